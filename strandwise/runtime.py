"""Settings, timers, and scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import logging
import os
import tempfile
import time
import uuid
import zipfile
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("strandwise")


@dataclass(frozen=True)
class Settings:
    """Where a run keeps its files, and its constants."""

    root: str = "artifacts"
    run_tag: str = "hybrid"
    seed: int = 42
    image_size: int = 518
    last_year: int = 2026

    def path(self, *names: str) -> str:
        return "/".join([self.root.rstrip("/"), *names])


def init_logging(level: int = logging.INFO) -> None:
    logging.basicConfig(level=level, format="%(levelname)s:%(name)s:%(message)s")


@contextmanager
def duration(name: str):
    """Log how long a block took; yields a dict that holds the milliseconds afterwards."""
    out: dict = {}
    start = time.perf_counter()
    try:
        yield out
    finally:
        out["ms"] = (time.perf_counter() - start) * 1000
        log.info("%s %.1f ms", name, out["ms"])


_SHIPPED: set[str] = set()


def ship(spark: SparkSession | None = None) -> None:
    """Send this package to the executors once per application (they need not share a file system)."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or spark.sparkContext.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="strandwise-"), "strandwise_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in root.rglob("*.py"):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(spark.sparkContext.applicationId)


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. On one machine a local one is set where none is; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        if have.isDefined():
            found = have.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            found = tempfile.mkdtemp(prefix="strandwise-")
            spark.sparkContext.setCheckpointDir(found)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return found.rstrip("/")


#: What holds inside scratch_until(): shuffled files go as their query ends, and few rows (with their vectors) are in
#: the memory of a task and its Python worker at once.
INSIDE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}
#: Paths of the scratch tables written inside the open scratch_until() blocks, the innermost last.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("strandwise_scratch", default=())


def scratch(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write to the shared folder (in a folder per value of `by`) and read back: cuts lineage, survives lost executors."""
    path = f"{shared_root(df.sparkSession)}/strandwise-{name}-{uuid.uuid4().hex}"
    if _OPEN.get():
        _OPEN.get()[-1].append(path)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_until(spark: SparkSession):
    """Scratch tables written inside are deleted at the end; nothing that is used afterwards may read them.

    Queries that run inside delete their shuffled files as they end.
    """
    mine: list[str] = []
    token = _OPEN.set((*_OPEN.get(), mine))
    before = {k: spark.conf.get(k, None) for k in INSIDE}
    for k, v in INSIDE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        _OPEN.reset(token)
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
        for path in mine:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, by whatever file system the path names."""
    return spark.read.text(path, wholetext=True).first()[0]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written by the driver through Hadoop's file systems (no local path is assumed)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
