"""Artifact store: tables beside a manifest; used again only if content and parameters are the same."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import running
from ..runtime import exists, log, read_text, scratch, write_text

#: Digests that are hashed into one digest of the next level.
BLOCK = 4096


def row_digest(*cols: str) -> Column:
    return F.sha2(F.concat_ws("␟", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), 256)


def content_hash(df: DataFrame, key: str, *cols: str) -> str:
    """SHA-256 of the rows in the order of their key: a tree of digests of BLOCK rows each, so no task sees all rows."""
    level = df.select(F.col(key).alias("k"), row_digest(key, *cols).alias("h"))
    while True:
        level = running(level, ["k", "h"], F.lit(1).cast("long")).withColumn("b", F.expr(f"before div {BLOCK}"))
        level = level.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("before", "h"))).alias("x"))
        level = scratch(level.select(F.col("b").alias("k"), F.sha2(F.array_join(F.col("x.h"), ""), 256).alias("h")), "digests")
        n = level.count()
        if n <= 1:
            rows = level.collect()
            return rows[0].h if rows else ""


@cache
def code_version() -> str:
    """A hash of the code that builds artifacts: what older code built is built again."""
    root = Path(__file__).resolve().parents[1]
    digest = hashlib.sha256()
    for p in sorted(p for part in ("features", "functions", "operators") for p in (root / part).glob("*.py")):
        digest.update(p.read_bytes())
    return digest.hexdigest()[:16]


class ArtifactStore:
    """Tables under a root folder. Each name has a manifest and versions; a new version is whole before the manifest names it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def manifest(self, name: str) -> dict | None:
        path = f"{self.root}/{name}/manifest.json"
        return json.loads(read_text(self.spark, path)) if exists(self.spark, path) else None

    def cached(self, name: str, content: str, params: dict, build: Callable[[], DataFrame | list[DataFrame]], force: bool = False) -> DataFrame:
        """The stored table if its manifest has the same content hash, parameters and code, else a newly built one.

        What is built may be a list of tables, which are written one after the other.
        """
        params = json.loads(json.dumps({**params, "code": code_version()}, default=str))
        if not force:
            try:
                found = self.manifest(name)
                if found and found["content"] == content and found["params"] == params:
                    return self.spark.read.parquet(f"{self.root}/{name}/{found['version']}")
            except Exception as e:  # an unreadable store is an empty one
                log.warning("artifact %s can't be read, building it again: %s", name, e)
        version = uuid.uuid4().hex
        path = f"{self.root}/{name}/{version}"
        made = build()
        for part in made if isinstance(made, list) else [made]:
            part.write.mode("append").parquet(path)
        out = self.spark.read.parquet(path)
        manifest = {"content": content, "params": params, "version": version, "rows": out.count(), "columns": out.columns}
        write_text(self.spark, f"{self.root}/{name}/manifest.json", json.dumps(manifest, ensure_ascii=False, indent=2))
        return out

    def save_json(self, name: str, value: dict) -> str:
        path = f"{self.root}/{name}.json"
        write_text(self.spark, path, json.dumps(value, ensure_ascii=False, indent=2, default=str))
        return path


def fingerprint(df: DataFrame) -> str:
    """A hash of the rows in any order, in one pass: their number, and the sum and exclusive or of two row hashes."""
    cols = sorted(df.columns)
    a, b = F.xxhash64(*cols), F.xxhash64(F.lit("second"), *cols)
    row = df.agg(F.count("*"), F.sum(a.cast("decimal(38,0)")), F.sum(b.cast("decimal(38,0)")), F.bit_xor(a), F.bit_xor(b)).first()
    return "-".join(map(str, [*row, *cols]))
