"""Global order without a single task: ranks, running sums and quantiles over range partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import scratch


def running(df: DataFrame, by: list[str], value: Column, within: list[str] | None = None) -> DataFrame:
    """df plus `before`: the sum of `value` over the rows that come earlier by `by`, in each group of `within`.

    Rows are dealt to tasks by ranges of (within, by), so a large group is spread; each range's sums are small, and
    their running sums are joined back. `by` should have no ties, or equal rows come in no fixed order.
    """
    within = within or []
    keys = [*within, *by]
    cols = df.columns
    x = df.withColumn("_v", value).repartitionByRange(*keys).sortWithinPartitions(*keys)
    x = scratch(x.withColumn("_m", F.monotonically_increasing_id()), "ranges").withColumn("_p", F.expr("shiftright(_m, 33)"))
    groups = [*within, "_p"]
    sums = x.groupBy(*groups).agg(F.sum("_v").alias("_s"))
    earlier = Window.partitionBy(*within).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*groups, F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_o"))
    inner = Window.partitionBy(*groups).orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_i", F.coalesce(F.sum("_v").over(inner), F.lit(0)))
    for g in within:  # groups may be null
        sums = sums.withColumnRenamed(g, f"_g_{g}")
    on = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in within]
    sums = sums.withColumnRenamed("_p", "_q")
    return x.join(sums, [*on, x["_p"] == sums["_q"]]).select(*cols, (F.col("_o") + F.col("_i")).alias("before"))


def quantiles(df: DataFrame, value: Column, shares: list[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation; nulls are left out. Only the values asked for reach the driver."""
    counts = df.select(value.cast("double").alias("x")).where("x IS NOT NULL").groupBy("x").agg(F.count("*").alias("n"))
    at = running(counts, ["x"], F.col("n"))
    at = scratch(at, "counts")
    n = at.agg(F.sum("n")).first()[0]
    if not n:
        return [None] * len(shares)
    places = {s: s * (n - 1) for s in shares}
    want = sorted({int(p) for p in places.values()} | {min(int(p) + 1, n - 1) for p in places.values()})
    hit = " OR ".join(f"(before <= {w} AND {w} < before + n)" for w in want)
    rows = at.where(hit).collect()
    value_at = {w: next(r.x for r in rows if r.before <= w < r.before + r.n) for w in want}
    out = []
    for s in shares:
        low, part = int(places[s]), places[s] - int(places[s])
        out.append(value_at[low] + part * (value_at[min(low + 1, n - 1)] - value_at[low]))
    return out


def with_group_count(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """df plus the size of each row's group (nulls group together): counts are combined before they move, and only
    groups of two rows or more are joined back."""
    many = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.count("*").alias("_n")).where("_n > 1")
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return df.join(many, on, "left").select(*df.columns, F.coalesce("_n", F.lit(1)).cast("long").alias(name))
