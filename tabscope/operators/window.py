"""Row-ordered window features, and a global prefix scan.

A plain window holds all rows of a key, or without a key all rows, in one task.
Here the rows are range-partitioned on (key, order), checkpointed (so partition
ids are fixed and the lineage is cut), and each partition gets its offset per
key from a table of totals (one row per partition and key). Rolling frames
additionally receive the previous ``n - 1`` rows of earlier partitions as halo
rows. So a key holding a third of all rows is spread over many tasks;
``skew_safe=False`` asks for plain windows where every key is known to be small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_UNB = Window.unboundedPreceding

# Rows whose distinct values are counted and ranked in one task, and the tasks that a frequent value is dealt to.
RANK_ROWS, DEALS = 500_000, 16


def _cols(xs):
    return [F.col(x) if isinstance(x, str) else x for x in (xs or [])]


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which a null key equals a null key; ``right`` adds its other columns."""
    named = right.select(*[F.col(k).alias(f"_on_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_on_{k}"))
    return left.join(named, cond, how).drop(*[f"_on_{k}" for k in keys])


def _n_parts(df: DataFrame, partitions: int | None) -> int:
    if partitions:
        return partitions
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def sorted_ranges(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], partitions: int | None) -> DataFrame:
    """Range-partition on (keys, order), sort, tag each row with its partition id, checkpoint."""
    allk = list(keys) + list(order_by)
    st = (df.repartitionByRange(_n_parts(df, partitions), *allk).sortWithinPartitions(*allk)
          .withColumn("_pid", F.spark_partition_id()))
    return cut_lineage(st)


def _indexed(st: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Add _g: 0-based position of the row within its key, across partitions."""
    k = list(keys)
    cnt = st.groupBy("_pid", *k).agg(F.count(F.lit(1)).alias("_cnt"))
    wo = (Window.partitionBy(*k) if k else Window.partitionBy()).orderBy("_pid").rowsBetween(_UNB, -1)
    offs = cnt.select("_pid", *k, "_cnt", F.coalesce(F.sum("_cnt").over(wo), F.lit(0)).alias("_start"))
    w = Window.partitionBy("_pid", *k).orderBy(*order_by)
    return join_on(st, offs, ["_pid", *k]).withColumn("_g", F.col("_start") + F.row_number().over(w) - 1)


def prefix_scan(df: DataFrame, order_by: Sequence[str], value: Column | None = None, out: str = "cum",
                partition_by: Sequence[str] = (), partitions: int | None = None, few_keys: bool = False) -> DataFrame:
    """Running sum of ``value`` (default 1: a 1-based row number) in ``order_by`` order.

    Exact and deterministic for a unique order key; no stage runs on one task. ``few_keys``: the offsets, a row per
    range and key, are broadcast, and the rows keep to as many tasks as there are ranges.
    """
    v = value if value is not None else F.lit(1).cast("long")
    keys = list(partition_by)
    st = sorted_ranges(df.withColumn("_v", v), keys, order_by, partitions)
    tot = st.groupBy("_pid", *keys).agg(F.sum("_v").alias("_tot"))
    wo = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("_pid").rowsBetween(_UNB, -1)
    offs = tot.select("_pid", *keys, F.sum("_tot").over(wo).alias("_off"))
    w = Window.partitionBy("_pid", *keys).orderBy(*order_by).rowsBetween(_UNB, 0)
    if few_keys:
        st, offs = st.repartition(_n_parts(df, partitions), "_pid"), F.broadcast(offs)
    j = join_on(st, offs, ["_pid", *keys])
    # null offset = first partition of the key; null running sum (all-null values so far) stays null
    run = F.sum("_v").over(w)
    res = F.when(run.isNull(), F.col("_off")).when(F.col("_off").isNull(), run).otherwise(F.col("_off") + run)
    return j.withColumn(out, res).drop("_pid", "_v", "_off")


def global_row_index(df: DataFrame, order_by: Sequence[str], out: str = "row_index",
                     partition_by: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """W6 at scale: 0-based position in order_by order (within partition_by)."""
    r = prefix_scan(df, order_by, F.lit(1).cast("long"), "_rn1", partition_by, partitions)
    return r.withColumn(out, F.col("_rn1") - 1).drop("_rn1")


def _rolling_staged(df: DataFrame, specs: dict[str, tuple[str, Column, int]], order_by: Sequence[str],
                    partition_by: Sequence[str], partitions: int | None) -> DataFrame:
    """Rolling frames over range partitions with halo rows from earlier partitions."""
    keys = list(partition_by)
    n_max = max(n for _, (_, _, n) in specs.items())
    st = _indexed(sorted_ranges(df, keys, order_by, partitions), keys, order_by)
    base_cols = [c for c in st.columns]
    if n_max > 1:
        starts = (st.select("_pid", *keys, "_start").distinct()
                  .groupBy(*keys).agg(F.collect_list(F.struct("_pid", "_start")).alias("_starts")))
        # only the last n-1 rows of a partition can be needed by a later one
        tail = join_on(st.where(F.col("_g") >= F.col("_start") + F.col("_cnt") - (n_max - 1)), starts, keys) \
            if keys else st.where(F.col("_g") >= F.col("_start") + F.col("_cnt") - (n_max - 1)) \
            .withColumn("_starts", starts.select("_starts").scalar())
        halo = tail.select(*[c for c in base_cols if c != "_pid"], F.explode(F.filter(
            "_starts", lambda s: (s["_start"] > F.col("_g")) & (s["_start"] <= F.col("_g") + (n_max - 1)))).alias("_s"))
        halo = halo.withColumn("_pid", F.col("_s._pid")).drop("_s").withColumn("_halo", F.lit(True))
        u = st.withColumn("_halo", F.lit(False)).unionByName(halo.select(*base_cols, "_halo"))
    else:
        u = st.withColumn("_halo", F.lit(False))
    cols = {}
    for name, (kind, x, n) in specs.items():
        w = Window.partitionBy("_pid", *keys).orderBy("_g")
        cols[name] = _frame_expr(kind, x, n, w)
    return u.withColumns(cols).where(~F.col("_halo")).drop("_pid", "_cnt", "_start", "_g", "_halo")


def _frame_expr(kind: str, x: Column, n: int, w) -> Column:
    fr = w.rowsBetween(-(n - 1), 0)
    if kind == "mean":
        return F.avg(x).over(fr)
    if kind == "sum":
        return F.sum(x).over(fr)
    if kind == "std":
        return F.coalesce(F.stddev_samp(x).over(fr), F.lit(0.0))
    if kind == "diff":
        return F.coalesce(x - F.lag(x, 1).over(w), F.lit(0.0))
    raise ValueError(kind)


def rolling(df: DataFrame, specs: dict[str, tuple[str, str | Column, int]], order_by: Sequence[str],
            partition_by: Sequence[str] = (), skew_safe: bool | None = None,
            partitions: int | None = None) -> DataFrame:
    """W1-W4 together: specs {out: (kind in mean|sum|std|diff, column, n)}; min_periods = 1.

    ``order_by`` must be unique within ``partition_by`` for a deterministic result.
    """
    specs = {k: (kind, F.col(x).cast("double") if isinstance(x, str) else x, n if kind != "diff" else 2)
             for k, (kind, x, n) in specs.items()}
    staged = skew_safe is None or skew_safe
    if staged:
        return _rolling_staged(df, specs, order_by, partition_by, partitions)
    w = Window.partitionBy(*partition_by).orderBy(*order_by)
    return df.withColumns({k: _frame_expr(kind, x, n, w) for k, (kind, x, n) in specs.items()})


def rolling_mean(df, x, n, order_by, partition_by=(), out=None, **kw):
    """Mean of the last n rows (min_periods 1)."""
    return rolling(df, {out or f"{x}_roll{n}_mean": ("mean", x, n)}, order_by, partition_by, **kw)


def rolling_sum(df, x, n, order_by, partition_by=(), out=None, **kw):
    """Sum of the last n rows."""
    return rolling(df, {out or f"{x}_roll{n}_sum": ("sum", x, n)}, order_by, partition_by, **kw)


def rolling_std(df, x, n, order_by, partition_by=(), out=None, **kw):
    """Sample sd of the last n rows, 0 where undefined."""
    return rolling(df, {out or f"{x}_roll{n}_std": ("std", x, n)}, order_by, partition_by, **kw)


def diff(df, x, order_by, partition_by=(), out=None, **kw):
    """X - previous x, 0 on the first row (and where undefined)."""
    return rolling(df, {out or f"{x}_diff": ("diff", x, 2)}, order_by, partition_by, **kw)


def cumulative_sum(df: DataFrame, x: str | Column, order_by: Sequence[str], partition_by: Sequence[str] = (),
                   out: str = "cumsum", skew_safe: bool | None = None, partitions: int | None = None) -> DataFrame:
    """Running total (of a column or an expression)."""
    v = F.col(x).cast("double") if isinstance(x, str) else x
    staged = skew_safe is None or skew_safe
    if staged:
        return prefix_scan(df, order_by, v, out, partition_by, partitions)
    w = Window.partitionBy(*partition_by).orderBy(*order_by).rowsBetween(_UNB, 0)
    return df.withColumn(out, F.sum(v).over(w))


def row_index(df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str] = (), out: str = "row_index",
              skew_safe: bool | None = None, partitions: int | None = None) -> DataFrame:
    """0-based position."""
    staged = skew_safe is None or skew_safe
    if staged:
        return global_row_index(df, order_by, out, partition_by, partitions)
    return df.withColumn(out, (F.row_number().over(Window.partitionBy(*partition_by).orderBy(*order_by)) - 1).cast("long"))


def counted_values(df: DataFrame, keys: Sequence[str], value: str, **counts: Column) -> tuple[DataFrame, int]:
    """(keys..., ``value``, n, ``counts``...) per distinct non-null value, and the number of tasks that hold them.

    The number follows the rows, not the session: a task aggregates about RANK_ROWS of them, where a partial aggregate
    would hold all that differ in an input split. A frequent value is dealt to some tasks and summed from their counts.
    """
    keys = [*keys, value]
    rows = df.where(F.col(value).isNotNull()).select(*keys, *[x.alias(n) for n, x in counts.items()])
    parts = max(_n_parts(df, None), -(-rows.count() // RANK_ROWS))
    dealt = rows.withColumn("_deal", F.spark_partition_id() % DEALS).repartition(parts, *keys, "_deal")
    part = dealt.groupBy(*keys, "_deal").agg(F.count(F.lit(1)).alias("n"), *[F.count(n).alias(n) for n in counts])
    merged = part.repartition(parts, *keys).groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(n).alias(n) for n in counts])
    return merged, parts


def average_rank(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """Ties share the mean rank (1-based), nulls unranked.

    Works on the distinct (group, value) table: a running count over distinct values
    (a prefix scan, so a group with many values is many tasks), then
    rank = cum - n + (n + 1) / 2, joined back on (group, value).
    """
    by = list(by)
    v = F.col(value)
    counts = df.where(v.isNotNull()).groupBy(*by, v.alias("_val")).agg(F.count(F.lit(1)).alias("_n"))
    ranks = prefix_scan(counts, ["_val"], F.col("_n"), "_cum", by)
    ranks = ranks.select(*by, "_val", (F.col("_cum") - F.col("_n") + (F.col("_n") + 1) / 2.0).alias(out), "_n")
    j = df.join(ranks.withColumnsRenamed({b: f"_by_{b}" for b in by}),
                [df[b].eqNullSafe(F.col(f"_by_{b}")) for b in by] + [df[value] == F.col("_val")], "left")
    return j.drop(*[f"_by_{b}" for b in by], "_val", "_n")


def rank_table(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """W7 in compact form: (by..., value, n, avg_rank) per distinct value."""
    by = list(by)
    v = F.col(value)
    counts, parts = counted_values(df.select(*by, v.alias("value")), by, "value")
    ranks = prefix_scan(counts, ["value"], F.col("n"), "_cum", by, parts)
    return ranks.select(*by, "value", "n", (F.col("_cum") - F.col("n") + (F.col("n") + 1) / 2.0).alias("avg_rank"))


def group_share(df: DataFrame, by: Sequence[str], digits: int = 2) -> DataFrame:
    """Count and pct of all rows per level (the level table is one row per level)."""
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("pct", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()) * 100, digits))
