"""Exact quantiles by distributed selection on rounded doubles.

Three passes narrow a histogram for all groups and ranks at once: a pass counts the values, rounded to 11 bits, to 32
bits and not at all, inside the buckets that still hold a wanted rank (partial counts per task), and the running count
over a bucket's rounded values finds the next, narrower bucket. Rounding keeps the order and costs a product and two
differences a row. A bucket is counted once, however many ranks it holds. Rows are never sorted, and no task sees more
of a group than its histogram, whose length is bounded by the bits of a pass.

``exact_quantiles`` serves the columns of a wide table whose quantiles go to the driver anyway: one histogram of slots of
equal width over all columns finds the slots that hold the wanted ranks, and only the rows of those are grouped.
Columns whose values crowd in a slot go through the three passes.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import long_form

#: Bits that the first two passes round away; the third counts the values themselves.
ROUNDED_BITS = (42, 21)

#: Columns of one scan, slots of a column's histogram, and the rows of a slot up to which they are grouped in one window.
SCAN_COLUMNS, SLOTS, SLOT_ROWS = 40, 4096, 1_000_000


def order_code(x: Column) -> Column:
    """A long that orders as the double does: -0.0 as 0.0, infinities beyond all numbers, NaN last."""
    a = F.abs(x)
    two = F.lit(2.0)
    normal = (a >= 2.0 ** -1022) & (a < float("inf"))
    safe = F.when(normal, a).otherwise(1.0)
    near = F.floor(F.log2(safe)).cast("double")  # right but for a unit next to powers of two
    e = near + (safe >= F.pow(two, near + 1)).cast("double") - (safe < F.pow(two, near)).cast("double")
    fraction = (safe * F.pow(two, -e) - 1.0) * 2.0 ** 52
    size = (F.when(F.isnan(a), F.lit((2047 << 52) + 1)).when(a == float("inf"), F.lit(2047 << 52))
            .when(normal, (e + 1023).cast("long") * F.lit(1 << 52) + fraction.cast("long"))
            .otherwise((F.when(a < 2.0 ** -1022, a).otherwise(0.0) * 2.0 ** 537 * 2.0 ** 537).cast("long")))
    return F.when(x < 0, -size).otherwise(size)


def rounded(x: Column, bits: int) -> Column:
    """x to 53 - ``bits`` bits, to nearest (Veltkamp's splitting): never falls where x rises; infinities and NaN stay."""
    def near(v):
        c = v * (2.0 ** bits + 1)
        return c - (c - v)
    size = F.abs(x)
    return (F.when(size < 2.0 ** 960, near(x)).when(size <= sys.float_info.max, near(x * 2.0 ** -64) * 2.0 ** 64).otherwise(x))


def _holding(counts: DataFrame, by: Sequence[str], inside: Sequence[str], p: str) -> DataFrame:
    """The buckets ``p`` that hold a wanted rank; ``_t`` then has the ranks inside them."""
    w = Window.partitionBy(*by, *inside).orderBy(p).rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("_cum") - F.col("_n")
    here = F.filter("_t", lambda t: (t["rank"] >= before) & (t["rank"] < F.col("_cum")))
    held = counts.withColumn("_cum", F.sum("_n").over(w)).withColumn("_t", here).where(F.size("_t") > 0)
    left = F.transform("_t", lambda t: F.struct(t["i"].alias("i"), (t["rank"] - before).alias("rank")))
    return held.select(*by, *inside, p, "_total", left.alias("_t"))


def _join_in(left: DataFrame, right: DataFrame, by: Sequence[str], inside: Sequence[str]) -> DataFrame:
    """Inner join on groups, where null equals null, and buckets, which are never null."""
    keys = [*by, *inside]
    named = right.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    cond = [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in by] + [F.col(k) == F.col(f"_on_{k}") for k in inside]
    return left.join(named, cond).drop(*[f"_on_{k}" for k in keys])


def quantile_table(long: DataFrame, probs: Sequence[float], by: Sequence[str] = ("column",), name: str = "q",
                   bounded: bool = True) -> DataFrame:
    """Linear-interpolated quantiles (pandas' default) of ``value`` per group: by..., ``name`` (array in the order of ``probs``).

    Nulls are left out, NaN counts as the largest value; a group without values has no row. ``bounded`` says that the
    groups are few (columns, levels of a small factor): the buckets sought, at most two per group and quantile, are then
    broadcast; otherwise they are joined as Spark sees fit.
    """
    by = list(by)
    few = F.broadcast if bounded else (lambda df: df)
    value = F.col("value")
    rows = long.where(value.isNotNull()).select(*by, value.cast("double").alias("value"))
    rows = rows.select(*by, "value", rounded(value, ROUNDED_BITS[0]).alias("_p0"))

    # pass 1: all rows; each target (quantile, lower or upper neighbour) finds the bucket that holds its rank
    first = rows.groupBy(*by, "_p0").agg(F.count(F.lit(1)).alias("_n"))
    first = first.withColumn("_total", F.sum("_n").over(Window.partitionBy(*by)))
    at = [(F.col("_total") - 1).cast("double") * float(p) for p in probs]
    ranks = F.array(*[F.struct(F.lit(2 * i + k).alias("i"), side(x).cast("long").alias("rank"))
                      for i, x in enumerate(at) for k, side in enumerate((F.floor, F.ceil))])
    found = _holding(first.withColumn("_t", ranks), by, [], "_p0")

    # passes 2 and 3: rows of those buckets only, which keep their bucket's name: a rounded value may lie in two
    for inside, p, next_bucket in ((["_p0"], "_p1", rounded(value, ROUNDED_BITS[1])), (["_p0", "_p1"], "_p2", value)):
        here = _join_in(rows, few(found.select(*by, *inside)), by, inside)
        rows = rows.withColumn(p, next_bucket)
        counts = here.groupBy(*by, *inside, next_bucket.alias(p)).agg(F.count(F.lit(1)).alias("_n"))
        found = _holding(_join_in(counts, few(found), by, inside), by, inside, p)

    ends = found.select(*by, "_total", F.col("_p2").alias("value"), F.explode("_t.i").alias("_i"))
    ends = ends.groupBy(*by).agg(F.max("_total").alias("_total"), *[F.max(F.when(F.col("_i") == i, value)).alias(f"_v{i}") for i in range(2 * len(at))])
    out = []
    for i, x in enumerate(at):
        low, high = F.col(f"_v{2 * i}"), F.col(f"_v{2 * i + 1}")
        out.append(F.when(low == high, low).otherwise((F.ceil(x) - x) * low + (x - F.floor(x)) * high))
    return ends.select(*by, F.array(*out).alias(name))


def quantile_scalars(df: DataFrame, cols: Sequence[str | Column], probs: Sequence[float]) -> Column:
    """One scalar subquery: struct of arrays ``c0``, ``c1``, ... with the quantiles of each column (null without values)."""
    values = [F.col(c) if isinstance(c, str) else c for c in cols]
    pairs = F.array(*[F.struct(F.lit(i).alias("column"), v.cast("double").alias("value")) for i, v in enumerate(values)])
    long = df.select(F.explode(pairs).alias("p")).select("p.column", "p.value")
    found = quantile_table(long, probs)
    return found.agg(F.struct(*[F.max_by("q", F.when(F.col("column") == i, F.lit(1))).alias(f"c{i}") for i in range(len(values))]).alias("s")).scalar()


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float]]:
    """``quantile_table`` of whole columns on the driver: column -> quantiles in the order of ``probs``.

    Nulls are left out, NaN counts as the largest value; columns without values have no entry.
    """
    out = {}
    for s in range(0, len(cols), SCAN_COLUMNS):
        out |= _scan_quantiles(df, cols[s:s + SCAN_COLUMNS], probs)
    return out


def _scan_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float]]:
    raw = df.select(*[F.col("`" + c.replace("`", "``") + "`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    work = raw.select(*[F.nanvl(f"c{i}", F.lit(None).cast("double")).alias(f"c{i}") for i in range(len(cols))])
    size = [F.abs(f"c{i}") <= sys.float_info.max for i in range(len(cols))]
    stats = raw.agg(*[F.struct(F.count(f"c{i}").alias("rows"), F.min(F.when(ok, F.col(f"c{i}"))).alias("low"), F.max(F.when(ok, F.col(f"c{i}"))).alias("high")).alias(f"s{i}")
                      for i, ok in enumerate(size)]).first()
    stats = {i: stats[f"s{i}"] for i in range(len(cols)) if stats[f"s{i}"]["rows"]}
    if not stats:
        return {}
    at = {i: [float(s["rows"] - 1) * float(p) for p in probs] for i, s in stats.items()}
    wanted = {i: sorted({int(r) for x in xs for r in (math.floor(x), math.ceil(x))}) for i, xs in at.items()}
    value = {(i, r): math.nan for i in wanted for r in wanted[i]}  # beyond all numbers: NaN

    cells = []
    for i, s in stats.items():
        v = F.col(f"c{i}")
        width = s["high"] - s["low"] if s["low"] is not None else 0.0
        scale = SLOTS / width if width and math.isfinite(SLOTS / width) else 0.0
        slot = F.floor((v - F.lit(s["low"])) * scale) if scale else F.lit(0).cast("long")
        slot = F.when(v == math.inf, F.lit(2 * SLOTS).cast("long")).when(v == -math.inf, F.lit(-1).cast("long")).otherwise(slot)
        cells.append(F.when(v.isNotNull(), F.struct(F.lit(i).alias("i"), slot.alias("slot"), v.alias("value"))))
    slots = _ranked(work, cells, "slot", [(i, r, r) for i in wanted for r in wanted[i]])
    narrow, hard = {}, set()
    for x in slots:
        if x["least"] == x["most"]:
            value[x["i"], x["rank"]] = x["least"]
        elif x["n"] > SLOT_ROWS:
            hard.add(x["i"])
        else:
            narrow.setdefault((x["i"], x["least"], x["most"]), []).append((x["rank"], x["place"]))
    if hard:
        crowded = raw.select(*[F.col(f"c{i}") for i in sorted(hard)])
        table = {r["column"]: r["q"] for r in quantile_table(long_form(crowded, crowded.columns), probs).collect()}
    if narrow:
        cells = {}
        for k, (i, least, most) in enumerate(narrow):
            inside = (F.col(f"c{i}") >= least) & (F.col(f"c{i}") <= most)
            cell = F.struct(F.lit(k).alias("i"), F.col(f"c{i}").alias("value"))
            cells[i] = cells[i].when(inside, cell) if i in cells else F.when(inside, cell)
        found = _ranked(work, [*cells.values()], "value", [(k, r, place) for k, ranks in enumerate(narrow.values()) for r, place in ranks])
        columns = [i for i, _, _ in narrow]
        value |= {(columns[x["i"]], x["rank"]): x["value"] for x in found}

    out = {}
    for i in stats:
        ends = [(value[i, math.floor(x)], value[i, math.ceil(x)]) for x in at[i]]
        out[cols[i]] = table[f"c{i}"] if i in hard else [a if a == b else (math.ceil(x) - x) * a + (x - math.floor(x)) * b for x, (a, b) in zip(at[i], ends)]
    return out


def _ranked(work: DataFrame, cells: Sequence[Column], key: str, sought: Sequence[tuple[int, int, int]]) -> list[Row]:
    """The groups (``i``, ``key``) of the cells that hold a sought (i, rank, place); ``place`` comes back as the place in the group."""
    inside = work.select(F.explode(F.array(*cells)).alias("cell")).where(F.col("cell").isNotNull()).select("cell.*")
    ends = [F.min("value").alias("least"), F.max("value").alias("most")] if key != "value" else []
    n = inside.groupBy("i", key).agg(F.count(F.lit(1)).alias("n"), *ends)
    n = n.withColumn("upto", F.sum("n").over(Window.partitionBy("i").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)))
    ranks = work.sparkSession.createDataFrame([*sought], "k int, rank long, at long")
    before = F.col("upto") - F.col("n")
    held = (F.col("i") == F.col("k")) & (F.col("at") >= before) & (F.col("at") < F.col("upto"))
    return n.join(F.broadcast(ranks), held).withColumn("place", F.col("at") - before).collect()
