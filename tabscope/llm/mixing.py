"""Mixing sources to target weights: capped targets, a time-varying curriculum, training positions. Native functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, n_words

#: Weight and slope of the sources in their order, repeating. A source's weight at training time t in [0, 1] is
#: weight * (1 + slope * (2 t - 1)): it integrates to ``weight``, and rises or falls over the training.
WEIGHTS = (1, 2, 3)
SLOPES = (0.5, 0.0, -0.5)
#: Largest number of times that a source may be repeated.
CAP = 3
#: Hex digits of the order key that make a bucket of a source, and those that place a document inside its bucket.
BUCKET_DIGITS, INNER_DIGITS = 3, 10
#: Rows (source, bucket) of the table of sums up to which it is sent to the documents; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000


def _cycle(values: tuple, rank: Column) -> Column:
    return F.element_at(F.array(*(F.lit(float(v)) for v in values)), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, slopes: tuple = SLOPES, cap: float = CAP) -> DataFrame:
    """Per source (``source_key``, ``source``, ``source_size``): its ``target`` and ``slope``.

    The sources, by code point with null last, weigh ``weights`` in turn and share the sum of all sizes. A target stops
    at ``cap`` times its source's size and the excess is shared again by weight. In the order of size / weight the
    sources that stop come first, so one running sum over the sources finds all of them at once. One row per source.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = (ranked.withColumn("weight", _cycle(weights, F.col("rank"))).withColumn("slope", _cycle(slopes, F.col("rank")))
              .withColumn("top", F.lit(float(cap)) * F.col("source_size"))
              .withColumn("ratio", F.col("top") / F.col("weight")))
    whole = Window.partitionBy()
    order = Window.orderBy("ratio", "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (ranked.withColumn("total", F.sum("source_size").over(whole).cast("double"))
              .withColumn("topped", F.coalesce(F.sum("top").over(before), F.lit(0.0)))
              .withColumn("heavy", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
              .withColumn("level", (F.col("total") - F.col("topped")) / F.col("heavy")))
    level = F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "rank", "level"))).over(whole)["level"]
    return ranked.withColumn("shared", level).select(
        "source_key", "source_size", "slope",
        F.when(F.col("shared").isNull() | (F.col("ratio") <= F.col("shared")), F.col("top")).otherwise(F.col("weight") * F.col("shared")).alias("target"))


def mix_plan(docs: DataFrame, weights: tuple = WEIGHTS, slopes: tuple = SLOPES, cap: float = CAP, prefix: str = "") -> DataFrame:
    """``docs`` (doc_id, text, source) with ``size``, ``source_size``, ``target``, ``copies``, ``taken``, ``slope`` and
    ``middle`` (words of the source up to the middle of the document), each named with ``prefix``.

    Within a source the documents stand in the order of the md5 of doc_id and text. The mix reads that stream over and
    over until the source's target is met: every document ``floor(target / source_size)`` times, and those whose middle
    lies before the rest of the target once more. Sums of buckets (first digits of the key) say which bucket holds the
    end of the rest; inside that one bucket of a source the running sum over its keys is exact, so a target is met
    within one document. Rows of one key are alike and stand one after the other; if the end falls among them, they are
    ranked, without the others. So texts are not shuffled. ``middle`` is exact for the sum before the bucket and reads
    the place inside it from the key's next digits. Null or wordless texts have size 0; extra columns stay.
    """
    p = prefix
    key, bucket, skey, size = f"{p}key", f"{p}bucket", f"{p}source_key", f"{p}size"
    keyed = (docs.withColumn(skey, F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")))
             .withColumn(key, F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.col("text").cast("string"), F.lit("")))))
             .withColumn(bucket, F.substring(key, 1, BUCKET_DIGITS)).withColumn(size, n_words(F.col("text"))))
    sums = materialize(keyed.groupBy(F.col(skey).alias("source_key"), F.col(bucket).alias("bucket"))
                       .agg(F.sum(size).alias("words")), "mix-sums")
    named = F.when(F.col("source_key") != "", F.expr("substring(source_key, 2)"))
    targets = source_targets(sums.groupBy("source_key").agg(F.sum("words").alias("source_size")).withColumn("source", named), weights, slopes, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("passes", whole).withColumn("rest", F.col("target") - whole * F.col("source_size"))
    ahead = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = materialize(sums.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0))).join(targets, "source_key"), "mix-buckets")

    # the end of the rest: one bucket of a source, one key of the bucket, so many of the key's rows
    ends = firsts.where((F.col("ahead") < F.col("rest")) & (F.col("rest") <= F.col("ahead") + F.col("words"))).select("source_key", "bucket", "ahead", "rest")
    narrow = keyed.select(F.col(skey).alias("source_key"), F.col(bucket).alias("bucket"), F.col(key).alias("key"), F.col(size).alias("size"))
    few = F.broadcast(ends) if ends.count() <= BROADCAST_ROWS else ends
    inside = narrow.join(few, ["source_key", "bucket"]).groupBy("source_key", "bucket", "key").agg(
        F.first("size").alias("size"), F.count(F.lit(1)).alias("rows"), F.first("ahead").alias("ahead"), F.first("rest").alias("rest"))
    before = Window.partitionBy("source_key").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("start", F.col("ahead") + F.coalesce(F.sum(F.col("size") * F.col("rows")).over(before), F.lit(0)))
    room = F.col("rest") - F.col("start") - F.col("size") / 2
    more = F.when(F.col("size") > 0, F.least(F.col("rows"), F.greatest(F.lit(0), F.ceil(room / F.col("size"))))).otherwise(
        F.when(room > 0, F.col("rows")).otherwise(F.lit(0)))
    inside = inside.withColumn("more", more.cast("long"))
    last = inside.where("more > 0").groupBy("source_key").agg(F.max_by(F.struct("key", "more", "rows"), F.col("key")).alias("last"))
    bounds = materialize(ends.select("source_key", F.col("bucket").alias("end_bucket")).join(last, "source_key", "left")
                         .select("source_key", "end_bucket", "last.key", "last.more", "last.rows"), "mix-ends")
    firsts = firsts.join(bounds, "source_key", "left").select(
        F.col("source_key").alias(skey), F.col("bucket").alias(bucket),
        *[F.col(c).alias(f"{p}{c}") for c in ("ahead", "words", "source_size", "target", "slope", "passes", "rest", "end_bucket")],
        F.col("key").alias(f"{p}end_key"), F.col("more").alias(f"{p}end_more"), F.col("rows").alias(f"{p}end_rows"))
    if firsts.count() <= BROADCAST_ROWS:
        firsts = F.broadcast(firsts)
    c = {n: F.col(f"{p}{n}") for n in ("ahead", "words", "source_size", "target", "middle", "size", "passes", "copies", "rest", "end_bucket", "end_key", "end_more", "end_rows", "nth")}
    inner = F.conv(F.substring(key, BUCKET_DIGITS + 1, INNER_DIGITS), 16, 10).cast("double") / F.lit(float(16 ** INNER_DIGITS))
    planned = keyed.join(firsts, [skey, bucket]).withColumn(f"{p}middle", c["ahead"] + inner * (c["words"] - c["size"]) + c["size"] / 2)
    split = F.coalesce((F.col(key) == c["end_key"]) & (c["end_more"] < c["end_rows"]), F.lit(False))
    if bounds.where("more < rows").isEmpty():
        planned = planned.withColumn(f"{p}nth", F.lit(0).cast("long"))
    else:
        # rows of the key at the end: ranked inside the partition they come from, and across by the partitions' counts
        alike = materialize(planned.where(split).withColumn(f"{p}pid", F.spark_partition_id()), "mix-alike")
        counts = alike.groupBy(skey, f"{p}pid").agg(F.count(F.lit(1)).alias(f"{p}n"))
        earlier = Window.partitionBy(skey).orderBy(f"{p}pid").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.select(skey, f"{p}pid", F.coalesce(F.sum(f"{p}n").over(earlier), F.lit(0)).alias(f"{p}first"))
        ranks = Window.partitionBy(skey, f"{p}pid").orderBy(key)
        alike = alike.join(counts, [skey, f"{p}pid"]).withColumn(f"{p}nth", F.col(f"{p}first") + F.row_number().over(ranks) - 1).drop(f"{p}pid", f"{p}first")
        planned = planned.where(~split).withColumn(f"{p}nth", F.lit(0).cast("long")).unionByName(alike)
    ahead_of_end = (F.col(bucket) < c["end_bucket"]) | ((F.col(bucket) == c["end_bucket"]) & (
        (F.col(key) < c["end_key"]) | ((F.col(key) == c["end_key"]) & (c["nth"] < c["end_more"]))))
    planned = (planned.withColumn(f"{p}copies", c["passes"] + F.when(ahead_of_end, F.lit(1)).otherwise(F.lit(0)))
               .withColumn(f"{p}taken", c["copies"] * c["size"]))
    return planned.select(*docs.columns, *(f"{p}{n}" for n in ("size", "source_size", "target", "copies", "taken", "slope", "middle", "key")))


def position(reached: Column, slope: Column) -> Column:
    """Training time t at which a source has used the share ``reached`` of its target.

    The share used by t is the integral of 1 + slope (2 t - 1), that is slope t^2 + (1 - slope) t; this is its inverse.
    """
    b = F.lit(1.0) - slope
    root = (F.sqrt(b * b + F.lit(4.0) * slope * reached) - b) / (F.lit(2.0) * slope)
    return F.when(slope == 0, reached).otherwise(root)


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, slopes: tuple = SLOPES, cap: float = CAP, into: str | None = None) -> DataFrame:
    """The mix itself: each document as often as it is taken, range-sorted by training position; the columns of ``docs``
    and, if ``into`` names one, the position (0 to 1). Documents of which no copy is taken are not in the mix."""
    p = "mix_"
    while any(c.startswith(p) for c in docs.columns):
        p += "_"
    plan = mix_plan(docs, weights, slopes, cap, p)
    each = plan.where(F.col(f"{p}copies") > 0).withColumn(f"{p}copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{p}copies") - 1)))
    placed = each.withColumn(f"{p}position", first_position(p, F.col(f"{p}copy"))).orderBy(f"{p}position", f"{p}key", f"{p}copy")
    return placed.select(*docs.columns, *([F.col(f"{p}position").alias(into)] if into else []))


def first_position(prefix: str = "", copy: Column | None = None) -> Column:
    """Training position (0 to 1) of a document's copy (its first) in a plan."""
    p = prefix
    reached = (copy if copy is not None else F.lit(0)) * F.col(f"{p}source_size") + F.col(f"{p}middle")
    reached = F.least(F.lit(1.0), F.coalesce(F.try_divide(reached, F.col(f"{p}target")), F.lit(0.0)))
    return position(reached, F.col(f"{p}slope"))


def mix_table(docs: DataFrame) -> DataFrame:
    """One row per document, range-sorted by training position: doc_id, size, source_size, target, taken, copies and
    the ``position`` of its first copy (null, and last, if none is taken)."""
    plan = mix_plan(docs.select("doc_id", "text", "source"))
    plan = plan.select("doc_id", "size", "source_size", "target", "taken", "copies", F.when(F.col("copies") > 0, first_position()).alias("position"))
    return plan.orderBy(F.col("position").asc_nulls_last(), "doc_id")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || coalesce(text, '')) AS k,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM {docs}),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
 r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS n, CAST(1 + (n - 1) % 3 AS DOUBLE) AS w,
     CASE (n - 1) % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE -0.5::DOUBLE END AS slope FROM s),
 o AS (SELECT *, 3.0::DOUBLE * source_size AS top, 3.0::DOUBLE * source_size / w AS ratio FROM r),
 l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
     - coalesce(sum(top) OVER (ORDER BY ratio, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
     / sum(w) OVER (ORDER BY ratio, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
 i AS (SELECT *, row_number() OVER (ORDER BY ratio, n) AS nth FROM l),
 m AS (SELECT arg_min(level, nth) AS shared FROM i WHERE level < ratio),
 t AS (SELECT source, source_size, slope, CASE WHEN shared IS NULL OR ratio <= shared THEN top ELSE w * shared END AS target FROM l, m),
 b AS (SELECT source, k[1:3] AS bucket, sum(size) AS words,
     coalesce(sum(sum(size)) OVER (PARTITION BY source ORDER BY k[1:3] ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
   FROM d GROUP BY source, k[1:3]),
 x AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) - size AS start FROM d),
 p AS (SELECT x.doc_id, x.size, t.source_size, t.target, t.slope, start,
     CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS passes,
     b.ahead + CAST(('0x' || k[4:13])::BIGINT AS DOUBLE) / 1099511627776.0::DOUBLE * (b.words - x.size) + x.size / 2.0::DOUBLE AS middle
   FROM x JOIN t ON x.source IS NOT DISTINCT FROM t.source JOIN b ON x.source IS NOT DISTINCT FROM b.source AND x.k[1:3] = b.bucket),
 c AS (SELECT *, CAST(passes + CASE WHEN start + size / 2.0::DOUBLE < target - passes * source_size THEN 1 ELSE 0 END AS BIGINT) AS copies,
     least(1.0::DOUBLE, CASE WHEN target > 0 THEN middle / target ELSE 0 END) AS reached FROM p)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, copies, CASE WHEN copies > 0 THEN CASE WHEN slope = 0 THEN reached
  ELSE (sqrt((1 - slope) * (1 - slope) + 4.0::DOUBLE * slope * reached) - (1 - slope)) / (2.0::DOUBLE * slope) END END AS position FROM c"""
