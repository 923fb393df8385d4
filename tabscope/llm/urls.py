"""URL filters: host rules first, then a learned tree of path templates per host. Built from DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: The stated rules: (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Levels of the tree; a template ends in ** below them.
DEPTH = 4
#: Share of distinct segments among a branch's URLs from which they are variable, and the least number of them.
VARIABLE, LEAST_VARIABLE = 0.5, 3
#: Shares of blocked URLs are told apart in so many steps before branches are compared.
STEPS = 256
#: Labelled URLs that a template needs, strength of the prior, and smoothed purity from which it is rejected.
MIN_LABELS, PRIOR, PURITY = 5, 4.0, 0.8
#: Largest |z| at which two branches' shares of blocked URLs count as alike.
ALIKE = 1.96
#: A host's rows are dealt over so many keys where they meet its templates.
SALT = 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule whose host is the URL's or a parent of it and whose path starts the
    URL's path; null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # the last that fits is the longest
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def segment(path: Column, level: int) -> Column:
    """Segment of a path at a level (from 1), null below its end; one that holds a digit is variable, ``*``."""
    s = F.get(F.split(path, "/"), F.lit(level))
    return F.when(s.rlike("[0-9]"), F.lit("*")).otherwise(s)


def _merged(classes: Column) -> Column:
    """(step, group) of a branch's classes of children, (step, labelled, blocked), in the order of their shares of
    blocked URLs: a class joins the one before it if the two shares do not differ by the z test. At most STEPS + 1."""
    start = F.struct(F.array().cast("array<struct<step:int,group:int>>").alias("out"), F.lit(0).alias("group"),
                     F.lit(0).cast("long").alias("labelled"), F.lit(0).cast("long").alias("blocked"))

    def step(a, c):
        n, m = a["labelled"].cast("double"), c["labelled"].cast("double")
        pooled = (a["blocked"] + c["blocked"]) / (n + m)
        spread = F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m))
        same = F.when(a["labelled"] == 0, F.lit(False)).otherwise(F.abs(a["blocked"] / n - c["blocked"] / m) <= F.lit(ALIKE) * spread)
        group = a["group"] + F.when(same, F.lit(0)).otherwise(F.lit(1))
        return F.struct(F.concat(a["out"], F.array(F.struct(c["step"].alias("step"), group.alias("group")))).alias("out"), group.alias("group"),
                        F.when(same, a["labelled"] + c["labelled"]).otherwise(c["labelled"]).alias("labelled"),
                        F.when(same, a["blocked"] + c["blocked"]).otherwise(c["blocked"]).alias("blocked"))

    return F.aggregate(F.sort_array(classes), start, step)["out"]


def _branches(child: DataFrame) -> DataFrame:
    """host, prefix, seg -> ``branch`` for the children (host, prefix, seg, n, labelled, blocked) that keep a branch.

    Where the segments of a branch are variable, children with fewer than MIN_LABELS labelled URLs are left to the
    wildcard. Children without labels keep their own branch; of the others those of like shares become one, named by
    its least and largest segment and how many more it has.
    """
    at = ["host", "prefix"]
    literal = child.where(F.col("seg") != "*")
    spread = literal.groupBy(*at).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("of"))
    variable = spread.where((F.col("k") >= LEAST_VARIABLE) & (F.col("k") >= F.lit(VARIABLE) * F.col("of"))).select(*at, F.lit(True).alias("variable"))
    kept = literal.join(variable, at, "left").where(F.col("variable").isNull() | (F.col("labelled") >= MIN_LABELS))
    kept = kept.withColumn("step", F.when(F.col("labelled") > 0, F.round(F.col("blocked") / F.col("labelled") * STEPS).cast("int")))
    classes = kept.where("step IS NOT NULL").groupBy(*at, "step").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    lists = classes.groupBy(*at).agg(F.collect_list(F.struct("step", "labelled", "blocked")).alias("classes"))
    groups = lists.select(*at, F.explode(_merged(F.col("classes"))).alias("m")).select(*at, "m.step", "m.group")
    grouped = kept.join(groups, [*at, "step"], "left")
    names = grouped.where("group IS NOT NULL").groupBy(*at, "group").agg(F.min("seg").alias("a"), F.max("seg").alias("b"), F.count(F.lit(1)).alias("k"))
    rest = F.when(F.col("k") > 2, F.concat(F.lit("|+"), (F.col("k") - 2).cast("string"))).otherwise(F.lit(""))
    names = names.select(*at, "group", F.when(F.col("k") == 1, F.col("a")).otherwise(F.concat("a", F.lit("|"), "b", rest)).alias("name"))
    return grouped.join(names, [*at, "group"], "left").select(*at, "seg", F.coalesce("name", "seg").alias("branch"))


def template_tree(shapes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Template and verdict of every path shape: host, s1 .. s``depth``, more, ``template``, ``purity``, ``verdict``.

    ``shapes``: host, s1 .. s``depth`` (null below the path's end), ``more`` (the path goes on), n, labelled, blocked.
    Level by level, variable segments become a wildcard and children merge where labels show no difference
    (``_branches``), alike at any number of children. The template that judges a shape is its
    deepest one below the host with MIN_LABELS labelled URLs, and is rejected at a smoothed share of blocked URLs of
    PURITY: (blocked + PRIOR * share of all) / (labelled + PRIOR). A shape without such a template is allowed.
    """
    total = shapes.agg((F.sum("blocked") / F.sum("labelled")).alias("p")).first()["p"] if not shapes.isEmpty() else None
    base = float(total or 0.0)
    now = shapes.withColumn("prefix", F.lit("")).withColumn("evidence", F.lit(None).cast("struct<template:string,labelled:bigint,blocked:bigint>"))
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    for level in range(1, depth + 1):
        seg = f"s{level}"
        child = now.where(F.col(seg).isNotNull()).groupBy("host", "prefix", F.col(seg).alias("seg")).agg(*sums)
        names = _branches(child).withColumnRenamed("seg", seg)
        step = F.when(F.col(seg).isNotNull(), F.concat("prefix", F.lit("/"), F.coalesce("branch", F.lit("*"))))
        now = materialize(now.join(names, ["host", "prefix", seg], "left").withColumn("next", step).drop("branch"), "url-level")
        seen = now.where("next IS NOT NULL").groupBy("host", "next").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b")).where(F.col("l") >= MIN_LABELS)
        now = (now.join(seen, ["host", "next"], "left").withColumn("evidence", F.when(F.col("l").isNotNull(), F.struct(
            F.col("next").alias("template"), F.col("l").alias("labelled"), F.col("b").alias("blocked"))).otherwise(F.col("evidence")))
            .withColumn("prefix", F.coalesce("next", "prefix")).drop("next", "l", "b"))
    purity = (F.col("evidence.blocked") + F.lit(PRIOR * base)) / (F.col("evidence.labelled") + F.lit(PRIOR))
    template = F.concat("prefix", F.when(F.col("more"), F.lit("/**")).otherwise(F.lit("")))
    return now.select("host", *(f"s{i}" for i in range(1, depth + 1)), "more", template.alias("template"), purity.alias("purity"),
                      F.when(purity >= PURITY, F.lit("block")).otherwise(F.lit("allow")).alias("learned"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Verdict on every row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, template, purity.

    A rule decides where one fits, and the URLs that rules decide are the labels from which the templates learn; the
    template tree judges the rest. Null URLs and those without ``://`` have empty host and path and, like all hosts
    without evidence, are allowed. Paths are read whole; only the tree ends at DEPTH levels. Rows with a null page_id
    and repeated rows are judged and returned like others; extra columns are ignored; an empty table gives no rows.

    URLs are counted by host and path shape before any shuffle, so the tree grows with shapes, not rows; rows find
    their template by a join whose keys are dealt over SALT values, as one host may hold a third of the rows.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    hit = rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules)
    levels = [segment(F.col("path"), i).alias(f"s{i}") for i in range(1, DEPTH + 1)]
    more = (F.size(F.split("path", "/")) > DEPTH + 1).alias("more")
    rows = rows.select("page_id", "host", "path", hit.alias("hit"), *levels, more)
    keys = ["host", *(f"s{i}" for i in range(1, DEPTH + 1)), "more"]
    one = lambda c: F.sum(F.when(c, F.lit(1)).otherwise(F.lit(0))).cast("long")
    shapes = materialize(rows.groupBy(*keys).agg(F.count("*").alias("n"), one(F.col("hit").isNotNull()).alias("labelled"),
                                                 one(F.col("hit.verdict") == "block").alias("blocked")), "url-shapes")
    tree = materialize(template_tree(shapes), "url-tree").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALT)).cast("int"))
    same = [salted[k].eqNullSafe(tree[k]) for k in [*keys, "salt"]]
    found = salted.join(tree, same, "left")
    return found.select("page_id", salted["host"], "path", F.col("hit.rule").alias("rule"),
                        F.coalesce("hit.verdict", "learned", F.lit("allow")).alias("verdict"), "template", "purity")
