"""Readers, writers, fingerprints, marked-JSON extraction and contract checks."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

READERS = {"csv", "tsv", "json", "jsonl", "parquet", "orc"}


def read_table(spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | str | None = None,
               check_empty: bool = True) -> DataFrame:
    """Dispatch the reader on the format (csv / tsv with header and inferred types, json, parquet, orc)."""
    fmt = (fmt or os.path.splitext(path.rstrip("/"))[1].lstrip(".") or "parquet").lower()
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt in ("csv", "tsv"):
        r = r.option("header", True).option("inferSchema", schema is None)
        df = r.option("sep", "\t" if fmt == "tsv" else ",").csv(path)
    elif fmt in ("json", "jsonl"):
        df = r.json(path)
    elif fmt in ("parquet", "orc"):
        df = r.format(fmt).load(path)
    else:
        raise ValueError(f"unsupported format {fmt!r} (Excel needs converting first)")
    if check_empty and df.isEmpty():
        raise ValueError(f"empty dataset: {path}")
    return df


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """File listing (path, name, modificationTime, length) without reading contents."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True)
            .load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "modificationTime", "length"))


DATASET_EXTS = ["csv", "xlsx", "xls", "parquet", "json", "tsv"]


def latest_dataset(spark: SparkSession, path: str, kind: str = "raw") -> str | None:
    """Newest dataset by mtime; ``raw`` = a dataset extension without 'engineered' in its name,
    ``engineered`` = ``*_engineered.csv``. A dataset is a file, or a folder written by Spark
    (the first path segment carrying a dataset extension)."""
    files = list_files(spark, path)
    exts = "|".join(DATASET_EXTS)
    ds_path = F.regexp_extract("path", rf"^(.*?[^/]+\.({exts}))(/|$)", 1)
    ds_name = F.element_at(F.split(ds_path, "/"), -1)
    files = files.select(ds_path.alias("ds"), ds_name.alias("name"), "modificationTime").where(F.col("ds") != "")
    if kind == "engineered":
        files = files.where(F.col("name").endswith("_engineered.csv"))
    else:
        files = files.where(~F.col("name").contains("engineered"))
    row = files.agg(F.max_by("ds", F.struct("modificationTime", "ds")).alias("p")).first()
    return row["p"] if row else None


def head_sample(df: DataFrame, order_by: Sequence[str], n: int = 200) -> DataFrame:
    """S3: the first n rows in key order (a top-n, not a scan of everything to the driver)."""
    return df.orderBy(*order_by).limit(n)


def row_hash(cols: Sequence[str]) -> Column:
    """md5 of the row's text form; columns joined by the unit separator."""
    return F.md5(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in cols]))


def table_fingerprint(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Order-insensitive content hash: (rows, sum of 32-bit md5 prefixes, xor of xxhash64)."""
    cols = list(cols) if cols is not None else df.columns
    h = row_hash(cols)
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.sum(F.conv(F.substring(h, 1, 8), 16, 10).cast("long")).alias("md5_sum"),
                  F.bit_xor(F.xxhash64(*[F.col(c) for c in cols])).alias("xx_xor"))


def file_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """S4 for files: sha256 of each file's bytes."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def fingerprint_key(df: DataFrame, cols: Sequence[str] | None = None) -> str:
    r = table_fingerprint(df, cols).first()
    return f"{r['n_rows']}-{r['md5_sum']}-{r['xx_xor']}"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def materialize_once(df: DataFrame, base: str, build, cols: Sequence[str] | None = None) -> DataFrame:
    """Reuse the engineered table when both outputs for this input fingerprint exist, else rebuild.

    ``build(df) -> DataFrame``; outputs: ``{base}/{fp}/data`` and ``{base}/{fp}/_new_columns``.
    """
    spark = df.sparkSession
    fp = fingerprint_key(df, cols)
    data, meta = f"{base}/{fp}/data", f"{base}/{fp}/_new_columns"
    if _exists(spark, data) and _exists(spark, meta):
        return spark.read.parquet(data)
    out = build(df)
    out.write.mode("overwrite").parquet(data)
    new_columns(df, out).write.mode("overwrite").parquet(meta)
    return spark.read.parquet(data)


def new_columns(before: DataFrame, after: DataFrame) -> DataFrame:
    """S6 helper: columns added by feature engineering, with their types."""
    old = set(before.columns)
    rows = [(f.name, f.dataType.simpleString()) for f in after.schema.fields if f.name not in old]
    return after.sparkSession.createDataFrame(rows, "column string, dtype string")


def write_engineered(before: DataFrame, after: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Write the engineered table and return the list of new columns."""
    w = after.write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.format(fmt).save(path))
    return new_columns(before, after)


def write_results_json(sections: dict[str, DataFrame], path: str) -> None:
    """One JSON document per section row (``df.write.json``), a folder per section."""
    for name, df in sections.items():
        df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("doc")) \
            .write.mode("overwrite").json(f"{path}/{name}")


def report_table(sections: dict[str, tuple[DataFrame, Sequence]]) -> DataFrame:
    """Report rows (section, ordinal, item, field, value) from section tables and their sort keys.

    The first column of a table names the item; ``ordinal`` is its 1-based place by the sort keys (a global prefix
    scan, no one-task window). Without keys items go by name.
    """
    from ..operators.window import global_row_index
    out = None
    for name, (df, keys) in sections.items():
        key, vals = df.columns[0], df.columns[1:]
        keyed = df.withColumns({f"_k{i}": k for i, k in enumerate(keys)})
        order = [*[f"_k{i}" for i in range(len(keys))], key]
        ranked = global_row_index(keyed, order, out="_i")
        cast = ranked.select((F.col("_i") + 1).cast("long").alias("ordinal"), F.col(key).cast("string").alias("item"), *[F.col(c).cast("string").alias(c) for c in vals])
        u = cast.unpivot(["ordinal", "item"], list(vals), "field", "value").select(F.lit(name).alias("section"), "ordinal", "item", "field", "value")
        out = u if out is None else out.unionByName(u)
    return out


def ranked_findings(df: DataFrame, top: int = 5) -> DataFrame:
    """S8, findings: the ``top`` columns by outliers, by missing values, and pairs by |r|, as report rows.

    ``top`` is the length of the report's lists. Ties go by name.
    """
    from ..operators.assoc import pearson_pairs
    from ..operators.profile import missing_by_column, outliers_by_column
    pairs = pearson_pairs(df, with_p=False).select(F.concat_ws(" / ", "col1", "col2").alias("pair"), "pearson_r", "abs_r", "strength")
    sections = {"outliers": (outliers_by_column(df).select("column", "iqr_outliers", "iqr_outlier_pct", "severity"), [-F.col("iqr_outlier_pct")]),
                "missing": (missing_by_column(df).select("column", "count", "pct", "severity"), [-F.col("pct")]),
                "correlations": (pairs, [-F.col("abs_r")])}
    return report_table(sections).where(F.col("ordinal") <= top)


def write_predictions(pred: DataFrame, path: str, label: str = "label", prediction: str = "prediction") -> None:
    """(actual, predicted) table."""
    pred.select(F.col(label).alias("actual"), F.col(prediction).alias("predicted")).write.mode("overwrite").parquet(path)


def save_model(model, registry_path: str, models_dir: str, tag: str, name: str, family: str, score: float | None) -> str:
    """Save a fitted PipelineModel under models_<tag>/<name> and append a registry row."""
    from ..functions.scalar import clean_name  # noqa: F401 - name rules documented there
    import re
    safe = re.sub(r"[^a-zA-Z0-9_.-]+", "_", name).strip("_") or "model"
    path = f"{models_dir}/models_{tag}/{safe}"
    model.write().overwrite().save(path)
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(tag, safe, family, score, path)], "tag string, model string, family string, score double, path string") \
        .write.mode("append").parquet(registry_path)
    return path


def alias_overlap(a: Column, b: Column) -> Column:
    """U4: two arrays of names have one in common, whatever its case; nulls have none."""
    low = lambda x: F.transform(F.coalesce(x, F.array().cast("array<string>")), F.lower)
    return F.arrays_overlap(F.filter(low(a), lambda n: n.isNotNull()), F.filter(low(b), lambda n: n.isNotNull()))


def load_model(registry_path: str, name: str | None = None, aliases: Sequence[str] = ()):
    """Look the model up by name or alias (overlapping alias sets), else the newest best-scored one."""
    from pyspark.ml import PipelineModel
    spark = SparkSession.getActiveSession()
    reg = spark.read.parquet(registry_path)
    if name or aliases:
        want = ([name] if name else []) + list(aliases)
        hit = reg.where(alias_overlap(F.array("model", "family"), F.array(*[F.lit(w) for w in want])))
        row = hit.orderBy(F.desc_nulls_last("score"), F.desc("path")).first()
        if row:
            return PipelineModel.load(row["path"])
    row = reg.orderBy(F.desc_nulls_last("score"), F.desc("path")).first()
    return PipelineModel.load(row["path"]) if row else None


def metrics_sink(metrics: DataFrame, path: str) -> DataFrame:
    """Write the metrics record as JSON and read it back."""
    metrics.write.mode("overwrite").json(path)
    return metrics.sparkSession.read.schema(metrics.schema).json(path)


def event_log_append(records: DataFrame, path: str) -> None:
    """S12 (batch): append records with their time to a JSON-lines log."""
    records.write.mode("append").json(path)


def event_log_stream(stream: DataFrame, path: str, checkpoint: str, trigger_once: bool = True):
    """S12 (stream): ``writeStream.format('json')`` with a checkpoint in the shared folder."""
    w = stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if trigger_once else w).start()


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Blank and malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def repair_json(blob: Column) -> Column:
    """Trailing commas removed, NaN -> null, +-Infinity -> +-1e308."""
    b = F.regexp_replace(blob, r",\s*([}\]])", "$1")
    b = F.regexp_replace(b, r"\bNaN\b", "null")
    b = F.regexp_replace(b, r"-Infinity\b", "-1e308")
    return F.regexp_replace(b, r"(?<![-\w])Infinity\b", "1e308")


def extract_marked_json(text: Column, begin: str, end: str, schema: str) -> Column:
    """The JSON between two markers, repaired, parsed with ``schema``; NULL if absent or unparsable."""
    import re
    pat = "(?s)" + re.escape(begin) + "(.*?)" + re.escape(end)
    blob = F.trim(F.regexp_extract(text, pat, 1))
    parsed = F.from_json(repair_json(blob), schema, {"mode": "PERMISSIVE"})
    return F.when(text.contains(begin) & text.contains(end) & (blob != ""), parsed)


def write_index(index: dict[str, DataFrame], path: str) -> None:
    """Persist chunks, dense, postings and terms as parquet tables (rebuild overwrites)."""
    for name, df in index.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in ("chunks", "dense", "postings", "terms")}


def validate_contract(present: Column, required: Sequence[str]) -> Column:
    """Required section names missing from a result (array of present keys)."""
    return F.array_sort(F.array_except(F.array(*[F.lit(r) for r in required]), present))
