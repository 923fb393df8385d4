"""Helpers shared by the training-data operators: shared-folder tables, word splitting, runs of sorted rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of bytes outside space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir`` that driver and executors share.

    A folder of this machine is made only in a one-JVM ``local`` session that names none (tests);
    on a cluster without the setting this raises.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found:
        return found
    conf = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf = tempfile.mkdtemp(prefix="tabscope-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a folder for one run of an operator, inside the shared folder (not yet created)."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Rows in an Arrow batch that goes to Python, so that a batch of long texts stays small."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if now <= 0 or now > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of a text column."""
    return int(df.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0)


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words of a text; bytes.split() splits at exactly the six ASCII white-space bytes."""
    return [] if not text else text.encode("utf-8", "surrogatepass").split()


def n_words(text: Column) -> Column:
    """Number of words of a text column (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sorted_runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Column arrays of each run of rows with equal keys; the rows arrive sorted by the keys.

    A run may span batches; at most one run and one batch are held.
    """
    held: list[dict[str, np.ndarray]] = []

    def merged() -> dict[str, np.ndarray]:
        return held[0] if len(held) == 1 else {c: np.concatenate([h[c] for h in held]) for c in held[0]}

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = {f.name: batch.column(i).to_numpy(zero_copy_only=False) for i, f in enumerate(batch.schema)}
        change = np.zeros(n, dtype=bool)
        for k in keys:
            change[1:] |= cols[k][1:] != cols[k][:-1]
        cuts = np.flatnonzero(change).tolist()
        if held and any(held[-1][k][-1] != cols[k][0] for k in keys):
            yield merged()
            held = []
        begin = 0
        for end in [*cuts, n]:
            held.append({c: v[begin:end] for c, v in cols.items()})
            if end < n:
                yield merged()
                held = []
            begin = end
    if held:
        yield merged()


def long_schema(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names])
