"""Event-log operators on event time, each with a batch form; stream twins below.

Binding of the driver's ``events`` table: ``from = user_id``, ``channel / content =
event_type``, ``payload = props``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import token_estimate
from ..operators.window import join_on, sorted_ranges
from ..session import cut_lineage

# Dedup windows (seconds), default rate limits, routing table, flow keywords.
DEDUP_WINDOW_S = 1.5
USER_DEDUP_WINDOW_S = 1.2
DEFAULT_LIMITS = {"rpm": 30, "rpd": 1000, "tpm": 8000, "tpd": 200000}
ROUTING_TABLE = [
    ("model", ["ml_engineer", "data_scientist"]), ("train", ["ml_engineer", "data_scientist"]),
    ("predict", ["ml_engineer"]), ("churn", ["ml_engineer", "data_scientist"]),
    ("accuracy", ["ml_engineer", "data_scientist"]), ("pipeline", ["ml_engineer"]), ("deploy", ["ml_engineer"]),
    ("retrain", ["ml_engineer", "data_scientist"]), ("analyse", ["data_scientist", "data_analyst"]),
    ("analyze", ["data_scientist", "data_analyst"]), ("eda", ["data_scientist"]),
    ("analysis", ["data_scientist", "data_analyst"]), ("dataset", ["data_scientist"]), ("feature", ["data_scientist"]),
    ("experiment", ["data_scientist"]), ("drift", ["data_scientist", "data_analyst", "ml_engineer"]),
    ("report", ["data_analyst"]), ("dashboard", ["data_analyst"]), ("metrics", ["data_analyst"]),
    ("kpi", ["data_analyst"]), ("monitoring", ["data_analyst", "ml_engineer"]), ("github", ["github"]),
    ("git", ["github"]), ("branch", ["github"]), ("merge", ["github"]), ("repository", ["github"]),
    ("repo", ["github"]), ("push", ["github"]),
]
DEFAULT_ASSIGNEE = "ml_engineer"
BUILD_FLOW_KEYWORDS = ["model", "train", "predict", "pipeline", "accuracy", "churn", "fraud", "classif", "retrain"]
BUILD_EXCLUDE_SECURITY = ["security", "audit", "scan", "owasp", "pentest"]
BUILD_EXCLUDE_GIT = ["github", "repo", "branch", "merge", "push"]
TRAINING_PROCESS_KEYWORDS = ["training process", "training proceeded", "how training", "model transparency",
                             "training explanation"]


def _us(ts) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp"))


def _any_contains(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


# ---------------------------------------------------------------- E1-E3

def route_channel(df: DataFrame, routes: dict[str, Sequence[str]], key: str = "event_type") -> DataFrame:
    """One row per (event, channel); an event may feed several channels (broadcast route table)."""
    rows = [(k, ch) for k, chans in routes.items() for ch in chans]
    rt = df.sparkSession.createDataFrame(rows, f"_key string, channel string")
    return df.join(F.broadcast(rt), df[key] == rt["_key"]).drop("_key")


def _one_row(df: DataFrame, by: Sequence[str], order: Column) -> DataFrame:
    """The row of least ``order`` per ``by`` (nulls are a group), whole; of rows alike in ``order``, one."""
    least = F.struct(order.alias("o"), F.xxhash64(*[c for c in df.columns]).alias("h"))
    return df.groupBy(*by).agg(F.min_by(F.struct(*df.columns), least).alias("_row")).select("_row.*")


def _bursts(times: DataFrame, keys: Sequence[str], window_us: int, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Heads and pointers of the distinct (keys, ``_t``) in ``times``.

    Heads are events with no event of their key less than the window before: they are always accepted. The pointer of
    an event leads to the first event a window or more after it, ``_next``, unless that one is a head. Events and their
    times plus a window are sorted together over range partitions, so a key of any size is many tasks; what lies across
    a partition's border comes from a table of one row per partition and key.
    """
    kinds = F.array(F.struct(F.col("_t").alias("at"), F.lit(1).alias("kind")), F.struct((F.col("_t") + window_us).alias("at"), F.lit(0).alias("kind")))
    both = times.select(*keys, "_t", F.explode(kinds).alias("_k")).select(*keys, "_t", F.col("_k.at").alias("_at"), F.col("_k.kind").alias("_kind"))
    staged = sorted_ranges(both, keys, ["_at", "_kind"], partitions)
    event = F.when(F.col("_kind") == 1, F.col("_at"))
    edges = staged.groupBy("_pid", *keys).agg(F.min(event).alias("_first"), F.max(event).alias("_last"))
    later = Window.partitionBy(*keys).orderBy(F.desc("_pid")).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select("_pid", *keys, F.last("_first", True).over(later).alias("_after"), F.last("_last", True).over(earlier).alias("_before"))
    inside = Window.partitionBy("_pid", *keys)
    down = inside.orderBy(F.desc("_at"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, 0)
    up = inside.orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    x = join_on(staged, edges, ["_pid", *keys]).select(
        *keys, "_t", "_kind", F.coalesce(F.last(event, True).over(down), F.col("_after")).alias("_next"),
        F.coalesce(F.last(event, True).over(up), F.col("_before")).alias("_prev"))
    x = cut_lineage(x)
    heads = x.where((F.col("_kind") == 1) & (F.col("_prev").isNull() | (F.col("_t") - F.col("_prev") >= window_us))).select(*keys, "_t")
    pointers = x.where((F.col("_kind") == 0) & F.col("_next").isNotNull()).select(*keys, "_t", "_next")
    # a pointer to a head is not needed: the head is accepted anyway
    named = heads.withColumnRenamed("_t", "_next")
    return heads, join_on(pointers, named, [*keys, "_next"], "left_anti")


def dedup_within(df: DataFrame, keys: Sequence[str], ts: str = "ts", order: str = "event_id",
                 window_s: float = DEDUP_WINDOW_S, partitions: int | None = None) -> DataFrame:
    """Keep an event unless the same key was *accepted* less than window_s before it.

    Dropped events do not extend the window. Of events of a key at one time the one of least ``order`` counts, so an
    event delivered again with its id is dropped; rows carry themselves through and are not looked up by id. An event
    is accepted if the pointers of ``_bursts`` lead to it from the head of its burst: pointer doubling finds these in
    as many rounds as the longest chain has binary digits, with joins on (keys, time), which are unique. Null times
    are one time of their key.
    """
    wus = int(round(window_s * 1_000_000))
    rows = _one_row(df.withColumn("_t", _us(ts)), [*keys, "_t"], F.struct(order))
    rows = cut_lineage(rows)
    times = rows.where(F.col("_t").isNotNull()).select(*keys, "_t")
    heads, step = _bursts(times, keys, wus, partitions)
    step = cut_lineage(step)
    reached = heads
    while not step.isEmpty():
        found = join_on(step, reached, [*keys, "_t"], "left_semi").select(*keys, F.col("_next").alias("_t"))
        reached = cut_lineage(reached.unionByName(found).distinct())
        ahead = step.withColumnRenamed("_next", "_far").withColumnRenamed("_t", "_next")
        step = cut_lineage(join_on(step, ahead, [*keys, "_next"]).select(*keys, "_t", F.col("_far").alias("_next")))
    kept = join_on(rows, reached, [*keys, "_t"], "left_semi").unionByName(rows.where(F.col("_t").isNull()))
    return kept.select(*df.columns)


def dedup_seen(df: DataFrame, keys: Sequence[str], ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Drop repeats of the key forever: the earliest event per key, once, also if it is delivered again with its id.

    The row itself goes through the aggregate (partial per task), so a hot key is one row per task.
    """
    return _one_row(df, keys, F.struct(ts, order))


# ---------------------------------------------------------------- E4-E6

def with_tokens(df: DataFrame, payload: str = "props") -> DataFrame:
    return df.withColumn("tokens", token_estimate(F.col(payload)))


def _buckets(df: DataFrame, key: str, ts: str, order: str, payload: str, window_us: int) -> DataFrame:
    """Events in time buckets (``_b``) one window wide, each also as halo (``_halo``) of the bucket after its own."""
    x = with_tokens(df, payload).select(order, key, ts, "tokens", _us(ts).alias("_t"))
    b = F.floor(F.col("_t") / window_us)
    copies = F.array(F.struct(b.alias("b"), F.lit(False).alias("halo")), F.struct((b + 1).alias("b"), F.lit(True).alias("halo")))
    return x.select("*", F.explode(copies).alias("_c")).select(order, key, ts, "tokens", "_t", F.col("_c.b").alias("_b"), F.col("_c.halo").alias("_halo"))


def rate_per_minute(df: DataFrame, key: str, ts: str = "ts", window_s: int = 60, payload: str = "props",
                    order: str = "event_id") -> DataFrame:
    """Requests and tokens in the trailing window (now - t < window) per key, per event.

    A group is a key's time bucket of one window with the bucket before as halo, so a key with most of the events is
    as many groups as it has windows. Events with a null time count among themselves.
    """
    wus = window_s * 1_000_000
    w = Window.partitionBy(key, "_b").orderBy("_t").rangeBetween(-(wus - 1), 0)
    x = _buckets(df, key, ts, order, payload, wus).withColumns({"requests_window": F.count(F.lit(1)).over(w), "tokens_window": F.sum("tokens").over(w)})
    alone = Window.partitionBy(key)
    known = x.where(~F.col("_halo") & F.col("_t").isNotNull()).select(order, key, ts, "requests_window", "tokens_window")
    timeless = with_tokens(df, payload).where(F.col(ts).isNull()).select(
        order, key, ts, F.count(F.lit(1)).over(alone).alias("requests_window"), F.sum("tokens").over(alone).alias("tokens_window"))
    return known.unionByName(timeless)


def daily_usage(df: DataFrame, key: str, ts: str = "ts", payload: str = "props") -> DataFrame:
    """E5: calls and tokens per key and UTC day (tumbling window)."""
    x = with_tokens(df, payload)
    return x.groupBy(key, F.window(F.col(ts).cast("timestamp"), "1 day").alias("w")).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens")) \
        .select(key, F.col("w.start").cast("timestamp_ntz").alias("day"), "calls", "tokens")


def over_quota(df: DataFrame, key: str, limits: dict[str, int] = DEFAULT_LIMITS, ts: str = "ts",
               payload: str = "props", order: str = "event_id") -> DataFrame:
    """Flag each event beyond the per-minute or per-day limits (counts include the event itself).

    Minutes are the buckets of ``rate_per_minute``. A day's running counts are those inside the minute plus the sums of
    the day's minutes before, a table of at most 1,440 rows per key and day. Events with a null time are left out.
    """
    wus = 60 * 1_000_000
    x = _buckets(df.where(F.col(ts).isNotNull()), key, ts, order, payload, wus)
    wm = Window.partitionBy(key, "_b").orderBy("_t").rangeBetween(-(wus - 1), 0)
    run = Window.partitionBy(key, "_b").orderBy("_halo", "_t", order).rowsBetween(Window.unboundedPreceding, 0)  # own events first
    x = x.withColumns({"_rm": F.count(F.lit(1)).over(wm), "_tm": F.sum("tokens").over(wm),
                       "_rd": F.count(F.lit(1)).over(run), "_td": F.sum("tokens").over(run)}).where(~F.col("_halo"))
    own = with_tokens(df.where(F.col(ts).isNotNull()), payload).select(key, F.floor(_us(ts) / wus).alias("_b"), "tokens")
    sums = own.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_r"), F.sum("tokens").alias("_s"))
    before = Window.partitionBy(key, F.floor(F.col("_b") / 1440)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, "_b", F.coalesce(F.sum("_r").over(before), F.lit(0)).alias("_r0"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"))
    x = join_on(x, sums, [key, "_b"])
    return x.select(order, key, ts, (F.col("_rm") > limits["rpm"]).alias("over_rpm"), (F.col("_tm") > limits["tpm"]).alias("over_tpm"),
                    (F.col("_rd") + F.col("_r0") > limits["rpd"]).alias("over_rpd"),
                    (F.col("_td") + F.col("_s0") > limits["tpd"]).alias("over_tpd"))


# ---------------------------------------------------------------- E7-E9

def task_state_latest(df: DataFrame, key: str, fields: Sequence[str], ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Per key, the last non-null value of each field (declarative aggregate, partial per partition)."""
    o = F.struct(F.col(ts), F.col(order))
    aggs = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), o)).alias(f) for f in fields]
    return df.groupBy(key).agg(*aggs, F.max(ts).alias("updated_at"))


def task_durations(df: DataFrame, key: str, start_types: Sequence[str], end_types: Sequence[str],
                   kind: str = "event_type", ts: str = "ts") -> DataFrame:
    """Seconds (3 dp) from the first start event to the first end event at or after it."""
    s = df.where(F.col(kind).isin(*start_types)).groupBy(key).agg(F.min(ts).alias("started_at"))
    e = df.join(s, key).where(F.col(kind).isin(*end_types) & (F.col(ts) >= F.col("started_at"))) \
        .groupBy(key).agg(F.min(ts).alias("ended_at"))
    j = s.join(e, key, "left")
    dur = (_us("ended_at") - _us("started_at")) / 1e6
    return j.select(key, "started_at", "ended_at", F.round(dur, 3).alias("duration_sec"))


def state_report(df: DataFrame, log_col: str = "event_type", ts: str = "ts", order: str = "event_id",
                 k: int = 5) -> DataFrame:
    """E9 (with K4): rows per log and its last k records (top-k limited before the shuffle)."""
    n = df.groupBy(log_col).agg(F.count(F.lit(1)).alias("n_total"))
    w = Window.partitionBy(log_col).orderBy(F.desc(ts), F.desc(order))
    last = df.select(log_col, order, ts).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return last.join(n, log_col).select(log_col, "n_total", F.col("rank").cast("long").alias("rank"), order, ts)


# ---------------------------------------------------------------- E10-E14

def completion_barrier(df: DataFrame, key: str, party: str, expected: Sequence[str], ts: str = "ts") -> DataFrame:
    """A key is complete once every expected party has reported; completion = last first-report time."""
    first = df.where(F.col(party).isin(*expected)).groupBy(key, party).agg(F.min(ts).alias("_first"))
    g = first.groupBy(key).agg(F.count(F.lit(1)).alias("n_reported"), F.max("_first").alias("_last"))
    done = F.col("n_reported") == len(set(expected))
    return g.select(key, "n_reported", done.alias("complete"), F.when(done, F.col("_last")).alias("completed_at"))


def first_sentence(text: Column) -> Column:
    return F.substring_index(F.coalesce(text, F.lit("")), ".", 1)


def summarise_reports(df: DataFrame, key: str, order: str, who: str, text: str) -> DataFrame:
    """E11: "Who: first sentence" of each report per key, in arrival order, joined by ' | '."""
    name = F.regexp_replace(F.col(who), "_", " ")
    label = F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, 2, 1 << 20)))
    item = F.struct(F.col(order).alias("o"), F.concat(label, F.lit(": "), first_sentence(F.col(text))).alias("s"))
    g = df.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("_l"))
    return g.select(key, F.array_join(F.transform("_l", lambda x: x["s"]), " | ").alias("summary"))


def freshness_check(df: DataFrame, by: str, kind: str, raw_kinds: Sequence[str], derived_kinds: Sequence[str],
                    ts: str = "ts") -> DataFrame:
    """Derived outputs are fresh when the newest derived one is not older than the newest raw input."""
    g = df.groupBy(by).agg(F.max(F.when(F.col(kind).isin(*raw_kinds), F.col(ts))).alias("newest_raw"),
                           F.max(F.when(F.col(kind).isin(*derived_kinds), F.col(ts))).alias("newest_derived"))
    return g.withColumn("fresh", F.coalesce(F.col("newest_derived") >= F.col("newest_raw"), F.lit(False)))


def keyword_route(df: DataFrame, id_col: str, text: str, table=ROUTING_TABLE, default: str = DEFAULT_ASSIGNEE) -> DataFrame:
    """Assignees in keyword-table order, first occurrence wins, default when nothing matches.

    The keyword table is small and fixed, so it is broadcast and matched with ``contains``.
    """
    rows = [(i, kw, j, a) for i, (kw, agents) in enumerate(table) for j, a in enumerate(agents)]
    kt = df.sparkSession.createDataFrame(rows, "kw_ord int, kw string, ag_ord int, agent string")
    m = df.select(id_col, F.lower(F.col(text)).alias("_t")).join(F.broadcast(kt), F.col("_t").contains(F.col("kw")))
    first = m.groupBy(id_col, "agent").agg(F.min(F.struct("kw_ord", "ag_ord")).alias("_o"))
    g = first.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("_o", "agent"))).alias("_a"))
    g = g.select(id_col, F.array_join(F.transform("_a", lambda x: x["agent"]), ",").alias("assignees"))
    return df.select(id_col).join(g, id_col, "left").select(id_col, F.coalesce("assignees", F.lit(default)).alias("assignees"))


def flow_classify(text: Column) -> Column:
    """training_process / build (minus security and git requests) / deploy / other."""
    t = F.lower(F.coalesce(text, F.lit("")))
    build = ~_any_contains(t, BUILD_EXCLUDE_SECURITY) & ~_any_contains(t, BUILD_EXCLUDE_GIT) & _any_contains(t, BUILD_FLOW_KEYWORDS)
    return (F.when(_any_contains(t, TRAINING_PROCESS_KEYWORDS), "training_process").when(build, "build")
            .when(t.contains("deploy"), "deploy").otherwise("other"))


# ---------------------------------------------------------------- stream twins

def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Streams need TIMESTAMP (not NTZ) for watermarks; the session runs in UTC."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def read_event_stream(spark, path: str, schema: T.StructType | str, max_files: int = 1, fmt: str = "parquet") -> DataFrame:
    """File-source stream of event batches (one file per trigger by default)."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files).load(path)


def stream_daily_usage(stream: DataFrame, key: str, ts: str = "ts", watermark: str = "1 minute",
                       payload: str = "props") -> DataFrame:
    """E5 stream: tumbling 1-day windows; append mode emits a day once the watermark passes it."""
    x = with_tokens(event_time(stream, ts), payload).withWatermark(ts, watermark)
    return x.groupBy(key, F.window(ts, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("calls"),
                                                             F.sum("tokens").alias("tokens")) \
        .select(key, F.col("w.start").alias("day"), "calls", "tokens")


def stream_rate_per_minute(stream: DataFrame, key: str, ts: str = "ts", watermark: str = "1 minute",
                           payload: str = "props") -> DataFrame:
    """E4 stream: sliding 60 s windows every 10 s."""
    x = with_tokens(event_time(stream, ts), payload).withWatermark(ts, watermark)
    return x.groupBy(key, F.window(ts, "60 seconds", "10 seconds").alias("w")).agg(
        F.count(F.lit(1)).alias("requests"), F.sum("tokens").alias("tokens"))


def stream_dedup_seen(stream: DataFrame, keys: Sequence[str], ts: str = "ts", watermark: str = "1 hour") -> DataFrame:
    """E3 stream: repeats dropped while the watermark keeps the key's state."""
    return event_time(stream, ts).withWatermark(ts, watermark).dropDuplicatesWithinWatermark(list(keys))


def stream_task_state(stream: DataFrame, key: str, fields: Sequence[str], ts: str = "ts",
                      order: str = "event_id") -> DataFrame:
    """E7 stream: update-mode aggregate of the last non-null value per field."""
    return task_state_latest(event_time(stream, ts), key, fields, ts, order)


def stream_dedup_within(stream: DataFrame, keys: Sequence[str], ts: str = "ts", order: str = "event_id",
                        window_s: float = DEDUP_WINDOW_S, timeout: str = "1 hour") -> DataFrame:
    """E2 stream: per-key state holds the last accepted time (O(1) per key), expired by event-time timeout."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    wus = int(round(window_s * 1_000_000))
    x = event_time(stream, ts).withColumn("_t", _us(ts)).withWatermark(ts, timeout)
    out_schema = f"{order} long"

    def fn(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(pdfs)).sort_values(["_t", order])
        keep = []
        for t, o in zip(rows["_t"].tolist(), rows[order].tolist()):
            if last is None or t - last >= wus:
                keep.append(o)
                last = t
        state.update((int(last),))
        state.setTimeoutTimestamp(int(last // 1000) + wus // 1000)  # fires once the watermark has passed the window
        yield pd.DataFrame({order: pd.Series(keep, dtype="int64")})

    return x.groupBy(*keys).applyInPandasWithState(fn, out_schema, "last long", "append",
                                                   GroupStateTimeout.EventTimeTimeout)


def stream_route_channel(stream: DataFrame, routes: dict[str, Sequence[str]], key: str = "event_type", ts: str = "ts") -> DataFrame:
    """E1 stream: every event meets the route table of its batch; no state."""
    return route_channel(event_time(stream, ts), routes, key)


def stream_completion_barrier(stream: DataFrame, key: str, party: str, expected: Sequence[str], ts: str = "ts",
                              watermark: str = "1 minute") -> DataFrame:
    """E10 stream: (key, n_reported, completed_at) once per key, when the watermark has passed its completion.

    State per key: the first report of each expected party, so at most one entry a party. An earlier report that comes
    later moves the completion, and its timer, back; once emitted, a key keeps one flag and is not emitted again, also
    after a restart from the checkpoint. Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    parties = sorted(set(expected))

    class Barrier(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.first = handle.getMapState("first", "party string", "us long")
            self.done = handle.getValueState("done", "done boolean")

        def handleInputRows(self, key, rows, timerValues):
            if self.done.exists():
                return
            for batch in rows:
                for name, us in batch.groupby("of_party")["at_us"].min().items():
                    known = self.first.getValue((name,))
                    if known is None or us < known[0]:
                        self.first.updateValue((name,), (int(us),))
            times = [v[0] for _, v in self.first.iterator()]
            if len(times) == len(parties):
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(max(times) // 1000 + 1)
            return
            yield

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            times = [v[0] for _, v in self.first.iterator()]
            self.first.clear()
            self.done.update((True,))
            yield pd.DataFrame({"of_key": [key[0]], "n_reported": [len(times)], "at_us": [max(times)]})

        def close(self):
            pass

    x = event_time(stream, ts).where(F.col(party).isin(*parties) & F.col(ts).isNotNull()).withWatermark(ts, watermark)
    x = x.select(F.col(key).alias("of_key"), F.col(party).cast("string").alias("of_party"), _us(ts).alias("at_us"), ts)
    schema = T.StructType([T.StructField("of_key", x.schema["of_key"].dataType), T.StructField("n_reported", T.LongType()),
                           T.StructField("at_us", T.LongType())])
    out = x.groupBy("of_key").transformWithStateInPandas(Barrier(), schema, "Append", "eventTime")
    return out.select(F.col("of_key").alias(key), "n_reported", F.timestamp_micros("at_us").alias("completed_at"))
