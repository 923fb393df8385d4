"""Registered event-log queries (E1-E14) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import events as E
from .catalog import register
from .sqlgen import EVENTS_NULLS_SQL
from .tables import events_nulls, t

# Channel routes for the events table (parameters of E1).
ROUTES = {"click": ["ui", "analytics"], "view": ["analytics"], "purchase": ["billing", "analytics"],
          "error": ["alerts"], "signup": ["crm", "analytics"]}
TOK_SQL = "CAST(greatest(1, floor(length(coalesce(props, '')) / 4)) AS BIGINT)"


def _ev(spark, sf):
    return t(spark, sf, "events")


register("route_channel", "SELECT event_id, channel FROM events JOIN (VALUES " +
         ", ".join(f"('{k}', '{c}')" for k, cs in ROUTES.items() for c in cs) + ") r(k, channel) ON events.event_type = r.k")(
    lambda spark, sf: E.route_channel(_ev(spark, sf), ROUTES).select("event_id", "channel"))

DEDUP_S = 6 * 3600  # six hours: with a few events per user and type per day, this exercises drops

register("dedup_within", f"""WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS t FROM events),
 r AS (SELECT user_id, event_type, min(t) AS t FROM e GROUP BY ALL
   UNION ALL
   SELECT e.user_id, e.event_type, min(e.t) FROM r JOIN e ON e.user_id = r.user_id AND e.event_type = r.event_type
     AND e.t >= r.t + {DEDUP_S * 1_000_000} GROUP BY ALL)
SELECT min(e.event_id) AS event_id FROM r JOIN e USING (user_id, event_type, t) GROUP BY e.user_id, e.event_type, e.t""")(
    lambda spark, sf: E.dedup_within(_ev(spark, sf), ["user_id", "event_type"], window_s=DEDUP_S).select("event_id"))

register("dedup_within_skew_safe", f"""WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS t FROM events),
 r AS (SELECT user_id, event_type, min(t) AS t FROM e GROUP BY ALL
   UNION ALL
   SELECT e.user_id, e.event_type, min(e.t) FROM r JOIN e ON e.user_id = r.user_id AND e.event_type = r.event_type
     AND e.t >= r.t + {DEDUP_S * 1_000_000} GROUP BY ALL)
SELECT min(e.event_id) AS event_id FROM r JOIN e USING (user_id, event_type, t) GROUP BY e.user_id, e.event_type, e.t""")(
    lambda spark, sf: E.dedup_within(_ev(spark, sf), ["user_id", "event_type"], window_s=DEDUP_S, partitions=7).select("event_id"))

register("dedup_seen", "SELECT arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type")(
    lambda spark, sf: E.dedup_seen(_ev(spark, sf), ["user_id", "event_type"]).select("event_id"))

HOT_S = 900  # all events as one key: its bursts hold hundreds of events, and every event is delivered again

_HOT_SQL = f"""WITH RECURSIVE e AS (SELECT event_id, epoch_us(ts) AS t FROM events),
 r AS (SELECT min(t) AS t FROM e UNION ALL SELECT (SELECT min(e.t) FROM e WHERE e.t >= r.t + {HOT_S * 1_000_000}) FROM r WHERE r.t IS NOT NULL)
SELECT min(e.event_id) AS event_id FROM r JOIN e USING (t) GROUP BY e.t"""


def _twice(spark, sf):
    e = _ev(spark, sf).withColumn("one", F.lit("x"))
    return e.unionByName(e)


register("dedup_within_hot_key", _HOT_SQL)(
    lambda spark, sf: E.dedup_within(_twice(spark, sf), ["one"], window_s=HOT_S, partitions=7).select("event_id"))

register("dedup_seen_redelivered", "SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")(
    lambda spark, sf: E.dedup_seen(_twice(spark, sf), ["user_id", "event_type"]).select("user_id", "event_type", "event_id"))

register("rate_per_minute_hot_key", f"""SELECT event_id, count(*) OVER w AS requests_window, CAST(sum({TOK_SQL}) OVER w AS BIGINT) AS tokens_window
FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN -1 ELSE user_id END AS k FROM events)
WINDOW w AS (PARTITION BY k ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW)""")(
    lambda spark, sf: E.rate_per_minute(_ev(spark, sf).withColumn("k", F.when(F.col("event_id") % 2 == 0, -1).otherwise(F.col("user_id"))),
                                        "k", window_s=3600).select("event_id", "requests_window", "tokens_window"))

register("rate_per_minute", f"""SELECT event_id, event_type, ts,
  count(*) OVER w AS requests_window, CAST(sum({TOK_SQL}) OVER w AS BIGINT) AS tokens_window FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)""")(
    lambda spark, sf: E.rate_per_minute(_ev(spark, sf), "event_type"))

register("daily_usage", f"""SELECT user_id, date_trunc('day', ts) AS day, count(*) AS calls, CAST(sum({TOK_SQL}) AS BIGINT) AS tokens
FROM events GROUP BY ALL""")(lambda spark, sf: E.daily_usage(_ev(spark, sf), "user_id"))

LIMITS = {"rpm": 1, "rpd": 50, "tpm": 8, "tpd": 500}

register("over_quota", f"""SELECT event_id, event_type, ts,
  count(*) OVER wm > {LIMITS['rpm']} AS over_rpm, sum({TOK_SQL}) OVER wm > {LIMITS['tpm']} AS over_tpm,
  count(*) OVER wd > {LIMITS['rpd']} AS over_rpd, sum({TOK_SQL}) OVER wd > {LIMITS['tpd']} AS over_tpd FROM events
WINDOW wm AS (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW),
  wd AS (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY epoch_us(ts), event_id ROWS UNBOUNDED PRECEDING)""")(
    lambda spark, sf: E.over_quota(_ev(spark, sf), "event_type", LIMITS))

register("task_state_latest", f"""SELECT user_id, arg_max(event_type, (ts, event_id)) FILTER (WHERE event_type IS NOT NULL) AS event_type,
  arg_max(value, (ts, event_id)) FILTER (WHERE value IS NOT NULL) AS value,
  arg_max(props, (ts, event_id)) FILTER (WHERE props IS NOT NULL) AS props, max(ts) AS updated_at
FROM {EVENTS_NULLS_SQL} GROUP BY user_id""")(
    lambda spark, sf: E.task_state_latest(events_nulls(spark, sf), "user_id", ["event_type", "value", "props"]))

register("task_durations", """WITH s AS (SELECT user_id, min(ts) AS started_at FROM events WHERE event_type = 'signup' GROUP BY 1),
 e AS (SELECT events.user_id, min(ts) AS ended_at FROM events JOIN s USING (user_id)
   WHERE event_type IN ('purchase', 'error') AND ts >= started_at GROUP BY 1)
SELECT s.user_id, started_at, ended_at, round((epoch_us(ended_at) - epoch_us(started_at)) / 1e6, 3) AS duration_sec
FROM s LEFT JOIN e USING (user_id)""")(
    lambda spark, sf: E.task_durations(_ev(spark, sf), "user_id", ["signup"], ["purchase", "error"]))

register("state_report", """WITH n AS (SELECT event_type, count(*) AS n_total FROM events GROUP BY 1),
 r AS (SELECT event_type, event_id, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rank FROM events)
SELECT r.event_type, n_total, rank, event_id, ts FROM r JOIN n USING (event_type) WHERE rank <= 5""")(
    lambda spark, sf: E.state_report(_ev(spark, sf)))

register("latest_n", """SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 5""")(
    lambda spark, sf: _ev(spark, sf).orderBy(F.desc("ts"), F.desc("event_id")).limit(5).select("event_id", "ts"))

register("completion_barrier", """WITH f AS (SELECT user_id, event_type, min(ts) AS first_ts FROM events
   WHERE event_type IN ('view', 'click', 'purchase') GROUP BY ALL),
 g AS (SELECT user_id, count(*) AS n_reported, max(first_ts) AS last_ts FROM f GROUP BY 1)
SELECT user_id, n_reported, n_reported = 3 AS complete, CASE WHEN n_reported = 3 THEN last_ts END AS completed_at FROM g""")(
    lambda spark, sf: E.completion_barrier(_ev(spark, sf), "user_id", "event_type", ["view", "click", "purchase"]))

register("summarise_reports", """SELECT conv_id, string_agg(upper(substr(replace(role, '_', ' '), 1, 1)) || lower(substr(replace(role, '_', ' '), 2))
  || ': ' || split_part(coalesce(text, ''), '.', 1), ' | ' ORDER BY turn) AS summary FROM conversations GROUP BY conv_id""")(
    lambda spark, sf: E.summarise_reports(t(spark, sf, "conversations"), "conv_id", "turn", "role", "text"))

register("freshness_check", """SELECT user_id, max(CASE WHEN event_type IN ('view', 'click') THEN ts END) AS newest_raw,
  max(CASE WHEN event_type = 'purchase' THEN ts END) AS newest_derived,
  coalesce(max(CASE WHEN event_type = 'purchase' THEN ts END) >= max(CASE WHEN event_type IN ('view', 'click') THEN ts END), false) AS fresh
FROM events GROUP BY user_id""")(
    lambda spark, sf: E.freshness_check(_ev(spark, sf), "user_id", "event_type", ["view", "click"], ["purchase"]))


def _route_sql():
    vals = ", ".join(f"({i}, '{kw}', {j}, '{a}')" for i, (kw, ags) in enumerate(E.ROUTING_TABLE) for j, a in enumerate(ags))
    return f"""WITH m AS (SELECT conv_id * 1000 + turn AS msg_id, lower(text) AS t FROM conversations),
 kt AS (SELECT * FROM (VALUES {vals}) v(kw_ord, kw, ag_ord, agent)),
 f AS (SELECT msg_id, agent, min((kw_ord, ag_ord)) AS o FROM m JOIN kt ON contains(t, kw) GROUP BY ALL),
 g AS (SELECT msg_id, string_agg(agent, ',' ORDER BY o) AS assignees FROM f GROUP BY 1)
SELECT m.msg_id, coalesce(assignees, '{E.DEFAULT_ASSIGNEE}') AS assignees FROM m LEFT JOIN g USING (msg_id)"""


register("keyword_route", _route_sql())(
    lambda spark, sf: E.keyword_route(t(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), "text"), "msg_id", "text"))


# Messages with a phrase made by rule, so that every flow occurs (both engines).
FLOW_SQL = """(SELECT conv_id * 1000 + turn AS msg_id, coalesce(text, '') || CASE (conv_id + turn) % 6 WHEN 0 THEN ' please TRAIN the churn model'
  WHEN 1 THEN ' deploy it' WHEN 2 THEN ' security audit of the model' WHEN 3 THEN ' explain the training process' WHEN 4 THEN ' merge the pipeline branch'
  ELSE '' END AS text FROM conversations)"""


def _flow_messages(spark, sf):
    t(spark, sf, "conversations").createOrReplaceTempView("conversations")
    return spark.sql(f"SELECT * FROM {FLOW_SQL}")


def _flow_sql():
    def anyc(ws):
        return "(" + " OR ".join(f"contains(x, '{w}')" for w in ws) + ")"
    return f"""SELECT msg_id, CASE WHEN {anyc(E.TRAINING_PROCESS_KEYWORDS)} THEN 'training_process'
  WHEN NOT {anyc(E.BUILD_EXCLUDE_SECURITY)} AND NOT {anyc(E.BUILD_EXCLUDE_GIT)} AND {anyc(E.BUILD_FLOW_KEYWORDS)} THEN 'build'
  WHEN contains(x, 'deploy') THEN 'deploy' ELSE 'other' END AS flow
FROM (SELECT msg_id, lower(text) AS x FROM {FLOW_SQL})"""


register("flow_classify", _flow_sql())(
    lambda spark, sf: _flow_messages(spark, sf).select("msg_id", E.flow_classify(F.col("text")).alias("flow")))
