"""Visits and the request guard."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import utc_timestamp
from ..operators import visits as V
from ..operators.bitmaps import bucket_bitmaps, distinct_visitors, numbered, rolled_up, trailing
from ..operators.groups import connected
from ..operators.tables import REQUESTS_SQL, as_requests, entries, pick, requests, turns
from ..streaming import run
from ..streaming import visits as Vs
from .registry import query

#: A moment inside the events' thirty days.
NOW, DAY, DAY_START = 1_706_000_000, "2024-01-23", 1_705_939_200
_LOCAL = "to_timestamp(epoch) AT TIME ZONE 'UTC' + INTERVAL 8 HOUR"
_BUCKET = "epoch - epoch % 300"
_ACTIVITY = f"""activity AS (SELECT ip, {_BUCKET} AS bucket_epoch, min(epoch) AS first_seen_epoch, max(epoch) AS last_seen_epoch, count(*) AS request_count, CAST(sum(blocked) AS BIGINT) AS blocked_count,
  arg_max(path, (epoch, id)) AS last_path, arg_max(method, (epoch, id)) AS last_method, arg_max(status, (epoch, id)) AS last_status FROM requests GROUP BY ALL)"""


@query("visitor_online", f"WITH {REQUESTS_SQL}, v AS (SELECT sha256('secret:' || visitor) AS h, max(epoch) AS l FROM requests GROUP BY 1) SELECT count(*) FILTER (l >= {NOW - 90}) AS online, count(*) AS total FROM v")
def visitor_online(spark, sf_dir):
    return V.current_stats(V.visitors(requests(spark, sf_dir)), NOW)


@query("visitor_upsert", f"WITH {REQUESTS_SQL} SELECT sha256('secret:' || visitor) AS visitor_hash, min(epoch) AS first_seen_epoch, max(epoch) AS last_seen_epoch FROM requests GROUP BY 1")
def visitor_upsert(spark, sf_dir):
    return V.visitors(requests(spark, sf_dir))


@query(
    "visitor_daily_gapfill",
    f"""WITH {REQUESTS_SQL}, s AS (SELECT strftime(d, '%Y-%m-%d') AS day_key FROM (SELECT unnest(generate_series(DATE '{DAY}' - 13, DATE '{DAY}', INTERVAL 1 DAY)) AS d)),
n AS (SELECT strftime(epoch_ms(epoch * 1000) + INTERVAL 8 HOUR, '%Y-%m-%d') AS day_key, count(DISTINCT visitor) AS n FROM requests GROUP BY 1)
SELECT s.day_key, coalesce(n, 0) AS unique_visitors FROM s LEFT JOIN n ON n.day_key = s.day_key""",
)
def visitor_daily_gapfill(spark, sf_dir):
    return V.daily_visitors(requests(spark, sf_dir), DAY)


def _bitmaps(spark, sf_dir):
    r = requests(spark, sf_dir)
    return bucket_bitmaps(r, numbered(r), V.bucket(F.col("epoch"), V.BUCKET))


@query("visitor_rollup_hours", f"WITH {REQUESTS_SQL} SELECT epoch // 3600 AS hour, count(DISTINCT visitor) AS visitors FROM requests GROUP BY 1")
def visitor_rollup_hours(spark, sf_dir):
    """Visitors of each hour, from the bitmaps of its buckets."""
    return distinct_visitors(rolled_up(_bitmaps(spark, sf_dir), F.expr("bucket_epoch div 3600"), "hour"), "hour")


@query(
    "visitor_rollup_fortnights",
    f"""WITH {REQUESTS_SQL}, v AS (SELECT DISTINCT epoch // 86400 AS day, visitor FROM requests), d AS (SELECT unnest(generate_series((SELECT min(day) FROM v), (SELECT max(day) FROM v))) AS day)
SELECT d.day, count(DISTINCT visitor) AS visitors FROM d JOIN v ON v.day BETWEEN d.day - 13 AND d.day GROUP BY 1""",
)
def visitor_rollup_fortnights(spark, sf_dir):
    """Visitors of each day and the thirteen before it, from the bitmaps of days."""
    days = rolled_up(_bitmaps(spark, sf_dir), F.expr("bucket_epoch div 86400"), "day")
    return distinct_visitors(trailing(days, 14), "day")


@query("ip_activity_buckets", f"WITH {REQUESTS_SQL}, {_ACTIVITY} SELECT * FROM activity")
def ip_activity_buckets(spark, sf_dir):
    return V.ip_activity(requests(spark, sf_dir))


@query(
    "ip_recent_topk",
    f"""WITH {REQUESTS_SQL}, {_ACTIVITY}, r AS (SELECT * FROM activity WHERE last_seen_epoch >= {NOW - 86400} ORDER BY last_seen_epoch DESC, ip, bucket_epoch DESC LIMIT 2000)
SELECT ip, regexp_replace(ip, '\\.[0-9]+$', '.*') AS display_ip, min(first_seen_epoch) AS first_seen_epoch, max(last_seen_epoch) AS last_seen_epoch, CAST(sum(request_count) AS BIGINT) AS request_count, CAST(sum(blocked_count) AS BIGINT) AS blocked_count,
  arg_max(last_path, (last_seen_epoch, bucket_epoch)) AS last_path, ip LIKE '%.1' AS is_blocked FROM r GROUP BY ip ORDER BY last_seen_epoch DESC, ip LIMIT 100""",
)
def ip_recent_topk(spark, sf_dir):
    r = requests(spark, sf_dir)
    blocked = r.where("ip LIKE '%.1'").select(F.col("ip").alias("ip_address")).distinct()
    return V.recent_ips(V.ip_activity(r), NOW, blocked)


@query("snapshot_peak", f"WITH {REQUESTS_SQL}, s AS (SELECT {_BUCKET} AS b, blocked, count(DISTINCT visitor) AS n FROM requests GROUP BY ALL) SELECT b AS bucket_epoch, arg_max(n, blocked) AS online, max(n) AS peak, CAST(max(blocked) AS BIGINT) AS recorded FROM s GROUP BY b")
def snapshot_peak(spark, sf_dir):
    r = requests(spark, sf_dir)
    one = lambda k: V.snapshots(r.where(F.col("blocked") == k)).select("bucket_epoch", "online", F.col("online").alias("peak"), F.lit(k).cast("long").alias("recorded"))
    return V.merge_snapshots(one(0), one(1))


_POINTS = f"""points AS (SELECT t.b AS bucket_epoch, coalesce(n, 0) AS online FROM (SELECT unnest(generate_series({DAY_START}, {NOW}, 300)) AS b) t
  LEFT JOIN (SELECT {_BUCKET} AS b, count(DISTINCT visitor) AS n FROM requests GROUP BY 1) s ON s.b = t.b)"""


@query("today_points", f"WITH {REQUESTS_SQL}, {_POINTS} SELECT * FROM points")
def today_points(spark, sf_dir):
    return V.today_points(V.snapshots(requests(spark, sf_dir)), DAY_START, NOW)


@query("visitor_hourly_peak", f"WITH {REQUESTS_SQL}, {_POINTS} SELECT strftime(epoch_ms(bucket_epoch * 1000) + INTERVAL 8 HOUR, '%Y-%m-%d %H:00') AS hour, max(online) AS peak FROM points GROUP BY 1")
def visitor_hourly_peak(spark, sf_dir):
    return V.hourly_peaks(V.today_points(V.snapshots(requests(spark, sf_dir)), DAY_START, NOW))


@query("bucket_snapshot", f"WITH {REQUESTS_SQL}, {_POINTS} SELECT online FROM points WHERE bucket_epoch = {DAY_START + 3000}")
def bucket_snapshot(spark, sf_dir):
    return V.today_points(V.snapshots(requests(spark, sf_dir)), DAY_START + 3000, DAY_START + 3000).select("online")


@query("activity_retention", f"WITH {REQUESTS_SQL}, {_ACTIVITY} SELECT count(*) AS n FROM activity WHERE last_seen_epoch >= {NOW} - 10 * 86400")
def activity_retention(spark, sf_dir):
    return V.retained(V.ip_activity(requests(spark, sf_dir)), NOW, 10).agg(F.count(F.lit(1)).alias("n"))


@query("visitor_daily_peak", f"WITH {REQUESTS_SQL}, {_POINTS} SELECT strftime(epoch_ms(bucket_epoch * 1000) + INTERVAL 8 HOUR, '%Y-%m-%d') AS day_key, max(online) AS peak FROM points GROUP BY 1")
def visitor_daily_peak(spark, sf_dir):
    return V.daily_peak(V.today_points(V.snapshots(requests(spark, sf_dir)), DAY_START, NOW))


@query("history_retention", f"WITH {REQUESTS_SQL}, b AS (SELECT DISTINCT {_BUCKET} AS b FROM requests), d AS (SELECT DISTINCT strftime(epoch_ms(epoch * 1000) + INTERVAL 8 HOUR, '%Y-%m-%d') AS k FROM requests) SELECT (SELECT count(*) FROM b WHERE b >= {NOW} - 12 * 86400) AS snapshots, (SELECT count(*) FROM d WHERE k >= strftime(epoch_ms({NOW} * 1000::BIGINT) + INTERVAL 8 HOUR - INTERVAL 12 DAY, '%Y-%m-%d')) AS days")
def history_retention(spark, sf_dir):
    r = requests(spark, sf_dir)
    days = r.select(V.day_key(F.col("epoch")).alias("day_key")).distinct()
    return V.retained(V.snapshots(r), NOW, 12, "bucket_epoch").agg(F.count(F.lit(1)).alias("snapshots")).join(V.retained_days(days, NOW, 12).agg(F.count(F.lit(1)).alias("days")))


@query("local_times", f"WITH {REQUESTS_SQL} SELECT id, CASE WHEN id % 3 = 2 THEN NULL WHEN id % 3 = 1 THEN epoch - epoch % 60 ELSE epoch END AS back FROM requests")
def local_times(spark, sf_dir):
    """Local times as text of three kinds, the last of which is none, and back."""
    at = V.local(F.col("epoch"))
    text = F.when(F.col("id") % 3 == 2, "soon").when(F.col("id") % 3 == 1, F.date_format(at, "yyyy-MM-dd HH:mm")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"))
    return requests(spark, sf_dir).select("id", V.local_epoch(text).alias("back"))


@query("utc_timestamps", "SELECT event_id AS id, strftime(to_timestamp(floor(epoch(ts))) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S+00:00') AS at FROM events")
def utc_timestamps(spark, sf_dir):
    return requests(spark, sf_dir).select("id", utc_timestamp(F.timestamp_seconds("epoch")).alias("at"))


@query("block_state", f"WITH {REQUESTS_SQL}, e AS (SELECT ip, arg_max(CASE WHEN blocked = 1 THEN 'block' ELSE 'unblock' END, (epoch, id)) AS a FROM requests GROUP BY ip) SELECT ip AS ip_address FROM e WHERE a = 'block'")
def block_state(spark, sf_dir):
    r = requests(spark, sf_dir)
    return V.block_state(r.select(F.col("ip").alias("ip_address"), F.when(F.col("blocked") == 1, "block").otherwise("unblock").alias("action"), F.struct("epoch", "id").alias("at")))


_PATHS = {"/search": "search", "/api/diagraph/export_csv": "export", "/audio/7.mp3": "audio", "/resonance/context/7": "context", "/resonance/data": "resonance", "/": "general"}


@query("request_policy", f"WITH {REQUESTS_SQL} SELECT ({list(_PATHS.values())})[CAST(id % {len(_PATHS)} AS INTEGER) + 1] AS policy, count(*) AS n FROM requests GROUP BY 1")
def request_policy(spark, sf_dir):
    r = requests(spark, sf_dir).withColumn("path", pick(tuple(_PATHS), F.col("id")))
    return r.groupBy(V.request_policy(F.col("path"), F.col("method")).alias("policy")).agg(F.count(F.lit(1)).alias("n"))


_AGENTS, _FETCH = ("Mozilla/5.0", "curl/8.1", "", "Python-Requests/2"), ("same-origin", "cross-site", "")
_REFUSED = {"/corpus-export-all": "honeypot", "/search": "general", "/resonance/data": "data", "/": "none", "/api/diagraph/4": "data"}


@query(
    "request_refusals",
    f"""WITH {REQUESTS_SQL}, r AS (SELECT id, ({list(_REFUSED)})[CAST(id % 5 AS INTEGER) + 1] AS p, ({list(_AGENTS)})[CAST(id // 5 % 4 AS INTEGER) + 1] AS a, ({list(_FETCH)})[CAST(id // 20 % 3 AS INTEGER) + 1] AS f, id // 60 % 2 = 0 AS fetched, CASE WHEN id // 120 % 2 = 0 THEN 51 ELSE 50 END AS page FROM requests)
SELECT id, CASE WHEN p = '/' THEN '' WHEN p = '/corpus-export-all' THEN 'honeypot' WHEN f = 'cross-site' THEN 'cross_site' WHEN p <> '/search' AND NOT fetched THEN 'missing_fetch_signal' WHEN a <> 'Mozilla/5.0' THEN 'automation_client' WHEN p = '/search' AND page > 50 THEN 'deep_pagination' ELSE '' END AS reason FROM r""",
)
def request_refusals(spark, sf_dir):
    n = F.col("id")
    r = requests(spark, sf_dir).withColumns({"path": pick(tuple(_REFUSED), n), "agent": pick(_AGENTS, F.expr("id div 5")), "fetch_site": pick(_FETCH, F.expr("id div 20")), "requested_with": F.when(F.expr("id div 60") % 2 == 0, "fetch"), "page": F.when(F.expr("id div 120") % 2 == 0, 51).otherwise(50)})
    r = r.withColumn("policy", V.request_policy(F.col("path"), F.col("method")))
    return r.select("id", F.coalesce(V.refusal(r, V.Limits())["reason"], F.lit("")).alias("reason"))


_LIMITS = ", ".join(f"('{n}', {a}, {b}, {c})" for n, (a, b, c) in V.guard.POLICIES.items())


@query("guard_policies", f"WITH {REQUESTS_SQL}, l AS (SELECT * FROM (VALUES {_LIMITS}) t(policy, \"limit\", window_seconds, penalty_seconds)), n AS (SELECT ({list(_PATHS.values())})[CAST(id % {len(_PATHS)} AS INTEGER) + 1] AS policy, count(*) AS n FROM requests GROUP BY 1) SELECT l.*, coalesce(n, 0) AS n_requests FROM l LEFT JOIN n USING (policy)")
def guard_policies(spark, sf_dir):
    """The policies in force, and how many requests fall under each."""
    r = requests(spark, sf_dir).withColumn("path", pick(tuple(_PATHS), F.col("id")))
    n = r.groupBy(V.request_policy(F.col("path"), F.col("method")).alias("policy")).agg(F.count(F.lit(1)).alias("n"))
    return V.guard_policies(spark).join(n, "policy", "left").select("policy", "limit", "window_seconds", "penalty_seconds", F.coalesce("n", F.lit(0)).alias("n_requests"))


@query("request_groups", f"WITH {REQUESTS_SQL} SELECT DISTINCT 'ip:' || ip AS node, min('ip:' || ip) OVER (PARTITION BY visitor) AS root FROM requests")
def request_groups(spark, sf_dir):
    """Addresses that a visitor joins, by the least of them."""
    r = requests(spark, sf_dir).withColumn("who", V.identities(F.col("ip"), F.col("visitor")))
    g = connected(r.select(F.col("who")[0].alias("a"), F.col("who")[1].alias("b")))
    return g.where("node LIKE 'ip:%'").select("node", "root")


@query(
    "rate_limit_first",
    f"""WITH {REQUESTS_SQL}, n AS (SELECT ip, visitor, epoch, id, row_number() OVER (PARTITION BY ip ORDER BY epoch, id) AS a, row_number() OVER (PARTITION BY visitor ORDER BY epoch, id) AS v FROM requests),
f AS (SELECT visitor, min((epoch, id)) AS at FROM n WHERE a > 30 OR v > 30 GROUP BY visitor)
SELECT n.id, (f.at IS NULL OR (n.epoch, n.id) < f.at) AS allowed FROM n LEFT JOIN f ON f.visitor = n.visitor""",
)
def rate_limit_first(spark, sf_dir):
    """With a window and a penalty longer than the data, the first request over the limit of its address or its visitor blocks all of
    the visitor's requests from then on."""
    forever = 10_000_000
    return V.guard_requests(requests(spark, sf_dir), {n: (30, forever, forever) for n in V.guard.POLICIES}).select("id", "allowed")


@query("rate_limit_guard")
def rate_limit_guard(spark, sf_dir):
    return V.guard_requests(requests(spark, sf_dir), {"general": (3, 3600, 7200)} | {n: (3, 60, 120) for n in ("search", "resonance", "context", "export", "audio", "login")})


@query("guard_status")
def guard_status(spark, sf_dir):
    return V.guard_status(rate_limit_guard(spark, sf_dir), NOW)


def _stream(spark, sf_dir):
    return as_requests(run.source(spark, f"{sf_dir}/events.parquet"))


@query("stream_ip_activity", f"WITH {REQUESTS_SQL}, {_ACTIVITY} SELECT * FROM activity")
def stream_ip_activity(spark, sf_dir):
    return run.drain(Vs.ip_activity(_stream(spark, sf_dir)), "complete")


@query("stream_ip_activity_merged", f"WITH {REQUESTS_SQL}, {_ACTIVITY} SELECT * FROM activity")
def stream_ip_activity_merged(spark, sf_dir):
    return run.newest(Vs.activity_changes(_stream(spark, sf_dir), keep="60 days"), ("ip", "bucket_epoch"))


@query("stream_online", f"WITH {REQUESTS_SQL} SELECT {_BUCKET} AS bucket_epoch, count(DISTINCT visitor) AS online FROM requests GROUP BY 1")
def stream_online(spark, sf_dir):
    return Vs.online_counts(_stream(spark, sf_dir), keep="60 days")


@query("stream_rate_limit_guard")
def stream_rate_limit_guard(spark, sf_dir):
    return Vs.guard_requests(_stream(spark, sf_dir), {"general": (3, 3600, 7200)} | {n: (3, 60, 120) for n in ("search", "resonance", "context", "export", "audio", "login")})


@query("blocked_requests", f"WITH {REQUESTS_SQL} SELECT id, ip LIKE '%.1' AS is_blocked FROM requests")
def blocked_requests(spark, sf_dir):
    r = requests(spark, sf_dir)
    return V.flag_blocked(r, r.where("ip LIKE '%.1'").select(F.col("ip").alias("ip_address"))).select("id", "is_blocked")


@query("incremental_entries", "SELECT doc_id AS id FROM documents WHERE doc_id > (SELECT max(conv_id) FROM conversations)")
def incremental_entries(spark, sf_dir):
    return V.incremental(entries(spark, sf_dir).select("id"), turns(spark, sf_dir))
