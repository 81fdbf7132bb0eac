"""Visitor and request statistics."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import guard
from ..functions.guard import Guard, Limits
from ..functions.text import mask_ip4, visitor_hash
from ..shipping import Working
from .groups import connected

ZONE, BUCKET, ONLINE = "Asia/Shanghai", 300, 90


def bucket(epoch: Column, seconds: int = BUCKET) -> Column:
    return epoch - F.pmod(epoch, F.lit(seconds))


def local(epoch: Column, zone: str = ZONE) -> Column:
    return F.from_utc_timestamp(F.timestamp_seconds(epoch), zone)


def day_key(epoch: Column, zone: str = ZONE) -> Column:
    return F.date_format(local(epoch, zone), "yyyy-MM-dd")


def visitors(requests: DataFrame, secret: str = "secret") -> DataFrame:
    return requests.groupBy(visitor_hash(secret, F.col("visitor")).alias("visitor_hash")).agg(F.min("epoch").alias("first_seen_epoch"), F.max("epoch").alias("last_seen_epoch"))


def current_stats(seen: DataFrame, now: int, window: int = ONLINE) -> DataFrame:
    return seen.agg(F.count_if(F.col("last_seen_epoch") >= now - window).alias("online"), F.count(F.lit(1)).alias("total"))


def daily_visitors(requests: DataFrame, last_day: str, days: int = 14) -> DataFrame:
    """Distinct visitors of each of the last days; days without any have 0."""
    last = F.to_date(F.lit(last_day))
    spine = requests.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("day_key"))
    n = requests.groupBy(day_key(F.col("epoch")).alias("day_key")).agg(F.countDistinct("visitor").alias("n"))
    return spine.join(n, "day_key", "left").select("day_key", F.coalesce("n", F.lit(0)).alias("unique_visitors"))


def ip_activity(requests: DataFrame, seconds: int = BUCKET) -> DataFrame:
    """One row for each ip and bucket; what came last is by (epoch, id)."""
    last = lambda c: F.max_by(c, F.struct("epoch", "id")).alias(f"last_{c}")
    return requests.groupBy("ip", bucket(F.col("epoch"), seconds).alias("bucket_epoch")).agg(F.min("epoch").alias("first_seen_epoch"), F.max("epoch").alias("last_seen_epoch"), F.count(F.lit(1)).alias("request_count"), F.sum("blocked").alias("blocked_count"), last("path"), last("method"), last("status"))


def recent_ips(activity: DataFrame, now: int, blocked: DataFrame | None = None, rows: int = 2000, top: int = 100, seconds: int = 86_400) -> DataFrame:
    """The newest bucket rows of the last day by ip, the ips seen last first, masked."""
    newest = activity.where(F.col("last_seen_epoch") >= now - seconds).orderBy(F.desc("last_seen_epoch"), "ip", F.desc("bucket_epoch")).limit(rows)
    by_ip = newest.groupBy("ip").agg(F.min("first_seen_epoch").alias("first_seen_epoch"), F.max("last_seen_epoch").alias("last_seen_epoch"), F.sum("request_count").alias("request_count"), F.sum("blocked_count").alias("blocked_count"), F.max_by("last_path", F.struct("last_seen_epoch", "bucket_epoch")).alias("last_path"))
    if blocked is not None:
        by_ip = by_ip.join(blocked.select(F.col("ip_address").alias("ip"), F.lit(True).alias("is_blocked")).distinct(), "ip", "left").withColumn("is_blocked", F.coalesce("is_blocked", F.lit(False)))
    return by_ip.withColumn("display_ip", mask_ip4(F.col("ip"))).orderBy(F.desc("last_seen_epoch"), "ip").limit(top)


def snapshots(requests: DataFrame, seconds: int = BUCKET) -> DataFrame:
    """Distinct visitors of each bucket as a measure of who was online."""
    return requests.groupBy(bucket(F.col("epoch"), seconds).alias("bucket_epoch")).agg(F.countDistinct("visitor").alias("online"))


def merge_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by bucket: the newest values, but the greatest peak. Both have bucket_epoch, online, peak, recorded."""
    return old.unionByName(new).groupBy("bucket_epoch").agg(F.max_by("online", "recorded").alias("online"), F.max("peak").alias("peak"), F.max("recorded").alias("recorded"))


def today_points(snaps: DataFrame, start: int, now: int, seconds: int = BUCKET) -> DataFrame:
    """Every bucket from the day's start to now, 0 where no snapshot is."""
    spine = snaps.sparkSession.range(start, now + 1, seconds).select(F.col("id").alias("bucket_epoch"))
    return spine.join(snaps, "bucket_epoch", "left").select("bucket_epoch", F.coalesce("online", F.lit(0)).alias("online"))


def hourly_peaks(points: DataFrame) -> DataFrame:
    return points.groupBy(F.date_format(local(F.col("bucket_epoch")), "yyyy-MM-dd HH:00").alias("hour")).agg(F.max("online").alias("peak"))


def daily_peak(points: DataFrame) -> DataFrame:
    return points.groupBy(day_key(F.col("bucket_epoch")).alias("day_key")).agg(F.max("online").alias("peak"))


def local_epoch(text: Column, zone: str = ZONE) -> Column:
    """Seconds of a local date and time in ISO form; null if it is none."""
    at = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")])
    return F.unix_seconds(F.to_utc_timestamp(at, zone))


def retained(rows: DataFrame, now: int, days: int = 30, column: str = "last_seen_epoch") -> DataFrame:
    """Activity of the last 30 days; snapshots by `bucket_epoch` are kept for 365."""
    return rows.where(F.col(column) >= now - days * 86_400)


def retained_days(daily: DataFrame, now: int, days: int = 365) -> DataFrame:
    """Rows of (day_key, ...) of the last local days."""
    first = F.date_sub(F.to_date(day_key(F.lit(now))), days)
    return daily.where(F.col("day_key") >= F.date_format(first, "yyyy-MM-dd"))


def cleanup_due(now: int, last: int, hours: int = 6) -> bool:
    return now - last >= hours * 3600


def block_state(events: DataFrame) -> DataFrame:
    """Blocked ips from (ip_address, action, at): the last action counts."""
    return events.groupBy("ip_address").agg(F.max_by("action", "at").alias("action")).where("action = 'block'").select("ip_address")


def _in(c: Column, values) -> Column:
    return c.isin(*sorted(values))


def _starts(c: Column, prefixes) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def request_policy(path: Column, method: Column) -> Column:
    out = F.when((path == "/admin/login") & (method == "POST"), "login")
    for name, policy in guard.BY_NAME.items():
        out = out.when(path == name, policy)
    for policy, starts in guard.BY_PREFIX:
        out = out.when(_starts(path, starts), policy)
    return out.otherwise("general")


def refusal(r: DataFrame, limits: Limits) -> Column:
    """Struct of policy, reason and seconds for a request that is refused for what it is, else null. As Guard.refusal, in the JVM."""
    cell = lambda n: F.coalesce(F.col(n), F.lit("")) if n in r.columns else F.lit("")
    path, agent = F.col("path"), cell("agent")
    data = _in(path, guard.SEARCHES) | _in(path, guard.FETCH_ONLY) | _starts(path, guard.DATA_PREFIXES)
    fetch = _in(path, guard.FETCH_ONLY) | _starts(path, guard.CONTEXTS) & ~_in(path, guard.EXPORTS)
    page = F.coalesce(F.col("page"), F.lit(1)) if "page" in r.columns else F.lit(1)
    found = lambda policy, reason, seconds: F.struct(policy.alias("policy"), F.lit(reason).alias("reason"), F.lit(seconds).alias("seconds"))
    own = F.col("policy")
    out = F.when(_in(path, guard.HONEYPOTS), found(F.lit("honeypot"), "honeypot", limits.honeypot))
    out = out.when(data & (F.lower(cell("fetch_site")) == "cross-site"), found(own, "cross_site", guard.CROSS_SITE_SECONDS))
    out = out.when(fetch & (F.lower(cell("requested_with")) != "fetch"), found(own, "missing_fetch_signal", guard.NO_SIGNAL_SECONDS))
    out = out.when(data & ((F.trim(agent) == "") | agent.rlike("(?i)" + guard.BOTS.pattern)), found(own, "automation_client", guard.BOT_SECONDS))
    deep = _in(path, guard.SEARCHES) & (page > limits.last_page) if limits.last_page else F.lit(False)
    return out.when(deep, found(F.lit("search"), "deep_pagination", 0))


def identities(ip: Column, visitor: Column) -> Column:
    """The identities of a request, whose states it reads and changes: its address, its visitor's hash, or 'anonymous'."""
    some = lambda c, made: F.when(F.coalesce(c, F.lit("")) != "", made)
    found = F.array_compact(F.array(some(ip, F.concat(F.lit("ip:"), ip)), some(visitor, F.concat(F.lit("visitor:"), F.substring(F.sha2(visitor, 256), 1, 24)))))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("anonymous")))


DECISIONS = "id long, ip string, epoch long, path string, allowed boolean, policy string, reason string, status int, retry_after int, remaining int"
#: The guard's state: a row for each identity, and the moment from which it says nothing any more.
STATE = "identity string, until double, logs map<string,array<double>>, alive double"
_NAMES = [c.split()[0] for c in DECISIONS.split(", ")]
_OUT = {"id": pa.int64(), "ip": pa.string(), "epoch": pa.int64(), "path": pa.string(), "allowed": pa.bool_(), "policy": pa.string(), "reason": pa.string(), "status": pa.int32(), "retry_after": pa.int32(), "remaining": pa.int32()}
_OUT |= {"identity": pa.string(), "until": pa.float64(), "logs": pa.map_(pa.string(), pa.list_(pa.float64())), "alive": pa.float64(), "root": pa.string()}
_READ = ("root", "epoch", "policy", "refused_policy", "reason", "seconds", "one", "two", "identity", "until", "logs")
#: Rows of state that are given out at once.
_STATE_ROWS = 4096


def _batch(columns: dict, n: int) -> pa.RecordBatch:
    """The columns given, the others null."""
    made = [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], kind) if c in columns else pa.nulls(n, kind) for c, kind in _OUT.items()]
    return pa.RecordBatch.from_arrays([x if x.type == kind else x.cast(kind, safe=False) for x, kind in zip(made, _OUT.values())], names=list(_OUT))


def _cells(column: pa.Array) -> list:
    """The values of a column, as to_pylist(), which takes each from Arrow by itself: most columns of a batch of requests are all null or have none."""
    if column.null_count == len(column):
        return [None] * len(column)
    return column.to_pylist() if column.null_count or pa.types.is_nested(column.type) else column.to_numpy(zero_copy_only=False).tolist()


def _decide(batches: Iterator[pa.RecordBatch], limits: Limits, keep: bool) -> Iterator[pa.RecordBatch]:
    """Rows of a group: first the state of its identities, then its requests in order; beside the decisions, with `keep`, the new state.
    Groups may be small and many, so a batch of rows gives a batch of decisions, and states are gathered over groups."""
    state, at, seen = Guard(limits), None, {}
    left: list[tuple] = []

    def leave() -> None:
        """What the group leaves behind: of each identity the block and the logs that are not over by its own last request."""
        logs: dict[str, dict] = {w: {} for w, until in state.blocked.items() if until > seen.get(w, until - 1)}
        for (w, policy), times in state.recent.items():
            if times and times[-1] > seen.get(w, times[-1]) - limits.policies[policy][1]:
                logs.setdefault(w, {})[policy] = list(times)
        for w, x in logs.items():
            until = state.blocked.get(w, 0.0)
            left.append((w, until, list(x.items()), max([until, *(times[-1] + limits.policies[p][1] for p, times in x.items())]), at))

    def given() -> Iterator[pa.RecordBatch]:
        if left:
            yield _batch(dict(zip(("identity", "until", "logs", "alive", "root"), map(list, zip(*left)))), len(left))
            left.clear()

    for batch in batches:
        out = []
        for root, epoch, policy, refused, reason, seconds, one, two, identity, until, logs in zip(*(_cells(batch.column(c)) for c in _READ)):
            if root != at:
                if keep and at is not None:
                    leave()
                state, at, seen = Guard(limits), root, {}
            if identity is not None:
                if until > 0:
                    state.blocked[identity] = until
                for name, times in dict(logs).items():
                    state.recent[identity, name] = deque(times)
                continue
            now, who = float(epoch), [one] if two is None else [one, two]
            out.append(state.settle(now, who, policy, (refused, reason, seconds) if reason else None))
            if keep:
                for w in who:
                    seen[w] = now
        if out:
            own = batch.filter(pc.is_null(batch.column("identity")))
            told = {c: [getattr(d, c) for d in out] for c in ("allowed", "policy", "reason", "status", "retry_after", "remaining")}
            yield _batch({c: own.column(c) for c in ("id", "ip", "epoch", "path")} | told, len(out))
        if len(left) >= _STATE_ROWS:
            yield from given()
    if keep and at is not None:
        leave()
    yield from given()


def _horizon(policy: Column, limits: Limits) -> Column:
    """Seconds after which a request under the policy that is not refused says nothing about later ones: its place in the log and a block
    that it may bring are over."""
    return F.coalesce(F.create_map(*[F.lit(x) for name, (_, window, penalty) in limits.policies.items() for x in (name, float(max(window + 1, penalty)))])[policy], F.lit(0.0))


def guard_sessions(judged: DataFrame, state: DataFrame, limits: Limits) -> DataFrame:
    """(identity, slice, session): the sessions that each identity's requests fall into, by slices of time. A session ends where no
    request of the identity has an effect any more, so nothing is carried into the next one. Slices are as long as most effects, and only
    their bounds are sorted, not requests. What `state` brings along is before the first slice."""
    span = max(max(window + 1, penalty) for _, window, penalty in limits.policies.values())
    end = F.col("epoch") + F.when(F.col("reason") != "", F.col("seconds").cast("double")).otherwise(_horizon(F.col("policy"), limits))
    touched = judged.select(F.explode("who").alias("identity"), F.floor(F.col("epoch") / span).cast("long").alias("slice"), F.col("epoch").cast("double").alias("lo"), end.alias("hi"))
    before = state.select("identity", F.lit(_BEFORE).cast("long").alias("slice"), F.lit(float(_BEFORE)).alias("lo"), F.col("alive").alias("hi"))
    slices = touched.unionByName(before).groupBy("identity", "slice").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    w = Window.partitionBy("identity").orderBy("slice")
    over = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return slices.withColumn("over", over).withColumn("session", F.max(F.when(F.col("over").isNull() | (F.col("lo") >= F.col("over")), F.col("slice"))).over(w)).select("identity", "slice", "session")


_BEFORE = -(1 << 40)


def guard_groups(judged: DataFrame, state: DataFrame, limits: Limits, work: Working) -> tuple[DataFrame, DataFrame]:
    """The judged requests with the `root` of their group, and (identity, session, root) of all sessions. Sessions that a request joins are
    one group, over any number of others."""
    span = max(max(window + 1, penalty) for _, window, penalty in limits.policies.values())
    sessions = work.table("sessions", guard_sessions(judged, state, limits))
    named = judged.withColumns({"one": F.col("who")[0], "two": F.get("who", 1), "slice": F.floor(F.col("epoch") / span).cast("long")})
    for c in ("one", "two"):
        own = sessions.select(F.col("identity").alias(c), "slice", F.concat_ws("#", "identity", "session").alias(f"{c}_node"))
        named = named.join(own, [c, "slice"], "left")
    named = work.table("named", named.select(*judged.columns, "one_node", "two_node"))
    groups = work.table("groups", connected(named.where("two_node IS NOT NULL").select(F.col("one_node").alias("a"), F.col("two_node").alias("b"))))
    rooted = named.join(groups, F.col("one_node") == F.col("node"), "left").select(F.coalesce("root", "one_node").alias("root"), *judged.columns)
    of = sessions.select("identity", "session").distinct().withColumn("own", F.concat_ws("#", "identity", "session"))
    return rooted, of.join(groups, F.col("own") == F.col("node"), "left").select("identity", "session", F.coalesce("root", "own").alias("root"))


#: Requests that are judged in one stream whatever quiet times lie between them.
WHOLE = 100_000


def guard_streams(judged: DataFrame, state: DataFrame, limits: Limits, work: Working, whole: int) -> tuple[DataFrame, DataFrame]:
    """As guard_groups(). Identities that requests join at any time are few beside the requests, so groups over all times are found first;
    only those of over `whole` requests are taken apart by sessions. Either way a request and those that it depends on are in one group."""
    pairs = work.table("pairs", judged.groupBy(F.col("who")[0].alias("a"), F.get("who", F.lit(1)).alias("b")).agg(F.count(F.lit(1)).alias("n")))
    joined = connected(pairs.where("b IS NOT NULL").select("a", "b"))
    roots = work.table("roots", pairs.groupBy("a").agg(F.sum("n").alias("n")).join(joined, F.col("a") == F.col("node"), "left").select(F.col("a").alias("identity"), F.coalesce("root", "a").alias("root"), "n"))
    large = work.table("large", roots.groupBy("root").agg(F.sum("n").alias("n")).where(F.col("n") > whole).select("root"))
    rooted = judged.withColumn("one", F.col("who")[0]).join(roots.select(F.col("identity").alias("one"), "root"), "one").select("root", *judged.columns)
    all_of = roots.select("identity", "root").unionByName(joined.select(F.col("node").alias("identity"), "root")).distinct()
    sessions = all_of.join(large, "root", "left_anti").select("identity", F.lit(_BEFORE).cast("long").alias("session"), "root")
    if large.isEmpty():
        return rooted, sessions
    parts, of = guard_groups(rooted.join(large, "root", "left_semi").select(*judged.columns), state.join(all_of.join(large, "root", "left_semi"), "identity", "left_semi"), limits, work)
    return rooted.join(large, "root", "left_anti").unionByName(parts), sessions.unionByName(of)


def guard_step(requests: DataFrame, state: DataFrame | None, limits: Limits, work: Working, keep: bool = True, whole: int = WHOLE) -> tuple[DataFrame, DataFrame]:
    """Decisions on requests, and the state after them of the identities that they touch (without `keep` none), given the state before
    (none: empty).

    A request changes the states of its address and of its visitor. Requests that meet in one of them, over any number of others, are
    one group and are judged in time order. In a large group each identity has sessions, between which its state is empty, and only
    requests whose sessions meet are together; so a gateway joins only those who use it within its session. What a request is refused
    for and its policy are worked out before, and requests that are exempt never travel. A group is a sorted stream that holds the
    state of its identities alone."""
    spark = requests.sparkSession
    visitor = F.col("visitor") if "visitor" in requests.columns else F.lit(None).cast("string")
    method = F.coalesce(F.col("method"), F.lit("GET")) if "method" in requests.columns else F.lit("GET")
    path = F.col("path")
    free = (method == "OPTIONS") | path.startswith("/static/") | (path == "/api/visitor-stats") | _in(F.coalesce("ip", F.lit("")), limits.trusted or ("-",))
    if "admin" in requests.columns:
        free = free | F.coalesce("admin", F.lit(False))
    r = requests.withColumns({"free": free, "policy": request_policy(path, method), "who": identities(F.col("ip"), visitor)})
    r = r.withColumn("no", refusal(r, limits)).select("id", "ip", "epoch", "path", "free", "policy", "who", F.col("no.policy").alias("refused_policy"), F.coalesce("no.reason", F.lit("")).alias("reason"), F.coalesce("no.seconds", F.lit(0)).alias("seconds"))
    judged = r.where("NOT free").drop("free")
    empty = spark.createDataFrame([], STATE)
    before = empty
    if state is not None:
        before = work.table("before", state.join(judged.select(F.explode("who").alias("identity")).distinct(), "identity", "left_semi").select(*empty.columns))
    rooted, sessions = guard_streams(judged, before, limits, work, whole)
    none = lambda schema: [F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    rows = rooted.select("*", *none(empty.schema))
    if state is not None:
        carried = before.join(sessions.where(F.col("session") == _BEFORE), "identity").select("root", *none(judged.schema), *empty.columns)
        rows = rows.unionByName(carried)
    flat = rows.select("*", F.get("who", F.lit(0)).alias("one"), F.get("who", F.lit(1)).alias("two")).drop("who", "alive")
    ordered = flat.repartition("root").sortWithinPartitions("root", F.col("identity").isNull(), "epoch", "id")
    done = ordered.mapInArrow(lambda batches: _decide(batches, limits, keep), f"{DECISIONS}, {STATE}, root string")
    done = work.table("decided", done) if keep else done
    passed = r.where("free").select("id", "ip", "epoch", "path", F.lit(True).alias("allowed"), F.lit("").alias("policy"), F.lit("").alias("reason"), F.lit(200).alias("status"), F.lit(0).alias("retry_after"), F.lit(0).alias("remaining"))
    # what an identity's last session leaves; earlier ones are over by then
    last = sessions.groupBy("identity").agg(F.max_by("root", "session").alias("root"))
    after = done.where("identity IS NOT NULL").join(last, ["identity", "root"], "left_semi").select(*empty.columns)
    return done.where("identity IS NULL").select(*_NAMES).unionByName(passed), after


def guard_requests(requests: DataFrame, policies: dict | None = None, limits: Limits | None = None, whole: int = WHOLE) -> DataFrame:
    """The guard's decision on each request: guard_step() from an empty state."""
    limits = limits or (Limits(policies=dict(policies)) if policies else Limits())
    return guard_step(requests, None, limits, Working(requests.sparkSession, "guard"), False, whole)[0]


def guard_policies(spark: SparkSession, limits: Limits = Limits()) -> DataFrame:
    """The policies in force, as the status page lists them."""
    return spark.createDataFrame([(n, *p) for n, p in limits.policies.items()], "policy string, limit int, window_seconds int, penalty_seconds int")


def guard_status(decisions: DataFrame, now: int) -> DataFrame:
    until = F.when((F.col("retry_after") > 0) & (F.col("reason") != "temporary_block"), F.col("epoch") + F.col("retry_after"))
    by_ip = decisions.groupBy("ip").agg(F.max(until).alias("until"), F.count_if(until.isNotNull()).alias("n"))
    return by_ip.agg(F.count_if(F.col("until") > now).alias("active_blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_blocks"))


def flag_blocked(requests: DataFrame, blocked: DataFrame) -> DataFrame:
    """is_blocked for each request, from a list of ip_address; requests may be a stream, the list then is read anew for each batch."""
    b = blocked.select(F.col("ip_address").alias("ip"), F.lit(True).alias("is_blocked")).dropDuplicates(["ip"])
    return requests.join(b, "ip", "left").withColumn("is_blocked", F.coalesce("is_blocked", F.lit(False)))


def incremental(source: DataFrame, derived: DataFrame, key: str = "entry_id", id: str = "id") -> DataFrame:
    """Rows of source after the greatest key that derived has: what a resumed derivation still has to do."""
    done = derived.agg(F.coalesce(F.max(key), F.lit(-(1 << 62))).alias("done"))
    return source.join(F.broadcast(done), F.col(id) > F.col("done")).drop("done")  # one row
