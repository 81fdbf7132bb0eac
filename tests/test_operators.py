import pytest
from pyspark.sql import functions as F

from turnmill.operators import folding
from turnmill.operators import ingest as I
from turnmill.operators import pairs as P
from turnmill.operators import statistics as St
from turnmill.operators import visits as V
from turnmill.operators.groups import connected
from turnmill.operators.search import SearchFilters, search_entries, search_turns
from turnmill.shipping import Working
from turnmill.sources import files


def test_csv_with_mark_and_line_feeds(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("﻿title,content,source,year\n甲,\"一\n二\",s,2001\n乙,\"x \"\"y\"\"\",s,bad\n,z,s,\n丙,\"一\n二\",s,\n", encoding="utf-8")
    raw = files.read_csv(spark, str(p)).withColumn("row_no", F.monotonically_increasing_id())
    made = I.prepare(raw, "b", "now")
    new = I.import_rows(made, made.where("false"))
    assert I.import_report(made, new).first().asDict() == {"success": 2, "failed": 1, "duplicate": 1}
    assert {(r.title, r.year) for r in new.collect()} == {("甲", 2001), ("乙", None)}
    with pytest.raises(files.MissingColumns):
        files.read_csv(spark, str(p), ("title", "nothing"))
    files.write_csv(new.select("title", "content"), str(tmp_path / "out"))
    assert files.read_csv(spark, str(tmp_path / "out"), ("title",)).count() == 2


def test_json_entries(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text('[{"id": 1, "title": "t", "content": "你好", "source": "s", "year": 2020, "category": ""}]', encoding="utf-8")
    r = files.read_entries_json(spark, str(p)).first()
    assert (r.dataset_name, r.import_batch, r.year) == ("s", "sample_init", 2020)


def test_split_entries_segment_and_content(spark):
    df = spark.createDataFrame([(1, "【甲】：你好啊\n【乙】：好的呀", None, None, None, None), (2, "x", "记者：你好吗", "未知", "c9", "3"), (3, None, None, None, None, None)], "id long, content string, current_segment string, speaker string, conversation_id string, segment_index string")
    got = sorted((r.entry_id, r.turn_index, r.speaker_label, r.turn_text, r.conversation_key) for r in P.split_entries(df).collect())
    assert got == [(1, 1, "甲", "你好啊", "entry:1"), (1, 2, "乙", "好的呀", "entry:1"), (2, 3, "记者", "你好吗", "c9")]


def test_showcase_takes_datasets_in_turn(spark):
    rows = [(i, ds, 1) for i, ds in enumerate(["骆驼祥子", "骆驼祥子", "平凡的世界", "平凡的世界", "雷雨", "雷雨"], 4)]
    df = spark.createDataFrame(rows, "id long, dataset_name string, has_lexical_echo int").selectExpr("*", "0 has_pattern_reuse", "1 has_question_response", "0 has_negation_turn", "0 has_repair_repetition", "'甲' speaker_a", "'乙' speaker_b", "'你好你好' text_a", "'好的' text_b", "'s' source", "'c' category")
    page = P.showcase_page(df, ("雷雨", "平凡的世界", "骆驼祥子")).collect()
    assert [r.dataset_name for r in page] == ["雷雨", "平凡的世界", "骆驼祥子"] * 2
    assert [r.id for r in P.resonance_page(df).collect()] == [9, 8, 7, 6, 5, 4]
    assert P.showcase_page(df.withColumn("speaker_b", F.lit("甲")), ("雷雨",)).count() == 0


def test_search_on_empty_tables(spark):
    t = spark.createDataFrame([], "id long, entry_id long, turn_index int, speaker_label string, turn_text string, source string, category string, dataset_name string, conversation_key string")
    e = spark.createDataFrame([], "id long, title string, content string, source string, category string, dataset_name string, year int, audio_file string")
    assert search_turns(t, e, SearchFilters("x"), 5).count() == 0 and search_entries(e, SearchFilters("x"), 5).count() == 0


def test_bad_numbers_are_ignored(spark):
    e = spark.createDataFrame([(1, "t", "abc", "s", "c", "d", 2000, None)], "id long, title string, content string, source string, category string, dataset_name string, year int, audio_file string")
    assert search_entries(e, SearchFilters("abc", year="x", content_min="?", content_max="")).count() == 1


def test_numbering_is_gapless(spark):
    df = spark.range(1000).select(F.xxhash64("id").alias("k"))
    got = I.with_ids(df, 10, "k").orderBy("k").select("id").toPandas()["id"].tolist()
    assert got == list(range(11, 1011))


def test_copy_skips_rows_by_any_key(spark):
    s = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d")], "id long, content_hash string")
    t = spark.createDataFrame([(1, "x"), (9, "b"), (8, None)], "id long, content_hash string")
    assert sorted(r.id for r in I.new_rows(s, t, "id", "content_hash").collect()) == [3, 4]


def _asked(spark, rows):
    """Requests from dictionaries, in order one second apart unless they say when; the rest as a browser sends it."""
    usual = {"path": "/search", "method": "GET", "ip": "203.0.113.10", "visitor": "a", "agent": "Mozilla/5.0", "fetch_site": "same-origin", "requested_with": "fetch", "page": 1, "admin": False}
    schema = "id long, epoch long, path string, method string, ip string, visitor string, agent string, fetch_site string, requested_with string, page int, admin boolean"
    return spark.createDataFrame([tuple((usual | {"id": (1 << 53) + i, "epoch": 1000 + i} | r)[c.split()[0]] for c in schema.split(", ")) for i, r in enumerate(rows)], schema)


NAMES = ("general", "search", "resonance", "context", "export", "audio", "login")


@pytest.mark.parametrize(
    "limit,rows,want",
    [
        (3, [{}, {}, {}, {}, {"path": "/", "epoch": 1060}], ["", "", "", "rate_limit", "temporary_block"]),
        (2, [{"ip": f"203.0.113.{i}"} for i in range(1, 4)], ["", "", "rate_limit"]),
        (2, [{"ip": f"203.0.113.{i}"} for i in range(1, 7)], ["", "", "rate_limit"] + ["temporary_block"] * 3),
        (2, [{"visitor": v} for v in "abc"], ["", "", "rate_limit"]),
        (3, [{"path": "/api/resonance", "requested_with": ""}], ["missing_fetch_signal"]),
        (3, [{"agent": "python-requests/2.32"}], ["automation_client"]),
        (3, [{"page": 11}, {}], ["deep_pagination", ""]),
        (3, [{"path": "/corpus-export-all"}, {"path": "/", "epoch": 1100}], ["honeypot", "temporary_block"]),
        (1, [{"admin": True, "agent": "curl/8"}, {"ip": "203.0.113.99", "agent": "curl/8"}, {"method": "OPTIONS"}, {"path": "/static/x"}], [""] * 4),
        (1, [{"ip": None, "visitor": ""}, {"ip": "", "visitor": None}, {"fetch_site": "cross-site"}], ["", "rate_limit", "cross_site"]),
        (2, [{"ip": "1", "visitor": "a"}, {"ip": "2", "visitor": "b"}, {"ip": "1", "visitor": "b"}, {"ip": "2", "visitor": "b"}], ["", "", "", "rate_limit"]),
    ],
)
def test_guard_across_identities(spark, limit, rows, want, tmp_path):
    limits = V.Limits({n: (limit, 60, 120) for n in NAMES}, last_page=10, honeypot=600, trusted=("203.0.113.99",))
    asked = _asked(spark, rows)
    got = V.guard_requests(asked, limits=limits).orderBy("id").collect()
    assert [r.reason for r in got] == want and [r.id for r in got] == [(1 << 53) + i for i in range(len(rows))]
    one = V.Guard(limits)
    plain = [one.decide(r.epoch, r.path, r.method, r.ip or "", r.visitor or "", r.agent, r.fetch_site, r.requested_with, r.page, r.admin) for r in asked.orderBy("id").collect()]
    assert [(r.allowed, r.policy, r.reason, r.status, r.retry_after, r.remaining) for r in got] == [(d.allowed, d.policy, d.reason, d.status, d.retry_after, d.remaining) for d in plain]
    # the same, a batch for each request: the state goes from batch to batch
    from turnmill.streaming import visits as Vs

    step = Vs.guard_step(limits)
    by_batch = [step(asked.where(F.col("id") == r.id), k, f"file://{tmp_path}").first() for k, r in enumerate(got)] if len(rows) < 5 else got
    assert [(r.reason, r.retry_after, r.remaining) for r in by_batch] == [(r.reason, r.retry_after, r.remaining) for r in got]


def test_guard_batch_and_stream_agree(spark, tmp_path):
    from turnmill.streaming import run
    from turnmill.streaming import visits as Vs

    rows = spark.range(200).selectExpr("id", "concat('10.0.0.', id % 6) ip", "cast(id % 3 as string) visitor", "1700000000 + id * 2 epoch", "'/' path", "'GET' method", "200 status", "0 blocked")
    rows.write.parquet(str(tmp_path / "r"))
    limits = {"general": (3, 60, 120)}
    a = V.guard_requests(spark.read.parquet(str(tmp_path / "r")), limits).select("id", "allowed", "reason", "retry_after")
    b = Vs.guard_requests(run.source(spark, str(tmp_path / "r")), limits).select("id", "allowed", "reason", "retry_after")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.where("NOT allowed").count() > 0


def test_connected_groups_match_union_find(spark):
    import random

    rng = random.Random(5)
    pairs = [(str(rng.randrange(60)), str(rng.randrange(60))) for _ in range(45)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(40)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    got = {r.node: r.root for r in connected(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == {x: root(x) for x in up if any(x in p and p[0] != p[1] for p in pairs)}


@pytest.mark.parametrize("pieces", [None, 1, 7, 40])
def test_window_pieces_equal_one_fold(spark, pieces):
    import random

    from turnmill.functions import grammar, windows

    rng = random.Random(12)
    rows = []
    for d in ("甲集", "乙集"):
        at = 0
        for k in range(120):
            at = at + 2 if k < 40 or rng.random() < 0.6 else rng.randrange(400)
            text = "\n".join(f"【{'甲乙'[i % 2]}】：话{i}" for i in range(at, at + rng.randint(1, 5)))
            rows.append((d, k, f"t{k}", rng.choice(["", "", "第一章"]), f"chunk{k}", text))
    df = spark.createDataFrame(rows, "dataset_name string, row_index long, title string, chapter string, chunk_id string, content string").repartition(5)
    want = []
    for d in ("甲集", "乙集"):
        parsed = [(d, c, t, chunk, grammar.merge_turns(x)) for n, _, t, c, chunk, x in rows if n == d]
        kept, equal, inside = windows.merge([r for r in parsed if len(r[4]) > 1])
        want += [(d, f"{d}_{i:04d}", f"《{d}》{x.chapter + ' ' if x.chapter else ''}合并大对话 {i:04d}", len(x.turns), " | ".join(x.titles[:20]), x.merges, x.contained, equal, inside) for i, x in enumerate(kept, 1)]
    got = folding.merge_windows(df, pieces).select("dataset_name", "dialogue_id", "title", "turn_count", "source_titles", "merges", "contained", "duplicates", "inside").collect()
    assert sorted(map(tuple, got)) == sorted(want) and any(w[5] for w in want) and len(want) > 20


def test_windows_that_share_a_short_turn_stay_apart(spark):
    """Unrelated windows with one turn in common are dialogues of their own, and no task has more than its share of them."""
    said = lambda k: f"【甲】：话{k}\n" + ("【乙】：嗯。" if k % 10 == 0 else f"【乙】：答{k}") + f"\n【甲】：完{k}"
    df = spark.createDataFrame([("集", k, f"t{k}", "", f"chunk{k}", said(k)) for k in range(2000)], "dataset_name string, row_index long, title string, chapter string, chunk_id string, content string")
    found = folding.starts(df, Working(spark, "t"), 8)
    assert found.where("start = place").count() == 2000
    assert found.groupBy(F.shiftright("place", 33)).count().agg(F.max("count")).first()[0] < 500
    got = folding.merge_windows(df).select("dialogue_id", "turn_count", "merges", "duplicates", "inside").collect()
    assert sorted(map(tuple, got)) == [(f"集_{k:04d}", 3, 0, 0, 0) for k in range(1, 2001)]


def test_equal_and_contained_dialogues_go(spark):
    text = lambda a, n: "\n".join(f"【{'甲乙'[i % 2]}】：话{i}" for i in range(a, a + n))
    rows = [(0, "", "chunk1", text(0, 6)), (1, "", "chunk9", text(50, 3)), (2, "", "chunk2", text(2, 3)), (3, "", "chunk9", text(80, 2)), (4, "", "chunk9", text(50, 3)), (5, "", "chunk40", text(1, 2)), (6, "一", "chunk1", text(90, 2)), (7, "二", "chunk1", text(1, 2))]
    df = spark.createDataFrame([("集", k, f"t{k}", c, u, x) for k, c, u, x in rows], "dataset_name string, row_index long, title string, chapter string, chunk_id string, content string")
    for pieces in (1, 3, 8):
        got = folding.merge_windows(df, pieces).select("source_titles", "duplicates", "inside").collect()
        assert sorted(r.source_titles for r in got) == ["t0", "t1", "t3", "t5", "t6", "t7"] and {(r.duplicates, r.inside) for r in got} == {(1, 1)}


def test_ids_are_stable_where_rows_are_equal_in_order(spark):
    rows = [(k % 3, f"row {k}") for k in range(60)]
    runs = [sorted((r.text, r.id) for r in I.with_ids(spark.createDataFrame(rows, "a int, text string").repartition(n), 100, "a").collect()) for n in (1, 7)]
    assert runs[0] == runs[1] and sorted(i for _, i in runs[0]) == list(range(101, 161))


def _requests(rows):
    return [(k, f"10.0.0.{k % 2}", str(k % 3), 1_700_000_000 + (k * 977) % 5000, f"/{k}", "GET", 200, k % 2) for k in rows]


REQUESTS = "id long, ip string, visitor string, epoch long, path string, method string, status int, blocked int"


def test_late_requests_merge_over_restarts(spark, tmp_path):
    """Three files, none in order of time, each read by a run of its own that goes on where the last one ended."""
    from turnmill.streaming import run
    from turnmill.streaming import visits as Vs

    stream = lambda: spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "r"))
    for n in range(3):
        spark.createDataFrame(_requests(range(120)[n::3]), REQUESTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
        got = run.newest(Vs.activity_changes(stream()), ("ip", "bucket_epoch"), f"file://{tmp_path}/activity")
        online = Vs.online_counts(stream(), at=f"file://{tmp_path}/online")
    whole = spark.createDataFrame(_requests(range(120)), REQUESTS)
    want = V.ip_activity(whole)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, online.collect())) == sorted(map(tuple, V.snapshots(whole).collect()))
    guarded = Vs.guard_requests(stream(), {n: (4, 600, 50) for n in NAMES})
    assert guarded.count() == 120 and guarded.where("reason = 'rate_limit'").count() > 0


def test_state_follows_the_changed_keys(spark, tmp_path):
    """The second batch touches one of many keys, and only this key's row is given out and its state updated."""
    from turnmill.streaming import run
    from turnmill.streaming import visits as Vs

    first = [(k, f"10.0.{k}.1", "v", 1_700_000_000, "/", "GET", 200, 0) for k in range(200)]
    for rows in (first, [(900, "10.0.7.1", "v", 1_700_000_010, "/x", "GET", 200, 1)]):
        spark.createDataFrame(rows, REQUESTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
        stream = spark.readStream.schema(REQUESTS).parquet(str(tmp_path / "r"))
        changed = run.changes(Vs.activity_changes(stream), f"file://{tmp_path}/at")
    counts = {r.batch: r["count"] for r in changed.groupBy("batch").count().collect()}
    assert sorted(counts.values()) == [1, 200]
    assert changed.where("ip = '10.0.7.1'").agg(F.max("request_count"), F.max("blocked_count")).first() == (2, 1)


def test_state_expires(spark, tmp_path):
    """Once the watermark has passed a bucket its state is cleared, so a request that comes even later is dropped instead of starting anew."""
    from turnmill.streaming import run
    from turnmill.streaming import visits as Vs

    for k, epoch in enumerate((1_700_000_000, 1_700_100_000, 1_700_100_001, 1_700_000_010)):
        spark.createDataFrame([(k, "10.0.0.1", "v", epoch, "/", "GET", 200, 0)], REQUESTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
        stream = spark.readStream.schema(REQUESTS).parquet(str(tmp_path / "r"))
        got = run.newest(Vs.activity_changes(stream, keep="1 hour"), ("ip", "bucket_epoch"), f"file://{tmp_path}/at")
    assert sorted(r.request_count for r in got.collect()) == [1, 2]


def test_peaks_only_grow(spark, tmp_path):
    from turnmill.streaming import run
    from turnmill.streaming import visits as Vs

    schema = "bucket_epoch long, online long, recorded long"
    for n, online in enumerate((3, 5, 2)):
        spark.createDataFrame([(300, online, n), (300 * (n + 2), 1, n)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
        got = run.newest(Vs.peak_changes(spark.readStream.schema(schema).parquet(str(tmp_path / "r"))), ("bucket_epoch",), f"file://{tmp_path}/at")
    peaks = {r.bucket_epoch: (r.online, r.peak, r.recorded) for r in got.collect()}
    assert peaks[300] == (2, 5, 2) and len(peaks) == 4


def test_guard_groups_of_a_gateway_stay_small(spark, tmp_path):
    """Visitors behind one address, who come in bursts with quiet times between them, are judged burst by burst, as one guard would."""
    import random

    from turnmill.shipping import Working

    rng = random.Random(8)
    limits = V.Limits({n: (6, 60, 120) for n in NAMES}, last_page=10, honeypot=600)
    rows, start = [], 1_700_000_000
    for burst in range(30):
        start += rng.choice([200, 500, 4000])
        for _ in range(20):
            rows.append({"ip": "10.0.0.1" if rng.random() < 0.7 else f"10.0.1.{rng.randrange(5)}", "visitor": str(rng.randrange(12)), "epoch": start + rng.randrange(40), "path": rng.choice(["/", "/search", "/x"]), "agent": rng.choice(["Mozilla", "Mozilla", "Mozilla", "curl/8"])})
    rows.sort(key=lambda r: r["epoch"])
    asked = spark.createDataFrame([(i, r["ip"], r["visitor"], r["epoch"], r["path"], "GET", r["agent"], "same-origin", "fetch", 1) for i, r in enumerate(rows)], "id long, ip string, visitor string, epoch long, path string, method string, agent string, fetch_site string, requested_with string, page int")
    one = V.Guard(limits)
    plain = [one.decide(r["epoch"], r["path"], "GET", r["ip"], r["visitor"], r["agent"], "same-origin", "fetch", 1) for r in rows]
    want = [(d.allowed, d.policy, d.reason, d.status, d.retry_after, d.remaining) for d in plain]
    told = lambda r: (r.allowed, r.policy, r.reason, r.status, r.retry_after, r.remaining)
    assert [told(r) for r in V.guard_requests(asked, limits=limits).orderBy("id").collect()] == want
    assert {d.reason for d in plain} >= {"", "rate_limit", "temporary_block", "automation_client"}
    # a block of 1800 seconds joins bursts; without such each burst is a group, or several
    calm = asked.where("agent = 'Mozilla'")
    judged = calm.select("id", "epoch", V.request_policy(F.col("path"), F.col("method")).alias("policy"), V.identities(F.col("ip"), F.col("visitor")).alias("who"), F.lit("").alias("reason"), F.lit(0).alias("seconds"))
    rooted, _ = V.guard_groups(judged, spark.createDataFrame([], V.STATE), limits, Working(spark, "t"))
    n = rooted.count()
    assert rooted.groupBy("root").count().agg(F.max("count")).first()[0] <= 0.1 * n and n == calm.count()
    # batch by batch, the state of one going into the next
    from turnmill.streaming import visits as Vs

    step, got = Vs.guard_step(limits), []
    for k in range(0, 600, 150):
        got += step(asked.where(f"id >= {k} AND id < {k + 150}"), k // 150, f"file://{tmp_path}").orderBy("id").collect()
    assert [told(r) for r in got] == want


def test_entry_point_survives_a_missing_subpackage(monkeypatch):
    import sys

    import __spark_entry__ as entry

    whole = entry.queries()
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    for name in [m for m in sys.modules if m.startswith("turnmill.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    with pytest.warns(UserWarning, match="left out"):
        left = entry.queries()
    assert left and set(left) <= set(whole) and "turn_search_neighbors" in left and not any(n.startswith("op") and n[2].isdigit() for n in left)


def test_stored_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, size in (("a.txt", 10), ("b.exe", 10), ("c.txt", 40)):
        (tmp_path / "in" / name).write_bytes(b"x" * size)
    got = files.list_objects(spark, str(tmp_path / "in"), ("txt",), 20)
    assert sorted((r.path[-5:], r.accepted) for r in got.collect()) == [("a.txt", True), ("b.exe", False), ("c.txt", False)]
    for n in (3, 5):
        files.backup(spark.range(n), str(tmp_path / "copy"))
    assert spark.read.parquet(str(tmp_path / "copy")).count() == 3


def test_page_window():
    assert St.page_window(95, 99, 10) == {"pages": 10, "page": 10, "offset": 90, "first": 1, "last": 10}


def test_diagraph_sheet():
    text = files.diagraph_sheet("t", [(1, "甲", {"A": "我"}), (2, "乙", {"A": "你", "B": "去"})], [{"column": "A", "mapping": "我：你", "relation": "人称映射"}])
    assert text.startswith(files.BOM) and "row,speaker,A,B" in text and "2,乙,你,去" in text


def test_files_names_and_addresses(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("你好".encode("gb18030"))
    (tmp_path / "b.txt").write_bytes(b"\xef\xbb\xbf" + "再见".encode())
    assert sorted(r.text for r in files.read_text_files(spark, str(tmp_path)).collect()) == ["你好", "再见"]
    assert [files.safe_name(n, ".txt") for n in ("../a b.txt", "", None, "txt", "c:\\x\\y.doc")] == ["a_b.txt", "upload.txt", "upload.txt", "upload.txt", "y.txt"]
    assert files.redact("postgres://u:p@h:5/d?password=x&a=b") == "postgres://u:***@h:5/d?password=***&a=b" and files.redact(None) == "" and files.redact("x") == "x"
