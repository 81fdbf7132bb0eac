"""The logical tables: schemas, and adapters from the plain tables documents, conversations and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicon as L
from ..functions.text import normalize_turn, search_text

_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


ENTRIES = _schema(id=_L, title=_S, content=_S, source=_S, year=_I, category=_S, dataset_name=_S, created_at=_S, import_batch=_S, content_hash=_S, source_url=_S, crawl_source=_S, crawl_date=_S, license_note=_S, audio_file=_S, segment_text=_S, current_segment=_S, prev_segment=_S, next_segment=_S, start_time=_D, end_time=_D, speaker=_S, conversation_id=_S, segment_index=_I, search_text=_S)
TURNS = _schema(id=_L, entry_id=_L, turn_index=_I, speaker_label=_S, turn_text=_S, source=_S, category=_S, dataset_name=_S, conversation_key=_S)
SUBMISSIONS = _schema(id=_L, title=_S, source=_S, category=_S, genre=_S, language=_S, modality=_S, text_content=_S, original_filename=_S, stored_filename=_S, storage_backend=_S, object_key=_S, file_hash=_S, status=_S, admin_note=_S, created_at=_S, reviewed_at=_S, reviewed_by=_S)
VISITORS = _schema(visitor_hash=_S, first_seen_epoch=_L, last_seen_epoch=_L)
IP_ACTIVITY = _schema(ip_address=_S, bucket_epoch=_L, first_seen_epoch=_L, last_seen_epoch=_L, request_count=_L, blocked_count=_L, last_path=_S, last_method=_S, last_status=_I)
SNAPSHOTS = _schema(bucket_epoch=_L, online_visitors=_I, peak_online_visitors=_I, total_visitors=_L, daily_visitors=_L, recorded_at_epoch=_L)

PAIRS = T.StructType([*_schema(id=_L, turn_a_id=_L, turn_b_id=_L, entry_id=_L, conversation_key=_S, turn_index_a=_I, turn_index_b=_I, speaker_a=_S, speaker_b=_S, text_a=_S, text_b=_S, source=_S, category=_S, dataset_name=_S, shared_terms=T.ArrayType(_S), markers=T.ArrayType(_S)), *[T.StructField(f, _I) for f in L.FLAGS.values()]])
STATS = _schema(stat_key=_S, stat_value=_S, updated_at=_S)
SCHEMAS = {"entries": ENTRIES, "turns": TURNS, "pairs": PAIRS, "stats": STATS, "submissions": SUBMISSIONS, "visitors": VISITORS, "ip_activity": IP_ACTIVITY, "snapshots": SNAPSHOTS}

#: Stored sections that the adapter deals out by doc_id, and phrases that stand for turns in Han script.
STORED = tuple(s for s in L.SECTION_ORDER if s != L.ANCIENT)
PHRASES = (
    "你为什么不去学校？", "我不是不去学校，是没时间。", "我觉得可以再试一次", "其实我觉得可以补充一下", "因为昨天下雨了，所以没去", "你能不能明天过来", "明天我可以过来吃饭",
    "如果天气好就一起去公园", "要是天气不好怎么办", "但是公园今天不开门", "我想吃麦当劳", "吃麦当劳没问题，不过要先写作业", "谢谢你的帮助", "谢谢，应该的", "好！当然。", "“好”，真的？",
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order; missing ones are null."""
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def create_tables(spark: SparkSession, folder: str) -> None:
    """Empty tables of all schemas, as Parquet folders; those that are there stay."""
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/{name}")


def columns_of(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, place): the catalogue of some tables."""
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame([(n, c, k) for n, df in tables.items() for k, c in enumerate(df.columns, 1)], "table_name string, column_name string, place int")


def table_facts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows, n_columns, n_files): what tables hold, each counted by itself."""
    out = None
    for name, df in tables.items():
        one = df.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("file").alias("n_files"))
        one = one.select(F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns"), "n_files")
        out = one if out is None else out.unionByName(one)
    return out


def plan_facts(df: DataFrame) -> dict[str, int]:
    """What a physical plan does: scans, shuffles, broadcasts, Python steps, and scans with filters pushed to them."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    count = lambda *names: sum(plan.count(n) for n in names)
    return {"scans": count("FileScan", "Scan ExistingRDD", "LocalTableScan"), "shuffles": count("Exchange hash", "Exchange range", "Exchange Single", "Exchange Round"), "broadcasts": count("BroadcastExchange"), "python_steps": count("MapInPandas", "MapInArrow", "ArrowEvalPython", "FlatMapGroups"), "pushed": plan.count("PushedFilters: [") - plan.count("PushedFilters: []")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(options: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (number % len(options) + 1).cast("int"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    source = pick(STORED, F.col("doc_id"))
    made = d.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("Doc "), F.col("doc_id")).alias("title"), F.col("text").alias("content"), source.alias("source"),
        F.when(source == L.TEXT_DIALOGUE, pick((*L.ANCIENT_CATEGORIES, *L.MODERN_CATEGORIES), F.expr("doc_id div 7"))).otherwise(F.col("lang")).alias("category"),
        (2000 + F.col("doc_id") % 25).cast("int").alias("year"), F.concat_ws("-", "source", "lang").alias("dataset_name"),
        F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("audio/"), F.col("doc_id"), F.lit(".mp3"))).alias("audio_file"), F.col("source").alias("crawl_source"),
    )
    return made


def turn_id(entry_id: Column, turn_index: Column) -> Column:
    """A surrogate key from the total order (entry, turn): no global numbering, so no single-task window."""
    return entry_id * 1_000_000 + turn_index


def turns(spark: SparkSession, sf_dir: str, phrases: bool = False) -> DataFrame:
    """conversations as turns; with phrases, each text is one of PHRASES by (conversation, turn)."""
    c = table(spark, sf_dir, "conversations")
    e = entries(spark, sf_dir).select(F.col("id").alias("e_id"), "source", "category", "dataset_name")
    text = pick(PHRASES, F.col("conv_id") * 31 + F.col("turn") * 7 + F.expr("turn div 2")) if phrases else normalize_turn(F.col("text"))
    return c.join(e, F.col("conv_id") == F.col("e_id"), "left").select(
        turn_id(F.col("conv_id"), F.col("turn") + 1).alias("id"), F.col("conv_id").alias("entry_id"), (F.col("turn") + 1).cast("int").alias("turn_index"), F.col("role").alias("speaker_label"), text.alias("turn_text"),
        F.coalesce("source", F.lit("")).alias("source"), F.coalesce("category", F.lit("")).alias("category"), F.coalesce("dataset_name", F.lit("")).alias("dataset_name"), F.concat(F.lit("entry:"), F.col("conv_id")).alias("conversation_key"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as requests: ip, epoch, path, method, status, blocked. Two addresses share a visitor."""
    return as_requests(table(spark, sf_dir, "events"))


def as_requests(e: DataFrame) -> DataFrame:
    bad = F.col("event_type") == "error"
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("10.0."), F.expr("user_id div 256"), F.lit("."), F.col("user_id") % 256).alias("ip"), F.expr("user_id div 2").cast("string").alias("visitor"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("epoch"), F.concat(F.lit("/"), F.col("event_type")).alias("path"), F.lit("GET").alias("method"), F.when(bad, 403).otherwise(200).alias("status"), bad.cast("int").alias("blocked"),
    )


# ---- the same tables in DuckDB's SQL, as common table expressions ------------------------------------------------------


def _list(options: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{o}'" for o in options) + "]"


_SOURCE = f"({_list(STORED)})[CAST(doc_id % {len(STORED)} AS INTEGER) + 1]"
ENTRIES_SQL = f"""entries AS (SELECT doc_id AS id, 'Doc ' || doc_id AS title, text AS content, {_SOURCE} AS source,
  CASE WHEN {_SOURCE} = '{L.TEXT_DIALOGUE}' THEN ({_list((*L.ANCIENT_CATEGORIES, *L.MODERN_CATEGORIES))})[CAST((doc_id // 7) % 6 AS INTEGER) + 1] ELSE lang END AS category,
  CAST(2000 + doc_id % 25 AS INTEGER) AS year, source || '-' || lang AS dataset_name, CASE WHEN doc_id % 10 = 0 THEN 'audio/' || doc_id || '.mp3' END AS audio_file, source AS crawl_source FROM documents)"""


def turns_sql(phrases: bool = False) -> str:
    text = f"({_list(PHRASES)})[CAST((c.conv_id * 31 + c.turn * 7 + c.turn // 2) % {len(PHRASES)} AS INTEGER) + 1]" if phrases else r"trim(regexp_replace(c.text, '\s+', ' ', 'g'))"
    return f"""{ENTRIES_SQL}, turns AS (SELECT c.conv_id * 1000000 + c.turn + 1 AS id, c.conv_id AS entry_id, CAST(c.turn + 1 AS INTEGER) AS turn_index, c.role AS speaker_label, {text} AS turn_text,
  coalesce(e.source, '') AS source, coalesce(e.category, '') AS category, coalesce(e.dataset_name, '') AS dataset_name, 'entry:' || c.conv_id AS conversation_key
  FROM conversations c LEFT JOIN entries e ON e.id = c.conv_id)"""


REQUESTS_SQL = """requests AS (SELECT event_id AS id, '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS ip, CAST(user_id // 2 AS VARCHAR) AS visitor, CAST(floor(epoch(ts)) AS BIGINT) AS epoch,
  '/' || event_type AS path, 'GET' AS method, CASE WHEN event_type = 'error' THEN 403 ELSE 200 END AS status, CAST(event_type = 'error' AS INTEGER) AS blocked FROM events)"""
