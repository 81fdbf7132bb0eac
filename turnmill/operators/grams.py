"""A stored index of runs of three characters, and searches that it answers.

`postings` has a row for each gram and entry, in folders by batch and by a hash of the gram, sorted by gram; a search reads the folders
of the grams that it asks for, and of these files the parts that may hold them. A later batch adds the postings of new and changed
entries; `gone` notes for these, and for deleted ones, up to which batch their postings are void. A batch counts once its folder in
`batches` is there, which is written last, so one that failed halfway is as if it had never been."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import gramplan, regexplan
from ..functions.gramplan import All, Formula
from .search import FTS_COLUMNS, SearchFilters, _text, entry_condition, fts_condition

_POSTINGS, _GONE, _BATCHES = "gram string, id long, batch int, part int", "id long, batch int", "n long, batch int"
#: Grams asked for in one search; flags of so many fit in one number.
MOST_GRAMS = 60


def fold(text: Column) -> Column:
    low = F.lower(F.replace(text, F.lit("İ"), F.lit("i")))
    return F.upper(F.translate(low, "ẞ", "ß"))  # changes nothing, but upper(lower(x)) would be taken for upper(x)


def grams_of(entries: DataFrame) -> DataFrame:
    """(gram, id) of the indexed columns of each entry."""
    text = fold(F.concat_ws("\n", *[_text(entries, n) for n in FTS_COLUMNS]))
    n = gramplan.GRAM
    # texts are dealt out anew, as a file's row group may hold them all; characters by place, as substr would walk to each from the beginning
    chars = entries.select("id", text.alias("t")).where(F.length("t") >= n).repartition("id").select("id", F.split("t", "").alias("c"))
    every = F.transform(F.sequence(F.lit(0), F.size("c") - n), lambda i: F.concat(*[F.get("c", i + k) for k in range(n)]))
    return chars.select(F.explode(F.array_distinct(every)).alias("gram"), "id")


class GramIndex:
    def __init__(self, spark: SparkSession, at: str, parts: int = 64):
        self.spark, self.at, self.parts = spark, at, parts

    def _read(self, name: str, schema: str) -> DataFrame:
        """The rows of a table; none before its first batch."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}")
        there = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
        return self.spark.read.schema(schema).parquet(f"{self.at}/{name}") if there else self.spark.createDataFrame([], schema)

    def batches(self) -> list[int]:
        """The batches that count."""
        return sorted(r["batch"] for r in self._read("batches", _BATCHES).select("batch").distinct().collect())

    def put(self, entries: DataFrame, batch: int | None = None, deleted: DataFrame | None = None) -> int:
        """Add entries, those of ids that are there already in their place, and delete (id). A batch that is repeated under its
        number replaces itself."""
        done = self.batches()
        batch = (done[-1] + 1 if done else 0) if batch is None else batch
        part = F.pmod(F.xxhash64("gram"), F.lit(self.parts)).cast("int")
        # ranges would make all grams twice, once for their bounds; a part too large for a task is cut
        rows = grams_of(entries).withColumn("part", part).hint("rebalance", "part").sortWithinPartitions("part", "gram", "id")
        rows.write.mode("overwrite").partitionBy("part").parquet(f"{self.at}/postings/batch={batch}")
        gone = entries.select("id")
        if deleted is not None:
            gone = gone.unionByName(deleted.select("id"))
        if batch:
            gone.distinct().write.mode("overwrite").parquet(f"{self.at}/gone/batch={batch}")
        self.spark.range(1).select(F.col("id").alias("n")).write.mode("overwrite").parquet(f"{self.at}/batches/batch={batch}")
        return batch

    def delete(self, ids: DataFrame) -> int:
        return self.put(self.spark.createDataFrame([], "id long, title string, content string"), deleted=ids)

    def postings(self, grams: list[str]) -> DataFrame:
        """(gram, id) that count, of these grams."""
        done = self.batches()
        parts = self.spark.createDataFrame([(g,) for g in grams], "gram string").select(F.pmod(F.xxhash64("gram"), F.lit(self.parts)).alias("part")).distinct()
        own = [r["part"] for r in parts.collect()]
        rows = self._read("postings", _POSTINGS).where(F.col("batch").isin(done) & F.col("part").isin(own) & F.col("gram").isin(grams))
        if len(done) < 2:
            return rows.select("gram", "id")
        gone = self._read("gone", _GONE).where(F.col("batch").isin(done)).groupBy("id").agg(F.max("batch").alias("since"))
        return rows.join(gone, "id", "left").where(F.col("since").isNull() | (F.col("batch") >= F.col("since"))).select("gram", "id")

    def candidates(self, asked: Formula) -> DataFrame | None:
        """Ids of the entries whose grams satisfy the formula; None if it says nothing."""
        wanted = gramplan.grams(asked)
        if not wanted or len(wanted) > MOST_GRAMS:
            return None
        bit = F.lit(0).cast("long")
        for k, g in enumerate(wanted):
            bit = F.when(F.col("gram") == g, F.lit(1 << k).cast("long")).otherwise(bit)
        found = self.postings(wanted).groupBy("id").agg(F.bit_or(bit).alias("bits"))

        def test(f: Formula) -> Column:
            if isinstance(f, str):
                return F.col("bits").bitwiseAND(1 << wanted.index(f)) != 0
            out = None
            for p in f.parts:
                out = test(p) if out is None else (out & test(p) if isinstance(f, All) else out | test(p))
            return F.lit(True) if out is None else out

        return found.where(test(asked)).select("id")

    def compact(self, to: str) -> GramIndex:
        """The same index in a new folder, as one batch without void postings."""
        new, done = GramIndex(self.spark, to, self.parts), self.batches()
        rows = self._read("postings", _POSTINGS).where(F.col("batch").isin(done))
        gone = self._read("gone", _GONE).where(F.col("batch").isin(done)).groupBy("id").agg(F.max("batch").alias("since"))
        kept = rows.join(gone, "id", "left").where(F.col("since").isNull() | (F.col("batch") >= F.col("since"))).select("gram", "id", "part")
        kept.repartitionByRange("part", "gram", "id").sortWithinPartitions("part", "gram", "id").write.partitionBy("part").parquet(f"{to}/postings/batch=0")
        self.spark.range(1).select(F.col("id").alias("n")).write.parquet(f"{to}/batches/batch=0")
        return new


def _among(entries: DataFrame, ids: DataFrame | None) -> DataFrame:
    return entries if ids is None else entries.join(ids, "id", "left_semi")


def search_phrase(entries: DataFrame, index: GramIndex, phrase: str) -> DataFrame:
    """Entries that hold the phrase in an indexed column, ignoring case. One of fewer than three characters is looked for everywhere."""
    return _among(entries, index.candidates(gramplan.phrase(phrase))).where(fts_condition(entries, phrase))


def search_pattern(entries: DataFrame, index: GramIndex, pattern: str, field: str = "content") -> DataFrame:
    """Entries in whose field the regular expression matches, ignoring case; none for a pattern that is refused. One that asks for no
    grams is looked for everywhere."""
    f = SearchFilters(pattern, mode="regex", field=field)
    asked = gramplan.TRUE if regexplan.error(pattern) else gramplan.formula(pattern)
    return _among(entries, index.candidates(asked)).where(entry_condition(entries, f))
