"""The language model's work on a token: words stay in Arrow, numbers of all lanes lie side by side, a shard is a task."""

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from test_text_llm import SMALL

from turnmill.llm import language_model

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_are_looked_up_in_arrow():
    texts = ["One b one", "", " \t\n", "straße Ünde a b \U0001f600 x\U0001f600é", "ONE ünde z"]
    words, which, at = language_model.tokens_of(pa.array(texts, pa.large_string()))
    assert isinstance(words, pa.Array) and words[-1].as_py() == "" and len(set(words.to_pylist())) == len(words)
    lower = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in texts]
    assert [[words[i].as_py() for i in which[a:b]] for a, b in zip(at[:-1], at[1:])] == [[*WORD.findall(t), ""] for t in lower]
    v = language_model.Vocabulary(["", "one", "straße"], [5, 3, 1], SMALL)
    want = [v.place.get(w, 3 + zlib.crc32(w[-2:].encode()) % SMALL.endings) for w in words.to_pylist()]
    assert v.ids(words).tolist() == want


def test_numbers_of_all_lanes_lie_side_by_side():
    v = language_model.Vocabulary([f"w{i}" for i in range(29)] + [""], list(range(40, 10, -1)), SMALL)
    net = language_model.Network(v, np.ones(v.size))
    x, h = net.p["in"][np.arange(7)], np.random.default_rng(0).standard_normal((7, SMALL.state)).astype(np.float32)
    assert all(a.shape == (7, SMALL.state) and a.T.flags.c_contiguous for a in net.step(x, h))
    assert net.gradients(h, np.arange(7), net.views(np.zeros(net.n, np.float32))).T.flags.c_contiguous


def test_each_shard_is_a_task(spark):
    rows = spark.range(4000).select((F.col("id") % 40).alias("shard"), F.xxhash64("id").alias("h"), F.col("id").cast("string").alias("text"))
    held = lambda n: [r["s"] for r in language_model.by_shard(rows, n).groupBy(F.spark_partition_id()).agg(F.sort_array(F.collect_set("shard")).alias("s")).collect()]
    assert sorted(held(40)) == [[k] for k in range(40)]
    assert sorted(held(16)) == [[k for k in range(40) if k % 16 == p] for p in range(16)]
