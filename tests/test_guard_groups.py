"""The guard's groups: many small ones, and large ones that are taken apart by sessions."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from turnmill.operators import visits as V
from turnmill.shipping import Working

LIMITS = V.Limits({n: (3, 60, 120) for n in V.guard.POLICIES})


def test_small_groups_share_batches():
    n = 5000
    cells = {"root": [f"ip:{k:05}" for k in range(n)], "id": list(range(n)), "ip": [f"{k:05}" for k in range(n)], "epoch": [7] * n, "path": ["/"] * n, "policy": ["general"] * n, "refused_policy": [None] * n, "reason": [""] * n, "seconds": [0] * n, "one": [f"ip:{k:05}" for k in range(n)]}
    nothing = {c: pa.nulls(n, kind) for c, kind in (("two", pa.string()), ("identity", pa.string()), ("until", pa.float64()), ("logs", pa.map_(pa.string(), pa.list_(pa.float64()))))}
    made = list(V._decide(iter([pa.RecordBatch.from_pydict({c: pa.array(x) if c != "refused_policy" else pa.nulls(n, pa.string()) for c, x in cells.items()} | nothing)]), LIMITS, True))
    assert [b.num_rows for b in made] == [n, n - 1, 1]  # the last group ends with the rows
    assert made[0].column("allowed").to_pylist() == [True] * n and made[1].column("alive").to_pylist() == [67.0] * (n - 1)


@pytest.mark.parametrize("whole", [0, 90, 10_000])
def test_groups_of_any_size_give_the_same(spark, whole):
    rng = random.Random(3)
    rows = []
    for burst in range(12):
        for _ in range(25):
            k = rng.randrange(40)
            rows.append((len(rows), "10.9.9.9" if k < 15 else f"10.0.0.{k}" if k < 38 else None, str(k // 3) if k % 7 else None, 1_700_000_000 + burst * 500 + rng.randrange(40), "/x"))
    rows.sort(key=lambda r: (r[3], r[0]))
    asked = spark.createDataFrame(rows, "id long, ip string, visitor string, epoch long, path string")
    one = V.Guard(LIMITS)
    want = {r[0]: (d.allowed, d.reason, d.retry_after, d.remaining) for r in rows for d in [one.decide(r[3], "/x", "GET", r[1] or "", r[2] or "")]}
    told = lambda df: {r.id: (r.allowed, r.reason, r.retry_after, r.remaining) for r in df.collect()}
    assert told(V.guard_requests(asked, limits=LIMITS, whole=whole)) == want
    # in two batches, the state of the first going into the second
    cut = rows[130][3]
    first, state = V.guard_step(asked.where(F.col("epoch") < cut), None, LIMITS, Working(spark, "guard"), whole=whole)
    second, _ = V.guard_step(asked.where(F.col("epoch") >= cut), state, LIMITS, Working(spark, "guard"), whole=whole)
    assert told(first) | told(second) == want


def test_cells_are_read_by_column_and_not_one_by_one():
    import pyarrow as pa

    from turnmill.operators import visits

    logs = pa.map_(pa.string(), pa.list_(pa.float64()))
    columns = [pa.nulls(3, logs), pa.nulls(3, pa.string()), pa.array([1, None, 3]), pa.array([1, 2, 3]), pa.array(["a", "", "ß"]), pa.array([{"a": [1.0]}, None, {}], logs), pa.array([], pa.string()), pa.array(["x", "y", "z"]).slice(1)]
    assert [visits._cells(c) for c in columns] == [c.to_pylist() for c in columns]
