"""Nothing that grows goes through the driver."""

import numpy as np
from pyspark.sql import functions as F

from palimpsest.llm import ann


def test_copies_of_query_blocks_are_not_broadcast(spark, monkeypatch):
    """Spark takes exploded rows for as small as the rows they come from: below its limit all copies were broadcast."""
    monkeypatch.setattr(ann, "ROWS", 4)
    monkeypatch.setattr(ann, "BLOCKS_A_GROUP", 2)
    v = np.random.default_rng(7).normal(size=(60, 3)).astype(np.float32)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    found = ann.nearest(table, F.col("vec_id") % 5 == 0, 4)
    got = {(x.query_id, x.rank): x.vec_id for x in found.collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    full = v.astype(np.float64) @ v.astype(np.float64).T
    for q in range(0, 60, 5):
        best = sorted((-full[q, i], i) for i in range(60) if i != q)[:4]
        assert [got[q, k + 1] for k in range(4)] == [i for _, i in best]
    assert len(got) == 48
