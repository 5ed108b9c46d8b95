"""What the pipeline's executors keep: Arrow batches, Python workers, the memo of token segments."""

import numpy as np
import pyarrow as pa

from palimpsest.llm import frames, queries, tokens
from palimpsest.llm.textbytes import blocks

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_are_bounded_by_bytes(spark):
    before = spark.conf.get(NAME)
    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('some text ', 1000) AS text")  # 30 MB

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], ["bytes", "n"])

    try:
        frames.bound_batches(spark)
        seen = docs.mapInArrow(sizes, "bytes long, n long").collect()
        assert sum(r.n for r in seen) == 3000 and max(r.bytes for r in seen) < 1.1 * frames.BATCH_BYTES
        spark.conf.set(NAME, "1m")  # a lower bound stays
        frames.bound_batches(spark)
        assert spark.conf.get(NAME) in ("1m", str(1 << 20), f"{1 << 20}b")
    finally:
        spark.conf.set(NAME, before)


def test_weights_need_no_python_worker(spark):
    weights = queries.source_weights(spark)
    assert [tuple(r) for r in weights.collect()] == queries.SOURCE_WEIGHTS
    assert weights.dtypes == [("path", "string"), ("weight", "bigint")]
    assert "LocalTableScan" in weights._jdf.queryExecution().executedPlan().toString()


def test_small_memo_gives_the_same_ids():
    texts = [f"word{k % 40} and number {k * k}, {chr(0xE9) * (k % 5)}\nline {k}" for k in range(400)]
    small, usual = (tokens.SegmentTokenizer(tokens.vocabulary("word_bpe_49k.json"), bits) for bits in (6, tokens.SLOT_BITS))
    for _, _, data, offsets in blocks(pa.array(texts), 2000):
        for x, y in zip(small.encode(data, offsets), usual.encode(data, offsets), strict=True):
            assert np.array_equal(x, y)
    assert small.known < usual.known and len(small.entry) == 64
