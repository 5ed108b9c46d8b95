"""Packing along a space-filling curve.

Each text's ids give a hashed vector (one pseudo-random direction an id) that is projected to DIMENSIONS numbers.
The numbers are standardised over the corpus, cut into 2**BITS cells a dimension, and turned into a Hilbert key.
Documents are range-sorted by that key and laid end to end, so that neighbours on the curve share sequences.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import discard, pick, staged
from .textbytes import blocks, mix
from .tokens import SLOT_BITS, tokenizer, vocabulary, with_end

DIMENSIONS, BITS = 4, 12
RUN_BYTES, MOST_RUNS, PART_IDS = 16 << 20, 50_000, 2048


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of cells (rows x dimensions, each below 2**bits)."""
    x = cells.astype(np.int64).T.copy()
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), top
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def directions(size: int) -> np.ndarray:
    """A fixed pseudo-random direction for every id."""
    bits = mix(np.arange(1, size * DIMENSIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return ((bits >> np.uint64(11)).astype(float) / 2**53 * 2 - 1).reshape(size, DIMENSIONS)


_TOKENISED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("at", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType()), T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType())])


def _tokenise(vocab: str, end_id: int, memo_bits: int):
    def run(batches):
        coder = tokenizer(vocabulary(vocab), memo_bits)  # where this worker has it
        size = max(coder.library.get_vocab_size(), end_id + 1)
        axes = directions(size)
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column("text")):
                ids, sizes = with_end(*coder.encode(data, offsets), end_id)
                ends, raw, wide = np.cumsum(sizes), ids.tobytes(), ids.itemsize
                sums = np.add.reduceat(axes[ids], ends - sizes, axis=0) / np.sqrt(sizes)[:, None]
                # a long document goes in several rows, so that rows weigh about the same in the sort
                parts = -(-sizes // PART_IDS)
                doc = np.repeat(np.arange(b - a), parts)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * PART_IDS
                low = (ends - sizes)[doc] + start
                high = np.minimum(low + PART_IDS, ends[doc])
                cuts = [raw[wide * x : wide * y] for x, y in zip(low.tolist(), high.tolist(), strict=True)]
                at = pa.ListArray.from_arrays(pa.array(np.arange(len(doc) + 1) * DIMENSIONS, pa.int32()), pa.array(sums[doc].reshape(-1)))
                keys = batch.column("doc_id").slice(a, b - a).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([keys, at, pa.array(sizes[doc], pa.int64()), pa.array(start, pa.int64()), pa.array(cuts, pa.binary())], ["doc_id", "at", "n", "start", "ids"])

    return run


def _keys(mean: list[float], spread: list[float]):
    @F.arrow_udf(T.LongType())
    def key(at: pa.Array) -> pa.Array:
        z = (np.asarray(at.flatten()).reshape(-1, DIMENSIONS) - np.array(mean)) / np.array(spread)
        cells = np.clip(((z / 8 + 0.5) * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
        return pa.array(hilbert_key(cells, BITS))

    return key


_PIECES = "part int, doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, local bigint, offset bigint"


def _lay(dtype: str, most: int):
    """Cuts the run of a partition's ids every ``most``; what is left at its end goes to sequences whose lengths
    are powers of two, so that nothing is padded."""

    def run(batches):
        part, at, held, used = TaskContext.get().partitionId(), 0, [], 0

        def close(pieces, local):
            return [(part, d, s, len(x) // 4, zlib.crc32(x), n, local, o) for d, s, x, n, o in pieces]

        names = ["part", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "local", "offset"]

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int32() if k == 0 else pa.int64()) for k in range(8)], names)

        for batch in batches:
            rows = []
            for doc_id, n, base, ids in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), batch.column("start").to_pylist(), batch.column("ids"), strict=True):
                raw, start = np.frombuffer(ids.as_buffer(), dtype).astype("<u4").tobytes(), 0
                while 4 * start < len(raw):
                    take = min(len(raw) // 4 - start, most - used)
                    held.append((doc_id, base + start, raw[4 * start : 4 * (start + take)], n, used))
                    start, used = start + take, used + take
                    if used == most:
                        rows += close(held, at)
                        at, held, used = at + 1, [], 0
            if rows:
                yield table(rows)
        rows, left = [], used
        while left:
            room, filled, pieces = 1 << (left.bit_length() - 1), 0, []
            while filled < room:
                doc_id, start, raw, n, _ = held.pop(0)
                take = min(len(raw) // 4, room - filled)
                pieces.append((doc_id, start, raw[: 4 * take], n, filled))
                if 4 * take < len(raw):
                    held.insert(0, (doc_id, start + take, raw[4 * take :], n, 0))
                filled += take
            rows += close(pieces, at)
            at, left = at + 1, left - room
        if rows:
            yield table(rows)

    return run


def pack_along_curve(docs: DataFrame, *, most: int = 2048, vocab: str = "word_bpe_49k.json", end_id: int = 1, memo_bits: int = SLOT_BITS) -> DataFrame:
    """Pieces of every document in sequences of at most ``most`` ids: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. Null or empty text: the end id alone. Repeated rows are separate documents; a null doc_id
    stays null. Ties on the curve go by doc_id, then by place. A document of more than PART_IDS ids is cut there too. Each of the sorted runs (RUN_BYTES of ids)
    ends in at most eleven short sequences. memo_bits: slots of each worker's memo of segments, which it keeps after
    the task; the ids don't depend on it. No rows: no pieces."""
    spark = docs.sparkSession
    coder = tokenizer(vocabulary(vocab), memo_bits)
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids, ids_path = staged(rows.mapInArrow(_tokenise(vocab, end_id, memo_bits), _TOKENISED), "packing-ids")
    axis = [F.col("at")[k] for k in range(DIMENSIONS)]
    first = F.col("start") == 0
    stats = ids.agg(*[F.avg(F.when(first, a)) for a in axis], *[F.stddev_pop(F.when(first, a)) for a in axis], F.sum(F.octet_length("ids"))).first()
    mean = [x or 0.0 for x in stats[:DIMENSIONS]]
    spread = [x or 1.0 for x in stats[DIMENSIONS : 2 * DIMENSIONS]]
    # as many runs as the ids need, so that a task's share stays the same as the input grows
    total = stats[2 * DIMENSIONS] or 0
    runs = max(1, -(-total // max(RUN_BYTES, total // MOST_RUNS)))
    keyed = ids.select(_keys(mean, spread)("at").alias("key"), "doc_id", "n", "start", "ids")
    ordered = keyed.repartitionByRange(runs, "key", "doc_id", "start", F.xxhash64("ids")).sortWithinPartitions("key", "doc_id", "start", "ids")
    pieces, _ = staged(ordered.mapInArrow(_lay(np.dtype(coder.dtype).str, most), _PIECES), "packing-pieces")
    discard(spark, ids_path)
    parts = pieces.groupBy("part").agg((F.max("local") + 1).alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    out = pieces.join(F.broadcast(parts), "part")  # one row a partition of the sort
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("local")).alias("sequence_id"), "offset")
