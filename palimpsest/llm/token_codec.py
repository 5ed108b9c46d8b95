"""Token-id files: range asymmetric numeral system (rANS) coding with static frequency tables.

Layout of a dataset folder (both parts are Parquet files that Spark's committer writes, so that a lost executor
leaves no half-written block):

* ``tables``: the shared frequency table, one row (precision, freq as little-endian u32 per id, crc32).
* ``blocks``: independent blocks (part, block, n_ids, doc_ids, doc_sizes, frame).

A frame is ``<IIIII`` (magic, table crc32, ids, segments, crc32 of the body), then per segment a checkpoint
``<IIII`` (first id, ids, first word, crc32 of its ids as u32) and LANES final states (u64), then the words (u32).
Each segment interleaves LANES coders (id i belongs to lane i mod LANES) and can be decoded alone from its
checkpoint; a block's segments are coded and decoded together, lane by lane.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import discard, pick, shared_root, staged
from .textbytes import blocks
from .tokens import tokenizer, vocabulary, with_end

MAGIC = 0x534E4152
PRECISION = 20
LANES = 128
SEGMENT_IDS = 32_768
BLOCK_IDS = 262_144
_HEAD, _POINT = struct.Struct("<IIIII"), struct.Struct("<IIII")
_U = np.uint64
_LOW = _U(1 << 31)


def frequency_table(counts: np.ndarray, precision: int = PRECISION) -> np.ndarray:
    """Frequencies that sum to 2**precision, at least 1 where an id occurs; all zero if none does."""
    counts = np.asarray(counts, np.float64)
    total, size = counts.sum(), 1 << precision
    if not total:
        return np.zeros(len(counts), np.uint32)
    seen = counts > 0
    assert seen.sum() <= size, "more distinct ids than the precision can hold"
    freq = np.where(seen, np.maximum(1, np.floor(counts / total * size)), 0).astype(np.int64)
    order = np.argsort(-counts, kind="stable")[: int(seen.sum())]
    spare = size - int(freq.sum())
    while spare:
        if spare > 0:
            freq[order[0]] += spare
            spare = 0
        else:
            take = np.minimum(freq[order] - 1, np.maximum(1, freq[order] * -spare // size))
            take = np.minimum(take, np.maximum(0, -spare - (np.cumsum(take) - take)))
            freq[order] -= take
            spare += int(take.sum())
    return freq.astype(np.uint32)


class Coder:
    def __init__(self, freq: np.ndarray, precision: int = PRECISION) -> None:
        self.precision, self.freq = precision, freq.astype(_U)
        self.below = np.cumsum(self.freq, dtype=_U) - self.freq
        self.table_crc = zlib.crc32(freq.astype("<u4").tobytes())
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))

    def encode(self, ids: np.ndarray) -> bytes:
        n = len(ids)
        segments = max(1, -(-n // SEGMENT_IDS))
        steps = min(SEGMENT_IDS, max(n, 1)) + LANES - 1
        steps //= LANES
        padded = np.zeros((segments, steps * LANES), np.int64)
        held = np.zeros((segments, steps * LANES), bool)
        for k in range(segments):
            part = ids[k * SEGMENT_IDS : (k + 1) * SEGMENT_IDS]
            padded[k, : len(part)], held[k, : len(part)] = part, True
        padded, held = padded.reshape(segments, steps, LANES), held.reshape(segments, steps, LANES)
        state = np.full((segments, LANES), _LOW, _U)
        words, owner, shift = [], [], _U(self.precision)
        for t in range(steps - 1, -1, -1):
            live, symbol = held[:, t], padded[:, t]
            f = np.where(live, self.freq[symbol], _U(1))
            out = live & (state >= f << _U(63 - self.precision))
            seg, _ = np.nonzero(out)
            words.append((state[out] & _U(0xFFFFFFFF)).astype("<u4"))
            owner.append(seg)
            state[out] >>= _U(32)
            q = state // f
            state = np.where(live, (q << shift) + (state - q * f) + self.below[symbol], state)
        words, owner = np.concatenate(words[::-1]), np.concatenate(owner[::-1])
        words = words[np.argsort(owner, kind="stable")]
        first = np.searchsorted(np.sort(owner), np.arange(segments))
        body = [
            _POINT.pack(k * SEGMENT_IDS, len(part := ids[k * SEGMENT_IDS : (k + 1) * SEGMENT_IDS]), int(first[k]), zlib.crc32(part.astype("<u4").tobytes())) + state[k].astype("<u8").tobytes()
            for k in range(segments)
        ]
        body = b"".join(body) + words.tobytes()
        return _HEAD.pack(MAGIC, self.table_crc, n, segments, zlib.crc32(body)) + body

    def decode(self, frame: bytes, only: int | None = None) -> np.ndarray:
        """The ids of a frame, or those of its segment ``only``. ValueError if any checksum fails."""
        magic, table, n, segments, crc = _HEAD.unpack_from(frame)
        if magic != MAGIC or table != self.table_crc or zlib.crc32(memoryview(frame)[_HEAD.size :]) != crc:
            raise ValueError("the frame is damaged or belongs to another table")
        size, at = _POINT.size + 8 * LANES, _HEAD.size
        points = [_POINT.unpack_from(frame, at + k * size) for k in range(segments)]
        states = [np.frombuffer(frame, "<u8", LANES, at + k * size + _POINT.size) for k in range(segments)]
        words = np.frombuffer(frame, "<u4", offset=at + segments * size)
        picked = range(segments) if only is None else [only]
        state = np.array([states[k] for k in picked], _U)
        counts = np.array([points[k][1] for k in picked])
        cursor = np.array([points[k][2] for k in picked], np.int64)
        steps = int(-(-counts.max() // LANES)) if len(counts) else 0
        out = np.zeros((len(counts), steps, LANES), np.uint32)
        mask, shift = _U((1 << self.precision) - 1), _U(self.precision)
        held = (np.arange(steps * LANES).reshape(steps, 1, LANES) < counts[None, :, None]) if steps else None
        for t in range(steps):
            live = held[t]
            slot = state & mask
            symbol = self.symbol[slot] if n else slot
            out[:, t] = symbol
            moved = self.freq[symbol] * (state >> shift) + slot - self.below[symbol]
            short = live & (moved < _LOW)
            rank = np.cumsum(short, axis=1)
            word = words[np.minimum(cursor[:, None] + rank - 1, len(words) - 1).clip(0)] if len(words) else np.zeros(short.shape, np.uint32)
            state = np.where(live, np.where(short, (moved << _U(32)) | word, moved), state)
            cursor += rank[:, -1]
        ids = []
        for row, k in enumerate(picked):
            part = out[row].reshape(-1)[: counts[row]]
            if zlib.crc32(part.astype("<u4").tobytes()) != points[k][3] or (state[row] != _LOW).any():
                raise ValueError(f"segment {k} is damaged")
            ids.append(part)
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32)


_RAW = "part int, block int, doc_ids binary, known binary, doc_sizes binary, ids binary"


def _raw_blocks(vocab: str, end_id: int):
    """Tokenises sorted texts into blocks of whole documents, about BLOCK_IDS ids each."""

    def run(batches):
        part, block, held, size = TaskContext.get().partitionId(), 0, [], 0
        coder = tokenizer(vocabulary(vocab))  # where this worker has it

        def flush():
            keys, known, sizes, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            row = [[part], [block], [keys.tobytes()], [known.tobytes()], [sizes.tobytes()], [ids.astype("<u4").tobytes() if coder.dtype != np.uint16 else ids.astype("<u2").tobytes()]]
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["part", "block", "doc_ids", "known", "doc_sizes", "ids"])

        for batch in batches:
            doc_id = batch.column("doc_id")
            known = np.asarray(doc_id.is_valid())
            key = np.asarray(doc_id.fill_null(0), np.int64)
            for a, b, data, offsets in blocks(batch.column("text"), 400_000):
                ids, sizes = with_end(*coder.encode(data, offsets), end_id)
                held.append((key[a:b], known[a:b], sizes.astype("<i8"), ids))
                size += len(ids)
                if size >= BLOCK_IDS:
                    yield flush()
                    block, held, size = block + 1, [], 0
        if held:
            yield flush()

    return run


def _count(width: int, size: int):
    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                total += np.bincount(np.frombuffer(ids.as_buffer(), f"<u{width}"), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], ["id", "n"])

    return run


def write_token_file(docs: DataFrame, path: str, *, vocab: str = "byte_bpe_50k.json", end_id: int = 2) -> None:
    """Writes the ids of every whole text, end_id after each document, in ascending doc_id order (null ids first,
    ties by a hash of the text, then text). Null text: the end id alone. Repeated rows are separate documents. No rows: no blocks."""
    spark = docs.sparkSession
    coder = tokenizer(vocabulary(vocab))
    size, width = max(coder.library.get_vocab_size(), end_id + 1), np.dtype(coder.dtype).itemsize
    ordered = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # a doc_id that many rows repeat spreads over several tasks by the hash
    ordered = ordered.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    raw, raw_path = staged(ordered.select("doc_id", "text").mapInArrow(_raw_blocks(vocab, end_id), _RAW), "token-ids", **{"parquet.block.size": str(8 << 20)})
    counted = raw.select("ids").mapInArrow(_count(width, size), "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(size, np.int64)
    for row in counted.collect():  # at most one row an id of the vocabulary
        counts[row["id"]] = row["n"]
    freq = frequency_table(counts)
    table = spark.createDataFrame([(PRECISION, freq.astype("<u4").tobytes(), zlib.crc32(freq.astype("<u4").tobytes()))], "precision int, freq binary, crc32 long")
    table.coalesce(1).write.parquet(f"{path}/tables")

    def encode(batches):
        own = Coder(freq)
        for batch in batches:
            for k in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[k].as_buffer(), f"<u{width}")
                rest = batch.slice(k, 1).select(["part", "block", "doc_ids", "known", "doc_sizes"])
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array([len(ids)], pa.int64()), pa.array([own.encode(ids)], pa.binary())], ["part", "block", "doc_ids", "known", "doc_sizes", "n_ids", "frame"])

    out = raw.mapInArrow(encode, "part int, block int, doc_ids binary, known binary, doc_sizes binary, n_ids bigint, frame binary")
    out.write.options(compression="zstd", **{"parquet.block.size": str(8 << 20)}).parquet(f"{path}/blocks")
    discard(spark, raw_path)


def _table(spark: SparkSession, path: str) -> np.ndarray:
    row = spark.read.parquet(f"{path}/tables").collect()[0]
    if zlib.crc32(bytes(row["freq"])) != row["crc32"]:
        raise ValueError("the frequency table is damaged")
    return np.frombuffer(bytes(row["freq"]), "<u4")


def read_token_file(spark: SparkSession, path: str, *, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids as little-endian u32, if asked) of every document of a file."""
    freq = _table(spark, path)
    stored = spark.read.parquet(f"{path}/blocks")
    parts = stored.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part"))
    order = Window.partitionBy("part").orderBy("block")
    starts = stored.select("part", "block", (F.sum("n_ids").over(order) - F.col("n_ids")).alias("before_block"))
    starts = starts.join(parts, "part").select("part", "block", (F.col("before_part") + F.col("before_block")).alias("first"))

    def decode(batches):
        own = Coder(freq)
        for batch in batches:
            for k in range(batch.num_rows):
                keys, known, sizes = (np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in (("doc_ids", "<i8"), ("known", bool), ("doc_sizes", "<i8")))
                ids = own.decode(batch.column("frame")[k].as_buffer().to_pybytes()).astype("<u4")
                ends, raw = np.cumsum(sizes), ids.tobytes()
                cuts = [raw[4 * a : 4 * b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                n = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column("part")[k].as_py()] * n, pa.int32()),
                        pa.array([batch.column("block")[k].as_py()] * n, pa.int32()),
                        pa.array(keys, pa.int64(), mask=~known),
                        pa.array(ends - sizes, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array([zlib.crc32(x) for x in cuts], pa.int64()),
                        pa.array(cuts if with_ids else [None] * n, pa.binary()),
                    ],
                    ["part", "block", "doc_id", "inside", "n_tokens", "ids_crc32", "ids"],
                )

    rows = stored.mapInArrow(decode, "part int, block int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
    rows = rows.join(starts, ["part", "block"])
    kept = ["ids"] if with_ids else []
    return rows.select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *kept)


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Writes the token file of docs to the shared folder and reads it back."""
    import uuid

    path = f"{shared_root(docs.sparkSession)}/token-file-{uuid.uuid4().hex}"
    write_token_file(docs, path, **options)
    return read_token_file(docs.sparkSession, path, with_ids=False)
