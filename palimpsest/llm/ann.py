"""Exact nearest neighbours by inner product, as a block matrix join.

Vectors are quantised to int8 with one scale each. Query blocks meet candidate blocks; a tile's int8 product,
exact in float arithmetic, gives every inner product within a proven error bound. Only pairs whose upper bound
reaches the query's k-th best lower bound in the tile, and its k-th best score of the tiles before, are recomputed in
double precision from the original vectors. A task keeps each query's k best of its tiles as a bounded heap (a sorted
array of k), and a ranking by query merges the tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import pick, staged

ROWS, QUERIES_AT_ONCE, HELD, BLOCKS_A_GROUP = 2048, 256, 32, 8


def normal(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows scaled exactly by powers of two so that their largest component is in [0.5, 1), the powers)."""
    power = np.frexp(np.abs(x).max(axis=1))[1]
    return np.ldexp(x, -power[:, None]), power


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale of each row, Euclidean norm of each row's error) of rows that normal() gives."""
    scale = np.maximum(np.abs(x).max(axis=1), 0.5) / 127.0
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale, np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-12)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in double precision; where a part overflows, in extended range."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = (q * c).sum(axis=1)
        wild = np.flatnonzero(~np.isfinite(out))
        if len(wild):
            out[wild] = (q[wild].astype(np.longdouble) * c[wild].astype(np.longdouble)).sum(axis=1).astype(np.float64)
    return out


def tile_best(q_id: np.ndarray, q: np.ndarray, c_id: np.ndarray, c: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, candidate position, score) of each query's k best candidates in one tile that may reach
    ``floor`` (each query's k-th best so far)."""
    (qn, q_power), (cn, c_power) = normal(q), normal(c)
    (qc, qs, qe), (cc, cs, ce) = quantise(qn), quantise(cn)
    # integers below 2**24 are exact in single precision up to 1040 dimensions, beyond that doubles hold them
    kind = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64
    near = (qc.astype(kind) @ cc.astype(kind).T).astype(np.float64) * qs[:, None] * cs[None, :]
    q_norm, c_norm = np.sqrt((qn**2).sum(1)), np.sqrt((cn**2).sum(1))
    # |q.c - q'.c'| <= |q - q'| |c| + |q'| |c - c'|, and |q'| <= |q| + |q - q'|
    bound = qe[:, None] * c_norm[None, :] + (q_norm + qe)[:, None] * ce[None, :]
    bound += 1e-12 * (np.abs(near) + q_norm[:, None] * c_norm[None, :])
    power = q_power[:, None] + c_power[None, :]
    with np.errstate(over="ignore", invalid="ignore"):
        low, high = np.ldexp(near - bound, power) - 1e-300, np.ldexp(near + bound, power) + 1e-300
    own = q_id[:, None] == c_id[None, :]
    a, b = np.nonzero(own)
    own[a, b] = (q[a] == c[b]).all(axis=1)  # the query's own row; another vector under its id is a candidate
    low[own], high[own] = -np.inf, -np.inf
    least = -np.partition(-low, k - 1, axis=1)[:, k - 1] if c.shape[0] > k else np.full(len(q), -np.inf)
    if floor is not None:
        least = np.maximum(least, floor)
    a, b = np.nonzero((high >= least[:, None]) & ~own)
    score = np.empty(len(a))
    for s in range(0, len(a), 65_536):
        score[s : s + 65_536] = products(q[a[s : s + 65_536]], c[b[s : s + 65_536]])
    order = np.lexsort((c_id[b], -score, a))
    a, b, score = a[order], b[order], score[order]
    start = np.searchsorted(a, np.arange(len(q)))
    kept = np.arange(len(a)) - start[a] < k
    return a[kept], b[kept], score[kept]


def _stack(dim: int, kind: str):
    """One block of each partition, numbered as the partition is."""

    def run(batches):
        parts = [(np.asarray(x.column("vec_id")), np.asarray(x.column("v").flatten()).reshape(-1, dim)) for x in batches if x.num_rows]
        if parts:
            ids, data = (np.concatenate(x) for x in zip(*parts, strict=True))
            row = [[TaskContext.get().partitionId()], [ids.astype("<i8").tobytes()], [data.astype(kind).tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), pa.array(row[1], pa.binary()), pa.array(row[2], pa.binary())], ["id", "ids", "data"])

    return run


def _tiles(dim: int, kind: str, k: int):
    """The k best of each query over the tiles that a task sees. Up to HELD query blocks' heaps are kept until their
    next tile; one that gives way is emitted and starts anew, which costs rows but loses none."""

    def run(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def emit(best):
            return pa.RecordBatch.from_arrays([pa.array(x) for x in best], ["query_id", "vec_id", "score"])

        for batch in batches:
            for t in range(batch.num_rows):
                q_id, c_id = (np.frombuffer(batch.column(c)[t].as_buffer(), "<i8") for c in ("q_ids", "ids"))
                q, c = (np.frombuffer(batch.column(c)[t].as_buffer(), kind).reshape(-1, dim).astype(np.float64) for c in ("q_data", "data"))
                key = batch.column("q")[t].as_py()
                found, floor = [], np.full(len(q), -np.inf)
                if key in held:
                    found = [held.pop(key)]
                    at = np.argsort(q_id, kind="stable")
                    full, times = np.unique(found[0][0], return_counts=True)
                    last = np.cumsum(times) - 1  # each query's worst of those kept
                    floor[at[np.searchsorted(q_id[at], full[times == k])]] = found[0][2][last[times == k]]
                for s in range(0, len(q), QUERIES_AT_ONCE):
                    own = q_id[s : s + QUERIES_AT_ONCE]
                    a, b, score = tile_best(own, q[s : s + QUERIES_AT_ONCE], c_id, c, k, floor[s : s + QUERIES_AT_ONCE])
                    found.append((own[a], c_id[b], score))
                query, vector, score = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((vector, -score, query))
                query, vector, score = query[order], vector[order], score[order]
                new = np.r_[True, query[1:] != query[:-1]] if len(query) else np.zeros(0, bool)
                place = np.arange(len(query)) - np.maximum.accumulate(np.where(new, np.arange(len(query)), 0))
                held[key] = tuple(x[place < k] for x in (query, vector, score))
                if len(held) > HELD:
                    yield emit(held.pop(next(iter(held))))
        for best in held.values():
            yield emit(best)

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v of the rows that take part: not null, not zero, no null or non-finite component."""
    rows = pick(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long"), F.col("embedding").alias("v"))
    rows = rows.where("vec_id is not null and v is not null and size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.where(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest other rows (all, if fewer), largest inner product
    first, ties to the smaller vec_id. is_query: a condition on vec_id.

    Rows that take no part (see ``usable``) are neither queries nor candidates; neither are vectors of another length
    than the most common one (of equally common ones the longer). Rows that agree in vec_id and vector count once.
    Several vectors under one vec_id are all candidates, the least of them is the query, and the others are
    candidates for it too. No rows: no result.
    """
    rows = usable(vectors)
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    dim = lengths.agg(F.max_by("d", F.struct("n", "d")).alias("d")).first()["d"] or 1
    rows = rows.where(F.size("v") == dim).distinct()
    kind = "<f4" if dict(rows.dtypes)["v"] == "array<float>" else "<f8"
    if kind == "<f8":
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))

    def blocked(part: DataFrame, name: str) -> tuple[DataFrame, int]:
        count = max(1, -(-part.count() // ROWS))
        packed = part.repartition(count).mapInArrow(_stack(dim, kind), "id int, ids binary, data binary")
        return staged(packed, name, **{"parquet.block.size": str(8 << 20)})[0], count

    wanted, _ = blocked(rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")), "ann-queries")
    blocks, count = blocked(rows, "ann-rows")
    # each block of the stated query set goes to every group of candidate blocks, and meets them there one by one; the
    # hint is needed, since Spark takes the exploded blocks to be as small as one copy and would broadcast all copies
    groups = -(-count // BLOCKS_A_GROUP)
    spread = wanted.select(F.col("id").alias("q"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))
    met = spread.hint("merge").join(blocks.withColumn("part", F.col("id") % groups), "part").select("q", "q_ids", "q_data", "ids", "data")
    found = met.mapInArrow(_tiles(dim, kind, k), "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
