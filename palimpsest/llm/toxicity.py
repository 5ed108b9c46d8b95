"""Toxicity: a factorization machine over hashed terms.

A term has a linear weight and a factor vector, and in a text that holds it c times the value x = 1 + ln c. The
logit of a text of n words is ``bias + sum(w x) / n**d + (|sum(v x)|^2 - sum(|v x|^2)) / (2 n**2d)`` over its distinct terms
(d is DAMPING), so that two terms that are harmless alone can count together. Terms are words and two word openings, hashed into 2**bits slots. Training
takes a bounded sample of labelled rows, learns weights and factors of all their terms together by minibatches, and
lets the penalty, not a filter by class, decide which of them stay; scoring reads every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import pick
from .textbytes import LOWER, PUNCTUATION, SPACE, Hasher, blocks, word_spans

_APART = SPACE | PUNCTUATION
OPENINGS = (5, 7)
DAMPING = 0.25


def block_terms(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots[kind, word], row of each word, words of each row); a word is cut at space and ASCII punctuation, its
    openings at OPENINGS bytes. ASCII letters are lower-cased."""
    data = LOWER[data]
    start, end, row = word_spans(data, offsets, _APART)
    hasher, slots = Hasher(data), np.empty((1 + len(OPENINGS), len(start)), np.int32)
    for kind, width in enumerate((0, *OPENINGS)):
        stop = np.minimum(end, start + width) if width else end
        slots[kind] = ((hasher.spans(start, stop) + np.uint64(kind * 0x1E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int32)
    return slots, row, np.bincount(row, minlength=len(offsets) - 1)


@dataclass(frozen=True)
class FactorizationMachine:
    bits: int
    slots: np.ndarray  # of the terms that have weights, sorted
    bias: float
    weights: np.ndarray
    factors: np.ndarray  # terms x rank

    def logits(self, term: np.ndarray, row: np.ndarray, words: np.ndarray) -> np.ndarray:
        """term: positions in slots of all occurrences, each with its row."""
        rank = self.factors.shape[1]
        out = np.zeros((len(words), rank + 2))
        if len(term):
            pair, times = np.unique(row.astype(np.int64) * len(self.slots) + term, return_counts=True)
            row, term = pair // len(self.slots), pair % len(self.slots)
            x = 1 + np.log(times)
            v = self.factors[term] * x[:, None]
            new = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            out[row[new]] = np.add.reduceat(np.column_stack([self.weights[term] * x, v, (v**2).sum(1)]), new, axis=0)
        n = np.maximum(words, 1).astype(float)
        return self.bias + out[:, 0] / n**DAMPING + ((out[:, 1:-1] ** 2).sum(1) - out[:, -1]) / (2 * n ** (2 * DAMPING))


def _known(slots: np.ndarray, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of terms with weights, and their rows."""
    term = place[slots]
    kind, word = np.nonzero(term >= 0)
    return term[kind, word], row[word]


def _gap(bare: np.ndarray, toxic: np.ndarray, real: tuple[float, float]) -> float:
    """The middle of the widest gap between sorted logits at which most texts are told apart. real: how many labelled
    texts a clean and a toxic one of the sample stand for."""
    rising = np.argsort(bare, kind="stable")
    weight = np.where(toxic > 0, real[1], real[0])[rising]
    mine = toxic[rising] > 0
    right = np.cumsum(np.where(mine, 0.0, weight))[:-1] + np.where(mine, weight, 0.0).sum() - np.cumsum(np.where(mine, weight, 0.0))[:-1]
    gap = np.diff(bare[rising])
    if not (gap > 0).any():
        return 0.0
    best = int(np.argmax(np.where(right >= right[gap > 0].max() * (1 - 1e-9), gap, -1.0)))
    return float((bare[rising[best]] + bare[rising[best + 1]]) / 2)


def fit(
    docs: list[tuple[np.ndarray, np.ndarray, int]], toxic: np.ndarray, *, bits: int, rank: int = 8, steps: int = 210, batch: int = 512,
    rate: float = 0.15, sparse: float = 3e-3, group: float = 0.02, quiet: float = 0.3, spread: float = 0.03, least: int = 4, real: tuple[float, float] = (1.0, 1.0), seed: int = 7,
) -> FactorizationMachine:
    """docs: each text's distinct slots, how often each occurs, and its number of words.

    Proximal minibatch descent with momentum on the log loss in which both classes weigh the same. Linear weights carry an l1 penalty
    (``sparse``), factor vectors a group penalty (``group``) that sets in after the share ``quiet`` of all steps: a
    pair of terms is found before lone noise is cut to zero. Steps are scaled by the steepest slope, so that a term of
    many texts moves before one of few. Terms of fewer than ``least`` texts can't teach and get neither. The bias
    is then moved so that a score of 0.5 lies in the widest gap of those that tell most labelled texts apart, each
    sampled text counted as the labelled ones that it stands for (``real``: of clean, of toxic). Without texts of both
    classes: the constant share of toxic ones."""
    toxic = np.asarray(toxic, float)
    share = float(toxic.mean()) if len(toxic) else 0.0
    if not len(toxic) or share in (0.0, 1.0):
        p = min(max(share, 0.01), 0.99)
        return FactorizationMachine(bits, np.zeros(0, np.int64), float(np.log(p / (1 - p))), np.zeros(0), np.zeros((0, rank)))
    size = np.array([len(d[0]) for d in docs])
    term, times = (np.concatenate([d[k] for d in docs]) for k in (0, 1))
    slots = np.flatnonzero(np.bincount(term, minlength=1 << bits) >= least)
    place = np.full(1 << bits, -1, np.int32)
    place[slots] = np.arange(len(slots))
    term = place[term]
    held = term >= 0
    size = np.add.reduceat(np.append(held, False).astype(np.int64), np.minimum(np.cumsum(size) - size, len(held))) * (size > 0)
    term, value = term[held], (1 + np.log(times[held])).astype(np.float32)
    start = np.cumsum(size) - size
    n_words = np.maximum(1, np.array([d[2] for d in docs])).astype(np.float32)
    by_one, by_two = n_words**-DAMPING, n_words ** (-2 * DAMPING) / 2
    cost = np.where(toxic > 0, 0.5 / share, 0.5 / (1 - share))
    rng = np.random.default_rng(seed)
    at = np.column_stack([rng.normal(0, spread, (len(slots), rank)), np.zeros(len(slots))]).astype(np.float32)  # factors, weight
    pace, bias, top = np.zeros_like(at), 0.0, np.zeros(2)
    usable = np.flatnonzero(size > 0)
    per_epoch = -(-len(usable) // batch)
    total = steps if per_epoch else 0
    queue: list[np.ndarray] = []

    def forward(own: np.ndarray):
        """Of the texts ``own``: terms a text, where they begin, terms, values, values times parameters, their sums, and
        the logits without the bias."""
        many = size[own]
        first = np.cumsum(many) - many
        where = np.repeat(start[own] - first, many) + np.arange(many.sum())
        t, c = term[where], value[where]
        x = at[t] * c[:, None]
        sums = np.add.reduceat(x, first, axis=0)
        own_pairs = np.add.reduceat((x[:, :rank] ** 2).sum(1), first)
        return many, first, t, c, x, sums, sums[:, rank] * by_one[own] + ((sums[:, :rank] ** 2).sum(1) - own_pairs) * by_two[own]

    for step in range(1, total + 1):
        queue = queue or np.array_split(rng.permutation(usable), per_epoch)
        own = queue.pop()
        many, first, t, c, x, sums, bare = forward(own)
        v, logit = x[:, :rank], bias + bare
        error = (cost[own] * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - toxic[own]) / len(own)).astype(np.float32)
        slope = np.empty_like(x)
        slope[:, :rank] = (np.repeat(2 * error * by_two[own], many) * c)[:, None] * (np.repeat(sums[:, :rank], many, axis=0) - v)
        slope[:, rank] = np.repeat(error * by_one[own], many) * c
        order = np.argsort(t, kind="stable")
        new = np.flatnonzero(np.r_[True, t[order][1:] != t[order][:-1]])
        pace *= 0.8
        pace[t[order][new]] += 0.2 * np.add.reduceat(slope[order], new, axis=0)
        top = np.maximum(0.97 * top, [np.abs(pace[:, :rank]).max(), np.abs(pace[:, rank]).max()])
        wide, long = np.minimum(rate * min(1.0, 2 * (1 - step / (total + 1))) / (top + 1e-9), 50.0)
        at[:, :rank] -= wide * pace[:, :rank]
        at[:, rank] -= long * pace[:, rank]
        at[:, rank] = np.sign(at[:, rank]) * np.maximum(0, np.abs(at[:, rank]) - long * sparse)
        weight = min(1.0, max(0.0, step / total - quiet) / quiet)
        norm = np.sqrt((at[:, :rank] ** 2).sum(1))
        at[:, :rank] *= np.maximum(0, 1 - wide * group * weight / np.maximum(norm, 1e-9))[:, None]
        bias -= 0.3 * min(rate / (top[1] + 1e-9), 50.0) * float(error.sum())
    bare = np.zeros(len(docs))
    for own in np.array_split(usable, max(1, per_epoch)):
        if len(own):
            bare[own] = forward(own)[-1]
    bias = -_gap(bare, toxic, real)
    kept = np.flatnonzero((at != 0).any(1))
    return FactorizationMachine(bits, slots[kept].astype(np.int64), bias, at[kept, rank].astype(float), at[kept, :rank].astype(float))


@F.arrow_udf(T.StructType([T.StructField("slots", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("words", T.LongType())]))
def _terms_20(text: pa.Array) -> pa.Array:
    out, counts, words = [], [], []
    for _, _, data, offsets in blocks(text):
        slots, row, n = block_terms(data, offsets, 20)
        edges = np.searchsorted(row, np.arange(len(offsets)))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own, times = np.unique(slots[:, a:b], return_counts=True)
            out.append(own.tobytes())
            counts.append(times.astype(np.int32).tobytes())
        words += n.tolist()
    return pa.StructArray.from_arrays([pa.array(out, pa.binary()), pa.array(counts, pa.binary()), pa.array(words, pa.int64())], ["slots", "counts", "words"])


def learn(docs: DataFrame, labels: DataFrame, usable=lambda doc_id: F.lit(True), most: int = 2000, **options) -> FactorizationMachine:
    """A machine learnt from at most ``most`` toxic and 3 * ``most`` other labelled texts (the documented bound on
    what the driver holds: eight bytes a distinct term of each), picked by a hash of doc_id. usable: a condition on
    doc_id. A doc_id with several labels is toxic if any of them says so; of several texts the least counts."""
    known = pick(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic")).where(usable(F.col("doc_id")))
    order = F.xxhash64(F.lit("toxic"), "doc_id")
    picked = known.where("toxic <> 0").orderBy(order, "doc_id").limit(most).unionByName(known.where("toxic = 0").orderBy(order, "doc_id").limit(3 * most))
    rows = pick(docs, "doc_id", "text").join(F.broadcast(picked), "doc_id")  # 4 * most rows
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "toxic", _terms_20("text").alias("t")).select("doc_id", "toxic", "t.*")
    rows = sorted(rows.toLocalIterator(), key=lambda r: r["doc_id"])
    toxic = np.array([r["toxic"] != 0 for r in rows])
    n = known.agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") != 0).alias("toxic")).first()
    real = (max(1, n["clean"]) / max(1, int((~toxic).sum())), max(1, n["toxic"]) / max(1, int(toxic.sum()))) if len(rows) else (1.0, 1.0)
    texts = [(np.frombuffer(r["slots"], np.int32), np.frombuffer(r["counts"], np.int32), r["words"]) for r in rows]
    del rows
    return fit(texts, toxic, bits=20, real=real, **options)


@lru_cache(maxsize=2)
def _place(key: bytes, bits: int) -> np.ndarray:
    place = np.full(1 << bits, -1, np.int32)
    kept = np.frombuffer(key, np.int64)
    place[kept] = np.arange(len(kept))
    return place


def scorer(machine: FactorizationMachine):
    """A column function: text -> probability that the text is toxic."""
    key = machine.slots.astype(np.int64).tobytes()

    @F.arrow_udf(T.DoubleType())
    def score(text: pa.Array) -> pa.Array:
        place, out = _place(key, machine.bits), [np.zeros(0)]
        for _, _, data, offsets in blocks(text):
            slots, row, words = block_terms(data, offsets, machine.bits)
            term, at = _known(slots, row, place)
            out.append(1 / (1 + np.exp(-np.clip(machine.logits(term, at, words), -30, 30))))
        return pa.array(np.concatenate(out))

    return score


def score_toxicity(docs: DataFrame, machine: FactorizationMachine) -> DataFrame:
    """doc_id and score in (0, 1), one row per row of docs. Null and empty texts get the machine's bias."""
    return pick(docs, "doc_id", "text").select("doc_id", scorer(machine)("text").alias("score"))
