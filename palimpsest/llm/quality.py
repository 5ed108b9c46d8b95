"""Quality rules: text statistics, and decision lists learnt from labelled documents.

``text_statistics`` measures whole texts, ``learn_decision_list`` fits ordered conjunctions of thresholds by
sequential covering (grow on one half of the labelled rows, prune on the other; at each step a rule that rejects and
one that keeps compete, so that the order of the list matters), and ``verdict`` turns the list into one Spark
conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import pick, place
from .textbytes import CONTINUATION, SPACE, Hasher, blocks, per_row, windows, word_spans

STATISTICS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_upper",
    "n_digits",
    "n_bars",
    "n_marks",
    "n_distinct_words",
)
_SCHEMA = T.StructType([T.StructField(x, T.LongType()) for x in STATISTICS])


def _table(members: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members.encode())] = True
    return table


_SYMBOL, _UPPER, _DIGIT = _table("#*$%&|<>"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789")
_BAR, _MARK = _table("|"), _table("!")


def _repeats(key: np.ndarray) -> np.ndarray:
    """Which entries occur more than once."""
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    out = np.empty(len(key), bool)
    out[order] = same[1:] | same[:-1]
    return out


def _firsts(row: np.ndarray, key: np.ndarray, rows: int) -> np.ndarray:
    """Distinct keys of each row."""
    order = np.lexsort((key, row))
    r, k = row[order], key[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    return np.bincount(r[new], minlength=rows)


def block_statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    rows = len(offsets) - 1
    start, end, row = word_spans(data, offsets)
    hasher = Hasher(data)
    words = hasher.spans(start, end)
    out = {"n_words": np.bincount(row, minlength=rows)}
    out["word_chars"] = per_row(~SPACE[data] & ~CONTINUATION[data], offsets)
    for name, table in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_digits", _DIGIT), ("n_bars", _BAR), ("n_marks", _MARK)):
        out[name] = per_row(table[data], offsets)

    newline = np.zeros(256, bool)
    newline[0x0A] = True
    a, b, line_row = word_spans(data, offsets, newline)
    out["n_lines"] = np.bincount(line_row, minlength=rows)
    holds = np.searchsorted(start, b) > np.searchsorted(start, a)
    a, b, line_row = a[holds], b[holds], line_row[holds]
    out["n_dup_lines"] = np.bincount(line_row, minlength=rows) - _firsts(line_row, hasher.spans(a, b), rows)

    key, first = windows(words, row, 3)
    first = first[_repeats(key ^ (row[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))]
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[first + k] = True
    out["n_repeat_words"] = np.bincount(row[covered], minlength=rows)
    out["n_distinct_words"] = _firsts(row, words, rows)
    return out


@F.arrow_udf(_SCHEMA)
def text_statistics(text: pa.Array) -> pa.Array:
    """Counts of each whole text; null and empty texts give zeros. A word is ``[^\\x20\\x09-\\x0D]+``.

    word_chars: code points in words. n_symbols: characters of ``#*$%&|<>``. n_lines: non-empty lines.
    n_dup_lines: lines with a word that equal an earlier line. n_repeat_words: words inside three-word windows
    that the text holds twice or more. n_upper, n_digits: ASCII. n_bars, n_marks: ``|`` and ``!``.
    """
    parts = [block_statistics(data, offsets) for _, _, data, offsets in blocks(text)]
    columns = [pa.array(np.concatenate([p[x] for p in parts]) if parts else [], pa.int64()) for x in STATISTICS]
    return pa.StructArray.from_arrays(columns, list(STATISTICS))


#: name -> expression over a statistics struct; a ratio of nothing is 0
FEATURES = {
    "symbols_per_char": ("n_symbols", "word_chars"),
    "upper_per_char": ("n_upper", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "bars_per_word": ("n_bars", "n_words"),
    "repeats_per_word": ("n_repeat_words", "n_words"),
    "dup_lines_per_line": ("n_dup_lines", "n_lines"),
    "digits_per_char": ("n_digits", "word_chars"),
    "chars_per_word": ("word_chars", "n_words"),
    "distinct_per_word": ("n_distinct_words", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


def feature(stats: Column, name: str) -> Column:
    above, below = FEATURES[name]
    return F.when(stats[below] > 0, stats[above] / stats[below]).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, list(FEATURES).index(self.name)]
        return v > self.threshold if self.above else v <= self.threshold


@dataclass(frozen=True)
class Rule:
    """Documents on which all conditions hold, and no rule before, are rejected, or kept if ``keeps``."""

    conditions: tuple[Condition, ...]
    precision: float
    covered: int
    keeps: bool = False

    def holds(self, x: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([c.holds(x) for c in self.conditions])


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))) if p else -1.0


def _grow(x: np.ndarray, bad: np.ndarray, weight: np.ndarray, cuts: list[np.ndarray], longest: int) -> list[Condition]:
    inside, rule = np.ones(len(x), bool), []
    while len(rule) < longest:
        p0, n0 = float(weight[inside & bad].sum()), float(weight[inside & ~bad].sum())
        if not n0:
            break
        best = (0.0, None)
        for j, name in enumerate(FEATURES):
            v, p, n = x[inside, j], np.where(bad, weight, 0.0)[inside], np.where(bad, 0.0, weight)[inside]
            for cut in cuts[j]:
                over = v > cut
                for above, hit in ((True, over), (False, ~over)):
                    gain = _gain(float(p[hit].sum()), float(n[hit].sum()), p0, n0)
                    if gain > best[0] + 1e-12:
                        best = (gain, Condition(name, above, float(cut)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(x)
    return rule


def fit_decision_list(
    x: np.ndarray, bad: np.ndarray, fold: np.ndarray, weight: np.ndarray | None = None, *, most_rules: int = 16, longest: int = 4, precision: float = 0.9, sure: float = 0.98, least: int = 5, n_cuts: int = 40
) -> list[Rule]:
    """Sequential covering. At each step a conjunction is grown on fold 0 and its tail pruned on fold 1, once for
    rejecting and once for keeping; of the two the one that is purer on all rows left, with both classes weighing the
    same, joins the list, and the rows that it covers go. A rejecting rule must be ``precise`` at the real shares, a
    keeping one ``sure`` at equal ones. It ends when no rejecting rule is left; keeping rules behind the last
    rejecting one say what the default says and are dropped. bad: what is to be rejected. weight: labelled documents
    that a row stands for (1 if not given); ``least`` is of rows. No rows, or no bad ones: no rules."""
    rules: list[Rule] = []
    weight = np.ones(len(x)) if weight is None else weight
    left = np.ones(len(x), bool)
    if not len(x) or not bad.any():
        return rules
    cuts = [np.unique(np.round(np.quantile(x[:, j], np.linspace(0.005, 0.995, n_cuts)), 6)) for j in range(x.shape[1])]
    cuts = [np.unique(np.concatenate([c, np.round(np.quantile(x[bad, j], np.linspace(0.02, 0.98, n_cuts // 2)), 6)])) for j, c in enumerate(cuts)]
    even = weight * np.where(bad, 0.5 / max(weight[bad].sum(), 1e-9), 0.5 / max(weight[~bad].sum(), 1e-9))

    def candidate(target: np.ndarray, share: np.ndarray, price: float) -> tuple[list[Condition], np.ndarray] | None:
        grow, prune = left & (fold == 0), left & (fold != 0)
        if target[grow].sum() < least:
            return None
        found = _grow(x[grow], target[grow], share[grow], cuts, longest)
        best, kept = -np.inf, found
        for n in range(len(found), 0, -1):
            hit = Rule(tuple(found[:n]), 0, 0).holds(x[prune])
            p, q = float(share[prune][target[prune] & hit].sum()), float(share[prune][~target[prune] & hit].sum())
            worth = (p - price * q) / max(p + q, 1e-9) if p + q else -1.0
            if worth >= best:
                best, kept = worth, found[:n]
        if not kept:
            return None
        hit = Rule(tuple(kept), 0, 0).holds(x) & left
        return (kept, hit) if (target & hit).sum() >= least else None

    while len(rules) < most_rules:
        reject, keep = candidate(bad, weight, 3.0), candidate(~bad, even, 3.0)
        if reject:
            p, q = float(weight[bad & reject[1]].sum()), float(weight[~bad & reject[1]].sum())
            precise = p / (p + q)
        if not reject or precise < precision:
            break

        def purity(hit: np.ndarray, target: np.ndarray) -> float:
            return float(even[hit & target].sum() / even[hit].sum())

        if keep and purity(keep[1], ~bad) >= sure and purity(keep[1], ~bad) > purity(reject[1], bad):
            kept, hit = keep
            rules.append(Rule(tuple(kept), float(weight[~bad & hit].sum() / weight[hit].sum()), round(float(weight[hit].sum())), True))
        else:
            kept, hit = reject
            rules.append(Rule(tuple(kept), precise, round(p + q)))
        left &= ~hit
    while rules and rules[-1].keeps:
        rules.pop()
    return rules


def labelled_statistics(docs: DataFrame, labels: DataFrame, most: int = 6000) -> DataFrame:
    """Features, quality label, fold and weight of at most ``most`` labelled documents of each class, by a hash of
    doc_id. The weight is the class's labels over those picked, so that weighted counts keep the real shares."""
    known = pick(labels, "doc_id", "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = F.xxhash64(F.lit("quality"), "doc_id")
    picked = known.where("quality = 0").orderBy(order, "doc_id").limit(most).unionByName(known.where("quality <> 0").orderBy(order, "doc_id").limit(most))
    n = known.agg(F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(F.col("quality") != 0).alias("good")).first()
    weight = F.when(F.col("quality") == 0, max(1.0, n["bad"] / most)).otherwise(max(1.0, n["good"] / most))
    rows = pick(docs, "doc_id", "text").join(F.broadcast(picked), "doc_id")  # 2 * most rows
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).withColumn("__s", text_statistics("text"))
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(2))
    return rows.select(*[feature(F.col("__s"), x).alias(x) for x in FEATURES], (F.col("quality") == 0).alias("bad"), fold.alias("fold"), weight.alias("weight"))


def learn_decision_list(docs: DataFrame, labels: DataFrame, most: int = 6000, **options) -> list[Rule]:
    """Rules for rejecting documents, learnt from at most 2 * ``most`` labelled rows (the bound on what the driver
    gets: a dozen numbers a row), each weighted by what it stands for. Labels of unknown documents and null labels are
    left out."""
    table = labelled_statistics(docs, labels, most).toPandas().sort_values([*FEATURES, "bad", "fold"])
    return fit_decision_list(table[list(FEATURES)].to_numpy(float), table["bad"].to_numpy(bool), table["fold"].to_numpy(int), table["weight"].to_numpy(float), **options)


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


def verdict(stats: Column, rules: list[Rule]) -> Column:
    """True where a document is kept: the first rule that holds decides, and the default is to keep."""
    out = F.when(base_failed(stats), F.lit(False))
    for rule in rules:
        test = F.lit(True)
        for c in rule.conditions:
            value = feature(stats, c.name)
            test = test & ((value > c.threshold) if c.above else (value <= c.threshold))
        out = out.when(test, F.lit(rule.keeps))
    return out.otherwise(F.lit(True))


def quality_report(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept and the other statistics, one row per row of docs.

    Null or empty text: zeros, base_failed true. Repeated rows stay; a null doc_id stays null.
    """
    rows = pick(docs, "doc_id", "text").select("doc_id", text_statistics("text").alias("s"))
    s = F.col("s")
    base, others = STATISTICS[:5], STATISTICS[5:]
    judged = [base_failed(s).alias("base_failed"), verdict(s, rules).alias("kept")]
    return rows.select("doc_id", *[s[x].alias(x) for x in base], *judged, *[s[x].alias(x) for x in others])


def keep_good(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with docs' own columns."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = place(names, text)
    judged = plain.withColumn("s", text_statistics(F.lit(None).cast("string") if at is None else F.col(f"c{at}").cast("string")))
    return judged.where(verdict(F.col("s"), rules)).drop("s").toDF(*names)
