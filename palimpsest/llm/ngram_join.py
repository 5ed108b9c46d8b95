"""N-gram Jaccard join by prefix trees.

Every document is its set of distinct word shingles (64-bit hashes) in one global order, from estimated rare to
frequent. Documents with equal sets are one node. Two sets that link share a shingle among the first
``n - ceil(t n) + 1`` of each, so nodes meet under their prefix shingles only. Meeting nodes are compared with the
node of their shingle that has the fewest rarer shingles (one pass, linear in the postings); what this leaves in
different components is compared pair by pair, after exact bounds from sizes, from the places of the shared shingle
and from parity sketches. Texts are fetched for nodes of such pairs only, one text a node. Comparison itself stores the partners of a node in a trie of their globally ordered sets (frequent first), walks it once with
the node's set so that partners with a common beginning share their partial overlap, and drops a subtree as soon as
what remains in it cannot reach the overlap that is needed. No pair is dropped other than by such exact bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .frames import discard, membership, pick, place, staged
from .textbytes import LOWER, Hasher, blocks, mix, windows, word_spans

ORDER_BITS = 16
CHUNK = 256
SALT_ROWS = 4096
U = np.uint64


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes, row of each, word hashes, row of each word); a text of fewer words has one shingle of all."""
    data = LOWER[data]
    start, end, row = word_spans(data, offsets)
    words = Hasher(data).spans(start, end)
    key, first = windows(words, row, width)
    at = row[first]
    count = np.bincount(row, minlength=len(offsets) - 1)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        begin = np.searchsorted(row, short)
        whole = np.array([_whole(words[b : b + count[r]]) for b, r in zip(begin, short, strict=True)], U)
        key, at = np.concatenate([key, whole]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        key, at = key[order], at[order]
    return key, at, words, row


def _whole(words: np.ndarray) -> np.uint64:
    total = U(len(words))
    with np.errstate(over="ignore"):
        for w in words:
            total = mix(np.array([total * U(0xD6E8FEB86659FD93) + w], U))[0]
    return total


class Order:
    """The global order: shingles whose bucket is far fuller than the mean come last, by its count; others go by
    the estimated frequency of their words; equal ones by hash. Any order is correct; a good one is fast."""

    def __init__(self, shingle_counts: np.ndarray, word_counts: np.ndarray) -> None:
        mean = shingle_counts.mean()
        heavy = shingle_counts > mean + 6 * np.sqrt(mean) + 20
        self.heavy = np.where(heavy, 1000.0 + np.log1p(shingle_counts), 0.0).astype(np.float32)
        self.salts = np.where(heavy, np.maximum(2, shingle_counts // SALT_ROWS), 1).astype(np.int32)  # groups that a shingle's nodes are dealt to
        self.words = np.log1p(word_counts).astype(np.float32)

    @staticmethod
    def bucket(key: np.ndarray) -> np.ndarray:
        return (key >> U(64 - ORDER_BITS)).astype(np.int64)

    def rank(self, key: np.ndarray, first: np.ndarray, words: np.ndarray, width: int) -> np.ndarray:
        rank = np.zeros(len(key), np.float32)
        weight = self.words[self.bucket(words)]
        for k in range(width):
            rank += weight[np.minimum(first + k, len(words) - 1)]
        return np.maximum(rank, self.heavy[self.bucket(key)])


def ordered_sets(data: np.ndarray, offsets: np.ndarray, width: int, order: Order) -> Iterator[np.ndarray]:
    """Each text's distinct shingles in global order, rare first."""
    key, at, words, row = shingles(data, offsets, width)
    rows = len(offsets) - 1
    edges, word_edges = np.searchsorted(at, np.arange(rows + 1)), np.searchsorted(row, np.arange(rows + 1))
    first = np.arange(len(key)) - edges[at] + word_edges[at] if len(key) else key.astype(np.int64)
    # a whole-sequence shingle of a short text ranks by the words that follow it too; the order stays a function of the set alone
    lone = (word_edges[1:] - word_edges[:-1] < width)[at] if len(key) else np.zeros(0, bool)
    rank = order.rank(key, first, words, width) if len(key) else np.zeros(0, np.float32)
    rank[lone] = 0
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if a == b:
            yield key[:0]
            continue
        own, sample = np.unique(key[a:b], return_index=True)
        yield own[np.argsort(rank[a:b][sample], kind="stable")]


def needed(na: int, nb, per_cent: int):
    """Smallest overlap with which sets of these sizes link."""
    return -(-(per_cent * (na + nb)) // (100 + per_cent))


def parity_sketch(own: np.ndarray) -> bytes:
    """Parities of the counts of the set's hashes modulo a power of two; sets that differ in d members have sketches
    that differ in d places at most, also after folding to a smaller size."""
    size = 1 << max(6, int(len(own)).bit_length() - 1)
    odd = np.bincount((own & U(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _fold(sketch: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_xor.reduce(sketch.reshape(-1, size), axis=0)


def may_link(a: bytes, na: int, b: bytes, nb: int, per_cent: int) -> bool:
    """Exact necessary condition from sizes and sketches."""
    if 100 * min(na, nb) < per_cent * max(na, nb):
        return False
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    apart = int(np.bitwise_count(_fold(x, size) ^ _fold(y, size)).sum())
    return (na + nb - apart) // 2 >= needed(na, nb, per_cent)


class Trie:
    """Sets in global order, frequent first, as a path-compressed prefix tree over their sorted sequences."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        flipped = [s[::-1] for s in sets]
        keys = [s.astype(">u8").tobytes() for s in flipped]
        self.order = sorted(range(len(sets)), key=keys.__getitem__)
        self.sets = [flipped[i] for i in self.order]
        self.size = np.array([len(s) for s in self.sets], np.int64)
        self.shared = np.zeros(len(sets) + 1, np.int64)  # common beginning of each with the one before
        for k in range(1, len(sets)):
            x, y = self.sets[k - 1], self.sets[k]
            n = min(len(x), len(y))
            differ = np.flatnonzero(x[:n] != y[:n])
            self.shared[k] = differ[0] if len(differ) else n

    def linked(self, probe: np.ndarray, per_cent: int) -> list[int]:
        """Positions (in the list given at first) of the sets that link with the probe."""
        out, sorted_probe, n = [], np.sort(probe), len(probe)
        if not n:
            return out

        def hits(part: np.ndarray) -> int:
            at = np.minimum(np.searchsorted(sorted_probe, part), n - 1)
            return int((sorted_probe[at] == part).sum())

        stack = [(0, len(self.sets), 0, 0)]
        while stack:
            low, high, depth, overlap = stack.pop()
            longest, shortest = int(self.size[low:high].max()), int(self.size[low:high].min())
            if overlap + longest - depth < needed(n, shortest, per_cent):
                continue
            common = len(self.sets[low]) if high - low == 1 else int(min(self.shared[low + 1 : high].min(), shortest))
            overlap += hits(self.sets[low][depth:common])
            while low < high and len(self.sets[low]) == common:
                if 100 * overlap >= per_cent * (n + common - overlap) and overlap:
                    out.append(self.order[low])
                low += 1
            while low < high:
                breaks = np.flatnonzero(self.shared[low + 1 : high] <= common)
                last = low + 1 + int(breaks[0]) if len(breaks) else high
                stack.append((low, last, common, overlap))
                low = last
        return out


def _runs(batches, keys: list[str]) -> Iterator[pa.Table]:
    """Groups of consecutive rows with equal keys, out of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in keys]
        change = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = tuple(c[a] for c in columns)
            if held and own != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = own
    if held:
        yield pa.Table.from_batches(held)


def _count(width: int):
    def run(batches):
        counts = np.zeros((2, 1 << ORDER_BITS), np.int64)
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column("text")):
                key, _, words, _ = shingles(data, offsets, width)
                for k, x in enumerate((key, words)):
                    counts[k] += np.bincount(Order.bucket(x), minlength=1 << ORDER_BITS)
        kind, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array(counts[kind, bucket])], ["kind", "bucket", "n"])

    return run


def global_order(rows: DataFrame, width: int) -> Order:
    """Counts of all shingles and words in 2**ORDER_BITS buckets each: what the driver gets has that fixed size."""
    table = rows.select("text").mapInArrow(_count(width), "kind int, bucket int, n bigint").groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((2, 1 << ORDER_BITS))
    counts[table["kind"], table["bucket"]] = table["n"]
    return Order(counts[0], counts[1])


def _describe(width: int, per_cent: int, order: Order):
    names = ["rid", "doc_id", "n", "node", "prefix", "sketch"]

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column("text")):
                n, node, prefix, sketch = [], [], [], []
                for own in ordered_sets(data, offsets, width, order):
                    n.append(len(own))
                    mixed = mix(own)
                    node.append(int((mix(np.array([mixed.sum(dtype=U) + U(len(own))], U))[0] ^ np.bitwise_xor.reduce(mixed)).astype(np.int64)) if len(own) else None)
                    prefix.append(own[: len(own) - -(-per_cent * len(own) // 100) + 1].tobytes() if len(own) else None)
                    sketch.append(parity_sketch(own) if len(own) else None)
                rest = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([rest.column("rid"), rest.column("doc_id"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(prefix, pa.binary()), pa.array(sketch, pa.binary())], names)

    return run


def _postings(order: Order):
    salts = order.salts

    def run(batches):
        for batch in batches:
            data = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("prefix")]
            for a in range(0, len(data), 512):
                part = data[a : a + 512]
                size = np.array([len(x) for x in part])
                token = np.concatenate(part)
                rest = batch.slice(a, len(part))
                node, n = (np.repeat(np.asarray(rest.column(c)), size) for c in ("node", "n"))
                many = salts[Order.bucket(token.view(U))]
                salt = (mix(node.view(U)) % many.astype(U)).astype(np.int32)
                pos = np.concatenate([np.arange(s) for s in size])
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(salt), pa.array(many > 1), pa.array(node), pa.array(n.astype(np.int32)), pa.array(pos, pa.int32())], ["token", "salt", "split", "node", "n", "pos"])

    return run


def _bounded(per_cent: int):
    def run(batches):
        for batch in batches:
            a, b, na, nb, x, y = (batch.column(c).to_pylist() for c in ("a", "b", "na", "nb", "sa", "sb"))
            kept = [k for k in range(len(a)) if may_link(x[k], na[k], y[k], nb[k], per_cent)]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(kept, pa.int64())) for c in ("a", "b")], ["a", "b"])

    return run


def _compare(width: int, per_cent: int, order: Order):
    """Walks the trie of each group's partners with the group's own node."""

    def run(batches):
        for group in _runs(batches, ["a", "chunk"]):
            own, node = group.column("a")[0].as_py(), np.asarray(group.column("node"))
            sets: dict[int, np.ndarray] = {}
            row = 0
            for _, _, data, offsets in blocks(group.column("text").combine_chunks()):
                for one in ordered_sets(data, offsets, width, order):
                    sets[int(node[row])] = one
                    row += 1
            if own not in sets:
                continue
            probe, others = sets.pop(own), list(sets)
            found = Trie([sets[k] for k in others]).linked(probe, per_cent) if others else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([own] * len(found), pa.int64()), pa.array([others[k] for k in found], pa.int64())], ["a", "b"])

    return run


def _left_over(per_cent: int):
    """Pairs of a shingle's nodes in different components that the bounds let through; between two chunks or
    within one."""

    def pairs_of(node, n, pos, comp, side, sketch, seen):
        left = np.flatnonzero(side != 1)
        right = left if len(left) == len(side) else np.flatnonzero(side == 1)
        sizes = np.array([len(x) for x in sketch])
        stacks = {z: np.frombuffer(b"".join(sketch[k] for k in right[sizes[right] == z]), np.uint8).reshape(-1, z) for z in np.unique(sizes[right]).tolist()}
        members = {z: right[sizes[right] == z] for z in stacks}
        for k in left.tolist():
            own = np.frombuffer(sketch[k], np.uint8)
            for z, stack in stacks.items():
                there = members[z]
                both = n[there].astype(np.int64) + int(n[k])
                least = needed(0, both, per_cent)
                near = (comp[there] != comp[k]) & (100 * np.minimum(n[there], n[k]) >= per_cent * np.maximum(n[there], n[k]))
                # linking sets share a shingle that at most n - least others come before, in each
                near &= (pos[there] + least <= n[there]) & (pos[k] + least <= n[k])
                if not near.any():
                    continue
                other, size, both, least = stack[near], min(z, len(own)), both[near], least[near]
                apart = np.bitwise_count(np.bitwise_xor.reduce(other.reshape(len(other), -1, size), axis=1) ^ _fold(own, size)).sum(axis=1, dtype=np.int64)
                for m in there[near][(both - apart) // 2 >= least].tolist():
                    pair = (int(node[k]), int(node[m])) if node[k] < node[m] else (int(node[m]), int(node[k]))
                    if pair not in seen:
                        seen.add(pair)
                        yield pair

    def run(batches):
        seen: set[tuple[int, int]] = set()
        held = None
        out: list[tuple[int, int]] = []

        def work(rows, last: bool):
            """Whole groups of rows; what may go on in the next batch is given back."""
            key = rows["key"]
            cuts = np.append(np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)]), len(key))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b == len(key) and not last:
                    return {c: x[a:] for c, x in rows.items()}
                if b - a > 1:
                    out.extend(pairs_of(rows["node"][a:b], rows["n"][a:b], rows["pos"][a:b], rows["comp"][a:b], rows["side"][a:b], rows["sketch"][a:b], seen))
                if len(seen) > 100_000:
                    seen.clear()
            return None

        def table():
            done = pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])
            out.clear()
            return done

        for batch in batches:
            rows = {"key": np.stack([np.asarray(batch.column(c), np.int64) for c in ("token", "i", "j")], axis=1), "sketch": batch.column("sketch").to_pylist()}
            rows |= {c: np.asarray(batch.column(c)) for c in ("node", "n", "pos", "comp", "side")}
            if held is not None:
                rows = {c: held[c] + rows[c] if c == "sketch" else np.concatenate([held[c], rows[c]]) for c in rows}
            held = work(rows, False) if batch.num_rows else held
            if out:
                yield table()
        if held is not None:
            work(held, True)
            if out:
                yield table()

    return run


def jaccard_links(docs: DataFrame, *, width: int, per_cent: int) -> tuple[DataFrame, DataFrame]:
    """(members, components): members has rid, doc_id, n, node for every row of docs (node null without a word);
    components has node, comp for every node that links with another text's."""
    spark = docs.sparkSession
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select(F.xxhash64("doc_id", "text").alias("rid"), "doc_id", "text")
    order = global_order(rows, width)
    sets, sets_path = staged(rows.mapInArrow(_describe(width, per_cent, order), "rid bigint, doc_id bigint, n bigint, node bigint, prefix binary, sketch binary"), "ngram-sets")
    members, _ = staged(sets.select("rid", "doc_id", "n", "node"), "ngram-members")
    firsts = [F.any_value(c).alias(c) for c in ("n", "prefix", "sketch")]
    nodes, nodes_path = staged(sets.where("node is not null").groupBy("node").agg(F.min("rid").alias("rid"), *firsts), "ngram-nodes")
    discard(spark, sets_path)

    # one exchange: postings are counted and met where they lie; those of a shingle with very many nodes in several groups
    postings = nodes.select("node", "n", "prefix").mapInArrow(_postings(order), "token bigint, salt int, split boolean, node bigint, n int, pos int")
    dealt = postings.repartition("token", "salt")
    alike = [F.bit_xor("node").alias("s1"), F.bit_xor(F.xxhash64("node")).alias("s2")]
    heads = dealt.groupBy("token", "salt").agg(F.count("*").alias("c"), F.any_value("split").alias("split"), F.min(F.struct("pos", "n", "node")).alias("head"), *alike).where("c > 1 or split")
    # shingles of the very same nodes bring the very same pairs: one of them is enough, at no certain place
    same_nodes = heads.groupBy("c", "s1", "s2", F.when(F.col("split"), F.struct("token", "salt")).alias("alone"))
    heads = same_nodes.agg(F.min(F.struct("token", "salt", "head")).alias("one"), (F.count("*") > 1).alias("several")).select("one.*", "several")
    met = dealt.join(heads, ["token", "salt"]).select("token", "node", "n", F.when(F.col("several"), 0).otherwise(F.col("pos")).alias("pos"), F.col("head.node").alias("head"), F.col("head.n").alias("head_n"))
    met, met_path = staged(met, "ngram-met")

    def bounded(pairs: DataFrame) -> DataFrame:
        x = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
        y = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
        return pairs.join(x, "a").join(y, "b").mapInArrow(_bounded(per_cent), "a bigint, b bigint")

    def compared(pairs: DataFrame) -> tuple[DataFrame, str]:
        pairs, path = staged(pairs, "ngram-pairs")
        sizes = pairs.groupBy("a").agg(F.count("*").alias("c"))
        parts = pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / CHUNK)).alias("chunk"), F.col("b").alias("node"))
        wanted = parts.unionByName(parts.select("a", "chunk", F.col("a").alias("node")).distinct())
        # the texts of these nodes alone are dealt out, one a node, however often its row is repeated
        known, known_path = staged(wanted.select("node").distinct().join(nodes.select("node", "rid"), "node"), "ngram-known")
        texts = rows.where(membership(known, "rid")("rid")).select("rid", "text").dropDuplicates(["rid"])
        texts, texts_path = staged(texts.join(known, "rid").select("node", "text"), "ngram-texts")
        grouped = wanted.join(texts, "node").repartition("a", "chunk").sortWithinPartitions("a", "chunk")
        links, links_path = staged(grouped.mapInArrow(_compare(width, per_cent, order), "a bigint, b bigint"), "ngram-links")
        for done in (path, known_path, texts_path):
            discard(spark, done)
        return links, links_path

    stars = met.where(f"node <> head and 100 * least(n, head_n) >= {per_cent} * greatest(n, head_n)")
    links, links_path = compared(bounded(stars.select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()))
    comps, comps_path = staged(connected_components(links), "ngram-components")

    labelled = met.select("token", "node", "n", "pos").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    open_tokens = labelled.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("c")).where("low <> high")
    parts = labelled.join(open_tokens.select("token", F.ceil(F.col("c") / CHUNK).alias("k")), "token").join(nodes.select("node", "sketch"), "node")
    parts = parts.withColumn("i", F.pmod(F.xxhash64("node"), F.col("k")))
    rest = ["node", "n", "pos", "comp", "sketch"]
    same = parts.select("token", "i", F.col("i").alias("j"), F.lit(2).alias("side"), *rest)
    several = parts.where("k > 1").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).where("o <> i")
    apart = several.select("token", F.least("i", "o").alias("i"), F.greatest("i", "o").alias("j"), (F.col("i") > F.col("o")).cast("int").alias("side"), *rest)
    blocked = same.unionByName(apart).repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    more, more_path = compared(blocked.mapInArrow(_left_over(per_cent), "a bigint, b bigint").distinct())
    final, _ = staged(connected_components(links.unionByName(more)), "ngram-components")
    for done in (met_path, nodes_path, comps_path, links_path, more_path):
        discard(spark, done)
    return members, final


def jaccard_components(docs: DataFrame, *, width: int = 5, per_cent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) for every row of docs.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Sets link when 100 * intersection >= per_cent * union.
    Null texts and texts without a word have no shingle and only themselves as component. Repeated rows stay and
    belong together. Null doc_ids count as members, but never as a component's name while it has others.
    """
    members, comps = jaccard_links(docs, width=width, per_cent=per_cent)
    lowest = members.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("low"))
    named = lowest.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    names = named.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = named.join(names, "comp").select("node", "component_id")
    return members.join(named, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, *, width: int = 5, per_cent: int = 80) -> DataFrame:
    """The rows of docs without near copies: of each component, the row with the smallest doc_id (nulls last, then by
    a hash of the text). Rows that agree in doc_id and text count as copies, also those without a word: of them the
    one with the least md5 of its JSON stays. Other rows without a word all stay. Columns as in docs.

    Only rows that may be copies are shuffled; all others are told by a membership filter and stay where they are.
    """
    members, comps = jaccard_links(docs, width=width, per_cent=per_cent)
    named = members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node", "rid"))
    best = named.groupBy("comp").agg(F.count("*").alias("c"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("best"))
    groups, _ = staged(best.where("c > 1").select("comp", "best.rid"), "ngram-groups")
    suspects = named.join(groups.select("comp"), "comp", "left_semi").select("rid")
    names = docs.columns
    columns = [f"c{i}" for i in range(len(names))]
    plain = docs.toDF(*columns)
    doc_id, text = (F.lit(None) if place(names, x) is None else F.col(f"c{place(names, x)}") for x in ("doc_id", "text"))
    keyed = plain.withColumn("rid", F.xxhash64(doc_id.cast("long"), F.coalesce(text.cast("string"), F.lit(""))))
    keyed = keyed.withColumn("maybe", membership(suspects, "rid")("rid"))
    sure = keyed.where("not maybe").select(*columns)
    # rows that the filter lets through although they have no copy are alone in their component
    alone = best.where("c = 1").select("best.rid")
    kept = groups.select("rid").unionByName(alone)
    rest = keyed.where("maybe").join(kept, "rid", "left_semi")
    row = F.struct(*columns)
    rest = rest.groupBy("rid").agg(F.min_by(row, F.md5(F.to_json(row).cast("binary"))).alias("one")).select("one.*")
    return sure.unionByName(rest).toDF(*names)
