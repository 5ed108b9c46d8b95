"""Each operator against a plain version, on nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import ann, chat, licenses, mixing, ngram_join, packing, quality, secrets_crf, token_codec, tokens, toxicity
from palimpsest.llm.textbytes import blocks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = ["doc_id", "text", "c2", "c3", "c4", "c5", "c6", "c7"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, DOC_ID string, score double, n_words string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def texts():
    rng = random.Random(5)
    words = ["the", "of", "Ünïcode", "naïve", "x" * 30, "a", "été", "word", "日本", "foo,", "bar.", "!!", "#tag", "12"]
    out = [None, "", " \n\t", "one", "one two", "A b\nA b\nA b\n\nC", "a b c a b c a b c", "x\u0085y   z  \n", "\n\n"]
    base = [rng.choice(words) for _ in range(300)]
    out.append(" ".join(base))
    for k in (1, 4, 40):
        other = list(base)
        for _ in range(k):
            other[rng.randrange(300)] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(other).upper() if k == 1 else " ".join(other))
    out += [" ".join(base), 'say token = "0123456789abcdef0123456789abcdef" or passwd:abc', "AKIA" + "Z9" * 9 + " api_key=" + "q1" * 9]
    out.append(" ".join(rng.choice(words) for _ in range(30_000)))
    out += ["Released under the MIT License. And more. Licensed under the Apache License, Version 2.0"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", f"src{k % 3}", len(t or ""), "clash", 0.5, "clash") for k, t in enumerate(texts())]
    rows += [rows[9], (None, "a text without id", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, int(k % 5 == 0)) for k in range(len(texts()))] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def plain_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = {}
    for g in grams:
        counts[g] = counts.get(g, 0) + 1
    inside = {i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_quality_statistics(docs, empty, labels):
    rules = quality.learn_decision_list(docs, labels)
    got = quality.quality_report(docs, rules).collect()
    assert len(got) == docs.count()
    by_text = {r["doc_id"]: r for r in got}
    for k, t in enumerate(texts()):
        r = by_text[k]
        n, chars, symbols, dup, repeat = plain_statistics(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat), k
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert not (r.base_failed and r.kept)
    assert quality.quality_report(empty, rules).count() == 0
    assert quality.keep_good(docs, rules).columns == docs.columns


def test_decision_list_finds_planted_rules():
    rng = np.random.default_rng(0)
    x = rng.random((2000, len(quality.FEATURES)))
    bad = (x[:, 0] > 0.8) & (x[:, 3] < 0.5) | (x[:, 7] > 0.95)
    rules = quality.fit_decision_list(x, bad, rng.integers(0, 2, 2000))
    hit = np.logical_or.reduce([r.holds(x) for r in rules])
    assert (hit & bad).sum() > 0.9 * bad.sum() and (hit & ~bad).sum() < 0.05 * bad.sum()
    assert quality.fit_decision_list(x[:0], bad[:0], bad[:0]) == []


def test_verdict_follows_rules(docs):
    rule = quality.Rule((quality.Condition("chars_per_word", True, 4.0),), 1.0, 1)
    rows = quality.quality_report(docs, [rule]).collect()
    for r in rows:
        assert r.kept == (not r.base_failed and not r.word_chars / max(1, r.n_words) > 4.0)


def test_toxicity(spark, docs, empty, labels):
    rng = random.Random(1)
    rows, marks = [], []
    for k in range(400):
        said = [rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "group"]) for _ in range(rng.randrange(3, 60))]
        bad = k % 4 == 0
        if bad:
            said.insert(rng.randrange(len(said)), "insult.")
        rows.append((k, " ".join(said)))
        marks.append((k, int(bad)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    machine = toxicity.learn(d, lab, lambda c: c % 5 != 0)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(d, machine).collect()}
    held = [k for k in range(400) if k % 5 == 0]
    assert np.mean([(got[k] >= 0.5) == (k % 4 == 0) for k in held]) > 0.95
    scored = toxicity.score_toxicity(docs, machine).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.score_toxicity(empty, machine).count() == 0
    none = toxicity.learn(empty, labels)
    assert [r.score for r in toxicity.score_toxicity(docs, none).collect()] == pytest.approx([0.01] * docs.count())


@pytest.mark.parametrize("vocab", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_segment_tokenizer_is_exact(vocab):
    coder = tokens.SegmentTokenizer(tokens.vocabulary(vocab))
    odd = [t or "" for t in texts()] + ["it's 'S I'LL\tq", "İ é é", "日本 語 テスト", "a\r\nb ​ c", "Ǆ ΑΣ ΣΑΣ. Σ", "<|endoftext|> x", "\x00 y  z", "“q” w", "a' b'c 'd"]
    for a, b, data, offsets in blocks(pa.array(odd), 2000):
        ids, sizes = coder.encode(data, offsets)
        ends = np.cumsum(sizes)
        for k, text in enumerate(odd[a:b]):
            assert ids[ends[k] - sizes[k] : ends[k]].tolist() == coder.library.encode(text, add_special_tokens=False).ids


def test_codec_round_trip():
    rng = np.random.default_rng(2)
    for size, n in ((1, 5), (3, 1000), (50_000, 100_000), (7, 0)):
        ids = ((rng.zipf(1.3, n) - 1) % size).astype(np.uint32)
        coder = token_codec.Coder(token_codec.frequency_table(np.bincount(ids, minlength=size)))
        frame = coder.encode(ids)
        assert (coder.decode(frame) == ids).all()
        if n > token_codec.SEGMENT_IDS:
            assert (coder.decode(frame, 1) == ids[token_codec.SEGMENT_IDS : 2 * token_codec.SEGMENT_IDS]).all()
            assert len(frame) < 4 * n
            broken = bytearray(frame)
            broken[-5] ^= 1
            with pytest.raises(ValueError):
                coder.decode(bytes(broken))
    table = token_codec.frequency_table(np.r_[np.ones(1000), 1e12])
    assert table.sum() == 1 << token_codec.PRECISION and table.min() == 1


def test_token_file(docs, empty):
    got = token_codec.round_trip(docs).orderBy("start").collect()
    library = tokens.SegmentTokenizer(tokens.vocabulary("byte_bpe_50k.json")).library
    rows = sorted(docs.toDF(*PLAIN).collect(), key=lambda r: (r.doc_id is not None, r.doc_id, r.text or ""))
    at = 0
    for r, g in zip(rows, got, strict=True):
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [2]
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_codec.round_trip(empty).count() == 0


def test_secrets(docs, empty):
    field = secrets_crf.learn(docs)
    got = {r.doc_id: r for r in secrets_crf.scan_secrets(docs, field).collect()}
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    for k, t in enumerate(texts()):
        t = t or ""
        spans = [(m.start(), m.end(), 0) for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        spans.sort(key=lambda s: (s[0], s[2]))
        text = ",".join(f"{('assign', 'access', 'hex')[z]}:{a}:{b}" for a, b, z in spans)
        assert got[k].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) <= set(got[k].spans.split(",")) | {""}
    assert secrets_crf.scan_secrets(empty, field).count() == 0
    clean = {r[0]: r[1] for r in secrets_crf.redact(docs, field).toDF(*[f"c{i}" for i in range(8)]).select("c0", "c1").collect()}
    assert clean[0] is None and clean[1] == "" and "0123456789abcdef" not in clean[14]


def test_field_decodes_like_enumeration():
    rng = np.random.default_rng(3)
    field = secrets_crf.Field(rng.normal(size=(secrets_crf.N_FEATURES, 3)), rng.normal(size=(3, 3)))
    line = np.array([0, 0, 0, 1, 2, 2, 2, 2])
    scores = rng.normal(size=(8, 3)) * 3
    tags = field.decode(line, scores)
    import itertools

    for chain in range(3):
        at = np.flatnonzero(line == chain)

        def worth(path, at=at):
            if path[0] == 2 or any(not secrets_crf.ALLOWED[a, b] for a, b in itertools.pairwise(path)):
                return -math.inf
            return sum(scores[i, t] for i, t in zip(at, path, strict=True)) + sum(field.moves[a, b] for a, b in itertools.pairwise(path))

        assert tuple(tags[at]) == max(itertools.product(range(3), repeat=len(at)), key=worth)


@pytest.mark.parametrize(("width", "per_cent"), [(3, 90), (5, 80)])
def test_ngram_join(docs, empty, width, per_cent):
    got = ngram_join.jaccard_components(docs, width=width, per_cent=per_cent).collect()
    assert len(got) == docs.count()
    sets = {}
    for k, t in enumerate(texts()):
        w = WORD.findall(lower(t or ""))
        sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}
    comp = {k: k for k in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= per_cent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), root(r.doc_id))
    assert ngram_join.jaccard_components(empty, width=width, per_cent=per_cent).count() == 0


def test_keep_one(docs):
    kept = [r[0] for r in ngram_join.keep_one(docs).toDF(*[f"c{i}" for i in range(8)]).select("c0").collect()]
    assert sorted(k for k in kept if k is not None) == sorted({r.component_id for r in ngram_join.jaccard_components(docs).collect() if r.doc_id is not None})
    assert kept.count(None) == 1


def test_trie_matches_pairs():
    rng = np.random.default_rng(4)
    order = rng.permutation(400).astype(np.uint64)
    sets = []
    for _ in range(60):
        base = rng.choice(400, 50, replace=False) if not sets or rng.random() < 0.2 else np.array(sorted(sets[-1][1]))
        keep = rng.random(len(base)) > 0.05
        own = set(base[keep].tolist()) or {1}
        sets.append((order[sorted(own, key=lambda x: order[x])], own))
    trie = ngram_join.Trie([s for s, _ in sets])
    for s, own in sets:
        want = [k for k, (_, o) in enumerate(sets) if 100 * len(own & o) >= 80 * len(own | o)]
        assert sorted(trie.linked(s, 80)) == want


def test_bounds_never_drop_a_link():
    rng = np.random.default_rng(6)
    for _ in range(200):
        a = rng.integers(0, 1 << 60, rng.integers(1, 300)).astype(np.uint64)
        b = np.concatenate([a[rng.random(len(a)) < 0.97], rng.integers(0, 1 << 60, rng.integers(0, 10)).astype(np.uint64)])
        both, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if both and 100 * both >= 80 * union:
            assert ngram_join.may_link(ngram_join.parity_sketch(a), len(a), ngram_join.parity_sketch(b), len(b), 80)


def test_nearest(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[50:80] = x[50]
    rows = [(k, [float(v) for v in x[k]], 1) for k in range(300)]
    rows += [(300, None, 1), (301, [0.0] * 8, 1), (302, [None] + [1.0] * 7, 1), (303, [float("nan")] * 8, 1), (304, [float("inf")] * 8, 1), (None, [1.0] * 8, 1), rows[7]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in ann.nearest(table, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    wide = x.astype(float)
    assert set(got) == set(range(0, 300, 20))
    for q, found in got.items():
        score = wide @ wide[q]
        want = [k for k in np.lexsort((np.arange(300), -np.round(score, 12))) if k != q][:20]
        assert [k for k, _ in found] == want
        assert np.allclose([s for _, s in found], score[want], rtol=1e-12)
    few = ann.nearest(table.where("vec_id < 5"), F.col("vec_id") == 0, 20)
    assert few.count() == 4
    assert ann.nearest(table.where("vec_id < 0"), F.col("vec_id") == 0, 20).count() == 0


def test_mixing_redistributes_among_siblings_first(spark):
    rows = [(k, "w " * 10, "a" if k < 60 else "b", f"s{k % 3}" if k < 60 else "t") for k in range(90)] + [(None, None, None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    weights = spark.createDataFrame([("a", 1), ("b", 1), ("a/s0", 8)], "path string, weight long")
    levels = {"lang": lambda c: c["lang"], "source": lambda c: c["source"]}
    got = mixing.mixed(table, levels, weights, fraction=0.6, most_epochs=1).collect()
    used = {}
    for r in got:
        used[r.c2, r.c3] = used.get((r.c2, r.c3), 0) + r.tokens
    # 540 tokens: a and b get 270 each; a/s0 holds 200 of its 8/10, what it can't use goes to its siblings
    assert used[("a", "s0")] == 200 and used[("b", "t")] == 270
    assert used[("a", "s1")] + used[("a", "s2")] == 60
    again = mixing.mixed(table, levels, weights, fraction=0.6, most_epochs=1).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(table.where("false"), levels, weights).count() == 0


def test_chat_collapse(spark):
    turns = []
    for conv, said in {1: ["a", "b"], 2: ["a", "b", "c", "d"], 3: ["a", "x"], 4: ["a", "b", "c", "d"], 5: ["z"], 6: ["a"]}.items():
        turns += [(conv, k, "user" if k % 2 == 0 else "bot", t, "clash") for k, t in enumerate(said)]
    turns += [(7, 0, None, None, None), (None, 0, "user", "lost", None), turns[0]]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, n_turns string")
    got = {r.conv_id: r for r in chat.render_chat(table).collect()}
    assert set(got) == {2, 3, 5, 7}
    assert got[2].n_logged == 2 and got[2].n_turns == 4
    assert got[3].chat == "<|user|>\na\n<|bot|>\nx\n"
    assert chat.render_chat(table.where("false")).count() == 0


def test_packing(docs, empty):
    library = tokens.SegmentTokenizer(tokens.vocabulary("word_bpe_49k.json")).library
    got = packing.pack_along_curve(docs).collect()
    want = sorted((r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in docs.toDF(*PLAIN).collect() if r.doc_id is not None)
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    for doc_id, ids in dict(want).items():
        copies = sum(d == doc_id for d, _ in want)
        assert sum(p.length for p in pieces[doc_id]) == copies * len(ids)
        for p in pieces[doc_id]:
            assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    runs = {}
    for r in got:
        runs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in runs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0  # nothing is padded
    assert packing.pack_along_curve(empty).count() == 0


def test_hilbert_key_walks_the_grid():
    side = np.arange(8)
    cells = np.stack(np.meshgrid(side, side, side), axis=-1).reshape(-1, 3)
    key = packing.hilbert_key(cells, 3)
    assert sorted(key) == list(range(512))
    walk = cells[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_licenses(docs, empty):
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(docs).collect()}
    last = len(texts()) - 1
    assert [(x.license, x.coverage) for x in got[last]] == [("MIT", 1.0), ("Apache-2.0", 1.0)]
    assert texts()[last][got[last][0].start : got[last][0].end] == "Released under the MIT License"
    assert all(not x for k, x in got.items() if k != last)
    assert licenses.scan_licenses(empty).count() == 0


def test_alignment_matches_full_table():
    rng = random.Random(8)
    for _ in range(60):
        t = [rng.randrange(6) for _ in range(rng.randrange(3, 14))]
        x = [v for v in t if rng.random() > 0.2]
        for _ in range(rng.randrange(3)):
            x.insert(rng.randrange(len(x) + 1), rng.randrange(6))
        best = [[0] * (len(x) + 1) for _ in range(len(t) + 1)]
        for i in range(len(t)):
            for j in range(len(x)):
                best[i + 1][j + 1] = best[i][j] + 1 if t[i] == x[j] else max(best[i][j + 1], best[i + 1][j])
        n, first, last = licenses.align(np.array(t), np.array(x), 0, band=20)
        assert n == best[-1][-1]
        assert n == 0 or 0 <= first <= last < len(x)


def pair_only(count, seed):
    """Texts that are toxic if they hold both of two words or neither; either word alone says nothing."""
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnr"]
    rows = []
    for k in range(count):
        said = [rng.choice(words) for _ in range(rng.randrange(5, 40))]
        one, two = rng.random() < 0.5, rng.random() < 0.5
        for word in ["zorgon"] * one + ["qwark"] * two:
            said.insert(rng.randrange(len(said)), word)
        rows.append((k, " ".join(said), int(one == two)))
    return rows


def test_toxicity_learns_a_pure_pair(spark):
    table = spark.createDataFrame(pair_only(2000, 1), "doc_id long, text string, toxic int")
    machine = toxicity.learn(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    held = pair_only(400, 2)
    scored = toxicity.score_toxicity(spark.createDataFrame(held, "doc_id long, text string, toxic int"), machine)
    got = {r.doc_id: r.score for r in scored.collect()}
    assert np.mean([(got[k] >= 0.5) == y for k, _, y in held]) > 0.95


def test_logits_are_the_double_sum():
    rng = np.random.default_rng(9)
    machine = toxicity.FactorizationMachine(8, np.arange(0, 256, 3), 0.3, rng.normal(size=86), rng.normal(size=(86, 4)))
    place = np.full(256, -1, np.int32)
    place[machine.slots] = np.arange(86)
    said = ["a bb ccc dddd eeeee", "", "bb bb x", "lone"]
    ((_, _, data, offsets),) = blocks(pa.array(said))
    slots, row, words = toxicity.block_terms(data, offsets, 8)
    got = machine.logits(*toxicity._known(slots, row, place), words)
    for r in range(len(said)):
        terms = [int(place[s]) for s in slots[:, row == r].ravel() if place[s] >= 0]
        x = {k: 1 + math.log(terms.count(k)) for k in terms}
        n = max(1, len(said[r].split())) ** toxicity.DAMPING
        pairs = sum(machine.factors[a] @ machine.factors[b] * x[a] * x[b] for a in x for b in x if a < b)
        assert got[r] == pytest.approx(machine.bias + sum(machine.weights[k] * v for k, v in x.items()) / n + pairs / n**2)


def test_mixing_with_clashing_columns_repeats_and_ties(spark):
    rows = [(k % 40, "w " * (3 + k % 2), "a", "s", "clash", "clash", 1) for k in range(80)] + [(40, "w " * 50_000, None, "s", None, None, None), (41, "", "b", None, None, None, None), (42, None, None, None, None, None, None)]
    names = ["doc_id", "text", "lang", "source", "DOC_ID", "__tokens", "epoch"]
    table = spark.createDataFrame(rows, "c0 long, c1 string, c2 string, c3 string, c4 string, c5 string, c6 int").toDF(*names)
    levels = {"lang": lambda c: c["lang"], "source": lambda c: c["source"]}
    weights = spark.createDataFrame([("a", 2)], "path string, weight long")
    out = mixing.mix(table, levels, weights, fraction=0.7)
    assert out.columns == names
    times = {}
    for r in mixing.mixed(table, levels, weights, fraction=0.7).collect():
        times.setdefault((r.c0, r.c1), []).append(r.epoch)
    total = sum(len((t or "").split()) * len(e) for (_, t), e in times.items())
    assert total <= 0.7 * sum(len((r[1] or "").split()) for r in rows)
    for (k, _), epochs in times.items():  # repeated rows stand or fall together
        assert sorted(epochs) == sorted([*range(1, max(epochs) + 1)] * (2 if k < 40 else 1)) or k < 40
    assert out.count() == sum(map(len, times.values()))


def test_nearest_with_extreme_lengths_and_repeats(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(60, 4))
    x[5:10] *= 1e200
    x[10:15] *= 1e-310
    x[15] = [5e-324, 0, 0, 0]
    rows = [(k, [float(v) for v in x[k]]) for k in range(60)] + [(-1, [1.0, 2.0]), (0, [float(v) for v in 2 * x[0]]), (7, [float(v) for v in x[3]]), (3, [float(v) for v in x[3]])]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 5 == 0, 6).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    have = sorted({(k, tuple(v)) for k, v in rows if len(v) == 4})
    assert set(got) == set(range(0, 60, 5))
    for q, found in got.items():
        own = min(v for k, v in have if k == q)
        all_of = [(float(ann.products(np.array([own]), np.array([v]))[0]), k) for k, v in have if (k, v) != (q, own)]
        assert found == [(k, s) for s, k in sorted(all_of, key=lambda z: (-z[0], z[1]))[:6]]
    assert all(np.isfinite(s) or abs(s) == np.inf for f in got.values() for _, s in f)


def thue_morse():
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_fool_polynomial_hashes(spark):
    one, two = thue_morse()
    said = [one, two, f"{one}\n{two}\n{one}", f"x {two} y", f"x {one} y"]
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string").coalesce(1)
    rows = {r.doc_id: r for r in ngram_join.jaccard_components(docs, width=3, per_cent=90).collect()}
    assert [rows[k].component_id for k in range(5)] == [0, 1, 2, 3, 4]
    assert {r.doc_id: r.n_dup_lines for r in quality.quality_report(docs, []).collect()} == {0: 0, 1: 0, 2: 1, 3: 0, 4: 0}
    for vocab, end, call in (("byte_bpe_50k.json", 2, token_codec.round_trip), ("word_bpe_49k.json", 1, packing.pack_along_curve)):
        library = tokens.SegmentTokenizer(tokens.vocabulary(vocab)).library
        for r in call(docs).collect():
            ids = library.encode(said[r.doc_id], add_special_tokens=False).ids + [end]
            if call is packing.pack_along_curve:
                ids = ids[r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_brings_like_documents_together(spark):
    rng = random.Random(13)
    topics = [[f"{c}{rng.randrange(10**6)}" for _ in range(40)] for c in "abcdefgh"]
    rows = [(k, " ".join(rng.choices(topics[k % 8], k=120))) for k in range(240)]
    runs = {}
    for r in packing.pack_along_curve(spark.createDataFrame(rows, "doc_id long, text string"), most=2048).collect():
        runs.setdefault(r.sequence_id, []).append(r.doc_id % 8)
    pairs = [a == b for own in runs.values() for i, a in enumerate(own) for b in own[:i]]
    assert np.mean(pairs) > 3 / 8  # in random order one in eight


def test_field_finds_what_no_pattern_finds(spark):
    rng = random.Random(14)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "consectetur", "día", "größe", "adipiscing", "elit"]
    lines = [" ".join(rng.choices(words, k=rng.randrange(4, 14))) for _ in range(600)]
    lines += [f'{x} token = "{rng.getrandbits(160):040x}" {x}' for x in lines[:60]]
    field = secrets_crf.fit_lines(lines)
    rng, hits, false, n = random.Random(15), 0, 0, 300
    said, spans = [], []
    for _ in range(n):
        head, value = " ".join(rng.choices(words, k=rng.randrange(1, 9))) + " ", secrets_crf.planted_secret(rng)
        said.append(f"{head}{value} {rng.choice(words)} {secrets_crf.planted_decoy(rng)}")
        spans.append((len(head), len(head) + len(value)))
    k = 0
    for _, _, data, offsets in blocks(pa.array(said)):
        for _, found in secrets_crf.block_secrets(field, data, offsets):
            mine = [(s, e) for s, e, kind in found if kind == "field"]
            hits += any(s <= spans[k][0] and spans[k][1] <= e for s, e in mine)
            false += any(e <= spans[k][0] or spans[k][1] <= s for s, e in mine)
            k += 1
    assert hits > 0.7 * n and false < 0.05 * n, (hits, false)


def test_license_scan_matches_a_plain_search(spark):
    """Every template, whole and with a word lost, between other words; each against alignment with all templates."""
    rng = random.Random(16)
    filler = ["and", "then", "some", "words", "of", "no", "license"]
    said, want = [], []
    for name, template in {**licenses.TEMPLATES, "tiny": "Beerware Licence", "lone": "Copyleftish"}.items():
        words = template.split(" ")
        for lost in (None, len(words) // 2):
            own = [w for k, w in enumerate(words) if k != lost]
            if lost is not None and len(words) < 6:
                continue
            said.append(" ".join([*rng.choices(filler, k=9), *own, *rng.choices(filler, k=9)]))
            want.append(name)
    said += ["", None, " ".join(filler * 40)]
    templates = {**licenses.TEMPLATES, "tiny": "Beerware Licence", "lone": "Copyleftish"}
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string"), templates).collect()}

    def tokens_of(text):
        return [w.lower() for w in re.findall(r"[^\s!-/:-@\[-`{-~]+", text or "")]

    def share(template, text):
        t, x = tokens_of(template), tokens_of(text)
        best = [[0] * (len(x) + 1) for _ in range(len(t) + 1)]
        for i in range(len(t)):
            for j in range(len(x)):
                best[i + 1][j + 1] = best[i][j] + 1 if t[i] == x[j] else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1] / len(t)

    for k, name in enumerate(want):
        assert name in [x.license for x in got[k]], (name, got[k])
        for x in got[k]:
            assert share(templates[x.license], said[k][x.start : x.end]) == pytest.approx(x.coverage)
    assert all(not got[k] for k in range(len(want), len(said)))
