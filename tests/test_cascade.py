"""Derived nodes, incremental state, intents, gates and the redo log on small hand-made stores."""

import math
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.operators import cascade as c
from palimpsest.operators import intents as i
from palimpsest.operators import maintenance as m
from palimpsest.operators import retrieval as r
from palimpsest.operators import temporal as t
from palimpsest.sources.shared import staged

A = "id string, subject_id string, predicate string, object_value string, recorded_seq long, valid_from long, valid_to long"
R = "source_assertion_id string, relation string, target_assertion_id string, rel_seq long"
ROWS = [("a1", "s", "deadline", "10", 1, None, None), ("a2", "s", "value", "x", 2, None, None), ("a3", "q", "deadline", "7", 3, None, None)]
TEXTS = [("e1", "launch project-x", 1), ("e2", "alpha beta", 2), ("e3", "gamma", 3)]


@pytest.fixture(scope="module")
def registry(spark):
    return spark.createDataFrame([("deadline", "single"), ("value", "single"), ("works_at", "multi")], "predicate string, cardinality string")


def store(spark, rows=ROWS, texts=TEXTS, rels=()):
    return {
        "assertions": spark.createDataFrame(rows, A),
        "bridge": spark.createDataFrame([(x[0], "e" + x[0][1:]) for x in rows], "assertion_id string, evidence_id string"),
        "evidence": spark.createDataFrame(texts, "id string, payload string, recorded_seq long"),
        "relations": spark.createDataFrame(list(rels), R),
    }


def stale(before, after):
    return {x.node for x in c.stale_nodes(before, after).collect()}


def chain(key):
    return {f"{kind}:{key}" for kind in ("state", "support", "context")}


def test_a_value_leaves_the_profile_fresh_and_a_text_the_state(spark):
    base = store(spark)
    value = [("a1", "s", "deadline", "11", 1, None, None), *ROWS[1:]]
    assert stale(base, store(spark, value)) == chain("s:deadline")
    text = [("e1", "launch moved", 1), *TEXTS[1:]]
    assert stale(base, store(spark, texts=text)) == {"profile:s", "support:s:deadline", "context:s:deadline"}
    move = [("a1", "z", "deadline", "10", 1, None, None), *ROWS[1:]]
    assert stale(base, store(spark, move)) == {"profile:s", "profile:z"} | chain("s:deadline") | chain("z:deadline")
    assert stale(base, store(spark)) == set()


def test_refresh_equals_full_rebuild_and_retires(spark, registry):
    base, gone = store(spark), store(spark, ROWS[:2])
    changed = staged(c.stale_nodes(base, gone), "stale")
    nodes, retired = c.refreshed(staged(c.node_values(base, registry), "nodes"), changed, gone, registry)
    nodes, full = staged(nodes, "nodes"), c.node_values(gone, registry)
    assert sorted(map(tuple, full.collect())) == sorted(map(tuple, nodes.collect()))
    assert {x.node for x in retired.collect()} == {"profile:q"} | chain("q:deadline")
    with pytest.raises(RuntimeError):
        c.read_contexts(nodes, changed, spark.createDataFrame([("context:q:deadline",)], "node string"))
    assert c.read_contexts(nodes, changed, spark.createDataFrame([("context:s:value",)], "node string")).count() == 1


def test_nodes_that_others_need_stay(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "source_node string, derived_node string")
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    assert {x.node: x.refused for x in c.remove(edges, asked.where("node <> 'c'")).collect()} == {"a": False, "b": True}
    assert not any(x.refused for x in c.remove(edges, asked).collect())
    again = c.register(edges, spark.createDataFrame([("x", "c")], "source_node string, derived_node string"))
    assert {tuple(x) for x in again.collect()} == {("a", "b"), ("x", "c")}


@pytest.mark.parametrize(
    ("old", "new", "rels", "path"),
    [
        ([], [("a1", "10")], [], "new"),
        ([("a1", "10")], [("a2", "12")], [("a2", "corrects", "a1")], "replaced"),
        ([("a1", "10")], [("a2", "10")], [], "same"),
        ([("a1", "10")], [("a2", "12")], [], "conflict"),
        ([("a1", "10"), ("a2", "12")], [("a3", "13")], [("a3", "supersedes", "a1")], "fallback"),
        ([("a1", "10")], [("a2", "12"), ("a3", "13")], [], "fallback"),
    ],
)
def test_short_paths_give_what_reconciliation_gives(spark, registry, old, new, rels, path):
    def rows(pairs):
        return spark.createDataFrame([(k, "s", "value", v, int(k[1:]), None, None) for k, v in pairs], A)

    links = spark.createDataFrame([(*x, n) for n, x in enumerate(rels)], R)
    kept = t.reconcile(rows(old), links, registry).withColumn("version", F.lit(1))
    (got,) = t.incremental(kept, rows(old), rows(new), links, registry).collect()
    (want,) = t.reconcile(rows(old + new), links, registry).collect()
    assert (got.status, got.operative, got.path, got.version) == (want.status, want.operative, path, 2 if old else 1)


def test_unknown_predicates_are_reported(spark, registry):
    (got,) = t.reconcile(spark.createDataFrame([("a1", "s", "colour", "red", 1, None, None)], A), spark.createDataFrame([], R), registry).collect()
    assert (got.status, got.operative) == ("unregistered", [])


def test_context_lines(spark, registry):
    rows = [("a1", "s", "value", "10", 1, None, None), ("a2", "s", "value", "12", 2, None, None)]
    base = store(spark, rows)
    parts = t.support(base["assertions"], base["relations"], registry)
    lines = t.context_lines(t.reconcile(base["assertions"], base["relations"], registry), parts, base["assertions"], base["bridge"], base["evidence"]).orderBy("section", "place").collect()
    assert [x.line for x in lines] == [
        "ENTITY: s", "PROPERTY: value", "CURRENT STATUS: contested", "- a1: '10'", "- a2: '12'", "- seq=1 a1: '10'", "- seq=2 a2: '12'", "- e1: launch project-x", "- e2: alpha beta",
    ]


def test_hard_filter_with_parts_missing(spark):
    base = store(spark)
    docs = r.assembled(spark.createDataFrame([*TEXTS, ("e9", "lone", 9)], "id string, payload string, recorded_seq long"), base["bridge"], base["assertions"])
    assert {x.id: x.subjects for x in docs.collect()} == {"e1": ["s"], "e2": ["s"], "e3": ["q"], "e9": []}
    asked = [(1, "s", None, None, None), (2, None, "deadline", None, None), (3, "s", "deadline", 5, None), (4, "q", None, None, 2), (5, None, None, None, None)]
    q = spark.createDataFrame(asked, "query_id long, subject_id string, predicate string, valid_time long, known_by long")
    got = {(x.query_id, x.id) for x in r.hard_filter(q, docs).collect()}
    assert got == {(1, "e1"), (1, "e2"), (2, "e1"), (2, "e3"), (3, "e1")}


def test_search_refuses_unknown_modes(spark):
    with pytest.raises(ValueError):
        r.search("psychic", {}, 5)


def test_subjects_with_stop_words_ties_and_predicates(spark):
    profiles = spark.createDataFrame([("s", "alpha", 1), ("q", "alpha", 1), ("q", "beta", 2)], "subject_id string, token string, tf long")
    allowed = spark.createDataFrame([("deadline", "s")], "predicate string, subject_id string")
    n = spark.createDataFrame([(2,)], "n long")
    asked = spark.createDataFrame([(1, "what is alpha", None), (2, "the beta of alpha", None), (3, "alpha", "deadline"), (4, "what is the", None)], "query_id long, question string, predicate string")
    got = {x.query_id: (x.subject_id, x.n_tied) for x in r.plan_subjects(asked, profiles, allowed, n).collect()}
    assert got == {1: (None, 2), 2: ("q", 1), 3: ("s", 1), 4: (None, 0)}


@pytest.mark.parametrize("spread", [0, 1, 10**9])
def test_subjects_are_those_of_scoring_all_however_common_the_words(spark, spread):
    dice = random.Random(5)
    names = [f"u{k}" for k in range(12)]
    held = {(s, w): dice.randint(1, 2) for s in names for w in ("moved", "late", "revised") if dice.random() < 0.7}
    held |= {(s, f"n{k}"): 1 for k, s in enumerate(names)} | {("u1", "n0"): 3, ("u5", "n4"): 1}
    carried = {(p, s) for p in ("deadline", "value") for s in names if dice.random() < 0.6}
    asked = [(k, " ".join(dice.choices(["moved", "late", "revised", "the", *[f"n{j}" for j in range(13)]], k=dice.randint(1, 4))), dice.choice(["deadline", "value", None])) for k in range(80)]
    df = {w: sum(x == w for _, x in held) for _, w in held}
    want = {}
    for k, text, p in asked:
        score = {}
        for w in text.split():
            for s in names:
                if (s, w) in held and (p is None or (p, s) in carried):
                    score[s] = score.get(s, 0.0) + (math.log((1 + len(names)) / (1 + df[w])) + 1) * (1 + math.log(held[s, w]))
        best = max(score.values(), default=0.0)
        near = [s for s in score if best - score[s] <= 1e-9]
        second = max((v for s, v in score.items() if [s] != near), default=0.0)
        want[k] = (near[0], 1, round((best - second) / best, 6)) if len(near) == 1 else (None, len(near), 0.0)
    profiles = spark.createDataFrame([(s, w, tf) for (s, w), tf in held.items()], "subject_id string, token string, tf long")
    allowed = spark.createDataFrame(sorted(carried), "predicate string, subject_id string")
    q = spark.createDataFrame(asked, "query_id long, question string, predicate string")
    got = r.plan_subjects(q, profiles, allowed, spark.createDataFrame([(len(names),)], "n long"), spread).collect()
    assert {x.query_id: (x.subject_id, x.n_tied, round(x.confidence, 6)) for x in got} == want
    assert {n for _, n, _ in want.values()} >= {0, 1, 2}


def test_questions_of_one_class_keep_their_own_limits(spark):
    rows = [("a1", "s", "deadline", "1", 1, 1, 5), ("a2", "s", "deadline", "2", 2, 4, None), ("a3", "s", "deadline", "3", 3, None, None), ("a4", "q", "deadline", "4", 4, None, None)]
    base = store(spark, rows, [("e1", "alpha beta", 1), ("e2", "alpha", 2), ("e3", "gamma", 3), ("e4", "alpha", 4)])
    asked = [(1, "alpha", "s", "deadline", None, None), (2, "alpha zeta", "s", "deadline", None, 2), (3, "alpha", "s", "deadline", 2, None), (4, "alpha", "q", "deadline", None, None), (5, "zeta", "s", "deadline", None, None)]
    q = spark.createDataFrame(asked, "query_id long, question string, subject_id string, predicate string, valid_time long, known_by long")
    words = tx.terms(tx.tokens(F.col("payload"))), tx.terms(tx.tokens(F.col("question")))
    channel = r.channel(base["evidence"], q, *words, base["evidence"].agg(F.count("*").alias("n")))
    docs = r.assembled(base["evidence"], base["bridge"], base["assertions"])
    got = {}
    for x in sorted(r.planned_search(q, docs, [channel, channel], 2).collect(), key=lambda x: (x.query_id, x.rank)):
        got.setdefault(x.query_id, []).append((x.id, x.score > 0))
    assert got == {1: [("e2", True), ("e1", True)], 2: [("e2", True), ("e1", True)], 3: [("e1", True), ("e3", False)], 4: [("e4", True)], 5: [("e3", False), ("e2", False)]}


def test_equal_noisy_questions_are_looked_up_once(spark, monkeypatch):
    profiles = spark.createDataFrame([("c1", "client-abcdef", 1), ("c2", "client-abcxyz", 1)], "subject_id string, token string, tf long")
    asked = [(1, "who is client-abcdef"), (2, "client-abcde"), (3, "client-abcde"), (4, None), (5, "the"), (6, "qqqqqq")]
    seen = []
    monkeypatch.setattr(r, "staged", lambda df, name: seen.append((name, df.select("query_id").distinct().count())) or df)
    q = spark.createDataFrame(asked, "query_id long, question string")
    got = {x.query_id: (x.subject_id, x.n_tied, x.n_candidates) for x in r.noisy_subjects(q, profiles, spark.createDataFrame([(2,)], "n long")).collect()}
    assert got == {1: ("c1", 1, 1), 2: ("c1", 1, 2), 3: ("c1", 1, 2), 4: (None, 0, 0), 5: (None, 0, 0), 6: (None, 0, 0)}
    assert seen == [("candidates", 2)]


def test_gate_holds_only_protected_keys(spark):
    keys = spark.createDataFrame([(1, "s|deadline"), (2, "q|value")], "seq long, read_key string")
    phases = spark.createDataFrame([(1, "invalidated"), (2, "prepared")], "seq long, phase string")
    reads = spark.createDataFrame([(1, "s|deadline"), (2, "q|value"), (3, "z|value")], "query_id long, read_key string")
    assert {x.query_id: x.blocked for x in i.gate(reads, keys, phases).collect()} == {1: True, 2: False, 3: False}


@pytest.mark.parametrize("lost", i.PHASES[1:])
def test_redo_log_takes_up_where_it_was_lost(spark, tmp_path, lost):
    log, done = i.RedoLog(spark, str(tmp_path / "log")), []
    log.prepare(7)

    def step(name, fails):
        def run():
            done.append(name)
            if fails:
                raise OSError("lost")

        return run

    with pytest.raises(OSError):
        log.run({name: step(name, name == lost) for name in i.PHASES[1:]})
    with pytest.raises(RuntimeError):
        log.prepare(8)
    again = i.RedoLog(spark, str(tmp_path / "log"))
    again.run({name: step(name, False) for name in i.PHASES[1:]})
    assert again.phase() == (7, "finalized") and not again.in_flight()
    assert done == [*i.PHASES[1 : i.PHASES.index(lost) + 1], *i.PHASES[i.PHASES.index(lost) :]]
    again.prepare(8)


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "assertions")
    spark.createDataFrame(ROWS, A).write.parquet(path)
    plan = spark.read.parquet(path).where("recorded_seq > 1").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(recorded_seq,1)" in plan and "object_value" not in plan


def optimized(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def two_stores(spark):
    """Texts that share words, pieces and grams; a move, a lost assertion, a revised and a lost text, a text without
    an assertion."""
    rows = [(f"a{k}", f"s{k % 4}", ("deadline", "value")[k % 3 % 2], str(k), k, None, None) for k in range(12)]
    texts = [(f"e{k}", f"launch-pad launch alpha{k % 3} due", k) for k in range(13)]
    before = store(spark, rows, texts)
    moved = [("a5", "s9", *x[2:]) if x[0] == "a5" else x for x in rows if x[0] != "a6"]
    revised = [(x[0], x[1] + " launch revised" if x[0] == "e7" else x[1], x[2]) for x in texts if x[0] != "e8"]
    after = before | {"assertions": spark.createDataFrame(moved, A), "evidence": spark.createDataFrame(revised, "id string, payload string, recorded_seq long")}
    return before, after


def test_one_index_of_both_stores_is_the_two_indexes(spark):
    before, after = two_stores(spark)
    old, new = ({tuple(x) for x in c.address_index(s).collect()} for s in (before, after))
    subjects = staged(c.affected_subjects(before, after), "subjects")
    assert {x.subject_id for x in subjects.collect()} == {"s0", "s1", "s2", "s3", "s9"}
    patch = c.index_patch(before, after, subjects)
    assert optimized(patch).count("regexp_extract_all") <= 2  # texts are split once for tokens, not once a structure and store
    got = patch.collect()
    assert {tuple(x)[:3] for x in got if x.change == 1} == new - old
    assert {tuple(x)[:3] for x in got if x.change == -1} == old - new
    assert len(got) == len(new ^ old)


def test_parity_tells_subjects_that_the_patch_forgot(spark):
    before, after = two_stores(spark)
    old, new = ({tuple(x) for x in c.address_index(s).collect()} for s in (before, after))
    some = spark.createDataFrame([("s1",), ("s9",)], "subject_id string")
    got = {x.structure: (x.n_entries, x.n_different) for x in c.patched_parity(before, after, some).collect()}
    want = {k: (sum(x[0] == k for x in new), sum(x[0] == k and x[1] not in ("s1", "s9") for x in new ^ old)) for k in c.STRUCTURES}
    assert got == want and any(n for _, n in got.values())


def test_nodes_are_judged_once(spark, registry):
    before, after = two_stores(spark)
    links = spark.createDataFrame([("a4", "corrects", "a0", 1), ("a8", "supersedes", "a4", 2)], R)
    before, after = before | {"relations": links}, after | {"relations": links}
    changed = staged(c.stale_nodes(before, after), "stale")
    full, part = c.node_values(after, registry), c.node_values(after, registry, changed)
    for frame in (full, part):
        assert "source_assertion_id" not in optimized(frame)  # relations are joined once, not once a part
    names = {x.node for x in changed.collect()}
    assert {tuple(x) for x in part.collect()} == {tuple(x) for x in full.collect() if x.node in names}


def test_words_are_read_once(spark):
    said = spark.createDataFrame([("Vendor-x slipped, released LATE",), ("one",), ("",), (None,)], "text string")
    got = said.select(tx.terms(tx.tokens(F.col("text"))).alias("w"), tx.terms(tx.concepts(F.col("text"))).alias("c"))
    assert optimized(got).count("regexp_extract_all") == 2  # as it was, once for each time that terms names the words
    assert [(x.w, x.c) for x in got.collect()] == [
        (["vendor-x", "slipped", "released", "late", "vendor-x slipped", "slipped released", "released late"], ["delay", "release", "delay", "delay release", "release delay"]),
        (["one"], ["one"]), ([], []), ([], []),
    ]


def test_scores_of_both_channels_are_those_of_each(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["launch", "late", "vendor-x", "due", "of", "alpha", "beta"], k=rng.randrange(9))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    asked = spark.createDataFrame([(1, "late launch of alpha"), (2, "vendor-x gamma"), (3, ""), (4, "due due beta")], "query_id long, text string")
    n, split = docs.agg(F.count("*").alias("n")), {"c": tx.terms(tx.concepts(F.col("text"))), "l": tx.terms(tx.tokens(F.col("text")))}
    scores = r.channel_scores(docs, asked, {k: (x, x) for k, x in split.items()}, n)
    assert "regexp_extract_all" not in optimized(scores)  # texts end with the staged weights
    rows = scores.collect()
    for name, words in split.items():
        weights, vectors = r.channel(docs, asked, words, words, n)
        want = {(x.query_id, x.id): x.score for x in r.cosine(vectors, weights).collect()}
        got = {(x.query_id, x.id): x[name] for x in rows if x[name] is not None}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1.5e-6 for k in want)


def test_questions_as_of_reconcile_as_each_alone(spark, registry):
    rng = random.Random(3)
    rows = [(f"a{k}", f"s{k % 2}", ("value", "works_at", "lost")[k % 3], str(rng.randrange(3)), k // 2, rng.choice([None, 0, 3]), rng.choice([None, 4, 9])) for k in range(40)]
    links = [(f"a{a}", rng.choice(["corrects", "supersedes", "refines"]), f"a{b}", n) for n, (a, b) in enumerate((rng.randrange(40), rng.randrange(40)) for _ in range(60))]
    asked = [(n, f"s{n % 3}", ("value", "works_at", "lost")[n // 2 % 3], rng.choice([None, 1, 3, 8]), rng.choice([None, 4, 12])) for n in range(40)]
    a, rel = spark.createDataFrame(rows, A), spark.createDataFrame(links, R)
    q = spark.createDataFrame(asked, "query_id long, subject_id string, predicate string, valid_time long, known_by long")
    got = t.reconcile_as_of(q, a, rel, registry)
    want = t.reconcile(t.as_of(q, a), rel, registry, ["query_id"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert optimized(got).count("Join") < optimized(want).count("Join")


def test_places_of_edges_grow_with_the_table(spark, monkeypatch):
    base = store(spark)
    want = sorted(map(tuple, m.dependency_edges(base["assertions"], base["bridge"]).collect()))
    assert len(want) == len(set(want)) == 3 * 6
    monkeypatch.setattr(m, "ASSERTIONS_A_PLACE", 1)
    edges = m.dependency_edges(base["assertions"], base["bridge"])
    assert edges.rdd.getNumPartitions() == 4  # one an assertion, and one; not merged again
    assert sorted(map(tuple, edges.collect())) == want
