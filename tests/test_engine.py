"""The reference scenarios with their expected answers, and every query against its SQL on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.operators import maintenance as m
from palimpsest.operators import temporal as t
from palimpsest.plans import catalog
from palimpsest.sources.shared import SnapshotTable
from palimpsest.streaming import heads

SF = "/root/testdata/sf0.001"
A = "id string, subject_id string, predicate string, object_value string, recorded_seq long, valid_from long, valid_to long"
R = "source_assertion_id string, relation string, target_assertion_id string, rel_seq long"


@pytest.fixture(scope="module")
def registry(spark):
    return spark.createDataFrame([("deadline", "single"), ("value", "single"), ("works_at", "multi")], "predicate string, cardinality string")


def state(spark, registry, rows, rels, valid=None, known=None):
    seen = t.visible(spark.createDataFrame(rows, A), None if valid is None else F.lit(valid), None if known is None else F.lit(known))
    found = t.reconcile(seen, spark.createDataFrame(rels, R), registry).collect()
    return (found[0].status, found[0].operative) if found else ("unknown", [])


CORRECTION = ([("a1", "s", "deadline", "10", 1, 1, None), ("a2", "s", "deadline", "14", 2, 1, None)], [("a2", "corrects", "a1", 1)])
TRANSITION = ([("a1", "s", "deadline", "10", 1, 1, 1), ("a2", "s", "deadline", "14", 2, 2, None)], [("a2", "supersedes", "a1", 1)])
CONFLICT = ([("a1", "s", "value", "10", 1, None, None), ("a2", "s", "value", "12", 2, None, None)], [])


@pytest.mark.parametrize(
    ("case", "valid", "known", "want"),
    [
        (CORRECTION, None, None, ("resolved", ["14"])),
        (CORRECTION, 1, 1, ("resolved", ["10"])),
        (CORRECTION, 1, None, ("resolved", ["14"])),
        (TRANSITION, None, None, ("resolved", ["14"])),
        (TRANSITION, 1, None, ("resolved", ["10"])),
        (CONFLICT, None, None, ("contested", [])),
        (CONFLICT, None, 0, ("unknown", [])),
    ],
)
def test_scenarios(spark, registry, case, valid, known, want):
    assert state(spark, registry, *case, valid, known) == want


def test_partial_correction_keeps_the_other_competitor(spark, registry):
    rows = [("a1", "s", "value", "10", 1, None, None), ("a2", "s", "value", "12", 2, None, None), ("a3", "s", "value", "14", 3, None, None)]
    rels = [("a3", "corrects", "a2", 1)]
    assert state(spark, registry, rows, rels) == ("contested", [])
    parts = t.support(spark.createDataFrame(rows, A), spark.createDataFrame(rels, R), registry).collect()
    assert {r.id: r.role for r in parts} == {"a1": "competing", "a2": "historical", "a3": "competing"}


def test_multi_valued_keeps_first_seen_order(spark, registry):
    rows = [("b", "s", "works_at", "y", 1, None, None), ("a", "s", "works_at", "x", 1, None, None), ("c", "s", "works_at", "y", 2, None, None)]
    assert state(spark, registry, rows, [("c", "contradicts", "a", 1)]) == ("resolved", ["x", "y"])


def test_labels(spark):
    for case, want in ((CORRECTION, "correction"), (TRANSITION, "transition"), (CONFLICT, None)):
        assert t.relation_label(spark.createDataFrame(case[0], A), spark.createDataFrame(case[1], R)).first().label == want


def test_inspection_shows_values_only_where_there_are_any(spark, registry):
    rows, rels = CORRECTION[0] + [(x, "t", *rest) for x, _, *rest in CONFLICT[0]], CORRECTION[1]
    rows = [r if r[1] == "s" else ("b" + r[0], *r[1:]) for r in rows]
    found = t.inspection(t.reconcile(spark.createDataFrame(rows, A), spark.createDataFrame(rels, R), registry)).collect()
    assert {r.subject_id: r.context for r in found} == {
        "s": "ENTITY: s\nPROPERTY: deadline\nCURRENT STATUS: resolved\nCURRENT VALUE: 14\nCANDIDATES: 1 HISTORICAL: 1",
        "t": "ENTITY: t\nPROPERTY: value\nCURRENT STATUS: contested\nCANDIDATES: 2 HISTORICAL: 0",
    }


def test_question_features(spark):
    rows = [("What is the target date?",), ("Why do we think so, as of day 12?",), ("due status at seq 7",), (None,)]
    q = F.col("q")
    got = spark.createDataFrame(rows, "q string").select(tx.intent(q), tx.predicate(q), tx.valid_time(q), tx.recorded_seq(q)).collect()
    assert [tuple(r) for r in got] == [("current", "deadline", None, None), ("provenance", None, 12, None), ("current", "project_status", None, 7), ("current", None, None, None)]


def test_reachability_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "source_node string, derived_node string")
    got = m.reachable(edges, spark.createDataFrame([("a",)], "node string")).collect()
    assert {r.node: r.depth for r in got} == {"b": 1, "c": 2, "a": 3, "d": 3}


def test_admission_counts_accepted_only(spark):
    rows = [("k", 1, 0), ("k", 2, 0), ("k", 3, 1), ("j", 1, 1), ("j", 2, 0)]
    got = m.admitted(spark.createDataFrame(rows, "write_key string, seq long, base_version long")).collect()
    assert {(r.write_key, r.seq): r.accepted for r in got} == {("k", 1): True, ("k", 2): False, ("k", 3): True, ("j", 1): False, ("j", 2): True}


def test_snapshot_without_marker_is_not_seen(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    assert table.version() == 0 and table.read() is None
    table.replace(spark.range(3))
    table.write(spark.range(9), 2)
    assert table.version() == 1 and table.read().count() == 3
    table.commit(2)
    assert table.read().count() == 9


def test_stream_of_heads_in_any_order(spark, tmp_path):
    rows = [(k, k % 3, f"t{k % 2}") for k in range(60)]
    log = str(tmp_path / "log")
    for part in (rows[40:], rows[:20], rows[20:40]):
        spark.createDataFrame(part, "event_id long, user_id long, event_type string").coalesce(1).write.mode("append").parquet(log)
    got = {(r.subject_id, r.predicate): r.recorded_seq for r in heads.heads_of_events(spark, log).collect()}
    want = {}
    for k, u, e in rows:
        want[f"u{u}", e] = max(k, want.get((f"u{u}", e), 0))
    assert got == want


def _rows(names, table):
    return sorted((tuple(round(float(v), 5) if isinstance(v, float) else v for v in (r[n] for n in names)) for r in table), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, name):
    frame = catalog.QUERIES[name](spark, SF)
    if name not in catalog.ORACLE_SQL:
        assert frame.count() > 0
        return
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    want = con.sql(catalog.ORACLE_SQL[name])
    names = sorted(frame.columns)
    assert names == sorted(want.columns)
    got = [r.asDict() for r in frame.collect()]
    assert _rows(names, got) == _rows(names, [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()])
