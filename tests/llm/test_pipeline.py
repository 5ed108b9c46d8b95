"""The pipeline's stages on the smallest tables, each against a plain version of what it decides."""

import os
import re
from collections import Counter

import pytest

import corpus_pipeline
from palimpsest.llm import queries, secrets_crf
from palimpsest.llm.frames import staged

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs, _ = staged(stage(spark, docs, SF), name)
        seen.append(docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    first, good, single, clean, mixed, packed = seen

    # the base rules hold for all that is kept; every document that they fail is gone
    assert {r.doc_id for r in good} <= {r.doc_id for r in first}
    assert all(len(WORD.findall(r.text)) >= 50 for r in good)

    sets = {r.doc_id: shingles(r.text) for r in good}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(r.doc_id for r in single) == sorted({find(k) for k in sets})

    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in single)
    before = {r.doc_id: r.text for r in single}
    for r in clean:
        assert not secrets_crf.base_spans(r.text)
        assert r.text == before[r.doc_id] or "<secret>" in r.text

    times = Counter(r.doc_id for r in mixed)
    assert set(times) <= {r.doc_id for r in clean} and max(times.values()) <= 2
    total = sum(len(WORD.findall(r.text)) for r in clean)
    assert sum(len(WORD.findall(r.text)) for r in mixed) <= 0.8 * total

    used = Counter()
    for p in packed:
        used[p.doc_id] += p.length
    tokens = {p.doc_id: p.doc_tokens for p in packed}
    assert used == Counter({k: n * tokens[k] for k, n in times.items()})


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    want = con.sql(queries.ORACLE_SQL[name])
    frame = queries.QUERIES[name](spark, SF)
    names = sorted(frame.columns)
    assert names == sorted(want.columns)
    got = sorted((tuple(r[n] for n in names) for r in frame.collect()), key=str)
    at = [want.columns.index(n) for n in names]
    assert got == sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=str)
