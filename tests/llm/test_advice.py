"""One test for each settled finding of the review."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import licenses, packing, quality, token_codec, tokens
from palimpsest.llm.textbytes import blocks


def test_rules_are_as_precise_as_on_all_labels(spark):
    """Half of the marked documents are good ones; of a sample that thins the good class, nine in ten are bad."""
    rows = [(k, "plain words again" + "!" * (k < 50 or k % 12 == 0), int(k >= 50)) for k in range(550)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    docs, labels = table.select("doc_id", "text"), table.select("doc_id", "quality")
    sampled = quality.labelled_statistics(docs, labels, most=50).toPandas()
    assert sampled["bad"].sum() == 50 and len(sampled) == 100
    marked = sampled[sampled["marks_per_word"] > 0]
    assert marked["bad"].mean() >= 0.9
    assert quality.learn_decision_list(docs, labels, most=50) == quality.learn_decision_list(docs, labels) == []
    # 45 bad ones with two marks each, and no good one: a rule, whatever the sample
    clear = docs.withColumn("text", quality.F.when(quality.F.col("doc_id") < 45, "plain words again !!!").otherwise(docs["text"]))
    for most in (50, 6000):
        (rule,) = quality.learn_decision_list(clear, labels, most=most)
        assert rule.precision == 1 and rule.covered == 45


SPECIAL = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|startoftext|>, y\n z", "half <|endof", "text|> half", None, "it's plain, text", "<|ENDOFTEXT|> é<|endoftext|>é "]


def contract(vocab):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.vocabulary(vocab))
    return lambda text: library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("vocab", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_get_their_own_ids(vocab):
    ids_of, coder = contract(vocab), tokens.SegmentTokenizer(tokens.vocabulary(vocab))
    if vocab == "byte_bpe_50k.json":
        assert ids_of(SPECIAL[0]) == [64, 220, 50256, 275]
    for most in (1, 1000):
        for a, b, data, offsets in blocks(pa.array(SPECIAL), most):
            ids, sizes = coder.encode(data, offsets)
            assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [ids_of(t) for t in SPECIAL[a:b]]


def test_added_tokens_in_token_file_and_packing(spark):
    docs = spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string")
    at, ids_of = 0, contract("byte_bpe_50k.json")
    for r in token_codec.round_trip(docs).orderBy("doc_id").collect():
        ids = [*ids_of(SPECIAL[r.doc_id]), 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    ids_of = contract("word_bpe_49k.json")
    for r in packing.pack_along_curve(docs).collect():
        ids = [*ids_of(SPECIAL[r.doc_id]), 1]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


def test_sibling_licenses_are_told_apart(spark):
    nc, sa, old = "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-SA 4.0.", "Released under the MIT License."
    said = [nc, sa, f"{nc} {sa}", f"{sa}\n{nc}\n{nc}", f"x {sa} some more words here {nc} y {old}", f"{old} {old}", "Licensed under CC BY 4.0."]
    names = {"CC-BY-NC": nc, "CC-BY-SA": sa, "MIT": old}
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    for r in licenses.scan_licenses(docs).collect():
        text, found = said[r.doc_id], [(x.license, x.start, x.end) for x in r.licenses]
        if r.doc_id == 6:  # a tie: neither word that tells them apart
            assert {(x.license, x.coverage) for x in r.licenses} == {("CC-BY-NC", 6 / 7), ("CC-BY-SA", 6 / 7)}
            continue
        want = [(name, a, a + len(line) - 1) for name, line in names.items() for a in range(len(text)) if text.startswith(line, a)]
        assert found == sorted(want, key=lambda x: x[1]), text
