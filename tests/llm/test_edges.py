"""Every operator and stage takes odd tables, and gives what its docstring says."""

from __future__ import annotations

import hashlib
import zlib

import pytest

import corpus_pipeline
from brindle.llm import chat_format, fingerprints, language_id, line_crf, mixing, ngram_join, packing, pseudonyms, quality_rules, secrets
from brindle.llm.queries import tokenizer
from tests.llm import edges

N = len(edges.ROWS)


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (9, 0, 0), (10, 0, 1), (None, 1, 0), (11, None, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "op1": quality_rules.quality_rules,
    "op2": secrets.scan_secrets,
    "op3": lambda d: line_crf.quality_rows(d, labels(d.sparkSession)),
    "op4": fingerprints.compare_with_next,
    "op5": pseudonyms.pseudonym_rows,
    "op7": mixing.mixed_sizes,
    "op8": ngram_join.jaccard_groups,
    "op9": language_id.language_rows,
    "op10": lambda d: packing.pack_documents(d, tokenizer("word_bpe_49k.json")),
}


@pytest.fixture(scope="module")
def results(spark):
    return {n: f(edges.table(spark)).collect() for n, f in OPERATORS.items()}


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


@pytest.mark.parametrize("name", [n for n in OPERATORS if n != "op10"])
def test_one_row_per_row(results, name):
    assert len(results[name]) == N
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in results[name]) == sorted((r[0] is None, r[0] or 0) for r in edges.ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_and_single_rows(spark, name):
    assert OPERATORS[name](edges.empty(spark)).collect() == []
    assert {r["doc_id"] for r in OPERATORS[name](edges.alone(spark)).collect()} == {1}


def test_quality_rules(results):
    r = by_id(results["op1"])
    for i in (3, 4, 5):
        assert r[i]["n_words"] == r[i]["word_chars"] == r[i]["n_repeat_words"] == r[i]["n_dup_lines"] == 0
        assert r[i]["base_failed"] and not r[i]["kept"]
    assert r[9]["n_symbols"] == 2 and r[6]["n_words"] == 4 * 120_000
    assert r[13]["n_symbols"] == 8


def test_secrets(results):
    r = by_id(results["op2"])
    nothing = hashlib.sha256(b"").hexdigest()
    assert all(r[i]["base_sha256"] == nothing and r[i]["spans"] == "" for i in (3, 4, 5, 6))


def test_quality_scores(results):
    for r in results["op3"]:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 4 == 2)
    a, b = (x["score"] for x in results["op3"] if x["doc_id"] == 7)
    assert a == b


def test_fingerprints(results):
    r = by_id(results["op4"])
    assert r[3]["fingerprint"] == r[4]["fingerprint"] == r[5]["fingerprint"] == ""
    assert r[3]["near_next"] == 1.0 and r[3]["n_chars"] == 0
    assert r[1]["fingerprint"] == r[7]["fingerprint"] and r[1]["near_next"] < 0.1
    # rows that share a doc_id follow each other; the null one comes first; the first follows the last
    assert sorted(x["near_next"] for x in results["op4"] if x["doc_id"] == 7)[1] == 1.0
    order = sorted(edges.ROWS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    got = {(x["doc_id"], x["edited_sha256"]) for x in results["op4"]}
    for (i, t, *_), (_, u, *_) in zip(order, order[1:] + order[:1], strict=True):
        t, u = t or "", u or ""
        h = len(t) // 2
        assert (i, hashlib.sha256((t[: len(t) - h] + u[:h]).encode()).hexdigest()) in got


def test_pseudonyms(results):
    r = by_id(results["op5"])
    assert r[3]["text"] is None and r[4]["text"] == "" and r[1]["text"] == edges.CLEAN and r[3]["n_replaced"] == 0


def test_mixing(results):
    r = by_id(results["op7"])
    assert r[3]["size"] == r[4]["size"] == r[5]["size"] == 0 and r[3]["taken"] == 0
    assert all(x["taken"] <= 3 * x["size"] for x in results["op7"])
    assert r[4]["source_size"] == r[None]["source_size"]  # null is a source


def test_ngram_join(results):
    r = by_id(results["op8"])
    assert all(r[i]["n_shingles"] == 0 and r[i]["component_id"] == i for i in (3, 4, 5))
    assert r[None]["component_id"] is None
    assert r[1]["component_id"] == r[7]["component_id"] == 1
    assert r[11]["component_id"] == r[12]["component_id"] == 11 and r[11]["n_shingles"] == 1
    assert r[10]["component_id"] == 10


def test_language(results):
    r = by_id(results["op9"])
    assert all(r[i]["lang_pred"] == "und" and r[i]["score"] == 0 for i in (3, 4, 5, 9))
    assert r[-5]["lang_pred"] != "und" and r[10]["lang_pred"] != "und"
    assert all(x["held_out"] == (zlib.crc32(b"" if x["doc_id"] is None else str(x["doc_id"]).encode()) % 5 == 0) for x in results["op9"])


def test_packing(results):
    rows = results["op10"]
    assert {r["doc_id"] for r in rows} == {r[0] for r in edges.ROWS}
    assert all(r["length"] == r["doc_tokens"] == 1 for r in rows if r["doc_id"] in (3, 4, 5))
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        place = 0
        for offset, length in sorted(pieces):
            assert offset == place
            place += length
        assert place <= 4096


def test_stages(spark, small):
    docs = edges.table(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        if name != "packing":
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        assert stage(spark, edges.empty(spark), small).count() == 0
        docs = spark.createDataFrame(out.collect(), out.schema)
        if name == "language_id":
            assert {r["doc_id"] for r in docs.collect()} >= {1, 2, 6, 7, 8, None}
            assert not {r["doc_id"] for r in docs.collect()} & {3, 4, 5, 9}
        if name == "ngram_jaccard_join":
            kept = [r["doc_id"] for r in docs.collect()]
            assert kept.count(1) == 1 and not {7, 12} & set(kept) and {2, 6, 11} <= set(kept)


def test_chat_edges(spark):
    rows = [(1, 1, "user", None), (1, 0, None, "a"), (1, 2, "user", "b<|im_end|>\n"), (1, 2, "user", "b<|im_end|>\n"), (2, None, "assistant", "&lt;|&amp;<|"), (None, 0, "as\nsis<|", "x"), (3, 5, "assistant", ""), (3, 6, "assistant", "é")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat_format.chat_digests(df).collect()}
    for conv in (1, 2, 3, None):
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.chat_digests(df.limit(0)).collect() == []
    merged = chat_format.format_chats(df).where("conv_id = 3").first()["formatted"]
    assert merged == "<|im_start|>assistant\n<|im_sep|>é<|im_end|>\n"
