"""Every stage of the pipeline against brute force on a small table with planted rows, odd rows and no rows."""

from __future__ import annotations

import random
import re

import corpus_pipeline
import pytest
from conftest import SMALL
from test_operators import brute_components, brute_rules, brute_spans

from midden.llm import pii, rules, toxicity
from midden.llm.common import table

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


def planted() -> list:
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bcdfgh") + rng.choice("aeiou") for _ in range(rng.randint(1, 3)))
    rows = []
    for i in range(40):
        text = " ".join(word() for _ in range(60)) + "."
        rows.append((10 * i, text, "en", "web", len(text)))
        if i % 4 == 0:  # an exact copy, and one with a word changed at the end
            rows.append((10 * i + 1, text, "en", "web", len(text)))
            rows.append((10 * i + 2, text[:-8] + "changed.", "en", "web", len(text)))
    rows += [(1001, None, None, None, None), (1002, "", "en", None, 0), (1003, "few words only", None, "x", 14), (1004, "same five words repeat here " * 6, None, "x", 162)]
    rows += [(1005, "please write to someone@mail.example.com about " + " ".join(word() for _ in range(20)), "en", "web", 1)] * 2
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(planted(), COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def text_of(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def kept(df) -> list:
    return sorted(r["doc_id"] for r in df.collect())


def test_names_and_order():
    assert list(STAGES) == ["toxicity", "quality_rules", "ngram_jaccard", "personal_data", "packing"]


def test_toxic_documents_go(spark):
    import pyarrow as pa

    docs = table(spark, SMALL, "documents")
    model = toxicity.fit(docs, table(spark, SMALL, "labels"))
    want = sorted(r["doc_id"] for r in docs.collect() if model.scores(pa.array([r["text"] or ""]))[0] < 0.5)
    assert len(model.kept) and kept(STAGES["toxicity"](spark, docs, SMALL)) == want and len(want) < docs.count()


def test_poor_documents_go(spark, docs):
    learned = rules.fit(docs, table(spark, SMALL, "labels"))
    want = []
    for r in docs.collect():
        words, chars, symbols, lines, repeated = brute_rules(r["text"] or "")
        counts = dict(zip(rules.COUNTS, rules.statistics_of((r["text"] or "").encode()), strict=True))
        assert tuple(counts[c] for c in rules.COUNTS[:5]) == (words, chars, symbols, lines, repeated)
        by = rules.features(lambda c, own=counts: own[c])
        rejected = any(all(c.holds(by[c.feature]) for c in rule) for rule in learned)
        if words >= 10 and 100 * repeated <= 20 * words and not rejected:
            want.append(r["doc_id"])
    got = kept(STAGES["quality_rules"](spark, docs, SMALL))
    assert got == sorted(want) and not {1001, 1002, 1003, 1004} & set(got)


def test_one_of_each_group_stays(spark, docs, text_of):
    label = {i: c for i, (_, c) in brute_components(list(text_of.items()), 5, 80, 100).items()}
    want = sorted(r["doc_id"] for r in docs.collect() if label[r["doc_id"]] == r["doc_id"])
    got = kept(STAGES["ngram_jaccard"](spark, docs, SMALL))
    assert got == want and 1 not in got and 2 not in got and got.count(1005) == 2


def test_personal_data_is_replaced(spark, docs, text_of):
    out = {r["doc_id"]: r for r in STAGES["personal_data"](spark, docs, SMALL).collect()}
    assert set(out) == set(text_of)
    for i, text in text_of.items():
        if not brute_spans(text or ""):
            assert out[i]["text"] == text
    assert "[EMAIL]" in out[1005]["text"] and out[1005]["n_chars"] == len(out[1005]["text"]) and out[1001]["text"] is None
    assert pii.base_spans(out[1005]["text"]) == []


def test_all_pieces_are_packed(spark, docs):
    rows = STAGES["packing"](spark, docs, SMALL).collect()
    assert sorted({r["doc_id"] for r in rows}) == sorted({r["doc_id"] for r in docs.collect()}) and len(rows) >= docs.count()
    used: dict = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096


def test_no_rows(spark, docs):
    none = docs.limit(0)
    for name, stage in STAGES.items():
        out = stage(spark, none, SMALL)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns), name


def test_clashing_columns_pass(spark):
    names = COLUMNS + ", stats string, spans string, mark long, label int, score double, kept boolean, component_id long, cid long, n int"
    text = "please write to someone@mail.example.com about these words that are many enough to pass every stage of it today"
    odd = spark.createDataFrame([(1, text, None, None, None, "a", "b", 1, 2, 0.5, True, 7, 8, 9)] * 2, names)
    for name, stage in list(STAGES.items())[:-1]:
        rows = stage(spark, odd, SMALL).collect()
        assert len(rows) == 2 and rows[0]["component_id"] == 7 and rows[0]["stats"] == "a", name
    assert re.search(r"\[EMAIL\]", STAGES["personal_data"](spark, odd, SMALL).first()["text"])
