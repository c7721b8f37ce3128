"""Hard negatives, packing by powers of two and the filter audit against brute force on small fixtures."""

from __future__ import annotations

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from comparing import differences, duck
from conftest import SMALL
from pyspark.sql import functions as F

from midden.llm import binary_packing, filter_audit, hard_negatives, queries

VECTORS = "vec_id long, embedding array<float>, label int, score long, at string, rank string, id string, vector int, anchor int, block int"


def vectors() -> list[tuple]:
    rng = random.Random(3)
    out = []
    for i in range(240):
        kind = rng.random()
        v = [rng.choice([-0.5, -0.25, 0.0, 0.25, 0.5, 0.126]) for _ in range(3)]
        if kind < 0.05:
            v = v[:1]
        elif kind < 0.08:
            v = []
        elif kind < 0.12:
            v[1] = rng.choice([None, float("nan"), float("inf"), -float("inf")])
        out.append((None if kind > 0.99 else i, None if 0.95 < kind < 0.97 else v, None if 0.97 < kind < 0.98 else rng.randrange(3)))
    return out + [out[10]] * 3 + [out[30]] * 2 + [(10, [0.5, 0.5, 0.5], 1), (7, [0.25, 0.25, 0.25], 2)]


def mined_by_force(rows: list[tuple], every: int, k_pos: int, k_neg: int) -> list[tuple]:
    use = []
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            use.append((i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    use = sorted(set(use))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: B905, E731
    out = []
    for i, label, v in use:
        if i % every:
            continue
        scored = sorted({(-dot(v, w), j, m == label) for j, m, w in use if j != i or m != label})
        first = [(-s, j) for s, j, same in scored if same and j != i][:k_pos]
        for p, pid in first:
            found = [(-s, j) for s, j, same in scored if not same and 80 * p <= -100 * s <= 100 * p][:k_neg]
            out += [(i, pid, r, j, p, s) for r, (s, j) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [8192, 5])
def test_hard_negatives_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", block)
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, "x", "x", "x", 1, 1, 1) for r in rows], VECTORS).repartition(5)
    got = hard_negatives.mine(df, F.col("vec_id") % 5 == 0, positives=3, negatives=4)
    want = mined_by_force(rows, 5, 3, 4)
    assert len(want) > 100
    assert sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == want
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 5 == 0).collect() == []
    assert hard_negatives.mine(df.withColumn("embedding", F.lit(None).cast("array<float>")), F.col("vec_id") % 5 == 0).collect() == []


def test_scores_are_exact():
    rng = np.random.default_rng(0)
    for scale in (100, 2**20, 2**28, 2**30):
        a, b = (rng.integers(-scale, scale, (5, 4)).astype(float) for _ in range(2))
        want = [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a]
        assert hard_negatives.scores(a, b).tolist() == want
    assert hard_negatives.scores(np.full((1, 2), 1e300), np.array([[1e300, 0], [-1e300, 0.0]])).tolist() == [[hard_negatives.MOST, -hard_negatives.MOST]]
    assert hard_negatives.scores(np.zeros((2, 0)), np.ones((3, 4))).tolist() == [[0] * 3] * 2


def test_slices_of_vectors_keep_all_rows(monkeypatch):
    monkeypatch.setattr(hard_negatives, "SLICE_ROWS", 7)
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array([1] * 50), pa.array([[float(i)] * (i % 4) for i in range(50)])], ["id", "label", "vector"])
    found = list(hard_negatives._slices(iter([batch.slice(0, 20), batch.slice(20)]), 1))
    assert [i for r in found for i in r.ids.tolist()] == list(range(50))
    assert len(found) > 5


def test_hard_negatives_query_equals_sql(spark):
    assert differences(queries.op11_hard_negatives(spark, SMALL), duck(SMALL), queries.ORACLE_SQL["op11_hard_negatives"]) == []


def test_binary_lengths():
    for n in [*range(1, 200), 4095, 4096, 4097, 12288, 99999]:
        got = binary_packing.lengths(n, 64).tolist()
        assert sum(got) == n and got == sorted(got, reverse=True) and all(x & (x - 1) == 0 for x in got)
        assert len(got) == n // 64 + (n % 64).bit_count()


def test_power_of_two_packing_by_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(8)
    texts = [None, "", " \n", "a", "same text", "same text", "word " * 9000, "x" * 3000, "<|endoftext|> b"]
    texts += [" ".join(rng.choice(["tree", "Wald,", "99", "été", "中文"]) for _ in range(rng.randrange(300))) for _ in range(40)]
    rows = [(i, t, 0, "x", "x", 1, 1, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[3], (None, "no id", 0, "x", "x", 1, 1, "x")], "doc_id long, text string, task int, nth string, length string, base int, bucket int, ids string").repartition(3)
    path, size = P.path("word_bpe_49k.json"), 256
    tool = Tokenizer.from_file(path)
    ids = {i: [*tool.encode(t or "", add_special_tokens=False).ids, 2] for i, t in [*enumerate(texts), (None, "no id")]}
    got = binary_packing.pack(df, path, 2, size, ids=True).collect()
    by_doc = collections.defaultdict(list)
    for r in got:
        whole = ids[r["doc_id"]]
        own = whole[r["start"] : r["start"] + r["length"]]
        assert r["ids"] == own and r["ids_crc32"] == zlib.crc32(np.array(own, "<u4")) and r["doc_tokens"] == len(whole) and r["offset"] == 0
        assert r["length"] == 1 << r["bucket"] <= size
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
    for i, whole in ids.items():
        spans = sorted(by_doc[i])
        times = 2 if i == 3 else 1
        assert len(spans) == times * (len(whole) // size + (len(whole) % size).bit_count())
        assert [s for s, n in spans for _ in range(n)] and sorted(x for s, n in spans for x in range(s, s + n)) == sorted([*range(len(whole))] * times)
    numbers = sorted((r["sequence_id"], r["length"]) for r in got)
    assert [n for n, _ in numbers] == list(range(len(got)))  # every number once
    assert [x for _, x in numbers] == sorted((x for _, x in numbers), reverse=True)  # equal lengths adjoin
    assert binary_packing.pack(df.limit(0), path, 2, size).collect() == []
    binary_packing.write(df, path, 2, str(tmp_path / "out"), size)
    for row in spark.read.parquet(str(tmp_path / "out")).collect():
        assert len(row["ids"]) == 1 << row["bucket"]
    with pytest.raises(ValueError, match="power of two"):
        binary_packing.pieces(df, path, 2, 100)


def audited_by_force(docs: list[tuple], labels: list[tuple]) -> list[tuple]:
    least: dict[str, int] = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    rows = []
    for i, t, source in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t],
        }
        own = [x for x in labels if i is not None and x[0] == i]
        rows.append((source or "", fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = []
    for part in {r[0] for r in rows}:
        mine, lines, shapley = [r for r in rows if r[0] == part], [], collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone, stay = [r for r in left if r[1][f]], [r for r in left if not r[1][f]]
                shapley[f] += len(gone)
                alone = sum(r[1][f] and sum(r[1].values()) == 1 for r in mine)
                lines.append((part, order, step, len(stay), len(gone), sum(r[1][f] for r in mine) - len(gone), alone, sum(r[2] for r in gone), sum(r[3] for r in gone)))
                left = stay
        out += [(*x, shapley[x[1][x[2] - 1]]) for x in lines]
    return sorted(out)


def test_filter_audit_by_brute_force(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice([None, "", "Aa b", "many " * 250, " ".join(map(str, range(260))), " ".join(map(str, range(210))) + " #", "A B C " * 80, "x\ty\nZ | 😀 $" + "w" * i]), rng.choice([None, "", "p", "q"])) for i in range(120)]
    docs += [docs[5], docs[5], (None, "Aa b", "q"), (500, "only #", "gone")]
    labels = [(i, rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for i in range(0, 120, 2)] + [(4, 1, 1), (4, 0, None), (None, 1, 1), (999, 1, 1)]
    df = spark.createDataFrame([(*d, 1, "x", "x", True, 3) for d in docs], "doc_id long, text string, source string, state int, part string, A string, good boolean, n int").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.interactions(df, known)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    want = audited_by_force(docs, labels)
    assert sorted(map(tuple, got.collect())) == want
    assert filter_audit.interactions(df.limit(0), known.limit(0)).collect() == []


def test_states_are_shared(spark):
    rows = spark.createDataFrame([("p", i % 2 == 0, i % 3 == 0, i % 5 == 0, i < 9) for i in range(30)], "part string, X boolean, Y boolean, Z boolean, lost boolean")
    trie = filter_audit.Trie(rows, list("XYZ"), ["lost"])
    assert trie.done == set(range(8)) and trie.edges == 12  # 3 filters: 8 unordered prefixes, not 16 nodes
    got = filter_audit.audit(rows, list("XYZ"), ["lost"]).collect()
    assert len(got) == 18
    for order in ("XYZ", "ZYX"):
        steps = sorted((r["step"], r["kept"], r["removed"]) for r in got if r["filter_order"] == order)
        assert steps[-1][1] == sum(bool(i % 2 and i % 3 and i % 5) for i in range(30))
        assert sum(s[2] for s in steps) + steps[-1][1] == 30
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_audit_query_equals_sql(spark):
    assert differences(queries.op13_filter_interactions(spark, SMALL), duck(SMALL), queries.ORACLE_SQL["op13_filter_interactions"]) == []
