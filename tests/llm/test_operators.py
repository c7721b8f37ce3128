"""The corpus operators against brute force, exact round trips and held-out accuracy, on small fixtures."""

from __future__ import annotations

import collections
import hashlib
import html as html_lib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from midden.llm import audio, bpe, cells, chunks, components, cotrain, html_blocks, jaccard, orc_tokens, packing, pii, queries, rules, tokens, toxicity
from midden.llm.common import slices, texts_of

CLASH = "doc_id long, text string, lang string, source string, n_chars long, n int, stats string, length string, kept string, score string, label int, mark string, cid string, found string, base string"


def odd_texts() -> list:
    rng = random.Random(5)
    kinds = ["ab", "aab c\n ", "the \n\t\x1c\x85　é's'll12 .,!中文😀\r", "0123 +-=@.", "̀éΣAİſK ", "<|endoftext|> a", "abé, .ÀÜßª ", "\na b\nc,\n. "]
    out = [None, "", " ", "\n", "a", "a b", "word " * 3000, "x" * 9000, "same text here again", "same text here again", "Σ. é, "]
    return out + ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.choice([1, 3, 20, 100, 700]))) for _ in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 3 else "en", None, None, 1, "x", "x", "x", "x", 0, "x", "x", "x", "x") for i, t in enumerate(odd_texts())]
    return spark.createDataFrame(rows + rows[8:9], CLASH).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], CLASH)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, None, None), (1, 1, 1), (1, 1, 1), (2, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


def texts(df) -> dict:
    return {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}


def test_bpe_equals_the_library(docs):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    tool = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: tool.encode_ordinary(t) for i, t in texts(docs).items()}
    args = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    rows = bpe.round_trip(docs, *args).collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = want[r["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tool.decode_bytes(ids)).hexdigest()
    encoded = bpe.encode(docs, *args)
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == want
    assert {r["doc_id"]: bytes(r["bytes"]).decode() for r in bpe.decode(encoded, *args).collect()} == texts(docs)


def test_long_pretokens_merge_like_short_ones():
    table = bpe.Ranks(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng = random.Random(2)
    for token in [b"a" * 200, b"ab" * 90, bytes(rng.choice(b"thean") for _ in range(250))]:
        out: list = [None]
        table._matrix([token], 256, [0], out)
        assert out[0].tolist() == table._long(token).tolist()
        assert table.decode(out[0]) == token


@pytest.mark.parametrize("name,word_ends", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_chunked_ids_equal_whole_texts(name, word_ends):
    e = tokens.Encoder(P.path(name), word_ends, limit=50)
    rows = pa.array([t or "" for t in odd_texts()])
    for part in (rows, rows.slice(7, 40)):
        flat, ends = e.encode(part)
        start = 0
        for text, end, want in zip(part.to_pylist(), ends, e.tool.encode_batch(part.to_pylist(), add_special_tokens=False), strict=True):
            assert flat[start:end].tolist() == want.ids, text
            start = end


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, "", None, "b" * 100, "c"])], ["text"])
    assert [x for b in slices(iter([batch]), "text", 12) for x in b.column(0).to_pylist()] == batch.column(0).to_pylist()


def test_orc_files(spark, docs, none, tmp_path):
    folder = orc_tokens.write(docs, str(tmp_path / "orc"), P.path("byte_bpe_50k.json"), 0)
    e = tokens.Encoder(P.path("byte_bpe_50k.json"), False)
    want = {i: [*e.tool.encode(t, add_special_tokens=False).ids, 0] for i, t in texts(docs).items()}
    assert {r["doc_id"]: r["ids"] for r in orc_tokens.read(spark, folder).collect()} == want
    assert {r["doc_id"] for r in orc_tokens.read(spark, folder, [3, 5]).collect()} == {3, 5}
    rows = sorted(orc_tokens.summary(spark, folder).collect(), key=lambda r: (r["doc_id"], r["start"]))
    at = 0
    for r in rows:
        ids = np.array(want[r["doc_id"]], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert orc_tokens.stored(none, P.path("byte_bpe_50k.json"), 0).count() == 0


def test_packing(docs, none):
    rows = packing.pack(docs, P.path("word_bpe_49k.json"), 1, 256).collect()
    e = tokens.Encoder(P.path("word_bpe_49k.json"), True)
    want = {i: np.array([*e.tool.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in texts(docs).items()}
    by = collections.defaultdict(list)
    for r in rows:
        part = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == 256 * r["piece"] and len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert sum(r["length"] for r in rows) == sum(map(len, want.values())) + len(want[8])
    assert packing.pack(none, P.path("word_bpe_49k.json"), 1, 256).count() == 0


@pytest.mark.parametrize("n", [0, 1, 40, 3000, 200_000])
def test_plan_places_every_piece_once(n):
    rng = np.random.default_rng(n)
    sizes = np.clip(np.exp(rng.normal(6.4, 1.1, n)).astype(int), 1, 4096)
    hist = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True)), strict=True))
    plan, seen = packing.Plan(hist, 4096), collections.Counter()
    filled = np.zeros(plan.sequences, int)
    for length, rank, count, first, offset in plan.places:
        assert (filled[first : first + count] == offset).all() and rank == seen[length]
        filled[first : first + count] += length
        seen[length] += count
    assert seen == collections.Counter(hist) and filled.max(initial=0) <= 4096
    assert plan.sequences <= 1.02 * -(-int(sizes.sum()) // 4096) + 2


def test_nnls_finds_the_exact_solution():
    a = np.array([[1.0, 0, 1], [0, 1, 1]])
    assert np.allclose(packing.nnls(a, a @ np.array([2.0, 0, 3])), [2, 0, 3])


def test_audio(docs, none):
    rows = audio.digest(docs).collect()
    by = texts(docs)
    for r in rows:
        raw = by[r["doc_id"]].encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    same = [r for r in rows if r["doc_id"] in (8, 9)]
    assert len({(r["media_sha256"], r["feature"]) for r in same}) == 1
    assert audio.digest(none).count() == 0
    feature = audio.features(audio.store(docs)).first()
    assert audio.from_tensors(bytes(feature["tensors"])).shape[1] == audio.MELS


def test_resampling_keeps_a_tone():
    t = np.arange(16_000) / 16_000
    y = audio.resample(np.sin(2 * np.pi * 500 * t).astype(np.float32))
    assert len(y) == 6000 and abs(np.abs(np.fft.rfft(y[500:5500])).argmax() - 500 * 5000 / 6000) <= 1


def test_hysteresis():
    mel = np.full((30, audio.MELS), 0.0)
    mel[10:15] = 3
    assert audio.segments(mel) == [(10, 30)] or audio.segments(mel)[0][0] == 10


def brute_rules(text: str) -> tuple:
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = set()
    for i in range(len(w) - 4):
        if seen[tuple(w[i : i + 5])] > 1:
            inside.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_rules(docs, none, labels):
    by = texts(docs)
    rows = rules.judge(docs, [(rules.Condition("upper_case", True, 0.5), rules.Condition("n_words", True, 3.0))]).collect()
    for r in rows:
        want = brute_rules(by[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r["base_failed"] and r["kept"])
    assert rules.fit(none, labels) == [] and rules.judge(none, []).count() == 0
    assert rules.keep(docs, labels).columns == docs.columns
    assert {r["doc_id"] for r in rules.keep(docs, labels).collect()} <= {r["doc_id"] for r in rows if not r["base_failed"]}


def test_rules_are_learned_and_pruned():
    rng = np.random.default_rng(1)
    x = {"a": rng.random(600), "b": rng.random(600)}
    y = (x["a"] >= 0.8) & (x["b"] < 0.5)
    found = rules.learn(x, y)
    caught = np.zeros(600, bool)
    for rule in found:
        caught |= rules._covers(rule, x, 600)
    assert (caught == y).mean() > 0.98 and str(found[0][0])


def brute_spans(text: str) -> list:
    def luhn(s):
        d = [int(c) for c in s][::-1]
        return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0

    tests = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda g: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda g: all(int(p) <= 255 for p in g.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda g: 12 <= len(d := re.sub("[^0-9]", "", g)) <= 19 and luhn(d)),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda g: 9 <= len(re.sub("[^0-9]", "", g)) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(tests) for m in re.finditer(p, text) if ok(m[0]))


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("a@.1 2+-(4)9%") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == brute_spans(text), text
    assert pii.base_spans("a@b@c.d e@f.g@h.i 1.2.3.4.5.6.7.8 +1 (555) 010-2345 4012 8888-8888 1881")


def test_bootstrapped_identifiers(spark, none):
    rows = [(i, f"please write to user{i}@mail.example.com today, or see card id 40{i:02d} soon") for i in range(30)]
    rows += [(100 + i, f"please write to ZX-{i}-77Q today, it is version 2.{i} now") for i in range(5)] + [(200, None), (201, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.report(df).collect()}
    assert all("id:16:" in got[100 + i] for i in range(5)) and got[200] == "" and got[201] == ""
    assert all(r["n_email"] == 1 for r in pii.report(df).where("doc_id < 30").collect())
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert clean[0].startswith("please write to [EMAIL] today") and clean[200] is None and len(clean) == len(rows)
    assert pii.report(none).count() == 0 and pii.redact(none).columns == none.columns


def test_identifiers_over_several_hops(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(9))
    rows = [(i, f"please write to user{i}@mail.example.com today, {word()}") for i in range(60)]
    rows += [(100 + i, f"please write to ZX-{i}-77Q today, then {word()} {word()} staff badge ZX-{i}-77Q shown") for i in range(40)]
    rows += [(200 + i, f"{word()} staff badge QQ-{i}-5 shown") for i in range(3)]  # no seed has this context
    rows += [(300 + i, f"{word()} {word()} contact=user{i}@mail.example.com {word()}") for i in range(30)]
    rows += [(400 + i, f"{word()} {word()} contact=KV-{i}-8 {word()}") for i in range(3)]
    long = "Z9" * 150
    rows += [(500, f"please write to {long}a today, {word()}"), (501, f"{word()} {word()} {long}b {word()}")]
    got = {r["doc_id"]: r["spans"] for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].count("id:") == 2 for i in range(100, 140))
    assert all("id:22:" in got[i] for i in range(200, 203))
    assert all("id:28:" in got[i] for i in range(400, 403))
    assert "id:16:" in got[500] and got[501] == ""


def test_contexts_are_whole_words():
    found = pii.instances("x" * 500 + " " + "y" * 90 + " A-1234 " + "z" * 90 + " end", [])
    assert found[0][4] == pii.instances("x" * 500 + "  " + "y" * 90 + " A-1234 " + "z" * 90, [])[0][4]
    assert found[0][4] != pii.instances("x" * 499 + " " + "y" * 90 + " A-1234 " + "z" * 90, [])[0][4]
    assert found[0][4] != pii.instances("x" * 500 + " " + "y" * 90 + " A-1234 " + "z" * 89, [])[0][4]


def brute_components(rows, n, num, den) -> dict:
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    label = {i: i for i in sets}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                label[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in sets}


def near_copies() -> list:
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, common = [(0, None), (1, ""), (2, "one"), (3, "ONE"), (4, "one two")], " ".join(word() for _ in range(30))
    for family in range(12):
        base = [word() for _ in range(rng.choice([8, 40, 150]))]
        for _ in range(rng.choice([1, 4, 25])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy) + (" " + common if family % 3 == 0 else "")))
    return rows


@pytest.mark.parametrize("n,num,den,small", [(3, 90, 100, False), (5, 80, 100, False), (3, 80, 100, True), (3, 90, 100, True)])
def test_jaccard_components(spark, monkeypatch, n, num, den, small):
    if small:  # every step of large regions on a small table
        monkeypatch.setattr(jaccard, "COMMON", 3)
        for name, value in (("TINY", 2), ("CELL", 4), ("PIVOTS", 2), ("LEVELS", 2), ("EXACT_LEVELS", 2), ("OUTSIDE", 3), ("BLOCK", 5), ("SALT_ROWS", 7)):
            monkeypatch.setattr(cells, name, value)
    rows = near_copies()
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n, num, den).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, n, num, den)


def test_links_come_from_pivots(spark, monkeypatch):
    """Links of a large region of sets, through pivots, windows and the rest."""
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(4):
        base = np.unique(rng.integers(0, 1 << 62, 120))
        for _ in range(25):
            own = base.copy()
            own[rng.choice(len(own), rng.integers(0, 9), replace=False)] = rng.integers(0, 1 << 62, 1)
            sets.append(np.unique(own))
    for name, value in (("CELL", 10), ("PIVOTS", 4), ("OUTSIDE", 7), ("SALT_ROWS", 16)):
        monkeypatch.setattr(cells, name, value)
    table = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(sets)], "cid long, shingles binary")
    members = table.select(F.lit(7).cast("long").alias("region"), "cid")
    links = [(r["u"], r["v"]) for r in cells.exact_links(members, table, 90, 100).collect()]
    alike = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 90 * len(np.union1d(a, b))
    # Besides links there are pairs of pivots that a member is linked with; both give the same components.
    assert links and all(any(alike(sets[u], sets[x]) and alike(sets[v], sets[x]) for x in range(100)) for u, v in links)
    want = spark.createDataFrame([(i, j) for i in range(100) for j in range(i) if alike(sets[i], sets[j])], "u long, v long")
    labels = lambda edges: {r["node"]: r["component"] for r in components.components(edges).where("node <> -1").collect()}
    assert labels(spark.createDataFrame(links, "u long, v long")) == labels(want)


def test_cells_compare_inside_windows_only(monkeypatch):
    rng = np.random.default_rng(4)
    pool = np.arange(400)
    sets = [np.sort(rng.choice(pool, 100 + k, replace=False)) for k in range(12)] + [np.arange(k, 200 + k) for k in range(0, 60, 5)]
    counted = []
    real = cells.common_counts
    monkeypatch.setattr(cells, "common_counts", lambda a, others: counted.append(len(others)) or real(a, others))
    got = cells.cell_links(sets, 80, 100)
    label = list(range(len(sets)))
    for i, j in got:
        label = [label[i] if x == label[j] else x for x in label]
    for i in range(len(sets)):
        for j in range(i):
            if len(np.intersect1d(sets[i], sets[j])) * 100 >= 80 * len(np.union1d(sets[i], sets[j])):
                assert label[i] == label[j]
    assert all(len(np.intersect1d(sets[i], sets[j])) * 100 >= 80 * len(np.union1d(sets[i], sets[j])) for i, j in got)
    assert sum(counted) < len(sets) * (len(sets) - 1) // 2


def test_jaccard_edges(spark, docs, none):
    got = jaccard.join(docs, 3, 90, 100).collect()
    assert len(got) == docs.count() and jaccard.join(none, 3, 90, 100).count() == 0
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = brute_components(list(rows.items()), 3, 90, 100)
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: c for i, (_, c) in want.items()}
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and {8} <= {r["doc_id"] for r in kept.collect()} and 9 not in {r["doc_id"] for r in kept.collect()}


def test_sketches_bound_from_below():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 300)))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 62, 5))))
        both = cells.Sketches(pa.array([b"x" * 8, jaccard.sketch(a, 9, 10), jaccard.sketch(b, 9, 10)], pa.binary()).slice(1))
        rows = both.rows(np.array([0, 1]), int(both.size.min()))
        assert np.bitwise_count(rows[0] ^ rows[1]).sum() <= len(np.setxor1d(a, b))


def test_cell_labels_by_brute_force():
    rng = np.random.default_rng(9)
    sets, cell = [], []
    for k in range(30):
        base = np.unique(rng.integers(0, 1 << 62, rng.integers(5, 80)))
        for _ in range(rng.integers(1, 6)):
            keep = base[rng.random(len(base)) < 0.95]
            sets.append(keep if len(keep) else base)
            cell.append(k // 3)
    n = np.array(list(map(len, sets)))
    bits = cells.Sketches(pa.array([jaccard.sketch(s, 9, 10) for s in sets], pa.binary()))
    root = cells.cell_labels(np.array(cell), n, np.zeros(len(n), int), np.zeros(len(n), int), bits, 90, 100)
    for b in range(len(n)):
        assert cell[root[b]] == cell[b] and root[root[b]] == root[b] <= b
        for a in range(b):
            if cell[a] == cell[b] and len(np.intersect1d(sets[a], sets[b])) * 100 >= 90 * len(np.union1d(sets[a], sets[b])):
                assert root[a] == root[b]
    assert len(set(root.tolist())) >= 20


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    got = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert set(got.values()) == {0, 100} and len(got) == 43


def test_html_blocks(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    model = html_blocks.fit(pages)
    got = {r["page_id"]: r["text"] for r in html_blocks.extract(pages, model).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(html_lib.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"<(?!/?b>)[^>]*>", body)]
        assert got[r["page_id"]] == " ".join(p for p in parts if p)
    odd = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "u", "<p>unclosed <b"), (4, "u", "<script>x</script>"), (5, "u", "<div>" * 3000 + "deep")], "page_id long, url string, html string")
    rows = html_blocks.extract(odd, model).collect()
    assert len(rows) == 5 and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert html_blocks.blocks("<p>a&nbsp;b &lt;c&gt;\n d<br>e<script>x</script>")[0][1] == "a b <c> d"


def test_lstm_gradients():
    rng = np.random.default_rng(0)
    model = html_blocks.Labeller(1)
    x, sizes = html_blocks._padded([rng.normal(size=(k, html_blocks.INPUT)).astype(np.float32) for k in (3, 5)])
    y = np.array([[1, 0], [0, 1], [1, 1], [-1, 0], [-1, 1]])
    grad = model.gradients(x, sizes, y)

    def loss():
        p = 1 / (1 + np.exp(-model.logits(x, sizes).astype(np.float64)))
        return -np.where(y == 1, np.log(p), np.where(y == 0, np.log(1 - p), 0)).sum() / (y >= 0).sum()

    for name in ("fx", "bh", "o", "b0"):
        at = tuple(rng.integers(s) for s in model.w[name].shape)
        old = model.w[name][at]
        model.w[name][at] = old + 1e-2
        up = loss()
        model.w[name][at] = old - 1e-2
        down = loss()
        model.w[name][at] = old
        assert abs((up - down) / 2e-2 - grad[name][at]) < 2e-3


def labelled_texts(n: int) -> tuple:
    rng = random.Random(8)
    words = ["".join(rng.choice("bcdfgklmn") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    texts_, toxic = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                w.insert(rng.randrange(len(w) + 1), "zoqxi" + rng.choice(["", "ra", "lo", "ne", "mu"]))
        texts_.append(" ".join(w))
        toxic.append(int(bad))
    return texts_, np.array(toxic, np.float32)


def test_toxicity_generalises():
    t, y = labelled_texts(1200)
    model = toxicity.train(t[:800], y[:800], ["x"] * 800)
    s = model.scores(pa.array(t[800:]))
    assert ((s >= 0.5) == (y[800:] == 1)).mean() > 0.97
    assert len(model.scores(pa.array(["", t[0], t[0]]))) == 3 and len(set(model.scores(pa.array([t[0], t[0]])).tolist())) == 1


def test_toxicity_edges(docs, none, labels):
    rows = toxicity.judge(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert toxicity.judge(none, labels).count() == 0 and toxicity.keep(docs, labels).columns == docs.columns
    assert toxicity.keep(docs, labels).count() == sum(r["predicted"] == 0 for r in rows)


def test_toxicity_sample_with_a_long_text(spark, docs, labels):
    t, y = labelled_texts(400)
    t[3] = "word " * 4_000_000  # one long labelled text leaves the others in the sample
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string").repartition(4)
    known = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, toxic int")
    model = toxicity.fit(df, known)
    s = model.scores(pa.array([x for i, x in enumerate(t) if i != 3]))
    assert ((s >= 0.5) == (np.delete(y, 3) == 1)).mean() > 0.9
    small = toxicity.fit(df, known, sample_bytes=40_000)
    assert len(small.kept) and not np.array_equal(small.calibration[:, 0], [0.0])
    with pytest.warns(UserWarning, match="2 labelled documents"):
        toxicity.fit(docs, labels)


def test_toxicity_of_long_labelled_texts(spark):
    t, y = labelled_texts(400)
    calm, bad = ([x for x, v in zip(t, y, strict=True) if v == c] for c in (0, 1))
    texts = [" ".join(own[i % len(own)] for i in range(k, k + 12_000)) for k in range(25) for own in (calm, bad)]
    assert min(map(len, texts)) > 256 << 10
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    model = toxicity.fit(df, spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int"), longest=40_000, train_rows=F.col("doc_id") < 40)
    s = model.scores(pa.array(texts[40:]))
    assert ((s >= 0.5) == (np.arange(40, 50) % 2 == 1)).all()
    cut = df.select("text", toxicity._window(F.col("text"), 40_000).alias("own")).collect()
    assert all(len(r["own"].encode()) <= 40_000 and f" {r['own']} " in f" {r['text']} " for r in cut)
    odd = spark.createDataFrame([("é" * 9_000,), ("x" * 9_000,), ("",), ("ab cd",)], "text string").select(toxicity._window(F.col("text"), 8_000).alias("own")).collect()
    assert [r["own"] for r in odd] == ["é" * 2_000, "x" * 2_000, "", "ab cd"]


def test_repeated_labelled_ids_are_one_row_in_training(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"text {i} of one id", "en", "web") for i in range(50)] + [(2, "other words", "en", "web")], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(rules, "learn", lambda x, poor: seen.append(len(poor)) or [])
    rules.fit(docs, labels)
    assert seen == [2]
    assert cotrain.fit(docs, labels, rounds=0).labelled == 2


def test_held_out_toxic_documents(spark):
    docs_, labels_ = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.judge(docs_, labels_).join(labels_, "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows)
    assert right >= 0.9 * len(rows)


def test_registered_queries():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES) == list(range(1, 14))


def test_texts_of_fills_nulls(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert texts_of(df, "doc_id").first()["text"] == "" and df.select(F.col("text")).first()["text"] is None
    assert chunks.spaced(pa.array([], pa.string())).names == []


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "ngram_jaccard", "personal_data", "packing"]
    docs_ = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs_.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs_.count()
        docs_ = spark.createDataFrame(stage(spark, docs_, SMALL).collect(), docs_.schema)
        assert docs_.columns == columns and 0 < docs_.count() <= before, name
    kept = {r["doc_id"] for r in docs_.collect()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SMALL).collect()} == kept
