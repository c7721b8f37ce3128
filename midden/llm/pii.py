"""Personal data: fixed patterns, and more identifiers found by bootstrapping from their contexts.

Seeds are the fixed patterns' matches, each of its kind, and values that are assigned to a credential's name
(kind "id"). Every word with a digit or an at sign is an instance. Its lexical patterns are the words beside it, the name that
is assigned to it (name=value, name: value, name = value) and, of long mixed strings, their form. Spark scores the
graph of patterns and instances in hops: a pattern's confidence for a kind is the
share of its instances that are known to be of that kind (seeds count 1, accepted ones what they were
accepted at; the smoothing lowers it where there are few), an instance's score that of its best pattern, as one telling context
among rare words is enough. Instances of a score of at least `least` are accepted, speak for further patterns
in the next hop, and so on until a hop accepts none. As confidences are shares of one kind, a context that
meets all kinds alike, like any common word, never speaks for one. Accepted instances become spans of kind "id".

Cases: null and empty texts have no spans; repeated rows get equal spans; without seeds
nothing is added; overlapping matches of different kinds are all given; extra columns pass, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, map_arrow, scratch, slices, texts_of

KINDS = ("email", "ip", "card", "phone", "id")
OTHER = 4

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match starts at the start of a run of digits, so the look-behind only saves retries inside long runs.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
INSTANCE = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
EDGE = "\"'()[]{}<>,.;:!?|*#$%&"
NAMED = re.compile(r"([A-Za-z_][A-Za-z_-]*)([=:]+)(.+)")
# Names of credentials, as written in lower case without - and _.
CREDENTIALS = frozenset("token accesstoken authtoken apitoken apikey accesskey secretkey privatekey secret clientsecret password passwd passphrase".split())
SEED_LENGTH = 8  # of a value assigned to a credential's name, to be a seed
FORM_LENGTH = 16  # of a mixed string, to have its form as a pattern
MIXED = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_+/=-]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Around each at sign in turn: the run before it, back to the last match, and a domain behind."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), in order."""
    out = [(a, 0, b) for a, b in emails(text)]
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(out)


def key(word: str, longest: int) -> str:
    """The word; of a longer one a hash of the whole behind a space, which no word has."""
    return word if len(word) <= longest else " " + hashlib.sha256(word.encode("utf-8", "surrogatepass")).hexdigest()


def words_before(text: str, end: int, most: int = 3) -> list[str]:
    """The last words before end, whole."""
    size = 80
    while len(words := text[max(0, end - size) : end].lower().split()) <= most and size < end:
        size *= 2
    return [key(w, 80) for w in words[-most:]]


def word_after(text: str, start: int) -> list[str]:
    """The first word from start on, whole."""
    size = 40
    while len(words := text[start : start + size].lower().split()) < 2 and start + size < len(text):
        size *= 2
    return [key(w, 80) for w in words[:1]]


def name_before(before: list[str]) -> str:
    """The name to which what follows the words is assigned, or nothing."""
    if before and before[-1] in ("=", ":", ":="):
        return before[-2].strip(EDGE + "=") if len(before) > 1 else ""
    return before[-1].strip(EDGE + "=") if before and before[-1][-1:] in ("=", ":") else ""


def form(value: str) -> str:
    """Hexadecimal or mixed, and the length, of a long string of letters and digits; nothing for other values."""
    if len(value) < FORM_LENGTH or not MIXED.fullmatch(value):
        return ""
    return f"{'hex' if set(value.lower()) <= set('0123456789abcdef') else 'mixed'}{len(value)}"


def instances(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str, int, list[str]]]:
    """(start, end, value, kind as a seed or -1, lexical patterns) of every word with a digit or an at sign; an instance over spans of several kinds has the first one's."""
    out: list = []
    if not base and not DIGIT.search(text) and "@" not in text:
        return out
    at = 0
    for m in INSTANCE.finditer(text):
        word = m[0]
        start = m.start() + len(word) - len(word.lstrip(EDGE))
        end = m.end() - (len(word) - len(word.rstrip(EDGE)))
        if end <= start:
            continue
        while at < len(base) and base[at][2] <= start:
            at += 1
        kind, i = -1, at
        while i < len(base) and base[i][0] < end:
            if base[i][2] > start:
                kind = base[i][1]
                break
            i += 1
        before, after = words_before(text, m.start()), word_after(text, m.end())
        patterns = ["<" + w for w in before[-1:]] + ["<<" + " ".join(before[-2:])] * (len(before) > 1) + [">" + w for w in after]
        name = name_before(before)
        if n := NAMED.fullmatch(text[start:end]):
            inner = n[3].lstrip(EDGE)
            if inner.rstrip(EDGE):
                name, start = n[1], end - len(inner)
                end -= len(inner) - len(inner.rstrip(EDGE))
        value = text[start:end]
        if name:
            patterns.append("=" + key(name.lower(), 80))
            if kind < 0 and len(value) >= SEED_LENGTH and name.lower().replace("_", "").replace("-", "") in CREDENTIALS:
                kind = OTHER
        if shape := form(value):
            patterns.append("~" + shape)
        out.append((start, end, key(value, 200), kind, patterns))
    return out


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_INSTANCE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("seed", pa.int32()), ("patterns", pa.list_(pa.string()))])
SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, base, found): mark is the text's hash; base spans and instances of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            base, found = [], []
            for text in batch.column("text").to_pylist():
                b = base_spans(text)
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in b])
                found.append([dict(zip(("start", "end", "value", "seed", "patterns"), x, strict=True)) for x in instances(text, b)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(base, pa.list_(_SPAN)), pa.array(found, pa.list_(_INSTANCE))], ["doc_id", "mark", "base", "found"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = texts_of(docs, "doc_id").withColumn("mark", F.xxhash64("text"))
    return map_arrow(marked, run, f"doc_id {kind}, mark long, base {SPANS}, found array<struct<start:bigint,end:bigint,value:string,seed:int,patterns:array<string>>>")


def accepted(scanned: DataFrame, least: float = 0.5, smooth: float = 3.0, support: int = 5) -> DataFrame:
    """(value): the instances that aren't seeds and that the scored graph takes for identifiers.

    support: known instances of one kind that a pattern must have met to speak for that kind. A hop needs one pass over the
    edges, as what isn't known yet counts as 0; hops end when one accepts nothing, as then the next would score the same.
    """
    each = scanned.where(F.size("found") > 0).select(F.explode("found").alias("x"))
    seed = F.when(F.col("x.seed") >= 0, F.col("x.seed"))
    edges = each.select("x.value", seed.alias("kind"), F.explode("x.patterns").alias("pattern")).groupBy("pattern", "value").agg(F.min("kind").alias("kind"))
    edges = cut(edges, "pii-edges")
    held = cut(edges.sparkSession.createDataFrame([], "value string, held double, as int"), "pii-held")
    while True:
        known = edges.join(held, "value", "left").withColumn("of", F.coalesce("kind", "as"))
        kinds = [F.when(F.col("of") == k, F.when(F.col("kind").isNotNull(), 1.0).otherwise(F.col("held"))) for k in range(len(KINDS))]
        sums = known.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"s{k}") for k, c in enumerate(kinds)), *(F.count(c).alias(f"c{k}") for k, c in enumerate(kinds)))
        shares = F.array(*(F.when(F.col(f"c{k}") >= support, F.struct((F.col(f"s{k}") / (F.col("n") + smooth)).alias("share"), F.lit(-k).alias("as"))) for k in range(len(KINDS))))
        telling = sums.select("pattern", F.array_max(shares).alias("best")).where(F.col("best.share") >= least)
        scores = edges.where("kind IS NULL").join(telling, "pattern").groupBy("value").agg(F.max("best").alias("best"))
        fresh = cut(scores.join(edges.where("kind IS NOT NULL").select("value").distinct(), "value", "left_anti").join(held, "value", "left_anti").select("value", F.col("best.share").alias("held"), (-F.col("best.as")).alias("as")), "pii-fresh")
        done = fresh.isEmpty()
        if not done:
            held = cut(held.unionAll(fresh), "pii-held", instead=held)
        forget(fresh)
        if done:
            return held.select("value")


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, base, spans): the fixed patterns' spans, and all spans, of every row; seeds that no fixed pattern matches, and what is accepted, have the kind id."""
    with scratch(docs.sparkSession) as keep:
        return keep(cut(_found(docs), "pii-spans"))


def _found(docs: DataFrame) -> DataFrame:
    scanned = cut(scan(docs), "pii-scan")
    values = accepted(scanned)
    places = scanned.where(F.exists("found", lambda x: (x.seed < 0) | (x.seed == OTHER))).select("doc_id", "mark", F.explode("found").alias("x")).where(f"x.seed < 0 OR x.seed = {OTHER}")
    places = places.select("doc_id", "mark", "x.value", "x.seed", F.struct(F.col("x.start").alias("start"), F.lit(OTHER).alias("kind"), F.col("x.end").alias("end")).alias("span"))
    added = places.where(f"seed = {OTHER}").select("doc_id", "mark", "span").unionAll(places.where("seed < 0").join(values, "value").select("doc_id", "mark", "span"))
    added = added.groupBy("doc_id", "mark").agg(F.collect_set("span").alias("added"))  # at most a text's words
    rows = scanned.select("doc_id", "mark", "base").alias("l").join(added.alias("r"), F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.mark") == F.col("r.mark")), "left")
    both = F.concat(F.col("l.base"), F.coalesce("r.added", F.array().cast(SPANS)))
    return rows.select("l.doc_id", "l.mark", "l.base", F.array_sort(both).alias("spans"))


def joined(column: str):
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_id, personal) for every document; personal: 1 if it has any span."""
    rows = find(docs)
    counts = [F.expr(f"CAST(size(filter(base, s -> s.kind = {i})) AS BIGINT)").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return rows.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), F.expr(f"CAST(size(filter(spans, s -> s.kind = {OTHER})) AS BIGINT)").alias("n_id"), (F.size("spans") > 0).cast("int").alias("personal"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets; n_chars, if it is a column, follows."""
    names = docs.columns
    mark, own = ("_".join(["_", *names, x]) for x in ("mark", "spans"))  # longer than every column's name
    spans = find(docs).where(F.size("spans") > 0).select("doc_id", "mark", "spans").dropDuplicates(["doc_id", "mark"])
    left = docs.withColumn(mark, F.xxhash64(F.coalesce("text", F.lit("")))).alias("l")
    on = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col(f"l.`{mark}`") == F.col("r.mark"))
    rows = left.join(spans.alias("r"), on, "left").select(*(F.col(f"l.`{c}`") for c in names), F.col("r.spans").alias(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_redacted(t, s) if s else t for t, s in zip(batch.column("text").to_pylist(), batch.column(own).to_pylist(), strict=True)]
            new = {"text": texts, "n_chars": [None if t is None else len(t) for t in texts]}
            changed = pc.is_valid(batch.column(own))
            cols = [pc.if_else(changed, pa.array(new[c], batch.column(c).type), batch.column(c)) if c in new else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(cols, names)

    return map_arrow(rows, run, docs.schema)


def _redacted(text: str, spans: list[dict]) -> str:
    out, done = [], 0
    for s in spans:
        if s["start"] >= done:
            out += [text[done : s["start"]], f"[{KINDS[s['kind']].upper()}]"]
        done = max(done, s["end"])
    return "".join([*out, text[done:]])
