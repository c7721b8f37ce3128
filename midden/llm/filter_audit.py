"""How filters interact: what each removes at each place of every order of applying them.

The orders of n filters are the paths of a trie. A node's survivors depend on which filters came before, not on their
order, so the 2^n unordered prefixes are the states, and each is visited once: depth first, its survivors are its parent's
survivors that pass one more filter, persisted while its children are made, and counted along every edge that leaves it.
Counts stay a table, a row for each part and state; orders read them from there.

A state's survivors hold a part, flags and outcomes, never texts. Spark persists them in memory and on disk, and
a lost executor's share is made anew from the written flags. Counting is partial sums by part, so a part with a third of all rows is
a few numbers a task.

Cases: null text is an empty one (0 words, no characters, equal to other empty texts); a null source is the part '';
rows without an id never repeat a smaller one; repeated rows count each, and share their id's label; of
several labels of one id, 1 wins; documents without a label lose nothing good or toxic; a part that no filter
leaves anything of has zeros; an empty table gives no rows. Extra columns don't matter.
"""

from __future__ import annotations

import itertools
import json
import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, new_path

# What stands between words, and the symbols of filter D.
SPACE, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"


def flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A, B, C, D, E, good, toxic): whether each document fails each filter, from one scan of the texts.

    A: under 200 words. B: under half of the words are distinct. C: over 2 of 100 characters are A-Z. D: any of #$%&*|.
    E: the text is that of a smaller id; told by the texts' SHA-256, as texts aren't shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    words = F.array_remove(F.split("text", SPACE), "")
    read = read.select(
        "doc_id", "part", F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("distinct"),
        F.length("text").alias("chars"), F.length(F.regexp_replace("text", "[^A-Z]+", "")).alias("capitals"),
        F.col("text").rlike(SYMBOLS).alias("D"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
    )
    read = read.select(
        "doc_id", "part", (F.col("n") < 200).alias("A"), (100 * F.col("distinct").cast("long") < 50 * F.col("n").cast("long")).alias("B"),
        (100 * F.col("capitals").cast("long") > 2 * F.col("chars").cast("long")).alias("C"), "D", "digest",
    )
    read = cut(read, "audit-read")
    firsts = read.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    joined = read.join(firsts, ["digest", "doc_id"], "left").join(known.withColumnRenamed("doc_id", "labelled"), F.col("doc_id") == F.col("labelled"), "left")
    again = F.col("doc_id").isNotNull() & F.col("first").isNull()  # joined by text and id, so that no text's copies meet in one task
    return cut(joined.select("part", "A", "B", "C", "D", again.alias("E"), F.coalesce(F.col("good") == 1, F.lit(False)).alias("good"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic")), "audit-flags", instead=read)


class Trie:
    """The walk over all unordered prefixes; states are sets of filters as bits, counts the path that has their counts by part."""

    def __init__(self, rows: DataFrame, filters: list[str], outcomes: list[str]):
        self.filters, self.outcomes = filters, outcomes
        self.counts = new_path(rows.sparkSession, "audit-counts")
        names = ["here", *(f"{x}_{i}" for i in range(len(filters)) for x in ("gone", *outcomes, "alone"))]
        self.schema = "part string, state int, " + ", ".join(f"{x} long" for x in names)  # a state has the columns of its edges
        self.done: set[int] = set()
        self.edges = 0
        self._visit(rows, 0)

    def _visit(self, survivors: DataFrame, state: int) -> None:
        self.done.add(state)
        open_edges = [i for i in range(len(self.filters)) if not state >> i & 1]
        # read from storage at the root, else from memory; nothing more is read of a state that all filters have made
        held = bool(state and open_edges)
        own = survivors.persist(StorageLevel.MEMORY_AND_DISK) if held else survivors
        wanted = [F.count(F.lit(1)).alias("here")]
        for i in open_edges:
            gone = F.col(self.filters[i])
            wanted += [F.count_if(gone).alias(f"gone_{i}"), *(F.count_if(gone & F.col(o)).alias(f"{o}_{i}") for o in self.outcomes)]
            if not state:
                wanted.append(F.count_if(gone & ~_any([g for g in self.filters if g != self.filters[i]])).alias(f"alone_{i}"))
        own.groupBy("part").agg(*wanted).write.parquet(f"{self.counts}/state={state}")
        self.edges += len(open_edges)
        for i in open_edges:
            if (child := state | 1 << i) not in self.done:
                self._visit(own.filter(~F.col(self.filters[i])).drop(self.filters[i]), child)
        if held:
            own.unpersist()


def _any(names: list[str]) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | F.col(n)
    return out


def audit(rows: DataFrame, filters: list[str], outcomes: list[str]) -> DataFrame:
    """A row for each part, order of filters and step: kept, removed, redundant, unique_fails, <outcome>_lost and shapley.

    rows: part, a boolean for each filter (failing it) and each outcome, without nulls. Filters' names are single letters, at most 6 of them.
    kept: rows after the step; removed: at the step; redundant: rows that fail the step's filter and went earlier; unique_fails: rows that
    fail that filter alone; shapley: its removed rows summed over all orders.
    """
    if not 1 <= len(filters) <= 6 or any(len(f) != 1 for f in filters):
        raise ValueError("one to six filters with names of one letter")
    spark, n = rows.sparkSession, len(filters)
    trie = Trie(rows.select("part", *filters, *outcomes), filters, outcomes)
    counted = spark.read.schema(trie.schema).parquet(trie.counts)
    counted.written_at = trie.counts
    fields = [c for c in counted.columns if c not in ("part", "state")]
    by_state = counted.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("state", F.struct(*fields)))).alias("at"))  # 2^n entries a part
    by_state = cut(by_state, "audit-states")
    forget(counted)
    # after t of n filters, so many orders have that prefix and that filter next
    weight = [math.factorial(t) * math.factorial(n - 1 - t) for t in range(n)]
    gone = lambda i, s: F.coalesce(F.element_at("at", F.lit(s))[f"gone_{i}"], F.lit(0))
    totals = [sum((gone(i, s) * weight[s.bit_count()] for s in range(1 << n) if not s >> i & 1), F.lit(0)).alias(f"sum_{i}") for i in range(n)]
    wide = by_state.select("part", "at", *totals)
    steps = []
    for order in itertools.permutations(range(n)):
        state = 0
        for k, i in enumerate(order, 1):
            steps.append(("".join(filters[j] for j in order), k, i, state))
            state |= 1 << i
    listed = json.dumps([{"filter_order": a, "step": k, "i": i, "state": s} for a, k, i, s in steps])
    plan = F.from_json(F.lit(listed), "array<struct<filter_order: string, step: int, i: int, state: int>>")
    each = wide.select("part", "at", F.array(*(f"sum_{i}" for i in range(n))).alias("sums"), F.explode(plan).alias("p"))
    here, root = F.element_at("at", F.col("p.state")), F.element_at("at", F.lit(0))
    pick = lambda of, name: F.coalesce(F.element_at(F.array(*(of[f"{name}_{i}"] for i in range(n))), F.col("p.i") + 1), F.lit(0))
    removed = pick(here, "gone")
    return each.select(
        "part", "p.filter_order", "p.step", (F.coalesce(here["here"], F.lit(0)) - removed).alias("kept"), removed.alias("removed"),
        (pick(root, "gone") - removed).alias("redundant"), pick(root, "alone").alias("unique_fails"),
        *(pick(here, o).alias(f"{o}_lost") for o in outcomes), F.element_at("sums", F.col("p.i") + 1).cast("long").alias("shapley"),
    )


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters of `flags` in all 120 orders, by source."""
    marked = flags(docs, labels)
    out = audit(marked, list("ABCDE"), ["good", "toxic"])
    forget(marked)
    return out
