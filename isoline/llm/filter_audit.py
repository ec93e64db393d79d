"""How corpus filters interact: what each would remove at every place of every order, by executing the permutation trie.

The trie's edges are filters, a path from the root is an order of them. Survivors depend on which filters came before, not on their order, so nodes
with the same set of filters are one state: depth first, each state's survivors are filtered from its parent's and persisted while the states below it
are visited, and a state that was reached before is not executed again. Five filters have 32 states and 80 edges for 120 orders. At every state one
aggregate over its survivors counts what each filter that is still to come removes, by part. The counts of all edges, a row for each part, state and
filter, are looked up for all orders in the end; nothing but the list of orders is made on the driver.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoline.llm.common import Scratch, join_keys, text_or_empty, written

#: ASCII white space, which stands between words.
BLANK = r"[\x20\x09-\x0D]+"


def text_filters(text: Column) -> dict[str, Column]:
    """True: the text fails. A: under 200 words; B: fewer than half of the words are distinct; C: over 2 % of the characters are A-Z; D: holds a mark of code or tables."""
    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": F.size(words) < 200, "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words), "C": 100 * capitals > 2 * F.length(text), "D": text.rlike("[#$%&*|]")}


def judged(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per row of docs: part, A to E (does it fail?), good, toxic. E: a smaller doc_id has the same text, anywhere in docs."""
    text = text_or_empty("text")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), *(c.alias(k) for k, c in text_filters(text).items()))
    rows = scratch.written(rows, "rows")
    same = scratch.written(rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).where("copies > 1"), "copies")
    rows = join_keys(rows, same, "digest", "copies", how="left").select("doc_id", "part", *"ABCD", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).alias("E"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
    marks = scratch.written(marks.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")), "labels")
    named = rows.where("doc_id is not null").join(marks, "doc_id", "left").select("part", *"ABCDE", "good", "toxic")
    none = rows.where("doc_id is null").select("part", *"ABCDE", F.lit(None).cast("boolean").alias("good"), F.lit(None).cast("boolean").alias("toxic"))
    every = named.unionByName(none)
    return every.select("part", *"ABCDE", *(F.coalesce(k, F.lit(False)).alias(k) for k in ("good", "toxic")))


def edge_counts(rows: DataFrame, filters: str, scratch: Scratch) -> DataFrame:
    """rows: part, a boolean column for each letter of filters (true: fails), good, toxic. Returns part, state, filter, kept, removed, good_lost, toxic_lost.

    state is the set of filters that came before, as its letters in the order of `filters`. Parts without survivors have no row at a state.
    """
    seen: set[str] = set()

    def visit(state: str, survivors: DataFrame) -> None:
        left = [f for f in filters if f not in state]
        counts = ", ".join(f"struct('{f}' AS filter, count_if(NOT {f}) AS kept, count_if({f}) AS removed, count_if({f} AND good) AS good_lost, count_if({f} AND toxic) AS toxic_lost)" for f in left)
        found = survivors.groupBy("part").agg(F.expr(f"array({counts}) AS e")).selectExpr("part", f"'{state}' AS state", "inline(e)")
        nonlocal edges
        edges = scratch.added(found, "edges")
        seen.add(state)
        for f in left:
            below = "".join(x for x in filters if x in state or x == f)
            if len(below) == len(filters) or below in seen:
                continue
            rest = survivors.where(f"NOT {f}").drop(f).persist(StorageLevel.MEMORY_AND_DISK)
            visit(below, rest)
            rest.unpersist()

    edges = rows
    visit("", rows)
    return edges


def audit(rows: DataFrame, filters: str, scratch: Scratch) -> DataFrame:
    """One row per part, order of all filters and step, from rows as `edge_counts` takes them."""
    spark, n = rows.sparkSession, len(filters)
    edges = edge_counts(rows, filters, scratch)
    only = {f: " AND ".join([f, *(f"NOT {x}" for x in filters if x != f)]) for f in filters}
    fails = ", ".join(f"struct('{f}' AS filter, count_if({f}) AS fails, count_if({only[f]}) AS unique_fails)" for f in filters)
    totals = rows.groupBy("part").agg(F.expr(f"array({fails}) AS e")).selectExpr("part", "inline(e)")
    # so many orders put the filter right behind the filters of its state
    orders = F.element_at(F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n))), F.length("state") + 1)
    shapley = edges.groupBy("part", "filter").agg(F.sum(F.col("removed") * orders).cast("bigint").alias("shapley"))
    plan = [("".join(p), k + 1, f, "".join(x for x in filters if x in p[:k])) for p in permutations(filters) for k, f in enumerate(p)]
    steps = F.broadcast(spark.createDataFrame(plan, "filter_order string, step int, filter string, state string"))  # n! * n rows, whatever the data
    none = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    placed = totals.join(shapley, ["part", "filter"], "left").join(steps, "filter").join(edges, ["part", "state", "filter"], "left")
    return placed.select("part", "filter_order", "step", none("kept"), none("removed"), (F.col("fails") - F.coalesce("removed", F.lit(0))).cast("bigint").alias("redundant"), none("unique_fails"), none("good_lost"), none("toxic_lost"), none("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Five filters (`text_filters`, and E for copies) in all 120 orders: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    part is the source, a null one the empty string. A null text is empty. A null doc_id has no label and is neither a copy nor an original; rows that
    repeat a doc_id and a text are no copies of each other. A document with several labels is good (toxic) if one of them says so; one without is neither.
    Every part of docs has its 600 rows, with zeros where nothing is left; empty tables give no rows. Other columns of either table are not read.
    """
    scratch = Scratch(docs.sparkSession, "filter-audit")
    rows = scratch.written(judged(docs, labels, scratch), "judged")
    found = written(audit(rows, "ABCDE", scratch), "filter-audit")
    scratch.clear()
    return found
