"""Lists of arcs put in order by pointer doubling: joins in a number of rounds that grows with the logarithm of the longest chain, no task for a chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isoline.sources.steps import Steps


def _doubled(state: DataFrame, steps: Steps, loops: bool) -> DataFrame:
    """state: id, jump, least, to_end, last. Doubles what each arc knows of those behind it until nothing changes (loops) or no arc has one before it."""
    while True:
        ahead = state.select(F.col("id").alias("jump"), F.col("jump").alias("far"), F.col("least").alias("l"), F.col("to_end").alias("n"), F.col("last").alias("e"))
        both = state.join(ahead, "jump", "left")
        least = F.least("least", "l")  # of what is not null
        new = both.select("id", F.col("far").alias("jump"), least.alias("least"), (F.col("to_end") + F.coalesce("n", F.lit(0))).alias("to_end"), F.coalesce("e", "last").alias("last"), (F.col("jump").isNotNull() & (F.col("far").isNull() | (least < F.col("least")))).alias("news"))
        new = steps.keep(new)
        busy = "news" if loops else "jump is not null"
        state = new.drop("news")
        if new.where(busy).isEmpty():
            return state


def ranked(arcs: DataFrame, steps: Steps) -> DataFrame:
    """arcs: id, next (bigint; the arc that follows or null; no two arcs are followed by the same one). Returns id, chain, to_end, closed.

    chain is the id of its last arc, to_end counts the arcs up to there, the arc itself included. A loop has no end: it is cut before its least id, which
    becomes the first arc.
    """
    start = arcs.select("id", F.col("next").alias("jump"), F.col("id").alias("least"), F.lit(1).cast("bigint").alias("to_end"), F.col("id").alias("last"))
    state = _doubled(steps.keep(start), steps, True)
    open_ = state.where("jump is null").select("id", F.col("last").alias("chain"), "to_end", F.lit(False).alias("closed"))
    loops = state.where("jump is not null").select("id", "least")
    if loops.isEmpty():
        return open_
    cut = arcs.join(loops, "id").select("id", F.when(F.col("next") != F.col("least"), F.col("next")).alias("jump"), "least", F.lit(1).cast("bigint").alias("to_end"), F.col("id").alias("last"))
    cut = _doubled(steps.keep(cut), steps, False)
    return open_.unionByName(cut.select("id", F.col("last").alias("chain"), "to_end", F.lit(True).alias("closed")))


def linked(ends: DataFrame, steps: Steps) -> DataFrame:
    """Undirected parts joined where their ends meet. ends: part (bigint), side (0: start, 1: end), node (any columns in a struct). Returns part, line, place, back, closed.

    At a node ends meet in pairs, in order of part and side; an odd one stays free. A line's parts go in order of place; back: the part is walked from its end.
    """
    at = Window.partitionBy("node").orderBy("part", "side")
    paired = ends.withColumns({"n": F.row_number().over(at), "after": F.lead(F.struct("part", "side")).over(at), "before": F.lag(F.struct("part", "side")).over(at)})
    mate = F.when(F.col("n") % 2 == 1, F.col("after")).otherwise(F.col("before"))
    # each part is two arcs: 2 * part leaves it by its end, 2 * part + 1 by its start
    arcs = paired.select((2 * F.col("part") + 1 - F.col("side")).alias("id"), mate.alias("m")).select("id", (2 * F.col("m.part") + F.col("m.side")).alias("next"))
    found = ranked(steps.keep(arcs), steps)
    both = found.groupBy(F.shiftright("id", 1).alias("part")).agg(F.min(F.struct("chain", F.col("id").bitwiseAND(1).alias("back"), "to_end", "closed")).alias("a"))
    return both.select("part", F.col("a.chain").alias("line"), (-F.col("a.to_end")).alias("place"), (F.col("a.back") == 1).alias("back"), F.col("a.closed").alias("closed"))
