"""Connected components of links between rows, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import scratch

MAX_ROUNDS = 60
#: Links up to which the smallest neighbours of all nodes (two for each link at most) are sent to every task.
BROADCAST_LINKS = 500_000
#: Beyond: nodes that are, namely those that have more than their share of the links.
HOT_NODES = 50_000
#: Links of a node that a join may always meet in one task.
LINKS = 64


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).collect()[0])


def _with_least(edges: DataFrame, links: int) -> tuple[DataFrame, DataFrame | None]:
    """Links (u, v) with m, the smallest neighbour of u; and the table behind it, if there is one.

    Up to BROADCAST_LINKS links, m is sent to every task. Beyond, that is done for nodes with more than
    ``4 * links / HOT_NODES`` neighbours (HOT_NODES of them at most, as a link has two ends); the others
    meet their links by a shuffle, in which no key has more rows than that.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    if links <= BROADCAST_LINKS:
        return edges.join(F.broadcast(least.drop("n")), "u"), None
    least = scratch.save(least, "least")
    most = max(LINKS, 4 * links // HOT_NODES)
    hot, cold = F.broadcast(least.where(F.col("n") > most).drop("n")), least.where(F.col("n") <= most).drop("n")
    rest = edges.join(hot.select("u"), "u", "left_anti")
    return edges.join(hot, "u").unionByName(rest.join(cold, "u")), least


def components(links: DataFrame) -> DataFrame:
    """(u, label): the smallest node that each node of the links (u, v: bigint) can reach.

    Large stars hang a node's larger neighbours on its smallest; small stars do so with the smaller
    ones. Both need a minimum by node, summed before the shuffle, and a join with it in which nodes
    of very many links are set apart. Rounds grow with the logarithm of the longest path.

    Links of a node with itself and repeated ones don't count; without links the result is empty.
    """
    edges = scratch.save(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
    state = _state(edges)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        starred, first = _with_least(both, state[0])
        large = starred.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u != v").distinct()
        if first is not None:
            large = scratch.save(large, "large")
        starred, second = _with_least(large, state[0])
        small = starred.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        after = scratch.save(small, "edges")
        now = _state(after)
        scratch.drop(*(x for x in (edges, large, first, second) if x is not None))
        del starred, small, large, first, second, both
        # Broadcasts and shuffles of a round stay with the executors until the driver's garbage is collected.
        scratch.free(edges.sparkSession)
        edges = after
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    # All edges lead to the smallest node of their component now.
    return edges.select("u", F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("u"), F.col("v").alias("label")).distinct())
