"""Connected components of an edge table that is never gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import store

c = F.col


def connected_components(edges: DataFrame) -> DataFrame:
    """Of edges (a long, b long) each node with the smallest node it can reach: ``node``, ``component``.

    Every round each node moves to the node of least random rank among itself and its neighbours, and edges move along;
    ranks are drawn anew, so that chains shrink as fast as stars.  Loops and repeated edges do no harm; no edges give no
    rows.  Rows with a null end are left out.
    """
    live = store(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    moves = []
    while live.limit(1).count():
        salt = F.lit(len(moves))
        both = live.union(live.select("b", "a"))
        rank = lambda x: F.struct(F.xxhash64(x, salt).alias("rank"), x.alias("to"))
        move = store(both.groupBy("a").agg(F.min(rank(c("b"))).alias("m")).select(
            "a", F.least("m", rank(c("a")))["to"].alias("to")), "moves")
        moves.append(move)
        ahead = live.join(move, "a").select(c("to").alias("a2"), c("b").alias("a")).join(move, "a").select(
            c("a2").alias("a"), c("to").alias("b"))
        live = store(ahead.filter("a <> b").distinct(), "edges")
    if not moves:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    at = moves[0].select(c("a").alias("node"), "to")
    for move in moves[1:]:
        at = at.join(move.select(c("a").alias("to"), c("to").alias("next")), "to", "left").select(
            "node", F.coalesce("next", "to").alias("to"))
    at = store(at, "places")
    least = at.groupBy("to").agg(F.min("node").alias("component"))
    return at.join(least, "to").select("node", "component")
