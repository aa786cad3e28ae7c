"""Contraction of trees whose nodes take the largest or smallest contribution of their children.

In each phase all nodes without open children hand their values up (rake). A node with one open child then has a value of the form
max(lo, min(hi, x + gain)) of that child's value x; such functions compose to one of the same form, so every node of a chain finds its
function of the chain's lowest node by pointer doubling, and the chain shrinks to one edge (compress). At least half of the
leaves go in each phase; a chain takes as many rounds as the logarithm of its length. Values inside chains follow at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from kifuframe.session import stored

INF = float("inf")


def _clamp(f: Column, x: Column) -> Column:
    return F.greatest(f["lo"], F.least(f["hi"], x + f["gain"]))


def _apply(f: Column, x: Column) -> Column:
    """The function's value; ``alt`` where the argument is null."""
    return F.when(x.isNull(), f["alt"]).otherwise(_clamp(f, x))


def _struct(lo: Column, hi: Column, gain: Column, alt: Column) -> Column:
    return F.struct(lo.alias("lo"), hi.alias("hi"), gain.alias("gain"), alt.cast("double").alias("alt"))


def _compose(outer: Column, inner: Column) -> Column:
    return _struct(_clamp(outer, inner["lo"]), _clamp(outer, inner["hi"]), inner["gain"] + outer["gain"], _apply(outer, inner["alt"]))


def _value_of_one(largest: Column, best: Column, own: Column, edge: Column) -> Column:
    """A node's value as a function of its one open child, given the best of the others and the child's edge."""
    def pick(x: Column) -> Column:  # a null best is passed over
        return F.when(largest, F.greatest(x, best)).otherwise(F.least(x, best))
    return _struct(pick(edge["lo"]), pick(edge["hi"]), edge["gain"], F.coalesce(pick(edge["alt"]), own))


def _counted(df: DataFrame, name: str, **figures: Column) -> tuple[DataFrame, dict]:
    seen = Observation()
    kept = stored(df.observe(seen, *[F.coalesce(F.count_if(c), F.lit(0)).alias(k) for k, c in figures.items()]), name)
    return kept, seen.get


def contracted(nodes: DataFrame) -> DataFrame:
    """``node, value`` for ``nodes(node, parent, largest, gain, own)``.

    A node's value is the largest (or smallest) ``child value + child's gain``, or ``own`` if there is none. Nulls are passed over.
    ``parent`` is null or a node.
    """
    edge = _struct(F.lit(-INF), F.lit(INF), F.coalesce("gain", F.lit(0.0)), F.lit(None))
    opened = stored(nodes.select("node", "parent", "largest", "own", F.lit(None).cast("double").alias("best"), edge.alias("edge")), "tree-open")
    done: list[DataFrame] = []
    chains: list[DataFrame] = []
    while True:
        children = opened.where("parent is not null").groupBy(F.col("parent").alias("_of")).agg(F.count(F.lit(1)).alias("_open"))
        marked, seen = _counted(opened.join(children, F.col("node") == F.col("_of"), "left").select(
            *opened.columns, F.coalesce("_open", F.lit(0)).alias("open")), "tree-marked", leaves=F.col("open") == 0, rest=F.col("open") > 0)
        leaves = marked.where("open = 0").select("node", "parent", "edge", F.coalesce("best", "own").alias("value"))
        done.append(leaves.select("node", "value"))
        if not seen["rest"]:
            break
        given = leaves.where("parent is not null").select("parent", _apply(F.col("edge"), F.col("value")).alias("x")).groupBy(
            F.col("parent").alias("_of")).agg(F.max("x").alias("_high"), F.min("x").alias("_low"), F.count(F.lit(1)).alias("_less"))
        best = F.when(F.col("largest"), F.greatest("best", "_high")).otherwise(F.least("best", "_low"))
        rest = marked.where("open > 0").join(given, F.col("node") == F.col("_of"), "left").select(
            "node", "parent", "largest", "own", best.alias("best"), "edge", (F.col("open") - F.coalesce("_less", F.lit(0))).alias("open"))
        opened, seen = _counted(rest, "tree-open", chain=F.col("open") == 1)
        if seen["chain"]:
            links = _doubled(opened)
            chains.append(links.select("node", "low", "f"))
            opened = stored(_without_chains(opened, links), "tree-open")
        else:
            opened = opened.drop("open")
    values = _union(done)
    for chain in reversed(chains):  # the lowest node of a chain is a leaf, or in a later chain
        known = values.select(F.col("node").alias("_node"), F.col("value").alias("_x"))
        found = stored(chain.join(known, F.col("low") == F.col("_node")).select("node", _apply(F.col("f"), F.col("_x")).alias("value")), "tree-values")
        values = values.unionByName(found)
    return values


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _doubled(opened: DataFrame) -> DataFrame:
    """``node, low, f`` of each chain node: the lowest node of its chain, and its value as a function of that node's."""
    child = opened.where("parent is not null").select(F.col("node").alias("low"), F.col("parent").alias("_of"), F.col("edge").alias("_edge"))
    links = opened.where("open = 1").join(child, F.col("node") == F.col("_of")).select(
        "node", "low", _value_of_one(F.col("largest"), F.col("best"), F.col("own"), F.col("_edge")).alias("f"))
    links, seen = _counted(links, "tree-links", all=F.lit(True))
    while True:
        below = links.select(F.col("node").alias("_node"), F.col("low").alias("_low"), F.col("f").alias("_f"))
        further = F.col("_node").isNotNull()
        links, seen = _counted(links.join(below, F.col("low") == F.col("_node"), "left").select(
            "node", F.coalesce("_low", "low").alias("low"), F.when(further, _compose(F.col("f"), F.col("_f"))).otherwise(F.col("f")).alias("f"),
            further.alias("moved")), "tree-links", moved=F.col("moved"))
        links = links.drop("moved")
        if not seen["moved"]:
            return links


def _without_chains(opened: DataFrame, links: DataFrame) -> DataFrame:
    """The other nodes; those below a chain hang from the node above it."""
    inside = links.select(F.col("node").alias("_inside"))
    kept = opened.join(inside, F.col("node") == F.col("_inside"), "left_anti")
    # the top of a chain is the chain node that no chain node has below it as its child
    tops = opened.join(links, "node").join(inside, F.col("parent") == F.col("_inside"), "left_anti").select(
        F.col("low").alias("_low"), F.col("parent").alias("_parent"), _compose(F.col("edge"), F.col("f")).alias("_edge"))
    hung = F.col("_low").isNotNull()
    return kept.join(tops, F.col("node") == F.col("_low"), "left").select(
        "node", F.when(hung, F.col("_parent")).otherwise(F.col("parent")).alias("parent"), "largest", "own", "best",
        F.when(hung, F.col("_edge")).otherwise(F.col("edge")).alias("edge"))
