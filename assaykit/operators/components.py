"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.operators.joins import attach_by_key
from assaykit.session import materialize


def _with_minimum(pairs: DataFrame, n_pairs: int) -> DataFrame:
    """Add to each directed pair (u, v) the smallest node next to u, u included.

    A hub can be an end of most pairs: its neighbours are reduced by a partial aggregate and its
    rows are salted when the minimum is joined back.
    """
    nearest = pairs.groupBy("u").agg(
        F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("__degree")
    )
    return attach_by_key(pairs, nearest, "u", "__degree", ["m"], total=n_pairs)


def _step(edges: DataFrame, n_edges: int, larger: bool) -> DataFrame:
    """One star step; ``edges`` are (u, v) with u > v. A step never adds edges."""
    if larger:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = _with_minimum(both, 2 * n_edges).where("v > u")
        moved = near.select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        near = _with_minimum(edges, n_edges)
        # every lower neighbour, and u itself, hangs on the smallest one
        moved = near.select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
        ).select("e.*")
    return materialize(moved.where("u != v").distinct(), "edges")


def _is_star_forest(edges: DataFrame) -> tuple[bool, int]:
    """Whether every node has one smaller neighbour and that one is a root; and the edge count."""
    roles = edges.select(F.col("u").alias("node"), F.lit(1).alias("low")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("low"))
    )
    # times a node is the larger end, and whether it is also a smaller end
    per_node = roles.groupBy("node").agg(F.sum("low").alias("up"), F.count("*").alias("n"))
    wrong = (F.col("up") > 1) | ((F.col("up") == 1) & (F.col("n") > 1))
    bad, n = per_node.agg(F.count_if(wrong), F.sum("up")).first()
    return bad == 0, n or 0


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an undirected (u, v) edge table.

    The component is its smallest node. Every step is written to the shared folder, so a lost
    executor repeats one step at most, and the loop ends when only stars are left.
    """
    ordered = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    current = materialize(ordered.distinct(), "edges")
    done, n_edges = _is_star_forest(current)
    while not done:
        current = _step(_step(current, n_edges, larger=True), n_edges, larger=False)
        done, n_edges = _is_star_forest(current)
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)


def hub_components(links: DataFrame) -> DataFrame:
    """Components of (u, hub) links that lead to few different hubs.

    Only hub-to-hub edges go through the iteration: each node hangs on its smallest hub, and its
    other hubs are linked to that one. A node's hub list is no longer than the number of hubs.
    """
    hubs = links.select(F.col("v").alias("u"), "v").distinct()
    lists = materialize(
        links.select("u", "v").unionByName(hubs).groupBy("u").agg(F.collect_set("v").alias("hubs")), "hubs"
    ).select("u", "hubs", F.array_min("hubs").alias("first"))
    between = lists.select(F.explode("hubs").alias("u"), F.col("first").alias("v"))
    merged = connected_components(between)
    return lists.join(merged, F.col("first") == F.col("node"), "left").select(
        F.col("u").alias("node"), F.coalesce("component", "first").alias("component")
    )
