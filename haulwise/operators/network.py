"""Building the road network from node positions and business rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from haulwise.functions.geo import haversine_km
from haulwise.functions.grading import delay_for_distance
from haulwise.operators.graph import is_connected
from haulwise.operators.nearest import knn_join
from haulwise.session import cut_lineage

DISTANCE_DECIMALS = 1


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def knn_neighbours(nodes: DataFrame, k: int) -> DataFrame:
    """(src, dst, distance_km, position): the ``k`` nearest other nodes of each node, distances to 0.1 km."""
    hits = knn_join(
        nodes.select(F.col("id").alias("query_id"), "latitude", "longitude"),
        nodes.select(F.col("id").alias("point_id"), "latitude", "longitude"),
        k, exclude_self=True, decimals=DISTANCE_DECIMALS,
    )
    return hits.select(F.col("query_id").alias("src"), F.col("point_id").alias("dst"), "distance_km", "position")


def apply_network_rules(edges: DataFrame, nodes: DataFrame, forbidden: DataFrame, required: DataFrame, chain: DataFrame) -> DataFrame:
    """Undirected edges after the rules: no forbidden pair, no shortcut inside a chain, required pairs and the
    consecutive pairs of every chain added.

    ``forbidden`` and ``required`` are (src, dst), ``chain`` is (chain_id, position, id). Chain members are looked up
    from the edges, so no pair list of a chain is ever formed.
    """
    known = nodes.select("id")
    order = Window.partitionBy("chain_id").orderBy("position")
    members = chain.join(known, "id", "left_semi").withColumn("place", F.row_number().over(order)).select("chain_id", "place", "id")
    a = members.select("chain_id", F.col("id").alias("src"), F.col("place").alias("place_a"))
    b = members.select("chain_id", F.col("id").alias("dst"), F.col("place").alias("place_b"))
    shortcuts = (
        edges.join(a, "src").join(b, ["chain_id", "dst"])
        .filter(F.abs(F.col("place_a") - F.col("place_b")) != 1).select("src", "dst")
    )
    links = a.join(b.withColumn("place_a", F.col("place_b") - 1), ["chain_id", "place_a"]).select("src", "dst")
    must = required
    for end in ("src", "dst"):
        must = must.join(known.withColumnRenamed("id", end), end, "left_semi").select("src", "dst")
    kept = (
        edges.select("src", "dst")
        .join(undirected(forbidden), ["src", "dst"], "left_anti")
        .join(undirected(shortcuts), ["src", "dst"], "left_anti")
    )
    return kept.unionByName(undirected(must)).unionByName(undirected(links)).distinct()


def with_distances(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ends = nodes.select("id", "latitude", "longitude")
    a = ends.select(F.col("id").alias("src"), F.col("latitude").alias("lat_a"), F.col("longitude").alias("lon_a"))
    b = ends.select(F.col("id").alias("dst"), F.col("latitude").alias("lat_b"), F.col("longitude").alias("lon_b"))
    km = F.round(haversine_km("lat_a", "lon_a", "lat_b", "lon_b"), DISTANCE_DECIMALS)
    return edges.join(a, "src").join(b, "dst").select("src", "dst", km.alias("distance_km")).withColumn(
        "avg_delay_minutes", delay_for_distance("distance_km").cast("double")
    )


def build_network(
    nodes: DataFrame, forbidden: DataFrame, required: DataFrame, chain: DataFrame, k: int = 4
) -> DataFrame:
    """kNN network under the rules; ``k`` grows until the network is connected (or every node is a neighbour)."""
    nodes = cut_lineage(nodes.select("id", "latitude", "longitude"))
    most = max(1, nodes.count() - 1)
    k = max(1, min(k, most))
    while True:
        edges = cut_lineage(apply_network_rules(undirected(knn_neighbours(nodes, k)), nodes, forbidden, required, chain))
        if k >= most or is_connected(nodes, edges):
            return with_distances(edges, nodes)
        k += 1
