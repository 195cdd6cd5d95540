"""Resistor graphs as sparse DataFrames.

``edges(src, dst, w)`` stores both directions, no self loops; ``nodes(id, deg, g)`` keeps
the connection to the universal ground as a column (never as n extra edges).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from potentia.functions import vec
from potentia.operators import neighbors, radius
from potentia.operators.points import total_weight


@dataclass
class Graph:
    edges: DataFrame   # src, dst, w
    nodes: DataFrame   # id, deg, g
    n: int             # number of nodes
    total_w: float     # sum of w over both directions

    def persist(self) -> "Graph":
        self.edges = self.edges.persist()
        self.nodes = self.nodes.persist()
        return self


def symmetrize(directed: DataFrame) -> DataFrame:
    """Directed pairs (src, dst[, w]) -> both directions, each undirected pair once.

    Both directions come from one pass (explode of the pair and its reverse), so an upstream
    kNN kernel runs once, then one shuffle removes pairs found from both ends."""
    cols = [c for c in directed.columns if c not in ("src", "dst")]
    both = F.explode(F.array(
        F.struct(F.col("src").alias("src"), F.col("dst").alias("dst"), *[F.col(c) for c in cols]),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), *[F.col(c) for c in cols])))
    return directed.select(both.alias("_e")).select("_e.*").dropDuplicates(["src", "dst"])


def knn_edges(points: DataFrame, k: int, **kw) -> DataFrame:
    """G1: symmetric kNN conductances ``w_ij = w_i * w_j / k`` with weights normalised to 1."""
    tot = total_weight(points)
    pts = points.select("id", "x", (F.col("weight") / F.lit(tot)).alias("weight"))
    nb = neighbors.self_knn(pts, k, with_weight=True, **kw)
    directed = nb.select("src", "dst", (F.col("src_weight") * F.col("dst_weight") / F.lit(float(k))).alias("w"))
    return symmetrize(directed)


def with_ground(edges: DataFrame, ids: DataFrame, r: float | None, universal_ground: bool = True) -> Graph:
    """Ground conductance per node ``g = sum(K) / (r n^2)`` and degree per node.

    ``ids`` lists every node (so isolated nodes still get a row). ``r=None`` or
    ``universal_ground=False`` means no ground (g = 0).
    """
    if universal_ground and (r is None or r <= 0):
        raise ValueError("Ground resistance r must be positive")
    edges = edges.persist()  # the total below materialises it once for every later use
    n = ids.count()
    total = edges.agg(F.sum("w").alias("t")).first()["t"] or 0.0
    g = total / (r * n * n) if universal_ground else 0.0
    deg = edges.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("deg"))
    nodes = (ids.select("id").join(deg, "id", "left")
             .select("id", F.coalesce("deg", F.lit(0.0)).alias("deg"), F.lit(float(g)).alias("g")))
    return Graph(edges, nodes, n, float(total))


def knn_graph(points: DataFrame, k: int, r: float, universal_ground: bool = True, **kw) -> Graph:
    """G1-G3 in one call."""
    return with_ground(knn_edges(points, k, **kw), points.select("id"), r, universal_ground)


def reground(graph: Graph, r: float) -> Graph:
    """Same graph, new ground resistance (only the g column changes)."""
    g = graph.total_w / (r * graph.n * graph.n)
    return Graph(graph.edges, graph.nodes.withColumn("g", F.lit(float(g))), graph.n, graph.total_w)


def reset(graph: Graph, edges: DataFrame | None = None, g: float | DataFrame | None = None) -> Graph:
    """The same nodes with new weights and/or a new ground. ``edges(src, dst, w)`` replaces the weights, so
    degrees and total follow and the ground keeps its resistance; ``g`` is one conductance for all nodes or
    a table ``id, g`` (nodes it does not name lose their ground)."""
    nodes, n, total = graph.nodes, graph.n, graph.total_w
    if edges is not None:
        edges = edges.persist()
        total = float(edges.agg(F.sum("w")).first()[0] or 0.0)
        deg = edges.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("deg"))
        same = F.col("g") * F.lit(total / graph.total_w if graph.total_w else 0.0)  # g = sum K / (r n^2)
        nodes = (nodes.select("id", same.alias("g")).join(deg, "id", "left")
                 .select("id", F.coalesce("deg", F.lit(0.0)).alias("deg"), "g"))
    if isinstance(g, DataFrame):
        nodes = nodes.drop("g").join(g.select("id", "g"), "id", "left").withColumn("g", F.coalesce("g", F.lit(0.0)))
    elif g is not None:
        nodes = nodes.withColumn("g", F.lit(float(g)))
    return Graph(edges if edges is not None else graph.edges, nodes, n, total)


def transition(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """Row-normalised operator entries ``p = w/(deg+g)`` and ``p_ground = g/(deg+g)``."""
    p = (graph.edges.join(graph.nodes.select(F.col("id").alias("src"), "deg", "g"), "src")
         .select("src", "dst", (F.col("w") / (F.col("deg") + F.col("g"))).alias("p")))
    pg = graph.nodes.select("id", (F.col("g") / (F.col("deg") + F.col("g"))).alias("p_ground"))
    return p, pg


# ----------------------------------------------------------------------------- kernel graphs
def kernel_edges(points: DataFrame, kernel: str | Callable[[Column, float], Column], c: float, *, min_w: float = 0.0,
                 max_points: int = 20_000) -> DataFrame:
    """Gaussian or radial kernel, cut at ``min_w``; X2: or any ``kernel(d2, c)`` that
    takes and returns columns. An unknown name is an error.

    With ``min_w`` > 0 the Gaussian's cut-off is a radius, sqrt(-2 c^2 ln min_w), and only pairs
    inside it are ever made (radius join, any dimension); what is left out adds less than
    (n - 1) ``min_w`` to a node's degree. ``min_w`` = 0 asks for the dense kernel, n^2 rows
    (survey 7.6.4), as does a kernel of one's own, whose shape is not known.
    """
    if not callable(kernel) and kernel not in ("radial", "gaussian"):
        raise ValueError(f"unknown kernel {kernel!r}")
    if kernel == "radial":
        pairs, weight = radius.radius_join(points, c), F.lit(1.0)
    elif kernel == "gaussian" and 0.0 < min_w < 1.0:
        pairs = radius.radius_join(points, _reach(c, min_w))
        weight = vec.gaussian_kernel("d2", c)
    else:
        pairs = neighbors.all_pairs(points, max_points=max_points)
        weight = kernel(F.col("d2"), c) if callable(kernel) else vec.gaussian_kernel("d2", c)
    directed = pairs.select(F.col("id1").alias("src"), F.col("id2").alias("dst"), weight.alias("w"))
    directed = directed.where(F.col("w") > F.lit(float(min_w)))
    # both directions of one reading: a union would make the pairs twice
    return directed.select(F.inline(F.array(F.struct("src", "dst", "w"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))))


def _reach(c: float, min_w: float) -> float:
    return math.sqrt(-2.0 * c * c * math.log(min_w)) * (1 + 1e-9)


def kernel_degrees(points: DataFrame, c: float, *, min_w: float) -> DataFrame:
    """The degrees of ``kernel_edges(points, "gaussian", c, min_w=min_w)``, ``id, deg`` of the nodes that have edges, without
    listing the edges: a table of them grows with the square of the points wherever the cut-off reaches a share of all."""
    if not 0.0 < min_w < 1.0:
        raise ValueError("kernel_degrees needs a cut-off between 0 and 1")
    return radius.gaussian_degrees(points, c, min_w, _reach(c, min_w))


def count_weighted(edges: DataFrame, centroids: DataFrame) -> DataFrame:
    """Centroid kernel scaled by both cell counts ``K(ci,cj) * n_i * n_j`` (D3 intended)."""
    cnt = centroids.select(F.col("centroid_id"), F.col("n").cast("double").alias("cnt"))
    return (edges.join(cnt.withColumnRenamed("centroid_id", "src").withColumnRenamed("cnt", "ns"), "src")
            .join(cnt.withColumnRenamed("centroid_id", "dst").withColumnRenamed("cnt", "nd"), "dst")
            .select("src", "dst", (F.col("w") * F.col("ns") * F.col("nd")).alias("w")))


def universal_ground(edges: DataFrame, ids: DataFrame, p_g: float, degrees: DataFrame | None = None) -> Graph:
    """Ground edge ``p_g / n`` per node (calling again replaces it; ground held at 0 V). ``degrees(id, deg)`` of the same
    edges, where given, spare a reading of them. The edges are read once and not stored."""
    n = ids.count()
    deg = degrees if degrees is not None else edges.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("deg"))
    deg = deg.persist()
    total = deg.agg(F.sum("deg")).first()[0] or 0.0
    nodes = (ids.select("id").join(deg, "id", "left")
             .select("id", F.coalesce("deg", F.lit(0.0)).alias("deg"), F.lit(float(p_g) / n).alias("g")))
    return Graph(edges, nodes, n, float(total))


#: Row sums up to this number are sent to the edges.
_SENT_SUMS = 2_000_000


def _with_row_sums(edges: DataFrame, degrees: DataFrame | None = None) -> DataFrame:
    """Off-diagonal edges plus their row sum ``_s``: partial aggregation then an equi join
    (a hub row is summed across tasks, not gathered into one window task). The join is not left to the
    planner: edges made by a kernel look as small as the points they come from, and would be broadcast.
    Sums that are given (``degrees(id, deg)``) go to the edges where they lie, a row a node, so edges are neither sent nor read twice."""
    off = edges.where(F.col("src") != F.col("dst"))
    if degrees is None:
        return off.join(off.groupBy("src").agg(F.sum("w").alias("_s")).hint("merge"), "src")
    sums = degrees.select(F.col("id").alias("src"), F.col("deg").alias("_s")).persist()
    return off.join(sums.hint("broadcast" if sums.count() <= _SENT_SUMS else "merge"), "src")


def row_stochastic(edges: DataFrame, degrees: DataFrame | None = None) -> DataFrame:
    """``w / rowsum`` with zero diagonal; a zero-degree row raises. ``degrees(id, deg)`` of the same edges, where given,
    spare a reading of them and their exchange (:func:`kernel_degrees`)."""
    return (_with_row_sums(edges, degrees)
            .select("src", "dst",
                    F.when(F.col("_s") > 0, F.col("w") / F.col("_s"))
                    .otherwise(F.raise_error(F.lit("zero degree row"))).alias("w")))


def literal_rescale(edges: DataFrame) -> DataFrame:
    """Literal off-diagonal rescale ``w * (1 - s) / s`` (s = off-diagonal row sum);
    a row sum above 1 or equal to 0 raises, as the original validation does."""
    off = _with_row_sums(edges)
    return off.select("src", "dst",
                      F.when(F.col("_s") > 1, F.raise_error(F.lit("row sum above 1")))
                      .when(F.col("_s") == 0, F.raise_error(F.lit("zero degree row")))
                      .otherwise(F.col("w") * (F.lit(1.0) - F.col("_s")) / F.col("_s")).alias("w"))


def cosine_knn_graph(points: DataFrame, k: int = 9) -> tuple[DataFrame, DataFrame]:
    """Unweighted graph from cosine neighbours (unit-normalised, so L2 order = cosine order).

    Returns (edges with w=1 both directions, nodes with degree incl. isolated ones)."""
    unit = points.select("id", vec.l2_normalize("x").alias("x"))
    nb = neighbors.self_knn(unit, k)
    e = symmetrize(nb.select("src", "dst", F.lit(1.0).alias("w")))
    deg = e.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("deg"))
    nodes = points.select("id").join(deg, "id", "left").select("id", F.coalesce("deg", F.lit(0.0)).alias("deg"))
    return e, nodes


def normalized_laplacian(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Entries of ``I - D^-1/2 A D^-1/2`` (diagonal 1 for nodes with degree > 0)."""
    d = nodes.select("id", "deg")
    off = (edges.join(d.withColumnRenamed("id", "src").withColumnRenamed("deg", "ds"), "src")
           .join(d.withColumnRenamed("id", "dst").withColumnRenamed("deg", "dd"), "dst")
           .select(F.col("src").alias("i"), F.col("dst").alias("j"),
                   (-F.col("w") / F.sqrt(F.col("ds") * F.col("dd"))).alias("value")))
    diag = d.where(F.col("deg") > 0).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("value"))
    return off.unionByName(diag)


# ----------------------------------------------------------------------------- graph queries
def matvec(edges: DataFrame, v: DataFrame) -> DataFrame:
    """``(W v)_src = sum_dst w * v_dst`` for every problem: one equi join + partial agg."""
    return (edges.join(v.select("problem_id", F.col("id").alias("dst"), "v"), "dst")
            .groupBy("problem_id", "src").agg(F.sum(F.col("w") * F.col("v")).alias("wv")))


def free_nodes(nodes: DataFrame, landmarks: DataFrame) -> DataFrame:
    """Nodes that are not held at a fixed voltage, per problem (anti join)."""
    probs = landmarks.select("problem_id").distinct()
    pids = [r[0] for r in probs.collect()]  # problem ids: bounded by the landmark list
    per = nodes.select("id").withColumn("problem_id", F.explode(F.array(*[F.lit(p) for p in pids])))
    return per.join(landmarks.select("problem_id", "id"), ["problem_id", "id"], "left_anti")


def hops(edges: DataFrame, sources: DataFrame, radius: int) -> DataFrame:
    """Nodes within ``radius`` hops of each source -> ``source, id, hops`` (BFS frontier loop)."""
    e = edges.select("src", "dst").persist()
    visited = sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("hops"))
    frontier = visited
    for h in range(1, radius + 1):
        nxt = (frontier.join(e.withColumnRenamed("src", "id"), "id")
               .select("source", F.col("dst").alias("id")).distinct()
               .join(visited.select("source", "id"), ["source", "id"], "left_anti")
               .withColumn("hops", F.lit(h)))
        nxt = nxt.persist()
        visited = visited.unionByName(nxt)
        frontier = nxt
    return visited
