"""Voltage solves on a sparse graph, many problems at once (V1-V5, V7).

A *problem* is one set of fixed voltages (``landmarks(problem_id, id, voltage)``) on a shared
graph; every node is also tied to the ground (0 V) through conductance ``g``. Free node i obeys

    (deg_i + g_i) v_i - sum_j w_ij v_j = b_i     (landmark nodes keep their voltage)

with ``b`` the optional source terms (0 by default). All problems advance together: one product with the
edges per sweep, so adding landmarks adds rows, not jobs. Edges and state lie in blocks
(:mod:`potentia.operators.blocks`), which leaves one exchange a sweep, of the sums, and no plan to make. Lineage is cut
with a reliable checkpoint every few sweeps. :class:`_Sweeper` is the same sweep on DataFrames.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from potentia.operators.blocks import Blocks, place as _place
from potentia.operators.coarse import CoarseSpace
from potentia.operators.graph import Graph
from potentia.session import checkpoint_dir, cut_lineage, drop_cut

#: Sweeps between two checkpoints. A sweep reads the state twice, so the logical plan doubles with
#: each sweep until a checkpoint cuts it.
CHECKPOINT_EVERY = 2


class NotConverged(RuntimeError):
    """A solve ended before its tolerance; ``residuals`` has the relative residual by problem."""

    def __init__(self, residuals: dict[int, float], rounds: int):
        super().__init__(f"{len(residuals)} problems did not converge in {rounds} rounds: {residuals}")
        self.residuals = residuals


def _problem_ids(landmarks: DataFrame) -> list[int]:
    # bounded by the landmark list the caller gives
    return sorted(r[0] for r in landmarks.select("problem_id").distinct().collect())


def _per_problem(nodes: DataFrame, pids: list[int]) -> DataFrame:
    """Nodes for every problem; graphs that already differ per problem carry ``problem_id``."""
    if "problem_id" in nodes.columns:
        return nodes.where(F.col("problem_id").isin([int(p) for p in pids]))
    return nodes.withColumn("problem_id", F.explode(F.array(*[F.lit(int(p)) for p in pids])))


def _edge_keys(edges: DataFrame) -> list[str]:
    """Join keys of the edge table against per-problem node values."""
    return ["dst", "problem_id"] if "problem_id" in edges.columns else ["dst"]


class _Sweeper:
    """Edges and state kept in one partitioning over the sweeps of a solve.

    Both sides of the edge join are cached by the node that joins, the sums are grouped where the
    state lies (a union of equally partitioned frames keeps their partitioning), so a sweep
    moves the contributions alone. ``advance`` runs one job: it caches the new state, reduces it
    per problem and releases the old one."""

    def __init__(self, graph: Graph, pids: list[int]):
        self.spark = graph.edges.sparkSession
        self.parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.keys = _edge_keys(graph.edges)
        self.home = ["id", *self.keys[1:]]
        self.place = {p: i for i, p in enumerate(pids)}
        # a cache shows its whole lineage in each round's plan, so what made the graph is cut off first
        self.edges = self._keep(cut_lineage(graph.edges.select("src", *self.keys, "w").repartition(self.parts, *self.keys)))
        self.edges.count()
        self.held: list[DataFrame] = [self.edges]
        self.state: DataFrame | None = None
        self.sweeps = 0

    def _keep(self, df: DataFrame) -> DataFrame:
        return df.persist(StorageLevel.MEMORY_AND_DISK)

    def start(self, state: DataFrame) -> None:
        self.state = self._keep(cut_lineage(state.repartition(self.parts, *self.home)))

    def per_problem(self, values: dict[int, float]) -> Column:
        """A number looked up by problem: an array literal indexed by the problem's place."""
        array = F.array(*[F.lit(float(values.get(p, 0.0))) for p in self.place])
        return F.get(array, F.col("_q"))

    def gather(self, state: DataFrame, col: str, active: list[int]) -> DataFrame:
        """``state`` plus ``_wv = sum_j w_ij col_j`` for the active problems (0 for the others)."""
        columns = [c for c in state.columns if c not in ("problem_id", "id")]
        moving = state if len(active) == len(self.place) else state.where(
            F.get(F.array(*[F.lit(p in set(active)) for p in self.place]), F.col("_q")))
        contributions = (self.edges.join(moving.select("problem_id", F.col("id").alias("dst"), col).hint("shuffle_hash"), self.keys)
                         .select("problem_id", F.col("src").alias("id"), (F.col("w") * F.col(col)).alias("_c"))
                         .repartition(self.parts, *self.home))
        own = state.select("problem_id", "id", F.lit(0.0).alias("_c"), F.lit(True).alias("_own"), *columns)
        # a node's own row is the only one with state columns: max takes them along, by hash aggregation
        summed = own.unionByName(contributions, allowMissingColumns=True).groupBy("problem_id", "id").agg(
            F.sum("_c").alias("_wv"), F.max("_own").alias("_own"), *[F.max(c).alias(c) for c in columns])
        return summed.where("_own").drop("_own")

    def advance(self, state: DataFrame, sums: dict[str, Column], cells: int = 0) -> dict[int, dict]:
        """Take ``state`` as the new state; per problem the sums of the given expressions. With ``cells``
        (their number), ``by_cell`` also has the sums of r, s and w by cell ``_z``, in the same job."""
        old, self.sweeps = self.state, self.sweeps + 1
        self.state = self._keep(state)
        by = ["problem_id", "_z"] if cells else ["problem_id"]
        parts = {**sums, **{f"_{c}": F.col(c) for c in ("r", "s", "w")}} if cells else sums
        rows = self.state.groupBy(*by).agg(*[F.sum(e).alias(n) for n, e in parts.items()]).collect()
        if old is not None:
            old.unpersist(blocking=False)
        if self.sweeps % CHECKPOINT_EVERY == 0:
            checkpoint_dir(self.spark)
            cut = self.state.checkpoint(eager=True)  # written from the cache; keeps the partitioning
            self.state.unpersist(blocking=False)
            self.state = cut
        if not cells:
            return {r["problem_id"]: {n: r[n] or 0.0 for n in sums} for r in rows}
        out: dict[int, dict] = {}
        for r in sorted(rows, key=lambda r: (r["problem_id"], r["_z"])):
            got = out.setdefault(r["problem_id"], {**dict.fromkeys(sums, 0.0), "by_cell": np.zeros((3, cells))})
            for n in sums:
                got[n] += r[n] or 0.0
            if r["_z"] >= 0:
                got["by_cell"][:, r["_z"]] = [r["_r"], r["_s"], r["_w"]]
        return out

    def finish(self, out: DataFrame) -> DataFrame:
        """Write the result once and release what the solve held."""
        out = cut_lineage(out)
        for df in [*self.held, self.state]:
            df.unpersist(blocking=False)
        return out


def _totals(rows: dict, sums: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Sums by problem of what each row and problem has."""
    return {n: np.bincount(rows["q"].ravel(), v.ravel(), rows["problems"]) for n, v in sums.items()}


def _added(parts: list[dict]) -> dict[str, np.ndarray]:
    return {n: sum(p[n] for p in parts) for n in parts[0]}


def _finish(blocks: Blocks, column: str, rows: DataFrame, pids: list[int], fixed: DataFrame | None = None) -> DataFrame:
    """``problem_id, id, v`` written once: the blocks' column, the ``rows`` without an id (at 0 V) and what is ``fixed``."""
    types = {c: rows.schema[c].dataType for c in ("problem_id", "id")}
    out = blocks.table(column).select(F.get(F.array(*[F.lit(int(p)) for p in pids]), F.col("_q")).cast(types["problem_id"]).alias("problem_id"),
                                      F.col("id").cast(types["id"]).alias("id"), "v")
    out = out.unionByName(rows.where(F.col("id").isNull()).select("problem_id", "id", F.lit(0.0).alias("v")).distinct())
    out = cut_lineage(out if fixed is None else fixed.unionByName(out))
    blocks.release()
    return out


def _jacobi_totals(rows: dict) -> dict[str, np.ndarray]:
    return _totals(rows, {"ss": rows["step"] * rows["step"]})


def _jacobi_step(rows: dict, wv: np.ndarray, active: np.ndarray) -> dict:
    held = np.where(np.isnan(rows["fixed"]), wv * rows["inv"], rows["fixed"])
    v = np.where(active[rows["q"]], held, rows["v"])
    return {**rows, "v": v, "step": np.where(rows["has"], v - rows["v"], 0.0)}


def jacobi(graph: Graph, landmarks: DataFrame, *, max_iters: int = 10, tol: float | None = None,
           stop_when_growing: bool = True) -> DataFrame:
    """V2: ``v <- P v`` with landmarks reset after every sweep, starting from 0 V.

    Each problem stops at ``max_iters``, when its step norm falls to ``tol``, or (as the
    original loop does) right after a sweep whose step norm did not shrink (that sweep is kept).
    This is the truncated iteration: after t sweeps a node more than t hops from every landmark
    still has exactly 0 V (:func:`unreached` names such nodes); use :func:`conjugate_gradient`
    for the solution. Returns ``problem_id, id, v`` for every node and problem.
    """
    pids = _problem_ids(landmarks)
    fixed = landmarks.select("problem_id", "id", F.col("voltage").alias("fixed"))
    pk = ["problem_id"] if "problem_id" in graph.nodes.columns else []
    base = (_per_problem(graph.nodes.select(*pk, "id", (F.lit(1.0) / (F.col("deg") + F.col("g"))).alias("inv")), pids)
            .join(fixed, ["problem_id", "id"], "left"))
    base = base.select("problem_id", "id", _place(pids), "inv", "fixed", F.coalesce("fixed", F.lit(0.0)).alias("v")).persist()
    blocks = Blocks(graph.edges, base, pids, ["inv", "fixed", "v"], graph.n)
    # step norm before the first sweep: |v0 - 0| (as the original loop initialises it)
    prev = _added(blocks.totals(lambda rows: _totals(rows, {"ss": rows["many"] * rows["v"] * rows["v"]})))["ss"] ** 0.5
    active = np.ones(len(pids), bool)
    for _ in range(max_iters):
        if not active.any():
            break
        got = _added(blocks.advance(None, "v", active, functools.partial(_jacobi_step, active=active.copy()), _jacobi_totals))
        step = got["ss"] ** 0.5
        stop = (step <= tol if tol is not None else False) | (stop_when_growing & (step >= prev))
        prev, active = np.where(active, step, prev), active & ~stop
    out = _finish(blocks, "v", base, pids)
    base.unpersist(blocking=False)
    return out


def unreached(voltages: DataFrame) -> DataFrame:
    """``id`` of the nodes that are at exactly 0 V in every problem: no landmark's current has
    arrived there (too few sweeps, or another component of the graph)."""
    return voltages.groupBy("id").agg(F.max(F.abs(F.col("v"))).alias("_m")).where(F.col("_m") == 0).select("id")


def _cg_start(rows: dict, cells: np.ndarray | None) -> dict:
    return {**rows, "u": _preconditioned(rows, rows["r"], cells)}


def _preconditioned(rows: dict, r: np.ndarray, cells: np.ndarray | None) -> np.ndarray:
    """u for the residual r; ``cells`` are the coarse corrections, a row a problem."""
    u = np.divide(r, rows["diag"], out=np.zeros_like(r), where=rows["has"])
    if cells is None:
        return u
    z = rows["z"][:, None]
    return u + np.where(rows["has"] & (z >= 0), cells[rows["q"], np.maximum(z, 0)], 0.0)


def _cg_step(rows: dict, alpha: np.ndarray, beta: np.ndarray, cells: np.ndarray | None) -> dict:
    # a frozen problem has a step of 0 and keeps its x and r
    a, c = alpha[rows["q"]], beta[rows["q"]]
    p, s = rows["u"] + c * rows["p"], rows["w"] + c * rows["s"]
    r = rows["r"] - a * s
    return {**rows, "p": p, "s": s, "x": rows["x"] + a * p, "r": r, "u": _preconditioned(rows, r, cells)}


def _cg_product(rows: dict, wv: np.ndarray) -> dict:
    # a landmark is no unknown: what flows to it counts in no sum
    return {**rows, "w": np.where(rows["has"], rows["diag"] * rows["u"] - wv, 0.0)}


def _cell_sums(rows: dict, column: str, cells: int) -> np.ndarray:
    """A row a problem: the column's sum in each cell."""
    z = np.broadcast_to(rows["z"][:, None], rows["q"].shape)
    some = z >= 0
    flat = np.bincount(rows["q"][some] * cells + z[some], rows[column][some], rows["problems"] * cells)
    return flat.reshape(rows["problems"], cells)


def _first_cell_sums(rows: dict, cells: int) -> dict[str, np.ndarray]:
    return {"r": _cell_sums({**rows, "r": rows["r"] * rows["many"]}, "r", cells)}


def _cg_totals(rows: dict, cells: int) -> dict[str, np.ndarray]:
    out = _totals(rows, {"gamma": rows["r"] * rows["u"], "delta": rows["w"] * rows["u"], "rr": rows["r"] * rows["r"]})
    return out | {f"cells_{c}": _cell_sums(rows, c, cells) for c in ("r", "s", "w") if cells}


def conjugate_gradient(graph: Graph, landmarks: DataFrame, *, tol: float = 1e-12, max_iters: int | None = None,
                       sources: DataFrame | None = None, partial: bool = False,
                       cells: DataFrame | None = None, trace: list[int] | None = None) -> DataFrame:
    """V1: exact voltages by Jacobi-preconditioned conjugate gradient on the SPD system

        (deg_i + g_i) v_i - sum_{j free} w_ij v_j = sum_{c fixed} w_ic v_c + b_i     (i free)

    ``sources(problem_id, id, b)`` gives the optional terms b. Unknowns are the free nodes only
    (landmarks never enter the Krylov space). The single-reduction (Chronopoulos-Gear) form is
    used: a round is one job with one product with the edges, one exchange of its sums, one
    per-problem reduction of (r.u, Au.u, r.r). Problems converge (relative residual <= ``tol``)
    and freeze independently. A problem whose residual has not improved for a hundred rounds, that
    breaks down, or that reaches ``max_iters`` (default: no limit) raises :class:`NotConverged`,
    unless ``partial`` asks for the last iterate.
    ``cells(id, centroid_id)`` adds the second level of :mod:`potentia.operators.coarse` to the preconditioner: a
    round stays one job, whose reduction is by problem and cell, and the rounds stop growing with the
    graph's diameter. The number of rounds is appended to ``trace``.
    Returns ``problem_id, id, v`` for every node and problem.
    """
    pids = sorted({*_problem_ids(landmarks), *(_problem_ids(sources) if sources is not None else [])})
    own = ["problem_id"] if "problem_id" in graph.edges.columns else []
    edges = cut_lineage(graph.edges.select("src", "dst", *own, "w"))
    fixed = landmarks.select("problem_id", "id", F.col("voltage").alias("fixed"))
    pk = ["problem_id"] if "problem_id" in graph.nodes.columns else []
    free = (_per_problem(graph.nodes.select(*pk, "id", (F.col("deg") + F.col("g")).alias("diag")), pids)
            .join(fixed.select("problem_id", "id"), ["problem_id", "id"], "left_anti"))
    b = (edges.join(fixed.select("problem_id", F.col("id").alias("dst"), "fixed"), ["dst", *own])
         .select("problem_id", F.col("src").alias("id"), (F.col("w") * F.col("fixed")).alias("b")))
    if sources is not None:
        b = b.unionByName(sources.select("problem_id", "id", "b"))
    b = b.groupBy("problem_id", "id").agg(F.sum("b").alias("b"))
    zero = F.lit(0.0)
    coarse = CoarseSpace(graph, fixed, cells, pids) if cells is not None else None
    if coarse is not None and not coarse.k:
        coarse.release()
        coarse = None
    n_cells, cell = (coarse.k, ["_z"]) if coarse else (0, [])
    if coarse:
        free = free.join(coarse.numbered, "id", "left").withColumn("_z", F.coalesce("_z", F.lit(-1)))
    # a node without any conductance is at 0 V: it has no current and stays out of the products
    start = free.join(b, ["problem_id", "id"], "left").select(
        "problem_id", "id", _place(pids), *cell, F.when(F.col("diag") > 0, F.col("diag")).otherwise(F.lit(1.0)).alias("diag"),
        zero.alias("x"), F.coalesce("b", zero).alias("r"), zero.alias("p"), zero.alias("s")).persist()
    blocks = Blocks(edges, start, pids, ["diag", "x", "r", "p", "s"], graph.n)
    totals = functools.partial(_cg_totals, cells=n_cells)
    of_cells = functools.partial(_first_cell_sums, cells=n_cells)
    first = coarse.corrections(_added(blocks.totals(of_cells))["r"]) if coarse else None
    got = _added(blocks.advance(functools.partial(_cg_start, cells=first), "u", np.ones(len(pids), bool), _cg_product, totals))
    norm = got["rr"] ** 0.5
    gamma, alpha, beta = got["gamma"], np.zeros(len(pids)), np.zeros(len(pids))
    residual = np.where(norm > 0, 1.0, 0.0)
    bad = (norm > 0) & ~(got["delta"] > 0)
    failed = {pids[i]: 1.0 for i in np.flatnonzero(bad)}
    active = (norm > 0) & ~bad
    alpha[active] = gamma[active] / got["delta"][active]
    best = np.ones(len(pids))
    best_at = np.zeros(len(pids), int)
    rounds = 0
    while active.any() and (max_iters is None or rounds < max_iters):
        rounds += 1
        a, c = np.where(active, alpha, 0.0), np.where(active, beta, 0.0)
        # the new residual's cell sums follow from those of the round before, so no further job is needed
        ahead = coarse.corrections(got["cells_r"] - a[:, None] * (got["cells_w"] + c[:, None] * got["cells_s"])) if coarse else None
        got = _added(blocks.advance(functools.partial(_cg_step, alpha=a, beta=c, cells=ahead), "u", active.copy(), _cg_product, totals))
        for i in np.flatnonzero(active):
            g_new, delta, rr = (float(got[k][i]) for k in ("gamma", "delta", "rr"))
            residual[i] = rr ** 0.5 / norm[i]
            if residual[i] <= tol or g_new == 0:
                active[i] = False
                continue
            if residual[i] < best[i]:
                best[i], best_at[i] = residual[i], rounds
            b_new = g_new / gamma[i]
            denom = delta - b_new * g_new / alpha[i]
            if not denom > 0 or rounds - best_at[i] > 100:
                failed[pids[i]] = float(residual[i])
                active[i] = False
                continue
            beta[i], alpha[i], gamma[i] = b_new, g_new / denom, g_new
    if trace is not None:
        trace.append(rounds)
    failed |= {pids[i]: float(residual[i]) for i in np.flatnonzero(active)}
    if failed and not partial:
        raise NotConverged(failed, rounds)
    out = _finish(blocks, "x", start, pids, fixed.select("problem_id", "id", F.col("fixed").alias("v")))
    start.unpersist(blocking=False)
    drop_cut(edges)
    if coarse:
        coarse.release()
    return out


def solve(graph: Graph, landmarks: DataFrame, method: str = "cg", **kw) -> DataFrame:
    """Pick the solver (``'cg'`` exact, ``'jacobi'`` truncated)."""
    if method == "cg":
        return conjugate_gradient(graph, landmarks, **kw)
    if method == "jacobi":
        return jacobi(graph, landmarks, **kw)
    raise ValueError(f"unknown method {method!r}")


def one_per_landmark(landmark_ids: DataFrame, voltage: float = 1.0) -> DataFrame:
    """V3: one problem per landmark row (``problem_id`` given, or dense rank of id)."""
    if "problem_id" in landmark_ids.columns:
        return landmark_ids.select("problem_id", "id", F.lit(float(voltage)).alias("voltage"))
    from pyspark.sql import Window
    w = Window.orderBy("id")
    return landmark_ids.select((F.row_number().over(w) - 1).alias("problem_id"), "id",
                               F.lit(float(voltage)).alias("voltage"))


def wide(voltages: DataFrame) -> DataFrame:
    """P16 / V3 all_solutions: long -> one row per point with voltages ordered by problem_id."""
    return (voltages.groupBy("id")
            .agg(F.array_sort(F.collect_list(F.struct("problem_id", "v"))).alias("_s"))
            .select("id", F.transform("_s", lambda s: s["v"]).alias("v")))


def long(wide_df: DataFrame) -> DataFrame:
    """Wide -> long."""
    return wide_df.select("id", F.posexplode("v").alias("problem_id", "v"))


def out_of_sample(assignments: DataFrame, centroid_voltages: DataFrame) -> DataFrame:
    """V7: a raw point takes the voltage of its nearest centroid."""
    cv = centroid_voltages.select("problem_id", F.col("id").alias("centroid_id"), "v")
    return assignments.select("id", "centroid_id").join(cv, "centroid_id").select("problem_id", "id", "v")


def local_solve(graph: Graph, landmarks: DataFrame, cells: DataFrame, centroid_voltages: DataFrame,
                neighbours: DataFrame, **kw) -> DataFrame:
    """V5: two-level solve. Every cell is a problem of its own whose boundary is the centres of
    the adjacent cells, at the voltages of the coarse solve.

    A point keeps its edges inside its cell. An edge into an adjacent cell becomes a tie of the
    same conductance to that cell's centre: its weight stays in the point's degree and, times the
    centre's voltage, is a source term. Edges into cells that are not adjacent are left out.
    ``landmarks`` are held as in the fine problem. Since no edge crosses a border, all cells are
    solved at once.

    ``cells(id, centroid_id)`` assigns points to cells, ``centroid_voltages(problem_id, centroid_id,
    v)`` is the coarse solution, ``neighbours(c1, c2)`` the adjacent cells (J13, either order).
    """
    c = cells.select("id", "centroid_id")
    e = (graph.edges.join(c.select(F.col("id").alias("src"), F.col("centroid_id").alias("cs")), "src")
         .join(c.select(F.col("id").alias("dst"), F.col("centroid_id").alias("cd")), "dst"))
    inner = e.where(F.col("cs") == F.col("cd")).select("src", "dst", "w")
    adjacent = neighbours.select(F.col("c1").alias("cs"), F.col("c2").alias("cd")).unionByName(
        neighbours.select(F.col("c2").alias("cs"), F.col("c1").alias("cd"))).distinct()
    ties = (e.where(F.col("cs") != F.col("cd")).join(adjacent, ["cs", "cd"], "left_semi")
            .groupBy(F.col("src").alias("id"), F.col("cd").alias("centroid_id")).agg(F.sum("w").alias("bw")))
    sources = (ties.join(centroid_voltages.select("problem_id", "centroid_id", "v"), "centroid_id")
               .groupBy("problem_id", "id").agg(F.sum(F.col("bw") * F.col("v")).alias("b")))
    deg = (inner.select(F.col("src").alias("id"), "w").unionByName(ties.select("id", F.col("bw").alias("w")))
           .groupBy("id").agg(F.sum("w").alias("deg")))
    nodes = (graph.nodes.select("id", "g").join(deg, "id", "left")
             .select("id", F.coalesce("deg", F.lit(0.0)).alias("deg"), "g"))
    # landmarks may be absent from a problem: every coarse problem is a fine one
    return conjugate_gradient(Graph(inner, nodes, graph.n, graph.total_w), landmarks, sources=sources, **kw)
