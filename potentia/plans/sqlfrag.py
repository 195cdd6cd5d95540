"""DuckDB SQL fragments used by the oracle queries (independent re-statements of each
operator in plain SQL; nothing here runs on Spark)."""

from __future__ import annotations


def d2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"


def l1(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda t: abs(t[1] - t[2])))"


def linf(a: str, b: str) -> str:
    return f"list_max(list_transform(list_zip({a}, {b}), lambda t: abs(t[1] - t[2])))"


def dotp(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda t: t[1] * t[2]))"


def norm(a: str) -> str:
    return f"sqrt(list_sum(list_transform({a}, lambda v: v * v)))"


EMB_POINTS = ("SELECT vec_id AS id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x, label "
              "FROM embeddings")

LINEITEM_ID = ("CAST(('0x' || substr(md5(CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) "
               "|| ':' || CAST(l_partkey AS VARCHAR) || ':' || CAST(l_suppkey AS VARCHAR) "
               "|| ':' || CAST(CAST(round(l_quantity) AS BIGINT) AS VARCHAR) "
               "|| ':' || CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR)), 1, 15)) AS BIGINT)")

LINEITEM_POINTS = (f"SELECT {LINEITEM_ID} AS id, "
                   "[l_quantity * 0.02, l_extendedprice * 0.00001, l_discount * 10.0, l_tax * 10.0] AS x "
                   "FROM lineitem")


def knn_edges_cte(k: int, pts: str = "pts", n_cte: str = "cnt") -> str:
    """CTE body list (no WITH) producing ``knn(src,dst,d2,rk)``, ``edges(src,dst,w)``."""
    return f"""
pairs AS (SELECT a.id AS src, b.id AS dst, {d2('a.x', 'b.x')} AS d2 FROM {pts} a JOIN {pts} b ON a.id <> b.id),
knn AS (SELECT src, dst, d2, rk FROM (SELECT src, dst, d2,
          row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS rk FROM pairs) WHERE rk <= {k}),
und AS (SELECT src, dst FROM knn UNION SELECT dst AS src, src AS dst FROM knn),
edges AS (SELECT src, dst, ((1.0 / {n_cte}.n) * (1.0 / {n_cte}.n)) / {float(k)!r} AS w FROM und, {n_cte})"""


def jacobi_state(edges: str, nodes: str, lm: str, iters: int) -> str:
    """Recursive CTE ``state(it, problem_id, id, v)``: ``iters`` Jacobi sweeps from 0 V.

    ``nodes(id, inv)`` holds 1/(deg+g); ``lm(problem_id, id, voltage)`` the fixed nodes.
    """
    return f"""
state AS (
  SELECT 0 AS it, pr.problem_id, n.id, CAST(coalesce(l.voltage, 0.0) AS DOUBLE) AS v
  FROM {nodes} n CROSS JOIN (SELECT DISTINCT problem_id FROM {lm}) pr
  LEFT JOIN {lm} l ON l.problem_id = pr.problem_id AND l.id = n.id
  UNION ALL
  SELECT s.it + 1, s.problem_id, e.src,
         CAST(coalesce(max(l.voltage), sum(e.w * s.v) * max(n.inv)) AS DOUBLE)
  FROM state s JOIN {edges} e ON e.dst = s.id JOIN {nodes} n ON n.id = e.src
       LEFT JOIN {lm} l ON l.problem_id = s.problem_id AND l.id = e.src
  WHERE s.it < {iters}
  GROUP BY s.it, s.problem_id, e.src)"""
