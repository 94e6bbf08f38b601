"""Forests in SQL, their levels unrolled: the independent side of the forest queries."""

from __future__ import annotations

from weft.functions.randomness import uniform_sql


def _drawn(k: int, seed: int) -> str:
    return f"""z{k} AS (SELECT tree, node, feature, min(v) AS lo, max(v) AS hi FROM a{k} JOIN fr USING (tree, key) JOIN fv USING (key) WHERE weight > 0 GROUP BY ALL),
d{k} AS (SELECT tree, node, feature, lo + {uniform_sql(seed, 'tree', 'node', 'feature')} * (hi - lo) AS threshold FROM z{k} WHERE hi > lo),
"""


def _best(k: int, task: str) -> str:
    if task == "classification":
        return f"""c{k} AS (SELECT tree, node, feature, threshold, y, coalesce(sum(weight) FILTER (v <= threshold), 0) AS l, sum(weight) AS a FROM a{k} JOIN fr USING (tree, key) JOIN fv USING (key) JOIN d{k} USING (tree, node, feature) WHERE weight > 0 GROUP BY ALL),
s{k} AS (SELECT tree, node, feature, threshold, sum(l)::DOUBLE AS nl, sum(a)::DOUBLE AS n, sum(l * l)::DOUBLE AS ll, sum((a - l) * (a - l))::DOUBLE AS rr, sum(a * a)::DOUBLE AS aa FROM c{k} GROUP BY ALL),
g{k} AS (SELECT *, round((1 - aa / (n * n)) - nl / n * (1 - ll / (nl * nl)) - (n - nl) / n * (1 - rr / ((n - nl) * (n - nl))), 9) AS gain FROM s{k} WHERE nl > 0 AND n > nl),
"""
    return f"""s{k} AS (SELECT tree, node, feature, threshold, coalesce(sum(weight) FILTER (v <= threshold), 0)::DOUBLE AS nl, sum(weight)::DOUBLE AS n, coalesce(sum(y * weight) FILTER (v <= threshold), 0)::DOUBLE AS sl, sum(y * weight)::DOUBLE AS s FROM a{k} JOIN fr USING (tree, key) JOIN fv USING (key) JOIN d{k} USING (tree, node, feature) WHERE weight > 0 GROUP BY ALL),
g{k} AS (SELECT *, round((sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n) / n, 9) AS gain FROM s{k} WHERE nl > 0 AND n > nl),
"""


def grown(depth: int, seed: int = 42, split: str = "best", task: str = "classification", lifetime: float | None = None) -> str:
    """CTEs over fr (tree, key, weight, y) and fv (key, feature, v): nd, the nodes, and leaf, the node that each row ends at.

    Rows of weight 0 are routed but not learned from.
    """
    out = "a0 AS (SELECT tree, key, 1 AS node FROM fr), t0 AS (SELECT DISTINCT tree, 1 AS node, 0.0::DOUBLE AS tau FROM fr),\n"
    for k in range(depth):
        out += _drawn(k, seed)
        if split == "best":
            out += _best(k, task) + f"b{k} AS (SELECT tree, node, feature, threshold FROM g{k} QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY gain DESC, feature) = 1),\n"
        elif split == "random":
            out += f"b{k} AS (SELECT tree, node, feature, threshold FROM d{k} QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY {uniform_sql(seed + 1, 'tree', 'node', 'feature')}, feature) = 1),\n"
        else:
            out += f"""w{k} AS (SELECT tree, node, feature, lo, hi - lo AS width, sum(hi - lo) OVER (PARTITION BY tree, node) AS total, sum(hi - lo) OVER (PARTITION BY tree, node ORDER BY feature) AS upto FROM z{k}),
e{k} AS (SELECT w{k}.*, tau - ln(1 - {uniform_sql(seed + 2, 'tree', 'node')}) / total AS cut FROM w{k} JOIN t{k} USING (tree, node) WHERE total > 0),
b{k} AS (SELECT tree, node, feature, lo + {uniform_sql(seed, 'tree', 'node', 'feature')} * width AS threshold, cut FROM e{k} WHERE cut < {lifetime} AND width > 0 AND upto > {uniform_sql(seed + 3, 'tree', 'node')} * total QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY feature) = 1),
t{k + 1} AS (SELECT tree, node * 2 + side AS node, cut AS tau FROM b{k}, range(2) c(side)),
"""
        out += f"a{k + 1} AS (SELECT tree, key, node * 2 + (v > threshold)::INT AS node FROM a{k} JOIN b{k} USING (tree, node) JOIN fv USING (key, feature)),\n"
    rows = " UNION ALL ".join(f"SELECT {k} AS depth, tree, key, node FROM a{k}" for k in range(depth + 1))
    cuts = " UNION ALL ".join(f"SELECT tree, node, feature, threshold FROM b{k}" for k in range(depth))
    return out + f"""r AS ({rows}), x AS ({cuts}),
nd AS (SELECT tree, node, depth, feature, threshold, sum(weight)::DOUBLE AS n, sum(weight * y)::DOUBLE / sum(weight) AS mean FROM r JOIN fr USING (tree, key) LEFT JOIN x USING (tree, node) WHERE weight > 0 GROUP BY ALL),
leaf AS (SELECT tree, key, arg_max(node, depth) AS node FROM r GROUP BY ALL)
"""


AVERAGE_PATH = "CASE WHEN {0} <= 1 THEN 0.0::DOUBLE WHEN {0} = 2 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * (ln(greatest({0}, 3) - 1.0::DOUBLE) + 0.5772156649015329::DOUBLE) - 2.0::DOUBLE * ({0} - 1) / {0} END"
