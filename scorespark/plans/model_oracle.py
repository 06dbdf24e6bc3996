"""DuckDB SQL that grows the trees and fits the logistic models again, from the same tables and rules."""

from __future__ import annotations

from collections.abc import Sequence

from ..operators.trees import _POISSON as POISSON, DEEPEST, PRIME, STEP, TreeParams


def draw(number: str, tree: str, seed: int) -> str:
    """The arithmetic of ``trees.hashed``: each round is a lambda over a list of one."""
    return (f"list_transform(list_transform(list_transform(list_transform([({number})::BIGINT], "
            f"lambda n: [n, (n * 48271 + {tree} * 69621 + {seed}) % {PRIME}]), "
            f"lambda p: [p[1], (p[2] * p[2] + p[1]) % {PRIME}]), "
            f"lambda p: (p[2] * p[2] + {tree} * 40692 + 11) % {PRIME}), lambda h: (h * h + 1) % {PRIME})[1]")


def poisson(hash_: str) -> str:
    return f"CASE {' '.join(f'WHEN {hash_} < {c} THEN {i}' for i, c in enumerate(POISSON))} ELSE {len(POISSON)} END"


def grown(name: str, rows: str, features: Sequence[str], targets: Sequence[str], params: TreeParams, number: str = "id",
          folds: int = 0) -> str:
    """CTEs ending in ``{name}`` (u, target, fold, tree, r, lvl, node, feature, gain, value): every row's path in every tree.

    ``rows`` is a table with r (unique), id, train (1: fitted on, 0: scored only), fold, the features, and the targets
    as doubles. With folds, a row is scored by the trees without its fold only.
    """
    k = len(features)
    deepest = min(params.maxDepth if params.maxDepth is not None else DEEPEST, DEEPEST)
    y = " ".join(f"WHEN {i} THEN floor({t} * {STEP} + 0.5)::BIGINT" for i, t in enumerate(targets))
    weight = poisson("h") if params.bootstrap else "1"
    hash_ = draw(f"({number}) % {PRIME}", "tree", params.seed) if params.bootstrap else "0"

    def decide(moved: str) -> str:
        """Each row of ``moved`` (lvl, u, r, node, w, y) with its node's totals and split."""
        choice = "true"
        ranked = ""
        if params.tried is not None and params.tried < k:
            node_hash = draw(f"node % {PRIME}", "(tree * 64 + f)", params.seed)
            ranked = (f", offered AS (SELECT DISTINCT u, node, f, {node_hash} AS h FROM cand JOIN {name}_units USING (u)), "
                      "ranked AS (SELECT u, node, f, row_number() OVER (PARTITION BY u, node ORDER BY h, f) AS rk FROM offered)")
            choice = f"(u, node, f) IN (SELECT (u, node, f) FROM ranked WHERE rk <= {params.tried})"
        return f"""WITH m AS ({moved}),
  tot AS (SELECT u, node, sum(w)::DOUBLE AS sw, sum(w * y)::DOUBLE AS ss, min(y) FILTER (w > 0) AS lo, max(y) FILTER (w > 0) AS hi
          FROM m GROUP BY u, node),
  cells AS (SELECT u, node, f, bin, sum(w)::DOUBLE AS w, sum(w * y)::DOUBLE AS s FROM (
    SELECT u, node, w, y, unnest(range(0, {k})) AS f, unnest(b) AS bin FROM m JOIN {name}_bins USING (r) WHERE w > 0) GROUP BY ALL),
  cum AS (SELECT u, node, f, bin, sum(w) OVER win AS wl, sum(s) OVER win AS sl, max(bin) OVER (PARTITION BY u, node, f) AS top
          FROM cells WINDOW win AS (PARTITION BY u, node, f ORDER BY bin)),
  cand AS (SELECT u, node, f, bin, sl * sl / wl + (ss - sl) * (ss - sl) / (sw - wl) AS score, ss * ss / sw AS parent
           FROM cum JOIN tot USING (u, node) WHERE bin < top AND sw >= 2 AND lo < hi){ranked},
  pick AS (SELECT u, node, f, bin, score - parent AS gain FROM cand WHERE {choice}
           QUALIFY row_number() OVER (PARTITION BY u, node ORDER BY score DESC, f, bin) = 1 AND score > parent)
SELECT lvl, m.u, r, m.node, w, y, CASE WHEN sw > 0 THEN ss / (sw * {STEP}) ELSE 0 END AS value,
       CASE WHEN lvl < {deepest} THEN coalesce(f, -1) ELSE -1 END AS feature, bin, gain / {float(STEP) ** 2} AS gain
FROM m JOIN tot ON tot.u = m.u AND tot.node = m.node LEFT JOIN pick ON pick.u = m.u AND pick.node = m.node"""

    used = f"train = 1 AND w > 0 OR {'fold = without' if folds else 'true'}"
    return f"""{name}_units AS (
  SELECT (target * {max(folds, 1)} + without) * {params.numTrees} + tree AS u, target, {'without' if folds else '-1 AS without'}, tree
  FROM range({len(targets)}) a(target), range({max(folds, 1)}) b(without), range({params.numTrees}) c(tree)),
{name}_values AS (SELECT unnest(range(0, {k})) AS f, unnest([{', '.join(features)}]) AS v FROM {rows} WHERE train = 1),
{name}_counts AS (SELECT f, v, count(*) AS n FROM {name}_values GROUP BY f, v),
{name}_runs AS (SELECT f, v, n, sum(n) OVER (PARTITION BY f ORDER BY v) AS run, sum(n) OVER (PARTITION BY f) AS total FROM {name}_counts),
{name}_cuts AS MATERIALIZED (SELECT list(c ORDER BY f) AS cuts FROM (SELECT f, list(v ORDER BY v) AS c FROM {name}_runs
  WHERE ceil(run * {params.maxBins} / total) > ceil((run - n) * {params.maxBins} / total) GROUP BY f)),
{name}_bins AS MATERIALIZED (SELECT r, [{', '.join(f'len(list_filter(cuts[{i + 1}], lambda c: c < {f}))' for i, f in enumerate(features))}] AS b
  FROM {rows}, {name}_cuts),
{name}_start AS (
  SELECT 0 AS lvl, u, r, 1::BIGINT AS node, w::BIGINT AS w, coalesce(y, 0) AS y FROM (
    SELECT u, r, train, fold, without, CASE WHEN train = 0 OR fold = without THEN 0 ELSE {weight} END AS w, y FROM (
      SELECT u, r, train, fold, without, {hash_} AS h, CASE target {y} END AS y FROM {rows}, {name}_units)) WHERE {used}),
{name}_paths AS (
  ({decide(f"SELECT * FROM {name}_start")})
  UNION ALL
  ({decide(f"SELECT lvl + 1 AS lvl, u, r, 2 * node + CASE WHEN b[feature + 1] > bin THEN 1 ELSE 0 END AS node, w, y FROM {name}_paths JOIN {name}_bins USING (r) WHERE feature >= 0")})
),
{name} AS (SELECT p.u, target, without AS fold, tree, r, lvl, node, w, feature, gain, value FROM {name}_paths p JOIN {name}_units USING (u))"""


def leaves(name: str, depth: int | None = None, held_out: bool = False) -> str:
    """(target, fold, tree, r, value): the value each row reaches in each tree, of trees cut at ``depth`` if given."""
    conditions = ([f"lvl <= {depth}"] if depth is not None else []) + (["w = 0"] if held_out else [])
    where = f" WHERE {' AND '.join(conditions)}" if conditions else ""
    return f"SELECT target, fold, tree, r, arg_max(value, lvl) AS value FROM {name}{where} GROUP BY target, fold, tree, r"


def importance(name: str, features: Sequence[str]) -> str:
    """(feature, importance) by the decrease of impurity, averaged over the trees that split."""
    named = ", ".join(f"({i}, '{f}')" for i, f in enumerate(features))
    return f"""SELECT n.name AS feature, coalesce(sum(share) / (SELECT count(DISTINCT u) FROM {name} WHERE feature >= 0), 0) AS importance
FROM (VALUES {named}) n(f, name) LEFT JOIN (
  SELECT u, feature, sum(gain) / sum(sum(gain)) OVER (PARTITION BY u) AS share
  FROM (SELECT DISTINCT u, node, feature, gain FROM {name} WHERE feature >= 0) GROUP BY u, feature) g ON g.feature = n.f
GROUP BY n.f, n.name"""


def newton(name: str, rows: str, features: Sequence[str], label: str, steps: int = 10, strength: float = 1.0) -> str:
    """CTEs ending in ``{name}`` with b0 (intercept), b1, ...: Newton steps on the penalised log loss, each a Gauss elimination."""
    k = len(features) + 1
    x = ["1.0", *features]
    ctes = [f"{name}_0 AS MATERIALIZED (SELECT {', '.join(f'0.0::DOUBLE AS b{i}' for i in range(k))})"]
    for step in range(steps):
        old, new, tag = f"{name}_{step}", f"{name}_{step + 1}", f"{name}_s{step}"
        z = " + ".join(f"b{i} * {c}" for i, c in enumerate(x))
        sums = [f"sum(p * (1 - p) * {x[i]} * {x[j]}) + {1 / strength if i == j and i else 0.0}::DOUBLE AS e{i}_{j}" for i in range(k) for j in range(k)]
        sums += [f"sum(({label} - p) * {x[i]}) - {1 / strength if i else 0.0}::DOUBLE * any_value(b{i}) AS e{i}_{k}" for i in range(k)]
        ctes.append(f"{tag}_0 AS MATERIALIZED (SELECT {', '.join(sums)} FROM (SELECT *, 1 / (1 + exp(-({z}))) AS p FROM {rows}, {old}))")
        for c in range(k):
            out = []
            for i in range(k):
                for j in range(c + 1, k + 1):
                    lead = f"e{c}_{j} / e{c}_{c}"
                    out.append(f"{lead} AS e{i}_{j}" if i == c else f"e{i}_{j} - e{i}_{c} * {lead} AS e{i}_{j}")
            ctes.append(f"{tag}_{c + 1} AS MATERIALIZED (SELECT {', '.join(out)} FROM {tag}_{c})")
        ctes.append(f"{new} AS MATERIALIZED (SELECT {', '.join(f'b{i} + e{i}_{k} AS b{i}' for i in range(k))} FROM {old}, {tag}_{k})")
    ctes.append(f"{name} AS (SELECT * FROM {name}_{steps})")
    return ", ".join(ctes)
