"""DuckDB SQL for the registered queries, on the same tables."""

from __future__ import annotations

from dataclasses import replace

from ..schema import FEATURE_RANGES, FEATURES, QUINTILES, WHOLE_FEATURES
from ..operators.classify import forest_params
from ..operators.regression import REGRESSORS, feature_names
from .feature_queries import GRID, GRID_FOLDS
from .marks_queries import GRADES, STUDENT
from ..operators.trees import PRIME
from .model_oracle import grown, importance, leaves, newton
from .model_queries import FOLDS, POOLED_PARAMS, SEARCH
from .tables import BASE, CAPITALS, DIGITS, NEXT, PUNCTUATION, SUBJECTS, TEXT_FEATURES

S = SUBJECTS


def cols(template: str, names=S, sep: str = ", ") -> str:
    return sep.join(template.format(s=s) for s in names)


# --- shared parts ---------------------------------------------------------------------

MARKS = """marks AS (
  SELECT o_orderkey AS id, o_custkey AS student_id, CAST(year(o_orderdate) AS INTEGER) AS year,
         lower(replace(substr(o_orderpriority, 3), ' ', '_')) AS subject,
         CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 4507.0 END AS mark,
         o_orderdate, o_orderstatus
  FROM orders)"""
WIDE = MARKS + f""", wide AS (
  SELECT student_id, c_name AS name, year,
         {cols("avg(CASE WHEN subject = '{s}' THEN mark END) AS {s}")}
  FROM marks JOIN customer ON c_custkey = student_id
  GROUP BY student_id, c_name, year HAVING count(mark) > 0)"""
CLEAN = WIDE + f""", means AS (SELECT {cols("avg({s}) AS m_{s}")} FROM wide),
clean AS (
  SELECT student_id, name, year, {cols("least(100.0, greatest(0.0, coalesce({s}, m_{s}))) AS {s}")},
         CASE WHEN year IN ({BASE}, {NEXT}) THEN year - {BASE} END AS year_encoded
  FROM wide, means)"""
PAIRS = CLEAN + f""", pairs AS (
  SELECT b.student_id, 0 AS year_encoded, {cols("b.{s} AS {s}")}, {cols("n.{s} AS {s}_next")}
  FROM clean b JOIN clean n ON n.student_id = b.student_id
  WHERE b.year = {BASE} AND n.year = {NEXT})"""


def _share(characters: str) -> str:
    return (
        f"CAST(length(text) - length(translate(text, '{characters}', '')) AS DOUBLE)"
        " / greatest(length(text), 1)"
    )


TEXT = f"""words AS (SELECT *, string_split(text, ' ') AS w FROM documents),
text_features AS (
  SELECT d.doc_id AS id, CAST(length(text) AS DOUBLE) AS n_chars, CAST(len(w) AS DOUBLE) AS n_words,
         CAST(len(string_split(text, chr(10))) AS DOUBLE) AS n_lines,
         CAST(length(text) - len(w) + 1 AS DOUBLE) / len(w) AS mean_word_len,
         {_share(DIGITS)} AS digit_ratio, {_share(CAPITALS)} AS upper_ratio,
         {_share(PUNCTUATION)} AS punct_ratio,
         CAST(len(list_distinct(w)) AS DOUBLE) / len(w) AS distinct_ratio,
         CAST(substr(source, 4) AS DOUBLE) AS source_no,
         CAST(1 - quality AS INTEGER) AS label,
         CASE WHEN CAST(substr(source, 4) AS INTEGER) >= 16 THEN 'test' ELSE 'original' END AS split
  FROM words d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
LABELLED = TEXT + ", labelled AS (SELECT * FROM text_features WHERE label IS NOT NULL)"
ENGAGEMENT = """per AS (
  SELECT o_custkey AS id, count(*) AS n, sum(o_totalprice) AS spent,
         count(*) FILTER (o_orderstatus = 'F') AS present
  FROM orders GROUP BY o_custkey),
raw AS (
  SELECT id, c_nationkey % 2 AS gender, 18 + 2 * c_nationkey AS age, 10 * n AS logins,
         spent / 70000 AS total_hours, spent / 350000 AS pct_avg_hours, present AS presence_count,
         n - present AS absence_count, CAST(100 * present AS DOUBLE) / n AS pct_attended,
         CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 1 ELSE 0 END AS attending_from_home,
         abs(c_acctbal) / 40 AS distance_to_uni_km,
         1 + c_nationkey % 5 AS polar4_quintile, c_nationkey % 6 AS polar3_quintile,
         1 + c_nationkey // 5 AS adult_he_2001_quintile, (c_nationkey + 3) % 6 AS adult_he_2011_quintile,
         1 + id % 5 AS tundra_msoa_quintile, 1 + id % 3 AS tundra_lsoa_quintile,
         1 + id % 4 AS gaps_gcse_quintile, 1 + (id + c_nationkey) % 5 AS gaps_gcse_ethnicity_quintile,
         CASE WHEN c_nationkey % 6 = 1 AND 1 + id % 4 <= 2 AND c_acctbal >= 0 THEN 1 ELSE 0 END
           AS uni_connect_target_ward,
         CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS label,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'test' ELSE 'original' END AS split
  FROM customer JOIN per ON id = c_custkey),
engagement AS (SELECT id, """ + cols("CAST({s} AS DOUBLE) AS {s}", FEATURES) + """, label, split FROM raw),
loaded AS (
  SELECT * REPLACE (CASE WHEN logins <= 150 THEN logins END AS logins) FROM engagement)"""
SCORED = LABELLED + """, scored AS (
  SELECT id, label, round(1 / (1 + exp(-(2.0 - 4.0 * distinct_ratio + 20.0 * digit_ratio
         - 0.01 * source_no + 6.0 * upper_ratio))), 3) AS score
  FROM labelled),
predicted AS (SELECT *, CASE WHEN score >= 0.4 THEN 1 ELSE 0 END AS prediction FROM scored)"""
ROUND_S = cols("round({s}, 6) AS {s}")
WIDE_ROWS = f"student_id, name, year, {ROUND_S}"


def long(source: str, keys: str, value: str = "mark", names=S) -> str:
    """One SELECT per subject, in place of an unpivot."""
    return " UNION ALL ".join(f"SELECT {keys}, '{s}' AS subject, {s} AS {value} FROM {source}" for s in names)


def row_mean(names=S) -> str:
    total = " + ".join(f"coalesce({s}, 0)" for s in names)
    present = " + ".join(f"CASE WHEN {s} IS NULL THEN 0 ELSE 1 END" for s in names)
    return f"(({total}) / nullif({present}, 0))"


def extreme(function: str) -> str:
    """Name of the first subject that holds the row's greatest or least score."""
    best = f"{function}({', '.join(S)})"
    whens = " ".join(f"WHEN {s} = {best} THEN '{s}'" for s in S)
    return f"CASE {whens} END"


# --- least squares in SQL: moments, then one elimination step per feature ------------------

CELLS_OF = """count(*) FILTER (label = 1 AND {0} = 1) AS tp, count(*) FILTER (label = 0 AND {0} = 1) AS fp,
       count(*) FILTER (label = 1 AND {0} = 0) AS fn, count(*) FILTER (label = 0 AND {0} = 0) AS tn"""


def solve(source: str, group: str = "g") -> str:
    """CTEs ending in ``coef``: one row per group with b_{subject}_{feature} and a_{subject}."""
    k = len(S)
    moments = [f"avg({s}) AS mx_{i}" for i, s in enumerate(S)]
    moments += [f"avg({s}_next) AS my_{i}" for i, s in enumerate(S)]
    for i, a in enumerate(S):
        moments += [f"covar_pop({a}, {b}) AS e0_{i}_{j}" for j, b in enumerate(S)]
        moments += [f"covar_pop({a}, {b}_next) AS e0_{i}_{k + j}" for j, b in enumerate(S)]
    means = ", ".join([f"mx_{i}" for i in range(k)] + [f"my_{i}" for i in range(k)])
    ctes = [f"m0 AS (SELECT {group}, {', '.join(moments)} FROM {source} GROUP BY {group})"]
    for p in range(k):
        cells = []
        for i in range(k):
            for j in range(2 * k):
                pivot_row = f"e{p}_{p}_{j} / e{p}_{p}_{p}"
                cell = pivot_row if i == p else f"e{p}_{i}_{j} - e{p}_{i}_{p} * ({pivot_row})"
                cells.append(f"{cell} AS e{p + 1}_{i}_{j}")
        ctes.append(f"m{p + 1} AS (SELECT {group}, {means}, {', '.join(cells)} FROM m{p})")
    out = []
    for t, target in enumerate(S):
        out += [f"e{k}_{i}_{k + t} AS b_{target}_{f}" for i, f in enumerate(S)]
        shift = " - ".join(f"e{k}_{i}_{k + t} * mx_{i}" for i in range(k))
        out.append(f"my_{t} - {shift} AS a_{target}")
    return ", ".join(ctes) + f", coef AS (SELECT {group}, {', '.join(out)} FROM m{k})"


def linear(target: str, row: str = "r", coef: str = "c") -> str:
    return f"{coef}.a_{target} + " + " + ".join(f"{coef}.b_{target}_{f} * {row}.{f}" for f in S)


def clip(expression: str) -> str:
    return f"least(100.0, greatest(0.0, {expression}))"


FITTED = PAIRS + ", one AS (SELECT 1 AS g, * FROM pairs), " + solve("one")
AHEAD = FITTED + f""", ahead AS (
  SELECT r.student_id, {", ".join(clip(linear(s)) + f" AS {s}" for s in S)}
  FROM clean r, coef c WHERE r.year = {NEXT})"""
COEFFICIENTS = " UNION ALL ".join(
    [f"SELECT '{t}' AS subject, 'intercept' AS feature, round(a_{t}, 6) AS coefficient FROM coef" for t in S]
    + [f"SELECT '{t}', '{f}', round(b_{t}_{f}, 6) FROM coef" for t in S for f in S]
)
TREE_CHECKS = f"""WITH {CLEAN} SELECT model, subject, count(*) AS n_rows, 0::BIGINT AS outside,
  0::BIGINT AS again_differs, 0::BIGINT AS stored_differs, true AS beats_mean
  FROM clean, (VALUES ('DecisionTree'), ('RandomForest')) m(model), (VALUES {", ".join(f"('{s}')" for s in S)}) s(subject)
  WHERE year = {NEXT} GROUP BY model, subject"""
POOLED = CLEAN + f""", pooled AS (
  SELECT b.student_id, b.year, {cols("b.{s} AS {s}")}, {cols("n.{s} AS {s}_next")}
  FROM clean b JOIN clean n ON n.student_id = b.student_id AND n.year = b.year + 1)"""
FOLDED = PAIRS + f""", folded AS (
  SELECT *, CAST(ntile({FOLDS}) OVER (ORDER BY student_id) - 1 AS INTEGER) AS fold FROM pairs)"""
CV = FOLDED + f""", numbers AS (SELECT DISTINCT fold AS g FROM folded),
train AS (SELECT -1 AS g, f.* FROM folded f UNION ALL
          SELECT n.g, f.* FROM folded f, numbers n WHERE f.fold <> n.g), {solve("train")},
errors AS ({" UNION ALL ".join(
    f"SELECT '{s}' AS subject, c.g, r.{s}_next - ({linear(s)}) AS e FROM folded r JOIN coef c "
    f"ON c.g = r.fold OR c.g = -1" for s in S)}),
fold_rmse AS (SELECT subject, g, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae FROM errors GROUP BY subject, g)"""


# --- trees: grown again from the pairs, scored on them (odd r) and on the following year (even r) --------

X = feature_names(S)
Y = [f"{s}_next" for s in S]
SUBJECT = f"[{', '.join(repr(s) for s in S)}][target + 1]"
TREE, FOREST = REGRESSORS["DecisionTree"], REGRESSORS["RandomForest"]


def tree_rows(source: str, key: str = "student_id", fold: str = "-2") -> str:
    """CTE tree_rows: pairs to fit on, and the rows of the following year."""
    return f"""tree_rows AS (
  SELECT 2 * row_number() OVER (ORDER BY {key}) + 1 AS r, {key}, 1 AS train, {fold} AS fold, 0.0::DOUBLE AS year_encoded,
         {cols("{s}")}, {cols("{s}_next")} FROM {source}
  UNION ALL SELECT 2 * row_number() OVER (ORDER BY student_id), student_id{"" if key == "student_id" else ", 0"}, 0, -3, 1.0, {cols("{s}")}, {cols("NULL")}
  FROM clean WHERE year = {NEXT})"""


def scores(name: str, model: str) -> str:
    """(model, subject, student_id, r, v): means over the trees."""
    return (f"SELECT '{model}' AS model, {SUBJECT} AS subject, student_id, r, round(avg(value), 12) AS v "
            f"FROM ({leaves(name)}) JOIN tree_rows USING (r) GROUP BY target, student_id, r")


TRUTH = " UNION ALL ".join(f"SELECT r, '{s}' AS subject, {s}_next AS y FROM tree_rows WHERE train = 1" for s in S)
TREES = f"""{PAIRS}, {tree_rows("pairs")}, {grown("one_tree", "tree_rows", X, Y, TREE, "student_id")}, {grown("forest", "tree_rows", X, Y, FOREST, "student_id")},
predicted AS ({scores("one_tree", "DecisionTree")} UNION ALL {scores("forest", "RandomForest")}), truth AS ({TRUTH})"""
FORECASTS = f"SELECT student_id, subject, round({clip('v')}, 6) AS predicted_mark, model AS model_used FROM predicted WHERE r % 2 = 0"
LINEAR_ALL = f"""one AS (SELECT 1 AS g, * FROM pairs), {solve("one")},
line AS ({" UNION ALL ".join(f"SELECT 'LinearRegression' AS model, '{s}' AS subject, r.student_id, r.r, {linear(s)} AS v FROM tree_rows r, coef c" for s in S)}),
everything AS (SELECT * FROM predicted UNION ALL SELECT * FROM line),
in_sample AS (SELECT model, subject, sqrt(avg((y - v) ** 2)) AS rmse, avg(abs(y - v)) AS mae
              FROM everything JOIN truth USING (r, subject) GROUP BY model, subject),
best AS (SELECT * FROM in_sample QUALIFY row_number() OVER (PARTITION BY subject ORDER BY rmse, model) = 1)"""


def fold_errors(name: str, model: str) -> str:
    """Out-of-fold RMSE per subject and fold."""
    return (f"SELECT '{model}' AS model, subject, fold, sqrt(avg((y - v) ** 2)) AS rmse FROM ("
            f"SELECT {SUBJECT} AS subject, fold, r, round(avg(value), 12) AS v FROM ({leaves(name, held_out=True)}) GROUP BY target, fold, r) "
            "JOIN truth USING (r, subject) GROUP BY subject, fold")


FOLD_ROWS = f"""fold_rows AS (SELECT t.* REPLACE (f.fold AS fold) FROM tree_rows t JOIN folded f USING (student_id) WHERE train = 1)"""
EVALUATION = f"""{CV}, {tree_rows("pairs")}, {FOLD_ROWS}, truth AS ({TRUTH}),
{grown("one_tree", "tree_rows", X, Y, TREE, "student_id")}, {grown("forest", "tree_rows", X, Y, FOREST, "student_id")},
{grown("fold_tree", "fold_rows", X, Y, TREE, "student_id", FOLDS)}, {grown("fold_forest", "fold_rows", X, Y, FOREST, "student_id", FOLDS)},
predicted AS ({scores("one_tree", "DecisionTree")} UNION ALL {scores("forest", "RandomForest")}),
in_sample AS (SELECT model, subject, sqrt(avg((y - v) ** 2)) AS rmse, avg(abs(y - v)) AS mae
              FROM predicted JOIN truth USING (r, subject) GROUP BY model, subject
              UNION ALL SELECT 'LinearRegression', subject, rmse, mae FROM fold_rmse WHERE g = -1),
held_out AS ({fold_errors("fold_tree", "DecisionTree")} UNION ALL {fold_errors("fold_forest", "RandomForest")}
             UNION ALL SELECT 'LinearRegression', subject, g, rmse FROM fold_rmse WHERE g >= 0)"""


def search(name: str, params, value: str, rows: str) -> str:
    """One SELECT per combination of a grid over the same trees."""
    out = []
    for depth in params["maxDepth"]:
        for size in params["numTrees"]:
            cut = f"SELECT {value}, fold, r, round(avg(value), 12) AS v FROM ({leaves(name, depth, True)}) WHERE tree < {size} GROUP BY target, fold, r"
            out.append(f"SELECT {depth} AS maxDepth, {size} AS numTrees, q.* FROM ({rows.format(cut=cut)}) q")
    return " UNION ALL ".join(out)


# --- classifiers: scaled features of the labelled documents ------------------------------------------------

RISK = LABELLED + f""", scaler AS (
  SELECT {cols("avg({s}) AS m_{s}, coalesce(nullif(stddev_pop({s}), 0), 1) AS s_{s}", TEXT_FEATURES)} FROM labelled WHERE split <> 'test'),
risk_rows AS (
  SELECT id AS r, id, CASE WHEN split = 'test' THEN 0 ELSE 1 END AS train, -2 AS fold,
         {cols("({s} - m_{s}) / s_{s} AS {s}", TEXT_FEATURES)}, label::DOUBLE AS label FROM labelled, scaler),
risk_train AS (SELECT * FROM risk_rows WHERE train = 1)"""
RISK_FOREST = grown("forest", "risk_rows", TEXT_FEATURES, ["label"], forest_params(len(TEXT_FEATURES)))
FOREST_SCORES = "SELECT r AS id, round(avg(value), 12) AS p FROM (" + leaves("forest") + ") JOIN risk_rows USING (r) WHERE train = 0 GROUP BY r"
LOGISTIC = newton("newton", "risk_train", TEXT_FEATURES, "label")
LOGISTIC_Z = " + ".join(["b0", *[f"b{i + 1} * {f}" for i, f in enumerate(TEXT_FEATURES)]])
LOGISTIC_SCORES = f"SELECT id, 1 / (1 + exp(-({LOGISTIC_Z}))) AS p FROM risk_rows, newton WHERE train = 0"
CLASSIFIED = f"""{RISK}, {RISK_FOREST}, {LOGISTIC},
judged AS (SELECT 'RandomForest' AS model, * FROM ({FOREST_SCORES}) UNION ALL SELECT 'LogisticRegression', * FROM ({LOGISTIC_SCORES})),
known AS (SELECT model, p, (p > 0.5)::INT AS got, label::INT AS label FROM judged JOIN risk_rows USING (id)),
cells AS (SELECT model, {CELLS_OF.format("got")} FROM known GROUP BY model),
ranked AS (SELECT model, label, rank() OVER w + (count(*) OVER (PARTITION BY model, p) - 1) / 2.0 AS rk
           FROM known WINDOW w AS (PARTITION BY model ORDER BY p)),
areas AS (SELECT model, CASE WHEN count(*) > sum(label) AND sum(label) > 0 THEN
            (sum(rk) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) END AS roc_auc
          FROM ranked GROUP BY model),
evaluated AS (
  SELECT model, (tp + tn) / (tp + tn + fp + fn) AS accuracy,
         (coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2.0 * tn / nullif(2 * tn + fp + fn, 0), 0))
           / ((tp + fp + fn > 0)::INT + (tn + fp + fn > 0)::INT) AS f1_macro,
         roc_auc, coalesce(tp / nullif(tp + fn, 0), 0) AS recall_fail FROM cells JOIN areas USING (model))"""
EVALUATED = ("model, round(accuracy, 6) AS accuracy, round(f1_macro, 6) AS f1_macro, round(roc_auc, 6) AS roc_auc, "
             "round(recall_fail, 6) AS recall_fail FROM evaluated")


def correlation(a: str, b: str, source: str) -> str:
    return (
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, "
        f"CASE WHEN count(*) > 0 AND stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 "
        f"THEN round(corr({a}, {b}), 6) + 0.0 END AS correlation FROM {source} "
        f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
    )


def grade_case(value: str) -> str:
    whens = " ".join(
        f"WHEN {value} >= {cut} THEN '{name}'" for name, cut in sorted(GRADES.items(), key=lambda g: -g[1])
    )
    return f"CASE WHEN {value} IS NULL THEN NULL {whens} ELSE 'F' END"


def out_of_range(feature: str) -> str:
    low, high = FEATURE_RANGES[feature]
    test = f"{feature} < {low} OR {feature} > {high}"
    return f"{test} OR {feature} <> floor({feature})" if feature in WHOLE_FEATURES else test


BY_STUDENT = WIDE + f""", by_student AS (
  SELECT student_id, name, {cols("avg({s}) AS {s}")} FROM wide GROUP BY student_id, name)"""
OVERALL = WIDE + f""", overall AS (
  SELECT student_id, name, avg({row_mean()}) AS overall_mean FROM wide GROUP BY student_id, name)"""


def change(source: str) -> str:
    deltas = [f"n.{s} - b.{s}" for s in S]
    total = " + ".join(f"coalesce({d}, 0)" for d in deltas)
    present = " + ".join(f"CASE WHEN {d} IS NULL THEN 0 ELSE 1 END" for d in deltas)
    return f"""change AS (
  SELECT b.student_id, b.name, {cols("b.{s} AS {s}_1997")}, {cols("n.{s} AS {s}_1998")},
         {cols("n.{s} - b.{s} AS {s}_delta")}, ({total}) / nullif({present}, 0) AS overall_delta
  FROM {source} b JOIN {source} n ON n.student_id = b.student_id
  WHERE b.year = {BASE} AND n.year = {NEXT})"""


PER_SCORE = SCORED + """, per_score AS (
  SELECT score AS threshold, CAST(sum(label) AS BIGINT) AS p, CAST(sum(1 - label) AS BIGINT) AS n
  FROM predicted GROUP BY score),
running AS (
  SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, row_number() OVER w AS pos,
         lead(p) OVER w AS next_p, lead(n) OVER w AS next_n, sum(p) OVER () AS all_p, sum(n) OVER () AS all_n
  FROM per_score WINDOW w AS (ORDER BY threshold DESC))"""
AUC = "(SELECT sum(n * (tp - p / 2.0)) / (sum(p) * sum(n)) FROM running)"
CELLS = CELLS_OF.format("prediction")
CLASSIFIER = PER_SCORE + f""", cells AS (SELECT {CELLS} FROM predicted),
bundle AS (
  SELECT (tp + tn) / (tp + tn + fp + fn) AS accuracy,
         (2.0 * tp / (2 * tp + fp + fn) + 2.0 * tn / (2 * tn + fp + fn)) / 2 AS f1_macro,
         {AUC} AS roc_auc, tp / (tp + fn) AS recall_fail FROM cells)"""
NUMBERED = ENGAGEMENT + f""", distinct_rows AS (
  SELECT {", ".join(FEATURES)}, label, min(split) AS split FROM loaded GROUP BY {", ".join(FEATURES)}, label),
numbered AS (
  SELECT row_number() OVER (ORDER BY split, {cols("{s} NULLS FIRST", FEATURES)}, label) AS id, *
  FROM distinct_rows)"""
ROUND_F = cols("round({s}, 6) AS {s}", FEATURES)
ROUND_T = cols("round({s}, 6) AS {s}", TEXT_FEATURES)

ORACLE: dict[str, str] = {
    # scans and joins
    "marks_joined": f"WITH {MARKS} SELECT student_id, c_name AS name, year, subject, round(mark, 6) AS mark "
                    "FROM marks JOIN customer ON c_custkey = student_id ORDER BY student_id, year, subject",
    "marks_wide": f"WITH {WIDE} SELECT {WIDE_ROWS} FROM wide",
    "entity_marks": f"WITH {WIDE} SELECT {WIDE_ROWS} FROM wide WHERE student_id = {STUDENT}",
    "entity_period_row": f"WITH {WIDE} SELECT {WIDE_ROWS} FROM wide "
                         f"WHERE student_id = {STUDENT} AND year = {NEXT} ORDER BY year LIMIT 1",
    "ordered_history": f"WITH {WIDE} SELECT student_id, year, {ROUND_S} FROM wide ORDER BY student_id, year",
    "dimension_scan": "SELECT c_custkey AS student_id, c_name AS name FROM customer ORDER BY 1",
    "distinct_keys": "SELECT DISTINCT o_custkey AS student_id FROM orders ORDER BY 1",
    "distinct_periods": "SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders ORDER BY 1",
    "next_period_pairs": f"WITH {PAIRS} SELECT student_id, year_encoded, {ROUND_S}, "
                         f"{cols('round({s}_next, 6) AS {s}_next')} FROM pairs",
    "pooled_pairs": f"WITH {POOLED} SELECT student_id, year, {ROUND_S}, "
                    f"{cols('round({s}_next, 6) AS {s}_next')} FROM pooled",
    "fk_violations": f"WITH {MARKS} SELECT student_id, count(*) AS n_rows FROM marks WHERE student_id NOT IN "
                     "(SELECT c_custkey FROM customer WHERE c_acctbal >= 0) GROUP BY student_id",
    "insert_or_ignore": f"WITH {MARKS} SELECT student_id, subject, id, round(mark, 6) AS mark FROM marks m "
                        "WHERE year > 1995 AND NOT EXISTS (SELECT 1 FROM marks k WHERE k.year <= 1995 "
                        "AND k.student_id = m.student_id AND k.subject = m.subject) "
                        "QUALIFY row_number() OVER (PARTITION BY student_id, subject ORDER BY id) = 1",
    "union_sources": "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, 'customer' AS split "
                     "FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, 'supplier' FROM supplier",
    "dedup_first": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice "
                   "FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber "
                   "ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity) = 1",
    # cleaning
    "clean_marks": f"WITH {CLEAN} SELECT {WIDE_ROWS}, CAST(year_encoded AS INTEGER) AS year_encoded FROM clean",
    "impute_by_period": f"WITH {WIDE} SELECT student_id, name, year, "
                        f"{cols('round(coalesce({s}, avg({s}) OVER (PARTITION BY year)), 6) AS {s}')} FROM wide",
    "imputation_log": f"WITH {WIDE}, filled AS (SELECT student_id, year, "
                      f"{cols('CASE WHEN {s} IS NULL THEN avg({s}) OVER (PARTITION BY year) END AS {s}')} FROM wide), "
                      f"cells AS ({long('filled', 'student_id, year', 'v')}) "
                      "SELECT student_id, year, subject, round(v, 6) AS imputed_value FROM cells WHERE v IS NOT NULL",
    "minmax_norm": f"WITH {WIDE} SELECT student_id, year, {ROUND_S}, "
                   f"{cols('round(({s} - min({s}) OVER ()) / (max({s}) OVER () - min({s}) OVER ()), 6) AS {s}_norm')} "
                   "FROM wide",
    "nan_null": "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, "
                "count(*) FILTER (o_totalprice < 50000) AS n_missing, "
                "round(avg(o_totalprice) FILTER (o_totalprice >= 50000), 6) AS mean, "
                "round(max(o_totalprice) FILTER (o_totalprice >= 50000), 6) AS top FROM orders GROUP BY 1",
    "ensure_wide": f"WITH {MARKS} SELECT student_id, year, "
                   f"""{cols("round(avg(CASE WHEN subject = '{s}' THEN mark END), 6) AS {s}")} """
                   "FROM marks GROUP BY student_id, year HAVING count(mark) > 0",
    "unpivot_load": f"WITH {WIDE}, cells AS ({long('wide', 'student_id, year')}) "
                    "SELECT student_id, year, subject, round(mark, 6) AS mark FROM cells",
    "csv_round_trip": f"WITH {CLEAN} SELECT {WIDE_ROWS}, CAST(year_encoded AS INTEGER) AS year_encoded FROM clean",
    "cohort_upload": f"WITH {WIDE}, cells AS ({long('wide', 'student_id, year')}) "
                     f"SELECT student_id, year, subject, round(mark, 6) AS mark FROM cells WHERE year > {BASE}",
    "cohort_students": f"WITH {WIDE} SELECT DISTINCT student_id, name FROM wide w WHERE year >= {BASE} "
                       f"AND NOT EXISTS (SELECT 1 FROM wide o WHERE o.student_id = w.student_id AND o.year <= {BASE})",
    # descriptive statistics
    "subject_averages": f"WITH {CLEAN}, cells AS ({long('clean', 'student_id')}) "
                        "SELECT subject, round(avg(mark), 6) AS average FROM cells GROUP BY subject ORDER BY 2 DESC",
    "entity_averages": f"WITH {WIDE} SELECT student_id, round({row_mean()}, 6) AS average FROM wide "
                       f"WHERE year = {NEXT} ORDER BY 2",
    "class_progress": f"WITH {CLEAN} SELECT year, {cols('round(avg({s}), 6) AS {s}')} FROM clean GROUP BY year ORDER BY year",
    "entity_progress": f"WITH {WIDE}, cells AS ({long('wide', 'student_id, year')}) SELECT student_id, year, subject, "
                       "round(mark, 6) AS mark FROM cells ORDER BY student_id, subject, year",
    "entity_comparison": f"WITH {WIDE}, cells AS ({long('wide', 'student_id, year')}) SELECT student_id, subject, "
                         f"round(avg(mark) FILTER (year = {BASE}), 6) AS y{BASE}, "
                         f"round(avg(mark) FILTER (year = {NEXT}), 6) AS y{NEXT} FROM cells "
                         f"WHERE year IN ({BASE}, {NEXT}) GROUP BY student_id, subject",
    "subject_summary": f"WITH {CLEAN}, cells AS ({long('clean', 'student_id')}) SELECT subject, "
                       "round(avg(mark), 6) AS mean, round(median(mark), 6) AS median, "
                       "round(stddev_samp(mark), 6) AS std FROM cells GROUP BY subject",
    "subject_summary_raw": f"WITH {WIDE}, cells AS ({long('wide', 'student_id')}) SELECT subject, "
                           "round(avg(mark), 6) AS mean, round(median(mark), 6) AS median, "
                           "round(stddev_samp(mark), 6) AS std FROM cells GROUP BY subject",
    "entity_summary": f"WITH {WIDE} SELECT student_id, name, year, round({row_mean()}, 6) AS overall_mean, "
                      f"{extreme('greatest')} AS best_subject, {extreme('least')} AS worst_subject FROM wide",
    "corr_matrix": f"WITH {WIDE}, r AS ({' UNION ALL '.join(correlation(a, b, 'wide') for a in S for b in S)}) "
                   f"""SELECT feature_a AS feature, {cols("max(CASE WHEN feature_b = '{s}' THEN correlation END) AS {s}")} """
                   "FROM r GROUP BY feature_a",
    "top_performers": f"WITH {OVERALL} SELECT student_id, name, round(overall_mean, 6) AS overall_mean FROM overall "
                      "ORDER BY overall.overall_mean DESC, student_id LIMIT 3",
    "failing_entities": f"WITH {BY_STUDENT}, cells AS ({long('by_student', 'student_id, name', 'v')}) "
                        "SELECT student_id, name, subject, round(v, 6) AS subject_avg FROM cells WHERE v < 50",
    "period_change": f"WITH {WIDE}, {change('wide')} SELECT student_id, name, "
                     f"{cols('round({s}_delta, 6) AS {s}_delta')}, round(overall_delta, 6) AS overall_delta FROM change",
    "overview_kpis": f"WITH {OVERALL}, {change('wide')}, top AS (SELECT * FROM overall ORDER BY overall_mean DESC, "
                     "student_id LIMIT 1), improved AS (SELECT * FROM change "
                     "ORDER BY overall_delta DESC NULLS LAST, student_id LIMIT 1) "
                     f"SELECT (SELECT round(avg({row_mean()}), 6) FROM wide) AS class_average, "
                     "top.student_id AS top_student, round(top.overall_mean, 6) AS top_mean, "
                     "improved.student_id AS most_improved, round(improved.overall_delta, 6) AS best_delta "
                     "FROM top, improved",
    "entity_alerts": f"WITH {BY_STUDENT} SELECT student_id, name, round({row_mean()}, 6) AS overall_mean, "
                     f"{extreme('greatest')} AS best_subject, {extreme('least')} AS worst_subject, "
                     f"{cols('coalesce({s} < 50, false)', sep=' OR ')} AS alert FROM by_student",
    "grade_bins": f"WITH {MARKS}, clipped AS (SELECT subject, CASE WHEN mark IS NOT NULL THEN {clip('mark')} END AS v "
                  f"FROM marks) SELECT subject, {grade_case('v')} AS grade, count(*) AS n_rows FROM clipped GROUP BY 1, 2",
    "formatted_ids": "SELECT c_custkey AS student_id, printf('S%03d', c_custkey) AS display_id, c_name AS name FROM customer",
    "prediction_log": f"WITH {MARKS} SELECT student_id, subject, CASE WHEN mark IS NOT NULL THEN "
                      f"round({clip('mark')}, 6) END AS predicted_mark, o_orderstatus AS model_used, "
                      "CAST(o_orderdate AS DATE) AS created_at FROM marks",
    "prediction_log_latest": f"WITH {MARKS} SELECT student_id, subject, CASE WHEN mark IS NOT NULL THEN "
                             f"round({clip('mark')}, 6) END AS predicted_mark, o_orderstatus AS model_used, "
                             "CAST(o_orderdate AS DATE) AS created_at FROM marks "
                             f"WHERE student_id = {STUDENT} ORDER BY o_orderdate DESC",
    # feature tables
    "messy_csv_load": f"WITH {ENGAGEMENT} SELECT {ROUND_F}, label, 'original' AS split FROM loaded",
    "feature_table_report": f"WITH {NUMBERED} SELECT count(*) AS kept, "
                            "CAST(any_value((SELECT max(label) FROM engagement)) AS BIGINT) AS dropped, "
                            "count(*) FILTER (label = 0) AS passes, count(*) FILTER (label = 1) AS fails "
                            "FROM (SELECT DISTINCT * EXCLUDE (id, split) FROM numbered)",
    "split_scan": f"WITH {NUMBERED} SELECT id, {ROUND_F}, label, split FROM numbered WHERE split = 'test' ORDER BY id",
    "train_test_pair": f"WITH {ENGAGEMENT} SELECT CASE split WHEN 'test' THEN 'test' ELSE 'train' END AS part, label, "
                       "count(*) AS n_rows, round(avg(pct_attended), 6) AS mean_attended, "
                       "round(max(pct_attended), 6) AS top_attended FROM loaded GROUP BY 1, 2",
    "drop_null_label": f"WITH {TEXT} SELECT count(label) AS kept, count(*) FILTER (label IS NULL) AS dropped, "
                       "count(*) FILTER (label = 0) AS passes, count(*) FILTER (label = 1) AS fails FROM text_features",
    "feature_label_split": f"WITH {ENGAGEMENT} SELECT {ROUND_F} FROM engagement WHERE split = 'original'",
    "label_column": f"WITH {ENGAGEMENT} SELECT label FROM engagement WHERE split = 'original'",
    "class_distribution": f"WITH {LABELLED} SELECT label, count(*) AS n_rows, "
                          "CASE label WHEN 0 THEN 'Pass' ELSE 'Fail' END AS class FROM labelled GROUP BY label ORDER BY label",
    "label_kpis": f"WITH {LABELLED}, k AS (SELECT count(*) AS total, count(*) FILTER (label = 0) AS passes, "
                  "count(*) FILTER (label = 1) AS fails FROM labelled) SELECT *, round(fails / greatest(1, total), 6) "
                  "AS fail_rate, printf('%.1f%%', 100.0 * fails / greatest(1, total)) AS fail_rate_text FROM k",
    "labelled_names": f"WITH {LABELLED} SELECT id, CASE label WHEN 0 THEN 'Pass' ELSE 'Fail' END AS class FROM labelled",
    "sentinel_null": f"WITH {ENGAGEMENT} SELECT id, {cols('nullif({s}, 0) AS {s}', QUINTILES)} FROM engagement",
    "standard_scale": f"WITH {LABELLED} SELECT id, " + cols(
        "round(({s} - avg({s}) OVER ()) / coalesce(nullif(stddev_pop({s}) OVER (), 0), 1), 6) AS {s}", TEXT_FEATURES
    ) + " FROM labelled",
    "feature_corr_matrix": f"WITH {ENGAGEMENT} " + " UNION ALL ".join(
        correlation(a, b, "engagement") for a in FEATURES for b in FEATURES
    ),
    "domain_violations": f"WITH {ENGAGEMENT} " + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, count(*) FILTER ({out_of_range(f)}) AS violations FROM engagement" for f in FEATURES
    ),
    "within_domain": f"WITH {ENGAGEMENT} SELECT id, {ROUND_F} FROM engagement WHERE "
                     + " AND ".join(f"NOT ({out_of_range(f)})" for f in FEATURES),
    "flag_rule_check": f"WITH {ENGAGEMENT}, r AS (SELECT polar3_quintile = 1 AND gaps_gcse_quintile IN (1, 2) AS want, "
                       "uni_connect_target_ward = 1 AS got FROM engagement) SELECT count(*) AS checked, "
                       "count(*) FILTER (want AND NOT got) AS flag_absent, "
                       "count(*) FILTER (NOT want AND got) AS flag_unexpected FROM r",
    # metrics
    "logistic_squash": f"WITH {SCORED} SELECT id, label, round(score, 6) AS score, prediction FROM predicted",
    "confusion_matrix": f"WITH {SCORED}, cells AS (SELECT {CELLS} FROM predicted) "
                        "SELECT 0 AS actual, 0 AS predicted, tn AS n_rows FROM cells "
                        "UNION ALL SELECT 0, 1, fp FROM cells UNION ALL SELECT 1, 0, fn FROM cells "
                        "UNION ALL SELECT 1, 1, tp FROM cells",
    "classifier_metrics": f"WITH {CLASSIFIER} SELECT round(accuracy, 6) AS accuracy, round(f1_macro, 6) AS f1_macro, "
                          "round(recall_fail, 6) AS recall_fail FROM bundle",
    "roc_auc": f"WITH {CLASSIFIER} SELECT round(roc_auc, 6) AS roc_auc FROM bundle",
    "roc_curve": f"WITH {PER_SCORE} SELECT CAST('inf' AS DOUBLE) AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr "
                 "UNION ALL SELECT round(threshold, 6), round(fp / all_n, 6), round(tp / all_p, 6) FROM running "
                 "WHERE pos = 1 OR next_p IS NULL OR p <> next_p OR n <> next_n",
    "classifier_bundle": f"WITH {CLASSIFIER} SELECT round(accuracy, 6) AS accuracy, round(f1_macro, 6) AS f1_macro, "
                         "round(roc_auc, 6) AS roc_auc, round(recall_fail, 6) AS recall_fail FROM bundle",
    "quality_gates": f"WITH {CLASSIFIER} SELECT accuracy >= 0.7 AS accuracy_ok, recall_fail > 0 AS recall_ok FROM bundle",
    "label_log": f"WITH {SCORED} SELECT id AS vle_student_id, prediction AS predicted_label, score AS predicted_proba, "
                 "'fixed' AS model_used FROM predicted",
    "label_log_latest": f"WITH {SCORED} SELECT id AS vle_student_id, prediction AS predicted_label, score AS predicted_proba, "
                        "'fixed' AS model_used FROM predicted WHERE id = (SELECT min(id) FROM predicted)",
    "classifier_checks": f"WITH {LABELLED} SELECT model, count(*) AS n_rows, 0::BIGINT AS wrong_labels, 0::BIGINT AS outside, "
                         "0::BIGINT AS again_differs, 0::BIGINT AS stored_differs, 1.0::DOUBLE AS importances FROM labelled, "
                         "(VALUES ('LogisticRegression'), ('RandomForest')) m(model) WHERE split = 'test' GROUP BY model",
    # regressions
    "ols_coefficients": f"WITH {FITTED} {COEFFICIENTS}",
    "ols_predictions": f"WITH {AHEAD}, cells AS ({long('ahead', 'student_id', 'v')}) SELECT student_id, subject, "
                       "round(v, 6) AS predicted_mark, 'LinearRegression' AS model_used FROM cells",
    "predictions_long": f"WITH {AHEAD}, cells AS ({long('ahead', 'student_id', 'v')}) SELECT student_id, subject, "
                        "round(v, 6) AS predicted_mark FROM cells ORDER BY student_id, v",
    "ols_cv": f"WITH {CV} SELECT 'LinearRegression' AS model, subject, round(max(rmse) FILTER (g = -1), 6) AS RMSE, "
              "round(max(mae) FILTER (g = -1), 6) AS MAE, round(avg(rmse) FILTER (g >= 0), 6) AS mean, "
              "round(stddev_pop(rmse) FILTER (g >= 0), 6) AS std FROM fold_rmse GROUP BY subject",
    "fold_sizes": f"WITH {FOLDED} SELECT fold, count(*) AS n_rows, min(student_id) AS first_id, "
                  "max(student_id) AS last_id FROM folded GROUP BY fold",
    "rmse_mae": f"WITH {PAIRS} " + " UNION ALL ".join(
        f"SELECT '{s}' AS subject, round(sqrt(avg(({s}_next - {s}) ** 2)), 6) AS RMSE, "
        f"round(avg(abs({s}_next - {s})), 6) AS MAE, round(least(min({s}), min({s}_next)), 6) AS low, "
        f"round(greatest(max({s}), max({s}_next)), 6) AS high FROM pairs" for s in S
    ),
    "actual_vs_predicted": f"WITH {FITTED} " + " UNION ALL ".join(
        f"SELECT r.student_id, 'LinearRegression' AS model, '{s}' AS subject, round(r.{s}_next, 6) AS y_true, "
        f"round({linear(s)}, 6) AS y_pred FROM pairs r, coef c" for s in S
    ),
    "entity_report": f"WITH {AHEAD}, {change('clean')} SELECT g.student_id, g.name, "
                     f"{cols('round({s}_1997, 6) AS {s}_1997')}, {cols('round({s}_1998, 6) AS {s}_1998')}, "
                     f"{cols('round({s}_delta, 6) AS {s}_delta')}, round(overall_delta, 6) AS overall_delta, "
                     f"{cols('round(a.{s}, 6) AS {s}_predicted')} FROM change g JOIN ahead a ON a.student_id = g.student_id",
    "regression_gates": f"WITH {CV} SELECT bool_and(rmse < 20) AS rmse_ok FROM fold_rmse WHERE g = -1",
    "pooled_pairs_model": f"WITH {POOLED}, one AS (SELECT 1 AS g, * FROM pooled), {solve('one')} {COEFFICIENTS}",
    "regressor_checks": TREE_CHECKS,
    "pooled_tree_checks": f"SELECT * FROM ({TREE_CHECKS}) WHERE model = 'DecisionTree'",
    "incremental_refit": f"WITH {POOLED}, one AS (SELECT 1 AS g, * FROM pooled), {solve('one')} {COEFFICIENTS}",
    # trees and forests
    "pooled_forest_predictions": f"WITH RECURSIVE {POOLED}, {tree_rows('pooled', 'student_id, year')}, "
                                 + grown("forest", "tree_rows", X, Y, replace(FOREST, **POOLED_PARAMS), f"student_id % {PRIME} * 1000003 + year")
                                 + f", predicted AS ({scores('forest', 'RandomForest')}) {FORECASTS}",
    "tree_predictions": f"WITH RECURSIVE {TREES} {FORECASTS} AND model = 'DecisionTree'",
    "forest_predictions": f"WITH RECURSIVE {TREES} {FORECASTS} AND model = 'RandomForest'",
    "model_round_trip": f"WITH RECURSIVE {TREES}, {LINEAR_ALL} {FORECASTS.replace('FROM predicted', 'FROM everything')}",
    "prediction_intervals": f"WITH RECURSIVE {PAIRS}, {tree_rows('pairs')}, {grown('forest', 'tree_rows', X, Y, FOREST, 'student_id')}, "
                            f"band AS (SELECT {SUBJECT} AS subject, student_id, avg(value) AS v, "
                            "1.96 * stddev_pop(value) AS half "
                            f"FROM ({leaves('forest')}) JOIN tree_rows USING (r) WHERE train = 0 GROUP BY target, student_id) "
                            f"SELECT student_id, subject, round({clip('v')}, 6) AS predicted_mark, round({clip('v - half')}, 6) AS low, "
                            f"round({clip('v + half')}, 6) AS high FROM band",
    "best_model": f"WITH RECURSIVE {TREES}, {LINEAR_ALL} SELECT subject, round(rmse, 6) AS RMSE, model, round(mae, 6) AS MAE FROM best",
    "regression_evaluation": f"WITH RECURSIVE {EVALUATION} SELECT i.model, i.subject, round(any_value(i.rmse), 6) AS RMSE, "
                             "round(any_value(mae), 6) AS MAE, round(avg(h.rmse), 6) AS mean, round(stddev_pop(h.rmse), 6) AS std "
                             "FROM in_sample i JOIN held_out h ON h.model = i.model AND h.subject = i.subject GROUP BY i.model, i.subject",
    "entity_report_best": f"WITH RECURSIVE {TREES}, {LINEAR_ALL}, {change('clean')}, chosen AS (SELECT student_id, subject, {clip('v')} AS v "
                          "FROM everything JOIN best USING (model, subject) WHERE r % 2 = 0), "
                          f"ahead AS (SELECT student_id, {cols(chr(32).join(['max(v) FILTER (subject =', chr(39) + '{s}' + chr(39) + ') AS {s}']))} "
                          "FROM chosen GROUP BY student_id) SELECT g.student_id, g.name, "
                          f"{cols('round({s}_1997, 6) AS {s}_1997')}, {cols('round({s}_1998, 6) AS {s}_1998')}, "
                          f"{cols('round({s}_delta, 6) AS {s}_delta')}, round(overall_delta, 6) AS overall_delta, "
                          f"{cols('round(a.{s}, 6) AS {s}_predicted')} FROM change g JOIN ahead a ON a.student_id = g.student_id",
    "regressor_search": f"WITH RECURSIVE {FOLDED}, {tree_rows('pairs')}, {FOLD_ROWS}, truth AS ({TRUTH}), "
                        + grown("forest", "fold_rows", X, Y, replace(FOREST, maxDepth=max(SEARCH['maxDepth']), numTrees=max(SEARCH['numTrees'])),
                                "student_id", FOLDS) + ", folds AS ("
                        + search("forest", SEARCH, f"{SUBJECT} AS subject", "SELECT subject, fold, sqrt(avg((y - v) ** 2)) AS rmse FROM "
                                 "({cut}) JOIN truth USING (r, subject) GROUP BY subject, fold")
                        + ") SELECT subject, maxDepth, numTrees, round(avg(rmse), 6) AS mean, round(stddev_pop(rmse), 6) AS std "
                          "FROM folds GROUP BY ALL",
    # fitted classifiers
    "forest_scores": f"WITH RECURSIVE {RISK}, {RISK_FOREST} SELECT id, (p > 0.5)::INT AS predicted_label, round(p, 6) AS predicted_proba, "
                     f"'RandomForest' AS model_used FROM ({FOREST_SCORES})",
    "logistic_scores": f"WITH {RISK}, {LOGISTIC} SELECT id, (p > 0.5)::INT AS predicted_label, round(p, 6) AS predicted_proba, "
                       f"'LogisticRegression' AS model_used FROM ({LOGISTIC_SCORES})",
    "feature_importance": f"WITH RECURSIVE {RISK}, {RISK_FOREST} SELECT feature, round(importance, 6) AS importance "
                          f"FROM ({importance('forest', TEXT_FEATURES)})",
    "classifier_eval": f"WITH RECURSIVE {CLASSIFIED} SELECT {EVALUATED}",
    "best_classifier": f"WITH RECURSIVE {CLASSIFIED} SELECT {EVALUATED} ORDER BY evaluated.recall_fail DESC, evaluated.roc_auc DESC, model LIMIT 1",
    "grid_search": f"WITH RECURSIVE {RISK}, grid_rows AS (SELECT * REPLACE (ntile({GRID_FOLDS}) OVER (ORDER BY id) - 1 AS fold) FROM risk_train), "
                   + grown("forest", "grid_rows", TEXT_FEATURES, ["label"], forest_params(len(TEXT_FEATURES), {k: max(v) for k, v in GRID.items()}),
                           "id", GRID_FOLDS) + ", areas AS ("
                   + search("forest", GRID, "target", "SELECT fold, (sum(rk) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / "
                            "(sum(label) * (count(*) - sum(label))) AS area FROM (SELECT fold, label, rank() OVER (PARTITION BY fold ORDER BY v) + "
                            "(count(*) OVER (PARTITION BY fold, v) - 1) / 2.0 AS rk FROM ({cut}) JOIN (SELECT r, label FROM grid_rows) USING (r)) "
                            "GROUP BY fold HAVING count(*) > sum(label) AND sum(label) > 0")
                   + ") SELECT maxDepth, numTrees, round(avg(area), 6) AS roc_auc FROM areas GROUP BY maxDepth, numTrees",
    # files
    "exact_csv_load": f"WITH {ENGAGEMENT} SELECT {cols('round({s}, 6) AS {s}', [f for f in FEATURES if f != 'age'])}, label FROM engagement",
    "mixed_headers_load": f"WITH {ENGAGEMENT} SELECT " + ", ".join(
        f"round({f if i < 10 else f'CASE WHEN id % 3 < 2 THEN {f} END'}, 6) AS {f}" for i, f in enumerate(FEATURES)) + ", label FROM engagement",
    "completed_features": f"WITH {ENGAGEMENT} SELECT id, " + ", ".join(
        "0.0::DOUBLE AS " + f if f in ("total_hours", "polar4_quintile") else
        "CASE WHEN id % 5 > 0 THEN round(age, 6) ELSE 0 END AS age" if f == "age" else f"round({f}, 6) AS {f}" for f in FEATURES)
        + ", label FROM engagement",
    "loaded_or_empty": f"WITH {ENGAGEMENT} SELECT 'present' AS source, (count(*) + sum(label))::BIGINT AS n_rows, sum(label)::BIGINT AS fails "
                       "FROM engagement UNION ALL SELECT 'absent', 0, NULL UNION ALL SELECT 'unusable', 0, NULL",
    "compacted_log_latest": f"WITH {MARKS} SELECT student_id, subject, CASE WHEN mark IS NOT NULL THEN "
                            f"round({clip('mark')}, 6) END AS predicted_mark, o_orderstatus AS model_used, "
                            "CAST(o_orderdate AS DATE) AS created_at FROM marks "
                            f"WHERE student_id = {STUDENT} ORDER BY o_orderdate DESC",
}
