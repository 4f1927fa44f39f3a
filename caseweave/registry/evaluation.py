"""Queries over splits, metrics, classifiers (M) and treatment contrasts (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseweave.functions.draws import POISSON_ONE
from caseweave.operators import causal as cs, cohorts as co, evaluation as ev
from caseweave.registry.aggregates import lab_extremes, rounded
from caseweave.registry.case import case
from caseweave.registry.cohorts import ARMS_SQL, TYPES, arms
from caseweave.registry.graph import SPLIT_SQL
from caseweave.registry.similarity import members
from caseweave.session import materialise


@case("m1_split", SPLIT_SQL + """
SELECT a.hadm_id, a.subject_id, p.split FROM admissions a JOIN parts p ON a.subject_id = p.subject_id
""")
def _(t):
    rows = t.admissions.select("hadm_id", "subject_id").join(
        co.readmission_flags(t.admissions), "hadm_id"
    )
    return ev.split_subjects(rows, "readmitted_30d").select("hadm_id", "subject_id", "split")


def matrix(t):
    flags = co.readmission_flags(t.admissions).select("hadm_id", "readmitted_30d")
    return (
        co.covariates(t.admissions, t.patients, TYPES).join(lab_extremes(t), "hadm_id")
        .join(flags, "hadm_id")
        .fillna(0.0, ["creatinine_max", "sodium_mean", "platelet_min"])
    )


NAMES = ["age", "gender_M", "gender_F", "hospital_los_days", "creatinine_max", "sodium_mean"]


def train_and_test(t):
    """M1: the matrix split by subject; models are fitted on one part and judged on another."""
    rows = matrix(t).join(t.admissions.select("hadm_id", "subject_id"), "hadm_id")
    rows = materialise(ev.split_subjects(rows, "readmitted_30d"))
    return rows.where("split = 'train'"), rows.where("split = 'test'")


@case("m2_logistic")
def _(t):
    train, test = train_and_test(t)
    model = ev.train_logistic(train, NAMES, "readmitted_30d")
    scores = ev.predicted(model, test, NAMES)
    return ev.areas(ev.curve(scores, "readmitted_30d"))


@case("m3_boosted")
def _(t):
    train, test = train_and_test(t)
    model = ev.train_boosted(train, NAMES, "readmitted_30d", depth=4)
    scores = ev.predicted(model, test, NAMES)
    return ev.areas(ev.curve(scores, "readmitted_30d"))


@case("m4_importance")
def _(t):
    train, _ = train_and_test(t)
    return ev.feature_importance(ev.train_logistic(train, NAMES, "readmitted_30d"), train, NAMES)


def _curve_sql(score, group=""):
    part = f"PARTITION BY {group}" if group else ""
    by = f"{group}, " if group else ""
    return f"""
c AS (SELECT {by}{score} AS s, SUM(label) AS pos, SUM(1 - label) AS neg FROM scored GROUP BY {by}{score}),
k AS (SELECT *, SUM(pos) OVER ({part} ORDER BY s DESC) AS tp, SUM(neg) OVER ({part} ORDER BY s DESC)
  AS fp, SUM(pos) OVER ({part}) AS ap, SUM(neg) OVER ({part}) AS an FROM c)
"""


AREA = "SUM(neg * (2 * tp - pos)) / 2.0 / (MAX(ap) * MAX(an))"
RECALL_AREA = """
SUM(pos * (tp / (tp + fp) + CASE WHEN tp - pos + fp - neg = 0 THEN 1.0
  ELSE (tp - pos) / (tp - pos + fp - neg) END) / 2.0) / MAX(ap)
"""


@case("m5_areas", "WITH" + _curve_sql("score_b") + f"""
SELECT ROUND({AREA}, 8) AS auroc, ROUND({RECALL_AREA}, 8) AS auprc FROM k
""")
def _(t):
    return rounded(ev.areas(ev.curve(t.scored, score="score_b")), 8)


@case("m6_threshold", "WITH" + _curve_sql("score_b") + """
, b AS (SELECT * FROM k ORDER BY CAST(tp AS DOUBLE) * an - CAST(fp AS DOUBLE) * ap DESC, s DESC LIMIT 1)
SELECT s AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
  CAST(an - fp AS BIGINT) AS tn, CAST(ap - tp AS BIGINT) AS fn,
  ROUND(tp / (tp + fp), 8) AS precision, ROUND(tp / ap, 8) AS recall,
  ROUND(2 * tp / (tp + fp + ap), 8) AS f1 FROM b
""")
def _(t):
    return ev.threshold_metrics(ev.curve(t.scored, score="score_b")).withColumns(
        {c: F.round(c, 8) for c in ("precision", "recall", "f1")}
    )


@case("m7_calibration", """
SELECT CAST(LEAST(9, GREATEST(0, CEIL(ROUND(score_a * 10, 9)) - 1)) AS INT) AS bin,
  ROUND(AVG(label), 6) AS fraction_of_positives, ROUND(AVG(score_a), 6) AS mean_predicted_value,
  COUNT(*) AS n FROM scored GROUP BY 1
""")
def _(t):
    return rounded(ev.calibration(t.scored, score="score_a"))


@case("m8_extended", "WITH" + _curve_sql("score_b") + """
, z AS (SELECT *, LEAD(pos) OVER w AS np, LEAD(neg) OVER w AS nn FROM k WINDOW w AS (ORDER BY s DESC)),
q AS (SELECT * FROM z WHERE (tp = pos AND fp = neg) OR np IS NULL OR np <> pos OR nn <> neg)
SELECT (SELECT ROUND(AVG((score_b - label) * (score_b - label)), 8) FROM scored) AS brier_score,
  (SELECT COUNT(*) FROM scored) AS n_test, (SELECT CAST(SUM(label) AS BIGINT) FROM scored) AS n_positive,
  (SELECT CAST(SUM(1 - label) AS BIGINT) FROM scored) AS n_negative,
  ROUND(COALESCE(MAX(CASE WHEN fp / an <= 1 - 0.9::DOUBLE THEN tp / ap END), 0), 8)
    AS sensitivity_at_90_specificity,
  ROUND(COALESCE(MAX(CASE WHEN fp / an <= 1 - 0.95::DOUBLE THEN tp / ap END), 0), 8)
    AS sensitivity_at_95_specificity FROM q
""")
def _(t):
    return rounded(ev.extended_metrics(t.scored, score="score_b"), 8)


@case("m9_subgroups", "WITH" + _curve_sql("score_b", "category") + f"""
, a AS (SELECT category, ROUND({AREA}, 8) AS auroc FROM k GROUP BY category)
SELECT s.category, COUNT(*) AS n, ROUND(AVG(s.score_b), 8) AS mean_proba, a.auroc FROM scored s
JOIN a ON s.category = a.category GROUP BY s.category, a.auroc HAVING COUNT(*) >= 5
""")
def _(t):
    return rounded(ev.subgroup_metrics(t.scored, "category", score="score_b"), 8)


@case("m10_bootstrap_difference")
def _(t):
    return ev.compare_areas(t.scored, "row_id", "label", "score_a", "score_b")


@case("m11_compared_scores", "WITH" + _curve_sql("score_a") + f"""
, x AS (SELECT 'score_a' AS feature, {AREA} AS auroc FROM k),
c2 AS (SELECT score_b AS s, SUM(label) AS pos, SUM(1 - label) AS neg FROM scored GROUP BY score_b),
k2 AS (SELECT *, SUM(pos) OVER (ORDER BY s DESC) AS tp, SUM(neg) OVER (ORDER BY s DESC) AS fp,
  SUM(pos) OVER () AS ap, SUM(neg) OVER () AS an FROM c2),
y AS (SELECT 'score_b' AS feature, {AREA} AS auroc FROM k2)
SELECT feature, ROUND(auroc, 8) AS auroc, ROUND(quantile_cont(v, 0.25), 8) AS q25,
  ROUND(quantile_cont(v, 0.5), 8) AS q50, ROUND(quantile_cont(v, 0.9), 8) AS q90,
  (SELECT ROUND(CORR(score_a, score_b), 8) FROM scored) AS correlation
FROM (SELECT * FROM x UNION ALL SELECT * FROM y) JOIN (SELECT 'score_a' AS feature, score_a AS v
  FROM scored UNION ALL SELECT 'score_b', score_b FROM scored) USING (feature)
GROUP BY feature, auroc
""")
def _(t):
    table = ev.compare_models(t.scored, "label", "score_a", "score_b")
    return rounded(table.select("feature", "auroc", "q25", "q50", "q90", "correlation"), 8)


# --- treatment contrasts ----------------------------------------------------------------

LABELS = ["norepinephrine", "heparin", "ventilated"]
PEAK_SQL = ARMS_SQL + """
, z AS (SELECT n.hadm_id, n.arm, CAST(p.anchor_age AS DOUBLE) AS x, (SELECT MAX(l.valuenum)
    FROM labevents l WHERE l.hadm_id = n.hadm_id AND l.itemid IN (50912, 51082)) AS y
  FROM n JOIN patients p ON n.subject_id = p.subject_id WHERE n.n_matching = 1),
f AS (SELECT * FROM z WHERE y IS NOT NULL)
"""


def frame(t):
    return co.cohort_frame(
        t.admissions, arms(t), co.covariates(t.admissions, t.patients),
        {
            "peak": co.outcome_biomarker(t.admissions, t.labevents, t.d_labitems, "creatinine"),
            "died": co.outcome_died(t.admissions),
        },
    )


@case("e1_t_learner", PEAK_SQL + """
SELECT 0 AS replicate, arm AS T, ROUND(regr_intercept(y, x) + regr_slope(y, x)
  * (SELECT AVG(x) FROM f), 6) AS mu FROM f GROUP BY arm
""")
def _(t):
    return rounded(cs.t_learner(frame(t), ["age"], "peak"))


@case("e1_t_learner_binary")
def _(t):
    return cs.t_learner(frame(t), ["age", "gender_M"], "died", binary=True)


@case("e1_boosted_means")
def _(t):
    return cs.boosted_means(frame(t), ["age", "gender_M"], "peak", 3, depth=3)


@case("e2_s_learner", PEAK_SQL + """
, g AS (SELECT arm, AVG(x) AS mx, AVG(y) AS my FROM f GROUP BY arm),
b AS (SELECT SUM((f.x - g.mx) * (f.y - g.my)) / SUM((f.x - g.mx) * (f.x - g.mx)) AS s
  FROM f JOIN g ON f.arm = g.arm)
SELECT 0 AS replicate, g.arm AS T, ROUND(g.my + b.s * ((SELECT AVG(x) FROM f) - g.mx), 6) AS mu
FROM g, b
""")
def _(t):
    return rounded(cs.s_learner(frame(t), ["age"], "peak", 3))


@case("e3_x_learner", PEAK_SQL + """
, mu_rows AS (SELECT arm, regr_intercept(y, x) + regr_slope(y, x) * (SELECT AVG(x) FROM f) AS mu FROM f
  GROUP BY arm)
SELECT 0 AS replicate, a.arm AS T, ROUND(a.mu - b.mu, 6) AS effect FROM mu_rows a JOIN mu_rows b
ON b.arm = 0 AND a.arm > 0
""")
def _(t):
    return rounded(cs.x_learner(frame(t), ["age"], "peak", 3))


COPIES = "CASE " + " ".join(
    f"WHEN d < {p}::DOUBLE THEN {k}" for k, p in enumerate(POISSON_ONE)
) + f" ELSE {len(POISSON_ONE)} END"
BOOT_SQL = PEAK_SQL + f"""
, r AS (SELECT f.*, rep, CAST('0x' || md5(concat_ws('-', '5', CAST(hadm_id AS VARCHAR),
    CAST(rep AS VARCHAR)))[1:13] AS BIGINT) / 4503599627370496.0::DOUBLE AS d
  FROM f, (SELECT UNNEST(range(1, 201)) AS rep)),
w AS (SELECT rep, arm, x, y, {COPIES} AS w FROM r),
s AS (SELECT rep, arm, SUM(w) AS n, SUM(w * x) AS sx, SUM(w * y) AS sy, SUM(w * x * x) AS sxx,
  SUM(w * x * y) AS sxy FROM w GROUP BY rep, arm),
b AS (SELECT *, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS slope FROM s),
mu_rows AS (SELECT rep, arm, (sy - slope * sx) / n + slope * (SELECT AVG(x) FROM f) AS mu FROM b)
"""
NAME = "CASE arm WHEN 0 THEN 'norepinephrine' WHEN 1 THEN 'heparin' ELSE 'ventilated' END"


def replicates(t):
    return cs.t_learner(frame(t), ["age"], "peak", replicates=200, seed=5)


@case("e4_bootstrap", BOOT_SQL + f"""
SELECT arm AS T, {NAME} AS label, ROUND(AVG(mu), 5) AS point, ROUND(quantile_cont(mu, 0.025), 5) AS lower,
  ROUND(quantile_cont(mu, 0.975), 5) AS upper FROM mu_rows GROUP BY arm
""")
def _(t):
    return rounded(cs.arm_means(replicates(t), LABELS), 5)


@case("e4_boosted")
def _(t):
    mu = cs.boosted_learner(frame(t), ["age", "gender_M"], "peak", 3, replicates=200, seed=5, rounds=200, depth=6)
    return cs.arm_means(mu, LABELS)


#: One round at rate 1 without shrinkage splits a 0/1 covariate into its two groups, whose weighted means are the model.
TREE_SQL = ARMS_SQL + f"""
, z AS (SELECT n.hadm_id, n.arm, p.gender = 'M' AS g, (SELECT MAX(l.valuenum)
    FROM labevents l WHERE l.hadm_id = n.hadm_id AND l.itemid IN (50912, 51082)) AS y
  FROM n JOIN patients p ON n.subject_id = p.subject_id WHERE n.n_matching = 1),
f AS (SELECT * FROM z WHERE y IS NOT NULL),
sizes AS (SELECT g, COUNT(*) AS size FROM f GROUP BY g),
r AS (SELECT f.*, rep, CAST('0x' || md5(concat_ws('-', '5', CAST(hadm_id AS VARCHAR),
    CAST(rep AS VARCHAR)))[1:13] AS BIGINT) / 4503599627370496.0::DOUBLE AS d
  FROM f, (SELECT UNNEST(range(1, 201)) AS rep)),
w AS (SELECT rep, arm, g, y, {COPIES} AS w FROM r),
c AS (SELECT rep, arm, g, SUM(w * y) / SUM(w) AS m FROM w GROUP BY ALL HAVING SUM(w) > 0),
mu_rows AS (SELECT rep, arm, SUM(m * size) / SUM(size) AS mu FROM c JOIN sizes USING (g) GROUP BY ALL
  HAVING COUNT(*) = 2)
"""


@case("e4_single_trees", TREE_SQL + f"""
SELECT arm AS T, {NAME} AS label, ROUND(AVG(mu), 5) AS point, ROUND(quantile_cont(mu, 0.025), 5) AS lower,
  ROUND(quantile_cont(mu, 0.975), 5) AS upper FROM mu_rows GROUP BY arm
""")
def _(t):
    mu = cs.boosted_learner(
        frame(t), ["gender_M"], "peak", 3, replicates=200, seed=5, rounds=1, depth=1, rate=1.0, shrink=0.0
    )
    return rounded(cs.arm_means(mu, LABELS), 5)


@case("e5_contrasts", BOOT_SQL + f"""
, g AS (SELECT rep, {NAME} AS label, mu FROM mu_rows),
c AS (SELECT a.label || '|' || b.label AS contrast, a.mu - b.mu AS gap FROM g a JOIN g b
  ON a.rep = b.rep AND a.label < b.label)
SELECT contrast, ROUND(AVG(gap), 5) AS point, ROUND(quantile_cont(gap, 0.025), 5) AS lower,
  ROUND(quantile_cont(gap, 0.975), 5) AS upper FROM c GROUP BY contrast
""")
def _(t):
    return rounded(cs.contrasts(replicates(t), LABELS), 5)


@case("e5_ranking", BOOT_SQL + f"""
SELECT {NAME} AS label, ROUND(AVG(mu), 5) AS point FROM mu_rows GROUP BY arm
""")
def _(t):
    return rounded(
        cs.ranking(cs.arm_means(replicates(t), LABELS)).select("label", "point"), 5
    )


#: Peaks in five levels; with one 0/1 covariate a model of levels has the shares of the levels in each of its two groups.
LEVEL_SQL = "CASE WHEN y < 0.8 THEN 0 WHEN y < 1.2 THEN 1 WHEN y < 2.0 THEN 2 WHEN y < 4.0 THEN 3 ELSE 4 END"
STAGE_SQL = ARMS_SQL + f"""
, z AS (SELECT n.hadm_id, n.arm, p.gender = 'M' AS g, (SELECT MAX(l.valuenum)
    FROM labevents l WHERE l.hadm_id = n.hadm_id AND l.itemid IN (50912, 51082)) AS y
  FROM n JOIN patients p ON n.subject_id = p.subject_id WHERE n.n_matching = 1),
f AS (SELECT hadm_id, arm, g, {LEVEL_SQL} AS v FROM z WHERE y IS NOT NULL),
sizes AS (SELECT g, COUNT(*) AS size FROM f GROUP BY g)
"""


def staged(t):
    y = F.col("peak")
    level = F.when(y < 0.8, 0).when(y < 1.2, 1).when(y < 2.0, 2).when(y < 4.0, 3).when(y.isNotNull(), 4)
    return frame(t).withColumn("stage", level)


#: So small a ridge leaves the shares as they are.
NO_RIDGE = 1e-9


def _most_likely(weights, groups):
    return f"""
, c AS (SELECT {groups}, arm, g, v, SUM({weights}) AS n FROM r GROUP BY ALL HAVING SUM({weights}) > 0),
top AS (SELECT {groups}, arm, g, ARG_MIN(v, (-n, v)) AS v FROM c GROUP BY ALL),
mu_rows AS (SELECT {groups}, arm, SUM(v * size) / SUM(size) AS mu FROM top JOIN sizes USING (g) GROUP BY ALL)
"""


@case("e1_ordinal", STAGE_SQL + ", r AS (SELECT 0 AS rep, 1 AS w, * FROM f)" + _most_likely("w", "rep") + """
SELECT rep AS replicate, arm AS T, ROUND(mu, 6) AS mu FROM mu_rows
""")
def _(t):
    return rounded(cs.ordinal_learner(staged(t), ["gender_M"], "stage", 3, ridge=NO_RIDGE))


@case("e1_ordinal_expected", STAGE_SQL + """
, cells AS (SELECT arm, g, AVG(v) AS v FROM f GROUP BY ALL)
SELECT 0 AS replicate, arm AS T, ROUND(SUM(v * size) / SUM(size), 5) AS mu FROM cells JOIN sizes USING (g) GROUP BY arm
""")
def _(t):
    return rounded(cs.ordinal_learner(staged(t), ["gender_M"], "stage", 3, ridge=NO_RIDGE, expected=True), 5)


@case("e2_ordinal", STAGE_SQL + """
SELECT 0 AS replicate, arm AS T, ROUND(AVG(v), 5) AS mu FROM f GROUP BY arm
""")
def _(t):
    return rounded(cs.ordinal_learner(staged(t), [], "stage", 3, single=True, expected=True), 5)


@case("e7_ordinal", STAGE_SQL + f"""
, r AS (SELECT rep, {COPIES} AS w, f.* FROM (SELECT f.*, rep, CAST('0x' || md5(concat_ws('-', '0', CAST(hadm_id AS VARCHAR),
    CAST(rep AS VARCHAR)))[1:13] AS BIGINT) / 4503599627370496.0::DOUBLE AS d
  FROM f, (SELECT UNNEST(range(1, 201)) AS rep)) f)""" + _most_likely("w", "rep") + f"""
, q AS (SELECT 'mean' AS quantity, {NAME} AS name, mu AS v FROM mu_rows
  UNION ALL SELECT 'contrast', a.label || '|' || b.label, a.mu - b.mu
  FROM (SELECT rep, {NAME} AS label, mu FROM mu_rows) a JOIN (SELECT rep, {NAME} AS label, mu FROM mu_rows) b
  ON a.rep = b.rep AND a.label < b.label)
SELECT quantity, name, ROUND(AVG(v), 5) AS point, ROUND(quantile_cont(v, 0.025), 5) AS lower,
  ROUND(quantile_cont(v, 0.975), 5) AS upper FROM q GROUP BY quantity, name
""")
def _(t):
    return rounded(cs.estimate(staged(t), ["gender_M"], "stage", LABELS, kind="ordinal", ridge=NO_RIDGE), 5)


@case("e7_x_effects")
def _(t):
    return cs.estimate(frame(t), ["age", "gender_M"], "peak", LABELS, learner="x_learner")


@case("e6_overlap")
def _(t):
    return cs.overlap(frame(t), ["age", "gender_M"])


@case("e7_estimate")
def _(t):
    return cs.estimate(
        frame(t), ["age", "gender_M"], "peak", LABELS, learner="s_learner"
    )


@case("e7_narrowed")
def _(t):
    return cs.estimate(
        frame(t), ["age", "gender_M"], "peak", LABELS, within=members(t)
    )


@case("e7_estimate_binary")
def _(t):
    return cs.estimate(
        frame(t), ["age", "gender_M"], "died", LABELS, kind="binary"
    )
