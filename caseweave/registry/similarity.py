"""Queries over similarity (S, J13, A32, IO13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseweave import rules
from caseweave.functions import kernels as kn
from caseweave.functions.kernels import Direction, Kind, Missing, Trait
from caseweave.operators import aggregates as ag, similarity as sm, temporal as tp
from caseweave.plans.ordered import neighbour
from caseweave.registry.aggregates import rounded
from caseweave.registry.case import case
from caseweave.registry.observation import CHARLSON_SQL, prefix_table
from caseweave.registry.temporal import BUCKETS_SQL, buckets, creatinine
from caseweave.operators.observation import charlson
from caseweave.sources import exports

PRIORITY = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

FEATURES_SQL = """
WITH w AS (SELECT a.hadm_id, a.subject_id, a.admission_type, p.gender, p.anchor_age AS age,
    COALESCE(i.h, 0.0::DOUBLE) AS icu_los_hours, l.cr, l.so, l.pl
  FROM admissions a JOIN patients p ON a.subject_id = p.subject_id
  LEFT JOIN (SELECT hadm_id, SUM(los) * 24.0 AS h FROM icustays GROUP BY hadm_id) i
    ON a.hadm_id = i.hadm_id
  LEFT JOIN (SELECT hadm_id, MAX(CASE WHEN itemid = 50912 THEN valuenum END) AS cr,
    AVG(CASE WHEN itemid = 50983 THEN valuenum END) AS so,
    MIN(CASE WHEN itemid = 51265 THEN valuenum END) AS pl FROM labevents GROUP BY hadm_id) l
    ON a.hadm_id = l.hadm_id),
f AS (SELECT hadm_id, subject_id, admission_type, gender, age, icu_los_hours,
    COALESCE(cr, (SELECT MEDIAN(cr) FROM w)) AS creatinine_max,
    COALESCE(so, (SELECT MEDIAN(so) FROM w)) AS sodium_mean,
    COALESCE(pl, (SELECT MEDIAN(pl) FROM w)) AS platelet_min FROM w)
"""


def features(t, comorbid=False):
    flags = charlson(t.diagnoses_icd, prefix_table(t)) if comorbid else None
    return sm.encounter_features(t.admissions, t.patients, t.icustays, t.labevents, flags)


@case("s19_encounter_features", FEATURES_SQL + """
SELECT hadm_id, subject_id, admission_type, gender, age, ROUND(icu_los_hours, 6) AS icu_los_hours,
  ROUND(creatinine_max, 6) AS creatinine_max, ROUND(sodium_mean, 6) AS sodium_mean,
  ROUND(platelet_min, 6) AS platelet_min, CASE WHEN gender = 'M' THEN 1 ELSE 0 END AS gender_M,
  CASE WHEN gender = 'F' THEN 1 ELSE 0 END AS gender_F,
  CASE WHEN gender IN ('M', 'F') THEN 0 ELSE 1 END AS gender_unknown, 0 AS charlson_index FROM f
""")
def _(t):
    return rounded(features(t))


def _kernel_case(name, expression, sql):
    @case(name, f"SELECT row_id, category, ROUND({sql}, 6) AS similarity FROM scored")
    def _(t):
        return rounded(t.scored.select("row_id", "category", expression().alias("similarity")))


_kernel_case("s1_quantitative",
             lambda: kn.quantitative(F.col("score_a"), F.col("score_b"), 0.5),
             "GREATEST(0, LEAST(1, 1 - ABS(score_a - score_b) / 0.5))")
_kernel_case("s2_nominal", lambda: kn.same(F.col("category"), F.lit("3")),
             "CASE WHEN category = '3' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END")
_kernel_case(
    "s3_ordinal",
    lambda: kn.compare_trait(
        Trait("c", Kind.ORDINAL, levels=["1", "2", "3", "4", "5", "6", "7"]),
        F.lit("2"), F.col("category"),
    )[0],
    "1 - ABS(CAST(category AS DOUBLE) - 2) / 6",
)
_kernel_case("s5_one_sided",
             lambda: kn.one_sided(F.lit(0.6), F.col("score_a"), 0.8, Direction.HIGHER),
             "GREATEST(0, LEAST(1, 1 - GREATEST(0, 0.6 - score_a) / 0.8))")


@case("s4_binary", """
SELECT row_id, category, CASE WHEN label = 0 THEN false ELSE true END AS counted,
  CASE WHEN label = 1 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS similarity FROM scored
""")
def _(t):
    trait = Trait("x", Kind.BINARY, present=1, asymmetric=True)
    similarity, part = kn.compare_trait(trait, F.lit(0), F.col("label"))
    return t.scored.select(
        "row_id", "category", part.alias("counted"), similarity.alias("similarity")
    )


@case("s6_missing_policy", """
SELECT labevent_id, charttime, valuenum IS NOT NULL AS excluded_part, true AS zero_part,
  ROUND(CASE WHEN valuenum IS NULL THEN 0 ELSE GREATEST(0, 1 - ABS(valuenum - 25) / 50) END, 6)
    AS zero_similarity FROM labevents
""")
def _(t):
    base = Trait("v", scale=(0.0, 50.0))
    zero = Trait("v", scale=(0.0, 50.0), missing=Missing.ZERO)
    _, part = kn.compare_trait(base, F.lit(25.0), F.col("valuenum"))
    similarity, always = kn.compare_trait(zero, F.lit(25.0), F.col("valuenum"))
    return rounded(t.labevents.select(
        "labevent_id", "charttime", part.alias("excluded_part"), always.alias("zero_part"),
        similarity.alias("zero_similarity"),
    ))


TRAITS = [
    Trait("age", weight=2.0, scale=(18.0, 90.0), reference=70.0),
    Trait("gender", Kind.NOMINAL, reference="F"),
    Trait("admission_type", Kind.ORDINAL, levels=PRIORITY, reference="2-HIGH"),
    Trait("creatinine_max", weight=1.5, scale=(1.0, 50.0), direction=Direction.HIGHER),
    Trait("sodium_mean", scale=(5.0, 45.0), reference=20.0, missing=Missing.ZERO),
]
DISTANCE_SQL = """
(2.0 * (1 - GREATEST(0, LEAST(1, 1 - ABS(70 - age) / 72.0)))
 + (CASE WHEN gender = 'F' THEN 0 ELSE 1 END)
 + ABS(CAST(admission_type[1] AS DOUBLE) - 2) / 4
 + 1.5 * (1 - GREATEST(0, 1 - GREATEST(0, 50 - creatinine_max) / 49.0))
 + (1 - GREATEST(0, 1 - ABS(20 - sodium_mean) / 40.0))) / 6.5::DOUBLE
"""


@case("s7_profile_distance", FEATURES_SQL + f"""
SELECT hadm_id, ROUND({DISTANCE_SQL}, 6) AS distance FROM f
""")
def _(t):
    profile = {x.name: x.reference for x in sm.pinned(TRAITS)}
    return rounded(sm.score_against(features(t), TRAITS, profile).select("hadm_id", "distance"))


PART_TRAITS = [
    Trait("p_size"), Trait("p_retailprice"), Trait("p_brand", Kind.NOMINAL),
    Trait("p_type", Kind.NOMINAL, weight=0.5),
]
PART_SQL = """
((ABS(x.p_size - y.p_size) / (SELECT MAX(p_size) - MIN(p_size) FROM part)
 + ABS(x.p_retailprice - y.p_retailprice) / (SELECT MAX(p_retailprice) - MIN(p_retailprice) FROM part)
 + CASE WHEN x.p_brand = y.p_brand THEN 0 ELSE 1 END
 + 0.5 * CASE WHEN x.p_type = y.p_type THEN 0 ELSE 1 END) / 3.5::DOUBLE)
"""


@case("s8_pair_distances", f"""
WITH n AS (SELECT p_partkey AS left_id, LEAD(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey)
  AS right_id FROM part)
SELECT n.left_id, n.right_id, ROUND({PART_SQL}, 6) AS distance FROM n JOIN part x
ON n.left_id = x.p_partkey JOIN part y ON n.right_id = y.p_partkey
""")
def _(t):
    pairs = neighbour(t.part, ["p_brand"], ["p_partkey"], {"right_id": "p_partkey"}).where(
        "right_id IS NOT NULL"
    ).select(F.col("p_partkey").alias("left_id"), "right_id")
    return rounded(
        sm.pair_distances(pairs, t.part, sm.fit_scales(t.part, PART_TRAITS), "p_partkey")
    )


@case("s9_nearest", f"""
WITH a AS (SELECT arg_min(p_partkey, (p_retailprice, p_partkey)) AS k FROM part GROUP BY p_type)
SELECT left_id, right_id, distance FROM (SELECT x.p_partkey AS left_id, y.p_partkey AS right_id,
  ROUND({PART_SQL}, 6) AS distance, ROW_NUMBER() OVER (PARTITION BY x.p_partkey
    ORDER BY {PART_SQL}, y.p_partkey) AS rn
  FROM a JOIN part x ON a.k = x.p_partkey JOIN part y ON y.p_partkey <> x.p_partkey) WHERE rn <= 3
""")
def _(t):
    cheapest = t.part.groupBy("p_type").agg(
        F.min_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("p_partkey")
    )
    anchors = t.part.join(cheapest.select("p_partkey"), "p_partkey", "left_semi")
    fitted = sm.fit_scales(t.part, PART_TRAITS)
    return rounded(sm.nearest(anchors, t.part, fitted, "p_partkey", 3))


@case("s9_nearest_table", f"""
SELECT left_id, right_id, distance FROM (SELECT x.p_partkey AS left_id, y.p_partkey AS right_id,
  ROUND({PART_SQL}, 6) AS distance, ROW_NUMBER() OVER (PARTITION BY x.p_partkey
    ORDER BY ROUND({PART_SQL}, 12), y.p_partkey) AS rn
  FROM part x JOIN part y ON y.p_partkey <> x.p_partkey WHERE x.p_partkey % 100 = 0) WHERE rn <= 5
""")
def _(t):
    anchors = t.part.where(F.col("p_partkey") % 100 == 0)
    return rounded(sm.nearest(anchors, t.part, sm.fit_scales(t.part, PART_TRAITS), "p_partkey", 5))


@case("s10_fitted_scales", """
SELECT p_brand, ROUND(MIN((p_size - lo) / (hi - lo)), 6) AS lowest,
  ROUND(MAX((p_size - lo) / (hi - lo)), 6) AS highest
FROM part, (SELECT MIN(p_size)::DOUBLE AS lo, MAX(p_size)::DOUBLE AS hi FROM part) GROUP BY p_brand
""")
def _(t):
    low, high = sm.fit_scales(t.part, [Trait("p_size")])[0].scale
    place = (F.col("p_size") - low) / (high - low)
    return rounded(t.part.groupBy("p_brand").agg(
        F.min(place).alias("lowest"), F.max(place).alias("highest")
    ))


@case("s12_contributions", FEATURES_SQL + """
SELECT hadm_id, 'age' AS name, ROUND(2.0 * (2 * GREATEST(0, LEAST(1, 1 - ABS(70 - age) / 72.0)) - 1), 6)
  AS signed, true AS included FROM f
UNION ALL SELECT hadm_id, 'gender', CASE WHEN gender = 'F' THEN 1.0 ELSE -1.0 END, true FROM f
""")
def _(t):
    profile = {x.name: x.reference for x in sm.pinned(TRAITS)}
    scored = sm.score_against(features(t), TRAITS, profile)
    long = scored.select("hadm_id", F.explode("contributions").alias("c")).select(
        "hadm_id", "c.name", "c.signed", "c.included"
    )
    return rounded(long.where(F.col("name").isin("age", "gender")))


ANCHOR = 100
BURDEN = {f"charlson_{c}": float(w) for c, (w, _) in rules.CHARLSON.items()}


def _scores_sql():
    flags = list(BURDEN)
    shared = " + ".join(f"CASE WHEN q.{c} = 1 AND g.{c} = 1 THEN {w}e0 ELSE 0 END"
                        for c, w in BURDEN.items())
    either = " + ".join(f"CASE WHEN q.{c} = 1 OR g.{c} = 1 THEN {w}e0 ELSE 0 END"
                        for c, w in BURDEN.items())
    columns = ", ".join(f"COALESCE(h.{c}, 0) AS {c}" for c in [*flags, "charlson_index"])

    def scaled(column, scale):
        return (f"COALESCE(GREATEST(0e0, LEAST(1e0, 1e0 - ABS(q.{column} - g.{column}) / {scale}e0))"
                ", 0e0)")

    severity = " + ".join(scaled(c, s) for c, s in rules.SEVERITY_SCALES.items())
    return FEATURES_SQL + f"""
, ch AS ({CHARLSON_SQL}),
g AS (SELECT f.*, {columns} FROM f LEFT JOIN ch h ON f.hadm_id = h.hadm_id),
parts AS (SELECT g.hadm_id, g.subject_id,
  ({scaled('age', 50)} + CASE WHEN q.gender = g.gender THEN 1e0 ELSE 0e0 END
    + CASE WHEN q.admission_type = g.admission_type THEN 1e0 ELSE 0e0 END) / 3 AS demographics,
  0.5e0 * {scaled('charlson_index', 10)} + 0.5e0 * CASE WHEN ({either}) > 0
    THEN ({shared}) / ({either}) ELSE 1e0 END AS comorbidity_burden,
  1e0 AS comorbidity_set, ({severity}) / 4 AS severity, 1e0 AS social
  FROM g, (SELECT * FROM g WHERE hadm_id = {ANCHOR}) q WHERE g.hadm_id <> {ANCHOR}),
ctx AS (SELECT *, demographics * 0.15e0 + comorbidity_burden * 0.35e0 + comorbidity_set * 0.25e0
  + severity * 0.15e0 + social * 0.10e0 AS contextual FROM parts)
"""


SCORES_SQL = _scores_sql()


def contextual(t):
    frame = features(t, comorbid=True)
    anchor = frame.where(F.col("hadm_id") == ANCHOR).first().asDict()
    others = frame.where(F.col("hadm_id") != ANCHOR)
    return sm.contextual_scores(others, anchor, burden=BURDEN)


@case("s13_contextual_scores", SCORES_SQL + """
SELECT hadm_id, subject_id, ROUND(contextual, 9) AS contextual, ROUND(demographics, 9) AS demographics,
  ROUND(comorbidity_burden, 9) AS comorbidity_burden, comorbidity_set,
  ROUND(severity, 9) AS severity, social FROM ctx
""")
def _(t):
    return rounded(contextual(t).drop("contributors", "detractors"), 9)


def _overlap_sql():
    shared = " + ".join(f"CASE WHEN charlson_{c} = 1 THEN {w}.0 ELSE 0 END"
                        for c, (w, _) in rules.CHARLSON.items() if c in ("renal_disease", "aids_hiv"))
    either = " + ".join(
        f"{w}.0" if c in ("renal_disease", "aids_hiv")
        else f"CASE WHEN charlson_{c} = 1 THEN {w}.0 ELSE 0 END"
        for c, (w, _) in rules.CHARLSON.items()
    )
    return f"SELECT hadm_id, ROUND(({shared}) / ({either})::DOUBLE, 6) AS overlap FROM ({CHARLSON_SQL})"


@case("s14_flag_overlap", _overlap_sql())
def _(t):
    from caseweave.operators.similarity import _overlap
    anchor = {"charlson_renal_disease": 1, "charlson_aids_hiv": 1}
    score, _states = _overlap(anchor, BURDEN)
    return rounded(
        charlson(t.diagnoses_icd, prefix_table(t)).select("hadm_id", score.alias("overlap"))
    )


@case("s15_top_features")
def _(t):
    return contextual(t).select(
        "hadm_id",
        F.transform("contributors", lambda p: p["feature"]).alias("contributors"),
        F.transform("detractors", lambda p: p["feature"]).alias("detractors"),
    )


TRAJECTORY_SQL = f"""
, bk AS ({BUCKETS_SQL}),
ab AS (SELECT bucket, COUNT(DISTINCT code) AS na, ROW_NUMBER() OVER (ORDER BY MIN(first_at), bucket) - 1
  AS pos FROM bk WHERE hadm_id = {ANCHOR} GROUP BY bucket),
cb AS (SELECT c.hadm_id, c.bucket, COUNT(*) AS nc, COUNT(a.code) AS nb FROM bk c
  LEFT JOIN (SELECT bucket, code FROM bk WHERE hadm_id = {ANCHOR}) a
  ON c.bucket = a.bucket AND c.code = a.code WHERE c.hadm_id <> {ANCHOR} GROUP BY c.hadm_id, c.bucket),
lb AS (SELECT a.hadm_id, x.bucket, x.pos FROM admissions a, ab x WHERE a.hadm_id <> {ANCHOR}
  UNION ALL SELECT hadm_id, bucket, (SELECT COUNT(*) FROM ab) - 1
    + ROW_NUMBER() OVER (PARTITION BY hadm_id ORDER BY bucket) FROM cb
  WHERE bucket NOT IN (SELECT bucket FROM ab)),
ts AS (SELECT l.hadm_id, SUM(POW(0.9e0, l.pos) * COALESCE(c.nb / (c.nc + a.na - c.nb)::DOUBLE, 0))
    / SUM(POW(0.9e0, l.pos)) AS temporal FROM lb l
  LEFT JOIN cb c ON l.hadm_id = c.hadm_id AND l.bucket = c.bucket
  LEFT JOIN ab a ON l.bucket = a.bucket GROUP BY l.hadm_id),
nb AS (SELECT hadm_id, COUNT(DISTINCT bucket) AS n FROM cb GROUP BY hadm_id)
"""


def _named(sql):
    """The trajectory steps as further steps of a longer statement."""
    return sql.replace("WITH p AS", "WITH p_ AS").replace("FROM p LEFT", "FROM p_ p LEFT")


@case("s16_trajectory_scores", "WITH one AS (SELECT 1)" + _named(TRAJECTORY_SQL) + """
SELECT ts.hadm_id, ROUND(ts.temporal, 6) AS temporal,
  ABS((SELECT COUNT(*) FROM ab) - COALESCE(nb.n, 0)) AS los_gap_days, true AS temporal_available
FROM ts LEFT JOIN nb ON ts.hadm_id = nb.hadm_id
""")
def _(t):
    rows = buckets(t)
    return rounded(sm.trajectory_scores(
        rows.where(F.col("hadm_id") == ANCHOR), rows.where(F.col("hadm_id") != ANCHOR),
        t.admissions.where(F.col("hadm_id") != ANCHOR),
    ))


@case("s16_trajectory_members", "WITH one AS (SELECT 1)" + _named(TRAJECTORY_SQL) + f"""
, ch AS (SELECT hadm_id FROM admissions WHERE hadm_id % 100 = 0 AND hadm_id <> {ANCHOR}),
l AS (SELECT ch.hadm_id, b.bucket, b.code FROM ch, bk b WHERE b.hadm_id = {ANCHOR}),
r AS (SELECT b.hadm_id, b.bucket, b.code FROM bk b JOIN ch ON b.hadm_id = ch.hadm_id)
SELECT COALESCE(l.hadm_id, r.hadm_id) AS hadm_id, COALESCE(l.bucket, r.bucket) AS bucket,
  COALESCE(l.code, r.code) AS code, CASE WHEN l.code IS NOT NULL AND r.code IS NOT NULL THEN 'shared'
    WHEN l.code IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS member_of
FROM l FULL JOIN r ON l.hadm_id = r.hadm_id AND l.bucket = r.bucket AND l.code = r.code
""")
def _(t):
    rows = buckets(t)
    chosen = t.admissions.where((F.col("hadm_id") % 100 == 0) & (F.col("hadm_id") != ANCHOR))
    return sm.trajectory_members(rows.where(F.col("hadm_id") == ANCHOR), rows, chosen)


RANKED_SQL = SCORES_SQL + _named(TRAJECTORY_SQL) + """
, ranked AS (SELECT ctx.hadm_id, ctx.subject_id, ctx.contextual, ts.temporal,
  0.5e0 * ts.temporal + 0.5e0 * ctx.contextual AS combined FROM ctx JOIN ts ON ctx.hadm_id = ts.hadm_id)
"""


@case("s17_combined_scores", RANKED_SQL + """
SELECT hadm_id, ROUND(contextual, 9) AS contextual, ROUND(temporal, 9) AS temporal,
  ROUND(combined, 9) AS combined FROM ranked
""")
def _(t):
    rows = buckets(t)
    temporal = sm.trajectory_scores(
        rows.where(F.col("hadm_id") == ANCHOR), rows.where(F.col("hadm_id") != ANCHOR),
        t.admissions.where(F.col("hadm_id") != ANCHOR),
    )
    both = sm.combined(contextual(t), temporal)
    return rounded(both.select("hadm_id", "contextual", "temporal", "combined"), 9)


@case("s18_similar_encounters", RANKED_SQL + """
SELECT hadm_id, subject_id, ROUND(combined, 9) AS combined FROM ranked
ORDER BY ranked.combined DESC, hadm_id LIMIT 20
""")
def _(t):
    ranked = sm.rank_similar(
        features(t, comorbid=True), buckets(t), hadm_id=ANCHOR, burden=BURDEN, top_k=20
    )
    return rounded(ranked.select("hadm_id", "subject_id", "combined"), 9)


@case("s18_similar_to_template", FEATURES_SQL + """
, x AS (SELECT hadm_id, 0.15e0 * (GREATEST(0e0, 1e0 - ABS(70 - age) / 50e0)
    + CASE WHEN gender = 'F' THEN 1e0 ELSE 0e0 END
    + CASE WHEN admission_type = '1-URGENT' THEN 1e0 ELSE 0e0 END) / 3
  + 0.35e0 + 0.25e0 + 0.15e0 * (GREATEST(0e0, LEAST(1e0, 1e0 - ABS(40 - creatinine_max) / 3e0)))/ 4
  + 0.10e0 AS combined FROM f)
SELECT hadm_id, ROUND(combined, 9) AS combined FROM x WHERE combined >= 0.8
""")
def _(t):
    template = {
        "age": 70.0, "gender_F": 1, "admission_type": "1-URGENT", "creatinine_max": 40.0,
        "charlson_index": 0,
    }
    ranked = sm.rank_similar(features(t), buckets(t), template=template, top_k=None, at_least=0.8)
    return rounded(ranked.select("hadm_id", "combined"), 9)


COHORT_SQL = FEATURES_SQL + f"""
, d AS (SELECT hadm_id, subject_id, age, gender, {DISTANCE_SQL} AS distance FROM f),
m AS (SELECT * FROM d WHERE distance <= 0.3)
"""


def members(t):
    return sm.profile_cohort(features(t), TRAITS, 0.3)


@case("s20_profile_cohort", COHORT_SQL + """
SELECT hadm_id, subject_id, ROUND(distance, 6) AS distance FROM m
""")
def _(t):
    return rounded(members(t).select("hadm_id", "subject_id", "distance"))


@case("j13_profile_scan", COHORT_SQL + "SELECT COUNT(*) AS n, ROUND(SUM(distance), 4) AS total FROM d")
def _(t):
    profile = {x.name: x.reference for x in sm.pinned(TRAITS)}
    return sm.score_against(features(t), TRAITS, profile).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("distance"), 4).alias("total")
    )


@case("a32_cohort_distances", COHORT_SQL + """
SELECT COUNT(*) AS n_returned, ROUND(MIN(distance), 6) AS min, ROUND(AVG(distance), 6) AS mean,
  ROUND(MAX(distance), 6) AS max, ROUND(MEDIAN(distance), 6) AS median FROM m
""")
def _(t):
    return rounded(sm.cohort_distances(members(t)))


@case("a32_cohort_quantities", COHORT_SQL + """
SELECT 'age' AS name, 2.0::DOUBLE AS weight,
  ROUND(AVG(GREATEST(0, LEAST(1, 1 - ABS(70 - age) / 72.0))), 6) AS mean_similarity,
  ROUND(AVG(2 * (2 * GREATEST(0, LEAST(1, 1 - ABS(70 - age) / 72.0)) - 1)), 6) AS mean_signed,
  COUNT(*) AS included_count FROM m
UNION ALL SELECT 'gender', 1.0, ROUND(AVG(CASE WHEN gender = 'F' THEN 1.0 ELSE 0.0 END), 6),
  ROUND(AVG(CASE WHEN gender = 'F' THEN 1.0 ELSE -1.0 END), 6), COUNT(*) FROM m
""")
def _(t):
    return rounded(sm.cohort_quantities(members(t)).where(F.col("name").isin("age", "gender")))


@case("s21_derived_ranges", """
WITH l AS (SELECT hadm_id, SUM(DATE_DIFF('second', intime, outtime) / 3600.0) AS v FROM icustays
  GROUP BY hadm_id),
r AS (SELECT hadm_id, COUNT(DISTINCT drug)::DOUBLE AS v FROM prescriptions
  WHERE hadm_id IN (SELECT hadm_id FROM icustays) GROUP BY 1)
SELECT 'icu_hours' AS feature, ROUND(quantile_cont(v, 0.01), 6) AS low,
  ROUND(quantile_cont(v, 0.99), 6) AS high, COUNT(*) AS n FROM l
UNION ALL SELECT 'n_drugs', ROUND(quantile_cont(v, 0.01), 6), ROUND(quantile_cont(v, 0.99), 6),
  COUNT(*) FROM r
""")
def _(t):
    def build(reference):
        return tp.assemble_features(reference, {
            "icu_hours": ag.stay_hours(t.icustays),
            "n_drugs": ag.distinct_drugs(t.prescriptions, t.icustays),
        })
    return rounded(sm.derived_ranges(t.admissions, build, ["icu_hours", "n_drugs"]))


@case("s21_trend_ranges")
def _(t):
    def build(reference):
        return tp.assemble_features(reference, {"slope": tp.trend(creatinine(t))})
    return sm.derived_ranges(t.admissions, build, ["slope"])


@case("io13_ranked_csv", COHORT_SQL + """
SELECT ROW_NUMBER() OVER (ORDER BY distance, hadm_id) AS rank, subject_id, hadm_id,
  ROUND(distance, 6) AS distance FROM m
""")
def _(t):
    path = exports.scratch(t.spark, "ranked")
    exports.write_ranked(members(t), path)
    return t.spark.read.option("header", True).schema(
        "rank bigint, subject_id bigint, hadm_id bigint, distance double"
    ).csv(path)
