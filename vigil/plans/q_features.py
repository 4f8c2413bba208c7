"""Feature-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as feat
from ..operators import relational, stats
from .domain import line_fault, machine
from .registry import query
from .sqlbits2 import (FEATURES_SQL, HASH_UNIT_SQL, LINE_FAULT_SQL, MACHINE_TARGET_SQL,
                       RELABELED_SQL)


def labeled(spark, d):
    return feat.machine_failure(machine(spark, d))


def features(spark, d, encode: bool = True):
    return feat.derive_features(labeled(spark, d), encode)


# ---- item 13: random failures -> target 0, 'No Failure' ----
@query("relabel_random", sql=f"SELECT l_orderkey, l_linenumber, target, failure_type FROM ({RELABELED_SQL})")
def q_relabel_random(spark, d):
    return feat.relabel_random(labeled(spark, d)).select("l_orderkey", "l_linenumber", "target", "failure_type")


# ---- items 15, 72: line-fault rule classifier (first match, unmatched -> 'No failure') ----
@query("fault_rules", sql=f"""
WITH x AS ({LINE_FAULT_SQL}),
y AS (SELECT *, CASE
    WHEN g = 1 AND c = 0 AND b = 0 AND a = 1 THEN 'Fault between phase A and ground'
    WHEN g = 0 AND c = 1 AND b = 1 AND a = 0 THEN 'Fault between phase B and phase C'
    WHEN g = 1 AND c = 0 AND b = 1 AND a = 1 THEN 'Fault between phases A,B and ground'
    WHEN g = 0 AND c = 1 AND b = 1 AND a = 1 THEN 'Fault between all three phases'
    WHEN g = 1 AND c = 1 AND b = 1 AND a = 1 THEN 'Three phase symmetrical fault'
    ELSE 'No failure' END AS failure_type FROM x)
SELECT l_orderkey, l_linenumber, ia, ib, ic, va, vb, vc,
       CASE WHEN failure_type = 'No failure' THEN 0 ELSE 1 END AS target, failure_type FROM y""")
def q_fault_rules(spark, d):
    return relational.fault_rules(line_fault(spark, d))


# ---- item 71: machine feature build ----
@query("derive_features", sql=f"SELECT * FROM ({FEATURES_SQL})")
def q_derive_features(spark, d):
    return features(spark, d)


# ---- item 73: alphabetical label codes ----
@query("label_encode", sql=f"""
WITH x AS ({MACHINE_TARGET_SQL}),
c AS (SELECT failure_type, CAST(dense_rank() OVER (ORDER BY failure_type) - 1 AS INTEGER) AS code
      FROM (SELECT DISTINCT failure_type FROM x))
SELECT l_orderkey, l_linenumber, x.failure_type, c.code FROM x JOIN c ON x.failure_type = c.failure_type""")
def q_label_encode(spark, d):
    return feat.label_encode(labeled(spark, d), "failure_type", out="code").select(
        "l_orderkey", "l_linenumber", "failure_type", "code")


# ---- item 74: hash split on the row key (test share 0.33) ----
@query("hash_split", sql=f"""
SELECT l_orderkey, l_linenumber, CASE WHEN {HASH_UNIT_SQL} < 0.33 THEN 'test' ELSE 'train' END AS split
FROM lineitem""")
def q_hash_split(spark, d):
    from ..sources.tables import load
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return feat.hash_split(li, ["l_orderkey", "l_linenumber"], 0.33)


# ---- item 75: min-max scaling fitted on train, applied to test ----
_SC = feat.FEATURES


@query("minmax_scale", sql=f"""
WITH x AS (SELECT *, CASE WHEN {HASH_UNIT_SQL} < 0.33 THEN 'test' ELSE 'train' END AS split FROM ({FEATURES_SQL})),
s AS (SELECT {", ".join(f"min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in _SC)} FROM x WHERE split = 'train')
SELECT l_orderkey, l_linenumber, split, target, failure_type,
       {", ".join(f"round(coalesce(CAST(({c} - mn_{c}) AS DOUBLE) / nullif(CAST((mx_{c} - mn_{c}) AS DOUBLE), 0), 0.0), 6) AS {c}" for c in _SC)}
FROM x, s""")
def q_minmax_scale(spark, d):
    x = feat.hash_split(features(spark, d), ["l_orderkey", "l_linenumber"], 0.33)
    x = x.select("l_orderkey", "l_linenumber", "split", "target", "failure_type",
                 *[F.col(c).cast("double").alias(c) for c in _SC])
    return feat.minmax_scale(x, _SC)


# ---- item 43: failure plausibility per distinct value (suffix sums) ----
@query("feat_prob", sql=f"""
WITH x AS ({FEATURES_SQL}),
{", ".join(f'''p_{c} AS (SELECT CAST({c} AS DOUBLE) AS value, sum(target) AS s, count(*) AS n FROM x GROUP BY {c}),
r_{c} AS (SELECT '{c}' AS feature, value, round_even(CAST(sum(s) OVER (ORDER BY value DESC) AS DOUBLE)
          / CAST(sum(n) OVER (ORDER BY value DESC) AS DOUBLE) * 100, 2) AS prob FROM p_{c})''' for c in ("wear", "rpm"))}
SELECT * FROM r_wear UNION ALL SELECT * FROM r_rpm""")
def q_feat_prob(spark, d):
    f = features(spark, d, encode=False)
    return stats.feat_prob(f, ["wear", "rpm"])


# ---- item 40: distinct count per column ----
_NU = ["type", "air_k", "process_k", "rpm", "torque", "wear", "failure_type"]


@query("nunique", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct FROM ({MACHINE_TARGET_SQL})" for c in _NU))
def q_nunique(spark, d):
    return stats.nunique(labeled(spark, d), _NU)


# ---- item 41: class frequencies ----
@query("class_freq", sql=f"SELECT failure_type, count(*) AS n FROM ({MACHINE_TARGET_SQL}) GROUP BY failure_type")
def q_class_freq(spark, d):
    return stats.class_freq(labeled(spark, d), "failure_type")


# ---- item 42: Pearson correlation matrix of the numeric features ----
_CORR = ["power", "process_k", "heat", "wear", "overstrain", "rpm", "target"]


@query("corr_matrix", sql=f"""
WITH x AS ({FEATURES_SQL})
{" UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM x" for a in _CORR for b in _CORR)}""")
def q_corr_matrix(spark, d):
    return stats.corr_matrix(features(spark, d, encode=False), _CORR)
