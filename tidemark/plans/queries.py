"""Registered queries: every operator on the given tables, with SQL that gives the same rows.

The tables hold no missing, infinite or repeated values and hardly drift, so the queries make some:
values turn into null, NaN or infinity by rule, and the current side is shifted or filtered.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..calibrate import summarize
from ..functions.canonical import content_sums, is_finite, kind_of
from ..functions.lineage import cut, shared_folder
from ..functions.tails import kolmogorov_tail
from ..operators import cells, quality, twosample
from ..operators import categorical as cat
from ..operators.adversarial import group_folds, labelled, stratified_folds, validate
from ..operators.decisions import alerts, benjamini_hochberg, distance_decisions, quality_status, raw_p_values, roll_up
from ..operators.distribution_index import Index, sample_distances
from ..operators.histogram import category_shares, equal_width
from ..operators.longform import category_long, numeric_long
from ..operators.stability import psi_js
from ..streaming import records
from ..streaming.events import classify, envelopes, feedback_join, payload_hash, performance, settled, tumbling_windows, validated
from .registry import register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(frame: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return frame.withColumns({n: F.round(F.col(n), digits) for n in names})


# ---- quality: lineitem with missing, NaN and infinite values made by rule -----------------------------

FEATURES = {
    "l_quantity": {"kind": "numeric", "nullable": True, "min": 2, "max": 49},
    "l_discount": {"kind": "numeric", "nullable": True, "min": 0},
    "l_tax": {"kind": "numeric", "nullable": False, "max": 0.08},
    "l_returnflag": {"kind": "categorical", "nullable": True},
}


def _quality_sides(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    l = _table(spark, sf_dir, "lineitem")  # noqa: E741
    discount = F.when(F.col("l_discount") == 0.1, float("inf")).when(F.col("l_discount") == 0.05, float("nan")).otherwise(F.col("l_discount"))
    dirty = l.select("l_orderkey", "l_quantity", discount.alias("l_discount"), F.expr("nullif(l_tax, 0.0)").alias("l_tax"), F.expr("if(l_linenumber = 7, null, l_returnflag)").alias("l_returnflag"))
    return {"reference": dirty.where("l_orderkey % 2 = 0").drop("l_orderkey"), "current": dirty.where("l_orderkey % 2 = 1 and l_quantity > 5").drop("l_orderkey")}


_DIRTY = """
WITH dirty AS (
  SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'reference' ELSE 'current' END AS dataset, l_quantity,
    CASE WHEN l_discount = 0.1 THEN 'Infinity'::DOUBLE WHEN l_discount = 0.05 THEN NULL ELSE l_discount END AS l_discount,
    nullif(l_tax, 0.0) AS l_tax, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_returnflag END AS l_returnflag
  FROM lineitem WHERE l_orderkey % 2 = 0 OR l_quantity > 5),
long AS (
  SELECT dataset, 'l_quantity' AS feature, l_quantity AS v, l_quantity IS NULL AS gone, 2.0 AS lo, 49.0 AS hi, true AS nullable, true AS numeric FROM dirty
  UNION ALL SELECT dataset, 'l_discount', l_discount, l_discount IS NULL, 0.0, NULL, true, true FROM dirty
  UNION ALL SELECT dataset, 'l_tax', l_tax, l_tax IS NULL, NULL, 0.08, false, true FROM dirty
  UNION ALL SELECT dataset, 'l_returnflag', NULL, l_returnflag IS NULL, NULL, NULL, true, false FROM dirty),
profile AS (
  SELECT dataset, feature, any_value(lo) AS lo, any_value(hi) AS hi, any_value(nullable) AS nullable, any_value(numeric) AS numeric, count(*) AS rows, count(*) FILTER (gone) AS missing,
    count(*) FILTER (v = 'Infinity'::DOUBLE) AS plus_infinite, count(*) FILTER (v = '-Infinity'::DOUBLE) AS minus_infinite, count(*) FILTER (isfinite(v)) AS finite,
    min(v) FILTER (isfinite(v)) AS least, max(v) FILTER (isfinite(v)) AS largest,
    count(*) FILTER (isfinite(v) AND v < lo) AS below, count(*) FILTER (isfinite(v) AND v > hi) AS above
  FROM long GROUP BY dataset, feature)
"""


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = _quality_sides(spark, sf_dir)
    parts = [quality.profile(f, FEATURES).withColumn("dataset", F.lit(s)) for s, f in sides.items()]
    return parts[0].unionByName(parts[1])


@register("missing_fraction", _DIRTY + "SELECT dataset, feature, rows, missing, round(missing / rows, 9) AS fraction FROM profile")
def missing_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiles(spark, sf_dir).select("dataset", "feature", "rows", "missing", F.round(F.col("missing") / F.col("rows"), 9).alias("fraction"))


@register("infinite_count", _DIRTY + "SELECT dataset, feature, plus_infinite, minus_infinite, finite FROM profile WHERE numeric")
def infinite_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _profiles(spark, sf_dir).where("finite is not null")
    return p.select("dataset", "feature", F.col("positive_infinities").alias("plus_infinite"), F.col("negative_infinities").alias("minus_infinite"), "finite")


@register("range_min_max", _DIRTY + "SELECT dataset, feature, least, largest, CASE WHEN lo IS NOT NULL THEN below END AS below_min, CASE WHEN hi IS NOT NULL THEN above END AS above_max FROM profile WHERE numeric")
def range_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiles(spark, sf_dir).where("finite is not null").select("dataset", "feature", "least", "largest", "below_min", "above_max")


@register("missing_increase_pp", _DIRTY + """
SELECT r.feature, round(r.missing / r.rows, 9) AS reference_fraction, round(c.missing / c.rows, 9) AS current_fraction, round((c.missing / c.rows - r.missing / r.rows) * 100.0, 9) AS increase_pp
FROM profile r JOIN profile c ON r.feature = c.feature AND r.dataset = 'reference' AND c.dataset = 'current'""")
def missing_increase_pp(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = _quality_sides(spark, sf_dir)
    found = quality.missing_increase(*[quality.profile(f, FEATURES) for f in sides.values()])
    return _rounded(found, "reference_fraction", "current_fraction", "increase_pp", digits=9)


@register("duplicate_fraction", """
WITH same AS (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_quantity)
SELECT sum(n)::BIGINT AS rows, sum(n - 1)::BIGINT AS duplicate_count, round(sum(n - 1) / sum(n), 9) AS duplicate_fraction FROM same""")
def duplicate_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(quality.duplicates(_table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")), "duplicate_fraction", digits=9)


_CHECKS = _DIRTY + """, checks AS (
  SELECT feature, dataset || '_missing_fraction' AS "check", missing / rows AS value, CASE WHEN nullable THEN 0.1 ELSE 0.0 END AS threshold,
    missing / rows > CASE WHEN nullable THEN 0.1 ELSE 0.0 END AS alert, CASE WHEN nullable THEN 'warning' ELSE 'critical' END AS bad FROM profile
  UNION ALL SELECT feature, dataset || '_infinite_count', plus_infinite + minus_infinite, 0.0, plus_infinite + minus_infinite > 0, 'critical' FROM profile WHERE numeric
  UNION ALL SELECT feature, dataset || '_min', least, lo, CASE WHEN least IS NOT NULL THEN below > 0 END, 'critical' FROM profile WHERE lo IS NOT NULL
  UNION ALL SELECT feature, dataset || '_max', largest, hi, CASE WHEN largest IS NOT NULL THEN above > 0 END, 'critical' FROM profile WHERE hi IS NOT NULL),
decided AS (SELECT feature, "check", round(value, 9) AS value, threshold, alert, CASE WHEN alert IS NULL THEN 'skipped' WHEN alert THEN bad ELSE 'ok' END AS status FROM checks)
"""


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [quality.checks(quality.profile(f, FEATURES), s, FEATURES, 0.1) for s, f in _quality_sides(spark, sf_dir).items()]
    return _rounded(parts[0].unionByName(parts[1]), "value", digits=9)


@register("quality_checks", _CHECKS + "SELECT feature, \"check\", value, threshold::DOUBLE AS threshold, alert, status FROM decided")
def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checks(spark, sf_dir)


@register("quality_status_summary", _CHECKS + """
SELECT count(*) AS n_checks, count(*) FILTER (status = 'error') AS n_error, count(*) FILTER (status = 'critical') AS n_critical, count(*) FILTER (status = 'warning') AS n_warning, count(*) FILTER (status = 'skipped') AS n_skipped,
  CASE WHEN bool_or(status = 'error') THEN 'error' WHEN bool_or(status = 'critical') THEN 'critical' WHEN bool_or(status = 'warning') THEN 'warning' WHEN bool_and(status = 'skipped') THEN 'skipped' ELSE 'ok' END AS status
FROM decided""")
def quality_status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_status(_checks(spark, sf_dir))


# ---- two samples: lineitem and orders, the current side shifted ----------------------------------------

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount"]


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _table(spark, sf_dir, "lineitem")  # noqa: E741
    shifted = l.where("l_orderkey % 3 = 0").select((F.col("l_quantity") + 3).alias("l_quantity"), (F.col("l_extendedprice") * 1.1).alias("l_extendedprice"), "l_discount")
    return numeric_long(l.where("l_orderkey % 3 <> 0"), shifted, NUMBERS)


def _summed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return twosample.cumulative(_numbers(spark, sf_dir))


_LONG = """
WITH sides AS (
  SELECT l_orderkey % 3 <> 0 AS is_reference, CASE WHEN l_orderkey % 3 = 0 THEN l_quantity + 3 ELSE l_quantity END AS l_quantity,
    CASE WHEN l_orderkey % 3 = 0 THEN l_extendedprice * 1.1::DOUBLE ELSE l_extendedprice END AS l_extendedprice, l_discount FROM lineitem),
long AS (
  SELECT 'l_quantity' AS feature, is_reference, l_quantity AS v FROM sides UNION ALL SELECT 'l_extendedprice', is_reference, l_extendedprice FROM sides UNION ALL SELECT 'l_discount', is_reference, l_discount FROM sides)
"""
_CDF = _LONG + """, counts AS (
  SELECT feature, v, count(*) FILTER (is_reference) AS r, count(*) FILTER (NOT is_reference) AS c FROM long GROUP BY feature, v),
cdf AS (
  SELECT feature, v, sum(r) OVER w / sum(r) OVER (PARTITION BY feature) - sum(c) OVER w / sum(c) OVER (PARTITION BY feature) AS gap, lead(v) OVER (PARTITION BY feature ORDER BY v) - v AS width
  FROM counts WINDOW w AS (PARTITION BY feature ORDER BY v)),
sizes AS (SELECT feature, count(*) FILTER (is_reference) AS n_reference, count(*) FILTER (NOT is_reference) AS n_current FROM long GROUP BY feature)
"""


@register("ks_statistic", _CDF + """
SELECT feature, any_value(n_reference) AS n_reference, any_value(n_current) AS n_current, round(max(abs(gap)), 9) AS ks FROM cdf JOIN sizes USING (feature) GROUP BY feature""")
def ks_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(twosample.ks_wasserstein(_summed(spark, sf_dir)).select("feature", "n_reference", "n_current", "ks"), "ks", digits=9)


@register("ks_location", _CDF + """
SELECT feature, arg_min(v, (-round(abs(gap), 12), v)) AS location, (CASE WHEN arg_min(gap, (-round(abs(gap), 12), v)) > 0 THEN 1 ELSE -1 END)::INTEGER AS sign FROM cdf GROUP BY feature""")
def ks_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return twosample.ks_wasserstein(_summed(spark, sf_dir)).select("feature", "location", "sign")


@register("wasserstein1", _CDF + "SELECT feature, round(sum(abs(gap) * coalesce(width, 0)), 6) AS wasserstein FROM cdf GROUP BY feature")
def wasserstein1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(twosample.ks_wasserstein(_summed(spark, sf_dir)).select("feature", "wasserstein"), "wasserstein")


@register("ks_asymptotic_p", """
WITH sides AS (SELECT o_orderkey % 2 = 0 AS is_reference, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE o_totalprice * 1.005::DOUBLE END AS v FROM orders),
counts AS (SELECT v, count(*) FILTER (is_reference) AS r, count(*) FILTER (NOT is_reference) AS c FROM sides GROUP BY v),
gaps AS (SELECT abs(sum(r) OVER w / sum(r) OVER () - sum(c) OVER w / sum(c) OVER ()) AS gap FROM counts WINDOW w AS (ORDER BY v)),
d AS (SELECT max(gap) AS ks, (SELECT sum(r) * sum(c) / sum(r + c) FROM counts) AS n FROM gaps)
SELECT round(ks, 9) AS ks, round(2 * (SELECT sum((CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * n * ks * ks)) FROM range(1, 101) t(k)), 6) AS p_value FROM d""")
def ks_asymptotic_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    long = numeric_long(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1").withColumn("o_totalprice", F.col("o_totalprice") * 1.005), ["o_totalprice"])
    found = twosample.ks_wasserstein(twosample.cumulative(long)).collect()  # a row per feature
    rows = [(round(r["ks"], 9), round(kolmogorov_tail(math.sqrt(r["n_reference"] * r["n_current"] / (r["n_reference"] + r["n_current"])) * r["ks"]), 6)) for r in found]
    return spark.createDataFrame(rows, "ks double, p_value double")


# ---- cells, PSI and JS ----------------------------------------------------------------------------------

_EDGES = _LONG + """, wide AS (
  SELECT feature, unnest(quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edge FROM long WHERE is_reference GROUP BY feature),
edges AS (SELECT feature, list_sort(list_distinct(list(edge))) AS edges FROM wide GROUP BY feature)"""
_CELLS = _EDGES + """, every AS (SELECT feature, unnest(range(0, len(edges) + 1))::INTEGER AS cell FROM edges),
counted AS (
  SELECT feature, (SELECT count(*) FROM (SELECT unnest(edges) AS e) WHERE e <= v)::INTEGER AS cell, count(*) FILTER (is_reference) AS r, count(*) FILTER (NOT is_reference) AS c
  FROM long JOIN edges USING (feature) GROUP BY 1, 2),
cells AS (
  SELECT feature, cell, coalesce(r, 0) AS r, coalesce(c, 0) AS c, coalesce(r, 0) / sum(coalesce(r, 0)) OVER (PARTITION BY feature) AS p, coalesce(c, 0) / sum(coalesce(c, 0)) OVER (PARTITION BY feature) AS q
  FROM every LEFT JOIN counted USING (feature, cell))"""
_PSI = """, sized AS (SELECT *, count(*) OVER (PARTITION BY feature) AS k FROM cells),
smooth AS (SELECT feature, k, p, q, (p + 1e-6) / (1 + 1e-6 * k) AS a, (q + 1e-6) / (1 + 1e-6 * k) AS b FROM sized)"""
_PSI_SELECT = _PSI + " SELECT feature, any_value(k) AS n_cells, round(sum((b - a) * ln(b / a)), 6) AS psi FROM smooth GROUP BY feature"
_JS_SELECT = _PSI + """ SELECT feature, any_value(k) AS n_cells,
  round(sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / (2 * ln(2)), 6) AS js FROM smooth GROUP BY feature"""


@register("quantile_edges", _EDGES + " SELECT feature, unnest(range(1, len(edges) + 1))::INTEGER AS place, round(unnest(edges), 6) AS edge FROM edges")
def quantile_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cells.quantile_edges(_summed(spark, sf_dir), 10).select("feature", F.posexplode("edges").alias("k", "edge"))
    return found.select("feature", (F.col("k") + 1).alias("place"), F.round("edge", 6).alias("edge"))


@register("numeric_histogram", _CELLS + " SELECT feature, cell, r AS n_reference, c AS n_current, round(p, 9) AS p_reference, round(q, 9) AS p_current FROM cells")
def numeric_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cells.numeric_cells(_summed(spark, sf_dir)), "p_reference", "p_current", digits=9)


@register("constant_reference_cells", """
WITH long AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 25 ELSE p_size END AS v, p_partkey % 2 = 0 AS is_reference FROM part)
SELECT 'p_size' AS feature, cell::INTEGER AS cell, count(v) FILTER (is_reference) AS n_reference, count(v) FILTER (NOT is_reference) AS n_current
FROM range(0, 3) t(cell) LEFT JOIN long ON sign(v - 25) + 1 = cell GROUP BY cell""")
def constant_reference_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part").select("p_partkey", "p_size")
    long = numeric_long(p.where("p_partkey % 2 = 0").withColumn("p_size", F.lit(25)), p.where("p_partkey % 2 = 1"), ["p_size"])
    return cells.numeric_cells(twosample.cumulative(long)).select("feature", "cell", "n_reference", "n_current")


@register("psi_numeric", _CELLS + _PSI_SELECT)
def psi_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(psi_js(cells.numeric_cells(_summed(spark, sf_dir))).select("feature", "n_cells", "psi"), "psi")


@register("js_numeric", _CELLS + _JS_SELECT)
def js_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(psi_js(cells.numeric_cells(_summed(spark, sf_dir))).select("feature", "n_cells", "js"), "js")


# ---- categories: orders, customers and parts, the current side filtered --------------------------------


def _category_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    own = category_long(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1 and (o_orderpriority <> '1-URGENT' or o_orderkey % 5 = 0)"), ["o_orderstatus", "o_orderpriority"])
    d = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return cells.category_cells(own.unionByName(category_long(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1 and lang <> 'fr'"), ["source", "lang"])))


_CATEGORY_CELLS = """
WITH long AS (
  SELECT f AS feature, o_orderkey % 2 = 0 AS is_reference, CASE WHEN f = 'o_orderstatus' THEN o_orderstatus ELSE o_orderpriority END AS v
  FROM orders, (VALUES ('o_orderstatus'), ('o_orderpriority')) t(f) WHERE o_orderkey % 2 = 0 OR o_orderpriority <> '1-URGENT' OR o_orderkey % 5 = 0
  UNION ALL SELECT f, doc_id % 2 = 0, CASE WHEN f = 'lang' THEN lang ELSE source END FROM documents, (VALUES ('lang'), ('source')) t(f) WHERE doc_id % 2 = 0 OR lang <> 'fr'),
counted AS (SELECT feature, 'string:' || v AS cell, count(*) FILTER (is_reference) AS r, count(*) FILTER (NOT is_reference) AS c FROM long WHERE v IS NOT NULL GROUP BY ALL),
cells AS (SELECT *, r / sum(r) OVER (PARTITION BY feature) AS p, c / sum(c) OVER (PARTITION BY feature) AS q FROM counted)
"""


@register("category_counts", _CATEGORY_CELLS + "SELECT feature, cell, r AS n_reference, c AS n_current, round(p, 9) AS p_reference, round(q, 9) AS p_current FROM cells")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_category_cells(spark, sf_dir), "p_reference", "p_current", digits=9)


@register("psi_categorical", _CATEGORY_CELLS.rstrip() + _PSI_SELECT)
def psi_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(psi_js(_category_cells(spark, sf_dir)).select("feature", "n_cells", "psi"), "psi")


@register("js_categorical", _CATEGORY_CELLS.rstrip() + _JS_SELECT)
def js_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(psi_js(_category_cells(spark, sf_dir)).select("feature", "n_cells", "js"), "js")


_POOLED = _CATEGORY_CELLS.rstrip() + """, pooled AS (
  SELECT feature, CASE WHEN r + c < 10 THEN '<pooled rare categories>' ELSE cell END AS cell, sum(r)::BIGINT AS r, sum(c)::BIGINT AS c FROM cells GROUP BY ALL),
expected AS (SELECT *, sum(r) OVER w AS tr, sum(c) OVER w AS tc, (r + c) * sum(r) OVER w / sum(r + c) OVER w AS er, (r + c) * sum(c) OVER w / sum(r + c) OVER w AS ec FROM pooled WINDOW w AS (PARTITION BY feature)),
chi AS (
  SELECT feature, count(*) AS n_cells, sum((r - er) ** 2 / er + (c - ec) ** 2 / ec) AS x, any_value(tr + tc) AS n, min(least(r, c)) AS least_observed, min(least(er, ec)) AS least_expected FROM expected GROUP BY feature),
gated AS (SELECT *, n_cells >= 2 AND least_observed >= 5 AND least_expected >= 5 AS applies FROM chi)
"""


@register("rare_pooling", _POOLED + "SELECT feature, cell, r AS n_reference, c AS n_current FROM pooled")
def rare_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.pooled(_category_cells(spark, sf_dir))


@register("chi2_statistic", _POOLED + "SELECT feature, n_cells, n_cells - 1 AS dof, CASE WHEN applies THEN round(x, 6) END AS chi2, least_observed, round(least_expected, 6) AS least_expected, applies FROM gated")
def chi2_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cat.chi_square(_category_cells(spark, sf_dir)).select("feature", "n_cells", "dof", "chi2", "least_observed", "least_expected", "applies")
    return _rounded(found, "chi2", "least_expected")


@register("cramers_v", _POOLED + "SELECT feature, CASE WHEN applies THEN round(sqrt(x / n), 9) END AS cramers_v FROM gated")
def cramers_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cat.chi_square(_category_cells(spark, sf_dir)).select("feature", "cramers_v"), "cramers_v", digits=9)


@register("category_changes", _CATEGORY_CELLS + """
SELECT feature, count(*) AS n_categories, count(*) FILTER (r = 0) AS n_new, count(*) FILTER (c = 0) AS n_gone, count(*) FILTER (r + c < 10) AS n_pooled,
  round(coalesce(sum(r) FILTER (r + c < 10), 0) / sum(r), 9) AS pooled_fraction_reference, round(coalesce(sum(c) FILTER (r + c < 10), 0) / sum(c), 9) AS pooled_fraction_current,
  round(coalesce(sum(r + c) FILTER (r + c < 10), 0) / sum(r + c), 9) AS pooled_fraction
FROM cells GROUP BY feature""")
def category_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cat.category_changes(_category_cells(spark, sf_dir)), "pooled_fraction_reference", "pooled_fraction_current", "pooled_fraction", digits=9)


@register("new_disappeared_categories", _CATEGORY_CELLS + "SELECT feature, cell, CASE WHEN r = 0 THEN 'new' ELSE 'disappeared' END AS change FROM cells WHERE r = 0 OR c = 0")
def new_disappeared_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.new_and_gone(_category_cells(spark, sf_dir))


# ---- decisions: one p-value and one distance per market segment and part brand ----------------------------


def _p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("feature")).agg(F.count("*").alias("n"))
    p = _table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.count("*").alias("n"))
    return c.select("feature", F.lit("chi2").alias("method"), F.round(F.exp(-F.col("n") % 37 / 7.0), 9).alias("p_value")).unionByName(p.select("feature", F.lit("ks").alias("method"), F.round(F.exp(-F.col("n") % 23 / 5.0), 9).alias("p_value")))


_P_VALUES = """
WITH p AS (
  SELECT c_mktsegment AS feature, 'chi2' AS method, round(exp(-count(*) % 37 / 7.0::DOUBLE), 9) AS p_value FROM customer GROUP BY 1
  UNION ALL SELECT p_brand, 'ks', round(exp(-count(*) % 23 / 5.0::DOUBLE), 9) FROM part GROUP BY 1)
"""


@register("bh_adjust", _P_VALUES + """, ranked AS (SELECT *, row_number() OVER (ORDER BY p_value, feature, method) AS rank, count(*) OVER () AS family_size FROM p),
adjusted AS (SELECT *, min(least(1.0, p_value * family_size / rank)) OVER (ORDER BY rank DESC) AS q FROM ranked)
SELECT feature, method, p_value, rank::INTEGER AS rank, family_size, round(q, 9) AS adjusted_p_value, q < 0.05 AS alert, CASE WHEN q < 0.05 THEN 'warning' ELSE 'ok' END AS status FROM adjusted""")
def bh_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(benjamini_hochberg(_p_values(spark, sf_dir), 0.05), "adjusted_p_value", digits=9)


@register("raw_p_rule", _P_VALUES + "SELECT feature, method, p_value, p_value < 0.05 AS alert, CASE WHEN p_value < 0.05 THEN 'warning' ELSE 'ok' END AS status FROM p")
def raw_p_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_p_values(_p_values(spark, sf_dir), 0.05)


_THRESHOLDS = [("lang", "psi", None), ("source", "psi", 0.002), (None, "psi", 0.1), (None, "js", 0.01), ("source", "wasserstein", 1.0)]


def _distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = psi_js(_category_cells(spark, sf_dir))
    both = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.round(m, 9).alias("value")) for m in ("psi", "js")]))
    values = found.select("feature", both.alias("x")).select("feature", "x.*")
    return distance_decisions(values, spark.createDataFrame(_THRESHOLDS, "feature string, method string, threshold double"))


_DISTANCES = _CATEGORY_CELLS.rstrip() + _PSI + """, both_values AS (
  SELECT feature, 'psi' AS method, round(sum((b - a) * ln(b / a)), 9) AS value FROM smooth GROUP BY feature
  UNION ALL SELECT feature, 'js', round(sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / (2 * ln(2)), 9) FROM smooth GROUP BY feature),
resolved AS (
  SELECT feature, method, value, CASE WHEN feature = 'lang' AND method = 'psi' THEN NULL WHEN feature = 'source' AND method = 'psi' THEN 0.002 WHEN method = 'psi' THEN 0.1 ELSE 0.01 END::DOUBLE AS threshold,
    CASE WHEN feature IN ('lang', 'source') AND method = 'psi' THEN 'feature' ELSE 'global' END AS threshold_source FROM both_values),
decided AS (SELECT *, value > threshold AS alert, CASE WHEN value > threshold THEN 'warning' ELSE 'ok' END AS status FROM resolved)
"""


@register("threshold_resolution", _DISTANCES + "SELECT feature, method, threshold, threshold_source FROM resolved")
def threshold_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distances(spark, sf_dir).select("feature", "method", "threshold", "threshold_source")


@register("distance_decision", _DISTANCES + "SELECT feature, method, round(value, 6) AS value, threshold, alert, status FROM decided")
def distance_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_distances(spark, sf_dir).select("feature", "method", "value", "threshold", "alert", "status"), "value")


@register("feature_status_rollup", _DISTANCES + "SELECT feature, CASE WHEN bool_or(status = 'warning') THEN 'warning' ELSE 'ok' END AS status, bool_or(alert) AS alert FROM decided GROUP BY feature")
def feature_status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roll_up(_distances(spark, sf_dir), "feature")


@register("alerts_union", f"""
SELECT 'quality' AS source, feature, "check", CASE WHEN status = 'critical' THEN 'critical' ELSE 'warning' END AS severity FROM ({_CHECKS} SELECT * FROM decided) WHERE alert
UNION ALL SELECT 'drift', feature, method, 'warning' FROM ({_DISTANCES} SELECT * FROM decided) WHERE alert""")
def alerts_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    drift = _distances(spark, sf_dir).withColumnRenamed("method", "check")
    return alerts(_checks(spark, sf_dir), "quality").unionByName(alerts(drift, "drift"))


# ---- events: windows, idempotency, feedback, performance ---------------------------------------------------


@register("count_tumbling_window", """
WITH n AS (SELECT event_id, event_type, value, row_number() OVER (ORDER BY ts, event_id) AS n, count(*) OVER () AS total FROM events)
SELECT ((n - 1) // 500)::BIGINT AS window_no, count(*) AS events, count(DISTINCT event_type) AS types, round(avg(value), 6) AS mean_value, min(event_id) AS first_id FROM n WHERE n <= total // 500 * 500 GROUP BY 1""")
def count_tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tumbling_windows(_table(spark, sf_dir, "events").select("event_id", "event_type", "value", "ts"), 500, ["ts", "event_id"])
    return _rounded(w.groupBy("window_no").agg(F.count("*").alias("events"), F.count_distinct("event_type").alias("types"), F.avg("value").alias("mean_value"), F.min("event_id").alias("first_id")), "mean_value")


@register("window_drift", """
WITH n AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY event_type) AS total FROM events),
w AS (SELECT event_type, (n - 1) // 400 AS window_no, value FROM n WHERE n <= total // 400 * 400),
base AS (SELECT event_type, avg(value) AS mean FROM w WHERE window_no = 0 GROUP BY 1)
SELECT event_type, window_no::BIGINT AS window_no, round(avg(value) - any_value(mean), 6) AS shift FROM w JOIN base USING (event_type) GROUP BY 1, 2""")
def window_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tumbling_windows(_table(spark, sf_dir, "events").select("event_id", "event_type", "value", "ts"), 400, ["ts", "event_id"], "event_type")
    means = w.groupBy("event_type", "window_no").agg(F.avg("value").alias("mean"))
    base = means.where("window_no = 0").select("event_type", F.col("mean").alias("base"))
    return means.join(base, "event_type").select("event_type", "window_no", F.round(F.col("mean") - F.col("base"), 6).alias("shift"))


def _variants(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Orders with nulls, and tables that differ from them: by order only, in where nulls stand, by a type, a value or a row."""
    o = _table(spark, sf_dir, "orders")
    price, status = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus"))
    own = lambda a, b, c: o.select(a.alias("a"), b.alias("b"), c.alias("c"))
    other = F.when(F.col("o_orderkey") % 2 == 1, F.col("o_totalprice"))
    return {
        "itself": own(price, other, status), "another_order": own(price, other, status).repartition(3), "nulls_swapped": own(other, price, status),
        "one_value": own(F.when(F.col("o_orderkey") == 0, 0.5).when(F.col("o_orderkey") == 1, 0.25).otherwise(price), other, status), "a_row_less": own(price, other, status).where("c is not null or b is null"),
    }


@register("reference_fingerprint", """
WITH base AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS a, CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice END AS b, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS c FROM orders),
variants AS (
  SELECT 'itself' AS variant, a, b, c FROM base UNION ALL SELECT 'another_order', a, b, c FROM base UNION ALL SELECT 'nulls_swapped', b, a, c FROM base
  UNION ALL SELECT 'one_value', CASE WHEN k = 0 THEN 0.5 WHEN k = 1 THEN 0.25 ELSE a END, b, c FROM base UNION ALL SELECT 'a_row_less', a, b, c FROM base WHERE c IS NOT NULL OR b IS NULL),
counted AS (SELECT variant, a, b, c, count(*) AS n FROM variants GROUP BY ALL),
gone AS (
  SELECT v.variant FROM (SELECT DISTINCT variant FROM variants) v JOIN (SELECT a, b, c, n FROM counted WHERE variant = 'itself') i ON true
  WHERE NOT EXISTS (SELECT 1 FROM counted x WHERE x.variant = v.variant AND x.n = i.n AND x.a IS NOT DISTINCT FROM i.a AND x.b IS NOT DISTINCT FROM i.b AND x.c IS NOT DISTINCT FROM i.c))
SELECT variant, count(*) AS rows, variant NOT IN (SELECT variant FROM gone) AND count(*) = (SELECT count(*) FROM base) AS same FROM variants GROUP BY variant""")
def reference_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tables have the fingerprint of the first one: content decides, where nulls stand included, and order does not."""
    found = {name: content_sums(frame) for name, frame in _variants(spark, sf_dir).items()}
    return spark.createDataFrame([(name, sums[0], sums == found["itself"]) for name, sums in found.items()], "variant string, rows long, same boolean")


@register("window_distances", """
WITH n AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY event_type) AS total FROM events),
w AS (SELECT event_type, (n - 1) // 400 AS window_no, value FROM n WHERE n <= total // 400 * 400),
r AS (SELECT event_type, value FROM events WHERE user_id % 3 = 0),
both_sides AS (SELECT event_type, window_no, value, 0 AS r, 1 AS c FROM w UNION ALL SELECT event_type, window_no, value, 1, 0 FROM r JOIN (SELECT DISTINCT event_type, window_no FROM w) USING (event_type)),
points AS (SELECT event_type, window_no, value, sum(r) AS r, sum(c) AS c FROM both_sides WHERE isfinite(value) GROUP BY ALL),
gaps AS (
  SELECT *, (sum(r) OVER o)::DOUBLE / (sum(r) OVER g) - (sum(c) OVER o)::DOUBLE / (sum(c) OVER g) AS gap, lead(value) OVER o - value AS step FROM points
  WINDOW o AS (PARTITION BY event_type, window_no ORDER BY value), g AS (PARTITION BY event_type, window_no))
SELECT event_type, window_no::BIGINT AS window_no, sum(r)::BIGINT AS n_reference, sum(c)::BIGINT AS n_current, round(max(abs(gap)), 9) AS ks,
  min_by(value, (-abs(gap), value)) AS location, CASE WHEN min_by(gap, (-abs(gap), value)) > 0 THEN 1 ELSE -1 END AS sign, round(sum(abs(gap) * coalesce(step, 0)), 9) AS wasserstein
FROM gaps GROUP BY 1, 2""")
def window_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window of an event type against the events of a third of the users, by an index of these."""
    e = _table(spark, sf_dir, "events").select("event_id", "event_type", "value", "ts", "user_id")
    values = e.where((F.col("user_id") % 3 == 0) & is_finite(F.col("value")))
    path = f"{shared_folder(spark)}/tidemark-index-{uuid.uuid4().hex}"
    Index.write(values.groupBy(F.col("event_type").alias("name"), F.col("value").alias("v")).agg(F.count("*").alias("n")), path)
    w = tumbling_windows(e, 400, ["ts", "event_id"], "event_type").where(is_finite(F.col("value")))
    samples = w.select(F.concat_ws("/", "event_type", "window_no").alias("feature"), F.col("event_type").alias("name"), F.col("value").alias("v"))
    found = sample_distances(Index.read(spark, path), samples)
    own = F.split("feature", "/")
    return _rounded(found.select(own[0].alias("event_type"), own[1].cast("long").alias("window_no"), "n_reference", "n_current", "ks", "location", "sign", "wasserstein"), "ks", "wasserstein", digits=9)


@register("event_dedup_conflict", """
WITH incoming AS (
  SELECT event_id, sha256(concat_ws('|', event_type, value::VARCHAR)) AS h, 1 AS position FROM events WHERE event_id % 4 <> 0
  UNION ALL SELECT event_id, sha256(concat_ws('|', event_type, value::VARCHAR)), 2 FROM events WHERE event_id % 3 = 0
  UNION ALL SELECT event_id, sha256('other'), 3 FROM events WHERE event_id % 5 = 0),
known AS (SELECT event_id, sha256(concat_ws('|', event_type, value::VARCHAR)) AS known FROM events WHERE event_id % 7 = 0),
j AS (SELECT *, coalesce(known, first(h) OVER (PARTITION BY event_id ORDER BY position)) AS truth, row_number() OVER (PARTITION BY event_id ORDER BY position) AS place FROM incoming LEFT JOIN known USING (event_id))
SELECT outcome, count(*) AS n, sum(event_id)::BIGINT AS ids FROM (
  SELECT event_id, CASE WHEN known IS NULL AND place = 1 THEN 'accepted' WHEN h = truth THEN 'duplicate' ELSE 'conflict' END AS outcome FROM j) GROUP BY outcome""")
def event_dedup_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    digest = F.sha2(F.concat_ws("|", "event_type", F.col("value").cast("string")), 256)
    part = lambda where, position, h: e.where(where).select("event_id", h.alias("payload_sha256"), F.lit(position).alias("position"))
    incoming = part("event_id % 4 <> 0", 1, digest).unionByName(part("event_id % 3 = 0", 2, digest)).unionByName(part("event_id % 5 = 0", 3, F.sha2(F.lit("other"), 256)))
    found = classify(incoming, e.where("event_id % 7 = 0").select("event_id", digest.alias("payload_sha256")))
    return found.groupBy("outcome").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


#: By id modulo 8: the same object, other white space, a text, a fraction, no object, no JSON, a key more, a boolean.
_PAYLOADS = ["{p}", '{{ "k" : {k} }}', '{{"k": "{k}"}}', '{{"k": {k}.0}}', "[{k}]", "not json", '{{"k": {k}, "j": null}}', '{{"k": true}}']


def _payload_cases() -> str:
    parts = [f"WHEN {n} THEN '" + x.format(p="' || props || '", k="' || k || '") + "'" for n, x in enumerate(_PAYLOADS)]
    return f"CASE event_id % {len(_PAYLOADS)} {' '.join(parts)} END"


@register("event_payload_types", f"""
WITH numbered AS (SELECT event_id, props, json_extract_string(props, '$.k') AS k FROM events),
incoming AS (SELECT event_id, props, {_payload_cases()} AS features FROM numbered),
checked AS (SELECT *, CASE WHEN json_valid(features) THEN features END AS j FROM incoming)
SELECT outcome, count(*) AS n, sum(event_id)::BIGINT AS ids FROM (
  SELECT event_id, CASE WHEN j IS NULL OR json_type(j) <> 'OBJECT' THEN 'rejected'
    WHEN json_keys(j) = ['k'] AND json_type(j, '$.k') = json_type(props, '$.k') AND json_extract_string(j, '$.k') = json_extract_string(props, '$.k') THEN 'duplicate' ELSE 'conflict' END AS outcome FROM checked)
GROUP BY outcome""")
def event_payload_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of known ids: equal as JSON or not, types included; what is no object is no event."""
    e = _table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("event_id"), "props", F.get_json_object("props", "$.k").alias("k"))
    rows = lambda features: validated(e.select("event_id", F.lit("2024-05-01T10:00:00Z").alias("occurred_at"), features.alias("features"), F.lit(None).cast("string").alias("prediction_json"), F.lit(None).cast("double").alias("score")))
    digest = payload_hash("event_id", "occurred_at", "features", "shape").alias("payload_sha256")
    # read three times from here on, and a filter on `reason` would parse the payloads once for every place that it names them
    incoming = cut(rows(F.expr(_payload_cases())).select("event_id", digest, "reason", F.lit(1).alias("position")))
    known = rows(F.col("props")).select("event_id", digest)
    told = classify(incoming.where("reason is null").drop("reason"), known).select("event_id", "outcome")
    both = told.unionByName(incoming.where("reason is not null").select("event_id", F.lit("rejected").alias("outcome")))
    return both.groupBy("outcome").agg(F.count("*").alias("n"), F.sum(F.col("event_id").cast("long")).alias("ids"))


#: JSON lines by id modulo 9: a good one, a key missing, one too many, no such day, no offset, features that are a list, a number for an id, a line cut short, a text for a score.
_LINE_PARTS = {
    "id": """CASE WHEN event_id % 9 = 6 THEN event_id::VARCHAR ELSE '"' || event_id::VARCHAR || '"' END""",
    "at": """CASE event_id % 9 WHEN 3 THEN '2024-02-30T10:00:00Z' WHEN 4 THEN '2024-05-01T10:00:00' ELSE '2024-05-01T10:00:00+02:00' END""",
    "features": """CASE event_id % 9 WHEN 1 THEN '' WHEN 5 THEN ',"features":[1]' ELSE ',"features":' || props END""",
    "rest": """CASE event_id % 9 WHEN 2 THEN ',"more":1}' WHEN 7 THEN '' WHEN 8 THEN ',"score":"high"}' ELSE ',"score":0.5}' END""",
}
_LINE = f"""'{{"event_id":' || {_LINE_PARTS["id"]} || ',"occurred_at":"' || {_LINE_PARTS["at"]} || '"' || {_LINE_PARTS["features"]} || {_LINE_PARTS["rest"]}"""


@register("event_validation", f"""
WITH lines AS (SELECT {_LINE} AS line FROM events),
parsed AS (SELECT line, CASE WHEN json_valid(line) THEN line END AS j FROM lines),
keyed AS (
  SELECT *, list_sort(list_filter(['event_id', 'features', 'occurred_at'], lambda k: NOT list_contains(json_keys(j), k))) AS missing,
    list_sort(list_filter(json_keys(j), lambda k: k NOT IN ('event_id', 'features', 'occurred_at', 'prediction', 'score'))) AS unknown, json_extract_string(j, '$.occurred_at') AS moment FROM parsed)
SELECT reason, count(*) AS n, sum(length(line))::BIGINT AS size FROM (
  SELECT line, CASE WHEN j IS NULL THEN 'not JSON' WHEN len(missing) > 0 THEN 'missing keys: ' || array_to_string(missing, ', ') WHEN len(unknown) > 0 THEN 'unknown keys: ' || array_to_string(unknown, ', ')
    WHEN json_type(j, '$.score') NOT IN ('DOUBLE', 'UBIGINT', 'BIGINT', 'NULL') THEN 'score must be a finite number' WHEN json_type(j, '$.event_id') <> 'VARCHAR' THEN 'event_id must be text that is not blank'
    WHEN NOT regexp_matches(moment, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$') OR try_cast(moment[:19] AS TIMESTAMP) IS NULL THEN 'occurred_at must be an ISO 8601 time with an offset'
    WHEN json_type(j, '$.features') <> 'OBJECT' THEN 'features must be an object' ELSE 'none' END AS reason FROM keyed)
GROUP BY reason""")
def event_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why lines of JSON are no events."""
    lines = _table(spark, sf_dir, "events").select(F.expr(_LINE.replace("::VARCHAR", "::STRING")).alias("value"))
    found = validated(envelopes(lines))
    return found.groupBy(F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("size"))


@register("label_settlement", """
WITH incoming AS (
  SELECT event_id, (event_id % 2)::VARCHAR AS y, 1 AS position FROM events WHERE event_id % 3 <> 0
  UNION ALL SELECT event_id, (1 - event_id % 2)::VARCHAR, 2 FROM events WHERE event_id % 4 = 0
  UNION ALL SELECT event_id, (event_id % 2)::VARCHAR, 3 FROM events WHERE event_id % 6 = 1),
known AS (SELECT event_id, (event_id % 2)::VARCHAR AS known FROM events WHERE event_id % 7 = 0),
j AS (SELECT *, coalesce(known, first(y) OVER (PARTITION BY event_id ORDER BY position)) AS truth, row_number() OVER (PARTITION BY event_id ORDER BY position) AS place FROM incoming LEFT JOIN known USING (event_id))
SELECT outcome, count(*) AS n, sum(event_id)::BIGINT AS ids FROM (
  SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'parked' WHEN known IS NULL AND place = 1 THEN 'accepted' WHEN y = truth THEN 'duplicate' ELSE 'conflict' END AS outcome FROM j) GROUP BY outcome""")
def label_settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of events that have come and of others, some known already, some given twice or otherwise."""
    e = _table(spark, sf_dir, "events").select("event_id")
    own = (F.col("event_id") % 2).cast("string")
    part = lambda where, y, position: e.where(where).select("event_id", y.alias("y_json"), F.lit(position).alias("position"))
    incoming = part("event_id % 3 <> 0", own, 1).unionByName(part("event_id % 4 = 0", (1 - F.col("event_id") % 2).cast("string"), 2)).unionByName(part("event_id % 6 = 1", own, 3))
    found = settled(incoming, e.where("event_id % 5 <> 0"), part("event_id % 7 = 0", own, 0).drop("position"))
    return found.groupBy("outcome").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as events with a prediction and a score, labels as late feedback; a window per source."""
    d = _table(spark, sf_dir, "documents")
    events = d.select(F.col("doc_id").alias("event_id"), F.col("source").alias("window_id"), F.when(F.col("n_chars") > 800, "1").when(F.col("doc_id") % 11 > 0, "0").alias("prediction_json"), F.when(F.col("doc_id") % 13 > 0, F.round(F.col("n_chars") % 997 / 997.0, 6)).alias("score"))
    feedback = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("event_id"), F.col("quality").cast("string").alias("y_json"))
    return feedback_join(events, feedback)


_SAMPLES = """
WITH samples AS (
  SELECT d.doc_id AS event_id, source AS window_id, CASE WHEN n_chars > 800 THEN '1' WHEN d.doc_id % 11 > 0 THEN '0' END AS prediction_json,
    CASE WHEN d.doc_id % 13 > 0 THEN round(n_chars % 997 / 997.0::DOUBLE, 6) END AS score, quality::VARCHAR AS y_json
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
acc AS (
  SELECT window_id, count(*) AS feedback_rows, count(prediction_json) AS accuracy_rows, avg(CASE WHEN prediction_json IS NOT NULL THEN (prediction_json = y_json)::INTEGER END) AS accuracy, count(score) AS roc_auc_rows FROM samples GROUP BY 1),
ranked AS (SELECT window_id, y_json::INTEGER AS y, rank() OVER w + (count(*) OVER (PARTITION BY window_id, score) - 1) / 2.0::DOUBLE AS rank FROM samples WHERE score IS NOT NULL WINDOW w AS (PARTITION BY window_id ORDER BY score)),
auc AS (
  SELECT window_id, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg, CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN (sum(CASE WHEN y = 1 THEN rank END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * sum(1 - y)) END AS roc_auc FROM ranked GROUP BY 1)
"""
_PERFORMANCE = {"enabled": True, "min_feedback_rows": 15, "baseline_accuracy": 0.75, "max_accuracy_drop": 0.1, "baseline_roc_auc": 0.6, "max_roc_auc_drop": 0.05}


@register("feedback_join", _SAMPLES + "SELECT event_id, window_id, prediction_json, score, y_json FROM samples")
def feedback_join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir).select("event_id", "window_id", "prediction_json", "score", "y_json")


@register("online_accuracy", _SAMPLES + "SELECT window_id, feedback_rows, accuracy_rows, CASE WHEN feedback_rows >= 15 AND accuracy_rows >= 15 THEN round(accuracy, 9) END AS accuracy FROM acc")
def online_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(performance(_samples(spark, sf_dir), _PERFORMANCE).select("window_id", "feedback_rows", "accuracy_rows", "accuracy"), "accuracy", digits=9)


@register("online_roc_auc", _SAMPLES + "SELECT window_id, pos AS n_positive, neg AS n_negative, round(roc_auc, 9) AS roc_auc FROM auc")
def online_roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _samples(spark, sf_dir).select("window_id", F.col("y_json").cast("int").alias("label"), "score")
    return _rounded(twosample.roc_auc(scored, "window_id"), "roc_auc", digits=9)


@register("performance_degradation", _SAMPLES + """, m AS (
  SELECT window_id, feedback_rows, CASE WHEN feedback_rows >= 15 AND accuracy_rows >= 15 THEN accuracy END AS accuracy, CASE WHEN feedback_rows >= 15 AND roc_auc_rows >= 15 THEN roc_auc END AS roc_auc FROM acc LEFT JOIN auc USING (window_id))
SELECT window_id, round(0.75 - accuracy, 9) AS accuracy_drop, 0.75 - accuracy > 0.1 AS accuracy_alert, round(0.6 - roc_auc, 9) AS roc_auc_drop, 0.6 - roc_auc > 0.05 AS roc_auc_alert,
  CASE WHEN accuracy IS NULL AND roc_auc IS NULL THEN 'not_evaluated' ELSE 'evaluated' END AS status,
  CASE WHEN feedback_rows < 15 THEN 'insufficient_feedback' WHEN accuracy IS NULL AND roc_auc IS NULL THEN 'metrics_unavailable' END AS reason FROM m""")
def performance_degradation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = performance(_samples(spark, sf_dir), _PERFORMANCE)
    return _rounded(found.select("window_id", "accuracy_drop", "accuracy_alert", "roc_auc_drop", "roc_auc_alert", "status", "reason"), "accuracy_drop", "roc_auc_drop", digits=9)


# ---- states, pages and joins of monitoring, on orders as runs and lineitems as deliveries -------------------


def _order_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs; half of them have a result."""
    o = _table(spark, sf_dir, "orders")
    result = F.when(F.col("o_orderkey") % 2 == 0, F.to_json(F.struct(F.struct(F.lower("o_orderstatus").alias("status"), (F.col("o_orderkey") % 4).alias("n_alerts")).alias("summary"))))
    return o.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status"), result.alias("result"))


def _event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stored events: views wait, clicks are claimed by their user's window."""
    e = _table(spark, sf_dir, "events")
    state = F.when(F.col("event_type") == "view", "buffered").when(F.col("event_type") == "click", "claimed").otherwise("processed")
    return e.select("event_id", F.col("event_id").alias("sequence"), state.alias("state"), F.when(state == "claimed", F.col("user_id")).alias("window_id"), "ts")


@register("state_counts", "SELECT CASE event_type WHEN 'view' THEN 'buffered' WHEN 'click' THEN 'claimed' ELSE 'processed' END AS state, count(*) AS n FROM events GROUP BY 1")
def state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.counts_by(_event_records(spark, sf_dir), "state")


@register("claimed_windows", "SELECT user_id AS window_id, min(event_id) AS first_sequence FROM events WHERE event_type = 'click' GROUP BY 1")
def claimed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.claimed(_event_records(spark, sf_dir))


@register("oldest_buffered", "SELECT event_id, ts FROM events WHERE event_type = 'view' ORDER BY ts, event_id LIMIT 50")
def oldest_buffered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.oldest(_event_records(spark, sf_dir), "buffered", 50, "ts").select("event_id", "ts")


@register("runs_page", "SELECT o_orderkey AS run_id, o_orderdate AS created_at, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 100")
def runs_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.page(_order_runs(spark, sf_dir).drop("result"), 50, 100, "F")


@register("runs_overview", """
SELECT o_orderkey AS run_id, o_orderdate AS created_at, o_orderstatus AS status, delivered, undelivered, CASE WHEN o_custkey % 3 = 0 THEN 'evaluated' END AS performance_status,
  CASE WHEN o_custkey % 3 = 0 THEN o_custkey::VARCHAR END AS metrics, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 4 END AS n_alerts, CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderstatus) END AS result_status
FROM orders LEFT JOIN (
  SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS delivered, count(*) FILTER (l_returnflag = 'R') AS undelivered FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def runs_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("l_returnflag") == "A", "succeeded").when(F.col("l_returnflag") == "R", "failed").otherwise("pending")
    deliveries = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), state.alias("status"))
    measured = _table(spark, sf_dir, "orders").where("o_custkey % 3 = 0").select(F.col("o_orderkey").alias("run_id"), F.lit("evaluated").alias("status"), F.col("o_custkey").cast("string").alias("metrics"))
    return records.overview(_order_runs(spark, sf_dir), deliveries, measured)


@register("foreign_keys", """
SELECT count(*) FILTER (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS known, count(*) FILTER (NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS unknown FROM customer""")
def foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = _table(spark, sf_dir, "customer").select("c_custkey"), _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return records.with_known(c, o, "c_custkey").agg(F.count_if("known").alias("known"), F.count_if(~F.col("known")).alias("unknown"))


@register("latest_versions", "SELECT o_custkey AS record, max(o_orderkey) AS version, arg_max(o_orderstatus, o_orderkey) AS state FROM orders GROUP BY 1")
def latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.latest(_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("record"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("state")), "record")


# ---- calibration, display, learning --------------------------------------------------------------------------


@register("calibration_summary", """
WITH runs AS (
  SELECT l_shipmode_like AS case_id, CASE WHEN l_suppkey % 3 = 0 THEN 8.0 END AS age_shift_years, CASE WHEN l_suppkey % 3 = 1 THEN 8.0 END AS current_missing_fraction, CASE WHEN l_linenumber = 1 THEN 'none' ELSE 'numeric' END AS scenario, l_linenumber AS method, l_suppkey % 5 AS seed, l_quantity AS value, CASE WHEN l_tax > 0.02 THEN l_discount > 0.05 END AS alert, l_linenumber > 3 AS expected_signal
  FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode_like FROM lineitem))
SELECT case_id, age_shift_years, current_missing_fraction, scenario, method, string_agg(DISTINCT seed::VARCHAR, '|' ORDER BY seed::VARCHAR) AS seeds, count(DISTINCT seed) AS n_runs, count(alert) AS n_decisions, count(*) FILTER (alert) AS n_alerts, round(avg(value), 6) AS mean_value, median(value) AS median_value,
  CASE WHEN scenario = 'none' THEN 'false_alert_rate' WHEN any_value(expected_signal) THEN 'detection_rate' ELSE 'non_target_alert_rate' END AS rate_kind, round(count(*) FILTER (alert) / nullif(count(alert), 0), 9) AS observed_rate
FROM runs GROUP BY case_id, age_shift_years, current_missing_fraction, scenario, method""")
def calibration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _table(spark, sf_dir, "lineitem")  # noqa: E741
    runs = l.select(
        F.concat("l_returnflag", "l_linestatus").alias("case_id"), F.when(F.col("l_linenumber") == 1, "none").otherwise("numeric").alias("scenario"), F.lit("f").alias("drift_family"), F.lit("l").alias("drift_level"), F.lit(1).alias("n_current"),
        F.when(F.col("l_suppkey") % 3 == 0, 8.0).alias("age_shift_years"), F.when(F.col("l_suppkey") % 3 == 1, 8.0).alias("current_missing_fraction"), F.lit("drift").alias("source"), F.lit(None).cast("string").alias("feature"), F.col("l_linenumber").alias("method"), (F.col("l_linenumber") > 3).alias("expected_signal"),
        F.lit("sha").alias("config_sha256"), (F.col("l_suppkey") % 5).alias("seed"), F.col("l_quantity").alias("value"), F.when(F.col("l_tax") > 0.02, F.col("l_discount") > 0.05).alias("alert"),
    )
    found = summarize(runs).select("case_id", "age_shift_years", "current_missing_fraction", "scenario", "method", "seeds", "n_runs", "n_decisions", "n_alerts", "mean_value", "median_value", "rate_kind", "observed_rate")
    return _rounded(_rounded(found, "mean_value"), "observed_rate", digits=9)


@register("display_histogram", """
WITH v AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'reference' ELSE 'current' END AS side, p_retailprice AS v FROM part),
r AS (SELECT min(v) AS lo, max(v) AS hi FROM v), e AS (SELECT list(lo + (hi - lo) * k / 12 ORDER BY k) AS inner_edges FROM r, range(1, 12) t(k)),
n AS (SELECT side, (SELECT count(*) FROM (SELECT unnest(inner_edges) AS x) WHERE x <= v)::INTEGER AS bin, count(*) AS n FROM v, e GROUP BY 1, 2)
SELECT s.side, b.bin::INTEGER AS bin, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY s.side), 9) AS fraction
FROM (VALUES ('reference'), ('current')) s(side) CROSS JOIN range(0, 12) b(bin) LEFT JOIN n ON n.side = s.side AND n.bin = b.bin""")
def display_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    long = numeric_long(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1"), ["p_retailprice"])
    return _rounded(equal_width(long, "p_retailprice", 12).select("side", "bin", "n", "fraction"), "fraction", digits=9)


@register("category_proportions", _CATEGORY_CELLS + "SELECT feature, cell, round(p, 9) AS p_reference, round(q, 9) AS p_current, row_number() OVER (PARTITION BY feature ORDER BY r + c DESC, cell)::INTEGER AS place FROM cells")
def category_proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(category_shares(_category_cells(spark, sf_dir)).select("feature", "cell", "p_reference", "p_current", "place"), "p_reference", "p_current", digits=9)


@register("stratified_folds", """
WITH n AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS label, count(*) AS n FROM orders GROUP BY 1)
SELECT label::INTEGER AS label, fold::INTEGER AS fold, (n // 3 + CASE WHEN fold < n % 3 THEN 1 ELSE 0 END)::BIGINT AS rows FROM n, range(0, 3) t(fold)""")
def stratified_folds_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    rows = labelled(o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 3 = 0"), {"o_totalprice": "numeric", "o_orderpriority": "categorical"})
    return stratified_folds(rows, 3, 42).groupBy("label", "fold").agg(F.count("*").alias("rows"))


#: The last two columns are what folds promise: no group in two of them, and no label's rows further from an even share than the largest group's.
@register("group_folds", "SELECT count(DISTINCT o_custkey) AS n_groups, count(*) AS rows, 0::BIGINT AS groups_in_two_folds, true AS labels_even FROM orders")
def group_folds_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    dealt = group_folds(labelled(o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 3 = 0"), {"o_totalprice": "numeric"}, "o_custkey"), 3, 42)
    per = dealt.groupBy("group_id").agg(F.count("*").alias("n"), F.count_distinct("fold").alias("folds"), F.sum("label").alias("n1"), F.sum(1 - F.col("label")).alias("n0"))
    labels_of = dealt.groupBy("fold", "label").agg(F.count("*").alias("n")).groupBy("label").agg(F.max("n").alias("most"), F.min("n").alias("least"), F.sum("n").alias("all"), F.count("*").alias("folds"))
    largest = per.agg(F.max("n0").alias("m0"), F.max("n1").alias("m1"))
    off = F.greatest(F.col("most") - F.col("all") / 3, F.col("all") / 3 - F.col("least"))
    even = labels_of.crossJoin(F.broadcast(largest)).agg(F.bool_and((F.col("folds") == 3) & (off <= F.when(F.col("label") == 1, F.col("m1")).otherwise(F.col("m0")))).alias("labels_even"))  # one row beside two
    return per.agg(F.count("*").alias("n_groups"), F.sum("n").alias("rows"), F.count(F.when(F.col("folds") > 1, 1)).alias("groups_in_two_folds")).crossJoin(even)


@register("adversarial_auc")
def adversarial_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learnt, so SQL has no equivalent; tests hold it against shifted and unshifted tables."""
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    settings = {"enabled": True, "n_splits": 3, "roc_auc_threshold": 0.7, "exclude_columns": [], "group_column": None}
    shifted = c.where("c_custkey % 2 = 1").withColumn("c_acctbal", F.col("c_acctbal") + 3000)
    found = validate(c.where("c_custkey % 2 = 0"), shifted, settings, {"c_acctbal": "numeric", "c_mktsegment": "categorical"}, trees=10)
    rows = [(found["status"], found["roc_auc"], found["alert"], n, x) for n, x in found["feature_importance"].items()]
    return spark.createDataFrame(rows, "status string, roc_auc double, alert boolean, feature string, importance double")


_ORDER_SIDES = """
WITH sides AS (SELECT o_orderkey % 2 = 0 AS is_reference, CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice * 1.1::DOUBLE ELSE o_totalprice END AS o_totalprice, o_orderstatus, o_orderpriority FROM orders)"""
_ORDER_LONG = _ORDER_SIDES + """, long AS (SELECT 'o_totalprice' AS feature, is_reference, o_totalprice AS v FROM sides)
"""
_ORDER_CATEGORIES = _ORDER_SIDES + """, long AS (
  SELECT 'o_orderstatus' AS feature, is_reference, o_orderstatus AS v FROM sides UNION ALL SELECT 'o_orderpriority', is_reference, o_orderpriority FROM sides),
counted AS (SELECT feature, 'string:' || v AS cell, count(*) FILTER (is_reference) AS r, count(*) FILTER (NOT is_reference) AS c FROM long WHERE v IS NOT NULL GROUP BY ALL),
cells AS (SELECT *, r / sum(r) OVER (PARTITION BY feature) AS p, c / sum(c) OVER (PARTITION BY feature) AS q FROM counted)"""
_ORDER_CDF, _ORDER_CELLS = (x.replace(_LONG, _ORDER_LONG) for x in (_CDF, _CELLS))
_STABILITY = "SELECT 'drift' AS source, feature, '{0}' AS method, {0} AS value, NULL::DOUBLE AS p FROM ({1})"
_ANALYZED = " UNION ALL ".join([
    f"SELECT 'quality' AS source, NULL AS feature, side || '_duplicate_fraction' AS method, value, NULL::DOUBLE AS p FROM ({_ORDER_SIDES} SELECT CASE WHEN is_reference THEN 'reference' ELSE 'current' END AS side, (count(*) - count(DISTINCT (o_totalprice, o_orderstatus, o_orderpriority))) / count(*) AS value FROM sides GROUP BY 1)",
    "SELECT 'quality', f, m, 0.0, NULL FROM (VALUES ('o_totalprice'), ('o_orderstatus'), ('o_orderpriority')) t(f), (VALUES ('reference_missing_fraction'), ('current_missing_fraction'), ('missing_increase_pp')) u(m)",
    "SELECT 'quality', 'o_totalprice', m, 0.0, NULL FROM (VALUES ('reference_infinite_count'), ('current_infinite_count')) u(m)",
    "SELECT 'adversarial', NULL, 'roc_auc', NULL, NULL",
    f"SELECT 'drift', feature, 'ks', ks, least(1.0, 2 * (SELECT sum((CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * n * ks * ks)) FROM range(1, 101) t(k))) FROM ({_ORDER_CDF} SELECT feature, max(abs(gap)) AS ks, any_value(n_reference * n_current / (n_reference + n_current)) AS n FROM cdf JOIN sizes USING (feature) GROUP BY feature)",
    f"SELECT 'drift', feature, 'wasserstein', w, NULL FROM ({_ORDER_CDF} SELECT feature, sum(abs(gap) * coalesce(width, 0)) AS w FROM cdf GROUP BY feature)",
    *[_STABILITY.format(m, x) for m, x in (("psi", _ORDER_CELLS + _PSI_SELECT), ("js", _ORDER_CELLS + _JS_SELECT), ("psi", _ORDER_CATEGORIES + _PSI_SELECT), ("js", _ORDER_CATEGORIES + _JS_SELECT))],
    f"SELECT 'drift', feature, 'chi2', CASE WHEN applies THEN x END, CASE WHEN applies THEN CASE n_cells WHEN 2 THEN 1.0 WHEN 3 THEN exp(-x / 2) ELSE exp(-x / 2) * (1 + x / 2) END END FROM ({_POOLED.replace(_CATEGORY_CELLS.rstrip(), _ORDER_CATEGORIES)} SELECT * FROM gated)",
])


@register("analyze_checks", f"""
WITH checks AS ({_ANALYZED}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY p IS NOT NULL ORDER BY p, feature, method) AS rank, count(p) OVER () AS m FROM checks),
adjusted AS (SELECT *, CASE WHEN p IS NOT NULL THEN min(least(1.0, p * m / rank)) OVER (PARTITION BY p IS NOT NULL ORDER BY rank DESC) END AS q FROM ranked),
decided AS (SELECT *, CASE WHEN method IN ('ks', 'chi2') THEN q < 0.05 WHEN method LIKE '%duplicate_fraction' THEN value > 0.01 WHEN source = 'quality' THEN value > 0 END AS alert FROM adjusted)
SELECT source, feature, method, round(value, 6) AS value, alert, CASE WHEN alert THEN 'warning' WHEN value IS NULL THEN 'skipped' ELSE 'ok' END AS status FROM decided""")
def analyze_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of analyze on orders, as a row per check; p-values, exact for small tables, decide but are not shown."""
    from ..calibrate import Case, result_rows
    from .analysis import analyze

    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    shifted = o.where("o_orderkey % 2 = 1").withColumn("o_totalprice", F.col("o_totalprice") * 1.1)
    result = analyze(o.where("o_orderkey % 2 = 0").drop("o_orderkey"), shifted.drop("o_orderkey"))
    rows = result_rows(Case("orders", "numeric", "numeric", "standard", 0, 0.0, 0.0), 0, result)
    names = ("source", "feature", "method", "status", "value", "alert")
    return _rounded(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], "source string, feature string, method string, status string, value double, alert boolean"), "value")


@register("semantic_kinds", "SELECT column_name AS name, CASE WHEN column_type IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT', 'FLOAT', 'DOUBLE') THEN 'numeric' WHEN column_type IN ('VARCHAR', 'BOOLEAN') THEN 'categorical' ELSE 'neither' END AS kind FROM (DESCRIBE SELECT * FROM lineitem)")
def semantic_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(f.name, kind_of(f.dataType) or "neither") for f in _table(spark, sf_dir, "lineitem").schema]
    return spark.createDataFrame(rows, "name string, kind string")
