"""Adversarial validation: can a classifier tell the reference's rows from the current ones?

Rows get a fold; per fold, a gradient-boosted classifier learns on the others and scores it. The
scores of all rows together give the ROC-AUC. Imputation and encoding are fitted on each fold's
training rows only.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import as_double, category_key, column, is_finite, kind_of
from ..functions.decide import exceeds
from .numbering import number_rows
from .twosample import medians, roc_auc

TREES, RATE, DEPTH, LEAF_ROWS = 80, 0.05, 4, 10
MISSING, OTHER = "<MISSING>", "<OTHER>"
#: Categories of a feature that the learner tells apart: the commonest of the training rows; all others are OTHER.
MOST_CATEGORIES = 256


def labelled(reference: DataFrame, current: DataFrame, features: Mapping[str, str], group: str | None = None) -> DataFrame:
    """Both sides' features as x0, x1, ... (numbers without infinities, or typed categories), label, group_id."""

    def side(frame: DataFrame, label: int) -> DataFrame:
        columns = []
        for k, (name, kind) in enumerate(features.items()):
            v = as_double(name)
            columns.append((F.when(is_finite(v), v) if kind == "numeric" else category_key(name)).alias(f"x{k}"))
        own = [category_key(group).alias("group_id")] if group else []
        return frame.select(*columns, *own, F.lit(label).alias("label"))

    return side(reference, 0).unionByName(side(current, 1))


def stratified_folds(rows: DataFrame, n_splits: int, seed: int, label: str = "label") -> DataFrame:
    """Adds `fold`: of each label the same number of rows in every fold, but for one.

    Rows are dealt in the order of a seeded hash of their content, so folds depend on neither partitions
    nor order; equal rows are interchangeable, and told apart by a number of no meaning, so that rows of which
    there are very many are not numbered by one task.
    """
    content = F.xxhash64(F.lit(seed), *[column(c) for c in rows.columns])
    numbered = number_rows(rows.withColumns({"_h": content, "_tie": F.monotonically_increasing_id()}), label, "_h", "_tie", name="_n")
    first = numbered.groupBy(F.col(label).alias("_label")).agg(F.min("_n").alias("_first"))  # a row per label
    dealt = numbered.join(F.broadcast(first), F.col(label).eqNullSafe(F.col("_label")))
    return dealt.withColumn("fold", ((F.col("_n") - F.col("_first")) % n_splits).cast("int")).drop("_h", "_tie", "_n", "_label", "_first")


#: Group sizes up to this are told apart one by one; of larger ones the leading four bits.
EXACT_SIZES = 64


def _size_class(n: str) -> Column:
    """A number for a group's rows of one label: equal for equal sizes, or for large ones that are within an eighth; at most a few hundred values."""
    bits = F.floor(F.log2(F.greatest(F.col(n), F.lit(1)).cast("double"))).cast("int")
    return F.when(F.col(n) <= EXACT_SIZES, F.col(n)).otherwise(EXACT_SIZES + 8 * bits + F.floor(F.col(n) / F.pow(F.lit(2.0), bits - 3)) - 8).cast("int")


def dealt_cells(cells: list[tuple[int, int, int, int]], n_splits: int) -> list[list[int]]:
    """For cells (groups, rows of label 0, rows of label 1, any), the folds that a cell's groups beyond whole rounds go to, in their order.

    Whole rounds give every fold the same. The rest is dealt greedily, the largest groups first: each group goes to the fold where the
    sum of squares of the labels' shares grows least, so to one that lacks the labels that the group has.
    """
    totals = [max(1, sum(c[k] for c in cells)) for k in (1, 2)]
    have = [[0.0, 0.0] for _ in range(n_splits)]
    rest: list[list[int]] = [[] for _ in cells]
    share = lambda c: max(c[1] / totals[0], c[2] / totals[1]) / c[0]
    for at in sorted(range(len(cells)), key=lambda k: (-share(cells[k]), k)):
        groups, *rows = cells[at][:3]
        mean = [r / groups / t for r, t in zip(rows, totals, strict=True)]
        for f in have:
            for k in (0, 1):
                f[k] += groups // n_splits * mean[k]
        for _ in range(groups % n_splits):
            fold = min((f for f in range(n_splits) if f not in rest[at]), key=lambda f: (have[f][0] * mean[0] + have[f][1] * mean[1], sum(have[f]), f))
            rest[at].append(fold)
            for k in (0, 1):
                have[fold][k] += mean[k]
    return rest


def group_folds(rows: DataFrame, n_splits: int, seed: int, label: str = "label", group: str = "group_id") -> DataFrame:
    """Adds `fold`, the same for all rows of a group; labels' shares are near even in all folds.

    Groups are counted by (rows of label 0, rows of label 1), a histogram of some ten thousand cells at most
    however many groups there are; what comes to the driver is this. In a cell groups are dealt in the order of a
    seeded hash: round by round, and the rest as `dealt_cells` says, so that a fold's rows of a label differ from an
    even share by no more than about the largest group's.
    """
    count = lambda y: F.sum(F.when(F.col(label) == y, 1).otherwise(0))
    sizes = rows.groupBy(group).agg(count(0).alias("_n0"), count(1).alias("_n1"))
    celled = sizes.select(F.col(group).alias("_g"), "_n0", "_n1", _size_class("_n0").alias("_c0"), _size_class("_n1").alias("_c1"), F.xxhash64(F.lit(seed), column(group)).alias("_h"))
    numbered = number_rows(celled, "_c0", "_c1", "_h", "_g", name="_n")
    found = numbered.groupBy("_c0", "_c1").agg(F.count("*").alias("groups"), F.sum("_n0").alias("n0"), F.sum("_n1").alias("n1"), F.min("_n").alias("first")).orderBy("_c0", "_c1").collect()
    rest = dealt_cells([(r["groups"], r["n0"], r["n1"], 0) for r in found], n_splits)
    rounds = [(r["_c0"], r["_c1"], r["first"], r["groups"] // n_splits * n_splits, folds) for r, folds in zip(found, rest, strict=True)]
    plan = F.broadcast(rows.sparkSession.createDataFrame(rounds, "_c0 int, _c1 int, _first long, _even long, _rest array<int>"))  # a row per cell
    place = F.col("_n") - F.col("_first")
    fold = F.when(place < F.col("_even"), (place % n_splits).cast("int")).otherwise(F.get("_rest", (place - F.col("_even")).cast("int")))
    turn = numbered.join(plan, ["_c0", "_c1"]).select("_g", fold.alias("fold"))
    return rows.join(turn, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def _stacked(rows: DataFrame, kinds: list[str], kind: str) -> DataFrame:
    """(feature, value) of all columns of one kind."""
    pairs = [F.struct(F.lit(f"x{k}").alias("feature"), F.col(f"x{k}").alias("value")) for k, own in enumerate(kinds) if own == kind]
    return rows.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")


def _prepared(train: DataFrame, rows: DataFrame, kinds: list[str]) -> tuple[DataFrame, DataFrame, list[tuple[int, str]]]:
    """Imputed columns fitted on train: medians with an indicator, or the commonest categories and one for what is missing."""
    middle = {r["feature"]: r["quantile"] for r in medians(_stacked(train, kinds, "numeric"), "feature", "value").collect()} if "numeric" in kinds else {}
    common: dict[str, list[str]] = {}
    if "categorical" in kinds:
        counts = _stacked(train, kinds, "categorical").where("value is not null").groupBy("feature", "value").count()
        place = F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("count"), "value"))  # Spark keeps the first before it shuffles
        for r in counts.withColumn("place", place).where(F.col("place") <= MOST_CATEGORIES).collect():
            common.setdefault(r["feature"], []).append(r["value"])
    out = []
    for frame in (train, rows):
        for k, kind in enumerate(kinds):
            c = f"x{k}"
            if kind == "numeric":
                frame = frame.withColumn(f"{c}_missing", F.col(c).isNull().cast("double")).withColumn(c, F.coalesce(c, F.lit(middle.get(c)), F.lit(0.0)))
            else:
                known = F.col(c).isin(common[c]) if common.get(c) else F.lit(False)
                frame = frame.withColumn(c, F.when(F.col(c).isNull(), MISSING).when(known, F.col(c)).otherwise(OTHER))
        out.append(frame)
    return out[0], out[1], [(k, kind) for k, kind in enumerate(kinds)]


def fit_and_score(train: DataFrame, rows: DataFrame, kinds: list[str], seed: int, trees: int = TREES) -> tuple[DataFrame, list[float]]:
    """rows (label, fold) with `score`, and each feature's share of the importance."""
    train, rows, parts = _prepared(train, rows, kinds)
    stages, inputs = [], []
    for k, kind in parts:
        if kind == "numeric":
            inputs += [f"x{k}", f"x{k}_missing"]
        else:
            stages += [StringIndexer(inputCol=f"x{k}", outputCol=f"x{k}_index", handleInvalid="keep"), OneHotEncoder(inputCol=f"x{k}_index", outputCol=f"x{k}_hot", dropLast=True)]
            inputs.append(f"x{k}_hot")
    stages += [VectorAssembler(inputCols=inputs, outputCol="features"), GBTClassifier(labelCol="label", maxIter=trees, stepSize=RATE, maxDepth=DEPTH, minInstancesPerNode=LEAF_ROWS, seed=seed)]
    model = Pipeline(stages=stages).fit(train)
    gain, at = model.stages[-1].featureImportances.toArray(), 0
    shares = []
    hot = {s.getOutputCol(): s.categorySizes[0] for s in model.stages if hasattr(s, "categorySizes")}
    for k, kind in parts:
        size = 2 if kind == "numeric" else hot[f"x{k}_hot"]
        shares.append(float(gain[at : at + size].sum()))
        at += size
    total = sum(shares)
    scored = model.transform(rows).select("label", "fold", vector_to_array("probability")[1].alias("score"))
    return scored, [s / total for s in shares] if total > 0 else [0.0] * len(shares)


def result(status: str, settings: Mapping[str, Any], reason: str | None = None, **found: Any) -> dict[str, Any]:
    strategy = "stratified_group_kfold" if settings["group_column"] else "stratified_kfold"
    base = {"status": status, "roc_auc": None, "threshold": settings["roc_auc_threshold"], "fold_auc": [], "feature_importance": {}, "importance_type": None, "split_strategy": strategy, "group_column": settings["group_column"], "n_groups": None, "alert": None, "reason": reason}
    return base | found


def validate(reference: DataFrame, current: DataFrame, settings: Mapping[str, Any], features: Mapping[str, str], seed: int = 42, trees: int = TREES) -> dict[str, Any]:
    """The adversarial section of a result; features map names to kinds."""
    group, k = settings["group_column"], settings["n_splits"]
    if not settings["enabled"]:
        return result("skipped", settings, "adversarial validation is switched off")
    used = {n: kind for n, kind in features.items() if n not in settings["exclude_columns"] and n != group}
    used = {n: kind for n, kind in used.items() if all(n in f.columns and kind_of(f.schema[n].dataType) == kind for f in (reference, current))}
    if not used:
        return result("skipped", settings, "no common features are left")
    if group:
        lacking = [s for s, f in (("reference", reference), ("current", current)) if group not in f.columns]
        if lacking:
            return result("skipped", settings, f"group column {group!r} is missing in: {', '.join(lacking)}")
    rows = labelled(reference, current, used, group)
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if min(sizes.get(0, 0), sizes.get(1, 0)) < k:
        return result("skipped", settings, f"each side needs at least {k} rows")
    n_groups = None
    if group:
        if rows.where("group_id is null").head(1):
            return result("skipped", settings, f"group column {group!r} holds missing values")
        per = rows.select("label", "group_id").distinct().groupBy("label").count().collect()
        n_groups = rows.select("group_id").distinct().count()
        if n_groups < k or min(r["count"] for r in per) < k:
            return result("skipped", settings, f"each side needs at least {k} groups", n_groups=n_groups)
    dealt = (group_folds if group else stratified_folds)(rows, k, seed)
    dealt = dealt.persist()
    try:
        parts = [fit_and_score(dealt.where(F.col("fold") != f), dealt.where(F.col("fold") == f), list(used.values()), seed + f, trees) for f in range(k)]
        scored = parts[0][0]
        for more, _ in parts[1:]:
            scored = scored.unionByName(more)
        both = scored.select("label", "score", F.explode(F.array(F.col("fold"), F.lit(-1))).alias("feature"))
        auc = {r["feature"]: r["roc_auc"] for r in roc_auc(both).collect()}
    finally:
        dealt.unpersist()
    mean = {n: sum(p[1][j] for p in parts) / k for j, n in enumerate(used)}
    importance = dict(sorted(mean.items(), key=lambda x: (-x[1], x[0])))
    threshold, value = settings["roc_auc_threshold"], auc[-1]
    alert = None if threshold is None else exceeds(value, threshold)
    reason = "the threshold is not configured" if alert is None else "rows of the two tables can be told apart" if alert else None
    return result(
        "warning" if alert else "ok", settings, reason, roc_auc=value, fold_auc=[auc.get(f) for f in range(k)], feature_importance=importance, importance_type="gain", n_groups=n_groups, alert=alert
    )
