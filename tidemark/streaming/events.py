"""Operators on events: payload hashes, duplicates and conflicts, counted windows, feedback, performance."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import number_rows
from ..operators.twosample import roc_auc
from . import records

#: Keys of a label, and of an event.
LABEL_KEYS = {"event_id", "y_true"}
EVENT_REQUIRED, EVENT_OPTIONAL = {"event_id", "occurred_at", "features"}, {"prediction", "score"}


def parsed_json(text: Column) -> Column:
    """The one JSON value that a text holds, as VARIANT; null if it holds none, or more, or an object with a key twice."""
    alone = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).cast("array<variant>")  # what stands after a value would else be passed over
    return F.when(F.size(alone) == 1, alone[0])


def type_of(value: Column) -> Column:
    """number, text, boolean, object, array or null: what a VARIANT value is."""
    name = F.schema_of_variant(value)
    return (
        F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "text").when(name == "BOOLEAN", "boolean").when(name == "VOID", "null")
        .when(name.isNotNull(), "number")
    )


def canonical_variant(value: Column) -> Column:
    """JSON text of a VARIANT: keys sorted at every depth, types as they were, no white space."""
    return F.to_json(value)


def shape_of(value: Column) -> Column:
    """The types of a VARIANT's parts, by which 1 and 1.0 differ; how a fraction was written does not."""
    return F.regexp_replace(F.schema_of_variant(value), r"DECIMAL\(\d+,0*[1-9]\d*\)|DECIMAL\([1-9],0\)|DECIMAL\(1[0-8],0\)|DOUBLE", "FRACTION")


def number_text(value: Column) -> Column:
    """Canonical JSON text of a VARIANT scalar in which a fraction of zero stays one: 1.0, not 1."""
    text = F.to_json(value)
    return F.when(shape_of(value).eqNullSafe("FRACTION") & text.rlike(r"^-?\d+$"), F.concat(text, F.lit(".0"))).otherwise(text)


def utc_time(text: Column) -> Column:
    """An ISO 8601 time with an offset, in UTC with Z; null if it is none."""
    good = text.rlike(r"^\s*\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})\s*$")
    moment = F.when(good, F.to_utc_timestamp(F.try_to_timestamp(F.trim(text)), F.current_timezone()))
    fraction = F.date_format(moment, "SSSSSS")
    return F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction != "000000", F.concat(F.lit("."), fraction)).otherwise(""), F.lit("Z"))


def envelopes(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines of JSON as event_id, occurred_at, features, prediction_json, score, and `problem`, null where keys and types are right.

    Keys are exactly event_id, occurred_at, features, and, if wanted, prediction and score.
    """
    v = parsed_json(F.col(value)).alias("v")
    whole = lines.select(F.col(value).alias("_line"), v).withColumn("m", F.when(type_of(F.col("v")) == "object", F.col("v").cast("map<string,variant>")))
    part = lambda k: F.col("m")[k]
    of = lambda k, t: F.when(type_of(part(k)) == t, part(k).cast("string"))
    missing = F.array_except(F.array(*map(F.lit, sorted(EVENT_REQUIRED))), F.map_keys("m"))
    unknown = F.array_except(F.map_keys("m"), F.array(*map(F.lit, sorted(EVENT_REQUIRED | EVENT_OPTIONAL))))
    scored = part("score").isNull() | type_of(part("score")).isin("number", "null")
    problem = (
        F.when(F.col("v").isNull(), "not JSON").when(F.col("m").isNull(), "not an object").when(F.size(missing) > 0, F.concat(F.lit("missing keys: "), F.array_join(missing, ", ")))
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown keys: "), F.array_join(F.array_sort(unknown), ", "))).when(~scored, "score must be a finite number")
    )
    predicted = F.when(type_of(part("prediction")) != "null", number_text(part("prediction")))
    return whole.select(
        of("event_id", "text").alias("event_id"), of("occurred_at", "text").alias("occurred_at"), F.to_json(part("features")).alias("features"), shape_of(part("features")).alias("shape"), predicted.alias("prediction_json"),
        F.when(type_of(part("score")) == "number", F.try_variant_get(part("score"), "$", "double")).alias("score"), problem.alias("problem"), F.col("_line").alias("line"),
    )


def labels(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines of JSON, {"event_id": text, "y_true": scalar}, as event_id, y_json, and `reason`, null where a line is a label; `line` as it was."""
    whole = lines.select(F.col(value).alias("_line"), parsed_json(F.col(value)).alias("v")).withColumn("m", F.when(type_of(F.col("v")) == "object", F.col("v").cast("map<string,variant>")))
    part = lambda k: F.col("m")[k]
    wanted = F.array(*map(F.lit, sorted(LABEL_KEYS)))
    reason = F.when(F.col("v").isNull(), "not JSON").when(F.col("m").isNull(), "not an object").when((F.size("m") != len(LABEL_KEYS)) | (F.size(F.array_intersect(F.map_keys("m"), wanted)) != len(LABEL_KEYS)), "keys must be event_id and y_true")
    name = F.when(type_of(part("event_id")) == "text", part("event_id").cast("string"))
    return validated_labels(whole.select(name.alias("event_id"), number_text(part("y_true")).alias("y_json"), reason.alias("problem"), F.col("_line").alias("line")))


def validated_labels(rows: DataFrame) -> DataFrame:
    """Adds `reason`, why a row (event_id, y_json) is no label, null where it is one, and trims ids."""
    known = F.col("problem") if "problem" in rows.columns else F.lit(None).cast("string")
    reason = F.when(known.isNotNull(), known).when(F.col("event_id").isNull() | (F.trim("event_id") == ""), "event_id must be text that is not blank").when(parsed_json(F.col("y_json")).isNull(), "y_true is no JSON")
    return rows.withColumn("reason", reason).withColumn("event_id", F.when(F.col("reason").isNull(), F.trim("event_id")).otherwise(F.col("event_id")))


def settled(labels_: DataFrame, events: DataFrame, known: DataFrame) -> DataFrame:
    """Labels (event_id, y_json, position) with `outcome`: parked where the event has not come, else accepted, duplicate or conflict as `classify` says of known labels."""
    met = records.with_known(labels_, events, "event_id")
    waiting = met.where("not known").drop("known").withColumn("outcome", F.lit("parked"))
    return classify(met.where("known").drop("known"), known, digest="y_json").unionByName(waiting)


def validated(rows: DataFrame) -> DataFrame:
    """Adds `reason`, why a row is no event, null where it is one; occurred_at in UTC, features as canonical JSON, and their `shape`.

    rows: event_id, occurred_at, features, prediction_json, score, and `problem` and `shape` where they are known already. Event ids are trimmed.
    Cut the result before filtering on `reason`: Spark else moves the filter below, where payloads are parsed for every place that names them.
    """
    known = F.col("problem") if "problem" in rows.columns else F.lit(None).cast("string")
    v, p = F.col("_features"), F.col("_prediction")
    parsed = rows.withColumns({"_features": parsed_json(F.col("features")), "_prediction": parsed_json(F.col("prediction_json")), "_at": utc_time(F.col("occurred_at"))})
    score = F.col("score")
    reason = (
        F.when(known.isNotNull(), known)
        .when(F.col("event_id").isNull() | (F.trim("event_id") == ""), "event_id must be text that is not blank")
        .when(F.col("_at").isNull(), "occurred_at must be an ISO 8601 time with an offset")
        .when(v.isNull(), "features is no JSON").when(type_of(v) != "object", "features must be an object").when(F.to_json(v) == "{}", "features must not be empty")
        .when(F.col("prediction_json").isNotNull() & (p.isNull() | type_of(p).isin("object", "array")), "prediction must be a JSON scalar")
        .when(score.isNotNull() & ~(F.abs(score) < float("inf")) | F.isnan(score), "score must be a finite number")
    )
    good = parsed.withColumns({"reason": reason, "shape": F.coalesce("shape", shape_of(v)) if "shape" in rows.columns else shape_of(v)})
    return good.withColumns({"event_id": F.when(F.col("reason").isNull(), F.trim("event_id")).otherwise(F.col("event_id")), "occurred_at": F.coalesce("_at", "occurred_at"), "features": F.coalesce(canonical_variant(v), "features")}).drop("_features", "_prediction", "_at")


def payload_hash(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def classify(incoming: DataFrame, known: DataFrame, key: str = "event_id", digest: str = "payload_sha256", order: str | list[str] = "position") -> DataFrame:
    """Adds `outcome`: accepted, duplicate (same id, same payload) or conflict (same id, another payload).

    What is known already decides; among new rows of one id, the first in `order` does. A null id is one id.
    """
    seen = known.select(F.col(key).alias("_key"), F.col(digest).alias("_known")).dropDuplicates(["_key"])
    place = F.col(order) if isinstance(order, str) else F.struct(*order)
    first = incoming.groupBy(F.col(key).alias("_first_key")).agg(F.min_by(F.col(digest), place).alias("_first"), F.min(place).alias("_place"))
    joined = incoming.join(seen, F.col(key).eqNullSafe(F.col("_key")), "left").join(first, F.col(key).eqNullSafe(F.col("_first_key")))
    right = F.coalesce("_known", "_first")
    new = F.col("_known").isNull() & (place == F.col("_place"))
    outcome = F.when(new, "accepted").when(F.col(digest) == right, "duplicate").otherwise("conflict")
    return joined.withColumn("outcome", outcome).drop("_key", "_known", "_first_key", "_first", "_place")


def tumbling_windows(events: DataFrame, size: int, order: list[str], group: str | None = None) -> DataFrame:
    """Adds window_no (from 0): each `size` consecutive events of a group, full windows only.

    Windows count events in the order given; time plays no part. Events are numbered over ranges of the
    order, of group and order where there is a group, so no task numbers a whole group.
    """
    order = [group, *order] if group else order
    numbered = number_rows(events, *order, name="_n")
    if group is None:
        counted = numbered.crossJoin(F.broadcast(events.agg(F.count("*").alias("_total"), F.lit(1).alias("_first"))))  # one row
    else:
        sizes = numbered.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("_total"), F.min("_n").alias("_first"))
        counted = numbered.join(sizes, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")
    place = F.col("_n") - F.col("_first")
    full = place < F.floor(F.col("_total") / size) * size
    return counted.where(full).withColumn("window_no", F.floor(place / size)).drop("_n", "_total", "_first")


def feedback_join(events: DataFrame, feedback: DataFrame) -> DataFrame:
    """Events that have a label by now; there is no bound on how late it may come."""
    return events.join(feedback, "event_id")


def binary_label(y_json: Column) -> Column:
    """0 or 1 from the JSON texts false, true, 0, 1, 0.0, 1.0; null for anything else."""
    return F.when(y_json.isin("true", "1", "1.0"), 1).when(y_json.isin("false", "0", "0.0"), 0)


def performance(samples: DataFrame, config: Mapping[str, Any], window: str = "window_id") -> DataFrame:
    """Per window: feedback_rows, accuracy and roc_auc with their sample rows, drops and alerts, status, reason.

    samples: window, prediction_json, y_json, score. Accuracy compares JSON texts, so 1, 1.0 and true
    are three labels. A metric is null where it has too few rows, or one class only. A drop is an alert
    when it is plainly above its limit.
    """
    least = config["min_feedback_rows"]
    label = binary_label(F.col("y_json"))
    predicted = F.col("prediction_json").isNotNull()
    scored = F.col("score").isNotNull() & label.isNotNull()
    sums = samples.groupBy(window).agg(
        F.count("*").alias("feedback_rows"),
        F.count(F.when(predicted, 1)).alias("accuracy_rows"),
        F.avg(F.when(predicted, (F.col("prediction_json") == F.col("y_json")).cast("double"))).alias("accuracy"),
        F.count(F.when(scored, 1)).alias("roc_auc_rows"),
    )
    auc = roc_auc(samples.where(scored).select(F.col(window), label.alias("label"), "score"), group=window).select(window, "roc_auc")
    joined = sums.join(auc, window, "left")
    enough = F.lit(config["enabled"]) & (F.col("feedback_rows") >= least)
    for metric in ("accuracy", "roc_auc"):
        value = F.when(enough & (F.col(f"{metric}_rows") >= least), F.col(metric))
        drop = F.lit(config[f"baseline_{metric}"]).cast("double") - F.col(metric)
        joined = joined.withColumn(metric, value).withColumn(f"{metric}_drop", drop).withColumn(f"{metric}_alert", F.col(f"{metric}_drop") > F.lit(config[f"max_{metric}_drop"]).cast("double"))
    none = F.col("accuracy").isNull() & F.col("roc_auc").isNull()
    reason = F.when(~F.lit(config["enabled"]), "performance_disabled").when(F.col("feedback_rows") < least, "insufficient_feedback").when(none, "metrics_unavailable")
    return joined.withColumn("status", F.when(none, "not_evaluated").otherwise("evaluated")).withColumn("reason", reason)
