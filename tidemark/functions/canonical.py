"""Canonical values: NaN as null, typed category keys, canonical JSON and its hash."""

from __future__ import annotations

import hashlib
import json
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATING = (T.FloatType, T.DoubleType)
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
CATEGORICAL = (T.BooleanType, T.StringType, T.CharType, T.VarcharType)


def kind_of(data_type: T.DataType) -> str | None:
    """numeric, categorical, or None for types that are neither."""
    return "numeric" if isinstance(data_type, NUMERIC) else "categorical" if isinstance(data_type, CATEGORICAL) else None


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def canonical(frame: DataFrame) -> DataFrame:
    """The frame with NaN as null in every floating column; column names must be unique."""
    return frame.select(*[F.nanvl(column(f.name), F.lit(None)).alias(f.name) if isinstance(f.dataType, FLOATING) else column(f.name) for f in frame.schema])


def as_double(name: str) -> Column:
    """The value as a double, null where it is missing; infinities stay."""
    value = column(name).cast("double")
    return F.when(~F.isnan(value), value)


def is_finite(value: Column) -> Column:
    return value.isNotNull() & (F.abs(value) < float("inf"))


def category_key(name: str) -> Column:
    """type:value, null where the value is missing."""
    value = column(name)
    return F.when(value.isNotNull(), F.concat(F.typeof(value), F.lit(":"), value.cast("string")))


def whole(*names: str) -> Column:
    """All of a row's values as one text, in which nulls keep their places: equal for equal rows only."""
    return F.to_json(F.struct(*[column(n).alias(f"c{k}") for k, n in enumerate(names)]), {"ignoreNullFields": "false"})


def content_sums(frame: DataFrame) -> tuple[int, str]:
    """A frame's number of rows, and a digest of its rows that no order changes: two sums of 120 bits of each row's SHA-256."""
    digest = F.sha2(whole(*frame.columns), 256)
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    row = frame.agg(F.count("*").alias("n"), F.concat_ws(":", part(1).cast("string"), part(16).cast("string")).alias("sums")).first()
    return row["n"], row["sums"]


def canonical_json(value: Any) -> str:
    """Sorted keys, no white space, no NaN or infinity."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def sha256_json(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def utc_timestamp(text: str) -> str:
    """An ISO 8601 time with an offset, in UTC with Z."""
    if not isinstance(text, str):
        raise ValueError("a time must be text")
    try:
        t = datetime.fromisoformat(text.strip())
    except ValueError as e:
        raise ValueError(f"not an ISO 8601 time: {text!r}") from e
    if t.tzinfo is None:
        raise ValueError(f"a time needs an offset: {text!r}")
    return t.astimezone(UTC).isoformat().replace("+00:00", "Z")
