"""Tables, configurations and documents: how they come in and go out."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Mapping
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import validate_config
from ..functions.canonical import canonical, column

#: Texts in a CSV file that mean a missing value (fixed values of the common CSV convention).
MISSING_TEXTS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
FORMATS = (".csv", ".parquet")


def table_format(path: object) -> str:
    """The extension, after checking the argument: a csv file, or a Parquet file or folder."""
    if not isinstance(path, str | os.PathLike):
        raise TypeError(f"a path is needed, not {type(path).__name__}")
    name = os.fspath(path)
    extension = os.path.splitext(name.rstrip("/"))[1].lower()
    if "://" not in name:
        if not os.path.exists(name):
            raise FileNotFoundError(name)
        if os.path.isdir(name) and extension != ".parquet":
            raise IsADirectoryError(name)
    if extension not in FORMATS:
        raise ValueError(f"{name}: the extension must be one of {', '.join(FORMATS)}")
    return extension


def load_table(spark: SparkSession, path: str | os.PathLike[str], multi_line: bool = False) -> DataFrame:
    """A CSV or Parquet table with NaN as null; CSV columns are doubles, whole numbers, booleans or text.

    multi_line: quoted CSV values may hold line breaks; a file is then read by one task.
    """
    extension, name = table_format(path), os.fspath(path)
    if extension == ".parquet":
        return canonical(spark.read.parquet(name))
    raw = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(name)
    cleaned = raw.select(*[F.when(~column(c).isin(*MISSING_TEXTS), column(c)).alias(c) for c in raw.columns])
    whole, real = r"^\s*[+-]?\d+\s*$", r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)\s*$"
    test = lambda c, p: F.bool_and(column(c).rlike(p))
    seen = cleaned.agg(*[F.struct(test(c, whole).alias("whole"), test(c, real).alias("real"), F.bool_and(column(c).isin("True", "False", "true", "false", "TRUE", "FALSE")).alias("flag"), F.count(F.when(column(c).isNull(), 1)).alias("missing")).alias(f"c{k}") for k, c in enumerate(cleaned.columns)]).first()
    columns = []
    for k, c in enumerate(cleaned.columns):
        s, v = seen[k], column(c)
        if s["real"] is None:  # nothing but missing values
            columns.append(v.cast("double").alias(c))
        elif s["whole"] and not s["missing"]:
            columns.append(F.trim(v).cast("long").alias(c))
        elif s["real"]:
            word = F.lower(F.trim(v))
            infinite = F.when(word.rlike("^-inf"), float("-inf")).when(word.rlike(r"^\+?inf"), float("inf"))
            columns.append(F.coalesce(infinite, word.try_cast("double")).alias(c))
        elif s["flag"] and not s["missing"]:
            columns.append(F.lower(v).cast("boolean").alias(c))
        else:
            columns.append(v)
    return cleaned.select(*columns)


def records_frame(spark: SparkSession, records: list[Mapping[str, Any]], schema: T.StructType | None = None) -> DataFrame:
    """A DataFrame of records; columns that only some records have are null in the others."""
    names = list(dict.fromkeys(k for r in records for k in r))
    if schema is None:
        fields = []
        for n in names:
            values = [r[n] for r in records if r.get(n) is not None]
            kinds = {type(v) for v in values}
            kind = T.BooleanType() if kinds == {bool} else T.LongType() if kinds == {int} and len(values) == len(records) else T.DoubleType() if values and kinds <= {int, float} else T.StringType()
            fields.append(T.StructField(n, kind))
        schema = T.StructType(fields)
    cast = {T.DoubleType: float, T.FloatType: float, T.LongType: int, T.IntegerType: int, T.StringType: lambda v: v if isinstance(v, str) else json.dumps(v)}
    rows = [tuple(None if r.get(f.name) is None else cast.get(type(f.dataType), lambda v: v)(r[f.name]) for f in schema) for r in records]
    return canonical(spark.createDataFrame(rows, schema))


def _yaml(path: str | os.PathLike[str]) -> Any:
    if not isinstance(path, str | os.PathLike):
        raise TypeError(f"a path is needed, not {type(path).__name__}")
    if os.path.isdir(path):
        raise IsADirectoryError(os.fspath(path))
    if os.path.splitext(os.fspath(path))[1].lower() not in (".yaml", ".yml"):
        raise ValueError(f"{os.fspath(path)}: a YAML file is needed")
    with open(path, encoding="utf-8") as f:
        try:
            return yaml.safe_load(f)
        except yaml.YAMLError as e:
            raise ValueError(f"{os.fspath(path)} is not YAML: {e}") from e


def load_config(path: str | os.PathLike[str]) -> dict[str, Any]:
    return validate_config(_yaml(path))


def load_monitoring_config(path: str | os.PathLike[str]) -> dict[str, Any]:
    from ..streaming.settings import validate_monitoring_config

    return validate_monitoring_config(_yaml(path))


def ready_to_write(path: str | os.PathLike[str], overwrite: bool = False) -> str:
    """The path, if its folder is there and nothing would be overwritten unasked."""
    name = os.fspath(path)
    if os.path.isdir(name):
        raise IsADirectoryError(name)
    if not os.path.isdir(os.path.dirname(os.path.abspath(name))):
        raise FileNotFoundError(os.path.dirname(os.path.abspath(name)))
    if os.path.exists(name) and not overwrite:
        raise FileExistsError(name)
    return name


def write_text_atomic(path: str | os.PathLike[str], text: str, overwrite: bool = False) -> None:
    """All of the text or none of it: written beside, flushed to disk, then renamed."""
    name = ready_to_write(path, overwrite)
    fd, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(name)), prefix=".", suffix=".tmp")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, name)
    except BaseException:
        if os.path.exists(temporary):
            os.unlink(temporary)
        raise


def write_json_atomic(path: str | os.PathLike[str], value: Any, overwrite: bool = False) -> None:
    write_text_atomic(path, json.dumps(value, ensure_ascii=False, allow_nan=False, indent=2) + "\n", overwrite)
