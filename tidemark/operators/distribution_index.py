"""An index of a reference's distribution, by which small samples are compared with it without going through it.

The reference's distinct values are kept in pages of consecutive values, each value with the number of
reference values up to it and the integral of that number below it. Two kinds of places are looked up: a value's
(how many reference values lie below it and up to it, the nearest one below it, and the integral up to it) and a
rank's (the value that holds it, and the integral up to that). With these, Kolmogorov-Smirnov's distance takes the
sample's own points, and the one reference value next below each; Wasserstein's distance takes differences
of integrals between the sample's points, cut where the reference crosses the sample's level.

How it scales: a lookup finds its page among the pages' ends (`fences`), of which there are at most MAX_PAGES whatever
the size of the reference (pages grow beyond), so they can be sent to every task. Lookups are then shuffled to the pages. The pages
are a bucketed table and stay where they are: what is shuffled is in proportion to the samples' distinct values, the
reference is read but not moved. Building shuffles the reference's distinct values once. However many lookups
meet in a page, a Python task is handed ASK_ROWS of them at a time; an index of a few pages goes to every task, and the
lookups of a page are dealt over the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .running import running_sums

#: Distinct values of a page, at least; and pages of an index at most.
PAGE_ROWS = 1_024
MAX_PAGES = 1 << 18
#: Pages of one bucket, about, and buckets at most.
BUCKET_PAGES, MAX_BUCKETS = 64, 2_048
#: Lookups that are answered together, at most.
ASK_ROWS = 4_096
#: Pages of an index that is sent to every task, at most; the lookups of such an index are dealt over about as many shares.
FEW_PAGES = 1_024

_PAGES = "page int, n_before long, below double, v array<double>, upto array<long>, area array<double>"
_FENCES = "page int, name string, first double, last double, n_before long, total long"
#: What is looked up: a sample's value, the sample's next value, and the rank of the sample's level.
AT, NEXT, RANK = 0, 1, 2
_ANSWER = "feature string, v double, kind int, low long, upto long, below double, value double, area double, total long"


class Index(NamedTuple):
    """pages: a row per page; fences: (page, name, first, last, n_before, total) in the order of name and value."""

    pages: DataFrame
    fences: DataFrame

    @staticmethod
    def write(counts: DataFrame, path: str, page_rows: int = PAGE_ROWS, max_pages: int = MAX_PAGES) -> None:
        """Builds the index of (name, v, n), distinct by name and v, under `path`; the fences come last."""
        spark = counts.sparkSession
        summed = running_sums(counts.select("name", "v", "n", F.lit(1).cast("long").alias("place")), "name", "v", ["n", "place"])
        step = F.coalesce(F.col("n_upto") * (F.col("next_v") - F.col("v")), F.lit(0.0))
        areas = running_sums(summed.select("name", "v", "n", "n_upto", "place_upto", step.alias("step")), "name", "v", ["step"])
        sizes = areas.groupBy("name").agg(F.max("place_upto").alias("n_values"))  # a row per feature
        wide = max(page_rows, ceil((sizes.agg(F.sum("n_values")).first()[0] or 0) / max(1, max_pages - sizes.count())))
        own = F.floor((F.col("place_upto") - 1) / wide).cast("int")
        cells = F.array_sort(F.collect_list(F.struct("v", F.col("n_upto").alias("upto"), (F.col("step_upto") - F.col("step")).alias("area"))))
        paged = areas.groupBy("name", own.alias("of_name")).agg(cells.alias("x"), (F.min("n_upto") - F.min_by("n", "v")).alias("n_before"))  # `wide` values a page
        rows = paged.select("name", "of_name", "n_before", F.col("x.v").alias("v"), F.col("x.upto").alias("upto"), F.col("x.area").alias("area"))
        rows.write.mode("overwrite").parquet(f"{path}/unnumbered")
        rows = spark.read.parquet(f"{path}/unnumbered")
        ends = rows.select("name", "of_name", F.element_at("v", 1).alias("first"), F.element_at("v", -1).alias("last"), "n_before", F.element_at("upto", -1).alias("upto"))
        found = sorted(tuple(r) for r in ends.collect())  # MAX_PAGES rows at most
        last = {f[0]: f[5] for f in found}
        fences = [(k, f[0], f[2], f[3], f[4], last[f[0]]) for k, f in enumerate(found)]
        numbers = [(k, f[0], f[1], found[k - 1][3] if k and found[k - 1][0] == f[0] else None) for k, f in enumerate(found)]
        numbered = rows.join(spark.createDataFrame(numbers, "page int, name string, of_name int, below double"), ["name", "of_name"])
        buckets = min(MAX_BUCKETS, max(1, len(found) // BUCKET_PAGES))
        name = _table_name(path)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        pages = numbered.select("page", "n_before", "below", "v", "upto", "area").repartition(buckets, "page")
        pages.write.mode("overwrite").bucketBy(buckets, "page").sortBy("page").option("path", f"{path}/pages").saveAsTable(name)
        spark.createDataFrame(fences, _FENCES).coalesce(1).write.mode("overwrite").parquet(f"{path}/fences")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Index:
        """The index under `path`; the pages as the bucketed table that they were written as."""
        fences = spark.read.schema(_FENCES).parquet(f"{path}/fences")
        name, n = _table_name(path), fences.count()
        if not spark.catalog.tableExists(name):  # another session wrote it
            buckets = min(MAX_BUCKETS, max(1, n // BUCKET_PAGES))
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({_PAGES}) USING parquet CLUSTERED BY (page) SORTED BY (page) INTO {buckets} BUCKETS LOCATION '{path}/pages'")
        return Index(spark.table(name), fences)


def _table_name(path: str) -> str:
    return f"tidemark_index_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


class _Fences:
    """The fences as arrays, for the tasks that look pages up."""

    def __init__(self, rows: list):
        self.of: dict[str, tuple[int, np.ndarray, np.ndarray, float, int]] = {}
        names = [r["name"] for r in rows]
        for name in dict.fromkeys(names):
            own = [r for r in rows if r["name"] == name]
            self.of[name] = (own[0]["page"], np.asarray([r["first"] for r in own]), np.asarray([r["n_before"] for r in own], np.int64), own[-1]["last"], own[0]["total"])

    def __len__(self) -> int:
        return sum(len(first) for _, first, *_ in self.of.values())

    def places(self, name: str, kind: int, key: np.ndarray) -> np.ndarray:
        """The pages of values, or of ranks from 1 on; -1 below all values."""
        base, first, before, _, _ = self.of[name]
        at = np.searchsorted(before, key, "left") - 1 if kind == RANK else np.searchsorted(first, key, "right") - 1
        return np.where(at < 0, -1, at + base)


def lookups(index: Index, asked: DataFrame) -> DataFrame:
    """Answers to (feature, name, v, kind, key, rank): key is a value for AT and NEXT; rank counts for RANK.

    low, upto: reference values below the key, and up to it; below: the nearest of them; value: what holds the rank;
    area: the integral of counts up to the key or to the value; total: reference values of the name.
    """
    ship(asked.sparkSession)
    fences = _Fences(index.fences.orderBy("page").collect())  # MAX_PAGES rows at most

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(1).to_numpy(zero_copy_only=False)
            kinds, keys, ranks = b.column(3).to_numpy(), b.column(4).to_numpy(zero_copy_only=False), b.column(5).to_numpy(zero_copy_only=False)
            page, total = np.full(len(names), -1, np.int32), np.zeros(len(names), np.int64)
            for name in set(names.tolist()) & fences.of.keys():
                own = names == name
                total[own] = fences.of[name][4]
                for kind in (AT, RANK):
                    some = own & ((kinds == RANK) == (kind == RANK))
                    page[some] = fences.places(name, kind, (ranks if kind == RANK else keys)[some])
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in (0, 2, 3, 4, 5)], pa.array(page), pa.array(total)], ["feature", "v", "kind", "key", "rank", "page", "total"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                asked = row.column(0).flatten()
                feature, v, kind, key, rank, total = (asked.field(n) for n in ("feature", "v", "kind", "key", "rank", "total"))
                values, upto, area = (row.column(n).flatten().to_numpy(zero_copy_only=False) for n in (3, 4, 5))
                before, below = row.column(1)[0].as_py(), row.column(2)[0].as_py()
                kinds, keys, ranks = kind.to_numpy(), key.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
                by_rank = kinds == RANK
                at = np.where(by_rank, np.searchsorted(upto, ranks, "left"), np.searchsorted(values, keys, "right") - 1)
                under = np.searchsorted(values, keys, "left") - 1
                low = np.where(under >= 0, upto[np.maximum(under, 0)], before)
                near = np.where(under >= 0, values[np.maximum(under, 0)], np.nan if below is None else below)
                to = area[at] + np.where(by_rank, 0.0, upto[at] * (keys - values[at]))
                columns = [feature, v, kind, pa.array(low), pa.array(upto[at]), pa.array(near, mask=np.isnan(near)), pa.array(values[at]), pa.array(to), total]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _ANSWER.split(", ")])

    placed = asked.select("feature", "name", "v", "kind", F.coalesce("key", F.lit(0.0)).alias("key"), F.coalesce("rank", F.lit(0)).cast("long").alias("rank")).mapInArrow(find, "feature string, v double, kind int, key double, rank long, page int, total long")
    few = len(fences) <= FEW_PAGES
    share = F.pmod(F.xxhash64("feature", "v", "kind"), F.lit(max(1, FEW_PAGES // max(1, len(fences)))))
    keys = ["page", "share"] if few else ["page"]
    # numbered in their own task, so a page's lookups are cut without a count of them
    ordered = placed.where("page >= 0").withColumn("share", share).repartition(*keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    inside = ordered.withColumn("part", F.floor(place / ASK_ROWS)).groupBy(*keys, "part").agg(F.collect_list(F.struct("feature", "v", "kind", "key", "rank", "total")).alias("asked"))
    # the pages are bucketed by page, so only what is asked is shuffled
    joined = inside.join(F.broadcast(index.pages), "page") if few else inside.hint("merge").join(index.pages, "page")
    met = joined.select("asked", "n_before", "below", "v", "upto", "area").mapInArrow(answer, _ANSWER)
    none = F.lit(None).cast("double")
    zero = F.lit(0).cast("long")
    outside = placed.where("page < 0").select("feature", "v", "kind", zero.alias("low"), zero.alias("upto"), none.alias("below"), none.alias("value"), F.lit(0.0).alias("area"), "total")
    return met.unionByName(outside)


def sample_distances(index: Index, samples: DataFrame) -> DataFrame:
    """What twosample.ks_wasserstein gives, for samples (feature, name, v), each against the index's values of its name.

    A feature is a sample's own name; several may ask for one name. Null where the name has no values.
    """
    counts = samples.groupBy("feature", "name", "v").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("feature").agg(F.sum("n").alias("m"), F.max("name").alias("name"))
    totals = index.fences.groupBy("name").agg(F.first("total").alias("total"))
    sizes = sizes.join(F.broadcast(totals), "name", "left")  # a row per name
    own = running_sums(counts.select("feature", "v", "n"), "feature", "v", ["n"]).join(sizes, "feature")
    level = F.expr("(n_upto * total + m - 1) div m")
    ask = lambda kind, key, rank: F.struct(F.lit(kind).alias("kind"), key.cast("double").alias("key"), rank.cast("long").alias("rank"))
    null = F.lit(None)
    wanted = own.where("total is not null").select("feature", "name", "v", F.explode(F.array(ask(AT, F.col("v"), null), ask(NEXT, F.coalesce("next_v", "v"), null), ask(RANK, null, level))).alias("a"))
    found = lookups(index, wanted.select("feature", "name", "v", "a.*"))
    side = {kind: f"a{kind}" for kind in (AT, NEXT, RANK)}
    together = found.groupBy("feature", "v").agg(*[F.max(F.when(F.col("kind") == k, F.struct("low", "upto", "below", "value", "area"))).alias(n) for k, n in side.items()])  # three rows each
    d = own.join(together, ["feature", "v"], "left")
    share = lambda x: F.col(x) / F.col("total")
    now = F.col("n_upto") / F.col("m")
    first, last = F.col("n_upto") == F.col("n"), F.col("next_v").isNull()
    # at the value itself; at the reference's last value before the next one; and before the first one
    gap = lambda v, g: F.struct(F.abs(g).alias("size"), v.alias("v"), g.alias("gap"))
    nothing = F.lit(None).cast("struct<size:double,v:double,gap:double>")
    tail = F.when(~last & (F.col("a1.below") > F.col("v")), gap(F.col("a1.below"), share("a1.low") - now)).when(last & (F.col("a2.value") > F.col("v")), nothing)
    head = F.when(first & F.col("a0.below").isNotNull(), gap(F.col("a0.below"), share("a0.low")))
    points = F.array(gap(F.col("v"), share("a0.upto") - now), F.coalesce(tail, nothing), F.coalesce(head, nothing))
    best = F.array_sort(F.filter(points, lambda x: x["v"].isNotNull()), lambda a, b: F.when(a["size"] > b["size"], -1).when(a["size"] < b["size"], 1).when(a["v"] < b["v"], -1).when(a["v"] > b["v"], 1).otherwise(0))[0]
    # the integral of |F - level| from the value to the next one, or beyond the last one to the reference's end
    cross, a = F.col("a2.value"), F.col("v")
    b = F.when(last, F.greatest(cross, a)).otherwise(F.col("next_v"))
    area_a, area_x = F.col("a0.area"), F.col("a2.area")
    area_b = F.when(last, F.when(cross > a, area_x).otherwise(area_a)).otherwise(F.col("a1.area"))
    x = F.greatest(a, F.least(cross, b))
    at_x = F.when(cross <= a, area_a).when(cross >= b, area_b).otherwise(area_x)
    part = now * (x - a) - (at_x - area_a) / F.col("total") + (area_b - at_x) / F.col("total") - now * (b - x)
    begun = F.when(first, area_a / F.col("total")).otherwise(0.0)
    rows = d.select("feature", "m", "total", best.alias("best"), F.greatest(part, F.lit(0.0)).alias("part"), begun.alias("begun"))
    at = F.min_by(F.struct("best.v", "best.gap"), F.struct(-F.col("best.size"), F.col("best.v")))
    agg = rows.groupBy("feature").agg(F.coalesce(F.max("total"), F.lit(0)).alias("n_reference"), F.max("m").alias("n_current"), F.max("best.size").alias("ks"), at.alias("at"), F.sum(F.col("part") + F.col("begun")).alias("wasserstein"))
    known = F.col("n_reference") > 0
    return agg.select(
        "feature", "n_reference", "n_current", F.when(known, F.col("ks")).alias("ks"), F.when(known, F.col("at.v")).alias("location"),
        F.when(known, F.when(F.col("at.gap") > 0, 1).otherwise(-1)).alias("sign"), F.when(known, F.col("wasserstein")).alias("wasserstein"),
    )
