"""Mixing sources to target weights: capped water-filling, by DataFrame functions only.

A document's size is its number of words. Sources share the total of all sizes by weight; no source
may be repeated more than max_epochs times, and what a capped source leaves goes to the others by
weight, until none is above its cap. A source then takes whole repetitions of all its documents,
and for the fraction a seeded random part of them: documents in the order of a hash, up to the place
where their sizes come nearest to what is wanted.

How it scales: sizes are summed per source before any shuffle. The level of the water comes from
rounds of one-row aggregates over the sources. The cut in the order of the hash is found by
refinement: sizes per source and leading hash digits, the digits where the cut falls, then the next
digits below them, and only at the end the few documents that share all leading digits; so a source
with a third of all rows never meets in one task. Sources are ranked by range partitions, not by one
task. The table of sources is broadcast only when its counted rows are few.

Defined results: a null text has size 0; the null source ranks last, the empty one first; sources of
size 0 have target 0 (as their cap); rows that repeat id and text share a hash, and where the cut falls
among them as many are taken as come nearest (which of them is arbitrary, so if they differ in other
columns, `mix` may take one or the other); null ids are told apart by their texts; texts of any length are
counted whole; an empty table gives an empty result; `mix` keeps all other columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

#: Weights by a source's rank, repeating.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Hash digits (of 4 bits) that each refinement looks at; refinements before documents are looked at singly.
DIGITS = 3
REFINEMENTS = 2
#: A table of at most so many sources is broadcast.
FEW_SOURCES = 10_000


def size_of(text: str = "text") -> Column:
    """Runs of characters other than the six ASCII separators."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_of(doc_id: str = "doc_id", text: str = "text", seed: str = SEED) -> Column:
    """A seeded digest of id and text; nulls are left out of it."""
    own = F.md5(F.col(text).cast("binary"))
    return F.md5(F.concat_ws(":", F.lit(seed), F.col(doc_id).cast("string"), own).cast("binary"))


def _ranked(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """source, source_size, rank: from 0, by code point, null last. Ranges of sources are counted apart."""
    in_order = sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    placed = scratch.write(
        in_order.select("source", "source_size", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place")),
        "placed",
    )
    # a row per partition of the ranging shuffle
    before = placed.groupBy("part").count().select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    return placed.join(F.broadcast(before), "part").select("source", "source_size", (F.col("before") + F.col("place")).alias("rank"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target, from (source, source_size)."""
    scratch = Scratch(sources.sparkSession, "targets")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = scratch.write(_ranked(sources, scratch).withColumn("weight", weight), "ranked")
    cap = F.col("source_size") * max_epochs
    level, capped_before = None, -1
    while True:
        full = F.lit(False) if level is None else cap <= F.col("weight") * level
        r = ranked.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"),
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0)).alias("taken"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("open"),
            F.count(F.when(full, 1)).alias("capped"),
        ).first()
        if r["capped"] == capped_before or not r["open"]:
            break
        level, capped_before = (r["total"] - r["taken"]) / r["open"], r["capped"]
    target = cap.cast("double") if level is None else F.least(cap.cast("double"), F.col("weight") * F.lit(float(level)))
    return ranked.select("source", "source_size", target.alias("target"))


def _near(left: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """left joined with one row per source, also where the source is null."""
    right = sources.withColumnRenamed("source", "_source")
    return left.join(F.broadcast(right) if few else right, left["source"].eqNullSafe(F.col("_source"))).drop("_source")


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> tuple[DataFrame, bool]:
    """From (source, size, ord) of each document: source, source_size, target, whole, cut, chosen, of; and whether the sources are few.

    A document is taken `whole` times, and once more if its ord is below `cut` (null: none), or equal to it
    and the document is one of `chosen`; `of` documents have that ord.
    """
    scratch = Scratch(sized.sparkSession, "plan")
    sources = scratch.write(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    few = sources.count() <= FEW_SOURCES
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    shared = targets(sources, weights, max_epochs).withColumn("whole", F.floor(share).cast("long"))
    shared = scratch.write(shared.withColumn("want", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))), "shared")
    # `lead`: the digits in which the cut falls so far; `before`: sizes of the documents that come before them
    at = shared.select("source", "want", F.lit("").alias("lead"), F.lit(0).cast("long").alias("before")).where("want > 0")
    by_source = Window.partitionBy("source")
    for k in range(REFINEMENTS):
        inside = _near(sized, at, few).where(F.substring("ord", 1, k * DIGITS) == F.col("lead")) if k else _near(sized, at, few)
        sums = inside.groupBy("source", F.substring("ord", 1, (k + 1) * DIGITS).alias("lead"), "want", "before").agg(F.sum("size").alias("size"))
        upto = F.col("before") + F.sum("size").over(by_source.orderBy("lead"))
        crossing = sums.withColumn("upto", upto).where(F.col("upto") >= F.col("want"))
        first = crossing.groupBy("source", "want").agg(F.min_by(F.struct("lead", (F.col("upto") - F.col("size")).alias("before")), "lead").alias("x"))
        at = scratch.write(first.select("source", "want", "x.lead", "x.before"), f"at{k}")
    last = _near(sized, at, few).where(F.substring("ord", 1, REFINEMENTS * DIGITS) == F.col("lead"))
    sums = last.groupBy("source", "ord", "want", "before").agg(F.sum("size").alias("size"), F.count("*").alias("of"))
    ends = sums.withColumn("start", F.col("before") + F.sum("size").over(by_source.orderBy("ord")) - F.col("size"))
    # of the rows with one ord, all of one size, as many as come nearest
    each = F.col("size") / F.col("of")
    near = F.least(F.greatest(F.ceil((F.col("want") - F.col("start")) / each - 0.5), F.lit(0)), F.col("of"))
    chosen = F.when(F.col("size") > 0, near).otherwise(F.lit(0)).cast("long")
    counted = ends.withColumn("chosen", chosen).withColumn("upto", F.col("start") + (F.col("chosen") * F.col("size") / F.col("of")).cast("long"))
    places = counted.select("source", "want", "ord", "upto", "chosen", "of")
    cut = F.min_by(F.struct("ord", "chosen", "of"), F.struct(F.abs(F.col("upto") - F.col("want")), "ord"))
    cuts = scratch.write(places.groupBy("source").agg(cut.alias("x")).select("source", F.col("x.ord").alias("cut"), "x.chosen", "x.of"), "cuts")
    right = cuts.withColumnRenamed("source", "_source")
    joined = shared.join(right, shared["source"].eqNullSafe(F.col("_source")), "left")
    return joined.select("source", "source_size", "target", "whole", "cut", "chosen", "of"), few


def repeated(rows: DataFrame, decided: DataFrame, few: bool, keep: list[str], scratch: Scratch) -> DataFrame:
    """`keep` columns and `times` of every row of `rows` (which holds source and ord).

    Where a cut falls among rows of one ord, these rows are numbered, in partitions as they come, and the
    first of them taken; their numbers are written, so that all who read them see the same.
    """
    joined = _near(rows, decided, few)
    below = F.col("whole") + F.when((F.col("ord") < F.col("cut")) | ((F.col("ord") == F.col("cut")) & (F.col("chosen") >= F.col("of"))), 1).otherwise(0)
    if decided.where("chosen > 0 and chosen < of").isEmpty():
        return joined.select(*keep, below.alias("times"))
    tied = F.coalesce((F.col("ord") == F.col("cut")) & (F.col("chosen") > 0) & (F.col("chosen") < F.col("of")), F.lit(False))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = scratch.write(joined.where(tied).select(*keep, "source", "whole", "chosen", F.spark_partition_id().alias("_part"), place.alias("_place")), "tied")
    # rows of one source lie between others in a partition, so they are counted by partition and source
    own = Window.partitionBy("source", "_part").orderBy("_place")
    counts = placed.groupBy("source", "_part").count()
    along = Window.partitionBy("source").orderBy("_part")
    before = counts.select(F.col("source").alias("_source"), F.col("_part").alias("_of"), (F.sum("count").over(along) - F.col("count")).alias("_before"))
    numbered = placed.withColumn("_n", F.row_number().over(own)).join(before, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_part") == F.col("_of")))
    times = F.col("whole") + F.when(F.col("_before") + F.col("_n") <= F.col("chosen"), 1).otherwise(0)
    return joined.where(~tied).select(*keep, below.alias("times")).unionByName(numbered.select(*keep, times.alias("times")))


def measured(docs: DataFrame, scratch: Scratch, seed: str = SEED) -> DataFrame:
    """The narrow table that all of the above reads."""
    return scratch.write(docs.select("doc_id", "source", size_of().alias("size"), order_of(seed=seed).alias("ord")), "sized")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; all columns as they were."""
    scratch = Scratch(docs.sparkSession, "mix")
    decided, few = plan(measured(docs, scratch, seed).select("source", "size", "ord"), weights, max_epochs)
    names = docs.columns
    packed = docs.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in names]).alias("row"), F.col("source"), order_of(seed=seed).alias("ord"))
    times = repeated(packed, decided.select("source", "whole", "cut", "chosen", "of"), few, ["row"], scratch)
    return times.where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "mix")
    sized = measured(docs, scratch)
    decided, few = plan(sized.select("source", "size", "ord"))
    found = repeated(sized, decided, few, ["doc_id", "size", "source_size", "target"], scratch)
    return found.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


OP7_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat_ws(':', 'mix-1', doc_id::VARCHAR, md5(text))) AS ord
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sources),
by_ratio AS (
  SELECT *, row_number() OVER w AS place, sum(source_size) OVER () AS total,
    coalesce(sum(3 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
    sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM ranked
  WINDOW w AS (ORDER BY 3.0::DOUBLE * source_size / weight, source)),
level AS (
  SELECT min_by((total - taken)::DOUBLE / open, place) AS level
  FROM by_ratio WHERE 3 * source_size > weight * ((total - taken)::DOUBLE / open)),
shared AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, coalesce(weight * level, (3 * source_size)::DOUBLE)) AS target
  FROM ranked, level),
wanted AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM shared),
places AS (
  SELECT source, ord, sum(size) AS size, count(*) AS n FROM sized GROUP BY source, ord),
summed AS (
  SELECT source, ord, size, n, sum(size) OVER (PARTITION BY source ORDER BY ord) - size AS start FROM places),
ends AS (
  SELECT s.source, ord, n, w.target - w.whole * w.source_size AS want, start, size,
    CASE WHEN size > 0 THEN least(greatest(ceil((w.target - w.whole * w.source_size - start) / (size / n) - 0.5::DOUBLE), 0), n) ELSE 0 END::BIGINT AS chosen
  FROM summed s JOIN wanted w ON s.source IS NOT DISTINCT FROM w.source
  WHERE w.target - w.whole * w.source_size > 0),
cuts AS (
  SELECT source, min_by({'ord': ord, 'chosen': chosen}, (abs(start + chosen * (size / n) - want), ord)) AS cut FROM ends GROUP BY source),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY source, ord) AS place FROM sized)
SELECT s.doc_id, s.size, w.source_size, w.target,
       ((w.whole + CASE WHEN s.ord < c.cut.ord OR (s.ord = c.cut.ord AND s.place <= c.cut.chosen) THEN 1 ELSE 0 END) * s.size)::BIGINT AS taken
FROM numbered s
JOIN wanted w ON s.source IS NOT DISTINCT FROM w.source
LEFT JOIN cuts c ON s.source IS NOT DISTINCT FROM c.source
"""
