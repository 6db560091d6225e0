"""MinHash near-dedup: a chosen-path set similarity join over word shingles.

Texts with equal shingle sets form a class, which takes part once. Classes are spread over trees: a
node chooses some coordinates of the minwise signature, by a hash of its path, and a class goes to one
child per chosen coordinate, which the coordinate's value names. Similar classes share most values,
so they meet in some leaf; others seldom do. A node that is still large branches on; one that is small
compares its classes exhaustively; trees are repeated to reach the target recall (a pair at the
similarity asked for is missed by all trees with probability below 1e-5: 2 trees at 0.85, 3 at 0.80).
A node that stays large at the last level, because its signatures agree, is compared in pairs of
blocks, so no class is left out.

Leaves compare signatures, with a margin of more than four standard deviations below the similarity,
and hand on stars, not pairs. The classes that stars connect are then confirmed on full sets: each
such group is searched from class to class, exact intersections deciding, so links cost memory in
proportion to the group, and members of a group are never expanded into pairs. A group too large for
one task is cut into blocks, each of which meets the group's first class; only classes that are not
linked with it by then go on to meet, leaf by leaf, what they met there, and the confirmed links are
connected. So in a large group a link is lost if its two classes met in no leaf (probability below 1e-5);
smaller groups find it even then. What one task holds is bounded in classes and in shingles, but for a
single longer text. Each class's text is fetched by id and text digest, so rows that share an id, or have
none, do not meet each other's classes.

Defined results: texts without words, null texts too, have an empty set, link with nothing, and are
their own component; rows that repeat are equal texts, so they share a component; a null doc_id takes
part, but never names a component unless no member has another id; an empty table gives an empty
result; `keep_documents` keeps one text of each component, that of the smallest id (null last), ties
broken by the text's digest, and all other columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, mix64, ship, table
from .components import components
from .shingles import COORDINATES, begin, identity, shingles, signature

#: A link, unless another similarity is asked for: 100 * intersection >= SIMILARITY * union.
SIMILARITY = 85
#: Share of pairs at the similarity that the leaves' margin, and all trees together, may miss.
MISSED = 1e-5
#: Coordinates that a node chooses on the first levels; every level below chooses two.
BRANCHES = (4, 2, 1)
LATER_BRANCHES = 2
#: Nodes of more classes branch on, up to so many levels.
SMALL = 2000
LEVELS = 12
#: Classes and shingles, about, that one task confirms at once; larger groups are cut.
GROUP_CLASSES = 4000
GROUP_SHINGLES = 4_000_000


def margin(similarity: int) -> int:
    """Agreeing coordinates from which classes are confirmed: fewer agree by chance in at most MISSED of pairs."""
    p, below = similarity / 100, 0.0
    for need in range(COORDINATES + 1):
        below += comb(COORDINATES, need) * p**need * (1 - p) ** (COORDINATES - need)
        if below > MISSED:
            return need
    return COORDINATES


def trees(similarity: int) -> int:
    """Trees that miss a pair at this similarity, all of them, with probability below MISSED."""
    p, missed = similarity / 100, 0.0
    for branches in (*[LATER_BRANCHES] * (LEVELS - len(BRANCHES)), *reversed(BRANCHES)):
        missed = (1 - p * (1 - missed)) ** branches
    return max(1, ceil(log(MISSED) / log(missed))) if missed > 0 else 1


_SKETCH = "doc_id long, text_id string, n_shingles long, class binary, signature binary"


def text_id(text: Column) -> Column:
    """A digest that tells texts apart; null counts as the empty text."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_id, n_shingles, class (null without words) and signature of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        for b in batches:
            n, ids, signs = [], [], []
            for text in b.column(1).cast(pa.binary()).to_pylist():
                found = shingles(text)
                n.append(len(found))
                ids.append(identity(found) if len(found) else None)
                signs.append(signature(found).tobytes() if len(found) else None)
            columns = [b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(signs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_id", "n_shingles", "class", "signature"])

    return docs.select(F.col("doc_id").cast("long"), "text", text_id(F.col("text"))).mapInArrow(run, _SKETCH)


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, COORDINATES)


def _chosen(path: np.ndarray, branch: int) -> np.ndarray:
    """The coordinate that each path's node chooses for its branch-th child."""
    start = mix64(path ^ np.uint64(0xA5A5A5A5)) % np.uint64(COORDINATES)
    stride = mix64(path ^ np.uint64(0x5A5A5A5A)) % np.uint64(COORDINATES // 2) * np.uint64(2) + np.uint64(1)
    return ((start + stride * np.uint64(branch)) % np.uint64(COORDINATES)).astype(np.int64)


def _children(path: np.ndarray, sign: np.ndarray, branches: int) -> tuple[np.ndarray, np.ndarray]:
    """Paths of all children, and the row of `sign` that each belongs to; coordinates differ within a node."""
    rows = np.arange(len(sign))
    paths = []
    for branch in range(branches):
        at = _chosen(path, branch)
        paths.append(mix64(path * np.uint64(3) + (at.astype(np.uint64) << np.uint64(20)) + sign[rows, at] + np.uint64(1)))
    return np.concatenate(paths), np.tile(rows, branches)


def _first_levels(n_trees: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sign = _signatures(b.column(1))
            for tree in range(n_trees):
                path, row = np.full(len(sign), tree + 1, np.uint64), np.arange(len(sign))
                for branches in BRANCHES:
                    path, at = _children(path, sign[row], branches)
                    row = row[at]
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), b.column(0).take(pa.array(row))], ["node", "class"])

    return run


def _next_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        path, row = _children(b.column(0).to_numpy().view(np.uint64), _signatures(b.column(2)), LATER_BRANCHES)
        yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), b.column(1).take(pa.array(row))], ["node", "class"])


def leaves(classes: DataFrame, scratch: Scratch, similarity: int = SIMILARITY) -> DataFrame:
    """(node, class): nodes of 2 to SMALL classes; each is to be compared exhaustively."""
    rows = scratch.write(classes.select("class", "signature").mapInArrow(_first_levels(trees(similarity)), "node long, class binary"), "level0")
    found = None
    level = 0
    while True:
        sizes = scratch.write(rows.groupBy("node").count().where("count > 1"), f"sizes{level}")
        small = rows.join(sizes.where(F.col("count") <= SMALL).select("node"), "node")
        large = sizes.where(F.col("count") > SMALL)
        if large.isEmpty():
            found = small if found is None else found.unionByName(small)
            return found
        if level + 1 >= LEVELS:  # in pairs of blocks, each pair of at most SMALL classes
            blocks = large.select("node", F.ceil(F.col("count") / (SMALL // 3)).cast("int").alias("blocks"))
            placed = rows.join(blocks, "node").withColumn("own", F.pmod(F.xxhash64("class", "node"), "blocks").cast("int"))
            other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            pairs = other.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "class")
            both = small.unionByName(pairs)
            return both if found is None else found.unionByName(both)
        found = small if found is None else found.unionByName(small)
        inner = rows.join(large.select("node"), "node").join(classes.select("class", "signature"), "class").select("node", "class", "signature")
        level += 1
        rows = scratch.write(inner.mapInArrow(_next_level, "node long, class binary"), f"level{level}")


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of equal first column, from sorted batches: a table and where its groups begin."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0)
        if not held or held[-1].column(0)[-1] == key[0] == key[-1]:
            held.append(b)
            continue
        last = key.to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(last != last[-1])[-1]) + 1 if last[0] != last[-1] else 0
        held.append(b.slice(0, cut))
        yield _cut(held)
        held = [b.slice(cut)]
    if held:
        yield _cut(held)


def _cut(held: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
    t = pa.Table.from_batches([b for b in held if b.num_rows]).combine_chunks()
    key = t.column(0).to_numpy()
    begins = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1)
    return t, np.append(begins, len(key))


def _stars(need: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per leaf, classes whose signatures agree in `need` coordinates, directly or by way of others: (a, b), a the first of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in _by_key(batches):
            classes, sign = t.column(1), _signatures(t.column(2))
            size = np.diff(cuts)
            two = cuts[:-1][size == 2]
            a = two[(sign[two] == sign[two + 1]).sum(axis=1) >= need]
            froms, tos = [a], [a + 1]
            for begin, end in zip(cuts[:-1][size > 2].tolist(), cuts[1:][size > 2].tolist(), strict=True):
                left = np.arange(begin, end)
                while len(left):
                    root, front = left[0], [left[0]]
                    left = left[1:]
                    while front and len(left):
                        near = (sign[left] == sign[front.pop()]).sum(axis=1) >= need
                        if near.any():
                            hit = left[near]
                            froms.append(np.full(len(hit), root))
                            tos.append(hit)
                            front += hit.tolist()
                            left = left[~near]
            f, g = np.concatenate(froms), np.concatenate(tos)
            yield pa.RecordBatch.from_arrays([classes.take(pa.array(x)).combine_chunks() for x in (f, g)], ["a", "b"])

    return run


def linked_groups(sets: list[np.ndarray], similarity: int = SIMILARITY) -> list[int]:
    """For each set the number of the first set that it reaches over links, itself included."""
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    begin = np.cumsum(size) - size
    of = list(range(len(sets)))
    mark = np.zeros(int(flat.max()) + 1, bool)
    left = np.arange(len(sets))
    held, starts = flat, begin  # the shingles of `left`
    while len(left):
        root, front = int(left[0]), [int(left[0])]
        gone = np.zeros(len(left), bool)
        gone[0] = True
        while front:
            x = front.pop()
            own = flat[begin[x] : begin[x] + size[x]]
            mark[own] = True
            shared = np.add.reduceat(mark[held].astype(np.int64), starts)
            mark[own] = False
            hit = ~gone & (100 * shared >= similarity * (size[x] + size[left] - shared))
            for k in left[hit].tolist():
                of[k] = root
                front.append(k)
            gone |= hit
        left = left[~gone]
        if len(left):
            held = np.concatenate([flat[begin[k] : begin[k] + size[k]] for k in left.tolist()])
            starts = np.cumsum(size[left]) - size[left]
    return of


def _confirmed(similarity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From texts by unit, in the order of units and classes, each class's confirmed links as stars (a, b)."""

    def stars(sets: dict[bytes, np.ndarray]) -> pa.RecordBatch:
        names = list(sets)
        of = linked_groups([sets[x] for x in names], similarity) if len(names) > 1 else []
        linked = [k for k, root in enumerate(of) if k != root]
        pairs = [names[of[k]] for k in linked], [names[k] for k in linked]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in pairs], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[bytes, np.ndarray] = {}
        key = None
        begin()
        for b in batches:
            texts = b.column(2).cast(pa.binary())
            for k, (unit, name) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if unit != key:
                    if len(sets) > 1:
                        yield stars(sets)
                    sets, key = {}, unit
                if name not in sets:
                    found = shingles(texts[k].as_py())
                    if len(found) and identity(found) == name:
                        sets[name] = found
        yield stars(sets)

    return run


def _blocks(rows: DataFrame, key: str, scratch: Scratch, name: str) -> DataFrame:
    """rows (key, class, n_shingles, ...) with `unit`: a key's classes, or where they are too many each pair of blocks of them."""
    much = F.greatest(F.count("*") / GROUP_CLASSES, F.sum("n_shingles") / GROUP_SHINGLES)
    sizes = scratch.write(rows.groupBy(key).agg(F.when(much > 1, F.ceil(2 * much)).otherwise(1).cast("int").alias("_blocks")), name)
    placed = rows.join(sizes, key).withColumn("_own", F.pmod(F.xxhash64("class"), "_blocks").cast("int"))
    other = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    unit = F.xxhash64(key, F.least("_own", "_other"), F.greatest("_own", "_other"))
    return other.withColumn("unit", unit).drop("_blocks", "_own", "_other")


def _first(first_id: str, first_text: str) -> Column:
    """The struct whose minimum is the row of the smallest id, null last; ties go to the smallest text_id."""
    return F.struct(F.col(first_id).isNull(), F.col(first_id), F.col(first_text))


def link(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, text_id, n_shingles, class, component_id, kept and stays of every row; sets link from `similarity` percent on.

    `kept`: the doc_id names the component. `stays`: the row is, up to rows that repeat it, the one of its component to keep.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    sketched = scratch.write(sketches(docs), "sketched")
    with_words = sketched.where("class is not null")
    by_class = with_words.groupBy("class").agg(F.min("doc_id").alias("first_id"), F.min(_first("doc_id", "text_id"))["text_id"].alias("first_text"), F.max("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = scratch.write(by_class, "classes")

    met = scratch.write(leaves(classes, scratch, similarity), "met")
    scratch.drop(*(f"{kind}{level}" for kind in ("level", "sizes") for level in range(LEVELS)))
    compared = met.join(classes.select("class", "signature"), "class").select("node", "class", "signature")
    stars = compared.repartition("node").sortWithinPartitions("node").mapInArrow(_stars(margin(similarity)), "a binary, b binary")
    groups = components(stars, scratch, "candidates")

    members = scratch.write(groups.join(classes.select(F.col("class").alias("node"), "first_id", "first_text", "n_shingles"), "node").withColumnRenamed("node", "class"), "members")
    sizes = members.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    fits = (F.col("n") <= GROUP_CLASSES) & (F.col("shingles") <= GROUP_SHINGLES)
    # written before they are joined: a join of two scans can be split where one group is large
    fitting = scratch.write(sizes.select("component", fits.alias("fits")), "fitting")
    sized = scratch.write(members.join(fitting, "component"), "sized")
    own = ("class", "first_id", "first_text")
    repeats = not sketched.groupBy("doc_id", "text_id").count().where("count > 1").isEmpty()
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), text_id(F.col("text")).alias("_text"), "text")

    def confirmed(units: DataFrame) -> DataFrame:
        """The links between the classes of each unit, as stars."""
        # units grow with the corpus, so they are never broadcast: one plan at every size
        same = F.col("first_id").eqNullSafe(F.col("_id")) & (F.col("first_text") == F.col("_text"))
        with_text = units.select("unit", *own).hint("merge").join(texts, same).select("unit", "class", "text")
        if repeats:  # one row stands for those that repeat it, before they are dealt
            with_text = with_text.dropDuplicates(["unit", "class"])
        return with_text.repartition("unit").sortWithinPartitions("unit", "class").mapInArrow(_confirmed(similarity), "a binary, b binary")

    fit = sized.where("fits").select(F.xxhash64("component").alias("unit"), *own)
    large = sized.where("not fits")
    if large.isEmpty():
        stars = scratch.write(confirmed(fit), "links")
        roots = stars.select(F.col("a").alias("class"), F.col("a").alias("component")).distinct()
        joined = stars.select(F.col("b").alias("class"), F.col("a").alias("component")).unionByName(roots)
    else:
        # a large group's first class meets all others, block by block; most near copies are linked by that
        parts = F.ceil(2 * F.greatest(F.col("n") / GROUP_CLASSES, F.col("shingles") / GROUP_SHINGLES)).cast("int")
        counted = scratch.write(sizes.where(~fits).select("component", parts.alias("parts")), "counted")
        dealt = large.join(counted, "component")
        every = F.sequence(F.lit(0), F.col("parts") - 1)
        block = F.when(F.col("class") == F.col("component"), every).otherwise(F.array(F.pmod(F.xxhash64("class"), "parts").cast("int")))
        met_first = dealt.withColumn("block", F.explode(block)).select(F.xxhash64("component", "block").alias("unit"), *own)
        links = scratch.write(confirmed(fit.unionByName(met_first)), "links")
        pieces = components(links, scratch, "pieces").select(F.col("node").alias("class"), F.col("component").alias("piece"))
        # classes that are not in the piece of their group's first class meet what they met in leaves
        led = scratch.write(large.join(pieces, "class", "left").select("component", "class", F.coalesce("piece", "class").alias("piece")), "led")
        first = led.where("class = component").select("component", F.col("piece").alias("main"))
        apart = scratch.write(led.join(first, "component").where("piece <> main").select("class"), "apart")
        if apart.isEmpty():
            joined = pieces.withColumnRenamed("piece", "component")
        else:
            nodes = scratch.write(met.join(apart, "class").select("node").distinct(), "nodes")
            again = met.join(nodes, "node").join(large.select("n_shingles", *own), "class")
            rest = scratch.write(confirmed(_blocks(again, "node", scratch, "blocks")), "rest")
            joined = components(links.unionByName(rest), scratch, "joined").select(F.col("node").alias("class"), "component")

    named = joined.join(members.select("class", "first_id", "first_text"), "class")
    named = scratch.write(named, "named")
    least = scratch.write(named.groupBy("component").agg(F.min("first_id").alias("component_id"), F.min(_first("first_id", "first_text"))["first_text"].alias("keeper")), "least")
    of_class = scratch.write(named.join(least, "component").select("class", "component_id", "keeper"), "of_class")
    scratch.drop("met", "members", "fitting", "sized", "links", "candidates-stars", "named", "least")
    scratch.drop("counted", "pieces-stars", "led", "apart", "nodes", "blocks", "rest", "joined-stars")
    every = classes.select(*own).join(of_class, "class", "left")
    ids = every.select("class", F.coalesce("component_id", "first_id").alias("component_id"), F.coalesce("keeper", "first_text").alias("keeper"))
    ids = scratch.write(ids, "ids")
    found = with_words.select("doc_id", "text_id", "n_shingles", "class").join(ids, "class")
    alone = sketched.where("class is null").select("class", "doc_id", "text_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("text_id").alias("keeper"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    stays = kept & (F.col("text_id") == F.col("keeper"))
    return found.unionByName(alone).select("doc_id", "text_id", "n_shingles", "class", "component_id", kept.alias("kept"), stays.alias("stays"))


def keep_documents(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """One row of docs of each component, and each row without words, all columns as they were; of rows that repeat one."""
    kept = link(docs, similarity).where("stays").groupBy(F.col("doc_id").alias("kept_id"), F.col("text_id").alias("kept_text")).count()
    repeated = not kept.where("count > 1").isEmpty()
    # a row's own columns stay inside a struct, so that none can clash with what is joined
    packed = docs.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").isNull().alias("none"), text_id(F.col("text")).alias("digest"))
    stay = packed.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_text")), "left_semi")
    return (stay.dropDuplicates(["id", "none", "digest"]) if repeated else stay).select("row.*")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM places),
sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 85 * (x.n + y.n - shared.n)),
both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, e.b FROM reached r JOIN both_ways e ON r.b = e.a),
named AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN named USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""
