"""Near-duplicates by MinHash with tensored banding, verified on the full sets.

Two collections of `SIDE` short bands, of `HALF` minhashes each, are computed; a table for every pair of a band of the first
and one of the second gives SIDE x SIDE tables of 2 x HALF minhashes a key from 2 x SIDE x HALF minhashes in all, about the square
root of what tables of their own would need. With 10 and 3, 60 minhashes stand for 600. Sets of similarity s share a key with
probability (1 - (1 - s^3)^10)^2: 0.99985 at 0.85 and 0.99999 at 0.9, while sets of 0.3 do with 0.06 and unrelated ones never.

Texts of one set are one point. Points that meet nobody under any key are done. The others are compared in three rounds of tables
(one, those of equal numbers, the rest), each point carrying the label of what it was linked with before: keys all of whose points
have one label are done, and keys that hold the same points are compared once. Points of a key are compared set by set in one
task up to `BLOCK`. Where more than a block of points are not of the key's commonest label, blocks that share a few pivots are
compared first, to have fewer labels; then all that is not in the commonest label meets every block. So all points that meet under a key are compared or already linked, no pair is written, and a key that
holds a third of all points is the work of many tasks. Links are confirmed by intersection and union of the sets.

Null texts and texts without a word have an empty set and are linked with nothing, each its own component. Fewer words than a
shingle make one shingle of all words; repeated shingles count once, and very long texts count whole. Rows that repeat an id are
rows of their own with one component if their sets are linked; the smallest id names a component, null ids are passed over. An
empty table gives an empty one. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from gridmeter.llm.common import settle
from gridmeter.llm.components import components
from gridmeter.llm.simhash import SEED, shingle_hashes

WIDTH = 5
#: Linked are sets whose intersection is at least 85 of 100 of their union.
SIMILAR = (85, 100)
SIDE, HALF = 10, 3
#: Points and shingles of a block, and pivots that each block of a large key shares.
BLOCK, BLOCK_SHINGLES, PIVOTS = 512, 1_000_000, 8
#: Rounds of tables: that of the first two bands, the others of equal numbers, and the rest.
TURNS = 3


@cache
def _multipliers() -> np.ndarray:
    return np.random.default_rng(12).integers(0, 1 << 63, 2 * SIDE * HALF, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands(hashes: np.ndarray) -> np.ndarray:
    """A long for each of the 2 x SIDE bands of a set that is not empty.

    A minhash is the smallest product of the shingle hashes, random as they are, with one odd number modulo 2^64."""
    mixed = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    least = np.full(2 * SIDE * HALF, ~np.uint64(0))
    for lo in range(0, len(mixed), 1024):
        np.minimum(least, np.multiply.outer(_multipliers(), mixed[lo : lo + 1024]).min(axis=1), out=least)
    out = np.zeros(2 * SIDE, dtype=np.uint64)
    for part in least.reshape(2 * SIDE, HALF).T:
        out = (out ^ part) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))


def signatures(docs: DataFrame, width: int, text: str, doc_id: str) -> DataFrame:
    """(doc_id, mark, fp, size, bands) of every row: hash of the text, hash and size of its set (0 if empty), and its bands."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for t in batch.column(2):
                hashes = shingle_set(t.as_py(), width)
                n = len(hashes)
                fp = int.from_bytes(xxhash.xxh64_digest(hashes.tobytes(), SEED), "big", signed=True) if n else 0
                told.append((fp, n, bands(hashes) if n else None))
            cols = [pa.array([t[0] for t in told], pa.int64()), pa.array([t[1] for t in told], pa.int64()), pa.array([t[2] for t in told], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["doc_id", "mark", "fp", "size", "bands"])

    schema = rows.select("doc_id", "mark").schema.add("fp", "long").add("size", "long").add("bands", ArrayType(LongType()))
    return rows.mapInArrow(run, schema)


def filed(points: DataFrame) -> DataFrame:
    """(key, round, fp): every point under its keys, one for each pair of bands."""
    first = points.select("fp", F.slice("bands", SIDE + 1, SIDE).alias("second"), F.posexplode(F.slice("bands", 1, SIDE)).alias("i", "u"))
    both = first.select("fp", "i", "u", F.posexplode("second").alias("j", "v"))
    number = F.when(F.col("i") != F.col("j"), 2).when(F.col("i") > 0, 1).otherwise(0).cast("byte")
    return both.select(F.xxhash64("i", "j", "u", "v").alias("key"), number.alias("round"), "fp")


def meetings(points: DataFrame) -> DataFrame:
    """Rows of `filed` whose key holds several points. Keys are counted with partial sums, so a common one costs no task more."""
    rows = filed(points)
    several = rows.groupBy("key").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).filter("least < most").select("key")
    return rows.join(several, "key", "left_semi")


class Sets:
    """Sets of a block, numbered densely, so that one is compared with all by a look-up and a sum."""

    def __init__(self, flat: np.ndarray, size: np.ndarray):
        self.size, self.begin = size, np.cumsum(size) - size
        distinct, self.at = np.unique(flat, return_inverse=True)
        self.mark = np.zeros(len(distinct), dtype=bool)

    def alike(self, x: int) -> np.ndarray:
        """Which sets are similar to set x."""
        mine = self.at[self.begin[x] : self.begin[x] + self.size[x]]
        self.mark[mine] = True
        both = np.add.reduceat(self.mark[self.at], self.begin, dtype=np.int64)
        self.mark[mine] = False
        return SIMILAR[1] * both >= SIMILAR[0] * (self.size + self.size[x] - both)


def connect(label: np.ndarray, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(n, 2) indices of similar sets that connect what similar pairs and equal labels connect; at most one less than there are labels.

    Of any two labels one is not the commonest; so it is enough to hold the points beside that one against all others, those
    of rare labels first. Points that all others are connected with already need no look.
    """
    _, root, members = np.unique(label, return_inverse=True, return_counts=True)
    sets, edges = Sets(flat, size), []
    order = np.argsort(members[root], kind="stable")
    for x in order[: len(label) - members.max()].tolist():
        other = root != root[x]
        if not other.any():
            break
        for y in np.flatnonzero(other & sets.alike(x)).tolist():
            if root[y] != root[x]:
                edges.append((x, y))
                root[root == root[y]] = root[x]
    return np.array(edges, dtype=np.int64).reshape(-1, 2)


def compare(rows: DataFrame, by: list[str], partitions: int) -> DataFrame:
    """Links (a, b) between labels, from each group of `rows` (columns `by`, label, fp, hashes) compared as a whole."""
    rows = rows.select(F.xxhash64(*by).alias("group"), "label", "fp", "hashes").repartition(partitions, "group").sortWithinPartitions("group", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settled() -> Iterator[pa.RecordBatch]:
            label = np.concatenate([b.column(1).to_numpy() for b in held])
            if (label == label[0]).all():
                return
            lists = [b.column(3) for b in held]
            at = connect(label, np.concatenate([x.flatten().to_numpy() for x in lists]), np.concatenate([x.value_lengths().to_numpy() for x in lists]).astype(np.int64))
            pairs = np.unique(np.sort(label[at], axis=1), axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            group = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[-1].column(0)[0].as_py() != group[lo]:
                    yield from settled()
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from settled()

    return rows.mapInArrow(run, "a long, b long")


def shingle_sets(docs: DataFrame, points: DataFrame, width: int, text: str, doc_id: str) -> DataFrame:
    """(fp, size, hashes) of `points` (fp, size, and mark and _id of a row of `docs` that has the text)."""
    rows = docs.select(F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_mark"), F.col(doc_id).alias("_own"), F.col(text).alias("text"))
    found = points.join(rows, (F.col("_mark") == F.col("mark")) & F.col("_id").eqNullSafe(F.col("_own"))).select("fp", "size", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                sets = [shingle_set(t.as_py(), width).view(np.int64) for t in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sets, pa.list_(pa.int64()))], ["fp", "size", "hashes"])

    return found.mapInArrow(run, "fp long, size long, hashes array<long>")


def relabelled(points: DataFrame, edges: DataFrame) -> DataFrame:
    """`points` (fp, label, size) with the smallest label that theirs is linked with."""
    label = components(edges, "a", "b").withColumnRenamed("node", "label")
    moved = points.join(label, "label", "left")
    return settle(moved.select("fp", F.coalesce("root", "label").alias("label"), "size"), "tensored-labels")


def several_labels(met: DataFrame, labels: DataFrame, compared: list[DataFrame], block: int) -> DataFrame:
    """Keys whose points have different labels: (key, x, y, n, others, first, parts, chunks).

    Keys that hold the same points, as x and y tell, are one, and those that an earlier round has compared are left out.
    `first` is the commonest label and `others` the points that have another one.
    """
    per = met.join(labels, "fp").groupBy("key", "label").agg(
        F.count("*").alias("times"), F.sum("size").alias("shingles"),
        F.bit_xor(F.xxhash64("fp")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "fp")).alias("y"))
    one = per.groupBy("key").agg(
        F.max(F.struct("times", "label")).alias("most"), F.sum("times").alias("n"), F.sum("shingles").alias("shingles"),
        F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).filter("n > most.times")
    one = one.groupBy("x", "y").agg(F.min(F.struct("key", "n", "shingles", "most")).alias("k")).select("x", "y", "k.*")
    for before in compared:
        one = one.join(before, ["x", "y"], "left_anti")
    parts = F.ceil(F.greatest(F.col("n") / block, F.col("shingles") / BLOCK_SHINGLES)).cast("long")
    others = F.col("n") - F.col("most.times")
    chunks = F.ceil(others * parts / F.col("n")).cast("long")
    return settle(one.select("x", "y", "key", "n", others.alias("others"), F.col("most.label").alias("first"), parts.alias("parts"), chunks.alias("chunks")), "tensored-keys")


def one_round(met: DataFrame, labels: DataFrame, sets: DataFrame, compared: list[DataFrame], block: int) -> DataFrame:
    """`labels` after all points that meet under the keys of `met` (key, fp) have been compared.

    `compared` holds what tells the points of the keys of earlier rounds, and gets that of this one."""
    earlier = list(compared)
    keys = several_labels(met, labels, earlier, block)
    compared.append(keys.select("x", "y"))
    numbers = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    # Keys with more than a block of points beside the commonest label: blocks that share a few pivots, to have fewer labels.
    crowded = keys.filter("chunks > 1").select("key", "n", "parts")
    size = crowded.agg(F.sum("n")).first()[0]
    if size:
        rows = met.join(crowded, "key").join(labels, "fp").withColumn("part", F.pmod(F.xxhash64("fp"), "parts"))
        pivot = F.pmod(F.xxhash64(F.lit(1), "key", "fp"), F.ceil(F.col("n") / PIVOTS).cast("long")) == 0
        spread = rows.withColumn("part", F.explode(F.when(pivot, numbers).otherwise(F.array("part"))))
        edges = compare(spread.join(sets, "fp"), ["key", "part"], max(8, size // 2000))
        labels = relabelled(labels, settle(edges, "tensored-first-links"))
        keys = several_labels(met, labels, earlier, block)
    size = keys.agg(F.sum("n")).first()[0]
    if not size:
        return labels
    # What a key holds beside its commonest label meets every block of it, in chunks as large as blocks.
    rows = met.join(keys.drop("x", "y", "n", "others"), "key").join(labels, "fp").withColumn("part", F.pmod(F.xxhash64("fp"), "parts"))
    late = rows.filter("parts > 1 AND label <> first").withColumn("chunk", F.pmod(F.xxhash64(F.lit(2), "fp"), "chunks"))
    late = late.withColumn("own", F.col("part")).withColumn("part", F.explode(numbers)).filter("part <> own")
    there = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    names = ["key", "part", "chunk", "fp", "label"]
    every = (late.select(*names).union(there.select(*names)) if not keys.filter("parts > 1").isEmpty() else there.select(*names)).join(sets, "fp")
    return relabelled(labels, settle(compare(every, ["key", "part", "chunk"], max(8, size // 2000)), "tensored-links"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """(doc_id, mark, n_shingles, component_id) of every row."""
    rows = settle(signatures(docs, width, text, doc_id), "tensored-signatures")
    points = rows.filter("size > 0").groupBy("fp").agg(
        F.min("doc_id").alias("least"), F.min(F.struct("mark", "doc_id")).alias("one"), F.min("size").alias("size"), F.first("bands").alias("bands"))
    points = settle(points.select("fp", "least", "size", "bands", F.col("one.mark").alias("mark"), F.col("one.doc_id").alias("_id")), "tensored-points")
    met = settle(meetings(points), "tensored-meetings")
    near = points.join(met.select("fp").distinct(), "fp", "left_semi")
    # Rows that repeat id and text give a set once each.
    sets = settle(shingle_sets(docs, near.select("fp", "size", "mark", "_id"), width, text, doc_id).dropDuplicates(["fp"]).select("fp", "hashes"), "tensored-sets")
    labels = settle(near.select("fp", F.col("fp").alias("label"), "size"), "tensored-labels")
    compared: list[DataFrame] = []
    for number in range(TURNS):
        labels = one_round(met.filter(F.col("round") == number).select("key", "fp"), labels, sets, compared, block)
    return named(rows, points, labels)


def named(rows: DataFrame, points: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with the smallest id of their component."""
    grouped = points.select("fp", "least").join(labels.select("fp", "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    smallest = grouped.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("points"))
    # Most components are one point and have their name already; the others meet it, those of a large one in as many places as its size asks for.
    several = smallest.filter("points > 1").withColumn("salts", F.ceil(F.col("points") / 10_000).cast("long"))
    several = settle(several.drop("points"), "tensored-names")
    inside = grouped.join(several.select("label", "salts"), "label").withColumn("salt", F.pmod(F.xxhash64("fp"), "salts"))
    salted = several.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    inside = settle(inside.join(salted.select("label", "salt", "component_id"), ["label", "salt"]).select("fp", "component_id"), "tensored-named")
    points = grouped.join(inside, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    found = rows.join(points, "fp", "left")
    return found.select("doc_id", "mark", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
