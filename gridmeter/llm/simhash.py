"""Near-duplicates by 64-bit SimHash fingerprints that differ in few bits, found through Golay keys of segments.

Fingerprints are cut into three segments of 22, 21 and 21 bits. With up to 5 differing bits, two of the three segments
differ in at most 2 bits each, and segments that close share a Golay key. So every fingerprint is filed under the pairs of
keys of its three pairs of segments, and what meets under a pair of keys is verified bit by bit.

Null and blank texts have fingerprint 0 and link like any other. Documents of one fingerprint are one point: links are
sought between distinct fingerprints, so repeated rows and copies cost nothing. Where more than `RUN` distinct
fingerprints meet under one key, they are linked exactly through common points half way instead (see `midpoints`).
The smallest doc_id names a component; null ids are passed over. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmeter.llm import golay
from gridmeter.llm.common import settle
from gridmeter.llm.components import components

SEED = 42
MAX_BITS = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Largest number of fingerprints under one key that are compared with each other.
RUN = 4096
#: Places over which the points of one component are spread.
SALTS = 64
_ONES = np.array([bin(i).count("1") for i in range(1 << 8)], dtype=np.uint8)


def bits_set(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x) if hasattr(np, "bitwise_count") else _ONES[x.view(np.uint8)].reshape(*x.shape, 8).sum(axis=-1)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of every shingle of `width` words, A-Z lower-cased; of all words where they are fewer, none without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(len(words) - width + 1, 1)
    last = ends[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), dtype="<u8", count=n)


def fingerprint(text: str | None, width: int) -> int:
    """SimHash over all shingles of `width` words, repeats included; a bit is set if it is in over half of the hashes."""
    hashes = shingle_hashes(text, width)
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, n, 4096):
        part = hashes[lo : lo + 4096]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(len(part), 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, mark, fp) of all rows; fp is the fingerprint as a signed long, mark a hash of the text."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), mark_of(F.col(text)).alias("mark"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in batch.column(2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["doc_id", "mark", "fp"])

    return rows.mapInArrow(run, rows.select("doc_id", "mark").schema.add("fp", "long"))


def mark_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def segment_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of pairs of segments, and the index of the fingerprint that each belongs to."""
    fps = fps.view(np.uint64)
    per = [golay.keys(((fps >> np.uint64(at)) & np.uint64((1 << size) - 1)).astype(np.int64)) for at, size in SEGMENTS]
    out, index = [], []
    for kind, (i, j) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        both = (np.int64(kind) << 24) | (per[i][:, :, None] << 12) | per[j][:, None, :]
        valid = (per[i][:, :, None] >= 0) & (per[j][:, None, :] >= 0)
        out.append(both[valid])
        index.append(np.nonzero(valid)[0])
    return np.concatenate(out), np.concatenate(index)


def _file_under_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy()
        key, index = segment_keys(fps)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[index])], ["key", "fp"])


def spanning(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges that connect what is reachable among these fingerprints, one less than members for each component."""
    left, edges = fps.view(np.uint64), []
    while len(left):
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            near = bits_set(left ^ queue.pop()) <= most
            if near.any():
                edges += [(root, x) for x in left[near]]
                queue += list(left[near])
                left = left[~near]
    return edges


def link_runs(key: np.ndarray, fp: np.ndarray, most: int) -> np.ndarray:
    """Edges among rows sorted by key; (n, 2) fingerprints."""
    new = np.concatenate(([True], key[1:] != key[:-1]))
    start = np.flatnonzero(new)
    size = np.diff(np.concatenate((start, [len(key)])))
    small = np.repeat(size <= 8, size)
    found = []
    for lag in range(1, 8):
        a, b = fp[:-lag], fp[lag:]
        hit = (key[:-lag] == key[lag:]) & small[:-lag]
        if not hit.any():
            break
        a, b = a[hit], b[hit]
        near = bits_set((a ^ b).view(np.uint64)) <= most
        found.append(np.stack([a[near], b[near]], axis=1))
    for at in np.flatnonzero(size > 8):
        edges = spanning(fp[start[at] : start[at] + size[at]], most)
        if edges:
            found.append(np.array(edges, dtype=np.uint64).view(np.int64))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def links(points: DataFrame, most: int = MAX_BITS, run: int = RUN, partitions: int | None = None) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints in `points` (column fp) which differ in `most` bits or fewer."""
    if most > 5:
        raise ValueError("two of three segments are within 2 bits only up to 5 differing bits")
    filed = points.mapInArrow(_file_under_keys, "key long, fp long")
    filed = (filed.repartition(partitions, "key") if partitions else filed.repartition("key")).sortWithinPartitions("key", "fp")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, crowded = np.zeros(0, np.int64), np.zeros(0, np.int64), None

        def told(pairs: np.ndarray, dense: np.ndarray) -> pa.RecordBatch:
            a, b = np.concatenate([pairs[:, 0], dense]), np.concatenate([pairs[:, 1], dense])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy()])
            if crowded is not None:  # the rest of a run that was handed over
                rest = key == crowded
                if rest.any():
                    yield told(np.zeros((0, 2), np.int64), fp[rest])
                    key, fp = key[~rest], fp[~rest]
            if not len(key):
                continue
            tail = np.searchsorted(key, key[-1])
            if tail == 0 and len(key) <= run:
                continue
            if tail == 0:
                crowded = key[-1]
                yield told(np.zeros((0, 2), np.int64), fp)
                key, fp = key[:0], fp[:0]
                continue
            if tail >= 100_000 or len(key) > 200_000:
                yield from settle_runs(key[:tail], fp[:tail], told)
                key, fp = key[tail:], fp[tail:]
        if len(key):
            yield from settle_runs(key, fp, told)

    def settle_runs(key: np.ndarray, fp: np.ndarray, told) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.concatenate((start, [len(key)])))
        large = np.repeat(size > run, size)
        yield told(link_runs(key[~large], fp[~large], most) if (~large).any() else np.zeros((0, 2), np.int64), np.unique(fp[large]))

    found = settle(filed.mapInArrow(verify, "a long, b long").distinct(), "simhash-links")
    crowded = found.filter("a = b").select(F.col("a").alias("fp"))
    plain = found.filter("a <> b")
    return plain if crowded.isEmpty() else plain.union(midpoint_links(crowded, most))


def midpoints(fps: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """All points within half of `most` bits, one array for each way to flip; two fingerprints share one exactly if within `most`."""
    masks = [0]
    for n in range(1, (most + 1) // 2 + 1):
        masks += [sum(1 << i for i in at) for at in combinations(range(64), n)]
    for mask in masks:
        yield fps.view(np.uint64) ^ np.uint64(mask)


def midpoint_links(points: DataFrame, most: int) -> DataFrame:
    """Links of crowded fingerprints: each is filed under all points half way, so the work grows with their number, not its square.

    For an odd `most` a common point may join two fingerprints one bit further apart; such a link is checked against the bits.
    """
    if most % 2:
        raise ValueError("points half way need an even number of bits")

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for at in midpoints(fps, most):
                yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(fps)], ["mid", "fp"])

    filed = points.mapInArrow(file, "mid long, fp long")
    least = filed.groupBy("mid").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return filed.join(least, "mid").filter("a <> fp").select("a", F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int, most: int = MAX_BITS, text: str = "text", doc_id: str = "doc_id", run: int = RUN) -> DataFrame:
    """(doc_id, mark, fp, root, component_id) of every row; root is the fingerprint that names the component."""
    rows = settle(fingerprints(docs, width, text, doc_id), "simhash-fingerprints")
    points = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-points")
    size = points.count()
    # About 2 MB of filed keys for each task, whatever the number of fingerprints.
    edges = links(points.select("fp"), most, run, partitions=max(8, size * 84 // 250_000))
    return name_groups(rows, points, edges)


def name_groups(rows: DataFrame, points: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (doc_id, mark, fp) with the root of their component and its smallest id; points hold the smallest id of each fp."""
    label = components(edges, "a", "b").withColumnRenamed("node", "fp")
    grouped = points.join(label, "fp", "left").withColumn("linked", F.col("root").isNotNull()).withColumn("root", F.coalesce("root", "fp"))
    # A component may hold a third of all points, so they meet its smallest id in SALTS places (never broadcast: Spark would size it before it is multiplied).
    smallest = grouped.filter("linked").groupBy("root").agg(F.min("least").alias("smallest"))
    smallest = smallest.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    named = grouped.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS))).join(smallest.hint("merge"), ["root", "salt"], "left")
    named = named.select("fp", "root", F.when(F.col("linked"), F.col("smallest")).otherwise(F.col("least")).alias("component_id"))
    return rows.join(named, "fp").select("doc_id", "mark", "fp", "root", "component_id")


def deduplicate(docs: DataFrame, found: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each component in `found` (near_duplicates of the same rows), with all columns of `docs`.

    It is the row with the smallest id (of equal ids, the smallest text hash).
    """
    found = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = found.groupBy("root").agg(F.min(F.struct("mark", "doc_id")).alias("first"), F.count("*").alias("rows"))
    first = settle(first.select(F.col("first.doc_id").alias("_id"), F.col("first.mark").alias("_mark"), "rows"), "simhash-survivors")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(doc_id).alias("_own"), mark_of(F.col(text)).alias("_own_mark"))
    kept = rows.join(first, (F.col("_own_mark") == F.col("_mark")) & F.col("_own").eqNullSafe(F.col("_id")))
    # Rows that repeat id and text are one document too; only where there are any, rows are made distinct.
    if not first.filter("rows > 1").isEmpty():
        kept = kept.filter("rows = 1").unionByName(kept.filter("rows > 1").dropDuplicates(["_own", "_own_mark"]))
    return kept.select("_row.*")
