"""Near-duplicates by similarity of their sets of word shingles, found through wide SimHash fingerprints and Golay keys.

A fingerprint of 256 bits is laid out in two orders, each cut into segments of 30 bits. The first 23 bits of a segment are
decoded to nearby Golay codewords, which forgives errors there, and the other seven must agree. Texts of similarity 0.8
differ in about 39 bits, four or five of each segment, so by pigeonhole some segments have few errors; all 16 are tried.
Fingerprints that meet under a key and differ in up to 62 bits are candidates only: within components of candidates, texts
are linked where the Jaccard similarity of their sets of shingle hashes is 0.8 or more, and nowhere else (see `verified`).

Null and blank texts have an empty set and form one group. Texts of fewer words than a shingle are one shingle. Repeated
shingles count once. Texts with one set are one point, so copies cost nothing. The smallest doc_id names a group; null ids
are passed over. An empty table gives an empty one, and very long texts count whole. Extra columns are left out.
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

from gridmeter.llm import golay, simhash
from gridmeter.llm.common import settle
from gridmeter.llm.components import components

#: 64-bit words of a fingerprint, and the most bits that candidates differ in: 39 at a similarity of 0.8, and four times the spread of 6.
WORDS, MOST_BITS = 4, 62
#: Texts are linked at this Jaccard similarity or more (4 / 5).
SIMILAR = (4, 5)
#: Points that are compared in one task and shingles they may have, and points of a large component that meet all others.
BLOCK, BLOCK_SHINGLES, PIVOTS = 1024, 2_000_000, 8
#: Bits of a segment that must agree beside its Golay word, and multipliers of the orders in which bits are laid out.
EXACT, ORDERS = 7, (1, 73)
#: A quarter of the rows that are read before whole keys are compared; it bounds no key.
RUN = 4096
#: Rounds of segments; points carry what earlier rounds have connected them with.
ROUNDS = ((0, 1), (1, 4), (4, 16))
COLUMNS = [f"w{i}" for i in range(WORDS)]


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(simhash.shingle_hashes(text, width))


def set_id(hashes: np.ndarray) -> int:
    """A signed long for a set of shingles, 0 for the empty one."""
    return int.from_bytes(xxhash.xxh64_digest(hashes.tobytes(), simhash.SEED), "big", signed=True) if len(hashes) else 0


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WORDS words; a bit is set if it is in over half of the hashes of the distinct shingles."""
    if not len(hashes):
        return np.zeros(WORDS, dtype=np.uint64)
    ones = np.zeros((WORDS, 64), dtype=np.int64)
    for lo in range(0, len(hashes), 4096):
        for word in range(WORDS):
            x = hashes[lo : lo + 4096] + np.uint64(word * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            ones[word] += np.unpackbits(x.view(np.uint8), bitorder="little").reshape(len(x), 64).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), axis=1, bitorder="little").view("<u8")[:, 0]


def node_of(words: np.ndarray) -> np.ndarray:
    """A long for each fingerprint."""
    out = np.zeros(len(words), dtype=np.uint64)
    for word in range(words.shape[1]):
        out = (out ^ words[:, word]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def fingerprints(docs: DataFrame, width: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, mark, fp, size, node, w0..) of all rows: hash of the text, id and size of its set, a long for the fingerprint, and its words."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), simhash.mark_of(F.col(text)).alias("mark"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for t in batch.column(2):
                hashes = shingle_set(t.as_py(), width)
                told.append((set_id(hashes), len(hashes), fingerprint(hashes)))
            words = np.array([w for _, _, w in told], dtype=np.uint64).reshape(-1, WORDS)
            longs = [np.array([t[i] for t in told], dtype=np.int64) for i in (0, 1)]
            cols = [pa.array(x) for x in (*longs, node_of(words), *words.view(np.int64).T)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["doc_id", "mark", "fp", "size", "node", *COLUMNS])

    schema = rows.select("doc_id", "mark").schema
    for name in ("fp", "size", "node", *COLUMNS):
        schema = schema.add(name, "long")
    return rows.mapInArrow(run, schema)


@cache
def segments() -> list[np.ndarray]:
    """Positions of the bits of every segment."""
    size, bits = golay.BITS + EXACT, 64 * WORDS
    return [np.arange(at, at + size) * step % bits for step in ORDERS for at in range(0, bits - size + 1, size)]


def segment_keys(words: np.ndarray, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all segments from `first` up to `last`, and the index of the fingerprint that each belongs to."""
    bits = np.unpackbits(words.view(np.uint8).reshape(len(words), 8 * WORDS), axis=1, bitorder="little").astype(np.int64)
    weights, out, index = 1 << np.arange(golay.BITS), [], []
    for number, places in list(enumerate(segments()))[first:last]:
        code = golay.keys(bits[:, places[: golay.BITS]] @ weights)
        exact = bits[:, places[golay.BITS :]] @ weights[:EXACT]
        valid = code >= 0
        out.append((np.int64(number) << (golay.INFO + EXACT) | code << EXACT | exact[:, None])[valid])
        index.append(np.nonzero(valid)[0])
    return np.concatenate(out), np.concatenate(index)


def _with_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = np.stack([c.to_numpy() for c in batch.columns], axis=1).view(np.uint64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node_of(words))], [*COLUMNS, "node"])


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return simhash.bits_set(a ^ b).sum(axis=-1, dtype=np.int64)


def link_run(label: np.ndarray, words: np.ndarray, most: int) -> np.ndarray:
    """(n, 2) labels that connect what is reachable in one run by differing bits or by a common label: from each smallest label to the others.

    What is reached is not compared again, so the work is near linear where rows are alike. Rare labels come first, and what
    is left when only one label remains needs no look.
    """
    names, group, members = np.unique(label, return_inverse=True, return_counts=True)
    edges = [np.zeros((0, 2), np.int64)]
    order = np.argsort(group, kind="stable")
    begin = np.cumsum(members) - members
    left, alive = np.arange(len(label)), np.ones(len(names), dtype=bool)
    for start in np.argsort(members, kind="stable").tolist():
        if not alive[start]:
            continue
        alive[start] = False
        left = left[alive[group[left]]]
        queue, reached = order[begin[start] : begin[start] + members[start]].tolist(), [start]
        while queue and len(left):
            near = differing(words[left], words[queue.pop()]) <= most
            if near.any():
                found = np.unique(group[left[near]])
                alive[found] = False
                left = left[alive[group[left]]]
                reached += found.tolist()
                for i in found.tolist():
                    queue += order[begin[i] : begin[i] + members[i]].tolist()
        if len(reached) > 1:
            told = np.sort(names[reached])
            edges.append(np.stack([np.full(len(told) - 1, told[0]), told[1:]], axis=1))
        if not len(left):
            break
    return np.concatenate(edges)


def link_runs(key: np.ndarray, label: np.ndarray, words: np.ndarray, most: int) -> np.ndarray:
    """(n, 2) labels that connect fingerprints of one key, for rows sorted by key."""
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.concatenate((start, [len(key)])))
    small, found = np.repeat(size <= 8, size), [np.zeros((0, 2), np.int64)]
    for lag in range(1, 8):
        at = np.flatnonzero((key[:-lag] == key[lag:]) & small[:-lag])
        if not len(at):
            break
        at = at[label[at] != label[at + lag]]
        at = at[differing(words[at], words[at + lag]) <= most]
        found.append(np.stack([label[at], label[at + lag]], axis=1))
    return np.concatenate(found + [link_run(label[start[at] : start[at] + size[at]], words[start[at] : start[at] + size[at]], most) for at in np.flatnonzero(size > 8)])


def links(points: DataFrame, most: int = MOST_BITS, run: int | None = None, partitions: int | None = None) -> DataFrame:
    """Edges (a, b), by node, that connect the fingerprints of `points` (columns w0..) whose keys meet and which differ in `most` bits or fewer.

    Segments come in rounds. A point carries the label of all that earlier rounds have connected it with, and a key tells only
    links between different labels, from the smallest one: a large group of near copies is told in the first round, by as many
    edges as it has points times the keys of one segment, and costs the later ones nothing. Rows are read `run` by `run`, but all
    rows of one key are connected as a whole, however many; a row takes 48 bytes. Work grows with the square only of rows
    under one key that are not alike.
    """
    if "node" not in points.columns:
        points = points.select(*COLUMNS).mapInArrow(_with_nodes, ", ".join(f"{c} long" for c in (*COLUMNS, "node")))
    labels = settle(points.select("node", F.col("node").alias("label"), *COLUMNS), "similar-labels")
    for first, last in ROUNDS:
        share = -(-(partitions or 0) * (last - first) // len(segments()))
        found = settle(_links_of(labels, first, last, most, 4 * (run or RUN), max(4, share) if partitions else None), "similar-links")
        moved = components(found, "a", "b").withColumnRenamed("node", "label")
        labels = labels.join(moved, "label", "left").select("node", F.coalesce("root", "label").alias("label"), *COLUMNS)
        labels = settle(labels, "similar-labels")
    return labels.filter("label <> node").select(F.col("label").alias("a"), F.col("node").alias("b"))


def _links_of(labels: DataFrame, first: int, last: int, most: int, read: int, partitions: int | None) -> DataFrame:
    """Edges (a, b) between labels, by the keys of the segments from `first` up to `last`."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(0).to_numpy()
            words = np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1)
            key, index = segment_keys(words.view(np.uint64), first, last)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, label[index], *words[index].T)], ["key", "label", *COLUMNS])

    filed = labels.select("label", *COLUMNS).mapInArrow(file, ", ".join(f"{c} long" for c in ("key", "label", *COLUMNS)))
    filed = (filed.repartition(partitions, "key") if partitions else filed.repartition("key")).sortWithinPartitions("key", "w0")

    def settled(key: np.ndarray, words: np.ndarray) -> Iterator[pa.RecordBatch]:
        pairs = link_runs(key, words[:, 0].view(np.int64), words[:, 1:], most)
        if len(pairs):
            pairs = np.unique(np.sort(pairs, axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held, size, limit = [], [], 0, read
        for batch in batches:
            held_key.append(batch.column(0).to_numpy())
            held.append(np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1).view(np.uint64))
            size += len(held_key[-1])
            if size < limit:
                continue
            key, words = np.concatenate(held_key), np.concatenate(held)
            tail = int(np.searchsorted(key, key[-1]))
            if tail:
                yield from settled(key[:tail], words[:tail])
            held_key, held, size = [key[tail:]], [words[tail:]], len(key) - tail
            # A run that goes on is put together again only when it has doubled.
            limit = max(read, 2 * size)
        if size:
            yield from settled(np.concatenate(held_key), np.concatenate(held))

    return filed.mapInArrow(verify, "a long, b long").distinct()


def alike(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of `others` have a Jaccard similarity of SIMILAR or more with `one`; sets are sorted distinct hashes, none empty."""
    sizes = np.array([len(x) for x in others], dtype=np.int64)
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    both = np.add.reduceat((one[at] == flat).astype(np.int64), np.concatenate(([0], np.cumsum(sizes[:-1]))))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(one) + sizes - both)


def connect(words: np.ndarray, sets: list[np.ndarray], most: int) -> np.ndarray:
    """(n, 2) indices that connect what is reachable by pairs within `most` bits whose sets are similar; all such pairs count."""
    size = np.array([len(x) for x in sets], dtype=np.int64)
    left, edges = np.flatnonzero(size), [np.zeros((0, 2), np.int64)]
    while len(left):
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            fits = (SIMILAR[1] * np.minimum(size[left], size[x]) >= SIMILAR[0] * np.maximum(size[left], size[x])) & (differing(words[left], words[x]) <= most)
            near = np.flatnonzero(fits)
            # A few hundred sets at a time, so that long ones are not copied all at once.
            hit = [near[lo : lo + 256][alike(sets[x], [sets[i] for i in left[near[lo : lo + 256]]])] for lo in range(0, len(near), 256)]
            if hit and len(hit := np.concatenate(hit)):
                found = left[hit]
                edges.append(np.stack([np.full(len(found), root), found], axis=1))
                queue += found.tolist()
                left = np.delete(left, hit)
    return np.concatenate(edges)


def connect_blocks(rows: DataFrame, by: list[str], most: int, partitions: int) -> DataFrame:
    """Edges (a, b) that connect the similar points of each group of `rows` (columns `by`, fp, w0.., hashes)."""
    rows = rows.select(F.xxhash64(*by).alias("block"), "fp", *COLUMNS, "hashes").repartition(partitions, "block").sortWithinPartitions("block", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settled() -> Iterator[pa.RecordBatch]:
            fp = np.concatenate([b.column(1).to_numpy() for b in held])
            words = np.concatenate([np.stack([c.to_numpy() for c in b.columns[2:-1]], axis=1) for b in held]).view(np.uint64)
            sets = []
            for b in held:
                lists = b.column(b.num_columns - 1)
                flat, ends = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
                sets += [flat[lo:hi] for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
            at = connect(words, sets, most)
            if len(at):
                pairs = np.sort(fp[at], axis=1)
                pairs = pairs[pairs[:, 0] != pairs[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            block = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[-1].column(0)[0].as_py() != block[lo]:
                    yield from settled()
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from settled()

    return rows.mapInArrow(run, "a long, b long")


def shingle_sets(docs: DataFrame, points: DataFrame, width: int, text: str, doc_id: str) -> DataFrame:
    """Adds `hashes`, the sorted distinct shingle hashes, to `points` (columns mark and _id name a row of `docs` that has the text)."""
    rows = docs.select(simhash.mark_of(F.col(text)).alias("mark"), F.col(doc_id).alias("_own"), F.col(text).alias("text"))
    found = points.withColumnRenamed("mark", "_mark").join(rows, (F.col("_mark") == F.col("mark")) & F.col("_id").eqNullSafe(F.col("_own")))
    found = found.drop("_mark", "mark", "_id", "_own")
    names = [c for c in found.columns if c != "text"]
    found = found.select(*names, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                sets = [shingle_set(t.as_py(), width).view(np.int64) for t in part.columns[-1]]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(sets, pa.list_(pa.int64()))], [*names, "hashes"])

    return found.mapInArrow(run, found.drop("text").schema.add("hashes", ArrayType(LongType())))


def verified(docs: DataFrame, points: DataFrame, candidates: DataFrame, width: int, most: int, block: int, text: str, doc_id: str) -> DataFrame:
    """Edges (a, b) that connect all points which are in one component of `candidates`, within `most` bits and similar by their sets.

    Points of a component are compared in blocks, with a few pivots of the component in every block. What is then not in the
    largest group of its component meets every block of it. So each pair has been compared, or both were in one group
    already, and one large group costs each of its points once.
    """
    label = components(candidates, "a", "b")
    # Different sets may share a fingerprint.
    several = points.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1").select("node")
    label = label.union(several.join(label, "node", "left_anti").select("node", F.col("node").alias("root")))
    members = settle(points.join(label, "node").drop("node"), "similar-members")
    blocks = F.ceil(F.greatest(F.count("*") / block, F.sum("size") / BLOCK_SHINGLES)).cast("long")
    large = settle(members.groupBy("root").agg(F.count("*").alias("n"), blocks.alias("blocks")).filter("blocks > 1"), "similar-large")
    placed = members.drop("size").join(large, "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("fp"), "blocks"))
    sets = settle(shingle_sets(docs, placed, width, text, doc_id), "similar-sets")
    if sets.count() > members.count():  # rows that repeat id and text
        sets = settle(sets.dropDuplicates(["fp"]), "similar-distinct-sets")
    partitions = max(8, members.count() // 1000)
    numbers = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    pivots = sets.filter("blocks > 1").filter(F.pmod(F.xxhash64(F.lit(1), "fp"), F.ceil(F.col("n") / PIVOTS).cast("long")) == 0)
    pivots = pivots.withColumn("own", F.col("block")).withColumn("block", F.explode(numbers)).filter("block <> own").drop("own")
    edges = settle(connect_blocks(sets.unionByName(pivots.select(*sets.columns)), ["root", "block"], most, partitions), "similar-edges").distinct()
    if large.isEmpty():
        return edges
    big = sets.filter("blocks > 1")
    group = components(edges.join(big.select(F.col("fp").alias("a")), "a"), "a", "b")
    group = big.select("fp", "root").join(group.select(F.col("node").alias("fp"), F.col("root").alias("group")), "fp", "left")
    group = settle(group.withColumn("group", F.coalesce("group", "fp")), "similar-groups")
    first = group.groupBy("root", "group").agg(F.count("*").alias("n")).groupBy("root").agg(F.max(F.struct("n", "group")).alias("most"), F.sum("n").alias("all"))
    first = settle(first.select("root", F.col("most.group").alias("first"), (F.col("all") - F.col("most.n")).alias("others")), "similar-others").filter("others > 0")
    if first.isEmpty():
        return edges
    chunks = first.join(large.select("root", "n", "blocks"), "root").select("root", "first", F.ceil(F.col("others") * F.col("blocks") / F.col("n")).cast("long").alias("chunks"))
    big = big.join(group.select("fp", "group"), "fp").join(chunks, "root")
    late = big.filter(F.col("group") != F.col("first")).withColumn("chunk", F.pmod(F.xxhash64(F.lit(2), "fp"), "chunks"))
    late = late.withColumn("own", F.col("block")).withColumn("block", F.explode(numbers)).filter("block <> own")
    there = big.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    names = ["root", "block", "chunk", "fp", *COLUMNS, "hashes"]
    more = connect_blocks(late.select(*names).union(there.select(*names)), ["root", "block", "chunk"], most, partitions)
    return edges.union(settle(more, "similar-late-edges")).distinct()


def near_duplicates(docs: DataFrame, width: int, most: int = MOST_BITS, text: str = "text", doc_id: str = "doc_id", run: int | None = None) -> DataFrame:
    """(doc_id, mark, fp, root, component_id) of every row; fp is the set of shingles, root the set that names the component."""
    rows = settle(fingerprints(docs, width, text, doc_id), "similar-fingerprints")
    same = [F.min(c).alias(c) for c in ("size", "node", *COLUMNS)]
    points = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(F.struct("mark", "doc_id")).alias("one"), *same)
    points = settle(points.select("fp", "least", F.col("one.mark").alias("mark"), F.col("one.doc_id").alias("_id"), "size", "node", *COLUMNS), "similar-points")
    # About 4 MB of filed keys for each task, whatever the number of fingerprints.
    candidates = links(points.dropDuplicates(["node"]), most, run, partitions=max(8, points.count() * 90 // 100_000))
    edges = verified(docs, points.drop("least"), candidates, width, most, run or BLOCK, text, doc_id)
    return simhash.name_groups(rows.select("doc_id", "mark", "fp"), points.select("fp", "least"), edges)
