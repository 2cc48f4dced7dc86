"""Packing into sequences of fixed length: shortest-pack-first over the histogram of lengths.

Documents are cut into pieces of the full length and one rest. Only the histogram of lengths (at most `length` numbers)
reaches the driver. Lengths are placed longest first into the pattern with the most room left that still holds them;
patterns carry counts, so millions of equal sequences are one entry. Then every piece gets its rank among the pieces of its
length, and the patterns say which sequence and offset that rank has.

Null texts are empty ones; every document has at least its end id, so every document has a piece. Rows that repeat an id are
packed each on their own. An empty table gives an empty one. Very long texts are many pieces. Extra columns are left out.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmeter.llm.common import settle
from gridmeter.llm.tokens import encoder, grouped

LENGTH, END = 1024, 0


def patterns(histogram: dict[int, int], length: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, how many sequences) by shortest-pack-first histogram packing.

    The heap holds patterns by their filling, the emptiest first. A length that fits there joins as many of its sequences as
    it has pieces; the others open sequences of their own. Patterns that cannot take the shortest length are done.
    """
    open_: list[tuple[int, int, tuple[int, ...], int]] = []
    done: list[tuple[tuple[int, ...], int]] = []
    serial = 0
    shortest = min((n for n, c in histogram.items() if c), default=0)
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        # Within a length, sequences filled by it go back to the heap, so a sequence may take several pieces of it.
        while left:
            if open_ and open_[0][0] + size <= length:
                filled, _, inside, count = heapq.heappop(open_)
                used = min(count, left)
                left -= used
                if used < count:
                    heapq.heappush(open_, (filled, serial, inside, count - used))
                    serial += 1
                filled, inside, count = filled + size, (*inside, size), used
            else:
                # As many to a new sequence as fit: they are what the emptiest patterns would become one by one.
                each = min(length // size, left)
                filled, inside, count = each * size, (size,) * each, left // each
                left -= each * count
            if filled + shortest > length:
                done.append((inside, count))
            else:
                heapq.heappush(open_, (filled, serial, inside, count))
                serial += 1
    return done + [(inside, count) for _, _, inside, count in sorted(open_)]


def places(found: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks of runs, the sequence the run starts in, and the offset in all of them."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    first = 0
    for inside, count in found:
        offset = 0
        for size in inside:
            rank = taken.get(size, 0)
            out.setdefault(size, []).append((rank, first, offset))
            taken[size] = rank + count
            offset += size
        first += count
    return {size: tuple(np.array(c, dtype=np.int64) for c in zip(*runs, strict=True)) for size, runs in out.items()}


def token_pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of every piece."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in grouped(batches):
            ids, count = encoder(path).encode(texts, end)
            data = ids.astype("<u4").tobytes()
            begin = np.cumsum(count) - count
            cuts = -(-count // length)
            doc = np.repeat(np.arange(len(count)), cuts)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * length
            size = np.minimum(count[doc] - start, length)
            lo = (begin[doc] + start) * 4
            crc = [zlib.crc32(data[a : a + 4 * n]) for a, n in zip(lo.tolist(), size.tolist(), strict=True)]
            cols = [keys.take(pa.array(doc)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(count[doc])]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    schema = rows.select("doc_id").schema
    for name in ("start", "length", "ids_crc32", "doc_tokens"):
        schema = schema.add(name, "long")
    return rows.mapInArrow(run, schema)


def ranked(rows: DataFrame, group: str, order: list[str], blocks: int) -> DataFrame:
    """Adds `rank`, from 0 within each group: rows are ranked in hash blocks, and blocks are offset by their counts, so a
    group may hold all rows."""
    names = rows.columns
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    sizes = rows.groupBy(group, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.select(group, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_before"))
    within = Window.partitionBy(group, "_block").orderBy(*order)
    out = rows.withColumn("_at", F.row_number().over(within) - 1).join(offset, [group, "_block"])
    return out.select(*names, (F.col("_before") + F.col("_at")).alias("rank"))


def pack(pieces: DataFrame, length: int = LENGTH, order: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """Adds sequence_id and offset to pieces, whose `length` is at most that of a sequence."""
    pieces = settle(pieces, "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = places(patterns(histogram, length))
    blocks = max(1, sum(histogram.values()) // 50_000)
    rows = ranked(pieces, "length", list(order), blocks)
    at, by = rows.columns.index("rank"), rows.columns.index("length")
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, size = batch.column(at).to_numpy(), batch.column(by).to_numpy()
            sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            for n in np.unique(size):
                mine = np.flatnonzero(size == n)
                begins, first, place = where[int(n)]
                run_ = np.searchsorted(begins, rank[mine], side="right") - 1
                sequence[mine], offset[mine] = first[run_] + rank[mine] - begins[run_], place[run_]
            cols = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(offset)], schema.names)

    return rows.mapInArrow(run, schema)
