"""Removal of long passages that another document has already: difference-cover anchors, then exact windows.

A passage is a window of 13 words. With D = {0, 1, 3} modulo 7, any two positions i and j have a shift below 7 that brings
both into D, so two equal windows share an anchor: 7 words that start at a position in D modulo 7 in both documents. Only
anchors (3 of 7 positions) are compared across documents at first. Around anchors that two documents share, matches are
extended: every window that holds such an anchor is compared, and a word goes if a window over it also starts in a document
with a smaller id.

Documents are handled in packs of about `PACK` bytes, one compressed row each, written once. A pack sends each of its
distinct anchors (later windows) once to a bucket by hash, with one bit or the smallest id; a bucket answers with one bit
for each. So a passage that millions of documents share costs a bucket one entry for each pack, and answers are tiny.

Null texts have no words. Windows within one document, or within rows that repeat one id, remove nothing. A null id is
larger than all others. Texts under 13 words are never changed. Extra columns are left out. Hashes have 64 bits for anchors,
which are only a filter, and 96 bits for windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmeter.llm.common import settle

WINDOW, PERIOD = 13, 7
#: Fixed value: every difference modulo 7 is a difference of two of these.
COVER = (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
PACK = 2 << 20
#: Entries that a bucket holds, about; their number grows with the words of the table.
BUCKET = 500_000
NO_ID = np.iinfo(np.int64).max
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Scrambled 64-bit values (the finaliser of SplitMix64)."""
    x = x + np.uint64(salt * int(_ODD) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64), 1)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    out = np.ones(n, dtype=np.uint64)
    if n > 1:
        np.multiply.accumulate(np.full(n - 1, base, dtype=np.uint64), out=out[1:])
    return out


_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def run_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of values[start:end], all from one running sum."""
    n = len(values)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * _powers(_BASE, n), out=sums[1:])
    return mix((sums[end] - sums[start]) * _powers(_INVERSE, n + 1)[start])


class Words:
    """The words of several texts joined by a blank: their hashes, and the document of each."""

    def __init__(self, blob: bytes, lengths: np.ndarray):
        data = np.frombuffer(blob, dtype=np.uint8)
        solid = ~_BLANK[data]
        edge = np.diff(np.concatenate(([0], solid.view(np.int8), [0])))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.hash = run_hashes(_BYTES[data], start, end) if len(start) else np.zeros(0, np.uint64)
        begins = np.cumsum(lengths + 1) - lengths - 1
        self.doc = np.searchsorted(begins, start, side="right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(lengths)))
        self.count = np.bincount(self.doc, minlength=len(lengths))
        self.place = np.arange(len(start)) - self.first[self.doc] if len(start) else start

    def runs(self, width: int, at: np.ndarray) -> np.ndarray:
        return run_hashes(mix(self.hash, 2), at, at + width)

    def fits(self, width: int) -> np.ndarray:
        """Places where `width` words of one document start."""
        return np.flatnonzero(self.place + width <= self.count[self.doc]) if len(self.doc) else np.zeros(0, np.int64)


def packs(docs: DataFrame, doc_id: str, text: str, carry: list[str]) -> DataFrame:
    """(pack, ids, nulls, lengths, blob, rest, words): documents in rows of about `PACK` bytes; a longer text has a row of its own.

    `rest` holds the columns `carry` as an Arrow stream.
    """
    filler = "_" + max(carry, key=len, default="")  # longer than every name of `carry`, so none of them
    rows = docs.select(
        F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.spark_partition_id().cast("long").alias("task"), F.struct(F.lit(0).alias(filler), *[F.col(c) for c in carry]).alias("rest"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, rest, size, number, task = [], [], [], 0, 0, 0

        def told() -> pa.RecordBatch:
            lengths = np.array([len(t) for t in texts], dtype=np.int64)
            blob = zstandard.ZstdCompressor(level=1).compress(b" ".join(texts))
            key = np.array([NO_ID if i is None else i for i in ids], dtype=np.int64)
            null = np.array([i is None for i in ids])
            cols = [[(task << 32) | number], [key.tobytes()], [np.packbits(null).tobytes()], [lengths.tobytes()], [blob], [_stream(rest)], [sum(len(t.split()) for t in texts)]]
            kinds = [pa.int64(), *[pa.binary()] * 5, pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["pack", "ids", "nulls", "lengths", "blob", "rest", "words"])

        for batch in batches:
            others = pa.RecordBatch.from_struct_array(batch.column(3)) if carry else None
            for at, (i, t, part) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True)):
                data, task = t.encode("utf-8", "surrogatepass"), part
                if texts and size + len(data) > PACK:
                    yield told()
                    ids, texts, rest, size, number = [], [], [], 0, number + 1
                if carry:
                    rest.append(others.slice(at, 1))
                ids.append(i)
                texts.append(data)
                size += len(data) + 1
        if texts:
            yield told()

    return rows.mapInArrow(run, "pack long, ids binary, nulls binary, lengths binary, blob binary, rest binary, words long")


def _stream(rows: list[pa.RecordBatch]) -> bytes:
    if not rows:
        return b""
    table = pa.Table.from_batches(rows).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def opened(blob: bytes, ids: bytes, lengths: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    return zstandard.ZstdDecompressor().decompress(blob), np.frombuffer(ids, dtype=np.int64), np.frombuffer(lengths, dtype=np.int64)


def anchors(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors."""
    at = words.fits(ANCHOR)
    at = at[np.isin(words.place[at] % PERIOD, COVER)]
    return at, words.runs(ANCHOR, at)


def distinct_anchors(words: Words, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchor hashes of a pack in order, the place of every anchor among them, and whether two documents share one."""
    at, value = anchors(words)
    found, where = np.unique(value, return_inverse=True)
    owner = ids[words.doc[at]]
    low, high = np.full(len(found), NO_ID), np.full(len(found), np.iinfo(np.int64).min)
    np.minimum.at(low, where, owner)
    np.maximum.at(high, where, owner)
    return found, where, low < high


def near_windows(words: Words, shared: np.ndarray) -> np.ndarray:
    """Places of the windows that hold an anchor at one of the places `shared`."""
    if not len(shared):
        return shared
    mark = np.zeros(len(words.doc) + 1, dtype=np.int64)
    np.add.at(mark, np.maximum(shared - (WINDOW - ANCHOR), 0), 1)
    np.add.at(mark, shared + 1, -1)
    fits = words.fits(WINDOW)
    return fits[np.cumsum(mark)[:-1][fits] > 0]


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes >> np.uint64(20)) % np.uint64(buckets)


def dealt(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that sorts by bucket and keeps the order within, and where each bucket that occurs begins."""
    to = bucket_of(hashes, buckets)
    order = np.argsort(to, kind="stable")
    names, begin = np.unique(to[order], return_index=True)
    return order, names.astype(np.int64), begin


def _answers(replies: list[tuple[int, bytes]], order: np.ndarray, names: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The bits of all buckets, in the order of the entries that were sent."""
    out = np.zeros(len(order), dtype=bool)
    if not len(order):
        return out
    size = dict(zip(names.tolist(), zip(begin.tolist(), [*begin[1:].tolist(), len(order)], strict=True), strict=True))
    for bucket, bits in replies:
        lo, hi = size[bucket]
        out[order[lo:hi]] = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=hi - lo).astype(bool)
    return out


def exchange(sent: DataFrame, judge: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """(pack, replies): what the buckets answer, gathered by pack. `judge` gets the entries of a bucket, one row for each pack."""
    told = sent.groupBy("bucket").applyInArrow(judge, "pack long, bucket long, bits binary")
    return told.groupBy("pack").agg(F.collect_list(F.struct("bucket", "bits")).alias("replies"))


def _shared(group: pa.Table) -> pa.Table:
    """Anchors that two packs sent, or that one pack sent as shared by two of its documents."""
    entries = [np.frombuffer(x, dtype=np.uint64) for x in group.column("hashes").to_pylist()]
    many = [np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=len(e)).astype(bool) for x, e in zip(group.column("extra").to_pylist(), entries, strict=True)]
    found, where, times = np.unique(np.concatenate(entries), return_inverse=True, return_counts=True)
    twice = times > 1
    twice[where[np.concatenate(many)]] = True
    return _bits(group, entries, twice[where])


def _smaller(group: pa.Table) -> pa.Table:
    """Windows that a document with a smaller id than any of the pack's has."""
    entries = [np.frombuffer(x, dtype=np.uint64) for x in group.column("hashes").to_pylist()]
    rest = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in group.column("check").to_pylist()])
    least = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in group.column("extra").to_pylist()])
    both = np.concatenate(entries)
    order = np.lexsort((rest, both))
    new = np.concatenate(([True], (both[order][1:] != both[order][:-1]) | (rest[order][1:] != rest[order][:-1])))
    lowest = np.minimum.reduceat(least[order], np.flatnonzero(new))
    answer = np.zeros(len(both), dtype=bool)
    answer[order] = lowest[np.cumsum(new) - 1] < least[order]
    return _bits(group, entries, answer)


def _bits(group: pa.Table, entries: list[np.ndarray], answer: np.ndarray) -> pa.Table:
    ends = np.cumsum([len(e) for e in entries])
    bits = [np.packbits(x).tobytes() for x in np.split(answer, ends[:-1])]
    # Where no bit is set there is nothing to say.
    told = [any(b) for b in bits]
    cols = {"pack": group.column("pack").to_pylist(), "bucket": group.column("bucket").to_pylist(), "bits": bits}
    return pa.table({k: pa.array(list(compress(v, told)), pa.binary() if k == "bits" else pa.int64()) for k, v in cols.items()})


def distinct_windows(words: Words, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows of a pack: hash, check, smallest id; and the place of every window among them."""
    value = words.runs(WINDOW, at)
    rest = (run_hashes(mix(words.hash, 3), at, at + WINDOW) >> np.uint64(32)).astype(np.uint32)
    order = np.lexsort((rest, value))
    new = np.concatenate(([True], (value[order][1:] != value[order][:-1]) | (rest[order][1:] != rest[order][:-1]))) if len(at) else np.zeros(0, bool)
    where = np.empty(len(at), dtype=np.int64)
    where[order] = np.cumsum(new) - 1
    least = np.full(int(new.sum()), NO_ID)
    np.minimum.at(least, where, ids[words.doc[at]])
    return value[order][new], rest[order][new], least, where


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", texts: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row.

    With `texts`, the rows of `docs` instead: words are taken out of their texts, what is left being joined by blanks, texts
    that lose nothing stay as they are, and rows that lose their last word go.
    """
    carry = [c for c in docs.columns if c not in (doc_id, text)] if texts else []
    packed = settle(packs(docs, doc_id, text, carry), "packs")
    total = packed.agg(F.sum("words")).first()[0] or 0
    buckets = max(16, int(total * len(COVER) / PERIOD) // BUCKET)

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                blob, ids, lengths = opened(row["blob"], row["ids"], row["lengths"])
                found, _, many = distinct_anchors(Words(blob, lengths), ids)
                order, names, begin = dealt(found, buckets)
                if len(names):
                    hashes = [x.tobytes() for x in np.split(found[order], begin[1:])]
                    extra = [np.packbits(x).tobytes() for x in np.split(many[order], begin[1:])]
                    yield pa.RecordBatch.from_pydict({"bucket": names, "pack": np.full(len(names), row["pack"]), "hashes": hashes, "extra": extra})

    source = packed.select("pack", "ids", "lengths", "blob")
    sent = source.mapInArrow(send_anchors, "bucket long, pack long, hashes binary, extra binary")
    shared = exchange(sent, _shared)

    def places(row: dict) -> tuple[Words, np.ndarray, np.ndarray, bytes, np.ndarray]:
        blob, ids, lengths = opened(row["blob"], row["ids"], row["lengths"])
        words = Words(blob, lengths)
        found, where, _ = distinct_anchors(words, ids)
        hit = _answers([(r["bucket"], r["bits"]) for r in row["shared"] or []], *dealt(found, buckets))
        at, _ = anchors(words)
        return words, ids, near_windows(words, at[hit[where]]), blob, lengths

    def send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, ids, at, _, _ = places(row)
                value, rest, least, _ = distinct_windows(words, ids, at)
                order, names, begin = dealt(value, buckets)
                if len(names):
                    cut = [np.split(x[order], begin[1:]) for x in (value, rest, least)]
                    hashes, check, extra = ([y.tobytes() for y in x] for x in cut)
                    yield pa.RecordBatch.from_pydict({"bucket": names, "pack": np.full(len(names), row["pack"]), "hashes": hashes, "check": check, "extra": extra})

    shared = settle(shared.withColumnRenamed("replies", "shared"), "shared-anchors")
    with_shared = source.join(shared, "pack", "left")
    sent = with_shared.mapInArrow(send_windows, "bucket long, pack long, hashes binary, check binary, extra binary")
    smaller = exchange(sent, _smaller).withColumnRenamed("replies", "smaller")
    final = packed.drop("words").join(shared, "pack", "left").join(smaller, "pack", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, ids, at, blob, lengths = places(row)
                value, _, least, where = distinct_windows(words, ids, at)
                hit = _answers([(r["bucket"], r["bits"]) for r in row["smaller"] or []], *dealt(value, buckets))
                gone = hit[where] | (ids[words.doc[at]] > least[where]) if len(at) else np.zeros(0, bool)
                mark = np.zeros(len(words.doc) + 1, dtype=np.int64)
                np.add.at(mark, at[gone], 1)
                np.add.at(mark, at[gone] + WINDOW, -1)
                keep = np.cumsum(mark)[:-1] == 0
                out: dict[str, list] = {"doc_id": [], "n_words": [], "n_removed": [], "kept_sha256": []}
                left: list[str | None] = []
                null = np.unpackbits(np.frombuffer(row["nulls"], dtype=np.uint8), count=len(ids)).astype(bool)
                begin = 0
                for i, length in enumerate(lengths.tolist()):
                    all_words = blob[begin : begin + length].split()
                    begin += length + 1
                    mine = keep[words.first[i] : words.first[i] + len(all_words)]
                    kept = b" ".join(all_words if mine.all() else compress(all_words, mine.tolist()))
                    out["doc_id"].append(None if null[i] else int(ids[i]))
                    out["n_words"].append(len(all_words))
                    out["n_removed"].append(int((~mine).sum()))
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                    left.append((kept if out["n_removed"][-1] else blob[begin - length - 1 : begin - 1]).decode("utf-8", "surrogatepass"))
                if texts:
                    rest = pa.ipc.open_stream(row["rest"]).read_all() if carry else None
                    cols = {c: rest.column(c) for c in carry} | {doc_id: pa.array(out["doc_id"], pa.int64()), text: pa.array(left, pa.string())}
                    stay = [n == 0 or gone < n for n, gone in zip(out["n_words"], out["n_removed"], strict=True)]
                    yield from pa.table({c: cols[c] for c in docs_columns}).filter(pa.array(stay)).to_batches()
                else:
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    docs_columns = docs.columns
    if texts:
        return final.mapInArrow(cut, docs.withColumn(doc_id, F.col(doc_id).cast("long")).schema)
    return final.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")
