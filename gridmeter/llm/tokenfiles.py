"""Token ids of documents in ascending id order, in files of coded and checksummed blocks.

A file holds: 8 bytes `IDBLOCK2`; the sizes of its index (bytes, unsigned 64 bit) and of its blocks (number, 32 bit); the
index, compressed, with its CRC-32: ids (64 bit), whether they are null (8 bit), ids per document (64 bit); then for each
block the number of ids, the coded bytes and their CRC-32 (32 bit each), and the coded bytes. All numbers are little-endian.
A document may run over blocks, but not over files. The blocks of a file share a model and are decoded side by side (see
`rangecoder`); a file is decoded alone.

Null texts are empty ones and hold the end id alone. Null ids come first, rows that repeat an id by their text. An empty
table leaves no files and an empty result. Extra columns are left out. Files get names of their own, so a task that runs
twice harms nothing: readers follow the manifest that the finished tasks returned.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmeter.llm import files, rangecoder
from gridmeter.llm.common import settle
from gridmeter.llm.tokens import encoder, grouped

MAGIC = b"IDBLOCK2"
#: Ids of a block: a file has as many as the coder has lanes.
BLOCK = 256
#: Ids of a file, about; a document is never cut.
FILE = 1 << 20
END = 2


def to_bytes(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A file's content."""
    index = np.array([0 if i is None else i for i in doc_ids], dtype="<i8").tobytes()
    index += np.array([i is None for i in doc_ids], dtype=np.uint8).tobytes() + counts.astype("<u8").tobytes()
    index = zlib.compress(index)
    blocks = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
    out = [MAGIC, struct.pack("<QIII", len(index), len(doc_ids), len(blocks), zlib.crc32(index)), index]
    for block, coded in zip(blocks, rangecoder.encode(blocks), strict=True):
        out += [struct.pack("<III", len(block), len(coded), zlib.crc32(coded)), coded]
    return b"".join(out)


def from_bytes(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Ids of the documents, how many ids each has, and all ids one after another; ValueError if a checksum or size is wrong."""
    if data[:8] != MAGIC:
        raise ValueError("not a file of token blocks")
    size, docs, n, check = struct.unpack_from("<QIII", data, 8)
    at = 28 + size
    if zlib.crc32(data[28:at]) != check:
        raise ValueError("index damaged")
    index = zlib.decompress(data[28:at])
    doc_ids, null = np.frombuffer(index, "<i8", docs), np.frombuffer(index, np.uint8, docs, 8 * docs)
    counts = np.frombuffer(index, "<u8", docs, 9 * docs).astype(np.int64)
    coded, sizes = [], []
    for i in range(n):
        count, length, check = struct.unpack_from("<III", data, at)
        coded.append(data[at + 12 : at + 12 + length])
        sizes.append(count)
        if len(coded[-1]) != length or zlib.crc32(coded[-1]) != check:
            raise ValueError(f"block {i} damaged")
        at += 12 + length
    ids = np.concatenate([np.zeros(0, np.uint32), *rangecoder.decode(coded, sizes)])
    if at != len(data) or len(ids) != counts.sum():
        raise ValueError("sizes do not agree")
    return [None if z else int(i) for i, z in zip(doc_ids, null, strict=True)], counts, ids


def write(docs: DataFrame, path: str, end: int = END, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Write all documents and return the manifest: (part, file, uri, n_docs, n_ids), files in order of (part, file)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    folder = files.new_folder(docs.sparkSession, "token-files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        doc_ids, counts, ids, number, held = [], [], [], 0, 0

        def told() -> pa.RecordBatch:
            data = to_bytes(doc_ids, np.concatenate(counts), np.concatenate(ids))
            uri = files.write(folder, f"{part:06d}-{number:06d}", ".ids", data)
            row = {"part": [part], "file": [number], "uri": [uri], "n_docs": [len(doc_ids)], "n_ids": [held]}
            return pa.RecordBatch.from_pydict(row)

        for keys, texts in grouped(batches):
            found, count = encoder(path).encode(texts, end)
            ends, begin, names = np.cumsum(count), 0, keys.to_pylist()
            while begin < len(count):
                before = int(ends[begin - 1]) if begin else 0
                # As many documents as fit, one at least if the file is empty.
                stop = int(np.searchsorted(ends, before + FILE - held, side="right"))
                stop = max(stop, begin + (held == 0))
                if stop > begin:
                    doc_ids += names[begin:stop]
                    counts.append(count[begin:stop])
                    ids.append(found[before : int(ends[stop - 1])])
                    held += len(ids[-1])
                if stop < len(count):
                    yield told()
                    doc_ids, counts, ids, number, held = [], [], [], number + 1, 0
                begin = stop
        if doc_ids:
            yield told()

    return settle(rows.mapInArrow(run, "part long, file long, uri string, n_docs long, n_ids long"), "token-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    # Ids before each part, then before each file of it: the first window has one row for each part.
    per_part = manifest.groupBy("part").agg(F.sum("n_ids").alias("in_part"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = per_part.select("part", F.coalesce(F.sum("in_part").over(earlier), F.lit(0).cast("long")).alias("before_part"))
    earlier = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0).cast("long"))).join(per_part, "part")
    placed = placed.select("uri", (F.col("before") + F.col("before_part")).alias("first"))
    # One file for a task where that is few thousand tasks; their rows are too small for Spark to size tasks by.
    placed = placed.repartition(min(max(manifest.count(), 1), 10_000), "uri")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                doc_ids, counts, ids = from_bytes(files.read(row["uri"]))
                data, ends = ids.astype("<u4").tobytes(), np.cumsum(counts)
                crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                cols = [pa.array(doc_ids, pa.int64()), pa.array(row["first"] + ends - counts), pa.array(counts), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
