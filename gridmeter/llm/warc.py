"""WARC 1.1 archives compressed record by record with Zstandard and a shared dictionary.

An archive is a skippable frame (magic 0x184D2A5D) with the dictionary, then one frame for each record. The dictionary is
trained on a sample of at most about `SAMPLE` payloads, chosen by hash; everything is written whatever the sample.

Of records whose payloads of 100 bytes or more are equal, the one with the smallest page id is a response and the others are
revisits that refer to it and hold no payload. Pages without an id are always responses, as are pages that share the
smallest id. Null payloads are empty. An empty table leaves no archives. Extra columns are left out.

Readers check the frame, the version line, the named fields, Content-Length, the end of the record, and for responses the
payload's digest; a fault raises ValueError and names the archive.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmeter.llm import files
from gridmeter.llm.common import settle

MAGIC = 0x184D2A5D
SAMPLE, DICTIONARY = 400, 64 << 10
#: Payload bytes of an archive, about.
ARCHIVE = 16 << 20
LEAST = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def train(samples: list[bytes]) -> bytes:
    """A dictionary, or none if there is too little to learn from."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One record; `payload` is left out of a revisit."""
    kind, body = ("response", payload) if refers_to is None else ("revisit", b"")
    fields = [("WARC-Type", kind), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(size))]
    if page_id is not None:
        fields.append(("WARC-Record-ID", f"<urn:page:{page_id}>"))
    if url is not None:
        # A line end would end the field.
        fields.append(("WARC-Target-URI", url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    fields.append(("Content-Length", str(len(body))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and content of a record, checked."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(line.partition(": ")[::2] for line in lines[1:])
    if not gap or lines[0] != "WARC/1.1" or not {"WARC-Type", "WARC-Payload-Digest", "X-Payload-Length", "Content-Length"} <= fields.keys():
        raise ValueError("header incomplete")
    length = int(fields["Content-Length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("length differs from Content-Length")
    body = rest[:length]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response":
        if hashlib.sha256(body).hexdigest() != digest or length != int(fields["X-Payload-Length"]):
            raise ValueError("payload differs from its digest")
    elif fields["WARC-Type"] != "revisit" or body or "WARC-Refers-To" not in fields:
        raise ValueError("neither a response nor a revisit")
    return fields, body


def archive(records: list[bytes], dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=3).compress(dictionary)
    trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    frames = zstandard.ZstdCompressor(level=3, dict_data=trained, write_content_size=True, write_checksum=True)
    return b"".join([struct.pack("<II", MAGIC, len(packed)), packed, *(frames.compress(r) for r in records)])


def records(data: bytes) -> Iterator[bytes]:
    """Records of an archive, one from each frame."""
    magic, size = struct.unpack_from("<II", data) if len(data) >= 8 else (0, 0)
    if magic != MAGIC or len(data) < 8 + size:
        raise ValueError("no leading dictionary frame")
    dictionary = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]) if size else b""
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    rest = memoryview(data)[8 + size :]
    while len(rest):
        frame = reader.decompressobj()
        yield frame.decompress(rest)
        if not frame.eof:
            raise ValueError("frame cut short")
        rest = rest[len(rest) - len(frame.unused_data) :]


def _number(field: str | None) -> int | None:
    return int(field.removeprefix("<urn:page:").removesuffix(">")) if field else None


def with_first(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, size, refers_to): refers_to is set for revisits."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    # Partial minima in the scan tasks; only digests that occur again are joined, without their payloads.
    again = rows.filter(F.col("size") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    again = again.filter("n > 1").drop("n")
    rows = rows.join(again, "digest", "left")
    refers = F.when((F.col("size") >= LEAST) & (F.col("first") < F.col("page_id")), F.col("first"))
    return rows.select("page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), "digest", "size", refers.alias("refers_to"))


def write(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write all pages and return the manifest: (uri, n_records)."""
    n = pages.count()
    chosen = pages.filter(F.pmod(F.xxhash64(F.lit(5), F.col(page_id)), F.lit(1 << 30)) < (1 << 30) * min(1.0, SAMPLE / max(n, 1)))
    # The beginnings of payloads are all a dictionary can use; no page is cut in the archives.
    samples = [bytes(r[0]) for r in chosen.select(F.substring(F.coalesce(F.col(html), F.lit("")), 1, 16384).cast("binary")).collect()]
    dictionary = train(sorted(s for s in samples if s))
    folder = files.new_folder(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def told() -> pa.RecordBatch:
            uri = files.write(folder, f"{part:06d}-{number:06d}", ".warc.zst", archive(held, dictionary))
            return pa.RecordBatch.from_pydict({"uri": [uri], "n_records": [len(held)]})

        for batch in batches:
            for row in batch.to_pylist():
                if held and size + row["size"] > ARCHIVE:
                    yield told()
                    number, held, size = number + 1, [], 0
                held.append(record(row["page_id"], row["url"], row["payload"] or b"", row["digest"], row["size"], row["refers_to"]))
                size += len(held[-1])
        if held:
            yield told()

    return settle(with_first(pages, page_id, url, html).mapInArrow(run, "uri string, n_records long"), "warc-manifest")


def read(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record; with `payloads` also url and payload."""
    rows = manifest.repartition(min(max(manifest.count(), 1), 10_000), "uri")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out: list[dict] = []
                try:
                    for data in records(files.read(row["uri"])):
                        fields, body = parsed(data)
                        one = {
                            "page_id": _number(fields.get("WARC-Record-ID")), "payload_bytes": int(fields["X-Payload-Length"]),
                            "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"), "record_type": fields["WARC-Type"],
                            "refers_to": _number(fields.get("WARC-Refers-To")),
                        }
                        if payloads:
                            url = fields.get("WARC-Target-URI")
                            one["url"] = url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                            one["payload"] = body
                        out.append(one)
                except (ValueError, zstandard.ZstdError) as error:
                    raise ValueError(f"{row['uri']}: {error}") from error
                if len(out) != row["n_records"]:
                    raise ValueError(f"{row['uri']}: {len(out)} records instead of {row['n_records']}")
                yield pa.RecordBatch.from_pylist(out, schema=kinds)

    kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    if payloads:
        kinds = kinds.append(pa.field("url", pa.string())).append(pa.field("payload", pa.binary()))
        schema += ", url string, payload binary"
    return rows.mapInArrow(run, schema)
