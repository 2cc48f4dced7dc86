"""Reading files of users as a Spark data source: every file is scanned once, by its own header.

A plain CSV scan applies the header of one file to all. Here an input partition holds whole files of some 64 MB together, a file
is read as a stream, and rows leave in Arrow batches, so memory is bounded by a batch and not by a file.
"""

from __future__ import annotations

import csv
import io
import json
import os
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "meter_user_files"
WANTED = ("timestamp", "energy_consumption")
PACK_BYTES = 64 * 1024 * 1024
BATCH_ROWS = 8192

ROWS = pa.schema([
    ("file", pa.string()), ("header", pa.list_(pa.string())), *[(c, pa.string()) for c in WANTED],
])


def locate(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":" in path.split("/", 1)[0] else os.path.abspath(path))


def _hidden(path: str, base: str) -> bool:
    return any(part.startswith(("_", ".")) and "=" not in part for part in path[len(base):].split("/"))


def list_files(path: str) -> list[tuple[str, int]]:
    """Files below a folder, the file itself, or the files of one folder that match a pattern in the last part of the path."""
    system, base = locate(path)
    folder, _, last = base.rstrip("/").rpartition("/")
    if any(c in last for c in "*?["):
        named = [i for i in system.get_file_info(fs.FileSelector(folder)) if fnmatchcase(i.base_name, last)]
        found = [i for i in named if i.is_file]
        for sub in (i for i in named if not i.is_file):
            found += [i for i in system.get_file_info(fs.FileSelector(sub.path, recursive=True)) if i.is_file]
        base = folder
    else:
        info = system.get_file_info(base)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        if info.is_file:
            return [(info.path, info.size or 0)]
        found = [i for i in system.get_file_info(fs.FileSelector(base, recursive=True)) if i.is_file]
    return sorted((i.path, i.size or 0) for i in found if not _hidden(i.path, base))


def parse(stream: io.TextIOBase) -> Iterator[tuple[list[str], list[str | None]]]:
    """Names of the header and the wanted cells of every row that has any text. Quoted cells may hold commas and line ends."""
    csv.field_size_limit(2**31 - 1)
    header: list[str] | None = None
    for cells in csv.reader(stream):
        if not any(c.strip() for c in cells):
            continue
        if header is None:
            header = [c.strip() for c in cells]
            places = [header.index(c) if c in header else None for c in WANTED]
            names = [c for c in header if c]
            continue
        yield names, [cells[p] if p is not None and p < len(cells) else None for p in places]


class Files(InputPartition):
    def __init__(self, source: str, paths: list[str]):
        self.source, self.paths = source, paths


class UserFileReader(DataSourceReader):
    def __init__(self, sources: list[str]):
        self.sources = sources

    def partitions(self) -> list[Files]:
        packs = []
        for source in self.sources:
            held = None
            for path, size in list_files(source):
                if held is None or held + size > PACK_BYTES:
                    packs.append(Files(source, []))
                    held = 0
                packs[-1].paths.append(path)
                held += size
        return packs or [Files(self.sources[0], [])]  # Spark reads one partition even when there is none

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = locate(partition.source)
        columns: list[list] = [[] for _ in ROWS.names]

        def batch() -> pa.RecordBatch:
            arrays = [pa.array(values, kind) for values, kind in zip(columns, ROWS.types)]
            for values in columns:
                values.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=ROWS)

        for path in partition.paths:
            with system.open_input_stream(path) as raw:
                text = io.TextIOWrapper(raw, encoding="utf-8-sig", errors="replace", newline="")
                for names, cells in parse(text):
                    for values, value in zip(columns, (path, names, *cells)):
                        values.append(value)
                    if len(columns[0]) == BATCH_ROWS:
                        yield batch()
        if columns[0]:
            yield batch()


class UserFiles(DataSource):
    """Option `paths`: a JSON list of folders, files or patterns. Files packed by size; a partition is read again as a whole."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file string, header array<string>, " + ", ".join(f"{c} string" for c in WANTED)

    def reader(self, schema) -> DataSourceReader:
        return UserFileReader(json.loads(self.options["paths"]))
