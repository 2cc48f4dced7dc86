"""Whole files in the shared folder, written and read by tasks through any file system that pyarrow knows."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

from gridmeter.llm.common import shared_folder


def new_folder(spark: SparkSession, name: str) -> str:
    folder = shared_folder(spark, name)
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    return folder


def write(folder: str, stem: str, suffix: str, data: bytes) -> str:
    """Write a file under a name of its own: an attempt that is repeated leaves another file, and only the path that the
    finished task returns is read."""
    uri = f"{folder}/{stem}-{uuid.uuid4().hex}{suffix}"
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_output_stream(path) as out:
        out.write(data)
    return uri


def read(uri: str) -> bytes:
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_stream(path) as stream:
        return stream.read()
