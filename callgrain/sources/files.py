"""Opening capture files, by path or URI: plain, zstd, and zstd-compressed archives; and the folder that a cluster shares."""

from __future__ import annotations

import contextlib
import io
import os
import re
import tarfile
import tempfile
from collections.abc import Iterator

from pyspark.sql import SparkSession

ZSTD = b"\x28\xb5\x2f\xfd"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, a folder in the temporary one of the
    machine is set if the master is local, as in tests; on a cluster that would lose rows, so there it is an error."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="callgrain-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _placed(path: str):
    """The file system of a URI and the path in it; None for a plain path."""
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]+:/", path):
        return None, path
    if path.startswith("file:"):
        return None, re.sub(r"^file:/+", "/", path)
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@contextlib.contextmanager
def written(path: str) -> Iterator:
    """A file to write, compressed if its name ends with .zst; folders are made."""
    system, at = _placed(path)
    if system is None:
        os.makedirs(os.path.dirname(at), exist_ok=True)
        raw = open(at, "wb")
    else:
        system.create_dir(at.rsplit("/", 1)[0], recursive=True)
        raw = system.open_output_stream(at)
    with raw:
        if path.endswith(".zst"):
            import zstandard

            with zstandard.ZstdCompressor().stream_writer(raw, closefd=False) as out:
                yield out
        else:
            yield raw


@contextlib.contextmanager
def opened(path: str) -> Iterator:
    """A byte stream; compressed by suffix or by its first bytes."""
    system, at = _placed(path)
    with io.BufferedReader(open(at, "rb", buffering=0) if system is None else system.open_input_file(at), 1 << 20) as raw:
        magic = raw.peek(4)[:4]
        if path.endswith(".zst") or magic == ZSTD:
            import zstandard

            with zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as stream:
                yield io.BufferedReader(stream, 1 << 20)
        else:
            yield raw


def capture_files(path: str | list[str], workdir: str) -> list[str]:
    """The packet captures of a path in order: the file itself, or the members of a .tar.zst, extracted under workdir; those of a list one after
    the other. Members that would leave workdir are refused. workdir must be a folder that the driver and all executors share."""
    if isinstance(path, list):
        return [f for k, p in enumerate(path) for f in capture_files(p, os.path.join(workdir, str(k)))]
    if not path.endswith((".tar.zst", ".tzst")):
        return [path]
    with opened(path) as stream, tarfile.open(fileobj=stream, mode="r|") as archive:
        archive.extractall(workdir, filter="data")
    found = [os.path.join(d, f) for d, _, files in os.walk(workdir) for f in files if f.endswith(".pcap")]
    return sorted(found)
