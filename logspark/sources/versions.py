"""Outputs that are replaced in one step, for readers that may come at any time.

Every run writes a directory of its own below the output's path and, when that is
complete, a small numbered file that names it. A reader takes the highest number whose
file is complete, so it sees the earlier output until the one write that publishes the
new one, and never a part of either, also in stores where a rename is a copy. The
version before the current one is kept for those that still read it.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

POINTERS, END = "_versions", "end"


def file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def delete(spark: SparkSession, path: str) -> None:
    fs, to_path = file_system(spark, path)
    fs.delete(to_path(path), True)


def _versions(spark: SparkSession, path: str) -> list[tuple[int, str | None]]:
    """(number, directory) of all pointers, latest first; no directory where a pointer is not complete."""
    fs, to_path = file_system(spark, path)
    pointers = to_path(f"{path}/{POINTERS}")
    if not fs.exists(pointers):
        return []
    out = []
    for status in fs.listStatus(pointers):
        name = status.getPath().getName()
        if name.isdigit():
            stream = fs.open(status.getPath())
            try:
                said = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
            finally:
                stream.close()
            directory, _, end = said.partition("\n")
            out.append((int(name), directory if end == END else None))
    return sorted(out, reverse=True)


def current(spark: SparkSession, path: str) -> str | None:
    """The directory of the published output at ``path``, None before the first."""
    path = path.rstrip("/")
    return next((f"{path}/{d}" for _, d in _versions(spark, path) if d), None)


@contextmanager
def published(spark: SparkSession, path: str):
    """Yield a directory to write to; readers of :func:`current` see it if the block succeeds."""
    path = path.rstrip("/")
    fs, to_path = file_system(spark, path)
    name = f"version-{uuid.uuid4().hex}"
    try:
        yield f"{path}/{name}"
    except BaseException:
        fs.delete(to_path(f"{path}/{name}"), True)
        raise
    earlier = _versions(spark, path)
    _point(spark, path, name, earlier[0][0] + 1 if earlier else 1)
    complete = [d for _, d in earlier if d]
    for old in complete[1:]:  # their readers began two versions ago
        fs.delete(to_path(f"{path}/{old}"), True)
    for number, d in earlier:
        if d in complete[1:]:
            fs.delete(to_path(f"{path}/{POINTERS}/{number:012d}"), False)


def _point(spark: SparkSession, path: str, name: str, number: int) -> None:
    """Write the pointer; its last word tells readers that all of it is there."""
    fs, to_path = file_system(spark, path)
    while fs.exists(to_path(f"{path}/{POINTERS}/{number:012d}")):  # another run was faster
        number += 1
    stream = fs.create(to_path(f"{path}/{POINTERS}/{number:012d}"), False)
    try:
        stream.write(f"{name}\n{END}".encode())
    finally:
        stream.close()
