"""Raw files in the shared folder, written and read by tasks.

A task writes a file of its own (a fresh name for every attempt) and reports it
in its output row. The rows are written as a manifest table; only files that a
manifest names count, so a retried or speculative task leaves at most an
unnamed file behind and never a wrong one.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO

from pyarrow import fs


def _open(uri: str):
    return fs.FileSystem.from_uri(uri)


@contextmanager
def create(uri: str) -> Iterator[BinaryIO]:
    """Open a file for writing; its folder is made."""
    store, path = _open(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path, compression=None) as out:
        yield out


@contextmanager
def opened(uri: str) -> Iterator[BinaryIO]:
    """Open a file for seeking reads."""
    store, path = _open(uri)
    with store.open_input_file(path) as src:
        yield src
