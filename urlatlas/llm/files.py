"""Binary files in shared storage, written and read by tasks."""

from __future__ import annotations

import uuid
from typing import BinaryIO

from pyarrow import fs


def place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or absolute path (local, or any store Arrow can open)."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace(":/", ":///", 1))


def create(folder: str, prefix: str, suffix: str) -> tuple[str, BinaryIO]:
    """A new file of a unique name and its open stream.

    Every task attempt writes files of its own; the table of files that
    Spark commits names those of the attempts that count, so retried or
    doubled tasks leave nothing half-written in a result.
    """
    store, path = place(folder)
    store.create_dir(path, recursive=True)
    name = f"{prefix}-{uuid.uuid4().hex}{suffix}"
    return f"{folder}/{name}", store.open_output_stream(f"{path}/{name}")


def open_stream(path: str) -> BinaryIO:
    store, at = place(path)
    return store.open_input_stream(at, buffer_size=1 << 20)


def open_file(path: str) -> BinaryIO:
    store, at = place(path)
    return store.open_input_file(at)
