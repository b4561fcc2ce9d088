"""Files that Python workers write in a folder that all executors share."""

from __future__ import annotations

import os
import uuid

import pyarrow.fs as pafs


def _resolve(folder: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in folder and not folder.startswith("file:"):
        return pafs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return pafs.FileSystem.from_uri(folder)


class Shard:
    """One file, written beside its place and moved there when complete.

    A task that fails or runs twice leaves no partial file under the final name;
    attempts of one task write the same content.
    """

    def __init__(self, folder: str, name: str) -> None:
        self.fs, root = _resolve(folder)
        self.fs.create_dir(root, recursive=True)
        self.final = f"{root}/{name}"
        self.partial = f"{root}/.{name}.{os.getpid()}-{uuid.uuid4().hex[:8]}"
        self.sink = self.fs.open_output_stream(self.partial)

    def commit(self) -> str:
        if not self.sink.closed:
            self.sink.close()
        self.fs.move(self.partial, self.final)
        return self.final

    def abort(self) -> None:
        if not self.sink.closed:
            self.sink.close()
        self.fs.delete_file(self.partial)


def local_path(folder: str) -> str:
    """Path of a ``file:`` folder, for memory mapping."""
    fs, path = _resolve(folder)
    if not isinstance(fs, pafs.LocalFileSystem):
        raise ValueError("memory mapping needs a folder in the local file tree")
    return path
