"""Folders that tasks list, read and write themselves, by path or URI.

Local paths and ``file:`` URIs are used directly; other URIs through the file system
pyarrow has for them. Every executor must be able to reach them.
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote, urlsplit


class LocalFolders:
    """Directories of this machine or of a mounted shared file system."""

    def __init__(self, base: str):
        self.base = base

    def place(self, path: str) -> str:
        return os.path.join(self.base, path) if path else self.base

    def entries(self, path: str) -> Iterator[tuple[str, bool, int]]:
        """Name, whether a directory, and size of every regular entry; links are none."""
        with os.scandir(self.place(path)) as found:
            for entry in found:
                info = entry.stat(follow_symlinks=False)
                kind = info.st_mode & 0o170000
                if kind in (0o040000, 0o100000):
                    yield entry.name, kind == 0o040000, info.st_size

    def kind(self, path: str) -> tuple[bool, int] | None:
        """Whether a directory, and the size; nothing for other kinds of entries."""
        info = os.lstat(self.place(path))
        kind = info.st_mode & 0o170000
        return (kind == 0o040000, info.st_size) if kind in (0o040000, 0o100000) else None

    def read(self, path: str) -> bytes:
        with open(self.place(path), "rb") as handle:
            return handle.read()

    def write(self, path: str, data: bytes) -> None:
        target = self.place(path)
        try:
            handle = open(target, "wb")
        except FileNotFoundError:
            os.makedirs(os.path.dirname(target), exist_ok=True)
            handle = open(target, "wb")
        with handle:
            handle.write(data)

    def remove(self, path: str) -> None:
        shutil.rmtree(self.place(path), ignore_errors=True)


class RemoteFolders:
    """Directories of a store pyarrow has a file system for."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.fs, self.base = fs.FileSystem.from_uri(uri)

    def place(self, path: str) -> str:
        return f"{self.base.rstrip('/')}/{path}" if path else self.base

    def entries(self, path: str) -> Iterator[tuple[str, bool, int]]:
        from pyarrow import fs

        for info in self.fs.get_file_info(fs.FileSelector(self.place(path))):
            if info.type in (fs.FileType.File, fs.FileType.Directory):
                yield info.base_name, info.type == fs.FileType.Directory, info.size or 0

    def kind(self, path: str) -> tuple[bool, int] | None:
        from pyarrow import fs

        info = self.fs.get_file_info([self.place(path)])[0]
        known = info.type in (fs.FileType.File, fs.FileType.Directory)
        return (info.type == fs.FileType.Directory, info.size or 0) if known else None

    def read(self, path: str) -> bytes:
        with self.fs.open_input_stream(self.place(path)) as stream:
            return stream.read()

    def write(self, path: str, data: bytes) -> None:
        self.fs.create_dir(self.place(path).rpartition("/")[0], recursive=True)
        with self.fs.open_output_stream(self.place(path)) as stream:
            stream.write(data)

    def remove(self, path: str) -> None:
        if self.kind(path):
            self.fs.delete_dir(self.place(path))


@lru_cache(maxsize=4096)
def folders(root: str) -> LocalFolders | RemoteFolders:
    scheme = urlsplit(root).scheme
    if scheme in ("", "file"):
        return LocalFolders(unquote(urlsplit(root).path) if scheme else root)
    return RemoteFolders(root)
