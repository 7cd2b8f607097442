"""Files by URI from Python: in folders that all machines see, and in the stores that Arrow opens.

Paths are written as Hadoop writes them (``file:/folder/name``). A scheme that Arrow does not open is refused when a path is first looked at,
with the schemes that are.
"""

from __future__ import annotations

import os
import re
import stat as modes
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from typing import BinaryIO

from pyarrow import fs

#: Hadoop's names of stores that Arrow knows under another one (fixed values).
SAME_STORE = {"s3a": "s3", "s3n": "s3", "gs": "gs", "s3": "s3", "hdfs": "hdfs", "viewfs": "viewfs", "abfs": "abfs", "abfss": "abfss"}
#: Names of a folder that are held and sorted at a time.
SORTED = 1 << 16


@dataclass(frozen=True)
class Found:
    """A file's path and length (None if it cannot be told)."""

    path: str
    length: int | None


def local_path(uri: str) -> str | None:
    """The path of a URI in the machines' own name space, None for one in another store."""
    if uri.startswith("file:"):
        rest = uri[5:]
        return "/" + rest.lstrip("/") if rest.startswith("/") else rest
    scheme, mark, _ = uri.partition("://")
    return None if mark and "/" not in scheme else uri


def local_uri(path: str) -> str:
    return "file:" + os.path.abspath(path)


def remote(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a URI, and the path in it."""
    scheme, _, rest = uri.partition("://")
    if scheme not in SAME_STORE:
        raise ValueError(f"no store opens {scheme}: ({', '.join(['file', *SAME_STORE])} are known)")
    return fs.FileSystem.from_uri(f"{SAME_STORE[scheme]}://{rest}")


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a URI, and the path in it."""
    path = local_path(uri)
    return (fs.LocalFileSystem(), os.path.abspath(path)) if path is not None else remote(uri)


def check(uri: str) -> None:
    """Raise where no store opens the scheme of ``uri``."""
    scheme, mark, _ = uri.partition("://")
    if local_path(uri) is None and mark and scheme not in SAME_STORE:
        raise ValueError(f"no store opens {scheme}: ({', '.join(['file', *SAME_STORE])} are known)")


def children(uri: str, wanted: re.Pattern | None = None, lengths: bool = True) -> Iterator[Found]:
    """The files right in a folder; the file itself if it is one; itself without a length if there is nothing. ``wanted``: of files in a folder of the machines,
    only those whose names match; without ``lengths`` those are not looked at. Such a folder streams by, in the order of names within every SORTED."""
    path = local_path(uri)
    if path is not None:
        if not os.path.isdir(path):
            yield Found(local_uri(path), _length(path))
            return
        folder = os.path.abspath(path)
        with os.scandir(folder) as entries:
            names = (e.name for e in entries if (wanted is None or wanted.match(e.name)) and not _is_folder(e))
            while held := sorted(islice(names, SORTED)):
                for name in held:
                    inner = os.path.join(folder, name)
                    yield Found(f"file:{inner}", _length(inner) if lengths else None)
        return
    store, inner = remote(uri)
    info = store.get_file_info(inner)
    prefix = uri[: len(uri) - len(inner)] if uri.endswith(inner) else uri.partition("://")[0] + "://"
    if info.type == fs.FileType.Directory:
        for i in store.get_file_info(fs.FileSelector(inner)):
            if i.type == fs.FileType.File:
                yield Found(prefix + i.path, i.size)
    else:
        yield Found(uri, info.size if info.type == fs.FileType.File else None)


def _is_folder(entry: os.DirEntry) -> bool:
    try:
        return entry.is_dir()
    except OSError:
        return False


def file_length(uri: str) -> int | None:
    """The length of a file of the machines, None if it cannot be told."""
    return _length(local_path(uri))


def _length(path: str) -> int | None:
    try:
        found = os.stat(path)
        return found.st_size if modes.S_ISREG(found.st_mode) else None
    except OSError:
        return None


def open_read(uri: str) -> BinaryIO:
    """A file to read and to seek in."""
    path = local_path(uri)
    if path is not None:
        return open(path, "rb", buffering=0)
    store, inner = remote(uri)
    return store.open_input_file(inner)


def read_range(handle: BinaryIO, start: int, size: int) -> bytes:
    """Up to ``size`` bytes from ``start`` on."""
    handle.seek(start)
    parts, left = [], size
    while left:
        part = handle.read(left)
        if not part:
            break
        parts.append(part)
        left -= len(part)
    return b"".join(parts)


def replace_file(uri: str, data: bytes, attempt: str) -> None:
    """Put a file in place of what is there. It is written under a name of the attempt's own first, so a lost or repeated attempt leaves no
    half file; where a store does not rename over a file, the old one keeps another name until the new one is there."""
    path = local_path(uri)
    if path is not None:
        with open(f"{path}.{attempt}.tmp", "wb") as out:
            out.write(data)
        os.replace(f"{path}.{attempt}.tmp", path)
        return
    store, inner = remote(uri)
    with store.open_output_stream(f"{inner}.{attempt}.tmp") as out:
        out.write(data)
    old = f"{inner}.{attempt}.old"
    there = store.get_file_info(inner).type != fs.FileType.NotFound
    if there:
        store.move(inner, old)
    store.move(f"{inner}.{attempt}.tmp", inner)
    if there:
        store.delete_file(old)


def make_folder(uri: str) -> None:
    path = local_path(uri)
    if path is not None:
        os.makedirs(path, exist_ok=True)
    else:
        store, inner = remote(uri)
        store.create_dir(inner, recursive=True)


def is_folder(uri: str) -> bool:
    path = local_path(uri)
    if path is not None:
        return os.path.isdir(path)
    store, inner = remote(uri)
    return store.get_file_info(inner).type == fs.FileType.Directory


def open_write(uri: str) -> BinaryIO:
    """A new file to write."""
    path = local_path(uri)
    if path is not None:
        return open(path, "wb")
    store, inner = remote(uri)
    return store.open_output_stream(inner)
