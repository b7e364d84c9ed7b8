"""Files that tasks read by place and write as streams, on any file system that Arrow knows.

Paths are those that Spark takes; a scheme that Arrow does not know is not
:func:`reachable`, and callers then go by Spark's own readers and writers.
"""

from __future__ import annotations

import io
import re

#: Bytes that are fetched at a time.
BUFFER = 1 << 17


def located(path: str):
    """(file system, path within it)."""
    from pyarrow import fs

    m = re.match(r"([a-z][a-z0-9+.-]*):", path)
    if m is None:
        return fs.LocalFileSystem(), path
    if m[1] == "file":
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))


def reachable(path: str) -> bool:
    try:
        located(path)
    except (ValueError, OSError, ImportError):
        return False
    return True


def opened(path: str) -> io.BufferedReader:
    """A file to read from any place."""
    system, at = located(path)
    return io.BufferedReader(system.open_input_file(at), BUFFER)


def whole(path: str) -> bytes:
    """A small file."""
    system, at = located(path)
    with system.open_input_stream(at, compression=None) as f:
        return f.read()


def created(path: str):
    """A new file to write; folders above it are made."""
    system, at = located(path)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(at, compression=None)


def put(path: str, data: bytes) -> None:
    with created(path) as f:
        f.write(data)


def move(old: str, new: str) -> None:
    system, at = located(old)
    to = located(new)[1]
    system.create_dir(to.rsplit("/", 1)[0], recursive=True)
    system.move(at, to)


def delete(path: str) -> None:
    """A file or a folder, if it is there."""
    from pyarrow import fs

    system, at = located(path)
    kind = system.get_file_info(at).type
    if kind == fs.FileType.Directory:
        system.delete_dir(at)
    elif kind == fs.FileType.File:
        system.delete_file(at)


def size(path: str) -> int | None:
    """Bytes of a file; None if there is none."""
    from pyarrow import fs

    system, at = located(path)
    info = system.get_file_info(at)
    return info.size if info.type == fs.FileType.File else None
