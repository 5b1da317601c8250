"""Access to files by path or address (local, hdfs, s3, gcs) and the headers of the binary formats.

All numbers are little-endian. A header is ``int32 N`` and, for vectors, ``int32 d``; from 2 ** 31 rows on, ``int32 -1`` stands for N,
which follows as an ``int64`` after the others.
"""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass

from pyarrow import fs

INT_MAX = (1 << 31) - 1
#: The file of a folder that names its parts, a line each, in order.
LIST = "_parts"


class FormatError(ValueError):
    """A file whose size or header doesn't fit its format."""


def located(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


@dataclass(frozen=True)
class Part:
    """One file: where its records begin, how many there are and how many 4-byte values each has."""

    path: str
    offset: int
    rows: int
    cols: int


def header_bytes(rows: int, cols: int | None, long: bool = False) -> bytes:
    """``cols``: None for class files, which have no such field."""
    fields = () if cols is None else (cols,)
    if long or rows > INT_MAX:
        return struct.pack(f"<{1 + len(fields)}iq", -1, *fields, rows)
    return struct.pack(f"<{1 + len(fields)}i", rows, *fields)


def read_header(system: fs.FileSystem, path: str, vectors: bool) -> Part:
    with system.open_input_file(path) as f:
        size, head = f.size(), f.read(16)
    n = 8 if vectors else 4
    if len(head) < n:
        raise FormatError(f"{path}: too short for a header")
    rows, cols = struct.unpack_from("<ii", head) if vectors else (*struct.unpack_from("<i", head), 1)
    if rows == -1:
        if len(head) < n + 8:
            raise FormatError(f"{path}: too short for a long header")
        rows, n = struct.unpack_from("<q", head, n)[0], n + 8
    if rows < 0 or cols < 1 or size != n + 4 * rows * cols:
        raise FormatError(f"{path}: {size} bytes don't hold {rows} rows of {cols} values")
    return Part(path, n, rows, cols)


def listed(system: fs.FileSystem, folder: str) -> list[str]:
    """The names of a folder's parts: those of its list or, where there is none, all part files in order of their names."""
    if system.get_file_info(f"{folder}/{LIST}").type == fs.FileType.File:
        with system.open_input_file(f"{folder}/{LIST}") as f:
            return f.read().decode().split()
    return sorted(i.base_name for i in system.get_file_info(fs.FileSelector(folder)) if i.type == fs.FileType.File and i.base_name.startswith("part-") and not i.base_name.endswith(".body"))


def write_list(system: fs.FileSystem, folder: str, names: list[str]) -> None:
    """Replaces the list as a whole: it is written beside and moved."""
    with system.open_output_stream(f"{folder}/{LIST}.new") as out:
        out.write("\n".join(names).encode())
    if system.type_name in ("local", "s3", "gcs", "abfs"):  # where a move replaces
        system.move(f"{folder}/{LIST}.new", f"{folder}/{LIST}")
    else:
        system.copy_file(f"{folder}/{LIST}.new", f"{folder}/{LIST}")
        system.delete_file(f"{folder}/{LIST}.new")


def parts_of(path: str, vectors: bool) -> list[Part]:
    """The file itself, or the part files of a folder in order. Only headers are read."""
    system, inner = located(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    names = [inner]
    if info.type == fs.FileType.Directory:
        names = [f"{inner}/{name}" for name in listed(system, inner)]
    found = [read_header(system, name, vectors) for name in names]
    if len({p.cols for p in found if p.rows}) > 1:
        raise FormatError(f"{path}: parts of different widths")
    return found
