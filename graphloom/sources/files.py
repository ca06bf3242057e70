"""Files of any store that Arrow's file systems reach, opened and listed inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from typing import BinaryIO

#: Names of a store's scheme where Arrow's differs from Hadoop's.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def store_of(path: str) -> tuple[object, str]:
    """Arrow's file system of a path or address, and the path in it."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if not rest or "/" in scheme:
        return fs.LocalFileSystem(), path
    rest = rest if rest.startswith("//") else "//" + rest  # Spark writes file:/x
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


def open_file(path: str) -> BinaryIO:
    store, at = store_of(path)
    return store.open_input_file(at)


def walk(root: str, folders: list[str], skip_dirs: set[str], budget: int) -> Iterator[tuple[str, int | None]]:
    """Relative path and size of each file below some folders of a tree; folders of the skipped names are left out.

    After ``budget`` entries the folders that are left come instead of what is in them, without a size.
    """
    from pyarrow import fs

    store, base = store_of(root.rstrip("/"))
    todo = list(folders)
    while todo and budget > 0:
        folder = todo.pop()
        for entry in store.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base)):
            budget -= 1
            at = f"{folder}/{entry.base_name}" if folder else entry.base_name
            if entry.type == fs.FileType.Directory:
                if entry.base_name not in skip_dirs:
                    todo.append(at)
            elif entry.type == fs.FileType.File:
                yield at, entry.size
    yield from ((folder, None) for folder in todo)
