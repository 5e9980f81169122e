"""Binary files in the folder that the cluster shares, read and written from tasks by any store's URI."""

from __future__ import annotations

import re

from pyarrow import fs


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of ``uri`` and the path in it, by its scheme.

    A path without a scheme is refused: Spark would resolve it against its default store, this process against its own disk
    (``storage.shared_path`` gives whole URIs).  So is a scheme that pyarrow has no store for."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", uri)
    if not scheme:
        raise ValueError(f"{uri} names no store")
    if scheme[1] == "file":
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri)
    # Spark's names of a store that pyarrow knows by another.
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def create(uri: str):
    """A binary stream that writes a new file; its folder is made where the store has folders."""
    store, path = open_store(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None)


def open_random(uri: str):
    """A seekable binary file, open for reading."""
    store, path = open_store(uri)
    return store.open_input_file(path)
