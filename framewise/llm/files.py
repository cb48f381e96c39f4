"""Plain files in the shared folder, written and read by executors through the store named in its URI."""

from __future__ import annotations

import re
import uuid

from pyarrow import fs


def place(uri: str) -> tuple[fs.FileSystem, str]:
    uri = re.sub(r"^file:/+", "/", uri)
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def write(uri: str, data: bytes) -> None:
    store, path = place(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path, compression=None) as out:
        out.write(data)


def write_once(uri: str, data: bytes) -> None:
    """Write a file that every attempt of a task would write alike: readers see all of it or nothing."""
    store, path = place(uri)
    if store.get_file_info(path).type == fs.FileType.NotFound:
        write(part := f"{uri}-{uuid.uuid4().hex}", data)
        store.move(place(part)[1], path)


def open_stream(uri: str):
    store, path = place(uri)
    return store.open_input_stream(path, compression=None)


def read(uri: str) -> bytes:
    with open_stream(uri) as f:
        return f.read()
