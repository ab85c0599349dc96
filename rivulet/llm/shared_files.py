"""Files that executors write to and read from the shared folder."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """A folder, made if it is missing, given as a path or as a URI that pyarrow can open."""
    fs, path = pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    fs.create_dir(path, recursive=True)
    return fs, path


def write_file(folder: str, name: str, data: bytes) -> str:
    """Writes a file of the folder and returns its path. A retried task writes the same bytes to a new name and moves it over the old one."""
    fs, root = open_folder(folder)
    temporary = f"{root}/_{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as out:
        out.write(data)
    fs.move(temporary, f"{root}/{name}")
    return f"{root}/{name}"


def read_file(folder: str, path: str) -> bytes:
    fs, _ = open_folder(folder)
    with fs.open_input_file(path) as source:
        return source.read()
