"""Files of our own formats in the shared folder, opened from inside tasks."""

from __future__ import annotations

import os


def opened(uri: str):
    """(file system, path) of a URI that Arrow can reach: file, hdfs, s3, gs."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put(uri: str, data: bytes) -> None:
    """Write a whole file under its final name or not at all.

    A second attempt of a task writes the same bytes, so the last rename may win.
    """
    filesystem, path = opened(uri)
    filesystem.create_dir(os.path.dirname(path), recursive=True)
    draft = f"{path}.{os.urandom(6).hex()}"
    with filesystem.open_output_stream(draft) as out:
        out.write(data)
    filesystem.move(draft, path)


def get(uri: str, offset: int | None = None, length: int | None = None) -> bytes:
    """A whole file, or one range of it."""
    filesystem, path = opened(uri)
    with filesystem.open_input_file(path) as source:
        return source.read() if offset is None else source.read_at(length, offset)


def remove(uri: str) -> None:
    """A folder and what is in it; one that is not there is no error."""
    filesystem, path = opened(uri)
    if filesystem.get_file_info(path).type.name == "Directory":
        filesystem.delete_dir(path)
