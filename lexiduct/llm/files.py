"""Reading and writing of the operators' own files in the shared folder."""

from __future__ import annotations

import uuid
from contextlib import contextmanager


def place(uri: str):
    """(filesystem, path) of a URI; a path without a scheme is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


@contextmanager
def new_file(uri: str):
    """A stream that becomes the file at uri only when all was written.  An attempt
    that is lost leaves a .part file of its own and never a half-written file; a
    repeated attempt replaces the whole file."""
    fs, path = place(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with fs.open_output_stream(part, compression=None) as out:
            yield out
        fs.move(part, path)
    except BaseException:
        if fs.get_file_info(part).type.name != "NotFound":
            fs.delete_file(part)
        raise


def random_access(uri: str):
    fs, path = place(uri)
    return fs.open_input_file(path)


def stream(uri: str):
    fs, path = place(uri)
    return fs.open_input_stream(path, compression=None)
