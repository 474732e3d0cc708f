"""Binary files in the shared folder, written and read by tasks, on any store that pyarrow opens."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def _at(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else fs.FileSystem.from_uri("file://" + path.removeprefix("file:"))


@contextmanager
def created(folder: str, name: str):
    """A stream to a new file. Yields (path, stream); the name holds a random part, so a task that runs twice never writes over itself."""
    store, at = _at(folder)
    store.create_dir(at, recursive=True)
    path = f"{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(f"{at}/{path}") as out:
        yield f"{folder}/{path}", out


def opened(path: str):
    """The file for random access."""
    store, at = _at(path)
    return store.open_input_file(at)
