"""Files in the shared folder, written and read by tasks.

A task writes under a name of its own; only names that reach a stored table count,
so what a lost or repeated task left behind is never read.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict

from pyarrow import fs

#: Files kept open, or small files kept in memory, by one reader.
KEPT = 16


def fresh_name(folder: str, kind: str, suffix: str) -> str:
    return f"{folder}/{kind}-{uuid.uuid4().hex}{suffix}"


def _resolve(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (
        fs.LocalFileSystem(),
        path,
    )


def create(path: str):
    """An output stream; missing folders are made."""
    system, name = _resolve(path)
    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(name, compression=None)


class Reader:
    """Range reads, with the last files kept open."""

    def __init__(self):
        self.open: OrderedDict = OrderedDict()

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path not in self.open:
            system, name = _resolve(path)
            self.open[path] = system.open_input_file(name)
            if len(self.open) > KEPT:
                self.open.popitem(last=False)[1].close()
        self.open.move_to_end(path)
        return self.open[path].read_at(length, offset)

    def whole(self, path: str) -> bytes:
        system, name = _resolve(path)
        with system.open_input_file(name) as file:
            return file.read()


class Recent:
    """Remembers the last results of ``load``."""

    def __init__(self, load, kept: int = KEPT):
        self.load, self.kept, self.held = load, kept, OrderedDict()

    def __getitem__(self, key):
        if key not in self.held:
            self.held[key] = self.load(key)
            if len(self.held) > self.kept:
                self.held.popitem(last=False)
        self.held.move_to_end(key)
        return self.held[key]
