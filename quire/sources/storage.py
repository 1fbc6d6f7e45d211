"""Files that tasks open themselves, on whatever storage the executors share: ranged reads, writes, moves."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import BinaryIO

from pyarrow import fs

#: Names that Spark and pyarrow give the same storage.
ALIASES = {"s3a": "s3", "s3n": "s3"}


class Storage:
    """Locations by scheme; local paths need none. `schemes` has file systems for further schemes, made from the part after `://`.

    It goes to tasks with their functions, so what makes a file system must be pickled, not the file system.
    """

    def __init__(self, schemes: dict[str, Callable[[str], fs.FileSystem]] | None = None):
        self.schemes = schemes or {}

    def at(self, location: str) -> tuple[fs.FileSystem, str]:
        """The file system and the path in it."""
        named = re.match("([A-Za-z][A-Za-z0-9+.-]+)://([^/]*)/*(.*)", location, re.S)
        if not named or named[1] == "file":
            return fs.LocalFileSystem(), re.sub("^file:/+", "/", location)
        scheme, authority, path = named.groups()
        if scheme in self.schemes:
            return self.schemes[scheme](authority), path
        system, root = fs.FileSystem.from_uri(f"{ALIASES.get(scheme, scheme)}://{authority}")
        return system, f"{root.rstrip('/')}/{path}"

    def open(self, location: str) -> BinaryIO:
        """For reading at any place: only what is asked for is fetched."""
        system, path = self.at(location)
        return system.open_input_file(path)

    def create(self, location: str) -> BinaryIO:
        """For writing; folders above are made."""
        system, path = self.at(location)
        if "/" in path.rstrip("/"):
            system.create_dir(path.rpartition("/")[0], recursive=True)
        return open(path, "wb") if isinstance(system, fs.LocalFileSystem) else system.open_output_stream(path)

    def exists(self, location: str) -> bool:
        system, path = self.at(location)
        return system.get_file_info(path).type != fs.FileType.NotFound

    def move(self, source: str, target: str) -> None:
        """Within one file system; what the target was is replaced."""
        system, path = self.at(source)
        system.move(path, self.at(target)[1])

    def delete(self, location: str) -> None:
        """A file, if it is there."""
        if self.exists(location):
            system, path = self.at(location)
            system.delete_file(path)
