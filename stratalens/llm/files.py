"""Raw files below the shared folder, opened in tasks through Arrow's file systems."""

from __future__ import annotations

import re
import uuid

import pyarrow.fs as pafs


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path of a path or URI as Spark shows it (``file:/...`` too)."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def task_file(folder: str, part: int, suffix: str) -> str:
    """A name that no other attempt of the task has; readers take only names that the committed manifest lists."""
    return f"{folder}/part-{part:05d}-{uuid.uuid4().hex}{suffix}"


class Window:
    """Reads of a file in ascending order through a buffer of some MB, for a store where each request is dear."""

    def __init__(self, file, size: int, step: int = 4 << 20):
        self.file, self.size, self.step, self.at, self.held = file, size, step, 0, b""

    def read(self, start: int, length: int) -> memoryview:
        """``length`` bytes from ``start``, fewer at the end of the file."""
        if start < self.at or start + length > self.at + len(self.held):
            self.at = start
            self.held = self.file.read_at(max(0, min(max(length, self.step), self.size - start)), start)
        return memoryview(self.held)[start - self.at : start - self.at + length]
