"""Files of any file system a session can reach, read in ranges and written whole, from executors.

Paths are URIs (file, hdfs, s3, gs, ...) or local paths; pyarrow's file systems open them in the Python workers.
"""

from __future__ import annotations

from fnmatch import fnmatch

import pyarrow.fs as pafs


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):  # Hadoop writes file:/x as well as file:///x
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def listed(path: str, pattern: str) -> list[str]:
    """The files of a folder whose names fit, or the file itself; nothing for a missing path. In the order of their names."""
    fs, p = _at(path)
    info = fs.get_file_info(p)
    if info.type == pafs.FileType.NotFound:
        return []
    if info.type == pafs.FileType.File:
        return [path]
    root = path.rstrip("/")
    return sorted(f"{root}/{f.base_name}" for f in fs.get_file_info(pafs.FileSelector(p)) if f.type == pafs.FileType.File and fnmatch(f.base_name, pattern))


class Ranges:
    """A file's bytes by position; ``read`` counts what was asked for."""

    def __init__(self, path: str) -> None:
        fs, p = _at(path)
        self.file = fs.open_input_file(p)
        self.size, self.read = self.file.size(), 0

    def at(self, offset: int, length: int) -> bytes:
        out = self.file.read_at(max(0, min(length, self.size - offset)), offset)
        self.read += len(out)
        return out

    def close(self) -> None:
        self.file.close()

    def __enter__(self) -> Ranges:
        return self

    def __exit__(self, *_) -> None:  # noqa: ANN002
        self.close()


class Whole:
    """A file written aside and named at the end, so a task run twice or broken off leaves one whole file or none."""

    def __init__(self, path: str, attempt: object) -> None:
        self.fs, self.path = _at(path)
        self.aside = f"{self.path}.{attempt}"
        self.out = None

    def write(self, data: bytes) -> None:
        if self.out is None:
            self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
            self.out = self.fs.open_output_stream(self.aside)
        self.out.write(data)

    def commit(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.aside, self.path)
