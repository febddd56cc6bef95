"""File access for Python readers and writers: plain paths and URIs."""

from __future__ import annotations

from pyarrow import fs


def place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a plain path or a URI (file, hdfs, s3, gs, ...)."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def read_bytes(path: str, start: int = 0, size: int | None = None) -> bytes:
    system, name = place(path)
    with system.open_input_file(name) as f:
        return f.read_at(f.size() - start if size is None else min(size, f.size() - start), start)


def write_bytes(path: str, *chunks: bytes) -> None:
    system, name = place(path)
    parent = name.rsplit("/", 1)[0]
    if parent and parent != name:
        system.create_dir(parent, recursive=True)
    with system.open_output_stream(name) as f:
        for c in chunks:
            f.write(c)


def delete_folder(path: str) -> None:
    system, name = place(path)
    if system.get_file_info(name).type == fs.FileType.Directory:
        system.delete_dir(name)
