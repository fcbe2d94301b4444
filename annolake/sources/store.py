"""Files by URI from the driver and the executors alike, through pyarrow's file systems.

A path without a scheme is local and only good for a local master; on a cluster roots are URIs of a
shared store. Files are written beside their place and moved into it, so that none is seen half done."""

from __future__ import annotations

import json
import uuid

from pyarrow import fs


def _split(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri if not uri.startswith("file:/") or uri.startswith("file://") else "file://" + uri[5:])
    return fs.LocalFileSystem(), uri


def exists(uri: str) -> bool:
    s, p = _split(uri)
    return s.get_file_info(p).type != fs.FileType.NotFound


def is_dir(uri: str) -> bool:
    s, p = _split(uri)
    return s.get_file_info(p).type == fs.FileType.Directory


def is_file(uri: str) -> bool:
    s, p = _split(uri)
    return s.get_file_info(p).type == fs.FileType.File


def entries(uri: str, recursive: bool = False) -> list[fs.FileInfo]:
    """The files below a folder, none where it does not exist."""
    s, p = _split(uri)
    return [i for i in s.get_file_info(fs.FileSelector(p, allow_not_found=True, recursive=recursive)) if i.type == fs.FileType.File]


def folders(uri: str) -> list[str]:
    s, p = _split(uri)
    return sorted(i.base_name for i in s.get_file_info(fs.FileSelector(p, allow_not_found=True)) if i.type == fs.FileType.Directory)


def read_bytes(uri: str) -> bytes:
    s, p = _split(uri)
    with s.open_input_stream(p) as f:
        return f.read()


def read_json(uri: str, otherwise: object = None) -> object:
    """A JSON document; ``otherwise`` where there is none that can be read."""
    try:
        return json.loads(read_bytes(uri).decode("utf-8"))
    except (OSError, ValueError):
        return otherwise


def write_bytes(uri: str, data: bytes) -> None:
    s, p = _split(uri)
    folder, _, name = p.rpartition("/")
    if folder:
        s.create_dir(folder, recursive=True)
    aside = f"{folder}/.{name}.{uuid.uuid4().hex[:8]}.tmp" if folder else f".{name}.{uuid.uuid4().hex[:8]}.tmp"
    with s.open_output_stream(aside) as f:
        f.write(data)
    s.move(aside, p)


def write_text(uri: str, text: str) -> None:
    write_bytes(uri, text.encode("utf-8"))


def write_json(uri: str, payload: object) -> None:
    """A JSON document with sorted keys."""
    write_text(uri, json.dumps(payload, ensure_ascii=False, indent=2, sort_keys=True, default=str))
