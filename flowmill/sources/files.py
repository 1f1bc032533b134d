"""Byte streams on whatever file system a path names, for use inside tasks."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyarrow import fs


def path_part(path: str) -> str:
    """The path without scheme and host; names are taken as they stand, not decoded."""
    return re.sub(r"^[A-Za-z][\w+.-]*:(//[^/]*)?/*", "/", path) if ":" in path else path


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it, for a path as Spark lists it."""
    remote = re.match(r"([A-Za-z][\w+.-]*)://([^/]*)/(.*)", path)
    if remote is None or remote[1] == "file":
        return fs.LocalFileSystem(), path_part(path)
    return fs.FileSystem.from_uri(f"{remote[1]}://{remote[2]}/{quote(remote[3])}")
