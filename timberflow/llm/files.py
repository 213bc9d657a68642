"""Whole files written by tasks to a shared folder.

A file has a name that its partition fixes; it is written under another name
and then moved, so a repeated task replaces it by the same content and readers
never see half a file.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterable

from pyarrow import fs


def put(folder: str, name: str, parts: Iterable[bytes]) -> int:
    """Write ``folder/name``; returns its size."""
    filesystem, base = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))
    filesystem.create_dir(base, recursive=True)
    draft = posixpath.join(base, f".{name}.{uuid.uuid4().hex}")
    size = 0
    with filesystem.open_output_stream(draft) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    filesystem.move(draft, posixpath.join(base, name))
    return size
