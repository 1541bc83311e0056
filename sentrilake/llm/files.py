"""Binary files that tasks write to and read from the cluster's shared folder."""

from __future__ import annotations

import os
import uuid

from pyarrow import fs

_CHUNK = 1 << 20


def open_output(folder: str, stem: str):
    """A new file below ``folder`` and its path. The name is the attempt's own: a task that runs
    again never touches what another attempt wrote, and only files named by rows that
    Spark accepted are read."""
    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex[:12]}"
    return system.open_output_stream(f"{base}/{name}", buffer_size=_CHUNK), f"{folder.rstrip('/')}/{name}"


def open_input(path: str):
    """A file with random access."""
    folder, name = os.path.split(path)
    system, base = fs.FileSystem.from_uri(folder)
    return system.open_input_file(f"{base}/{name}")
