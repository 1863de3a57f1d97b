"""File access inside tasks."""

from __future__ import annotations

import re


def open_uri(path: str):
    """(file system, path on it) for a local path or any URI Spark listed."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else re.sub("^file:/*", "/", path))


def frame(**columns):
    """Plain object columns, whatever string type pandas prefers."""
    import pandas as pd

    return pd.DataFrame({name: pd.Series(list(values), dtype=object) for name, values in columns.items()})
