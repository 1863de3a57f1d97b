"""Carrying out a mirror plan."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..sources._files import frame, open_uri


def apply_mirror(plan: DataFrame, source_root: str, target_root: str) -> DataFrame:
    """(path, action, status) after copying uploads and removing deletions in the tasks.

    Parent folders are created first. Repeating a plan changes nothing.
    """
    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        source, source_base = open_uri(source_root)
        target, target_base = open_uri(target_root)

        def one(path: str, action: str) -> str:
            goal = f"{target_base}/{path}"
            if action == "upload":
                target.create_dir(goal.rsplit("/", 1)[0], recursive=True)
                fs.copy_files(f"{source_base}/{path}", goal, source_filesystem=source, destination_filesystem=target)
                return "uploaded"
            if action == "delete":
                if target.get_file_info(goal).type != fs.FileType.NotFound:
                    target.delete_file(goal)
                return "deleted"
            return "kept"

        for batch in batches:
            yield frame(path=batch["path"], action=batch["action"],
                        status=[one(p, a) for p, a in zip(batch["path"], batch["action"])])

    return plan.select("path", "action").mapInPandas(apply, "path string, action string, status string")
