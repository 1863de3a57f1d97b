"""Result tables for dashboards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame


def publish(df: DataFrame, target: str, fmt: str = "parquet", mode: str = "overwrite",
            columns: Sequence[str] | None = None, options: Mapping[str, str] | None = None) -> None:
    """Write to a relational results database (`jdbc`, target is the table) or to files.

    `columns` fixes the column order readers rely on.
    """
    out = df.select(*columns) if columns else df
    writer = out.write.format(fmt).mode(mode).options(**(options or {}))
    if fmt == "jdbc":
        writer.option("dbtable", target).save()
    else:
        writer.save(target)
