"""Lake layout: `<container>/<schema>/<table>` and who may use which container."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import ANALYTICS_READS, ANALYTICS_WRITES, CONTAINERS


@dataclass(frozen=True)
class Layout:
    root: str = ""

    def path(self, container: str, *parts: str) -> str:
        if container not in CONTAINERS:
            raise ValueError(f"unknown container '{container}'")
        return "/".join([*([self.root.rstrip("/")] if self.root else []), container, *parts])


def container_path(container: Column, schema: Column, table: Column) -> Column:
    """Path of a table; NULL for a container the layout does not have."""
    return F.when(container.isin(*CONTAINERS), F.concat_ws("/", container, schema, table))


def _workspaces(container: Column, analytics: tuple[str, ...]) -> Column:
    return F.when(container.isin(*analytics), "analytics,engineering").when(
        container.isin(*CONTAINERS), "engineering")


def readers(container: Column) -> Column:
    """Workspaces that may read a container."""
    return _workspaces(container, ANALYTICS_READS + ANALYTICS_WRITES)


def writers(container: Column) -> Column:
    """Workspaces that may write a container."""
    return _workspaces(container, ANALYTICS_WRITES)


def with_access(df: DataFrame, container: str, schema: str, table: str) -> DataFrame:
    """Add `table_path`, `readers` and `writers`; unknown containers get NULL."""
    c = F.col(container)
    return df.withColumns({
        "table_path": container_path(c, F.col(schema), F.col(table)), "readers": readers(c), "writers": writers(c)})
