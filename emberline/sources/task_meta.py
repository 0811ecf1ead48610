"""Task metadata as VARIANT: any keys, kept as they came, read by path without parsing the rest.

Tasks are rows (task_id, seed_name, ..., meta variant). Known paths have typed readers with defaults; unknown keys stay in the variant through Parquet and back to JSON.

Results in special cases: a null or malformed text is an empty object; a path that is absent, null or of another type gives its default; an empty table has no shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The paths that the library reads, with type and default: chain depth, slow functions by name, functions, the share of each at the start, the search that made it.
PATHS: dict[str, tuple[str, object]] = {
    "d": ("int", 0),
    "k": ("int", 0),
    "functions": ("array<string>", None),
    "slow_functions": ("array<string>", None),
    "profile0": ("map<string,double>", None),
    "kind": ("string", "function"),
    "search.nodes": ("int", 0),
}


def parsed(text: Column) -> Column:
    """A variant of a JSON text, an empty object where it is none."""
    return F.coalesce(F.try_parse_json(text), F.parse_json(F.lit("{}")))


def at(meta: Column, path: str) -> Column:
    """The value of a known path, or its default."""
    kind, default = PATHS[path]
    found = F.try_variant_get(meta, f"$.{path}", kind)
    empty = F.from_json(F.lit("{}" if kind.startswith("map") else "[]"), kind) if default is None else F.lit(default).cast(kind)
    return F.coalesce(found, empty)


def with_columns(tasks: DataFrame, meta: str = "meta", paths: tuple[str, ...] = tuple(PATHS)) -> DataFrame:
    """tasks with a column for each path, named by it, points as underscores."""
    return tasks.withColumns({p.replace(".", "_"): at(F.col(meta), p) for p in paths})


def shape(tasks: DataFrame, meta: str = "meta") -> str | None:
    """The schema that all rows' variants fit, unknown keys included."""
    return tasks.agg(F.schema_of_variant_agg(meta)).first()[0]


def text(meta: Column) -> Column:
    """The variant as JSON, its keys sorted."""
    return F.to_json(meta)
