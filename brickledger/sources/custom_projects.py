"""The user's own projects, kept as JSON ``[{"name": ..., "aliases": [...]}]``."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.storage import replacing
from ..registry import CustomProject, Registry
from ..schemas import CUSTOM_PROJECTS

# The list is typed in by users and becomes part of every plan, so a caller states how long it may be.
MAX_PROJECTS = 10_000


def read_registry(spark: SparkSession, path: str, max_projects: int | None = MAX_PROJECTS) -> Registry:
    """Registry with the projects stored at ``path``; blank names are skipped, no file means none.

    More than ``max_projects`` are an error; with ``None`` any number is read.
    """
    try:
        rows = spark.read.schema(CUSTOM_PROJECTS).option("multiLine", True).json(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return Registry()
    named = rows.filter(F.trim("name") != "")
    projects = (named if max_projects is None else named.limit(max_projects + 1)).collect()
    if max_projects is not None and len(projects) > max_projects:
        raise ValueError(f"more than {max_projects} custom projects in {path}")
    return Registry.with_projects(CustomProject(p.name, tuple(p.aliases or ())) for p in projects)


def write_registry(spark: SparkSession, registry: Registry, path: str) -> None:
    """Write the custom projects as one JSON array, in the place of what was at ``path``."""
    document = json.dumps([{"name": p.name, "aliases": list(p.aliases)} for p in registry.custom])
    with replacing(spark, path) as staged:
        spark.createDataFrame([(document,)], "value string").coalesce(1).write.text(staged)
