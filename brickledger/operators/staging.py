"""Control over when a column is computed."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEPT_EXPRESSIONS = 32


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns as a finished stage of their own.

    A filter on a plain projected column is pushed below the projection, which
    evaluates the column twice, and the optimizer derives constraints from
    every projected expression, which takes long for large ones.  A generator
    gives the same rows and stops both.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def built_once(build: Callable) -> Callable:
    """Remember the Columns that ``build`` makes, per application and arguments.

    Building the extraction rules takes thousands of calls from Python to the
    JVM.  The Columns name their inputs, so any number of plans can share them.
    """
    made: OrderedDict = OrderedDict()

    @wraps(build)
    def lookup(*args):
        key = (SparkSession.active().sparkContext.applicationId, *args)
        if key not in made:
            made[key] = build(*args)
            if len(made) > KEPT_EXPRESSIONS:
                made.popitem(last=False)
        made.move_to_end(key)
        return made[key]

    return lookup
