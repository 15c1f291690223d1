"""Inventory CSV files.

Lines are rendered as text so that the bytes are exactly those of the format:
byte order mark, CRLF and quoting only where needed.  A sorted write may give
several part files; joined in name order they are the one file, because the
header is a row that sorts first.  An export is written beside the old one and
takes its place when it is complete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.strings import strip
from ..operators.storage import replacing, scratch, stored
from ..schemas import INVENTORY_FIELDS, POST_ORDER


def single_line(c: Column) -> Column:
    """One line of text: line breaks become " | ", runs of blanks one space."""
    joined = F.regexp_replace(F.coalesce(c, F.lit("")), P.LINE_BREAKS, " | ")
    return strip(F.regexp_replace(joined, P.BLANK_RUN, " "))


def csv_cell(c: Column) -> Column:
    """A cell safe for spreadsheets: formulas are disarmed, quotes doubled."""
    text = F.coalesce(c, F.lit(""))
    safe = F.when(text.rlike(P.FORMULA_START), F.concat(F.lit("'"), text)).otherwise(text)
    quoted = F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(safe.rlike(r'[",\r\n]'), quoted).otherwise(safe)


def file_name(society: Column, months: int) -> Column:
    """``Inventory_<society>_<months>m.csv`` with everything but letters and digits as "_"."""
    name = F.trim(F.regexp_replace(strip(society), "[^A-Za-z0-9_]+", "_"), F.lit("_"))
    return F.concat(F.lit("Inventory_"), F.when(name == "", "Project").otherwise(name), F.lit(f"_{months}m.csv"))


def csv_line(flag: Column) -> Column:
    cells = [csv_cell(F.col(c)) for c in INVENTORY_FIELDS if c != "full_message"]
    return F.concat_ws(",", *cells, csv_cell(single_line(F.col("full_message"))), csv_cell(flag.cast("string")))


def header_line() -> str:
    return P.BYTE_ORDER_MARK + ",".join(P.INVENTORY_HEADERS)


def inventory_lines(inventory: DataFrame) -> DataFrame:
    """CSV lines of the inventory with the columns that order them."""
    return inventory.select(
        F.lit(1).alias("_row"), "ts", *POST_ORDER, csv_line(F.col("is_duplicate")).alias("value"), "society"
    )


_ORDER = ["_row", "ts", *POST_ORDER]


def project_files(lines: DataFrame, months: int) -> DataFrame:
    """``(society, file_name)`` of every society: a name that several societies would have gets a hash of each."""
    societies = lines.select("society").distinct().withColumn("file_name", file_name(F.col("society"), months))
    shared = societies.groupBy("file_name").agg(F.count("*").alias("_n"))
    ending = f"_{months}m.csv"
    own = F.concat(
        F.expr(f"left(file_name, length(file_name) - {len(ending)})"), F.lit("_"), F.left(F.md5("society"), F.lit(8)), F.lit(ending))
    return societies.join(shared, "file_name").select("society", F.when(F.col("_n") > 1, own).otherwise(F.col("file_name")).alias("file_name"))


def write_inventory_csv(
    inventory: DataFrame, path: str, by_project: bool = False, months: int = 1, society: str | None = None
) -> None:
    """Write the flagged inventory, or one society of it, below ``path``.

    With ``by_project`` there is a folder ``file_name=...`` per society.  Rows
    are range-partitioned by file and time, so a large project is written by
    several tasks.  The lines are rendered once and stored for sampling, headers
    and writing.  A failed write leaves the old export as it was.
    """
    spark = inventory.sparkSession
    with scratch(spark), replacing(spark, path) as staged:
        lines = stored(inventory_lines(inventory if society is None else inventory.filter(F.col("society") == society)), "lines")
        header = F.lit(header_line())
        no_order = {"_row": F.lit(0), **{c: F.lit(None).cast("long") for c in ("ts", "chat_id", "message_id")},
                    "part_no": F.lit(None).cast("int"), "value": header}
        if not by_project:
            top = spark.range(1).select(*[c.alias(name) for name, c in no_order.items()])
            ordered = top.unionByName(lines.drop("society")).orderBy(*_ORDER).select("value")
            ordered.write.option("lineSep", "\r\n").text(staged)
        else:
            files = stored(project_files(lines, months), "files")
            tops = files.select("file_name", *[c.alias(n) for n, c in no_order.items()])
            filed = lines.join(files, "society").drop("society")
            order = ["file_name", *_ORDER]
            parts = tops.unionByName(filed).repartitionByRange(*order).sortWithinPartitions(*order)
            parts.select("file_name", "value").write.option("lineSep", "\r\n").partitionBy("file_name").text(staged)
