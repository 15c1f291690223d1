"""Unicode normalisation, the one thing Spark has no built-in function for.

The Arrow UDFs work on column batches.  Callers go through the wrappers below,
which send only the non-ASCII values to the Python worker: ASCII text is
already in every normal form, so it travels as null and is filled back in on
the JVM side.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# The functions travel inside the plan, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# HTML character references understood in project names
HEX_REFERENCE = r"&#x([0-9a-fA-F]+);"
DECIMAL_REFERENCE = r"&#(\d+);"


def _normalised(values: pa.Array, form: str) -> pa.Array:
    texts = values.to_pylist()
    return pa.array([None if t is None else unicodedata.normalize(form, t) for t in texts], pa.string())


@F.arrow_udf(StringType())
def _nfkc(values: pa.Array) -> pa.Array:
    return _normalised(values, "NFKC")


def decode_references(text: str) -> str:
    def char(code: int, raw: str) -> str:
        return chr(code) if code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else raw

    text = re.sub(HEX_REFERENCE, lambda m: char(int(m[1], 16), m[0]), text, flags=re.ASCII)
    return re.sub(DECIMAL_REFERENCE, lambda m: char(int(m[1]), m[0]), text, flags=re.ASCII)


def _plain_letters(values: pa.Array) -> pa.Array:
    referenced = pc.fill_null(pc.match_substring(values, "&#"), False)
    if pc.any(referenced).as_py():
        decoded = [None if v is None else decode_references(v) for v in values.filter(referenced).to_pylist()]
        values = pc.replace_with_mask(values, referenced, pa.array(decoded, type=values.type))
    return pc.replace_substring_regex(_normalised(values, "NFKD"), r"\p{M}", "")


@F.arrow_udf(StringType())
def _plain(values: pa.Array) -> pa.Array:
    return _plain_letters(values)


def _plain_lists(lists: pa.Array) -> pa.Array:
    ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(lists), 0)).cast(pa.int32())
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
    return pa.ListArray.from_arrays(offsets, _plain_letters(lists.flatten()), mask=pc.is_null(lists))


@F.arrow_udf(ArrayType(StringType()))
def _plain_each(lists: pa.Array) -> pa.Array:
    return _plain_lists(lists)


# Spark asks for the size of a batch at every row, and the writer of lists then goes over all null rows before it:
# lists travel as JSON texts, whose writer does not.
@F.arrow_udf(ArrayType(StringType()))
def _plain_each_json(texts: pa.Array) -> pa.Array:
    return _plain_lists(pa.array([None if t is None else json.loads(t) for t in texts.to_pylist()], pa.list_(pa.string())))


def _not_ascii(c: Column) -> Column:
    return F.octet_length(c) != F.length(c)


def needs_plain(c: Column) -> Column:
    return _not_ascii(c) | c.contains("&#")


def nfkc(c: Column) -> Column:
    """Compatibility form: mathematical bold letters become plain ones, and so on."""
    return F.coalesce(_nfkc(F.when(_not_ascii(c), c)), c)


def plain_letters(c: Column) -> Column:
    """HTML references decoded, accents and other marks dropped."""
    return F.coalesce(_plain(F.when(needs_plain(c), c)), c)


def plain_letters_each(c: Column) -> Column:
    """``plain_letters`` for every element of an array column."""
    return F.coalesce(_plain_each_json(F.to_json(F.when(F.exists(c, needs_plain), c))), c)


SQL_FUNCTIONS = {"nfkc": _nfkc, "plain_letters": _plain, "plain_letters_each": _plain_each}
