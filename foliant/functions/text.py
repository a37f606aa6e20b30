"""Text helpers with Python's string semantics as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as Python's str.strip() takes it, with the four separators: its characters, and a run of them.
_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = "[\\t\\n\\x0b\\f\\r\\x1c\\x1d\\x1e\\x1f \\x85\\xa0[\\u1680-\\u3000&&[\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]]]+"


def py_strip(c: Column) -> Column:
    return F.trim(c, F.lit(_SPACE))


def clean_cell(c: Column) -> Column:
    """null becomes empty, else stripped text."""
    return py_strip(F.coalesce(c.cast("string"), F.lit("")))


def words(c: Column) -> Column:
    return F.filter(F.split(c, _RUN), lambda x: x != "")


def word_count(c: Column) -> Column:
    bare = py_strip(c)
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, _RUN)))


def is_upper(c: Column) -> Column:
    return (F.upper(c) == c) & (F.lower(c) != c)


def truthy(c: Column) -> Column:
    """Neither null nor zero."""
    return F.coalesce(c != 0, F.lit(False))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once in each row, also where ``body`` uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
