"""String helpers with Python ``str`` semantics, as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line boundaries of str.splitlines().  Printable ASCII is settled by the first half of a class; Java tries every range of the second.
_EOL_CHARS = "\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029"
PY_EOL = f"[[^ -~]&&[{_EOL_CHARS}]](?:(?<=\\r)\\n)?"
_LINE = f"[ -~[^{_EOL_CHARS}]]*+(?:{PY_EOL}|\\z)"


# Characters Python's str.isspace() accepts (ASCII controls, the separators
# 0x1c-0x1f, NEL, NBSP and the Unicode space separators), for trim().
PY_SPACE_CHARS = ("\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200b))
                  + "\u2028\u2029\u202f\u205f\u3000")


def py_strip(c: Column) -> Column:
    """``str.strip()``: leading and trailing Python whitespace removed (built-in trim)."""
    return F.trim(c, F.lit(PY_SPACE_CHARS))


def py_splitlines(c: Column) -> Column:
    """``str.splitlines()`` without line ends: NULL in, NULL out; "" -> [].

    The last line's end goes first, so the text is split once.
    """
    return F.when(c == "", F.array().cast("array<string>")) \
        .otherwise(F.split(F.regexp_replace(c, PY_EOL + "\\z", ""), PY_EOL, -1))


def py_splitlines_keepends(c: Column) -> Column:
    """``str.splitlines(keepends=True)``: every piece keeps its line end.

    Every line is matched with its end (``\r\n`` is one); nothing of it depends on the other pieces.
    """
    return F.filter(F.regexp_extract_all(c, F.lit(_LINE), F.lit(0)), lambda x: x != "")


def strip_line_end(c: Column) -> Column:
    """``line.rstrip("\\r\\n")``."""
    return F.rtrim(c, F.lit("\r\n"))


def count_char(c: Column, ch: str) -> Column:
    """Occurrences of a single character in a string."""
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def blank_to_null(c: Column) -> Column:
    return F.nullif(py_strip(c), F.lit(""))
