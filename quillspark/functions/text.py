"""String and tokenization expressions (T1, T3, T11, P1, K3 escaping)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word/punctuation token pattern (a run of letters, digits and marks, or one
# character that is neither such a character nor whitespace). Shared verbatim with the SQL oracle.
TOKEN_PATTERN = r"[\p{L}\p{N}\p{M}]+|[^\p{L}\p{N}\p{M}\s]"
# The characters of Python's ``str.isspace`` and those that ``repr`` escapes by code point
# (controls, format and private-use characters, separators other than the space), as regex classes.
PY_SPACE = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
NOT_PRINTABLE = (r"\p{Cc}\p{Cf}\p{Co}\p{Zl}\p{Zp}"
                 r"\xa0\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text) -> Column:
    """Lowercase, then words and single punctuation marks, in text order."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(TOKEN_PATTERN), 0)


def token_len(toks) -> Column:
    """Token count before truncation."""
    return F.size(_c(toks))


def first_word(text) -> Column:
    """First whitespace-delimited word; '' for blank text."""
    return F.regexp_extract(_c(text), f"[^{PY_SPACE}]+", 0)


def nonblank(text) -> Column:
    """the text has a character that is not white space."""
    return _c(text).rlike(f"[^{PY_SPACE}]")


def py_strip(text) -> Column:
    """Python ``str.strip()`` (Spark ``trim`` removes spaces only)."""
    return F.regexp_replace(_c(text), rf"\A[{PY_SPACE}]+|[{PY_SPACE}]+\z", "")


def space_pieces(text) -> Column:
    """Number of pieces of ``text.split(" ")``: a blank string is one piece, double spaces add one."""
    return F.size(F.split(_c(text), " ", -1))


def _code_point_escape(c: Column) -> Column:
    n = F.ascii(c)
    return (F.when(n < 0x100, F.format_string("\\x%02x", n)).when(n < 0x10000, F.format_string("\\u%04x", n))
            .otherwise(F.format_string("\\U%08x", n)))


def python_repr(text) -> Column:
    """K3: Python ``repr`` of a string.

    Backslash first, then newline, carriage return and tab, then other characters that do not print, by
    code point. Outer double quotes only when the text holds a single quote and no double quote; otherwise
    single quotes with inner ones escaped.
    """
    t = _c(text)
    body = F.regexp_replace(t, r"\\", r"\\\\")
    body = F.regexp_replace(body, "\n", r"\\n")
    body = F.regexp_replace(body, "\r", r"\\r")
    body = F.regexp_replace(body, "\t", r"\\t")
    hidden = f"[{NOT_PRINTABLE}]"
    body = F.when(body.rlike(hidden), F.array_join(F.transform(
        F.split(body, ""), lambda c: F.when(c.rlike(hidden), _code_point_escape(c)).otherwise(c)), "")).otherwise(body)
    use_double = F.instr(t, "'") > 0
    use_double = use_double & (F.instr(t, '"') == 0)
    return F.when(use_double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.regexp_replace(body, "'", r"\\'"), F.lit("'"))
    )


def type_token_ratio(toks, window: int = 128) -> Column:
    """Distinct share of the first ``window`` tokens; shorter lists use their own length; empty -> 0."""
    head = F.slice(_c(toks), 1, window)
    n = F.size(head)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_distinct(head)) / n)


def joined(arr, sep: str = " ") -> Column:
    """Array rendered as one string (for sinks and value comparison)."""
    return F.array_join(F.transform(_c(arr), lambda x: x.cast("string")), sep)
