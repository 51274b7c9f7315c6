"""Text column functions with Python ``str`` semantics.

Java's and RE2's ``\\s`` do not match what ``str.split()`` / ``str.strip()``
treat as blank, so the class is spelled out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 code points for which Python's str.isspace() is true,
# as a Java regex character class (tab..CR, FS..space, NEL, NBSP, OGHAM SPACE
# MARK, EN QUAD..HAIR SPACE, LINE SEP, PARA SEP, NNBSP, MMSP, IDEOGRAPHIC SPACE).
WS_CLASS = ("[\\t-\\r\\u001c-\\u0020\\u0085\\u00a0\\u1680\\u2000-\\u200a"
            "\\u2028\\u2029\\u202f\\u205f\\u3000]")
WS = WS_CLASS + "+"
# The same class in DuckDB (RE2) spelling, for the oracle SQL.
DUCK_WS = ("[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
           "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+")

# The texts pandas.read_csv turns into NaN by default.
PANDAS_NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The same 29 characters as a plain string, for ``trim(str, chars)``.
WS_CHARS = "".join(chr(c) for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
                                     *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


NEAR_BLANKS = ("  ", *[x for x in WS_CHARS if " " != x < "\x80"])
FAR_BLANKS = tuple(x for x in WS_CHARS if x > "\x80")


def tokens(c) -> Column:
    """``s.split()``: split on runs of Python blanks, no empty tokens (F1).
    Trimmed first, so the split yields no empty piece except for a blank
    string (-> empty array); no lambda, stays in generated code. A text whose
    only blanks are single spaces, as most are, needs no regular expression."""
    c = _c(c)
    t = F.trim(c, F.lit(WS_CHARS))
    near, far = (reduce(lambda a, b: a | b, [F.contains(c, F.lit(x)) for x in xs]) for xs in (NEAR_BLANKS, FAR_BLANKS))
    return (F.when(t == "", F.array().cast("array<string>"))
            .when(near | ((F.length(c) != F.octet_length(c)) & far), F.split(t, WS, -1))
            .otherwise(F.split(t, " ", -1)))


def py_strip(c) -> Column:
    """``s.strip()`` (F2): trim the Python blank characters from both ends
    (a character-set trim, no regular expression)."""
    return F.trim(_c(c), F.lit(WS_CHARS))


def norm_text(c) -> Column:
    """``' '.join(s.lower().split())``."""
    return F.array_join(tokens(F.lower(_c(c))), " ")


def strip_prefix(c, prefix: str) -> Column:
    """Drop ``prefix`` (any case) once, then strip (F5, one step of F10). A character
    becomes one or more in lower case, so only as many as ``prefix`` has are looked at."""
    c = _c(c)
    head = F.substr(c, F.lit(1), F.lit(len(prefix)))
    return (F.when(F.startswith(F.lower(head), F.lit(prefix.lower())),
                   py_strip(rest_from(c, F.lit(len(prefix) + 1))))
            .otherwise(c))


def rest_from(c, start: Column) -> Column:
    """The text from character ``start`` (1-based) to its end."""
    return F.substr(_c(c), start)


def is_blank(c) -> Column:
    return py_strip(c) == ""


def na_to_null(c, tokens_=PANDAS_NA_TOKENS) -> Column:
    """Map pandas' default NA texts to null, as ``read_csv`` does."""
    c = _c(c)
    return F.when(c.isin(list(tokens_)), F.lit(None).cast("string")).otherwise(c)


def md5_int(c, start: int = 1) -> Column:
    """8 hex digits of md5 starting at ``start`` as a non-negative BIGINT.

    DuckDB: ``('0x' || substr(md5(x), start, 8))::BIGINT``.
    """
    return F.conv(F.substring(F.md5(_c(c).cast("string")), start, 8), 16, 10).cast("bigint")


def seeded_hash(seed, key) -> Column:
    """Seeded order key ``md5('<seed>|' || key)`` as BIGINT (first 8 hex digits)."""
    return md5_int(F.concat(F.lit(f"{seed}|"), _c(key).cast("string")))
