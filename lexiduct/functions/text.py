"""Column functions on terms: normalisation, the accept policy, buckets, budgets.

All are expressions of built-in functions, so they stay in whole-stage codegen.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space that trimming removes.
SPACE_CLASS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: What marks a term as junk, matched without regard to case.
JUNK = (
    ("url", r"(?iu)https?://|www\."),
    ("domain", r"(?iu)\.(?:com|net|org|co|in|io)\d*(?![0-9A-Za-z_])"),
    ("escape", r"(?iu)\\u[0-9a-f]{4}"),
    ("control", r"[\x00-\x1f]"),
)
LETTER = r"\p{L}"
#: Allowed edits by query length in code points; the largest key not above it counts.
EDITS_BY_LENGTH = {0: 0, 3: 1, 5: 2}


def _unmarked(c: str) -> str:
    """A character without its combining marks, composed again."""
    return unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"))


@functools.lru_cache(maxsize=1)
def _mark_tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Characters whose unmarked form is one other character, those forms, and the few
    whose form is longer.  Ideographs and Hangul outside of the compatibility blocks
    have no marks and are skipped."""
    one_from, one_to, longer = [], [], []
    for cp in range(0x80, min(sys.maxunicode, 0x30000)):
        if 0x3400 <= cp <= 0x9FFF or 0xAC00 <= cp <= 0xDFFF or 0x20000 <= cp < 0x2F800:
            continue
        c = chr(cp)
        if unicodedata.category(c) == "Mn":
            continue
        t = _unmarked(c)
        if t != c and len(t) == 1:
            one_from.append(c)
            one_to.append(t)
        elif t != c and t:
            longer.append((c, t))
    return "".join(one_from), "".join(one_to), tuple(longer)


def strip_marks(col: Column) -> Column:
    """Drops combining marks, of precomposed letters too.  Terms in ASCII skip the tables."""
    one_from, one_to, longer = _mark_tables()
    out = F.translate(col, one_from, one_to)
    for a, b in longer:
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.regexp_replace(out, r"\p{Mn}", "")
    return F.when(F.octet_length(col) != F.length(col), out).otherwise(col)


def trim_space(col: Column) -> Column:
    return F.regexp_replace(col, f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")


def lower_each(col: Column) -> Column:
    """Lower case character by character: a capital sigma never becomes a final one."""
    return F.lower(F.translate(col, "Σİ", "σi"))


def normalise(col: Column | str) -> Column:
    """Trimmed, without combining marks, in lower case; null becomes the empty string."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(lower_each(strip_marks(trim_space(col))), F.lit(""))


def junk_flags(col: Column) -> dict[str, Column]:
    """A boolean for each reason to reject a normalised term."""
    return {"empty": col == "", "no_letter": (col != "") & ~col.rlike(LETTER), **{name: col.rlike(rx) for name, rx in JUNK}}


def accept(col: Column | str) -> Column:
    """Whether a normalised term may enter a corpus.  One pattern, so that a filter on a
    computed term computes it once."""
    col = F.col(col) if isinstance(col, str) else col
    junk = "|".join(rx.removeprefix("(?iu)") for _, rx in JUNK)
    return col.rlike(f"(?ius)^(?!.*(?:{junk})).*{LETTER}")


def bucket(col: Column | str, depth: int) -> Column:
    """The first `depth` code points; shorter terms whole."""
    return F.substring(col, 1, depth)


def edit_budget(col: Column, scheme: dict[int, int] | None = None) -> Column:
    """Allowed edits of a query by its length.  A scheme must have the key 0."""
    scheme = EDITS_BY_LENGTH if scheme is None else scheme
    if 0 not in scheme:
        raise ValueError("an edit scheme must say what holds from length 0")
    out = F.lit(scheme[0])
    for length in sorted(k for k in scheme if k):
        out = F.when(F.length(col) >= length, F.lit(scheme[length])).otherwise(out)
    return out


def clamp_limit(value: int | None, default: int = 10, most: int = 100) -> int:
    """Not positive or absent: the default; above the maximum: the maximum."""
    return default if value is None or value <= 0 else min(value, most)


def parse_int(col: Column, default: int, least: int, most: int) -> Column:
    """Empty, unreadable or below least: the default; above most: most."""
    n = col.try_cast("int")
    return F.when(n.isNull() | (n < least), F.lit(default)).otherwise(F.least(n, F.lit(most)))


def version_number(col: Column) -> Column:
    """N of vN, null for other names."""
    return F.nullif(F.regexp_extract(col, r"^v(\d+)$", 1), F.lit("")).cast("int")


def round3(col: Column) -> Column:
    return F.round(col, 3)


def route_key_parts(col: Column) -> tuple[Column, Column]:
    """Method and route of "METHOD /route", split at the first space."""
    parts = F.split(col, " ", 2)
    return F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
