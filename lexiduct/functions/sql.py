"""The column functions as temporary SQL functions, for spark.sql()."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lexiduct.functions import text as T

NAMES = ("lexi_normalise", "lexi_accept", "lexi_bucket", "lexi_edit_budget")


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(spark: SparkSession) -> tuple[str, ...]:
    """Creates lexi_normalise(term), lexi_accept(word), lexi_bucket(term, depth) and
    lexi_edit_budget(query) in the session; returns their names.  They are SQL bodies of
    built-in functions, which the optimiser inlines."""
    one_from, one_to, longer = T._mark_tables()
    plain = f"translate(t, {_text(one_from)}, {_text(one_to)})"
    for a, b in longer:
        plain = f"replace({plain}, {_text(a)}, {_text(b)})"
    plain = f"if(octet_length(t) <> length(t), regexp_replace({plain}, {_text(chr(92) + 'p{Mn}')}, ''), t)"
    trimmed = f"regexp_replace(t, {_text(f'^{T.SPACE_CLASS}+|{T.SPACE_CLASS}+$')}, '')"
    junk = "|".join(rx.removeprefix("(?iu)") for _, rx in T.JUNK)
    steps = sorted(T.EDITS_BY_LENGTH.items(), reverse=True)
    bodies = {
        "_lexi_trim(t STRING) RETURNS STRING": trimmed,
        "_lexi_plain(t STRING) RETURNS STRING": plain,
        "lexi_normalise(t STRING) RETURNS STRING": "coalesce(lower(translate(_lexi_plain(_lexi_trim(t)), 'Σİ', 'σi')), '')",
        "lexi_accept(t STRING) RETURNS BOOLEAN": f"rlike(t, {_text(f'(?ius)^(?!.*(?:{junk})).*{T.LETTER}')})",
        "lexi_bucket(t STRING, depth INT) RETURNS STRING": "substring(t, 1, depth)",
        "lexi_edit_budget(t STRING) RETURNS INT": "CASE " + " ".join(f"WHEN length(t) >= {n} THEN {e}" for n, e in steps) + " END",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return NAMES
