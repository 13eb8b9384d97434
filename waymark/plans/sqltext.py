"""Fixed text tables and shared expressions of the checking SQL."""

from __future__ import annotations

from waymark.functions import text


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values_cte(name: str, table: dict[str, dict[str, str]], columns: str) -> str:
    rows = ", ".join(f"({quoted(a)}, {quoted(b)}, {quoted(v)})" for a, r in table.items() for b, v in r.items())
    return f"{name}({columns}) AS (VALUES {rows})"


TEMPLATES_SQL = values_cte("templates", text.TEMPLATES, "k, lang, txt")
UNITS_SQL = values_cte("units", text.UNITS, "k, lang, txt")
QUALIFIERS_SQL = values_cte("quals", text.QUALIFIERS, "lang, k, txt")
SIDES_SQL = values_cte("sides", text.SIDES, "lang, k, txt")
ARRIVALS_SQL = values_cte("arrivals", text.ARRIVALS, "lang, k, txt")


def speak_sql(expr: str) -> str:
    """Speech rules in RE2 spelling."""
    for pattern, replacement in text.SPEECH_RULES:
        expr = f"regexp_replace({expr}, {quoted(pattern)}, {quoted(replacement.replace('$', chr(92)))}, 'g')"
    return expr
