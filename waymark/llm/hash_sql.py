"""SQL that DuckDB lacks a function for: CRC-32 of a string's UTF-8 bytes, byte by byte over a table made by its rule."""

from __future__ import annotations

#: A macro cannot be set up where one statement is asked for, so the table is a common table expression of one row.
CRC_TABLE = """crc_table AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) AS r(i)))"""


def crc(text: str, table: str = "t") -> str:
    """Unsigned CRC-32 of the string expression ``text``; ``table`` is the column of ``crc_table``."""
    digits = f"hex(encode({text}))"
    byte = "(strpos('0123456789ABCDEF', x[1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2]) - 1"
    steps = f"list_transform(regexp_extract_all({digits}, '..'), lambda x: {byte})"
    return f"xor(list_reduce({steps}, lambda c, x: xor(c >> 8, {table}[1 + (xor(c, x) & 255)]), 4294967295::BIGINT), 4294967295)"
