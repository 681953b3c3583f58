"""Fragments of SQL that several queries' SQL needs."""

#: A common table expression ``crc`` with ``tab``, the 256 steps of CRC-32 by byte.
CRC_TABLE = """crc AS (
  SELECT [list_reduce([j, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR j IN range(256)] AS tab)"""


def crc32_of(codes: str) -> str:
    """CRC-32 of a list of byte codes, beside the table expression ``crc``."""
    return (
        f"xor(list_reduce(list_concat([4294967295], {codes}), lambda c, x:"
        " xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295)"
    )
