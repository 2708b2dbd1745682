"""Digests, difference hashes and Hamming distances as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WORD_BITS = 60


def h60(c: Column) -> Column:
    """First 60 bits of the MD5 of a text: a seedable draw that any SQL engine can repeat."""
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("bigint")


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def dhash_bits(grid: Column, width: int, height: int) -> Column:
    """Difference hash of a row-major ``height x width`` grid as a text of 0/1: is each cell greater than its left
    neighbour? It gives ``height * (width - 1)`` bits."""
    rows = [F.zip_with(F.slice(grid, r * width + 2, width - 1), F.slice(grid, r * width + 1, width - 1),
                       lambda right, left: F.when(right > left, "1").otherwise("0")) for r in range(height)]
    return F.array_join(F.concat(*rows), "")


def words(bits: Column, n_bits: int) -> list[Column]:
    """The bits packed into bigint columns of at most 60 bits each."""
    return [F.conv(F.substring(bits, s + 1, min(WORD_BITS, n_bits - s)), 2, 10).cast("bigint")
            for s in range(0, n_bits, WORD_BITS)]


def dhash_hex(bits: Column, n_bits: int) -> Column:
    """The bits as lower-case hexadecimal text, four bits to a digit."""
    pieces = []
    for s in range(0, n_bits, WORD_BITS):
        n = min(WORD_BITS, n_bits - s)
        pieces.append(F.lpad(F.lower(F.conv(F.substring(bits, s + 1, n), 2, 16)), (n + 3) // 4, "0"))
    return F.concat(*pieces)


def hamming(a: list[Column], b: list[Column]) -> Column:
    """Distance of two hashes held as word columns; stays inside generated code."""
    total = F.lit(0)
    for x, y in zip(a, b, strict=True):
        total = total + F.bit_count(x.bitwiseXOR(y))
    return total


def hamming_arrays(a: Column, b: Column) -> Column:
    """Distance of two hashes held as word arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def row_fingerprint(cols: list[str]) -> Column:
    """60-bit digest of a row's text; NULL and blank differ."""
    shown = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in cols]
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *shown), 256), 1, 15), 16, 10).cast("bigint")
