"""Hex-encoded binary hashes and 8x8 plane hashes."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_bits(h: Column) -> Column:
    """A hash of at most 16 hex digits as BIGINT (two's complement)."""
    return F.conv(h, 16, -10).cast("bigint")


def hash_words(h: Column) -> Column:
    """A hex hash of any length as an array of 64-bit words, for block comparison."""
    chunks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(h) / 16).cast("int") - 1))
    return F.transform(chunks, lambda i: hex_bits(F.substring(h, i * 16 + 1, F.lit(16))))


def hamming(a: Column, b: Column, digits: int = 16) -> Column:
    """Differing bits of two equal-length hex hashes of ``digits`` digits; unequal lengths raise."""
    pieces = [
        F.bit_count(hex_bits(F.substring(a, i + 1, 16)).bitwiseXOR(hex_bits(F.substring(b, i + 1, 16))))
        for i in range(0, max(digits, 1), 16)
    ]
    distance = reduce(lambda x, y: x + y, pieces).cast("int")
    return (F.when(F.length(a) != F.length(b), F.raise_error(F.lit("hash lengths differ")).cast("int"))
            .when(F.length(a) == 0, F.lit(0)).otherwise(distance))


def hash_similarity(a: Column, b: Column, digits: int = 16) -> Column:
    """1 - share of differing bits; 0 for empty hashes."""
    return F.when(F.length(a) == 0, F.lit(0.0)).otherwise(
        F.lit(1.0) - hamming(a, b, digits) / (F.length(a) * 4)
    )


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; lambdas would recompute it per element."""
    return F.transform(F.array(value), body)[0]


def bits_to_hex(bits: Column) -> Column:
    """Pack an array of 64 booleans, most significant first, into 16 hex digits."""
    text = F.array_join(F.transform(bits, lambda b: b.cast("int").cast("string")), "")
    return bind(text, lambda t: F.lower(F.concat(*[
        F.lpad(F.conv(F.substring(t, start, 32), 2, 16), 8, "0") for start in (1, 33)])))


def average_hash(plane: Column) -> Column:
    """Bit per cell of a flat 8x8 plane: brighter than the mean."""
    mean = lambda p: F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x) / F.size(p)
    return bits_to_hex(bind(plane, lambda p: bind(mean(p), lambda m: F.transform(p, lambda x: x > m))))


def difference_hash(plane: Column) -> Column:
    """Bit per horizontal step of a flat 8x9 plane: right brighter than left."""
    at = lambda p, i, step: F.element_at(p, (F.floor(i / 8) * 9 + i % 8 + step).cast("int"))
    return bits_to_hex(bind(plane, lambda p: F.transform(
        F.sequence(F.lit(0), F.lit(63)), lambda i: at(p, i, 2) > at(p, i, 1))))


def dct_basis(size: int) -> list[list[float]]:
    """Orthonormal DCT-II basis rows."""
    rows = []
    for u in range(size):
        scale = math.sqrt((1.0 if u == 0 else 2.0) / size)
        rows.append([scale * math.cos(math.pi * (2 * x + 1) * u / (2 * size)) for x in range(size)])
    return rows


def low_frequencies(plane: Column, side: int = 8) -> Column:
    """The 64 lowest DCT coefficients of a flat plane, row by row (separable: rows, then columns)."""
    basis = F.array(*[F.array(*[F.lit(v) for v in row]) for row in dct_basis(side)[:8]])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    rows = lambda p: F.transform(
        F.sequence(F.lit(0), F.lit(side - 1)), lambda y: F.slice(p, (y * side + 1).cast("int"), side))
    # one array of `side` row projections per horizontal frequency
    across = lambda r: F.transform(basis, lambda b: F.transform(r, lambda row: dot(row, b)))
    down = lambda cols: F.flatten(F.transform(basis, lambda b: F.transform(cols, lambda column: dot(column, b))))
    return bind(plane, lambda p: bind(rows(p), lambda r: bind(across(r), down)))


def perceptual_hash(plane: Column, side: int = 8) -> Column:
    """Low 8x8 DCT block of a flat square plane against the median without first row and column."""
    inner = lambda low: F.filter(
        F.transform(low, lambda x, i: F.when((i % 8 > 0) & (i >= 8), x)), lambda x: x.isNotNull())
    median = lambda low: F.element_at(F.sort_array(inner(low)), 25)
    return bits_to_hex(bind(low_frequencies(plane, side), lambda low: bind(
        median(low), lambda m: F.transform(low, lambda x: x > m))))
