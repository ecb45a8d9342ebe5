"""Opaque mark codes and their 64-bit messages."""

from __future__ import annotations

import hashlib
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAYLOAD_VERSION = 1


def message_words_of(code: Column) -> tuple[Column, Column]:
    """The two 32-bit words of an 8-digit hex code's message: the code, and the CRC-32 of its four bytes."""
    return F.conv(code, 16, 10).cast("bigint"), F.crc32(F.unhex(code))


def message_bits(code: Column) -> Column:
    """64 message bits of an 8-digit hex code: the code, then the CRC-32 of its four bytes."""
    word = lambda v: F.transform(F.sequence(F.lit(31), F.lit(0), F.lit(-1)),
                                 lambda i: F.getbit(v, i).cast("int"))
    code_word, check = message_words_of(code)
    return F.concat(word(code_word), word(check))


def bits_word(bits: Column, start: int) -> Column:
    """32 bits from ``start`` (0-based), most significant first, as BIGINT."""
    return F.aggregate(F.slice(bits, start + 1, 32), F.lit(0).cast("bigint"),
                       lambda acc, b: acc * 2 + b.cast("bigint"))


def word_hex(word: Column) -> Column:
    return F.lower(F.lpad(F.hex(word), 8, "0"))


def crc_of_word(word: Column) -> Column:
    return F.crc32(F.unhex(F.lpad(F.hex(word), 8, "0")))


def crc_valid(bits: Column) -> Column:
    return crc_of_word(bits_word(bits, 0)) == bits_word(bits, 32)


def issue_codes(assets: DataFrame, bits: int = 32) -> DataFrame:
    """Add ``watermark_code``: a keyed-down BLAKE2s of version, owner token, asset and channel.

    Spark has no BLAKE2s, so this is the one Arrow UDF of the module; rows stay independent.
    """

    @F.pandas_udf("string")
    def code(owner: pd.Series, asset: pd.Series, channel: pd.Series) -> pd.Series:
        def one(user: str, item: str, chan: str | None) -> str:
            token = uuid.uuid5(uuid.NAMESPACE_URL, user)
            text = "|".join((str(PAYLOAD_VERSION), str(token), item, chan or ""))
            raw = int.from_bytes(hashlib.blake2s(text.encode(), digest_size=8).digest(), "big")
            return f"{raw % (1 << bits):08x}"

        return pd.Series([one(u, a, c) for u, a, c in zip(owner, asset, channel)], dtype="object")

    channel = F.col("distribution_id") if "distribution_id" in assets.columns else F.lit(None)
    return assets.withColumn("watermark_code", code(
        F.col("user_id").cast("string"), F.col("asset_id").cast("string"), channel.cast("string")))


def code_collisions(assets: DataFrame) -> DataFrame:
    """Codes issued more than once."""
    return (assets.where(F.col("watermark_code").isNotNull()).groupBy("watermark_code")
            .agg(F.count("*").alias("assets")).where("assets > 1"))
