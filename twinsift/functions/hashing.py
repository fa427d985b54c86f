"""Stable hashes used for assignment, sampling order and cache keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_WORD = 8
HEX_WORD_SPAN = 16**HEX_WORD


def _hex_word(digest: Column, word: int) -> Column:
    return F.conv(F.substring(digest, 1 + word * HEX_WORD, HEX_WORD), 16, 10).cast("bigint")


def digest_modulo(key: Column, n: int) -> Column:
    """SHA-1 of the key read as one 160-bit number, modulo n (n below 2^31)."""
    digest = F.sha1(key.cast("binary"))
    words = [_hex_word(digest, w) for w in range(5)]
    return reduce(lambda acc, w: (acc * F.lit(HEX_WORD_SPAN) + w) % n, words[1:], words[0] % n)


def uniform(key: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the MD5 of the key."""
    return _hex_word(F.md5(key.cast("binary")), 0) / F.lit(float(HEX_WORD_SPAN))


def order_key(seed, key: Column) -> Column:
    """Text to sort by for a seeded, repeatable shuffle."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")).cast("binary"))


def seeded_uniform(seed, key: Column) -> Column:
    return uniform(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def content_key(identifier: Column) -> Column:
    return F.sha1(identifier.cast("string").cast("binary"))
