"""Hex, base64, addresses, hashes and ciphers on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60
#: The form of an address.
ADDRESS = r"^0x[0-9a-fA-F]{40}$"


def to_hex(x: Column) -> Column:
    return F.lower(F.hex(x))


def from_hex(x: Column) -> Column:
    """Bytes of hex digits, with or without 0x."""
    return F.unhex(F.regexp_replace(x, "^0x", ""))


def swap_bytes(x: Column) -> Column:
    """Binary in reverse byte order."""
    pairs = F.regexp_extract_all(F.hex(x), F.lit("(..)"), F.lit(1))
    return F.unhex(F.array_join(F.reverse(pairs), ""))


def normalize_address(x: Column) -> Column:
    """0x and 40 digits: zeros go after 0x. Anything without 0x, or with more digits, is an error."""
    bad = F.raise_error(F.concat(F.lit("not an address: "), F.coalesce(x, F.lit("null"))))
    return F.when(x.startswith("0x") & (F.length(x) <= 42), F.concat(F.lit("0x"), F.lpad(F.substring(x, 3, 40), 40, "0"))).otherwise(bad)


def is_address(x: Column) -> Column:
    return x.rlike(ADDRESS)


def salted_hash(data: Column, salt: str) -> Column:
    """First 60 bits of SHA-256(salt then data), as a non-negative long."""
    digits = F.sha2(F.concat(F.lit(salt), data.cast("string")), 256)
    return F.conv(F.substring(digits, 1, HASH_BITS // 4), 16, 10).cast("long")


def shard_of(hashed: Column, shards: int) -> Column:
    """Equal ranges of the hash: 0 to shards - 1."""
    width = -(-(1 << HASH_BITS) // shards)
    return ((hashed - hashed % width) / width).cast("int")


def two_positions(data: Column, salt: str, size: int) -> Column:
    """struct(first, second, rest): two slots of a table and a residual, all from slices of one digest."""
    digits = F.sha2(F.concat(F.lit(salt), data.cast("string")), 256)
    part = lambda i: F.conv(F.substring(digits, 1 + 12 * i, 12), 16, 10).cast("long")
    return F.struct((part(0) % size).alias("first"), (part(1) % size).alias("second"), part(2).alias("rest"))


def encrypt(plain: Column, key: Column) -> Column:
    """AES-GCM with a random nonce in front and the tag behind."""
    return F.aes_encrypt(plain, key, F.lit("GCM"))


def decrypt(sealed: Column, key: Column) -> Column:
    return F.aes_decrypt(sealed, key, F.lit("GCM"))


def xor_words(a: Column, b: Column) -> Column:
    """Exclusive or of binaries, as long as the first; b is at least as long. By words of seven bytes."""
    digits = lambda x: F.regexp_extract_all(F.hex(x), F.lit("(?:..){1,7}"), F.lit(0))
    number = lambda h: F.conv(h, 16, 10).cast("long")

    def word(x: Column, y: Column) -> Column:
        return F.lpad(F.hex(number(x).bitwiseXOR(number(F.substring(y, F.lit(1), F.length(x))))), F.length(x), F.lit("0"))

    words = F.slice(digits(b), F.lit(1), F.size(digits(a)))
    return F.unhex(F.array_join(F.zip_with(digits(a), words, word), ""))


def ctr(data: Column, key: Column, nonce: Column, start: int = 0) -> Column:
    """AES-CTR, both ways: data xor the ciphers of nonce (12 bytes) and a block counter (4 bytes, most significant
    first, from start, modulo 2**32). The same nonce must never serve twice under one key."""
    blocks = F.sequence(F.lit(start).cast("long"), F.lit(start) + F.floor((F.length(data) + 15) / 16).cast("long"))
    counter = lambda i: F.unhex(F.lpad(F.hex(F.pmod(i, F.lit(1 << 32))), 8, "0"))
    # the cipher of one block; the second half of what ECB gives is padding
    stream = F.transform(blocks, lambda i: F.hex(F.substring(F.aes_encrypt(F.concat(nonce, counter(i)), key, F.lit("ECB"), F.lit("PKCS")), 1, 16)))
    return xor_words(data, F.unhex(F.array_join(stream, "")))


def epoch_to_iso(seconds: Column) -> Column:
    """UTC time of epoch seconds; expects the session's time zone to be UTC."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
