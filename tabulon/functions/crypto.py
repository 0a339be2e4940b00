"""Digests and ciphers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def password(x: Column) -> Column:
    """`*` and the double SHA-1 in capitals."""
    return F.concat(F.lit("*"), F.upper(F.sha1(F.unhex(F.sha1(x.cast("binary"))))))


def sha2(x: Column, bits: int) -> Column:
    return F.sha2(x.cast("binary"), 256 if bits == 0 else bits) if bits in (0, 224, 256, 384, 512) else F.lit(None).cast("string")


def folded_key(key: str) -> bytes:
    """A key of any length as 16 bytes: folded by exclusive or."""
    out = bytearray(16)
    for i, b in enumerate(key.encode()):
        out[i % 16] ^= b
    return bytes(out)


def aes_encrypt(x: Column, key: str) -> Column:
    return F.aes_encrypt(x.cast("binary"), F.lit(folded_key(key)), F.lit("ECB"), F.lit("PKCS"))


def aes_decrypt(x: Column, key: str) -> Column:
    """Null if the data is not a cipher text of the key."""
    return F.try_aes_decrypt(x.cast("binary"), F.lit(folded_key(key)), F.lit("ECB"), F.lit("PKCS"))
