"""AES-GCM at rest with a ring of keys."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def encrypt(plain: Column, key: bytes) -> Column:
    """Nonce of 12 bytes, ciphertext and tag."""
    return F.aes_encrypt(plain, F.lit(key), F.lit("GCM"))


def decrypt_with_ring(sealed: Column, ring: list[bytes]) -> Column:
    """The plain bytes by the first key of ``ring`` that authenticates them; null where none does."""
    return F.coalesce(*[F.try_aes_decrypt(sealed, F.lit(key), F.lit("GCM")) for key in ring])


def derive_key(secret: bytes, purpose: str) -> bytes:
    """A 256-bit key of its own for each purpose."""
    return hashlib.sha256(len(secret).to_bytes(8, "big") + secret + purpose.encode()).digest()


def xor_mask(value: Column, mask: bytes) -> Column:
    """Each byte of ``value`` with the mask's, the mask repeated; its own inverse."""
    if not mask:
        return value
    digits = F.hex(value)
    masked = F.transform(
        F.sequence(F.lit(0), F.octet_length(value) - 1),
        lambda i: F.lpad(
            F.hex(
                F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10)
                .cast("int")
                .bitwiseXOR(F.element_at(F.array(*[F.lit(b) for b in mask]), (i % len(mask) + 1).cast("int")))
            ),
            2,
            "0",
        ),
    )
    return F.when(F.octet_length(value) == 0, value).otherwise(F.unhex(F.array_join(masked, "")))
