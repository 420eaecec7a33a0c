"""Column functions: ids, numbers, checksums, names, encryption."""

from .hashes import blake3, blake3_chain, blake3_of
from .checksum import crc32c, crc32c_of, sha256_chain
from .crypto import decrypt_with_ring, derive_key, encrypt, xor_mask
from .ids import encode_gid, gid_local, gid_shard, shard_bits, u64
from .names import (
    event_type_ok,
    metadata_keys_ok,
    metadata_size_ok,
    namespace_ok,
    rejection,
    stream_ok,
)

__all__ = [
    "blake3",
    "blake3_chain",
    "blake3_of",
    "crc32c",
    "crc32c_of",
    "decrypt_with_ring",
    "derive_key",
    "encode_gid",
    "encrypt",
    "event_type_ok",
    "gid_local",
    "gid_shard",
    "metadata_keys_ok",
    "metadata_size_ok",
    "namespace_ok",
    "rejection",
    "sha256_chain",
    "shard_bits",
    "stream_ok",
    "u64",
    "xor_mask",
]
