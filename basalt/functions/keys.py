"""Block keys, sizes, references, codecs and ciphers as column expressions.

Keys are lower-case hex strings.  Secrets pass through the JVM's heap: there is no locked memory here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the archive format.
KEY_BYTES = 32
INLINE_BYTES = 160
REF_KEYS = INLINE_BYTES // KEY_BYTES
MAX_INDIRECTION = 4
MIN_BLOCK = 4096
DEFAULT_BLOCK = 65536
MAX_BLOCK = 4096 << 18
MAX_REFERENCED = 124
MAX_DEPTH = 100


def encryption_key(block: Column, salt: bytes) -> Column:
    """SHA-256 of salt and plain text: equal blocks under one salt have equal keys."""
    return F.sha2(F.concat(F.lit(salt), block), 256)


def storage_key(encryption: Column) -> Column:
    """SHA-256 of the raw encryption key: names a block without giving its key away."""
    return F.sha2(F.unhex(encryption), 256)


def mtime_key(path: Column, size: Column, mtime: Column, salt: bytes) -> Column:
    """SHA-256 of salt, big-endian size and modification second, and path."""
    wide = lambda n: F.unhex(F.lpad(F.hex(n), 16, "0"))
    return F.sha2(F.concat(F.lit(salt), wide(size), wide(mtime), F.encode(path, "UTF-8")), 256)


def valid_block_size(n: Column) -> Column:
    """At least 4096, a power of two, and within the codec's limit."""
    return (n >= MIN_BLOCK) & (n <= MAX_BLOCK) & (n.bitwiseAND(n - 1) == 0)


def valid_ref(ref: Column) -> Column:
    """ref: hex of length byte, indirection byte, payload.  Bad hex, odd length and empty input are invalid."""
    raw = F.when(ref.rlike("^([0-9A-Fa-f]{2})+$"), F.unhex(ref))
    size = F.conv(F.substring(ref, 1, 2), 16, 10).cast("int")
    level = F.conv(F.substring(ref, 3, 2), 16, 10).cast("int")
    direct = (level == 0) & (size <= INLINE_BYTES)
    keyed = (level > 0) & (level <= MAX_INDIRECTION) & (size >= KEY_BYTES) & (size % KEY_BYTES == 0) & (size <= INLINE_BYTES)
    whole = F.octet_length(raw) == size + 2
    # an empty file is an empty inline payload; an empty payload behind indirection is invalid
    return F.coalesce(whole & (direct | keyed), F.lit(False))


def keeps_compressed(plain: Column, packed: Column) -> Column:
    """The compressed form is kept if it saves more than a twentieth (integer division, strict)."""
    return (packed > 0) & (packed < plain) & (plain - packed > F.floor(plain / 20))


def seal(block: Column, key: Column, codec: Column | None = None) -> Column:
    """AES-256-GCM under the block's own key; the nonce is the codec's number and the length before sealing.

    A key belongs to one plain text, and a codec gives one packed form of it, so key and nonce never meet two texts.
    The stored form is longer by a nonce of 12 and a tag of 16 bytes, which detects damage.
    """
    wide = lambda n, digits: F.lpad(F.hex(n.cast("long")), digits, "0")
    nonce = F.unhex(F.concat(wide(F.lit(0) if codec is None else codec, 8), wide(F.octet_length(block), 16)))
    return F.aes_encrypt(block, F.unhex(key), F.lit("GCM"), F.lit("DEFAULT"), nonce)


def seal_ref(ref: Column, mtime: Column, salt: bytes) -> Column:
    """A reference in a table of modification times: sealed under the salt's hash, the nonce from the entry's key."""
    return F.aes_encrypt(F.unhex(ref), F.unhex(F.sha2(F.lit(salt), 256)), F.lit("GCM"), F.lit("DEFAULT"), F.unhex(F.substring(mtime, 1, 24)))


def unseal_ref(sealed: Column, salt: bytes) -> Column:
    return F.lower(F.hex(F.aes_decrypt(sealed, F.unhex(F.sha2(F.lit(salt), 256)), F.lit("GCM"))))


def ref(indirection: Column, payload: Column) -> Column:
    """A reference in hex: length and indirection bytes, then the inlined content or the keys (hex)."""
    return F.lower(F.concat(F.lpad(F.hex((F.length(payload) / 2).cast("long")), 2, "0"), F.lpad(F.hex(indirection.cast("long")), 2, "0"), payload))


def unseal(stored: Column, key: Column) -> Column:
    return F.aes_decrypt(stored, F.unhex(key), F.lit("GCM"))


#: Codec names of the command line -> (Arrow codec, level, identifier on disk).  lz4hc decodes as lz4.
CODECS = {"lz4": ("lz4_raw", None, 0), "lz4hc": ("lz4_raw", 9, 0), "zstd": ("zstd", 3, 1)}


def compressed(block: Column, codec: str = "zstd") -> Column:
    name, level, _ = CODECS[codec]

    @F.arrow_udf("binary")
    def pack(column):
        import pyarrow as pa

        coder = pa.Codec(name, compression_level=level)
        return pa.array([coder.compress(x.as_buffer(), asbytes=True) if x.is_valid else None for x in column], pa.binary())

    return pack(block)


def decompressed(block: Column, size: Column, codec: str = "zstd") -> Column:
    name, _, _ = CODECS[codec]

    @F.arrow_udf("binary")
    def unpack(column, sizes):
        import pyarrow as pa

        coder = pa.Codec(name)
        return pa.array([coder.decompress(x.as_buffer(), n, asbytes=True) if x.is_valid else None for x, n in zip(column, sizes.to_pylist(), strict=True)], pa.binary())

    return unpack(block, size)
