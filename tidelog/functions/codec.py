"""Binary forms: record headers, deltas, digests, encryption."""

from __future__ import annotations

import hashlib
import hmac
import os
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..model import HEADER


def little_endian(n: Column, width: int) -> Column:
    """A whole number as bytes."""
    return F.unhex(F.concat(*(F.substring(F.lpad(F.hex(n.cast("bigint")), 16, "0"), 15 - 2 * i, 2) for i in range(width))))


def from_little_endian(raw: Column) -> Column:
    """Up to 8 bytes; a value above 2^63 is a decimal of its own."""
    return F.conv(_swapped(F.hex(raw)), 16, 10).cast("decimal(20,0)")


def _swapped(digits: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(0), (F.length(digits) / 2 - 1).cast("int")), lambda i: F.substring(digits, i * 2 + 1, F.lit(2)))
    return F.array_join(F.reverse(pairs), "")


def header(ts_ns: Column, event_type: Column, path_len: Column, delta_size: Column, file_size: Column) -> Column:
    """The 25 bytes before a record's path."""
    return F.concat(little_endian(ts_ns, 8), little_endian(event_type, 1), little_endian(path_len, 4), little_endian(delta_size, 4), little_endian(file_size, 8))


#: Bytes of the old content's blocks, of which one has to stand in the new content for a copy to be found.
COPY_BLOCK = 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Leading bytes that two arrays share."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        differ = a[at : at + step] != b[at : at + step] if at + step <= n else a[at:n] != b[at:n]
        if differ.any():
            return at + int(differ.argmax())
        at, step = min(n, at + step), step * 4
    return n


def _windows(x: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` bytes, up to a factor that depends on its place."""
    powers = np.cumprod(np.full(len(x), _BASE, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * powers)])
    back = np.cumprod(np.full(max(0, len(x) - size + 1), np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64))
    return (sums[size:] - sums[:-size])[: len(back)] * back


def delta_encode_bytes(old: bytes, new: bytes) -> bytes:
    """Copies from the old content and inserts of new: (offset u32, length u32) with
    the top bit of the length set for an insert, whose bytes follow. Empty for empty
    content. What both ends share is two copies; between them, blocks of all the old
    content are looked up at every place of the new by hash, and a hit is extended both ways
    as far as it goes. Work is linear in both contents, but for what repeats many times."""
    if not new:
        return b""
    a, b = np.frombuffer(old, np.uint8), np.frombuffer(new, np.uint8)
    head = _shared(a, b)
    tail = _shared(a[head:][::-1], b[head:][::-1])
    b = b[head : len(b) - tail]
    ops: list[tuple[int, int, bytes | None]] = [(0, head, None)] if head else []
    done = 0
    if len(a) >= COPY_BLOCK <= len(b):
        starts = np.arange(0, len(a) - COPY_BLOCK + 1, COPY_BLOCK)
        known, first = np.unique(_windows(a, COPY_BLOCK)[starts], return_index=True)
        hashes = _windows(b, COPY_BLOCK)
        slot = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        for i in np.nonzero(known[slot] == hashes)[0].tolist():
            if i < done:
                continue
            j = int(starts[first[slot[i]]])
            n = _shared(a[j:], b[i:])
            if n < COPY_BLOCK:
                continue
            before = _shared(a[max(0, j - (i - done)) : j][::-1], b[done:i][::-1])
            if i - before > done:
                ops.append((0, i - before - done, b[done : i - before].tobytes()))
            ops.append((j - before, n + before, None))
            done = i + n
    if done < len(b):
        ops.append((0, len(b) - done, b[done:].tobytes()))
    if tail:
        ops.append((len(old) - tail, tail, None))
    return b"".join(struct.pack("<II", at, n | (data is not None) << 31) + (data or b"") for at, n, data in ops)


def delta_decode_bytes(old: bytes, delta: bytes) -> bytes:
    out, i = [], 0
    while i < len(delta):
        at, n = struct.unpack_from("<II", delta, i)
        i += 8
        if n >> 31:
            n &= (1 << 31) - 1
            out.append(delta[i : i + n])
            i += n
        else:
            if at + n > len(old):
                raise ValueError("a copy reaches beyond the old content")
            out.append(old[at : at + n])
    return b"".join(out)


@F.pandas_udf(BinaryType())
def delta_encode(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([delta_encode_bytes(bytes(a or b""), bytes(b or b"")) for a, b in zip(old, new, strict=True)])


@F.pandas_udf(BinaryType())
def delta_decode(old: pd.Series, delta: pd.Series) -> pd.Series:
    return pd.Series([delta_decode_bytes(bytes(a or b""), bytes(d or b"")) for a, d in zip(old, delta, strict=True)])


@F.pandas_udf(BinaryType())
def blake2b(content: pd.Series) -> pd.Series:
    """32 bytes."""
    return content.map(lambda x: None if x is None else hashlib.blake2b(bytes(x), digest_size=32).digest())


def key_from(password: str, salt: bytes, iterations: int = 100_000) -> bytes:
    """C2. On the driver; the key reaches expressions as a literal, so plans hold it."""
    return hashlib.pbkdf2_hmac("blake2b", password.encode(), salt, iterations, 32)


def encrypt(content: Column, key: bytes, aad: Column) -> Column:
    """C1, SC4: AES-GCM with a record's header and path authenticated along."""
    return F.call_function("aes_encrypt", content, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), aad)


def decrypt(content: Column, key: bytes, aad: Column) -> Column:
    return F.call_function("aes_decrypt", content, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), aad)


def pack_header(ts_ns: int, event_type: int, path_len: int, delta_size: int, file_size: int) -> bytes:
    return struct.pack(HEADER, ts_ns, event_type, path_len, delta_size, file_size)


#: A store's crypto.meta is magic, version, iterations, salt and verifier; bounds of the iterations.
META_MAGIC, META_VERSION, META_BYTES, ITERATIONS = b"TTCRYPT1", 1, 61, (10_000, 10_000_000)
_META = "<8sBI16s32s"


def _verifier(key: bytes) -> bytes:
    return hashlib.blake2b(b"verify", digest_size=32, key=key).digest()


def new_meta(password: str, iterations: int = 100_000) -> tuple[bytes, bytes]:
    """C4: (meta, key) of a new store."""
    salt = os.urandom(16)
    key = key_from(password, salt, iterations)
    return struct.pack(_META, META_MAGIC, META_VERSION, iterations, salt, _verifier(key)), key


def meta_fault(meta: bytes) -> str | None:
    """What is wrong with a meta, if anything."""
    if len(meta) != META_BYTES:
        return "size"
    magic, version, iterations, _, _ = struct.unpack(_META, meta)
    if magic != META_MAGIC or version != META_VERSION:
        return "magic"
    return None if ITERATIONS[0] <= iterations <= ITERATIONS[1] else "iterations"


def unlock(meta: bytes, password: str) -> bytes:
    """C4: the key; ValueError for a damaged meta or a wrong password."""
    if fault := meta_fault(meta):
        raise ValueError(f"damaged meta: {fault}")
    _, _, iterations, salt, verifier = struct.unpack(_META, meta)
    key = key_from(password, salt, iterations)
    if not hmac.compare_digest(verifier, _verifier(key)):
        raise ValueError("wrong password")
    return key


def seal_bytes(spark: SparkSession, content: bytes, key: bytes, aad: bytes = b"") -> bytes:
    """Small contents, as a repo's own key or a side file, on the driver."""
    return bytes(spark.range(1).select(encrypt(F.lit(content), key, F.lit(aad))).first()[0])


def open_bytes(spark: SparkSession, content: bytes, key: bytes, aad: bytes = b"") -> bytes:
    return bytes(spark.range(1).select(decrypt(F.lit(content), key, F.lit(aad))).first()[0])


def block_key(hash_: Column, repo_key: bytes) -> Column:
    """Each block's own key, from the repo's and its hash."""
    return blake2b(F.concat(F.lit(repo_key), hash_))


def sealed_block(data: Column, key: Column) -> Column:
    """Equal blocks give equal ciphertexts: the nonce is zero, as a key has one content only."""
    return F.call_function("aes_encrypt", data, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(bytes(12)))


def opened_block(data: Column, key: Column) -> Column:
    return F.call_function("aes_decrypt", data, key, F.lit("GCM"))
