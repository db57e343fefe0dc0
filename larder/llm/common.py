"""Helpers shared by the training-data operators.

Words are maximal runs of characters outside the ASCII white space set
(space, tab to carriage return); only A-Z is folded to lower case.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.session import checkpoint_dir, ship_package

SPACES = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
FOLD = str.maketrans(UPPER, LOWER)

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

# Odd multiplier of the polynomial word hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
PIECE_BYTES = 1 << 20
_POWERS: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder and package for the Python workers."""
    checkpoint_dir(spark)
    ship_package(spark)


def fold(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def words(col: Column) -> Column:
    """Array of words; empty for null."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), SPACES), lambda w: w != "")


def remainder(col: Column, mod: int) -> Column:
    """crc32 of the id as text modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % mod


def n_blocks(docs: DataFrame, text: str, block_bytes: int) -> int:
    """Blocks of about ``block_bytes`` of text needed for the whole table."""
    total = docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0
    return max(1, math.ceil(total / block_bytes))


def block_of(ident: str, text: str, n: int) -> Column:
    """Block number of a row, a function of the row alone, so that a recomputed
    task deals its rows out as before."""
    return F.pmod(F.xxhash64(F.col(ident), F.col(text)), F.lit(n)).cast("int")


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for key, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche step, so that any bits of a hash can serve as a bucket."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _pieces(data: bytes) -> Iterator[bytes]:
    """Parts of about PIECE_BYTES, cut at white space only."""
    at = 0
    while len(data) - at > PIECE_BYTES:
        window = np.frombuffer(data, np.uint8, count=len(data) - at - PIECE_BYTES, offset=at + PIECE_BYTES)
        step = 1 << 16
        cut = next((i + int(hit[0]) for i in range(0, len(window), step)
                    if len(hit := np.flatnonzero(IS_SPACE[window[i:i + step]]))), None)
        if cut is None:
            break
        yield data[at:at + PIECE_BYTES + cut]
        at += PIECE_BYTES + cut
    yield data[at:]


def _hash_buffer(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of each word of a buffer that ends in white space."""
    space = IS_SPACE[buf]
    before = np.concatenate(([True], space[:-1]))
    starts = np.flatnonzero(before & ~space)
    ends = np.flatnonzero(space & ~before)
    up, down = _powers(len(buf))
    run = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:len(buf)], out=run[1:])
    return starts, mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: list) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Word hashes of the texts in chunks of bounded memory.

    Yields (first, last, hashes, offsets): the words of texts[first:last] in
    order and the offset of each text's first word, with one more at the end.
    Texts are strings or UTF-8 bytes.  Null is taken as empty.  A text over
    PIECE_BYTES is hashed in parts cut at white space.
    """
    first, size, held = 0, 0, []

    def done(first: int, held: list):
        buf = np.frombuffer(b" ".join(held) + b" ", np.uint8)
        starts, hashes = _hash_buffer(buf)
        begins = np.cumsum([0] + [len(x) + 1 for x in held])
        return first, first + len(held), hashes, np.searchsorted(starts, begins)

    for i, text in enumerate(texts):
        data = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
        if len(data) > PIECE_BYTES:
            if held:
                yield done(first, held)
            parts = [_hash_buffer(np.frombuffer(p + b" ", np.uint8))[1] for p in _pieces(data)]
            hashes = np.concatenate(parts)
            yield i, i + 1, hashes, np.array([0, len(hashes)])
            first, size, held = i + 1, 0, []
            continue
        held.append(data)
        size += len(data)
        if size > PIECE_BYTES:
            yield done(first, held)
            first, size, held = i + 1, 0, []
    if held:
        yield done(first, held)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i + 1]] for each i; 0 where empty."""
    out = np.zeros(len(offsets) - 1)
    full = offsets[1:] > offsets[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, offsets[:-1][full])
    return out


class Lookup:
    """Open-addressing table from distinct 64-bit keys to their positions, for arrays of keys."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.slots = np.full(1 << bits, -1, dtype=np.int32)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = self.slots[at[left]] < 0
            self.slots[at[left[free]]] = left[free]
            left = left[self.slots[at[left]] != left]
            at[left] = (at[left] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 where it is missing."""
        if not len(keys) or not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int32)
        at = self._home(keys)
        found = self.slots[at]
        left = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            found[left] = self.slots[at[left]]
            left = left[(found[left] >= 0) & (self.keys[found[left]] != keys[left])]
        return found
