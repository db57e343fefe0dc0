"""Byte-level BPE encoding and decoding over a distinct-word table.

Rows are dealt into blocks by a hash.  Each block gives its distinct words
(pre-tokens), packed by bucket of the word's hash; the words of all blocks meet
in their bucket, in which each is encoded once; the ids go back to the blocks
that asked and are joined to the texts by word position.  Decoding joins each
id to its piece (the vocabulary, a bounded table) and concatenates the pieces.

The texts are shuffled once: the block exchange serves both the word table and
the final join.  A word travels once per block, so a frequent word is no hot key.
There are half as many buckets as blocks, so a bucket holds about as many words
as two blocks ask for, whatever the corpus; a block's result is built in parts
of about PART_WORDS words.

Nulls and oddities: a null text is encoded as the empty text.  Strings of
special tokens in a text are encoded as the library does, as that token.
Repeated rows and null ids are kept, one result each.
"""

from __future__ import annotations

import hashlib
import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import block_of, n_blocks, prepare, table

# Fixed value: the pre-token pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"
BLOCK_BYTES = 8 << 20
DIGEST_BLOCK_BYTES = 16 << 20  # a block's digests are small; larger blocks ask for fewer words
PART_WORDS = 1 << 17  # words of a block that are joined at a time
BATCH_WORDS = 1 << 13  # words that the library encodes at a time

_WORD = regex.compile(PATTERN)
_LOADED: dict[str, tuple] = {}


def vocabulary(path: str):
    """Tokenizer and piece bytes by id (an Arrow array), loaded once per worker."""
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        # Byte-level vocabularies write bytes as printable characters: those that
        # print stand for themselves, the rest are numbered from 256 in order.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        other = [b for b in range(256) if b not in set(plain)]
        back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        pieces = [b""] * tok.get_vocab_size(with_added_tokens=True)
        for piece, i in tok.get_vocab(with_added_tokens=True).items():
            pieces[i] = bytes(back[c] for c in piece)
        _LOADED[path] = tok, pa.array(pieces, pa.large_binary())
    return _LOADED[path]


def split_words(text: str | None, special: str = SPECIAL) -> list[str]:
    """Pre-tokens in order; special tokens split the text first."""
    if not text:
        return []
    parts = text.split(special)
    found = _WORD.findall(parts[0])
    for p in parts[1:]:
        found.append(special)
        found += _WORD.findall(p)
    return found


def encode_words(words: list[str], path: str) -> list[bytes]:
    """Ids of each word as little-endian unsigned 32-bit integers."""
    tok, _ = vocabulary(path)
    return [np.array(e.ids, dtype="<u4").tobytes() for i in range(0, len(words), BATCH_WORDS)
            for e in tok.encode_batch(words[i:i + BATCH_WORDS], add_special_tokens=False)]


def pack(values: list[bytes]) -> bytes:
    """Values as one compressed string: their number, their lengths, their bytes."""
    sizes = np.array([len(values), *map(len, values)], dtype="<u4")
    return zstandard.ZstdCompressor(level=3).compress(sizes.tobytes() + b"".join(values))


def unpack(packed: list[bytes], kind: pa.DataType) -> pa.Array:
    """The values of several packed strings in order, as one array of large strings or binaries."""
    sizes, data = [np.zeros(1, dtype=np.int64)], []
    squeezed = zstandard.ZstdDecompressor()
    for p in packed:
        raw = squeezed.decompress(p)
        n = int(np.frombuffer(raw, "<u4", count=1)[0])
        sizes.append(np.frombuffer(raw, "<u4", count=n, offset=4))
        data.append(memoryview(raw)[4 + 4 * n:])
    ends = np.cumsum(np.concatenate(sizes), dtype=np.int64)
    return pa.Array.from_buffers(kind, len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(b"".join(data))])


def words_of(block: pa.Table) -> Iterator[list[str]]:
    """Pre-tokens of each text of a block."""
    squeezed = zstandard.ZstdDecompressor()
    for t in block.column("packed"):
        yield split_words(squeezed.decompress(t.as_py()).decode() if t.is_valid else None)


def distinct_words(block: pa.Table, buckets: int) -> pa.Table:
    """The distinct words of a block, one row per bucket: (block, bucket, words)."""
    seen: set[str] = set()
    for found in words_of(block):
        seen.update(found)
    words = sorted(w.encode() for w in seen)
    del seen
    bucket = np.array([zlib.crc32(w) % buckets for w in words], dtype=np.int32)
    order = np.argsort(bucket, kind="stable")
    numbers, starts = np.unique(bucket[order], return_index=True)
    rows = [pack([words[i] for i in part]) for part in np.split(order, starts[1:])] if len(numbers) else []
    number = np.full(len(numbers), block.column("block")[0].as_py(), dtype=np.int32)
    return pa.table({"block": number, "bucket": numbers.astype(np.int32), "words": pa.array(rows, pa.binary())})


def encoded_bucket(rows: pa.Table, path: str) -> pa.Table:
    """The rows of a bucket with the ids of their words; each word is encoded once."""
    asked = [unpack([w.as_py()], pa.large_string()) for w in rows.column("words")]
    words = pa.chunked_array(asked, pa.large_string()).unique()
    ids = pa.array(encode_words(words.to_pylist(), path), pa.large_binary())
    coded = [pack(ids.take(pc.index_in(a, value_set=words)).to_pylist()) for a in asked]
    return pa.table({"block": rows.column("block"), "words": rows.column("words"), "ids": pa.array(coded, pa.binary())})


def joined_block(block: pa.Table, answers: pa.Table, path: str, digests: bool) -> Iterator[pa.RecordBatch]:
    """The results of a block's texts, in parts of about PART_WORDS words."""
    _, pieces = vocabulary(path)
    words = unpack(answers.column("words").to_pylist(), pa.large_string())
    ids_of = unpack(answers.column("ids").to_pylist(), pa.large_binary())

    def part(first: int, ends: list[int], found: list[str]) -> pa.RecordBatch:
        at = pc.index_in(pa.array(found, pa.large_string()), value_set=words)
        if at.null_count:
            raise KeyError(found[pc.index(at.is_null(), True).as_py()])
        word_ends, ids = flat(ids_of.take(at))
        piece_ends, text = flat(pieces.take(pa.array(np.frombuffer(ids, "<u4"))))
        cut = word_ends[ends]
        coded = [bytes(ids[a:b]) for a, b in zip(cut, cut[1:])]
        byte = piece_ends[cut // 4]
        texts = [str(text[a:b], "utf-8", "replace") for a, b in zip(byte, byte[1:])]
        if digests:
            coded = [hashlib.sha256(x).hexdigest() for x in coded]
            texts = [hashlib.sha256(x.encode()).hexdigest() for x in texts]
        return pa.RecordBatch.from_arrays(
            [idents.slice(first, len(texts)), pa.array(np.diff(cut) // 4, pa.int64()),
             pa.array(coded, pa.string() if digests else pa.binary()), pa.array(texts, pa.string())],
            names=["id", "n_tokens", "ids", "decoded"])

    idents = block.column("id").combine_chunks()
    first, ends, held = 0, [0], []
    for found in words_of(block):
        held += found
        ends.append(len(held))
        if len(held) >= PART_WORDS:
            yield part(first, ends, held)
            first, ends, held = first + len(ends) - 1, [0], []
    yield part(first, ends, held)


def flat(values: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Ends of the values, 0 before the first, and their bytes."""
    if not len(values):
        return np.zeros(1, np.int64), memoryview(b"")
    _, ends, data = values.buffers()
    ends = np.frombuffer(ends, np.int64, count=len(values) + 1, offset=8 * values.offset)
    return ends - ends[0], memoryview(data or b"")[ends[0]:ends[-1]]


def code(docs: DataFrame, path: str, ident: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES,
         digests: bool = False) -> DataFrame:
    """Encode and decode every row: (id, n_tokens, ids, decoded), or with
    ``digests`` the SHA-256 of both in their place.  ``ids`` is binary, four
    bytes per id."""
    blocks = n_blocks(docs, text, block_bytes)
    kind = docs.schema[ident].dataType.simpleString()

    def squeeze(batches):
        compress = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            packed = [compress(t.as_py().encode()) if t.is_valid else None for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], names=["block", "id", "packed"])

    # Texts travel compressed: they are the bulk of what this operator shuffles.
    dealt = docs.select(block_of(ident, text, blocks).alias("block"), F.col(ident).alias("id"), F.col(text).alias("text")).mapInArrow(
        squeeze, f"block int, id {kind}, packed binary")

    buckets = math.ceil(blocks / 2)

    def distinct(block: pa.Table) -> pa.Table:
        return distinct_words(block, buckets)

    def encode(rows: pa.Table) -> pa.Table:
        coded = encoded_bucket(rows, path)
        pa.default_memory_pool().release_unused()  # workers live on between stages
        return coded

    def join(block: pa.Table, answers: pa.Table) -> pa.Table:
        # In parts, as a table in one piece would reach the JVM as one buffer.
        joined = pa.Table.from_batches(list(joined_block(block, answers, path, digests)))
        pa.default_memory_pool().release_unused()
        return joined

    asked = dealt.groupBy("block").applyInArrow(distinct, "block int, bucket int, words binary")
    answers = asked.groupBy("bucket").applyInArrow(encode, "block int, words binary, ids binary")
    ids_kind = "string" if digests else "binary"
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        join, f"id {kind}, n_tokens bigint, ids {ids_kind}, decoded string")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    prepare(spark)
    coded = code(table(spark, sf_dir, "documents"), path or default_vocabulary(), block_bytes=DIGEST_BLOCK_BYTES, digests=True)
    return coded.select(F.col("id").alias("doc_id"), "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))
