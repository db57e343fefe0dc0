"""Token-id files: documents as zstandard frames that share one trained dictionary.

A folder holds three Parquet tables, so that Spark's writer commits them and any
store Spark reaches can hold them:

``dictionary``  one row: the dictionary's bytes, their SHA-256, the end id.
``segments``    rows of at most ``SEGMENT_BYTES`` of frames: shard, first id of
                the segment within its shard, number of documents and ids, least
                and greatest document id, the dictionary's SHA-256, and as binary
                arrays the document ids, ids per document, frame offsets and the
                frames themselves.  A frame is one document: its ids as
                little-endian unsigned 32-bit integers, compressed on their own.
``shards``      per shard the number of ids in all shards before it.

Documents lie in ascending order of id over segments and shards.  One document
is read by the segments whose id range holds it (Parquet statistics skip the
others) and the offset index: only its own frame is decompressed.

Texts are encoded where they are read; only compressed frames are shuffled, once.
The dictionary is trained on a bounded, documented sample: about ``SAMPLES``
documents of up to about ``SAMPLE_BYTES`` of ids, chosen by hash.  It changes the
size of the files, never what is read back.

Nulls and oddities: a null text is the empty text, which has the end id alone.
Null ids come first.  Rows of one id are ordered by their frame's bytes, and equal rows
each have their place.  An empty table gives a folder without segments.
Columns of other names are ignored.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.bpe import SPECIAL, default_vocabulary, split_words, vocabulary
from larder.llm.common import prepare, table
from larder.session import checkpoint_dir

END_ID = 0
SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 2048, 32 << 10, 64 << 10
SEGMENT_BYTES, SHARD_BYTES = 1 << 20, 16 << 20
ROW_GROUP_BYTES = 8 << 20  # what a reader holds at a time
LEVEL = 3
CHUNK_CHARS = 1 << 20  # texts split into words at a time
HELD = 800_000  # words whose ids a task remembers
ROWS = 512  # documents taken from Arrow at a time

# Ranges that hold letters alone, marks alone and white space alone.  Over them the standard
# library's patterns split as the vocabulary's pattern does.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u0481\u048a-\u052f"
_MARKS = "!-/:-@\\[-`{-~\u00a1-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u2010-\u2027"
_UNCOMMON = re.compile(f"[^{_LETTERS}{_MARKS}0-9 \t\n\r]")
_COMMON_WORD = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[{_MARKS}]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+")


class _Numbers(dict):
    """Number of each word in order of first sight; ``new`` holds those not yet encoded."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


def words_of(text: str | None) -> list[str]:
    """Pre-tokens as ``split_words`` gives them; texts of common letters and marks take a faster pattern."""
    if not text:
        return []
    if SPECIAL in text or _UNCOMMON.search(text):
        return split_words(text)
    return _COMMON_WORD.findall(text)


class Encoder:
    """Ids of texts as bytes; each word is encoded once while remembered."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer, _ = vocabulary(path)
        self.numbers, self.ids, self.at, self.seen = _Numbers(), np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def forget(self) -> None:
        """Of too many words those seen once go; all, if that is not enough."""
        often = self.seen > 1
        stay = often if often.sum() <= HELD // 2 else np.zeros_like(often)
        lengths = np.diff(self.at)
        self.ids = self.ids[np.repeat(stay, lengths)]
        self.at = np.concatenate(([0], np.cumsum(lengths[stay])))
        kept = [w for w, s in zip(self.numbers, stay) if s]
        self.numbers, self.seen = _Numbers(), np.zeros(len(kept), np.int64)  # to be seen again before the next time
        self.numbers.update(zip(kept, range(len(kept))))

    def learn(self) -> None:
        """Encode the words that have a number but no ids yet."""
        new = self.numbers.new
        coded = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        lengths = np.fromiter(map(len, coded), np.int64, count=len(coded))
        self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(lengths)))
        self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(coded), "<u4", count=int(lengths.sum()))))
        self.seen = np.pad(self.seen, (0, len(new)))
        new.clear()

    def __call__(self, texts: list, end: int):
        last, k = np.array([end], "<u4").tobytes(), 0
        while k < len(texts):
            found, size = [], 0
            while k < len(texts) and size < CHUNK_CHARS:
                found.append(words_of(texts[k]))
                size += len(texts[k] or "") + 1
                k += 1
            if len(self.numbers) > HELD:
                self.forget()
            words = np.cumsum([0, *map(len, found)])
            codes = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(found)), np.int64, count=int(words[-1]))
            if self.numbers.new:
                self.learn()
            self.seen += np.bincount(codes, minlength=len(self.numbers))
            first, n = self.at[codes], self.at[codes + 1] - self.at[codes]
            ends = np.concatenate(([0], np.cumsum(n)))
            out = self.ids[np.repeat(first - ends[:-1], n) + np.arange(ends[-1])]
            cuts = ends[words]
            for i, j in zip(cuts[:-1], cuts[1:]):
                yield out[i:j].tobytes() + last


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder: the words of one task serve the next."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """Dictionary of the samples; empty where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary_of(docs: DataFrame, path: str, ident: str, text: str, end: int) -> bytes:
    """Dictionary trained on about ``SAMPLES`` of the shorter documents, those whose hash
    lies below a bound set by their number."""
    body = F.coalesce(F.col(text), F.lit(""))
    short = docs.where(F.octet_length(body) <= SAMPLE_BYTES // 4)
    bound = int(min(1.0, SAMPLES / max(1, docs.count())) * (1 << 63))
    picked = short.where(F.shiftrightunsigned(F.xxhash64(F.col(ident), body), 1) < F.lit(min(bound, (1 << 63) - 1))).select(body.alias("t"))
    texts = sorted(r["t"] for r in picked.limit(4 * SAMPLES).collect())  # the limit holds where one row repeats endlessly
    return train(list(encoder(path)(texts, end)))


def _codec(data: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(data)} if data else {}


def write(docs: DataFrame, folder: str, path: str, ident: str = "doc_id", text: str = "text", end: int = END_ID,
          segment_bytes: int = SEGMENT_BYTES, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode every row of ``docs`` and write the folder's tables."""
    spark = docs.sparkSession
    data = dictionary_of(docs, path, ident, text, end)
    digest = hashlib.sha256(data).hexdigest()
    spark.createDataFrame([(digest, data, end)], "sha256 string, data binary, end_id int").coalesce(1).write.parquet(f"{folder}/dictionary")

    def encode(batches):
        compress, ids_of = zstandard.ZstdCompressor(level=LEVEL, **_codec(data)).compress, encoder(path)
        for b in batches:
            for first in range(0, b.num_rows, ROWS):
                part, counts, frames = b.slice(first, ROWS), [], []
                for ids in ids_of(part.column(1).to_pylist(), end):
                    counts.append(len(ids) // 4)
                    frames.append(compress(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(frames, pa.binary())], names=["id", "n", "frame"])

    # Written before it is dealt out: the range bounds would else encode everything twice,
    # and ``seq`` (which splits equal rows) must not change when a task runs again.
    frames = (
        docs.select(F.col(ident).cast("long"), F.col(text)).mapInArrow(encode, "id bigint, n bigint, frame binary")
        .withColumn("seq", F.monotonically_increasing_id()).checkpoint()
    )
    total = frames.agg(F.sum(F.octet_length("frame").cast("long"))).first()[0] or 0
    shards = max(1, math.ceil(total / shard_bytes), min(spark.sparkContext.defaultParallelism, math.ceil(total / segment_bytes)))
    order = ["id", F.xxhash64("frame"), "seq"]
    dealt = (
        frames.repartitionByRange(shards, *order).sortWithinPartitions(*order)
        .select(F.spark_partition_id().alias("shard"), "id", "n", "frame")
    )
    names = ["shard", "first", "docs", "ids", "least", "greatest", "sha256", "doc_ids", "counts", "offsets", "frames"]

    def pack(batches):
        held, size, shard, first = [], 0, None, 0

        def out():
            ids, counts, parts = zip(*held)
            known = [i for i in ids if i is not None]
            offsets = np.cumsum([0, *map(len, parts)])
            values = (shard, first, len(held), sum(counts), min(known, default=None), max(known, default=None), digest,
                      list(ids), list(counts), offsets.tolist(), b"".join(parts))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(),
                     pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

        for b in batches:
            shard = b.column(0)[0].as_py() if b.num_rows else shard
            for i, n, frame in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if held and size + len(frame) > segment_bytes:
                    yield out()
                    first += sum(h[1] for h in held)
                    held, size = [], 0
                held.append((i, n, frame))
                size += len(frame)
        if held:
            yield out()

    schema = ("shard int, first bigint, docs bigint, ids bigint, least bigint, greatest bigint, sha256 string, "
              "doc_ids array<bigint>, counts array<bigint>, offsets array<bigint>, frames binary")
    # The frames are compressed already, so Parquet adds only cheap coding.
    dealt.mapInArrow(pack, schema).write.option("compression", "uncompressed").option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{folder}/segments")
    sums = sorted(spark.read.parquet(f"{folder}/segments").groupBy("shard").agg(F.sum("ids"), F.sum("docs")).collect())  # one row per shard of SHARD_BYTES
    before = np.cumsum([0, *(r[1] for r in sums)]).tolist()
    spark.createDataFrame([(r[0], b, r[1], r[2]) for r, b in zip(sums, before)], "shard int, base bigint, ids bigint, docs bigint").coalesce(1).write.parquet(f"{folder}/shards")


def dictionary(spark: SparkSession, folder: str) -> tuple[str, bytes]:
    """The folder's dictionary, checked against its hash."""
    row = spark.read.parquet(f"{folder}/dictionary").first()
    data = bytes(row["data"])
    if hashlib.sha256(data).hexdigest() != row["sha256"]:
        raise ValueError(f"the dictionary in {folder} is not the one its hash names")
    return row["sha256"], data


def _documents(segments: DataFrame, digest: str, data: bytes, wanted: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    ask = None if wanted is None else set(wanted)
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:5 if with_ids else 4]
    columns = ["sha256", "base", "first", "doc_ids", "counts", "offsets", "frames"]

    def run(batches):
        unpack = zstandard.ZstdDecompressor(**_codec(data)).decompress
        for b in batches:
            for k in range(b.num_rows):
                sha, base, first, doc_ids, counts, at = (b.column(c)[k].as_py() for c in range(6))
                if sha != digest:
                    raise ValueError("a segment was written with another dictionary")
                starts = base + first + np.cumsum([0, *counts])
                frames = memoryview(b.column(6)[k].as_buffer())
                pick = [j for j, i in enumerate(doc_ids) if ask is None or i in ask]
                for low in range(0, len(pick), ROWS):
                    part = pick[low:low + ROWS]
                    ids = [unpack(frames[at[j]:at[j + 1]]) for j in part]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([doc_ids[j] for j in part], pa.int64()), pa.array([int(starts[j]) for j in part], pa.int64()),
                        pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                        *([pa.array(ids, pa.binary())] if with_ids else [])], names=names)

    return segments.select(*columns).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def read(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document; ``ids`` is binary,
    four bytes per id, and left out on request."""
    segments = spark.read.parquet(f"{folder}/segments").join(spark.read.parquet(f"{folder}/shards").select("shard", "base"), "shard")
    return _documents(segments, *dictionary(spark, folder), with_ids=with_ids)


def read_ids(spark: SparkSession, folder: str, ids: list[int]) -> DataFrame:
    """As ``read``, of the named documents alone: other segments are skipped by their
    range of ids, other documents of a segment by the offset index."""
    segments = spark.read.parquet(f"{folder}/segments")
    hit = F.lit(False)
    for i in ids:
        hit = hit | ((F.col("least") <= i) & (F.col("greatest") >= i))
    return _documents(segments.where(hit).join(spark.read.parquet(f"{folder}/shards").select("shard", "base"), "shard"), *dictionary(spark, folder), list(ids))


def op13_token_files(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    prepare(spark)
    folder = f"{checkpoint_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), folder, path or default_vocabulary())
    return read(spark, folder, with_ids=False)
