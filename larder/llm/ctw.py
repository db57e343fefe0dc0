"""Language-model scores by context-tree weighting (CTW) over bytes.

A byte is eight binary decisions; each decision has its own tree of contexts,
the previous 0 to ``depth`` bytes.  Every node estimates its bit by
Krichevsky-Trofimov (KT); a node's weighted probability is the mean of its own
block probability and the product of its children's, and the prediction for a
bit mixes the KT estimates of all depths with the weights this gives.  The
block probabilities depend on counts alone, so the tree is built by
aggregation from the leaves to the root and read on the way back.

Texts are dealt into blocks, n-grams into shards by the last ``CUT`` bytes of
their context, so that all of the tree below a context of ``CUT`` bytes is in
one shard.  A block asks for the code length of each of its distinct byte
n-grams (and the count of each of its distinct words) in one row per shard,
sorted keys and counts as compressed arrays.  A shard builds its part of the
tree; the few levels above ``CUT`` are one ``groupBy`` and one join each; the
shard then answers each block in kind.  The tables grow with the corpus,
nothing is broadcast, and a frequent n-gram is asked for once per block.
N-grams seen only in held-out texts go through the same tree with count zero.

A text is its UTF-8 bytes with A-Z folded, after ``depth`` bytes 0xFE and
before one byte 0xFF; neither occurs in UTF-8, so the model is a proper
distribution over texts.  Words are told apart by 64-bit hashes.

Nulls and oddities: null is the empty text, which has the end alone.  Repeated
rows count each time in training and get one score each; a null id counts as
the empty text in the hold-out rule.  Without training texts every bit has
probability one half.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import Lookup, block_of, mix, n_blocks, prepare, remainder, sums, table, word_hashes

DEPTH = 5
CUT = 2
BLOCK_BYTES = 32 << 20
SHARDS = 64  # at least; two per block where that is more
CHUNK = 2 << 20
FOLD_BYTES = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
GRAM, WORD = 0, 1


def folded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD_BYTES)


def grams(texts: list[bytes], depth: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, keys, offsets): one key per predicted byte of texts[first:last].

    A key holds the byte in its low 8 bits and the context above, latest byte
    lowest.  A text over CHUNK bytes comes in several parts."""
    def keys_of(buf: np.ndarray) -> np.ndarray:
        wide = buf.astype(np.uint64)
        n = len(wide) - depth
        out = wide[depth:].copy()
        for k in range(1, depth + 1):
            out |= wide[depth - k:depth - k + n] << np.uint64(8 * k)
        return out

    start, end = b"\xfe" * depth, b"\xff"
    first, size, held = 0, 0, []

    def done():
        keys = keys_of(np.frombuffer(b"".join(held), np.uint8))
        # the starts of all texts but the first are predicted by no one
        lengths = np.array([len(x) - depth for x in held])
        begins = np.concatenate(([0], np.cumsum(lengths + depth)[:-1]))
        keep = np.ones(len(keys), dtype=bool)
        for k in range(depth):
            keep[begins[1:] - depth + k] = False
        return first, first + len(held), keys[keep], np.concatenate(([0], np.cumsum(lengths)))

    for i, text in enumerate(texts):
        data = start + text + end
        if len(data) > CHUNK:
            if held:
                yield done()
            for at in range(0, len(data) - depth, CHUNK):
                part = keys_of(np.frombuffer(data[at:at + CHUNK + depth], np.uint8))
                yield i, i + 1, part, np.array([0, len(part)])
            first, size, held = i + 1, 0, []
            continue
        held.append(data)
        size += len(data)
        if size > CHUNK:
            yield done()
            first, size, held = i + 1, 0, []
    if held:
        yield done()


def merge_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.add.reduceat(counts, at)


def distinct_counts(keys: Iterator[tuple[np.ndarray, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with their number in training texts (0: held out only)."""
    parts: list = []
    for values, counted in keys:
        if len(values):
            found, n = np.unique(values, return_counts=True)
            parts.append((found, n if counted else np.zeros_like(n)))
            if len(parts) >= 16:
                parts = [merge_counts(parts)]
    return merge_counts(parts) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def packed(values: np.ndarray) -> bytes:
    """An array of 64-bit numbers, equal bytes of all side by side, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


ASKED = "block int, shard int, kind tinyint, keys binary, counts binary"


def questions(block: int, kind: int, keys: np.ndarray, counts: np.ndarray, depth: int, shards: int) -> pa.Table:
    """One row per shard from sorted distinct keys and their counts."""
    of = mix((keys >> np.uint64(8)) & np.uint64((1 << 8 * min(CUT, depth)) - 1) if kind == GRAM else keys) % np.uint64(shards)
    order = np.argsort(of, kind="stable")
    keys, counts, of = keys[order], counts[order].astype(np.int64), of[order]
    at = np.flatnonzero(np.diff(of, prepend=np.uint64(shards)))
    ends = [*at[1:], len(of)]
    return pa.table({
        "block": np.full(len(at), block, np.int32), "shard": of[at].astype(np.int32), "kind": np.full(len(at), kind, np.int8),
        "keys": pa.array([packed_keys(keys[i:j]) for i, j in zip(at, ends)], pa.binary()),
        "counts": pa.array([packed(counts[i:j]) for i, j in zip(at, ends)], pa.binary())})


def log_gamma(x, log=np.log):
    """ln Gamma(x) for x >= 0.5, an array or a column: Stirling's series at x + 6, and the recurrence back."""
    y = x + 6.0
    series = (y - 0.5) * log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y)
    return series - log(x) - log(x + 1) - log(x + 2) - log(x + 3) - log(x + 4) - log(x + 5)


def kt_block(n0, n1, log=np.log):
    return log_gamma(n0 + 0.5, log) + log_gamma(n1 + 0.5, log) - log_gamma(n0 + n1 + 1.0, log) - math.log(math.pi)


class Level:
    """Nodes of one depth: ids (context above, node in the low 8 bits), counts, the
    weighted block probability, and the place of each node in the level above."""

    def __init__(self, ids: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None = None):
        self.ids, self.n0, self.n1, self.up = ids, n0, n1, None
        block = kt_block(n0, n1)
        if below is None:
            self.lw, self.stay, self.go = block, 1.0, 0.0
        else:
            own, below = math.log(0.5) + block, math.log(0.5) + below
            self.lw = np.logaddexp(own, below)
            # stay: the weight of this node's own estimate; go, the rest, is left to the deeper ones
            self.stay, self.go = np.exp(own - self.lw), np.exp(below - self.lw)

    def above(self, d: int) -> Level:
        """The level of contexts of ``d`` bytes."""
        ids, self.up = np.unique(self.ids & np.uint64(((1 << 8 * d) - 1) << 8 | 255), return_inverse=True)
        return Level(ids, *(np.bincount(self.up, x, len(ids)) for x in (self.n0, self.n1, self.lw)))

    def passed(self, got0, got1, share):
        """What the estimates down to this level give a 0 and a 1, and the weight left."""
        total = self.n0 + self.n1 + 1.0
        mine = share * self.stay
        return got0 + mine * (self.n0 + 0.5) / total, got1 + mine * (self.n1 + 0.5) / total, share * self.go


class Tree:
    """The part of the tree under the contexts of ``cut`` bytes, from sorted n-grams and counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, cut: int):
        self.keys, self.runs = keys, []
        counts = counts.astype(float)
        ids, zeros, ones, size = [], [], [], 0
        for j in range(8):
            prefix = keys >> np.uint64(8 - j)
            first = np.concatenate(([True], prefix[1:] != prefix[:-1]))
            at = np.flatnonzero(first)
            bit = (keys >> np.uint64(7 - j) & np.uint64(1)).astype(bool)
            zeros.append(np.add.reduceat(np.where(bit, 0.0, counts), at))
            ones.append(np.add.reduceat(np.where(bit, counts, 0.0), at))
            ids.append(keys[at] & ~np.uint64(255) | np.uint64(1 << j) | (keys[at] & np.uint64(255)) >> np.uint64(8 - j))
            self.runs.append((first, bit, size))
            size += len(at)
        self.levels = [Level(np.concatenate(ids), np.concatenate(zeros), np.concatenate(ones))]
        for d in range(depth - 1, cut - 1, -1):
            self.levels.append(self.levels[-1].above(d))

    def lengths(self, ids: np.ndarray, *state: np.ndarray) -> np.ndarray:
        """ln probability of each n-gram's byte, from (got0, got1, share) for the ids of the top level."""
        order = np.argsort(ids)
        state = [x[order][np.searchsorted(ids[order], self.levels[-1].ids)] for x in state]
        for level, deeper in zip(self.levels[:0:-1], self.levels[-2::-1]):
            state = [x[deeper.up] for x in level.passed(*state)]
        l0, l1, _ = self.levels[0].passed(*state)
        l0, l1 = np.log(l0), np.log(l1)
        out = np.zeros(len(self.keys))
        for first, bit, start in self.runs:
            at = start - 1 + np.cumsum(first)
            out += np.where(bit, l1[at], l0[at])
        return out


def merged(asked: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a kind and their counts over all blocks."""
    parts: list = []
    for row in asked.select(["kind", "keys", "counts"]).to_batches():
        for k, keys, counts in zip(*(row.column(i) for i in range(3))):
            if k.as_py() == kind:
                parts.append((unpacked_keys(keys.as_py()), unpacked(counts.as_py(), np.int64)))
                if len(parts) >= 16:
                    parts = [merge_counts(parts)]
    return merge_counts(parts) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def from_above(top: DataFrame, cut: int) -> DataFrame:
    """(ctx, node, got0, got1, share): what the contexts under ``cut`` bytes leave to
    each node of the contexts of ``cut`` bytes, from its (ctx, node, n0, n1, lw)."""
    half = math.log(0.5)
    n0, n1 = F.col("n0"), F.col("n1")
    levels = [top]
    for d in range(cut - 1, -1, -1):
        up = levels[-1].groupBy(F.col("ctx").bitwiseAND(F.lit((1 << 8 * d) - 1)).alias("ctx"), "node").agg(
            F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("lw").alias("below"))
        own, below = half + kt_block(n0, n1, F.log), half + F.col("below")
        most = F.greatest(own, below)
        up = up.withColumn("lw", most + F.log(F.exp(own - most) + F.exp(below - most)))
        levels.append(up.withColumns({"stay": F.exp(own - F.col("lw")), "go": F.exp(below - F.col("lw"))}).drop("below").checkpoint())
    above = None
    for d, level in enumerate(reversed(levels)):
        if above is None:
            level = level.withColumns({"got0": F.lit(0.0), "got1": F.lit(0.0), "share": F.lit(1.0)})
        else:
            level = level.withColumn("up", F.col("ctx").bitwiseAND(F.lit((1 << 8 * (d - 1)) - 1))).join(above, ["up", "node"])
        if d == cut:
            return level.select("ctx", "node", "got0", "got1", "share")
        mine = F.col("share") * F.col("stay")
        above = level.select(
            F.col("ctx").alias("up"), "node", (F.col("got0") + mine * (n0 + 0.5) / (n0 + n1 + 1.0)).alias("got0"),
            (F.col("got1") + mine * (n1 + 0.5) / (n0 + n1 + 1.0)).alias("got1"), (F.col("share") * F.col("go")).alias("share"))


def answered(asked: DataFrame, depth: int) -> tuple[DataFrame, int, int]:
    """(block, kind, keys, values) for the questions: natural logs of the CTW
    probability of n-grams, counts of words; the words in training, and how many differ."""
    cut = min(CUT, depth)
    schema = "shard int, kind tinyint, ctx bigint, node int, n0 double, n1 double, lw double"

    def tops(part: pa.Table) -> pa.Table:
        _, words = merged(part, WORD)
        keys, counts = merged(part, GRAM)
        top = Tree(keys, counts, depth, cut).levels[-1] if len(keys) else Level(keys, np.zeros(0), np.zeros(0))
        n = len(top.ids)
        return pa.table({
            "shard": np.full(n + 1, part.column("shard")[0].as_py(), np.int32), "kind": np.append(np.full(n, GRAM, np.int8), np.int8(WORD)),
            "ctx": np.append((top.ids >> np.uint64(8)).astype(np.int64), 0), "node": np.append((top.ids & np.uint64(255)).astype(np.int32), np.int32(0)),
            "n0": np.append(top.n0, float(words.sum())), "n1": np.append(top.n1, float((words > 0).sum())), "lw": np.append(top.lw, 0.0)})

    top = asked.groupBy("shard").applyInArrow(tops, schema).checkpoint()
    tokens, kinds = top.where(F.col("kind") == WORD).agg(F.coalesce(F.sum("n0"), F.lit(0.0)), F.coalesce(F.sum("n1"), F.lit(0.0))).first()
    top = top.where(F.col("kind") == GRAM)
    states = top.select("shard", "ctx", "node").join(from_above(top.drop("shard", "kind"), cut), ["ctx", "node"])

    def answers(part: pa.Table, state: pa.Table) -> pa.Table:
        found = {}
        keys, counts = merged(part, GRAM)
        if len(keys):
            ctx, node, *reach = (state.column(c).to_numpy() for c in ("ctx", "node", "got0", "got1", "share"))
            found[GRAM] = keys, Tree(keys, counts, depth, cut).lengths(ctx.astype(np.uint64) << np.uint64(8) | node.astype(np.uint64), *reach)
        keys, counts = merged(part, WORD)
        found[WORD] = keys, counts.astype(float)
        values = []
        for kind, data in zip(part.column("kind").to_pylist(), part.column("keys")):
            keys, value = found[kind]
            values.append(packed(value[np.searchsorted(keys, unpacked_keys(data.as_py()))]))
        return part.select(["block", "kind", "keys"]).append_column("values", pa.array(values, pa.binary()))

    return (asked.groupBy("shard").cogroup(states.groupBy("shard")).applyInArrow(answers, "block int, kind tinyint, keys binary, values binary"),
            int(tokens), int(kinds))


def code_lengths(counts: DataFrame, depth: int, shards: int = SHARDS) -> DataFrame:
    """(gram, lp): natural log of the CTW probability of each n-gram's byte in its
    context, from (gram, n) with n the count in training."""
    def ask(part: pa.Table) -> pa.Table:
        keys, n = part.column("gram").to_numpy().view(np.uint64), part.column("n").to_numpy()
        order = np.argsort(keys)
        return questions(0, GRAM, keys[order], n[order], depth, shards)

    def tell(batches):
        for b in batches:
            for keys, values in zip(b.column(2), b.column(3)):
                yield pa.RecordBatch.from_arrays([pa.array(unpacked_keys(keys.as_py()).view(np.int64)), pa.array(unpacked(values.as_py(), float))],
                                                 names=["gram", "lp"])

    dealt = counts.select("gram", F.col("n").cast("long").alias("n"), F.pmod(F.xxhash64("gram"), F.lit(shards)).alias("part"))
    asked = dealt.groupBy("part").applyInArrow(ask, ASKED).checkpoint()
    return answered(asked, depth)[0].mapInArrow(tell, "gram bigint, lp double")


def score(docs: DataFrame, held: Column, ident: str = "doc_id", text: str = "text", depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``held`` marks the rows that are scored but not learned from."""
    if not 1 <= depth <= 6:
        raise ValueError("the depth is 1 to 6 bytes: a context and its byte share one long")
    blocks = n_blocks(docs, text, block_bytes)
    shards = max(SHARDS, 2 * blocks)
    kind = docs.schema[ident].dataType.simpleString()

    def pack(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            texts = pa.array([squeeze(folded(t.as_py())) for t in b.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), texts], names=["block", "id", "held", "packed"])

    def texts_of(block: pa.Table) -> Iterator[bytes]:
        unpack = zstandard.ZstdDecompressor().decompress
        return (unpack(t.as_py()) for t in block.column("packed"))

    # Texts travel compressed: they are the bulk of what this operator shuffles.
    dealt = docs.select(block_of(ident, text, blocks).alias("block"), F.col(ident).alias("id"),
                        held.alias("held"), F.col(text).alias("text")).mapInArrow(pack, f"block int, id {kind}, held boolean, packed binary")

    def distinct(block: pa.Table) -> pa.Table:
        lots: list = [(True, []), (False, [])]  # learned from, held out
        for t, h in zip(texts_of(block), block.column("held").to_pylist()):
            lots[bool(h)][1].append(t)
        number = block.column("block")[0].as_py()
        return pa.concat_tables([
            questions(number, tag, *distinct_counts((x[2], counted) for counted, texts in lots for x in of(texts)), depth, shards)
            for tag, of in ((GRAM, lambda ts: grams(ts, depth)), (WORD, word_hashes))])

    asked = dealt.groupBy("block").applyInArrow(distinct, ASKED).checkpoint()
    answers, tokens, kinds = answered(asked, depth)
    ends = docs.where(~held).count()
    total, vocabulary = tokens + ends, kinds + (ends > 0)

    def finish(block: pa.Table, got: pa.Table) -> pa.Table:
        find = {}
        kinds_of = got.column("kind").to_numpy()
        for tag in (GRAM, WORD):
            at = got.filter(pa.array(kinds_of == tag))
            keys = [unpacked_keys(x.as_py()) for x in at.column("keys")]
            values = [unpacked(x.as_py(), float) for x in at.column("values")]
            find[tag] = Lookup(np.concatenate([np.zeros(0, np.uint64), *keys])), np.concatenate([np.zeros(0), *values])

        def value_of(tag, keys):  # each key was asked for, so each is there
            where, values = find[tag]
            return values[where(keys)] if len(keys) else np.zeros(0)

        n = block.num_rows
        lp, base, n_words, known = np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        floor = total + 0.5 * (vocabulary + 1)
        texts = list(texts_of(block))
        for first, last, keys, offsets in grams(texts, depth):
            lp[first:last] += sums(value_of(GRAM, keys), offsets)
        for first, last, keys, offsets in word_hashes(texts):
            c = value_of(WORD, keys)
            base[first:last] += sums(np.log10((c + 0.5) / floor), offsets)
            n_words[first:last] += np.diff(offsets)
            known[first:last] += sums((c > 0).astype(float), offsets).astype(np.int64)
        return pa.table({
            "id": block.column("id"), "held_out": block.column("held"), "n_tokens": n_words + 1, "n_known": known + (ends > 0),
            "train_tokens": np.full(n, total, np.int64),
            "base_score": base + math.log10((ends + 0.5) / floor), "score": lp / math.log(10)})

    return (
        dealt.groupBy("block").cogroup(answers.groupBy("block"))
        .applyInArrow(finish, f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    )


def op6_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return score(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 5) == 1).withColumnRenamed("id", "doc_id")
