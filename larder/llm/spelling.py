"""Spelling variants: words one edit apart, grouped under their common form.

Words are counted over all texts first.  The word list is then sorted by length
and letter statistics and cut into blocks of at most ``BLOCK_WORDS`` words of
one length, each block one row with its words packed.  Pairs of blocks of equal
or adjacent length meet; a task multiplies the letter-count matrices of two
blocks (a Gram matrix), which gives the squared distance of every two count
vectors.  One inserted or deleted letter changes it by 1, one replaced letter by
2, so only pairs at 1 or 2 can be near; those are compared letter by letter.

Every statistic kept with a block is a number of letters out of a fixed set.
One edit changes it by at most one, so two blocks whose ranges of a statistic
lie further apart than one hold no near pair and never meet: an exact cut.

Nulls and oddities: a null text has no words; a null id counts as the empty
text in the hash.  Repeated rows count each time.  An empty table, or one
without a frequent word, gives an empty result.  Columns of other names are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import prepare, table

MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
MISSPELL = 199  # a run whose hash this divides loses one letter
BLOCK_WORDS = 2048
BLOCK_LETTERS = 1 << 18  # at most in a block, so that outsize words come in smaller blocks
PAIRS_PER_TASK, MAX_TASKS = 16, 1 << 14
HELD = 400_000  # distinct words a task holds before it passes their counts on
FIRST, LAST = 0xC0, 0xFF  # letters beyond a-z
LETTERS = 26 + LAST - FIRST + 1
# Letter sets of the statistics: about half of all letters each, cut three ways.
SETS = ("abcdefghijklm", "aeioubcdfgh", "aeklmnstvwz")
LOWERING = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def run_pattern(length: int) -> re.Pattern:
    """Runs of at least ``length`` letters in folded UTF-8; U+00C0 to U+00FF are C3 80 to C3 BF."""
    return re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % length)


def count_words(docs: DataFrame, ident: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of at least ``min_length`` letters and ``min_count`` occurrences."""
    runs = run_pattern(min_length)  # a lost letter makes a run shorter, so shorter runs give no word

    def run(batches):
        held: Counter = Counter()

        def out():
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for b in batches:
            for ident_, text_ in zip(b.column(0), b.column(1)):
                if not text_.is_valid:
                    continue
                found = runs.findall(text_.as_buffer().to_pybytes().translate(LOWERING))
                if not found:
                    continue
                start = zlib.crc32(((ident_.as_py() or "") + ":").encode())
                hit = np.array([zlib.crc32(w, start) for w in found], dtype=np.int64)
                for i in np.flatnonzero(hit % MISSPELL == 0):
                    word = found[i].decode()
                    at = int(hit[i]) % len(word)
                    found[i] = (word[:at] + word[at + 1:]).encode() if len(word) > min_length else b""
                held.update(found)
                if len(held) > HELD:
                    held.pop(b"", None)
                    yield from out()
                    held = Counter()
        held.pop(b"", None)
        if held:
            yield from out()

    return (
        docs.select(F.col(ident).cast("string"), F.col(text)).mapInArrow(run, "word string, n bigint")
        .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    )


def matrix(words: list[str]) -> np.ndarray:
    """Code points, one row per word; all words have one length."""
    return np.array(words).view(np.uint32).reshape(len(words), -1)


def letter_counts(points: np.ndarray) -> np.ndarray:
    at = np.where(points >= FIRST, points - FIRST + 26, points - ord("a")).astype(np.int64)
    out = np.zeros((len(points), LETTERS), dtype=np.float32)
    np.add.at(out, (np.arange(len(points))[:, None], at), 1)
    return out


def replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of equal length differ in exactly one place."""
    return (a != b).sum(axis=1) == 1


def inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether a row of ``long`` is that of ``short`` with one more letter."""
    head = np.cumprod(short == long[:, :-1], axis=1).sum(axis=1)
    tail = np.cumprod((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= short.shape[1]


def near_rows(a: list[str], b: list[str], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the near pairs of two blocks; ``same``: one block with itself."""
    x, y = matrix(a), matrix(b)
    left, right = letter_counts(x), letter_counts(y)
    distance = (left * left).sum(1)[:, None] + (right * right).sum(1)[None, :] - 2 * (left @ right.T)
    gap = y.shape[1] - x.shape[1]
    i, j = np.nonzero(distance == (1 if gap else 2))
    if same:
        i, j = i[i < j], j[i < j]
    keep = np.zeros(len(i), dtype=bool)
    step = max(1, (1 << 22) // y.shape[1])
    for at in range(0, len(i), step):
        part = slice(at, at + step)
        keep[part] = inserted(x[i[part]], y[j[part]]) if gap else replaced(x[i[part]], y[j[part]])
    return i[keep], j[keep]


def blocks(words: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(block, length, low, high, words, counts): the word list in blocks of one length."""
    stats = [F.length("word") - F.length(F.translate("word", s, "")) for s in SETS]
    columns = [F.col(f"s{k}") for k in range(len(SETS))]
    dealt = (
        words.select("word", "n", F.length("word").alias("length"), *[s.alias(f"s{k}") for k, s in enumerate(stats)])
        .repartitionByRange("length", *columns, "word").sortWithinPartitions("length", *columns, "word")
        .select(F.spark_partition_id().alias("part"), "word", "n", "length", F.array(*columns).alias("stats"))
    )

    def run(batches):
        held, part, number = [], None, 0

        def out():
            size = pa.array([len(held[0][0])], pa.int32())
            low, high = ([f(x) for x in zip(*(h[2] for h in held))] for f in (min, max))
            packed = "".join(h[0] for h in held).encode()
            return pa.RecordBatch.from_arrays([
                pa.array([(part << 32) + number], pa.int64()), size, pa.array([low], pa.list_(pa.int32())), pa.array([high], pa.list_(pa.int32())),
                pa.array([packed], pa.binary()), pa.array([np.array([h[1] for h in held], "<i8").tobytes()], pa.binary())],
                names=["block", "length", "low", "high", "words", "counts"])

        for b in batches:
            part = b.column(0)[0].as_py() if b.num_rows else part
            for word, n, stat in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(4).to_pylist()):
                if held and (len(held) >= min(block_words, max(1, BLOCK_LETTERS // len(word))) or len(held[0][0]) != len(word)):
                    yield out()
                    held, number = [], number + 1
                held.append((word, n, stat))
        if held:
            yield out()

    return dealt.mapInArrow(run, "block bigint, length int, low array<int>, high array<int>, words binary, counts binary")


def near_pairs(words: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, near, near_n): both directions of every two words one edit apart."""
    # Written once: block numbers come from the partitioning, which a second run need not repeat.
    table_ = blocks(words, block_words).checkpoint()
    head = table_.select("block", "length", "low", "high")
    first = head.select(F.col("block").alias("a"), F.col("length").alias("length_a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"),
                        F.explode(F.array("length", F.col("length") + 1)).alias("length"))
    second = head.select(F.col("block").alias("b"), "length", "low", "high")
    close = [(F.col("low")[k] <= F.col("high_a")[k] + 1) & (F.col("low_a")[k] <= F.col("high")[k] + 1) for k in range(len(SETS))]
    meet = first.join(second, "length").where((F.col("length") > F.col("length_a")) | (F.col("a") <= F.col("b")))
    for c in close:
        meet = meet.where(c)
    meet = meet.select("a", "b").checkpoint()
    tasks = max(1, min(MAX_TASKS, meet.count() // PAIRS_PER_TASK))
    packed = table_.select("block", F.struct("length", "words", "counts").alias("x"))
    pairs = (
        meet.join(packed.select(F.col("block").alias("a"), F.col("x").alias("left")), "a")
        .join(packed.select(F.col("block").alias("b"), F.col("x").alias("right")), "b")
        .select((F.col("a") == F.col("b")).alias("same"), "left", "right")
    )

    def unpack(side) -> tuple[list[str], np.ndarray]:
        size, text = side["length"], side["words"].decode()
        return [text[k:k + size] for k in range(0, len(text), size)], np.frombuffer(side["counts"], "<i8")

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                (a, n), (c, m) = unpack(b.column(1)[r].as_py()), unpack(b.column(2)[r].as_py())
                i, j = near_rows(a, c, b.column(0)[r].as_py())
                if len(i):
                    left, right = pa.array(a, pa.string()).take(pa.array(i)), pa.array(c, pa.string()).take(pa.array(j))
                    yield pa.RecordBatch.from_arrays([
                        pa.concat_arrays([left, right]), pa.concat_arrays([right, left]), pa.array(np.concatenate((m[j], n[i])))], names=["word", "near", "near_n"])

    # A pair of blocks is few bytes and much work, so the number of tasks is set by the pairs.
    return pairs.repartition(tasks, "left.words", "right.words").mapInArrow(run, "word string, near string, near_n bigint")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms followed to the last.  A form is at least
    ``RATIO`` times as frequent, so chains are short; each round doubles the step."""
    step = forms.select("word", F.col("form").alias("root")).checkpoint()
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = step.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")).checkpoint()
        step = after.select("word", "root")
        if after.where("moved").isEmpty():
            return step


def variants(docs: DataFrame, ident: str = "doc_id", text: str = "text", ratio: int = RATIO, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n): one row per frequent word."""
    words = count_words(docs, ident, text).checkpoint()
    best = (
        near_pairs(words, block_words).groupBy("word")
        .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near"))).alias("x"))
    )
    judged = (
        words.join(best, "word", "left")
        .withColumn("known", F.coalesce(-F.col("x.m") >= ratio * F.col("n"), F.lit(False)))
        .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("known"), F.col("x.near")).alias("form"),
                F.when(F.col("known"), -F.col("x.m")).alias("form_n"))
        .checkpoint()
    )
    ends = roots(judged.where("form IS NOT NULL"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return variants(table(spark, sf_dir, "documents"))
