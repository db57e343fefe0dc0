"""Benchmark decontamination: BM25 with block-max WAND over the test items.

Test items are cut into segments of up to 48 words and indexed: BM25 weights,
each divided by the score the segment has against itself, in posting lists with
a maximum per block.  Every training text is cut into passages of 64 words, one
each 32; every passage queries the index and retrieves all segments whose share
of their own score reaches ``threshold``.  A batch first bounds all its passages
at once with the block maxima of the rarer terms; passages that no block can
satisfy are done, the others run block-max WAND.  Retrieved items are verified
against the text: five-word shingles of the item, and the words of its answer.

Statistics are over all distinct item texts: a text is indexed once, under its
SHA-256, and the ids that have it are joined to what is found.  The index is
dealt into shards of bounded text; each shard is broadcast and the texts pass it
in turn, so the texts are not shuffled and no shard grows with the number of items.

Items of fewer than ``MIN_WORDS`` words have no shingle to verify; they are found
where a text's words are the item's and no others.

Nulls and oddities: null and empty texts retrieve nothing, null and wordless
items are not found.  Equal items are reported each under its id, repeated item rows once,
and an id with several texts once for each text found; repeated texts to search
are judged one by one; a null id of theirs is carried along.  Without items
nothing is found.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import prepare, table

TOKEN = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x5e\x60\x7b-\x7f]+")  # a word as tokens() has it
BLANK = bytes(c if c >= 128 or chr(c).isalnum() or c == 95 else 32 for c in range(256))
ANSWER = re.compile(r"\b(?:answer|solution|antwort|respuesta|réponse)\s*:", re.I)
MIN_WORDS = 5  # a shingle
SEGMENT = 48
CELL = 32  # a passage is two cells
K1, B = 1.2, 0.75
THRESHOLD = 0.5
SHINGLE, SIMILAR = 5, 0.8
POSTINGS_BLOCK = 16
ITEMS_BLOCK = 2  # segments that share a bound in the batch step
SLACK = 0.2
SHARD_CHARS = 4 << 20
BATCH_WORDS = 1 << 19


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words in UTF-8: runs of letters, digits, underscores and characters beyond ASCII."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(BLANK).split()


def answer_start(text: str) -> int:
    """Where the answer begins: after an answer mark, else after the last question
    mark, else at the last quarter of the words."""
    if m := ANSWER.search(text):
        return m.end()
    at = text.rfind("?") + 1
    if at and TOKEN.search(text, at):
        return at
    found = list(TOKEN.finditer(text))
    return found[len(found) * 3 // 4].start() if found else 0


def segments(words: list) -> list[list]:
    n = max(1, math.ceil(len(words) / SEGMENT))
    return [words[len(words) * i // n:len(words) * (i + 1) // n] for i in range(n)]


class Index:
    """One shard: posting lists over segments with block maxima.

    rows: (item, segment, term, weight), weight being the term's share of the
    segment's own score; texts: {item: text}."""

    def __init__(self, rows: pd.DataFrame, texts: dict, threshold: float = THRESHOLD):
        self.threshold, self.texts, self.parsed = threshold, texts, {}
        self.whole = {tuple(w): i for i, t in texts.items() if 0 < len(w := tokens(t)) < MIN_WORDS}
        self.vocab, self.lists = {}, []
        if not len(rows):
            return
        rows = rows.sort_values(["item", "segment", "term"], ignore_index=True)
        ids = rows[["item", "segment"]].drop_duplicates(ignore_index=True)
        self.item_of = ids["item"].tolist()
        seg = rows.groupby(["item", "segment"], sort=False).ngroup().to_numpy()
        terms = sorted(set(rows["term"]))
        number = {t: i for i, t in enumerate(terms)}
        self.vocab = {t.encode(): i for t, i in number.items()}
        term, weight = rows["term"].map(number).to_numpy(np.int64), rows["weight"].to_numpy(float)
        order = np.lexsort((seg, term))
        starts = np.searchsorted(term[order], np.arange(len(terms) + 1))
        for i in range(len(terms)):
            part = order[starts[i]:starts[i + 1]]
            s, w = seg[part].tolist(), weight[part].tolist()
            last = [s[min(j + POSTINGS_BLOCK, len(s)) - 1] for j in range(0, len(s), POSTINGS_BLOCK)]
            most = [max(w[j:j + POSTINGS_BLOCK]) for j in range(0, len(s), POSTINGS_BLOCK)]
            self.lists.append((s, w, last, most, max(w)))
        # A segment's lightest terms, up to the share SLACK of its score, stay out of
        # the batch bound, which allows for that share instead.
        order = np.lexsort((weight, seg))
        run = np.cumsum(weight[order])
        begin = np.searchsorted(seg[order], seg[order])
        before = run - np.where(begin > 0, run[begin - 1], 0.0)
        needed = np.zeros(len(rows), dtype=bool)
        needed[order] = before > SLACK
        self.n_blocks = len(ids) // ITEMS_BLOCK + 1
        slack = np.zeros(len(ids))
        np.add.at(slack, seg[~needed], weight[~needed])
        self.slack = np.zeros(self.n_blocks)
        np.maximum.at(self.slack, np.arange(len(ids)) // ITEMS_BLOCK, slack)
        key = term[needed] * self.n_blocks + seg[needed] // ITEMS_BLOCK
        pairs, where = np.unique(key, return_inverse=True)
        bound = np.zeros(len(pairs))
        np.maximum.at(bound, where, weight[needed])
        self.block, self.bound = pairs % self.n_blocks, bound
        self.first = np.searchsorted(pairs // self.n_blocks, np.arange(len(terms) + 1))

    def query(self, found) -> list[tuple[int, float]]:
        """Block-max WAND: (segment, score) of all segments at or above the threshold."""
        least = self.threshold - 1e-9
        cursors = [[self.lists[t][0][0], 0, self.lists[t]] for t in found]  # segment, position, list
        out = []

        def move(c, to):
            c[1] = bisect_left(c[2][0], to, c[1])
            c[0] = c[2][0][c[1]] if c[1] < len(c[2][0]) else None

        while cursors:
            cursors.sort(key=lambda c: c[0])
            total, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                total += c[2][4]
                if total >= least:
                    pivot = i
                    break
            if pivot < 0:
                break
            at = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == at:
                pivot += 1
            total, until = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else math.inf
            for c in cursors[:pivot + 1]:
                b = bisect_left(c[2][2], at)
                if b < len(c[2][2]):
                    total += c[2][3][b]
                    until = min(until, c[2][2][b] + 1)
            if total < least:  # no segment up to the nearest block end can reach it
                for c in cursors[:pivot + 1]:
                    move(c, max(until, at + 1) if until < math.inf else len(self.item_of))
            elif cursors[0][0] == at:
                value = sum(c[2][1][c[1]] for c in cursors[:pivot + 1])
                if value >= least:
                    out.append((at, value))
                for c in cursors[:pivot + 1]:
                    move(c, at + 1)
            else:
                for c in cursors[:pivot + 1]:
                    if c[0] < at:
                        move(c, at)
            cursors = [c for c in cursors if c[0] is not None]
        return out

    def passages(self, ids: list[np.ndarray]) -> list[tuple[int, int]]:
        """(text, cell) of the passages that some block of items may satisfy."""
        lengths = np.array([len(x) for x in ids])
        cells = -(-lengths // CELL)
        base = np.concatenate(([0], np.cumsum(cells)))
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        text = np.repeat(np.arange(len(ids)), lengths)
        inside = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        cell = base[text] + inside // CELL
        known = flat >= 0
        pair = np.unique(cell[known] * len(self.lists) + flat[known])
        cell, term = pair // len(self.lists), pair % len(self.lists)
        n = self.first[term + 1] - self.first[term]
        at = np.repeat(self.first[term], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        keys, where = np.unique(np.repeat(cell, n) * self.n_blocks + self.block[at], return_inverse=True)
        own = np.bincount(where, weights=self.bound[at], minlength=len(keys))

        def beside(step):
            to = np.searchsorted(keys, keys + step)
            hit = (to < len(keys)) & (keys[np.minimum(to, len(keys) - 1)] == keys + step)
            return np.where(hit, own[np.minimum(to, len(keys) - 1)], 0.0)

        if not len(keys):
            return []
        most = own + np.maximum(beside(self.n_blocks), beside(-self.n_blocks)) + self.slack[keys % self.n_blocks]
        hot = np.unique(keys[most >= self.threshold - 1e-6] // self.n_blocks)
        owner = np.searchsorted(base, hot, "right") - 1
        out = {(int(t), int(c - base[t]) - d) for t, c in zip(owner, hot) for d in (0, 1)}
        return sorted(x for x in out if x[1] >= 0)

    def verified(self, item, words: list[bytes], have: list) -> tuple[float, float]:
        """Shares of the item's shingles and of its answer's words that the text has."""
        if item not in self.parsed:
            text = self.texts[item]
            all_words = tokens(text)
            self.parsed[item] = set(zip(*(all_words[i:] for i in range(SHINGLE)))), set(tokens(text[answer_start(text):]))
        shingles, answer = self.parsed[item]
        if not have:
            have += [set(zip(*(words[i:] for i in range(SHINGLE)))), set(words)]
        return len(shingles & have[0]) / len(shingles), len(answer & have[1]) / max(1, len(answer))

    def find(self, texts: list) -> list[list[tuple]]:
        """For each text its verified items: (item, score, shingle overlap, answer overlap)."""
        out: list[list[tuple]] = [[] for _ in texts]
        get = self.vocab.get
        held, size = [], 0
        for i, text in enumerate(texts):
            words = tokens(text)
            if 0 < len(words) < MIN_WORDS:
                item = self.whole.get(tuple(words))
                if item is not None:
                    out[i].append((item, 1.0, 1.0, 1.0))
            elif words and self.lists:
                held.append((i, words, np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))))
                size += len(words)
            if held and (size >= BATCH_WORDS or i + 1 == len(texts)):
                best: dict = {}
                for j, c in self.passages([x[2] for x in held]):
                    part = held[j][2][c * CELL:(c + 2) * CELL]
                    for seg, value in self.query(sorted(set(part[part >= 0].tolist()))):
                        k = j, self.item_of[seg]
                        best[k] = max(best.get(k, 0.0), value)
                have: dict = {}
                for (j, item), value in sorted(best.items()):
                    overlap, answer = self.verified(item, held[j][1], have.setdefault(j, []))
                    if overlap >= SIMILAR and answer >= SIMILAR:
                        out[held[j][0]].append((item, value, overlap, answer))
                held, size = [], 0
        return out


def named(items: DataFrame, ident: str = "item_id", text: str = "text") -> DataFrame:
    """(item, id, text) of the usable item rows, ``item`` being the key of the text."""
    kept = items.where(F.col(ident).isNotNull() & F.col(text).isNotNull())
    return kept.select(F.sha2(F.col(text).cast("binary"), 256).alias("item"), F.col(ident).alias("id"), F.col(text).alias("text"))


def indexes(items: DataFrame, ident: str = "item_id", text: str = "text", threshold: float = THRESHOLD, shard_chars: int = SHARD_CHARS):
    """The index in shards of about ``shard_chars`` characters, one at a time."""
    def cut(frames):
        for f in frames:
            rows = []
            for i, t in zip(f["item"], f["text"]):
                words = tokens(t)
                if len(words) >= MIN_WORDS:
                    for k, seg in enumerate(segments(words)):
                        rows += [(i, k, w.decode("utf-8", "replace"), n, len(seg)) for w, n in Counter(seg).items()]
            yield pd.DataFrame(rows, columns=["item", "segment", "term", "tf", "size"])

    kept = named(items, ident, text).select("item", "text").distinct().checkpoint()
    shards = max(1, math.ceil((kept.agg(F.sum(F.length("text"))).first()[0] or 0) / shard_chars))
    kept = kept.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)))
    terms = kept.select("item", "text").mapInPandas(cut, "item string, segment int, term string, tf int, size int").checkpoint()
    n, words = terms.select("item", "segment", "size").distinct().agg(F.count("*"), F.sum("size")).first()
    idf = terms.groupBy("term").agg(F.count("*").alias("df")).select("term", F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    tf = F.col("tf")
    value = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("size") / ((words or 1) / max(n, 1))))
    weighed = terms.join(idf, "term").withColumn("value", value)
    own = weighed.groupBy("item", "segment").agg(F.sum("value").alias("own"))
    rows = weighed.join(own, ["item", "segment"]).select(
        "item", "segment", "term", (F.col("value") / F.col("own")).alias("weight"), F.pmod(F.xxhash64("item"), F.lit(shards)).alias("shard")).checkpoint()
    for s in range(shards):
        part = rows.where(F.col("shard") == s).drop("shard").toPandas()
        texts = {r["item"]: r["text"] for r in kept.where(F.col("shard") == s).select("item", "text").collect()}
        if texts:
            yield Index(part, texts, threshold)


def find(docs: DataFrame, items: DataFrame, ident: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Verified pairs (id, item_id, score, overlap, answer_overlap)."""
    kind, item_kind = docs.schema[ident].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    out = None
    for index in indexes(items, **options):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(frames, shared=shared):
            for f in frames:
                rows = [(i, *x) for i, found in zip(f["id"], shared.value.find(list(f["text"]))) for x in found]
                yield pd.DataFrame(rows, columns=["id", "item", "score", "overlap", "answer_overlap"])

        part = docs.select(F.col(ident).cast("string").alias("id"), F.col(text).alias("text")).mapInPandas(
            run, "id string, item string, score double, overlap double, answer_overlap double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"id {kind}, item_id {item_kind}, score double, overlap double, answer_overlap double")
    ids = named(items).select("item", F.col("id").alias("item_id")).distinct()
    return out.join(ids, "item").select(F.col("id").cast(kind).alias("id"), "item_id", "score", "overlap", "answer_overlap")


def clean(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without a verified item, all columns as they are."""
    at = docs.columns.index(text)
    for index in indexes(items, **options):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for b in batches:
                found = shared.value.find(b.column(at).to_pylist())
                yield b.filter(pa.array([not x for x in found], type=pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")
