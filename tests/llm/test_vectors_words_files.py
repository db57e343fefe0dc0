"""Whitening, spelling variants and token files against plain versions, and their defined results on odd rows."""

from __future__ import annotations

import math
import random
import re
import uuid
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import spelling, token_files, whitening
from larder.llm.bpe import default_vocabulary
from larder.llm.common import prepare
from larder.session import checkpoint_dir

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, word string, id long, shard int, n long"


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    prepare(spark)


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "w", 1, 2, 3) for i, t in rows], DOCS)


# -- whitening -------------------------------------------------------------------

def plain_whitening(vectors: list[list[float]], k: int = 8):
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(0)
    deviation = [int(sum((n * a - b) ** 2 for a, b in zip(row, s))) for row in x]
    centre = np.array([[float(n * a - b) / n for a, b in zip(row, s)] for row in x])
    cov = centre.T @ centre / n
    values, turn = np.linalg.eigh(cov)
    by = np.argsort(-values)[:k]
    return n, deviation, centre @ turn[:, by] / np.sqrt(values[by]), values[by] / np.trace(cov)


def test_whitening_equals_the_eigenvectors_of_the_covariance(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    n, deviation, white, explained = plain_whitening([v for _, v in rows])
    got = sorted(whitening.op11_whitening(spark, SF).collect(), key=lambda r: (r["vec_id"], r["component"]))
    assert [r["vec_id"] for r in got] == [i for i, _ in sorted(rows) for _ in range(8)] and {r["n"] for r in got} == {n}
    place = {i: k for k, (i, _) in enumerate(rows)}
    assert all(r["deviation"] == deviation[place[r["vec_id"]]] for r in got)
    ours = np.array([r["whitened"] for r in got]).reshape(n, -1)
    theirs = white[[place[i] for i, _ in sorted(rows)]]
    signs = np.sign((ours * theirs).sum(0))
    assert np.abs(ours * signs - theirs).max() < 1e-8
    assert np.allclose([got[k]["explained"] for k in range(8)], explained, rtol=1e-9)
    assert len({r["identity_error"] for r in got}) == 1 and 0 <= got[0]["identity_error"] < 1e-9


def test_factorisation_of_low_rank_and_equal_eigenvalues():
    rnd = np.random.default_rng(3)
    basis, _ = np.linalg.qr(rnd.normal(size=(9, 9)))
    wanted = np.array([5.0, 5, 5, 2, 1e-3, 0, 0, 0, 0])
    cov = basis * wanted @ basis.T
    factor = whitening.pivoted_cholesky(cov)
    assert factor.shape == (9, 5) and np.abs(factor @ factor.T - cov).max() < 1e-12
    vectors, values = whitening.jacobi(factor)
    assert np.allclose(values, wanted[:5], rtol=1e-9)
    assert np.abs(vectors.T @ vectors - np.eye(5)).max() < 1e-12 and np.abs(vectors * values @ vectors.T - cov).max() < 1e-12


def test_whitening_of_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, id string, v int, i int"
    good = [[0.5, 0.25, 1.0], [0.1, 0.9, -1.0], [0.3, 0.2, 0.1], [0.3, 0.2, 0.1]]
    rows = [(k, v) for k, v in enumerate(good)] + [
        (10, None), (11, [0.1, None, 0.2]), (12, [0.1, float("nan"), 0.2]), (13, [0.1, float("-inf"), 0.2]), (14, []), (15, [1.0]), (None, [0.0, 0.0, 0.5]), (3, good[3])]
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], schema)
    got = whitening.whiten(df).collect()
    n, deviation, white, _ = plain_whitening([*good, [0.0, 0.0, 0.5], good[3]])
    assert {r["n"] for r in got} == {6} and Counter(r["id"] for r in got) == {0: 3, 1: 3, 2: 3, 3: 6, None: 3}
    assert {r["id"]: r["deviation"] for r in got} == {0: deviation[0], 1: deviation[1], 2: deviation[2], 3: deviation[3], None: deviation[4]}
    assert whitening.whiten(df.where("vec_id > 9 AND vec_id < 15")).count() == 0 and whitening.whiten(df.limit(0)).count() == 0
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(3)], "vec_id long, embedding array<double>")
    assert whitening.whiten(same).count() == 0  # no variance, no component
    line = spark.createDataFrame([(k, [float(k), 2.0 * k]) for k in range(4)], "vec_id long, embedding array<double>")
    assert {r["component"] for r in whitening.whiten(line).collect()} == {1}


def test_whitening_stays_exact_for_large_values(spark):
    rows = [[1e30, 0.0], [-1e30, 3.0], [5e8, 1.0]]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    held = [[max(-(2.0 ** 30), min(2.0 ** 30, c)) for c in v] for v in rows]
    _, deviation, _, explained = plain_whitening(held)
    got = {r["id"]: r for r in whitening.whiten(df).where("component = 1").collect()}
    assert [got[k]["deviation"] for k in range(3)] == [d if d < 1 << 63 else None for d in deviation]
    assert got[0]["explained"] == pytest.approx(explained[0])


def test_deviations_and_products_switch_to_wide_integers():
    x = whitening.grid(np.array([[0.5, -0.5], [3e5, 1.0], [7e5, -2.0]]))
    model = whitening.Fit(3, [int(v) for v in x.sum(0)], None, None, 1.0)
    want = [sum((3 * int(a) - int(s)) ** 2 for a, s in zip(row, x.sum(0))) for row in x]
    assert whitening.deviations(x, model) == want
    big = np.array([[1 << 39, 3], [5, 1 << 38]], dtype=np.int64)
    assert whitening.product(big).tolist() == (big.astype(object).T @ big.astype(object)).tolist()


# -- spelling variants -----------------------------------------------------------

def plain_near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_variants(rows):
    counts: Counter = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 199 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1:]
            counts[word] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    near = {w: [v for v in n if v != w and abs(len(v) - len(w)) <= 1 and plain_near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def got_variants(df):
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def test_spelling_equals_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = plain_variants(rows)
    assert any(v[0] for v in want.values()) and any(v[3] for v in want.values())
    assert got_variants(spelling.op12_spelling(spark, SF)) == want


@pytest.mark.parametrize("block_words", [1, 3, 2048])
def test_spelling_chains_ties_and_blocks(spark, block_words):
    rnd = random.Random(4)
    stems = ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(6, 9))) for _ in range(12)]
    words = [(s, 800) for s in stems[:6]]
    for s in stems[:6]:  # a chain: each form at least five times as frequent as the next
        near = s
        for n in (130, 25, 5):
            near = near[:2] + rnd.choice("xyzÿ") + near[3:] if rnd.random() < 0.5 else near + rnd.choice("xyzÿ")
            words.append((near, n))
    words += [("tiedword", 50), ("tiedwordb", 300), ("tiedworda", 300), ("xtiedword", 300), ("reversed", 9), ("deserver", 9)]
    tokens = [w for w, n in words for _ in range(n)]
    rnd.shuffle(tokens)
    rows = [(k, " ".join(tokens[k::97])) for k in range(97)]
    want = plain_variants(rows)
    assert any(want[v[0]][0] for v in want.values() if v[0])
    assert got_variants(spelling.variants(docs_of(spark, rows), block_words=block_words)) == want


def test_spelling_of_odd_rows(spark):
    long = "grown " * 200_000 + "Aardvark " * 9  # over 1 MB
    rows = [(1, None), (2, ""), (None, "Ünïcodé ÜNÏCODÉ ünïcodé Ünïcodé ünïcodé " * 4), (3, long), (3, long), (4, "aaaaaa× ÷÷÷÷÷÷ " * 6),
            (5, "日本語日本語 " * 9), (6, "a" * 50_000 + " " + "b" * 40)]
    want = plain_variants(rows)
    assert "aardvark" in want
    assert got_variants(spelling.variants(docs_of(spark, rows))) == want
    for empty in (docs_of(spark, []), docs_of(spark, [(1, None), (2, "few rare words")])):
        assert spelling.variants(empty).count() == 0
    assert spelling.variants(docs_of(spark, [(1, "")])).columns == ["word", "form", "root", "n", "n_near", "form_n"]


# -- token files -----------------------------------------------------------------

def test_both_ways_of_splitting_agree():
    from larder.llm.bpe import split_words

    rnd = random.Random(6)
    points = [p for r in (range(1, 0x250), range(0x400, 0x530), range(0x2000, 0x2070), (0x3000, 0xFEFF, 0x1F600)) for p in r]
    for _ in range(3000):
        text = "".join(rnd.choice((chr(rnd.choice(points)), rnd.choice("ab '\n 9.éж"), rnd.choice(("'s", "'ll", "  ", "\r\n", "don't ")))) for _ in range(12))
        assert token_files.words_of(text) == split_words(text), text
    assert token_files.words_of("x<|endoftext|> y") == ["x", "<|endoftext|>", " y"]
    assert not token_files._UNCOMMON.search("Zażółć — «été» ~[ok]_ Пример, 12%\n")


def plain_ids(rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(default_vocabulary())
    return [(i, [*tok.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows]


def as_bytes(ids):
    return np.array(ids, "<u4").tobytes()


def folder_for(spark):
    return f"{checkpoint_dir(spark)}/test-token-files-{uuid.uuid4().hex}"


def test_encoder_forgets_words_without_losing_ids(monkeypatch):
    monkeypatch.setattr(token_files, "HELD", 6)
    monkeypatch.setattr(token_files, "CHUNK_CHARS", 30)
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(("the", "a", "of", f"rare{rnd.randint(0, 99)}", "")) for _ in range(9)) for _ in range(60)] + [None, ""]
    got = list(token_files.Encoder(default_vocabulary())(texts, 0))
    assert got == [as_bytes(ids) for _, ids in plain_ids(enumerate(texts))]


def test_token_files_round_trip(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    at, want = 0, []
    for i, ids in plain_ids(rows):
        want.append((i, at, len(ids), zlib.crc32(as_bytes(ids))))
        at += len(ids)
    got = sorted(tuple(r) for r in token_files.op13_token_files(spark, SF).collect())
    assert got == want


def test_token_files_small_segments_and_single_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    folder = folder_for(spark)
    token_files.write(docs, folder, default_vocabulary(), segment_bytes=4000, shard_bytes=30_000)
    segments = spark.read.parquet(f"{folder}/segments")
    assert segments.count() > 20 and segments.select("shard").distinct().count() > 4
    digest, data = token_files.dictionary(spark, folder)
    assert data and {r["sha256"] for r in segments.select("sha256").distinct().collect()} == {digest}
    whole = {r["doc_id"]: r for r in token_files.read(spark, folder).collect()}
    ids = sorted(whole)
    assert [whole[i]["start"] for i in ids] == np.cumsum([0] + [whole[i]["n_tokens"] for i in ids])[:-1].tolist()
    some = [ids[3], ids[77], -5]
    part = {r["doc_id"]: r for r in token_files.read_ids(spark, folder, some).collect()}
    assert part == {i: whole[i] for i in some[:2]}
    # the dictionary is what makes short documents small
    plain = sum(len(token_files.zstandard.ZstdCompressor(level=3).compress(bytes(r["ids"]))) for r in whole.values())
    assert segments.agg(F.sum(F.octet_length("frames"))).first()[0] < 0.9 * plain


def test_token_files_of_odd_rows(spark):
    long = "word and number 12 " * 60_000
    rows = [(7, None), (7, ""), (None, "no id"), (3, long), (5, "same"), (5, "same"), (5, "other"), (-2, "<|endoftext|> é \u0000 日本"), (2**40, "far")]
    folder = folder_for(spark)
    token_files.write(docs_of(spark, rows), folder, default_vocabulary())
    got = sorted((tuple(r) for r in token_files.read(spark, folder).collect()), key=lambda r: r[1])
    want = plain_ids(rows)
    assert Counter((r[0], bytes(r[4])) for r in got) == Counter((i, as_bytes(x)) for i, x in want)
    assert [r[0] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r[1] == at and r[3] == zlib.crc32(bytes(r[4])) and r[2] * 4 == len(r[4])
        at += r[2]
    assert [r["doc_id"] for r in token_files.read_ids(spark, folder, [5, 3]).select("doc_id").collect()].count(5) == 3


def test_token_files_of_an_empty_table_and_a_foreign_dictionary(spark):
    folder = folder_for(spark)
    token_files.write(docs_of(spark, []), folder, default_vocabulary())
    assert token_files.read(spark, folder).count() == 0 and token_files.read_ids(spark, folder, [1]).count() == 0
    other = folder_for(spark)
    token_files.write(docs_of(spark, [(1, "x")]), other, default_vocabulary())
    segments = spark.read.parquet(f"{other}/segments").withColumn("base", F.lit(0))
    with pytest.raises(Exception, match="another dictionary"):
        token_files._documents(segments, "0" * 64, b"").collect()
