"""The pipeline against a plain chain of the operators' brute-force versions, and the entry point without this part."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

import __spark_entry__ as E
import corpus_pipeline as P

ROOT = os.path.dirname(os.path.abspath(E.__file__))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    folder = f"{P.checkpoint_dir(spark)}/test-pipeline-{os.getpid()}"
    for i, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.mode("overwrite").parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        out.append((name, docs.toPandas()))
    return out


def test_every_stage_takes_effect(spark, stages):
    from tests.llm.test_text_operators import brute_print

    from larder.llm import bpe, decontaminate, pii

    before = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    judged = E.queries()["op7_quality_rules"](spark, SF).toPandas().set_index("doc_id")
    tables = dict(stages)
    first = tables["quality_rules"]
    assert set(first.doc_id) == set(judged.index[judged.kept]) and list(first.columns) == list(before.columns)
    # near duplicates: one document for each component of a brute-force graph
    prints = {r.doc_id: brute_print(r.text) for r in first.itertuples()}
    ids, left, kept = sorted(prints), set(prints), set()
    while left:
        todo = [min(left)]
        kept.add(todo[0])
        left.discard(todo[0])
        while todo:
            a = todo.pop()
            near = {b for b in left if (prints[a] ^ prints[b]).bit_count() <= 3}
            left -= near
            todo += near
    second = tables["simhash_near_dedup"]
    assert sorted(second.doc_id) == sorted(kept) and ids
    items = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()
    third = tables["benchmark_decontamination"]
    grams = lambda w: set(zip(*(w[j:] for j in range(5))))
    tests = [grams(decontaminate.tokens(t)) for t in items.text]
    dirty = {r.doc_id for r in second.itertuples() if any(len(grams(decontaminate.tokens(r.text)) & t) >= 0.8 * len(t) for t in tests)}
    assert dirty and set(third.doc_id) == set(second.doc_id) - dirty
    fourth = tables["pii"]
    old = third.set_index("doc_id").text
    assert set(fourth.doc_id) == set(third.doc_id)
    for r in fourth.itertuples():
        was, now = pii.entities(old[r.doc_id]), pii.entities(r.text)
        assert len(was) == len(now) and not {x[2:] for x in was} & {x[2:] for x in now} and r.n_chars == len(r.text)
    last = tables["bpe"]
    texts = fourth.set_index("doc_id").text
    assert len(last) == len(fourth)
    tok, _ = bpe.vocabulary(bpe.default_vocabulary())
    for r in last.itertuples():
        assert r.decoded == texts[r.doc_id]
        assert [int.from_bytes(r.ids[i:i + 4], "little") for i in range(0, len(r.ids), 4)] == tok.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_run_equals_the_stages(spark, stages):
    got = P.run(spark, SF).toPandas().sort_values("doc_id", ignore_index=True)
    want = stages[-1][1].sort_values("doc_id", ignore_index=True)
    assert got[["doc_id", "n_tokens", "decoded"]].equals(want[["doc_id", "n_tokens", "decoded"]])


def test_entry_works_without_this_part(tmp_path):
    code = ("import sys, importlib.abc\n"
            "class No(importlib.abc.MetaPathFinder):\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name.startswith('larder.llm') or name == 'corpus_pipeline': raise ModuleNotFoundError(name)\n"
            "sys.meta_path.insert(0, No())\n"
            "import __spark_entry__ as e\n"
            "names = set(e.queries())\n"
            "assert 'stock_valuation' in names and 'pipeline' not in names and not any(n.startswith('op1_') for n in names)\n")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT})


def test_every_query_runs_at_smallest_scale(spark):
    docs, pages = spark.read.parquet(f"{SF}/documents.parquet").count(), spark.read.parquet(f"{SF}/pages.parquet").count()
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    for name, fn in E.queries().items():
        if name.startswith("op"):
            n = fn(spark, SF).count()
            want = {"op1_url_filter": pages, "op2_html_extract": pages, "op11_whitening": 8 * vectors}
            assert n == want.get(name, docs) or name in ("op3_decontaminate", "op12_spelling") and n > 0, name
