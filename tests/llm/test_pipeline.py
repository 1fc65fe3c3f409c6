"""The registered queries against their SQL, and the pipeline's stages against what the operators say of their inputs."""

from collections import Counter, defaultdict

import pytest
from compare import connect, duck_rows, spark_rows
from conftest_texts import CLASHING, odd_texts
from test_decontaminate import slow
from test_mixing import slow_targets
from test_near_copies import slow_kept
from test_pii import slow_base

import __spark_entry__ as entry
import corpus_pipeline
from tidemark.llm import pii, quality, queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, sf, name):
    assert spark_rows(queries.QUERIES[name](spark, sf)) == duck_rows(connect(sf), queries.SQL[name])


def test_registration():
    registered = entry.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in registered) == 1
    assert "pipeline" in registered and set(queries.SQL) <= set(entry.oracle_sql())


def test_stages_and_run(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    benchmark = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts, mix = {}, []
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        columns = docs.columns
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(at)))
        docs = spark.read.parquet(str(tmp_path / str(at)))
        after = docs.collect()
        ids = {r.doc_id for r in after}
        if name != "mixing":
            assert docs.columns == columns and len(after) == len(ids)
        if name == "quality":
            model = quality.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
            assert ids == {i for i, r in before.items() if model.scores([r.text.encode()])[0] >= 0.3} and 0 < len(ids) < len(before)
        if name == "near_dedup":
            assert ids == {i for i, _ in slow_kept([(i, r.text) for i, r in before.items()])} and len(ids) < len(before)
        if name == "decontamination":
            assert ids == {i for i, r in before.items() if not slow(r.text, benchmark)[1]}
        if name == "pii":
            assert ids == set(before)
            texts = {r.doc_id: r.text for r in after}
            for i, text in texts.items():
                assert slow_base(text) == [] and (slow_base(before[i].text) != [] or text == before[i].text)
            assert any(f"<{k.upper()}>" in t for t in texts.values() for k in pii.KINDS)
        if name == "mixing":
            sizes, words = defaultdict(int), defaultdict(int)
            for r in before.values():
                sizes[r.source] += len(r.text.split())
            copies = Counter(r.doc_id for r in after)
            assert max(copies.values()) <= 2 and all(texts[r.doc_id] == r.text for r in after)
            assert sorted((r.doc_id, r.copy) for r in after) == sorted((i, k) for i, n in copies.items() for k in range(1, n + 1))
            for r in after:
                words[r.source] += len(r.text.split())
            largest = max(len(r.text.split()) for r in before.values())
            assert all(abs(words[s] - t) <= largest for s, t in slow_targets(dict(sizes)).items())
            mix = sorted(tuple(r) for r in after)
    assert mix and sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).collect()) == mix


def odd_folder(docs, spark, sf, tmp_path):
    """A folder of tables with the odd texts as documents."""
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_run_keeps_clashing_columns(spark, sf, odd_docs, tmp_path):
    folder = odd_folder(odd_docs, spark, sf, tmp_path)
    mixed = corpus_pipeline.run(spark, folder)
    assert [c for c in mixed.columns if c != "copy__"] == odd_docs.columns
    rows = mixed.collect()
    assert rows and all(r[c] == "clash" for r in rows for c in CLASHING)
    assert {r.doc_id for r in rows} <= {i for i, _ in odd_texts()}


def test_run_of_no_documents(spark, sf, no_docs, tmp_path):
    assert corpus_pipeline.run(spark, odd_folder(no_docs, spark, sf, tmp_path)).collect() == []
