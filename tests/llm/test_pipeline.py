"""The pipeline against a plain version of its stages, and the registered queries."""

from __future__ import annotations

import re
from collections import defaultdict

import corpus_pipeline
from meterlark.llm import queries, similar


def test_pipeline_matches_a_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in corpus_pipeline.quality(spark, docs, sf).collect()}
    assert 0.5 * len(texts) < len(good) < len(texts)
    groups = defaultdict(list)
    for i in good:
        groups[re.sub(r"[\x20\x09-\x0D]", "", texts[i])].append(i)
    exact = sorted(min(g, key=lambda i: (-len(texts[i]), i)) for g in groups.values())
    sets = {i: set(similar.shingles(texts[i]).tolist()) for i in exact}

    def alike(x, y):
        return x == y or 5 * len(x & y) >= 4 * len(x | y)

    kept, left = set(), set(exact)
    while left:
        group, todo = set(), [min(left)]
        while todo:
            a = todo.pop()
            if a in left:
                left.discard(a)
                group.add(a)
                todo += [b for b in left if alike(sets[a], sets[b])]
        kept.add(min(group))
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == kept
    assert all(len(r.ids) == r.length for r in rows)


def test_stages_return_the_columns_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name


def test_packing_remembers_fewer_chunks_than_alone(spark, sf, monkeypatch):
    """Stages before it have left less memory: with 900,000 chunks an executor passed its 3,000 MB."""
    seen, plain = [], corpus_pipeline.pack
    monkeypatch.setattr(corpus_pipeline, "pack", lambda *args, **options: (seen.append(options), plain(*args, **options))[1])
    assert corpus_pipeline.packed(spark, spark.read.parquet(f"{sf}/documents.parquet").limit(5), sf).count() >= 5
    assert seen[0]["known"] <= 100_000


def test_empty_documents(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_each_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11)) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
