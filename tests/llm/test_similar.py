"""Near copies by the similarity of their shingles, against brute force."""

from __future__ import annotations

import random

import corpus_pipeline
from meterlark.llm import components, simhash, similar


def _components(sets):
    """Position of the first of each set's component: Jaccard similarity of 0.8 and more, chains included."""
    parent = list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                r, s = find(a), find(b)
                parent[max(r, s)] = min(r, s)
    return [find(a) for a in range(len(sets))]


def _shingles(text, n=5):
    ws = text.lower().split()
    return {tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set()


def _near_copies(families, copies):
    """Texts of 60 to 200 words, and copies with some words changed; all hold one common passage."""
    rng = random.Random(11)
    common = [f"common{i}" for i in range(15)]
    out = []
    for f in range(families):
        ws = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(60, 200))] + common
        for _ in range(copies):
            own = list(ws)
            for at in rng.sample(range(len(own)), rng.randrange(6)):
                own[at] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(own))
    return out


def _held(spark, texts):
    rows = list(enumerate(texts))
    got = {r.doc_id: r.component_id for r in similar.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(_components([_shingles(t) for t in texts])))
    return got


def test_similar_documents_match_brute_force(spark, monkeypatch):
    texts = [*_near_copies(20, 8), "", " \n", "Two words", "two WORDS", "a b c d e", "a b c d f"]
    got = _held(spark, texts)
    assert 20 < len(set(got.values())) < len(texts)
    monkeypatch.setattr(similar, "PAIRED", 3)
    assert _held(spark, texts) == got
    assert similar.similar_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_similar_documents_of_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    found = similar.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    ids = [r.doc_id for r in rows]
    want = _components([_shingles(r.text or "") for r in rows])
    assert {r.doc_id: r.component_id for r in found.collect()} == {i: ids[c] for i, c in zip(ids, want, strict=True)}


def test_the_stage_drops_copies_many_bits_apart(spark, sf):
    """Copies of a similarity of 0.8 whose fingerprints differ in more than two bits."""
    texts = _near_copies(10, 4)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    want = _components([_shingles(t) for t in texts])
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, sf).collect()) == sorted(set(want)) != list(range(len(texts)))


def test_stages_keep_one_row_of_an_id_and_text(spark, sf):
    long = " ".join(f"word{i}" for i in range(80))
    rows = [(1, "one text of its own"), (1, "one text of its own"), (2, long), (2, "another text"), (2, "another  text"), (3, long), (None, "no id"), (None, "no id"), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = sorted(map(str, [(1, rows[0][1]), (2, long), (2, "another  text"), (None, "no id"), (5, None)]))
    for stage, left in ((corpus_pipeline.exact, docs), (corpus_pipeline.near, docs.where("text is null or text <> 'another text'"))):
        assert sorted(str((r.doc_id, r.text)) for r in stage(spark, left, sf).collect()) == want


def test_quality_decides_on_each_text_of_an_id(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = corpus_pipeline.quality(spark, docs, sf).select("doc_id").collect()
    good = {r.doc_id for r in good}
    bad = docs.where(~docs.doc_id.isin(list(good))).limit(3).collect()
    twins = spark.createDataFrame([(min(good), b.text, b.lang, b.source, b.n_chars) for b in bad], docs.schema)
    left = corpus_pipeline.quality(spark, docs.unionByName(twins), sf).where(f"doc_id = {min(good)}").collect()
    assert len(left) == 1 and left[0].text not in {b.text for b in bad}


def _bits(a, b):
    return ((a ^ b) & ((1 << 64) - 1)).bit_count()


def _long_copies(families, copies):
    """Long texts, and copies with one word changed: some are at most two bits apart, some are not."""
    rng = random.Random(5)
    out = []
    for _ in range(families):
        ws = [f"w{rng.randrange(3000)}" for _ in range(600)]
        for _ in range(copies):
            own = list(ws)
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(own))
    return out


def test_near_fingerprints_join_what_two_bits_join(spark):
    sets = [similar.shingles(t) for t in _long_copies(12, 6)]
    rows = [(similar._node(s), len(s), simhash.set_fingerprint(s), similar.parity(s).tolist()) for s in sets]
    # Sets of one fingerprint.
    rows += [(n + 1, size, fp, mask) for n, size, fp, mask in rows[:5]]
    found = similar.near_fingerprints(spark.createDataFrame(rows, "node long, size long, fp long, mask array<long>"), 4, 5).collect()
    fp = {r[0]: r[2] for r in rows}
    assert found and all(r.u < r.v and _bits(fp[r.u], fp[r.v]) <= 2 for r in found)
    nodes = [r[0] for r in rows]
    want = {n: n for n in nodes}
    got = dict(want)
    for of, pairs in ((want, [(a, b) for a in nodes for b in nodes if _bits(fp[a], fp[b]) <= 2]), (got, [(r.u, r.v) for r in found] * 9)):
        for _ in range(9):
            for a, b in pairs:
                of[a] = of[b] = min(of[a], of[b])
    assert got == want and 12 <= len(set(got.values())) < len(nodes)


def test_set_fingerprint_is_the_simhash_of_the_text():
    for text in ("", "one", "A b c d e f g h", " ".join(f"word{i}" for i in range(700))):
        assert simhash.set_fingerprint(similar.shingles(text)) == simhash._signed(simhash.fingerprint(text, 5))
    own = similar.shingles(" ".join(f"word{i}" for i in range(700)))
    assert simhash.set_fingerprint(own, 100) == simhash.set_fingerprint(own)


def test_the_stage_links_by_fingerprints_and_compares_no_class_again(spark, sf, monkeypatch):
    """Copies within two bits are linked through pivots; only other pairs meet under sketch hashes."""
    texts = [*_long_copies(6, 5), *_near_copies(6, 4)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    verified, plain = [], similar._verified

    def watched(pairs, *more):
        out = plain(pairs, *more)
        verified.append(([(r.u, r.v) for r in pairs.collect()], out))
        return out

    monkeypatch.setattr(similar, "_verified", watched)
    want = _components([_shingles(t) for t in texts])
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, sf).collect()) == sorted(set(want))
    fp = {similar._node(s): simhash.set_fingerprint(s) for s in map(similar.shingles, texts)}
    by_pivots, links = verified[0]
    assert links.count() > 6 and all(_bits(fp[u], fp[v]) <= 2 for u, v in by_pivots)
    classes = {r.node: r.root for r in components.components(links).collect()}
    rest = [p for pairs, _ in verified[1:] for p in pairs]
    assert rest and all(classes.get(u, u) != classes.get(v, v) for u, v in rest)
