"""The corpus operators on odd rows, and against brute force."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import string
import time
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meterlark.llm import bpe, chunks, components, exact_dedup, license_scan, line_dedup, packing, quality, sharding, simhash, token_counts, topk

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Nulls, empty and white texts, ties, repeated rows, a long text, special strings.
ODD = [
    (1, None), (2, ""), (3, " \t\r\n"), (4, "mit license"), (4, "mit license"), (5, "MIT  LICENSE"), (6, "a" * 3000), (7, "x<|endoftext|> y"), (None, "no id"), (8, "héllo wörld " * 400), (9, "日本語 テキスト"),
]


def docs(spark, rows=ODD):
    """Documents with more columns, whose names the operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit(c) for c in ("row", "n", "size", "shard", "key", "fp", "ids", "own", "words", "score", "_id", "i", "t")})


@pytest.fixture(scope="module")
def table(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(table):
    return {r.doc_id: r.text for r in table.collect()}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


# licence scan


def _scan(text, threshold=0.8):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
    places, base, own, best = [], set(), set(), 0.0
    for phrase, label in license_scan.BASE.items():
        p = phrase.split()
        found = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += found
        base |= {label} if found else set()
    for t in license_scan.templates(threshold):
        if not t.base:
            n = len(t.words)
            for at in range(0, len(words), n):
                shared = len(set(words[at : at + 2 * n]) & t.tokens)
                if shared >= t.need:
                    own.add(t.label)
                    best = max(best, shared / len(t.tokens))
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), 1.0 if places else best


def test_scan_matches_brute_force(spark, table, texts):
    fields = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    got = {r.doc_id: tuple(r[f] for f in fields) for r in license_scan.scan(table).collect()}
    assert got == {i: _scan(t) for i, t in texts.items()}


def test_filters_discard_blocks_before_they_are_counted(spark):
    """A prefix token alone: at a text's end too few words follow, elsewhere too few tokens of higher rank."""
    plan = license_scan.templates(0.8)
    filler = " ".join(f"w{i}" for i in range(200))
    common = " ".join(f"{w} " * 60 for t in plan for w in t.words if w != "charge")
    rows = [(i, f"{filler} charge {filler}") for i in range(20)] + [(i, "charge") for i in range(20, 40)] + [(98, common), (99, f"{filler} permission is hereby granted free of charge to any person obtaining a copy of this software {filler}")]
    found = license_scan.blocks(docs(spark, rows), "doc_id", "text", plan).where("label = 'mit-text' and start is not null")
    late = found.where("id = 99 and shared >= need").count()
    assert late and found.where("id >= 20 and id < 40").count() == 0  # by length
    early = found.where("id < 20")
    assert early.count() and early.where("may").count() == 0  # by position
    got = {r.doc_id: r.labels for r in license_scan.scan(docs(spark, rows)).collect()}
    assert {i for i, v in got.items() if "mit-text" in v} == {99}


def test_scan_odd_rows(spark):
    rows = [*ODD, (20, "cc by cc by mit license apache license"), (21, "You may not use this FILE, except in compliance with the Licence"), (22, "gnuK general public license"), (23, "GNU-general/public_LICENSE")]
    got = license_scan.scan(docs(spark, rows)).collect()
    assert sorted(map(str, [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in got])) == sorted(map(str, [(i, *_scan(t)) for i, t in rows]))
    assert license_scan.scan(docs(spark, [])).count() == 0


# exact dedup


def test_index_keeps_the_longest_then_the_first(spark):
    index = exact_dedup.DigestIndex(spark, f"t_{uuid.uuid4().hex}", buckets=4)
    rows = [(5, "a b"), (3, "ab"), (2, "a  b"), (9, "a  b"), (9, "a  b"), (1, "c"), (1, "c"), (4, None), (6, " "), (None, "q"), (None, "q")]
    got = sorted(index.add(docs(spark, rows)).collect(), key=str)
    keep = {"ab": 2, "c": 1, "": 6, "q": None}
    for r in got:
        assert r.kept is False or keep[next(k for k in keep if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)] == r.doc_id
    # Of repeated rows one stays.
    assert sorted(str(r.doc_id) for r in got if r.kept) == ["1", "2", "6", "None"]
    again = index.add(docs(spark, [(0, "a b"), (7, "new"), (7, "new")])).collect()
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in again) == [(0, 2, False), (7, 7, False), (7, 7, True)]
    assert index.add(docs(spark, [])).count() == 0
    index.drop()


def test_a_batch_run_again_decides_the_same(spark):
    index = exact_dedup.DigestIndex(spark, f"t_{uuid.uuid4().hex}", buckets=4)
    index.add(docs(spark, [(1, "a")]), batch="one")
    rows = [(2, "a"), (3, "b"), (4, "b")]
    want = sorted(tuple(r) for r in index.add(docs(spark, rows), batch="two").collect())
    assert sorted(tuple(r) for r in index.add(docs(spark, rows), batch="two").collect()) == want
    assert [r[3] for r in want] == [False, True, False] and index.entries().count() == 2
    index.compact()
    assert index.entries().count() == 2 and [r.kept for r in index.add(docs(spark, [(9, "b")])).collect()] == [False]
    index.drop()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith(index.table)]


def test_a_better_row_is_a_new_version(spark):
    index = exact_dedup.DigestIndex(spark, f"t_{uuid.uuid4().hex}", buckets=4)
    try:
        index.add(docs(spark, [(5, "a b"), (6, "c"), (None, "d")]), batch="one", replace=True)
        rows = [(9, "a  b"), (7, "c"), (8, "c"), (3, "d"), (1, "e")]
        want = [(1, 1, True), (3, 3, True), (7, 6, False), (8, 6, False), (9, 9, True)]
        for _ in range(2):  # the second run appends nothing
            got = index.add(docs(spark, rows), batch="two", replace=True)
            assert sorted((r.doc_id, r.keep_id, r.kept) for r in got.collect()) == want
            assert index.entries().count() == 6 and index.current().count() == 4
        # A row as good as the one that is kept does not replace it, nor does a worse one.
        later = index.add(docs(spark, [(9, "a  b"), (1, "ab")]), batch="three", replace=True).collect()
        assert [(r.keep_id, r.kept) for r in later] == [(9, False)] * 2 and index.entries().count() == 6
        index.compact()
        assert index.entries().count() == 4 and {r.keep_id for r in index.current().collect()} == {9, 6, 3, 1}
    finally:
        index.drop()


def test_the_index_is_not_exchanged(spark):
    index = exact_dedup.DigestIndex(spark, f"t_{uuid.uuid4().hex}", buckets=3)
    try:
        index.add(docs(spark, [(i, f"t {i}") for i in range(50)]), batch="one")
        groups = index.reduced(exact_dedup.digested(docs(spark, [(i, f"t {i}") for i in range(40, 60)]), "doc_id", "text"))
        for joined, rows in ((index.unknown(groups), 10), (index.better(groups), 0)):
            plan = joined._jdf.queryExecution().executedPlan().toString()
            # The batch's digests are dealt as the buckets are; nothing else is.
            assert "SortMergeJoin" in plan and "Bucketed: true" in plan
            assert re.findall(r"Exchange hashpartitioning\(text_sha256#\d+, (\d+)\)", plan) == ["3"] and plan.count("Exchange") == 1, plan
            assert joined.count() == rows
    finally:
        index.drop()


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_batches_do_not_change_what_stays(spark, batches):
    rng = random.Random(batches)
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, "", "a b", "ab", "a  b", "b", "b ", "c d e", "cd e"])) for _ in range(150)]
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[ \t-\r]", "", t or "")].append((-len(t or ""), i is None, i or 0))
    got = defaultdict(list)
    for r in exact_dedup.deduplicated(docs(spark, rows).repartition(4), batches=batches).collect():
        got[r.text_sha256].append(r)
    assert len(got) == len(groups)
    for key, members in groups.items():
        found, best = got[hashlib.sha256(key.encode()).hexdigest()], min(members)
        keep = None if best[1] else best[2]
        assert len(found) == len(members) and {(r.keep_id, r.group_size) for r in found} == {(keep, len(members))}
        assert [r.doc_id for r in found if r.kept] == [keep]


def test_the_dedup_query_leaves_no_table(spark, sf):
    before = {t.name for t in spark.catalog.listTables()}
    assert exact_dedup.op2_digest_index(spark, sf).where("kept").count() == exact_dedup.op2_digest_index(spark, sf).select("text_sha256").distinct().count()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_hot_group_and_digest(spark):
    index = exact_dedup.DigestIndex(spark, f"t_{uuid.uuid4().hex}", buckets=4)
    try:
        rows = [(i, "same text" if i % 3 else f"own {i}") for i in range(600)]
        got = {r.doc_id: r for r in index.add(docs(spark, rows)).collect()}
        assert got[2].keep_id == 1 and got[2].group_size == 400 and got[3].kept
        assert got[3].text_sha256 == hashlib.sha256(b"own3").hexdigest()
    finally:
        index.drop()


# SimHash


def _components(fps):
    parent = list(range(len(fps)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(a) for a in range(len(fps))]


def test_fingerprint_by_definition():
    def slow(text, words):
        ws = re.findall(r"[^\x20\x09-\x0D]+", text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
        sh = [" ".join(ws[i : i + words]) for i in range(max(1, len(ws) - words + 1))] if ws else []
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0

    for text in ("", " \n", "One", "Éa b", "a b c", "a b c d e f A B C", "x " * 500):
        assert simhash.fingerprint(text) == slow(text, 3) == simhash.fingerprint(text, step=2)


def test_near_duplicates_match_brute_force(spark, table, texts):
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(table).collect()}
    ids = sorted(texts)
    fps = [simhash.fingerprint(texts[i]) for i in ids]
    assert got == {i: (f, ids[c]) for i, f, c in zip(ids, fps, _components(fps), strict=True)}


def test_crowded_keys_lose_no_link(spark):
    random.seed(5)
    fps = {0, 2**64 - 1, 1 << 63}
    for _ in range(400):  # a cloud about one value, and a chain away from it
        fps.add(sum(1 << random.randrange(64) for _ in range(random.randrange(4))) % 2**64)
    x = 0xABCDEF
    for i in range(12):
        x ^= 3 << (5 * i)
        fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    roots = {r.node % 2**64: r.root for r in components.components(simhash.links(df)).collect()}
    want = _components(fps)
    groups, found = defaultdict(set), defaultdict(set)
    for f, c in zip(fps, want, strict=True):
        groups[c].add(f)
        found[roots.get(f, f"alone {f}")].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))
    assert max(map(len, groups.values())) > simhash.PAIRED


def test_near_duplicates_odd_rows(spark):
    got = simhash.near_duplicates(docs(spark)).collect()
    of = {r.doc_id: r.component_id for r in got}
    assert len(got) == len(ODD) and of[1] == of[2] == of[3] == 1 and of[4] == 4 and of[5] == 4
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(i + 1, i) for i in range(100, 120)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 121)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_of_a_million_edges(spark):
    edges = spark.range(1_000_000).select((F.col("id") * 2).alias("u"), (F.col("id") * 2 + 1).alias("v"))
    got = components.components(edges)
    assert got.agg(F.count(F.lit(1)), F.count_if(F.col("root") == F.col("node") - F.col("node") % 2)).first()[:] == (2_000_000, 2_000_000)


# BPE


@pytest.fixture(scope="module")
def reference_bpe():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_rank_queue_matches_the_library(reference_bpe):
    ranks, _ = bpe.encoder(RANKS)
    random.seed(1)
    pieces = [bytes(random.choices(b"abt ", k=random.randrange(1, 200))) for _ in range(300)] + ["ß".encode() * 99, b"\x00\xff" * 40, b"a", b""]
    ids, counts = ranks.encode(pieces)
    for piece, own in zip(pieces, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert own.tolist() == (reference_bpe._encode_single_piece(piece) if piece else [])
        assert bpe.decode(own, ranks.tokens) == piece


def test_very_long_pretokens(reference_bpe):
    """Repeats whose merges make smaller ranks, the case in which a bucket has to wait."""
    ranks = bpe.Ranks(RANKS)
    for unit in (b"abcab", b"theand", b"aaaaa"):
        piece = unit * 4000
        assert ranks.merge_long(piece).tolist() == reference_bpe._encode_single_piece(piece)
    began = time.monotonic()
    million = b"abcab" * 200_000
    assert b"".join(ranks.tokens[i] for i in ranks.merge_long(million).tolist()) == million
    assert time.monotonic() - began < 60
    rng = random.Random(3)
    pieces = [bytes(rng.choice(b"theandisors") for _ in range(rng.randrange(1, 90))) * rng.randrange(1, 20) for _ in range(300)]
    ids, counts = ranks.encode(pieces)
    got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [reference_bpe._encode_single_piece(p) for p in pieces]


def test_bitmap():
    b = bpe.RankBitmap(300_000)
    members = random.Random(3).sample(range(300_000), 500)
    for i in members:
        b.add(i)
    out = []
    while (i := b.first()) >= 0:
        out.append(i)
        b.remove(i)
    assert out == sorted(members)


def test_encode_texts(spark, table, texts, reference_bpe):
    got = {r.doc_id: r for r in bpe.digests(table.select("doc_id", "text"), RANKS).collect()}
    for i, text in texts.items():
        ids = reference_bpe.encode_ordinary(text)
        assert got[i].coded.asDict() == {"n_tokens": len(ids), "ids_sha256": hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), "decoded_sha256": hashlib.sha256(text.encode()).hexdigest()}
    odd = bpe.encode_texts(docs(spark), RANKS).collect()
    assert sorted((r.ids for r in odd), key=str) == sorted((reference_bpe.encode_ordinary(t or "") for _, t in ODD), key=str) and odd[0].row == "row"
    assert bpe.encode_texts(docs(spark, []), RANKS).count() == 0


# chunks and token counts


def test_chunk_table_matches_the_library(library):
    random.seed(2)
    alphabet = list("ab \n\t.,'s1é \x1c\x85 !") + [" "] * 5
    many = ["".join(random.choices(alphabet, k=random.randrange(60))) for _ in range(3000)] + [t or "" for _, t in ODD] + ["", " ", "  a", "a  b ", "<|endoftext|>", " <|endoftext|> a<|endoftext|>"]
    table = chunks.ChunkTable(chunks.library_encode(JSON))
    want = [e.ids for e in library.encode_batch(many, add_special_tokens=False)]
    assert [x.tolist() for x in table.ids(many)] == want and table.counts(many).tolist() == list(map(len, want))
    table.most = 10  # forgets before each batch
    assert [x.tolist() for x in table.ids(many[:50])] == want[:50]


def test_a_workers_table_is_bounded(library):
    table = chunks.library_table(JSON, 300)
    assert chunks.library_table(JSON, 300) is table is not chunks.library_table(JSON)
    texts = [" ".join(f"word{i}x{k}" for k in range(100)) for i in range(50)]
    for text in texts:
        assert [x.tolist() for x in table.ids([text])] == [library.encode(text, add_special_tokens=False).ids]
        # What one call adds is not forgotten before the next.
        assert sum(len(numbers) for numbers, _, _ in table.kinds) <= 300 + 100


def test_pack_with_few_known_chunks(spark, table, texts):
    rows = table.select("doc_id", "text").limit(60)
    few, many = (sorted(map(str, packing.pack(rows, JSON, **known).collect())) for known in ({"known": 50}, {}))
    assert few == many and len(few) >= 60


def test_parts_of_long_texts(library):
    text = "ab c  d\n e " * 5000
    assert "".join(chunks.parts(text, 1000)) == text
    table = chunks.ChunkTable(chunks.library_encode(JSON))
    old, chunks.parts.__defaults__ = chunks.parts.__defaults__, (1000,)
    try:
        assert next(iter(table.ids([text]))).tolist() == library.encode(text, add_special_tokens=False).ids
    finally:
        chunks.parts.__defaults__ = old


def test_counts_of_spliced_chunks(spark, table, texts, library):
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(table.select("doc_id", "text"), JSON, chunk=400, overlap=4).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}


def test_counts_of_odd_rows(spark, library):
    rows = [*ODD, (30, "b" * 2500), (31, " " * 2500), (32, "a b " * 900 + "c" * 1500 + " d" * 300), (33, "<|endoftext|>" * 200), (34, "<|endoftext|> x " * 200)]
    got = token_counts.count_tokens(docs(spark, rows), JSON, chunk=300, overlap=8).collect()
    assert sorted(str((r.doc_id, r.n_tokens)) for r in got) == sorted(str((i, len(library.encode(t or "", add_special_tokens=False).ids))) for i, t in rows)
    assert got[0].own == "own" and token_counts.count_tokens(docs(spark, []), JSON).count() == 0


def test_splices_need_a_common_place(spark):
    side = "array<struct<p:long,n:long>>"
    df = spark.createDataFrame([(1, 0, 9, [], [(10, 4)], 0, 10), (1, 1, 9, [(10, 2)], [], 10, 20), (2, 0, 9, [], [(10, 4)], 0, 10), (2, 1, 9, [(11, 2)], [], 10, 20)], f"row long, chunk int, n long, left {side}, right {side}, left_at long, right_at long")
    got = {(r.row, r.chunk): (r.n, r.failed) for r in token_counts.splice(df).collect()}
    assert got == {(1, 0): (4, False), (1, 1): (7, False), (2, 0): (None, True), (2, 1): (None, False)}


def test_chunks_beside_a_failed_splice_are_joined(spark):
    text = "".join(chr(97 + i % 26) for i in range(50))
    cuts = [(0, 0), (10, 2), (20, 3), (30, 2), (50, 0)]
    rows = [(1, k, text[max(0, a - u) : b + v], max(0, a - u), a, u, b, v) for k, ((a, u), (b, v)) in enumerate(zip(cuts, cuts[1:], strict=False))]
    chunks_ = spark.createDataFrame(rows, "row long, chunk int, text string, base long, left_at long, left_reach long, right_at long, right_reach long")
    state = spark.createDataFrame([(1, 0, 4, False), (1, 1, None, True), (1, 2, None, True), (1, 3, None, False), (2, 0, 3, False)], "row long, chunk int, n long, failed boolean")
    got = sorted(tuple(r) for r in token_counts.widened(chunks_, state).select(*chunks_.columns).collect())
    assert got == [(1, 0, text[0:12], 0, 0, 0, 10, 2), (1, 1, text[8:50], 8, 10, 2, 50, 0)]


def test_texts_without_spaces_are_cut(spark, library):
    rng = random.Random(5)
    han = "".join("。" if rng.random() < 0.03 else chr(0x4E00 + rng.randrange(2000)) for _ in range(9000))
    feeds = "\n".join("word%d" % rng.randrange(999) for _ in range(1500))
    mixed = "ab" * 4000 + han[:3000] + "x " * 2000
    hard = "<|endoftext|>" * 700 + "  \n \n" * 500
    assert len(token_counts.plan_chunks(han, 1000, 32)) > 6 and len(token_counts.plan_chunks(feeds, 1000, 32)) > 6
    rows = list(enumerate([han, feeds, mixed, hard]))
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs(spark, rows), JSON, chunk=1000, overlap=32).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in rows}


# search


def test_top_k_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 60)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rng = np.random.default_rng(0)
    x = np.floor(rng.normal(size=(500, 8)) * rng.lognormal(0, 1, size=(500, 1)) * 20)
    x[100:260] = x[100]  # one very common vector: ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, df.where("id % 20 = 0"), k=5).collect())
    want = []
    for q in range(0, 500, 20):
        s = [(-int(x[q] @ x[i]), i) for i in range(500) if i != q]
        want += [(q, r + 1, i, -n) for r, (n, i) in enumerate(sorted(s)[:5])]
    assert got == want


def test_search_exchanges_only_what_may_reach_a_floor(spark):
    """Lengths that fall off: most (part, block) pairs and products are never made."""
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(size=(3000, 8)) * (400 / (1 + np.arange(3000)))[:, None])
    order = np.argsort(-np.linalg.norm(x, axis=1))
    x = x[order]
    top = float(np.linalg.norm(x[0]))
    bands = np.clip(np.floor((1 - np.linalg.norm(x, axis=1) / top) * topk.BANDS), 0, topk.BANDS - 1).astype(int)
    counts = {b: int((bands == b).sum()) for b in sorted(set(bands.tolist()))}
    first, shares, blocks = topk._shares(counts, 200)
    scores = x @ x.T
    floors = np.sort(scores[:, :200], axis=1)[:, -5]
    rows = spark.createDataFrame([(i, v.tolist(), int(b), int(first[b] + i % shares[b])) for i, (v, b) in enumerate(zip(x, bands, strict=True))], "id long, v array<double>, band int, block int")
    asked = spark.createDataFrame([(i, x[i].tolist(), float(np.linalg.norm(x[i])), float(floors[i])) for i in range(0, 3000, 20)], "id long, v array<double>, qnorm double, floor double")
    left, right = topk.within_reach(asked, rows, top, first, shares)
    pairs = {(r.qid, r.block) for r in left.select("qid", "block").collect()}
    later = {i: b for i, b in rows.where("block > 0").select("id", "block").collect()}
    assert all((q, b) in pairs for q in range(0, 3000, 20) for i, b in later.items() if scores[q, i] >= floors[q])
    assert len(pairs) < 150 * (blocks - 1) / 2 and right.count() < len(later) * 2
    seen = {}
    q = x[::20]
    got = topk._best(q, np.arange(0, 3000, 20), x, np.arange(3000), 5, np.full(len(q), -np.inf), np.eye(8), 4, seen)
    assert seen["scored"] < seen["within"] < q.shape[0] * len(x)
    for i in range(0, 3000, 600):
        want = sorted(((-scores[i, j], j) for j in range(3000) if j != i))[:5]
        assert sorted((-s, v) for a, v, s in zip(*got, strict=True) if a == i) == want


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.5]), (20, None), (21, [1.0, None]), (22, [float("nan"), 1.0]), (23, [float("inf"), 1.0]), (24, []), (None, [1.0, 1.0]), (25, [-0.01, 2.0]), (25, [-0.01, 2.0])]
    df = topk.integer_vectors(spark.createDataFrame(rows, "k long, e array<float>"), "k", "e", 64.0)
    assert sorted(str((r.id, r.v)) for r in df.collect()) == sorted(map(str, [(0, [64.0, 32.0]), (24, []), (None, [64.0, 64.0]), (25, [-1.0, 128.0]), (25, [-1.0, 128.0])]))
    got = [tuple(r) for r in topk.top_k(df, df.where("id % 20 = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 25, 4032), (0, 2, 25, 4032), (0, 3, 24, 0)]
    assert topk.top_k(df.where("id < 0"), df.where("id < 0")).count() == 0


# packing


def test_differencing_balances():
    sizes = np.random.default_rng(1).integers(1, 257, 4000)
    of = packing.windows_for(sizes, 1024)
    sums = np.bincount(of, sizes)
    assert sums.max() <= 1024 and len(sums) <= -(-sizes.sum() // 1024) * 1.01 and sums.max() - sums.min() <= 16
    assert packing.windows_for(np.array([600, 600, 600]), 1024).tolist() != [0, 0, 0]
    assert sorted(packing.windows_for(np.array([600, 600, 600]), 1024)) == [0, 1, 2]  # the count rose from two


def _held(rows, texts, library):
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, pieces in by.items():
        ids, at = [*library.encode(texts[i] or "", add_special_tokens=False).ids, 0], 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()))
            at += r.length
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    return set(by), sum(1024 * len(sequences) - sum(r.length for r in rows) for _ in (0,))


def test_pack_holds_every_id_once(spark, table, texts, library):
    rows = packing.pack(table, JSON).collect()
    ids, padding = _held(rows, texts, library)
    assert ids == set(texts) and padding < 1024 * 6
    one = rows[0]
    assert zlib.crc32(np.array(one.ids, "<u4").tobytes()) == one.ids_crc32


def test_pack_odd_rows(spark, library):
    rows = [r for r in ODD if r[0] != 4]
    got = packing.pack(docs(spark, rows), JSON, keep_ids=False).collect()
    assert _held(got, dict(rows), library)[0] == {i for i, _ in rows}
    twice = packing.pack(docs(spark, [(4, "mit license")] * 2), JSON, keep_ids=False).collect()
    assert len(twice) == 2 and {r.offset for r in twice} == {0, 3} and packing.pack(docs(spark, []), JSON).count() == 0


# quality


def test_quality_on_held_out_labels(spark, table, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.score_documents(table, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) >= 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    got = quality.score_documents(docs(spark), labels).collect()
    assert len(got) == len(ODD) and all(r.predicted == 1 for r in got)  # one kind of label only: nothing is rejected
    assert quality.score_documents(docs(spark, []), labels).count() == 0


def test_the_cut_is_of_all_labelled_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(int(i % 7 > 0), 1, len(quality.FEATURES)).tolist(), int(i % 7 > 0)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, x array<double>, quality int")
    model = quality.train(df.select("doc_id", "x"), df.select("doc_id", "quality"), most=200, pairs=2000)
    known = [(x, q) for i, x, q in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    raw, k = np.sort([np.dot(x, model.weights) for x, _ in known]), sum(q == 0 for _, q in known)
    assert k < len(known) / 5 and np.isclose(model.cut, (raw[k - 1] + raw[k]) / 2, rtol=1e-9) and np.isclose(model.width, raw.std() / 4)


def test_bradley_terry_orders_a_feature():
    rng = np.random.default_rng(2)
    n = len(quality.FEATURES)
    good, bad = rng.normal(size=(200, n)), rng.normal(size=(80, n))
    good[:, 3] += 6
    m = quality.fit(good, bad, 5000)
    assert np.argmax(np.abs(m.weights)) == 3 and m.weights[3] > 0
    assert np.mean(good @ m.weights >= m.cut) > 0.98 and np.mean(bad @ m.weights < m.cut) > 0.95


# sharding


def _sharded(df, n):
    rows = df.collect()
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in rows:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(n))
    return rows, sizes


def test_shards_of_equal_bytes(spark):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randrange(200)) for i in range(6000)]
    got, sizes = _sharded(sharding.shard_by_bytes(docs(spark, rows)), 16)
    ideal = sum(sizes.values()) / 16
    assert len(got) == 6000 and all(abs(s - ideal) <= 0.02 * ideal + 400 for s in sizes.values())
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == {(i, len(t) + 1, zlib.crc32(t.encode())) for i, t in rows}


def test_a_hot_text_is_split_and_others_stay_together(spark):
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i // 6}") for i in range(6000)]
    got, sizes = _sharded(sharding.shard_by_bytes(docs(spark, rows)), 16)
    ideal = sum(sizes.values()) / 16
    assert all(abs(s - ideal) <= 0.05 * ideal for s in sizes.values())
    texts, where = dict(rows), defaultdict(set)
    for r in got:
        where[texts[r.doc_id]].add(r.shard)
    assert len(where.pop("hot text")) >= 5 and all(len(s) == 1 for s in where.values())


def test_shards_odd_rows(spark):
    got, _ = _sharded(sharding.shard_by_bytes(docs(spark)), 16)
    assert sorted(str((r.doc_id, r.size)) for r in got) == sorted(str((i, len((t or "").encode()) + 1)) for i, t in ODD)
    assert sharding.shard_by_bytes(docs(spark, [])).count() == 0
    assert _sharded(sharding.shard_by_bytes(docs(spark, [(1, "same")] * 50), 4), 4)[1]


# lines


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def _line_classes(rows, per, most):
    places = sorted((i if i is not None else 2**63, k, line) for i, t in rows for k, line in enumerate((t or "").split("\n")) if line.strip(" "))
    distinct = sorted({p[2] for p in places})
    parent = {x: x for x in distinct}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for k, a in enumerate(distinct):
        for b in distinct[:k]:
            t = min(most, min(len(a), len(b)) // per)
            if t and abs(len(a) - len(b)) <= t and _edits(a, b) <= t:
                parent[find(a)] = find(b)
    first = {}
    for i, k, line in places:
        first.setdefault(find(line), (i, k))
    return sorted((i, k, *first[find(line)]) for i, k, line in places)


def _got_lines(df):
    return sorted((r.doc_id if r.doc_id is not None else 2**63, r.line_no, r.first_id if r.first_id is not None else 2**63, r.first_line) for r in df.collect())


def test_banded_distance(spark):
    random.seed(6)
    pairs = []
    for _ in range(400):
        a = "".join(random.choices("abé😀", k=random.randrange(0, 9)))
        b = list(a)
        for _ in range(random.randrange(5)):
            kind, at = random.randrange(3), random.randrange(len(b) + 1)
            b[at : at + (kind > 0)] = [random.choice("abé😀")] if kind < 2 else []
        pairs.append((a, "".join(b)))
    pairs += [("", ""), ("", "a"), ("a", ""), ("ab", "ba"), ("abc", "xbc"), ("abc", "abcde")]
    df = spark.createDataFrame(pairs, "a string, b string")

    def letters(c):
        return F.filter(F.split(c, ""), lambda x: x != "")

    for most in (1, 2, 3):
        got = df.select("a", "b", *[line_dedup.within(letters("a"), letters("b"), F.lit(t), most).alias(f"t{t}") for t in range(most + 1)]).collect()
        assert not [r for r in got for t in range(most + 1) if r[f"t{t}"] != (_edits(r.a, r.b) <= t)]


@pytest.mark.parametrize("per,most", [(10, 1), (6, 2), (5, 3)])
def test_lines_match_brute_force(spark, per, most):
    rng = random.Random(7)
    base = ["".join(rng.choices("abcd ", k=rng.randrange(6, 30))) for _ in range(30)]

    def vary(s):
        s = list(s)
        for _ in range(rng.randrange(4)):
            kind, at = rng.randrange(3), rng.randrange(len(s))
            s[at : at + (kind > 0)] = ["x"] if kind < 2 else []
        return "".join(s)

    rows = [(i, "\n".join(vary(rng.choice(base)) for _ in range(6))) for i in range(60)] + [(None, "\n\n  \n" + base[0]), (70, None), (71, ""), (72, "é" * 20 + "\n" + "é" * 21)]
    assert _got_lines(line_dedup.line_classes(docs(spark, rows), per=per, most=most)) == _line_classes(rows, per, most)


def test_no_lines(spark):
    assert line_dedup.line_classes(docs(spark, [])).count() == 0


def test_crowded_segments_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "PAIRED", 5)
    texts = [f"common beginning of a line {i:03d} and its common end" for i in range(0, 200, 7)] + [f"common beginning of a line {i:03d} and its common ends" for i in range(0, 200, 21)]
    rows = list(enumerate(texts + [f"common beginning of a line {i * 1111:06d} and its common end" for i in range(40)]))
    for most in (1, 2):
        assert _got_lines(line_dedup.line_classes(docs(spark, rows), most=most)) == _line_classes(rows, 24, most)


def test_a_very_long_line(spark):
    line = "".join(random.Random(2).choices("abcdefgh ", k=300_000))
    rows = [(1, line), (2, line[:1000] + "x" + line[1001:]), (3, line[:-1]), (4, line[::-1])]
    assert {(r.doc_id, r.first_id, r.kept) for r in line_dedup.line_classes(docs(spark, rows)).collect()} == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)}


def test_texts_without_repeated_lines(spark):
    rows = [(1, "a line that is long enough\nshort\n\nlast"), (2, "a line that is long enoughs\nshort\n\nown"), (3, None)]
    got = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(docs(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "\nown", 3: ""}


def test_every_document_names_all_its_dropped_lines(spark):
    rows = [(1, "a first passage of some length\nown one"), (2, "a second passage of some length"), (3, "own three\na first passage of some length\na second passage of some lengths"), (4, None), (5, ""), (6, " \n "), (None, "own one")]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.n_near, [tuple(d) for d in r.dropped]) for r in line_dedup.document_lines(docs(spark, rows)).collect()}
    none = (0, 0, 0, [])
    assert got == {1: (2, 0, 0, []), 2: (1, 0, 0, []), 3: (3, 2, 1, [(1, 1, 0, 2), (2, 2, 0, 1)]), 4: none, 5: none, 6: none, None: (1, 1, 0, [(0, 1, 1, 2)])}


def test_lines_of_null_and_equal_ids(spark, tmp_path):
    """Rows without an id, and rows with one id, are documents of their own: no line is lost, and none is kept twice."""
    rows = [(1, "first line\nsecond line"), (None, "own a\nsecond line"), (None, "own b\nonly here"), (None, "own a\nonly here"), (7, "x\ny"), (7, "x\ny"), (7, "y\nz"), (2**63 - 1, "own a\nlast"), (-5, "z\nminus")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = Counter(line for r in line_dedup.without_repeated_lines(table).collect() for line in r.text.split("\n") if line)
    assert kept == Counter({line: 1 for _, t in rows for line in t.split("\n")})
    lines = line_dedup.line_classes(table).collect()
    assert len({(r.row, r.line_no) for r in lines}) == len(lines) == 18 and sum(r.kept for r in lines) == len(kept)
    first = {(r.doc_id, r.line_no): (r.first_id, r.first_line) for r in lines}
    assert first[2**63 - 1, 0] == (2**63 - 1, 0) and first[7, 0] in ((7, 0), (7, 1)) and first[-5, 0] == (-5, 0) and first[1, 1] == (1, 1)
    assert {(r.first_id, r.first_line) for r in lines if r.doc_id is None and r.kept} == {(None, 0), (None, 1)}
    got = line_dedup.op5_segment_lines(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and sum(r.n_lines for r in got) == 18 and sum(r.n_dropped for r in got) == 18 - len(kept)
    assert sorted(r.n_dropped for r in got if r.doc_id == 7) == [0, 2, 2]


def test_the_query_of_lines_has_a_row_per_document(spark, tmp_path):
    spark.createDataFrame([(1, "one"), (2, None), (3, "one\none")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, [d.line_no for d in r.dropped]) for r in line_dedup.op5_segment_lines(spark, str(tmp_path)).collect()}
    assert got == {1: (1, []), 2: (0, []), 3: (2, [0, 1])}


def test_the_keys_of_lines_are_compiled(spark):
    """The JVM only interprets methods of over 8,000 bytes, such as one that holds all keys with their arithmetic (23,474)."""
    table = docs(spark, [(1, "a line of some length, with an end\nshort")])
    lines = line_dedup._lines(table, line_dedup.Places.of(table, "text"), "doc_id", "text")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan holds its code before it runs
    try:
        plan = line_dedup._classes(lines, 24, 2)._jdf.queryExecution().executedPlan()
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        code = debug.codegenStringSeq(plan)
        sizes = [code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sizes and 0 < max(sizes) < 8000
