"""The Merkle manifest against a plain tree, on odd rows and with blocks of few leaves."""

from __future__ import annotations

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from meterlark.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, pos string, digest string"
ODD = [
    (None, "no id", "en", "a", 5, 1, "x", "y"), (None, "no id", "en", "a", 5, 1, "x", "y"), (3, None, None, None, None, 1, "x", "y"), (4, "", "", "", 0, 1, "x", "y"), (7, "é:1", "zé", "b", 3, 1, "x", "y"),
    (7, "other", "zé", "b", 5, 1, "x", "y"), (8, "x" * 100_000, "zé", "b", 9_223_372_036_854_775_807, 1, "x", "y"), (12, "alone", "Z", "c", 5, 1, "x", "y"),
] + [(i, f"text {i % 5}", "en", f"s{i % 3}", None if i % 11 == 0 else i, 1, "x", "y") for i in range(100, 137)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, more=0):
    doc_id, text, lang, source, n_chars = row[:5]
    values = (doc_id, source, lang, None if n_chars is None else n_chars + more, text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, at):
    """(root, siblings with sides) of one leaf by the plain tree."""
    path = []
    while len(nodes) > 1:
        run = nodes[at // 2 * 2 : at // 2 * 2 + 2]
        path.append((at % 2, run[1 - at % 2] if len(run) > 1 else None))
        nodes, at = [sha("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)], at // 2
    return nodes[0], path


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for k in langs:
        groups[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    subroots = [climb([leaf(r) for r in groups[k]], 0)[0] for k in langs]
    out = []
    for i, k in enumerate(langs):
        for j, r in enumerate(groups[k]):
            root, above = climb(subroots, i)
            path = climb([leaf(x) for x in groups[k]], j)[1] + above
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = leaf(r, 1) if hit else leaf(r)
            for right, other in path:
                folded = sha(folded if other is None else other + folded if right else folded + other)
            proof = sha("".join(other for _, other in path if other))
            out.append((r[0], leaf(r), subroots[i], root, proof, folded, folded == root, len(path), hit and r[4] is not None))
    return out


def got(df):
    return sorted((tuple(r)[:9] for r in df.collect()), key=str)


@pytest.fixture
def write(spark, tmp_path):
    def to(rows, partitions=5):
        spark.createDataFrame(rows, SCHEMA).repartition(partitions).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return to


@pytest.mark.parametrize("bits", [1, 2, 3, 10])
@pytest.mark.parametrize("rows", [ODD, ODD[-9:], ODD[-1:], ODD[2:5]], ids=["odd", "nine", "one", "single leaves"])
def test_blocks_make_the_plain_tree(spark, write, monkeypatch, bits, rows):
    if bits != 2 and rows is not ODD:
        pytest.skip("once is enough")
    build = merkle.manifest
    monkeypatch.setattr(merkle, "manifest", lambda leaves, order: build(leaves, order, bits))
    assert got(merkle.op11_path_copying(spark, write(rows))) == sorted(plain(rows), key=str)


def test_empty_table(spark, write):
    assert merkle.op11_path_copying(spark, write([])).collect() == []


def test_sql_on_odd_rows(spark, write):
    folder = write([r for r in ODD if r[4] != 9_223_372_036_854_775_807])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    df = merkle.op11_path_copying(spark, folder)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({merkle.OP11_SQL})").fetchall()
    assert sorted((tuple(r) for r in df.collect()), key=str) == sorted(want, key=str)


def test_versions_share_all_but_the_path(spark):
    leaves = spark.range(37).select("id", F.lit("=en").alias("tree"), F.sha2(F.col("id").cast("string"), 256).alias("digest"), F.when(F.col("id") == 20, F.sha2(F.lit("new"), 256)).alias("changed"))
    rows = {r.id: r for r in merkle.manifest(leaves.withColumn("more", F.col("id") * 2), "id", bits=2, carry=("more",)).collect()}
    levels = list(merkle.walk([rows[i].digest for i in range(37)]))
    changed = list(merkle.walk([sha("new") if i == 20 else rows[i].digest for i in range(37)]))
    assert rows[20].more == 40 and rows[19].copied is None and rows[19].folded == rows[19].root == levels[-1][0]
    assert rows[20].copied == [level[20 >> (k + 1)] for k, level in enumerate(changed[1:])] and rows[20].folded == changed[-1][0]
    # A version's other nodes are the first version's.
    assert all(sum(x != y for x, y in zip(a, b, strict=True)) == 1 for a, b in zip(levels, changed, strict=True))


def test_places_in_a_large_tree(spark):
    rows = spark.range(5000).select("id", F.lit("=en").alias("tree"), F.sha2(F.col("id").cast("string"), 256).alias("digest"), F.lit(None).cast("string").alias("changed"))
    places = merkle.numbered(rows, "tree", ["id", "digest"])
    assert {r.id: r.pos for r in places.collect()} == {i: i for i in range(5000)} and places.select("size").distinct().first()[0] == 5000
    assert merkle.manifest(rows, "id", bits=6).where("folded = root").count() == 5000
