"""Count automata against counters, and the phrases against brute force."""

from __future__ import annotations

import random
import re
import string
from collections import Counter, defaultdict

import duckdb
import pytest

from meterlark.llm import collocations
from meterlark.llm.collocations import Counts

SCHEMA = "doc_id long, text string, lang string, phrase string, n long, word string"


def brute(rows, least=10, cover=50, top=2000):
    f, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        longer = defaultdict(int)
        for p, a in counts.items():
            if len(p) == 3 and a >= least:
                for part in (p[:2], p[1:]):
                    longer[part] = max(longer[part], a)
        found = []
        for p, a in counts.items():
            if len(p) > 1 and a >= least and not (len(p) == 2 and 100 * longer[p] >= cover * a):
                cuts = [(10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
                s, k = min(cuts)
                found.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def texts(n, seed=0):
    r = random.Random(seed)
    vocabulary = ["der", "Die", "und", "new", "york", "city", "größe", "the", "en", "fr", "\x00", "<|x|>", "a" * 300]
    out = []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randrange(40))]
        words += ["New", "York", "Times"] * r.randrange(3) + ["rare" + str(r.randrange(1000))]
        out.append(("".join(w + r.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "!"]) for w in words), r.choice(["en", "fr", None, "und", "", "a b"])))
    return out


ODD = [(None, "en"), ("", None), (" \t\n.", "fr"), ("the the the the the the the the the the the the the", "de"), ("x y " * 50_000, "long")] + [("Hot pair", "en")] * 300


@pytest.fixture
def write(spark, tmp_path):
    def to(rows, partitions=4):
        rows = [(i, t, lang, "x", 1, "y") for i, (t, lang) in enumerate(rows)]
        spark.createDataFrame(rows, SCHEMA).repartition(partitions).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return to


@pytest.mark.parametrize("rows", [texts(300) + ODD, ODD[:3], []], ids=["odd", "no words", "empty"])
def test_query_against_brute_force(spark, write, rows):
    df = collocations.op12_count_automata(spark, write(rows))
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in df.collect()) == brute(rows)


def test_shards_heavy_words_and_few_bits(spark, write):
    """Many automata a task, ranges dealt by the second word, and bitmaps that pass nearly all."""
    rows = texts(120, 1)
    found = collocations.phrases(spark.read.parquet(write(rows) + "/documents.parquet"), least=3, cover=60, held=500, size=8, parts=50, bits=8)
    got = {(r.lang, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found.collect()}
    assert got == {(lang, phrase, *rest) for lang, _, phrase, *rest in brute(rows, 3, 60, 10**9)}


def test_sql_on_odd_rows(spark, write):
    rows = [r for r in texts(200, 2) + ODD if len(r[0] or "") < 50_000 and "\x00" not in (r[0] or "")]
    folder = write(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    assert sorted(con.execute(collocations.OP12_SQL).fetchall()) == brute(rows)


def test_last_place_of_equal_scores_is_by_bytes(spark, write):
    rows = [(f"{w} pair", "en") for w in ("ä", "z", "Z", "a", "é") for _ in range(10)]
    assert [r.phrase for r in collocations.op12_count_automata(spark, write(rows)).orderBy("rank").collect()] == [p for _, _, p, *_ in brute(rows)]


def random_counts(seed):
    r = random.Random(seed)
    words = [bytes([r.randrange(256)]) * r.randrange(1, 4) for _ in range(30)]
    return Counter({tuple(r.choice(words) for _ in range(r.randrange(1, 5))): r.randrange(1, 1 << 50) for _ in range(r.randrange(200))})


def automaton(counts):
    return Counts.build(*collocations._numbered(counts))


@pytest.mark.parametrize("seed", range(20))
def test_automata_count_as_counters_do(seed):
    a, b, c = (random_counts(3 * seed + i) for i in range(3))
    made = automaton(a)
    assert dict(made.items()) == dict(a) and list(made.items()) == sorted(a.items())
    assert dict(Counts.load(made.dump()).items()) == dict(a)
    whole = Counts.union([made, automaton(b), automaton(c)])
    assert dict(whole.items()) == dict(a + b + c)
    ask = Counter(dict.fromkeys([*list(a)[:50], *random_counts(seed + 1000)], 1))
    asked = automaton(ask)
    assert [(s, w) for (s, _), w in zip(asked.items(), asked.compose(whole).tolist(), strict=True)] == [(s, (a + b + c)[s]) for s in sorted(ask)]
    assert dict(Counts.union([made, automaton(b), automaton(c)], 1 << 49).items()) == {k: v for k, v in (a + b + c).items() if v >= 1 << 49}


def test_states_are_shared():
    made = automaton(Counter({(x, b"same", y): 7 for x in (b"a", b"b", b"c") for y in (b"u", b"v")}))
    # A start, one state after the first label, one after the second, one end.
    assert len(made.first) - 1 == 4 and len(made.label) == 3 + 1 + 2
    assert dict(automaton(Counter()).items()) == {} and automaton(Counter()).compose(made).tolist() == []
