"""Phrase mining against plain counting in Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from brookcal.llm import collocations, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, longest):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i: i + m])] += 1
    return f, n


def mined(rows, least, longest, cover, top):
    f, n = counted(rows, longest)
    wanted = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = set()
    for (lang, p), a in wanted.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                short = (lang, p[i: i + m])
                if 100 * a >= cover * wanted[short]:
                    inside.add(short)
    out = {}
    for (lang, p), a in wanted.items():
        if (lang, p) not in inside:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted(
        (lang, i + 1, p.decode(), -a, left, right, n[lang], -s)
        for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def texts(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "text string, lang string, phrase string, n int")


@pytest.mark.parametrize("least,longest,cover,most,burst", [(2, 5, 100, 10**6, 8_192), (2, 4, 60, 30, 8), (3, 2, 100, 30, 40), (1, 3, 100, 500, 32)])
def test_against_plain_counts(spark, least, longest, cover, most, burst):
    rng = random.Random(7)
    words = ["the", "of", "The", "É", "é", "x\x0by", "日本", "a", "b" * 300, "\x00", "-", "'s"]
    def text():
        return "".join(rng.choice(words[: rng.randint(2, 12)]) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n"]) for _ in range(rng.randint(0, 40)))
    rows = [(text(), rng.choice(["en", "en", "en", "fr", None, "und", ""])) for _ in range(150)]
    rows += [("the of the of the of the", "en")] * 30 + [(None, "en"), ("", None), (" . ", "fr"), ("one", "xx")]
    got = rows_of(collocations.collocations(texts(spark, rows).repartition(4), least, longest, cover, 2_000, most=most, burst=burst))
    assert got == mined(rows, least, longest, cover, 2_000)


def test_top_and_many_occurrences(spark):
    rows = [("a b c d e f. b c", "en")] * 150 + [("q r s", "fr")] * 99
    assert rows_of(collocations.collocations(texts(spark, rows), top=2)) == mined(rows, 100, 5, 100, 2)


def test_odd_rows_and_none(spark, odd, none):
    rows = [(r["text"], r["lang"]) for r in odd.collect()]
    assert rows_of(collocations.collocations(odd, 2)) == mined(rows, 2, 5, 100, 2_000)
    assert collocations.collocations(none).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["text"], r["lang"]) for r in queries.table(spark, d, "documents").collect()]
    got = queries.op13_collocations(spark, d)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert rows_of(got) == mined(rows, 100, 5, 100, 2_000)


def test_trie_keeps_counts_through_bursts_and_spills():
    rng = np.random.default_rng(1)
    trie, want, got = collocations.Node(3, 16), Counter(), Counter()
    for _ in range(60):
        ids = np.minimum(rng.zipf(1.4, (80, 3)), 500)
        rows, counts = collocations._distinct(list(ids.T.astype(np.int64)))
        trie.add(rows, counts)
        want.update(map(tuple, ids.tolist()))
        if trie.size() > 1_500:
            for found, n in trie.spill(700):
                got.update({tuple(r): 0 for r in found.tolist()})
                for r, k in zip(found.tolist(), n.tolist()):
                    got[tuple(r)] += k
            assert trie.size() <= 700
    assert len(trie.children)
    for found, n in trie.spill(0):
        for r, k in zip(found.tolist(), n.tolist()):
            got[tuple(r)] += k
    assert got == want and trie.size() == 0


def test_strength_is_exact_beyond_64_bits(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(300):
        n = rng.randint(10**6, 10**16)
        left, right = rng.randint(100, n), rng.randint(100, n)
        a = rng.randint(100, min(left, right))
        rows.append((a, n, left, right))
    # quotients that lie just below and just at a whole number
    rows += [(100, 10**16 + d, 10**9, 10**9 + e) for d in (-1, 0, 1) for e in (0, 1)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long").withColumn("score", collocations.strength("a", "n", "l", "r"))
    assert dict(df.dtypes)["score"] == "bigint"
    assert all(x["score"] == 1000 * x["a"] * x["n"] // (x["l"] * x["r"]) for x in df.collect())
