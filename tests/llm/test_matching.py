"""Near duplicates, contamination, repeats and nearest vectors against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from brookcal.llm import decontamination, kdtree, queries, repeats, simhash


def brute_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_components(prints, distance):
    """Smallest index linked with each, by search."""
    label, at = {}, 0
    for i in range(len(prints)):
        if i in label:
            continue
        todo = [i]
        while todo:
            k = todo.pop()
            if k in label:
                continue
            label[k] = i
            todo += [m for m in range(len(prints)) if m not in label and (prints[k] ^ prints[m]).bit_count() <= distance]
        at += 1
    return label


def test_fingerprints_and_components(odd, documents):
    for docs in (odd, documents):
        rows = docs.select("doc_id", "text").collect()
        prints = [brute_fingerprint(t) for _, t in rows]
        label = brute_components(prints, 4)
        least = {}
        for i, (d, _) in enumerate(rows):
            if d is not None:
                least[label[i]] = min(d, least.get(label[i], d))
        want = Counter((d, f"{p:016x}", least.get(label[i])) for i, ((d, _), p) in enumerate(zip(rows, prints)))
        got = simhash.near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")), "component_id").collect()
        assert Counter(tuple(r) for r in got) == want


def test_every_distance_links_what_it_should(spark):
    rng = random.Random(4)
    prints = [rng.getrandbits(64) for _ in range(30)]
    for p in prints[:20]:
        for d in range(1, 8):
            q = p
            for b in rng.sample(range(64), d):
                q ^= 1 << b
            prints.append(q)
    prints = sorted(set(prints))
    rows = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "fingerprint long")
    for distance in (0, 3, 4):
        links = simhash.component_roots(simhash.fingerprint_links(rows, distance)).collect()
        group = {r["node"] % 2**64: r["root"] % 2**64 for r in links}
        label = brute_components(prints, distance)
        got, want = defaultdict(set), defaultdict(set)
        for i, p in enumerate(prints):
            got[group.get(p, p)].add(p)
            want[label[i]].add(p)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_long_chains_are_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(1000, 1001)], "a long, b long")
    roots = {r["node"]: r["root"] for r in simhash.component_roots(links).collect()}
    assert roots == {**dict.fromkeys(range(61), 0), 1000: 1000, 1001: 1000}


def test_one_of_each_group_stays(odd, none):
    kept = simhash.keep_first(odd).collect()
    found = simhash.near_duplicates(odd).select("root").distinct().count()
    assert len(kept) == found and kept[0].asDict().keys() == dict.fromkeys(odd.columns).keys()
    ids = [r["doc_id"] for r in kept]
    assert 1 in ids and 2 not in ids and ids.count(7) == 1
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_first(none).count() == 0


def test_a_fingerprint_reaches_few_slices():
    assert len(simhash._reach(2, 8)) == 37
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 2**63, 50, dtype=np.uint64)
    masks, columns = simhash._ball(2)[0], simhash._group_columns(8)
    slices = simhash._syndromes((prints[:, None] ^ masks[None, :]).ravel(), columns).reshape(50, -1)
    reached = simhash._syndromes(prints, columns)[:, None] ^ simhash._reach(2, 8)[None, :]
    assert all(set(a) == set(b) for a, b in zip(slices.tolist(), reached.tolist()))


def test_values_reach_the_rows_of_hot_and_plain_keys(spark):
    counts = {0: 500, 1: 40, **{k: 1 for k in range(2, 300)}}
    rows = spark.createDataFrame([(k,) for k, n in counts.items() for _ in range(n)], "key long")
    values = spark.createDataFrame([(k, n, k * 7) for k, n in counts.items()], "key long, n long, value long")
    got = Counter((r["key"], r["value"]) for r in simhash._with_values(rows, values, "key").collect())
    assert got == Counter({(k, k * 7): n for k, n in counts.items()})


def test_rows_that_differ_elsewhere_leave_one_whatever_the_partitions(spark):
    rows = [(1, "one and the same text of six words", c) for c in "abcdefgh"] + [(2, "something else", "z"), (2, "something else", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = [sorted(map(tuple, simhash.keep_first(docs.repartition(n, "source")).collect())) for n in (1, 5)]
    assert kept[0] == kept[1] and [r[0] for r in kept[0]] == [1, 2]


def brute_contamination(text, items, window=10):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    words, hit, found = re.findall(pattern, low(text)), set(), set()
    for item, t in items:
        own = re.findall(pattern, low(t))
        k = min(window, len(own))
        grams = {tuple(own[i:i + k]) for i in range(len(own) - k + 1)} if k else set()
        for i in range(len(words) - k + 1):
            if k and tuple(words[i:i + k]) in grams:
                hit |= set(range(i, i + k))
                found.add(item)
    return len(words), len(hit), found


def test_contamination(spark, odd, none):
    rng = random.Random(3)
    alphabet = "a b c d".split()
    texts = [" ".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    items = [(i, " ".join(rng.choice(alphabet) for _ in range(rng.choice([0, 3, 4, 6, 9, 10, 11, 30])))) for i in range(25)]
    items += [(100, "TWO three, four five six seven eight nine ten eleven"), (101, "Seven EIGHT nine"), (102, None), (103, "--"), (104, "été naïve")]
    table = spark.createDataFrame(items + items[:3], "item_id long, text string")
    for window, block in ((10, 200_000), (5, 40), (4, 1)):
        got = decontamination.find_contamination(docs, table, window, block, keep=("text",)).collect()
        assert len(got) == docs.count()
        for r in got:
            n, hits, found = brute_contamination(r["d_row"]["text"], items, window)
            assert (r["d_words"], sum(b - a for a, b in r["d_hits"]), set(r["d_items"])) == (n, hits, found)
    empty = decontamination.find_contamination(docs, table.limit(0)).collect()
    assert all(not r["d_hits"] for r in empty) and max(r["d_words"] for r in empty) == 3000
    assert decontamination.find_contamination(none, table).count() == 0


def test_spans_are_removed(spark, odd):
    items = spark.createDataFrame([(1, "three four five six seven eight nine ten"), (2, "cat sat on the mat it was a long and quiet day")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.decontaminate(odd, items, max_coverage=0.7).collect()}
    assert got[11]["text"] == "x one two  y Seven eight nine" and got[11]["n_chars"] == len(got[11]["text"])
    assert got[1]["text"] == "The , and nothing else happened here at all."
    assert got[8]["text"] == "word " * 3000 and got[5]["text"] == "" and got[4]["text"] is None
    dropped = decontamination.decontaminate(odd, items, max_coverage=0.5)
    assert dropped.columns == odd.columns
    assert {1, 10, 11}.isdisjoint({r["doc_id"] for r in dropped.select("doc_id").collect()})


def brute_repeats(rows, min_words):
    """Removed spans of each distinct (id, text), the earliest unit kept."""
    docs = sorted({(d is None, d, xxhash.xxh64_intdigest((t or "").encode(), 42), t) for d, t in rows if t is not None},
                  key=lambda x: (x[0], x[1] or 0, x[2] - 2**64 if x[2] >= 2**63 else x[2]))
    seen, out = set(), {}
    for _, d, _, t in docs:
        runs, last = [], False
        for a, b, n, digest in repeats.units_of(t):
            again = digest in seen
            seen.add(digest)
            if again and last:
                runs[-1] = (runs[-1][0], b, runs[-1][2] + n)
            elif again:
                runs.append((a, b, n))
            last = again
        out[d, t] = [[a, b] for a, b, n in runs if n >= min_words]
    return out


def test_repeats(odd, none, documents):
    for docs, least in ((odd, 3), (documents, 10), (documents, 1)):
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        want = brute_repeats(rows, least)
        got = repeats.remove_repeats(docs.select("doc_id", F.col("text").alias("text"), F.col("text").alias("original")), min_words=least).collect()
        assert len(got) == len(rows)
        for r in got:
            spans = want.get((r["doc_id"], r["original"]), [])
            assert r["removed_spans"] == spans
            if r["original"] is not None:
                edges = [0, *[x for s in spans for x in s], len(r["original"])]
                assert r["text"] == "".join(r["original"][a:b] for a, b in zip(edges[::2], edges[1::2]))
    assert repeats.repeated_spans(none).count() == 0


def test_units_keep_offsets():
    text = "One. Two! three\nFOUR  five.\n\n six"
    assert [text[a:b] for a, b, _, _ in repeats.units_of(text)] == ["One.", " Two!", " three\n", "FOUR  five.", " six"] or \
        "".join(text[a:b] for a, b, _, _ in repeats.units_of(text)).split() == text.split()
    assert [n for *_, n, _ in repeats.units_of("a b\n\nc d e", "paragraph")] == [2, 3]


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), rng.integers(-3, 4, 5).astype(float).tolist() if i % 7 else rng.normal(size=5).tolist()) for i in range(900)]
    rows += [(None, [1.0] * 5), (901, None), (902, [1.0, None, 0.0, 0.0, 0.0]), (903, [float("nan")] * 5), (904, [float("inf")] * 5), (905, []), (906, [2.0]), (17, rows[17][1])]
    vectors = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    old = kdtree.SHARD_ROWS, kdtree.BLOCK_QUERIES, kdtree.LEAF
    kdtree.SHARD_ROWS, kdtree.BLOCK_QUERIES = 100, 7
    try:
        got = kdtree.top_k(vectors, k=4, every=50).collect()
    finally:
        kdtree.SHARD_ROWS, kdtree.BLOCK_QUERIES, kdtree.LEAF = old
    good = [(i, np.floor(1024 * np.array((v + [0] * 5)[:5]))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, qv in good:
        if q % 50:
            continue
        best = sorted(((-int(qv @ v), i) for i, v in good if i != q))[:4]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert mine == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert kdtree.top_k(vectors.limit(0)).count() == 0


def test_products_beyond_doubles(spark):
    """Scores near 2^60 that differ by less than a double can tell."""
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(2 ** 19 + int(x)) + 1 / 1024 for x in rng.integers(0, 4, 3)]) for i in range(400)]
    got = kdtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).collect()
    whole = {i: [int(1024 * x) for x in v] for i, v in rows}
    for q in range(0, 400, 100):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    with pytest.raises(ValueError):
        kdtree.top_k(spark.createDataFrame([(0, [1e13])], "vec_id long, embedding array<double>"))


def test_few_vectors(spark):
    vectors = spark.createDataFrame([(0, [1.0]), (100, [2.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in kdtree.top_k(vectors).collect()) == [(0, 1, 100, 2 * 1024 * 1024), (100, 1, 0, 2 * 1024 * 1024)]


def test_item_digest(spark):
    got = queries.op10_decontamination(spark, "/root/testdata/sf0.001").where("contaminated").first()
    assert got is None or re.fullmatch("[0-9a-f]{64}", got["items_sha256"])
    assert hashlib.sha256(b"").hexdigest() in {r["items_sha256"] for r in queries.op10_decontamination(spark, "/root/testdata/sf0.001").collect()}
