"""Sharding and mixing."""

from collections import Counter, defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from brookcal.llm import mixing, sharding


def test_every_row_has_one_slot_and_shards_are_even(odd, documents):
    for docs, shards in ((odd, 4), (documents, 40)):
        rows = sharding.shard_rows(docs, shards, vnodes=16).collect()
        given = docs.select("doc_id", "text").collect()
        want = Counter((d, len((t or "").encode()) + 16, crc32((t or "").encode())) for d, t in given)
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
        slots = defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
        sizes = [len(slots[s]) for s in range(shards)]
        assert max(sizes) - min(sizes) <= 1
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_shards_are_those_of_the_sequential_ring(spark, documents):
    """Rows one by one in ring order: the first shard clockwise with room."""
    points, owners = sharding.ring(7, 8)
    rows = documents.select("doc_id", F.xxhash64("doc_id", "text").alias("at")).collect()
    room = sharding.capacities(len(rows), 7)
    want = {}
    arc = lambda r: int((points < r["at"]).sum()) % len(points)
    for r in sorted(rows, key=lambda r: (arc(r), r["at"])):
        k = arc(r)
        while not room[owners[k % len(owners)]]:
            k += 1
        want[r["doc_id"]] = owners[k % len(owners)]
        room[want[r["doc_id"]]] -= 1
    got = {r["doc_id"]: r["shard"] for r in sharding.shard_rows(documents, 7, vnodes=8).collect()}
    assert got == want


def test_ring_moves_little_with_headroom():
    counts = {a: 5 for a in range(20 * 64)}

    def owner(shards):
        _, owners = sharding.ring(shards, 64)
        points, _ = sharding.ring(shards, 64)
        keys = [(i * 0x9E3779B97F4A7C15) % 2**64 - 2**63 for i in range(6_000)]
        arcs = Counter(int((points < k).sum()) % len(points) for k in keys)
        cuts = sharding.walk(dict(arcs), owners, sharding.capacities(len(keys), shards, 1.5))
        placed = defaultdict(list)
        for a, first, stop, s, _ in sorted(cuts):
            placed[a] += [s] * (stop - first)
        out = {}
        for k in sorted(keys):
            out[k] = placed[int((points < k).sum()) % len(points)].pop(0)
        return out

    a, b = owner(20), owner(21)
    moved = sum(a[k] != b[k] for k in a) / len(a)
    assert counts and moved < 0.12  # one in 21 has to


def test_a_row_that_occurs_very_often(spark):
    docs = spark.range(10_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    rows = sharding.shard_rows(docs, 3, vnodes=4).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("k")).collect()
    assert sorted(r["n"] for r in rows) == [3333, 3333, 3334] and all(r["n"] == r["k"] for r in rows)


def test_no_rows(none):
    assert sharding.shard_rows(none, 4).count() == 0
    assert mixing.plan_mix(none).count() == 0
    assert mixing.mix(none).count() == 0


def reference_targets(sizes, weights, most=3.0):
    """Target by bisection of the common share per weight."""
    total, low, high = sum(sizes.values()), 0.0, 1e12
    for _ in range(400):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(most * sizes[s], mid * weights[s]) for s in sizes) < total else (low, mid)
    return {s: min(most * sizes[s], low * weights[s]) for s in sizes}


def test_mix_meets_targets(odd, documents):
    for docs in (odd, documents):
        rows = mixing.plan_mix(docs, rows_per_bucket=7).collect()
        again = mixing.plan_mix(docs.repartition(3)).collect()
        key = lambda r: (r["doc_id"] is None, r["doc_id"], r["size"], r["taken"])
        assert sorted(map(key, rows)) == sorted(map(key, again))
        words = Counter()
        for s, t in docs.select("source", "text").collect():
            words[s] += len((t or "").encode().split())
        order = sorted((s for s in words if s is not None)) + [None] * (None in words)
        want = reference_targets(words, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
        taken, most = Counter(), Counter()
        for r in rows:
            assert r["source_size"] == words[r["source"]]
            assert r["target"] == pytest.approx(want[r["source"]], abs=1e-6)
            assert r["taken"] == r["size"] * len(r["positions"]) <= 3 * r["size"]
            assert all(0 <= p <= 1 for p in r["positions"]) and r["positions"] == sorted(r["positions"])
            taken[r["source"]] += r["taken"]
            most[r["source"]] = max(most[r["source"]], r["size"])
        assert all(abs(taken[s] - want[s]) <= most[s] / 2 + 1 for s in words)


def test_positions_invert_the_schedule(documents):
    """A source whose weight falls is used up earlier: words before any time follow the integral of its weight."""
    rows = mixing.plan_mix(documents).where("source is not null").collect()
    by_source = defaultdict(list)
    for r in rows:
        by_source[r["source"]] += [(p, r["size"], r["target"]) for p in r["positions"]]
    plans = mixing.repeating_schedules(list(by_source))
    for s, own in by_source.items():
        (a, b), target = plans[s].weights, own[0][2]
        for t in (0.25, 0.5, 0.75):
            want = target * (a * t + (b - a) * t * t / 2) / ((a + b) / 2)
            assert abs(sum(n for p, n, _ in own if p < t) - want) <= max(n for _, n, _ in own) + 1


def test_mix_repeats_and_sorts(documents):
    planned = mixing.plan_mix(documents).select("doc_id", F.size("positions").alias("n")).collect()
    mixed = mixing.mix(documents)
    assert mixed.columns == documents.columns
    assert Counter(r["doc_id"] for r in mixed.select("doc_id").collect()) == Counter({r["doc_id"]: r["n"] for r in planned if r["n"]})


def test_schedules_are_checked():
    with pytest.raises(ValueError):
        mixing.Schedule((0.0, 0.5), (1.0, 1.0))
    with pytest.raises(ValueError):
        mixing.Schedule((0.0, 1.0), (1.0, -1.0))


def test_documents_of_the_mix_have_places_in_it(odd, documents, none):
    assert mixing.mixed_documents(none).count() == 0
    for docs in (odd, documents):
        key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"])
        rows = mixing.mixed_documents(docs).collect()
        assert sorted(map(key, rows)) == sorted(map(key, mixing.plan_mix(docs).collect()))
        assert all(len(r["places"]) == len(r["positions"]) and r["places"] == sorted(r["places"]) for r in rows)
        order = sorted((place, r["doc_id"], position) for r in rows for place, position in zip(r["places"], r["positions"]))
        assert [o[0] for o in order] == list(range(len(order)))
        assert [o[2] for o in order] == sorted(o[2] for o in order)
    assert [o[1] for o in order] == [r["doc_id"] for r in mixing.mix(documents).collect()]
