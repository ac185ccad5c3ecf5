"""SimHash near duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most ``k`` bits apart share a word of the Hamming space that is within half of ``k`` of both. So every
distinct fingerprint emits all its variants within that radius, variants are shuffled, and fingerprints that meet are linked.

Variants are not shuffled one by one. The space is cut into the cosets of a linear code: a variant's slice is the syndrome of
its bits, so a slice's owner can tell from a fingerprint which of its variants lie in the slice. The syndrome holds the parity
of each group of positions, so flipping two bits moves a variant to a slice at most two bits off: of 256 slices a fingerprint
reaches 37. It is sent to these, eight bytes each, and expands there, one bounded part of the slice at a time.

All members of one variant are linked to the smallest one that came within the smaller radius: a star, never all pairs. By
the triangle inequality every such link is within ``k`` bits, and every linked pair meets at some variant, so the components
are those of the full link graph. Links are still verified. Components are found on distinct fingerprints, so copies of one
text weigh nothing.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookcal.session import cut_lineage

#: Fingerprints that one slice may receive before the space is cut into more slices; 8 bytes each.
SLICE_FINGERPRINTS = 8_000_000
#: Copies of fingerprints that are dealt to slices at a time.
DEALT = 500_000
#: A key is hot if it holds more than this part of all rows.
HOT_PART = 0.01
#: Variants expanded at a time.
EXPANDED = 1_000_000
LEAST_BITS = 8


def fingerprint_of(text: str | None, shingle: int) -> int:
    """A bit is 1 if more than half of the shingles' hashes have it; no words: zero."""
    words = text.encode("utf-8").lower().split() if text else []  # on bytes, only A-Z and ASCII white space count
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    n = max(1, len(words) - shingle + 1)
    starts = [0, *ends[: n - 1]]
    stops = ends[shingle - 1:] if len(words) >= shingle else [ends[-1]]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65_536):
        some = np.array([digest(line[a:b - 1], 42) for a, b in zip(starts[at: at + 65_536], stops[at: at + 65_536])], dtype="<u8")
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(ones * 2 > n).tolist()))


def fingerprints(
    docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text", digest: Column | None = None,
) -> DataFrame:
    """``doc_id, digest, fingerprint`` (signed 64-bit) per row; ``digest`` is a hash of the text unless another is given.

    Other columns are ignored.
    """
    digest = F.xxhash64(text_col) if digest is None else digest
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), digest.alias("digest"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint_of(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(np.array(prints, dtype=np.uint64).view(np.int64))],
                names=["doc_id", "digest", "fingerprint"],
            )

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {id_type}, digest long, fingerprint long")


def _group_columns(bits: int) -> np.ndarray:
    """Syndromes of the 64 single bits by which slices are cut: position ``i`` counts for the parity of group ``i % bits``."""
    return 1 << (np.arange(64) % bits)


def _reach(radius: int, bits: int) -> np.ndarray:
    """Differences between a fingerprint's own slice and those that hold variants of it."""
    return np.unique(_syndromes(_ball(radius)[0], _group_columns(bits)))


def _syndrome_columns(bits: int) -> np.ndarray:
    """Fixed pseudo-random syndromes of the 64 single bits, distinct and not zero."""
    seen: list[int] = []
    for i in itertools.count():
        c = xxhash.xxh64_intdigest(i.to_bytes(4, "little"), 7) & ((1 << bits) - 1)
        if c and c not in seen:
            seen.append(c)
        if len(seen) == min(64, (1 << bits) - 1):
            return np.array((seen * 64)[:64], dtype=np.int64)


def _syndromes(prints: np.ndarray, columns: np.ndarray) -> np.ndarray:
    out = np.zeros(len(prints), dtype=np.int64)
    for i, c in enumerate(columns):
        out ^= np.where((prints >> np.uint64(i)) & np.uint64(1), c, 0)
    return out


def _ball(radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks of at most ``radius`` bits and their weights."""
    masks = [sum(1 << i for i in some) for w in range(radius + 1) for some in itertools.combinations(range(64), w)]
    return np.array(masks, dtype=np.uint64), np.array([bin(m).count("1") for m in masks])


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node of the component of each of ``n`` nodes under the links ``a``-``b``."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def _slice_links(prints: np.ndarray, distance: int, bits: int, slice_id: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (member, root) between fingerprints that meet at a variant of this slice."""
    prints = np.unique(prints)
    low, high = distance // 2, distance - distance // 2
    masks, weights = _ball(high)
    finer, variants_each = 0, len(masks) // len(_reach(high, bits)) + 1
    while len(prints) * variants_each >> finer > EXPANDED and finer < 20:
        finer += 1
    columns = _group_columns(bits)
    more = _syndrome_columns(finer) if finer else np.zeros(64, dtype=np.int64)
    columns = columns | (more << bits)
    own, of_mask = _syndromes(prints, columns), _syndromes(masks, columns)
    by_mask: dict[int, np.ndarray] = {}
    order = np.argsort(of_mask, kind="stable")
    values, first = np.unique(of_mask[order], return_index=True)
    for v, some in zip(values.tolist(), np.split(order, first[1:])):
        by_mask[v] = some
    order = np.argsort(own, kind="stable")
    values, first = np.unique(own[order], return_index=True)
    groups = list(zip(values.tolist(), np.split(order, first[1:])))
    found_a, found_b = [], []
    for part in range(1 << finer):
        wanted = slice_id | (part << bits)
        variants, owners, near = [], [], []
        for v, members in groups:
            some = by_mask.get(v ^ wanted)
            if some is not None:
                variants.append((prints[members][:, None] ^ masks[some][None, :]).ravel())
                owners.append(np.repeat(members, len(some)))
                near.append(np.tile(weights[some] <= low, len(members)))
        if not variants:
            continue
        variant, owner, close = np.concatenate(variants), np.concatenate(owners), np.concatenate(near)
        order = np.argsort(variant)
        variant, owner, close = variant[order], owner[order], close[order]
        starts = np.flatnonzero(np.concatenate(([True], variant[1:] != variant[:-1])))
        sizes = np.diff(np.append(starts, len(variant)))
        shared = np.repeat(sizes > 1, sizes)
        if not shared.any():
            continue
        centre = np.minimum.reduceat(np.where(close, owner, len(prints)), starts)
        centre, owner = np.repeat(centre, sizes)[shared], owner[shared]
        linked = (centre < len(prints)) & (centre != owner)
        a, b = owner[linked], centre[linked]
        true = np.bitwise_count(prints[a] ^ prints[b]) <= distance
        found_a.append(a[true])
        found_b.append(b[true])
    if found_a:
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        touched, index = np.unique(np.concatenate((a, b)), return_inverse=True)
        root = _roots(index[: len(a)], index[len(a):], len(touched))
        member = np.flatnonzero(root != np.arange(len(touched)))
        yield prints[touched[member]], prints[touched[root[member]]]


def _lots(batches: Iterator[pa.RecordBatch], least: int = 10_000) -> Iterator[np.ndarray]:
    """Fingerprints in lots that do not depend on how the batches are cut, so that a slice gets few and full rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        n += batch.num_rows
        if n >= least:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


def fingerprint_links(distinct: DataFrame, distance: int) -> DataFrame:
    """Links ``a, b`` over the column ``fingerprint`` of distinct rows whose components are those of the distance graph."""
    count, high = distinct.count(), distance - distance // 2
    bits = LEAST_BITS
    while bits < 48 and count * len(_reach(high, bits)) >> bits > SLICE_FINGERPRINTS:
        bits += 1
    slices, columns, reach = 1 << bits, _group_columns(bits), _reach(high, bits)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, DEALT // len(reach))
        for prints in (lot[at: at + step] for lot in _lots(batches) for at in range(0, len(lot), step)):
            own = _syndromes(prints, columns)
            order = np.argsort(own, kind="stable")
            prints, (values, first) = prints[order], np.unique(own[order], return_index=True)
            where = (values[:, None] ^ reach[None, :]).ravel()
            group = np.repeat(np.arange(len(values)), len(reach))
            order = np.argsort(where, kind="stable")
            targets, begin = np.unique(where[order], return_index=True)
            parts = np.split(prints, first[1:])
            packed = [np.concatenate([parts[g] for g in some]).tobytes() for some in np.split(group[order], begin[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(targets), pa.array(packed, pa.binary())], names=["slice", "packed"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for s, arrived in itertools.groupby(rows, key=lambda row: row[0]):
            prints = np.frombuffer(b"".join(x for _, x in arrived), dtype=np.uint64)
            for a, b in _slice_links(prints, distance, bits, s):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    dealt = distinct.select("fingerprint").mapInArrow(deal, "slice long, packed binary")
    # a task takes its slices in turn and holds one of them
    tasks = min(slices, max(1 << LEAST_BITS, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return dealt.repartition(tasks, "slice").sortWithinPartitions("slice").mapInArrow(meet, "a long, b long").distinct()


def component_roots(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b``): the smallest node it is connected with.

    Large stars and small stars in turn: neighbours of a node move to the smallest of them. A round is written to the shared
    folder; the number of rounds grows with the logarithm of the longest chain. The smallest neighbours are written out before
    they are joined, so that the node in the middle of a huge star can be split over tasks.
    """
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        # large star: every larger neighbour of a node moves to the node's smallest neighbour
        both = edges.union(edges.select("b", "a"))
        least = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("m")))
        moved = both.where("b > a").join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = moved.where("a <> b").distinct()
        # small star: a node and its smaller neighbours move to the smallest of them
        least = large.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        joined = large.join(least, F.col("a") == F.col("node"))
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("node").alias("a"), F.col("m").alias("b")))
        new = cut_lineage(small.where("a <> b").distinct())
        before = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() == before:
            break
        edges = new
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _with_values(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """``rows`` next to the one row that ``values`` has for their ``key``; its column ``n`` counts the rows of the key.

    Rows of hot keys, fewer than ``1 / HOT_PART`` keys, meet a broadcast of those keys where they are; only the others are shuffled.
    """
    total = values.agg(F.sum("n")).first()[0] or 0
    hot, plain = values.where(F.col("n") > total * HOT_PART), values.where(F.col("n") <= total * HOT_PART)
    keys = [r[0] for r in hot.select(key).collect()]  # at most 1 / HOT_PART
    is_hot = F.col(key).isin(keys) if keys else F.lit(False)
    return rows.where(is_hot).join(F.broadcast(hot.drop("n")), key).unionByName(rows.where(~is_hot).join(plain.drop("n"), key))


def near_duplicates(
    docs: DataFrame, distance: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text", digest: Column | None = None,
) -> DataFrame:
    """``doc_id, digest, fingerprint, root, component_id`` for every row of ``docs``.

    ``root`` names the component by its smallest fingerprint, ``component_id`` is its smallest document id (NULL if the
    component has none). Texts without words, NULL included, share the fingerprint zero and are linked like any other; a
    text shorter than a shingle is one shingle. Repeated rows come back as often as they occur. No rows give no rows.
    """
    rows = cut_lineage(fingerprints(docs, shingle, id_col, text_col, digest))
    nodes = cut_lineage(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    roots = component_roots(fingerprint_links(nodes, distance))
    # fingerprints without links are components of their own
    nodes = cut_lineage(nodes.join(roots, F.col("fingerprint") == F.col("node"), "left").drop("node"))
    alone, linked = nodes.where("root IS NULL"), nodes.where("root IS NOT NULL")
    named = cut_lineage(linked.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n")))
    linked = _with_values(linked.withColumnRenamed("n", "copies"), named, "root")
    labels = alone.select("fingerprint", F.col("fingerprint").alias("root"), F.col("first_id").alias("component_id"), "n").unionByName(
        linked.select("fingerprint", "root", "component_id", F.col("copies").alias("n"))
    )
    return _with_values(rows, cut_lineage(labels), "fingerprint").select("doc_id", "digest", "fingerprint", "root", "component_id")


def keep_first(
    docs: DataFrame, distance: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row of ``docs`` per component: the one with the smallest id (NULL last), then the smallest hash of its columns."""
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    digest = F.xxhash64(text_col, *([F.to_json(F.struct(*rest))] if rest else []))
    found = near_duplicates(docs, distance, shingle, id_col, text_col, digest)
    equal = found.groupBy("root", "doc_id", "digest").agg(F.count("*").alias("n"))
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "digest", "n")
    firsts = equal.groupBy("root").agg(F.min(rank).alias("first"))
    firsts = cut_lineage(firsts.select(F.col("first.doc_id").alias("x_id"), F.col("first.digest").alias("x_digest"), "first.n"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("doc_id"), digest.alias("digest"))
    kept = rows.join(
        firsts, F.col("doc_id").eqNullSafe(F.col("x_id")) & (F.col("digest") == F.col("x_digest")), "left_semi",
    )
    if firsts.where("n > 1").limit(1).count():  # rows that are equal in all columns
        kept = kept.dropDuplicates(["doc_id", "digest"])
    return kept.select("row.*")
