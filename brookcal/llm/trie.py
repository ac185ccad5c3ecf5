"""Prefix trie of conversations, as balanced parentheses.

Conversations are ordered by the digests of their turns, so that one after another visits their trie in preorder. Ranges of that
order are shards, and a shard is encoded in blocks of bounded size: an opening parenthesis where a node begins, a closing one
where its subtree ends. Excess minima over blocks of 64 positions, minima of those, and so on, let ``find_close`` skip what cannot
hold the end of a subtree; the rank of ``()`` counts its leaves, and differences of cumulative arrays give members and savings.

A node is final unless it lies on the first or the last path of its block, where the neighbour may go on with it. These two spines
travel to the next level with what hangs off them summed up, and are merged there in the same way, until one block holds them
all. A level gets at most a quarter of the paths of the one before. Children of a spine learn the smallest member of their parent at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookcal.session import scratch_path

WIDTH = 16  # bytes of a turn's digest
BLOCK_NODES = 200_000
LEAST_PATHS = 8  # paths of a block, so that levels shrink
LEVEL_PATHS = 20_000  # paths of a level that one task merges
IDS_IN_CHUNK = 4_096
NONE = np.iinfo(np.int64).max
EMPTY = hashlib.sha256(b"").hexdigest()

OWN = ("members", "least", "children", "leaves", "saved")
OUT = (
    "kind string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, node binary, level int, part int, block int, side int, path binary, weights array<long>, ends array<string>, "
    + ", ".join(f"s_{c} array<long>" for c in OWN)
)


# balanced parentheses ------------------------------------------------------------


class Parentheses:
    """A sequence of +1 and -1 with excess minima over blocks, blocks of blocks, and so on."""

    FAN = 64

    def __init__(self, signs: np.ndarray):
        self.signs = signs
        self.levels = [np.cumsum(signs, dtype=np.int64)]
        while len(self.levels[-1]) > self.FAN:
            low = self.levels[-1]
            full = np.full(-(-len(low) // self.FAN) * self.FAN, NONE)
            full[: len(low)] = low
            self.levels.append(full.reshape(-1, self.FAN).min(axis=1))
        self.opens = np.nonzero(signs > 0)[0]
        leaf = (signs[:-1] > 0) & (signs[1:] < 0)
        self.leaves_before = np.concatenate([[0], np.cumsum(np.append(leaf, False))])

    def _first(self, level: int, after: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The first place behind ``after`` whose value is ``most`` or less; it must exist."""
        values, fan = self.levels[level], self.FAN
        out = np.full(len(after), -1)
        for lot in range(0, len(after), 20_000):
            at = slice(lot, lot + 20_000)
            out[at] = self._inside(values, after[at] // fan, after[at], most[at])
        left = np.nonzero(out < 0)[0]
        if len(left):
            block = self._first(level + 1, after[left] // fan, most[left])
            for lot in range(0, len(left), 20_000):
                at = slice(lot, lot + 20_000)
                out[left[at]] = self._inside(values, block[at], np.full(len(block[at]), -1), most[left[at]])
        return out

    def _inside(self, values: np.ndarray, block: np.ndarray, after: np.ndarray, most: np.ndarray) -> np.ndarray:
        places = block[:, None] * self.FAN + np.arange(self.FAN)
        low = values[np.minimum(places, len(values) - 1)]
        hit = (places < len(values)) & (places > after[:, None]) & (low <= most[:, None])
        first = hit.argmax(axis=1)
        return np.where(hit[np.arange(len(block)), first], places[np.arange(len(block)), first], -1)

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        return self._first(0, opens, self.levels[0][opens] - 1)

    def leaves(self, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
        """How many ``()`` lie in each subtree: the difference of two ranks."""
        return self.leaves_before[closes] - self.leaves_before[opens]


def _range_min(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Least value of each non-empty range, from two overlapping powers of two."""
    table, span = [values], 1
    while 2 * span <= len(values):
        table.append(np.minimum(table[-1][:-span], table[-1][span:]))
        span *= 2
    size = np.frexp((stop - start).astype(np.float64))[1] - 1
    out = np.empty(len(start), dtype=values.dtype)
    for k, row in enumerate(table):
        at = np.nonzero(size == k)[0]
        out[at] = np.minimum(row[start[at]], row[stop[at] - (1 << k)])
    return out


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths share."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    if a[: high * WIDTH] == b[: high * WIDTH]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[: middle * WIDTH] == b[: middle * WIDTH]:
            low = middle
        else:
            high = middle
    return low


class Block:
    """The trie of paths that come in order, and what each node brings along besides its subtree here."""

    def __init__(self, keyed: bool):
        self.shared, self.sizes, self.weights, self.spine, self.nodes = [], [], [[0]], [0], 1
        self.first, self.last, self.places, self.values = None, b"", [], {c: [] for c in OWN}
        self.parents, self.ends = [[-1]], {}
        self.keys: list[bytes] | None = [_keys(b"")[0]] if keyed else None

    def add(self, path: bytes, weights: list[int], own: dict[str, list[int]], ends: list[str | None]) -> None:
        """A path; ``own`` and ``ends`` are for its last nodes."""
        size = len(path) // WIDTH
        shared = 0 if self.first is None else _common(self.last, path)
        del self.spine[shared + 1:]
        if size > shared:
            self.parents.append([self.spine[-1], *range(self.nodes, self.nodes + size - shared - 1)])
        self.spine.extend(range(self.nodes, self.nodes + size - shared))
        self.nodes += size - shared
        self.weights.append(weights[shared:])
        self.shared.append(shared)
        self.sizes.append(size)
        if self.keys is not None:
            self.keys += _keys(path)[shared + 1:]
        if self.first is None:
            self.first, self.first_weights, self.first_spine = path, weights, list(self.spine)
        self.last, self.last_weights = path, weights
        at = self.spine[size + 1 - len(ends):]
        self.places.append(at)
        for c in OWN:
            self.values[c].append(own[c])
        self.ends.update((node, end) for node, end in zip(at, ends) if end is not None)

    def encode(self) -> None:
        shared, sizes = np.array(self.shared), np.array(self.sizes)
        closing = np.append(0, sizes[:-1]) - shared
        runs = np.column_stack([closing, sizes - shared]).ravel()
        signs = np.repeat(np.tile(np.array([-1, 1], dtype=np.int8), len(sizes)), runs)
        marks = Parentheses(np.concatenate([np.ones(1, dtype=np.int8), signs, np.full(int(sizes[-1]) + 1, -1, dtype=np.int8)]))
        closes = marks.find_close(marks.opens)
        stop = np.searchsorted(marks.opens, closes)  # the subtree of node i is nodes i to stop[i]

        def below(values: np.ndarray) -> np.ndarray:
            total = np.append(0, np.cumsum(values))
            return total[stop] - total[:-1]

        def flat(lists: list[list[int]]) -> np.ndarray:
            return np.concatenate([np.asarray(x, dtype=np.int64) for x in lists])

        place, self.own = flat(self.places), {}
        for c in OWN:
            self.own[c] = np.full(self.nodes, NONE if c == "least" else 0, dtype=np.int64)
            (np.minimum if c == "least" else np.add).at(self.own[c], place, flat(self.values[c]))
        self.depth = marks.levels[0][marks.opens] - 1
        self.parent = flat(self.parents)
        self.members = below(self.own["members"])
        self.least = _range_min(self.own["least"], np.arange(self.nodes), stop)
        kids = np.bincount(self.parent[1:], minlength=self.nodes)
        self.children = kids + self.own["children"]
        # a pair () is no leaf where children hang off it that are final already; their leaves were counted with them
        inner = (kids == 0) & (self.own["children"] > 0)
        self.leaves = marks.leaves(marks.opens, closes) - below(inner) + below(self.own["leaves"])
        self.saved = below((self.members - 1) * flat(self.weights) + self.own["saved"])


def _keys(path: bytes) -> list[bytes]:
    """Keys of the prefixes of a path, from none of its turns to all."""
    running, out = hashlib.blake2b(digest_size=WIDTH), []
    for at in range(0, len(path) + 1, WIDTH):
        out.append(running.copy().digest())
        running.update(path[at: at + WIDTH])
    return out


# rows --------------------------------------------------------------------------

_ARROW = pa.schema([
    ("kind", pa.string()), *[(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")],
    ("ends_sha256", pa.string()), ("node", pa.binary()), *[(c, pa.int32()) for c in ("level", "part", "block", "side")],
    ("path", pa.binary()), ("weights", pa.list_(pa.int64())), ("ends", pa.list_(pa.string())), *[(f"s_{c}", pa.list_(pa.int64())) for c in OWN],
])


def _batch(kind: str, n: int, **cols) -> pa.RecordBatch:
    cols["kind"] = [kind] * n

    def column(field: pa.Field) -> pa.Array:
        values = cols.get(field.name)
        if values is None:
            return pa.nulls(n, field.type)
        return values if isinstance(values, pa.Array) else pa.array(values, field.type)

    return pa.RecordBatch.from_arrays([column(f) for f in _ARROW], schema=_ARROW)


def _finish(block: Block, level: int, part: int, number: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """The final nodes of a block and, unless it is the whole trie, its spines and the places where their children look for them."""
    block.encode()
    spines = [] if whole else [(block.first, block.first_weights, block.first_spine), (block.last, block.last_weights, block.spine)]
    spines = spines[: len(block.sizes)]  # one path is one spine
    side = np.full(block.nodes, -1, dtype=np.int32)
    for k in reversed(range(len(spines))):
        side[spines[k][2]] = k
    done = np.nonzero(side < 0)[0]
    for at in range(0, len(done), 20_000):
        some = done[at: at + 20_000]
        up = block.parent[some]
        asks = (up >= 0) & (side[up] >= 0)

        def where(values: np.ndarray | int) -> pa.Array:
            return pa.array(np.broadcast_to(np.asarray(values, dtype=np.int32), len(some)), pa.int32(), mask=~asks)

        yield _batch(
            "node", len(some), conv_id=block.least[some], depth=block.depth[some],
            parent_conv_id=pa.array(block.least[up], pa.int64(), mask=(up < 0) | asks), n_convs=block.members[some],
            n_children=block.children[some], n_leaves=block.leaves[some], saved_tokens=block.saved[some],
            ends_sha256=[block.ends.get(i, EMPTY) for i in some.tolist()], node=block.keys and [block.keys[i] for i in some.tolist()],
            level=where(level), part=where(part), block=where(number), side=where(side[up]),
        )
    if not spines:
        return
    hanging = done[side[block.parent[done]] >= 0]
    up, own = block.parent[hanging], block.own
    for c, values in (("members", block.members), ("children", np.ones(block.nodes, dtype=np.int64)), ("leaves", block.leaves), ("saved", block.saved)):
        np.add.at(own[c], up, values[hanging])
    np.minimum.at(own["least"], up, block.least[hanging])
    parents = set(up.tolist())
    for k, (path, weights, nodes) in enumerate(spines):
        mine = side[nodes] == k
        yield _batch(
            "spine", 1, level=[level], part=[part], block=[number], side=[k], path=[path], weights=[weights],
            ends=[[block.ends.get(i) if m else None for i, m in zip(nodes, mine)]],
            **{f"s_{c}": [np.where(mine, own[c][nodes], NONE if c == "least" else 0).tolist()] for c in OWN},
        )
        asked = [(d, key) for d, (i, m, key) in enumerate(zip(nodes, mine, _keys(path))) if m and i in parents]
        if asked:
            n = len(asked)
            yield _batch("place", n, level=[level] * n, part=[part] * n, block=[number] * n, side=[k] * n,
                         depth=[d for d, _ in asked], node=[key for _, key in asked])


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Copies of one path next to each other become one row with their ids, so many to a row."""

    def rows(lot: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "path": pa.array([x[0] for x in lot], pa.binary()), "weights": pa.array([x[1] for x in lot], pa.list_(pa.int64())),
            "first": pa.array([x[2][0] for x in lot], pa.int64()), "n": pa.array([len(x[2]) for x in lot], pa.int64()),
            "ids": pa.array([",".join(map(str, x[2])) for x in lot], pa.string()),
        })

    lot: list[tuple[bytes, list[int], list[int]]] = []
    for batch in batches:
        for conv, path, weights in zip(*(c.to_pylist() for c in batch.columns)):
            if lot and lot[-1][0] == path and len(lot[-1][2]) < most:
                lot[-1][2].append(conv)
                continue
            if len(lot) >= 1_000:
                yield rows(lot)
                lot = []
            lot.append((path, weights, [conv]))
    if lot:
        yield rows(lot)


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Distinct paths with their members counted and hashed; chunks of one path come one after another, by their ids."""
    current = None
    for batch in batches:
        for path, weights, first, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if current is not None and current[0] == path:
                current[2]["members"][0] += n
                current[3].update(f",{ids}".encode())
                continue
            if current is not None:
                yield *current[:3], [current[3].hexdigest()]
            current = (path, weights, {"members": [n], "least": [first], "children": [0], "leaves": [0], "saved": [0]}, hashlib.sha256(ids.encode()))
    if current is not None:
        yield *current[:3], [current[3].hexdigest()]


def _spines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for path, weights, ends, *own in zip(*(c.to_pylist() for c in batch.columns)):
            yield path, weights, dict(zip(OWN, own)), ends


def _encode_blocks(level: int, single: bool, block_nodes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, block = TaskContext.get().partitionId(), 0, None
        for element in (_spines if level else _sequences)(batches):
            if block is not None and block.nodes >= block_nodes and len(block.sizes) >= LEAST_PATHS:
                yield from _finish(block, level, part, number, False)
                number, block = number + 1, None
            block = block or Block(level > 0)
            block.add(*element)
        if block is not None:
            yield from _finish(block, level, part, number, single and number == 0)

    return run


# the operator -----------------------------------------------------------------


def turn_paths(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: the turns of each conversation in order, each with its digest and the UTF-8 bytes of its text.

    Turns are ordered by ``turn``, NULL first, and those of one number by their digest. A NULL role or text counts as empty.
    Rows without ``conv_id`` belong to no conversation and are left out. Texts stay where they are read; 16 bytes of the SHA-256
    of role and text stand for a turn. Other columns are not read.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * WIDTH)
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")).alias("t"))
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("turns"))


def prefix_trie(paths: DataFrame, block_nodes: int = BLOCK_NODES, ids_in_chunk: int = IDS_IN_CHUNK) -> DataFrame:
    """The nodes of the trie of ``paths(conv_id, turns)`` as ``turn_paths`` gives them; conversation ids are distinct.

    A node is a sequence of turns with which a conversation begins, the root is the empty one. ``conv_id`` is its smallest member,
    ``parent_conv_id`` that of its parent, ``n_convs`` the members, ``n_children`` the children, ``n_leaves`` the nodes without
    children in its subtree, ``saved_tokens`` the sum over its subtree of (members - 1) times the bytes of the last turn, and
    ``ends_sha256`` the SHA-256 of the ascending ids of members without further turns, joined by commas. Conversations without
    turns end at the root; an empty table has no nodes.

    Copies of a conversation, however many, are packed before they meet; a task holds one block and one path at a time. Results do not
    depend on ``block_nodes`` and ``ids_in_chunk``, which bound them.
    """
    spark = paths.sparkSession

    def stored(df: DataFrame, label: str, schema: str) -> tuple[DataFrame, str]:
        path = scratch_path(spark, label)
        df.write.parquet(path)
        return spark.read.schema(schema).parquet(path), path

    # written before each range shuffle, whose bounds take a pass of their own
    members, _ = stored(paths.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path"),
        F.transform("turns", lambda t: t["bytes"]).alias("weights"),
    ), "trie-members", "conv_id long, path binary, weights array<long>")
    packed = "path binary, weights array<long>, first long, n long, ids string"
    chunks, _ = stored(
        members.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(
            lambda batches: _chunks((b.select(["conv_id", "path", "weights"]) for b in batches), ids_in_chunk), packed), "trie-chunks", packed)
    source, single, level, folders = chunks.repartitionByRange("path").sortWithinPartitions("path", "first"), False, 0, []
    while True:
        rows, folder = stored(source.mapInArrow(_encode_blocks(level, single, block_nodes), OUT), f"trie-level-{level}", OUT)
        folders.append(folder)
        spines = rows.where("kind = 'spine'")
        n = spines.count()
        if not n:
            break
        level, single, order = level + 1, n <= LEVEL_PATHS, ("part", "block", "side")
        spread = spines.coalesce(1) if single else spines.repartitionByRange(-(-n // LEVEL_PATHS), *order)
        source = spread.sortWithinPartitions(*order).select("path", "weights", "ends", *[f"s_{c}" for c in OWN])
    rows = spark.read.schema(OUT).parquet(*folders)
    nodes = rows.where("kind = 'node'")
    merged = nodes.where("node IS NOT NULL").select("node", F.col("conv_id").alias("up"))
    here = ["level", "part", "block", "side"]
    parents = rows.where("kind = 'place'").join(merged, "node").select(*here, (F.col("depth") + 1).alias("depth"), "up")
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    waiting = nodes.where("side IS NOT NULL").drop("parent_conv_id").join(parents.withColumnRenamed("up", "parent_conv_id"), [*here, "depth"])
    return nodes.where("side IS NULL").select(*columns).unionByName(waiting.select(*columns))
