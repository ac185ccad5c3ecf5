"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton is built over item words, block by block, so that what is broadcast never exceeds ``block_words`` words; every
block is one pass over the documents, without a shuffle. A document streams through it word by word. The state says how long
the match that ends here is; a match of ``window`` words, or one that ends with a whole shorter item, is a hit. Words and word
pairs that no item has cannot lie inside a match, so runs between them that are too short are not walked.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a word stay, A-Z becomes lower case, every other ASCII byte separates.
_WORD_BYTES = bytes(
    b if b >= 0x80 or chr(b).isalnum() and not chr(b).isupper() else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(_WORD_BYTES).split() if text else []


class ItemAutomaton:
    """Suffix automaton of many word sequences, with the items of every window on its states."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[int | None] = []
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, int, list[int]]] = []
        pairs: set[int] = set()
        shortest = window
        for name, words in items:
            if not words:
                continue
            item = len(self.names)
            self.names.append(name)
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            shortest = min(shortest, len(ids))
            pairs.update((a << 32) | b for a, b in zip(ids, ids[1:]))
            last = 0
            for c in ids:
                last = self._extend(last, c)
            ends.append((item, last, ids))
        self.shortest = shortest
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        # the ancestor of a state that holds its suffix of `window` words
        self.anchor = [-1] * len(self.link)
        for s in sorted(range(len(self.link)), key=self.length.__getitem__):
            if self.length[s] >= window:
                up = self.link[s]
                self.anchor[s] = s if self.length[up] < window else self.anchor[up]
        self.items: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for item, last, ids in ends:
            if len(ids) < window:
                self.short.setdefault(last, []).append((len(ids), item))
                continue
            state = 0
            for i, c in enumerate(ids):
                state = self.next[state][c]
                if i + 1 >= window:
                    self.items.setdefault(self.anchor[state], set()).add(item)
        # states whose suffixes include a whole short item: the nearest such state at or above each one
        self.nearest = [-1] * len(self.link)
        if self.short:
            for s in sorted(range(len(self.link)), key=self.length.__getitem__):
                self.nearest[s] = s if s in self.short else self.nearest[self.link[s]] if s else -1

    def _extend(self, last: int, c: int) -> int:
        known = self.next[last].get(c)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._split(last, c, known)
        state = len(self.link)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        at = last
        while at >= 0 and c not in self.next[at]:
            self.next[at][c] = state
            at = self.link[at]
        if at >= 0:
            target = self.next[at][c]
            self.link[state] = target if self.length[target] == self.length[at] + 1 else self._split(at, c, target)
        return state

    def _split(self, at: int, c: int, target: int) -> int:
        clone = len(self.link)
        self.next.append(dict(self.next[target]))
        self.length.append(self.length[at] + 1)
        self.link.append(self.link[target])
        self.link[target] = clone
        while at >= 0 and self.next[at].get(c) == target:
            self.next[at][c] = clone
            at = self.link[at]
        return clone

    def matches(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words are inside an occurrence of a window, and the items with such windows."""
        hit = np.zeros(len(words), dtype=bool)
        found: set[int] = set()
        if len(words) < self.shortest or not self.names:
            return hit, found
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        known = ids >= 0
        if self.shortest > 1:
            code = (ids[:-1] << 32) | ids[1:]
            place = np.minimum(np.searchsorted(self.pairs, code), max(len(self.pairs) - 1, 0))
            joined = known[:-1] & known[1:] & (self.pairs[place] == code) if len(self.pairs) else np.zeros(len(code), bool)
            edge = np.diff(np.concatenate(([0], joined.astype(np.int8), [0])))
            starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
        else:
            edge = np.diff(np.concatenate(([0], known.astype(np.int8), [0])))
            starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        for a, b in zip(starts, stops):
            if b - a >= self.shortest:
                self._walk(ids[a:b].tolist(), int(a), hit, found)
        return hit, found

    def _walk(self, ids: list[int], base: int, hit: np.ndarray, found: set[int]) -> None:
        state, matched, window = 0, 0, self.window
        for i, c in enumerate(ids):
            while state and c not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if c in self.next[state]:
                state, matched = self.next[state][c], matched + 1
            if matched >= window:
                found |= self.items[self.anchor[state]]
                hit[base + i - window + 1: base + i + 1] = True
            near = self.nearest[state]
            while near >= 0:
                for size, item in self.short[near]:
                    if size <= matched:
                        found.add(item)
                        hit[base + i - size + 1: base + i + 1] = True
                near = self.nearest[self.link[near]] if near else -1


def item_blocks(items: Iterator, window: int, block_words: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Items in blocks of bounded size; an item above it is cut into pieces that overlap by ``window - 1`` words."""
    block, size = [], 0
    for name, text in items:
        words = words_of(text)
        step = max(block_words, window)
        for at in range(0, max(1, len(words) - window + 1), step):
            piece = words[at: at + step + window - 1]
            if block and size + len(piece) > block_words:
                yield block
                block, size = [], 0
            block.append((name, piece))
            size += len(piece)
    if block:
        yield block


def find_contamination(
    docs: DataFrame, items: DataFrame, window: int = 10, block_words: int = 200_000, id_col: str = "doc_id",
    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: tuple[str, ...] = (),
    with_text: bool = False,
) -> DataFrame:
    """One row per document: ``d_id, d_words, d_hits, d_items``, with ``keep`` as the struct ``d_row``, on request ``d_text``,
    the text without its hit runs.

    ``d_words`` counts words, ``d_hits`` are the hit runs as word positions ``[start, stop]``, ``d_items`` the distinct ids of
    items with windows in the text. A document without words, NULL text included, has no hits; items without words have no
    windows; an item id of NULL is reported as one NULL id; repeated items count once. With no items nothing is hit.
    """
    context = docs.sparkSession.sparkContext
    out = docs.select(
        F.col(id_col).alias("d_id"), F.col(text_col).alias("d_text"), F.lit(0).cast("long").alias("d_words"),
        F.array().cast("array<array<int>>").alias("d_hits"), F.array().cast("array<long>").alias("d_items"),
        *([F.struct(*keep).alias("d_row")] if keep else []),
    )
    source = items.select(F.col(item_col).cast("long"), F.col(item_text_col)).distinct().toLocalIterator()
    blocks = item_blocks(((r[0], r[1]) for r in source), window, block_words)
    block: list | None = next(blocks, [])
    while block is not None:
        following = next(blocks, None)
        out = _one_block(out, context.broadcast(ItemAutomaton(block, window)), with_text or following is not None, with_text and following is None)
        block = following
    return out


def _one_block(out: DataFrame, automaton, with_text: bool, cut: bool) -> DataFrame:
    given = out.columns
    returned = [c for c in given if with_text or c != "d_text"]

    def scan(batches):
        match = automaton.value
        for batch in batches:
            texts, hits, items = (batch.column(given.index(c)).to_pylist() for c in ("d_text", "d_hits", "d_items"))
            counts = []
            for i, text in enumerate(texts):
                words = words_of(text)
                counts.append(len(words))
                hit, found = match.matches(words)
                if not found:
                    continue
                for a, b in hits[i]:
                    hit[a:b] = True
                edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
                hits[i] = [[int(a), int(b)] for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
                items[i] = list({*items[i], *(match.names[k] for k in found)})
            cols = dict(zip(given, batch.columns))
            cols["d_words"] = pa.array(counts, pa.int64())
            cols["d_hits"] = pa.array(hits, pa.list_(pa.list_(pa.int32())))
            cols["d_items"] = pa.array(items, pa.list_(pa.int64()))
            if cut:
                cols["d_text"] = pa.array([remove_runs(t, h) if h else t for t, h in zip(texts, hits)], cols["d_text"].type)
            yield pa.RecordBatch.from_arrays([cols[c] for c in returned], names=returned)

    return out.mapInArrow(scan, out.select(*returned).schema)


def remove_runs(text: str, runs: list[list[int]]) -> str:
    """``text`` without the words of ``runs`` and what stands between them."""
    spots = [m.span() for m in _WORD.finditer(text)]
    kept, at = [], 0
    for a, b in runs:
        kept.append(text[at:spots[a][0]])
        at = spots[b - 1][1]
    return "".join([*kept, text[at:]])


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.5, id_col: str = "doc_id",
    text_col: str = "text", length_col: str | None = "n_chars", **how,
) -> DataFrame:
    """``docs`` without the hit spans; documents of which more than ``max_coverage`` of the words are hit go.

    Untouched documents come back as they were. Where text is cut and ``length_col`` exists, it is set to the new length.
    """
    columns = docs.columns
    rest = tuple(c for c in columns if c != text_col)
    found = find_contamination(docs, items, window, id_col=id_col, text_col=text_col, keep=rest, with_text=True, **how)

    covered = F.aggregate("d_hits", F.lit(0), lambda n, run: n + run[1] - run[0])
    touched = F.size("d_hits") > 0
    kept = found.where(~touched | (covered <= F.lit(max_coverage) * F.col("d_words")))
    values = {c: F.col("d_row")[c] for c in rest} | {text_col: F.col("d_text")}
    if length_col in rest:
        new_length = F.length("d_text").cast(docs.schema[length_col].dataType)
        values[length_col] = F.when(touched, new_length).otherwise(values[length_col])
    return kept.select(*[values[c].alias(c) for c in columns])
