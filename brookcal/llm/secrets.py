"""Secret scan: fixed formats, and formats learned by grammar inference.

One pass over the texts finds the spans of the fixed formats and all candidates: runs of 12 or more credential characters.
The fixed-format values are the labelled credentials. Per kind, a prefix tree of their character classes is built and
statistically compatible states are merged (Hoeffding bound), which gives a probabilistic automaton; the chance to end and the
lengths of the credentials belong to it. Every candidate gets its likelihood per step under each automaton, alone and against a
chain of character classes that is counted over all candidates. Those for which both are as high as for nineteen in twenty
held-out credentials of a kind become spans of the kind ``format``: plain words fail the second, numbers of another length the
first. A candidate is scored whole; where it is none, the parts between its dots are scored, so that a full stop or a name before
a credential does not hide it.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookcal.session import cut_lineage

# fixed values: the formats searched for, and the least length of what they must hold
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % ASSIGN_LEAST)
PART = re.compile(r"[^.]{%d,}" % ASSIGN_LEAST)
#: Credentials of each kind that an automaton learns from, chosen by hash.
PER_KIND = 400
MIN_CREDENTIALS = 20


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """Start, kind number, end and credential of the fixed formats; leftmost and non-overlapping within a kind."""
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


class Covered:
    """Tells what lies inside one of some spans, given by ascending start and by stop."""

    def __init__(self, starts: Iterable[int], stops: Iterable[int]):
        self.starts, self.reach = list(starts), list(accumulate(stops, max))

    def inside(self, start: int, stop: int) -> bool:
        before = bisect_right(self.starts, start)
        return before > 0 and stop <= self.reach[before - 1]


def candidates(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, str]]:
    """Runs of credential characters, but for those that lie inside a fixed-format span and are found with it."""
    covered = Covered((s[0] for s in taken), (s[2] for s in taken))
    return [(m.start(), m[0]) for m in CANDIDATE.finditer(text) if not covered.inside(m.start(), m.end())]


_CLASSES = str.maketrans(
    {chr(c): "0" if chr(c).isdigit() else "a" if chr(c) in "abcdef" else "g" if chr(c).islower() else "A" for c in range(128) if chr(c).isalnum()}
)


def symbols(word: str) -> str:
    """Character classes: digits, hexadecimal and other lower-case letters, upper case; signs stand for themselves."""
    return word.translate(_CLASSES)


@dataclass
class Automaton:
    """A probabilistic automaton; state 0 is the start."""

    edges: list[dict[str, int]] = field(default_factory=list)
    through: list[dict[str, int]] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    lengths: dict[int, int] = field(default_factory=dict)

    @classmethod
    def infer(cls, words: Iterable[str], alpha: float = 0.05) -> "Automaton":
        """The prefix tree of ``words``, its compatible states merged, level by level."""
        tree = cls([{}], [{}], [0])
        for word in words:
            at = 0
            tree.lengths[len(word)] = tree.lengths.get(len(word), 0) + 1
            for c in symbols(word):
                tree.through[at][c] = tree.through[at].get(c, 0) + 1
                if c not in tree.edges[at]:
                    tree.edges[at][c] = len(tree.edges)
                    tree.edges.append({})
                    tree.through.append({})
                    tree.ends.append(0)
                at = tree.edges[at][c]
            tree.ends[at] += 1
        bound = math.sqrt(0.5 * math.log(2 / alpha))
        settled = [0]
        frontier = [(0, c) for c in sorted(tree.edges[0])]
        while frontier:
            parent, c = frontier.pop(0)
            state = tree.edges[parent][c]
            if state in settled:
                continue
            for other in settled:
                if tree._alike(other, state, bound):
                    tree.edges[parent][c] = other
                    tree._fold(other, state)
                    break
            else:
                settled.append(state)
            frontier = [(s, x) for s in settled for x in sorted(tree.edges[s]) if tree.edges[s][x] not in settled]
        number = {s: i for i, s in enumerate(settled)}
        return cls(
            [{c: number[t] for c, t in tree.edges[s].items()} for s in settled], [tree.through[s] for s in settled],
            [tree.ends[s] for s in settled], tree.lengths,
        )

    def _count(self, s: int) -> int:
        return self.ends[s] + sum(self.through[s].values())

    def _alike(self, a: int, b: int, bound: float) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self._count(a), self._count(b)
            if not n or not m:
                continue
            gap = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            shares = [(self.ends[a], self.ends[b])]
            shares += [(self.through[a].get(c, 0), self.through[b].get(c, 0)) for c in {*self.through[a], *self.through[b]}]
            if any(abs(x / n - y / m) > gap for x, y in shares):
                return False
            todo += [(self.edges[a][c], self.edges[b][c]) for c in self.edges[a] if c in self.edges[b]]
        return True

    def _fold(self, into: int, state: int) -> None:
        todo = [(into, state)]
        while todo:
            into, state = todo.pop()
            if into == state:
                continue
            self.ends[into] += self.ends[state]
            for c, n in self.through[state].items():
                self.through[into][c] = self.through[into].get(c, 0) + n
                if c in self.edges[into]:
                    todo.append((self.edges[into][c], self.edges[state][c]))
                else:
                    self.edges[into][c] = self.edges[state][c]

    def log_likelihood(self, word: str) -> float:
        """Mean natural log-likelihood per step, the end and the length counted as one; what was never seen has one half of a count."""
        at, total, own = 0, 0.0, symbols(word)
        for c in own:
            n = self._count(at) + 1.0
            total += math.log(self.through[at].get(c, 0.5) / n)
            if c not in self.edges[at]:
                # no way on: the end is as unlikely as this step, twice
                total += 2 * math.log(0.5 / n)
                break
            at = self.edges[at][c]
        else:
            total += math.log((self.ends[at] or 0.5) / (self._count(at) + 1.0))
        total += math.log((self.lengths.get(len(word), 0) + 0.5) / (sum(self.lengths.values()) + 1.0))
        return total / (len(own) + 1)


#: Start and end of a candidate in the chain of classes; neither is a credential character.
START, END = "^", "$"


@dataclass
class Background:
    """A chain of character classes with start and end, counted over all candidates."""

    pairs: dict[str, int]

    def __post_init__(self):
        self.from_class: dict[str, int] = {}
        for pair, n in self.pairs.items():
            self.from_class[pair[0]] = self.from_class.get(pair[0], 0) + n

    def log_likelihood(self, word: str) -> float:
        chain = START + symbols(word) + END
        steps = [math.log((self.pairs.get(chain[i: i + 2], 0) + 0.5) / (self.from_class.get(chain[i], 0) + 6.0)) for i in range(len(chain) - 1)]
        return sum(steps) / len(steps)


@dataclass
class Formats:
    """Automata of the kinds, the chain of all candidates, and the least likelihood and ratio of each kind."""

    automata: list[Automaton]
    background: Background
    least: list[tuple[float, float]] = field(default_factory=list)

    def calibrate(self, held: list[list[str]]) -> None:
        """39 in 40 held-out credentials of a kind reach its likelihood and as many its ratio (at least 0), so 38 in 40 reach both."""
        for automaton, words in zip(self.automata, held):
            own = sorted(automaton.log_likelihood(w) for w in words)
            ratio = sorted(automaton.log_likelihood(w) - self.background.log_likelihood(w) for w in words)
            self.least.append((own[len(own) // 40], max(0.0, ratio[len(ratio) // 40])))

    def accepts(self, word: str) -> bool:
        plain = None
        for automaton, (own, ratio) in zip(self.automata, self.least):
            likelihood = automaton.log_likelihood(word)
            if likelihood >= own:
                plain = self.background.log_likelihood(word) if plain is None else plain
                if likelihood - plain >= ratio:
                    return True
        return False

    def spans(self, start: int, run: str, covered: Covered) -> list[tuple[int, int]]:
        """The run if it is accepted, else those of its parts between dots that are.

        Credentials of one fixed form all have one likelihood, which is then the least one.
        """
        if self.accepts(run):
            return [(start, start + len(run))]
        if "." not in run:
            return []
        parts = [(start + m.start(), start + m.end(), m[0]) for m in PART.finditer(run)]
        return [(a, b) for a, b, part in parts if not covered.inside(a, b) and self.accepts(part)]


SCAN = "base array<struct<start:int,kind:int,stop:int,word:string>>, cand array<struct<start:int,word:string>>"
_BASE = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32()), ("word", pa.string())]))
_CAND = pa.list_(pa.struct([("start", pa.int32()), ("word", pa.string())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, cand`` for every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, cand = [], []
            for text in batch.column(1):
                t = text.as_py() or ""
                own = base_spans(t)
                base.append([dict(zip(("start", "kind", "stop", "word"), s)) for s in own])
                cand.append([{"start": a, "word": w} for a, w in candidates(t, own)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, _BASE), pa.array(cand, _CAND)], names=["doc_id", "base", "cand"],
            )

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(find, f"doc_id {id_type}, {SCAN}")


def learn_formats(found: DataFrame, per_kind: int = PER_KIND) -> Formats:
    """Automata from at most ``per_kind`` distinct credentials of each kind; the chain of classes from all candidates."""
    words = found.select(F.explode("base").alias("b")).select("b.kind", "b.word")
    rows = []
    for kind in range(len(KINDS)):
        some = words.where(F.col("kind") == kind).select("word").distinct()
        rows.append([r["word"] for r in some.orderBy(F.xxhash64("word"), "word").limit(per_kind).collect()])
    automata = [Automaton.infer(some[::2]) for some in rows if len(some) >= MIN_CREDENTIALS]
    held = [some[1::2] for some in rows if len(some) >= MIN_CREDENTIALS]
    plain = found.select(F.explode("cand.word").alias("w"))
    classes = F.translate("w", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0" * 10 + "a" * 6 + "g" * 20 + "A" * 26)
    chain = plain.select(F.concat(F.lit(START), classes, F.lit(END)).alias("c"))
    steps = F.transform(F.sequence(F.lit(1), F.length("c") - 1), lambda i: F.substring(F.col("c"), i, F.lit(2)))
    counts = chain.select(F.explode(steps).alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).collect()
    formats = Formats(automata, Background({r["pair"]: r["n"] for r in counts}))
    formats.calibrate(held)
    return formats


def find_secrets(docs: DataFrame, per_kind: int = PER_KIND, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans`` for every row: an array of ``start, kind, stop`` with kinds 0 to 2 as in ``KINDS`` and 3, ``format``.

    Offsets are code points, ends exclusive. Fixed-format spans always stay; learned ones lie inside none of them, but may hold
    or cross one. NULL and empty texts have no spans, repeated rows come back as often as they occur. With fewer than
    ``MIN_CREDENTIALS`` credentials of a kind, its format is not learned; an empty table gives no rows.
    """
    found = cut_lineage(scan(docs, id_col, text_col))
    formats = docs.sparkSession.sparkContext.broadcast(learn_formats(found, per_kind))
    spans = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for base, cand in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = [(b["start"], b["kind"], b["stop"]) for b in base]
                covered = Covered((s[0] for s in own), (s[2] for s in own))
                own += [(a, len(KINDS), b) for c in cand for a, b in formats.value.spans(c["start"], c["word"], covered)]
                out.append([dict(zip(("start", "kind", "stop"), s)) for s in sorted(own)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, spans)], names=["doc_id", "spans"])

    id_type = found.schema["doc_id"].dataType.simpleString()
    return found.select("doc_id", "base", "cand").mapInArrow(judge, f"doc_id {id_type}, spans array<struct<start:int,kind:int,stop:int>>")
