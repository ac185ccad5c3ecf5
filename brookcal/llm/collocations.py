"""Frequent phrases and how strongly their words belong together, counted in burst tries.

Texts are cut into words byte by byte: all separators are single bytes of UTF-8. Each task gives the words it meets ids of its own
and counts phrases in a trie over them. A trie begins as one hash container; a container that grows too large bursts into a node with
a container for each next word. When a task holds too many phrases, whole subtrees leave as runs sorted by phrase, largest first.
Runs are written to the shared folder, dealt by ranges of the phrase order, so that each partition owns whole prefixes, however
frequent one of them is, and are merged there.

Lengths are counted one after another, since a phrase can be frequent only where both phrases shorter by one word are. What passed
is kept in a bit filter of bounded size; a phrase that passes it by chance is counted and then dropped, so the filter changes the work
and never a count. Word pairs, of which there are most, pass a second filter: the first pass counts them by hash buckets, and a pair whose
bucket stays below the limit cannot reach it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brookcal.session import scratch_path

RUN = "lang string, words int, phrase string, n long"
UNKNOWN = "und"
LOT_BYTES = 4 << 20  # text cut at once
BURST = 8_192  # phrases of one container
MOST_PHRASES = 1_000_000  # phrases a task holds before subtrees leave
MOST_WORDS = 1_000_000  # words a task has ids for
LEAST_BITS, MOST_BITS = 16, 30  # of a filter: 8 kB to 128 MB
BUCKET_BITS = 23  # word pairs are first counted in so many buckets, a byte each
CHUNK_BITS = 20
TOP_PARTS = 256  # of a language, each of which sends at most the wanted rows

_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"): ord("Z") + 1] += 32


# words -------------------------------------------------------------------------


class Words(NamedTuple):
    """Words of some texts in order: which text, which piece, their hashes, and the words themselves, each with a space after it."""

    text: np.ndarray
    piece: np.ndarray
    hashes: np.ndarray
    spelled: pa.Array


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _spelled(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A polynomial of the bytes of each word, modulo 2^64."""
    if len(offsets) < 2:
        return np.zeros(0, dtype=np.uint64)
    size = np.diff(offsets)
    powers = np.full(int(size.max()) + 1, 0x9E3779B97F4A7C15, dtype=np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    place = np.arange(offsets[-1], dtype=np.int32) - np.repeat(offsets[:-1], size)
    return np.add.reduceat(powers[place] * (flat.astype(np.uint64) + np.uint64(1)), offsets[:-1])


def cut_words(texts: list[bytes], langs: list[str]) -> Words:
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    kind = _CLASS[data]
    inside = kind == 0
    before = np.concatenate([[False], inside[:-1]])
    starts = np.nonzero(inside & ~before)[0]
    ends = np.nonzero(before & ~inside)[0]
    flat = np.where(inside, _LOWER[data], np.uint8(0x20))[inside | before]
    offsets = np.zeros(len(starts) + 1, dtype=np.int32)
    np.cumsum(ends - starts + 1, out=offsets[1:])
    text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, np.append(0, np.cumsum([len(t) + 1 for t in texts])))))
    names = {lang: zlib.crc32(lang.encode()) << 32 | len(lang) for lang in set(langs)}
    own = _mix(np.array([names[lang] for lang in langs], dtype=np.uint64))
    spelled = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(flat))
    return Words(text, np.cumsum(kind == 2, dtype=np.int32)[starts], _mix(_spelled(flat, offsets) ^ own[text]), spelled)


def _roll(hashes: list[np.ndarray]) -> np.ndarray:
    """One hash for each row of word hashes."""
    out = hashes[0].copy()
    for h in hashes[1:]:
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h
    return _mix(out)


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return hashes & np.uint64((1 << bits) - 1), hashes >> np.uint64(64 - bits)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return hashes & np.uint64((1 << BUCKET_BITS) - 1)


def _bits_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


class Filter(NamedTuple):
    """What a pass knows from the one before: bits of the phrases of ``words`` words that passed, two for each, and for word
    pairs the buckets that reach the limit."""

    words: int
    data: bytes
    bits: int
    pairs: bytes | None = None

    def passed(self, hashes: np.ndarray) -> np.ndarray:
        """For each word, whether the phrase that begins there passed."""
        n = len(hashes) - self.words + 1
        hit = np.zeros(len(hashes), dtype=bool)
        if n > 0:
            data, rolled = np.frombuffer(self.data, dtype=np.uint8), _roll([hashes[j: n + j] for j in range(self.words)])
            hit[:n] = True
            for at in _places(rolled, self.bits):
                hit[:n] &= _bits_at(data, at)
        return hit


# the trie ------------------------------------------------------------------------


class Container:
    """Counts of the rest of phrases, by the bytes of their word ids."""

    def __init__(self, width: int, limit: int):
        self.width, self.limit, self.counts = width, limit, {}

    def size(self) -> int:
        return len(self.counts)

    def add(self, rows: np.ndarray, counts: np.ndarray) -> None:
        found = self.counts
        get = found.get
        for key, n in zip(np.ascontiguousarray(rows).view(f"V{4 * self.width}").ravel().tolist(), counts.tolist()):
            found[key] = get(key, 0) + n

    def matrix(self) -> np.ndarray:
        return np.frombuffer(b"".join(self.counts), dtype=">u4").reshape(-1, self.width)

    def containers(self, prefix: tuple) -> Iterator[tuple[tuple, Container]]:
        if self.counts:
            yield prefix, self


class Node:
    """Words with many phrases have a child each; the phrases of the others share a container until it bursts."""

    def __init__(self, width: int, burst: int):
        self.width, self.burst = width, burst
        self.children: dict[int, Container | Node] = {}
        self.heavy = np.zeros(0, dtype=np.int64)
        self.shared = Container(width, burst)

    def size(self) -> int:
        return self.shared.size() + sum(c.size() for c in self.children.values())

    def add(self, rows: np.ndarray, counts: np.ndarray) -> None:
        """Sorted distinct rows and how often each occurs."""
        if len(self.heavy):
            own = np.isin(rows[:, 0], self.heavy)
            mine, many = rows[own], counts[own]
            cuts = np.nonzero(np.append(True, mine[1:, 0] != mine[:-1, 0]))[0] if len(mine) else []
            for first, stop in zip(cuts, [*cuts[1:], len(mine)]):
                self.children[int(mine[first, 0])].add(mine[first:stop, 1:], many[first:stop])
            rows, counts = rows[~own], counts[~own]
        self.shared.add(rows, counts)
        if self.shared.size() > self.shared.limit and self.width > 1:
            self._split()

    def _split(self) -> None:
        shared = self.shared
        rows, counts = shared.matrix(), np.fromiter(shared.counts.values(), dtype=np.int64)
        words, many = np.unique(rows[:, 0], return_counts=True)
        out = words[many >= self.burst // 32 + 1]
        if not len(out):
            shared.limit *= 2
            return
        rest = ~np.isin(rows[:, 0], out)
        self.shared = Container(self.width, self.burst)
        self.shared.add(rows[rest], counts[rest])
        self.shared.limit = max(self.burst, 2 * self.shared.size())
        for word in out.tolist():
            mine = rows[:, 0] == word
            child = self.children[word] = Node(self.width - 1, self.burst) if self.width > 2 else Container(self.width - 1, self.burst)
            child.add(rows[mine, 1:], counts[mine])
        self.heavy = np.array(sorted(self.children), dtype=np.int64)

    def containers(self, prefix: tuple) -> Iterator[tuple[tuple, Container]]:
        yield from self.shared.containers(prefix)
        for key in sorted(self.children):
            yield from self.children[key].containers((*prefix, key))

    def spill(self, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Takes out whole subtrees, largest first, until ``keep`` phrases are left; gives their rows and counts."""
        left = self.size()
        for key, child in sorted([(None, self.shared), *self.children.items()], key=lambda x: -x[1].size()):
            if left <= keep:
                break
            left -= child.size()
            if key is None:
                self.shared = Container(self.width, self.burst)
            else:
                del self.children[key]
            for head, container in child.containers(() if key is None else (key,)):
                rest = container.matrix()
                front = np.broadcast_to(np.array(head, dtype=np.int64), (len(rest), len(head)))
                yield np.hstack([front, rest.astype(np.int64)]), np.fromiter(container.counts.values(), dtype=np.int64)
        self.heavy = np.array(sorted(self.children), dtype=np.int64)


def _distinct(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows of ids, big-endian so that bytes sort as ids do, and their counts."""
    code = columns[0]
    for c in columns[1:]:
        # the rows so far are renumbered, so that a pair of numbers always fits
        code = (np.unique(code, return_inverse=True)[1] if c is not columns[1] else code).astype(np.int64) << 32 | c
    _, first, counts = np.unique(code, return_index=True, return_counts=True)
    return np.column_stack([c[first] for c in columns]).astype(">u4"), counts


class WordCounter:
    """The first pass of one task: one hash container of words, and capped counts of word pairs by bucket."""

    def __init__(self, least: int, most: int):
        self.most, self.cap = most, least
        self.lots: list[pa.Table] = []
        self.pairs = np.zeros(1 << BUCKET_BITS, dtype=np.uint8 if least < 256 else np.uint32)

    def add(self, texts: list[bytes], langs: list[str]) -> Iterator[pa.RecordBatch]:
        words = cut_words(texts, langs)
        if not len(words.text):
            return
        pairs = words.piece[:-1] == words.piece[1:]
        at, n = np.unique(_bucket(_roll([words.hashes[:-1][pairs], words.hashes[1:][pairs]])), return_counts=True)
        self.pairs[at] = np.minimum(self.pairs[at] + n, self.cap)
        coded = words.spelled.dictionary_encode()
        names = list(dict.fromkeys(langs))
        kinds = {lang: i for i, lang in enumerate(names)}
        lang_of, size = np.array([kinds[x] for x in langs], dtype=np.int64)[words.text], len(coded.dictionary)
        found, counts = np.unique(lang_of * size + coded.indices.to_numpy(), return_counts=True)
        self.lots.append(pa.table({
            "lang": pa.array(names, pa.string()).take(pa.array(found // size)), "phrase": coded.dictionary.take(pa.array(found % size)), "n": counts}))
        if sum(map(len, self.lots)) > self.most:
            self._merge()
            if len(self.lots[0]) > self.most // 2:
                yield from self._runs()

    def _merge(self) -> None:
        merged = pa.concat_tables(self.lots).group_by(["lang", "phrase"]).aggregate([("n", "sum")])
        self.lots = [merged.rename_columns({"n_sum": "n"})]

    def rest(self) -> Iterator[pa.RecordBatch]:
        yield from self._runs()
        for chunk, data in enumerate(np.split(self.pairs, max(1, len(self.pairs) >> CHUNK_BITS))):
            if data.any():
                yield _run_batch(pa.nulls(1, pa.string()), 0, pa.nulls(1, pa.string()), pa.array([chunk]), pa.array([zlib.compress(data.tobytes(), 1)], pa.binary()))

    def _runs(self) -> Iterator[pa.RecordBatch]:
        if self.lots:
            self._merge()
            held = self.lots.pop()
            words = pc.binary_slice(held["phrase"].cast(pa.binary()), 0, -1).cast(pa.string())
            held = held.set_column(held.schema.get_field_index("phrase"), "phrase", words).sort_by([("lang", "ascending"), ("phrase", "ascending")])
            for b in held.select(["lang", "phrase", "n"]).combine_chunks().to_batches(max_chunksize=20_000):
                yield _run_batch(b.column(0), 1, b.column(1), b.column(2))


def _run_batch(lang: pa.Array, words: int, phrase: pa.Array, n: pa.Array, pairs: pa.Array | None = None) -> pa.RecordBatch:
    width = pa.array(np.full(len(n), words, dtype=np.int32))
    return pa.RecordBatch.from_arrays([lang, width, phrase, n, pa.nulls(len(n), pa.binary()) if pairs is None else pairs], names=["lang", "words", "phrase", "n", "pairs"])


class PhraseCounter:
    """A later pass of one task: a trie for each length."""

    def __init__(self, lengths: tuple[int, ...], kept: Filter, most: int = MOST_PHRASES, burst: int = BURST):
        self.lengths, self.kept, self.most, self.burst = lengths, kept, most, burst
        self.clear()

    def clear(self) -> None:
        self.ids: dict[tuple[str, str], int] = {}
        self.names: list[tuple[str, str]] = []
        self.tries = {m: Node(m, self.burst) for m in self.lengths}

    def _ids(self, words: Words, langs: list[str], wanted: np.ndarray) -> np.ndarray:
        """Task-wide ids of the words at some places; a word has another one in each language."""
        coded = words.spelled.filter(pa.array(wanted)).dictionary_encode()
        kinds = {lang: i for i, lang in enumerate(dict.fromkeys(langs))}
        names, spelled = list(kinds), coded.dictionary.to_pylist()
        lang = np.array([kinds[x] for x in langs], dtype=np.int64)[words.text[wanted]]
        pairs, places = np.unique(lang * len(spelled) + coded.indices.to_numpy(), return_inverse=True)
        own = np.empty(len(pairs), dtype=np.int64)
        for i, pair in enumerate(pairs.tolist()):
            name = names[pair // len(spelled)], spelled[pair % len(spelled)]
            at = self.ids.get(name)
            if at is None:
                at = self.ids[name] = len(self.names)
                self.names.append((name[0], name[1][:-1]))
            own[i] = at
        out = np.full(len(wanted), -1, dtype=np.int64)
        out[wanted] = own[places]
        return out

    def add(self, texts: list[bytes], langs: list[str]) -> Iterator[pa.RecordBatch]:
        words = cut_words(texts, langs)
        n, known = len(words.text), self.kept.words
        passed = self.kept.passed(words.hashes)
        begins, wanted = {}, np.zeros(n, dtype=bool)
        for m in self.lengths:
            if n < m:
                continue
            good = words.piece[: n - m + 1] == words.piece[m - 1:]
            for j in range(m - known + 1):
                good &= passed[j: n - m + 1 + j]
            at = np.nonzero(good)[0]
            if m == 2 and self.kept.pairs is not None:
                at = at[_bits_at(np.frombuffer(self.kept.pairs, dtype=np.uint8), _bucket(_roll([words.hashes[at], words.hashes[at + 1]])))]
            begins[m] = at
            for j in range(m):
                wanted[at + j] = True
        if not wanted.any():
            return
        ids = self._ids(words, langs, wanted)
        for m, at in begins.items():
            if len(at):
                self.tries[m].add(*_distinct([ids[at + j] for j in range(m)]))
        full = len(self.names) > MOST_WORDS
        if full or sum(t.size() for t in self.tries.values()) > self.most:
            for t in self.tries.values():
                yield from self._runs(t, 0 if full else t.size() // 2)
            if full:
                self.clear()

    def rest(self) -> Iterator[pa.RecordBatch]:
        for t in self.tries.values():
            yield from self._runs(t, 0)

    def _runs(self, trie: Node, keep: int) -> Iterator[pa.RecordBatch]:
        lot, size = [], 0
        for found in trie.spill(keep):
            lot.append(found)
            size += len(found[1])
            if size > 100_000:
                yield from self._run(lot)
                lot, size = [], 0
        yield from self._run(lot)

    def _run(self, lot: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """Phrases as rows, sorted by language and phrase."""
        if not lot:
            return
        rows, counts = (np.concatenate(x) for x in zip(*lot))
        used, places = np.unique(rows, return_inverse=True)
        places = places.reshape(rows.shape)
        langs, words = (pa.array(x) for x in zip(*[self.names[i] for i in used.tolist()]))
        phrase = pc.binary_join_element_wise(*[words.take(pa.array(places[:, j])) for j in range(rows.shape[1])], " ")
        out = pa.table({"lang": langs.take(pa.array(places[:, 0])), "phrase": phrase, "n": pa.array(counts)})
        for b in out.sort_by([("lang", "ascending"), ("phrase", "ascending")]).combine_chunks().to_batches(max_chunksize=20_000):
            yield _run_batch(b.column(0), rows.shape[1], b.column(1), b.column(2))


# jobs ----------------------------------------------------------------------------


def _count(docs: DataFrame, counter) -> DataFrame:
    """Runs of what ``counter()`` counts in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter()
        texts, langs, size = [], [], 0
        for batch in batches:
            for lang, text in zip(batch.column(1).to_pylist(), batch.column(0).cast(pa.binary())):
                texts.append(text.as_py())
                langs.append(lang)
                size += len(texts[-1])
                if size > LOT_BYTES:
                    yield from own.add(texts, langs)
                    texts, langs, size = [], [], 0
        if texts:
            yield from own.add(texts, langs)
        yield from own.rest()

    return docs.mapInArrow(run, RUN + ", pairs binary")


def _gather(chunks: DataFrame, size: int, parts: int) -> bytes:
    """``(chunk, data)`` put together; ``size`` bounds what the driver holds."""
    data, each = bytearray(size), size // parts
    for row in chunks.collect():
        data[row["chunk"] * each: (row["chunk"] + 1) * each] = row["data"]
    return bytes(data)


def _deal(df: DataFrame, parts: int) -> DataFrame:
    return df.repartition(min(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "chunk")


def _phrase_bits(frequent: DataFrame, words: int, bits: int) -> bytes:
    """The bits of a table of phrases, two for each; tasks make chunks of them."""
    shift = np.uint64(min(bits, CHUNK_BITS))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, phrases = (c.to_pylist() for c in batch.columns)
            hashes = cut_words([p.encode() for p in phrases], langs).hashes.reshape(-1, words)
            at = np.unique(np.concatenate(_places(_roll(list(hashes.T)), bits)))
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array((at >> shift).astype(np.int64)), "bit": pa.array((at & (np.uint64(1) << shift) - np.uint64(1)).astype(np.int64))})

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            chunks, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for c in np.unique(chunks).tolist():
                mine = at[chunks == c]
                np.bitwise_or.at(held.setdefault(c, np.zeros(1 << int(shift) >> 3, dtype=np.uint8)), mine >> 3, (1 << (mine & 7)).astype(np.uint8))
        if held:
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(held), pa.int64()), "data": pa.array([x.tobytes() for x in held.values()], pa.binary())})

    parts = 1 << bits - int(shift)
    set_bits = frequent.select("lang", "phrase").mapInArrow(places, "chunk long, bit long").distinct()
    return _gather(_deal(set_bits, parts).mapInArrow(chunk, "chunk long, data binary"), 1 << bits >> 3, parts)


def _pair_bits(runs: DataFrame, least: int) -> bytes:
    """One bit for each bucket of word pairs whose count reaches ``least``."""
    dtype, size = np.uint8 if least < 256 else np.uint32, 1 << min(BUCKET_BITS, CHUNK_BITS)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(chunk, np.zeros(size, dtype=np.int64))[:] += np.frombuffer(zlib.decompress(data), dtype=dtype)
        if held:
            packed = [np.packbits(x >= least, bitorder="little").tobytes() for x in held.values()]
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(held), pa.int64()), "data": pa.array(packed, pa.binary())})

    parts = (1 << BUCKET_BITS) // size
    counted = runs.where("words = 0").select(F.col("n").alias("chunk"), F.col("pairs").alias("data"))
    return _gather(_deal(counted, parts).mapInArrow(total, "chunk long, data binary"), 1 << BUCKET_BITS >> 3, parts)


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, most: int = MOST_PHRASES, burst: int = BURST) -> tuple[DataFrame, DataFrame]:
    """``(lang, words, phrase, n)`` of all phrases of up to ``longest`` words with ``least`` occurrences, and ``(lang, total)``.

    ``docs`` has ``lang`` and ``text``; NULL counts as ``und`` and as empty, other columns are not read. A-Z is lower-cased. Pieces
    end at ``.,;:!?``, line breaks, vertical tabs and form feeds, words at blanks and tabs. Occurrences may overlap. Equal rows all
    count; an empty table has no phrases. ``most`` and ``burst`` bound what a task holds and do not change the result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"))
    found, totals, kept = None, None, None

    def counter():
        return WordCounter(least, most) if kept is None else PhraseCounter(lengths, Filter(kept[0], kept[1].value, kept[2], kept[3] and kept[3].value), most, burst)

    for lengths in [(1,), (2,), (3,), tuple(range(4, longest + 1))]:
        lengths = tuple(m for m in lengths if m <= longest)
        if not lengths:
            break
        path = scratch_path(spark, f"runs-{lengths[0]}")
        _count(texts, counter).write.parquet(path)
        runs = spark.read.schema(RUN + ", pairs binary").parquet(path)
        counted = runs.where("words > 0")
        if totals is None:
            totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
        merged = counted.repartitionByRange("lang", "phrase").groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        path = scratch_path(spark, f"frequent-{lengths[0]}")
        merged.write.parquet(path)
        frequent = spark.read.schema(RUN).parquet(path)
        found = frequent if found is None else found.unionByName(frequent)
        if lengths[-1] < longest:
            bits = min(max((16 * frequent.count()).bit_length(), LEAST_BITS), MOST_BITS)
            pairs = spark.sparkContext.broadcast(_pair_bits(runs, least)) if kept is None else None
            kept = lengths[-1], spark.sparkContext.broadcast(_phrase_bits(frequent, lengths[-1], bits)), bits, pairs
    return found, totals


def strength(a: str, n: str, left: str, right: str) -> Column:
    """floor(1000 a n / (l r)) of long columns, exactly; 38 digits hold the products, and the quotient is at most 1000 n / a."""
    whole = "CAST({} AS DECIMAL(19, 0))".format
    return F.expr(f"CAST(1000 AS DECIMAL(4, 0)) * ({whole(a)} * {whole(n)}) DIV ({whole(left)} * {whole(right)})")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, cover: int = 100, top: int = 2000, **limits) -> DataFrame:
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Candidates are phrases of two or more words with ``a >= least`` occurrences. A candidate is cut after each of its words into a
    first part with ``l`` occurrences and a rest with ``r``; the cut with the lowest floor(1000 a n / (l r)) counts, the earliest among equals,
    where ``n`` is the number of words of the language. Candidates inside a longer one with at least ``cover`` percent of their
    occurrences are left out. Order: score and ``a`` descending, phrase ascending by its bytes.
    """
    phrases, totals = frequent_phrases(docs, least, longest, **limits)
    candidates = phrases.where("words >= 2").select("lang", "words", "phrase", F.col("n").alias("a"))
    parts = F.split("phrase", " ")
    # a longer candidate holds both phrases that are one word shorter, and those hold all the others
    inner = F.explode(F.array(F.array_join(F.slice(parts, F.lit(2), F.col("words") - 1), " "), F.array_join(F.slice(parts, F.lit(1), F.col("words") - 1), " ")))
    covered = candidates.where("words > 2").select("lang", inner.alias("phrase"), F.col("a").alias("over")).groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    alone = candidates.join(covered, ["lang", "phrase"], "left").where(F.col("over").isNull() | (100 * F.col("over") < cover * F.col("a")))
    k = F.explode(F.sequence(F.lit(1), F.col("words") - 1))
    cuts = alone.select("lang", "phrase", "a", "words", k.alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice(parts, F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice(parts, F.col("k") + 1, F.col("words")), " ").alias("rest"))
    lookup = phrases.select("lang", "phrase", "n")
    scored = (
        cuts.join(lookup.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
        .join(lookup.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
        .join(totals.withColumnRenamed("total", "n"), "lang")
    )
    lowest = scored.withColumn("score", strength("a", "n", "l", "r")).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = (F.desc("score"), F.desc("a"), F.col("phrase"))
    rows = lowest.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    # the best of each part of a language meet, so the last sort takes a bounded number of rows, however many phrases there are
    part = F.pmod(F.xxhash64("phrase"), F.lit(TOP_PARTS))
    best = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
