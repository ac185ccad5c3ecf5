"""Token ids as flat binary files.

A data set is a folder of parts. Part ``p`` has three files, all little-endian and free of headers: ``p.ids`` holds the ids of
its documents one after the other, as unsigned 16-bit integers where the vocabulary allows it and 32-bit ones otherwise;
``p.off`` holds one 64-bit offset per document and a last one, counted in ids from the start of the part; ``p.doc`` holds the
64-bit document ids, then one byte per document that is 0 where the id is NULL. Parts follow each other in ascending document
id, NULL first; where a part begins in the whole data set is the prefix sum of the ids before it, kept in ``manifest.json``.
Where documents come with a position, as in a training order, ``p.pos`` holds one 64-bit position per document.

Each part is written under a name of its own attempt and moved into place when whole, so a repeated task replaces it with
the same bytes. Files are reached through Arrow's file systems; a local or mounted part is memory-mapped.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "part int, docs long, tokens long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"
READ_ORDER = f"position long, {READ}"


#: Signs that end a word; the pattern of a byte-level tokenizer keeps them apart from its letters.
CLOSING = ".,;:!?"


class PieceMemory(dict):
    """Ids of pieces. One that is asked for and not known is noted in ``missing`` and answered with None.

    When ``most`` are held, all become the former generation; a piece asked for again comes back from it, the others go with
    the next change. So frequent pieces stay and rare ones leave. Memory, not results, depends on ``most``.
    """

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most, self.former, self.missing = most, {}, []

    def peek(self, piece: str) -> bytes | None:
        return self.get(piece) or self.former.get(piece)

    def __missing__(self, piece: str) -> bytes | None:
        ids = self.former.get(piece)
        if ids is None:
            self.missing.append(piece)
        else:
            self[piece] = ids
        return ids

    def add(self, learned: dict[str, bytes]) -> None:
        self.missing.clear()
        if len(self) + len(learned) > self.most:
            self.former = dict(self)
            self.clear()
        self.update(learned)


class PieceEncoder:
    """Encodes texts with a tokenizers file; what lies between single spaces is encoded once and remembered.

    A byte-level tokenizer that splits words by its own pattern never joins a letter or sign with the space after it, and a
    line break between two of them is a token of its own. So the ids of a text are those of its pieces. Other tokenizers, and
    texts in which white space meets white space, go to the library as they are.
    """


    def __init__(self, path: str, end_id: int = 0):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = id_type(max(self.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1))
        about = json.loads(self.tokenizer.to_str())
        split = about.get("pre_tokenizer") or {}
        self.by_piece = (
            split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
            and about.get("normalizer") is None and not about.get("truncation") and not about.get("padding")
        )
        special = [t["content"] for t in about.get("added_tokens", [])]
        self.marks = ["  ", " \n", "\n ", "\n\n", "\x00", *special]
        self.known, self.signs = PieceMemory(), {}
        if self.by_piece:
            # a byte-level token is spelled with one character per byte
            self.widths = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), dtype=np.int64)
            for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
                self.widths[i] = len(token)

    def _divisible(self, text: str) -> bool:
        """Whether all white space is single spaces and line breaks between other characters, and no mark occurs."""
        return (
            text.replace("\n", "").isprintable() and text[0] not in " \n" and text[-1] not in " \n"
            and not any(m in text for m in self.marks)
        )

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Encodes pieces in one text, each after its space or line break, and cuts the ids where pieces end.

        A sign that closes a word is a token of its own, so such pieces are put together from word and sign.
        """
        closed = {p for p in pieces if p[-1] in CLOSING and p[p[0] == "\x00":-1].isalpha()}
        words = {p[:-1] for p in closed}
        known = {p: ids for p in words if (ids := self.known.peek(p))}
        if "\n" in pieces:
            known["\n"] = self._direct(["\n"])[0]
        pieces = list(words.union(pieces).difference(closed, known))
        lots = [pieces[at: at + 500] for at in range(0, len(pieces), 500)]
        spelled = [["\n" + p[1:] if p[0] == "\x00" else " " + p for p in lot] for lot in lots]
        encoded = self.tokenizer.encode_batch_fast(list(map("".join, spelled)), add_special_tokens=False)
        size = self.dtype.itemsize
        for lot, words, found in zip(lots, spelled, encoded):
            ids = np.array(found.ids, dtype=np.int64)
            ends = np.cumsum(self.widths[ids])
            wanted = np.cumsum([len(x) if x.isascii() else len(x.encode("utf-8")) for x in words])
            cuts = np.searchsorted(ends, wanted)
            if not np.array_equal(ends[np.minimum(cuts, len(ends) - 1)], wanted):
                raise ValueError("the tokenizer joins what its pattern should keep apart")
            flat, at = ids.astype(self.dtype).tobytes(), 0
            for p, cut in zip(lot, (cuts + 1).tolist()):
                known[p] = flat[(at + (p[0] == "\x00")) * size: cut * size]
                at = cut
        if closed and not self.signs:
            self.signs = dict(zip(CLOSING, self._direct(list(CLOSING))))
        for p in closed:
            known[p] = known[p[:-1]] + self.signs[p[-1]]
        return known

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        plain, found = [], []
        get, missing = self.known.__getitem__, self.known.missing
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.by_piece or not self._divisible(text):
                out[i] = self._direct([text])[0]
                continue
            before = len(missing)
            ids = list(map(get, ("\x00" + text.replace("\n", " \n \x00")).split(" ")))
            if len(missing) > before:
                plain.append(i)
                found.append((ids, before))
            else:
                out[i] = b"".join(ids)
        if missing:
            learned = self._learn(list(set(missing)))
            for i, (ids, own) in zip(plain, found):
                at, holes = -1, ids.count(None)
                for p in missing[own: own + holes]:
                    at = ids.index(None, at + 1)
                    ids[at] = learned[p]
                out[i] = b"".join(ids)
            self.known.add(learned)
        return out


@lru_cache(maxsize=1)
def encoder_of(path: str, end_id: int) -> PieceEncoder:
    """One encoder a worker process, so that tasks after each other share what it remembers."""
    return PieceEncoder(path, end_id)


def id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


def _bounded(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple[list, list, list]]:
    """Ids, texts and what else comes with them, in lots of about ``most`` characters."""
    ids, texts, rest, size = [], [], [], 0
    for batch in batches:
        others = [c.to_pylist() for c in batch.columns[2:]]
        for i, t, *own in zip(batch.column(0).to_pylist(), batch.column(1), *others):
            t = t.as_py() or ""
            ids.append(i)
            texts.append(t)
            rest += own
            size += len(t)
            if size > most:
                yield ids, texts, rest
                ids, texts, rest, size = [], [], [], 0
    if ids:
        yield ids, texts, rest


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, parts: int | None = None, id_col: str = "doc_id",
    text_col: str = "text", position: Column | None = None,
) -> list[dict]:
    """Writes ``docs`` to the folder ``path``, which every executor must reach, and returns the manifest.

    Each document ends with ``end_id``; NULL and empty texts consist of it alone. Documents with one id, NULL included, stand
    in the order of a hash of their text; equal rows are all written. An empty table gives a manifest without parts.
    ``tokenizer`` names a tokenizers file that every executor has. ``position``, a column without NULL, is kept with each
    document; documents of one id and text stand in its order.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    _, root = _store(path)
    own = [] if position is None else ["position"]
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"),
        *[position.cast("long").alias(c) for c in own],
    )
    rows = rows.repartitionByRange(parts, "doc_id", "tie", *own).sortWithinPartitions("doc_id", "tie", *own).select("doc_id", "text", *own)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(path)
        part = TaskContext.get().partitionId()
        attempt = f"{root}/_attempts/{part:06d}-{uuid.uuid4().hex}"
        encoder, ends, doc_ids, positions, out = None, [0], [], [], None
        for ids, texts, at in _bounded(batches):
            if out is None:
                encoder = encoder_of(tokenizer, end_id)
                end = np.array([end_id], dtype=encoder.dtype).tobytes()
                store.create_dir(f"{root}/_attempts", recursive=True)
                out = store.open_output_stream(attempt + ".ids")
            for encoded in encoder.encode(texts):
                out.write(encoded)
                out.write(end)
                ends.append(ends[-1] + len(encoded) // encoder.dtype.itemsize + 1)
            doc_ids += ids
            positions += at
        if out is None:
            return
        out.close()
        known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
        contents = {
            ".off": np.array(ends, dtype="<u8").tobytes(),
            ".doc": np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes() + known.tobytes(),
        }
        if own:
            contents[".pos"] = np.array(positions, dtype="<i8").tobytes()
        for suffix, content in contents.items():
            with store.open_output_stream(attempt + suffix) as f:
                f.write(content)
        for suffix in (".ids", *contents):
            store.move(attempt + suffix, f"{root}/{part:06d}{suffix}")
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "docs": pa.array([len(doc_ids)], pa.int64()), "tokens": pa.array([ends[-1]], pa.int64()),
        })

    dtype = PieceEncoder(tokenizer, end_id).dtype
    found = sorted((r.asDict() for r in rows.mapInArrow(write, MANIFEST).collect()), key=lambda r: r["part"])
    base = 0
    for r in found:
        r |= {"base": base, "dtype": dtype.str, "placed": bool(own)}
        base += r["tokens"]
    store, _ = _store(path)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(found).encode())
    return found


class TokenPart:
    """One part, opened for reading: ``ids`` of document ``i`` are ``part[i]``."""

    def __init__(self, path: str, entry: dict):
        store, root = _store(path)
        stem = f"{root}/{entry['part']:06d}"

        def flat(suffix: str, dtype: str, count: int, offset: int = 0) -> np.ndarray:
            if isinstance(store, fs.LocalFileSystem):
                return np.memmap(stem + suffix, dtype=dtype, mode="r", offset=offset, shape=(count,))
            with store.open_input_file(stem + suffix) as f:
                return np.frombuffer(f.read_at(count * np.dtype(dtype).itemsize, offset), dtype=dtype)

        n = entry["docs"]
        self.base = entry["base"]
        self.offsets = flat(".off", "<u8", n + 1)
        self.doc_ids = flat(".doc", "<i8", n)
        self.known = flat(".doc", "u1", n, 8 * n)
        self.ids = flat(".ids", entry["dtype"], entry["tokens"])
        self.positions = flat(".pos", "<i8", n) if entry.get("placed") else None

    def __len__(self) -> int:
        return len(self.doc_ids)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[int(self.offsets[i]): int(self.offsets[i + 1])]


def _read(spark: SparkSession, path: str, placed: bool) -> DataFrame:
    store, root = _store(path)
    with store.open_input_stream(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    schema = READ_ORDER if placed else READ
    if not manifest:
        return spark.createDataFrame([], schema)
    if placed and not all(entry.get("placed") for entry in manifest):
        raise ValueError(f"the documents in {path} were written without positions")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                part = TokenPart(path, manifest[k])
                for at in range(0, len(part), 10_000):
                    some = range(at, min(at + 10_000, len(part)))
                    offsets = part.offsets[at: some.stop + 1].astype(np.int64)
                    cols = {"position": pa.array(part.positions[at: some.stop], pa.int64())} if placed else {}
                    yield pa.RecordBatch.from_pydict(cols | {
                        "doc_id": pa.array(part.doc_ids[at: some.stop], pa.int64(), mask=part.known[at: some.stop] == 0),
                        "start": pa.array(offsets[:-1] + part.base, pa.int64()),
                        "n_tokens": pa.array(np.diff(offsets), pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(part[i].astype("<u4").tobytes()) for i in some], pa.int64()),
                    })

    return spark.range(0, len(manifest), 1, len(manifest)).mapInArrow(read, schema)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the folder, ``start`` counted over the whole data set.

    ``ids_crc32`` is the checksum of the document's ids as little-endian 32-bit integers.
    """
    return _read(spark, path, False)


def read_in_order(spark: SparkSession, path: str) -> DataFrame:
    """``position`` and the columns of ``read_token_files``, range-sorted by position; needs files written with positions."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return _read(spark, path, True).repartitionByRange(parts, "position").sortWithinPartitions("position")
