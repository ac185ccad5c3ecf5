"""Packing by powers of two: documents are cut into pieces of binary length and pieces of one length share a bucket.

A document of ``n`` ids gives ``n // most`` pieces of ``most`` ids and one piece for each bit of the rest, longest first. Every
piece is a sequence of its own, so no sequence crosses documents and none is padded.

A data set is a folder of parts, one for each task that encoded texts. A part has one file for each length, ``stem.L.ids``, in
which sequence ``i`` begins at byte ``i * L * width`` (little-endian unsigned ids, 16 bits where the vocabulary allows it), and
``stem.doc`` with the 64-bit document ids, the 64-bit counts of their ids and one byte a document that is 0 where the document
id is NULL. Sequences are numbered by length, longest first, then by part and place; where a part begins in a bucket is the
prefix sum of the parts before it. The manifest names the files of the attempt that was counted, so files that a lost or doubled
task left behind are never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookcal.llm.token_files import _bounded, _store, encoder_of

MANIFEST = "part int, stem string, dtype string, docs long, counts array<long>"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def lengths_of(most: int) -> list[int]:
    """The powers of two from ``most`` down to 1."""
    if most < 1 or most & (most - 1):
        raise ValueError(f"the longest sequence must be a power of two, not {most}")
    return [1 << k for k in range(most.bit_length() - 1, -1, -1)]


def decompose(tokens: np.ndarray, lengths: list[int]) -> np.ndarray:
    """How many pieces of each length a document of so many ids gives, one row a document."""
    tokens = np.asarray(tokens, dtype=np.int64)[:, None]
    bits = (tokens % lengths[0]) // np.array(lengths, dtype=np.int64) % 2
    return np.where(np.arange(len(lengths)) == 0, tokens // lengths[0], bits)


def write_packed(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, most: int = 1024, id_col: str = "doc_id", text_col: str = "text",
) -> list[dict]:
    """Encodes ``docs`` where they are read, writes their pieces to the folder ``path`` and returns the manifest.

    Nothing is shuffled: texts stay in the task that scans them and only one row a task goes to the driver. Each document ends
    with ``end_id``; NULL and empty texts consist of it alone; equal rows are all packed, rows with a NULL id too. Other columns
    are not read. An empty table gives a manifest without parts. Every executor must reach ``path`` and has the file ``tokenizer``.
    """
    lengths = lengths_of(most)
    _, root = _store(path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(path)
        part = TaskContext.get().partitionId()
        stem = f"{part:06d}-{uuid.uuid4().hex}"
        streams: dict[int, object] = {}
        counts, doc_ids, tokens, encoder = np.zeros(len(lengths), dtype=np.int64), [], [], None
        for ids, texts, _ in _bounded(batches):
            if encoder is None:
                encoder = encoder_of(tokenizer, end_id)
                end, width = np.array([end_id], dtype=encoder.dtype).tobytes(), encoder.dtype.itemsize
                store.create_dir(root, recursive=True)
            encoded = [x + end for x in encoder.encode(texts)]
            sizes = [len(x) // width for x in encoded]
            split = decompose(np.array(sizes), lengths)
            lots: list[list[bytes]] = [[] for _ in lengths]
            for x, own in zip(encoded, split.tolist()):
                at = 0
                for lot, length, n in zip(lots, lengths, own):
                    if n:
                        step = n * length * width
                        lot.append(x[at: at + step])
                        at += step
            for length, lot in zip(lengths, lots):
                if lot:
                    if length not in streams:
                        streams[length] = store.open_output_stream(f"{root}/{stem}.{length}.ids")
                    streams[length].write(b"".join(lot))
            counts += split.sum(axis=0)
            doc_ids += ids
            tokens += sizes
        if encoder is None:
            return
        for out in streams.values():
            out.close()
        known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
        with store.open_output_stream(f"{root}/{stem}.doc") as out:
            out.write(np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes() + np.array(tokens, dtype="<i8").tobytes() + known.tobytes())
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "stem": pa.array([stem]), "dtype": pa.array([encoder.dtype.str]),
            "docs": pa.array([len(doc_ids)], pa.int64()), "counts": pa.array([counts.tolist()], pa.list_(pa.int64())),
        })

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = sorted((r.asDict() for r in rows.mapInArrow(write, MANIFEST).collect()), key=lambda r: r["part"])
    base = 0
    for k, length in enumerate(lengths):
        for r in found:
            r.setdefault("bases", []).append(base)
            base += r["counts"][k]
    store, _ = _store(path)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps({"lengths": lengths, "parts": found}).encode())
    return found


class PackedPart:
    """One part, opened for reading: ``sequences(length)`` is a matrix with one sequence a row."""

    def __init__(self, path: str, lengths: list[int], entry: dict):
        self.store, root = _store(path)
        self.stem, self.lengths, self.entry = f"{root}/{entry['stem']}", lengths, entry
        n = entry["docs"]
        head = self._flat(".doc", "<i8", 2 * n, 0)
        self.doc_ids, self.tokens = head[:n], head[n:]
        self.known = self._flat(".doc", "u1", n, 16 * n)

    def _flat(self, suffix: str, dtype: str, count: int, offset: int) -> np.ndarray:
        if not count:
            return np.zeros(0, dtype=dtype)
        if isinstance(self.store, fs.LocalFileSystem):
            return np.memmap(self.stem + suffix, dtype=dtype, mode="r", offset=offset, shape=(count,))
        with self.store.open_input_file(self.stem + suffix) as f:
            return np.frombuffer(f.read_at(count * np.dtype(dtype).itemsize, offset), dtype=dtype)

    def sequences(self, length: int, first: int = 0, stop: int | None = None) -> np.ndarray:
        stop = self.entry["counts"][self.lengths.index(length)] if stop is None else stop
        dtype = self.entry["dtype"]
        return self._flat(f".{length}.ids", dtype, (stop - first) * length, first * length * np.dtype(dtype).itemsize).reshape(-1, length)

    def pieces(self, at: int, stop: int, slots: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """The pieces of documents ``at`` to ``stop``, and ``slots`` moved on: how many sequences of each length came before."""
        split = decompose(self.tokens[at:stop], self.lengths)
        docs, levels = np.nonzero(split)
        many = split[docs, levels]
        before = slots + np.cumsum(split, axis=0) - split
        inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        docs, levels, slot = np.repeat(docs, many), np.repeat(levels, many), np.repeat(before[docs, levels], many) + inside
        length = np.array(self.lengths, dtype=np.int64)[levels]
        ends = np.cumsum(length)
        own = np.searchsorted(docs, np.arange(stop - at))
        start = ends - length - (ends - length)[own][docs]
        crcs = np.zeros(len(docs), dtype=np.int64)
        for k, size in enumerate(self.lengths):
            mine = np.nonzero(levels == k)[0]
            if len(mine):
                flat = self.sequences(size, int(slots[k]), int(slots[k]) + len(mine)).astype("<u4")
                crcs[mine] = [crc32(row) for row in flat]
        cols = {
            "doc": docs + at, "start": start, "length": length, "ids_crc32": crcs,
            "sequence_id": np.array(self.entry["bases"], dtype=np.int64)[levels] + slot,
        }
        return cols, slots + split.sum(axis=0)


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """One row a piece, read back from the files: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``ids_crc32`` is the checksum of the piece's ids as little-endian 32-bit integers. ``offset`` is the piece's place in its
    sequence, which is 0, since a sequence holds one piece.
    """
    store, root = _store(path)
    with store.open_input_stream(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    lengths, parts = manifest["lengths"], manifest["parts"]
    if not parts:
        return spark.createDataFrame([], PIECES)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entry in batch.to_pylist():
                part, slots = PackedPart(path, lengths, entry), np.zeros(len(lengths), dtype=np.int64)
                for at in range(0, entry["docs"], 2_000):
                    found, slots = part.pieces(at, min(at + 2_000, entry["docs"]), slots)
                    doc = found.pop("doc")
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(part.doc_ids[doc], pa.int64(), mask=part.known[doc] == 0),
                        **{c: pa.array(found[c]) for c in ("start", "length", "ids_crc32")},
                        "doc_tokens": pa.array(part.tokens[doc].astype(np.int64)), "sequence_id": pa.array(found["sequence_id"]),
                        "offset": pa.array(np.zeros(len(doc), dtype=np.int64)),
                    })

    rows = spark.createDataFrame(parts, MANIFEST + ", bases array<long>")
    return rows.repartition(len(parts), "part").mapInArrow(read, PIECES)
