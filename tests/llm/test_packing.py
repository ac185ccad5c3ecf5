"""Packing by powers of two: every id in one piece, no padding, files that read back."""

from zlib import crc32

import numpy as np
import pytest
from tokenizers import Tokenizer

from brookcal.llm import packing, queries
from brookcal.session import scratch_path


def test_lengths_are_powers_of_two():
    assert packing.lengths_of(8) == [8, 4, 2, 1]
    assert packing.decompose(np.array([1, 8, 21, 7]), [8, 4, 2, 1]).tolist() == [[0, 0, 0, 1], [1, 0, 0, 0], [2, 1, 0, 1], [0, 1, 1, 1]]
    for wrong in (0, 12, -4):
        with pytest.raises(ValueError, match="power of two"):
            packing.lengths_of(wrong)


def whole(pieces: list, texts: list, most: int, end: int) -> None:
    """Compares the pieces with the ids of the library, document by document."""
    library = Tokenizer.from_file(queries.tokenizer_path())
    want = {}
    for d, t in texts:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, end], dtype="<u4")
        cuts, at = [], 0
        for length in [most] * (len(ids) // most) + [1 << k for k in range(40, -1, -1) if len(ids) % most >> k & 1]:
            cuts.append((at, length, crc32(ids[at: at + length].tobytes()), len(ids)))
            at += length
        assert at == len(ids)
        want.setdefault(d, []).extend(cuts)
    got = {}
    for r in pieces:
        got.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        assert r["offset"] == 0 and r["length"] & (r["length"] - 1) == 0 and r["length"] <= most
    assert {d: sorted(x) for d, x in got.items()} == {d: sorted(x) for d, x in want.items()}
    # gapless, and longer sequences come first
    numbered = sorted(pieces, key=lambda r: r["sequence_id"])
    assert [r["sequence_id"] for r in numbered] == list(range(len(pieces)))
    assert [r["length"] for r in numbered] == sorted((r["length"] for r in pieces), reverse=True)


@pytest.mark.parametrize("most,end", [(1024, 0), (16, 70_000)])
def test_every_id_lies_in_one_piece(spark, odd, most, end):
    path = scratch_path(spark, "packed")
    docs = odd.repartition(3)
    manifest = packing.write_packed(docs, path, queries.tokenizer_path(), end, most)
    whole(packing.read_pieces(spark, path).collect(), [(r["doc_id"], r["text"]) for r in odd.collect()], most, end)
    lengths = packing.lengths_of(most)
    for entry in manifest:
        part = packing.PackedPart(path, lengths, entry)
        for length, n in zip(lengths, entry["counts"]):
            assert part.sequences(length).shape == (n, length)


def test_query(spark):
    d = "/root/testdata/sf0.001"
    got = queries.op12_packing(spark, d)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert {t for _, t in got.dtypes} == {"bigint"}
    whole(got.collect(), [(r["doc_id"], r["text"]) for r in queries.table(spark, d, "documents").collect()], 1024, 0)


def test_no_documents(spark, none):
    path = scratch_path(spark, "packed")
    assert packing.write_packed(none, path, queries.tokenizer_path()) == []
    assert packing.read_pieces(spark, path).count() == 0
