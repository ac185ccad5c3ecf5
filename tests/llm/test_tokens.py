"""Token files: exact round trips."""

import random
from zlib import crc32

import numpy as np
import pytest
from tokenizers import Tokenizer

from brookcal.llm import queries, token_files
from brookcal.session import scratch_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.tokenizer_path())


def test_pieces_give_the_ids_of_the_whole(library):
    rng = random.Random(1)
    alphabet = ["a", "B", "'s", "'", "1", "23", " ", "\n", "\t", ".", ",", "é", " ", "\x00", "\x1c", "\x85", "日", " ", "\U0001f600", "\r", "-", "_", "​", "́", "'ll", "½", "<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(20_000)]
    encoder = token_files.PieceEncoder(queries.tokenizer_path())
    assert encoder.by_piece and encoder.dtype == np.dtype("<u2")
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, dtype="<u2").tolist() for x in encoder.encode(texts)] == want


def test_round_trip(spark, odd, documents, library):
    for docs, end in ((odd, 0), (documents, 70_000)):
        path = scratch_path(spark, "tokens")
        manifest = token_files.write_token_files(docs, path, queries.tokenizer_path(), end, parts=5)
        got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r["start"])
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        assert len(got) == len(rows)
        known = [r["doc_id"] for r in got]
        assert known == sorted(known, key=lambda d: (d is not None, d or 0))
        want = {}
        for d, t in rows:
            ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, end], dtype="<u4")
            want.setdefault(d, []).append((len(ids), crc32(ids.tobytes())))
        mine, at = {}, 0
        for r in got:
            assert r["start"] == at
            at += r["n_tokens"]
            mine.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
        assert {d: sorted(x) for d, x in mine.items()} == {d: sorted(x) for d, x in want.items()}
        assert sum(p["tokens"] for p in manifest) == at
        part = token_files.TokenPart(path, manifest[0])
        assert isinstance(part.ids, np.memmap) and part[0][-1] == end


def test_no_documents(spark, none):
    path = scratch_path(spark, "tokens")
    assert token_files.write_token_files(none, path, queries.tokenizer_path()) == []
    assert token_files.read_token_files(spark, path).count() == 0


def test_pieces_are_forgotten_and_learned_again(library):
    rng = random.Random(2)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) + rng.choice(["", ".", ",", "!?", "'s", "\n"]) for _ in range(40)).rstrip("\n") for _ in range(400)]
    texts = [t.replace("\n ", "\n") for t in texts]
    encoder = token_files.PieceEncoder(queries.tokenizer_path())
    encoder.known.most = 50
    got = [x for at in range(0, 400, 7) for x in encoder.encode(texts[at: at + 7])]
    assert [np.frombuffer(x, dtype="<u2").tolist() for x in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert encoder.known.former
