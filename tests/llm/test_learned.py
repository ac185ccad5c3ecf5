"""Language, secrets and toxicity: held-out accuracy, gradients, and properties."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from brookcal.llm import language, queries, secrets, toxicity

SF = "/root/testdata/sf0.01"


def test_language_on_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = queries.op5_language(spark, SF).where("held_out").join(docs, "doc_id").select("lang", "lang_pred", "score").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_of_odd_rows(odd, none):
    model = language.train(odd, F.lit(True))
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(odd, model).collect()}
    assert {got[4], got[5], got[6], got[9]} == {"und"} and got[7] == "fr"
    assert language.identify(odd, model).count() == odd.count()
    empty = language.train(none, F.lit(True))
    assert {r["lang_pred"] for r in language.identify(odd, empty).collect()} == {"und"}


def test_ngram_counts_do_not_depend_on_chunks(monkeypatch):
    text = "Één lange tekst 123 with Ünicode, " * 20
    whole = language.ngram_counts(text)
    monkeypatch.setattr(language, "CHUNK", 7)
    assert (language.ngram_counts(text) == whole).all()
    assert language.ngram_counts("12 .. 3 45 67 89 ..") is None
    late = "1234 .. 567 89 Één"
    split = language.ngram_counts(late)
    monkeypatch.setattr(language, "CHUNK", 1 << 20)
    assert (language.ngram_counts(late) == split).all()


def brute_spans(text):
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    for kind, pattern, least in ((1, r"AKIA[A-Z0-9]+", 18), (2, r"[0-9a-f]+", 16)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(out)


def test_fixed_formats():
    rng = random.Random(1)
    parts = ["password", "Token", "API_KEY", "apikey", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH12345678", "0123abcd", "deadbeefdeadbeef", "xyz.", "é", "\n", "ſecret", "toKen"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [s[:3] for s in secrets.base_spans(text)] == brute_spans(text)


def test_secrets_of_every_row(odd, none, documents):
    for docs in (odd, documents):
        texts = sorted((d is None, d, t or "") for d, t in docs.select("doc_id", "text").collect())
        got = secrets.find_secrets(docs).collect()
        assert len(got) == len(texts)
        base = lambda spans: [(s["start"], s["kind"], s["stop"]) for s in spans if s["kind"] < 3]
        want = sorted((n, d, brute_spans(t)) for n, d, t in texts)
        assert sorted((r["doc_id"] is None, r["doc_id"], base(r["spans"])) for r in got) == want
    assert secrets.find_secrets(none).count() == 0


def test_learned_formats_find_unlabelled_credentials(spark):
    """Values of the learned shape without their keyword are found, ordinary identifiers are not."""
    rng = random.Random(2)
    value = lambda: "sk" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(24))
    plain = lambda: rng.choice(["release-candidate-", "customer_number_", "chapter-heading-"]) + str(rng.randint(1, 99))
    rows = [(i, f"see token={value()} here") for i in range(200)] + [(1000 + i, f"and {plain()} too") for i in range(200)]
    rows += [(2000 + i, f"then {value()} alone") for i in range(40)]
    got = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all([s["kind"] for s in got[i]] == [0] for i in range(200))
    assert not any(got[1000 + i] for i in range(200))
    found = [i for i in range(40) if [(s["kind"], s["start"], s["stop"]) for s in got[2000 + i]] == [(3, 5, 31)]]
    assert len(found) >= 32


def test_every_run_is_a_candidate():
    text = "abcdefghijkl, 123456789012 aa.bb.ccddee.ff q0123456789abcdefQ 0123456789abcdef token = abcdefghijklmn"
    found = secrets.candidates(text, secrets.base_spans(text))
    assert [w for _, w in found] == ["abcdefghijkl", "123456789012", "aa.bb.ccddee.ff", "q0123456789abcdefQ"]
    assert all(text[a: a + len(w)] == w for a, w in found)


@pytest.mark.parametrize("form", ["A" * 14, "9" * 14, "sA9A9A.sA9A.9A9A9A", "A99hhhhhhhhhhhhhhhhhhA99"])
def test_unlabelled_credentials_of_any_form(spark, form):
    """Short ones, letters or digits only, dotted ones and those around a fixed format."""
    rng = random.Random(3)
    some = {"A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "9": "0123456789", "h": "0123456789abcdef"}
    value = lambda: "".join(rng.choice(some.get(c, c)) for c in form)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(12, 18)))
    rows = [(i, f"see token={value()} here") for i in range(200)] + [(1000 + i, f"and {word()} or {word()}. Too") for i in range(200)]
    rows += [(2000 + i, f"then {value()} alone") for i in range(40)] + [(3000 + i, f"then {value()}.") for i in range(40)]
    got = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(got[1000 + i] for i in range(200))
    learned = {i: [(s["start"], s["stop"]) for s in x if s["kind"] == 3] for i, x in got.items()}
    assert sum(learned[2000 + i] == [(5, 5 + len(form))] for i in range(40)) >= 32
    if "." not in form:
        assert sum(any(a == 5 and b >= 5 + len(form) for a, b in learned[3000 + i]) for i in range(40)) >= 32


def test_long_credentials_are_learned_whole(spark):
    """Credentials with 64 characters in common are as many as they are, and each ends where it ends."""
    rng = random.Random(4)
    head = "ey" + "Q" * 62
    value = lambda: head + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(24))
    rows = [(i, f"see token={value()} here") for i in range(60)] + [(2000 + i, f"then {value()} alone") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(docs).collect()}
    found = [i for i in range(40) if [(s["kind"], s["start"], s["stop"]) for s in got[2000 + i]] == [(3, 5, 5 + 88)]]
    assert len(found) >= 28
    automaton = secrets.Automaton.infer([value() for _ in range(30)])
    assert sum(sum(t.values()) for t in automaton.through) == 30 * 88


def test_long_numbers_are_no_credentials(spark):
    """Learned from hexadecimal credentials of two lengths: others like them are found, dates, order and card numbers are not."""
    rng = random.Random(6)
    value = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 40]))).upper()
    numbers = [lambda: f"2026{rng.randint(1, 12):02}{rng.randint(1, 28):02}{rng.randint(0, 2359):04}", lambda: str(rng.randint(10 ** 12, 10 ** 16)),
               lambda: f"40128888888818{rng.randint(10, 99)}", lambda: f"ABCDEF{rng.randint(100000, 999999)}"]
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(12, 18)))
    rows = [(i, f"see token={value()} here") for i in range(300)] + [(1000 + i, f"and {word()} or {word()}. Too") for i in range(300)]
    rows += [(2000 + i, f"then {value()} alone") for i in range(100)] + [(3000 + i, f"order {numbers[i % 4]()} of") for i in range(100)]
    got = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum([(s["start"], s["kind"]) for s in got[2000 + i]] == [(5, 3)] for i in range(100))
    wrong = sum(any(s["kind"] == 3 for s in got[i]) for i in [*range(1000, 1300), *range(3000, 3100)])
    assert found >= 90 and wrong <= found // 10
    # where no candidate is a number, length and end still tell
    few = secrets.Formats([secrets.Automaton.infer([value() for _ in range(200)])], secrets.Background({"^g": 500, "gg": 6000, "g$": 500}))
    few.calibrate([[value() for _ in range(200)]])
    assert sum(few.accepts(value()) for _ in range(100)) >= 85
    assert not any(few.accepts(w) for w in ("202612020321", "4012888888881881", "ABCDEF012345"))


def test_automaton_merges_states():
    rng = random.Random(5)
    words = ["AK" + "".join(rng.choice("0123456789abcdef") for _ in range(20)) for _ in range(200)]
    automaton = secrets.Automaton.infer(words)
    assert len(automaton.edges) < 60
    assert automaton.log_likelihood(words[0]) > automaton.log_likelihood("release-candidate-name")
    assert sum(automaton.ends) == len(words)


def test_gradients():
    rng = np.random.default_rng(0)
    model = toxicity.ToxicityModel({"a": 1, "bb": 2, "idiot": 3}, np.array([0, 0, 1.0, 2.0]))
    for k in model.p:
        model.p[k] = model.p[k].astype(np.float64)
    model.telling = model.telling.astype(np.float64)
    words = "a bb ccc dd idiot e ff gg".split() * 3
    spans, y, weights = [(0, 5), (3, 12), (10, 11)], np.array([1.0, 0, 1]), np.array([1.0, 2, 1])

    def loss():
        distinct = list(dict.fromkeys(words))
        places = {w: i for i, w in enumerate(distinct)}
        x = model.logits(model._features(distinct), np.array([places[w] for w in words]), spans)
        return float(((np.logaddexp(0, x) - y * x) * weights).sum() / weights.sum())

    found = model.gradients(words, spans, y, weights)
    for k, p in model.p.items():
        at = (3, 2) if k == "word" else (int(model.word_parts(["idiot"])[1][0]), 1) if k == "char" else tuple(rng.integers(0, n) for n in p.shape)
        p[at] += 1e-5
        above = loss()
        p[at] -= 2e-5
        below = loss()
        p[at] += 1e-5
        assert found[k][at] == pytest.approx((above - below) / 2e-5, rel=1e-2, abs=1e-7), k


def test_toxicity_finds_held_out_texts(monkeypatch):
    monkeypatch.setattr(toxicity, "VOCABULARY", 500)
    rng = random.Random(7)
    common = ["alpha", "river", "stone", "cloud", "green", "paper", "north", "music", "table", "light"]
    rude = ["idiot", "scum", "moron"]

    def text(toxic):
        words = [rng.choice(common) + rng.choice(["", ",", "."]) for _ in range(rng.randint(5, 300))]
        for _ in range(3 * toxic):
            words.insert(rng.randint(0, len(words)), rng.choice(rude).upper() + "!")
        return " ".join(words)

    labels = [int(i % 4 == 0) for i in range(300)]
    model = toxicity.fit([text(y) for y in labels], labels, steps=60, passes=4)
    held = [int(i % 4 == 0) for i in range(100)]
    scores = [model.score(x) for x in model.best_logits([toxicity.words_of(text(y)) for y in held])]
    assert np.mean([(s >= 0.5) == bool(y) for s, y in zip(scores, held)]) > 0.95
    # texts alone or together, the score is the same
    texts = [toxicity.words_of(text(i % 2)) for i in range(6)]
    alone = [model.best_logits([t])[0] for t in texts]
    assert model.best_logits(texts) == pytest.approx(alone, abs=1e-4)


@pytest.mark.parametrize("letters", [[chr(c) for c in range(0x4E00, 0x4E80)], list("abcdefghijklmnopqrstuvwxyz")])
def test_toxic_passage_in_a_long_unspaced_text(letters):
    rng = random.Random(11)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 6))) for _ in range(33)]
    common, rude = words[:30], words[30:]

    def text(toxic, size):
        some = [rng.choice(common) for _ in range(size)]
        if toxic:
            at = rng.randint(0, size)
            some[at:at] = rude
        return "".join(some)

    labels = [int(i % 2 == 0) for i in range(200)]
    model = toxicity.fit([text(y, rng.randint(15, 100)) for y in labels], labels, steps=60, passes=4)
    held = [i % 2 for i in range(40)]
    scores = [model.score(x) for x in model.best_logits([toxicity.words_of(text(y, 1000)) for y in held])]
    assert np.mean([(s >= 0.5) == bool(y) for s, y in zip(scores, held)]) > 0.9


def test_long_words_are_cut():
    assert toxicity.words_of("One " + "x" * 48 + " two") == ["one", "x" * 48, "two"]
    assert toxicity.words_of("a" + "bc" * 24 + " d") == ["abc", *["bcb", "cbc"] * 23, "d"]
    assert toxicity.words_of("\u4f60\u597d\u5417\u54e6 ok") == ["\u4f60\u597d\u5417", "\u597d\u5417\u54e6", "ok"]
    assert toxicity.words_of("x" * 50_000) == ["xxx"]


def test_windows_cover_everything():
    for n in (0, 1, 63, 64, 65, 111, 112, 113, 1000):
        spans = toxicity.windows_of(n)
        assert set().union(*[range(a, b) for a, b in spans]) == set(range(n))
        assert all(b - a <= toxicity.WINDOW for a, b in spans)


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (7, 0), (8, None), (10, 0), (None, 1), (11, 0), (11, 1)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels, F.lit(True))
    got = toxicity.score_toxicity(odd, model, keep=tuple(odd.columns)).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["score"] == 0 for r in got if r["doc_id"] in (4, 5, 6))
    assert toxicity.train(odd, labels.limit(0), F.lit(True)) is None
    assert toxicity.score_toxicity(none, model).count() == 0
