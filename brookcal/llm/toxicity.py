"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word comes in as a learned vector (frequent training words), the mean of learned vectors of its character trigrams, and how
much more often it stands in toxic training texts. Texts are read in overlapping windows of 64 words; a window's states are
pooled by attention into a logit, and the largest logit of all windows, calibrated, is the score of the text. Words of scripts
without spaces, and other words above 48 letters, come in as their overlapping pieces of three, each a word. Labels belong to
whole texts, so training picks the windows: first those with the most telling words, later those the network scores highest.

The fit uses at most ``per_class`` labelled texts of each class, chosen by hash; the ids are broadcast, the texts found where
they lie. Everything is scored whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, STRIDE = 64, 48
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 8, 8, 12, 8
TRIGRAMS = 4096
VOCABULARY = 20_000
#: A word needs one in ``RARE`` training texts, from 4 to 12 of them, for a vector of its own.
RARE, FEWEST, MOST_NEEDED = 100, 4, 12
#: Log ratios up to this size are taken for chance.
CHANCE = 1.5
PER_CLASS = 1_200
REMEMBERED = 150_000
#: Windows that are scored together.
BATCH = 512
#: Shrinking of word and trigram vectors per unit of learning rate.
DECAY = 1.0
#: Longer words are cut, and so are those of more than one piece in scripts that put no space between words.
LONGEST, PIECE = 48, 3
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_EDGE = ".,;:!?\"'()[]{}<>*-_"


def _pieces(words: list[str]) -> Iterator[str]:
    """The words, with the cut ones as overlapping pieces that begin at each letter."""
    known: dict[str, str] = {}  # one object for equal pieces
    for w in words:
        if len(w) > LONGEST or len(w) > PIECE and _UNSPACED.search(w):
            for a in range(len(w) - PIECE + 1):
                piece = w[a: a + PIECE]
                yield known.setdefault(piece, piece)
        else:
            yield w


def words_of(text: str | None) -> list[str]:
    """Lower-case words; a word repeated in place counts once, so that a run of it weighs no more than the word."""
    return [w for w, _ in groupby(_pieces(text.lower().split()))] if text else []


def windows_of(n: int) -> list[tuple[int, int]]:
    """Overlapping windows that cover ``n`` words."""
    last = max(0, n - WINDOW)
    return [(a, min(n, a + WINDOW)) for a in [*range(0, last, STRIDE), last]] if n else []


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _forward(inputs: np.ndarray, u: np.ndarray, active: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (time, window, unit); windows are sorted by falling length, ``active[t]`` of them have a word ``t``."""
    steps, count, _ = inputs.shape
    h = np.zeros((count, HIDDEN), dtype=inputs.dtype)
    states = np.zeros((steps, count, HIDDEN), dtype=inputs.dtype)
    for t in range(steps):
        n = active[t]
        before = h[:n].copy() if keep is not None else h[:n]
        g = before @ u
        gates = _sigmoid(inputs[t, :n, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        c = np.tanh(inputs[t, :n, 2 * HIDDEN:] + r * g[:, 2 * HIDDEN:])
        new = c + z * (before - c)
        if keep is not None:
            keep.append((before, z, r, c, g[:, 2 * HIDDEN:]))
        h[:n] = new
        states[t, :n] = new
    return states


def _backward(d_states: np.ndarray, u: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the inputs and of ``u``."""
    steps, count, _ = d_states.shape
    d_inputs = np.zeros((steps, count, 3 * HIDDEN), dtype=d_states.dtype)
    du = np.zeros_like(u)
    dh = np.zeros((count, HIDDEN), dtype=d_states.dtype)
    for t in range(steps - 1, -1, -1):
        before, z, r, c, gc = kept[t]
        n = len(before)
        d = dh[:n] + d_states[t, :n]
        dc = d * (1 - z) * (1 - c * c)
        dz = d * (before - c) * z * (1 - z)
        dr = dc * gc * r * (1 - r)
        dg = np.concatenate((dz, dr, dc * r), axis=1)
        d_inputs[t, :n] = np.concatenate((dz, dr, dc), axis=1)
        du += before.T @ dg
        dh[:n] = d * z + dg @ u.T
    return d_inputs, du


class ToxicityModel:
    """Parameters, word features and scoring. Instances travel to the executors as a broadcast of fixed size."""

    def __init__(self, vocabulary: dict[str, int], telling: np.ndarray, seed: int = 3):
        random = np.random.default_rng(seed)

        def start(*shape: int, scale: float) -> np.ndarray:
            return random.normal(0, scale, shape).astype(np.float32)

        width = WORD_DIM + CHAR_DIM + 1
        self.vocabulary, self.telling = vocabulary, telling.astype(np.float32)
        self.p = {
            "word": start(len(vocabulary) + 1, WORD_DIM, scale=0.1), "char": start(TRIGRAMS, CHAR_DIM, scale=0.1),
            "wf": start(width, 3 * HIDDEN, scale=0.3), "wb": start(width, 3 * HIDDEN, scale=0.3),
            "uf": start(HIDDEN, 3 * HIDDEN, scale=0.2), "ub": start(HIDDEN, 3 * HIDDEN, scale=0.2),
            "bf": np.zeros(3 * HIDDEN, np.float32), "bb": np.zeros(3 * HIDDEN, np.float32),
            "a": start(2 * HIDDEN, ATTENTION, scale=0.3), "ab": np.zeros(ATTENTION, np.float32),
            "v": start(ATTENTION, scale=0.3), "w": start(2 * HIDDEN, scale=0.3), "b": np.zeros(1, np.float32),
        }
        self.p["word"][0] = 0
        self.slope, self.shift = 1.0, 0.0
        self._forget()

    def _forget(self) -> None:
        self._rows: dict[str, int] = {}
        self._table = np.zeros((1024, WORD_DIM + CHAR_DIM + 1), dtype=np.float32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_rows", "_table")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._forget()

    def word_parts(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vocabulary number of each word, its trigram slots one after the other, and where each word's slots begin."""
        bare = [w.strip(_EDGE) or w for w in words]
        number = np.array([self.vocabulary.get(w, 0) for w in bare], dtype=np.int64)
        joined = "".join(["\x02" + w + "\x03" for w in bare])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        h = (points[:-2] * np.uint32(0x9E3779B1)) ^ (points[1:-1] * np.uint32(0x85EBCA77)) ^ (points[2:] * np.uint32(0xC2B2AE3D))
        slots = ((h ^ (h >> np.uint32(13))) * np.uint32(0x27D4EB2F) >> np.uint32(20)).astype(np.int64)
        sizes = np.array([len(w) for w in bare])  # a word of n letters has n trigrams with its edges
        begins = np.cumsum(sizes + 2) - (sizes + 2)
        inside = np.ones(len(slots), dtype=bool)
        inside[(begins[1:] - 1)] = False
        inside[(begins[1:] - 2)] = False
        return number, slots[inside], np.cumsum(sizes) - sizes

    def _features(self, words: list[str]) -> np.ndarray:
        number, slots, begins = self.word_parts(words)
        sizes = np.diff(np.append(begins, len(slots)))[:, None]
        return np.concatenate((
            self.p["word"][number], np.add.reduceat(self.p["char"][slots], begins, axis=0) / sizes, self.telling[number][:, None],
        ), axis=1)

    def rows_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Features of the distinct words of a text or lot of texts, and the place of each word among them."""
        distinct = list(set(words))
        if len(self._rows) + len(distinct) > REMEMBERED:
            self._forget()
        new = [w for w in distinct if w not in self._rows]
        if new:
            at = len(self._rows)
            if at + len(new) > len(self._table):
                self._table = np.concatenate((self._table, np.zeros((max(len(self._table), len(new)), self._table.shape[1]), np.float32)))
            self._table[at: at + len(new)] = self._features(new)
            self._rows.update(zip(new, range(at, at + len(new))))
        places = {w: i for i, w in enumerate(distinct)}
        table = self._table[[self._rows[w] for w in distinct]]
        return table, np.fromiter(map(places.__getitem__, words), dtype=np.int64, count=len(words))

    @staticmethod
    def _layout(index: np.ndarray, spans: list[tuple[int, int]]):
        """Windows by falling length: order, word places forth and back, active counts, lengths."""
        sizes = np.array([b - a for a, b in spans])
        order = np.argsort(-sizes, kind="stable")
        sizes, starts = sizes[order], np.array([a for a, _ in spans])[order]
        steps = int(sizes[0])
        t = np.arange(steps)[:, None]
        inside = t < sizes[None, :]
        forth = index[np.where(inside, starts[None, :] + t, 0)]
        back = index[np.where(inside, starts[None, :] + sizes[None, :] - 1 - t, 0)]
        return order, forth, back, inside.sum(axis=1), sizes, inside

    def logits(self, table: np.ndarray, index: np.ndarray, spans: list[tuple[int, int]], keep: dict | None = None) -> np.ndarray:
        p = self.p
        order, forth, back, active, sizes, inside = self._layout(index, spans)
        kf, kb = ([], []) if keep is not None else (None, None)
        hf = _forward((table @ p["wf"] + p["bf"])[forth], p["uf"], active, kf)
        hb = _forward((table @ p["wb"] + p["bb"])[back], p["ub"], active, kb)
        turn = np.where(inside, sizes[None, :] - 1 - np.arange(len(active))[:, None], 0)
        h = np.concatenate((hf, np.take_along_axis(hb, turn[:, :, None], axis=0)), axis=2)
        mid = np.tanh(h @ p["a"] + p["ab"])
        e = np.where(inside, mid @ p["v"], -np.inf)
        e = np.exp(e - e.max(axis=0))
        share = e / e.sum(axis=0)
        pooled = (share[:, :, None] * h).sum(axis=0)
        out = pooled @ p["w"] + p["b"]
        if keep is not None:
            keep |= {"order": order, "forth": forth, "back": back, "inside": inside, "turn": turn, "h": h, "mid": mid, "share": share, "pooled": pooled, "kf": kf, "kb": kb}
        result = np.empty(len(spans), dtype=out.dtype)
        result[order] = out
        return result

    def best_logits(self, texts: list[list[str]]) -> list[float]:
        """Largest window logit of each text; minus infinity without words."""
        out = [-np.inf] * len(texts)
        at = 0
        while at < len(texts):
            lot, n = [], 0
            while at < len(texts) and (not lot or n + len(texts[at]) <= 60_000):
                lot.append(at)
                n += len(texts[at])
                at += 1
            words = [w for i in lot for w in texts[i]]
            if not words:
                continue
            table, index = self.rows_of(words)
            spans, owner, base = [], [], 0
            for i in lot:
                own = windows_of(len(texts[i]))
                spans += [(base + a, base + b) for a, b in own]
                owner += [i] * len(own)
                base += len(texts[i])
            for a in range(0, len(spans), BATCH):
                for i, x in zip(owner[a: a + BATCH], self.logits(table, index, spans[a: a + BATCH]).tolist()):
                    out[i] = max(out[i], x)
        return out

    def score(self, logit: float) -> float:
        return float(_sigmoid(np.float64(self.slope * logit + self.shift))) if np.isfinite(logit) else 0.0

    def gradients(self, words: list[str], spans: list[tuple[int, int]], labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        p, keep = self.p, {}
        distinct = list(dict.fromkeys(words))
        places = {w: i for i, w in enumerate(distinct)}
        index = np.fromiter(map(places.__getitem__, words), dtype=np.int64, count=len(words))
        number, slots, begins = self.word_parts(distinct)
        table = self._features(distinct)
        logits = self.logits(table, index, spans, keep)
        order = keep["order"]
        d_out = ((_sigmoid(logits) - labels) * weights)[order].astype(np.float32) / max(1.0, float(weights.sum()))
        h, share, mid, inside = keep["h"], keep["share"], keep["mid"], keep["inside"]
        g = {"w": keep["pooled"].T @ d_out, "b": np.array([d_out.sum()])}
        d_pooled = d_out[:, None] * p["w"]
        d_share = (h * d_pooled[None]).sum(axis=2)
        d_e = np.where(inside, share * (d_share - (share * d_share).sum(axis=0)), 0)
        d_mid = d_e[:, :, None] * p["v"] * (1 - mid * mid)
        g |= {"v": (mid * d_e[:, :, None]).sum(axis=(0, 1)), "a": np.tensordot(h, d_mid, ((0, 1), (0, 1))), "ab": d_mid.sum(axis=(0, 1))}
        d_h = share[:, :, None] * d_pooled[None] + d_mid @ p["a"].T
        d_h = np.where(inside[:, :, None], d_h, 0)
        d_hb = np.where(inside[:, :, None], np.take_along_axis(d_h[:, :, HIDDEN:], keep["turn"][:, :, None], axis=0), 0)
        d_table = np.zeros_like(table)
        for way, d_states, kept, at in (("f", d_h[:, :, :HIDDEN], keep["kf"], keep["forth"]), ("b", d_hb, keep["kb"], keep["back"])):
            d_in, g["u" + way] = _backward(d_states, p["u" + way], kept)
            d_rows = np.zeros((len(distinct), 3 * HIDDEN), dtype=np.float32)
            np.add.at(d_rows, at[inside], d_in[inside])
            g["w" + way], g["b" + way] = table.T @ d_rows, d_rows.sum(axis=0)
            d_table += d_rows @ p["w" + way].T
        g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(g["word"], number, d_table[:, :WORD_DIM])
        g["word"][0] = 0
        sizes = np.diff(np.append(begins, len(slots)))
        np.add.at(g["char"], slots, np.repeat(d_table[:, WORD_DIM: WORD_DIM + CHAR_DIM] / sizes[:, None], sizes, axis=0))
        return g


def _telling_words(texts: list[list[str]], labels: list[int]) -> tuple[dict[str, int], np.ndarray]:
    """Words of enough texts, and the shrunken log ratio of their shares of toxic and other texts."""
    toxic, other = Counter(), Counter()
    for words, label in zip(texts, labels):
        (toxic if label else other).update({w.strip(_EDGE) or w for w in words})
    n, m = max(1, sum(labels)), max(1, len(labels) - sum(labels))
    both = toxic + other
    least = min(MOST_NEEDED, max(FEWEST, len(labels) // RARE))
    known = sorted((w for w, c in both.items() if c >= least), key=lambda w: (-both[w], w))[:VOCABULARY]
    ratio = [0.0] + [
        np.log((toxic[w] + 0.5) / (n + 1)) - np.log((other[w] + 0.5) / (m + 1)) for w in known
    ]
    weight = np.array([0.0] + [both[w] / (both[w] + 8) for w in known])
    shrunk = np.array(ratio) * weight
    return {w: i + 1 for i, w in enumerate(known)}, np.clip(np.sign(shrunk) * np.maximum(np.abs(shrunk) - CHANCE, 0), -3, 3)


def _calibrate(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through weighted labels: Newton steps, halved until the loss falls, with a ridge."""
    x = np.stack((logits, np.ones_like(logits)), axis=1)
    first = beta = np.array([1.0, 0.0])

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((weights * (np.logaddexp(0, z) - labels * z)).sum() + 0.05 * ((b - first) ** 2).sum())

    for _ in range(100):
        q = _sigmoid(x @ beta)
        gradient = x.T @ (weights * (q - labels)) + 0.1 * (beta - first)
        hessian = (x * (weights * q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        while np.abs(step).max() > 1e-9 and loss(beta - step) > loss(beta):
            step = step / 2
        beta = beta - step
        if np.abs(step).max() < 1e-6:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def fit(texts: list[str], labels: list[int], weights: tuple[float, float] = (1.0, 1.0), passes: int = 8, steps: int = 200, seed: int = 3) -> ToxicityModel:
    """``weights``: how many texts of the corpus a text of class 0 and of class 1 stands for, in the calibration. Every fourth
    text of a class is kept back for it. Training takes ``passes`` passes, or as many as ``steps`` updates need."""
    split = [words_of(t) for t in texts]
    nth: Counter = Counter()
    back = []
    for i, label in enumerate(labels):
        nth[label] += 1
        if nth[label] % 4 == 0:
            back.append(i)
    apart = set(back)
    learned = [i for i in range(len(split)) if i not in apart]
    vocabulary, telling = _telling_words([split[i] for i in learned], [labels[i] for i in learned])
    model = ToxicityModel(vocabulary, telling, seed)
    random = np.random.default_rng(seed)
    usable = [i for i in learned if split[i]]
    if len({labels[i] for i in usable}) < 2:
        model.slope, model.shift = 0.0, 4.0 if any(labels) else -4.0
        return model
    telling_of = [np.maximum(telling[[vocabulary.get(w.strip(_EDGE) or w, 0) for w in split[i]]], 0) for i in range(len(split))]

    def window_marks(i: int) -> list[float]:
        return [float((telling_of[i][a:b] ** 2).sum()) for a, b in windows_of(len(split[i]))]

    marks = {i: window_marks(i) for i in usable}
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    step = 0
    picked = sum(1 if labels[i] else 3 for i in usable)
    passes = max(passes, -(-128 * steps // picked))
    for turn in range(passes):
        if turn == passes // 2:  # from here on the network itself picks the windows
            for i in usable:
                table, index = model.rows_of(split[i])
                marks[i] = model.logits(table, index, windows_of(len(split[i]))).tolist()
            model._forget()
        chosen = []
        for i in usable:
            order = np.argsort(marks[i])[::-1]
            some = order[:1].tolist() if labels[i] else {*order[:2].tolist(), *random.integers(0, len(order), 1).tolist()}
            chosen += [(i, k) for k in some]
        random.shuffle(chosen)
        positive = max(1, sum(labels[i] for i, _ in chosen))
        balance = min(4.0, max(1.0, (len(chosen) - positive) / positive / 2))
        for at in range(0, len(chosen), 128):
            words, spans, y = [], [], []
            for i, k in chosen[at: at + 128]:
                a, b = windows_of(len(split[i]))[k]
                spans.append((len(words), len(words) + b - a))
                words += split[i][a:b]
                y.append(labels[i])
            y = np.array(y, dtype=np.float32)
            step += 1
            for k, g in model.gradients(words, spans, y, np.where(y > 0, balance, 1.0)).items():
                m, v = state[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                rate = 0.01 / (1 + 6 * turn / passes)
                if k in ("word", "char"):
                    model.p[k] *= 1 - DECAY * rate
                model.p[k] -= (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
        model._forget()
    back = [i for i in back if split[i]]
    if len({labels[i] for i in back}) < 2:
        back = usable
    best = model.best_logits([split[i] for i in back])
    y = np.array([labels[i] for i in back], dtype=np.float64)
    model.slope, model.shift = _calibrate(np.array(best), y, np.where(y > 0, weights[1], weights[0]))
    model._forget()
    return model


def train(
    docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic",
) -> ToxicityModel | None:
    """Fits on labelled texts whose ``doc_id`` satisfies ``learn``; None without any. An id with labels 0 and 1 counts as 1."""
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(
        F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)
    ).where(learn).groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    at = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000))
    picked = []
    for y, n in sorted(counts.items()):
        share = min(1_000_000, int(1.2e6 * per_class / n) + 1)
        some = known.where((F.col("y") == y) & (at < share)).orderBy(at, "doc_id").limit(per_class).collect()
        picked += [(r["doc_id"], y) for r in some]
    if not picked:
        return None
    id_type = known.schema["doc_id"].dataType.simpleString()
    few = spark.createDataFrame(picked, f"x_id {id_type}, y int")  # at most 2 * per_class rows
    found = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")).join(F.broadcast(few), F.col("d") == F.col("x_id"))
    rows = found.select("d", "t", "y").orderBy("d", F.xxhash64("t")).limit(4 * per_class).collect()
    if not rows:
        return None
    seen = Counter(r["y"] for r in rows)
    weights = tuple(counts.get(y, 0) / max(1, seen[y]) for y in (0, 1))
    return fit([r["t"] for r in rows], [r["y"] for r in rows], weights)


def score_toxicity(
    docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
) -> DataFrame:
    """``doc_id, score, predicted`` for every row, and ``keep`` as the struct ``row``; only the text is read.

    NULL, empty and blank texts score 0, and so does everything without a model. Equal texts score alike, however often they
    occur. ``predicted`` is 1 from a score of 0.5.
    """
    # a text that is kept travels once
    apart = text_col not in keep
    rows = docs.select(
        F.col(id_col).alias("doc_id"), *([F.col(text_col).alias("t")] if apart else []), *([F.struct(*keep).alias("row")] if keep else []),
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores, given = [], batch.column("t") if apart else batch.column("row").field(text_col)
            for at in range(0, batch.num_rows, 256):
                texts = [words_of(t) for t in given.slice(at, 256).to_pylist()]
                scores += [m.score(x) for x in m.best_logits(texts)] if m else [0.0] * len(texts)
            cols = [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            names = ["doc_id", "score", "predicted"]
            row = [batch.column("row")] if keep else []
            yield pa.RecordBatch.from_arrays(cols + row, names=names + (["row"] if keep else []))

    out = rows.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), *(["row"] if keep else [])).schema
    return rows.mapInArrow(judge, out)
