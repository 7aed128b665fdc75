"""Quality classifier by co-training of two views.

The views are a document's text (hashed words, and shares of characters, lines and words)
and the metadata of its page (source, language, stated length). Each view has its own
logistic classifier. In each round both score all documents without a label; of the share of
which a classifier is surest the other learns some too. The views are then calibrated on
labelled rows that neither has seen, and the calibrated views are combined there into one
probability, which scores all documents.

What a classifier is fitted on is bounded: at most ``labelled`` rows with a label, and for
each round, view and class ``passed`` pseudo-labelled ones, by the hash of their ids. The
shares they come from are taken over all documents. Features are made on the executors; only
those of the rows fitted on reach the driver. Training makes the features of all documents
once and stages them packed, a fraction of the text's size; each round reads that table, the
scoring at the end the documents, and neither moves any.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import blocks as B
from marlstone.llm import words as W
from marlstone.llm.whole_rows import packed
from marlstone.session import ship
from marlstone.staging import Staged

#: Rows that a fit may take: with a label, and passed on by the other view in a round, for each class.
LABELLED, PASSED = 12_000, 300
ROUNDS = 3
#: Share of all unlabelled documents that a view is surest of, for each class, and how sure it must be.
EXCHANGED, SURE = 0.1, 0.9
#: Steps of probability in which that share is found.
BINS = 10_000
#: Rows of 16 bytes, a round's steps of documents, in a file.
FILE_ROWS = 2_000_000
#: Rows whose features are made at a time.
SLICE = 500
_KEPT = ("i", "source", "lang", "chars")
HELD_OUT = 4
WORD_SLOTS = 1 << 17
META_SLOTS = 1 << 12
#: Fewer labelled rows of either class than this give no classifier.
LEAST = 5

_CLASSES = (rb"[A-Z]", rb"[0-9]", rb"\n", rb"[.,;:!?'\"()-]", rb"[^\x00-\x7f]")
_SYMBOLS = [bytes([c]) for c in range(33, 127) if not chr(c).isalnum()]
STATS = len(_CLASSES) + len(_SYMBOLS) + 5
#: Which bytes are no ASCII white space, which are of each class, and each symbol.
_INK = np.array([not bytes([c]).isspace() for c in range(256)])
_COUNTED = np.array([[bool(re.fullmatch(p, bytes([c]))) for c in range(256)] for p in (*_CLASSES, *map(re.escape, _SYMBOLS))], float)
TEXT_SLOTS = WORD_SLOTS + STATS


class _Slots(dict):
    """Slots of words; a memo of bounded size keeps the frequent ones."""

    def __missing__(self, word: bytes) -> int:
        slot = W.word_hash(word) % WORD_SLOTS
        if len(word) <= 64:
            if len(self) >= 200_000:
                self.clear()
            self[word] = slot
        return slot


_slots = _Slots()


def text_counts(text: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots and counts of a text's distinct words, and its shares; a null text is an empty one."""
    text = text or b""
    words = W.split(text, W.ALNUM)
    times = Counter(words)
    slots = np.fromiter(map(_slots.__getitem__, times), np.uint32, len(times))
    counts = np.fromiter(times.values(), np.float32, len(times))
    data = np.frombuffer(text, "u1")
    seen, ink = np.bincount(data, minlength=256), _INK[data]
    chunks = int(np.count_nonzero(ink[1:] > ink[:-1])) + int(ink[:1].sum())
    lines = text.split(b"\n")
    more = (math.log1p(len(words)) / 5, len(times) / max(1, len(words)), len(set(lines)) / len(lines), int(np.count_nonzero(ink)) / max(1, chunks) / 10, 1.0)
    return slots, counts, np.concatenate([np.sqrt(_COUNTED @ seen / max(1, len(text))) * 4, more])


def word_values(counts: np.ndarray) -> np.ndarray:
    """Values of words by their counts in a text, of one length for all texts."""
    values = 1 + np.log(counts.astype(np.float32))
    if len(values):
        values *= 3 / math.sqrt(float(values @ values))
    return values


def text_parts(text: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots and values of a text's distinct words, and its shares."""
    slots, counts, shares = text_counts(text)
    return slots, word_values(counts), shares


def text_features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of the text view."""
    slots, values, shares = text_parts(text)
    return np.concatenate([slots, np.arange(WORD_SLOTS, TEXT_SLOTS, dtype=np.uint32)]), np.concatenate([values, shares]).astype(np.float32)


def size_class(chars: int | None) -> str:
    return "null" if chars is None else str(int(2 * math.log2(max(1, chars))))


def meta_features(source, lang, chars) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of the metadata view; nulls are values of their own."""
    size = size_class(chars)
    keys = [f"s {source}".encode(), f"l {lang}".encode(), f"c {size}".encode(), f"sl {source} {lang}".encode()]
    slots, times = np.unique(np.r_[W.word_hashes(keys) % np.uint64(META_SLOTS - 1), META_SLOTS - 1].astype(np.uint32), return_counts=True)
    return slots, times.astype(np.float32)


class Rows:
    """Sparse rows."""

    def __init__(self, slots: list[np.ndarray], values: list[np.ndarray]):
        self.slots, self.values = slots, values

    def take(self, at: np.ndarray) -> Rows:
        return Rows([self.slots[k] for k in at], [self.values[k] for k in at])

    def join(self, other: Rows) -> Rows:
        return Rows(self.slots + other.slots, self.values + other.values)

    def __len__(self) -> int:
        return len(self.slots)


def fit(x: Rows, y: np.ndarray, size: int, start: np.ndarray | None = None, steps: int = 60, decay: float = 1e-4) -> np.ndarray:
    """Logistic weights by Adam over all rows at once; each class counts as much as the other at a power of one half."""
    slots, values = np.concatenate(x.slots), np.concatenate(x.values)
    begin = np.r_[0, np.cumsum([len(s) for s in x.slots])[:-1]]
    row = np.repeat(np.arange(len(x)), [len(s) for s in x.slots])
    w = np.zeros(size) if start is None else start.copy()
    m, v = np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(w[slots] * values, begin), -30, 30)))
        g = np.bincount(slots, weights=values * (p - y)[row], minlength=size) / len(x) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def margins(x: Rows, w: np.ndarray) -> np.ndarray:
    return np.array([float((w[s] * v).sum()) for s, v in zip(x.slots, x.values, strict=True)])


def scale(columns: np.ndarray, y: np.ndarray, steps: int = 200) -> np.ndarray:
    """Weights of a logistic model with an intercept, by damped Newton steps."""
    a = np.c_[columns, np.ones(len(y))]
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(w))
        d = np.linalg.solve(h, a.T @ (p - y) + 1e-2 * w)
        w -= d / max(1.0, np.abs(d).max())
        if np.abs(d).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    """Weights of the views, their calibration, and how the calibrated views combine."""

    text: np.ndarray
    meta: np.ndarray
    platt: np.ndarray
    joint: np.ndarray

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sure = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        a = self.platt[0, 0] * text + self.platt[0, 1]
        b = self.platt[1, 0] * meta + self.platt[1, 1]
        return sure(a), sure(b), sure(np.c_[a, b, np.ones(len(a))] @ self.joint)


def cotrain(text: Rows, meta: Rows, y: np.ndarray, ask, rounds: int = ROUNDS) -> Model | None:
    """A model from labelled rows; every ``HELD_OUT``-th of a class is for calibration.

    ``ask(weights)`` has all unlabelled documents scored and gives ``{id: (goal, text row, meta
    row)}`` for each view: what that view passes on to the other.
    """
    if min((y == 0).sum(), (y == 1).sum()) < LEAST:
        return None
    held = np.concatenate([np.flatnonzero(y == c)[::HELD_OUT] for c in (0, 1)])
    base = np.setdiff1d(np.arange(len(y)), held)
    views = (text, meta)
    extra: list[dict] = [{}, {}]
    weights: list[np.ndarray | None] = [None, None]
    for k in range(rounds + 1):
        for v, x in enumerate(views):
            own = [extra[v][i] for i in sorted(extra[v])]
            more = Rows([r[1 + v][0] for r in own], [r[1 + v][1] for r in own])
            goal = np.r_[y[base], np.array([r[0] for r in own], int)]
            weights[v] = fit(x.take(base).join(more), goal, (TEXT_SLOTS, META_SLOTS)[v], weights[v], 60 if k == 0 else 20)
        if k < rounds:
            for v, found in enumerate(ask(weights)):
                extra[1 - v].update(found)
    m = [margins(x.take(held), w) for x, w in zip(views, weights, strict=True)]
    platt = np.stack([scale(z[:, None], y[held]) for z in m])
    joint = scale(np.c_[platt[0, 0] * m[0] + platt[0, 1], platt[1, 0] * m[1] + platt[1, 1]], y[held])
    return Model(*weights, platt, joint)


def _slices(batches):
    """(slice of a batch, its rows' text, source, language and length); at the end the memos are given back."""
    for whole in batches:
        for k in range(0, whole.num_rows, SLICE):
            batch = whole.slice(k, SLICE)
            yield batch, zip(W.texts(batch.column("text")), *(batch.column(c).to_pylist() for c in ("source", "lang", "chars")), strict=True)
    _slots.clear()
    W.release()


def _features(batches):
    for batch, rows in _slices(batches):
        out = [[a.tobytes() for a in (*text_features(t), *meta_features(s, g, c))] for t, s, g, c in rows]
        cols = [batch.column("i"), *(pa.array(c, pa.binary()) for c in zip(*out, strict=True))]
        yield pa.RecordBatch.from_arrays(cols, ["i", "ts", "tv", "ms", "mv"])


def _packed(batches):
    """Ids, metadata, and the text view's words and shares as bytes."""
    for batch, rows in _slices(batches):
        parts = [text_counts(t) for t, *_ in rows]
        words, shares = [B.pack(s, n) for s, n, _ in parts], [x.tobytes() for _, _, x in parts]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _KEPT), pa.array(words, pa.binary()), pa.array(shares, pa.binary())], [*_KEPT, "words", "shares"])


def _unpacked(words: bytes, shares: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    slots, counts = B.unpack(words)
    return slots, word_values(counts), np.frombuffer(shares, "<f8")


def _view_margins(rows, text_weights: np.ndarray, meta_weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Margins of rows of (parts of the text view, source, language, length)."""
    text, meta = [], []
    known: dict[tuple, float] = {}
    for (slots, values, shares), source, lang, chars in rows:
        text.append(float(text_weights[slots] @ values + text_weights[WORD_SLOTS:] @ shares))
        if (key := (source, lang, size_class(chars))) not in known:
            ms, mv = meta_features(source, lang, chars)
            known[key] = float(meta_weights[ms] @ mv)
        meta.append(known[key])
    return np.array(text), np.array(meta)


def _sure(sent):
    """Ids with the steps of probability that the two views give them."""

    def run(batches):
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("words", "shares", "source", "lang", "chars")]
            rows = ((_unpacked(w, x), *more) for w, x, *more in zip(*cols, strict=True))
            p = [np.floor(BINS / (1 + np.exp(-np.clip(z, -30, 30)))).astype(np.int32).clip(0, BINS - 1) for z in _view_margins(rows, *sent.value)]
            yield pa.RecordBatch.from_arrays([batch.column("i"), *map(pa.array, p)], ["i", "b0", "b1"])
        W.release()

    return run


def _scored(sent):
    def run(batches):
        model = sent.value
        for batch, rows in _slices(batches):
            found = _view_margins(((text_parts(t), *more) for t, *more in rows), model.text, model.meta)
            cols = [batch.column("row"), *(pa.array(x, pa.float64()) for x in model.score(*found))]
            yield pa.RecordBatch.from_arrays(cols, ["row", "p_text", "p_meta", "score"])

    return run


def _view(docs: DataFrame, *more) -> DataFrame:
    col = lambda name, kind: docs[name].cast(kind) if name in docs.columns else F.lit(None).cast(kind)
    return docs.select(*more, col("text", "string").alias("text"), col("source", "string").alias("source"), col("lang", "string").alias("lang"), col("n_chars", "long").alias("chars"))


def _bounds(bins: DataFrame, view: int) -> tuple[int, int]:
    """Steps up to which, and from which on, a view is surest: ``EXCHANGED`` of all rows at each end, within ``SURE``."""
    counts = np.zeros(BINS, np.int64)
    for b, n in bins.groupBy(f"b{view}").count().collect():  # a row for each step
        counts[b] = n
    wanted = EXCHANGED * counts.sum()
    low = int(np.searchsorted(np.cumsum(counts), wanted))
    high = BINS - 1 - int(np.searchsorted(np.cumsum(counts[::-1]), wanted))
    return min(low, int((1 - SURE) * BINS) - 1), max(high, int(SURE * BINS))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", labelled: int = LABELLED, passed: int = PASSED, rounds: int = ROUNDS) -> Model | None:
    """A model from labels (doc_id, 0 or 1), or None with fewer than ``LEAST`` rows of a class.

    Labels with a null id or value are left out; of several labels of a document the least
    holds. Of documents that share an id one is fitted on, the greatest by text; those with
    no id are scored but never fitted on. Null and empty texts and null or missing metadata
    are features like any other, long texts count whole, other columns are ignored. Empty
    tables give None.
    """
    spark = docs.sparkSession
    ship(spark)
    marked = labels.select(labels["doc_id"].cast("long").alias("i"), labels[label_col].cast("int").alias("y")).where("i IS NOT NULL AND y IN (0, 1)").groupBy("i").agg(F.min("y").alias("y"))
    order = F.xxhash64(F.lit(5), "i")
    narrow = docs.select(docs["doc_id"].cast("long").alias("i")).where("i IS NOT NULL")
    view = _view(docs, docs["doc_id"].cast("long").alias("i")).where("i IS NOT NULL")

    def features(ids: list[int]) -> dict[int, tuple]:
        """By id (text row, meta row); there are at most ``labelled`` or ``4 * passed`` ids, so they are broadcast."""
        rows = view.join(F.broadcast(spark.createDataFrame([(i,) for i in ids], "i long")), "i")
        rows = rows.groupBy("i").agg(F.max(F.struct("text", "source", "lang", "chars")).alias("r")).select("i", "r.*")
        got = rows.mapInArrow(_features, "i long, ts binary, tv binary, ms binary, mv binary").collect()
        part = lambda a, b: (np.frombuffer(a, "<u4"), np.frombuffer(b, "<f4"))
        return {r[0]: (part(r[1], r[2]), part(r[3], r[4])) for r in got}

    goals = {r[0]: r[1] for r in marked.join(narrow.distinct(), "i", "left_semi").orderBy(order, "i").limit(labelled).collect()}
    if min(sum(y == c for y in goals.values()) for c in (0, 1)) < LEAST:
        return None
    known = features(sorted(goals))
    ids = sorted(known)
    packed = Staged(view.mapInArrow(_packed, "i long, source string, lang string, chars long, words binary, shares binary"), "op5-features") if rounds else None
    files = 1 + packed.df.count() // FILE_ROWS if rounds else 0

    def ask(weights: list[np.ndarray]) -> list[dict]:
        scored = packed.df.mapInArrow(_sure(spark.sparkContext.broadcast(weights)), "i long, b0 int, b1 int")
        bins = Staged(scored.join(marked.select("i"), "i", "left_anti").repartition(files), "op5-unlabelled")
        picked: list[dict[int, int]] = [{}, {}]
        for v in (0, 1):
            low, high = _bounds(bins.df, v)
            for goal, sure in ((1, F.col(f"b{v}") >= high), (0, F.col(f"b{v}") <= low)):
                picked[v] |= {r[0]: goal for r in bins.df.where(sure).select("i").distinct().orderBy(order, "i").limit(passed).collect()}
        bins.drop()
        made = features(sorted({i for p in picked for i in p}))
        return [{i: (goal, *made[i]) for i, goal in p.items()} for p in picked]

    rows = lambda v: Rows([known[i][v][0] for i in ids], [known[i][v][1] for i in ids])
    model = cotrain(rows(0), rows(1), np.array([goals[i] for i in ids]), ask, rounds)
    if packed is not None:
        packed.drop()
    return model


def scored(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """Each row of ``docs`` as the struct ``row`` with ``p_text, p_meta, score, keep``.

    Null and empty texts and null metadata are scored like any others, and so is a row that
    repeats; missing metadata columns count as null, long texts whole. Without a model the
    scores are null and every row is kept. An empty table gives no rows.
    """
    rows = _view(docs, packed(docs))
    if model is None:
        none = F.lit(None).cast("double")
        return rows.select("row", none.alias("p_text"), none.alias("p_meta"), none.alias("score"), F.lit(True).alias("keep"))
    ship(docs.sparkSession)
    schema = rows.select("row").withColumns({k: F.lit(None).cast("double") for k in ("p_text", "p_meta", "score")}).schema
    out = rows.mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(model)), schema)
    return out.withColumn("keep", F.col("score") >= threshold)
