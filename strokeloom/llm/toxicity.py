"""Toxicity by a small convolutional text classifier, trained in numpy.

A word's embedding is the mean of hashed rows for the word, its prefixes and its suffix. Filters of
one, two and three words run over the text, each keeps its maximum, and a logistic layer reads the
maxima. As the filters are linear before pooling, a word's share in each filter is computed once
per distinct word, and a text's filters are sums of gathered rows.

The fit uses a bounded sample: labelled rows in hash order, up to MAX_TRAIN rows and MAX_TRAIN_BYTES
of text together (a text over 1 / PARTS of that is no part of it). In the driver a word is a number,
so memory follows the distinct words and 4 bytes a word. A quarter of the sample is kept out of
training, to calibrate the score and to set a threshold for each language. Scoring covers every
whole text.

Defined cases: a null or empty text scores as a text without words; a document of the sample that
repeats is learnt as often; equal texts have equal scores; an empty table gives no rows; labels that
are null, lack a document or repeat (the larger counts) do no harm; with labels of one class only, or none, every
score is 0; long texts are scored in overlapping blocks, whose maxima are the text's maxima;
extra columns pass by untouched.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strokeloom.llm.common import documents, materialize

MAX_TRAIN = 12_000  # rows of the fit
MAX_TRAIN_BYTES = 64 << 20  # of all their texts together
PARTS = 16  # ranges of the sample; the driver holds the texts of one
BUCKETS = 1 << 16
DIM = 12
FILTERS = 8  # of each width
WIDTHS = (1, 2, 3)
EPOCHS = 5
BATCH = 32
RATE = 0.05
SEED = 11
BLOCK = 1 << 17  # words of one block
KNOWN = 1 << 18  # distinct words whose shares are kept
FOLDS, HELD_OUT = 5, 0
LEAST_OF_LANGUAGE = 60  # calibration rows with fewer in a language keep the common threshold
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def rows_of(word: str) -> list[int]:
    """Hashed rows of a word: itself, prefixes of 3 to 6 letters, its last 4 letters."""
    parts = [f"={word}", *(f"<{word[:k]}" for k in (3, 4, 5, 6) if len(word) >= k), f">{word[-4:]}"]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts]


@dataclass
class Model:
    table: np.ndarray  # BUCKETS x DIM
    filters: np.ndarray  # DIM x (6 * FILTERS): each width's words in turn
    bias: np.ndarray  # 3 * FILTERS
    out: np.ndarray  # 3 * FILTERS
    offset: float
    scale: float = 1.0  # of the calibrated score
    shift: float = 0.0
    thresholds: dict = field(default_factory=dict)
    constant: float | None = None


def _shares(model: Model, words: list[str]) -> np.ndarray:
    """Each word's share in each filter."""
    rows = [rows_of(w) for w in words]
    ends = np.cumsum([len(r) for r in rows])
    flat = np.fromiter((x for r in rows for x in r), np.int64, int(ends[-1]) if len(rows) else 0)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    mean = np.add.reduceat(model.table[flat], starts, axis=0) / np.diff(np.append(starts, len(flat)))[:, None] if len(rows) else np.zeros((0, DIM), np.float32)
    return (mean @ model.filters).astype(np.float32)


def _convolved(shares: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """len(ids) - 2 windows of each filter, windows starting at each place; ids end with two pads."""
    n, f = len(ids) - 2, FILTERS
    out, at = np.empty((n, 3 * f), np.float32), 0
    for k, width in enumerate(WIDTHS):
        part = out[:, k * f : (k + 1) * f]
        for step in range(width):
            gathered = shares[ids[step : step + n], at : at + f]
            if step:
                part += gathered
            else:
                part[:] = gathered
            at += f
    return out


@dataclass
class Sample:
    """Texts of the fit as places in a list of distinct words: no word is held twice.

    ids: the words of all texts in turn; ends: where each text ends there; rows and row_ends: the
    hashed rows of each distinct word, likewise.
    """

    ids: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    row_ends: np.ndarray

    def text(self, k: int) -> np.ndarray:
        return self.ids[self.ends[k - 1] if k else 0 : self.ends[k]]

    def rows_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashed rows of the words in turn, how many each has)."""
        first = np.where(words > 0, self.row_ends[words - 1], 0)
        many = self.row_ends[words] - first
        ends = np.cumsum(many)
        return self.rows[np.repeat(first - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)], many


class SampleMaker:
    """Takes texts one by one; a text is dropped once its words are numbers."""

    def __init__(self) -> None:
        self.names: dict[str, int] = {}
        self.ids, self.ends, self.rows, self.row_ends = array("i"), array("q"), array("i"), array("q")

    def add(self, text: str | None) -> None:
        names = self.names
        for m in WORD.finditer((text or "").lower()):
            word = m[0]
            k = names.get(word)
            if k is None:
                k = names[word] = len(names)
                self.rows.extend(rows_of(word))
                self.row_ends.append(len(self.rows))
            self.ids.append(k)
        self.ends.append(len(self.ids))

    def made(self) -> Sample:
        self.names.clear()
        return Sample(*(np.array(x, t) for x, t in ((self.ids, np.int32), (self.ends, np.int64), (self.rows, np.int32), (self.row_ends, np.int64))))


def _log_odds(sample: Sample, picked: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Each hashed row's smoothed log odds of toxic texts against others, by texts that hold it."""
    counts = np.zeros((2, BUCKETS))
    for k, label in zip(picked.tolist(), labels.tolist(), strict=True):
        counts[label, np.unique(sample.rows_of(np.unique(sample.text(k)))[0])] += 1
    share = (counts + 0.5) / (np.bincount(labels, minlength=2)[:, None] + 1.0)
    odds = np.log(share[1] / share[0])
    return np.clip(odds * np.minimum(1.0, counts.sum(axis=0) / 6), -3, 3)


def fit(sample: Sample, labels: list[int], langs: list[str | None]) -> Model:
    """A model from a bounded sample. The first filter starts at the hashed rows' log odds."""
    y = np.asarray(labels, np.int64)
    rng = np.random.default_rng(SEED)
    f = FILTERS
    model = Model(
        table=rng.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32), filters=rng.normal(0, 0.4, (DIM, 6 * f)).astype(np.float32),
        bias=np.zeros(3 * f, np.float32), out=rng.normal(0, 0.1, 3 * f).astype(np.float32), offset=0.0,
    )
    order = rng.permutation(len(y))
    kept, train = order[: len(y) // 4], order[len(y) // 4 :]
    if len(set(y[train].tolist())) < 2:
        model.constant = 0.0
        return model
    model.table[:, 0] = _log_odds(sample, train, y[train])
    model.filters[0, :] = 0
    model.filters[1:, 0] = 0
    model.filters[0, 0], model.filters[1:, 1] = 1.0, model.filters[1:, 1]
    model.filters[0, [f, 2 * f, 3 * f, 4 * f, 5 * f]] = 0.5
    model.out[[0, f, 2 * f]] = (1.0, 0.3, 0.3)
    model.offset = -2.0
    slow = {k: np.full_like(v, 1e-2) for k, v in (("table", model.table), ("filters", model.filters), ("bias", model.bias), ("out", model.out))}
    slow_offset = 1e-2
    for _ in range(EPOCHS):
        rng.shuffle(train)
        for at in range(0, len(train), BATCH):
            picked = train[at : at + BATCH]
            slow_offset = _step(model, slow, slow_offset, sample, picked, y[picked])
    raw = np.concatenate([_pooled(model, sample, kept[k : k + BATCH])[0] for k in range(0, len(kept), BATCH)]) @ model.out + model.offset if len(kept) else np.zeros(0)
    _calibrate(model, raw, y[kept], [langs[k] for k in kept])
    return model


def _pooled(model: Model, sample: Sample, picked: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the picked texts: the pooled filters, then what a gradient needs: the word at each step of
    each filter's best window (texts x words of all filters, -1: none), the distinct words, their
    hashed rows, how many each has, and their embeddings."""
    f, texts = FILTERS, [sample.text(k) for k in picked.tolist()]
    words, ids = np.unique(np.concatenate(texts), return_inverse=True)
    rows, many = sample.rows_of(words)
    mean = np.zeros((len(words) + 1, DIM), np.float32)  # the last: the empty word
    if len(words):
        mean[:-1] = np.add.reduceat(model.table[rows], np.cumsum(many) - many, axis=0) / many[:, None]
    shares = mean @ model.filters
    pooled, words_at = np.empty((len(texts), 3 * f), np.float32), np.empty((len(texts), 6 * f), np.int64)
    at = 0
    for k, text in enumerate(texts):
        mine = np.concatenate([ids[at : at + len(text)], [len(words)] * (2 if len(text) else 3)]).astype(np.int64)
        at += len(text)
        tops, best = [], []
        for s in range(0, max(1, len(text)), BLOCK):
            conv = _convolved(shares, mine[s : s + BLOCK + 2])
            best.append(conv.argmax(axis=0) + s)
            tops.append(conv.max(axis=0))
        pick = np.argmax(tops, axis=0)
        pooled[k] = np.maximum(np.array(tops)[pick, np.arange(3 * f)] + model.bias, 0)
        where, column = np.array(best)[pick, np.arange(3 * f)], 0
        for w, width in enumerate(WIDTHS):
            for step in range(width):
                words_at[k, column : column + f] = mine[where[w * f : (w + 1) * f] + step]
                column += f
    return pooled, words_at, words, rows, many, mean


def _step(model: Model, slow: dict, slow_offset: float, sample: Sample, picked: np.ndarray, y: np.ndarray) -> float:
    """One Adagrad step; only each filter's best window of each text has a gradient."""
    f, n = FILTERS, len(picked)
    pooled, words_at, words, rows, many, mean = _pooled(model, sample, picked)
    g = 1 / (1 + np.exp(-np.clip(pooled @ model.out + model.offset, -30, 30))) - y
    g_top = g[:, None] * model.out * (pooled > 0)
    g_filters, g_mean = np.zeros_like(model.filters), np.zeros_like(mean)
    column = 0
    for k, width in enumerate(WIDTHS):
        mine = g_top[:, k * f : (k + 1) * f].astype(np.float32)
        for _ in range(width):
            block = slice(column, column + f)
            at = words_at[:, block]
            g_filters[:, block] = np.einsum("tfd,tf->df", mean[at], mine)
            np.add.at(g_mean, at.ravel(), (mine[:, :, None] * model.filters[:, block].T).reshape(-1, DIM))
            column += f
    for name, grad in (("filters", g_filters), ("bias", g_top.sum(axis=0)), ("out", (g[:, None] * pooled).sum(axis=0))):
        grad = grad / n
        slow[name] += grad**2
        getattr(model, name)[...] -= RATE * grad / np.sqrt(slow[name])
    moved = np.repeat(np.abs(g_mean[:-1]).sum(axis=1) > 0, many)
    if moved.any():
        each = np.repeat(g_mean[:-1] / np.maximum(many, 1)[:, None], many, axis=0)[moved]
        at, place = np.unique(rows[moved], return_inverse=True)
        grad = np.zeros((len(at), DIM), np.float32)
        np.add.at(grad, place, each)
        grad /= n
        slow["table"][at] += grad**2
        model.table[at] -= RATE * grad / np.sqrt(slow["table"][at])
    g_offset = float(g.sum()) / n
    slow_offset += g_offset**2
    model.offset -= RATE * g_offset / np.sqrt(slow_offset)
    return slow_offset


class Scorer:
    """Raw and calibrated scores of texts, with the shares of words met so far."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.names: dict[str, int] = {}
        self.shares = np.zeros((4096, self.model.filters.shape[1]), np.float32)  # row 0: the empty word

    def _ids(self, words: list[str]) -> np.ndarray:
        """Places in shares; place 0 is the empty word."""
        get = self.names.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        if len(missing := np.nonzero(ids < 0)[0]):
            new = list(dict.fromkeys(words[k] for k in missing))
            first = len(self.names) + 1
            self.names |= zip(new, range(first, first + len(new)), strict=True)
            while first + len(new) > len(self.shares):
                self.shares = np.vstack([self.shares, np.zeros_like(self.shares)])
            self.shares[first : first + len(new)] = _shares(self.model, new)
            ids[missing] = [self.names[words[k]] for k in missing]
        return ids

    def logits(self, texts: list[str | None]) -> np.ndarray:
        return self.of_words(words_of(t) for t in texts)

    def of_words(self, texts) -> np.ndarray:
        m, tops, owners, held, size = self.model, [], [], [], 0
        total = 0

        def flush() -> None:
            nonlocal held, size
            if not held:
                return
            if len(self.names) > KNOWN:
                self._reset()
            flat, starts = [], []
            at = 0
            for _, words, _ in held:
                starts.append(at)
                at += max(1, len(words)) + 2
                flat += words
            ids, out, at = self._ids(flat), np.zeros(at, np.int64), 0
            for start, (_, words, _) in zip(starts, held, strict=True):
                out[start : start + len(words)] = ids[at : at + len(words)]
                at += len(words)
            conv = _convolved(self.shares, np.append(out, [0, 0]))
            # Windows start at words; those of a piece that isn't a text's last stop short of its end.
            ends = np.array([s + max(1, len(w)) - 2 * more for s, (_, w, more) in zip(starts, held, strict=True)])
            cuts = np.stack([np.array(starts), ends], axis=1).ravel()
            tops.append(np.maximum.reduceat(conv, cuts, axis=0)[::2])
            owners.extend(k for k, _, _ in held)
            held, size = [], 0

        for k, words in enumerate(texts):
            total = k + 1
            for at in range(0, max(1, len(words) - 2), BLOCK - 2):
                piece = words[at : at + BLOCK]
                held.append((k, piece, at + BLOCK < len(words)))
                size += len(piece) + 2
                if size >= BLOCK:
                    flush()
        flush()
        if not total:
            return np.zeros(0)
        best = np.full((total, 3 * FILTERS), -np.inf, np.float32)
        np.maximum.at(best, np.array(owners), np.concatenate(tops))
        return np.maximum(best + m.bias, 0) @ m.out + m.offset

    def scores(self, texts: list[str | None]) -> np.ndarray:
        m = self.model
        if m.constant is not None:
            return np.full(len(texts), m.constant)
        return 1 / (1 + np.exp(-np.clip(m.scale * self.logits(texts) + m.shift, -30, 30)))


def _calibrate(model: Model, raw: np.ndarray, y: np.ndarray, langs: list[str | None]) -> None:
    """Score 0.5 and each language's threshold stand where the kept rows have the best F1."""
    if len(set(y.tolist())) < 2:
        return

    def best(score: np.ndarray, label: np.ndarray) -> float:
        order = np.argsort(-score, kind="stable")
        s, hits = score[order], np.cumsum(label[order])
        f1 = 2 * hits / (np.arange(1, len(s) + 1) + label.sum())
        f1[:-1][s[:-1] == s[1:]] = -1  # a threshold can't part equal scores
        k = int(f1.argmax())
        return float((s[k] + s[k + 1]) / 2 if k + 1 < len(s) else s[k] - 1e-6)

    model.scale = 1.0
    model.shift = -best(raw, y)
    score = 1 / (1 + np.exp(-np.clip(raw + model.shift, -30, 30)))
    for lang in {x for x in langs if x is not None}:
        mine = np.array([x == lang for x in langs])
        if mine.sum() >= LEAST_OF_LANGUAGE and 5 <= y[mine].sum() < mine.sum():
            model.thresholds[lang] = min(0.95, max(0.05, best(score[mine], y[mine])))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; a null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_bytes: int = MAX_TRAIN_BYTES) -> Model:
    """docs: (doc_id, text, lang); labels: (doc_id, toxic). Rows of the held-out fold are not used.

    The sample is written, so that it is joined and sorted once. It comes to the driver in PARTS
    ranges of hash order, one at a time, and turns into numbers as it comes.
    """
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    usable = marked.where(fold(F.col("doc_id")) != HELD_OUT)
    picked = usable.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(max_train)
    bytes_ = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    sample = docs.select("doc_id", "text", "lang", bytes_.alias("_bytes")).where(F.col("_bytes") <= max_bytes // PARTS).join(F.broadcast(picked), "doc_id")
    order = [F.xxhash64(F.lit(SEED), "doc_id"), F.col("doc_id"), F.xxhash64("text")]
    rows = materialize(sample, "labelled").repartitionByRange(PARTS, *order).sortWithinPartitions(*order)
    maker, y, langs, held = SampleMaker(), [], [], 0
    for r in rows.select("text", "toxic", "lang", "_bytes").toLocalIterator():
        if len(y) == max_train or held + r["_bytes"] > max_bytes:
            break
        maker.add(r["text"])
        y.append(int(r["toxic"]))
        langs.append(r["lang"])
        held += r["_bytes"]
    return fit(maker.made(), y, langs)


def with_scores(docs: DataFrame, model: Model, text: str = "text", name: str = "_score") -> DataFrame:
    """docs and a column of scores in [0, 1]."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            yield batch.append_column(name, pa.array(scorer.scores(texts), pa.float64()))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def threshold_of(model: Model, lang: Column) -> Column:
    """The language's threshold; 0.5 for a language without one."""
    found = F.lit(0.5)
    for name, value in sorted(model.thresholds.items()):
        found = F.when(lang == name, F.lit(value)).otherwise(found)
    return found


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    scored = with_scores(docs, model).drop("text")
    threshold = threshold_of(model, F.col("lang"))
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
        threshold.alias("language_threshold"),
        (F.col("_score") >= threshold).cast("int").alias("predicted_by_language"),
    )
