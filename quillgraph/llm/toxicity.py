"""Toxicity (8): a convolutional text classifier, trained and applied in numpy.

Words (lower-cased A-Z) are hashed to rows of an embedding: buckets that ``MIN_DOCS`` sampled texts
or more have get a row each, which further hash bits guard against other words of the bucket;
all other words share a row of zeros. So do the first ``PREFIXES`` bytes of longer words, as many
languages compound; a word's embedding is the sum. Filters of several widths run over the words, each filter's largest value over the whole text feeds a logistic layer.
Training uses a bounded sample of labelled rows (``SAMPLE_ROWS`` by hash order of doc_id, of them
texts up to ``SAMPLE_BYTES``, and no more than ``SAMPLE_WORDS`` words together); everything else covers all texts. Probabilities are calibrated
on a part of the sample that was not trained on, so that 0.5 separates the labels best; by language there
are further thresholds for ``flagged``, from held-out rows of the sample of each language. A
score depends on the text alone.

Null and empty texts get the score of a text without words. Very long texts are scored in parts
whose maxima are joined. Repeated rows get equal scores. Labels of unknown documents or null
labels are ignored. With no labelled rows, or labels of one kind only, all scores are the labels'
share (0 without any). Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .base import bounded_batches, written

BUCKETS, DIM = 1 << 18, 12
MIN_DOCS = 8
PREFIXES = (6, 8)
WIDTHS, FILTERS = (1, 2, 3), 8
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_WORDS = 4_000, 1 << 18, 12_000_000
EPOCHS, BATCH, RATE, DECAY = 14, 32, 0.01, 1e-5
CALIBRATE = 5  # one sampled row in so many is for calibration
FOLD = 5
MIN_LANG = 30
PART = 1 << 18  # words of a very long text at a time


def _hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    buf = K.LOWER[buf]
    starts, ends = K.spans(buf, offsets, K.LETTERS)
    columns = [K.hash_spans(buf, starts, ends, 0)]
    for n in PREFIXES:
        long = ends - starts > n
        column = np.zeros(len(starts), np.uint64)
        column[long] = K.hash_spans(buf, starts[long], starts[long] + n, 1) ^ np.uint64(n)
        columns.append(column)
    return np.diff(np.searchsorted(starts, offsets)), np.stack(columns, axis=1)


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words by document, and by word its hash and those of its prefixes (0: none)."""
    if len(offsets) == 2 and len(buf) > 4 * K.GROUP:
        parts = [_hashes(p, np.array([0, len(p)])) for p in K.pieces(buf, K.LETTERS)]
        return sum(p[0] for p in parts), np.concatenate([p[1] for p in parts])
    return _hashes(buf, offsets)


class Words:
    """Hashes to embedding rows; row 0 is for all words that were too rare."""

    def __init__(self, texts: list[np.ndarray], min_docs: int = MIN_DOCS):
        every, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(t) for t in texts)]), return_counts=True)
        kept = every[(n >= min_docs) & (every != 0)]
        bucket = (kept & np.uint64(BUCKETS - 1)).astype(np.int64)
        self.row = np.zeros(BUCKETS, np.int32)
        self.row[bucket] = np.arange(1, len(kept) + 1)  # of two words in a bucket the last stays
        self.check = np.concatenate((np.zeros(1, np.uint32), (kept >> np.uint64(32)).astype(np.uint32)))

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        rows = self.row[(hashes & np.uint64(BUCKETS - 1)).astype(np.int64)]
        return np.where(self.check[rows] == (hashes >> np.uint64(32)).astype(np.uint32), rows, 0)

    def __len__(self) -> int:
        return len(self.check)


class Convolution:
    """Weights: embedding (words x DIM), a filter bank (w x DIM x FILTERS) by width, a logistic layer."""

    def __init__(self, words: Words, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.words = words
        self.embedding = rng.normal(0, 0.1, (len(words), DIM)).astype(np.float32)
        self.embedding[0] = 0
        self.banks = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
        self.base = np.float32(0)
        self.scale, self.shift = 1.0, 0.0

    def tables(self) -> np.ndarray:
        """The slices of all filters side by side: one product for each word, of which windows then take sums."""
        return np.concatenate([bank[k] for bank in self.banks for k in range(len(bank))], axis=1)

    def pooled(self, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest value of each filter over a text's words, and where it was found. Ends are padded with zeros."""
        x = self.embedding[rows].sum(axis=1)
        best, where = [], []
        for w, bank, bias in zip(WIDTHS, self.banks, self.bias):
            padded = np.concatenate((x, np.zeros((max(w - 1, w - len(rows)), DIM), np.float32)))
            n = len(padded) - w + 1
            values = sum(padded[k : k + n] @ bank[k] for k in range(w)) + bias
            at = values.argmax(axis=0)
            best.append(np.maximum(values[at, np.arange(FILTERS)], 0))
            where.append(at)
        return np.concatenate(best), where

    def train(self, texts: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> None:
        """Adam over mini-batches, both labels weighing the same. Embedding rows that a batch doesn't touch stay."""
        rng = np.random.default_rng(seed)
        weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6))
        params = [self.embedding, *self.banks, *self.bias, self.out]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        step = 0
        base_moment = [0.0, 0.0]
        for _ in range(EPOCHS):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                grads = [np.zeros_like(p) for p in params[1:]]
                touched: dict[int, np.ndarray] = {}
                base_grad, chosen = 0.0, order[at : at + BATCH]
                for i in chosen:
                    rows = texts[i]
                    best, where = self.pooled(rows)
                    p = 1 / (1 + np.exp(-float(best @ self.out + self.base)))
                    g = np.float32((p - labels[i]) * weight[i] / len(chosen))
                    base_grad += float(g)
                    grads[-1] += g * best
                    back = g * self.out * (best > 0)
                    for b, w in enumerate(WIDTHS):
                        for f in np.flatnonzero(back[b * FILTERS : (b + 1) * FILTERS]):
                            d = back[b * FILTERS + f]
                            grads[len(WIDTHS) + b][f] += d
                            for k in range(w):
                                place = where[b][f] + k
                                if place < len(rows):
                                    own = rows[place]
                                    grads[b][k, :, f] += d * self.embedding[own].sum(axis=0)
                                    for r in own[own > 0].tolist():
                                        touched[r] = touched.get(r, 0) + d * self.banks[b][k, :, f]
                step += 1
                fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
                if touched:
                    at_rows = np.fromiter(touched, np.int64)
                    g = np.stack(list(touched.values()))
                    m, v = moments[0]
                    m[at_rows] = 0.9 * m[at_rows] + 0.1 * g
                    v[at_rows] = 0.999 * v[at_rows] + 0.001 * g * g
                    self.embedding[at_rows] -= RATE * (m[at_rows] / fix1) / (np.sqrt(v[at_rows] / fix2) + 1e-8)
                for p, g, (m, v) in zip(params[1:], grads, moments[1:]):
                    m[:] = 0.9 * m + 0.1 * g
                    v[:] = 0.999 * v + 0.001 * g * g
                    p -= (RATE * (m / fix1) / (np.sqrt(v / fix2) + 1e-8) + RATE * DECAY * p).astype(np.float32)
                base_moment = [0.9 * base_moment[0] + 0.1 * base_grad, 0.999 * base_moment[1] + 0.001 * base_grad**2]
                self.base -= np.float32(RATE * (base_moment[0] / fix1) / (np.sqrt(base_moment[1] / fix2) + 1e-8))

    def logit(self, rows: np.ndarray) -> float:
        best, _ = self.pooled(rows)
        return float(best @ self.out + self.base)


def best_cut(logits: np.ndarray, labels: np.ndarray) -> float:
    """The cut between logits that gives the best F1; the middle of the gap that it lies in."""
    order = np.argsort(-logits, kind="stable")
    values, hits = logits[order], np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(values) + 1) + labels.sum())
    end = np.append(values[:-1] != values[1:], True)
    k = int(np.argmax(np.where(end, f1, -1)))
    return float((values[k] + values[k + 1]) / 2) if k + 1 < len(values) else float(values[k] - 1)


class Scorer:
    """A trained model, applied to many texts at a time."""

    def __init__(self, model: Convolution):
        self.model, self.ready = model, model.tables()

    def scores(self, texts: pa.Array) -> pa.Array:
        model, out = self.model, []
        for _, _, buf, offsets in K.groups(texts):
            counts, hashes = word_hashes(buf, offsets)
            rows = model.words(hashes)
            pooled = self._pooled(counts, rows)
            out.append(1 / (1 + np.exp(-(pooled @ model.out + model.base - model.shift) * model.scale)))
        return pa.array(np.concatenate(out).astype(np.float64) if out else np.zeros(0), pa.float64())

    def _pooled(self, counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Largest filter values by document, over all its words; pad words follow each document."""
        pad = max(WIDTHS)
        begin = np.cumsum(counts + pad) - (counts + pad)
        laid = np.zeros((int((counts + pad).sum()), rows.shape[1]), np.int32)
        place = np.arange(len(rows)) + np.repeat(np.arange(len(counts)) * pad, counts)
        laid[place] = rows
        # windows start at words, as in training; a text without words has the pad only
        starts = np.zeros(len(laid), bool)
        starts[place] = True
        starts[begin[counts == 0]] = True
        if len(counts) > 1:
            return self._best(laid, starts, begin)
        parts = [self._best(laid[a : a + PART + pad], starts[a : a + PART], np.zeros(1, np.int64)) for a in range(0, len(laid), PART)]
        return np.max(parts, axis=0)

    def _best(self, laid: np.ndarray, starts: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Largest values over windows that start where ``starts`` says; ``laid`` may go on beyond it."""
        columns, at = [], 0
        product = self.model.embedding[laid].sum(axis=1) @ self.ready
        for bias, w in zip(self.model.bias, WIDTHS):
            n = min(len(starts), len(laid) - w + 1)
            values = np.full((len(starts), FILTERS), -np.inf, np.float32)
            values[:n] = bias
            for k in range(w):
                values[:n] += product[k : k + n, at : at + FILTERS]
                at += FILTERS
            values[~starts] = -np.inf
            columns.append(np.maximum(np.maximum.reduceat(values, begin, axis=0), 0))
        return np.concatenate(columns, axis=1)


def scorer(shared):
    """Arrow function over texts, with the model that was broadcast."""
    ready: list[Scorer] = []

    def score(texts: pa.Array) -> pa.Array:
        if not ready:
            ready.append(Scorer(shared.value))
        return ready[0].scores(texts)

    return score


def in_fold(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLD)) == 0


IDS = "doc_id long, lang string, toxic int, hashes binary"


def hashed_rows(batches):
    """(doc_id, lang, toxic, text) with the hashes of each text's words instead of the text."""
    for batch in batches:
        out = []
        for _, _, buf, offsets in K.groups(batch.column(3)):
            counts, flat = word_hashes(buf, offsets)
            cuts = np.cumsum(counts)
            out += [np.ascontiguousarray(flat[e - n : e]).tobytes() for e, n in zip(cuts, counts)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.binary())], names=["doc_id", "lang", "toxic", "hashes"])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[Convolution, dict[str, float]]:
    """Model and thresholds by language, from at most ``sample_rows`` labelled rows outside the held-out fold.

    Texts are hashed by the executors; the driver gets hashes, 24 bytes a word, of SAMPLE_WORDS words at most. Of
    rows with one doc_id the smallest text is taken, so that training can be repeated.
    """
    known = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~in_fold(F.col("doc_id")))
    half = sample_rows // 2
    # of each label as many as there may be: toxic ones are rare
    chosen = known.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(half).unionByName(known.where("toxic != 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(half))
    usable = docs.where(F.octet_length("text") <= SAMPLE_BYTES).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    sampled = usable.join(F.broadcast(chosen.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))), "doc_id")
    once = sampled.groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("r")).select("doc_id", "r.lang", "toxic", "r.text")
    ready, _ = written(once.mapInArrow(hashed_rows, IDS), "sample")
    # at most sample_rows numbers in one window
    n = F.octet_length("hashes") / (8 * (1 + len(PREFIXES)))
    fits = ready.select("doc_id", F.sum(n).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")).alias("upto")).where(F.col("upto") <= SAMPLE_WORDS).select("doc_id")
    doc_ids, langs, toxic, hashed = [], [], [], []
    for r in ready.join(F.broadcast(fits), "doc_id").orderBy("doc_id").toLocalIterator():
        doc_ids.append(r.doc_id)
        langs.append(r.lang or "")
        toxic.append(r.toxic)
        hashed.append(np.frombuffer(bytes(r.hashes), np.uint64).reshape(-1, 1 + len(PREFIXES)))
    y = np.array(toxic, np.int64)
    if len(set(y.tolist())) < 2:
        model = Convolution(Words([]))
        model.out[:] = 0
        share = y.mean() if len(y) else 0.0
        model.base = np.float32(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
        return model, {}
    apart = np.array([zlib.crc32(b"calibrate %d" % d) % CALIBRATE == 0 for d in doc_ids])
    if len(set(y[~apart])) < 2 or len(set(y[apart])) < 2:
        apart[:] = False
    train = np.flatnonzero(~apart)
    model = Convolution(Words([hashed[i] for i in train]))
    texts = [model.words(h) for h in hashed]
    model.train([texts[i] for i in train], y[train])
    check = np.flatnonzero(apart) if apart.any() else train
    logits = np.array([model.logit(texts[i]) for i in check])
    model.shift = best_cut(logits, y[check])
    spoken = np.array(langs)[check]
    cuts = {}
    for lang in sorted(set(spoken.tolist())):
        own = spoken == lang
        if own.sum() >= MIN_LANG and len(set(y[check][own])) == 2:
            cuts[lang] = float(1 / (1 + np.exp(-(best_cut(logits[own], y[check][own]) - model.shift) * model.scale)))
    return model, cuts


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, and flagged (by the language's threshold)."""
    bounded_batches(docs.sparkSession)
    model, cuts = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = docs.select("doc_id", "lang", F.arrow_udf(scorer(shared), "double").asNondeterministic()(F.coalesce("text", F.lit(""))).alias("score"))
    cut = F.lit(0.5)
    for lang, value in cuts.items():
        cut = F.when(F.col("lang") == lang, value).otherwise(cut)
    held_out = F.coalesce(in_fold(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("score") >= cut).alias("flagged"))
