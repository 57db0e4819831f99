"""Toxicity scores from a convolutional text classifier in numpy.

A word is the mean of hashed embeddings of itself and of its first and last letters, so words
that were never seen share what their stems say. Filters of several widths slide over the
words of the whole text, each keeps its maximum, and a linear layer gives a logit. The network
is trained by Adam in one task, on a bounded sample of the labelled rows (`MAX_LABELLED`);
scoring is one pass inside the scan with the parameters (about 4 MB) broadcast.

Thresholds are calibrated by language on rows kept out of training. The language is guessed
from function words of the text alone, so neither labels nor any other column is an input of a
score; the score is the logit against the threshold of the text's language, so that 0.5 is
where the decision changes.

Defined results: a null text counts as empty; a text without words is scored from the empty
window; labels that are null are not learned from; without any labelled row, or with one class
only, every score is the base rate; repeated rows are scored each, and of repeated
ids with a label the smallest text is learned from; very long texts are convolved whole, in parts that
overlap; an empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ._common import stored, text_batches

#: Most labelled rows that are learned from: those with the smallest hashes of their ids.
MAX_LABELLED = 4000
BUCKETS, SIZE, FILTERS, WIDTHS = 1 << 16, 16, 16, (1, 2, 3)
#: Words that a task remembers, and words that are convolved at a time.
REMEMBERED, CHUNK = 300_000, 1 << 16

#: Frequent function words that tell the languages apart.
FUNCTION_WORDS = {
    "en": {"the", "and", "of", "to", "is", "that", "with", "for", "it"},
    "fr": {"le", "les", "des", "est", "et", "une", "dans", "qui", "du"},
    "de": {"der", "die", "und", "das", "ist", "nicht", "von", "den", "mit"},
    "es": {"el", "los", "las", "por", "con", "una", "y", "del", "para"},
}
_LANGUAGE = {w: k for k, ws in enumerate(FUNCTION_WORDS.values()) for w in ws}
_EDGE = re.compile(r"^\W+|\W+$")


def features(word: str) -> list[int]:
    """Buckets of a word: itself, its first 3 to 5 letters and its last 4."""
    parts = (word, *(f"<{k}{word[:k]}" for k in (3, 4, 5)), f">{word[-4:]}")
    return [zlib.crc32(p.encode()) % (BUCKETS - 1) + 1 for p in parts]


class Words:
    """Numbers the distinct words of texts and holds their buckets; number 0 is padding."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.buckets = [[0] * 5]
        self.language = [-1]
        self._table, self._tongues = np.zeros((0, 5), np.int32), np.zeros(0, np.int8)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().split()
        number = self.number
        for w in set(words).difference(number):
            bare = _EDGE.sub("", w) or w
            number[w] = len(self.buckets)
            self.buckets.append(features(bare))
            self.language.append(_LANGUAGE.get(bare, -1))
        return np.fromiter(map(number.__getitem__, words), np.int64, len(words))

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and language of every word by number."""
        done = len(self._table)
        if done < len(self.buckets):
            self._table = np.concatenate([self._table, np.array(self.buckets[done:], np.int32)])
            self._tongues = np.concatenate([self._tongues, np.array(self.language[done:], np.int8)])
        return self._table, self._tongues

    def full(self) -> bool:
        return len(self.buckets) > REMEMBERED


def languages(rows: list[np.ndarray], words: Words) -> np.ndarray:
    """The language with most function words in each text; one more number stands for none."""
    table = words.arrays()[1]
    found = np.full(len(rows), len(FUNCTION_WORDS))
    for k, row in enumerate(rows):
        seen = table[row]
        counts = np.bincount(seen[seen >= 0], minlength=len(FUNCTION_WORDS))
        if counts.any():
            found[k] = counts.argmax()
    return found


def _segments(rows: list[np.ndarray]) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Groups of (owner, padded words) with about CHUNK windows; longer texts go in several parts.

    A text is padded by one word before and `pad` after it, and a window starts at each word but
    the last `pad` of a part, so parts have exactly the windows of the whole text."""
    pad, group, size = max(WIDTHS) - 1, [], 0
    for k, row in enumerate(rows):
        line = np.concatenate([[0], row, [0] * pad]).astype(np.int64)
        for at in range(0, len(row) + 1, CHUNK):
            part = line[at : at + CHUNK + pad]
            group.append((k, part))
            size += len(part)
            if size >= CHUNK:
                yield group
                group, size = [], 0
    if group:
        yield group


@dataclass
class TextCNN:
    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    dense: np.ndarray
    bias: float
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(FUNCTION_WORDS) + 1))

    @classmethod
    def fresh(cls, seed: int = 0) -> TextCNN:
        rng = np.random.default_rng(seed)
        embedding = rng.normal(0, 0.3, (BUCKETS, SIZE)).astype(np.float32)
        embedding[0] = 0
        filters = [rng.normal(0, (2 / (w * SIZE)) ** 0.5, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
        return cls(embedding, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.2, FILTERS * len(WIDTHS)).astype(np.float32), 0.0)

    def pool(self, rows: list[np.ndarray], words: Words, where: bool = False):
        """Maximum of each filter over each text, and the words of the maximal windows if asked."""
        best = np.full((len(rows), FILTERS * len(WIDTHS)), -np.inf, np.float32)
        windows = np.zeros((len(rows), FILTERS * len(WIDTHS), max(WIDTHS)), np.int64) if where else None
        buckets = words.arrays()[0]
        pad = max(WIDTHS) - 1
        for group in _segments(rows):
            owner = np.array([k for k, _ in group])
            sizes = np.array([len(p) - pad for _, p in group])
            line = np.concatenate([p for _, p in group])
            ends = np.cumsum(sizes + pad)
            start = np.concatenate([np.arange(e - s - pad, e - pad) for e, s in zip(ends, sizes)])
            used, at = np.unique(line, return_inverse=True)
            vectors = self.embedding[buckets[used]].mean(axis=1)
            offsets = np.cumsum(sizes) - sizes
            for n, (w, f, b) in enumerate(zip(WIDTHS, self.filters, self.biases)):
                value = b + sum((vectors @ f[k])[at[start + k]] for k in range(w))
                most = np.maximum.reduceat(value, offsets, axis=0)
                own = slice(n * FILTERS, (n + 1) * FILTERS)
                if where:
                    for k, (o, s) in enumerate(zip(offsets, sizes)):
                        first = value[o : o + s].argmax(axis=0)
                        better = most[k] > best[owner[k], own]
                        cells = line[(start[o + first])[:, None] + np.arange(max(WIDTHS))]
                        windows[owner[k], own][better] = cells[better]
                block = best[:, own]
                np.maximum.at(block, owner, most)
        return best, windows

    def logits(self, rows: list[np.ndarray], words: Words) -> np.ndarray:
        best, _ = self.pool(rows, words)
        return np.maximum(best, 0) @ self.dense + self.bias

    def scores(self, texts: list[str | None], words: Words) -> np.ndarray:
        """Probabilities against the threshold of each text's guessed language."""
        rows = [words(t) for t in texts]
        z = self.logits(rows, words) - self.thresholds[languages(rows, words)]
        return 1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30)))


def _adam(value, grad, state, step, rate):
    m, v = state
    m += 0.1 * (grad - m)
    v += 0.001 * (grad * grad - v)
    value -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(value.dtype)


def gradients(model: TextCNN, rows: list[np.ndarray], words: Words, labels: np.ndarray, weight: np.ndarray):
    """Of the weighted mean log loss of some texts: by the parameters (dense, filters, biases), by the
    bias of the output, and by the rows of the embedding that the maximal windows touch."""
    buckets = words.arrays()[0]
    best, windows = model.pool(rows, words, where=True)
    hidden = np.maximum(best, 0)
    z = hidden @ model.dense + model.bias
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    error = ((p - labels) * weight / len(rows)).astype(np.float32)
    back = error[:, None] * model.dense * (best > 0)
    d_filters, d_biases, hit, d_hit = [], [], [], []
    for n, (w, f) in enumerate(zip(WIDTHS, model.filters)):
        cells = windows[:, n * FILTERS : (n + 1) * FILTERS, :w]
        g = back[:, n * FILTERS : (n + 1) * FILTERS]
        vectors = model.embedding[buckets[cells]].mean(axis=3)  # text, filter, place, size
        d_filters.append(np.einsum("tfks,tf->ksf", vectors, g))
        d_biases.append(g.sum(axis=0))
        hit.append(buckets[cells].reshape(-1, 5))
        d_hit.append((np.einsum("ksf,tf->tfks", f, g) / 5).reshape(-1, SIZE))
    touched, place = np.unique(np.concatenate(hit).reshape(-1), return_inverse=True)
    d_embedding = np.zeros((len(touched), SIZE), np.float32)
    np.add.at(d_embedding, place, np.repeat(np.concatenate(d_hit), 5, axis=0))
    d_embedding[touched == 0] = 0
    return [hidden.T @ error, *d_filters, *d_biases], error.sum(), touched, d_embedding


def train(texts: Iterable[str | None], labels: np.ndarray, keep_out: np.ndarray, seed: int = 0, epochs: int = 5, batch: int = 32, rate: float = 0.01, least_steps: int = 300) -> TextCNN:
    """Train on the rows that are not kept out, then calibrate the thresholds on those that are."""
    model, words, rng = TextCNN.fresh(seed), Words(), np.random.default_rng(seed)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    model.bias = float(np.log(share / (1 - share)))
    if len(set(labels.tolist())) < 2:
        model.dense[:] = 0
        return model
    rows = [words(t) for t in texts]
    learn = np.flatnonzero(~keep_out)
    parameters = [model.dense, *model.filters, *model.biases]
    states = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    bias, bias_state = np.array([model.bias]), (np.zeros(1), np.zeros(1))
    m, v = np.zeros_like(model.embedding), np.zeros_like(model.embedding)
    step, steps = 0, max(least_steps, epochs * len(learn) // batch)
    while step < steps and len(learn):
        order = rng.permutation(learn)
        for at in range(0, len(order), batch):
            step += 1
            own = order[at : at + batch]
            weight = np.where(labels[own] > 0, min(8.0, (1 - share) / share), 1.0)
            grads, d_bias, touched, d_embedding = gradients(model, [rows[k] for k in own], words, labels[own], weight)
            lr = rate * (1 - step / (steps + 1))
            for value, grad, state in zip(parameters, grads, states):
                _adam(value, grad, state, step, lr)
            _adam(bias, np.array([d_bias]), bias_state, step, lr)
            model.bias = float(bias[0])
            m_t, v_t, part = m[touched], v[touched], model.embedding[touched]
            _adam(part, d_embedding, (m_t, v_t), step, lr)
            m[touched], v[touched], model.embedding[touched] = m_t, v_t, part
            if step >= steps:
                break
    held = np.flatnonzero(keep_out)
    if len(held):
        model.thresholds = calibrate(model.logits([rows[k] for k in held], words), labels[held], languages([rows[k] for k in held], words))
    return model


def calibrate(z: np.ndarray, labels: np.ndarray, language: np.ndarray, least: int = 10) -> np.ndarray:
    """A threshold for each language: the middle of the cuts with the best F1.

    A language with too few rows of either class gets the threshold of all rows."""

    def best(z, y):
        if not 0 < y.sum() < len(y):
            return 0.0
        order = np.argsort(-z, kind="stable")
        z, y = z[order], y[order]
        hits = np.cumsum(y)
        f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
        cut = np.flatnonzero(f1 >= f1.max() - 1e-12)
        a, b = z[cut[0]], z[min(cut[-1] + 1, len(z) - 1)]
        return float((a + b) / 2)

    whole = best(z, labels)
    out = np.full(len(FUNCTION_WORDS) + 1, whole)
    for k in range(len(out)):
        own = language == k
        if min(labels[own].sum(), (1 - labels[own]).sum()) >= least:
            out[k] = best(z[own], labels[own])
    return out


def _remainder(column: str, k: int):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(k))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MAX_LABELLED) -> TextCNN:
    """Train on labelled rows whose crc32(id) mod 5 is not 0, at most `most` of them."""
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y IS NOT NULL AND doc_id IS NOT NULL")
    marked = marked.where(_remainder("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("y").alias("y"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("body")).join(F.broadcast(marked), "doc_id")  # at most `most` rows
    rows = rows.groupBy("doc_id", "y").agg(F.min("body").alias("body")).withColumn("fold", _remainder("doc_id", 25) % 5)
    # one task gets at most `most` rows and sends the parameters
    rows = rows.select("doc_id", (F.col("y") > 0).cast("int").alias("y"), "fold", "body").repartition(1).sortWithinPartitions("doc_id")
    with text_batches(docs.sparkSession):
        made = rows.mapInArrow(_train_task, "model binary").collect()
    return pickle.loads(made[0].model) if made else train([], np.zeros(0, int), np.zeros(0, bool))


def _train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, labels, folds = [], [], []
    for batch in batches:
        texts += batch.column(3).to_pylist()
        labels += batch.column(1).to_pylist()
        folds += batch.column(2).to_pylist()
    model = train(texts, np.array(labels, int), np.array(folds) == 1)
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def _score(model, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            if words.full():
                words = Words()
            scores = model.value.scores(batch.column(batch.num_columns - 1).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], schema=schema)

    return run


def score_toxicity(docs: DataFrame, model: TextCNN, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted and the carried columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(F.col(id_col).alias("doc_id"), *[F.col(c).alias(f"carry_{c}") for c in carry], F.col(text_col).cast("string").alias("body"))
    out = base.drop("body").withColumn("score", F.lit(0.0))
    scored = stored(base.mapInArrow(_score(shared, to_arrow_schema(out.schema)), out.schema), "toxicity")
    scored = scored.withColumn("held_out", F.coalesce(_remainder("doc_id", 5) == 0, F.lit(False))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    return scored.withColumnsRenamed({f"carry_{c}": c for c in carry})
