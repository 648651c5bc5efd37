"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another. Each has a logistic model over the words
and word beginnings of a text and the probabilities of the categories before it; for
training, these come from models that did not see the row (out of fold), so that a
later model learns from probabilities as good as those it gets when it scores.
The last category is the label ``toxic`` itself, and decides. The categories before it
are kinds of toxic rows that the labels themselves show: the rows with the word that
most toxic rows have and few others, then of the rest those with the next such word, and
what remains. No word is given from outside.

Features are taken on the executors: the driver gets the numbers of the features that
tell toxic rows from others, never texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import choose, labelled_texts
from .session import Scratch, bound_batches
from .textbytes import SPACED_WORD, Run, ascii_fold, byte_class, find_words, runs

#: Bound of the labelled sample, in rows.
SAMPLE_ROWS = 6000
FOLDS = 5
#: Word beginnings, in bytes, that are features beside whole words.
BEGINNINGS = (4, 5, 6, 7)
#: A feature is used where at least so many positive rows have it; so many of the strongest are kept.
LEAST_ROWS, MOST_FEATURES = 3, 600
#: Features that go to the driver: the strongest by log ratio times rows, of those with at least so large a log ratio over the whole sample.
SENT_FEATURES, SENT_RATIO = 4 * MOST_FEATURES, 1.0
#: Kinds of toxic rows before the label itself; the last kind is what no word of the others covers.
KINDS = 3
CHAIN = (*(f"kind_{i}" for i in range(1, KINDS + 1)), "toxic")
_WORD_MARK = np.uint64(1 << 63)

_LETTERS = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)) & SPACED_WORD
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def features(run: Run) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs of a run, by text: hashes of words, and beginnings as numbers."""
    fold = ascii_fold()
    words = find_words(run, _LETTERS, fold)
    if not len(words.hash):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    padded = np.concatenate((fold[run.data], np.zeros(8, np.uint8)))
    head = np.ascontiguousarray(padded[words.start[:, None] + np.arange(8)[None, :]]).view(np.uint64)[:, 0]
    size = words.end - words.start
    text, value = [words.text], [words.hash | _WORD_MARK]
    for n in BEGINNINGS:
        longer = size >= n
        text.append(words.text[longer])
        value.append(((head[longer] & (_ONES >> np.uint64(64 - 8 * n))) ^ np.uint64(n << 56)) & ~_WORD_MARK)
    text, value = np.concatenate(text), np.concatenate(value)
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[fresh], value[fresh]


@dataclass
class Linear:
    """A logistic model: feature weights (features sorted), weights of earlier categories, bias."""

    features: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def predict(self, rows: int, text: np.ndarray, value: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        logit = np.full(rows, self.bias)
        if len(self.features) and len(value):
            at = np.minimum(np.searchsorted(self.features, value), len(self.features) - 1)
            found = self.features[at] == value
            logit += np.bincount(text[found], self.weights[at[found]], rows)
        if len(self.earlier):
            logit += earlier @ self.earlier
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit_linear(text: np.ndarray, number: np.ndarray, distinct: np.ndarray, earlier: np.ndarray, label: np.ndarray, use: np.ndarray, rounds: int = 200, ridge: float = 1e-3) -> Linear:
    """Fitted on the rows where ``use``; features are chosen on these rows too.

    ``text`` and ``number`` are pairs of a row and the index of a feature in ``distinct``.
    """
    positive = (use & (label == 1))[text]
    df_pos = np.bincount(number[positive], minlength=len(distinct))
    df_neg = np.bincount(number[(use & (label == 0))[text]], minlength=len(distinct))
    n_pos, n_neg = int((use & (label == 1)).sum()), int((use & (label == 0)).sum())
    ratio = np.log((df_pos + 0.5) / (n_pos + 1)) - np.log((df_neg + 0.5) / (n_neg + 1))
    strength = np.where((df_pos >= LEAST_ROWS) & (ratio > 1.5), ratio * df_pos, 0)
    chosen = np.sort(np.argsort(-strength, kind="stable")[: min(MOST_FEATURES, int((strength > 0).sum()))])
    picked = distinct[chosen]
    extra = earlier.shape[1]
    if not n_pos or not n_neg:
        return Linear(picked[:0], np.zeros(0), np.zeros(extra), 8.0 if n_pos else -8.0)
    place = np.full(len(distinct), -1)
    place[chosen] = np.arange(len(chosen))
    keep = np.flatnonzero((place[number] >= 0) & use[text])
    row, col = text[keep], place[number[keep]]
    y, scale = label[use], 1 / use.sum()
    renumber = np.cumsum(use) - 1
    row, dense = renumber[row], earlier[use]
    w, u, b = np.zeros(len(chosen)), np.zeros(extra), float(np.log(n_pos / n_neg))
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, u, np.zeros(1))]
    for t in range(1, rounds + 1):
        logit = b + np.bincount(row, w[col], len(y)) + dense @ u
        error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * scale
        grads = (np.bincount(col, error[row], len(w)) + ridge * w * 0.1, dense.T @ error + ridge * u * 0.1, np.array([error.sum()]))
        steps = []
        for g, m in zip(grads, moments, strict=True):
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.01 * (g * g - m[1])
            steps.append(0.1 * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.99**t)) + 1e-8))
        w, u, b = w - steps[0], u - steps[1], b - float(steps[2][0])
    return Linear(picked, w, u, b)


@dataclass
class Chain:
    names: tuple[str, ...]
    models: list[Linear]
    threshold: float

    def predict(self, rows: int, text: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Probabilities (rows, categories); each model sees those before it."""
        out = np.zeros((rows, len(self.models)))
        for i, model in enumerate(self.models):
            out[:, i] = model.predict(rows, text, value, out[:, :i])
        return out


def category_labels(text: np.ndarray, value: np.ndarray, toxic: np.ndarray, kinds: int = KINDS) -> dict[str, np.ndarray]:
    """0/1 per category of the chain, from the label and the (row, feature) pairs.

    Each kind but the last is the toxic rows, not yet of a kind, with the word that most of
    them have, among words of which toxic rows make up nine in ten of its rows at least; ties go to the least hash.
    """
    rest = toxic == 1
    out: dict[str, np.ndarray] = {}
    words = (value & _WORD_MARK) != 0
    distinct, number = np.unique(value[words], return_inverse=True)
    row = text[words]
    in_toxic = np.bincount(number[toxic[row] == 1], minlength=len(distinct))
    telling = 10 * in_toxic >= 9 * np.bincount(number, minlength=len(distinct))
    for i in range(1, kinds):
        counts = np.where(telling, np.bincount(number[rest[row]], minlength=len(distinct)), 0)
        has = np.zeros(len(toxic), bool)
        if len(counts) and counts.max() >= LEAST_ROWS:
            has[row[number == counts.argmax()]] = True
        out[f"kind_{i}"] = (rest & has).astype(np.int64)
        rest &= ~has
    return out | {f"kind_{kinds}": rest.astype(np.int64), "toxic": toxic.astype(np.int64)}


def fit_chain(text: np.ndarray, value: np.ndarray, fold: np.ndarray, labels: dict[str, np.ndarray], names: tuple[str, ...] = CHAIN, folds: int = FOLDS) -> Chain:
    """``text``, ``value``: (row, feature) pairs. ``labels``: 0/1 per row for each name. The threshold is the best F1 out of fold."""
    rows = len(fold)
    distinct, number = np.unique(value, return_inverse=True)
    held, models = np.zeros((rows, len(names))), []
    for i, name in enumerate(names):
        y = labels[name]
        for f in range(folds):
            out = fold == f
            model = fit_linear(text, number, distinct, held[:, :i], y, ~out)
            held[out, i] = model.predict(rows, text, value, held[:, :i])[out]
        models.append(fit_linear(text, number, distinct, held[:, :i], y, np.ones(rows, bool)))
    return Chain(names, models, best_threshold(held[:, -1], labels[names[-1]]))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    if not len(p) or not y.any():
        return 0.5
    tries = np.linspace(0.2, 0.8, 25)
    f1 = [2 * (y[p >= t] == 1).sum() / max(1, (p >= t).sum() + y.sum()) for t in tries]
    best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-9)
    return float(tries[best[len(best) // 2]])


def _row_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, label) to (doc_id, label, fold, features); equal texts have one fold."""
    import zlib

    for batch in batches:
        for run in runs(batch.column(1)):
            part = batch.slice(run.first, run.last - run.first)
            text, value = features(run)
            at = np.searchsorted(text, np.arange(run.last - run.first + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(value.view(np.int64)))
            fold = [zlib.crc32(run.data[a:b].tobytes()) % FOLDS for a, b in zip(run.bounds[:-1], run.bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(fold, pa.int32()), lists], names=["doc_id", "label", "fold", "features"])


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, keep: Column | None = None) -> Chain:
    """Fitted on at most ``rows`` labelled rows (of those that ``keep`` takes), whole texts.

    A row with a null id, text or label is not fitted on; without any rows of either label the chain knows only its bias.
    """
    bound_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "toxicity")
    found = labelled_texts(docs, choose(labels, "toxic", rows, keep)).dropDuplicates(["doc_id", "text"])
    table = scratch.keep(found.mapInArrow(_row_features, "doc_id long, label int, fold int, features array<long>"))
    per_row = table.select("doc_id", "label", "fold", F.explode("features").alias("feature"))
    n = table.agg(F.count_if(F.col("label") == 1).alias("yes"), F.count_if(F.col("label") == 0).alias("no")).first()
    counts = per_row.groupBy("feature").agg(F.count_if(F.col("label") == 1).alias("yes"), F.count_if(F.col("label") == 0).alias("no")).where(F.col("yes") >= LEAST_ROWS)
    ratio = F.log((F.col("yes") + 0.5) / (n.yes + 1)) - F.log((F.col("no") + 0.5) / (n.no + 1))
    best = counts.select("feature", ratio.alias("ratio"), (ratio * F.col("yes")).alias("strength")).where(F.col("ratio") > SENT_RATIO).orderBy(F.desc("strength"), "feature").limit(SENT_FEATURES).select("feature")
    telling = per_row.join(F.broadcast(best), "feature").groupBy("doc_id", "label", "fold").agg(F.sort_array(F.collect_set("feature")).alias("features"))
    # Bounded by the sample's rows, each with some of ``SENT_FEATURES`` numbers.
    with_any = {(r.doc_id, r.label, r.fold): r.features for r in telling.collect()}
    rows_of_sample = sorted(map(tuple, table.select("doc_id", "label", "fold").distinct().collect()))
    scratch.close()
    text = np.repeat(np.arange(len(rows_of_sample)), [len(with_any.get(k, ())) for k in rows_of_sample]).astype(np.int64)
    value = np.array([f for k in rows_of_sample for f in with_any.get(k, ())], np.int64).view(np.uint64)
    toxic, fold = np.array([k[1] for k in rows_of_sample], np.int64), np.array([k[2] for k in rows_of_sample], np.int64)
    return fit_chain(text, value, fold, category_labels(text, value, toxic))


def score_documents(docs: DataFrame, chain: Chain) -> DataFrame:
    """Category probabilities of each whole text, and the verdict ``rejected``.

    One row per row of ``docs`` with doc_id, p_<category> ..., score (the last category),
    predicted (0 or 1), rejected. Null or repeated ids stay; a null text counts as empty
    and has the models' biases. Only doc_id and text are read.
    """
    bound_batches(docs.sparkSession)
    names = [f"p_{n}" for n in chain.names]
    schema = "doc_id long, " + ", ".join(f"{n} double" for n in names) + ", score double, predicted int, rejected boolean"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch.column(1)):
                p = chain.predict(run.last - run.first, *features(run))
                over = p[:, -1] >= chain.threshold
                columns = [batch.column(0).slice(run.first, run.last - run.first), *(pa.array(p[:, i]) for i in range(p.shape[1])), pa.array(p[:, -1]), pa.array(over.astype(np.int32)), pa.array(over)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *names, "score", "predicted", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, schema)


def drop_toxic(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the chain does not reject.

    A null text counts as empty: it has no features, so the bias alone judges it, and it stays. Repeated rows are judged alike.
    """
    bound_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch.column(at)):
                p = chain.predict(run.last - run.first, *features(run))
                yield batch.slice(run.first, run.last - run.first).filter(pa.array(p[:, -1] < chain.threshold))

    return docs.mapInArrow(work, docs.schema)
