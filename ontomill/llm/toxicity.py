"""Toxicity by a convolutional text classifier over hashed word embeddings.

A word is the sum of two of ``BUCKETS`` trained vectors, one hashed from the word and one
from its first ``STEM`` letters, so that inflected forms share what is learned. Filters
of ``WIDTHS`` words run over the whole text, each keeps its largest value (max pooling),
and a logistic layer turns these into a score. The network is trained in numpy (Adam,
minibatches) on the whole texts of at most ``SAMPLE_ROWS`` labelled rows; everything
else covers all rows.

Scores see the text alone. Limits are calibrated on a held-out part of the sample: the
scores are rescaled so that ``LIMIT`` is the best limit over all languages, and each
language with enough rows has a limit of its own on that scale.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontomill.llm.common import rows_where, slices, words_of

BUCKETS = 1 << 15
DIMENSIONS = 12
WIDTHS = (1, 2, 3)
FILTERS = 6
STEM = 4
#: Bound of the training sample, calibration included.
SAMPLE_ROWS = 6_000
EPOCHS = 8
#: Passes over a small sample, which needs more of them: so many steps, in so many passes.
MIN_STEPS, MOST_EPOCHS = 400, 30
#: Weight of the prior of a bucket, in texts.
PRIOR_TEXTS = 6
BATCH = 16
#: The score from which on a text counts as toxic.
LIMIT = 0.7
#: Rows of a language in the calibration part that give it a limit of its own.
LANGUAGE_ROWS = 100
#: The least and the largest limit of a language.
LANGUAGE_LIMITS = (0.5, 0.9)
#: Words that are scored at once.
PIECE_WORDS = 50_000
_PUNCTUATION = b".,;:!?\"'()[]{}<>|*#$%&-_/\\"


class _Buckets(dict):
    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        plain = word.strip(_PUNCTUATION).decode("utf-8", "replace").lower()
        whole = xxhash.xxh32_intdigest(plain or word, 10) % (BUCKETS - 1) + 1
        stem = xxhash.xxh32_intdigest(plain[:STEM] or word, 11) % (BUCKETS - 1) + 1
        if len(self) >= self.LIMIT:
            self.clear()
        found = self[word] = whole << 32 | stem
        return found


def bucket_ids(text: str | None, buckets: _Buckets) -> np.ndarray:
    """The two buckets of every word of a text, a row each; 0 is for padding."""
    words = words_of(text)
    both = np.fromiter(map(buckets.__getitem__, words), np.int64, len(words))
    return np.stack([both >> 32, both & 0xFFFFFFFF], axis=1).astype(np.int32)


@dataclass
class Model:
    """The weights; ``shift`` and ``scale`` calibrate, ``limits`` holds limits by language."""

    table: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    shift: float = 0.0
    scale: float = 1.0
    limits: dict[str, float] = field(default_factory=dict)

    def pooled(self, ids: np.ndarray) -> np.ndarray:
        """The largest value of every filter over one text, whole."""
        reach = max(WIDTHS) - 1
        best = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        for at in range(0, max(1, len(ids)), PIECE_WORDS):
            own = ids[at : at + PIECE_WORDS + reach]
            own = np.concatenate([own, np.zeros((max(0, reach + 1 - len(own)), 2), np.int32)])
            vectors = self.table[own[:, 0]] + self.table[own[:, 1]]
            for w, (weights, bias) in enumerate(zip(self.filters, self.biases)):
                width = WIDTHS[w]
                n = len(own) - width + 1
                total = sum(vectors[k : k + n] @ weights[k] for k in range(width)) + bias
                part = best[w * FILTERS : (w + 1) * FILTERS]
                np.maximum(part, total.max(axis=0), out=part)
        return best

    def logit(self, ids: np.ndarray) -> float:
        return float(self.pooled(ids) @ self.out + self.out_bias)

    def score(self, ids: np.ndarray) -> float:
        z = (self.logit(ids) - self.shift) * self.scale
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    def limit(self, lang: str | None) -> float:
        return self.limits.get(lang, LIMIT)


def _forward_backward(model: Model, texts: list[np.ndarray], labels: np.ndarray):
    """Loss gradient of one minibatch: (rows of the table, their gradient, the rest)."""
    touched, pulls = [], []
    d_filters = [np.zeros_like(f) for f in model.filters]
    d_biases = [np.zeros_like(b) for b in model.biases]
    d_out, d_out_bias = np.zeros_like(model.out), 0.0
    for ids, label in zip(texts, labels):
        vectors = model.table[ids[:, 0]] + model.table[ids[:, 1]]
        pooled, places = [], []
        for weights, bias, width in zip(model.filters, model.biases, WIDTHS):
            n = len(ids) - width + 1
            total = sum(vectors[k : k + n] @ weights[k] for k in range(width)) + bias
            place = total.argmax(axis=0)
            pooled.append(total[place, np.arange(FILTERS)])
            places.append(place)
        values = np.concatenate(pooled)
        active = values > 0
        hidden = np.where(active, values, 0)
        z = float(hidden @ model.out + model.out_bias)
        error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - label
        d_out += error * hidden
        d_out_bias += error
        d_hidden = error * model.out * active
        for w, width in enumerate(WIDTHS):
            for f in np.flatnonzero(d_hidden[w * FILTERS : (w + 1) * FILTERS]):
                pull = d_hidden[w * FILTERS + f]
                at = places[w][f]
                d_biases[w][f] += pull
                for k in range(width):
                    d_filters[w][k, :, f] += pull * vectors[at + k]
                    touched += ids[at + k].tolist()
                    pulls += [pull * model.filters[w][k, :, f]] * 2
    return touched, pulls, [*d_filters, *d_biases, d_out, np.array([d_out_bias])]


def _log_odds(texts: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Of each bucket: log of how much likelier label 1 is in texts that hold it.

    Smoothed by ``PRIOR_TEXTS`` texts with the usual share, so a bucket seen in one text
    says next to nothing.
    """
    seen = np.zeros((2, BUCKETS))
    for ids, label in zip(texts, labels):
        seen[int(label), np.unique(ids)] += 1
    share = min(max(float(labels.mean()), 0.01), 0.99) if len(labels) else 0.5
    own = (seen[1] + PRIOR_TEXTS * share) / (seen.sum(axis=0) + PRIOR_TEXTS)
    return np.log(own / (1 - own)) - np.log(share / (1 - share))


def train(texts: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    """Fit the network; the same rows give the same weights.

    Vectors start at random but for their first number, the smoothed log odds of the
    bucket, which the first filter of each width reads at the start.
    """
    rng = np.random.default_rng(seed)
    model = Model(
        table=(rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))).astype(np.float32),
        filters=[
            rng.normal(0, 0.3, (width, DIMENSIONS, FILTERS)).astype(np.float32) for width in WIDTHS
        ],
        biases=[np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        out=rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32),
        out_bias=-1.0,
    )
    model.table[:, 0] = _log_odds(texts, labels)
    model.table[0] = 0
    for weights in model.filters:
        weights[:, 0, 0] = 1.0 / len(weights)
    reach = max(WIDTHS)
    padded = [np.concatenate([t, np.zeros((reach, 2), np.int32)]) for t in texts]
    dense = [*model.filters, *model.biases, model.out, np.array([model.out_bias])]
    first, second = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense]
    squares = np.zeros(BUCKETS, np.float32)
    step = 0
    wanted = -(-MIN_STEPS * BATCH // max(1, len(texts)))
    for _ in range(max(EPOCHS, min(MOST_EPOCHS, wanted))):
        order = rng.permutation(len(padded))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            touched, pulls, grads = _forward_backward(
                model, [padded[i] for i in chosen], labels[chosen]
            )
            step += 1
            for i, (value, grad) in enumerate(zip(dense, grads)):
                grad = grad / len(chosen)
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.999 * second[i] + 0.001 * grad**2
                rate = 0.01 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                value -= (rate * first[i] / (np.sqrt(second[i]) + 1e-8)).astype(value.dtype)
            model.out_bias = float(dense[-1][0])
            if touched:
                rows, inverse = np.unique(np.array(touched), return_inverse=True)
                total = np.zeros((len(rows), DIMENSIONS), np.float32)
                np.add.at(total, inverse, np.array(pulls, np.float32))
                total /= len(chosen)
                squares[rows] += (total**2).mean(axis=1)
                model.table[rows] -= 0.1 * total / (np.sqrt(squares[rows])[:, None] + 1e-6)
                model.table[0] = 0
    return model


def _best_limit(logits: np.ndarray, labels: np.ndarray) -> float:
    """The limit with the fewest errors, in the middle of the widest gap that has them."""
    values = np.unique(logits)
    limits = np.concatenate([[values[0] - 1], (values[:-1] + values[1:]) / 2, [values[-1] + 1]])
    gaps = np.concatenate([[0.0], np.diff(values), [0.0]])
    toxic = np.sort(logits[labels == 1])
    clean = np.sort(logits[labels == 0])
    missed = np.searchsorted(toxic, limits)
    false = len(clean) - np.searchsorted(clean, limits)
    errors = missed + false
    best = np.flatnonzero(errors == errors.min())
    return float(limits[best[np.argmax(gaps[best])]])


def calibrate(model: Model, texts: list[np.ndarray], labels: np.ndarray, langs: list) -> Model:
    """Rescale scores so that ``LIMIT`` divides best, and set limits by language."""
    if not len(texts) or labels.min() == labels.max():
        return model
    logits = np.array([model.logit(t) for t in texts])
    at = _best_limit(logits, labels)
    model.scale = 1.0
    model.shift = at - float(np.log(LIMIT / (1 - LIMIT)))
    for lang in sorted({x for x in langs if x is not None}):
        own = np.array([x == lang for x in langs])
        if own.sum() >= LANGUAGE_ROWS and labels[own].min() != labels[own].max():
            z = _best_limit(logits[own], labels[own]) - model.shift
            model.limits[lang] = float(np.clip(1 / (1 + np.exp(-z)), *LANGUAGE_LIMITS))
    return model


def learnable(labels: DataFrame) -> DataFrame:
    """``(_id, label)`` of the labels that may be learned from, once for each id.

    Ids whose crc32 as text leaves 1 when divided by 3 are held out; labels other than
    0 and 1 are left out.
    """
    known = labels.select(
        F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("label")
    ).filter("_id is not null and label in (0, 1)")
    known = known.filter(F.crc32(F.col("_id").cast("string").cast("binary")) % 3 != 1)
    return known.groupBy("_id").agg(F.max("label").alias("label"))


def fit(docs: DataFrame, known: DataFrame) -> Model:
    """Train and calibrate on the documents named in ``known`` (``_id``, ``label``).

    The sample is spread over ``known`` by a hash of the id; its ids are at most
    ``SAMPLE_ROWS`` and are broadcast, so no text is shuffled. A third of the sample is
    for calibration. Each text is taken once, null texts not at all. Without two kinds
    of labels, every score is the share of toxic rows.
    """
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_ROWS)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    sample = (
        own.filter(F.col("text").isNotNull())
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
        .select("_id", "text", "lang", "label")
        .limit(2 * SAMPLE_ROWS)  # more only if most ids occur several times
        .toPandas()
        .sort_values(["_id", "text"])
        .drop_duplicates("text", ignore_index=True)
    )
    labels = sample["label"].to_numpy(np.int64)
    buckets = _Buckets()
    texts = [bucket_ids(t, buckets) for t in sample["text"]]
    if not len(labels) or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.0
        none = train([], np.empty(0, np.int64))
        none.out[:] = 0
        none.out_bias = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        return none
    later = np.arange(len(labels)) % 3 == 2
    model = train([t for t, x in zip(texts, later) if not x], labels[~later])
    return calibrate(
        model,
        [t for t, x in zip(texts, later) if x],
        labels[later],
        [lang for lang, x in zip(sample["lang"], later) if x],
    )


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, limit, toxic)`` of every row; the text alone makes the score.

    ``limit`` is that of the row's language, ``toxic`` says whether the score reaches it.
    Null and empty texts have the score of no words. Null ids and repeated rows stay as
    they are; other columns are ignored. Rows keep their partition.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, buckets = shared.value, _Buckets()
        for part in slices(batches):
            scores = [own.score(bucket_ids(t, buckets)) for t in part.column(1).to_pylist()]
            limits = [own.limit(lang) for lang in part.column(2).to_pylist()]
            toxic = [s >= x for s, x in zip(scores, limits)]
            yield pa.record_batch(
                [
                    part.column(0),
                    pa.array(scores, pa.float64()),
                    pa.array(limits, pa.float64()),
                    pa.array(toxic, pa.bool_()),
                ],
                names=["doc_id", "score", "limit", "toxic"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "lang").mapInArrow(
        run, f"doc_id {kind}, score double, limit double, toxic boolean"
    )


def clean_rows(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose score is below the limit of their language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def fits():
        own, buckets = shared.value, _Buckets()

        def judge(texts: list, langs: list) -> list[bool]:
            return [
                own.score(bucket_ids(text, buckets)) < own.limit(lang)
                for text, lang in zip(texts, langs)
            ]

        return judge

    return rows_where(docs, ["text", "lang"], fits)
