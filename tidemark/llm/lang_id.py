"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the average of the embeddings of its hashed byte n-grams, a linear
layer and softmax follow; both are trained by stochastic gradient descent in
numpy on a bounded sample.  Documents of the sample that were held back set a
temperature, so that scores are probabilities, and the bounds under which a text
is rejected, for each length of text its own: of the score, and of how usual its
n-grams are in the language found.  The second refuses noise and languages that
were never learned, about which a softmax may be sure.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

BUCKET_BITS = 13
ORDERS = (1, 2, 3, 4)
DIMENSION = 16
UNKNOWN = "und"

#: ASCII but letters separates words, letters are lower-cased.
_CLEAN = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_LETTER = regex.compile(r"\p{L}")
_SEEDS = [np.uint32(x) for x in (2654435761, 2246822519, 3266489917, 668265263)]
SNIPPET_WORDS = (2, 4, 8, 16)


def bucket_counts(text: bytes) -> np.ndarray:
    """How often each bucket of n-grams occurs in a text; n-grams don't cross words."""
    words = text.translate(_CLEAN).split()
    if not words:
        return np.zeros(1 << BUCKET_BITS, np.int64)
    clean = b" " + b" ".join(words) + b" "
    data = np.frombuffer(clean, np.uint8).astype(np.uint32)
    space = data == 32
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    gram = data.copy()
    inner = np.zeros(len(data), bool)  # a space that isn't the first or the last byte
    for order in ORDERS:
        if order > 1:
            gram = gram[: len(data) - order + 1] | (data[order - 1 :] << np.uint32(8 * (order - 1)))
            if order > 2:
                inner = inner[: len(gram)] | space[order - 2 : order - 2 + len(gram)]
            else:
                inner = inner[: len(gram)]
        bad = space if order == 1 else inner
        hashed = ((gram ^ (gram >> np.uint32(15))) * _SEEDS[order - 1]) >> np.uint32(32 - BUCKET_BITS)
        out += np.bincount(hashed[~bad], minlength=1 << BUCKET_BITS)
    return out


#: Rows whose texts a task holds as Python objects.
SLICE = 256

#: Texts are calibrated by their number of different n-grams, as repetition tells
#: nothing new: up to 2**4, 2**6, ..., and beyond 2**12.
LENGTHS = 2.0 ** np.arange(4, 14, 2)


def length_class(n_grams: np.ndarray) -> np.ndarray:
    return np.searchsorted(LENGTHS, n_grams)


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # buckets x languages: embeddings times the linear layer
    bias: np.ndarray
    temperature: float
    usual: np.ndarray  # buckets x languages: logarithm of a bucket's share of a language's n-grams
    least_score: np.ndarray  # for each class of length
    least_usual: np.ndarray

    @classmethod
    def refusing(cls, languages: list[str]) -> LanguageModel:
        """Has learned nothing and rejects every text."""
        zeros = np.zeros((1 << BUCKET_BITS, len(languages)), np.float32)
        return cls(languages, zeros, np.zeros(len(languages), np.float32), 1.0, zeros, np.full(len(LENGTHS) + 1, 2.0), np.zeros(len(LENGTHS) + 1))

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float, bool]]:
        """Language, score and whether it is rejected, for each text."""
        for text in texts:
            if not text or not _LETTER.search(text):
                yield UNKNOWN, 0.0, True
                continue
            counts = bucket_counts(text.encode())
            used = np.flatnonzero(counts)
            values = counts[used]
            total = max(1, int(values.sum()))
            logits = (values @ self.weights[used] / total + self.bias) / self.temperature
            odds = np.exp(logits - logits.max())
            best = int(odds.argmax())
            score = float(odds[best] / odds.sum())
            length = int(length_class(len(used)))
            usual = float(values @ self.usual[used, best]) / total
            yield self.languages[best], score, score < self.least_score[length] or usual < self.least_usual[length]


def dense(features: list[tuple[np.ndarray, np.ndarray]], rows: np.ndarray) -> np.ndarray:
    """Some rows of features (buckets and their values) as a matrix."""
    out = np.zeros((len(rows), 1 << BUCKET_BITS), np.float32)
    for k, row in enumerate(rows.tolist()):
        used, values = features[row]
        out[k, used] = values
    return out


def train(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, *, epochs: int = 12, batch: int = 32, rate: float = 0.2, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings and linear layer by stochastic gradient descent; returns their product and the bias.

    features: each row's buckets and their n-gram counts divided by the row's
    sum; a matrix is made of a few rows at a time.  Rows are drawn in shuffled
    order, classes in equal weight.
    """
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSION)).astype(np.float32)
    layer = rng.normal(0, 0.5, (DIMENSION, classes)).astype(np.float32)
    bias = np.zeros(classes, np.float32)
    share = np.bincount(labels, minlength=classes).astype(np.float32)
    weight = (len(labels) / np.maximum(share, 1) / max(1, (share > 0).sum()))[labels]
    scale = 1.0 / max(1e-9, float(np.mean([(values**2).sum() for _, values in features])))  # averages are short vectors
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(len(labels))
        for start in range(0, len(order), batch):
            rows = order[start : start + batch]
            x = dense(features, rows)
            hidden = x @ table
            logits = hidden @ layer + bias
            odds = np.exp(logits - logits.max(1, keepdims=True))
            odds /= odds.sum(1, keepdims=True)
            odds[np.arange(len(rows)), labels[rows]] -= 1
            odds *= (weight[rows] / len(rows))[:, None]
            back = odds @ layer.T
            layer -= step * (hidden.T @ odds)
            bias -= np.float32(0.1) * step * odds.sum(0)
            table -= np.float32(step * scale) * (x.T @ back)
    return table @ layer, bias


def best_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss."""
    best = (np.inf, 1.0)
    for temperature in np.geomspace(0.05, 20, 61):
        z = logits / temperature
        z = z - z.max(1, keepdims=True)
        loss = float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(labels)), labels]))
        best = min(best, (loss, float(temperature)))
    return best[1]


def bounds(values: np.ndarray, lengths: np.ndarray, reject_share: float) -> np.ndarray:
    """For each class of length what at most ``reject_share`` of these values lie under, with a margin below.

    The margin is half as far again as that quantile is from the median.  A class
    of fewer than 20 values takes those of its neighbours too.
    """
    out = np.full(len(LENGTHS) + 1, -np.inf)
    for k in range(len(out)):
        reach = 0
        own = values[lengths == k]
        while len(own) < 20 and reach <= len(out):
            reach += 1
            own = values[np.abs(lengths - k) <= reach]
        if len(own):
            low = np.quantile(own, reject_share)
            out[k] = low - (np.median(own) - low) / 2
    return out


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = 200, reject_share: float = 0.001) -> LanguageModel:
    """Trains on at most about ``rows_per_language`` labelled rows of each label.

    The sample is chosen by a hash of id and text, so it does not depend on how
    rows are partitioned, and rows without an id are drawn like others; twice the
    expected number of rows is never passed, even if all rows are alike.  Of each
    sampled text the whole and short runs of its words are learned, so that
    scores hold for short texts too.  A fifth of the documents, by a hash of the
    text, is held back with all its parts and sets temperature and bounds.  Only
    feature vectors of fixed size reach the driver, and the counts of labels.
    Rows without a label or a text are left out, as are texts without a letter.
    Without any labelled row, or any sampled one with a letter, the model rejects
    everything.  The driver holds the counts of labels and the model: 64 kB for
    each label, and as much again while it is made, so 10,000 labels take a
    gigabyte and a half.
    """
    labelled = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    counts = labelled.groupBy("lang").count().collect()
    names = sorted(row["lang"] for row in counts)
    if not names:
        return LanguageModel.refusing([UNKNOWN])
    # A row for each label, all of which the model holds anyway.
    shares = labelled.sparkSession.createDataFrame([(row["lang"], min(1.0, rows_per_language / row["count"])) for row in counts], "lang string, bound double")
    draw = F.pmod(F.xxhash64(F.lit(11), F.col("doc_id"), F.col("text")), F.lit(1 << 30)) / float(1 << 30)
    position = {lang: k for k, lang in enumerate(names)}

    def run(batches):
        for batch in slices(batches, SLICE):
            rows = []
            for drawn, text, lang in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if not _LETTER.search(text):
                    continue
                words = text.split()
                rng = np.random.default_rng(len(text))
                held = zlib.crc32(text.encode()) % 5 == 0
                parts = [text]
                for n in SNIPPET_WORDS:
                    at = int(rng.integers(0, max(1, len(words) - n + 1)))
                    parts.append(" ".join(words[at : at + n]))
                for part in parts:
                    c = bucket_counts(part.encode())
                    used = np.flatnonzero(c)
                    if len(used):
                        rows.append((drawn, position[lang], held, used.astype("<u2").tobytes(), c[used].astype("<u4").tobytes()))
            kinds = (pa.float64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)], names=["draw", "lang", "held", "used", "n"])

    most = 2 * (1 + len(SNIPPET_WORDS)) * rows_per_language * len(names)
    order = ["draw", "lang", "used", "n"]
    drawn = labelled.withColumn("draw", draw).join(F.broadcast(shares), "lang").where(F.col("draw") < F.col("bound")).select("draw", "text", "lang")
    sample = drawn.mapInArrow(run, "draw double, lang int, held boolean, used binary, n binary").orderBy(*order).limit(most).toArrow()
    if not sample.num_rows:
        return LanguageModel.refusing(names)
    features, lang, held = [], sample.column("lang").to_numpy(), sample.column("held").to_numpy()
    sizes = np.zeros(len(lang))
    for k, (used, n) in enumerate(zip(sample.column("used").to_pylist(), sample.column("n").to_pylist(), strict=True)):
        values = np.frombuffer(n, "<u4").astype(np.float32)
        sizes[k] = values.sum()
        features.append((np.frombuffer(used, "<u2"), values / values.sum()))
    del sample
    if held.all() or not held.any():
        held = np.arange(len(lang)) % 5 == 0 if len(lang) > 1 else np.zeros(len(lang), bool)
    learned = np.flatnonzero(~held)
    weights, bias = train([features[k] for k in learned], lang[learned], len(names))
    usual = np.full((1 << BUCKET_BITS, len(names)), 0.1)
    for k in learned.tolist():
        np.add.at(usual[:, lang[k]], features[k][0], features[k][1].astype(float) * sizes[k])
    usual = np.log(usual / usual.sum(0)).astype(np.float32)
    probe = np.flatnonzero(held) if held.any() else learned
    logits = np.concatenate([dense(features, probe[k : k + 256]) @ weights + bias for k in range(0, len(probe), 256)])
    temperature = best_temperature(logits, lang[probe])
    odds = np.exp((logits - logits.max(1, keepdims=True)) / temperature)
    best = odds.argmax(1)
    right = np.flatnonzero(best == lang[probe])
    scores = (odds.max(1) / odds.sum(1))[right]
    typical = np.array([features[probe[k]][1] @ usual[features[probe[k]][0], best[k]] for k in right])
    lengths = length_class(np.array([len(features[k][0]) for k in probe[right]]))
    # A text that is more likely right than wrong isn't rejected for its score.
    least_score = np.minimum(0.5, bounds(scores, lengths, reject_share))
    # N-grams of nowhere fall into all buckets alike; a quarter of the way there a text is still let through.
    nowhere = float(usual.mean())
    least_usual = bounds(typical, lengths, reject_share)
    return LanguageModel(names, weights, bias, temperature, usual, least_score, least_usual - np.maximum(0, least_usual - nowhere) / 4)


def predict(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", added: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """The rows of docs with ``lang_pred, score, rejected``, from their whole texts alone.

    A null text or one without a letter is ``und`` with score 0, and rejected.
    Repeated rows are scored each; an empty table gives no rows; columns of docs
    that bear one of the three names, for which ``added`` gives others, are
    replaced.
    """
    source = docs.drop(*added)
    at = source.columns.index(text_col)

    def run(batches):
        for batch in slices(batches, SLICE):
            found = list(model.predict(batch.column(at).to_pylist()))
            columns = list(zip(*found, strict=True)) if found else [(), (), ()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.bool_())], names=[*batch.schema.names, *added])

    schema = T.StructType(list(source.schema.fields)).add(added[0], "string").add(added[1], "double").add(added[2], "boolean")
    return source.mapInArrow(run, schema)
