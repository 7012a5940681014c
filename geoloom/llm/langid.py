"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from all documents that may be learned from. The weights are learned by follow-the-regularised-
leader with elastic-net penalties from a bounded sample of labelled documents, then a temperature is fitted on a part
of the sample that the weights have not seen. Prediction is one pass without a shuffle, over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.arrow import append, utf8

BUCKETS = 1 << 15            # hashed n-grams
ORDERS = (1, 2, 3)
SAMPLE_ROWS = 3_000          # bound of the labelled sample, shared evenly between the languages
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """For each character below U+10000 its lower case, or a space if it is no letter."""
    t = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        if (x := chr(c)).isalpha():
            low = x.lower()
            t[c] = ord(low) if len(low) == 1 else c
    return t


_tables: dict[str, np.ndarray] = {}


def _codes(text: bytes) -> np.ndarray:
    """Lower-case letters of a UTF-8 text as code points, each run of other characters as one space, a space at each end."""
    if "letters" not in _tables:
        _tables["letters"] = _letters()
    raw = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    low = _tables["letters"][np.minimum(raw, 0xFFFF)]
    if len(raw) and raw.max() > 0xFFFF:
        for c in np.unique(raw[raw > 0xFFFF]):
            low[raw == c] = ord(chr(c).lower()) if chr(c).isalpha() else 32
    padded = np.concatenate([[32], low, [32]]).astype(np.uint32)
    return padded[np.concatenate([[True], (padded[1:] != 32) | (padded[:-1] != 32)])]


def grams(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams, rising, and how often each occurs; nothing for a text without letters."""
    c = _codes(text)
    if not (c != 32).any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    counts, h = np.zeros(BUCKETS, np.int64), np.zeros(len(c) + 1, np.uint32)
    shift = np.uint32(33 - BUCKETS.bit_length())
    for n in range(1, max(ORDERS) + 1):
        h = (h[:-1] * np.uint32(0x01000193) + c[n - 1:]) * np.uint32(0x9E3779B1) if n > 1 else (c + np.uint32(7)) * np.uint32(0x9E3779B1)
        if n in ORDERS and len(h):
            counts += np.bincount((h * np.uint32(0x85EBCA6B) >> shift).astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def _each(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    data, offsets = utf8(texts)
    raw = memoryview(data)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield grams(bytes(raw[a:b]))


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """How many documents hold each bucket, and how many there are. Tasks add up first; the driver gets one row a bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for at, _ in _each(batch.column(0)):
                df[at] += 1
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int64()), pa.array([*df[at].tolist(), n], pa.int64())],
                                         names=["bucket", "df"])
    got = docs.select(text).mapInArrow(run, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toArrow()
    bucket, df = got.column("bucket").to_numpy(), got.column("df").to_numpy()
    out = np.zeros(BUCKETS, np.int64)
    out[bucket[bucket >= 0]] = df[bucket >= 0]
    return out, int(df[bucket < 0].sum())


@dataclass
class LanguageModel:
    """Everything a prediction needs: languages, idf by bucket, weights (bucket x language), bias and temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.bias + _tfidf(at, counts, self.idf) @ self.weights[at]

    def predict(self, at: np.ndarray, counts: np.ndarray) -> tuple[str, float]:
        if not len(at) or not self.languages:
            return UNKNOWN, 0.0
        p = _softmax(self.logits(at, counts) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def _tfidf(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1.0 + np.log(counts)) * idf[at]
    return x / max(np.sqrt((x * x).sum()), 1e-12)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, epochs: int = EPOCHS,
                      alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias; ``rows`` holds each example's buckets and values. The bias is one more, unpenalised, bucket.

    Each coordinate keeps the sum of its adjusted gradients (``z``) and of their squares (``n``); its weight is zero while
    ``|z|`` is at most ``l1``, which keeps the model sparse.
    """
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))
    order, rng = np.arange(len(rows)), np.random.default_rng(0)

    def weights(at: np.ndarray) -> np.ndarray:
        zz, pen = z[at], np.where(at == BUCKETS, 0.0, l1)[:, None]
        rate = (beta + np.sqrt(n[at])) / alpha + np.where(at == BUCKETS, 0.0, l2)[:, None]
        return np.where(np.abs(zz) <= pen, 0.0, (np.sign(zz) * pen - zz) / rate)

    for _ in range(epochs):
        rng.shuffle(order)
        for i in order:
            at, x = np.append(rows[i][0], BUCKETS), np.append(rows[i][1], 1.0)
            w = weights(at)
            p = _softmax(x @ w)
            p[labels[i]] -= 1.0
            g = x[:, None] * p
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
    w = weights(np.arange(BUCKETS + 1))
    return w[:-1], w[-1]


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss on examples the weights have not seen, from a grid that is even in the logarithm."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean()
    return float(min(np.geomspace(0.05, 20.0, 121), key=loss))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Learns from the documents given that have a text and a language; all of them count for the document frequencies.

    Of each language, documents are taken by the hash of their text, copies once, so the sample doesn't depend on how the
    table is stored. With no labelled row the model has no language and predicts ``und``.
    """
    named = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    df, total = document_frequencies(named, "text")
    sizes = {r["lang"]: r["n"] for r in named.groupBy("lang").agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), "lang").limit(sample_rows).collect()}
    if not sizes:
        return LanguageModel([], np.zeros(BUCKETS), np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    each, span = max(1, sample_rows // len(sizes)), 1 << 30
    share = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, min(span, span * each // n + 1))])
    draw = F.pmod(F.xxhash64("text"), F.lit(span))
    sample = named.where(draw < share[F.col("lang")]).select(
        "text", "lang", F.xxhash64("text").alias("draw")).dropDuplicates(["draw", "lang"])

    def featured(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        got = list(_each(batch.column(0)))
        return {"at": pa.array([g[0].astype(np.int32) for g in got], pa.list_(pa.int32())),
                "n": pa.array([g[1].astype(np.int32) for g in got], pa.list_(pa.int32()))}
    rows = append(sample, featured, "at array<int>, n array<int>").drop("text").orderBy("draw", "lang").limit(
        2 * sample_rows).toArrow()
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0
    languages = sorted(sizes)
    code = {k: i for i, k in enumerate(languages)}
    examples, labels, aside = [], [], []
    for at, n, name, draw_ in zip(rows.column("at"), rows.column("n"), rows.column("lang").to_pylist(), rows.column("draw").to_pylist()):
        a = at.values.to_numpy(zero_copy_only=False).astype(np.int64)
        if len(a):
            examples.append((a, _tfidf(a, n.values.to_numpy(zero_copy_only=False), idf)))
            labels.append(code[name])
            aside.append((draw_ >> 40) % 5 == 0)
    labels, aside = np.array(labels, np.int64), np.array(aside, bool)
    learn = np.flatnonzero(~aside) if (~aside).any() else np.arange(len(labels))
    w, b = follow_the_leader([examples[i] for i in learn], labels[learn], len(languages))
    held = np.flatnonzero(aside)
    z = np.array([b + examples[i][1] @ w[examples[i][0]] for i in held]).reshape(len(held), len(languages))
    return LanguageModel(languages, idf, w, b, calibrate(z, labels[held]))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """All columns and ``lang_pred``, ``score`` (the calibrated probability of the language given).

    ``und`` with score 0 for null texts and texts without a letter. Columns named like the added ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)     # bounded: BUCKETS x languages

    def one(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        got = [shared.value.predict(at, n) for at, n in _each(batch.column(text))]
        return {"lang_pred": pa.array([g[0] for g in got], pa.string()), "score": pa.array([g[1] for g in got], pa.float64())}
    return append(docs, one, "lang_pred string, score double")


def held_out(key: Column) -> Column:
    """Documents kept for measuring: one in three by the checksum of the key; a null key counts as the text ``null``."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")) % 3 == 1
