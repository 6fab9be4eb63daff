"""Language identification with error-correcting output codes.

Each language gets a codeword. One binary classifier per code bit, a logistic regression on hashed byte n-grams, predicts
that bit's sign; a document's language is the one whose codeword costs least under the loss summed over bits.

Fit: a sample of at most ``train_rows`` labelled rows, as many of each language, is featurised on the executors; one
task gets those rows' sparse counts and fits, and the driver gets the model alone. Prediction reads every whole text in
one pass without a shuffle.

Defined results: a text that is null or holds no letter gives ``und`` with score 0; without any labelled row every text
is ``und``; with one language that language has score 1. A row whose id is null is never learned from. Equal texts get
equal answers, as nothing but the text enters a prediction. Columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import arrow_rows, map_rows, utf8

#: Cells of the hashed n-gram space, for two- and three-byte grams each.
CELLS = 4096
UND = "und"
#: Languages that a model may have: one row each comes to the driver.
MAX_LANGUAGES = 1000
#: Bytes as features see them: ASCII letters in lower case, every other ASCII byte a blank, bytes of longer characters kept.
FOLD = np.array([(b | 32) if chr(b).isalpha() and b < 128 else b if b >= 128 else 32 for b in range(256)], dtype=np.uint8)
#: Bytes of a text that are counted at a time.
CHUNK = 1 << 20


def gram_counts(data: bytes) -> np.ndarray:
    """Counts of hashed two- and three-byte grams over a whole text. Grams of blanks alone are left out."""
    counts = np.zeros(2 * CELLS, dtype=np.int64)
    for at in range(0, max(1, len(data)), CHUNK):
        a = FOLD[np.frombuffer(data[max(0, at - 2) : at + CHUNK], dtype=np.uint8)].astype(np.uint32)
        if len(a) < 3:
            a = np.concatenate([a, np.full(3 - len(a), 32, np.uint32)])
        two = a[:-1] * 251 + a[1:]
        three = (two[:-1] * 241 + a[2:]) * 2654435761 >> 20
        two = two * 2246822519 >> 20
        counts[:CELLS] += np.bincount(two[1 if at else 0 :], minlength=CELLS)
        counts[CELLS:] += np.bincount(three, minlength=CELLS)
    counts[(32 * 251 + 32) * 2246822519 % (1 << 32) >> 20] = 0
    counts[CELLS + (((32 * 251 + 32) * 241 + 32) * 2654435761 % (1 << 32) >> 20)] = 0
    return counts


def features(counts: np.ndarray) -> np.ndarray:
    """Square roots of relative frequencies."""
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32)


def codewords(n: int) -> np.ndarray:
    """A row of signs for each of n languages: exhaustive codes up to seven languages, else random ones with distinct rows and columns."""
    if n <= 1:
        return np.ones((n, 0), dtype=np.int8)
    if n <= 7:
        bits = np.arange(1, 2 ** (n - 1))
        signs = np.array([[1 if n - 1 == k or not b >> k & 1 else -1 for b in bits] for k in range(n)])
        return signs.astype(np.int8)
    rng, width, best, far = np.random.default_rng(n), 10 * int(np.ceil(np.log2(n))), None, -1
    for _ in range(32):
        columns: dict[bytes, np.ndarray] = {}
        while len(columns) < width:  # neither equal nor opposite ones, nor one that tells nothing apart
            c = rng.choice(np.array([-1, 1], np.int8), n)
            c *= c[0]
            if c.min() < 0:
                columns[c.tobytes()] = c
        codes = np.stack(list(columns.values()), axis=1)
        apart = int((codes[:, None, :] != codes[None]).sum(2)[~np.eye(n, dtype=bool)].min())
        if apart > far:
            best, far = codes, apart
    return best


@dataclass(frozen=True)
class Model:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    margin: float

    def decode(self, x: np.ndarray) -> tuple[str, float, bool]:
        """Language, score and whether the two nearest codewords are too close to tell apart."""
        if len(self.languages) < 2:
            return (self.languages[0], 1.0, False) if self.languages else (UND, 0.0, True)
        loss = np.logaddexp(0, -self.codes * (x @ self.weights + self.bias)).sum(1)
        order = np.argsort(loss, kind="stable")
        share = np.exp(loss[order[0]] - loss)
        return self.languages[order[0]], float(1 / share.sum()), bool(loss[order[1]] - loss[order[0]] < self.margin)


def fit(x: np.ndarray, labels: list[str], margin: float, rounds: int = 300, ridge: float = 1e-4, *, keep: bool = True) -> Model:
    """Full-batch logistic regression for all bits at once, with momentum. keep: whether x may not be overwritten."""
    names = sorted(set(labels))
    codes = codewords(len(names))
    weights, bias = np.zeros((x.shape[1], codes.shape[1]), np.float32), np.zeros(codes.shape[1], np.float32)
    if len(names) > 1:
        y = codes[[names.index(v) for v in labels]].astype(np.float32)
        mean = x.mean(0)
        z, speed_w, speed_b = np.subtract(x, mean, out=None if keep else x), np.zeros_like(weights), np.zeros_like(bias)
        for _ in range(rounds):
            pull = -y / (1 + np.exp(y * (z @ weights + bias)))
            speed_w = 0.9 * speed_w - 8.0 * (z.T @ pull / len(z) + ridge * weights)
            speed_b = 0.9 * speed_b - 0.5 * pull.mean(0)
            weights, bias = weights + speed_w, bias + speed_b
        bias = bias - mean @ weights
    return Model(names, codes, weights, bias, margin)


def held_out(id_col: str = "doc_id", folds: int = 5) -> F.Column:
    """Whether a row is kept from learning; a row without an id is."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(True))


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = 4000, folds: int = 5, margin: float = 0.05) -> Model:
    """Fits on at most ``train_rows`` rows outside the held-out fold, chosen by a hash of their id, evenly by language."""
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), (~held_out(id_col, folds)).alias("open")).filter("open and lang is not null and text is not null")
    totals = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(totals) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not totals:
        return fit(np.zeros((0, 2 * CELLS), np.float32), [], margin)
    quota = max(1, train_rows // len(totals))
    shares = [(k, min(1.0, 1.2 * quota / n + 8 / n)) for k, n in totals.items()]
    spark = docs.sparkSession
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)
    drawn = known.withColumn("place", place).join(F.broadcast(spark.createDataFrame(shares, "lang string, share double")), "lang").filter("place < share").select("lang", "place", utf8("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, places, texts = arrow_rows(b, "lang", "place", "text")
            full = [gram_counts(t) for t in texts]
            cells = [np.flatnonzero(c) for c in full]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(places, pa.float64()), pa.array([c.astype("<u2").tobytes() for c in cells], pa.binary()), pa.array([c[k].astype("<u4").tobytes() for c, k in zip(full, cells, strict=True)], pa.binary())], ["lang", "place", "cells", "counts"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for b in batches for row in zip(*arrow_rows(b, "lang", "place", "cells", "counts"), strict=True))
        taken: dict[str, int] = {}
        kept = []
        for r in rows:
            taken[r[0]] = taken.get(r[0], 0) + 1
            if taken[r[0]] <= quota:
                kept.append(r)
        x = np.zeros((len(kept), 2 * CELLS), np.float32)
        for i, (_, _, cells, counts) in enumerate(kept):
            counts = np.frombuffer(counts, "<u4").astype(np.float64)
            x[i, np.frombuffer(cells, "<u2")] = np.sqrt(counts / max(1.0, counts.sum()))
        labels = [r[0] for r in kept]
        del rows, kept
        m = fit(x, labels, margin, keep=False)
        yield pa.RecordBatch.from_arrays([pa.array([m.languages], pa.list_(pa.string())), pa.array([m.weights.tobytes()], pa.binary()), pa.array([m.bias.tobytes()], pa.binary())], ["languages", "weights", "bias"])

    sample = map_rows(drawn, count, "lang string, place double, cells binary, counts binary")
    told = map_rows(sample.repartition(1), learn, "languages array<string>, weights binary, bias binary").collect()
    names = list(told[0]["languages"]) if told else []
    if not names:
        return fit(np.zeros((0, 2 * CELLS), np.float32), [], margin)
    codes = codewords(len(names))
    weights, bias = (np.frombuffer(told[0][c], np.float32) for c in ("weights", "bias"))
    return Model(names, codes, weights.reshape(2 * CELLS, codes.shape[1]), bias, margin)


def predict(docs: DataFrame, model: Model, *, carry: list[str], text_col: str = "text") -> DataFrame:
    """The columns in ``carry`` with lang_pred, score and ambiguous, for every row."""
    slim = docs.select(*[F.col(c) for c in carry], F.col(text_col).cast("binary").alias("__text"))
    schema = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in carry)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data in b.column(len(carry)).to_pylist():
                out.append(model.decode(features(gram_counts(data))) if data and any(map(str.isalpha, data.decode("utf-8", "replace"))) else (UND, 0.0, True))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(carry)], pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.bool_())], [*carry, "lang_pred", "score", "ambiguous"])

    return map_rows(slim, label, f"{schema}, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = 4000, folds: int = 5, margin: float = 0.05) -> DataFrame:
    """Trains on the open folds and labels every row: id, held_out, lang_pred, score, ambiguous."""
    model = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, train_rows=train_rows, folds=folds, margin=margin)
    rows = docs.select(F.col(id_col), F.col(text_col), held_out(id_col, folds).alias("held_out"))
    return predict(rows, model, carry=[id_col, "held_out"], text_col=text_col)
