"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are 2- and 3-grams of the lower-cased letters of a text (runs of other characters count as one
space), hashed to 2**BITS buckets; a text's vector is log(1 + count) * idf, of length 1. The document
frequencies come from all rows to learn from. The weights are learnt by follow-the-regularised-leader
(FTRL-proximal) with elastic-net penalties, on a bounded sample of labelled rows (``per_language`` rows of
each language, about; the bound is a parameter), dealt over ``shards`` learners whose weights are averaged.
A temperature is then fitted on sampled rows that the learners did not see, so that scores are calibrated.

Learning rows have a non-null lang and crc32(doc_id as text) mod 4 other than 2; the others are held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisect.llm.common import over_texts, stored, table

BITS = 15
CHUNK = 1 << 20
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def counts(text: str | None) -> np.ndarray | None:
    """How often each bucket's n-grams occur in a whole text; None if it has no letter."""
    if not text:
        return None
    out, carry, any_letter = np.zeros(1 << BITS, np.int64), np.array([32], np.uint32), False
    for s in range(0, len(text), CHUNK):
        codes = np.frombuffer(text[s : s + CHUNK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[codes]
        any_letter = any_letter or bool(letter.any())
        codes = np.concatenate([carry, np.where(letter, codes, np.uint32(32))])
        codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
        two = codes[:-1] * np.uint32(0x9E3779B1) + codes[1:] * np.uint32(0x85EBCA6B)
        three = two[:-1] * np.uint32(0xC2B2AE35) + codes[2:] * np.uint32(0x27D4EB2F)
        for h in (two, three):
            out += np.bincount((h ^ (h >> np.uint32(13))) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS), minlength=1 << BITS)
        carry = codes[-2:]
        if len(codes) > 2 and s + CHUNK < len(text):  # the last bigram is seen again with the next piece
            h = codes[-2:-1] * np.uint32(0x9E3779B1) + codes[-1:] * np.uint32(0x85EBCA6B)
            out[(h ^ (h >> np.uint32(13))) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)] -= 1
    return out if any_letter else None


def vector(found: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and TF-IDF values of unit length."""
    at = np.flatnonzero(found)
    x = np.log1p(found[at]) * idf[at]
    size = np.sqrt((x * x).sum())
    return at, x / size if size > 0 else x


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 2, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.1, seed: int = 7) -> np.ndarray:
    """Weights (2**BITS + 1 x classes, the last row the bias) by FTRL-proximal with elastic net."""
    z, n = np.zeros(((1 << BITS) + 1, classes)), np.zeros(((1 << BITS) + 1, classes))

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x, label = rows[i]
            at, x = np.append(at, 1 << BITS), np.append(x, 1.0)
            w = weights(z[at], n[at])
            p = softmax(x @ w)
            p[label] -= 1.0
            g = np.outer(x, p)
            old = n[at]
            n[at] = old + g * g
            z[at] += g - (np.sqrt(n[at]) - np.sqrt(old)) / alpha * w
    return weights(z, n)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def logits(self, text: str | None) -> np.ndarray | None:
        found = counts(text)
        if found is None or not self.languages:
            return None
        at, x = vector(found, self.idf)
        return x @ self.weights[at] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        z = self.logits(text)
        if z is None:
            return UNKNOWN, 0.0
        p = softmax(z / self.temperature)
        return self.languages[int(p.argmax())], float(p.max())


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _draw(what: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(what), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)


def learn(docs: DataFrame, per_language: int = 1000, shards: int = 4, calibrate: float = 0.2) -> Model:
    """Fit a model on docs (doc_id, text, lang). About per_language rows of each language are sampled, by
    a hash; document frequencies are of all learning rows.

    Rows whose text or lang is null teach nothing, nor do texts without letters; long texts count whole,
    repeated rows each count, other columns are not looked at. From an empty table, or one without a label,
    comes a model of no language, which says ``und`` to all. Weights take 2**BITS floats a language on the
    driver and in each task; languages are the labels of the table, of which there is no bound here.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << BITS, np.int64), 0
        for b in batches:
            for t in b.column(0):
                if (c := counts(t.as_py())) is not None:
                    total += c > 0
                    n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], n), pa.int64())], ["bucket", "docs"])

    # at most 2**BITS + 1 rows; one partial count for each task and bucket
    by_bucket = over_texts(rows.select("text"), seen, "bucket int, docs long").groupBy("bucket").agg(F.sum("docs").alias("docs")).toPandas()
    frequency = np.zeros(1 << BITS)
    n = int(by_bucket.loc[by_bucket.bucket == -1, "docs"].sum())
    known = by_bucket[by_bucket.bucket >= 0]
    frequency[known.bucket.to_numpy()] = known.docs.to_numpy()
    idf = np.log((1 + n) / (1 + frequency)) + 1.0

    sizes = rows.groupBy("lang").count().orderBy("lang").collect()  # one row for each language
    languages = [r.lang for r in sizes]
    if not languages or not n:
        return Model([], idf, np.zeros(((1 << BITS) + 1, 0)))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, min(1.0, per_language / r["count"]))])
    sample = stored(rows.filter(_draw("sample") < share[F.col("lang")]).withColumn("calibrates", _draw("calibrate") < calibrate).withColumn("shard", F.floor(_draw("shard") * shards).cast("int")))
    number = {x: i for i, x in enumerate(languages)}

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "lang", "text"])
        sparse = ((vector(c, idf), number[x]) for t, x in zip(group.text, group.lang, strict=True) if (c := counts(t)) is not None)
        w = ftrl([(at, values, k) for (at, values), k in sparse], len(languages))
        at, k = np.nonzero(w)
        return pd.DataFrame({"bucket": at.astype(np.int32), "k": k.astype(np.int32), "w": w[at, k]})

    training = sample.filter("not calibrates")
    learners = max(1, training.select("shard").distinct().count())
    summed = training.groupBy("shard").applyInPandas(fit, "bucket int, k int, w double").groupBy("bucket", "k").agg(F.sum("w").alias("w")).toPandas()
    weights = np.zeros(((1 << BITS) + 1, len(languages)))
    weights[summed.bucket.to_numpy(), summed.k.to_numpy()] = summed.w.to_numpy() / learners
    model = Model(languages, idf, weights)

    grid = np.geomspace(0.02, 5.0, 60)

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(grid))
        for b in batches:
            for t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if (z := model.logits(t)) is not None:
                    total -= np.log(np.maximum(softmax(z[None, :] / grid[:, None])[:, number[x]], 1e-12))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(grid)), pa.int32()), pa.array(total)], ["i", "loss"])

    held = over_texts(sample.filter("calibrates").select("text", "lang"), losses, "i int, loss double").groupBy("i").agg(F.sum("loss").alias("loss")).collect()
    if any(r.loss > 0 for r in held):
        model.temperature = float(grid[min(held, key=lambda r: (r.loss, r.i)).i])
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, lang_pred, score.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if there was
    nothing to learn from. Repeats stay, null ids keep their rows, other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [model.predict(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in said], pa.string()), pa.array([s for _, s in said], pa.float64())], ["doc_id", "lang_pred", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return over_texts(slim, run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least_share: float = 0.2) -> DataFrame:
    """The rows of docs, with their own columns, whose language is told.

    It is told if the score is at least 1/n + least_share * (1 - 1/n) for n languages: so far above the
    score of no knowledge, whatever the number of languages. Null texts and those without letters go. A
    model of fewer than two languages can't tell anything, so then only these go. Long texts are judged
    whole, repeated rows alike; an empty table gives an empty result.
    """
    names = docs.columns
    at = names.index("text")
    n = len(model.languages)
    least_score = 1 / n + least_share * (1 - 1 / n) if n > 1 else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if n < 2:
                kept = [counts(t.as_py()) is not None for t in b.column(at)]
            else:
                kept = [x != UNKNOWN and s >= least_score for x, s in (model.predict(t.as_py()) for t in b.column(at))]
            yield b.filter(pa.array(kept, pa.bool_()))

    return over_texts(docs, run, docs.schema)


def op9_langid(spark, sf_dir: str) -> DataFrame:
    """Query: the language of every document."""
    docs = table(spark, sf_dir, "documents")
    return predict(docs, learn(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
