"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the mean of the embeddings of its words' character n-grams, hashed into
buckets; a linear softmax over it names the language. Both are trained by stochastic
gradient descent in numpy on a bounded sample of labelled rows. As the classifier is
linear in the mean, embeddings and softmax weights fold into one table of a row a bucket
for prediction. A temperature is fitted on a fifth of the sample that the training doesn't
see, so that scores are probabilities; a text is rejected if its language is more likely
wrong than right.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, release, sliced

GRAMS = (2, 3, 4)
BUCKETS = 1 << 15
#: Labelled rows of each language that the sample has on average at most; the bound of the fit.
PER_LANGUAGE = 900
#: Steps of gradient descent, of 16 texts each, whatever the sample's size.
STEPS = 2_200
#: The calibrated probability under which a text is rejected.
THRESHOLD = 0.5


@cache
def _letters() -> np.ndarray:
    """For each code point: itself if a letter, else 0."""
    return np.array([c if chr(c).isalpha() else 0 for c in range(0x110000)], np.uint32)


def subwords(texts: list[str], buckets: int = BUCKETS) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each n the buckets of all n-grams, text after text, and where each text's begin and end; whether each text has a letter."""
    low = [t.lower() for t in texts]
    code = _letters()[np.frombuffer(("\0" + "\0".join(low) + "\0\0\0\0").encode("utf-32-le", "surrogatepass"), np.uint32)]
    size = np.fromiter(map(len, low), np.int64, len(low))
    start = np.append(np.cumsum(size + 1) - size, len(code) - 3)
    letter = code != 0
    any_letter = np.add.reduceat(letter, start[:-1] - 1, dtype=np.int64) > 0 if len(low) else np.empty(0, bool)
    mixed, out = code * np.uint32(2654435761), []
    mixed ^= mixed >> np.uint32(15)
    for n in GRAMS:
        end = len(code) - n + 1
        good = letter[:end] | letter[n - 1 :]
        for i in range(1, n - 1):
            good &= letter[i : end + i]
        where = np.flatnonzero(good)
        h = np.full(len(where), n, np.uint32)
        for i in range(n):
            h ^= mixed[i : end + i][good]
            h *= np.uint32(16777619)
        h ^= h >> np.uint32(16)
        h &= np.uint32(buckets - 1)
        out.append((h, np.searchsorted(where, start - 1)))
    return out, any_letter


def _per_text(table: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean table row of each text's n-grams; whether it has a letter."""
    grams, any_letter = subwords(texts, len(table))
    total, count = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts), np.int64)
    for h, edge in grams:
        some = np.flatnonzero(edge[1:] > edge[:-1])
        if len(some):
            total[some] += np.add.reduceat(table[h], edge[some], axis=0, dtype=np.float64)
            count += np.diff(edge)
    return total / np.maximum(count, 1)[:, None], any_letter


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        mean, letter = _per_text(self.table, texts)
        p = softmax((mean + self.bias) / self.temperature)
        best = p.argmax(1)
        return [self.languages[k] if ok else "und" for k, ok in zip(best, letter, strict=True)], np.where(letter, p[np.arange(len(p)), best], 0.0)


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, languages: list[str], buckets: int = BUCKETS, dim: int = 12, steps: int = STEPS, rate: float = 8.0, seed: int = 3) -> LanguageModel:
    """rows: each text's buckets and their shares. The last fifth, in seeded order, calibrates."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = order[: max(1, len(rows) // 5)]
    fit = order[len(held) :] if len(rows) > 1 else order
    emb = rng.standard_normal((buckets, dim)) * 0.1
    out, bias, batch = rng.standard_normal((dim, len(languages))) * 0.1, np.zeros(len(languages)), 16
    done = 0
    while done < steps:
        rng.shuffle(fit)
        for i in range(0, len(fit), batch)[: steps - done]:
            part = fit[i : i + batch]
            idx = np.concatenate([rows[k][0] for k in part])
            share = np.concatenate([rows[k][1] for k in part])
            who = np.repeat(np.arange(len(part)), [len(rows[k][0]) for k in part])
            uniq, inv = np.unique(idx, return_inverse=True)
            x = np.zeros((len(part), len(uniq)))
            x[who, inv] = share
            h = x @ emb[uniq]
            g = softmax(h @ out + bias)
            g[np.arange(len(part)), y[part]] -= 1
            g *= rate * (1 - done / steps) / len(part)
            back = x.T @ (g @ out.T)
            out -= h.T @ g
            bias -= g.sum(0) * 0.1
            emb[uniq] -= back
            done += 1
    table = (emb @ out).astype(np.float32)
    logits = np.stack([(table[i] * s[:, None]).sum(0) for i, s in (rows[k] for k in held)]) + bias
    loss = lambda t: -np.log(np.maximum(1e-12, softmax(logits / t)[np.arange(len(held)), y[held]])).mean()
    temperature = min(np.geomspace(0.25, 8, 41), key=loss)
    return LanguageModel(languages, table, bias, float(temperature), THRESHOLD if len(languages) > 1 else 0.0)


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> LanguageModel | None:
    """Train on the rows that satisfy ``learn`` and have text and language; None if there are none.

    The sample takes a row by a hash of its id, at a rate that gives ``per_language`` rows of
    each language on average, or all of a rarer one. Texts stay on the executors; the
    driver gets at most BUCKETS shares a row.
    """
    prepare(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(learn & F.col("text").isNotNull() & F.col("lang").isNotNull())
    count = {r["lang"]: r["count"] for r in d.groupBy("lang").count().collect()}
    if not count:
        return None
    rate = F.element_at(F.create_map(*[F.lit(x) for lang, n in sorted(count.items()) for x in (lang, min(1.0, per_language / n))]), F.col("lang"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text", 1_000_000):
            grams, _ = subwords(b.column(1).to_pylist())
            rows = [np.unique(np.concatenate([h[e[i] : e[i + 1]] for h, e in grams]), return_counts=True) for i in range(b.num_rows)]
            yield pa.record_batch([b.column(0), b.column(2), pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array([(r[1] / max(1, r[1].sum())).astype(np.float32) for r in rows], pa.list_(pa.float32()))], ["id", "lang", "bucket", "share"])

    kind = d.schema["id"].dataType.simpleString()
    sample = d.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < rate * (1 << 20)).mapInArrow(features, f"id {kind}, lang string, bucket array<int>, share array<float>")
    got = sample.where("size(bucket) > 0").toArrow()
    if not got.num_rows:
        return None
    got = got.sort_by([("id", "ascending"), ("lang", "ascending")])
    languages = sorted(set(got["lang"].to_pylist()))
    y = np.array([languages.index(x) for x in got["lang"].to_pylist()])
    rows = [(b.values.to_numpy(), s.values.to_numpy()) for b, s in zip(got["bucket"], got["share"], strict=True)]
    model = train(rows, y, languages)
    del got, rows
    release()
    return model


def identify(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected), a row for each row of ``docs``, from whole texts.

    Null texts and texts without a letter are ``und`` with score 0, as is all without a
    model. rejected: those, and scores under the model's threshold. Other columns of
    ``docs`` are ignored; repeated rows and null ids are kept.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text", 2_000_000):
            texts = [t or "" for t in b.column(1).to_pylist()]
            names, score = model.predict(texts) if model else (["und"] * len(texts), np.zeros(len(texts)))
            bad = [n == "und" or s < model.threshold for n, s in zip(names, score, strict=True)]
            yield pa.record_batch([b.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(bad)], ["id", "lang_pred", "score", "rejected"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language isn't rejected; all rows without a model.

    Null texts and texts without a letter are rejected by any model; repeated rows share their
    verdict; ids aren't looked at; no rows give no rows.
    """
    prepare(docs.sparkSession)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, text_col, 2_000_000):
            names, score = model.predict([t or "" for t in b.column(place).to_pylist()])
            yield b.filter(pa.array([n != "und" and s >= model.threshold for n, s in zip(names, score, strict=True)]))

    return docs.mapInArrow(run, docs.schema) if model else docs
