"""Language ID (operator 7): nearest of several centroids per language, by cosine of TF-IDF n-gram vectors.

A text is lower-cased, every run of other characters than letters becomes one space, and its 1- to 3-grams of code
points are counted in 2 ** BITS hashed dimensions; log(1 + count) times the inverse document frequency, scaled to
length 1, is its vector.  Document frequencies are counted over all training documents; the centroids (spherical
k-means) are fitted on a bounded sample of them: SAMPLE documents a language and SAMPLE_ALL in all at most, those
with the least hashes of id and text, of each a stretch of SAMPLE_CHARS characters at most.

Short texts lie further from every centroid than long ones, so the distance that rejects depends on the length: a
text is rejected if its best cosine is under MARGIN times the lowest that the sample's texts, and pieces cut from
them, with as many letters (by powers of two) have to their own language.

Defined cases: a null text and one without a letter are ``und`` with score 0 and rejected; any other text gets a
language, whatever its script; ties between languages go to the first in alphabetical order; whole texts are read,
long ones in pieces; repeated rows each get their row, and are one in the sample; with no training rows every text is
``und``; further columns are ignored, or passed through by ``named``, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgeweave.llm.common import bounded, slices, stretch, text_or_empty
from edgeweave.llm.hashing import LAST, ODD, code_points, fold, mixed

BITS = 13
SAMPLE, SAMPLE_ALL, SAMPLE_CHARS = 400, 4000, 16384
CENTROIDS, ROUNDS = 4, 12
PIECE = 1 << 20
#: A text may be so much nearer to nothing than the furthest of the sample.
MARGIN = 0.9
#: Lengths of texts are told apart up to 2 ** LENGTHS letters.
LENGTHS = 12
#: Texts whose vectors are held at once.
CHUNK = 256
#: Sharpness of the score: a softmax over the languages' best cosines.
SHARP = 20.0


def _folded(text: str) -> np.ndarray:
    """Lower-case letters as code points, 32 for each run of anything else and at both ends."""
    codes = fold("isalpha")[np.minimum(code_points(text), LAST)]
    codes = np.concatenate(([32], np.where(codes == 0, 32, codes), [32]))
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    return codes[keep]


def counts(text: str | None) -> np.ndarray:
    """How often each hashed 1- to 3-gram occurs; all zeros if the text has no letter."""
    out = np.zeros(1 << BITS, dtype=np.int64)
    for lo in range(0, len(text or ""), PIECE):
        codes = _folded(text[max(0, lo - 2) : lo + PIECE])  # two characters back: grams across the cut
        if len(codes) < 3:
            continue
        one = mixed(codes.astype(np.uint64) * ODD[0] + ODD[3])
        two = one[:-1] * ODD[1] + one[1:]
        three = two[:-1] * ODD[1] + one[2:]
        for grams in (one[codes != 32], two, three):
            out += np.bincount((mixed(grams) >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
    return out


def vectors(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors, and the number of 1- to 3-grams of each text."""
    raw = np.array([counts(t) for t in texts], dtype=np.float32).reshape(len(texts), 1 << BITS)
    n = raw.sum(1)
    raw = np.log1p(raw, out=raw) * idf
    length = np.sqrt((raw * raw).sum(1, keepdims=True))
    return np.divide(raw, length, out=np.zeros_like(raw), where=length > 0), n


def length_class(n_grams: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n_grams, 1)).astype(int), LENGTHS)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # (languages * CENTROIDS, dimensions)
    least: np.ndarray  # by length class

    def cosines(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) cosines to the nearest centroid of each, and each text's length class, CHUNK by CHUNK."""
        best, sizes = [np.zeros((0, len(self.languages)))], [np.zeros(0, dtype=int)]
        for at in range(0, len(texts), CHUNK):
            v, n = vectors(texts[at : at + CHUNK], self.idf)
            best.append((v @ self.centroids.T).reshape(len(v), len(self.languages), -1).max(2))
            sizes.append(n)
        return np.vstack(best), np.concatenate(sizes)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score and whether the distance rejects it, for each text."""
        if not texts or not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        best, n = self.cosines(texts)
        at = best.argmax(1)
        top = best[np.arange(len(texts)), at]
        soft = 1 / np.exp(SHARP * (best - top[:, None]).astype(float)).sum(1)
        none = n == 0
        name = ["und" if x else self.languages[i] for x, i in zip(none, at, strict=True)]
        return name, [0.0 if x else float(s) for x, s in zip(none, soft, strict=True)], [bool(x) for x in none | (top < self.least[length_class(n)])]


def clusters(v: np.ndarray, k: int) -> np.ndarray:
    """k unit centroids by spherical k-means; starts are spread by farthest-first from the mean."""
    centre = v.mean(0)
    picks = [int((v @ centre).argmax())]
    near = v @ v[picks[0]]
    while len(picks) < k:
        picks.append(int(near.argmin()))
        near = np.maximum(near, v @ v[picks[-1]])
    c = v[picks].copy()
    for _ in range(ROUNDS):
        of = (v @ c.T).argmax(1)
        for i in range(k):
            if (of == i).any():
                m = v[of == i].sum(0)
                c[i] = m / (np.linalg.norm(m) or 1)
    return c


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each dimension occurs, and the number of texts; a partition gives one count a dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << BITS) + 1, dtype=np.int64)
        for batch in batches:
            for text in batch.column("text"):
                total[:-1] += counts(text.as_py()) > 0
                total[-1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["dim", "n"])

    rows = bounded(docs).select("text").mapInArrow(run, "dim bigint, n bigint").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    out = np.zeros((1 << BITS) + 1, dtype=np.int64)
    for r in rows:  # 2 ** BITS + 1 rows
        out[r["dim"]] = r["n"]
    return out[:-1], int(out[-1])


def sample(train: DataFrame, sizes: dict[str, int]) -> dict[str, list[str]]:
    """The texts that the centroids are fitted on, by language."""
    each = max(1, min(SAMPLE, SAMPLE_ALL // len(sizes)))
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    # About twice as many hashes as are wanted, of which the least are taken.
    share = F.create_map(*[F.lit(x) for lang, size in sizes.items() for x in (lang, min(1.0, (2 * each + 50) / size))])
    hashed = train.select("lang", h.alias("h"), stretch("text", SAMPLE_CHARS, h).alias("text")).filter(F.col("h") < F.element_at(share, F.col("lang")) * float(1 << 40))
    order = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    least = hashed.select("lang", "h").distinct().withColumn("at", order).filter(F.col("at") <= each)
    bar = {r["lang"]: r["h"] for r in least.groupBy("lang").agg(F.max("h").alias("h")).collect()}
    if not bar:
        return {}
    bars = F.create_map(*[F.lit(x) for pair in bar.items() for x in pair])
    rows = hashed.filter(F.col("h") <= F.element_at(bars, F.col("lang"))).groupBy("lang", "h").agg(F.min("text").alias("text")).collect()  # at most SAMPLE_ALL, or one a language
    return {lang: [r["text"] for r in sorted(rows, key=lambda r: r["h"]) if r["lang"] == lang] for lang in sorted(bar)}


def pieces(texts: list[str]) -> list[str]:
    """The texts, and two shorter stretches of each, of all lengths."""
    out = list(texts)
    for i, t in enumerate(texts):
        for k in (i, i + 5):
            n = 4 << k % (LENGTHS - 1)
            if n < len(t):
                at = zlib.crc32(t.encode("utf-8", "surrogatepass")) % (len(t) - n)
                out.append(t[at : at + n])
    return out


def fit(train: DataFrame) -> Model:
    """The model of ``train`` (doc_id, text, lang; nulls in text or lang are left out)."""
    none = Model([], np.zeros(0), np.zeros((0, 0)), np.zeros(LENGTHS + 1))
    train = train.filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    if not sizes:
        return none
    df, n = document_frequencies(train)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    languages, parts, texts = [], [], sample(train, sizes)
    for lang, some in texts.items():
        v = vectors(some, idf)[0]
        v = v[v.any(1)]
        if len(v):
            languages.append(lang)
            c = clusters(v, min(CENTROIDS, len(v)))
            parts.append(np.vstack([c, np.repeat(c[-1:], CENTROIDS - len(c), axis=0)]))
    if not languages:
        return none
    model = Model(languages, idf, np.vstack(parts).astype(np.float32), none.least)
    lows = np.full(LENGTHS + 1, np.inf)
    for i, lang in enumerate(languages):
        best, size = model.cosines(pieces(texts[lang]))
        some = size > 0
        np.minimum.at(lows, length_class(size[some]), best[some, i])
    for i in range(LENGTHS + 1):  # a length without pieces: as the next shorter, or never
        if np.isinf(lows[i]):
            lows[i] = lows[i - 1] if i else 0.0
    return replace(model, least=MARGIN * lows)


def held_out(name: str = "doc_id") -> Column:
    return F.crc32(F.col(name).cast("string").cast("binary")) % 3 == 1


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in slices(whole, CHUNK)):
            name, score, rejected = model.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return bounded(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double, rejected boolean")


def named(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows that the distance rejects."""

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        return pd.Series([not r for r in model.predict(list(texts))[2]], dtype=bool)

    return bounded(docs).filter(kept(text_or_empty()))


def predictions(docs: DataFrame) -> DataFrame:
    """One row per document; see op7."""
    out = identify(docs, fit(docs.filter(~held_out())))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
