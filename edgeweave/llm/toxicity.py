"""Toxicity (operator 9) by compression distance.

Two dictionaries are trained by zstandard: one on windows of ordinary text, and one on windows of toxic text, which
is used in front of the ordinary one's content.  A window's distance is its length compressed with the ordinary
dictionary less that with both: over 0 where toxic text explains bytes that ordinary text does not.  The windows that
the toxic dictionary is trained on are chosen: those around words that hold a piece which far more toxic than ordinary
documents have.  (Trained on whole toxic documents, it fills with the ordinary prose around toxic words, and two such
dictionaries differ by chance.)

A document's windows give its largest distance, the mean of the largest three, the mean, the share over a bar and
their number; a logistic curve over these, fitted by cross-fitting (dictionaries from one half, distances of the
other), is the score, moved so that the bar with the best F1 on the training rows is 0.5.

Labels come from a bounded sample: SAMPLE training documents a class at most, those with the least hashes of the id,
and of each a stretch of SAMPLE_CHARS characters at most.  Whole texts are scored.

Defined cases: a null text is an empty one, and an empty one has one empty window; very long texts are scored window
by window; repeated rows each get their row; a null label teaches nothing, of different labels of one id the larger
counts; equal hashes go to the smaller id, windows with equal distances are alike; with no training rows of one class
every score is 0; further columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeweave.llm.common import bounded, slices, stretch, text_or_empty

SAMPLE, SAMPLE_CHARS = 1500, 16384
WINDOW, STEP = 80, 60
LEVEL = 9
DICTIONARY = 32768
#: A piece of a word must occur in so many toxic documents, and so many times as often there as in ordinary ones.
LEAST_DOCS, LEAST_RATIO = 6, 30.0
PIECES = range(5, 10)
#: Characters around a chosen word in a toxic training window, and the trainer's sizes of dictionary, segment and piece.
AROUND = 4
TOXIC_SIZE, SEGMENT, DMER = 4096, 12, 6
BAR = 2


def windows(text: str | None) -> list[bytes]:
    data = (text or "").lower().encode("utf-8", "surrogatepass")
    if len(data) <= WINDOW:
        return [data]
    return [data[i : i + WINDOW] for i in range(0, len(data) - WINDOW + STEP, STEP)]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False)


def pieces_of(word: str) -> Iterator[str]:
    word = f" {word} "
    return (word[i : i + n] for n in PIECES for i in range(len(word) - n + 1))


def word_pieces(text: str) -> set[str]:
    return {p for word in set(re.findall(r"\w+", text.lower())) for p in pieces_of(word)}


def telling_pieces(toxic: list[str], ordinary: list[str]) -> set[str]:
    """The pieces that far more toxic than ordinary documents have."""
    have, common = Counter(), Counter()
    for t in toxic:
        have.update(word_pieces(t))
    have = {p: n for p, n in have.items() if n >= LEAST_DOCS}
    for t in ordinary:
        common.update(p for p in word_pieces(t) if p in have)
    return {p for p, n in have.items() if ((n + 0.5) / len(toxic)) / ((common[p] + 0.5) / len(ordinary)) > LEAST_RATIO}


def toxic_windows(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """The stretches of toxic text around words that hold a telling piece."""
    telling, out = telling_pieces(toxic, ordinary), []
    for t in map(str.lower, toxic):
        for w in re.finditer(r"\w+", t):
            if any(p in telling for p in pieces_of(w[0])):
                out.append(t[max(0, w.start() - AROUND) : w.end() + AROUND].encode("utf-8", "surrogatepass"))
    return out


def trained(samples: list[bytes], size: int, segment: int, dmer: int) -> bytes:
    """The dictionary that zstandard trains on the samples; of too little to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=dmer).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def toxic_content(toxic: list[str], ordinary: list[str]) -> bytes:
    return trained(toxic_windows(toxic, ordinary), TOXIC_SIZE, SEGMENT, DMER)


def ordinary_content(texts: list[str]) -> bytes:
    samples = [w for t in texts for w in (data[i : i + 256] for data in [t.lower().encode("utf-8", "surrogatepass")] for i in range(0, len(data), 256))]
    return trained(sorted(samples, key=lambda w: (zlib.crc32(w), w)), DICTIONARY, 64, 6) or b" " * 8


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: np.ndarray
    scale: tuple[np.ndarray, np.ndarray]
    _made: list = field(default_factory=list, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": []}

    def features(self, text: str | None) -> np.ndarray:
        if not self._made:
            self._made = [compressor(self.ordinary), compressor(self.toxic + self.ordinary)]
        plain, tox = self._made
        d = np.array([len(plain.compress(w)) - len(tox.compress(w)) for w in windows(text)], dtype=float)
        d[::-1].sort()
        return np.array([d[0], d[:3].mean(), np.sqrt(max(0.0, d.mean())), np.sqrt((d >= BAR).mean()), np.log(len(d))])

    def score(self, text: str | None) -> float:
        if not self.toxic:
            return 0.0
        z = (self.features(text) - self.scale[0]) / self.scale[1]
        return float(1 / (1 + np.exp(-np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weights and intercept by Newton's steps with a small ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (w * (p - y)) + 1e-2 * b
        h = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(b))
        b = b - np.linalg.solve(h, g)
    return b


def best_bar(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The bar on z with the highest weighted F1."""
    order = np.argsort(-z, kind="stable")
    hit, all_ = np.cumsum((w * y)[order]), np.cumsum(w[order])
    f1 = 2 * hit / (all_ + (w * y).sum())
    last = np.append(np.diff(z[order]) != 0, True)
    i = int(np.where(last, f1, -1).argmax())
    below = z[order][i + 1] if i + 1 < len(z) else z[order][i] - 1
    return float((z[order][i] + below) / 2)


def fit_texts(toxic: list[str], ordinary: list[str], prior: float) -> Model:
    """``prior``: the share of toxic rows among all that are labelled."""
    flat = (np.zeros(5), np.ones(5))
    if not toxic or not ordinary:
        return Model(b"", b"", np.zeros(6), flat)
    base = ordinary_content(ordinary)
    rows, y = [], []
    for a in (0, 1):
        content = toxic_content(toxic[a::2] or toxic, ordinary[a::2] or ordinary)
        half = Model(content, base, np.zeros(6), flat)
        for texts, label in ((toxic, 1), (ordinary, 0)):
            for t in texts[1 - a :: 2]:
                rows.append(half.features(t))
                y.append(label)
    x, y = np.array(rows), np.array(y, dtype=float)
    if not 0 < y.sum() < len(y):
        return Model(b"", b"", np.zeros(6), flat)
    w = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    scale = (x.mean(0), x.std(0) + 1e-9)
    z = (x - scale[0]) / scale[1]
    b = logistic(z, y, w)
    b[-1] -= best_bar(z @ b[:-1] + b[-1], y, w)
    return Model(toxic_content(toxic, ordinary) or b"\0", base, b, scale)


def held_out(name: str = "doc_id") -> Column:
    return F.crc32(F.col(name).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from labels.toxic of the rows that are not held out."""
    marks = labels.filter(~held_out()).filter("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    by_hash = [F.xxhash64(F.lit("toxicity"), "doc_id"), F.col("doc_id")]
    some = None
    for label in (0, 1):
        part = marks.filter(F.col("toxic") == label).orderBy(*by_hash).limit(SAMPLE)
        some = part if some is None else some.unionByName(part)
    # At most two times SAMPLE ids, so they go to the texts and not the texts to them.
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(some), "doc_id").select("doc_id", "toxic", stretch("text", SAMPLE_CHARS, F.xxhash64("doc_id")).alias("text")).collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["text"]))
    return fit_texts([r["text"] for r in rows if r["toxic"] == 1], [r["text"] for r in rows if r["toxic"] == 0], n1 / max(1, n0 + n1))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; see op9."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in slices(whole)):
            scores = [model.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    out = bounded(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
