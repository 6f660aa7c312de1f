"""Benchmark decontamination (operator 2) by the q-gram lemma.

Texts are compared as their letters and digits, lower-cased.  An item is cut into overlapping segments of LENGTH
characters (a shorter item is one segment), and also into short ones of SHORT characters, one every FINE, so that
every exact quote of QUOTE characters of an item holds a whole segment; an item of under SHORT characters is found
whole only.  A place where a segment of m characters occurs with at most
e = m * EDITS edits shares m + 1 - q * (e + 1) q-grams with it inside a parallelogram of e + 1 diagonals.

1. A text's q-grams are looked up in a bitmap of all benchmark q-grams; where no window of a segment's length has
   enough of them, nothing is done any more.
2. In the rest, hits (text position, item position) are counted in overlapping bands of diagonals (SPAN + e wide,
   one every SPAN, so that a parallelogram lies whole in one band); a segment's region is retained if its band has
   the lemma's number of hits.
3. A retained region is verified by banded alignment: the segment against the text around the band.

The benchmark is held by every task, so its size is checked: it is dealt into parts of about PART characters, which
are read, indexed and used one after the other, one pass over the documents for each.

Defined cases: null and empty texts hold nothing; an item with fewer than q letters and digits can't be found; a
null item_id counts as an item; repeated rows of documents each give their regions, repeated items count once; very
long texts are read in pieces of PIECE letters and digits that overlap by more than a segment, and their hits are
counted in portions of about HITS; of equally good placings of a segment the first counts; further columns are
ignored, or passed through by ``uncontaminated``, whatever their names; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeweave.llm.common import bounded, cut, fresh, slices, text_or_empty
from edgeweave.llm.hashing import LAST, ODD, code_points, fold, mixed

Q = 9
LENGTH = 128
STEP = 32
SHORT = 48
FINE = 8
#: Letters and digits of an item from which any exact quote of it is found.
QUOTE = SHORT + FINE - 1
EDITS = 0.08
SPAN = 16
BITS = 21
#: Characters of the benchmark in one pass, letters and digits of a text in one piece, and hits counted at a time.
PART = 4_000_000
PIECE = 1 << 20
HITS = 1 << 21


def letters(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The text's letters and digits as lower-case code points, and where in the text each stands."""
    codes = fold("isalnum")[np.minimum(code_points(text), LAST)]
    at = np.flatnonzero(codes)
    return codes[at], at


def pieces(text: str, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``letters`` of the text in pieces of about PIECE, each of which begins ``overlap`` letters before the last one's end."""
    codes, at = [], []
    for lo in range(0, len(text), PIECE):
        c, where = letters(text[lo : lo + PIECE])
        codes, at = [*codes, c], [*at, where + lo]
        last = lo + PIECE >= len(text)
        if last or sum(map(len, codes)) >= max(PIECE, 2 * overlap):
            whole, place = np.concatenate(codes), np.concatenate(at)
            yield whole, place
            codes, at = [whole[-overlap:]], [place[-overlap:]]


def grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """One hash for each of the q-grams, by doubling."""
    if len(codes) < q:
        return np.empty(0, dtype=np.uint64)
    n = len(codes) - q + 1
    power, width, run = np.array([ODD[1]]), 1, mixed(codes.astype(np.uint64) * ODD[0] + ODD[3])
    out, have = np.zeros(n, dtype=np.uint64), 0
    while True:
        if q & width:
            out = out * power + run[have : have + n]
            have += width
        if 2 * width > q:
            return out
        run = run[:-width] * power + run[width:]
        power, width = power * power, 2 * width


def segments(n: int, m: int, step: int) -> tuple[int, int, int, np.ndarray]:
    """Of an item of n characters: length, edits, the lemma's number of hits, and starts of its segments."""
    e = max(0, min(int(m * EDITS), m // Q - 1))
    return m, e, m + 1 - Q * (e + 1), np.array(sorted({*range(0, n - m + 1, step), n - m}))


class Index:
    """Segments of benchmark items and where each q-gram of an item stands."""

    def __init__(self, items: list[tuple[int | None, str]]) -> None:
        self.ids, self.codes, self.segments = [], [], []
        hashes, owner, place = [], [], []
        for ident, text in items:
            codes, _ = letters(text or "")
            if len(codes) < Q:
                continue
            t = len(self.ids)
            kinds = [(min(len(codes), LENGTH), STEP)] + [(SHORT, FINE)] * (len(codes) > SHORT)
            self.ids.append(ident)
            self.codes.append(codes)
            self.segments.append([segments(len(codes), m, step) for m, step in kinds])
            hashes.append(grams(codes))
            owner.append(np.full(len(hashes[-1]), t))
            place.append(np.arange(len(hashes[-1])))
        empty = np.empty(0, dtype=np.int64)
        h = np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.owner, self.place = (np.concatenate(x)[order] if x else empty for x in (owner, place))
        self.bitmap = np.zeros(1 << BITS, dtype=bool)
        self.bitmap[(self.hashes >> np.uint64(64 - BITS)).astype(np.int64)] = True
        every = [s for item in self.segments for s in item]
        self.reach = max((m + e for m, e, *_ in every), default=1)
        self.margin = 2 * max((e for _, e, *_ in every), default=0) + SPAN
        #: (reach, least) of the long and of the short segments.
        kinds = [[item[k] for item in self.segments if len(item) > k] for k in (0, 1)]
        self.windows = [(max(m + e for m, e, *_ in kind), min(least for _, _, least, _ in kind)) for kind in kinds if kind]

    def regions(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) in code points of the text, merged where regions of one item overlap."""
        if not text or not self.ids:
            return []
        found: dict[int, list[tuple[int, int, int]]] = {}
        for codes, at in pieces(text, 4 * (self.reach + self.margin)):
            for item, start, end, edits in self._piece(codes):
                found.setdefault(item, []).append((int(at[start]), int(at[end - 1]) + 1, edits))
        out = []
        for item, spans in sorted(found.items()):
            spans.sort()
            last = list(spans[0])
            for a, b, e in spans[1:]:
                if a <= last[1]:
                    last = [last[0], max(last[1], b), max(last[2], e)]
                else:
                    out.append((item, *last))
                    last = [a, b, e]
            out.append((item, *last))
        return out

    def _piece(self, codes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        h = grams(codes)
        maybe = self.bitmap[(h >> np.uint64(64 - BITS)).astype(np.int64)]
        sums = np.concatenate(([0], np.cumsum(maybe, dtype=np.int32)))
        # Positions in a dense window: a start of one within the reach before them.
        edge = np.zeros(len(h) + 1, dtype=np.int32)
        for reach, least in self.windows:
            starts = np.flatnonzero(sums[np.minimum(np.arange(len(h)) + reach, len(h))] - sums[:-1] >= least)
            np.add.at(edge, starts, 1)
            np.add.at(edge, np.minimum(starts + reach, len(h)), -1)
        if not edge.any():
            return
        pos = np.flatnonzero(maybe & (np.cumsum(edge[:-1]) > 0))
        first, last = np.searchsorted(self.hashes, h[pos], "left"), np.searchsorted(self.hashes, h[pos], "right")
        for a, b in self._portions(pos, last - first):
            yield from self._hits(codes, pos[a:b], first[a:b], (last - first)[a:b])

    def _portions(self, pos: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of ``pos`` with about HITS hits each; one begins before the last ends, so that any segment's hits lie whole in one."""
        overlap, total, a = 2 * (self.reach + self.margin), np.concatenate(([0], np.cumsum(n))), 0
        while a < len(pos):
            b = int(np.searchsorted(total, total[a] + HITS, "right")) - 1
            b = min(len(pos), max(b, int(np.searchsorted(pos, pos[a] + 2 * overlap))))
            yield a, b
            a = len(pos) if b == len(pos) else int(np.searchsorted(pos, pos[b] - overlap))

    def _hits(self, codes: np.ndarray, pos: np.ndarray, first: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        pos, first = np.repeat(pos, n), np.repeat(first, n)
        row = first + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
        item, place = self.owner[row], self.place[row]
        order = np.lexsort((place, item))
        item, place, pos = item[order], place[order], pos[order]
        cuts = np.flatnonzero(np.diff(item)) + 1
        for a, b in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(item)])), strict=True):
            for kind in self.segments[item[a]] if b > a else ():
                if b - a >= kind[2]:
                    yield from self._item(int(item[a]), kind, codes, pos[a:b], place[a:b])

    def _item(self, item: int, kind: tuple[int, int, int, np.ndarray], codes: np.ndarray, pos: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        m, e, least, starts = kind
        diagonal = pos - place + len(self.codes[item])  # from 0 up
        band = diagonal // SPAN
        # A band also holds the e diagonals after its span.
        also = diagonal % SPAN < e
        reach = (e + SPAN - 1) // SPAN
        bands, rows = [band], [np.arange(len(pos))]
        for back in range(1, reach + 1):
            in_it = also if back == reach and e % SPAN else np.ones(len(pos), dtype=bool)
            bands.append(band[in_it] - back)
            rows.append(np.flatnonzero(in_it))
        bands, rows = np.concatenate(bands), np.concatenate(rows)
        order = np.lexsort((rows, bands))  # rows are in order of place
        bands, rows = bands[order], rows[order]
        cuts = np.flatnonzero(np.diff(bands)) + 1
        for a, b in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(bands)])), strict=True):
            if b - a < least:
                continue
            here, at = place[rows[a:b]], pos[rows[a:b]]
            counts = np.searchsorted(here, starts + m - Q, "right") - np.searchsorted(here, starts, "left")
            for s in starts[counts >= least]:
                lo, hi = np.searchsorted(here, s, "left"), np.searchsorted(here, s + m - Q, "right")
                shift = at[lo:hi] - here[lo:hi]
                got = self._verify(item, int(s), m, e, codes, int(shift.min()), int(shift.max()), int(np.bincount(shift - shift.min()).argmax() + shift.min()))
                if got:
                    yield item, *got

    def _verify(self, item: int, s: int, m: int, e: int, codes: np.ndarray, low: int, high: int, usual: int) -> tuple[int, int, int] | None:
        """The best placing of a segment around the band's diagonals: start, end, edits; none if over e edits."""
        want = self.codes[item][s : s + m]
        if 0 <= s + usual and s + usual + m <= len(codes) and np.array_equal(codes[s + usual : s + usual + m], want):
            return s + usual, s + usual + m, 0
        # D[i][j]: edits of want[:i] against a stretch that ends at j; row by row, columns around the band only.
        lo, hi = max(0, s + low - e), min(len(codes), s + high + m + e)
        width = (high - low) + 2 * e + 1
        offs = np.arange(width)
        base = s + low - e  # column of offset k in row i is base + i + k
        big = m + width + 1
        ends = base + offs
        cost = np.where((ends >= lo) & (ends <= hi), 0, big)
        begin = ends.copy()
        for i in range(1, m + 1):
            ends = base + i + offs
            inside = (ends >= max(lo, 1)) & (ends <= hi)
            same = np.zeros(width, dtype=bool)
            same[inside] = codes[ends[inside] - 1] == want[i - 1]
            step = cost + ~same  # from (i - 1, j - 1): the same offset
            step[~inside] = big
            new, came = step, begin.copy()
            skip = np.append(cost[1:] + 1, big)  # from (i - 1, j): one offset more
            skip[(ends < lo) | (ends > hi)] = big
            better = skip < new
            new = np.where(better, skip, new)
            came[:-1] = np.where(better[:-1], begin[1:], came[:-1])
            # from (i, j - 1): one offset less, any number of times
            key = (new - offs) * (width + 1) + offs
            least = np.minimum.accumulate(key)
            source = least % (width + 1)
            run = new[source] + offs - source
            begin = np.where(run < new, came[source], came)
            cost = np.where(inside | (ends == lo), np.minimum(run, new), big)
        best = int(cost.argmin())
        if cost[best] > e:
            return None
        start, end = int(begin[best]), base + m + best
        return (start, end, int(cost[best])) if end > start else None


def parts_of(benchmark: DataFrame) -> int:
    return (benchmark.agg(F.sum(F.length(text_or_empty())).alias("n")).first()["n"] or 0) // PART + 1


def indexes(benchmark: DataFrame, parts: int) -> Iterator[Index]:
    """The index of one part of the benchmark after the other."""
    dealt = benchmark.select("item_id", text_or_empty().alias("text"), F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).alias("part"))
    for p in range(parts):
        rows = dealt.filter(F.col("part") == p).select("item_id", "text").distinct().collect()  # about PART characters
        yield Index(sorted(((r["item_id"], r["text"]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1])))


def contaminated_regions(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end (code points of the text), edits: every region that holds a benchmark segment."""
    out, parts = None, parts_of(benchmark)
    for index in indexes(benchmark, parts):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in (piece for whole in batches for piece in slices(whole)):
                rows = [(d.as_py(), index.ids[t], a, b, e) for d, text in zip(batch.column("doc_id"), batch.column("text"), strict=True) for t, a, b, e in index.regions(text.as_py())]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "start", "end", "edits"])

        part = bounded(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, item_id bigint, start bigint, end bigint, edits bigint")
        part = cut(part) if parts > 1 else part  # so that no two indexes are held at once
        out = part if out is None else out.unionByName(part)
    return out


def uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold a region of any benchmark item."""
    parts, held = parts_of(benchmark), None
    if parts == 1:
        return bounded(docs).filter(~holder(next(indexes(benchmark, 1)))(text_or_empty()))
    ident, digest = fresh(docs, "_id", "_digest")
    hashed = docs.withColumn(digest, F.md5(text_or_empty()))
    for index in indexes(benchmark, parts):
        part = cut(bounded(docs).filter(holder(index)(text_or_empty())).select(F.col("doc_id").alias(ident), F.md5(text_or_empty()).alias(f"{digest}_held")))
        held = part if held is None else held.unionByName(part)
    return hashed.join(held, hashed["doc_id"].eqNullSafe(held[ident]) & (hashed[digest] == held[f"{digest}_held"]), "left_anti").drop(digest)


def holder(index: Index) -> Callable[[Column], Column]:
    """A function of a text column: whether it holds a region of any of the index's items."""

    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(index.regions(t)) for t in texts], dtype=bool)

    return holds
