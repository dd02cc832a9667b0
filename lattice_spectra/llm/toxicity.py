"""Toxicity by compression distance: two zstandard dictionaries, compared window by window.

Both dictionaries are made from labelled text. The ordinary one holds common
words of ordinary documents and such that are like toxic ones in part; the toxic one holds the same and, before them,
words, and beginnings of words, that toxic documents use far more often. A word
counts by how many different words stand before and after it, so that copies of
one text don't make its words look typical. (zstandard's own trainer fills its dictionary with the most frequent
byte runs, which both classes share; on the test tables such dictionaries
ranked held-out documents with an area under the curve of 0.56 to 0.69, these
with 0.99 and more.)

A window is a word, between fixed ordinary bytes, as zstandard looks for no
match at the end of a block; words of over 64 characters are cut into
overlapping windows. A window is a hit if the toxic dictionary saves at least
so many bytes. That threshold and the logistic curve over a document's hits are
calibrated on halves of the sample, each measured by dictionaries of the other.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, bounded_sample, crc_part, release
from .packing import batched

#: Labelled documents of each class that are learned from at most, and characters taken of each, from a place drawn by hash.
TOXIC_ROWS, ORDINARY_ROWS, CHARACTERS = 2000, 3000, 4000
#: Words of ordinary text in both dictionaries, and of toxic text in one, at most.
COMMON, TYPICAL = 300, 2000
#: Ordinary words on which the toxic dictionary would save so many bytes, in both dictionaries; found twice, so many each time.
SAVES, ALIKE = 5, 1000
#: A typical word is so many times as frequent in toxic text, has so many contexts there or in the part of its documents, and so large a log-likelihood ratio.
RATIO, LEAST, PART, GAIN = 8.0, 3, 0.01, 9.0
FRAME, LONGEST, CACHE = 16, 64, 300_000
_MARKS = str.maketrans({c: " " for c in ".,%&$#*!?:;|-\"'()[]{}<>/\\=+_~`^"})


def words(text: str) -> list[str]:
    """Lower-case words without marks; long ones in overlapping parts."""
    found = text.lower().translate(_MARKS).split()
    if found and max(map(len, found)) > LONGEST:
        step = LONGEST - FRAME
        found = [w[i : i + LONGEST] for w in found for i in range(0, max(1, len(w) - FRAME), step)]
    return found


def _terms(w: list[str]) -> list[tuple[str, int]]:
    """Words, and beginnings of longer words marked by ``^``, with their places."""
    return [(x, i) for i, x in enumerate(w) if len(x) > 2] + [("^" + x[:k], i) for k in (4, 5) for i, x in enumerate(w) if len(x) > k]


def _contexts(texts: list[str], names: dict[int, str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of terms in order and how varied their neighbours are: the fewer of different words before and after."""
    before, after = [], []
    for t in texts:
        w = words(t)
        code = np.array([0, *(zlib.crc32(x.encode()) for x in w), 0], np.uint64)
        terms = _terms(w)
        if not terms:
            continue
        own = np.array([zlib.crc32(x.encode()) for x, _ in terms], np.uint64)
        at = np.array([i for _, i in terms])
        before.append(own << np.uint64(32) | code[at])
        after.append(own << np.uint64(32) | code[at + 2])
        if names is not None:
            names.update(zip(own.tolist(), (x for x, _ in terms), strict=True))
    if not before:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    codes, count = np.unique(np.unique(np.concatenate(before)) >> np.uint64(32), return_counts=True)
    _, other = np.unique(np.unique(np.concatenate(after)) >> np.uint64(32), return_counts=True)
    return codes, np.minimum(count, other)


class Saver:
    """Bytes that the toxic dictionary saves over the ordinary one on a window."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard as zs

        settings = zs.ZstdCompressionParameters.from_level(3, min_match=5, strategy=zs.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False, window_log=17, hash_log=14, chain_log=14, search_log=5)
        self.frame = ordinary[-FRAME:]

        def sizes(content: bytes):
            held = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=settings)
            return zs.ZstdCompressor(compression_params=settings, dict_data=held).compress

        self.ordinary, self.toxic = sizes(ordinary), sizes(toxic)

    def __call__(self, word: str) -> int:
        window = self.frame + b" " + word.encode() + b" " + self.frame
        return len(self.ordinary(window)) - len(self.toxic(window))


@dataclass
class Model:
    """Dictionaries, the least saving of a hit, its share in ordinary and in toxic text, and the logistic curve."""

    ordinary: bytes
    toxic: bytes
    threshold: int
    share: float
    rate: float
    slope: float
    level: float

    def score(self, hits: np.ndarray, n: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.level + self.slope * _evidence(hits, n, self.share, self.rate))))


def _evidence(hits: np.ndarray, n: np.ndarray, share: float, rate: float) -> np.ndarray:
    """Log-likelihood ratio of so many hits at the two classes' rates, damped for long texts."""
    ratio = hits * np.log(rate / share) + (n - hits) * np.log((1 - rate) / (1 - share))
    return np.sign(ratio) * np.log1p(np.abs(ratio))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Slope, level and mean loss, with a light pull of the slope to zero."""
    a = np.column_stack([x, np.ones(len(x))])
    w, pull = np.zeros(2), np.array([1e-2, 1e-4])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.diag(pull), a.T @ (y - p) - pull * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(a @ w, -30, 30))), 1e-9, 1 - 1e-9)
    return float(w[0]), float(w[1]), float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def unlike(texts: list[str], seen_share: float = 0.25) -> list[str]:
    """The texts in order without those that have so large a share of their word triples in common with earlier ones."""
    seen = np.zeros(1 << 25, bool)
    kept = []
    for t in texts:
        w = np.array([zlib.crc32(x.encode()) for x in words(t)], np.uint64)
        if len(w) < 3:
            kept.append(t)
            continue
        code = ((w[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ w[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) ^ w[2:]) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(39)
        if seen[code].mean() < seen_share:
            kept.append(t)
        seen[code] = True
    return kept


def _dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    names: dict[int, str] = {}
    bad, bad_c = _contexts(toxic, names)
    good, good_c = _contexts(ordinary)
    at = np.minimum(np.searchsorted(good, bad), max(len(good) - 1, 0))
    known = np.where(good[at] == bad, good_c[at], 0) if len(good) else np.zeros(len(bad))
    expected = (known + 0.5) * max(1, bad_c.sum()) / max(1, good_c.sum())
    gain = bad_c * np.log(np.maximum(bad_c, 1) / expected) - (bad_c - expected)
    least = max(LEAST, PART * len(toxic))
    typical = np.flatnonzero((bad_c >= least) & (bad_c >= RATIO * expected) & (gain >= GAIN))
    typical = typical[np.argsort(gain[typical], kind="stable")][-TYPICAL:]
    told = [names[int(c)].removeprefix("^") for c in bad[typical]]
    ranked = sorted(Counter(w for t in ordinary for w in words(t)).items(), key=lambda x: (-x[1], x[0]))
    common = " ".join(w for w, _ in ranked[:COMMON][::-1])
    alike: list[str] = []
    for _ in range(2 if told else 0):
        saver = Saver(*_contents(told, alike, common))
        held = set(told) | set(alike)
        alike += [w for w, _ in ranked if w not in held and saver(w) >= SAVES][:ALIKE]
    return _contents(told, alike, common)


def _contents(told: list[str], alike: list[str], common: str) -> tuple[bytes, bytes]:
    shared = f" {' '.join(alike[::-1])} {common} ".rjust(FRAME + 1)
    return shared.encode(), (" " + " ".join(told) + shared).encode()


def fit(toxic: list[str], ordinary: list[str]) -> Model | None:
    """A model from labelled texts; None if a class is missing. The texts' order is that of the split in halves."""
    toxic = unlike(toxic)
    if len(toxic) < 2 or len(ordinary) < 2:
        return None
    held: list[tuple[np.ndarray, float]] = []
    for half in (0, 1):  # each half is measured by the dictionaries of the other
        saver = Saver(*_dictionaries(toxic[half::2], ordinary[half::2]))
        known: dict[str, int] = {}
        for texts, y in ((toxic[1 - half :: 2], 1.0), (ordinary[1 - half :: 2], 0.0)):
            for t in texts:
                w = words(t)
                for x in w:
                    if x not in known:
                        known[x] = saver(x)
                held.append((np.array([known[x] for x in w], int), y))
    y = np.array([v for _, v in held])
    n = np.array([len(s) for s, _ in held], float)
    best = None
    for t in range(2, 9):
        hits = np.array([(s >= t).sum() for s, _ in held], float)
        share = float((hits[y == 0].sum() + 1) / (n[y == 0].sum() + 1000))
        rate = float(np.clip(np.median(hits[y == 1] / np.maximum(n[y == 1], 1)) / 2, 2 * share, 0.5))
        if rate >= 1:
            continue
        slope, level, loss = _logistic(_evidence(hits, n, share, rate), y)
        if best is None or loss < best[0] - 1e-6:
            best = (loss, t, share, rate, slope, level)
    return Model(*_dictionaries(toxic, ordinary), *best[1:])


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fits on a bounded sample of labelled rows whose crc32(doc_id as text) mod 4 isn't 2.

    Ids with more than one label don't count. The sample's ids are picked from
    the labels alone, so that the join to the texts has a side of at most
    ``TOXIC_ROWS + ORDINARY_ROWS`` rows, which is broadcast.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_part("doc_id", 4) != 2)).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_other")).where(F.col("toxic") == F.col("_other"))
    picked = bounded_sample(known.select("doc_id", "toxic"), "toxic", F.xxhash64("doc_id"), max(ORDINARY_ROWS, TOXIC_ROWS))
    picked = picked.where((F.col("toxic") == 0) & (F.col("_r") <= ORDINARY_ROWS) | (F.col("toxic") == 1) & (F.col("_r") <= TOXIC_ROWS)).select("doc_id", "toxic", "_r")
    rows = picked.collect()
    if not rows:
        return None
    few = docs.sparkSession.createDataFrame([tuple(r) for r in rows], picked.schema)
    text = F.coalesce("text", F.lit(""))
    room = F.greatest(F.length(text) - CHARACTERS, F.lit(0)) + 1
    found = docs.select("doc_id", F.substring(text, F.pmod(F.xxhash64("doc_id"), room.cast("long")).cast("int") + 1, F.lit(CHARACTERS)).alias("text")).join(F.broadcast(few), "doc_id")
    got = sorted({(r["toxic"], r["_r"]): r["text"] for r in found.collect()}.items())
    return fit([t for (k, _), t in got if k == 1], [t for (k, _), t in got if k == 0])


class Scorer:
    """Hits and windows of texts; keeps what it knows of late words."""

    def __init__(self, model: Model):
        self.model, self.saver = model, Saver(model.ordinary, model.toxic)
        self.hit: set[str] = set()
        self.known: set[str] = set()
        self.older: set[str] = set()

    def __call__(self, texts: list[str]) -> tuple[list[int], list[int]]:
        if len(self.known) > CACHE:
            self.known, self.older = set(), self.known
            self.hit &= self.older
        split = [words(t) for t in texts]
        new = set().union(*split).difference(self.known)
        for w in new.difference(self.older):
            if self.saver(w) >= self.model.threshold:
                self.hit.add(w)
        self.known |= new
        has = self.hit.__contains__
        return [sum(map(has, s)) for s in split], [len(s) for s in split]


def _score(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    release()
    model = shared.value
    scorer = Scorer(model) if model else None
    for batch in batches:
        score = np.zeros(len(batch))
        i = 0
        for group in batched(batch.column("_body").to_pylist()):
            if scorer:
                hits, n = scorer(group)
                score[i : i + len(group)] = model.score(np.array(hits, float), np.array(n, float))
            i += len(group)
        names = [n for n in batch.schema.names if n != "_body"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(score)], names=[*names, "score"])


def score(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``score`` of every row's whole text, also of null (as empty) and empty ones; 0 without a model."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_body"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_body")
    return rows.mapInArrow(lambda it: _score(it, shared), f"{fields}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; labels of held-out rows aren't learned from."""
    scored = score(docs, learn(docs, labels))
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_part("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
