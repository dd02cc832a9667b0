"""Language identification by a byte convolutional network, trained in numpy.

Bytes are folded to a small alphabet (letters without case, one sign each for
space, digits and other marks, UTF-8 continuation bytes without the bit that
tells case in Latin letters). Filters of several widths run over windows of a
fixed length; the maximum of each over a window feeds a softmax. A whole text is
cut into windows, which are scored in batches, and a document's prediction is
the length-weighted mean of its windows' probabilities.

Filters are applied by table look-up: a pair of signs is one row of a table
that holds its part of every filter, so no one-hot vectors are built.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, bounded_sample, buffers, crc_part, release

#: Labelled documents of each language that are learned from at most, and characters taken of each, from a place drawn by hash.
ROWS, CHARACTERS = 1500, 600
WINDOW, FILTERS, WIDTHS = 256, 16, (2, 3, 4)
SIGNS = 128
#: Windows that are scored at a time.
BATCH = 96


def _folding() -> np.ndarray:
    """Sign of each byte; 0 is no byte at all."""
    out = np.zeros(256, np.int32)
    for b in range(256):
        if 65 <= b <= 90 or 97 <= b <= 122:
            out[b] = 1 + (b | 32) - 97
        elif b <= 32:
            out[b] = 27
        elif 48 <= b <= 57:
            out[b] = 28
        elif b < 128:
            out[b] = 29
        elif b < 192:
            out[b] = 30 + (b & 31)
        elif b < 224:
            out[b] = 62 + (b & 31)
        elif b < 240:
            out[b] = 94 + (b & 15)
        else:
            out[b] = 110
    return out


_FOLD = _folding()
TAIL = max(WIDTHS) - 1


@dataclass
class Network:
    """Filters by width as (width, signs, filters), the softmax layer, and its languages."""

    filters: list[np.ndarray]
    weights: np.ndarray
    bias: np.ndarray
    languages: list[str]

    def tables(self) -> tuple[np.ndarray, ...]:
        w2, w3, w4 = self.filters
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(SIGNS * SIGNS, FILTERS).astype(np.float32)
        return pair(w2[0], w2[1]), pair(w3[0], w3[1]), w3[2].astype(np.float32), pair(w4[0], w4[1]), pair(w4[2], w4[3])


def _pooled(signs: np.ndarray, tables: tuple[np.ndarray, ...], where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Maximum of every filter over each row's ``WINDOW`` places, and that place."""
    t2, t3, u3, t4, v4 = tables
    pairs = signs[:, :-1] * SIGNS + signs[:, 1:]
    head = pairs[:, :WINDOW]
    maps = []
    maps.append(t2[head])
    three = t3[head]
    three += u3[signs[:, 2 : WINDOW + 2]]
    maps.append(three)
    four = t4[head]
    four += v4[pairs[:, 2 : WINDOW + 2]]
    maps.append(four)
    top = np.concatenate([m.max(axis=1) for m in maps], axis=1)
    return top, np.concatenate([m.argmax(axis=1) for m in maps], axis=1) if where else None


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], languages: list[str], rounds: int = 14, seed: int = 7) -> Network | None:
    """A network from labelled texts by Adam; windows are cut at random lengths, so that short texts are known too."""
    names = sorted(set(languages))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    y = np.searchsorted(names, languages)
    data = [_FOLD[np.frombuffer(t.encode(), np.uint8)] for t in texts]
    keep = [i for i, d in enumerate(data) if len(d)]
    net = Network([rng.normal(0, 0.3, (w, SIGNS, FILTERS)) for w in WIDTHS], rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(names))), np.zeros(len(names)), names)
    if not keep or len(names) == 1:
        return net
    params = [*net.filters, net.weights, net.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    share = np.bincount(y[keep], minlength=len(names)) / len(keep)
    step, size = 0, 64
    total = rounds * max(1, -(-len(keep) // size))
    for _ in range(rounds):
        order = rng.permutation(keep)
        for s in range(0, len(order), size):
            rows = order[s : s + size]
            signs = np.zeros((len(rows), WINDOW + TAIL), np.int32)
            for i, r in enumerate(rows):
                n = int(min(len(data[r]), WINDOW + TAIL, 8 * 2 ** rng.uniform(0, 5.1)))
                a = int(rng.integers(0, len(data[r]) - n + 1))
                signs[i, :n] = data[r][a : a + n]
            top, at = _pooled(signs, net.tables(), True)
            hidden = np.maximum(top, 0)
            p = _softmax(hidden @ net.weights + net.bias)
            d = p.copy()
            d[np.arange(len(rows)), y[rows]] -= 1
            d *= (1 / np.maximum(share[y[rows]] * len(names), 0.05) ** 0.5)[:, None] / len(rows)
            grads = [np.zeros_like(f) for f in net.filters]
            back = (d @ net.weights.T) * (top > 0)
            for k, w in enumerate(WIDTHS):
                part, place = back[:, k * FILTERS : (k + 1) * FILTERS], at[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(w):
                    sign = np.take_along_axis(signs, place + j, axis=1)
                    np.add.at(grads[k][j], (sign, np.arange(FILTERS)[None, :]), part)
            grads += [hidden.T @ d, d.sum(axis=0)]
            step += 1
            rate = 0.02 * (1 - 0.9 * step / total)
            for q, g, m, v in zip(params, grads, first, second, strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


class Reader:
    """Mean probabilities of whole texts."""

    def __init__(self, net: Network):
        self.net, self.tables = net, net.tables()
        self.weights, self.bias = net.weights.astype(np.float32), net.bias.astype(np.float32)

    def __call__(self, at: np.ndarray, raw: np.ndarray) -> np.ndarray:
        n = np.diff(at)
        count = -(-n // WINDOW)
        row = np.repeat(np.arange(len(n)), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start, end = at[row] + nth * WINDOW, at[row + 1]
        out = np.zeros((len(n), len(self.net.languages)))
        reach = np.arange(WINDOW + TAIL)
        for s in range(0, len(row), BATCH):
            a, e = start[s : s + BATCH], end[s : s + BATCH]
            places = a[:, None] + reach
            inside = places < e[:, None]
            signs = np.where(inside, _FOLD[raw[np.minimum(places, len(raw) - 1)]], 0)
            top, _ = _pooled(signs, self.tables)
            p = _softmax(np.maximum(top, 0) @ self.weights + self.bias)
            np.add.at(out, row[s : s + BATCH], p * np.minimum(e - a, WINDOW)[:, None])
        return out / np.maximum(n, 1)[:, None]


def learn(docs: DataFrame) -> Network | None:
    """Trains on at most ``ROWS`` documents of each language whose crc32(doc_id as text) mod 3 isn't 1."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_part("doc_id", 3) != 1))
    room = F.greatest(F.length("text") - CHARACTERS, F.lit(0)) + 1
    # only the characters that are learned from go through the sample's shuffle
    part = F.substring("text", F.pmod(F.xxhash64("doc_id", F.lit(2)), room.cast("long")).cast("int") + 1, F.lit(CHARACTERS))
    picked = bounded_sample(rows.select("doc_id", "lang", part.alias("text")), "lang", F.xxhash64("doc_id"), ROWS)
    got = picked.select("lang", "_r", "text").collect()
    got = sorted(got, key=lambda r: (r["lang"], r["_r"], r["text"]))
    return train([r["text"] for r in got], [r["lang"] for r in got])


def _predict(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    release()
    net = shared.value
    reader = Reader(net) if net else None
    for batch in batches:
        lang = np.full(len(batch), "und", object)
        score = np.zeros(len(batch))
        letters = np.asarray(batch.column("_letters").to_pylist(), bool)
        if reader and len(batch):
            p = reader(*buffers(batch.column("_body")))
            best = p.argmax(axis=1)
            lang = np.where(letters, np.array(net.languages, object)[best], "und")
            score = np.where(letters, np.minimum(p[np.arange(len(p)), best], 1.0), 0.0)
        names = [n for n in batch.schema.names if n not in ("_body", "_letters")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])


def predict(docs: DataFrame, net: Network | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` of every row's whole text.

    ``und`` with score 0 where the text is null or has no letter, or where no
    labelled text was there to learn from.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*keep, text.alias("_body"), text.rlike("\\p{L}").alias("_letters"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("_body", "_letters"))
    return rows.mapInArrow(lambda it: _predict(it, shared), f"{fields}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row; held-out rows aren't learned from."""
    found = predict(docs, learn(docs))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_part("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
