"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A word is a run of bytes above the space in the lower-case text; a shingle is
five successive words (all words, if there are fewer). A shingle's weight in a
document is its count there times its inverse document frequency, the mean of
those of its words; word frequencies are counted over all documents in a fixed
number of hashed buckets, so that the table that the executors get has one size
for any corpus.

Samples of the weighted sets are joined to bands. Documents that share a band
are linked to the band's least text, failures to every other member of that
band which looks alike by its samples; a link holds if the weighted Jaccard
similarity of both whole texts reaches the threshold. Groups are the connected
components of the links; exact copies are one text all the way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from .common import U64, buffers, discard, materialize, mix64, release
from .components import components

#: Hashed word buckets for document frequencies; the broadcast table has this many floats.
BUCKETS = 1 << 17
#: Distinct sets of random variates; shingles are dealt over them by their hash.
VARIATES = 1 << 15
SHINGLE = 5
#: Bytes of successive documents that are hashed at a time.
SLICE = 1 << 19
#: Members of a bucket that are compared with as many others at a time.
BLOCK = 500
#: Rows for each part that a band's members are dealt into when they are joined to its least text.
PART_ROWS = 50_000
#: Hashed cells of a weighted set's sketch.
CELLS = 512

_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPREAD = (np.random.Generator(np.random.PCG64(5)).integers(1, 2**62, 8, dtype=np.int64).astype(U64) << U64(1)) | U64(1)
_powers: dict[str, np.ndarray] = {}


def _power(base: U64, n: int) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        start = np.full(max(n, SLICE), base)
        start[0] = 1
        _powers[key] = np.multiply.accumulate(start)
    return _powers[key][:n]


def _words(at: np.ndarray, raw: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, word counts up to each row) for successive rows at a time."""
    i, n = 0, len(at) - 1
    while i < n:
        j = i + 1
        while j < n and at[j + 1] - at[i] <= SLICE:
            j += 1
        lo, hi = int(at[i]), int(at[j])
        part = raw[lo:hi]
        edges = at[i : j + 1] - lo
        if hi > lo:
            word = part > 32
            start = word.copy()
            start[1:] &= ~word[:-1]
            stop = word.copy()
            stop[:-1] &= ~word[1:]
            inner = edges[1:-1]
            inner = inner[(inner > 0) & (inner < hi - lo)]
            start[inner] = word[inner]
            stop[inner - 1] = word[inner - 1]
            s, e = np.flatnonzero(start), np.flatnonzero(stop)
            total = np.zeros(hi - lo + 1, U64)
            np.cumsum((part + U64(1)) * _power(_BASE, hi - lo), out=total[1:])
            hashes = mix64((total[e + 1] - total[s]) * _power(_INVERSE, hi - lo)[s])
            yield i, hashes, np.searchsorted(s, edges)
        else:
            yield i, np.zeros(0, U64), np.zeros(j - i + 1, np.int64)
        i = j


def _weights(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order, and their weights."""
    k = min(SHINGLE, len(words))
    n = len(words) - k + 1
    known = idf[(words >> U64(47)).astype(np.int64)]
    both, mean = words[:n] * _SPREAD[0], known[:n].copy()
    for j in range(1, k):
        both = both + words[j : j + n] * _SPREAD[j]
        mean += known[j : j + n]
    shingles, first, count = np.unique(mix64(both), return_index=True, return_counts=True)
    return shingles, (count * mean[first] / np.float32(k)).astype(np.float32)


def _variates(samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(2010))
    r = rng.gamma(2.0, 1.0, (samples, VARIATES)).astype(np.float32)
    c = np.log(rng.gamma(2.0, 1.0, (samples, VARIATES))).astype(np.float32)
    return r, c, rng.random((samples, VARIATES), dtype=np.float32)


def _sample(shingles: np.ndarray, weights: np.ndarray, tables: tuple[np.ndarray, ...]) -> np.ndarray:
    """One 64-bit name for each consistent sample of a weighted set."""
    r_all, c_all, b_all = tables
    k = np.arange(len(r_all))
    best, name = np.full(len(k), np.inf, np.float32), np.zeros(len(k), U64)
    logs = np.log(weights)
    for s in range(0, len(shingles), 1 << 14):
        cols = (shingles[s : s + (1 << 14)] >> U64(49)).astype(np.int64)
        r, b = np.take(r_all, cols, axis=1), np.take(b_all, cols, axis=1)
        t = np.floor(logs[s : s + (1 << 14)] / r + b)
        level = np.take(c_all, cols, axis=1) - r * (t - b + 1)
        i = level.argmin(axis=1)
        got = level[k, i]
        better = got < best
        best = np.where(better, got, best)
        own = shingles[s + i] * _SPREAD[5] + t[k, i].astype(np.int64).astype(U64) * _SPREAD[6] + k.astype(U64)
        name = np.where(better, own, name)
    return mix64(name)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    found, rows = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        at, raw = buffers(batch.column("text"))
        rows += len(batch)
        for _, hashes, upto in _words(at, raw):
            cell = (hashes >> U64(47)).astype(np.int64)
            for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
                if b > a:
                    found[np.unique(cell[a:b])] += 1
    has = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(has, -1), pa.int64()), pa.array(np.append(found[has], rows), pa.int64())], names=["bucket", "n"])


def word_idf(lowered: DataFrame) -> np.ndarray:
    """Inverse document frequency of every word bucket over all rows; ``BUCKETS`` floats."""
    counts = lowered.select("text").mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = (np.asarray(counts.column(c)) for c in ("bucket", "n"))
    total = max(1, int(n[bucket < 0].sum()))
    df = np.ones(BUCKETS)
    df[bucket[bucket >= 0]] = n[bucket >= 0]
    return np.log(1 + total / df).astype(np.float32)


def _signatures(batches: Iterator[pa.RecordBatch], idf, tables, rows: int) -> Iterator[pa.RecordBatch]:
    release()
    samples = len(tables.value[0])
    for batch in batches:
        at, raw = buffers(batch.column("text"))
        bands: list[np.ndarray | None] = [None] * len(batch)
        for i, hashes, upto in _words(at, raw):
            for j in range(len(upto) - 1):
                own = hashes[upto[j] : upto[j + 1]]
                if len(own):
                    name = _sample(*_weights(own, idf.value), tables.value)
                    parts = name.reshape(-1, rows)
                    key = np.arange(samples // rows, dtype=U64) * _SPREAD[7]
                    for c in range(rows):
                        key = mix64(key + parts[:, c])
                    bands[i + j] = key.view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("node"), pa.array(bands, pa.list_(pa.int64()))],
            names=["doc_id", "node", "bands"],
        )


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (ordered shingles, weights)."""
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    least = float(np.minimum(x[1][i], y[1][j]).sum(dtype=np.float64))
    total = float(x[1].sum(dtype=np.float64) + y[1].sum(dtype=np.float64)) - least
    return least / total if total > 0 else 0.0


def _verify(batches: Iterator[pa.RecordBatch], idf) -> Iterator[pa.RecordBatch]:
    last: tuple[int, tuple] | None = None
    for batch in batches:
        a = np.asarray(batch.column("a"))
        at, raw = buffers(batch.column("text_a"))
        sims = np.zeros(len(batch))
        for first, hashes, upto in _words(*buffers(batch.column("text_b"))):
            for i in range(first, first + len(upto) - 1):
                if last is None or last[0] != a[i]:
                    whole = [h for _, h, _ in _words(at[i : i + 2], raw)]
                    last = (int(a[i]), _weights(np.concatenate(whole), idf.value))
                sims[i] = similarity(last[1], _weights(hashes[upto[i - first] : upto[i - first + 1]], idf.value))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sims)], names=["a", "b", "similarity"])


def _vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(text.encode(), np.uint8)
    return _weights(np.concatenate([h for _, h, _ in _words(np.array([0, len(raw)]), raw)]), idf)


def _left_over(threshold: float, idf):
    """Links of failed members to any member outside their component, as many as join components.

    Weights summed by hashed cell bound a similarity from above, so that only
    pairs that may reach the threshold are compared in full; none is missed.
    """

    def compare(failed: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        out_a, out_b = [], []
        if len(failed) and len(members):
            vectors = {n: _vector(t, idf.value) for n, t in zip([*failed.f_node, *members.m_node], [*failed.f_text, *members.m_text], strict=True)}
            nodes = members.m_node.to_numpy()
            cells = np.zeros((len(nodes), CELLS), np.float32)
            total = np.zeros(len(nodes), np.float32)
            for i, n in enumerate(nodes):
                cells[i] = np.bincount((vectors[n][0] >> U64(55)).astype(np.int64), vectors[n][1], CELLS)
                total[i] = cells[i].sum()
            comp, own = members.m_comp.to_numpy().copy(), failed.f_comp.to_numpy().copy()
            for i, node in enumerate(failed.f_node):
                other = np.flatnonzero(comp != own[i])
                mine = np.bincount((vectors[node][0] >> U64(55)).astype(np.int64), vectors[node][1], CELLS).astype(np.float32)
                least = np.minimum(cells[other], mine).sum(axis=1)
                near = other[least >= (threshold - 1e-3) * (total[other] + mine.sum() - least)]
                for j in near:
                    if comp[j] != own[i] and similarity(vectors[node], vectors[nodes[j]]) >= threshold:
                        out_a.append(node)
                        out_b.append(nodes[j])
                        old, new = own[i], comp[j]
                        comp[comp == old] = new
                        own[own == old] = new
        return pd.DataFrame({"a": pd.Series(out_a, dtype="int64"), "b": pd.Series(out_b, dtype="int64")})

    return compare


def _grouped(docs: DataFrame, threshold: float, bands: int, rows: int) -> DataFrame:
    """``doc_id, node, comp``: each row's text hash and the least text hash of its group."""
    spark: SparkSession = docs.sparkSession
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"))
    idf = spark.sparkContext.broadcast(word_idf(body))
    tables = spark.sparkContext.broadcast(_variates(bands * rows))
    signed = materialize(body.mapInArrow(lambda it: _signatures(it, idf, tables, rows), "doc_id long, node long, bands array<long>"), "signatures")

    # one row for each text, so that exact copies don't swell a band; a band that many texts share is dealt into parts
    parts = max(32, signed.count() // PART_ROWS)
    texts_signed = signed.select("node", "bands").dropDuplicates(["node"])
    members = materialize(texts_signed.select("node", F.explode("bands").alias("band"), F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int").alias("part")), "members")
    ends = members.groupBy("band", "part").agg(F.min("node").alias("a"), F.max("node").alias("_z"))
    buckets = ends.groupBy("band").agg(F.min("a").alias("a"), F.max("_z").alias("_z")).where("a <> _z").select("band", "a")
    keyed = ends.select("band", "part").join(buckets, "band")
    star = materialize(members.join(keyed, ["band", "part"]).where("node <> a").select("band", "part", "a", F.col("node").alias("b")), "star")
    discard(members)
    first = star.select("a", "b").distinct()

    wanted = first.select(F.col("a").alias("node")).unionByName(first.select(F.col("b").alias("node"))).distinct()
    one = signed.groupBy("node").agg(F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("_id")).join(wanted, "node")
    texts = materialize(
        body.withColumn("_id", F.coalesce("doc_id", F.lit(-(2**63)))).join(one, ["node", "_id"]).select("node", "text").dropDuplicates(["node"]),
        "texts",
    )

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        return materialize(both.select("a", "b", "text_a", "text_b").mapInArrow(lambda it: _verify(it, idf), "a long, b long, similarity double"), "verified")

    checked = verified(first)
    links = checked.where(F.col("similarity") >= threshold).select("a", "b")
    failed = checked.where(F.col("similarity") < threshold).select("a", "b")
    comps = components(links)

    # Failures meet all others of their band that aren't in their component yet. Counts go from part to band and back, so
    # that a band's rows, however many, are joined by part.
    place = ["band", "part"]
    lost = star.join(failed, ["a", "b"]).select(*place, F.col("b").alias("node")).distinct()
    counted = star.groupBy(*place).agg(F.count(F.lit(1)).alias("_m")).join(lost.groupBy(*place).agg(F.count(F.lit(1)).alias("_f")), place, "left")
    blocks = counted.groupBy("band").agg(F.ceil(F.sum("_m") / BLOCK).alias("_mb"), F.ceil(F.sum("_f") / BLOCK).alias("_fb"), F.sum("_m").alias("_m")).where("_m > 1 and _fb > 0").select("band", "_mb", "_fb")
    sized = materialize(counted.select(*place).join(blocks, "band"), "blocks")

    def detailed(rows_: DataFrame) -> DataFrame:
        known = rows_.join(sized, place).drop("part")
        return known.join(texts, "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    left = detailed(lost).withColumn("_fi", F.pmod(F.xxhash64("node"), F.col("_fb")).cast("int")).withColumn("_mi", every("_mb"))
    right = detailed(star.select(*place, F.col("b").alias("node"))).withColumn("_mi", F.pmod(F.xxhash64("node"), F.col("_mb")).cast("int")).withColumn("_fi", every("_fb"))
    keys = ["band", "_fi", "_mi"]
    named_apart = lambda df, side: df.select(*[F.col(c).alias(side + c) for c in [*keys, "node", "text", "comp"]]).groupBy(*[side + c for c in keys])
    more = named_apart(left, "f_").cogroup(named_apart(right, "m_")).applyInPandas(_left_over(threshold, idf), "a long, b long")
    groups = components(links.unionByName(more.distinct()))
    discard(star, texts, checked, comps, sized)

    return signed.select("doc_id", "node").join(groups, "node", "left").select("doc_id", "node", F.coalesce("comp", "node").alias("comp"))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = 10, rows: int = 3) -> DataFrame:
    """``doc_id, class_id, class_size``: one row per row of ``docs``.

    ``class_id`` is the least doc_id of the document's group. Rows with one text
    are one group; a text without words is linked to nothing else. Null texts
    count as empty. Null ids are ignored for ``class_id`` unless all are null.
    Texts are told apart by a 64-bit hash.
    """
    named = materialize(_grouped(docs, threshold, bands, rows), "grouped")
    classes = named.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return named.join(classes, "comp").select("doc_id", "class_id", "class_size")


def deduplicate(docs: DataFrame, threshold: float = 0.8, bands: int = 10, rows: int = 3) -> DataFrame:
    """``docs`` with one row of each group: that of the least doc_id (nulls last), of its texts the least hash.

    Of rows with one id and text the first by the other columns stays.
    """
    last = F.lit(2**63 - 1)
    named = _grouped(docs, threshold, bands, rows)
    kept = named.groupBy("comp").agg(F.min(F.struct(F.coalesce("doc_id", last).alias("_id"), "node")).alias("_k")).select("_k._id", F.col("_k.node").alias("_node"))
    marked = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), last)).withColumn("_node", F.xxhash64(F.coalesce("text", F.lit(""))))
    others = [F.col(f"`{f.name}`") for f in docs.schema if f.name != "text" and isinstance(f.dataType, AtomicType)]
    one = Window.partitionBy("_id", "_node").orderBy(*(others or [F.lit(0)]))
    return marked.join(kept, ["_id", "_node"], "left_semi").withColumn("_n", F.row_number().over(one)).where("_n = 1").select(*docs.columns)
