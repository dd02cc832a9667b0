"""Removal of long repeated byte strings by prefix doubling over sampled positions.

A byte goes if a string of ``length`` bytes that covers it also starts at some
other place of the corpus, the same document included; matches never cross
documents and strings are judged on the input.

Ranks are doubled. Inside a document, ranks of strings of 1, 2, 4, ... up to
``length / 2`` bytes are 64-bit names, combined from two names at growing
offsets, so no sort is needed. From there on Spark sorts and reranks:

1. Of every window of ``length / 2 + 1`` successive half-length names the least
   is the window's anchor. It depends on the window's bytes alone, so equal
   strings have equal anchors, and some one in a hundred positions is one. Spark
   ranks the anchors; those with a unique name are settled: nothing that they
   stand for repeats.
2. Anchors left are ranked together with the names around all windows that
   they stand for. If all anchors of a name agree, each such window repeats.
3. Where they differ (the ends of a shared passage), one anchor of each kind is
   opened: its positions get the pair (name at p, name at p + length / 2), Spark
   ranks the pairs, and a position repeats if its pair isn't unique.

Step 3 is the doubling to the full length; steps 1 and 2 only keep positions
whose rank is settled out of it. No step has caps: a passage in a third of all
documents is a large count, aggregated before the shuffle. Where a text repeats
itself at a short period, its anchors' equal successors are one row with their
number, so that a long run of one letter is a few rows; windows found are merged
by stretches of a text before those of a text come together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, bounded_batches, buffers, discard, materialize, mix64, release

#: Bytes that are named at a time; bounds a worker's memory for texts of any length.
SLICE = 1 << 18
#: Bytes of a text whose windows found are merged at a time.
STRETCH = 1 << 16
_BYTE = np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, 256, dtype=np.int64).astype(U64)
_ODD = (np.random.Generator(np.random.PCG64(78)).integers(1, 2**62, 64, dtype=np.int64).astype(U64) << U64(1)) | U64(1)


def names(raw: np.ndarray, width: int) -> np.ndarray:
    """64-bit names of all strings of ``width`` bytes in ``raw``, by doubling."""
    now, step, turn = _BYTE[raw], 1, 0
    while step < width:
        ahead = min(step, width - step)
        both = now[:-ahead] * _ODD[turn]
        both += now[ahead:]
        if turn % 3 == 2:
            both ^= both >> U64(29)
        now, step, turn = both, step + ahead, turn + 1
    return mix64(now)


def _slices(at: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, end, first, last): byte ranges to name at a time; documents' windows start in [first, last)."""
    group: list[int] = []
    start = 0

    def out(rows: list[int]):
        lo, hi = int(at[rows[0]]), int(at[rows[-1] + 1])
        idx = np.array(rows)
        first, last = at[idx], at[idx + 1] - length + 1
        keep = last > first
        return lo, hi, idx[keep], first[keep], last[keep]

    for i in range(len(at) - 1):
        n = int(at[i + 1] - at[i])
        if n > SLICE:
            if group:
                yield out(group)
                group = []
            for s in range(int(at[i]), int(at[i + 1]) - length + 1, SLICE):
                e = min(s + SLICE + length - 1, int(at[i + 1]))
                yield s, e, np.array([i]), np.array([s]), np.array([e - length + 1])
            continue
        if group and at[i + 1] - at[group[0]] > SLICE:
            yield out(group)
            group = []
        group.append(i)
    if group:
        yield out(group)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step < width:
        ahead = min(step, width - step)
        x = np.minimum(x[:-ahead], x[ahead:])
        step += ahead
    return x


def _anchors(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    release()
    half, width = length // 2, length - length // 2 + 1
    low = U64((1 << 20) - 1)
    for batch in batches:
        at, raw = buffers(batch.column("text"))
        rows, names_, kinds, starts, spans, times = [], [], [], [], [], []
        for lo, hi, idx, first, last in _slices(at, length):
            if not len(idx):
                continue
            g = names(raw[lo:hi], half)
            where = _least((g & ~low) | np.arange(len(g), dtype=U64), width) & low
            where = where.astype(np.int64)
            # runs of windows with one anchor, cut at documents' ends
            inside = np.zeros(len(where) + 1, np.int32)
            np.add.at(inside, first - lo, 1)
            np.add.at(inside, last - lo, -1)
            ok = np.cumsum(inside)[:-1] > 0
            new = np.ones(len(where), bool)
            new[1:] = where[1:] != where[:-1]
            new[first - lo] = True
            edge = np.flatnonzero(new & ok)
            stop = np.flatnonzero(ok & np.append(new[1:] | ~ok[1:], True))
            a = where[edge]
            second = length - half
            kind = mix64(g[edge] * _ODD[40] + g[edge + second] * _ODD[41] + g[stop] * _ODD[42] + g[stop + second] * _ODD[43] + (a - edge).astype(U64) * _ODD[44] + (stop - edge).astype(U64) * _ODD[45])
            own = idx[np.searchsorted(first, edge + lo, side="right") - 1]
            name = g[a]
            # equal neighbours, as a period makes them, are one row
            head = np.ones(len(edge), bool)
            head[1:] = (name[1:] != name[:-1]) | (kind[1:] != kind[:-1]) | (own[1:] != own[:-1]) | (edge[1:] != stop[:-1] + 1)
            head = np.flatnonzero(head)
            tail = np.append(head[1:], len(edge)) - 1
            rows.append(own[head])
            names_.append(name[head])
            kinds.append(kind[head])
            starts.append(edge[head] + lo - at[own[head]])
            spans.append(stop[tail] - edge[head])
            times.append(tail - head + 1)
        if not rows:
            continue
        own = pa.array(np.concatenate(rows))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(own),
                batch.column("text_key").take(own),
                pa.array(np.concatenate(names_).view(np.int64)),
                pa.array(np.concatenate(kinds).view(np.int64)),
                pa.array(np.concatenate(starts).astype(np.int32)),
                pa.array(np.concatenate(spans).astype(np.int32)),
                pa.array(np.concatenate(times).astype(np.int32)),
            ],
            names=["doc_id", "text_key", "name", "kind", "start", "span", "times"],
        )


def _opened(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Position-rank pairs of the anchors in ``open``, an array of (start, span, copies)."""
    release()
    half = length // 2
    second = length - half
    for batch in batches:
        at, raw = buffers(batch.column("text"))
        cells = batch.column("open")
        ends = np.asarray(cells.offsets)
        parts = cells.values
        starts, spans, copies = (np.asarray(parts.field(k)) for k in ("start", "span", "copies"))
        rows, k1, k2, pos, num = [], [], [], [], []
        for i in range(len(batch)):
            for j in range(ends[i], ends[i + 1]):
                s, n = int(starts[j]), int(spans[j]) + 1
                g = names(raw[at[i] + s : at[i] + s + n + length - 1], half)
                rows.append(np.full(n, i))
                k1.append(g[:n])
                k2.append(g[second : second + n])
                pos.append(np.arange(s, s + n, dtype=np.int32))
                num.append(np.full(n, min(int(copies[j]), 2), np.int32))
            if rows and (sum(map(len, rows)) > 200_000 or i == len(batch) - 1):
                own = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(own), batch.column("text_key").take(own), pa.array(np.concatenate(k1).view(np.int64)), pa.array(np.concatenate(k2).view(np.int64)), pa.array(np.concatenate(pos)), pa.array(np.concatenate(num))],
                    names=["doc_id", "text_key", "k1", "k2", "start", "copies"],
                )
                rows, k1, k2, pos, num = [], [], [], [], []


def _runs(start: np.ndarray, span: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Merged byte runs [from, to) covered by the windows that start in [start, start + span]."""
    if not len(start):
        return start, start
    order = np.argsort(start, kind="stable")
    lo, hi = start[order], (start + span)[order] + length
    top = np.maximum.accumulate(hi)
    new = np.append(True, lo[1:] > top[:-1])
    first = np.flatnonzero(new)
    return lo[first], top[np.append(first[1:] - 1, len(top) - 1)]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of each stretch of a text as runs of neighbouring starts."""
    for batch in batches:
        cells = batch.column("some")
        ends = np.asarray(cells.offsets)
        starts, spans = (np.asarray(cells.values.field(k)).astype(np.int64) for k in ("start", "span"))
        rows, lo, hi = [], [], []
        for i in range(len(batch)):
            a, b = _runs(starts[ends[i] : ends[i + 1]], spans[ends[i] : ends[i + 1]], 1)
            rows.append(np.full(len(a), i))
            lo.append(a)
            hi.append(b - 1 - a)
        if rows:
            own = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(own), batch.column("text_key").take(own), pa.array(np.concatenate(lo).astype(np.int32)), pa.array(np.concatenate(hi).astype(np.int32))], names=["_id", "text_key", "start", "span"])


def _cut(batches: Iterator[pa.RecordBatch], length: int, keep_text: bool) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        at, raw = buffers(batch.column("text"))
        cells = batch.column("found")
        ends = np.asarray(cells.offsets)
        valid = np.asarray(cells.is_valid())
        starts, spans = (np.asarray(cells.values.field(k)).astype(np.int64) for k in ("start", "span"))
        size, removed, count, sha, texts = [], [], [], [], []
        for i in range(len(batch)):
            whole = raw[at[i] : at[i + 1]].tobytes()
            lo = hi = np.zeros(0, np.int64)
            if valid[i]:
                lo, hi = _runs(starts[ends[i] : ends[i + 1]], spans[ends[i] : ends[i + 1]], length)
            rest, last = [], 0
            for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                rest.append(whole[last:a])
                last = b
            left = b"".join([*rest, whole[last:]])
            size.append(len(whole))
            removed.append(len(whole) - len(left))
            count.append(len(lo))
            sha.append(hashlib.sha256(left).hexdigest())
            texts.append(left.decode("utf-8", "ignore") if keep_text else None)
        out = [batch.column(c) for c in batch.schema.names if c not in ("text", "text_key", "found")]
        kept = [c for c in batch.schema.names if c not in ("text", "text_key", "found")]
        out += [pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())]
        kept += ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if keep_text:
            out.append(pa.array(texts, pa.string()))
            kept.append("kept_text")
        yield pa.RecordBatch.from_arrays(out, names=kept)


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """Windows that repeat: ``doc_id, text_key, start, span``.

    ``docs`` has ``doc_id`` and ``text``; ``text_key`` is xxhash64 of the text.
    Each row stands for the windows of ``length`` bytes that start at ``start``
    to ``start + span``. Rows with one doc_id and one text share their results;
    documents are told apart by both. Nulls: a null text is empty; null ids are
    documents like others. Texts shorter than ``length`` bytes have no window.
    """
    if length < 8 or length % 2 or length // 2 + 1 > SLICE:
        raise ValueError("length must be even, at least 8")
    keyed = docs.select(F.coalesce("doc_id", F.lit(-1)).cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    long_enough = keyed.where(F.octet_length("text") >= length)
    anchors = materialize(
        long_enough.mapInArrow(lambda it: _anchors(it, length), "doc_id long, text_key long, name long, kind long, start int, span int, times int"),
        "anchors",
    )
    by_name = anchors.groupBy("name").agg(F.sum("times").alias("_n"), F.min("kind").alias("_lo"), F.max("kind").alias("_hi")).where("_n > 1")
    # a table of its own, so that a name with a large part of all anchors is split in the join
    repeated = materialize(by_name.select("name", (F.col("_lo") == F.col("_hi")).alias("agreed")), "names")
    left = materialize(anchors.join(repeated, "name"), "repeated-anchors")
    discard(anchors, repeated)
    agreed = left.where("agreed").select("doc_id", "text_key", "start", "span")
    differ = left.where("not agreed")
    kinds = materialize(differ.groupBy("name", "kind").agg(F.sum("times").alias("copies"), F.min(F.struct("doc_id", "text_key", "start", (F.floor((F.col("span") + 1) / F.col("times")) - 1).cast("int").alias("span"))).alias("one")), "kinds")
    copied = differ.join(kinds.where("copies > 1").select("name", "kind"), ["name", "kind"]).select("doc_id", "text_key", "start", "span")
    to_open = kinds.select("one.doc_id", "one.text_key", F.struct(F.col("one.start").alias("start"), F.col("one.span").alias("span"), F.least("copies", F.lit(2)).cast("int").alias("copies")).alias("cell"))
    cells = to_open.groupBy("doc_id", "text_key").agg(F.collect_list("cell").alias("open"))
    # rows that repeat both id and text open once, so that a copy isn't counted against itself twice
    opened = materialize(
        long_enough.join(cells, ["doc_id", "text_key"]).mapInArrow(lambda it: _opened(it, length), "doc_id long, text_key long, k1 long, k2 long, start int, copies int"),
        "opened",
    )
    pairs = materialize(opened.groupBy("k1", "k2").agg(F.sum("copies").alias("_n")).where("_n > 1").select("k1", "k2"), "repeated-pairs")
    ended = materialize(opened.where("copies = 1").join(pairs, ["k1", "k2"]).select("doc_id", "text_key", "start", F.lit(0).alias("span")), "ends")
    discard(opened, pairs)
    return agreed.unionByName(copied).unionByName(ended)


def remove_repeats(docs: DataFrame, length: int = 400, keep: tuple[str, ...] = ("doc_id",), keep_text: bool = False) -> DataFrame:
    """``keep`` columns, ``n_bytes, n_removed, n_spans, kept_sha256`` and, if asked, ``kept_text``.

    One row per row of ``docs``. ``kept_text`` drops bytes of a character that
    a cut left incomplete; the digest is of the kept bytes as they are.
    """
    window = F.struct("start", "span")
    some = repeated_spans(docs, length).groupBy(F.col("doc_id").alias("_id"), "text_key", F.floor(F.col("start") / STRETCH).alias("_stretch")).agg(F.collect_list(window).alias("some"))
    runs = some.select("_id", "text_key", "some").mapInArrow(_merged, "_id long, text_key long, start int, span int")
    found = runs.groupBy("_id", "text_key").agg(F.collect_list(window).alias("found"))
    body = docs.select(*keep, F.coalesce("doc_id", F.lit(-1)).cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    joined = body.join(found, ["_id", "text_key"], "left").select(*keep, "text", "text_key", "found")
    bounded_batches(docs.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.select(*keep).schema)
    schema = f"{fields}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string" if keep_text else "")
    return joined.mapInArrow(lambda it: _cut(it, length, keep_text), schema)
