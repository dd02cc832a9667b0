"""Packing of tokenised documents into fixed windows, best fit decreasing.

Documents are tokenised where they are read; ids never move. A document longer
than a window is first cut into full windows and one rest. Best fit decreasing
looks at lengths only, and there are at most ``window`` of those: the driver
gets one count for each length, whatever the corpus, and places equal lengths
together. Windows with equal remaining room are kept as ranges of window
numbers, and a segment tree over remaining capacity finds the tightest. The
result, some runs for each length, is joined back to the pieces by length and
rank, so the packing equals that of one sequential pass over all pieces.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, held, materialize, ranked

#: Words whose ids a worker keeps, twice: those of late and those before.
CACHE = 300_000
#: Characters of a text that are split into words at a time, up to the next white space.
PART = 1 << 21
#: Runs up to which the placement is broadcast.
RUNS = 100_000
_SPACE = re.compile(r"\s")
_ODD = re.compile("[\x1c-\x1f]")
#: Between a Latin letter and one of these marks the tokenizer always begins a new word.
_MARK = re.compile("(?<=[A-Za-zÀ-ÖØ-öø-ÿ])[.,%&$#*!?:;-]")
_WIDE = re.compile("[^\x00-\xff]")
# How the public word vocabulary's tokenizer normalises texts and cuts them into words.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_CUT = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False},
]


class OpenWindows:
    """Segment tree over remaining capacity; a leaf holds ranges of equal windows."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.full = bytearray(2 * self.leaves)
        self.ranges: dict[int, list[tuple[int, int]]] = {}

    def put(self, room: int, first: int, n: int) -> None:
        if room and n:
            self.ranges.setdefault(room, []).append((first, n))
            i = room + self.leaves
            while i and not self.full[i]:
                self.full[i] = 1
                i >>= 1

    def take(self, length: int) -> tuple[int, int, int] | None:
        """(room, first window, windows) of the tightest range with room for ``length``."""
        i = length + self.leaves
        if not self.full[i]:
            while i > 1 and (i & 1 or not self.full[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.full[2 * i] else 2 * i + 1
        room = i - self.leaves
        first, n = self.ranges[room].pop()
        if not self.ranges[room]:
            while i and not (i < self.leaves and (self.full[2 * i] or self.full[2 * i + 1])):
                self.full[i] = 0
                i >>= 1
        return room, first, n


def best_fit_decreasing(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, past rank, pieces a window, first window, offset).

    Equals placing the pieces one by one in order of falling length, each into
    the tightest window that has room: after a piece, its window is tighter
    than all others that would do, so it takes pieces of that length until full.
    """
    windows, runs, opened = OpenWindows(window), [], 0
    for length in sorted(counts, reverse=True):
        if not 0 < length <= window:
            raise ValueError("lengths must be from 1 to the window")
        rank, left = 0, counts[length]
        while left:
            room, first, n = windows.take(length) or (window, opened, -(-left // (window // length)))
            opened = max(opened, first + n)
            each = room // length
            whole = min(n, left // each)
            if whole:
                runs.append((length, rank, rank + whole * each, each, first, window - room))
                windows.put(room - each * length, first, whole)
                rank, left = rank + whole * each, left - whole * each
                first, n = first + whole, n - whole
            if n and left and left < each:
                runs.append((length, rank, rank + left, left, first, window - room))
                windows.put(room - left * length, first, 1)
                first, n, left = first + 1, n - 1, 0
            windows.put(room, first, n)
    return runs


class WordIds:
    """Ids of a text as little-endian 32-bit words; the tokenizer sees a word once.

    The tokenizer's words never cross white space, so a text's ids are those of
    its white-space words in a row. Python's white space is the tokenizer's but
    for four control characters; texts with those are encoded whole. To have
    fewer distinct words, marks are set apart from the letters before them and
    texts of the first 256 characters, where it goes letter by letter, are put
    in lower case, which the tokenizer does as well; texts that may hold a
    special token are left as they are. All this holds for tokenizers that
    normalise and cut texts as ``_NORMAL`` and ``_CUT`` say; any other gets whole
    texts.
    """

    def __init__(self, path: str, cache: int = CACHE):
        self.cache = cache
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        own = [{k: v for k, v in x.items() if k in ("type", "pattern", "behavior", "invert", "add_prefix_space", "use_regex")} for x in ((made["pre_tokenizer"] or {}).get("pretokenizers") or [])]
        self.by_words = ((made["normalizer"] or {}).get("normalizers"), own, made["model"].get("end_of_word_suffix")) == (_NORMAL, _CUT, "</w>")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def parts(self, text: str) -> Iterator[list[str]]:
        if "<|" not in text:
            text = _MARK.sub(r" \g<0>", text)
            if text.isascii() or not _WIDE.search(text):
                text = text.lower()
        start = 0
        while len(text) - start > PART:
            cut = _SPACE.search(text, start + PART)
            if cut is None:
                break
            yield text[start : cut.start()].split()
            start = cut.start()
        yield (text[start:] if start else text).split()

    def learn(self, new: set[str]) -> None:
        """Asks the tokenizer for the ids of words that aren't known.

        Words of plain letters go in a row as one text, which is cheaper; the
        mark of a word's end in the vocabulary tells where their ids part.
        """
        plain = [w for w in new if w.isalpha() and (w.isascii() or not _WIDE.search(w))]
        rest = list(new.difference(plain))
        for i in range(0, len(plain), 4096):
            words = plain[i : i + 4096]
            ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, np.uint32)
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stops) != len(words):
                rest += words
                continue
            blob, stops = ids.tobytes(), stops.tolist()
            self.known.update(zip(words, [blob[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)], strict=True))
        if rest:
            self.known.update(zip(rest, (array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(rest, add_special_tokens=False)), strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        if len(self.known) > self.cache:
            self.known, self.older = {}, self.known
        split = [None if _ODD.search(t) else list(self.parts(t)) for t in texts]
        new = set().union(*[words for parts in split if parts for words in parts]).difference(self.known)
        if new:
            again = new.intersection(self.older)
            self.known.update(zip(again, map(self.older.__getitem__, again), strict=True))
            self.learn(new.difference(again))
        get = self.known.__getitem__
        return [array("I", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() if parts is None else b"".join([b"".join(map(get, words)) for words in parts]) for t, parts in zip(texts, split, strict=True)]


def batched(texts: list[str], size: int = 1 << 20) -> Iterator[list[str]]:
    """The texts in order, some ``size`` characters at a time."""
    group, n = [], 0
    for t in texts:
        group.append(t)
        n += len(t)
        if n >= size:
            yield group
            group, n = [], 0
    if group:
        yield group


def _pieces(batches: Iterator[pa.RecordBatch], path: str, window: int, end_id: int, with_ids: bool, cache: int) -> Iterator[pa.RecordBatch]:
    encode, end = held(("words", path, cache), lambda: WordIds(path, cache)), array("I", [end_id]).tobytes()
    for batch in batches:
        rows, start, length, crc, total, ids = [], [], [], [], [], []
        i = 0
        for group in batched(batch.column("text").to_pylist()):
            for blob in encode(group):
                blob += end
                n = len(blob) // 4
                for s in range(0, n, window):
                    part = blob[4 * s : 4 * (s + window)]
                    rows.append(i)
                    start.append(s)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(n)
                    if with_ids:
                        ids.append(array("I", part).tolist())
                i += 1
        out = [batch.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        if with_ids:
            out.append(pa.array(ids, pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(out, names=names)


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, with_ids: bool = False, cache: int = CACHE) -> DataFrame:
    """Pieces of all documents with their places in windows.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and,
    if asked, the ``ids`` themselves. A null text is empty and gives the end id
    alone; rows with one doc_id are documents of their own; other columns are
    ignored. Sequences are numbered from 0; those of full windows come first.
    ``cache`` words' ids are kept by a worker, twice, which is memory for speed.
    """
    if window < 1:
        raise ValueError("a window holds one token at least")
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "")
    pieces = materialize(docs.mapInArrow(lambda it: _pieces(it, tokenizer, window, end_id, with_ids, cache), schema), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most one row for each length
    runs = best_fit_decreasing(counts, window)
    placed = docs.sparkSession.createDataFrame(runs, "_length long, _lo long, _hi long, _each long, _first long, _offset long")
    if len(runs) <= RUNS:
        placed = F.broadcast(placed)
    spread = max(8, sum(counts.values()) // 50_000)
    at = ranked(pieces, ["length"], ["doc_id", "start", "ids_crc32"], spread)
    joined = at.join(placed, (F.col("length") == F.col("_length")) & (F.col("rank") >= F.col("_lo")) & (F.col("rank") < F.col("_hi")))
    nth = F.col("rank") - F.col("_lo")
    return joined.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("_first") + F.floor(nth / F.col("_each")).cast("long")).alias("sequence_id"),
        (F.col("_offset") + (nth % F.col("_each")) * F.col("length")).alias("offset"),
        *(["ids"] if with_ids else []),
    )
