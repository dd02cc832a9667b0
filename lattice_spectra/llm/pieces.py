"""SentencePiece encoding and decoding by a forward pass shared between words.

The model's text is cut into marked words: a run of ``▁`` and what follows up
to the next. No piece of the vocabulary crosses such a cut (checked when it is
loaded), so a text's ids are those of its marked words in a row, and a worker
needs each distinct word once. New words are sorted, which makes neighbours
share prefixes, and walked depth first as one trie: the forward state of a
prefix is kept on a stack and reused by all words that begin with it.

For a unigram model that state is Viterbi's: the best sum of scores of pieces
that make the prefix, and where its last piece begins; ties go to the longer
last piece. Sums are single-precision ones, as the library's, but begin anew at
each marked word.

A BPE model's scores order merges and don't add up, so there the recursion
keeps, for every prefix, the last piece of that prefix's own encoding in place
of a sum. A piece may follow a prefix's last piece if merging the two alone
gives them back; exactly one piece does for each prefix, and the sequence is the
encoding that merging by scores yields. Words with a run of marks, whose pieces
tie, are merged directly.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, held
from .packing import batched

MARK = "▁"
#: Words and pairs of pieces that a worker keeps.
CACHE = 300_000
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


# Fixed values of the public model format: kinds of models and of pieces, and numbers of fields.
UNIGRAM, BPE = 1, 2
_USER_DEFINED, _UNUSED = 4, 5
_PIECE, _TRAINER, _NORMALIZER, _PIECE_KIND, _MODEL_KIND, _SUFFIX, _CHARACTERS, _PREFIX, _TRIM, _ESCAPE = 1, 2, 3, 3, 3, 24, 2, 3, 4, 5
#: What an unknown character's score is below the least of all pieces.
_UNKNOWN_COST = 10.0


def _fields(blob: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a serialised message's fields."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = blob[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(blob):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            n = number() if key & 7 == 2 else 4 if key & 7 == 5 else 8
            yield key >> 3, blob[at : at + n]
            at += n


def model_kind(blob: bytes) -> int:
    """``UNIGRAM`` or ``BPE``; ValueError for a model whose texts are normalised or cut in ways that aren't built here."""
    trainer, normalizer = {}, {}
    for field, value in _fields(blob):
        if field == _PIECE and dict(_fields(value)).get(_PIECE_KIND, 1) in (_USER_DEFINED, _UNUSED):
            raise ValueError("the vocabulary has user-defined or unused pieces")
        if field == _TRAINER:
            trainer = dict(_fields(value))
        elif field == _NORMALIZER:
            normalizer = dict(_fields(value))
    kind = trainer.get(_MODEL_KIND, UNIGRAM)
    if kind not in (UNIGRAM, BPE):
        raise ValueError("the model is neither a unigram nor a BPE one")
    if normalizer.get(_CHARACTERS) or normalizer.get(_TRIM, 1) or not normalizer.get(_PREFIX, 1) or not normalizer.get(_ESCAPE, 1) or trainer.get(_SUFFIX):
        raise ValueError("the model normalises texts, or marks words in another way than by a space before them")
    return kind


def _single(x: float) -> float:
    """Rounded to single precision."""
    return struct.unpack("f", struct.pack("f", x))[0]


class PieceCodec:
    """Encodes and decodes texts with a unigram or BPE SentencePiece model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            blob = f.read()
        self.kind = model_kind(blob)
        model = sentencepiece.SentencePieceProcessor(model_proto=blob)
        n = model.get_piece_size()
        special = [i for i in range(n) if model.is_control(i) or model.is_unknown(i)]
        self.byte = [0] * 256
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.raw: list[bytes] = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif i in special:
                self.raw.append(b"")
            else:
                self.ids[piece] = i
                self.score[piece] = model.get_score(i)
                self.raw.append(piece.encode())
        if not any(self.byte):
            raise ValueError("the vocabulary has no pieces for bytes")
        self.unknown = _single(min(self.score.values(), default=0.0) - _UNKNOWN_COST)
        self.longest = max(map(len, self.ids), default=1)
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("the vocabulary has pieces over more than one marked word")
        #: Ends of pieces; true for whole pieces.
        self.ends: dict[str, bool] = {}
        for p in self.ids:
            for i in range(1, len(p)):
                self.ends.setdefault(p[i:], False)
            self.ends[p] = True
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, word: str) -> list[str]:
        """Pieces by merging: the best-scored pair, the leftmost of equals, again and again."""
        parts, score = list(word), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _follows(self, last: str, piece: str) -> bool:
        key = (last, piece)
        known = self.pairs.get(key)
        if known is None:
            known = self.pairs[key] = self.merged(last + piece) == ([last, piece] if last else [piece])
        return known

    def _runs_merged(self, word: str) -> list[str]:
        """As ``merged``, for words of any length with runs of marks: only the run and its next pieces tie."""
        if len(word) <= 400:
            return self.merged(word)
        import heapq

        text: list[str | None] = list(word)
        left, right = list(range(-1, len(text) - 1)), [*range(1, len(text)), -1]
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            s = self.score.get(text[a] + text[b])
            if s is not None:
                heapq.heappush(heap, (-s, a, b, len(text[a]) + len(text[b])))

        for i in range(len(text) - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, n = heapq.heappop(heap)
            if text[a] is None or text[b] is None or right[a] != b or len(text[a]) + len(text[b]) != n:
                continue
            text[a], text[b] = text[a] + text[b], None
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
                offer(a, right[b])
            if left[a] >= 0:
                offer(left[a], a)
        return [t for t in text if t is not None]

    def _ids(self, parts: list[str]) -> bytes:
        out = array("I")
        for p in parts:
            i = self.ids.get(p)
            if i is None:
                out.extend(self.byte[b] for b in p.encode())
            else:
                out.append(i)
        return out.tobytes()

    def _learn_by_sums(self, new: set[str]) -> None:
        """Viterbi over the words' trie; sums[i] and stack[i] are those of the prefix of i characters."""
        known = self.score.get
        before, stack, sums = "", [0], [0.0]
        for word in sorted(new):
            shared = 0
            for x, y in zip(before, word):  # noqa: B905
                if x != y:
                    break
                shared += 1
            del stack[shared + 1 :], sums[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                best, at = None, i - 1
                for j in range(max(0, i - self.longest), i):
                    score = known(word[j:i])
                    if score is None:
                        if j < i - 1:
                            continue
                        score = self.unknown
                    total = _single(sums[j] + score)
                    if best is None or total > best:
                        best, at = total, j
                stack.append(at)
                sums.append(best)
            before = word
            parts, i = [], len(word)
            while i:
                parts.append(word[stack[i] : i])
                i = stack[i]
            self.words[word] = self._ids(parts[::-1])

    def learn(self, new: set[str]) -> None:
        """Encodes words that aren't known, sharing the states of common prefixes."""
        if self.kind == UNIGRAM:
            self._learn_by_sums(new)
            return
        if len(self.pairs) > CACHE:
            self.pairs.clear()
        ends, pairs, follows = self.ends.get, self.pairs.get, self._follows
        before, stack = "", [0]  # stack[i]: where the last piece of the prefix of i characters begins
        for word in sorted(new):
            if word.startswith(MARK * 2):
                self.words[word] = self._ids(self._runs_merged(word))
                continue
            shared = 0
            for x, y in zip(before, word):  # noqa: B905
                if x != y:
                    break
                shared += 1
            del stack[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                for j in range(i - 1, -1, -1):
                    piece = word[j:i]
                    whole = ends(piece)
                    if whole or j == i - 1:
                        last = word[stack[j] : j]
                        good = pairs((last, piece))
                        if good is None:
                            good = follows(last, piece)
                        if good:
                            stack.append(j)
                            break
                    if whole is None:
                        raise AssertionError("no piece ends this prefix")
            before = word
            parts, i = [], len(word)
            while i:
                parts.append(word[stack[i] : i])
                i = stack[i]
            parts.reverse()
            self.words[word] = self._ids(parts)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit words."""
        if len(self.words) > CACHE:
            self.words, self.older = {}, self.words
        split = []
        for t in texts:
            t = t.replace(" ", MARK)
            if not t:
                split.append([])
            elif MARK * 2 in t or t[0] == MARK or t[-1] == MARK:
                split.append(_WORD.findall(MARK + t))
            else:
                split.append((MARK + t.replace(MARK, "\0" + MARK)).split("\0") if "\0" not in t else _WORD.findall(MARK + t))
        new = set().union(*split).difference(self.words)
        if new:
            again = new.intersection(self.older)
            self.words.update(zip(again, map(self.older.__getitem__, again), strict=True))
            self.learn(new.difference(again))
        get = self.words.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def decode(self, blob: bytes) -> str:
        """Text of ids as ``encode`` returns them; bytes that aren't UTF-8 become U+FFFD."""
        ids = array("I", blob)
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def codec(path: str) -> PieceCodec:
    """The worker's codec of a model file."""
    return held(("pieces", path), lambda: PieceCodec(path))


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for batch in batches:
        ids = [array("i", blob) for group in batched(batch.column("text").to_pylist(), 1 << 22) for blob in own.encode(group)]
        yield pa.RecordBatch.from_arrays([*(c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "text"), pa.array(ids, pa.list_(pa.int32()))], names=[*(n for n in batch.schema.names if n != "text"), "ids"])


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for batch in batches:
        texts = [own.decode(array("I", ids).tobytes()) for ids in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "ids"), pa.array(texts, pa.string())], names=[*(n for n in batch.schema.names if n != "ids"), "text"])


def _digest(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for batch in batches:
        n, crc, decoded, same = [], [], [], []
        for group in batched(batch.column("text").to_pylist(), 1 << 22):
            for text, blob in zip(group, own.encode(group), strict=True):
                back = own.decode(blob)
                n.append(len(blob) // 4)
                crc.append(zlib.crc32(blob))
                decoded.append(zlib.crc32(back.encode()))
                same.append(back == text.replace(MARK, " "))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(decoded, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_ids", "ids_crc32", "decoded_crc32", "round_trip"])


def encode(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id`` and ``ids array<int>`` of every text; a null or empty text has no ids."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(lambda it: _encode(it, model), f"doc_id {kind}, ids array<int>")


def decode(ids: DataFrame, model: str) -> DataFrame:
    """``doc_id`` and ``text`` of every ``ids``; null ids give the empty text. Control ids give nothing."""
    ids = ids.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    kind = ids.schema["doc_id"].dataType.simpleString()
    return ids.mapInArrow(lambda it: _decode(it, model), f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, n_ids, ids_crc32, decoded_crc32, round_trip``: encoding and decoding in one pass.

    ``ids_crc32`` is of the ids as little-endian 32-bit words, ``decoded_crc32``
    of the decoded text in UTF-8; ``round_trip`` says whether that is the text,
    where a literal ``▁`` counts as a space, as it does in the model's format.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.mapInArrow(lambda it: _digest(it, model), "doc_id long, n_ids long, ids_crc32 long, decoded_crc32 long, round_trip boolean")
