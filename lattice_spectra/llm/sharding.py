"""Shards from indivisible groups: best fit decreasing over a balanced tree.

Group sizes are all that placement needs, so the driver gets a count for each
size class: sizes below 65,536 are exact, larger ones are rounded up by at most
a 1,024th, which bounds the classes (some 50,000 up to a petabyte) for any
corpus. Open shards are kept in a balanced tree (a treap) by remaining capacity
and number; each class enters the tightest shard that has room, again and
again. The runs are joined back to the groups by class and rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, ranked
from .packing import RUNS


class Treap:
    """Ordered keys with logarithmic insertion, removal and successor; priorities come from a hash of the key."""

    def __init__(self):
        self.root = None  # [key, priority, left, right]

    @staticmethod
    def _priority(key: tuple[int, int]) -> int:
        x = (key[0] * 0x9E3779B97F4A7C15 ^ key[1] * 0xC2B2AE3D27D4EB4F) & (2**64 - 1)
        x ^= x >> 31
        return x * 0xD6E8FEB86659FD93 & (2**64 - 1)

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = self._split(node[3], key)
            return node, right
        left, node[2] = self._split(node[2], key)
        return left, node

    def _merge(self, a, b):
        if a is None or b is None:
            return b if a is None else a
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def add(self, key: tuple[int, int]) -> None:
        left, right = self._split(self.root, key)
        self.root = self._merge(self._merge(left, [key, self._priority(key), None, None]), right)

    def pop_first_from(self, key: tuple[int, int]) -> tuple[int, int] | None:
        """Takes out the least key that isn't less than ``key``."""
        left, right = self._split(self.root, key)
        if right is None:
            self.root = left
            return None
        node = right
        while node[2] is not None:
            node = node[2]
        found = node[0]
        _, rest = self._split(right, (found[0], found[1] + 1))
        self.root = self._merge(left, rest)
        return found


def best_fit_decreasing(counts: dict[int, int], capacity: int, most: int | None = None, first: int = 0) -> list[tuple[int, int, int, int]] | None:
    """Runs (size, first rank, past rank, shard); None if more than ``most`` shards would be needed."""
    tree, runs, opened = Treap(), [], 0
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            got = tree.pop_first_from((size, -1))
            if got is None:
                if opened == most or size > capacity:
                    return None
                got, opened = (capacity, first + opened), opened + 1
            room, shard = got
            n = min(left, room // size)
            runs.append((size, rank, rank + n, shard))
            rank, left = rank + n, left - n
            if room - n * size:
                tree.add((room - n * size, shard))
    return runs


def near_equal(counts: dict[int, int], shards: int) -> list[tuple[int, int, int, int]]:
    """Runs that fill ``shards`` shards as evenly as best fit decreasing can.

    A group of at least the mean of what is left gets a shard of its own. For
    the rest the capacity is the mean, raised by growing steps until all fits.
    """
    counts, total, runs, used = dict(counts), sum(s * n for s, n in counts.items()), [], 0
    given: dict[int, int] = {}
    while counts and used < shards - 1 and (size := max(counts)) * (shards - used) >= total and total > size:
        runs.append((size, given.get(size, 0), given.get(size, 0) + 1, used))
        given[size] = given.get(size, 0) + 1
        counts[size] -= 1
        if not counts[size]:
            del counts[size]
        total, used = total - size, used + 1
    if not counts:
        return runs
    least, step = max(-(-total // (shards - used)), max(counts)), 0
    while (rest := best_fit_decreasing(counts, least + step, shards - used, used)) is None:
        step = 2 * step if step else max(1, least >> 22)
    return runs + [(s, a + given.get(s, 0), b + given.get(s, 0), shard) for s, a, b, shard in rest]


def size_class(size: Column) -> Column:
    """The size itself below 65,536, else rounded up to eleven significant bits."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(size.cast("double"))) - 10)
    return F.when(size < 65536, size).otherwise((F.ceil(size / step) * step).cast("long")).cast("long")


def place_groups(groups: DataFrame, key: list[str], size: str, shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """``groups`` with ``shard int``; with ``shards`` near-equal ones, with ``capacity`` as few of that capacity as found.

    ``key`` tells groups apart; ``size`` is a positive long. A group larger than
    ``capacity`` raises ValueError; one that fills a shard alone fits. Sizes of
    65,536 and more count as their class, up to a 1,024th more than they are, so
    that shards of a fixed capacity may be that much emptier than could be. The
    result reads a scratch table, which ``discard`` takes with it.
    """
    by = size_class(F.col(size))
    if capacity is not None:
        by = F.when(F.col(size) <= capacity, F.least(by, F.lit(capacity))).otherwise(by).cast("long")
    groups = materialize(groups.withColumn("_class", by), "groups")
    counts = {r["_class"]: r["n"] for r in groups.groupBy("_class").agg(F.count(F.lit(1)).alias("n")).collect()}  # bounded by the number of classes
    runs = near_equal(counts, shards) if capacity is None else best_fit_decreasing(counts, capacity)
    if runs is None:
        raise ValueError("a group is larger than the capacity")
    placed = groups.sparkSession.createDataFrame(runs, "_size long, _lo long, _hi long, shard int")
    if len(runs) <= RUNS:
        placed = F.broadcast(placed)
    at = ranked(groups, ["_class"], key, max(8, sum(counts.values()) // 50_000))
    found = at.join(placed, (F.col("_class") == F.col("_size")) & (F.col("rank") >= F.col("_lo")) & (F.col("rank") < F.col("_hi"))).select(*groups.columns[:-1], "shard")
    found._scratch = groups._scratch
    return found


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: equal texts stay together, sizes near equal.

    ``size`` is the text's UTF-8 bytes plus 1 (null: 1, as the empty text, with
    which it forms one group). Texts are told apart by 64-bit hash, crc32 and
    size. A group larger than a fair share has a shard of its own. ``slot``
    numbers a shard's rows from 0 without gaps; rows equal in id and text may
    swap slots. Null ids are rows like others.
    """
    text = F.coalesce("text", F.lit(""))
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_hash")), "sizes")
    key = ["_hash", "text_crc32", "size"]
    groups = rows.groupBy(*key).agg((F.count(F.lit(1)) * F.col("size")).alias("_bytes"))
    placed = place_groups(groups, key, "_bytes", shards)
    sharded = materialize(rows.join(placed.select(*key, "shard"), key).select("doc_id", "size", "text_crc32", "_hash", "shard"), "sharded")
    discard(rows, placed)
    n = sharded.count()
    return ranked(sharded, ["shard"], ["doc_id", "_hash"], max(8, n // (50_000 * shards))).select("doc_id", "size", "text_crc32", "shard", F.col("rank").alias("slot"))
