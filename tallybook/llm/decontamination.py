"""Benchmark decontamination (operator 1): documents that hold a passage like a benchmark item.

Of each document the windows of an item's size (in words) are compared with the items of that size. A window
needs so many shingles in common with some item that most windows fall out by a running count of shingles
that any item has; this loses nothing. The rest get a SimHash of 128 bits of their shingles, weighted by how often they
occur, and meet the items whose fingerprints are within the radius, all of them: similarity 0.8 is about 19 bits apart,
unlike texts 64, so the radius of 40 loses about two true matches at exactly 0.8 in a million and lets hardly any
other pair through. The radius holds for different shingles only, so windows and items that repeat a
shingle skip the fingerprints. Candidates are then verified by the exact weighted similarity of shingles, the sum of
the lesser counts over the sum of the greater. A document that has fewer words than an item is one window as a whole.

The items go to the tasks in blocks of bounded size, each a pass over the documents; documents never move.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches, table, text_bytes

_WORD = re.compile(r"\w+")
_SHIFT = np.uint64(44)
_BASE = np.uint64(0x9E3779B97F4A7C15)
MATCHES = "array<struct<item_id: long, similarity: double, start: int, n_words: int>>"


def words_of(text: str) -> list[str]:
    """Letters and digits, in lower case: punctuation and white space do not hide a passage."""
    return _WORD.findall(text.lower())


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` word hashes."""
    n = len(words) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * _BASE + words[k : k + n]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def latest_repeats(hashes: np.ndarray) -> np.ndarray:
    """For each place the last start from which the text up to it repeats a hash, or -1."""
    order = np.argsort(hashes, kind="stable")
    out = np.full(len(hashes), -1)
    same = hashes[order[1:]] == hashes[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return np.maximum.accumulate(out)


WORDS = 2  # of 64 bits in a fingerprint
_CELLS = 1 << 20  # pairs that are compared at once


def _bits(hashes: np.ndarray) -> np.ndarray:
    more = (hashes ^ (hashes >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    both = np.column_stack((hashes, more ^ (more >> np.uint64(33))))
    return np.unpackbits(both.view(np.uint8).reshape(-1, 8 * WORDS), axis=1, bitorder="little")


def simhashes(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The SimHash of ``size`` shingles from each start, a row of ``WORDS`` numbers; a shingle counts as often as it occurs."""
    sums = np.concatenate((np.zeros((1, 64 * WORDS), np.int32), np.cumsum(_bits(hashes), axis=0, dtype=np.int32)))
    return np.packbits(2 * (sums[starts + size] - sums[starts]) > size, axis=1, bitorder="little").view(np.uint64)


class HammingIndex:
    """Fingerprints by their blocks, one more than the radius, so that two within it agree in a block; ``pairs`` finds all within it.

    At radii that make blocks of a few bits a pair would be met once for about every block, so there fingerprints are
    compared tile by tile instead, which finds the same. Either way a bounded number of pairs is held at once.
    """

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        self.blocks: list[tuple[int, np.uint64, np.uint64]] = []  # word, shift, mask
        for word in range(WORDS):
            edges = np.linspace(0, 64, (radius + 1 + word) // WORDS + 1).astype(int)
            self.blocks += [(word, np.uint64(s), np.uint64((1 << (e - s)) - 1)) for s, e in zip(edges.tolist(), edges[1:].tolist()) if e > s]
        met = sum(2.0 ** -int(mask).bit_count() for *_, mask in self.blocks)
        self.tables = []
        self.tiled = met > 0.25 or len(self.blocks) <= radius
        if not self.tiled:
            for word, shift, mask in self.blocks:
                keys = (prints[:, word] >> shift) & mask
                order = np.argsort(keys, kind="stable")
                self.tables.append((keys[order], order))

    def _near(self, prints: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        apart = sum(np.bitwise_count(prints[row, w] ^ self.prints[at, w]).astype(np.int16) for w in range(WORDS))
        return apart <= self.radius

    def pairs(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``prints`` and of the index that are within the radius, each pair once."""
        size, found = max(1, len(self.prints)), [np.empty(0, np.int64)]
        if self.tiled:
            step = max(1, _CELLS // size)
            for low in range(0, len(prints), step):
                part = prints[low : low + step]
                apart = sum(np.bitwise_count(part[:, None, w] ^ self.prints[None, :, w]).astype(np.int16) for w in range(WORDS))
                row, at = np.nonzero(apart <= self.radius)
                found.append((row + low) * size + at)
            return np.divmod(np.concatenate(found), size)
        for (word, shift, mask), (keys, order) in zip(self.blocks, self.tables):
            own = (prints[:, word] >> shift) & mask
            low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            ends = np.cumsum(high - low)
            start = 0
            while start < len(own):  # as many rows as bring a bounded number of pairs, one at least
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _CELLS, "right")))
                n = (high - low)[start:stop]
                row = np.repeat(np.arange(start, stop), n)
                at = order[np.repeat(low[start:stop] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                near = self._near(prints, row, at)
                found.append(row[near] * size + at[near])
                start = stop
        return np.divmod(np.unique(np.concatenate(found)), size)


@dataclass
class Items:
    """A block of benchmark items, by their number of words."""

    rows: list[tuple[int | None, str]]
    size: int
    similarity: float
    radius: int
    groups: dict[int, tuple[list[int], list[Counter], HammingIndex, np.ndarray, np.ndarray]] = field(default_factory=dict)

    def build(self) -> Items:
        by: dict[int, list[tuple[int, np.ndarray]]] = {}
        for k, (_, text) in enumerate(self.rows):
            if w := words_of(text):
                by.setdefault(len(w), []).append((k, self.hashes(w)))
        for n, items in by.items():
            runs = [shingles(h, min(self.size, n)) for _, h in items]
            prints = np.concatenate([simhashes(r, np.zeros(1, np.int64), len(r)) for r in runs])
            self.groups[n] = [k for k, _ in items], [Counter(r.tolist()) for r in runs], HammingIndex(prints, self.radius), np.unique(np.concatenate(runs)), np.array([len(np.unique(r)) < len(r) for r in runs])
        self.all = {z: np.unique(np.concatenate([g[3] for n, g in self.groups.items() if min(n, self.size) == z])) for z in {min(n, self.size) for n in self.groups}}
        self.maybe = {z: np.zeros(1 << 20, bool) for z in self.all}  # by the first bits of the hash: most runs end here
        for z, hashes in self.all.items():
            self.maybe[z][(hashes >> _SHIFT).astype(np.int64)] = True
        return self

    known: dict[str, int] = field(default_factory=dict)

    def hashes(self, words: list[str]) -> np.ndarray:
        known, digest = self.known, xxhash.xxh64_intdigest
        if len(known) > 400_000:
            known = self.known = dict(islice(known.items(), 200_000))  # common words come early
        got = list(map(known.get, words))
        if None in got:
            for k, x in enumerate(got):
                if x is None:
                    got[k] = known[words[k]] = digest(words[k], 5)
        return np.array(got, np.uint64)

    def _shorter(self, m: int, runs: dict[int, np.ndarray], counts: dict[int, np.ndarray]) -> dict[int, dict]:
        """The items of more than ``m`` words that the whole text is like."""
        out: dict[int, dict] = {}
        for z in counts:
            most = int((m - z + 1) / self.similarity + 1e-9) + z - 1  # words of the longest item in reach
            own = None
            for n, (which, wanted, *_) in self.groups.items():
                if min(n, self.size) != z or not m < n <= most:
                    continue
                total = m + n - 2 * (z - 1)  # shingles of both
                if counts[z][-1] < int(np.ceil(total * self.similarity / (1 + self.similarity) - 1e-9)):
                    continue
                own = own or Counter(runs[z].tolist())
                for k, want in zip(which, wanted):
                    common = sum((own & want).values())
                    value = common / (total - common)
                    if value >= self.similarity:
                        out[k] = {"item_id": self.rows[k][0], "similarity": value, "start": 0, "n_words": m}
        return out

    def matches(self, text: str) -> list[dict]:
        """The best window for each item that has one, in order of the items; of equal ones the first."""
        words = self.hashes(words_of(text))
        runs, counts, repeats = {}, {}, {}
        for z, any_item in self.all.items():
            runs[z] = shingles(words, z)
            if not len(runs[z]):
                continue
            hit = self.maybe[z][(runs[z] >> _SHIFT).astype(np.int64)]
            some = np.flatnonzero(hit)
            if len(some):
                at = np.minimum(np.searchsorted(any_item, runs[z][some]), len(any_item) - 1)
                hit[some] = any_item[at] == runs[z][some]
            if hit.any():
                counts[z] = np.concatenate(([0], np.cumsum(hit)))
        best: dict[int, dict] = self._shorter(len(words), runs, counts)
        for n, (which, wanted, index, _, repeated) in self.groups.items() if counts else ():
            z = min(n, self.size)
            if z not in counts or len(words) < n:
                continue
            size = n - z + 1  # shingles of a window; those in common are at least 2st/(1+t)
            least = int(np.ceil(2 * size * self.similarity / (1 + self.similarity) - 1e-9))
            starts = np.flatnonzero(counts[z][size:] - counts[z][:-size] >= least)
            if len(starts) and z not in repeats:
                repeats[z] = latest_repeats(runs[z])
            # windows of a stretch of the text at a time, so that sums of bits are held for that alone
            for some in np.split(starts, np.flatnonzero(np.diff(starts // 4096)) + 1) if len(starts) else ():
                low = int(some[0])
                prints = simhashes(runs[z][low : int(some[-1]) + size], some - low, size)
                found = set(zip(*(x.tolist() for x in index.pairs(prints))))
                again = repeats[z][some + size - 1] >= some
                for item in range(len(wanted)) if again.any() else np.flatnonzero(repeated).tolist():
                    rows = np.arange(len(some)) if repeated[item] else np.flatnonzero(again)
                    near = np.isin(runs[z][low : int(some[-1]) + size], np.fromiter(wanted[item], np.uint64, len(wanted[item])))
                    near = np.concatenate(([0], np.cumsum(near)))
                    at = some[rows] - low
                    found.update((row, item) for row in rows[near[at + size] - near[at] >= least].tolist())
                for row, item in sorted(found):
                    start = int(some[row])
                    common = sum((Counter(runs[z][start : start + size].tolist()) & wanted[item]).values())
                    value = common / (2 * size - common)
                    k = which[item]
                    if value >= self.similarity and (k not in best or value > best[k]["similarity"]):
                        best[k] = {"item_id": self.rows[k][0], "similarity": value, "start": start, "n_words": n}
        return [best[k] for k in sorted(best)]


def with_matches(docs: DataFrame, items: list[tuple[int | None, str]], size: int = 5, similarity: float = 0.8, radius: int = 40, text: str = "text") -> DataFrame:
    """``docs`` with all columns and ``matches``: the items of one block that a text holds, each with its best window."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns if c != "matches"]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(items)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("start", pa.int32()), ("n_words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Items(sent.value, size, similarity, radius).build()
        for batch in batches:
            got = [block.matches(x.decode()) if block.groups else [] for x in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, kind)], names=["row", "matches"])

    schema = rows.select("row", F.lit(None).cast(MATCHES).alias("matches")).schema
    return rows.mapInArrow(run, schema).select("row.*", "matches")


def blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of about ``block_bytes`` of text; ids are cast to long, null texts match nothing."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        yield sorted((tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def find(docs: DataFrame, benchmark: DataFrame, size: int = 5, similarity: float = 0.8, radius: int = 40, block_bytes: int = 16 << 20) -> DataFrame:
    """``doc_id, item_id, similarity, start, n_words``: a row for each document and item that it holds.

    ``start`` counts words (runs of letters and digits) from 0; ``n_words`` are the window's: the item's, or all of a
    shorter text. An item under ``size`` words is one shingle; an
    item without words matches nothing, and so do null and empty texts. Repeated items and documents are each
    reported. Empty tables give no rows. With a null ``doc_id`` or ``item_id``, the row has a null there.
    """
    out = None
    for items in blocks(benchmark, block_bytes):
        got = with_matches(docs.select("doc_id", "text"), items, size, similarity, radius).select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")
        out = got if out is None else out.unionByName(got)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 5, similarity: float = 0.8, radius: int = 40, block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all columns. Null and empty texts stay."""
    inner = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("all"), F.col("text").alias("text"))
    for items in blocks(benchmark, block_bytes):
        inner = with_matches(inner, items, size, similarity, radius).where(F.size("matches") == 0).drop("matches")
    return inner.select("all.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: ``doc_id, item_id, similarity, start, n_words`` for every document that holds a benchmark item."""
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
