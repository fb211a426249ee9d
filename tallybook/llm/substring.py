"""Substring deduplication (operator 7): repeated windows by content-defined blocks of the corpus.

A window is ``window`` consecutive words of one document; every word goes that is covered by a window whose
words also start anywhere else. The corpus is its own reference. A relative Lempel-Ziv parse, which extends greedy factors
against every reference block, is not what runs here: it grows with the square of the corpus, or needs all of it in each
task, and its factors still have to be checked window by window, since a window that repeats may lie across factors. The
index alone answers that. The corpus is cut into blocks by content: of the
8-word grams in a window the least hash is the window's anchor, so equal windows have equal anchors at equal
places, and consecutive windows with the same anchor form a block, the unit that is indexed:

* of a block that the index holds twice or more all windows repeat;
* where an anchor is shared but the blocks around it differ, a common stretch ends inside the block. Such boundaries
  are checked window by window, with 128-bit hashes; of equal blocks one is enough for that;
* a block with an anchor of its own holds no repeated window.

So a document meets just the blocks that can match it, and not every block of the corpus in turn. What is
dealt out is one row per block (about a fourteenth of the words) and the few windows at the boundaries.
Anchors that a small sample finds often are dealt out by more than the anchor; the sample steers only where
rows go, the result is the same without it.

Documents are known by ``(doc_id, hash of the text)``, so ids may be null or repeat; wholly equal rows count as
occurrences of their own and get the same result. Null and empty texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WHITE, small_batches, table, text_bytes, written

GRAM = 8
_PLACE = np.uint64(28)
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_KNOWN_WORDS = 400_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Parser:
    """Hashes of word ranges of one document after another."""

    def __init__(self, window: int):
        if window < GRAM:
            raise ValueError(f"a window has {GRAM} words at least")
        self.window, self.known = window, {}
        self.powers = [np.ones(1, np.uint64)] * 4

    def _grow(self, n: int) -> None:
        if len(self.powers[0]) <= n:
            size = 1 << int(n).bit_length()
            for k, base in enumerate(_BASES):
                for at, step in ((k, base), (k + 2, np.uint64(pow(int(base), -1, 1 << 64)))):
                    out = np.full(size, step, np.uint64)
                    out[0] = 1
                    self.powers[at] = np.multiply.accumulate(out)

    def read(self, text: bytes) -> list[bytes]:
        """The document's words; sums of their hashes are kept for the ranges."""
        words = text.split()
        known, digest = self.known, xxhash.xxh64_intdigest
        if len(known) > _KNOWN_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = digest(w, 7)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        self._grow(len(words) + 1)
        self.n = len(words)
        if self.n >= 1 << int(_PLACE):
            raise ValueError(f"a text of {self.n} words: over {(1 << int(_PLACE)) - 1} an anchor's place has no room")
        self.sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * self.powers[k][: self.n]))) for k, x in enumerate((h, _mix(h)))]
        return words

    def ranges(self, k: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[k][end] - self.sums[k][start]) * self.powers[k + 2][start])

    def blocks(self) -> tuple[np.ndarray, ...]:
        """Of each block: its first window, one past its last, its anchor's hash, its own hash."""
        windows = self.n - self.window + 1
        if windows < 1:
            empty = np.empty(0, np.int64)
            return empty, empty, empty.view(np.uint64), empty.view(np.uint64)
        at = np.arange(self.n - GRAM + 1)
        grams = self.ranges(0, at, at + GRAM)
        least = (grams >> _PLACE << _PLACE) | at.astype(np.uint64)
        width, span = 1, self.window - GRAM + 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: windows], least[span - width : span - width + windows])
        anchor = (least & np.uint64((1 << 28) - 1)).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(np.diff(anchor)) + 1))
        last = np.concatenate((first[1:], [windows]))
        anchor = anchor[first]
        shape = ((anchor - first) * self.window + (last - first)).astype(np.uint64)
        return first, last, grams[anchor], _mix(self.ranges(1, first, last - 1 + self.window) + shape)


def _index_rows(docs: DataFrame, window: int) -> DataFrame:
    """A row for each block of each document: anchor ``a``, block ``b``, and whose it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(window)
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for row, text in enumerate(text_bytes(batch.column(2))):
                parser.read(text)
                _, _, anchor, block = parser.blocks()
                for x, y in zip(out, (anchor, block, np.full(len(anchor), row), np.arange(len(anchor)))):
                    x.append(y)
            anchor, block, row, nth = map(np.concatenate, out)
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(block.view(np.int64)), batch.column(0).take(row), batch.column(1).take(row), pa.array(nth.astype(np.int32))],
                names=["a", "b", "_d", "_h", "nth"],
            )

    kind = docs.schema["_d"].dataType.simpleString()
    return docs.select("_d", "_h", "_text").mapInArrow(run, f"a long, b long, _d {kind}, _h long, nth int")


def _often(rows: DataFrame) -> tuple[list[int], list[tuple[int, int]]]:
    """Anchors, and anchors with blocks, that hold over a thousandth of the sampled rows: a thousand each at most."""
    counts = written(rows.groupBy("a", "b").count(), "often")
    n = counts.agg(F.sum("count")).first()[0] or 0
    least = max(20, n // 1000)
    anchors = counts.groupBy("a").agg(F.sum("count").alias("n")).where(F.col("n") > least).select("a").collect()
    both = counts.where(F.col("count") > least).select("a", "b").collect()
    return [r[0] for r in anchors], [tuple(r) for r in both]


def _flagged(rows: DataFrame, window: int, often: tuple[list[int], list[tuple[int, int]]]) -> DataFrame:
    """Rows of the index whose block repeats (flag 1) or whose windows must be looked at (flag 2), or both.

    Rows of an anchor come sorted by block; one row is held at a time.
    """
    anchors, both = often
    place = F.col("a")
    if both:
        pair = F.struct("a", "b").isin([F.struct(F.lit(x).alias("a"), F.lit(y).alias("b")) for x, y in both])
        place = F.when(pair, F.xxhash64("a", "b", F.pmod(F.xxhash64("_d", "_h"), F.lit(64)))).otherwise(place)
    if anchors:
        mixed = F.xxhash64("a", "b")
        place = F.when(F.col("a").isin(anchors) & ~(pair if both else F.lit(False)), mixed).otherwise(place)
    hot, hot_pairs = set(anchors), set(both)
    names = ["_d", "_h", "nth", "flag"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first row of the open run waits until it is known whether the run and its anchor go on."""
        last: tuple[int, int] | None = None
        first, size, before = (), 0, False  # before: the anchor had another block before
        out: list[tuple] = []

        def close(differs: bool) -> None:
            if last is None:
                return
            differs = differs or before or last[0] in hot
            if last in hot_pairs or size > 1:
                out.append((*first, 3 if differs or last in hot_pairs else 1))
            elif differs:
                out.append((*first, 2))

        def made(schema: pa.Schema) -> pa.RecordBatch:
            kinds = [schema.field(2).type, pa.int64(), pa.int32(), pa.int32()]
            got = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names)
            out.clear()
            return got

        for batch in batches:
            anchor = batch.column(0).to_numpy()
            if not len(anchor):
                continue
            step = np.concatenate(([True], anchor[1:] != anchor[:-1]))
            lone = step & np.concatenate((step[1:], [True]))  # no neighbour has the anchor
            lone[[0, -1]] = False
            if hot:
                lone &= ~np.isin(anchor, list(hot))
            few = batch.take(pa.array(np.flatnonzero(~lone)))
            for a, b, d, h, nth in zip(*(c.to_pylist() for c in few.columns)):
                if last == (a, b):
                    size += 1
                    out.append((d, h, nth, 1))
                    continue
                same = last is not None and last[0] == a
                close(same)
                last, first, size, before = (a, b), (d, h, nth), 1, same
            if out:
                yield made(batch.schema)
        close(False)
        if out:
            yield made(batch.schema)

    kind = rows.schema["_d"].dataType.simpleString()
    dealt = rows.withColumn("_p", place).repartition("_p").drop("_p").sortWithinPartitions("a", "b")
    return dealt.mapInArrow(run, f"_d {kind}, _h long, nth int, flag int")


def _boundary_windows(docs: DataFrame, window: int) -> DataFrame:
    """The windows of the blocks ``looks`` of each document, with two hashes of 64 bits; ``known``: it repeats anyway."""
    names = ["_d", "_h", "at", "w1", "w2", "known"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(window)
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(5)]
            looks = batch.column(3).to_pylist()
            for row, text in enumerate(text_bytes(batch.column(2))):
                parser.read(text)
                first, last, _, _ = parser.blocks()
                nth, flag = np.array([(x["nth"], x["flag"]) for x in looks[row]], np.int64).T
                size = (last - first)[nth]
                at = np.repeat(first[nth] - np.cumsum(size) + size, size) + np.arange(size.sum())
                known = np.repeat(flag == 3, size)
                for x, y in zip(out, (np.full(len(at), row), at, parser.ranges(0, at, at + window), parser.ranges(1, at, at + window), known)):
                    x.append(y)
            if not out[0]:
                continue
            row, at, w1, w2, known = map(np.concatenate, out)
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(1).take(row), pa.array(at.astype(np.int32)), pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(known)],
                names=names,
            )

    kind = docs.schema["_d"].dataType.simpleString()
    return docs.select("_d", "_h", "_text", "looks").mapInArrow(run, f"_d {kind}, _h long, at int, w1 long, w2 long, known boolean")


def _same_document(a: DataFrame, b: DataFrame):
    return a["_d"].eqNullSafe(b["_d"]) & (a["_h"] == b["_h"])


def repeated_windows(docs: DataFrame, window: int = 35, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``_d, _h, blocks, windows``: of each document that has any, its repeated blocks by number and single windows by place."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(f"`{doc_id}`").alias("_d"), F.xxhash64(f"`{text}`").alias("_h"), F.col(f"`{text}`").alias("_text"))
    often = _often(_index_rows(docs.sample(0.01, seed=11), window))
    flagged = written(_flagged(_index_rows(docs, window), window, often), "factors")
    looks = flagged.where("flag >= 2").groupBy("_d", "_h").agg(F.collect_set(F.struct("nth", "flag")).alias("looks"))
    near = docs.where("_text is not null").join(looks.withColumnsRenamed({"_d": "_e", "_h": "_i"}), F.col("_d").eqNullSafe(F.col("_e")) & (F.col("_h") == F.col("_i")))
    edges = written(_boundary_windows(near.select("_d", "_h", "_text", "looks"), window), "boundaries")
    twice = edges.groupBy("w1", "w2").count().where("count > 1").select("w1", "w2")
    single = edges.where("not known").join(twice, ["w1", "w2"]).select("_d", "_h", F.lit(None).cast("int").alias("nth"), "at")
    both = flagged.where("flag != 2").select("_d", "_h", "nth", F.lit(None).cast("int").alias("at")).unionByName(single)
    return both.groupBy("_d", "_h").agg(F.collect_set("nth").alias("blocks"), F.collect_set("at").alias("windows"))


def _clean(words: list[bytes], text: bytes, gone: np.ndarray) -> bytes:
    """The text without the words that are gone; what stays of it keeps its white space, runs are joined by a line end."""
    if not gone.any():
        return text
    edges = np.flatnonzero(np.diff(np.concatenate(([True], gone, [True]))))
    out, at, word = [], 0, 0
    for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
        first = 0
        for w in range(word, end):
            at = text.index(words[w], at)
            first = at if w == start else first
            at += len(words[w])
        word = end
        out.append(text[first:at])
    return b"\n".join(out)


def remove_repeats(docs: DataFrame, window: int = 35, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with all columns, the text without its repeated windows, and ``n_words``, ``n_removed`` (of the input).

    A text without a repeated window stays as it is; a null text stays null, with no words. Rows are never
    dropped: a text that goes whole is empty. Columns called ``n_words`` or ``n_removed`` are replaced.
    """
    docs = docs.drop("n_words", "n_removed")
    spans = repeated_windows(docs, window, doc_id, text)
    keep = docs.columns
    rows = docs.select(F.struct(*[f"`{c}`" for c in keep if c != text]).alias("_row"), F.col(f"`{doc_id}`").alias("_d"), F.xxhash64(f"`{text}`").alias("_h"), F.col(f"`{text}`").alias("_text"))
    rows = rows.join(spans.withColumnsRenamed({"_d": "_e", "_h": "_i"}), F.col("_d").eqNullSafe(F.col("_e")) & (F.col("_h") == F.col("_i")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(window)
        for batch in batches:
            blocks, windows = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            texts, removed, counts = [], [], []
            valid = batch.column(1).is_valid().to_pylist()
            for k, raw in enumerate(text_bytes(batch.column(1))):
                if not blocks[k] and not windows[k]:
                    texts.append(raw if valid[k] else None)
                    counts.append(len(raw.split()))
                    removed.append(0)
                    continue
                words = parser.read(raw)
                first, last, _, _ = parser.blocks()
                steps = np.zeros(len(words) + 1, np.int64)
                nth, at = np.array(blocks[k] or [], np.int64), np.array(windows[k] or [], np.int64)
                np.add.at(steps, np.concatenate((first[nth], at)), 1)
                np.add.at(steps, np.concatenate((last[nth] - 1 + window, at + window)), -1)
                gone = np.cumsum(steps[:-1]) > 0
                texts.append(_clean(words, raw, gone))
                counts.append(len(words))
                removed.append(int(gone.sum()))
            got = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), got, pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], names=["_row", "_text", "n_words", "n_removed"])

    schema = rows.select("_row", F.col("_text").cast("string"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed")).schema
    out = rows.select("_row", F.col("_text").cast("string"), "blocks", "windows").mapInArrow(run, schema)
    return out.select(*[F.col("_text").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in keep], "n_words", "n_removed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: ``doc_id, n_words, n_removed, kept_sha256`` for every document."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    line = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), f"{WHITE}+", " "))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(line, 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
win AS (
  SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h
  FROM d, unnest(range(1, len(w) - 33)) AS t(i)),
rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY h) > 1),
gone AS (SELECT DISTINCT r, i + k AS p FROM rep, unnest(range(0, 35)) AS t(k)),
words AS (SELECT r, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY p) AS line, count(*) AS n
  FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.line, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
