"""SimHash near-duplicates (operator 10): exact comparison of 64-bit fingerprints that agree in blocks of bits.

Every pair of different fingerprints within the radius is found. Bits are cut into ``radius + k`` blocks; two
fingerprints within the radius differ in ``radius`` blocks at most, so they agree in all of some ``k`` blocks.
For each choice of ``k`` blocks those that agree in them form a cell and are compared; ``k`` follows the number of
fingerprints (radius 4: 5 cells a fingerprint, then 15 of about 21 bits, 35 of 27, 70 of 32). numpy compares the
rows of small cells by shifts, those of large ones tile against tile, and skips tile pairs whose bit counts (by
byte) differ by more than the radius. A task sends out a spanning forest of the links that it finds, never all
pairs; equal fingerprints are one node with a count.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import parallel, row_hash, small_batches, table, text_bytes, written

_ONES = np.uint64(0x0101010101010101)
_TASK_PAIRS = 2e8  # comparisons that a task should have
_ROW_COST, _PAIR_COST = 1500, 6  # about how many nanoseconds a row of a cell and a comparison take
_SMALL_CELL = 256  # rows that are compared by shifts
_SAMPLED = 1 << 21  # fingerprints whose cells are counted


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of lower-cased words; fewer words than ``size``: of the whole sequence."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    return np.fromiter((digest(line[s:e], 42) for s, e in spans), np.uint64, len(words) - size + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed 64-bit number; of none: zero."""
    if not len(hashes):
        return 0
    cuts = np.arange(0, len(hashes), 255)  # a lane of eight bits holds 255 ones
    out = np.zeros(64, np.int64)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _ONES, cuts)
        out[bit::8] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * out > len(hashes), bitorder="little").view(np.int64)[0])


def with_fingerprints(docs: DataFrame, size: int = 4, text: str = "text", name: str = "fp") -> DataFrame:
    """``docs`` without its text and with its SimHash as a long column, in place of one that is called like it.

    Null and empty texts have the fingerprint zero.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in (text, name)]
    schema = docs.select(*[f"`{c}`" for c in keep]).withColumn(name, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [majority(shingle_hashes(x, size)) for x in text_bytes(batch.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(got, pa.int64())], names=[*keep, name])

    return docs.select(*[f"`{c}`" for c in keep], F.col(f"`{text}`").cast("string").alias("_text")).mapInArrow(run, schema)


class _Tiles:
    """Fingerprints sorted by their bit counts, in tiles that know the range of the counts of each byte."""

    def __init__(self, fps: np.ndarray, side: int):
        ones = np.bitwise_count(fps.view(np.uint8).reshape(-1, 8)).astype(np.int16)
        words = ones[:, 0::2] + ones[:, 1::2]
        self.order = np.lexsort((*(ones[:, k] for k in range(8)), *(words[:, k] for k in range(4))))
        self.fps, ones = fps[self.order], ones[self.order]
        self.cuts = np.arange(0, len(fps), side)
        self.side = side
        self.low, self.high = np.minimum.reduceat(ones, self.cuts), np.maximum.reduceat(ones, self.cuts)

    def near(self, low: np.ndarray, high: np.ndarray, radius: int) -> np.ndarray:
        """Tiles that may hold a fingerprint within the radius of one in the given ranges."""
        apart = np.maximum(0, np.maximum(self.low - high, low - self.high)).sum(axis=1)
        return np.flatnonzero(apart <= radius)


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row that each row reaches, from the same before rows ``a`` were linked to ``b``."""
    while True:
        x, y = root[a], root[b]
        if not (apart := x != y).any():
            return root
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]) is not None and (up != root).any():
            root = up


def _forests(found: Iterator[tuple[np.ndarray, np.ndarray]], most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Links ``(a, b)`` that join what the given ones join, a spanning forest of as many as are held at once."""
    held, waiting = [], 0

    def forest() -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.concatenate(x) for x in zip(*held))
        nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        root = _joined(np.arange(len(nodes)), at[: len(a)], at[len(a) :])
        own = np.flatnonzero(root != np.arange(len(root)))
        return nodes[own], nodes[root[own]]

    for a, b in found:
        if not len(a):
            continue
        held.append((a, b))
        waiting += len(a)
        if waiting > most:
            held = [forest()]
            waiting = len(held[0][0])
            if waiting > most // 2:
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in held[0]], names=["a", "b"])
                held, waiting = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in forest()], names=["a", "b"])


class _Home:
    """The fingerprints of a cell, and which of them are known to be linked."""

    def __init__(self, fps: np.ndarray, radius: int, side: int):
        self.radius, self.tiles = radius, _Tiles(fps, side)
        self.root = np.arange(len(fps))
        for k, at in enumerate(self.tiles.cuts):
            near = self.tiles.near(self.tiles.low[k], self.tiles.high[k], radius)
            self._meet(self.tiles.fps[at : at + side], at, near[near >= k])

    def _meet(self, fps: np.ndarray, at: int | None, near: np.ndarray) -> np.ndarray:
        """Links the home rows within the radius; for visitors (at is None) also gives one home row of each, or -1."""
        first = np.full(len(fps), -1)
        for k in near:
            other = self.tiles.cuts[k]
            them = self.tiles.fps[other : other + self.tiles.side]
            i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ them[None, :]) <= self.radius)
            if not len(i):
                continue
            j = j + other
            if at is None:
                hit, where = np.unique(i, return_index=True)
                new = first[hit] < 0
                first[hit[new]] = j[where[new]]
                i = first[i]
            else:
                i = i + at
            if (apart := self.root[i] != self.root[j]).any():
                self.root = _joined(self.root, i[apart], j[apart])
        return first

    def visit(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links between visitors and home rows: one for each visitor that has any."""
        guests, a, b = _Tiles(fps, self.tiles.side), [], []
        for k, at in enumerate(guests.cuts):
            here = guests.fps[at : at + guests.side]
            first = self._meet(here, None, self.tiles.near(guests.low[k], guests.high[k], self.radius))
            a.append(here[first >= 0])
            b.append(self.tiles.fps[first[first >= 0]])
        return np.concatenate(a), np.concatenate(b)

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        own = np.flatnonzero(self.root != np.arange(len(self.root)))
        return self.tiles.fps[own], self.tiles.fps[self.root[own]]


def _tile_links(radius: int, side: int):
    """In rows ``key, tag, fp`` of parts of large cells, by key and tag: home rows (tag 0) meet each other and visitors."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        key, rows, home = None, [], None
        for batch in batches:
            keys, tags, fps = (batch.column(k).to_numpy() for k in range(3))
            cuts = np.flatnonzero((np.diff(keys) != 0) | (np.diff(tags) != 0)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(keys)]):
                if s == e:
                    continue
                if keys[s] != key:
                    if rows:
                        home, rows = _Home(np.concatenate(rows), radius, side), []
                    if home:
                        yield home.forest()
                    key, home = keys[s], None
                part = fps[s:e].view(np.uint64)
                if not tags[s]:
                    rows.append(part)
                    continue
                if rows:
                    home, rows = _Home(np.concatenate(rows), radius, side), []
                if home:
                    yield home.visit(part)
        if rows:
            home = _Home(np.concatenate(rows), radius, side)
        if home:
            yield home.forest()

    return lambda batches: _forests(links(batches))


def _cell_links(radius: int, side: int):
    """In rows ``key, fp`` by key: those of a cell meet."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for key, fps in _group_chunks(batches, 2):
            fps = fps.view(np.uint64)
            first = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
            size = np.diff(np.append(first, len(key)))
            for k in np.flatnonzero(size > _SMALL_CELL):
                yield _Home(fps[first[k] : first[k] + size[k]], radius, side).forest()
            few = np.repeat((size > 1) & (size <= _SMALL_CELL), size)
            key, fps = key[few], fps[few]
            rows = np.arange(len(key))  # with one of their cell ``step`` further on
            for step in range(1, _SMALL_CELL):
                rows = rows[rows < len(key) - step]
                rows = rows[key[rows] == key[rows + step]]
                if not len(rows):
                    break
                near = rows[np.bitwise_count(fps[rows] ^ fps[rows + step]) <= radius]
                yield fps[near], fps[near + step]

    return lambda batches: _forests(links(batches))


def _masks(radius: int, agree: int) -> list[int]:
    """Bits of each choice of ``agree`` blocks out of ``radius + agree``; of none: no bits, as all meet."""
    cuts = [64 * k // max(1, radius + agree) for k in range(radius + agree + 1)]
    blocks = [(1 << high) - (1 << low) for low, high in zip(cuts, cuts[1:])]
    return [sum(some) for some in combinations(blocks, agree)]


def _pairs_in(masks: list[int], n: int) -> float:
    """About how many pairs of ``n`` fingerprints meet in the cells."""
    return sum(n * n / 2 / 2 ** mask.bit_count() for mask in masks)


def fingerprint_links(fps: DataFrame, radius: int = 4, cell_rows: int = 1 << 17, side: int = 512, agree: int | None = None) -> DataFrame:
    """Links ``(a, b)`` that join all different fingerprints (column ``fp``) within the radius, as a forest per task.

    Cells are those of ``agree`` blocks; None: as many as take the least time, were bits even. A cell over ``cell_rows`` rows
    (as a sample has it, of two million fingerprints at least) is split, and each part meets the others: no task holds more
    at once. ``fps`` must be cheap to read again.
    """
    spark = fps.sparkSession
    n = fps.count()
    if agree is None:
        choices = [k for k in range(5) if radius + k <= 64 and (k or n <= cell_rows)] or [0]
        agree = min(choices, key=lambda k: len(_masks(radius, k)) * n * _ROW_COST + _pairs_in(_masks(radius, k), n) * _PAIR_COST)
    masks = _masks(radius, agree)

    def cells(df: DataFrame) -> DataFrame:
        keys = [F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long"))) for k, m in enumerate(masks)]
        return df.select(F.explode(F.array(*keys)).alias("cell"), "fp")

    every = max(1, n // _SAMPLED)
    sample = fps.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0)
    large = cells(sample).groupBy("cell").count().where(F.col("count") * every > cell_rows)
    large = {r["cell"]: r["count"] * every for r in large.collect()}  # at most len(masks) * n / cell_rows
    # comparisons, not bytes, are what a task must have few of
    tasks = max(parallel(spark), int(_pairs_in(masks, n) / _TASK_PAIRS))
    rows = cells(fps)
    if not large:
        return rows.repartition(tasks, "cell").sortWithinPartitions("cell").mapInArrow(_cell_links(radius, side), "a long, b long")
    split = F.broadcast(spark.createDataFrame([(c, -(-k // cell_rows)) for c, k in large.items()], "cell long, parts long"))
    links = rows.join(split, "cell", "left_anti").repartition(tasks, "cell").sortWithinPartitions("cell").mapInArrow(_cell_links(radius, side), "a long, b long")
    rows = rows.join(split, "cell").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")))
    home = rows.select(F.xxhash64("cell", "own").alias("key"), F.lit(0).alias("tag"), "fp")
    away = rows.where("own > 0").select("cell", "fp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("own") - 1)).alias("part"))
    rows = home.unionByName(away.select(F.xxhash64("cell", "part").alias("key"), F.lit(1).alias("tag"), "fp"))
    tasks = max(parallel(spark), int(sum(k * k for k in large.values()) / 2 / _TASK_PAIRS))
    rows = rows.repartition(tasks, "key").sortWithinPartitions("key", "tag")
    return links.unionByName(rows.mapInArrow(_tile_links(radius, side), "a long, b long"))


def with_components(prints: DataFrame, radius: int = 4, doc_id: str = "doc_id") -> DataFrame:
    """Adds ``component_id``, the least ``doc_id`` that a row reaches, and ``root`` to rows with a column ``fp``.

    ``root`` names the component even where ids repeat or are null.

    ``prints`` must be cheap to read again (a written table): it is read three times. A row with a null
    id takes part; a component of such rows alone has a null id. Repeated ids do not link rows by themselves.
    """
    known = written(prints.groupBy("fp").agg(F.min(f"`{doc_id}`").alias("_least")), "fingerprints")
    roots = components(fingerprint_links(known.select("fp"), radius))
    rooted = known.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = written(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("_least").alias("component_id"))
    return prints.join(rooted.select("fp", "root").join(least, "root"), "fp")


def near_duplicates(docs: DataFrame, size: int = 4, radius: int = 4) -> DataFrame:
    """One row per document: ``doc_id, fp, component_id``.

    Null and empty texts have fingerprint zero and are linked like any other. Rows that repeat are kept, each
    with the same component. Further columns of ``docs`` are ignored. An empty table gives no rows.
    """
    prints = written(with_fingerprints(docs.select("doc_id", "text"), size), "prints")
    return with_components(prints, radius).drop("root")


def keep_one(docs: DataFrame, size: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` with all columns, one for each group of near-duplicates.

    The row with the least ``doc_id`` stays; among rows that share it, that with the least hash of all
    columns; of wholly equal rows, one. A null id counts as greater than any other.
    """
    rows = docs.select("doc_id", "text", row_hash(docs.columns).alias("_row"))
    prints = written(with_fingerprints(rows, size), "prints")
    return _least_rows(docs, prints, with_components(prints, radius))


def _least_rows(docs: DataFrame, prints: DataFrame, rooted: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: the least ``doc_id, _row`` of each ``root``, once."""
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("_row").alias("r"))).alias("k"))
    kept = written(best.select("k.n", "k.d", "k.r").distinct(), "kept")
    marked = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("all"), F.col("doc_id").alias("e"), row_hash(docs.columns).alias("h"))
    out = marked.join(kept, F.col("e").eqNullSafe(F.col("d")) & (F.col("h") == F.col("r")), "left_semi")
    repeats = prints.groupBy("doc_id", "_row").count().where("count > 1")
    if not repeats.join(kept, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("_row") == F.col("r")), "left_semi").isEmpty():
        out = out.dropDuplicates(["e", "h"])
    return out.select("all.*")

_HOT_DOCS, _HOT_LEAST, _HOT_MOST = 10_000, 5, 200_000  # sampled documents, in how many of them a shingle is hot, longest list
_SMALL_GROUP = 32  # rows that all meet
_NEAREST = 8  # rows that one outside its group's largest component meets before it meets all


def numbered(hashes: np.ndarray) -> np.ndarray:
    """A hash for each shingle and its occurrence number, sorted: the common ones of two texts are the sum of the lesser counts."""
    s = np.sort(hashes)
    if not len(s):
        return s.view(np.int64)
    first = np.concatenate(([0], np.flatnonzero(np.diff(s)) + 1))
    nth = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
    out = s + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((out ^ (out >> np.uint64(29))).view(np.int64))


def _node(runs: np.ndarray) -> int:
    """Names texts with the same shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(runs.tobytes(), 7)).view(np.int64))


def _odd(runs: np.ndarray) -> bytes:
    """Which buckets of their low bits hold an odd number of the shingles, two to four buckets a shingle and 64 at least.

    As many bits as differ between two texts' sketches, at least, are shingles that only one of them has.
    """
    buckets = max(64, 1 << max(0, 2 * len(runs) - 1).bit_length())
    counts = np.bincount((runs.view(np.uint64) & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def _over_texts(docs: DataFrame, size: int, schema: str, rows) -> DataFrame:
    """``rows(runs)`` of each text's numbered shingles, as arrays for the columns of ``schema``."""
    small_batches(docs.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [rows(numbered(shingle_hashes(t, size))) for t in text_bytes(batch.column(0))]
            if made:
                columns = [np.concatenate(x) for x in zip(*made)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)

    return docs.select(F.col("text").cast("string").alias("_text")).mapInArrow(run, schema)


def _hot(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many documents of a sample hold, sorted, and about how many of all documents hold them.

    The sample only orders shingles and steers where rows go; links are the same without it.
    """
    every = max(1, docs.count() // _HOT_DOCS)
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)
    hot = _over_texts(sample, size, "run long", lambda runs: (runs,)).groupBy("run").count().where(F.col("count") >= _HOT_LEAST)
    hot = hot.orderBy(F.desc("count"), "run").limit(_HOT_MOST).toPandas().sort_values("run")  # at most _HOT_MOST rows
    return hot["run"].to_numpy(np.int64), hot["count"].to_numpy(np.int64) * every


def _texts(rows: DataFrame, size: int, similarity: float, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``doc_id, _row, node, n, bits, t, odd, prefix`` of rows ``doc_id, _row, t, _text``.

    ``prefix`` has as many of a text's shingles, the rarest first, that two texts alike must share one. Any order that
    all texts share is right; hot shingles come last, so that few groups are large. ``odd`` is the text's sketch.
    """
    small_batches(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(hot)
    schema = rows.select("doc_id", "_row", F.lit(0).cast("long").alias("node"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("bits"), "t", F.lit(None).cast("binary").alias("odd"), F.lit(None).cast("array<long>").alias("prefix")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = sent.value
        for batch in batches:
            node, n, bits, odd, prefix = [], [], [], [], []
            for text in text_bytes(batch.column(3)):
                runs = numbered(shingle_hashes(text, size))
                late = np.zeros(len(runs), np.int64)
                if len(known) and len(runs):
                    at = np.minimum(np.searchsorted(known, runs), len(known) - 1)
                    late = np.where(known[at] == runs, often[at], 0)
                least = int(np.ceil(similarity * len(runs) - 1e-9))
                node.append(_node(runs))
                n.append(len(runs))
                bits.append(majority(runs.view(np.uint64)))
                odd.append(_odd(runs))
                prefix.append(runs[np.lexsort((runs, late))[: len(runs) - least + 1]] if len(runs) else runs)
            ends = np.cumsum([0, *map(len, prefix)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *prefix])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(node, pa.int64()), pa.array(n, pa.int32()), pa.array(bits, pa.int64()), batch.column(2), pa.array(odd, pa.binary()), lists], names=["doc_id", "_row", "node", "n", "bits", "t", "odd", "prefix"])

    return rows.select("doc_id", "_row", "t", "_text").mapInArrow(run, schema)


def _group_chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first, in chunks that hold whole groups."""
    held: list[list[np.ndarray]] = []
    waiting = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        part = [batch.column(k).to_numpy() for k in range(width)]
        held.append(part)
        waiting += batch.num_rows
        if waiting < 1 << 17 or held[0][0][0] == part[0][-1]:
            continue
        rows = [np.concatenate(x) for x in zip(*held)]
        cut = int(np.flatnonzero(rows[0] != rows[0][-1])[-1]) + 1  # the last group may go on
        yield [x[:cut] for x in rows]
        held, waiting = [[x[cut:] for x in rows]], len(rows[0]) - cut
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64))


class _Pairs:
    """Which rows may be alike by length, place in the order of shingles and fingerprint, each pair of nodes once a chunk, with a place where both are.

    ``most`` is how many shingles of a text come from the shared one on: where it is the first that two texts share, they share no more.
    """

    def __init__(self, place: np.ndarray, node: np.ndarray, n: np.ndarray, bits: np.ndarray, most: np.ndarray, similarity: float, radius: int):
        self.place, self.node, self.n, self.bits, self.most, self.similarity, self.radius = place, node, n, bits, most, similarity, radius
        self.found: list[np.ndarray] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        near = _distance(self.bits[i], self.bits[j]) <= self.radius
        i, j = i[near], j[near]
        enough = np.minimum(self.most[i], self.most[j]) * (1 + self.similarity) >= self.similarity * (self.n[i].astype(np.int64) + self.n[j]) - 1e-9
        near = enough & (self.node[i] != self.node[j])
        i, j = i[near], j[near]
        a, b = self.node[i], self.node[j]
        self.found.append(np.column_stack((np.minimum(a, b), np.maximum(a, b), self.place[i])))

    def rows(self) -> pa.RecordBatch:
        """Each pair with its least place."""
        made = np.concatenate([np.empty((0, 3), np.int64), *self.found])
        made = made[np.lexsort((made[:, 2], made[:, 1], made[:, 0]))]
        new = np.ones(len(made), bool)
        new[1:] = (made[1:, :2] != made[:-1, :2]).any(axis=1)
        made = made[new]
        none = np.zeros(len(made), np.int64)
        self.found.clear()
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (made[:, 0], made[:, 1], made[:, 2], none.astype(np.int32) - 1, none, none.astype(np.int32))], names=_MET_NAMES)


_MET = "a long, b long, run long, n int, bits long, most int"
_MET_NAMES = [x.split()[0] for x in _MET.split(", ")]


def _meet_center(similarity: float, radius: int):
    """In rows ``place, n, node, bits, most`` by place: all of a small group meet. In others each meets the next one and its
    group's center, the row nearest to the bits that most rows of the group have. Near copies of one text differ more from
    each other than from that text.

    Rows of groups that aren't small follow as ``a = node, run = place, n, bits, most``; pairs have ``n = -1`` and their place as ``run``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, n, node, bits, most in _group_chunks(batches, 5):
            first = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
            size = np.diff(np.append(first, len(place)))
            some = np.repeat(size > 1, size)  # most shingles have one text
            place, n, node, bits, most, size = place[some], n[some], node[some], bits[some], most[some], size[size > 1]
            if not len(size):
                continue
            first = np.concatenate(([0], np.cumsum(size)[:-1]))
            group = np.repeat(np.arange(len(size)), size)
            pairs = _Pairs(place, node, n, bits, most, similarity, radius)
            small = size <= _SMALL_GROUP
            for rows, reach in ((np.flatnonzero(small[group]), _SMALL_GROUP), (np.flatnonzero(~small[group]), 2)):
                for step in range(1, reach):
                    near = group[rows[step:]] == group[rows[:-step]]
                    if not near.any():
                        break
                    pairs.add(rows[:-step][near], rows[step:][near])
            common = np.zeros(len(size), np.uint64)
            for k in range(64):
                ones = np.add.reduceat((bits.view(np.uint64) >> np.uint64(k)) & np.uint64(1), first)
                common |= (2 * ones > size).astype(np.uint64) << np.uint64(k)
            rank = _distance(bits, common.view(np.int64)[group]).astype(np.int64) << 40 | np.arange(len(bits))
            center = np.minimum.reduceat(rank, first) & ((1 << 40) - 1)
            more = ~small[group]
            pairs.add(np.flatnonzero(more), center[group[more]])
            yield pairs.rows()
            if more.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[more]) for x in (node, node, place, n, bits, most)], names=_MET_NAMES)

    return run


def _meet_others(similarity: float, radius: int, nearest: int | None):
    """In rows ``place, tag, n, node, bits, most, root`` by place and tag: rows meet those of other components.

    With ``nearest``, a row outside its group's largest component meets that many, by bits. Without, each of these
    meets all rows; rows with tag 1 are guests from other parts of their group. Rows are sorted by ``n`` too, and meet
    those of a length and place in the order of shingles with which they can be alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, tag, n, node, bits, most, root in _group_chunks(batches, 7):
            longest = (most * (1 + similarity) + 1e-9) / similarity - n  # of the texts that a row may be alike to
            first = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
            for s, e in zip(first.tolist(), [*first[1:].tolist(), len(place)]):
                roots, counts = np.unique(root[s:e], return_counts=True)
                if len(roots) < 2:
                    continue
                pairs = _Pairs(place, node, n, bits, most, similarity, radius)
                home = s + np.flatnonzero(tag[s:e] == 0)
                rest = s + np.flatnonzero((root[s:e] != roots[counts.argmax()]) | (tag[s:e] == 1))
                everyone, step = home, min(512, max(1, (1 << 22) // max(1, len(home))))
                for at in range(0, len(rest), step):
                    part = rest[at : at + step]
                    low, high = similarity * n[part].min() - 1e-9, n[part].max() / similarity + 1e-9
                    home = everyone[np.searchsorted(n[everyone], low) : np.searchsorted(n[everyone], high, side="right")]
                    if not len(home):
                        continue
                    far = _distance(bits[part][:, None], bits[home][None, :])
                    apart = (root[part][:, None] != root[home][None, :]) & (far <= radius)
                    apart &= (n[home][None, :] <= longest[part][:, None]) & (n[part][:, None] <= longest[home][None, :])
                    if nearest is None:
                        i, j = np.nonzero(apart)
                    else:
                        far[~apart] = 99
                        k = min(nearest, len(home))
                        j = np.argpartition(far, k - 1, axis=1)[:, :k].ravel()
                        i = np.repeat(np.arange(len(part)), k)
                        i, j = i[apart[i, j]], j[apart[i, j]]
                    pairs.add(part[i], home[j])
                    if sum(map(len, pairs.found)) > 1 << 20:
                        yield pairs.rows()
                yield pairs.rows()

    return run


_PLACE_PAIRS = 1 << 16  # that are compared in one task
_SENT_IDS = 1 << 19  # texts' ids of eight bytes that are broadcast at most


def _place_chunks(batches: Iterator[pa.RecordBatch], size: int = 1 << 25) -> Iterator[pa.Table]:
    """Rows sorted by ``place``, in chunks of about ``size`` bytes that hold whole places."""
    held: list[pa.RecordBatch] = []
    waiting = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        waiting += batch.nbytes
        if waiting < size or held[0]["place"][0] == batch["place"][-1]:
            continue
        rows = pa.Table.from_batches(held)
        place = rows["place"].to_numpy()
        cut = int(np.flatnonzero(place != place[-1])[-1]) + 1  # the last place may go on
        yield rows.slice(0, cut)
        held = rows.slice(cut).to_batches()
        waiting = sum(x.nbytes for x in held)
    if held:
        yield pa.Table.from_batches(held)


def _compared(pairs: DataFrame, loads: DataFrame, alike) -> DataFrame:
    """The pairs ``(a, b, place)`` of nodes for which ``alike(words, starts, ends, n, at, bt)`` holds.

    ``loads`` has ``node, n, load``, a load being 64-bit words. Pairs are compared where they met: a place gets the load of
    each of its texts once, however many pairs it has. A place of very many pairs is split by one side.
    """
    large = pairs.groupBy("place").count().where(F.col("count") > _PLACE_PAIRS).select("place", F.expr(f"count div {_PLACE_PAIRS} + 1").alias("parts"))
    split = F.when(F.col("parts").isNull(), F.col("place")).otherwise(F.xxhash64("place", F.pmod(F.xxhash64("a"), F.col("parts"))))
    pairs = pairs.join(large, "place", "left").select(split.alias("place"), "a", "b")
    members = pairs.select("place", F.explode(F.array("a", "b")).alias("node")).distinct().join(loads, "node")
    rows = members.select("place", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "n", "load")
    rows = rows.unionByName(pairs, allowMissingColumns=True).repartition("place").sortWithinPartitions("place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _place_chunks(batches):
            paired = pc.is_valid(chunk["b"])
            met, members = chunk.filter(paired).combine_chunks(), chunk.filter(pc.invert(paired)).combine_chunks()
            if not met.num_rows:
                continue
            a, b, place = (met[c].to_numpy() for c in ("a", "b", "place"))
            node, n = members["a"].to_numpy(), members["n"].to_numpy().astype(np.int64)
            load = members["load"].combine_chunks().cast(pa.large_binary())
            ends = np.frombuffer(load.buffers()[1], np.int64)[load.offset : load.offset + len(load) + 1] // 8
            words = np.frombuffer(load.buffers()[2], np.uint8)[: ends[-1] * 8].view(np.uint64)
            order = np.argsort(node)
            at, bt = (order[np.searchsorted(node[order], x)] for x in (a, b))
            yes = alike(words, ends[:-1], ends[1:], n, at, bt)
            yield pa.RecordBatch.from_arrays([pa.array(x[yes]) for x in (a, b, place)], names=["a", "b", "place"])

    return rows.select("place", "a", "b", "n", "load").mapInArrow(run, "a long, b long, place long")


def _odd_alike(similarity: float):
    """Whether two texts' sketches leave it open that they are alike; the longer sketch is folded to the shorter."""

    def alike(words, starts, ends, n, at, bt):
        size = ends - starts
        swap = size[at] < size[bt]
        at, bt = np.where(swap, bt, at), np.where(swap, at, bt)
        most = (1 - similarity) / (1 + similarity) * (n[at] + n[bt]) + 1e-9
        out = np.zeros(len(at), bool)
        kinds = size[at] << 32 | size[bt]
        by = np.argsort(kinds, kind="stable")
        for some in np.split(by, np.flatnonzero(np.diff(kinds[by])) + 1):
            long, short = int(size[at[some[0]]]), int(size[bt[some[0]]])
            step = max(1, (1 << 20) // long)
            for few in np.split(some, range(step, len(some), step)):
                x = words[starts[at[few]][:, None] + np.arange(long)].reshape(len(few), long // short, short)
                y = words[starts[bt[few]][:, None] + np.arange(short)]
                apart = np.bitwise_count(np.bitwise_xor.reduce(x, axis=1) ^ y).sum(axis=1, dtype=np.int64)
                out[few] = apart <= most[few]
        return out

    return alike


def _runs_alike(similarity: float):
    """Whether two texts' sorted shingles are alike."""

    def alike(words, starts, ends, n, at, bt):
        values, out = words.view(np.int64), np.zeros(len(at), bool)
        by = np.argsort(at, kind="stable")
        for some in np.split(by, np.flatnonzero(np.diff(at[by])) + 1):
            own = values[starts[at[some[0]]] : ends[at[some[0]]]]
            for few in np.split(some, range(256, len(some), 256)):
                low, high = starts[bt[few]], ends[bt[few]]
                n = high - low
                theirs = values[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
                place = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
                common = np.add.reduceat((own[place] == theirs).astype(np.int64), np.concatenate(([0], np.cumsum(n)[:-1])))
                out[few] = common >= similarity * (len(own) + n - common) - 1e-9
        return out

    return alike


def _alike(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, size: int, similarity: float) -> DataFrame:
    """Of the pairs ``(a, b, place)`` of nodes those whose shingles are alike, by exact comparison.

    Sketches of a few bits a shingle come first: they leave out only pairs that cannot be alike, and nearly all that are
    far from it, so that few texts are read again and sent.
    """
    pairs = written(_compared(pairs, nodes.select("node", "n", F.col("odd").alias("load")), _odd_alike(similarity)), "maybe-alike")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "t"), "node")
    texts = docs.select(F.col("text").cast("string").alias("_text"), F.xxhash64("text").alias("t"))
    wanted = written(wanted.select("t"), "wanted")
    # few ids go to the texts, so that the other texts stay where they are
    texts = texts.join(F.broadcast(wanted) if wanted.count() <= _SENT_IDS else wanted, "t", "left_semi")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of copies one is enough
        for batch in batches:
            got, names = [], []
            for t, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                if t in seen:
                    continue
                if len(seen) > 1 << 18:
                    seen.clear()
                seen.add(t)
                got.append(numbered(shingle_hashes(text, size)))
                names.append(_node(got[-1]))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(list(map(len, got)), pa.int32()), pa.array([x.tobytes() for x in got], pa.binary())], names=["node", "n", "load"])

    sets = texts.select("t", "_text").mapInArrow(run, "node long, n int, load binary").dropDuplicates(["node"])
    return _compared(pairs, sets, _runs_alike(similarity)).select("a", "b")


def similar_links(docs: DataFrame, texts: DataFrame, hot: tuple[np.ndarray, np.ndarray], size: int = 5, similarity: float = 0.8, radius: int = 24, group_rows: int = 1 << 17) -> DataFrame:
    """Links ``(a, b)`` that join all nodes whose weighted shingle similarity is at least ``similarity``.

    Candidates share one of their rarest shingles, early enough in both that as many can be shared as it takes, which loses
    nothing, and have fingerprints within the radius (by exclusive-or and bit counts in tiles); each is compared by sketches,
    then exactly. The texts with a shingle form a group. All of a small group meet. In others each text first meets its
    group's center; a text that is then outside the largest component meets those with the nearest fingerprints, and only
    what is still apart meets all others that it can be alike to. So a group of near copies costs a few pairs a text, not all
    pairs. A group over ``group_rows`` texts, as the sample has it, is dealt out in parts: its first rounds run in each part,
    and in the last round texts outside its largest component visit every part.
    """
    spark = docs.sparkSession
    nodes = written(texts.groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("odd").alias("odd"), F.first("prefix").alias("prefix"), F.min("t").alias("t")), "distinct-texts")
    rows = nodes.select(F.posexplode("prefix").alias("pos", "run"), "n", "node", "bits").withColumn("most", F.col("n") - F.col("pos")).drop("pos")
    known, often = hot
    split = spark.createDataFrame([(r, -(-c * 2 // group_rows)) for r, c in zip(known.tolist(), often.tolist()) if c > group_rows], "run long, parts long")  # at most _HOT_MOST rows
    few = F.broadcast(split)

    def placed(df: DataFrame) -> DataFrame:
        own = F.xxhash64("run", F.pmod(F.xxhash64("node"), F.col("parts")))
        return df.join(few, "run", "left").withColumn("place", F.when(F.col("parts").isNull(), F.col("run")).otherwise(own))

    def dealt(df: DataFrame, columns: list[str], run, schema: str) -> DataFrame:
        order = [c for c in ("place", "tag", "n", "node") if c in columns]
        return df.select(*columns).repartition(parallel(spark), "place").sortWithinPartitions(*order).mapInArrow(run, schema)

    met = written(dealt(placed(rows), ["place", "n", "node", "bits", "most"], _meet_center(similarity, radius), _MET), "meetings")
    pairs = written(met.where("n = -1").groupBy("a", "b").agg(F.min("run").alias("place")), "pairs")
    links = written(_alike(docs, nodes, pairs, size, similarity), "alike")
    # a part of a split group may be a single row that still has to meet those of other parts
    parted = F.broadcast(split.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "run").select(F.xxhash64("run", "part").alias("run")))
    large = met.where("n >= 0").select("run", F.col("a").alias("node"), "n", "bits", "most").join(parted, "run", "left_anti")
    large = large.unionByName(rows.select("run", "node", "n", "bits", "most").join(few, "run", "left_semi"))
    for nearest in (_NEAREST, None):
        roots = components(links)
        now = large.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        apart = now.groupBy("run").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("run")
        large = written(now.join(apart, "run", "left_semi").select("run", "node", "n", "bits", "most", "root"), "apart")
        spread = placed(large).withColumn("tag", F.lit(0))
        if nearest is None:
            largest = large.join(F.broadcast(split.select("run")), "run", "left_semi").groupBy("run", "root").count().groupBy("run").agg(F.max_by("root", "count").alias("largest"))
            guests = large.join(few, "run").join(largest, "run").where("root != largest").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
            spread = spread.unionByName(guests.withColumn("place", F.xxhash64("run", "part")).withColumn("tag", F.lit(1)), allowMissingColumns=True)
        more = written(dealt(spread, ["place", "tag", "n", "node", "bits", "most", "root"], _meet_others(similarity, radius, nearest), _MET).groupBy("a", "b").agg(F.min("run").alias("place")), "more")
        if more.isEmpty():
            continue
        links = written(links.unionByName(_alike(docs, nodes, more, size, similarity)), "alike")
    return links


def keep_one_similar(docs: DataFrame, size: int = 5, similarity: float = 0.8, radius: int = 24, group_rows: int = 1 << 17) -> DataFrame:
    """As ``keep_one``, but the groups join documents by weighted shingle similarity, each link compared exactly.

    Documents with the same shingles are one node (up to collisions of 64-bit hashes), so texts without words (null,
    empty) are one group.
    """
    rows = docs.select("doc_id", row_hash(docs.columns).alias("_row"), F.xxhash64("text").alias("t"), F.col("text").cast("string").alias("_text"))
    hot = _hot(docs.select("text"), size)
    texts = written(_texts(rows, size, similarity, hot), "texts")
    roots = components(similar_links(docs.select("text"), texts, hot, size, similarity, radius, group_rows))
    prints = texts.select("doc_id", "_row", F.col("node").alias("fp"))
    rooted = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return _least_rows(docs, prints, rooted)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: ``doc_id, fingerprint, component_id`` for every document."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
