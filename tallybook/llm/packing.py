"""Best-fit packing (operator 5), planned over the counts of lengths.

Documents are cut only where they are longer than a sequence. The pieces' lengths are counted (as many counts
as a sequence has tokens, whatever the input), and best-fit decreasing runs over these counts: bins with the
same remaining room are one range of sequence numbers, and a length fills whole ranges at a time. The plan is
a list of slots, each a range of ranks within a length; pieces get ranks by prefix sums over the written
partitions and take their place by a join on the length and the rank.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import small_batches, table, written
from .tokens import encoder, public_path


def plan(counts: dict[int, int], room: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots ``(length, first rank, one past the last rank, first sequence, per sequence, offset)``.

    Piece ``r`` of a slot goes to sequence ``first + i // per`` at ``offset + i % per * length``, where
    ``i = r - first rank``. Best-fit decreasing: each length takes the fullest sequences that have room,
    and only what is left opens new ones. A range of sequences is split once per length at most, and its room
    at least halves when it is used, so the plan's size depends on ``room`` alone.
    """
    slots: list[tuple[int, int, int, int, int, int]] = []
    free: list[tuple[int, int, int]] = []  # room left, first sequence, sequences
    following = 0
    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        if not 0 < length <= room:
            raise ValueError(f"a piece of {length} tokens doesn't fit {room}")
        rank, n, back = 0, counts[length], []

        def fill(left: int, first: int, size: int) -> None:
            nonlocal rank
            per = left // length
            whole = min(size, (n - rank) // per)
            if whole:
                slots.append((length, rank, rank + whole * per, first, per, room - left))
                rank += whole * per
                back.append((left - per * length, first, whole))
            if rank < n and whole < size:  # the last sequence gets what is left
                some = n - rank
                slots.append((length, rank, n, first + whole, some, room - left))
                rank = n
                back.append((left - some * length, first + whole, 1))
                whole += 1
            if whole < size:
                back.append((left, first + whole, size - whole))

        fits = [x for x in free if x[0] >= length]
        free = [x for x in free if x[0] < length]
        heapq.heapify(fits)
        while fits and rank < n:
            fill(*heapq.heappop(fits))
        if rank < n:
            opened = -(-(n - rank) // (room // length))
            fill(room, following, opened)
            following += opened
        free += [x for x in (*fits, *back) if x[0]]
    return slots


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, room: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids`` and where a piece was made: ``_part``, and ``_nth`` of its length there.

    A null text is empty: one piece with the end id alone. Repeated rows give repeated pieces.
    """
    small_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids", "_part", "_nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(room + 1, np.int64)
        for batch in batches:
            row, piece, start, length, ids, nth = [], [], [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                got = coder.ids(text or "") + end
                for p, at in enumerate(range(0, len(got) // 4, room)):
                    cut = got[4 * at : 4 * (at + room)]
                    row.append(k)
                    piece.append(p)
                    start.append(at)
                    ids.append(cut)
                    length.append(n := len(cut) // 4)
                    nth.append(seen[n])
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                    pa.array(ids, pa.binary()), pa.array([part] * len(row), pa.int64()), pa.array(nth, pa.int64()),
                ],
                names=names,
            )

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary, _part long, _nth long")


def pack(docs: DataFrame, tokenizer: str, end_id: int, room: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece of ``docs`` with its place: ``doc_id, piece, start, length, ids, sequence_id, offset``.

    Sequences are filled without gaps from offset 0 and numbered from 0. Which of two pieces of one length
    takes which slot is arbitrary. An empty table gives no rows; other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, tokenizer, end_id, room, doc_id, text), "pieces")
    by_part = pieces.groupBy("length", "_part").count()
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(by_part.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))), "bases")
    # at most one count for each length up to room
    counts = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    slots = spark.createDataFrame(plan(counts, room), "s_length long, low long, high long, first long, per long, place long")
    # one row for each length and partition that has it: broadcast while they are few, else sorted and merged
    bases = bases.select("length", "_part", "base")
    bases = F.broadcast(bases) if bases.count() <= 200_000 else bases.hint("merge")
    ranked = pieces.join(bases, ["length", "_part"]).withColumn("rank", F.col("base") + F.col("_nth"))
    # the plan's size is bounded by room, so it can always be broadcast
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("s_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    nth = F.col("rank") - F.col("low")
    sequence = F.col("first") + F.expr("(rank - low) div per")
    return placed.select("doc_id", "piece", "start", "length", "ids", sequence.alias("sequence_id"), (F.col("place") + F.pmod(nth, F.col("per")) * F.col("length")).alias("offset"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every piece of every document with its sequence and its place there."""
    out = pack(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"), end_id=1, room=4096)
    return out.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
