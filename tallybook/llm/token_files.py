"""Token ids in flat binary files (operator 3).

A shard is two files: ``NNNNN.bin`` has the ids of its documents one after another as unsigned integers of 16
or 32 bits, little-endian, and ``NNNNN.idx`` the 64-bit offsets (in ids) at which they begin, one more than
there are documents, then the documents' ids and which of those are null. ``manifest.json`` lists the shards
in order with their documents and tokens; a shard's base is the prefix sum of the tokens before it. Files of
a local or mounted file system are memory-mapped.

Each task writes its shard under a name of its own and moves it in place, so a task that runs twice leaves
the same files. Order: null ids first, then ascending; equal ids by text; equal rows are each kept.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import files, new_folder, parallel, small_batches, table, write_whole
from .tokens import encoder, public_path

_SHARD_BYTES = 128 << 20  # of text in a shard


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, vocabulary: int, shards: int | None = None, doc_id: str = "doc_id", text: str = "text") -> dict:
    """Encodes ``docs`` and writes them in order of their ids to the folder ``path`` (a URI); returns the manifest.

    A null text is empty: it has the end id alone. Only the shards' sizes come to the driver. An empty
    table gives a manifest without shards. Ids are 64-bit integers.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if shards is None:
        shards = max(parallel(spark), int(docs.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")))).first()[0] or 0) // _SHARD_BYTES)
    width = "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"
    fs, folder = files(path)
    fs.create_dir(folder, recursive=True)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        name = f"{TaskContext.get().partitionId():05d}"
        sizes, ids, nulls = array("q"), array("q"), bytearray()  # 17 bytes a document

        def parts():
            for batch in batches:
                nulls.extend(batch.column(0).is_null().to_numpy(zero_copy_only=False).astype("u1").tobytes())
                ids.frombytes(batch.column(0).fill_null(0).to_numpy().tobytes())
                for x in batch.column(1).to_pylist():
                    got = np.frombuffer(coder.ids(x or "") + end, "<u4")
                    sizes.append(len(got))
                    yield got.astype(width).tobytes()

        fs, folder = files(path)
        write_whole(fs, folder, f"{name}.bin", parts())
        offsets = np.concatenate(([0], np.cumsum(np.frombuffer(sizes, np.int64)))).astype("<i8")
        write_whole(fs, folder, f"{name}.idx", [offsets.tobytes(), np.frombuffer(ids, np.int64).astype("<i8").tobytes(), bytes(nulls)])
        yield pa.RecordBatch.from_pydict({"shard": [int(name)], "documents": [len(sizes)], "tokens": [int(offsets[-1])]})

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    dealt = rows.repartitionByRange(shards, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    # sorted here: a sort in Spark would run the tasks once more to sample them
    made = sorted((r.asDict() for r in dealt.mapInArrow(run, "shard long, documents long, tokens long").collect()), key=lambda r: r["shard"])
    made = [r for r in made if r["documents"]]
    for r, base in zip(made, np.cumsum([0, *(r["tokens"] for r in made)])):
        r["base"] = int(base)
    manifest = {"dtype": width, "end_id": end_id, "shards": made}
    with fs.open_output_stream(f"{folder}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


class Shard:
    """One shard, memory-mapped where the file system is local, else read by ranges."""

    def __init__(self, fs: pafs.FileSystem, folder: str, shard: int, documents: int, dtype: str):
        name = f"{folder}/{shard:05d}"
        local = isinstance(fs, pafs.LocalFileSystem)
        self.dtype = np.dtype(dtype)
        self.file = np.memmap(f"{name}.bin", dtype, "r") if local else fs.open_input_file(f"{name}.bin")
        raw = np.memmap(f"{name}.idx", "u1", "r") if local else np.frombuffer(fs.open_input_file(f"{name}.idx").read(), "u1")
        self.offsets = raw[: 8 * documents + 8].view("<i8")
        self.ids = raw[8 * documents + 8 : 16 * documents + 8].view("<i8")
        self.null = raw[16 * documents + 8 :]

    def __getitem__(self, k: int) -> np.ndarray:
        """The ids of the shard's document k."""
        s, e = int(self.offsets[k]), int(self.offsets[k + 1])
        if isinstance(self.file, np.memmap):
            return self.file[s:e]
        return np.frombuffer(self.file.read_at((e - s) * self.dtype.itemsize, s * self.dtype.itemsize), self.dtype)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the files at ``path``: ``doc_id, start, n_tokens, ids`` (ids as unsigned 32-bit, little-endian)."""
    small_batches(spark)
    fs, folder = files(path)
    with fs.open_input_stream(f"{folder}/manifest.json") as f:
        manifest = json.loads(f.read())
    dtype = manifest["dtype"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = files(path)
        for batch in batches:
            for x in batch.to_pylist():
                shard = Shard(fs, folder, x["shard"], x["documents"], dtype)
                for at in range(0, x["documents"], 256):
                    to = min(at + 256, x["documents"])
                    docs = [shard[k].astype("<u4").tobytes() for k in range(at, to)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.array(shard.ids[at:to]), mask=np.array(shard.null[at:to], bool)),
                            pa.array(np.array(shard.offsets[at:to]) + x["base"]),
                            pa.array(np.diff(shard.offsets[at : to + 1])),
                            pa.array(docs, pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    shards = spark.createDataFrame([tuple(r[k] for k in ("shard", "documents", "tokens", "base")) for r in manifest["shards"]], "shard long, documents long, tokens long, base long")
    out = "doc_id long, start long, n_tokens long, ids binary"
    return shards.repartition(max(1, len(manifest["shards"]))).mapInArrow(run, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: ``doc_id, start, n_tokens, ids_crc32`` of every document, from the files read back."""
    path = new_folder(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_path("byte_bpe_50k.json"), end_id=2, vocabulary=50_257)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
