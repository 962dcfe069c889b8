"""Token ids in Arrow files of fixed-size lists.

Documents are range-partitioned by doc_id and each partition writes one shard: an Arrow IPC file whose record batches
hold BATCH sequences of `length` ids (fixed-size list) and their mask (fixed-size list of booleans). Only a shard's
last sequence is padded, under a false mask. The place of the id number k of a shard is batch k // (BATCH * length),
so a reader maps the file and touches the batches it needs without copying. A shard is written under another name
and renamed, so a task that is tried again leaves one whole file.

Cases: null text counts as empty and gives the end id alone; null ids come first; rows that share a doc_id follow in
the order of their texts; other columns are ignored; an empty table writes no shard.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

#: Sequences in one record batch.
BATCH = 64
INDEX = "shard int, doc_id long, place long, n_tokens long"


def _schema(length: int, dtype: np.dtype) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])


class ShardWriter:
    """Appends ids to one Arrow file, batch by batch."""

    def __init__(self, folder: str, shard: int, length: int, dtype: np.dtype):
        self.length, self.dtype, self.schema = length, dtype, _schema(length, dtype)
        self.store, root = arrow_fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (arrow_fs.LocalFileSystem(), folder)
        self.store.create_dir(root, recursive=True)
        self.final, self.temporary = f"{root}/shard-{shard:06d}.arrow", f"{root}/.{shard:06d}-{uuid.uuid4().hex}"
        self.stream = self.store.open_output_stream(self.temporary)
        self.writer = pa.ipc.new_file(self.stream, self.schema)
        self.held: list[np.ndarray] = []
        self.count = 0

    def append(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.count += len(ids)
        if self.count >= BATCH * self.length:
            flat = np.concatenate(self.held)
            whole = len(flat) // (BATCH * self.length) * BATCH * self.length
            for at in range(0, whole, BATCH * self.length):
                self._write(flat[at : at + BATCH * self.length], BATCH * self.length)
            self.held, self.count = [flat[whole:]], len(flat) - whole

    def _write(self, flat: np.ndarray, real: int) -> None:
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(a), type=f.type) for a, f in zip((flat, np.arange(len(flat)) < real), self.schema)]
        self.writer.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        if self.count:
            flat = np.concatenate(self.held)
            self._write(np.pad(flat, (0, -len(flat) % self.length)), len(flat))
        self.writer.close()
        self.stream.close()
        self.store.move(self.temporary, self.final)


class ShardReader:
    """ids(place, n) from one Arrow file."""

    def __init__(self, folder: str, shard: int):
        self.store, root = arrow_fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (arrow_fs.LocalFileSystem(), folder)
        path = f"{root}/shard-{shard:06d}.arrow"
        self.source = pa.memory_map(path) if isinstance(self.store, arrow_fs.LocalFileSystem) else self.store.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.at, self.flat, self.mask = -1, None, None

    def _batch(self, n: int) -> None:
        if self.at != n:
            batch = self.file.get_batch(n)
            self.flat, self.mask, self.at = batch.column(0).flatten().to_numpy(zero_copy_only=True), batch.column(1), n

    def ids(self, place: int, n: int) -> np.ndarray:
        size, parts = BATCH * self.length, []
        while n > 0:
            self._batch(place // size)
            take = min(n, size - place % size)
            parts.append(self.flat[place % size : place % size + take])
            place, n = place + take, n - take
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def masked(self, sequence: int) -> np.ndarray:
        self._batch(sequence // BATCH)
        return np.array(self.mask[sequence % BATCH].as_py(), bool)


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, length: int = 2048, dtype: str = "<u2") -> DataFrame:
    """Write the shards and return their index (INDEX) as a written table."""
    common.small_batches(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, encoder, writer, place = TaskContext.get().partitionId(), tokens.encoder(tokenizer, dtype), None, 0
        end = np.array([end_id], dtype)
        for batch in batches:
            if not batch.num_rows:
                continue
            writer = writer or ShardWriter(folder, shard, length, np.dtype(dtype))
            counts = []
            for ids in encoder.encode(batch.column("text").fill_null("")):
                counts.append(len(ids) // end.itemsize + 1)
                writer.append(np.frombuffer(ids, dtype))
                writer.append(end)
            starts = place + np.cumsum([0, *counts[:-1]])
            place += sum(counts)
            yield pa.record_batch({"shard": pa.array([shard] * len(counts), pa.int32()), "doc_id": batch.column("doc_id"), "place": pa.array(starts, pa.int64()), "n_tokens": pa.array(counts, pa.int64())})
        if writer:
            writer.close()

    ordered = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return common.written(ordered.mapInArrow(write, INDEX), "token-index")


def read_back(index: DataFrame, folder: str) -> DataFrame:
    """(shard, doc_id, place, n_tokens, ids_crc32) of every document, from the files."""

    def read(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        reader = ShardReader(folder, int(rows["shard"].iloc[0]))
        rows["ids_crc32"] = [zlib.crc32(reader.ids(p, n).astype("<u4").tobytes()) for p, n in zip(rows["place"].tolist(), rows["n_tokens"].tolist())]
        return rows

    return index.groupBy("shard").applyInPandas(read, f"{INDEX}, ids_crc32 long")


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = 2048, folder: str | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files in folder."""
    spark = docs.sparkSession
    folder = folder or common.new_path(spark, "token-shards")
    index = write_shards(docs, folder, tokenizer, end_id, length)
    # One row for each shard, as many as there are partitions.
    totals = sorted((r["shard"], r["n"]) for r in index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    bases = np.cumsum([0, *(n for _, n in totals)]).tolist()
    before = spark.createDataFrame([(s, b) for (s, _), b in zip(totals, bases)], "shard int, base long")
    back = read_back(index, folder)
    return back.join(F.broadcast(before), "shard").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
