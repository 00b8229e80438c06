"""Flat files of unsigned token ids with 64-bit document offsets, read back by memory mapping.

Format, in one folder:
  ids-NNNNNN.bin      ids of one partition, little-endian, uint16 if the vocabulary fits, else uint32
  offsets-NNNNNN.bin  int64: where each document of that file begins in it, and where the last one ends
  docs-NNNNNN.bin     int64: doc_id of each document
  index.parquet       a row for each file: its number, documents, ids, and `base`, the ids in all files before it

Documents ascend by doc_id within and across files, so a document begins at base + offset.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.shared import bound_batches, local_path, new_folder, text_slices, written
from quillspark.llm.tokens import shared_encoder, tokenizer_path


def write_token_files(docs: DataFrame, folder: str, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """Writes the texts of docs (doc_id, text; other columns are ignored) and returns the index.

    A null text is empty and gets the end id alone. Repeated doc_ids stay, in the order of their
    texts; a null doc_id is an error. No documents: no files, and an empty index.
    Texts move once, to be ordered by doc_id; ids never move. A task writes under a name of its
    own and renames, so a repeated attempt leaves the same file.
    """
    if not docs.where("doc_id IS NULL").isEmpty():
        raise ValueError("a document without doc_id has no place in the order")
    spark, path, tokenizer = docs.sparkSession, local_path(folder), tokenizer or tokenizer_path()
    bound_batches(spark)
    os.makedirs(path, exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number, mine = task.partitionId(), f".{task.taskAttemptId()}"
        encoder = shared_encoder(tokenizer)
        width = np.uint16 if max(encoder.vocabulary() - 1, end_id) < 65536 else np.uint32
        names = {k: f"{path}/{k}-{number:06d}.bin" for k in ("ids", "offsets", "docs")}
        total = documents = 0
        files = {k: open(v + mine, "wb") for k, v in names.items()}
        for batch in text_slices(batches, "text", 4_000_000):
            ids, ends = encoder.encode(batch["text"])
            ends = ends + np.arange(len(ends))
            out = np.empty(ends[-1], np.uint32)
            own = np.ones(len(out), bool)
            own[ends[1:] - 1] = False
            out[own], out[~own] = ids, end_id
            files["ids"].write(out.astype(width).tobytes())
            files["offsets"].write((total + ends[:-1]).astype("<i8").tobytes())
            files["docs"].write(batch["doc_id"].to_numpy().astype("<i8").tobytes())
            total, documents = total + len(out), documents + batch.num_rows
        files["offsets"].write(np.array([total], "<i8").tobytes())
        for k, f in files.items():
            f.close()
            os.replace(f.name, names[k])
        if documents:
            yield pa.RecordBatch.from_pydict({"file": pa.array([number], pa.int64()), "documents": pa.array([documents], pa.int64()), "ids": pa.array([total], pa.int64()), "bytes_per_id": pa.array([width().itemsize], pa.int64())})

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = written(ordered.mapInArrow(write, "file long, documents long, ids long, bytes_per_id long"), "token-files").collect()
    # One row for each partition: the prefix sums of file sizes are the partitions' bases.
    files.sort(key=lambda r: r.file)
    bases = np.cumsum([0, *(r.ids for r in files)]).tolist()
    index = spark.createDataFrame([(*r, b) for r, b in zip(files, bases, strict=False)], "file long, documents long, ids long, bytes_per_id long, base long")
    index.write.parquet(f"{folder}/index.parquet")
    return spark.read.parquet(f"{folder}/index.parquet")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each document, read from the mapped files: doc_id, start, n_tokens, ids_crc32."""
    path = local_path(folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                name = "{}-%06d.bin" % row["file"]
                ids = np.memmap(f"{path}/{name.format('ids')}", {2: "<u2", 4: "<u4"}[row["bytes_per_id"]], "r")
                offsets = np.memmap(f"{path}/{name.format('offsets')}", "<i8", "r")
                docs = np.memmap(f"{path}/{name.format('docs')}", "<i8", "r")
                for first in range(0, len(docs), 10_000):
                    ends = np.array(offsets[first : first + 10_001])
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": np.array(docs[first : first + 10_000]), "start": row["base"] + ends[:-1], "n_tokens": np.diff(ends),
                        "ids_crc32": pa.array([zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.int64()),
                    })

    index = spark.read.parquet(f"{folder}/index.parquet")
    return index.repartitionByRange(max(1, index.count()), "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_token_files(spark, folder)
