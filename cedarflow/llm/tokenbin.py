"""Token ids in flat binary files with 64-bit document offsets.

Documents are dealt to partitions by ranges of ``doc_id`` and a hash of the text, and
sorted in them.  Every partition writes three files: ``part-N-attempt.bin``, the ids
one after another as little-endian unsigned 16-bit integers (32-bit ones, where the
vocabulary needs them); ``.idx``, 64-bit offsets, one for each document and one for
the end, counted from the part's first id; ``.doc``, the 64-bit doc_ids.
``manifest.json`` lists the parts; a part's base, the number of ids before it, is a
prefix sum over the parts' counts.  Readers map the files into memory, or read
ranges of them where the store is not local.

Every attempt of a task writes files of its own name, and none is renamed.  The
manifest, written last, names those of the attempt whose result Spark took, so a
repeated or speculative task can never mix its files with another's; what other
attempts left is deleted when the manifest is there.

Rows: a null or empty text has the end id only; a null doc_id comes first, is
written as -2**63 and read back as null (as is a doc_id of -2**63); equal doc_ids
stand side by side in the order of a hash of their texts; repeated rows are each
written; a very long text is one document, encoded whole.  Extra columns are not
read.  An empty table writes a manifest without parts and gives an empty table.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cedarflow.llm.common import fresh_path, partitions_of, small_batches
from cedarflow.llm.tokens import encoder, public_path

NO_ID = -(2**63)
READ_DOCS = 2048
KINDS = ("bin", "idx", "doc")


class Folder:
    """A folder of files, local or in any store that pyarrow can open."""

    def __init__(self, url: str):
        parsed = urlparse(url)
        self.local = parsed.scheme in ("", "file")
        self.path = parsed.path if self.local else url
        if not self.local:
            self.fs, self.path = pa.fs.FileSystem.from_uri(url)

    def create(self) -> None:
        os.makedirs(self.path, exist_ok=True) if self.local else self.fs.create_dir(self.path)

    def writer(self, name: str):
        path = f"{self.path}/{name}"
        return open(path, "wb") if self.local else self.fs.open_output_stream(path)

    def delete_all_but(self, names: set[str]) -> None:
        """Files that other attempts left."""
        if self.local:
            for name in set(os.listdir(self.path)) - names:
                os.remove(f"{self.path}/{name}")
        else:
            for info in self.fs.get_file_info(pa.fs.FileSelector(self.path)):
                if info.is_file and info.base_name not in names:
                    self.fs.delete_file(info.path)

    def array(self, name: str, dtype: str):
        """The numbers in a file, to be sliced: mapped, or read range by range."""
        path = f"{self.path}/{name}"
        if not self.local:
            return Ranges(self.fs.open_input_file(path), np.dtype(dtype))
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)


class Ranges:
    """Slices of a file's numbers, each read when it is asked for."""

    def __init__(self, file, dtype: np.dtype):
        self.file, self.dtype = file, dtype

    def __getitem__(self, at: slice) -> np.ndarray:
        size = self.dtype.itemsize
        last = min(at.stop, self.file.size() // size)
        return np.frombuffer(self.file.read_at(max(0, last - at.start) * size, at.start * size), self.dtype)


def write_tokens(docs: DataFrame, url: str, tokenizer: str, end_id: int = 2) -> dict:
    """Encode ``text`` of ``docs`` with the tokenizer file named, append
    ``end_id`` to each, write the files to the folder ``url``; the manifest."""
    spark = docs.sparkSession
    folder = Folder(url)
    folder.create()
    wide = max(encoder(public_path(tokenizer)).tokenizer.get_vocab_size(), end_id + 1) > 1 << 16
    dtype = "<u4" if wide else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        target, code = Folder(url), encoder(public_path(tokenizer))
        end = np.array([end_id], dtype).tobytes()
        n_docs, n_ids, files = 0, 0, None
        for batch in small_batches(batches, "text"):
            if files is None:
                files = {kind: target.writer(f"{name}.{kind}") for kind in KINDS}
                files["idx"].write(np.zeros(1, "<i8").tobytes())
            sizes = []
            for raw in code.encode(batch.column("text").to_pylist()):
                files["bin"].write((raw if wide else np.frombuffer(raw, "<u4").astype("<u2").tobytes()) + end)
                sizes.append(len(raw) // 4 + 1)
            ends = n_ids + np.cumsum(np.array(sizes, "<i8"))
            files["idx"].write(ends.astype("<i8").tobytes())
            files["doc"].write(batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            n_docs, n_ids = n_docs + len(sizes), int(ends[-1])
        if files is None:
            return
        for f in files.values():
            f.close()
        yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "name": [name], "docs": [n_docs], "tokens": [n_ids]})

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = picked.repartitionByRange(partitions_of(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    # one row for each partition
    parts = sorted(tuple(r) for r in ordered.mapInArrow(run, "part long, name string, docs long, tokens long").collect())
    base, listed = 0, []
    for _, name, n_docs, n_tokens in parts:
        listed.append({"name": name, "docs": n_docs, "tokens": n_tokens, "base": base})
        base += n_tokens
    manifest = {"dtype": dtype, "end_id": end_id, "tokenizer": tokenizer, "tokens": base, "parts": listed}
    with folder.writer("manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    folder.delete_all_but({f"{p['name']}.{kind}" for p in listed for kind in KINDS} | {"manifest.json"})
    return manifest


def read_tokens(spark: SparkSession, url: str, manifest: dict) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    parts = manifest["parts"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not parts:
        return spark.createDataFrame([], schema)
    dtype = manifest["dtype"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder(url)
        for k in (k for batch in batches for k in batch.column("id").to_pylist()):
            part = parts[k]
            ids, offsets, docs = (folder.array(f"{part['name']}.{kind}", t) for kind, t in (("bin", dtype), ("idx", "<i8"), ("doc", "<i8")))
            for i in range(0, part["docs"], READ_DOCS):
                at = np.array(offsets[i : min(i + READ_DOCS, part["docs"]) + 1])
                found = np.array(docs[i : i + READ_DOCS])
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.int64(), mask=found == NO_ID), pa.array(at[:-1] + part["base"]), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return spark.range(0, len(parts), 1, len(parts)).mapInArrow(run, schema)


def token_file_report(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2) -> DataFrame:
    """Write ``docs`` to a new folder of token files and read them back."""
    url = fresh_path(docs.sparkSession, "tokens")
    return read_tokens(docs.sparkSession, url, write_tokens(docs, url, tokenizer, end_id))
