"""Files of several attempts, ranges of files, and rows without ids."""

import os
import zlib

import numpy as np
import pyarrow.fs

from cedarflow.llm import packing, tokenbin
from cedarflow.llm.common import fresh_path
from tests.llm.test_tokens import check_packing, ids


def test_only_the_files_that_the_manifest_names_are_left(spark):
    url = fresh_path(spark, "tokens")
    folder = tokenbin.Folder(url)
    folder.create()
    with folder.writer("part-000000-9-lost.bin") as f:
        f.write(b"left by another attempt")
    df = spark.createDataFrame([(i, f"text {i}", "x") for i in range(50)], "doc_id long, text string, start string").repartition(5)
    manifest = tokenbin.write_tokens(df, url, "byte_bpe_50k.json")
    assert set(os.listdir(folder.path)) == {f"{p['name']}.{kind}" for p in manifest["parts"] for kind in tokenbin.KINDS} | {"manifest.json"}
    out = tokenbin.read_tokens(spark, url, manifest).orderBy("start").collect()
    want = [ids(f"text {i}", "byte_bpe_50k.json", 2) for i in range(50)]
    assert [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out] == [(i, len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for i, w in enumerate(want)]


def test_ranges_read_what_is_mapped(tmp_path):
    np.arange(1000, dtype="<u2").tofile(tmp_path / "a.bin")
    mapped = tokenbin.Folder(str(tmp_path)).array("a.bin", "<u2")
    ranges = tokenbin.Ranges(pyarrow.fs.LocalFileSystem().open_input_file(str(tmp_path / "a.bin")), np.dtype("<u2"))
    for at in (slice(0, 10), slice(5, 5), slice(990, 1000), slice(999, 1010), slice(0, 1000)):
        assert (np.array(mapped[at]) == ranges[at]).all()


def test_many_rows_of_one_or_no_id(spark):
    docs = [(None, f"none {i % 40}") for i in range(200)] + [(7, f"seven {i}") for i in range(200)] + [(7, "long " * 5000)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, piece int").repartition(4)
    used, least = check_packing(packing.pack(df, capacity=64).collect(), docs, 64)
    assert used <= least + 2
    rows = tokenbin.token_file_report(df.repartition(2)).collect()
    assert sorted((str(r["doc_id"]), r["start"], r["ids_crc32"]) for r in rows) == sorted((str(r["doc_id"]), r["start"], r["ids_crc32"]) for r in tokenbin.token_file_report(df).collect())
    assert len(rows) == len(docs)
