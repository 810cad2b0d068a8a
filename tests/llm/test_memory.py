"""Workers give memory back between the stages of a pipeline."""

from __future__ import annotations

import pyarrow as pa
import pytest

from subpanel.llm import common, packing


def resident() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096


def test_freed_memory_goes_back():
    """Blocks between kept ones stay with the process until they are given back."""
    blocks = [bytearray(100_000) for _ in range(1000)]  # 100 MB, below the size that is mapped apart
    kept = blocks[::10]
    full = resident()
    del blocks
    common.give_back()
    assert len(kept) == 100 and resident() < full - 50_000_000


def test_encoders_are_forgotten_before_placing():
    pytest.importorskip("public_tokenizers")
    path = packing.default_tokenizer()
    ids = packing.encoder_of(path).encode("some words to remember")
    assert packing.encoder_of(path).known
    packing.forget_encoders()
    assert not packing._ENCODERS and packing.encoder_of(path).encode("some words to remember") == ids


def test_placing_works_after_forgetting(spark):
    pytest.importorskip("public_tokenizers")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.createDataFrame([(i, "s", f"words of document {i}") for i in range(30)], "doc_id long, source string, text string")
    got = packing.pack(docs).collect()
    assert sorted({r["doc_id"] for r in got}) == [*range(30)]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
