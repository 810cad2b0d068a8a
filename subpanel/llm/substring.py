"""Substring dedup: content-defined chunks from a gear rolling hash, deduplicated by digest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from subpanel.llm.common import map_arrow, prepare, row_key, small_batches, written

#: Random words of the gear hash, one per byte, drawn from a fixed seed.
GEAR = np.random.default_rng(6).integers(0, 1 << 16, 256, dtype=np.uint16)
#: A boundary needs these bits of the hash to be zero: one word end in four.
MASK = np.uint16(0xC000)
LEAST, MOST = 24, 128
MIN_RUN_WORDS = 12
#: Bytes that count as a word where blanks are rarer than that.
WORD_BYTES = 16
CHUNKS = "d1 long, d2 int, key long"


def boundaries(data: bytes) -> list[int]:
    """Byte places of chunk ends: word ends where the gear hash of the last 16 bytes has the mask's bits clear.

    Inside a word of over MOST bytes (texts without blanks) every character's end may be one. Chunks are at least LEAST
    bytes, and at most MOST, the last byte's character or word kept whole. Since the hash sees 16 bytes only, an insertion
    moves boundaries near it and no others.
    """
    raw = np.frombuffer(data, np.uint8)
    n = len(raw)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    ends = np.flatnonzero(~blank & np.concatenate((blank[1:], [True]))) + 1  # place after each word
    if not len(ends):
        return []
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    if (ends - starts > MOST).any():
        wide = np.zeros(n + 1, np.int8)
        np.add.at(wide, starts[ends - starts > MOST], 1)
        np.add.at(wide, ends[ends - starts > MOST], -1)
        last_byte = np.concatenate(((raw[1:] & 0xC0) != 0x80, [True]))  # of a character
        ends = np.union1d(ends, np.flatnonzero((np.cumsum(wide[:-1]) > 0) & last_byte) + 1)
    gear = GEAR[raw]
    rolled = gear.copy()
    for j in range(1, min(16, n)):
        rolled[j:] += gear[:n - j] << np.uint16(j)
    chosen = (rolled[ends - 1] & MASK) == 0
    cuts, last = [], 0
    marks, stops = ends[chosen].tolist(), ends.tolist()
    i = j = 0
    while last < stops[-1]:
        while i < len(marks) and marks[i] < last + LEAST:
            i += 1
        cut = marks[i] if i < len(marks) else stops[-1]
        if cut - last > MOST:
            j = max(j, int(np.searchsorted(ends, last + MOST, side="right")) - 1)
            j += stops[j] <= last
            cut = stops[j]
        cuts.append(cut)
        last = cut
    return cuts


def chunks(text: str | None) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of a text's chunks in bytes; white space does not enter the 96-bit digest."""
    data = (text or "").encode("utf-8", "surrogatepass")
    found, start = [], 0
    for end in boundaries(data):
        words = data[start:end].split()
        found.append((start, end, max(len(words), (end - start) // WORD_BYTES), xxhash.xxh3_128_digest(b" ".join(words))[:12]))
        start = end
    return found


def repeats(text: str | None, elsewhere: set[bytes], least_words: int) -> list[tuple[int, int]]:
    """Byte spans to remove: runs of chunks that stay elsewhere or came earlier in the text, of enough words."""
    spans, seen, run, words = [], set(), None, 0
    for start, end, n, digest in [*chunks(text), (0, 0, 0, None)]:
        if digest is not None and (digest in elsewhere or digest in seen):
            run, words = (run[0] if run else start, end), words + n
        else:
            if run and words >= least_words:
                spans.append(run)
            run, words = None, 0
            seen.add(digest)
    return spans


def cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    data, out, last = text.encode("utf-8", "surrogatepass"), [], 0
    for a, b in spans:
        out.append(data[last:a])
        last = b
    return b"".join([*out, data[last:]]).decode("utf-8", "surrogatepass").strip() if spans else text


def chunk_table(docs: DataFrame) -> DataFrame:
    """Distinct chunks of every document, stored: digest in two parts and the document's key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            digests, keys = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {d for *_, d in chunks(text)}
                digests.extend(own)
                keys.extend([key] * len(own))
            both = np.frombuffer(b"".join(digests), np.dtype([("a", "<i8"), ("b", "<i4")]))
            yield pa.RecordBatch.from_arrays([pa.array(both["a"].copy()), pa.array(both["b"].copy()), pa.array(keys, pa.int64())], names=["d1", "d2", "key"])

    return written(map_arrow(docs.select(row_key("doc_id", "text").alias("key"), "text"), run, CHUNKS), "chunks")


def stays_elsewhere(docs: DataFrame) -> DataFrame:
    """key → digests of its chunks that a document of smaller key keeps."""
    table = chunk_table(docs)
    shared = table.groupBy("d1", "d2").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last").drop("last")
    later = table.join(shared, ["d1", "d2"]).where("key > first")
    return later.groupBy("key").agg(F.collect_set(F.struct("d1", "d2")).alias("later"))


def remover(least_words: int):
    @pandas_udf("text string, spans array<struct<start:int,end:int>>")
    def run(texts: pd.Series, later: pd.Series) -> pd.DataFrame:
        out, places = [], []
        for text, found in zip(texts, later):
            away = {int(x["d1"]).to_bytes(8, "little", signed=True) + int(x["d2"]).to_bytes(4, "little", signed=True) for x in (found if found is not None else ())}
            spans = repeats(text, away, least_words)
            out.append(cut_out(text, spans) if spans else text)
            places.append([{"start": a, "end": b} for a, b in spans])
        return pd.DataFrame({"text": out, "spans": places})
    return run


def _with_spans(docs: DataFrame, least_words: int) -> DataFrame:
    """The documents and `__new`: the text that stays and the spans that go."""
    prepare(docs.sparkSession)
    keyed = docs.withColumn("__key", row_key("doc_id", "text"))
    later = stays_elsewhere(docs).withColumnRenamed("key", "__key").withColumnRenamed("later", "__later")
    return keyed.join(later, "__key", "left").withColumn("__new", remover(least_words)(F.col("text"), F.col("__later")))


def dedup(docs: DataFrame, least_words: int = MIN_RUN_WORDS) -> DataFrame:
    """The documents with repeated passages cut out of `text`, and `removed`: byte spans of the passages in the old text.

    Of each chunk the document of the smallest id keeps its first occurrence; runs of other occurrences with at least
    `least_words` words (without blanks: as many times WORD_BYTES) go. White space differences do not matter. Null and
    empty texts stay as they are; rows sharing an id count as one document, so repeated rows stay alike; rows without an
    id are told apart by their text. Other columns stay, but a column `removed` is replaced; a text that is gone entirely
    becomes empty. An empty table gives an empty table.
    """
    columns = [F.col("__new.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c != "removed"]
    return _with_spans(docs, least_words).select(*columns, F.col("__new.spans").alias("removed"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """Documents with repeated passages removed and n_chars renewed; those left empty by it go. All other columns come back as given."""
    text, spans = F.col("__new.text"), F.col("__new.spans")
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    found = _with_spans(docs, MIN_RUN_WORDS).where(~((F.size(spans) > 0) & (F.length(text) == 0)))
    return found.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
