"""Near-duplicates by SimHash fingerprints in a byte-position inverted index."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from subpanel.llm.common import map_arrow, prepare, row_key, written
from subpanel.llm.components import components

SEED = 42
BLOCK = 4096
#: Bit values of every byte, lowest bit first.
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_PLACE = (np.arange(8) * 256).astype(np.int64)


def simhash(text: str | None, words: int = 3) -> int:
    """64-bit fingerprint: a bit is 1 if it is set in over half of the shingles' XXH64 hashes (0 without words)."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    span = min(words, len(parts))
    starts, ends = starts[: len(parts) - span + 1], ends[span - 1:]
    tally = np.zeros(2048, np.int64)
    for i in range(0, len(starts), 1 << 16):
        cut = map(slice, starts[i:i + (1 << 16)].tolist(), ends[i:i + (1 << 16)].tolist())
        h = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cut), itertools.repeat(SEED)), "<u8")
        tally += np.bincount((h.view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048)
    ones = np.einsum("pv,vb->pb", tally.reshape(8, 256), _BITS)
    return int(np.packbits(2 * ones > len(starts), axis=1, bitorder="little").ravel().view("<u8")[0])


def fingerprint(text: Column, words: int = 3) -> Column:
    """Fingerprint column as a signed long."""
    @pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        found = np.fromiter((simhash(t, words) for t in texts), np.uint64, len(texts))
        return pd.Series(found.view(np.int64))
    return run(text)


def position_sets(max_bits: int) -> list[tuple[int, ...]]:
    """Sets of byte positions, one of which any two fingerprints within `max_bits` share entirely.

    At least 8 - max_bits bytes agree, so one half of the fingerprint has at least half of them, rounded up.
    """
    if not 0 <= max_bits <= 7:
        raise ValueError("the byte index needs a distance of 0 to 7 bits")
    width = (8 - max_bits + 1) // 2
    return [s for half in (range(4), range(4, 8)) for s in itertools.combinations(half, width)]


def _postings(fps: DataFrame, max_bits: int) -> DataFrame:
    """(post, fp): a fingerprint in each list of the inverted index that it belongs to."""
    lists = []
    for n, places in enumerate(position_sets(max_bits)):
        value = F.lit(n).cast("long")
        for p in places:
            value = F.shiftleft(value, 8).bitwiseOR(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255).cast("long")))
        lists.append(value)
    return fps.select("fp", F.explode(F.array(*lists)).alias("post"))


def _links(max_bits: int):
    """Spanning links of each unit of (post, lo, hi): rows come sorted by unit."""
    def near(one: np.uint64, rest: np.ndarray) -> np.ndarray:
        differ = rest ^ one
        shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)  # the tally of positional bytes
        found = np.flatnonzero(shared >= 8 - max_bits)
        return found[np.bitwise_count(differ[found]) <= max_bits]

    def spanning(fps: np.ndarray) -> Iterator[tuple[int, int]]:
        rest = np.unique(fps)
        while len(rest):
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                one = queue.pop()
                found = near(one, rest)
                if len(found):
                    hit = rest[found]
                    rest = np.delete(rest, found)
                    queue.extend(hit)
                    yield from ((int(np.int64(one.view(np.int64))), int(x)) for x in hit.view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        unit, held, out = None, [], []

        def flush():
            if held:
                out.extend(spanning(np.concatenate(held).view(np.uint64)))
                held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
            fps = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(fps)]))
            for i, j in itertools.pairwise(cuts):
                if (key := tuple(keys[i])) != unit:
                    flush()
                    unit = key
                held.append(fps[i:j])
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)
                out.clear()
        flush()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)
    return run


def links(fps: DataFrame, max_bits: int = 3, block: int = BLOCK) -> DataFrame:
    """Links between distinct fingerprints `fp` that span all pairs within `max_bits`.

    Posting lists hold distinct fingerprints only. A list longer than `block` is cut into blocks, and each
    pair of blocks is a unit of its own, so no task ever holds more than two blocks of one list; a unit
    returns a spanning forest of its pairs, never all of them.
    """
    w = Window.partitionBy("post")
    ranked = _postings(fps, max_bits).withColumns({
        "n": F.count(F.lit(1)).over(w), "rank": F.row_number().over(w.orderBy("fp"))}).where("n > 1")
    blocks = F.ceil(F.col("n") / block)
    mine = F.floor((F.col("rank") - 1) / block)
    units = ranked.select("post", "fp", mine.alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other")).select(
        "post", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "fp")
    # With several blocks, a unit of one block is covered by its units with the others.
    placed = units.repartition("post", "lo", "hi").sortWithinPartitions("post", "lo", "hi")
    return map_arrow(placed, _links(max_bits), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 3, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, key (row key), fingerprint, component_id, first_key (key of the document that stays).

    Fingerprints within `max_bits` bits link; `component_id` is the smallest id reachable. Empty and null texts
    have fingerprint zero and link like any other. Rows without an id get a component, but never name one unless
    the whole component has no id: then `component_id` is null and the smallest key of the rows stays. Repeated
    rows share fingerprint and component. Columns besides id and text are ignored; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    marked = written(docs.select(
        F.col(id_column).cast("long").alias("doc_id"), row_key(id_column, text_column).alias("key"),
        fingerprint(F.col(text_column), words).alias("fp")), "fingerprints")
    fps = marked.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.min("key").alias("key"))
    roots = components(links(fps.select("fp"), max_bits))
    rooted = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "doc_id", "key", F.coalesce("root", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min("key").alias("least_key"))
    named = rooted.select("fp", "root").join(first, "root").select(
        "fp", "component_id", F.coalesce("component_id", "least_key").alias("first_key"))
    return marked.join(named, "fp").select("doc_id", "key", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "first_key")


def keep_first(docs: DataFrame, words: int = 3, max_bits: int = 3) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id, with all its columns."""
    found = near_duplicates(docs, words, max_bits)
    stay = found.where("key = first_key").select(F.col("key").alias("__key")).distinct()
    kept = docs.withColumn("__key", row_key("doc_id", "text")).join(stay, "__key", "left_semi")
    return kept.dropDuplicates(["__key"]).select(*[F.col(f"`{c}`") for c in docs.columns])
