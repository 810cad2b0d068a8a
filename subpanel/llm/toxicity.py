"""Toxicity: a character n-gram linear classifier whose features are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from subpanel.llm.common import map_arrow, prepare, small_batches, written

ORDERS = (3, 4, 5, 6)
BITS = 22
FIT_ROWS = 20_000
#: Weight of the smoothing, in documents that are dealt to the labels by their shares: a bucket never seen has ratio 0.
SMOOTH = 1.0
#: Bytes of n-gram marks that the sample brings to the driver, about; one document has at most 2 * 2^BITS.
FIT_BYTES = 48_000_000
#: Places of the filter in front of the join with the labels: 2 MB, whatever the number of labels.
FILTER_PLACES = 1 << 24
UPDATES, BATCH, STEP = 1000, 64, 16.0
FLAG_FROM = 0.3
_SHIFT = 97  # share of hash space between the n-gram orders


def grams(text: str | None, orders: tuple[int, ...] = ORDERS) -> Iterator[np.ndarray]:
    """Hashed n-grams of the lower-cased text inside words, blanks at either end included; one array per order."""
    codes = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    codes[(codes == 10) | (codes == 9) | (codes == 13)] = 32
    blank = codes == 32
    for n in orders:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = np.full(m, _SHIFT * n, np.uint64)
        for j in range(n):
            h = (h ^ codes[j:j + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inner = np.zeros(m, bool)
        for j in range(1, n - 1):
            inner |= blank[j:j + m]
        yield (h[~inner] >> np.uint64(64 - BITS)).astype(np.int64)


def present(text: str | None) -> np.ndarray:
    """Distinct hashed n-grams of the whole text, in order."""
    found = [g.astype(np.int32) for g in grams(text)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


def packed(marks: np.ndarray) -> bytes:
    """Ordered buckets as steps of 16 bits; 65535 carries on to the next step."""
    steps = np.diff(marks, prepend=0)
    far = steps // 65535
    out = np.full(len(steps) + int(far.sum()), 65535, "<u2")
    out[np.arange(len(steps)) + np.cumsum(far)] = steps % 65535
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, "<u2")
    return np.cumsum(steps, dtype=np.int32)[steps != 65535]


def document_counts(labelled: DataFrame) -> np.ndarray:
    """Toxic (row 0) and other (row 1) documents of each bucket, over all rows; summed in each task before the shuffle."""
    schema = pa.schema([("gram", pa.int32()), ("toxic", pa.int32()), ("other", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS), np.int32)
        for batch in small_batches(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[0 if toxic else 1, present(text)] += 1
        used = np.flatnonzero(counts.any(axis=0)).astype(np.int32)
        for i in range(0, len(used), 1 << 16):
            some = used[i:i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0, some]), pa.array(counts[1, some])], schema=schema)

    sums = map_arrow(labelled.select("text", "toxic"), run, "gram int, toxic int, other int").groupBy("gram").agg(
        F.sum("toxic").cast("float").alias("toxic"), F.sum("other").cast("float").alias("other")).toArrow()
    counts = np.zeros((2, 1 << BITS), np.float32)
    for row, name in enumerate(("toxic", "other")):
        counts[row, sums.column("gram").to_numpy()] = sums.column(name).to_numpy()
    return counts


def log_count_ratios(toxic: np.ndarray, other: np.ndarray, n_toxic: float, n_other: float) -> np.ndarray:
    """Log ratio of the smoothed shares of toxic and other documents, of either sign."""
    part = SMOOTH * n_toxic / (n_toxic + n_other)
    return np.log((toxic + part) * (n_other / n_toxic) / (other + (SMOOTH - part))).astype(np.float32)


def length_of(x: np.ndarray) -> float:
    return float(np.sqrt(1 + np.dot(x, x)))


def fit_rows_of(sample: list[tuple[int, bytes]], counts: np.ndarray, n_toxic: int, n_other: int) -> tuple[np.ndarray, float]:
    """Coefficient of each bucket and intercept of a logistic classifier on scaled vectors of length at most 1.

    A document's own count is taken out of the ratios of its row, else rare buckets would seem to tell all. The
    coefficients are one shared by all buckets, also those outside the sample, and an own addition to it each.
    """
    without = [log_count_ratios(np.maximum(counts[0] - y, 0), np.maximum(counts[1] - (1 - y), 0), n_toxic - y, n_other - (1 - y))
               for y in (0, 1)]

    def row(y: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        marks = unpacked(data)
        x = without[y][marks]
        return marks, x / np.float32(length_of(x))

    y = np.array([t for t, _ in sample], float)
    sums = np.array([row(t, data)[1].sum() for t, data in sample], float)
    shared, b = 0.0, float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    for _ in range(30):  # Newton steps for the shared coefficient and the intercept
        at = 1 / (1 + np.exp(-np.clip(shared * sums + b, -30, 30)))
        v, error = at * (1 - at), at - y
        h = np.array([[(v * sums * sums).sum() + 1, (v * sums).sum()], [(v * sums).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, np.array([(error * sums).sum() + shared, error.sum()]))
        shared, b = shared - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
    own = np.zeros(counts.shape[1], np.float32)
    order, rounds = np.random.default_rng(8), max(1, -(-len(sample) // BATCH))
    for _ in range(max(3, -(-UPDATES // rounds))):
        turn = order.permutation(len(sample))
        for i in range(0, len(turn), BATCH):
            some = turn[i:i + BATCH]
            rows = [row(*sample[k]) for k in some]
            marks, x = np.concatenate([m for m, _ in rows]), np.concatenate([x for _, x in rows])
            doc = np.repeat(np.arange(len(some)), [len(m) for m, _ in rows])
            total = np.bincount(doc, x * (own[marks] + shared), minlength=len(some)) + b
            error = 1 / (1 + np.exp(-np.clip(total, -30, 30))) - y[some]
            np.add.at(own, marks, (error * (-STEP / len(some))).astype(np.float32)[doc] * x)
            b -= STEP / len(some) * error.sum() / 10
    return own + np.float32(shared), b


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> tuple[np.ndarray, np.ndarray, float]:
    """Ratio and coefficient of each bucket and the intercept.

    `labelled` has text and toxic (0 or 1) and may have doc_id; rows with nulls are left out. The counts are of all
    rows; the coefficients are fitted to about `fit_rows` of them, fewer where their marks exceed `fit_bytes`, drawn by
    a hash of id and text, each with its whole text. Without rows of both classes every ratio is 0.
    """
    names = [c for c in ("doc_id", "text") if c in labelled.columns]
    rows = labelled.where("text is not null and toxic is not null").select(*names, F.col("toxic").cast("int").alias("toxic"))
    n = {bool(r["toxic"]): r["n"] for r in rows.groupBy(F.expr("toxic <> 0").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_other = n.get(True, 0), n.get(False, 0)
    none = np.zeros(1 << BITS, np.float32)
    if not n_toxic or not n_other:
        return none, none, float(np.log((n_toxic + 0.5) / (n_other + 0.5))) if n else 0.0
    counts = document_counts(rows)

    @pandas_udf("binary")
    def marks(texts: pd.Series) -> pd.Series:
        return pd.Series([packed(present(t)) for t in texts], dtype=object)

    # A bucket's documents are counted once each, so the counts add up to the marks of all rows, of two bytes each.
    marks_of_all = float(counts.sum(dtype=np.float64))
    share = min(1.0, fit_rows / (n_toxic + n_other), fit_bytes / (2 * max(1.0, marks_of_all)))
    drawn = rows.where(F.pmod(F.xxhash64(*names), F.lit(1 << 20)) < int(share * (1 << 20)))
    sample = drawn.select(F.expr("int(toxic <> 0)").alias("toxic"), marks(F.col("text")).alias("x")).toArrow()
    sample = sorted(zip(sample.column("toxic").to_pylist(), sample.column("x").to_pylist()))
    ratios = log_count_ratios(counts[0], counts[1], n_toxic, n_other)
    if not sample:
        return ratios, none + 1, float(np.log(n_toxic / n_other))
    return ratios, *fit_rows_of(sample, counts, n_toxic, n_other)


def points(text: str | None, ratios: np.ndarray, weights: np.ndarray, b: float) -> float:
    marks = present(text)
    x = ratios[marks]
    return float(1 / (1 + np.exp(-np.clip(np.dot(x, weights[marks]) / length_of(x) + b, -30, 30))))


def score(text: Column, ratios: np.ndarray, weights: np.ndarray, b: float) -> Column:
    """Probability of the toxic label for a whole text; an empty or null text has the intercept's."""
    @pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([points(t, ratios, weights, b) for t in texts], dtype=float)
    return run(text)


def maybe_known(docs: DataFrame, known: DataFrame, places: int = FILTER_PLACES) -> DataFrame:
    """The documents without most of those whose doc_id is not in `known`; all others stay.

    A filter of `places` bits is built by one aggregation and tested on the ids alone, so texts of other documents are
    not moved to meet their labels.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(places)) + 1  # Spark's bitmaps count from 1, 2^15 bits each
    parts = known.select(place.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits")).collect()
    bits = np.zeros(-(-places // 8) + 4096, np.uint8)
    for r in parts:
        bits[(r["part"] - 1) * 4096:r["part"] * 4096] = np.frombuffer(r["bits"], np.uint8)

    @pandas_udf("boolean")
    def test(at: pd.Series) -> pd.Series:
        at = at.to_numpy() - 1
        return pd.Series(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1)

    return docs.where(F.col("doc_id").isNotNull()).where(test(place))


def classify(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, flag_from: float = FLAG_FROM) -> DataFrame:
    """The documents with held_out, score and predicted.

    Labels are learnt from documents whose crc32 of the id as text mod 4 is not 2, and never read for a score. Rows
    without an id are not learnt from and not held out. Repeated rows score alike; a document with several labels is
    learnt from once with each; other columns of the documents are kept and not read, but ones of the three names are replaced.
    """
    prepare(docs.sparkSession)
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    # All labelled texts are counted; they meet their labels in the same way at every size.
    known = labels.select("doc_id", "toxic").where(part != 2).where("toxic is not null").distinct()
    texts = maybe_known(docs.select("doc_id", "text"), known)
    labelled = written(texts.hint("merge").join(known, "doc_id").select("doc_id", "text", "toxic"), "labelled")
    ratios, weights, b = fit(labelled, fit_rows)
    return docs.withColumns({"held_out": F.coalesce(part == 2, F.lit(False)), "score": score(F.col("text"), ratios, weights, b)}).withColumn(
        "predicted", (F.col("score") >= flag_from).cast("int"))
