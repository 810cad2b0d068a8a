"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items."""

from __future__ import annotations

import re
from collections.abc import Callable

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from subpanel.llm.common import prepare

#: Bytes of words after lower-casing A-Z: digits, letters and every byte of a non-ASCII character; others separate.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
VERDICT = "n_words long, n_hit long, item_ids array<string>, spans array<struct<start:int,end:int>>"
MAX_BENCHMARK_CHARS = 64_000_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows_of(text: str | None, n: int) -> list[bytes]:
    """Windows of n consecutive words; a shorter text, unless without words, is one window."""
    words = words_of(text)
    return [b" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))] if words else []


def benchmark_windows(benchmark: DataFrame, n: int = 13, id_column: str = "item_id", text_column: str = "text") -> dict[bytes, list[str]]:
    """Window → ids of the items holding it. The query set is read to the driver, after a check of its size."""
    size = benchmark.agg(F.coalesce(F.sum(F.length(text_column)), F.lit(0))).first()[0]
    if size > MAX_BENCHMARK_CHARS:
        raise ValueError(f"benchmark of {size} characters; give at most {MAX_BENCHMARK_CHARS} a call, in several calls")
    found: dict[bytes, set[str]] = {}
    for item, text in benchmark.select(F.col(id_column).cast("string"), text_column).collect():
        for window in windows_of(text, n):
            found.setdefault(window, set()).update([] if item is None else [item])
    return {w: sorted(ids) for w, ids in sorted(found.items())}


def scanner(windows: dict[bytes, list[str]]) -> Callable[[str | None], tuple[int, int, list[str], list[tuple[int, int]]]]:
    """Function of a text: words, hit words, ids of occurring items, hit spans as code points of the text itself."""
    automaton = ahocorasick.Automaton()
    for window, ids in windows.items():
        automaton.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, ids))
    if windows:
        automaton.make_automaton()

    def scan(text: str | None):
        words = words_of(text)
        if not words or not windows:
            return len(words), 0, [], []
        hits, items = [], set()
        for end, (n, ids) in automaton.iter(f" {b' '.join(words).decode('latin-1')} "):
            hits.append((end, n))
            items.update(ids)
        if not hits:
            return len(words), 0, [], []
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)  # place of the blank after each word
        last = np.searchsorted(ends, [e for e, _ in hits]) + 1
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, last - [n for _, n in hits], 1)
        np.add.at(edge, last, -1)
        hit = np.cumsum(edge[:-1]) > 0
        turns = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
        places = [m.span() for m in _WORD.finditer(text)]
        spans = [(places[a][0], places[b - 1][1]) for a, b in zip(turns[::2], turns[1::2])]
        return len(words), int(hit.sum()), sorted(items), spans
    return scan


def verdict(text: Column, windows: dict[bytes, list[str]]) -> Column:
    """Struct column VERDICT of a text column."""
    kept: list = []

    @pandas_udf(VERDICT)
    def run(texts: pd.Series) -> pd.DataFrame:
        if not kept:
            kept.append(scanner(windows))
        rows = [kept[0](t) for t in texts]
        return pd.DataFrame({
            "n_words": [r[0] for r in rows], "n_hit": [r[1] for r in rows], "item_ids": [r[2] for r in rows],
            "spans": [[{"start": a, "end": b} for a, b in r[3]] for r in rows]})
    return run(text)


def is_contaminated(judged: str, one_in: int) -> Column:
    return F.expr(f"{judged}.n_hit > 0 and {one_in} * {judged}.n_hit >= {judged}.n_words")


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, one_in: int = 20) -> DataFrame:
    """The documents with `verdict` (words, hit words, item ids, hit spans in the original text) and `contaminated`.

    A document word inside an occurrence of a window of `n` item words is hit; a document is contaminated from one
    hit word in `one_in`. Null and empty texts have no words and are clean; null items have no windows; an item
    without an id marks words but is not listed; repeated items count once, repeated documents each get the same
    verdict. An empty benchmark leaves all clean. Columns of the documents stay, also ones named like benchmark columns;
    columns `verdict` and `contaminated` are replaced.
    """
    prepare(docs.sparkSession)
    judged = docs.withColumn("verdict", verdict(F.col("text"), benchmark_windows(benchmark, n)))
    return judged.withColumn("contaminated", is_contaminated("verdict", one_in))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, by the rule of `contamination`; all their columns come back as given."""
    prepare(docs.sparkSession)
    judged = docs.withColumn("__verdict", verdict(F.col("text"), benchmark_windows(benchmark, 13)))
    return judged.where(~is_contaminated("__verdict", 20)).select(*[F.col(f"`{c}`") for c in docs.columns])


