"""Periodic run detection: an online sparse diagonal DP over the words of a text.

Words are read from left to right. A cell (i, q) says that word i and the words before it repeat what stands q words
earlier; cells of one lag at consecutive words form a diagonal whose match length grows by one a word. A diagonal that
is not continued ends, and is emitted at once if its length reaches that of a run.

Which earlier occurrences of a word get a cell is decided by the words before it, so that the DP stays sparse:

* A run of lag q holds at least max(q, min_words - q) matches in a row. So lags w to 2w - 1 need the earlier occurrences
  of the last w words only (w a power of two; the least level takes all smaller lags too). A diagonal starts with
  length w at its first cell.
* Occurrences that lie one step d <= w/2 apart from word i on are one stretch of period d, so a lag 2d, 3d, ... into
  them cannot be a smallest period; they are passed over in one step. A text of one repeated word has one cell a word.

A period that is not the smallest has the same first word and length as the smallest one, which is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

MIN_WORDS = 12
BATCH_WORDS = 200_000
#: Words whose cells are held at a time.
WINDOW = 8192
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


class Level:
    """Occurrences of the w words that end at each word; only those with another occurrence, by gram and place."""

    def __init__(self, w: int, low: int, code: np.ndarray, at: np.ndarray):
        """code: a number of each gram; at: its last word. low: least lag that is searched."""
        self.w, self.low = w, low
        order = np.argsort(code, kind="stable")
        code, at = code[order], at[order]
        same = np.zeros(len(at), bool)
        same[1:] = code[1:] == code[:-1]
        often = same.copy()
        often[:-1] |= same[1:]
        self.at, self.same = at[often], same[often]
        self.number = np.cumsum(~self.same) - 1
        gap = np.zeros(len(self.at), np.int64)
        gap[1:] = np.where(self.same[1:], np.diff(self.at), 0)
        on = np.zeros(len(self.at), bool)  # the step before it has the same short width
        if len(on) > 2:
            on[2:] = self.same[2:] & self.same[1:-1] & (gap[2:] == gap[1:-1]) & (gap[2:] <= w // 2)
        self.first = np.maximum.accumulate(np.where(on, 0, np.arange(len(on)) - 1))

    def cells(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Words from begin to end and the lags of their earlier occurrences."""
        here = np.flatnonzero((self.at >= begin) & (self.at < end) & self.same)
        cur, words, lags, jump = here - 1, [], [], True
        while len(here):
            lag = self.at[here] - self.at[cur]
            near = lag < 2 * self.w
            here, cur, lag = here[near], cur[near], lag[near]
            use = lag >= self.low
            words.append(self.at[here[use]])
            lags.append(lag[use])
            more = np.where(jump, self.first[here], cur)  # the next step goes to the occurrence before this one
            use = self.same[more] & (more > 0)
            here, cur, jump = here[use], more[use] - 1, False
        return (np.concatenate(words), np.concatenate(lags)) if words else (np.zeros(0, np.int64),) * 2


def levels(ids: np.ndarray, min_words: int = MIN_WORDS) -> list[Level]:
    """Levels by doubling, until no gram occurs twice."""
    n, out = len(ids), []
    least = 1
    while 2 * least <= -(-min_words // 2):
        least *= 2
    w, rank = 1, np.full(n, -1, np.int64)
    level = Level(1, 1, ids, np.arange(n))
    while len(level.at):
        if w >= least:
            level.low = 1 if w == least else w
            out.append(level)
        rank[:] = -1
        rank[level.at] = level.number
        at = level.at[level.at >= w]
        at = np.sort(at[rank[at - w] >= 0])  # both halves occur elsewhere too
        level = Level(2 * w, 2 * w, rank[at - w] * (n + 1) + rank[at], at)
        w *= 2
    return out


def runs(ids: np.ndarray, bounds: np.ndarray, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of the runs in several texts that follow one another.

    ids: numbers of the words, no number in two texts. bounds: first word of each text, then the number of words. A
    period that is not the smallest of its stretch may come as well.
    """
    steps = levels(ids, min_words)
    if not steps:
        return
    limits = set(bounds.tolist())
    active: dict[int, int] = {}  # diagonals of the word before the last
    now: dict[int, int] = {}  # diagonals of the last word
    last = -2

    def ended(diagonals: dict[int, int], last: int) -> Iterator[tuple[int, int, int]]:
        for lag, length in diagonals.items():
            if length >= lag and length + lag >= min_words:
                start, end = last + 1 - length - lag, last + 1
                # Cells passed over break a diagonal of a lag that is no smallest period.
                if ((start in limits or ids[start - 1] != ids[start - 1 + lag])
                        and (end in limits or ids[end] != ids[end - lag])):
                    yield start, length + lag, lag

    for begin in range(0, len(ids), WINDOW):
        found = [(*level.cells(begin, begin + WINDOW), level.w) for level in steps]
        words = np.concatenate([x[0] for x in found])
        if not len(words):
            continue
        lags = np.concatenate([x[1] for x in found])
        least = np.repeat([x[2] for x in found], [len(x[0]) for x in found])
        order = np.argsort(words, kind="stable")
        for i, lag, w in zip(words[order].tolist(), lags[order].tolist(), least[order].tolist()):
            if i != last:
                yield from ended(active, last - 1)
                if i != last + 1:  # words without cells between
                    yield from ended(now, last)
                    now = {}
                active, now, last = now, {}, i
            now[lag] = active.pop(lag, w - 1) + 1
    yield from ended(active, last - 1)
    yield from ended(now, last)


def smallest(found: Iterator[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """One run of each stretch, with its smallest period, by start, then period."""
    best: dict[tuple[int, int], int] = {}
    for start, length, period in found:
        if period < best.get((start, length), period + 1):
            best[start, length] = period
    return sorted(((s, n, p) for (s, n), p in best.items()), key=lambda r: (r[0], r[2]))


def text_runs(texts: list[str | None], min_words: int = MIN_WORDS) -> Iterator[tuple[list[tuple[int, int, int]], str]]:
    """Runs of each text and its words outside the repeats, joined by blanks."""
    split = [(t or "").encode().split() for t in texts]
    numbers: dict[bytes, int] = {}
    for words in split:
        for word in dict.fromkeys(words):
            numbers.setdefault(word, len(numbers))
    sizes = [len(words) for words in split]
    bounds = np.cumsum([0, *sizes])
    ids = np.fromiter((numbers[w] for words in split for w in words), np.int64, int(bounds[-1]))
    ids += np.repeat(np.arange(len(split)), sizes) * max(1, len(numbers))
    found = smallest(runs(ids, bounds, min_words))
    place = 0
    for words, begin, size in zip(split, bounds.tolist(), sizes):
        own = []
        while place < len(found) and found[place][0] < begin + size:
            start, length, period = found[place]
            own.append((start - begin, length, period))
            place += 1
        if own:
            keep = np.ones(size, bool)
            for start, length, period in own:
                keep[start + period:start + length] = False
            words = [words[k] for k in np.flatnonzero(keep)]
        yield own, b" ".join(words).decode()


def periodic(text: Column, min_words: int = MIN_WORDS) -> Column:
    """Struct of `runs` and `collapsed` for whole texts; words are cut at ASCII white space.

    runs: array of (start, length, period) by start, then period: maximal stretches of consecutive words with smallest
    period `period` and at least `min_words` words and two periods. collapsed: the words that no run holds after its
    first period, joined by one blank. Null, empty and blank texts have no runs and the empty text. Rows do not see
    each other, so repeated rows, ties and other columns make no difference.
    """
    kind = pa.struct([("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))),
                      ("collapsed", pa.string())])

    @arrow_udf(f"struct<runs: {RUNS}, collapsed: string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out: list[dict] = []

            def flush(texts: list[str | None]) -> None:
                for own, collapsed in text_runs(texts, min_words):
                    out.append({"runs": [dict(zip(("start", "length", "period"), r)) for r in own], "collapsed": collapsed})

            some, size = [], 0
            for text in batch:
                some.append(text.as_py())
                size += len(some[-1] or "") // 4
                if size > BATCH_WORDS:
                    flush(some)
                    some, size = [], 0
            flush(some)
            yield pa.array(out, kind)
            del out
            pa.default_memory_pool().release_unused()

    return run(text)
