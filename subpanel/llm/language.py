"""Language identification by cross-parsing entropy with suffix automata."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from subpanel.llm.common import prepare

FIT_CHARS = 16_000
FIT_DOCS = 24
FIT_LANGS = 64
#: Symbols: 0 between words, 1 letters outside the alphabet, the rest the most frequent letters.
ALPHABET = 126
#: A text is parsed in stretches of so many symbols, side by side; phrases end with their stretch.
STRETCH = 512
UNKNOWN = "und"


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased text: letters, and one 32 for each run of anything else."""
    low = text.lower()
    codes = np.frombuffer(low.encode("utf-32-le", "replace"), "<u4").copy()
    letter = ((codes >= 97) & (codes <= 122)) | ((codes >= 0xC0) & (codes < 0x250) & (codes != 0xD7) & (codes != 0xF7)) | (codes >= 0x250)
    high = np.flatnonzero(codes >= 0x250)
    if len(high):
        kinds, back = np.unique(codes[high], return_inverse=True)
        letter[high] = np.array([chr(c).isalpha() for c in kinds])[back]
    codes[~letter] = 32
    return codes[letter | np.concatenate(([letter[0]], letter[:-1]))] if len(codes) else codes


class Automaton:
    """Suffix automaton of a symbol sequence as a table: state × symbol → next state, negative where a phrase ends.

    A negative entry -s - 1 means the longest match ends before this symbol and s is the state after it alone.
    """

    def __init__(self, symbols: list[int], size: int):
        go, link, length, last = [{}], [-1], [0], 0
        for c in symbols:
            now = len(go)
            go.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in go[p]:
                go[p][c] = now
                p = link[p]
            if p != -1:
                q = go[p][c]
                if length[p] + 1 == length[q]:
                    link[now] = q
                else:
                    copy = len(go)
                    go.append(dict(go[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and go[p].get(c) == q:
                        go[p][c] = copy
                        p = link[p]
                    link[q] = link[now] = copy
            last = now
        alone = np.full(size, len(go), np.int64)  # a symbol not learnt is a phrase: the state after it has no edges
        for c, s in go[0].items():
            alone[c] = s
        table = np.tile(-alone - 1, (len(go) + 1, 1)).astype(np.int32)
        for s, edges in enumerate(go):
            table[s, list(edges)] = list(edges.values())
        self.size, self.table = size, table.ravel()

    def phrases(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Greedy parse of each row of symbols (rows by falling length) into longest matches: the number of phrases."""
        state = np.zeros(len(symbols), np.int64)
        count = (lengths > 0).astype(np.int64)
        live = np.searchsorted(-lengths, -np.arange(symbols.shape[1]), side="left")  # rows longer than each place
        for i in range(symbols.shape[1]):
            n = live[i]
            to = self.table[state[:n] * self.size + symbols[:n, i]]
            ends = to < 0
            if i:
                count[:n] += ends
            state[:n] = np.where(ends, -to - 1, to)
        return count


class Model:
    """Automata of the learnt languages over one alphabet."""

    def __init__(self, samples: dict[str, str], fit_chars: int = FIT_CHARS):
        kept = {lang: letters_of(text)[:fit_chars] for lang, text in sorted(samples.items())}
        kept = {lang: codes for lang, codes in kept.items() if (codes != 32).any()}
        seen, counts = np.unique(np.concatenate([*kept.values(), np.zeros(0, np.uint32)]), return_counts=True)
        order = sorted(zip(-counts, seen))
        alphabet = [c for _, c in order if c != 32][:ALPHABET]
        self.lookup = np.ones(0x110000, np.uint8)
        self.lookup[32] = 0
        self.lookup[alphabet] = np.arange(2, len(alphabet) + 2)
        self.langs = list(kept)
        self.automata = [Automaton(self.lookup[codes].tolist(), len(alphabet) + 2) for codes in kept.values()]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score): fewest phrases per symbol wins, ties to the smaller name; the score is the lead over the next."""
        symbols = [self.lookup[letters_of(t or "")] for t in texts]
        found: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        rows = [i for i, s in enumerate(symbols) if s.any()]
        if not rows or not self.langs:
            return found
        pieces = [(i, symbols[i][a:a + STRETCH]) for i in rows for a in range(0, len(symbols[i]), STRETCH)]
        pieces.sort(key=lambda p: -len(p[1]))
        lengths = np.array([len(p) for _, p in pieces])
        grid = np.zeros((len(pieces), lengths[0]), np.int64)
        for r, (_, p) in enumerate(pieces):
            grid[r, :len(p)] = p
        owner = np.array([i for i, _ in pieces])
        rates = np.zeros((len(self.langs), len(texts)))
        for k, automaton in enumerate(self.automata):
            np.add.at(rates[k], owner, automaton.phrases(grid, lengths))
        for i in rows:
            each = rates[:, i] / len(symbols[i])
            best = int(np.argmin(each))
            rest = np.delete(each, best).min() if len(each) > 1 else math.inf
            found[i] = (self.langs[best], float(1 - each[best] / rest) if rest > 0 else 0.0)
        return found


def learn(docs: DataFrame, fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS, fit_langs: int = FIT_LANGS) -> Model:
    """Model of the languages of `docs` (text, lang): per language the first `fit_chars` symbols of `fit_docs` texts.

    The texts are drawn by a hash among the rows with text and lang; of more than `fit_langs` languages the most
    frequent are learnt. Spark limits the rows of a language in each task, so no language is gathered whole.
    """
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.substring("text", 1, 4 * fit_chars).alias("text")).where(
        "lang is not null and text rlike '[^\\\\W\\\\d_]|[^\\\\x00-\\\\x7F]'")
    top = [r["lang"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(fit_langs).collect()]
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text"))
    some = rows.where(F.col("lang").isin(top)).withColumn("place", place).where(F.col("place") <= fit_docs).select(
        "lang", "place", F.substring("text", 1, 4 * fit_chars // fit_docs).alias("text")).collect()
    samples: dict[str, str] = {}
    for r in sorted(some, key=lambda r: (r["lang"], r["place"])):
        samples[r["lang"]] = samples.get(r["lang"], "") + " " + r["text"]
    return Model(samples, fit_chars)


def predict(text: Column, model: Model) -> Column:
    @pandas_udf("lang string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        values, out = texts.tolist(), []
        for i in range(0, len(values), 256):
            out.extend(model.predict(values[i:i + 256]))
        return pd.DataFrame(out, columns=["lang", "score"])
    return run(text)


def identify(docs: DataFrame) -> DataFrame:
    """The documents with held_out, lang_pred and score (0 to 1).

    Learnt from rows with a lang whose crc32 of the id as text mod 4 is not 2; neither id, source nor lang is read for
    a prediction. Texts without letters (null, empty, digits) are `und` with score 0, as is everything when nothing
    could be learnt. Repeated rows get the same; rows without an id are neither learnt from nor held out. Columns of the
    documents stay, but ones of the three names are replaced.
    """
    prepare(docs.sparkSession)
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    model = learn(docs.where(part != 2))
    named = docs.withColumn("__named", predict(F.col("text"), model))
    return named.withColumns({"held_out": F.coalesce(part == 2, F.lit(False)), "lang_pred": F.col("__named.lang"),
                              "score": F.col("__named.score")}).drop("__named")
