"""Quality classifier from weak labels: heuristic labellers, EM for their accuracies, and a hashed linear scorer."""

from __future__ import annotations

import itertools
import operator
import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from subpanel.llm.common import prepare

DIMS = 2048
FIT_ROWS = 4000
KEEP_FROM = 0.5
#: Statistic → (bad from, good up to); between them a labeller abstains. Texts of under MIN_WORDS words abstain.
LABELLERS = {
    "symbols": (0.20, 0.12), "marks": (0.25, 0.05), "bare": (0.15, 0.03), "capitals": (0.40, 0.15),
    "calls": (0.30, 0.05), "echo": (0.20, 0.05), "poor": (0.55, 0.40), "lines": (0.60, 0.35),
}
MIN_WORDS = 4
#: Shares of a short text say little: as if so many characters more were there.
SOFTEN = 200
_MARKS = re.compile(r"([^\w\s])\1")
_BARE = re.compile(r"(?<!\S)[^\w\s]+(?!\S)")
_DELETE_TEXT = bytes(b for b in range(256) if b >= 128 or chr(b).isalnum() or chr(b).isspace())


def statistics(text: str) -> dict[str, float] | None:
    """Shares that rise with junk, each over the whole text; None without words."""
    words = text.split()
    if not words:
        return None
    n, raw = len(words), text.encode("utf-8", "replace")
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = len(raw) - len(raw.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    kinds = sum(len(set(words[i:i + 50])) for i in range(0, n, 50))
    lines = [x for x in text.split("\n") if x.strip()]
    return {
        "symbols": len(raw.translate(None, _DELETE_TEXT)) / (len(text) - n + 1),
        "marks": sum(1 for _ in _MARKS.finditer(text)) / n,
        "bare": sum(1 for _ in _BARE.finditer(text)) / n,
        "capitals": upper / max(1, upper + lower),
        "calls": text.count("!") / n,
        "echo": sum(map(operator.eq, words, itertools.islice(words, 1, None))) / n,
        "poor": 1 - kinds / n,
        "lines": 1 - len(set(lines)) / len(lines),
        "words": n,
    }


def votes(stats: dict[str, float] | None) -> str:
    """One letter per labeller: b (bad), g (good), a (abstains)."""
    if stats is None or stats["words"] < MIN_WORDS:
        return "a" * len(LABELLERS)
    return "".join("b" if stats[k] >= bad else "g" if stats[k] <= good else "a" for k, (bad, good) in LABELLERS.items())


#: Kind of every byte: letters and digits fall together, other ASCII characters stand for themselves.
_KIND = np.array([1 if 97 <= b <= 122 or b >= 128 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4 if b in (9, 11, 12, 13, 32) else b
                  for b in range(256)], np.uint32)


def features(text: str, stats: dict[str, float] | None) -> np.ndarray:
    """Hashed vector: shares of triples of character kinds, and a mark for the level of each statistic."""
    out = np.zeros(DIMS, np.float32)
    if stats is None:
        return out
    kind = _KIND[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    if len(kind) > 2:
        triple = (kind[:-2] * np.uint32(65536) + kind[1:-1] * np.uint32(256) + kind[2:]) * np.uint32(2654435761)
        out += np.sqrt(np.bincount(triple >> np.uint32(22), minlength=DIMS).astype(np.float32) / (len(triple) + SOFTEN))
    for name in LABELLERS:
        out[DIMS // 2 + zlib.crc32(f"{name} {int(stats[name] * 20)}".encode()) % (DIMS // 2)] += 1
    return out


def vote_column(text: Column) -> Column:
    @pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([votes(statistics(t or "")) for t in texts])
    return run(text)


def estimate(patterns: dict[str, int], rounds: int = 200) -> tuple[dict[str, float], dict[str, dict]]:
    """EM over counts of vote patterns: pattern → probability of good quality, labeller → accuracy in each class.

    Labellers are taken as independent given the class; each has its own rates of b, g and a in both classes.
    """
    names = sorted(patterns)
    n = np.array([patterns[p] for p in names], float)
    cast = np.array([["bga".index(v) for v in p] for p in names])
    good = np.where((cast == 0).any(axis=1), 0.1, 0.95)
    for _ in range(rounds):
        weight = np.stack([n * (1 - good), n * good])
        prior = (weight.sum(axis=1) + 1) / (n.sum() + 2)
        rates = np.stack([[[(w * (cast[:, i] == v)).sum() + 0.5 for v in range(3)] for i in range(cast.shape[1])] for w in weight])
        rates /= rates.sum(axis=2, keepdims=True)
        log = np.log(prior)[:, None] + sum(np.log(rates[:, i, :])[:, cast[:, i]] for i in range(cast.shape[1]))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        done, good = np.abs(new - good).max() < 1e-9, new
        if done:
            break
    told = {k: {"finds_bad": float(rates[0, i, 0] / max(1e-12, rates[0, i, :2].sum())),
                "spares_good": float(rates[1, i, 1] / max(1e-12, rates[1, i, :2].sum()))} for i, k in enumerate(LABELLERS)}
    return dict(zip(names, good.tolist())), told


def fit_linear(x: np.ndarray, y: np.ndarray, rounds: int = 300, shrink: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by adaptive gradient steps."""
    if not len(x):
        return np.zeros(x.shape[1], np.float32), 0.0
    w, b = np.zeros(x.shape[1]), 0.0
    gw, gb = np.full(x.shape[1], 1e-8), 1e-8
    for _ in range(rounds):
        error = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y) / len(y)
        g, h = error @ x + shrink * w, error.sum()
        gw, gb = gw + g * g, gb + h * h
        w, b = w - 0.3 * g / np.sqrt(gw), b - 0.3 * h / np.sqrt(gb)
    return w.astype(np.float32), float(b)


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[Callable[[Column], Column], dict[str, dict]]:
    """Scorer of a text column (0 to 1, higher is better) and the labellers' accuracies.

    Vote patterns are counted over all documents. The linear scorer is fitted to posterior labels on a sample of
    about `fit_rows` documents, drawn by a hash of id and text, so the driver holds a bounded table.
    """
    voted = docs.select("doc_id", "text").withColumn("votes", vote_column(F.col("text")))
    patterns = {r["votes"]: r["n"] for r in voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not patterns:
        return score_column(np.zeros(DIMS, np.float32), 0.0), {}
    good, told = estimate(patterns)
    share = min(1.0, fit_rows / sum(patterns.values()))

    @pandas_udf("votes string, x binary")
    def rows(texts: pd.Series) -> pd.DataFrame:
        all_stats = [statistics(t or "") for t in texts]
        return pd.DataFrame({"votes": [votes(s) for s in all_stats],
                             "x": [features(t or "", s).astype(np.float16).tobytes() for t, s in zip(texts, all_stats)]})

    drawn = docs.where((F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int(share * (1 << 20))) & (F.trim("text") != ""))
    sample = sorted(drawn.select(rows(F.col("text")).alias("r")).select("r.*").collect(), key=lambda r: (r["votes"], bytes(r["x"])))
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in sample), np.float16).reshape(-1, DIMS).astype(np.float32)
    w, b = fit_linear(x, np.array([good.get(r["votes"], 0.5) for r in sample]))
    return score_column(w, b), told


def score_column(w: np.ndarray, b: float) -> Callable[[Column], Column]:
    @pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            stats = statistics(t or "")
            out.append(0.0 if stats is None else float(1 / (1 + np.exp(-np.clip(features(t, stats) @ w + b, -30, 30)))))
        return pd.Series(out)
    return run


def classify(docs: DataFrame, fit_rows: int = FIT_ROWS, keep_from: float = KEEP_FROM) -> DataFrame:
    """The documents with `quality_score` (0 to 1) and `kept`, true from `keep_from`.

    Texts that are null or without words score 0. Repeated rows score alike; other columns are kept and not read, but
    columns of the two names are replaced.
    An empty table gives an empty table.
    """
    prepare(docs.sparkSession)
    score, _ = fit(docs, fit_rows)
    return docs.withColumn("quality_score", score(F.col("text"))).withColumn("kept", F.col("quality_score") >= keep_from)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that `classify` keeps; all their columns come back as given."""
    prepare(docs.sparkSession)
    score, _ = fit(docs, FIT_ROWS)
    scored = docs.withColumn("__quality", score(F.col("text")))
    return scored.where(F.col("__quality") >= KEEP_FROM).select(*[F.col(f"`{c}`") for c in docs.columns])
