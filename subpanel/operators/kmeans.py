"""K-Means with several starts that advance together.

Every iteration is one pass over the vectors with the centres of all starts that still move, followed by one
aggregation of per-task sums; a start whose centres have settled drops out. Only the centres and a bounded sample for
the first centres are on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subpanel.session import prepare_workers

#: Rows on the driver from which the first centres are drawn, about.
SAMPLE_ROWS = 4096
#: A start has settled when the squares of its centres' steps sum to less.
SETTLED = 1e-4
_COUNT, _COST = -1, -2


@dataclass
class Fit:
    centres: np.ndarray
    cost: float
    costs: list[float]
    iterations: list[int]


def first_centres(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k rows of the sample, each drawn with a chance that grows with its squared distance from those before."""
    rng = np.random.default_rng(seed)
    centres = [sample[rng.integers(len(sample))]]
    away = ((sample - centres[0]) ** 2).sum(axis=1)
    for _ in range(1, k):
        total = away.sum()
        pick = rng.choice(len(sample), p=away / total) if total > 0 else rng.integers(len(sample))
        centres.append(sample[pick])
        away = np.minimum(away, ((sample - centres[-1]) ** 2).sum(axis=1))
    return np.array(centres)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the nearest centre of each row, for each start: rows x starts."""
    starts, k, d = centres.shape
    flat = centres.reshape(starts * k, d)
    distance = (flat * flat).sum(axis=1) - 2 * (x @ flat.T)
    return distance.reshape(len(x), starts, k).argmin(axis=2)


def totals(vectors: DataFrame, column: str, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each start and cluster: rows, sum of the vectors and squared distances, in one pass."""
    starts, k, d = centres.shape
    schema = pa.schema([("start", pa.int32()), ("cluster", pa.int32()), ("place", pa.int32()), ("v", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cost = np.zeros((starts, k)), np.zeros((starts, k, d)), np.zeros((starts, k))
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                x = batch.column(0).slice(at, 8192).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                label = nearest(x, centres)
                for s in range(starts):
                    member = label[:, s, None] == np.arange(k)
                    n[s] += member.sum(axis=0)
                    sums[s] += member.T.astype(float) @ x
                    away = ((x - centres[s][label[:, s]]) ** 2).sum(axis=1)
                    cost[s] += member.T.astype(float) @ away
        if n.any():
            v = np.concatenate([n[..., None], cost[..., None], sums], axis=2)
            s, c, p = np.indices(v.shape)
            place = np.where(p == 0, _COUNT, np.where(p == 1, _COST, p - 2))
            yield pa.RecordBatch.from_arrays([pa.array(a.ravel(), t.type) for a, t in zip((s, c, place, v), schema)], schema=schema)

    prepare_workers(vectors.sparkSession)
    parts = vectors.select(column).mapInArrow(run, "start int, cluster int, place int, v double")
    n, sums, cost = np.zeros((starts, k)), np.zeros((starts, k, d)), np.zeros((starts, k))
    for r in parts.groupBy("start", "cluster", "place").agg(F.sum("v").alias("v")).collect():
        if r["place"] == _COUNT:
            n[r["start"], r["cluster"]] = r["v"]
        elif r["place"] == _COST:
            cost[r["start"], r["cluster"]] = r["v"]
        else:
            sums[r["start"], r["cluster"], r["place"]] = r["v"]
    return n, sums, cost


def fit(vectors: DataFrame, column: str, k: int, starts: int, max_iter: int, seed: int) -> Fit | None:
    """The cheapest of several starts; None without vectors. `vectors` is read once for each iteration.

    A cluster that loses all its rows keeps its centre. Ties between starts go to the earlier one.
    """
    rows = vectors.count()
    if not rows:
        return None
    share = min(1.0, 1.2 * SAMPLE_ROWS / rows)
    sample = np.array([r[0] for r in (vectors.sample(share, seed) if share < 1 else vectors).select(column).collect()], float)
    sample = sample[np.lexsort(sample.T)]  # the same whatever the order of tasks
    centres = np.array([first_centres(sample, k, seed + s) for s in range(starts)])
    moving, iterations = list(range(starts)), [0] * starts
    for _ in range(max_iter):
        n, sums, _ = totals(vectors, column, centres[moving])
        after = np.where(n[..., None] > 0, sums / np.maximum(n, 1)[..., None], centres[moving])
        steps = ((after - centres[moving]) ** 2).sum(axis=(1, 2))
        centres[moving] = after
        for s in moving:
            iterations[s] += 1
        moving = [s for s, step in zip(moving, steps) if step > SETTLED]
        if not moving:
            break
    costs = totals(vectors, column, centres)[2].sum(axis=1)
    best = int(costs.argmin())
    return Fit(centres[best], float(costs[best]), costs.tolist(), iterations)
