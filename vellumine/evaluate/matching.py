"""One-to-one matching of predicted and gold entries by key similarity."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..folds import folded
from ..functions.similarity import key_similarity

LEAST = 0.5
MATCHED = "predicted int, gold int, similarity double"


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of least total cost, each row and column at most once; shortest augmenting paths, O(n^3)."""
    flipped = cost.shape[0] > cost.shape[1]
    c = cost.T if flipped else cost
    n, m = c.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)  # column 0 and row 0 are auxiliary
    for row in range(1, n + 1):
        owner[0], col = row, 0
        least, back, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[col]:
            used[col] = True
            slack = np.where(used[1:], np.inf, c[owner[col] - 1] - u[owner[col]] - v[1:])
            better = slack < least[1:]
            least[1:][better], back[1:][better] = slack[better], col
            nxt = int(np.argmin(np.where(used[1:], np.inf, least[1:]))) + 1
            step = least[nxt]
            u[owner[used]] += step
            v[used] -= step
            least[~used] -= step
            col = nxt
        while col:
            owner[col], col = owner[back[col]], back[col]
    pairs = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((b, a) if flipped else (a, b) for a, b in pairs)


def match_keys(predicted: list[str], gold: list[str], least: float = LEAST) -> list[tuple[int, int, float]]:
    if not predicted or not gold:
        return []
    cost = np.array([[1 - key_similarity(p, g) for g in gold] for p in predicted])
    return [(i, j, 1 - cost[i, j]) for i, j in assignment(cost) if cost[i, j] <= 1 - least]


def match_entries(predicted: DataFrame, gold: DataFrame, *keys: str, least: float = LEAST) -> DataFrame:
    """``keys, predicted, gold, similarity``: matched positions. Both sides: ``keys, ord, key``; one group is one
    document's entries of one section."""
    types = dict(predicted.dtypes)

    def run(rows: list) -> list[tuple]:
        p, g = ([r for r in rows if r.is_gold == side] for side in (False, True))
        at = rows[0][: len(keys)]
        return [(*at, p[i].ord, g[j].ord, s) for i, j, s in match_keys([r.key for r in p], [r.key for r in g], least)]

    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", " + MATCHED
    left, right = (df.select(*keys, F.col("ord").cast("int").alias("ord"), "key", F.lit(side).alias("is_gold")) for df, side in ((predicted, False), (gold, True)))
    return folded(left.unionByName(right), list(keys), ["is_gold", "ord"], run, schema)
