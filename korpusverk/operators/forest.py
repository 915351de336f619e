"""Random forests of all folds of a cross-validation at once, over binned features.

The definition is that of pyspark.ml's classifier: DEPTH levels, BINS bins a feature, a square root of the features for each node, rows drawn with Poisson(1), Gini impurity of weighted
classes, the mean of the leaves' shares. pyspark.ml keeps an array of all trees' draws for each row and fold in storage and takes each row down every tree one by one; here draws come from a
hash of the row (the same in every pass and on every partitioning) and a pass per level adds up histograms of whole chunks. Folds whose trees are still the same share a histogram,
as a training set is all rows less its fold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusverk.plans.runtime import cut

DEPTH, BINS = 5, 32
#: Rows of a chunk.
CHUNK = 50_000
#: Poisson(1) by 16 hashed bits.
DRAWS = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(i) for i in range(9)]), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def draws(row: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row (32 hashed bits) is in the tree's sample."""
    x = row ^ np.random.default_rng((seed, tree)).integers(1 << 32, dtype=np.uint32)
    for k in (0x85EBCA6B, 0xC2B2AE35):
        x = x * np.uint32(k)
        x ^= x >> np.uint32(15)
    return DRAWS[x >> np.uint32(16)]


def subsets(tree: int, level: int, n: int, seed: int) -> np.ndarray:
    """Features of each node of a level, sorted: a square root of them."""
    rng = np.random.default_rng((seed, tree, level))
    return np.sort(np.argsort(rng.random((1 << level, n)), axis=1)[:, : math.ceil(math.sqrt(n))], axis=1)


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)], axis=1).astype(np.uint8)


def node_of(flat: np.ndarray, base: np.ndarray, feature: np.ndarray, cut_at: np.ndarray, level: int) -> np.ndarray:
    """Number in the level of the node that each row (its place in flat) comes to."""
    at = np.zeros(len(base), np.int64)
    for _ in range(level):
        at = 2 * at + 1 + (flat.take(base + feature.take(at, mode="clip"), mode="clip") > cut_at.take(at, mode="clip"))
    return at - ((1 << level) - 1)


def histograms(chunk: tuple, level: int, feature: np.ndarray, cut_at: np.ndarray, k: int, seed: int, out: np.ndarray) -> None:
    """Adds to out (tree, fold, place in the subset, node, label, bin) the draws of a chunk (bins, labels, folds, hashes)."""
    x, label, fold, row = chunk
    flat, width, nodes = x.ravel(), x.shape[1], 1 << level
    for t in range(len(out)):
        w = draws(row, t, seed)
        some = np.flatnonzero(w)
        some_w, some_fold, of = w[some].astype(np.float64), fold[some], subsets(t, level, width, seed)
        alike: dict[bytes, list[int]] = {}
        for f in range(k):
            alike.setdefault(feature[t, f].tobytes() + cut_at[t, f].tobytes(), []).append(f)
        for same in alike.values():
            rows, weight, own = some, some_w, some_fold
            if len(same) == 1:
                kept = own != same[0]
                rows, weight = rows[kept], weight[kept]
            base = rows * width
            node = node_of(flat, base, feature[t, same[0]], cut_at[t, same[0]], level)
            cell = (2 * node + label[rows]) * BINS
            if len(same) > 1:
                cell += own * (2 * nodes * BINS)
            for j in range(of.shape[1]):
                bins = flat.take(base + (of[0, j] if not level else of[:, j].take(node, mode="clip")), mode="clip")
                if len(same) == 1:
                    out[t, same[0], j] += np.bincount(cell + bins, weight, 2 * nodes * BINS).reshape(nodes, 2, BINS).astype(np.uint32)
                else:
                    h = np.bincount(cell + bins, weight, k * 2 * nodes * BINS).reshape(k, nodes, 2, BINS).astype(np.uint32)
                    out[t, same, j] += h.sum(axis=0, dtype=np.uint32) - h[same]


def best(h: np.ndarray, of: np.ndarray, weights: np.ndarray) -> tuple:
    """(feature or -1, last bin on the left, weighted class sums on the left, of the whole node) of each node, from counts (place in the subset, node, label, bin)."""
    left = np.cumsum(h.astype(np.float64), axis=3)
    whole = left[0, :, :, -1]
    left = left[..., :-1]
    right = whole[None, :, :, None] - left
    valid = (left.sum(axis=2) >= 1) & (right.sum(axis=2) >= 1)
    wl, wr, wt = left * weights[:, None], right * weights[:, None], whole * weights

    def impure(c: np.ndarray, axis: int) -> np.ndarray:
        """Gini impurity times weight."""
        n = c.sum(axis=axis)
        return n - (c * c).sum(axis=axis) / np.maximum(n, 1e-300)

    gain = np.where(valid, impure(wt, 1)[None, :, None] - impure(wl, 2) - impure(wr, 2), -1.0)
    flat = gain.transpose(1, 0, 2).reshape(gain.shape[1], -1)
    at = flat.argmax(axis=1)
    node = np.arange(len(at))
    j, b = at // (BINS - 1), at % (BINS - 1)
    good = flat[node, at] > 1e-9 * np.maximum(wt.sum(axis=1), 1)
    return np.where(good, of[node, j], -1), b, wl[j, node, :, b], wt


def share(counts: np.ndarray) -> np.ndarray:
    return counts[..., 1] / np.maximum(counts.sum(axis=-1), 1e-300)


def scores(data: DataFrame, key: str, k: int, trees: int = 400, seed: int = 0) -> DataFrame:
    """(key, label, fold, score, predicted) of every row from the forest of the other folds; data: key, label, weight (of the label), fold, features (a vector).

    Bins are quantiles of all rows, without their labels. A pass over the binned rows for each level; each task keeps and sends one histogram of all trees.
    """
    spark = data.sparkSession
    rows = data.select(key, "label", "fold", vector_to_array("features").alias("x"))
    known = data.groupBy("label").agg(F.first("weight").alias("w"), F.first(F.size(vector_to_array("features"))).alias("n")).collect()  # two rows
    if not known:
        return rows.select(key, "label", "fold", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    width, weights = known[0]["n"], np.array([next((r["w"] for r in known if r["label"] == y), 0.0) for y in (0, 1)])
    held = rows.agg(*[F.percentile_approx(F.col("x")[i], [b / BINS for b in range(1, BINS)], 10_000).alias(f"q{i}") for i in range(width)]).first()
    edges = [np.unique(np.array(q)) for q in held]

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, n = [], 0

        def packed() -> pd.DataFrame:
            x, label, fold, row = (np.concatenate(p) for p in zip(*kept))
            return pd.DataFrame({"x": [x.tobytes()], "label": [label.tobytes()], "fold": [fold.tobytes()], "row": [row.tobytes()]})

        for f in frames:
            if len(f):
                kept.append((binned(np.stack(f["x"]), edges), f["label"].to_numpy(np.int8), f["fold"].to_numpy(np.int8), f["h"].to_numpy().view(np.uint64).astype(np.uint32)))
                n += len(f)
            if n >= CHUNK:
                yield packed()
                kept, n = [], 0
        if kept:
            yield packed()

    some = rows.select("x", "label", "fold", F.xxhash64(key, "label", "x").alias("h"))
    chunks = cut(some.coalesce(spark.sparkContext.defaultParallelism).mapInPandas(pack, "x binary, label binary, fold binary, row binary"))
    feature, cut_at = np.full((trees, k, (1 << DEPTH) - 1), -1, np.int64), np.full((trees, k, (1 << DEPTH) - 1), BINS, np.int64)
    value, alive = np.zeros((trees, k, (2 << DEPTH) - 1)), np.zeros((trees, k, (2 << DEPTH) - 1), bool)
    alive[..., 0] = True
    for level in range(DEPTH):
        nodes, first = 1 << level, (1 << level) - 1
        sent = spark.sparkContext.broadcast((np.maximum(feature[..., :first], 0), cut_at[..., :first]))  # trees x folds x nodes

        def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros((trees, k, math.ceil(math.sqrt(width)), 1 << level, 2, BINS), np.uint32)
            for f in frames:
                for r in f.itertuples():
                    x = np.frombuffer(r.x, np.uint8).reshape(-1, width)
                    histograms((x, np.frombuffer(r.label, np.int8).astype(np.int64), np.frombuffer(r.fold, np.int8).astype(np.int64), np.frombuffer(r.row, np.uint32)), level, *sent.value, k, seed, out)
            for t in range(trees):
                yield pd.DataFrame({"tree": [t], "h": [out[t].tobytes()]})

        def choose(f: pd.DataFrame) -> pd.DataFrame:
            h = sum(np.frombuffer(x, np.uint32).astype(np.int64) for x in f["h"]).reshape(k, -1, 1 << level, 2, BINS)
            t = int(f["tree"].iloc[0])
            found = [best(h[i], subsets(t, level, width, seed), weights) for i in range(k)]
            return pd.DataFrame({"tree": [t], "found": [np.concatenate([np.concatenate([a.reshape(-1) for a in x]).astype(np.float64) for x in found]).tobytes()]})

        for r in chunks.mapInPandas(count, "tree int, h binary").groupBy("tree").applyInPandas(choose, "tree int, found binary").toLocalIterator():  # a row for each tree
            for i, x in enumerate(np.frombuffer(r["found"], np.float64).reshape(k, -1)):
                t, (f, b), left, whole = r["tree"], x[: 2 * nodes].reshape(2, nodes).astype(np.int64), x[2 * nodes : 4 * nodes].reshape(nodes, 2), x[4 * nodes :].reshape(nodes, 2)
                at = np.arange(first, first + nodes)
                if not level:
                    value[t, i, 0] = share(whole)[0]
                split = alive[t, i, at] & (f >= 0)
                feature[t, i, at[split]], cut_at[t, i, at[split]] = f[split], b[split]
                alive[t, i, 2 * at + 1] = alive[t, i, 2 * at + 2] = split
                value[t, i, 2 * at + 1], value[t, i, 2 * at + 2] = np.where(split, share(left), value[t, i, at]), np.where(split, share(whole - left), value[t, i, at])
    model = spark.sparkContext.broadcast((np.maximum(feature, 0), cut_at, value))

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        feature, cut_at, value = model.value
        for f in frames:
            if not len(f):
                continue
            x, fold, score = binned(np.stack(f.pop("x")), edges), f["fold"].to_numpy(), np.zeros(len(f))
            for i in np.unique(fold):
                at = np.flatnonzero(fold == i)
                for t in range(trees):
                    score[at] += value[t, i, (1 << DEPTH) - 1 :][node_of(x.ravel(), at * width, feature[t, i], cut_at[t, i], DEPTH)]
            f["score"] = score / trees
            f["predicted"] = (f["score"] > 0.5).astype(np.int32)
            yield f

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (key, "label", "fold"))
    return cut(rows.mapInPandas(judge, f"{kinds}, score double, predicted int"))
