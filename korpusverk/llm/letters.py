"""Character codes and n-gram tables on numpy, shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 32 classes of characters: 0 anything else, 1-26 a-z, 27 å, 28 ä, 29 ö, 30 other letters of Latin-1, 31 digits.
CODES = np.zeros(256, np.uint8)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz", 1):
    CODES[ord(_c)] = CODES[ord(_c.upper())] = _i
CODES[0xDF:0x100] = CODES[0xC0:0xDF] = 30
CODES[0xD7] = CODES[0xF7] = 0
for _i, _c in ((27, "åÅ"), (28, "äÄ"), (29, "öÖ")):
    for _x in _c:
        CODES[ord(_x)] = _i
CODES[ord("0") : ord("9") + 1] = 31
GRAMS = 1 << 15


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, offsets) of all texts in one array, each followed by one code 0; runs of 0 stay as they are."""
    whole = "\n".join(texts) + "\n"
    codes = CODES[np.frombuffer(whole.encode("latin-1", "replace"), np.uint8)]
    return codes, np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])


def grams(codes: np.ndarray) -> np.ndarray:
    """Trigram numbers; the one at i covers i, i+1 and i+2 (cut off at the end)."""
    c = codes.astype(np.int32)
    pad = np.concatenate([c, [0, 0]])
    return (pad[:-2] << 10) | (pad[1:-1] << 5) | pad[2:]


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def count_table(df: DataFrame, columns: list[str], size: int, of: Callable, lists: bool = True) -> np.ndarray:
    """Sums over all rows of the counts that of gives for the batch, or for lists of its columns' texts; size is fixed, so what reaches the driver is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.float64)
        for batch in batches:
            total += of([[x or "" for x in c.to_pylist()] for c in batch.columns] if lists else batch)
        some = np.flatnonzero(total)
        for at in range(0, len(some), 50_000):
            part = some[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["bin", "n"])

    rows = df.select(*columns).mapInArrow(run, "bin bigint, n double").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.float64)
    out[rows["bin"].to_numpy()] = rows["n"].to_numpy()
    return out


def letter_counts(columns: list[list[str]]) -> np.ndarray:
    codes, _ = coded([t for c in columns for t in c])
    g = grams(codes)
    return np.bincount(g[g != 0], minlength=GRAMS).astype(np.float64)


def log_conditional(counts: np.ndarray, add: float = 0.5) -> np.ndarray:
    """log p(third | first two) from trigram counts, smoothed."""
    n = counts.reshape(-1, 32) + add
    return np.log(n / n.sum(1, keepdims=True)).ravel()
