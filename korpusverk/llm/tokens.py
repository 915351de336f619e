"""Encoding a corpus with a public byte-level BPE tokenizer.

Method: forced-boundary splitting. Two neighbouring bytes that stand side by side inside no token of the vocabulary can never be merged, so a
text may be cut between them; fragments are encoded once each per batch, independently, and their ids are concatenated. Cuts that could change how the
pre-tokenizer sees the fragments (after white space, before an apostrophe, inside a character) are not used.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusverk.plans.runtime import clash_free

NAME = "byte_bpe_50k.tiktoken"
_READY: dict[int, tuple] = {}


def default_path(name: str = NAME) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ranks_of(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


def forced(ranks: dict[bytes, int]) -> np.ndarray:
    """inside[a, b]: some token holds byte a directly before byte b."""
    inside = np.zeros((256, 256), bool)
    for token in ranks:
        if len(token) > 1:
            t = np.frombuffer(token, np.uint8)
            inside[t[:-1], t[1:]] = True
    return inside


def prepare(raw: bytes) -> tuple:
    key = hash(raw)
    if key not in _READY:
        import public_tokenizers
        import tiktoken

        ranks = ranks_of(raw)
        plain = np.zeros(256, bool)
        plain[0x21:0x7F] = True
        starts = np.ones(256, bool)
        starts[0x80:0xC0] = False
        starts[ord("'")] = False
        _READY[key] = (tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), forced(ranks), plain, starts)
    return _READY[key]


def cuts(data: np.ndarray, inside: np.ndarray, plain: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions p such that data may be cut before byte p."""
    if len(data) < 2:
        return np.zeros(0, np.int64)
    a, b = data[:-1], data[1:]
    solid = plain[a]
    solid[1:] |= data[:-2] == 0xC3  # the letters of Latin-1
    return np.flatnonzero(~inside[a, b] & solid & starts[b]) + 1


def encode(texts: pa.Array, ready: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids) of the texts' encodings; a null or empty text has no ids."""
    encoding, inside, plain, starts = ready
    texts = pa.array(texts).cast(pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    if offsets[-1] == offsets[0]:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.int32)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    bounds = np.unique(np.concatenate([offsets, cuts(data, inside, plain, starts)]))
    fragments = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    which = fragments.indices.to_numpy()
    coded = [encoding.encode_ordinary(x.decode()) for x in fragments.dictionary.to_pylist()]
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    flat = np.fromiter((i for c in coded for i in c), np.int32, int(sizes.sum()))
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    per = sizes[which]
    ends = np.concatenate([[0], np.cumsum(per)])
    at = np.repeat(first[which] - ends[:-1], per) + np.arange(ends[-1])
    return ends[np.searchsorted(bounds, offsets)], flat[at]


def _raw(df: DataFrame, path: str | None):
    with open(path or default_path(), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: its size does not depend on the data


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids ARRAY<INT>) of every row; ids is [] for a null or empty text, never null. Strings of special tokens are ordinary text.

    A map-only plan: no shuffle, whole texts, any row count; repeated rows give repeated results; other columns are not read.
    """
    raw = _raw(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = prepare(raw.value)
        for batch in batches:
            offsets, ids = encode(batch.column(1), ready)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))], names=[id_col, "ids"])

    src = clash_free(df, id_col, text_col)
    return src.mapInArrow(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, ids array<int>")


def count_tokens(df: DataFrame, id_col: str, text_col: str, *keep: str, path: str | None = None) -> DataFrame:
    """(id, keep..., n_tokens); 0 for a null or empty text."""
    raw = _raw(df, path)
    src = clash_free(df, text_col, id_col, *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = prepare(raw.value)
        for batch in batches:
            offsets, _ = encode(batch.column(0), ready)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.diff(offsets))], names=[id_col, *keep, "n_tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema[1:])
    return src.mapInArrow(run, f"{schema}, n_tokens bigint").withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0)))
