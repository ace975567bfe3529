"""Stretches of letters by which a text that lies in another one finds it.

Texts of a batch are one array of letters. A stretch is a hash of its group and letters; of each run of stretches the rarest is kept. A text of
so many letters as GRAMS names has at least one whole run, which any text that holds it has as well: so both keep the same stretch of that run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

#: Letters of the text looked for, at least: letters of a stretch, and stretches of a run; together no more letters than the text has.
GRAMS = {1: (1, 1), 2: (2, 1), 4: (4, 1), 8: (6, 3), 16: (10, 7), 32: (16, 17), 64: (32, 33)}
GRAM_BUCKETS = 1 << 18
_HASH_BITS = 40


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _runs(values: np.ndarray, width: int, join: Callable) -> np.ndarray:
    """join over width neighbours, by doubling; the last step overlaps."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = join(values[: max(len(values) - step, 0)], values[step:])
        done += step
    return values


def _stretches(texts: list[str], groups: np.ndarray, letters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the stretches that begin at each letter, and each letter's text and distance to the text's end."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    left = np.cumsum(sizes)[owner] - np.arange(len(codes))
    seeds = groups.astype(np.int64).view(np.uint64)[owner]
    hashes = _runs(_mix(codes + seeds), letters, lambda a, b: _mix(a * np.uint64(0xC2B2AE3D27D4EB4F) + b))
    return hashes, owner[: len(hashes)], left[: len(hashes)]


def _ranked(hashes: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The bucket's count above, bits of the hash below: the least is the rarest."""
    rank = np.minimum(often[hashes % np.uint64(GRAM_BUCKETS)], np.uint64((1 << (63 - _HASH_BITS)) - 1))
    return (rank << np.uint64(_HASH_BITS)) | (hashes >> np.uint64(64 - _HASH_BITS))


def gram_counts(lengths: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of batches of texts and hashes of their groups: how many stretches fall in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(GRAM_BUCKETS, dtype=np.int64)
        for batch in batches:
            for k in lengths:
                hashes, _, left = _stretches(batch.column(0).to_pylist(), batch.column(1).to_numpy(), GRAMS[k][0])
                n += np.bincount((hashes[left >= GRAMS[k][0]] % np.uint64(GRAM_BUCKETS)).astype(np.int64), minlength=GRAM_BUCKETS)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], names=["bucket", "n"])

    return count


def gram_keys(lengths: list[int], often: np.ndarray) -> Callable:
    """The stretches of a text that are the rarest of a run, for each of the lengths looked for."""

    def keys(texts: pd.Series, groups: pd.Series) -> pd.Series:
        owners, found = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for k in lengths:
            letters, run = GRAMS[k]
            hashes, owner, left = _stretches(texts.tolist(), groups.to_numpy(), letters)
            least = _runs(_ranked(hashes, often), run, np.minimum)
            whole = left[: len(least)] >= letters + run - 1
            owners.append(owner[: len(least)][whole])
            found.append(least[whole].view(np.int64))
        owner, value = np.concatenate(owners), np.concatenate(found)
        order = np.lexsort((value, owner))
        owner, value = owner[order], value[order]
        new = np.ones(len(value), dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
        owner, value = owner[new], value[new]
        return pd.Series(np.split(value, np.searchsorted(owner, np.arange(1, len(texts)))) if len(texts) else [])

    return F.pandas_udf(keys, "array<long>")


def needle_key(lengths: list[int], often: np.ndarray) -> Callable:
    """The rarest stretch of a text, of the length that goes with its own."""

    def key(texts: pd.Series, groups: pd.Series) -> pd.Series:
        out = np.zeros(len(texts), dtype=np.int64)
        sizes = texts.str.len().to_numpy()
        own = np.array(sorted(lengths) or [1])[np.maximum(np.searchsorted(sorted(lengths) or [1], sizes, side="right") - 1, 0)]
        for k in lengths:
            rows = np.flatnonzero(own == k)
            if not len(rows):
                continue
            hashes, owner, left = _stretches(texts.iloc[rows].tolist(), groups.to_numpy()[rows], GRAMS[k][0])
            ok = left >= GRAMS[k][0]
            least = np.full(len(rows), np.iinfo(np.uint64).max)
            np.minimum.at(least, owner[ok], _ranked(hashes, often)[ok])
            out[rows] = least.view(np.int64)
        return pd.Series(out)

    return F.pandas_udf(key, "long")
