"""Edit ratios by bit-parallel longest common subsequences.

A text of up to 64 letters is one machine word, a bit a letter, and a batch of pairs is an array of such words: each further letter of the
other texts costs three operations on the array. Longer texts, and lone long ones, take Python's long integers the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD_BITS = 64
#: Letters of the longer text up to which a batch goes letter by letter, and cells of a table of letters by pairs.
BATCH_LETTERS, BATCH_CELLS = 1024, 1 << 22


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    a, b = sorted((a, b), key=len)
    places: dict[str, int] = {}
    for i, letter in enumerate(a):
        places[letter] = places.get(letter, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for letter in b:
        hit = row & places.get(letter, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _letters(texts: list[str], width: int) -> np.ndarray:
    return np.array(texts, dtype=f"<U{max(width, 1)}").view(np.uint32).reshape(len(texts), max(width, 1))


def _run(short: np.ndarray, sizes: np.ndarray, long: np.ndarray) -> np.ndarray:
    """lcs of rows of letters; sizes: letters in each row of short (at most WORD_BITS); 0 in long is no letter."""
    known = np.unique(short)
    masks = np.zeros((len(short), len(known) + 1), dtype=np.uint64)
    rows = np.arange(len(short))
    for bit in range(short.shape[1]):
        masks[rows, np.searchsorted(known, short[:, bit])] |= np.where(bit < sizes, np.uint64(1) << np.uint64(bit), np.uint64(0))
    at = np.minimum(np.searchsorted(known, long), len(known) - 1)
    at = np.where((known[at] == long) & (long != 0), at, len(known))
    row = np.full(len(short), np.iinfo(np.uint64).max)
    for j in range(long.shape[1]):
        hit = row & masks[rows, at[:, j]]
        row = (row + hit) | (row - hit)
    inside = np.where(sizes >= WORD_BITS, np.iinfo(np.uint64).max, (np.uint64(1) << np.minimum(sizes, WORD_BITS - 1).astype(np.uint64)) - np.uint64(1))
    return sizes - np.bitwise_count(row & inside).astype(np.int64)


def lcs_batch(left: list[str], right: list[str]) -> np.ndarray:
    """lcs of each pair."""
    pairs = [(a, b) if len(a) <= len(b) else (b, a) for a, b in zip(left, right)]
    out = np.zeros(len(pairs), dtype=np.int64)
    order = sorted((i for i, (a, b) in enumerate(pairs) if len(a) <= WORD_BITS and len(b) <= BATCH_LETTERS and "\0" not in a + b), key=lambda i: len(pairs[i][1]))
    batched = set(order)
    for i, (a, b) in enumerate(pairs):
        if i not in batched:
            out[i] = lcs(a, b)
    while order:
        width = len(pairs[order[min(len(order), 256) - 1]][1])
        now = [i for i in order[: max(256, BATCH_CELLS // max(width, 1) // WORD_BITS)] if len(pairs[i][1]) <= max(width, 16)]
        order = order[len(now) :]
        short, long = [pairs[i][0] for i in now], [pairs[i][1] for i in now]
        sizes = np.fromiter(map(len, short), dtype=np.int64, count=len(now))
        out[now] = _run(_letters(short, int(sizes.max())), sizes, _letters(long, max(map(len, long))))
    return out


def indel(a: str, b: str) -> float:
    """2 x lcs by the sum of the lengths; 1 for two empty texts."""
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_set(a: str | None, b: str | None) -> float:
    """0 to 100: the best of the indel ratios among the shared words and the shared words with either rest. The shared words begin both
    other texts, so only the ratio of these two needs a subsequence, and that only if their lengths let it be the best."""
    x, y = set((a or "").lower().split()), set((b or "").lower().split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    p, q = f"{both} {only_x}".strip(), f"{both} {only_y}".strip()
    best = max(2 * len(both) / (len(both) + len(t)) for t in (p, q)) if both else 0.0
    if 2 * min(len(p), len(q)) / (len(p) + len(q)) > best:
        best = max(best, indel(p, q))
    return 100.0 * best


def window_ratios(short: str, long: str, starts: np.ndarray) -> np.ndarray:
    """0 to 100: indel ratio of short with the stretch of long, as long as short, from each start on; a start below zero or near the end
    gives the stretch that is inside."""
    n = len(short)
    begins, ends = np.maximum(starts, 0), np.minimum(starts + n, len(long))
    sizes = ends - begins
    if n > WORD_BITS or "\0" in short:
        return np.array([100.0 * indel(short, long[a:b]) for a, b in zip(begins.tolist(), ends.tolist())])
    text = np.concatenate([_letters([long], len(long))[0], np.zeros(n, dtype=np.uint32)])
    known = np.unique(_letters([short], n))
    masks = np.array([sum(1 << i for i, x in enumerate(short) if ord(x) == k) for k in known.tolist()] + [0], dtype=np.uint64)
    at = np.minimum(np.searchsorted(known, text), len(known) - 1)
    own = np.where(known[at] == text, masks[at], np.uint64(0))
    row = np.full(len(starts), np.iinfo(np.uint64).max)
    for j in range(n):
        hit = row & np.where(j < sizes, own[np.minimum(begins + j, len(text) - 1)], np.uint64(0))
        row = (row + hit) | (row - hit)
    inside = np.uint64((1 << n) - 1)
    return 200.0 * (n - np.bitwise_count(row & inside).astype(np.int64)) / (n + sizes)


def partial(a: str | None, b: str | None) -> float:
    """0 to 100: the best indel ratio of the shorter text with a stretch, at most as long, of the longer one."""
    short, long = sorted((a or "", b or ""), key=len)
    if not short:
        return 0.0
    if short in long:
        return 100.0
    return float(window_ratios(short, long, np.arange(1 - len(short), len(long))).max())


def near(word: str, text: str, least: float, shortest: int) -> bool:
    """Whether some stretch of text, as long as word, reaches the ratio least; of words under so many letters, only the word itself does.
    A stretch that reaches it lacks so few of the word's letters that one of 2 x lacking + 1 pieces of the word is in it unbroken: only
    stretches around these pieces are compared, and those cut off by the text's ends."""
    if word in text:
        return True
    n = len(word)
    if n < shortest or not text:
        return False
    lacking = n - int(np.ceil(least * n / 100 - 1e-9))
    starts = {*range(1 - n, 1), *range(max(0, len(text) - n + 1), len(text))}
    pieces = 2 * lacking + 1
    for k in range(pieces if lacking else 0):
        first, end = k * n // pieces, (k + 1) * n // pieces
        at = text.find(word[first:end])
        while at >= 0:
            starts.update(range(at - first - lacking, at - first + lacking + 1))
            at = text.find(word[first:end], at + 1)
    inside = np.array(sorted(s for s in starts if -n < s < len(text)))
    return bool(len(inside)) and bool((window_ratios(word, text, inside) >= least - 1e-9).any())


@F.pandas_udf(T.DoubleType())
def indel_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """0 to 1; null texts are empty."""
    for left, right in pairs:
        a, b = left.fillna("").tolist(), right.fillna("").tolist()
        whole = np.fromiter((len(x) + len(y) for x, y in zip(a, b)), dtype=float, count=len(a))
        yield pd.Series(np.where(whole == 0, 1.0, 2 * lcs_batch(a, b) / np.maximum(whole, 1)))


@F.pandas_udf(T.DoubleType())
def token_set_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in pairs:
        yield pd.Series([token_set(a, b) for a, b in zip(left, right)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def partial_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in pairs:
        yield pd.Series([partial(a, b) for a, b in zip(left, right)], dtype="float64")
