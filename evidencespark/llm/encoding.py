"""Whole texts to token ids with the tokenizers library, each distinct piece of text encoded once a batch or less.

Both tokenizers used here never join characters across the start of a run of white space, so a text may be cut where a
space or newline follows another character, and the ids of the pieces put end to end are those of the text. Cutting,
finding the distinct pieces and putting their ids in place are Arrow and numpy calls on whole batches; only distinct
pieces that the worker does not hold go to the library.
"""

from __future__ import annotations

import ctypes
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of pieces and ids that a worker holds. Beyond, only those of the batch at hand stay: memory is bounded, results are the same.
CACHE_BYTES = 24 << 20
#: Text bytes of a batch, but for a single longer text.
BATCH_BYTES = 8 << 20
#: White space in the widest sense: what only one of the libraries holds to be white space is not cut after.
_WHITE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
_PRE_TOKENS = r"[A-Za-z]+|[0-9]|[^A-Za-z0-9\s]+"
_encoders: dict[tuple[str, int], Encoder] = {}


def cut(texts: pa.Array) -> pa.ListArray:
    """The pieces of each text. Texts without two white-space characters in a row are cut at every space and newline, others by a
    pattern; those that hold the character used as the mark of a cut, by a plain loop."""
    odd = pc.match_substring(texts, "\0")
    runs = pc.and_not(pc.match_substring_regex(texts, f"[{_WHITE}][{_WHITE}]"), odd)
    plain = pc.invert(pc.or_(odd, runs))
    parts, rows = [], []
    for kind, mask in enumerate((plain, runs, odd)):
        if not mask.true_count:
            continue
        some = texts if mask.true_count == len(texts) else texts.filter(mask)
        if kind == 0:
            some = pc.replace_substring(pc.replace_substring(some, "\n", "\0\n"), " ", "\0 ")
        elif kind == 1:
            some = pc.replace_substring_regex(some, pattern=f"([^{_WHITE}])([ \\n])", replacement="\\1\0\\2")
        parts.append(pa.array([_CUT.split(x) for x in some.to_pylist()], pa.list_(pa.string())) if kind == 2 else pc.split_pattern(some, "\0"))
        rows.append(np.flatnonzero(mask.to_numpy(zero_copy_only=False)))
    if len(parts) == 1:
        return parts[0]
    return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(rows))))


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


class Encoder:
    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache_bytes = cache_bytes
        self.by_bytes = self.tokenizer.normalizer is None
        self.weight = np.zeros(self.tokenizer.get_vocab_size(), dtype=np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.weight[i] = len(token) if self.by_bytes else token.endswith("</w>")
        self._keep(pa.array([], pa.string()), np.empty(0, dtype=np.uint32), np.zeros(1, dtype=np.int64))

    def _keep(self, words: pa.Array, ids: np.ndarray, at: np.ndarray) -> None:
        self.words, self.ids, self.at = words, ids, at

    def _together(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and numbers of ids of pieces that all begin with a space or newline, encoded as one text without positions. Where a
        piece ends is told by its bytes, as a token of a byte-level vocabulary stands for a known number of them, or else by its
        pre-tokens, each of which ends with a token of its own kind. Should these not add up, the pieces are encoded one by one."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(pieces.to_pylist())], add_special_tokens=False)[0].ids, dtype=np.uint32)
        size = pc.binary_length(pieces) if self.by_bytes else pc.count_substring_regex(pieces, _PRE_TOKENS)
        wanted, at = np.cumsum(size.to_numpy(), dtype=np.int64), np.cumsum(self.weight[ids])
        ends = np.searchsorted(at, wanted) + 1
        if not len(at) or at[-1] != wanted[-1] or not np.array_equal(at[ends - 1], wanted):
            return self._apart(pieces)
        return ids, np.diff(ends, prepend=0)

    def _apart(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces.to_pylist(), add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], dtype=np.uint32), np.array([len(x) for x in found], dtype=np.int64)

    def _new(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces end to end, and the number of each."""
        pattern = r"^[ \n](?:[^\s]*[^\s<|])?[^\s<|]$" if self.by_bytes else r"^[ \n][!-&(-;=-{}~]+$"
        easy = pc.match_substring_regex(pieces, pattern).to_numpy(zero_copy_only=False)
        if self.by_bytes:  # a special token in the text is one token, whatever is around it
            easy &= ~pc.match_substring(pieces, "<|").to_numpy(zero_copy_only=False)
            easy &= ~pc.match_substring_regex(pieces, f"[{_WHITE}]$").to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(easy), np.flatnonzero(~easy)])
        parts = [f(pieces.filter(pa.array(mask))) for f, mask in ((self._together, easy), (self._apart, ~easy)) if mask.any()]
        ids, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return _gather(ids, _starts(counts)[back], counts[back]), counts[back]

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each begins (one more than there are texts); null is empty. With end_id, this id
        follows each text."""
        lists = cut(pc.fill_null(texts, ""))
        flat = lists.flatten().dictionary_encode()
        place = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        distinct = flat.dictionary
        held = pc.fill_null(pc.index_in(distinct, value_set=self.words), -1).to_numpy().astype(np.int64)
        fresh = distinct.filter(pa.array(held < 0))
        words, ids, at = self.words, self.ids, self.at
        if len(fresh):
            more, counts = self._new(fresh)
            held[held < 0] = len(words) + np.arange(len(fresh))
            words, ids, at = pa.concat_arrays([words, fresh]), np.concatenate([ids, more]), np.concatenate([at, at[-1] + np.cumsum(counts)])
            self._hold(words, ids, at, held)
        word = held[flat.indices.to_numpy()]
        begin, count = at[:-1][word], at[1:][word] - at[:-1][word]
        if end_id is not None:
            ids = np.append(ids, np.uint32(end_id))
            begin, count = np.insert(begin, place[1:], len(ids) - 1), np.insert(count, place[1:], 1)
            place = place + np.arange(len(place))
        return _gather(ids, begin, count), _starts(count)[place]

    def _hold(self, words: pa.Array, ids: np.ndarray, at: np.ndarray, used: np.ndarray) -> None:
        def size(words, ids):
            return words.nbytes + ids.nbytes + 8 * len(words)

        if size(words, ids) > self.cache_bytes:
            used = np.sort(used)
            count = at[1:][used] - at[:-1][used]
            words, ids, at = words.take(pa.array(used)), _gather(ids, at[:-1][used], count), _starts(count)
        if size(words, ids) <= self.cache_bytes:
            self._keep(words, ids, at)


def _gather(ids: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs ids[begin : begin + count], end to end."""
    starts = _starts(count)
    kind = np.int32 if starts[-1] < 2**31 > len(ids) else np.int64
    places = np.repeat((begin - starts[:-1]).astype(kind), count)
    places += np.arange(starts[-1], dtype=kind)
    return ids[places]


def encoder(path: str, cache_bytes: int = CACHE_BYTES) -> Encoder:
    """The worker's encoder for a tokenizer file and bound; it stays while the worker does."""
    if (path, cache_bytes) not in _encoders:
        _encoders[path, cache_bytes] = Encoder(path, cache_bytes)
    return _encoders[path, cache_bytes]


def let_go() -> None:
    """Drops the worker's encoders and gives freed memory back to the system. Workers are kept for later stages, which do not encode."""
    _encoders.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def batches_of(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many bytes of the column text, or of one row."""
    waiting: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(), dtype=np.int64)
        a, before = 0, 0
        while a < len(sizes):
            b = min(len(sizes), int(np.searchsorted(sizes, before + most - held)) + 1)
            waiting.append(batch.slice(a, b - a))
            held += int(sizes[b - 1]) - before
            a, before = b, int(sizes[b - 1])
            if held >= most:
                yield pa.concat_batches(waiting)
                waiting, held = [], 0
                pa.default_memory_pool().release_unused()
    if waiting:
        yield pa.concat_batches(waiting)
