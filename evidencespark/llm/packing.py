"""Hierarchical multi-length packing of token ids into sequences of at most MAX_LENGTH.

Each document is cut into full windows and a rest. A packing shard is a run of documents of one partition with about
SHARD_PIECES pieces: nothing is shuffled, and equal rows or ids are no hot key. In a shard, the rests are routed to tiers
(2048, 1024, 512, ... by the power of two that holds them), and each tier is packed into windows of its own length, from
the longest to the shortest: its rests open windows, shorter rests fill the gaps, each in the fullest window that still
holds it, and then the emptiest windows of the tier are taken apart and cut to fill the gaps left in the others. What the
last window of a tier can't fill goes down to shorter tiers, so only the last window of the shortest is not full. Windows of
falling length are dealt in turn to step groups of STEP_WINDOWS, so that the steps of a shard hold nearly equal numbers of
windows of each tier and of ids.

Defined results: null and empty texts hold the end id alone; repeated rows are documents each; a null doc_id is packed
like any other; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .encoding import batches_of, encoder, let_go

MAX_LENGTH = 2048
SMALLEST_TIER = 64
END_ID = 1
SHARD_PIECES = 4096
STEP_WINDOWS = 16
#: Bounds of the encoder in a pipeline, smaller than its own: packing shares an executor's memory with what other stages left. They change
#: no result; packing alone takes the encoder's own bounds, as a worker that holds more pieces encodes fewer of them again.
CACHE_BYTES, BATCH_BYTES = 8 << 20, 1 << 20
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, step_group long, tier int, ids binary"


def pack_tier(own: list[tuple[int, int, int]], shorter: list[tuple[int, int, int]], capacity: int) -> tuple[list, list]:
    """own, shorter: pieces (rest, from, to), of the tier and of tiers below. Windows of the tier, all full but the last at most,
    and the shorter pieces that they do not take."""
    windows: list[list[tuple[int, int, int]]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    holds = np.zeros(capacity + 1, dtype=bool)
    left = []
    for k, piece in enumerate([*own, *shorter]):
        n = piece[2] - piece[1]
        gap = n + int(holds[n:].argmax())
        if holds[gap]:
            w = room[gap].pop()
            holds[gap] = bool(room[gap])
        elif k < len(own):
            w, gap = len(windows), capacity
            windows.append([])
        else:
            left.append(piece)
            continue
        windows[w].append(piece)
        room[gap - n].append(w)
        holds[gap - n] = gap > n
    fill = [sum(b - a for _, a, b in w) for w in windows]
    by_fill = sorted(range(len(windows)), key=lambda w: (fill[w], w))
    low, high = 0, len(by_fill) - 1
    while low < high:
        giver, taker = by_fill[low], by_fill[high]
        gap = capacity - fill[taker]
        if not gap:
            high -= 1
            continue
        i, a, b = windows[giver].pop()
        n = min(gap, b - a)
        windows[taker].append((i, b - n, b))
        fill[taker] += n
        fill[giver] -= n
        if a < b - n:
            windows[giver].append((i, a, b - n))
        if not windows[giver]:
            low += 1
    return sorted((w for w in windows if w), key=lambda w: -sum(b - a for _, a, b in w)), left


def pack_tiers(lengths: np.ndarray) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows (tier, pieces (rest, from, to)), each tier in windows of its own length."""
    pieces = [(i, 0, int(n)) for i, n in enumerate(lengths)]
    out, tier = [], MAX_LENGTH
    while pieces:
        pieces.sort(key=lambda p: (p[1] - p[2], p[0], p[1]))
        own = [p for p in pieces if tier == SMALLEST_TIER or 2 * (p[2] - p[1]) > tier]
        windows, pieces = pack_tier(own, pieces[len(own) :], tier)
        if windows and tier > SMALLEST_TIER and sum(b - a for _, a, b in windows[-1]) < tier:
            for i, a, b in windows.pop():
                half = min(b, a + tier // 2)  # a piece over half the tier is cut for the tiers below
                pieces += [(i, x, y) for x, y in ((a, half), (half, b)) if x < y]
        out += [(tier, w) for w in windows]
        tier //= 2
    return out


def _narrow(piece: np.ndarray) -> bytes:
    """Two bytes an id where all fit, else four."""
    return piece.astype("<u2" if piece.max() < 1 << 16 else "<u4").tobytes()


def _step_groups(fills: np.ndarray, base: int) -> np.ndarray:
    """The step group of each window: windows by falling fill, so tier after tier, dealt to the groups forth and back."""
    groups = max(1, -(-len(fills) // STEP_WINDOWS))
    lap, at = np.divmod(np.arange(len(fills)), groups)
    out = np.empty(len(fills), dtype=np.int64)
    out[np.argsort(-fills, kind="stable")] = base + np.where(lap % 2 == 0, at, groups - 1 - at)
    return out


def pack_shard(pieces: list[tuple], base: int, keep_ids: bool) -> pa.RecordBatch:
    """pieces: (doc_id, start, length, ids_crc32, doc_tokens, ids of a rest or None). The packed rows, with sequence ids from base on."""
    full = [p for p in pieces if p[5] is None]
    rests = [p for p in pieces if p[5] is not None]
    rows = [(*p[:5], base + i, 0, MAX_LENGTH, None) for i, p in enumerate(full)]
    fills = [MAX_LENGTH] * len(full)
    for tier, window in pack_tiers(np.array([p[2] for p in rests], dtype=np.int64)):
        offset = 0
        for i, a, b in window:
            doc_id, start, length, crc, whole, data = rests[i]
            ids = np.frombuffer(data, dtype="<u2" if len(data) == 2 * length else "<u4")[a:b].astype("<u4")
            rows.append((doc_id, start + a, b - a, crc if b - a == length else zlib.crc32(ids), whole, base + len(fills), offset, tier, ids.tobytes() if keep_ids else None))
            offset += b - a
        fills.append(offset)
    group = _step_groups(np.array(fills, dtype=np.int64), base)
    columns = [*zip(*rows)]
    columns.insert(7, group[np.array(columns[5]) - base])
    types = [pa.int64()] * 8 + [pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], [x.split()[0] for x in PACKED.split(", ")])


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID, shard_pieces: int = SHARD_PIECES, keep_ids: bool = True, cache_bytes: int = CACHE_BYTES, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, step_group, tier, ids (of pieces of
    packed rests, null unless keep_ids; a full window's are those of its range of the document)."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        encode = encoder(tokenizer, cache_bytes).encode
        held: list[tuple] = []
        for batch in batches_of(batches, batch_bytes):
            ids, starts = encode(batch["text"], end_id)
            for at, end, key in zip(starts.tolist(), starts[1:].tolist(), batch["doc_id"].to_pylist()):
                for a in range(at, end, MAX_LENGTH):
                    piece = ids[a : min(end, a + MAX_LENGTH)]
                    held.append((key, a - at, len(piece), zlib.crc32(piece.astype("<u4", copy=False)), end - at, _narrow(piece) if len(piece) < MAX_LENGTH else None))
                if len(held) >= shard_pieces:
                    out = pack_shard(held, base, keep_ids)
                    base, held = out["sequence_id"][-1].as_py() + 1, []
                    yield out
        if held:
            yield pack_shard(held, base, keep_ids)
        encode = held = batch = ids = None  # or the encoder and its last batch stay
        let_go()

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(packed, PACKED), "packed")


def pack_documents(docs: DataFrame, tokenizer: str, cache_bytes: int = CACHE_BYTES, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    return pack(docs, tokenizer, keep_ids=False, cache_bytes=cache_bytes, batch_bytes=batch_bytes).drop("ids")
