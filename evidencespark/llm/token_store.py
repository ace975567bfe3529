"""Token ids as binary: patched frame-of-reference blocks, written and read back by Spark.

A block holds BLOCK ids. It stores their minimum, the offsets from it packed at a bit width that fits PERCENTILE of
them, and the rest as exceptions: a list of places and of the high bits that did not fit. A segment is a run of
documents in ascending doc_id order: the packed blocks end to end, the byte at which each block starts, and the
document boundaries, so that a document is read by decoding only the blocks that it touches.

The store is a folder of Parquet files with a segment a row, range-partitioned by doc_id; Spark's committer makes the
write safe against lost and repeated tasks. Global positions are the segment's own plus the ids of all parts before it.

Defined results: null and empty texts hold the end id alone; a null doc_id comes first; repeated rows are documents each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, new_path
from .encoding import batches_of, encoder

BLOCK = 256
PERCENTILE = 0.95
END_ID = 0
SEGMENT_IDS = 1 << 17
SEGMENT = "part int, segment int, first long, n_ids long, payload binary, block_starts array<int>, doc_ids array<long>, doc_starts array<long>"


_HEAD = np.dtype([("m", "<u4"), ("n", "<u2"), ("w", "u1"), ("h", "u1"), ("e", "<u2")])


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def _rank(rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For exceptions given by their blocks, rising: how many each block has, and the place of each in its block's list."""
    counts = np.bincount(rows, minlength=n)
    return counts, np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)


def encode_blocks(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> tuple[bytes, np.ndarray]:
    """The packed blocks, and the byte at which each starts. Layout of a block: minimum u4, count u2, width u1, high-bits
    width in bytes u1 (0, 2 or 4), exceptions u2, packed offsets, places u1 or u2, high bits."""
    n = len(ids)
    if not n:
        return b"", np.empty(0, dtype=np.int32)
    blocks = -(-n // block)
    padded = np.full(blocks * block, ids[-1], dtype=np.int64)
    padded[:n] = ids
    table = padded.reshape(blocks, block)
    least = table.min(axis=1)
    offsets = table - least[:, None]
    at = min(block - 1, int(np.ceil(percentile * block)) - 1)
    width = _widths(np.partition(offsets, at, axis=1)[:, at])
    rows, places = np.nonzero(offsets >> width[:, None])
    high = offsets[rows, places] >> width[rows]
    found, k = _rank(rows, blocks)
    most = np.zeros(blocks, dtype=np.int64)
    np.maximum.at(most, rows, high)
    place_size = 1 if block <= 256 else 2
    head = np.zeros(blocks, dtype=_HEAD)
    head["m"], head["w"], head["e"] = least, width, found
    head["n"] = np.minimum(n - np.arange(blocks) * block, block)
    head["h"] = np.where(found == 0, 0, np.where(most < 1 << 16, 2, 4))
    body = -(-block * width // 8)
    sizes = _HEAD.itemsize + body + found * (place_size + head["h"])
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), dtype=np.uint8)

    def put(at: np.ndarray, values: np.ndarray) -> None:
        out[at[:, None] + np.arange(values.shape[1])] = values

    put(starts, head.view(np.uint8).reshape(blocks, -1))
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        low = offsets[own].astype("<u2" if w <= 16 else "<u4")
        bits = np.unpackbits(low.view(np.uint8), axis=1, bitorder="little").reshape(len(own), block, -1)[:, :, :w]
        put(starts[own] + _HEAD.itemsize, np.packbits(bits.reshape(len(own), -1), axis=1, bitorder="little"))
    lists = (starts + _HEAD.itemsize + body)[rows]
    put(lists + k * place_size, places.astype("<u2").view(np.uint8).reshape(-1, 2)[:, :place_size])
    for size in (2, 4):
        own = head["h"][rows] == size
        put((lists + found[rows] * place_size + k * size)[own], high[own].astype("<u4").view(np.uint8).reshape(-1, 4)[:, :size])
    return out.tobytes(), starts.astype(np.int32)


def decode_blocks(payload: bytes, starts: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The ids of the given blocks, in order."""
    if not len(starts):
        return np.empty(0, dtype=np.uint32)
    data = np.frombuffer(payload, dtype=np.uint8)
    starts = np.asarray(starts, dtype=np.int64)

    def get(at: np.ndarray, size: int) -> np.ndarray:
        return data[at[:, None] + np.arange(size)]

    head = get(starts, _HEAD.itemsize).view(_HEAD)[:, 0]
    width, found = head["w"].astype(np.int64), head["e"].astype(np.int64)
    body = -(-block * width // 8)
    ids = np.zeros((len(starts), block), dtype=np.int64)
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        bits = np.unpackbits(get(starts[own] + _HEAD.itemsize, -(-block * w // 8)), axis=1, bitorder="little", count=block * w)
        whole = np.zeros((len(own), block, 16 if w <= 16 else 32), dtype=np.uint8)
        whole[:, :, :w] = bits.reshape(len(own), block, w)
        ids[own] = np.packbits(whole.reshape(len(own), -1), axis=1, bitorder="little").view("<u2" if w <= 16 else "<u4")
    place_size = 1 if block <= 256 else 2
    rows = np.repeat(np.arange(len(starts)), found)
    _, k = _rank(rows, len(starts))
    lists = (starts + _HEAD.itemsize + body)[rows]
    places = np.zeros((len(rows), 2), dtype=np.uint8)
    places[:, :place_size] = get(lists + k * place_size, place_size)
    places = places.view("<u2")[:, 0]
    for size in (2, 4):
        own = head["h"][rows] == size
        high = get((lists + found[rows] * place_size + k * size)[own], size).view(f"<u{size}")[:, 0].astype(np.int64)
        ids[rows[own], places[own]] |= high << width[rows[own]]
    ids += head["m"].astype(np.int64)[:, None]
    keep = np.arange(block) < head["n"].astype(np.int64)[:, None]
    return ids[keep].astype(np.uint32)


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, partitions: int | None = None) -> None:
    """docs: doc_id, text. Writes the store."""
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, segment, first = TaskContext.get().partitionId(), 0, 0
        encode = encoder(tokenizer).encode
        for batch in batches_of(batches):
            ids, starts = encode(batch["text"], end_id)
            a = 0
            while a < batch.num_rows:  # whole documents, up to SEGMENT_IDS ids or one document
                b = max(a + 1, int(np.searchsorted(starts, starts[a] + SEGMENT_IDS, side="right")) - 1)
                payload, blocks = encode_blocks(ids[starts[a] : starts[b]])
                size = int(starts[b] - starts[a])
                row = [[part], [segment], [first], [size], [payload], [blocks], [batch["doc_id"][a:b].to_pylist()], [starts[a:b] - starts[a]]]
                types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types)], [x.split()[0] for x in SEGMENT.split(", ")])
                segment, first, a = segment + 1, first + size, b

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("row"))
    # The range is over the hash of the text as well, so that rows of one doc_id are not all in one part.
    ordered = ordered.repartitionByRange(n, "doc_id", "row").sortWithinPartitions("doc_id", "row").drop("row")
    with bounded_batches(docs.sparkSession):
        ordered.mapInArrow(segments, SEGMENT).write.parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) from a store."""
    store = spark.read.schema(SEGMENT).parquet(path)
    parts = store.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row a part
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("base"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, first, n, payload = (batch.column(i)[row].as_py() for i in (0, 2, 3, 4))
                starts, begin = (batch.column(i)[row].values.to_numpy() for i in (5, 7))
                ids = decode_blocks(payload, starts).astype("<u4").tobytes()
                at = [*begin.tolist(), n]
                pieces = [ids[a * 4 : b * 4] for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(pieces), part), pa.int32()), batch.column(6)[row].values,
                        pa.array(first + begin, pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(pieces, pa.binary()),
                    ],
                    ["part", "doc_id", "within", "n_tokens", "ids"],
                )

    found = store.mapInArrow(decode, "part int, doc_id long, within long, n_tokens long, ids binary")
    return found.join(F.broadcast(parts), "part").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids")


def token_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from a store written for it."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, tokenizer, path)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


