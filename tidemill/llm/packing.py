"""Packing along a space-filling curve.

A document's token counts are hashed into ``DIMS`` signed dimensions, scaled to length 1 and projected on ``AXES``
fixed random axes; the coordinates, cut into ``2**BITS`` steps, give its Hilbert key.  Documents are
range-sorted by (key, id) and written into sequences of ``LENGTH`` tokens one after another along the curve; a
document that doesn't fit is cut at the sequence's end.  Only the last sequence can be short: padding is less than one
sequence for the whole table.

Tokenising is done once; token ids (compressed) lie in the shared folder while the light rows
(row, key, length) are sorted.  Positions come from running sums inside each sorted range and the
totals of the ranges before it, one number per range.

Null and empty texts have the end mark alone. Repeated rows and ids are packed one by one. An empty
table gives no piece.  Other columns play no part.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .store import Scratch

LENGTH = 1024
DIMS, AXES, BITS = 256, 4, 10
END = 0
SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=2)
def _encoder(path: str):
    """A function text -> ids of the tokenizer file; byte-level BPE files with a rank twin use that, with equal ids."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    twin = path.removesuffix(".json") + ".tiktoken"

    def plain(text: str) -> np.ndarray:
        return np.array(whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    try:
        import base64

        import public_tokenizers
        import tiktoken

        with open(twin, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    except (ImportError, OSError):
        return plain

    def quick(text: str) -> np.ndarray:
        if SPECIAL in text:  # the tokenizer file reads it as one id
            return plain(text)
        return np.array(fast.encode_ordinary(text), dtype=np.uint32)

    return quick


@lru_cache(maxsize=1)
def _axes(size: int = 1 << 17):
    rng = np.random.Generator(np.random.PCG64(7))
    return rng.integers(0, DIMS, size), rng.choice(np.array([-1.0, 1.0]), size), rng.normal(size=(DIMS, AXES))


def coordinates(ids: np.ndarray) -> np.ndarray:
    """Steps on each axis of the projected hashed token vector."""
    place, sign, axes = _axes()
    ids = ids % len(place)
    v = np.bincount(place[ids], sign[ids], DIMS)
    size = math.sqrt(float(v @ v))
    x = (v / size) @ axes if size else np.zeros(AXES)
    return np.clip((1 / (1 + np.exp(-1.7 * x)) * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of each row of non-negative integers below 2**bits (axes to transposed index, Gray code)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap if i else 0
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _tokenised(batches, path):
    import zstandard

    encode, pack = _encoder(path), zstandard.ZstdCompressor(level=1)
    for whole in batches:
        for k in range(0, whole.num_rows, 500):
            batch = whole.slice(k, 500)
            sizes, blobs, points = [], [], []
            for text in batch.column("text"):
                ids = encode(text.as_py() or "")
                points.append(coordinates(ids))
                ids = np.append(ids, np.uint32(END))
                sizes.append(len(ids))
                blobs.append(pack.compress((ids.astype(np.uint16) if ids.max() < 65536 else ids).tobytes()))
            keys = hilbert(np.array(points).reshape(-1, AXES))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(keys), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], ["row", "doc_id", "key", "tokens", "ids"])


def _running(batches):
    part, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column("tokens").to_numpy()
        after = total + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.full(len(n), part, np.int64)), pa.array(after - n), batch.column("tokens")], ["row", "part", "within", "tokens"])
        total = int(after[-1]) if len(after) else total


def _pieces(batches, length):
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        out = {k: [] for k in ("row", "start", "length", "crc", "seq", "offset")}
        where = batch.column("base").to_numpy()
        sizes = batch.column("tokens").to_numpy()
        for k in range(batch.num_rows):
            raw = unpack.decompress(batch.column("ids")[k].as_py(), max_output_size=8 * int(sizes[k]))
            ids = np.frombuffer(raw, np.uint16 if len(raw) == 2 * sizes[k] else np.uint32).astype("<u4")
            base, a = int(where[k]), 0
            while a < len(ids):
                b = min(len(ids), a + length - (base + a) % length)
                for c, v in zip(out, (k, a, b - a, zlib.crc32(ids[a:b].tobytes()), (base + a) // length, (base + a) % length), strict=True):
                    out[c].append(v)
                a = b
        rows = pa.array(out["row"], pa.int64())
        longs = [pa.array(out[c], pa.int64()) for c in ("start", "length", "crc", "seq", "offset")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(rows), *longs[:3], batch.column("tokens").take(rows), *longs[3:], batch.column("key").take(rows)],
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "curve_key"],
        )


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, curve_key``."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "packing")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    coded = scratch.put(rows.mapInArrow(lambda it: _tokenised(it, tokenizer), "row long, doc_id long, key long, tokens long, ids binary"), "coded")
    order = coded.select("row", "doc_id", "key", "tokens").repartitionByRange("key", "doc_id", "row").sortWithinPartitions("key", "doc_id", "row")
    placed = scratch.put(order.select("row", "tokens").mapInArrow(_running, "row long, part long, within long, tokens long"), "placed")
    totals = sorted(placed.groupBy("part").agg(F.sum("tokens").alias("n")).collect())  # one row per range
    bases, at = [], 0
    for part, n in totals:
        bases.append((part, at))
        at += n
    base = spark.createDataFrame(bases, "part long, before long")
    start = placed.join(F.broadcast(base), "part").select("row", (F.col("before") + F.col("within")).alias("base"))
    return coded.join(start, "row").drop("row").mapInArrow(
        lambda it: _pieces((b.slice(i, 500) for b in it for i in range(0, b.num_rows, 500)), length),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, curve_key long",
    )
