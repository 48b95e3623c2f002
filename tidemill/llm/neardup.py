"""Near-duplicate documents: MinHash bands find candidates, odd sketches prune them, full sets decide.

A document's set holds its distinct ``shingle``-word shingles (words are runs of
bytes other than 0x20 and 0x09-0x0D, A-Z folded); with fewer words the whole
sequence is the one element; without words the set is empty and linked with nothing.
Two documents are linked when 100 * |A & B| >= percent * |A | B|.

Steps, all of them distributed:

1. One pass over the texts writes a small row per document: set size, a 128-bit
   key of the set, ``BANDS`` band keys of a 128-value MinHash sample, and the odd
   sketch (the sample's values toggled into a 512-bit parity map).
2. Documents with equal sets form a class, which has a number of its own and goes on as
   one row, so a class of any size costs one row from here.
3. Within each bucket of a band, every member is paired with the bucket's
   smallest number (a star: as many pairs as members).  A pair whose odd sketches'
   XOR population count shows a similarity far below the limit is dropped; for the rest
   the full sets are intersected.
4. Connected components over the confirmed links.  Buckets whose members still lie in
   different components are examined completely, in blocks of members that fit
   a task: only pairs from different components are compared, and a block
   returns a spanning forest, never its pairs.
5. Components again, then ids are carried back to all members of the classes.

A pair at similarity 0.8 shares no bucket with probability (1 - 0.8**4)**32 < 5e-8.

Rows are told apart by their texts, not by their ids: rows that repeat an id with another text are documents of
their own, in components of their own.  A component's id is the smallest ``doc_id`` among its rows; rows without an id take
part, and ``component_id`` is null where no row of a component has one.  ``kept`` says whether ``doc_id`` and ``component_id``
are the same (null and null are).  Null ``text`` counts as empty; other columns play no part.
Very long texts are read whole; their sets are as long as they are.  An empty table gives an empty result.

Shingles are compared by 64-bit hashes and equal sets found by 128-bit sums over them: two shingles of one pair of
documents with ``n`` of them are taken for equal with probability n**2 / 2**64, two sets with 2**-128.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import vectext as V
from .components import components
from .store import Scratch, row_key

ROWS, BANDS, ODD_WORDS = 4, 32, 8
SAMPLES = ROWS * BANDS
ODD_BITS = 64 * ODD_WORDS
#: Estimates this far below the limit are dropped: over six standard errors of a 128-value sample.
MARGIN = 0.25
#: Shingles and documents in one block of a mixed bucket, about; a task holds two blocks.
BLOCK, BLOCK_DOCS = 500_000, 4000
_SKETCH = "doc_id long, rid long, mark long, n_shingles long, k1 long, k2 long, bands array<long>, odd array<long>"


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    data, offsets = V.utf8(column)
    for i, j in V.slices(offsets):
        part = data[offsets[i] : offsets[j]]
        h, _, _, row = V.words(part, offsets[i : j + 1] - offsets[i])
        at = V.row_bounds(row, 0, j - i)
        run = np.zeros(max(len(h) - width + 1, 0), np.uint64)
        for k in range(width):
            run += h[k : k + len(run)] * V.MULT[k]
        run = V.mix(run)
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= width:
                yield np.unique(run[a : b - width + 1])
            elif b > a:
                own = h[a:b] * V.MULT[100 : 100 + b - a]
                yield V.mix(np.array([own.sum(dtype=np.uint64) + np.uint64(int(b - a))], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def _minima(x: np.ndarray) -> np.ndarray:
    best = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(x), 1024):
        v = x[k : k + 1024] * V.MULT[:SAMPLES, None]
        v += V.ADD[:SAMPLES, None]
        np.minimum(best, v.min(axis=1), out=best)
    return best


def _longs(a: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(a).view(np.int64).reshape(-1))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.__len__() + 1, a.shape[1], dtype=np.int32)), flat)


def sketch_rows(batch: pa.RecordBatch, width: int) -> pa.RecordBatch:
    n = batch.num_rows
    sizes, keys = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64)
    sample = np.zeros((n, SAMPLES), np.uint64)
    for i, s in enumerate(shingle_sets(batch.column("text"), width)):
        if len(s):
            sizes[i] = len(s)
            keys[i] = (V.mix(s).sum(dtype=np.uint64), (V.mix(s ^ V.ADD[300]) * V.MULT[301]).sum(dtype=np.uint64))
            sample[i] = _minima(s)
    mixed = V.mix(sample)
    groups = mixed.reshape(n, BANDS, ROWS) * V.MULT[400 : 400 + ROWS]
    bands = V.mix(groups.sum(axis=2, dtype=np.uint64) + V.ADD[:BANDS])
    bit = (V.mix(mixed + V.ADD[:SAMPLES]) >> np.uint64(64 - int(math.log2(ODD_BITS)))).astype(np.int64)
    odd = np.zeros((n, ODD_BITS), np.int64)
    np.add.at(odd, (np.repeat(np.arange(n), SAMPLES), bit.reshape(-1)), 1)
    packed = np.packbits((odd & 1).astype(np.uint8), axis=1).view(np.uint64)
    return pa.RecordBatch.from_arrays(
        [*(batch.column(c) for c in ("doc_id", "rid", "mark")), pa.array(sizes), pa.array(keys[:, 0].view(np.int64)), pa.array(keys[:, 1].view(np.int64)), _longs(bands), _longs(packed)],
        ["doc_id", "rid", "mark", "n_shingles", "k1", "k2", "bands", "odd"],
    )


def estimate(a: str, b: str):
    """Similarity that the XOR population count of two odd sketches suggests."""
    differ = F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    inner = F.greatest(F.lit(1.0) - 2.0 * differ / ODD_BITS, F.lit(1e-6))
    return F.lit(1.0) + F.log(inner) * (ODD_BITS / (4.0 * SAMPLES))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    lo, hi = sorted((len(a), len(b)))
    if 100 * lo < percent * hi or not lo:
        return False
    both = overlap(a, b)
    return 100 * both >= percent * (lo + hi - both)


def _sets_of(batches, width):
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            sets = [s.view(np.int64) for s in shingle_sets(part.column("text"), width)]
            at = np.cumsum([0, *map(len, sets)])
            flat = pa.array(np.concatenate(sets)) if sets else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.LargeListArray.from_arrays(pa.array(at), flat).cast(pa.list_(pa.int64()))], ["id", "items"])


def _unsigned(column: pa.Array, i: int) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False).view(np.uint64)


def _confirm(batches, percent):
    for batch in batches:
        a, b = batch.column("a_items"), batch.column("b_items")
        ok = [linked(_unsigned(a, i), _unsigned(b, i), percent) for i in range(batch.num_rows)]
        yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))


def _forest(table: pa.Table, percent: int) -> pa.Table:
    """Links that join different components, of one block or between two (p < q): a spanning forest."""
    ids, comps, side = (table.column(c).to_numpy() for c in ("id", "comp", "own"))
    within = table.column("p")[0].as_py() == table.column("q")[0].as_py()
    items = table.column("items").combine_chunks()
    sets = [_unsigned(items, i) for i in range(len(ids))]
    sizes = np.array([len(s) for s in sets])
    flat = table.column("odd").combine_chunks().flatten()
    odd = flat.to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(ids), ODD_WORDS)
    order = np.argsort(sizes, kind="stable")
    parent = {int(c): int(c) for c in comps}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    most = ODD_BITS / 2 * (1 - math.exp(-4.0 * SAMPLES / ODD_BITS * (1 - percent / 100 + MARGIN)))
    out = []
    for k, i in enumerate(order):
        rest = order[k + 1 :]
        rest = rest[(100 * sizes[i] >= percent * sizes[rest]) & (within | (side[rest] != side[i]))]
        near = np.bitwise_count(odd[rest] ^ odd[i]).sum(axis=1)
        for j in rest[near <= most]:
            x, y = root(int(comps[i])), root(int(comps[j]))
            if x != y and linked(sets[i], sets[j], percent):
                parent[x] = y
                out.append((int(ids[i]), int(ids[j])))
    u, v = zip(*out, strict=True) if out else ((), ())
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _rows(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, rid, mark, n_shingles, component_id, first`` of each row; ``first``: whether no row of its component comes before it by id and mark."""
    spark: SparkSession = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "neardup")
    key = row_key(id_col, text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), *key, F.col(text_col).cast("string").alias("text"))
    known = scratch.put(
        texts.mapInArrow(lambda it: (sketch_rows(b.slice(i, 500), shingle) for b in it for i in range(0, b.num_rows, 500)), _SKETCH),
        "sketches",
    )
    # Rows without an id come last.
    place = F.struct(F.col("doc_id").isNull().alias("none"), "rid", "mark").alias("place")
    classes = known.filter("n_shingles > 0").groupBy("k1", "k2").agg(F.min(place).alias("place"))
    classes = scratch.put(classes.select(F.monotonically_increasing_id().alias("id"), "k1", "k2", "place"), "classes")  # written: its numbers stay
    heads = scratch.put(
        known.join(classes.select("id", "k1", "k2", "place.rid", "place.mark"), ["k1", "k2", "rid", "mark"]).dropDuplicates(["k1", "k2", "rid", "mark"])
        .select("id", "rid", "mark", "n_shingles", "bands", "odd"),
        "heads",
    )
    spread = heads.select("id", "n_shingles", F.explode("bands").alias("bucket"))
    hubs = spread.groupBy("bucket").agg(F.min("id").alias("hub"), F.count("*").alias("members")).filter("members > 1")
    hubs = scratch.put(hubs, "hubs")  # a join of two shuffles, whose hot partitions Spark can split
    member = scratch.put(spread.join(hubs, "bucket"), "members")

    wanted = heads.join(member.select("id").distinct(), "id").select("id", "rid", "mark")
    sets = scratch.put(
        texts.select("rid", "mark", "text").join(wanted, ["rid", "mark"]).dropDuplicates(["rid", "mark"]).select("id", "text").mapInArrow(lambda it: _sets_of(it, shingle), "id long, items array<long>"),
        "sets",
    )
    small = heads.select("id", "n_shingles", "odd")
    left = small.select(F.col("id").alias("u"), F.col("n_shingles").alias("nu"), F.col("odd").alias("ou"))
    right = small.select(F.col("id").alias("v"), F.col("n_shingles").alias("nv"), F.col("odd").alias("ov"))
    plausible = (
        member.filter("id <> hub").select(F.col("hub").alias("u"), F.col("id").alias("v")).distinct()
        .join(left, "u").join(right, "v")
        .filter(100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv"))
        .filter(estimate("ou", "ov") >= percent / 100 - MARGIN)
        .select("u", "v")
    )
    pairs = plausible.join(sets.select(F.col("id").alias("v"), F.col("items").alias("b_items")), "v").join(sets.select(F.col("id").alias("u"), F.col("items").alias("a_items")), "u")
    links = scratch.put(pairs.mapInArrow(lambda it: _confirm(it, percent), "u long, v long"), "links")
    first = scratch.put(components(links, scratch, "first"), "first")

    tagged = member.select("bucket", "id", "members", "n_shingles").join(first, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    mixed = tagged.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum("n_shingles").alias("load"), F.max("members").alias("m"), F.expr("bit_xor(xxhash64(id))").alias("who")).filter("lo <> hi and m > 2")
    # Bands with the same members are examined once.
    parts = F.ceil(F.greatest(F.max("load") / BLOCK, F.max("m") / BLOCK_DOCS)).cast("int")
    mixed = scratch.put(mixed.groupBy("who").agg(F.min("bucket").alias("bucket"), parts.alias("parts")).drop("who"), "mixed")
    blocks = (
        tagged.select("bucket", "id", "comp").join(mixed, "bucket")
        .withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("bucket", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "id", "comp")
        .join(sets, "id").join(heads.select("id", "odd"), "id")
    )
    more = scratch.put(blocks.groupBy("bucket", "p", "q").applyInArrow(lambda t: _forest(t, percent), "u long, v long"), "more")
    if more.isEmpty():
        final = first
    else:
        # The nodes of the second graph are the components that are already known.
        def comp_of(df, c):
            names = first.select(F.col("id").alias(c), F.col("comp").alias(f"{c}c"))
            return df.join(names, c, "left").withColumn(c, F.coalesce(f"{c}c", c)).drop(f"{c}c")

        second = components(comp_of(comp_of(more, "u"), "v"), scratch, "second").select(F.col("id").alias("comp"), F.col("comp").alias("to"))
        nodes = first.union(more.select(F.explode(F.array("u", "v")).alias("id")).distinct().join(first, "id", "left_anti").select("id", F.col("id").alias("comp")))
        final = scratch.put(nodes.join(second, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")), "final")
    # A class alone in its component has no entry in ``final``: its own number stands.
    named = classes.join(final, "id", "left").select("k1", "k2", "place", F.coalesce("comp", "id").alias("comp"))
    least = named.groupBy("comp").agg(F.min("place").alias("least"))  # combined in the map tasks
    named = scratch.put(named.select("k1", "k2", "comp").join(least, "comp"), "named")
    linked = (
        known.filter("n_shingles > 0").select("doc_id", "rid", "mark", "n_shingles", "k1", "k2")
        .join(named, ["k1", "k2"])
        .select("doc_id", "rid", "mark", "n_shingles", F.when(~F.col("least.none"), F.col("least.rid")).alias("component_id"), (place == F.col("least")).alias("first"))
    )
    alone = known.filter("n_shingles = 0").select("doc_id", "rid", "mark", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    return linked.unionByName(alone)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row; see the module's text."""
    found = _rows(docs, shingle, percent, id_col, text_col)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all columns: the one with the smallest id (rows without an id last; texts of one id by hash).

    Rows equal in id and text are one document, of which one row stays.  Documents without words are linked with nothing and stay.
    """
    kept = _rows(docs, shingle, percent, id_col, text_col).filter("first").select(F.col("rid").alias("__rid"), F.col("mark").alias("__mark"))
    rid, mark = row_key(id_col, text_col)
    both = docs.select("*", rid.alias("__rid"), mark.alias("__mark")).join(kept, ["__rid", "__mark"], "left_semi")
    return both.dropDuplicates(["__rid", "__mark"]).drop("__rid", "__mark")
