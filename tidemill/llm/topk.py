"""Exact top-k by inner product over vectors in descending order of length.

Vectors are lists of numbers; component x counts as the integer floor(``scale`` * x). Vectors that are null or hold null or
non-finite components take no part.  Shorter vectors are read as ending in zeros. Scores are exact while
they stay below 2**53.

Vectors are range-sorted by length, longest first, and stored as blocks of at most ``BLOCK`` rows.  Blocks are met in rounds
of descending length: the ``ROUNDS`` first ones in small rounds, then the rest.  After each round every query has its k best so far, whose
least score bounds what can still matter; queries are sorted by the length that a vector needs to reach their bound (Cauchy-Schwarz) and put into blocks of
``QUERIES`` with similar needs, and a block of queries meets a block of vectors only if the longest of these has the least need's length.
Inside a meeting, products are summed over the first ``HEAD`` axes of a rotation (the singular vectors of a bounded sample, strongest
first) and pairs are dropped when this partial sum plus the product of the remaining lengths stays below the bound; the rest are computed
exactly.  Each meeting returns k rows a query at most, and the best k of those are the result: ties go to the smaller id.

A query is never its own candidate (rows that share its id are left out).  Rows that repeat an id are candidates one by one;
queries that share an id give the answers of the first by content.  Empty tables give an empty result; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .store import Scratch

SCALE, BLOCK, QUERIES, HEAD, SAMPLE = 256, 4096, 512, 24, 4096
ROUNDS = (1, 8, 64)
_BLOCKS = "part long, longest double, least double, ids binary, vectors binary, bounds binary"


def _whole(batches, scale):
    """Ids, lengths and components of the vectors that take part."""
    for batch in batches:
        ids, lists = batch.column("vec_id"), batch.column("embedding")
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls are NaN
        row = np.repeat(np.arange(len(lists)), sizes)
        ok = pc.and_(ids.is_valid(), lists.is_valid()).to_numpy(zero_copy_only=False) & (np.bincount(row[~np.isfinite(flat)], minlength=len(lists)) == 0)
        own = ok[row]
        values = np.floor(scale * flat[own])
        length = np.sqrt(np.bincount(row[own], values * values, minlength=len(lists)))[ok]
        ends = np.concatenate([[0], np.cumsum(sizes[ok])]).astype(np.int32) * 8
        vectors = pa.Array.from_buffers(pa.binary(), int(ok.sum()), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(values.tobytes())])
        yield pa.RecordBatch.from_arrays([ids.filter(pa.array(ok)), pa.array(length), vectors], ["vec_id", "size", "vector"])


def _stacked(batches, rows, dims):
    """Consecutive rows as blocks of whole matrices; ``size`` orders them, ``bound`` may be missing."""
    from pyspark import TaskContext

    me, at, held, count = TaskContext.get().partitionId(), 0, [], 0

    def block(table):
        m = np.zeros((len(table), dims))
        for k, v in enumerate(table["vector"].to_pylist()):
            m[k, : len(v) // 8] = np.frombuffer(v)
        size = table["size"].to_numpy()
        bounds = table["bound"].to_numpy().astype(np.float64).tobytes() if "bound" in table.column_names else None
        row = [(me << 32) + at, float(size.max()), float(size.min()), table["vec_id"].to_numpy().astype(np.int64).tobytes(), m.tobytes(), bounds]
        kinds = (pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], ["part", "longest", "least", "ids", "vectors", "bounds"])

    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        while count >= rows:
            whole = pa.Table.from_batches(held)
            yield block(whole.slice(0, rows))
            held, at, count = whole.slice(rows).to_batches(), at + 1, count - rows
    if count:
        yield block(pa.Table.from_batches(held))


def meet(qid, q, bound, vid, v, rotation, k):
    """Per query: ids and scores of its best k among one block that reach its bound (block sorted by length, longest first)."""
    qr, vr = q @ rotation, v @ rotation
    qn, vn = np.sqrt((q * q).sum(1)), np.sqrt((v * v).sum(1))
    head = qr[:, :HEAD] @ vr[:, :HEAD].T
    rest = np.sqrt(np.maximum((qr[:, HEAD:] ** 2).sum(1), 0))[:, None] * np.sqrt(np.maximum((vr[:, HEAD:] ** 2).sum(1), 0))[None, :]
    most = head + rest
    out = []
    for i in range(len(qid)):
        reach = int(np.searchsorted(-vn * qn[i], -(bound[i] - 1e-6 * (1 + abs(bound[i]))), "right")) if qn[i] else len(vid)
        slack = 1e-6 * (1 + qn[i] * (vn[0] if len(vn) else 0))
        order = np.flatnonzero((most[i, :reach] >= bound[i] - slack) & (vid[:reach] != qid[i]))
        best_id, best = np.zeros(0, np.int64), np.zeros(0)
        limit = bound[i]
        for a in range(0, len(order), 512):
            some = order[a : a + 512]
            some = some[most[i, some] >= limit - slack]
            if not len(some):
                continue
            ids, score = np.append(best_id, vid[some]), np.append(best, v[some] @ q[i])
            top = np.lexsort((ids, -score))[:k]
            best_id, best = ids[top], score[top]
            if len(best) == k:
                limit = max(limit, best[-1])
        ok = best >= bound[i]
        out.append((best_id[ok], best[ok].astype(np.int64)))
    return out


def _met(batches, rotation, k):
    dims = len(rotation)
    for batch in batches:
        for r in batch.to_pylist():
            qid, vid = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
            q, v = np.frombuffer(r["q_vectors"]).reshape(-1, dims), np.frombuffer(r["vectors"]).reshape(-1, dims)
            found = meet(qid, q, np.frombuffer(r["bounds"]), vid, v, rotation, k)
            who = np.repeat(qid, [len(a) for a, _ in found])
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(np.concatenate([a for a, _ in found])), pa.array(np.concatenate([b for _, b in found]))], ["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest scores among ``vectors`` other than itself."""
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "topk")
    kind = "vec_id long, size double, vector binary"

    def whole(df):
        return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding")).mapInArrow(lambda it: _whole(it, scale), kind)

    plain = scratch.put(whole(vectors), "plain")
    asked = scratch.put(whole(queries).groupBy("vec_id").agg(F.min(F.struct("vector", "size")).alias("x")).select("vec_id", "x.size", "x.vector"), "asked")
    dims = max(plain.agg(F.max(F.length("vector"))).first()[0] or 0, asked.agg(F.max(F.length("vector"))).first()[0] or 0) // 8
    dims = max(dims, 1)
    # The rotation only steers pruning; a bounded sample is enough.
    sample = [np.frombuffer(r[0]) for r in plain.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").collect()]
    m = np.zeros((len(sample), dims))
    for i, a in enumerate(sample):
        m[i, : len(a)] = a
    rotation = np.linalg.svd(m.T @ m)[0] if len(sample) else np.eye(dims)

    sorted_ = plain.repartitionByRange(F.desc("size"), "vec_id").sortWithinPartitions(F.desc("size"), "vec_id")
    blocks = scratch.put(sorted_.mapInArrow(lambda it: _stacked(it, BLOCK, dims), _BLOCKS), "blocks")
    lead = [(r["part"], r["longest"]) for r in blocks.orderBy(F.desc("longest"), "part").limit(sum(ROUNDS)).select("part", "longest").collect()]

    def ready(best, name):
        """Queries in blocks of similar needs, with each one's k-th score so far."""
        rows = asked.withColumn("bound", F.lit(float("-inf")))
        if best is not None:
            last = best.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("bound"))
            rows = asked.join(last, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
        need = F.when(F.col("bound") > 0, F.col("bound") / F.greatest("size", F.lit(1e-300))).otherwise(0.0)
        rows = rows.select("vec_id", need.alias("size"), "vector", "bound").repartitionByRange("size", "vec_id").sortWithinPartitions("size", "vec_id")
        made = rows.mapInArrow(lambda it: _stacked(it, QUERIES, dims), _BLOCKS)
        return scratch.put(made.select(F.col("part").alias("q_part"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), "bounds", F.col("least").alias("need")), name)

    def met(asks, meets, best, name):
        """The best k of each query after some meetings (q_part, part)."""
        both = meets.join(blocks.select("part", "ids", "vectors"), "part").join(asks, "q_part").select("q_ids", "q_vectors", "bounds", "ids", "vectors")
        found = both.mapInArrow(lambda it: _met(it, rotation, k), "query_id long, vec_id long, score long")
        found = found if best is None else found.unionByName(best.drop("rank"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return scratch.put(top, name) if name else top

    best, at = None, 0
    for n, size in enumerate(ROUNDS):
        some = lead[at : at + size]
        if not some:
            break
        at += size
        asks = ready(best, f"asks-{n}")
        listed = F.explode(F.array(*[F.struct(F.lit(p).cast("long").alias("part"), F.lit(x).alias("longest")) for p, x in some]))
        meets = asks.select("q_part", "need", listed.alias("b")).filter("b.longest >= need * (1 - 1e-9)").select("q_part", "b.part")
        best = met(asks, meets, best, f"best-{n}")
    result = ["query_id", "rank", "vec_id", "score"]
    if best is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rest = blocks.filter(~F.col("part").isin([p for p, _ in lead]))
    left = rest.count()
    if left:
        # Which block meets which is decided on their numbers alone: a block of queries is sent to the blocks that can matter.
        asks = ready(best, "asks")
        lanes = max(1, left // 1000)  # a lane lists about a thousand blocks
        sizes = rest.groupBy(F.pmod(F.xxhash64("part"), F.lit(lanes)).alias("lane")).agg(F.collect_list(F.struct("part", "longest")).alias("all"))
        needs = asks.select("q_part", "need", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))).alias("lane"))
        meets = needs.join(sizes, "lane").select("q_part", "need", F.explode("all").alias("b")).filter("b.longest >= need * (1 - 1e-9)").select("q_part", "b.part")
        best = met(asks, meets, best, None)
    return best.select(*result)
