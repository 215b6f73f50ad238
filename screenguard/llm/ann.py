"""Approximate nearest neighbours by inner product: randomly rotated one-bit codes.

A vector's code is the signs of its rotated components, one packed bit each. With the
code go two scalars: the vector's norm over the cosine between the rotated unit vector and
its sign vector, and the width of the error bound. A rotated query is cut into a few bit
planes; counts of the bits that a code and a plane share give an unbiased estimate of the
inner product with a known error bound. The best estimates are computed exactly first; the
k-th of them is a floor, and only vectors whose estimate plus bound reach the floor are
reranked on the original components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import prepare

#: Vectors of one block of the index, and queries of one block.
BLOCK, QUERIES = 16_384, 2_048
#: Widths of the error bound; at 3 nearly no true neighbour falls outside.
WIDTH = 3.0
#: Bits that a query's components are rounded to.
PLANES = 6


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same for the same seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, rot: np.ndarray, width: float = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits as rows of 64-bit words, and the two scalars: what estimates and error bounds scale by."""
    dim = x.shape[1]
    norm = np.linalg.norm(x, axis=1)
    o = (x / norm[:, None]) @ rot
    cosine = np.abs(o).sum(1) / np.sqrt(dim)
    spread = norm * np.sqrt(np.maximum(0, 1 - cosine**2)) / cosine * width / np.sqrt(max(1, dim - 1))
    return _words(o > 0), (norm / cosine / np.sqrt(dim)).astype(np.float32), spread.astype(np.float32)


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    packed = np.packbits(bits, axis=1)
    out = np.zeros((len(bits), -(-bits.shape[1] // 64) * 8), np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


class Block:
    """A block of vectors with their codes, ready for queries."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, scale: np.ndarray, spread: np.ndarray, rot: np.ndarray):
        self.ids, self.x, self.codes, self.scale, self.spread, self.rot = ids, x, codes, scale, spread, rot
        self.single = x.astype(np.float32)
        self.ones = np.bitwise_count(codes).sum(1, dtype=np.float32)
        self.longest = np.sqrt(np.einsum("ij,ij->i", self.single, self.single).max(initial=0))

    def estimate(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products (queries by vectors), and bounds of their errors.

        A query's rotated components are rounded to PLANES bits; what that loses is in the bound.
        """
        turned = q @ self.rot
        low, high = turned.min(1, keepdims=True), turned.max(1, keepdims=True)
        step = np.maximum((high - low) / ((1 << PLANES) - 1), 1e-30)
        level = np.rint((turned - low) / step).astype(np.uint16)
        lost = np.linalg.norm(turned - (low + level * step), axis=1)
        planes = [_words(level >> j & 1) for j in range(PLANES)]
        total = (low[:, 0] * q.shape[1] + step[:, 0] * level.sum(1)).astype(np.float32)
        est = np.empty((len(q), len(self.codes)), np.float32)
        for i in range(len(q)):
            shared = np.zeros(len(self.codes), np.int32)
            for j, plane in enumerate(planes):
                # one word at a time: most vectors have few
                for w in range(self.codes.shape[1]):
                    shared += np.bitwise_count(self.codes[:, w] & plane[i, w]).astype(np.int32) << j
            # the sum over set bits, twice, less the sum over all
            est[i] = (2 * (np.float32(low[i, 0]) * self.ones + np.float32(step[i, 0]) * shared) - total[i]) * self.scale
        norm = np.linalg.norm(q, axis=1).astype(np.float32)
        rounding = (lost * np.sqrt(q.shape[1])).astype(np.float32)
        return est, norm[:, None] * self.spread[None, :] + rounding[:, None] * self.scale[None, :]

    def rough(self, q: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Inner products of the original vectors in single precision."""
        return np.concatenate([np.einsum("ij,ij->i", q[row[i : i + 65_536]], self.single[at[i : i + 65_536]]) for i in range(0, len(row), 65_536)] or [np.empty(0, np.float32)])


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products in double precision, components added in order."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def search_block(block: Block, qid: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query id, vector id, score): each query's k best of this block.

    Reranking is in single precision first; what comes within its rounding of the k-th best
    is computed exactly.
    """
    ids = block.ids
    for i in range(0, len(q), 64):
        who, part = qid[i : i + 64], q[i : i + 64]
        single = part.astype(np.float32)
        est, bound = block.estimate(part)
        est[who[:, None] == ids[None, :]] = -np.inf
        slack = 1e-5 * np.linalg.norm(part, axis=1).astype(np.float32) * block.longest
        n = min(k + 1, len(ids))
        top = np.argpartition(-est, n - 1, axis=1)[:, :n]
        row = np.repeat(np.arange(len(part)), n)
        first = np.where(np.isinf(est[row, top.ravel()]), -np.inf, block.rough(single, row, top.ravel())).reshape(len(part), n)
        floor = np.sort(first, axis=1)[:, ::-1][:, k - 1] - slack if n >= k else np.full(len(part), -np.inf)
        row, at = np.nonzero((est + bound >= floor[:, None]) & (est > -np.inf))
        score = block.rough(single, row, at)
        cut = np.searchsorted(row, np.arange(len(part) + 1))
        keep = []
        for j, (s, e) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            least = np.partition(score[s:e], e - s - k)[e - s - k] - 2 * slack[j] if e - s > k else -np.inf
            keep.append(s + np.flatnonzero(score[s:e] >= least))
        keep = np.concatenate(keep) if keep else np.empty(0, np.int64)
        row, at = row[keep], at[keep]
        sure = exact(part[row], block.x[at])
        cut = np.searchsorted(row, np.arange(len(part) + 1))
        best = [s + _best(sure[s:e], ids[at[s:e]], k) for s, e in zip(cut[:-1], cut[1:], strict=True)]
        best = np.concatenate(best) if best else np.empty(0, np.int64)
        yield who[row[best]], ids[at[best]], sure[best]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", width: float = WIDTH, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest by largest inner product.

    Nearest first, ties to the smaller id; all candidates if there are fewer than k; never
    the query's own id. Vectors that are null, zero, or hold null or non-finite
    components take no part, on either side, nor do null ids or vectors whose length isn't
    the table's most common one (smaller on ties). A repeated id counts once for each row
    among the candidates; as a query it stands for the least of its vectors. Other columns are
    ignored; an empty table gives no rows.

    Every row is coded once. Blocks of codes meet blocks of queries on a grid; a cell holds
    one block of each, and gives k rows a query, of which the k best are kept before the last
    shuffle. The vectors go with their codes, in the type they have: a code of one bit a
    component leaves a tenth of a block or more to rerank for each query, so that together a
    cell's queries need nearly all of them.
    """
    spark = vectors.sparkSession
    prepare(spark)
    single = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    kind = "float" if single else "double"

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(vec_col).cast(f"array<{kind}>")
        df = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
        return df.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")

    base = clean(vectors)
    common = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim, n = (common["d"], common["count"]) if common else (1, 0)
    base = base.where(F.size("v") == dim)
    ask = clean(queries).where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"))
    columns = max(1, -(-n // block))
    rows = max(1, -(-ask.count() // QUERIES))
    rot = rotation(dim, seed)
    words = -(-dim // 64)

    def matrix(v: pa.Array) -> np.ndarray:
        return v.values.to_numpy()[v.offsets[0].as_py() : v.offsets[-1].as_py()].reshape(-1, dim)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes, scale, spread = encode(matrix(b.column(1)).astype(float), rot, width)
                yield pa.record_batch([b.column(0), b.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(spread)], ["id", "v", "code", "scale", "spread"])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by cell, vectors before queries."""
        now, held, index = None, [], None
        for b in batches:
            cell, role, key = (b.column(i).to_numpy() for i in range(3))
            edge = np.flatnonzero(np.diff(cell) | np.diff(role)) + 1
            for s, e in zip(np.r_[0, edge], np.r_[edge, len(cell)], strict=True):
                if s == e:
                    continue
                if cell[s] != now:
                    now, held, index = cell[s], [], None
                v = matrix(b.column(3).slice(s, e - s)).astype(float)
                if role[s] == 0:
                    codes = np.frombuffer(b"".join(b.column(4).slice(s, e - s).to_pylist()), np.uint64).reshape(-1, words)
                    held.append((key[s:e].copy(), v, codes, b.column(5).to_numpy(zero_copy_only=False)[s:e], b.column(6).to_numpy(zero_copy_only=False)[s:e]))
                    continue
                if not held:
                    continue
                if index is None:
                    index = Block(*[np.concatenate(x) for x in zip(*held, strict=True)], rot)
                for who, at, score in search_block(index, key[s:e], v, k):
                    yield pa.record_batch([pa.array(who), pa.array(at), pa.array(score)], ["query_id", "vec_id", "score"])

    column, row = F.pmod(F.xxhash64("id"), F.lit(columns)), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(rows))
    grid = lambda axis: F.explode(F.sequence(F.lit(0), F.lit(axis - 1)))
    cell = (F.col("c") * rows + F.col("r")).alias("cell")
    index = base.mapInArrow(coded, f"id long, v array<{kind}>, code binary, scale float, spread float")
    left = index.select("*", column.alias("c"), grid(rows).alias("r")).select(cell, F.lit(0).cast("byte").alias("role"), "id", "v", "code", "scale", "spread")
    right = ask.select("id", "v", row.alias("r"), grid(columns).alias("c")).select(cell, F.lit(1).cast("byte").alias("role"), "id", "v", F.lit(None).cast("binary").alias("code"), F.lit(0).cast("float").alias("scale"), F.lit(0).cast("float").alias("spread"))
    found = left.union(right).repartition(min(4 * columns * rows, 4096), "cell").sortWithinPartitions("cell", "role").mapInArrow(cells, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
