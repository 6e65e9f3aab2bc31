"""Exact top-k inner products from an impact-ordered index.

Components are whole numbers, floor(scale * x). The index is cut into blocks of vectors. In a block, each dimension's
postings are ordered by value and cut into segments of like value, the quantised impacts. For a query, a segment's impact
is the most that its postings can add to a score, above the least that any posting of its dimension adds; a negative
component reads its dimension from the low end.

A query takes a block's segments in falling impact, whatever their dimension, and adds each to the accumulators of its vectors.
At any time a vector's score is at most its accumulator plus the next impact for each dimension in which it has not been
met. From time to time the k best bounds are scored exactly, and their k-th score is the bar. Processing stops only once
few vectors have a bound that reaches the bar: no other can be among the k best, ties included. Those few are rescored
from their whole components, so scores are exact however coarse the segments are.

Blocks and queries meet in slots: every block is sent once, a block's queries follow it. Each pair gives k rows per query,
and Spark keeps the best k of all. Ties go to the smaller id.

Vectors that are null or hold null or non-finite components take no part. Vectors may differ in length; a missing component
is zero, and an empty or zero vector scores zero. Repeated rows are candidates each; a query's own id never answers it, and
a query that repeats with the same vector is asked once. Fewer than k candidates give fewer rows; empty tables give none.
Components beyond a long are held at its ends, and a score beyond a long is an error. Other columns are not read.
"""

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from workloom.llm.frames import map_batches
from workloom.session import stash

SCALE, K = 256, 5
#: Most vectors and components of a block, queries that travel together, and segments of a dimension.
BLOCK, CELLS, QUERY_BLOCK, LEVELS = 8_192, 1 << 19, 64, 16
#: A vector costs less to rescore than its postings to add, so the pass ends when one in so many is possible.
FEW = 8


def _padded(lists: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), np.int64)
    for row, values in zip(out, lists):
        row[:len(values)] = values
    return out


class Block:
    """Some vectors' postings, ordered by value in each dimension and cut into segments of like value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, order: np.ndarray | None = None, levels: int = LEVELS):
        self.ids, self.vectors, self.n, self.d = ids, vectors, *vectors.shape
        levels = max(2, min(levels, self.n // 512))  # segments long enough to be worth a step
        self.order = (np.argsort(vectors.T, axis=1, kind="stable") if order is None else order).astype(np.intp)
        # Segments, by dimension and value: their dimension, place and length in the flat order, least and greatest value.
        self.postings = self.order.ravel()
        ranked = np.take_along_axis(vectors.T, self.order, 1)
        step = np.maximum(ranked[:, -1:].astype(np.float64) - ranked[:, :1], 1.0) * (1 + 1e-9) / levels
        level = np.floor((ranked - ranked[:, :1].astype(np.float64)) / step).astype(np.int64)
        self.starts = np.flatnonzero(np.diff(level, axis=1, prepend=-1))
        self.sizes = np.diff(self.starts, append=self.n * self.d)
        self.dims = self.starts // self.n
        self.low, self.high = ranked.ravel()[self.starts], ranked.ravel()[self.starts + self.sizes - 1]
        self.firsts = np.searchsorted(self.dims, np.arange(self.d))
        self.most = int(np.abs(vectors).max(initial=0))

    def exact(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Scores of some vectors, as whole numbers of any size where 64 bits might not do."""
        if self.most * int(np.abs(query).max(initial=0)) * max(self.d, 1) < 2 ** 62:
            return self.vectors[rows] @ query
        return np.array([sum(a * b for a, b in zip(row, query.tolist())) for row in self.vectors[rows].tolist()], object)

    def best(self, q_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, by score and id."""
        wide = np.zeros(self.d, np.int64)
        wide[:min(self.d, len(query))] = query[:self.d]
        others = self.ids != q_id
        pool = int(others.sum())
        k = min(k, pool)
        if not k:
            return self.ids[:0], np.zeros(0, np.int64)
        possible = np.flatnonzero(others)
        if 4 * self.most * int(np.abs(wide).max(initial=0)) * max(self.d, 1) ** 2 < 2 ** 53:
            possible = self._possible(wide, others, k)
        scores = self.exact(possible, wide)
        if scores.dtype == object:
            order = sorted(range(len(possible)), key=lambda i: (-scores[i], self.ids[possible[i]]))[:k]
        else:
            order = np.lexsort((self.ids[possible], -scores))[:k]
        return self.ids[possible[order]], scores[order]

    def _possible(self, query: np.ndarray, others: np.ndarray, k: int) -> np.ndarray:
        """Rows that may be among the k best: the score-at-a-time pass with its proof.

        An accumulator holds its impacts above `bits` low bits, which count the dimensions met. Segments are
        added some at a time, between one look at the bounds and the next.
        """
        n_dims = int(np.count_nonzero(query))
        own = query[self.dims]
        top = np.where(own > 0, own * self.high, own * self.low)
        least = np.minimum.reduceat(top, self.firsts)
        impact, ground = top - least[self.dims], int(least.sum())
        turn = np.argsort(-impact, kind="stable")
        turn = turn[impact[turn] > 0]
        impact, starts, sizes = np.append(impact[turn], 0), self.starts[turn], self.sizes[turn]
        bits = self.d.bit_length()
        reached = np.cumsum(sizes)
        held = np.zeros(self.n, np.int64)
        at, goal, bar = 0, self.n * n_dims // 4, None
        while True:
            until = int(np.searchsorted(reached, goal)) + 1
            pieces = [self.postings[a:a + m] for a, m in zip(starts[at:until].tolist(), sizes[at:until].tolist())]
            if pieces:
                steps = np.repeat((impact[at:until][:len(pieces)] << bits) + 1, sizes[at:until])
                held += np.bincount(np.concatenate(pieces), steps, self.n).astype(np.int64)
            at = min(until, len(starts))
            bound = (held >> bits) + (n_dims - (held & ((1 << bits) - 1))) * impact[at] + ground
            bound[~others] = -2 ** 62
            first = np.argpartition(-bound, k - 1)[:k]
            worst = self.exact(first, query).min()
            bar = worst if bar is None else max(bar, worst)
            possible = np.flatnonzero((bound >= bar) & others)
            if len(possible) <= max(8 * k, self.n // FEW) or at == len(starts):
                return possible
            goal += self.n * n_dims // 16


def _packing(size: int, cells: int, ordered: bool):
    """Vectors in blocks: how many, their length, ids, components and, for the index, each dimension's order."""
    names = ["part", "seq", "n", "d", "ids", "vectors", "orders"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        lists: list[np.ndarray] = []
        width = 0

        def block() -> pa.RecordBatch:
            nonlocal seq
            seq += 1
            vectors = _padded(lists, width)
            order = np.argsort(vectors.T, axis=1, kind="stable").astype("<u4").tobytes() if ordered else None
            row = [part, seq - 1, len(ids), width, np.array(ids, "<i8").tobytes(), vectors.astype("<i8").tobytes(), order]
            kinds = [pa.int64()] * 4 + [pa.binary()] * 3
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds)], names=names)

        for batch in batches:
            column = batch.column(1)
            flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            for i, a, b in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                if ids and (len(ids) >= size or (len(ids) + 1) * max(width, b - a) > cells):
                    yield block()
                    ids, lists, width = [], [], 0
                ids.append(i)
                lists.append(flat[a:b].copy())
                width = max(width, b - a)
        if ids:
            yield block()
    return work


def _searching(k: int):
    """Rows of a slot: its blocks, then the queries that meet them."""
    names = ["query_id", "query_key", "vec_id", "score"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, blocks = None, []
        for batch in batches:
            for own, n, d, ids, vectors, orders in zip(*batch.columns):
                n, d = n.as_py(), d.as_py()
                row_ids = np.frombuffer(ids.as_py(), "<i8")
                values = np.frombuffer(vectors.as_py(), "<i8").reshape(n, d)
                if own.as_py() != slot:
                    slot, blocks = own.as_py(), []
                if orders.is_valid:
                    blocks.append(Block(row_ids, values, np.frombuffer(orders.as_py(), "<u4").reshape(d, n)))
                    continue
                out: list[list] = [[], [], [], []]
                for q_id, query in zip(row_ids.tolist(), values):
                    key = xxhash.xxh3_64_intdigest(query.tobytes()) - 2 ** 63
                    for block in blocks:
                        found, scores = block.best(q_id, query, k)
                        out[0] += [q_id] * len(found)
                        out[1] += [key] * len(found)
                        out[2] += found.tolist()
                        out[3] += scores.tolist()
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=names)
    return work


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, vec_id: str = "vec_id",
                       embedding: str = "embedding", block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products among `vectors`, never its own id."""
    spark = vectors.sparkSession

    def pick(df: DataFrame) -> DataFrame:
        whole = df.where(df[vec_id].isNotNull()).select(df[vec_id].cast("bigint").alias("id"), df[embedding].cast("array<double>").alias("v"))
        return whole.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))).select(
            "id", F.transform("v", lambda c: F.floor(c * scale)).alias("x"))

    packed = "part bigint, seq bigint, n bigint, d bigint, ids binary, vectors binary, orders binary"
    index = stash(map_batches(pick(vectors), _packing(block, CELLS, True), packed), "impact-index")
    asked = stash(map_batches(pick(queries).distinct(), _packing(query_block, CELLS, False), packed), "queries")
    # Blocks are numbered without gaps, so that every slot has one; tasks of the packing bound what is collected.
    counts = sorted((r.part, r.n) for r in index.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    slots = sum(n for _, n in counts)
    if not slots:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    starts = spark.createDataFrame([(part, at - n) for (part, n), at in zip(counts, accumulate(n for _, n in counts))], "part bigint, start bigint")
    columns = ["slot", "n", "d", "ids", "vectors", "orders"]
    last = F.lit(slots - 1).cast("bigint")
    met = (index.join(F.broadcast(starts), "part").withColumn("slot", F.col("start") + F.col("seq")).select(columns)
           .unionByName(asked.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).select(columns)))
    parted = met.repartitionByRange(slots, "slot").sortWithinPartitions("slot", F.col("orders").isNull())
    best = map_batches(parted, _searching(k), "query_id bigint, query_key bigint, vec_id bigint, score bigint")
    own = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
