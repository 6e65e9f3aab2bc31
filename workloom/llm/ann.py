"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector v is seen from a centre c, the mean of a bounded sample: v - c = |v - c| o with a unit vector o. A random
rotation P, the same everywhere, turns o into coordinates of like size, and their signs are the code. With
x = signs / sqrt(d) in the rotated space, <o, q> is estimated by <x, Pq> / <x, Po>; the correction scalars
|v - c| and <x, Po> are kept with the packed bits. The estimate errs by no more than
`EPS` * sqrt((1 - <x, Po>^2) / <x, Po>^2 / (d - 1)) but for a small chance, which gives each candidate a least
distance. A query's bits are packed in four planes of a small integer code, so estimates are bit counts.

Both sides are packed in blocks and dealt into parts, and each part of the queries meets each part of the vectors in
a task: every query block with every block of vectors. In a pair of blocks a query first takes the k candidates with
the best estimates, measures them exactly, and then every candidate whose least distance is within the k-th of these,
so ties and copies are not lost to the estimate. Each task gives k rows per query, and Spark keeps the best k of all.
The code is a filter: the score is the exact Euclidean distance in double precision.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part.
Repeated rows are candidates each; a query's own id never answers it. Ties go to the smaller id. Fewer than k candidates give fewer rows; empty tables give none.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import FloatType

from workloom.llm.frames import map_batches
from workloom.session import stash

SAMPLE = 4_096
BLOCK, QUERY_BLOCK = 8_192, 512
GROUP = 16  # blocks of queries in a part
LISTS = 64 << 20  # bytes of result lists that are always few
EPS = 2.2
PLANES = 4


def rotation(d: int, seed: int = 7) -> np.ndarray:
    """A random rotation, the same for the same d."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _bits(signs: np.ndarray) -> np.ndarray:
    """Rows of booleans as 64-bit words."""
    width = -(-signs.shape[1] // 64) * 64
    wide = np.zeros((len(signs), width), bool)
    wide[:, :signs.shape[1]] = signs
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


class Codes:
    """One-bit codes of vectors around a centre, with their correction scalars."""

    def __init__(self, vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        rest = vectors - centre
        self.size = np.linalg.norm(rest, axis=1)
        turned = (rest / np.maximum(self.size, 1e-300)[:, None]) @ turn.T
        self.d = vectors.shape[1]
        self.bits = _bits(turned > 0)
        self.ones = (turned > 0).sum(1)
        self.fit = np.maximum(np.abs(turned).sum(1) / np.sqrt(self.d), 1e-6)  # <x, Po>
        self.slack = EPS * np.sqrt(np.maximum(1 - self.fit ** 2, 0) / self.fit ** 2 / max(self.d - 1, 1))

    def estimates(self, query: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated squared distances to the query, and how much less each may be."""
        rest = query - centre
        far = np.linalg.norm(rest)
        turned = turn @ (rest / max(far, 1e-300))
        low, top = turned.min(), turned.max()
        step = max(top - low, 1e-12) / (2 ** PLANES - 1)
        levels = np.rint((turned - low) / step).astype(np.int64)
        planes = [_bits(((levels >> p) & 1).astype(bool)[None, :])[0] for p in range(PLANES)]
        # <signs, turned> with signs of -1 and 1, from the sum over set bits
        over = low * self.ones
        for p, plane in enumerate(planes):
            over = over + step * (1 << p) * np.bitwise_count(self.bits & plane).sum(1)
        inner = (2 * over - (low * self.d + step * levels.sum())) / np.sqrt(self.d) / self.fit
        reach = 2 * self.size * far
        rounding = EPS * step / np.sqrt(12) / self.fit
        return self.size ** 2 + far ** 2 - reach * inner, reach * (self.slack + rounding)


def _usable(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part, and their vectors."""
    rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), d), False).to_numpy(zero_copy_only=False))
    values = column.take(pa.array(rows)).flatten()
    vectors = pc.fill_null(values.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(len(rows), d)
    good = np.isfinite(vectors).all(1) & vectors.any(1)
    return rows[good], vectors[good]


def _packing(d: int, size: int, kind: str):
    """Usable rows packed in blocks: how many, ids and vectors."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, held = [], [], 0

        def block() -> pa.RecordBatch:
            i, v = np.concatenate(ids), np.concatenate(vectors)
            out = pa.RecordBatch.from_arrays([pa.array([len(i)], pa.int64()), pa.array([i.astype("<i8").tobytes()], pa.binary()),
                                              pa.array([v.astype(kind).tobytes()], pa.binary())], names=["n", "ids", "vectors"])
            ids.clear()
            vectors.clear()
            return out

        for batch in batches:
            column = batch.column(1)
            rows, found = _usable(column, d)
            own = batch.column(0).to_numpy(zero_copy_only=False)[rows]
            at = 0
            while at < len(rows):
                take = min(size - held, len(rows) - at)
                ids.append(own[at:at + take])
                vectors.append(found[at:at + take])
                held, at = held + take, at + take
                if held == size:
                    yield block()
                    held = 0
        if held:
            yield block()
    return work


def nearest_in_block(ids: np.ndarray, vectors: np.ndarray, codes: Codes, q_id: int, query: np.ndarray,
                     centre: np.ndarray, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact distances of the block's k nearest, by distance and id."""
    estimate, less = codes.estimates(query, centre, turn)
    mine = ids == q_id
    estimate[mine] = np.inf
    less[mine] = 0.0
    pool = len(ids) - int(mine.sum())
    if not pool:
        return ids[:0], np.zeros(0)
    k = min(k, pool)
    first = np.argpartition(estimate, k - 1)[:k]
    bound = ((vectors[first] - query) ** 2).sum(1).max()
    chosen = np.flatnonzero((estimate - less <= bound * (1 + 1e-12)) & ~mine)
    chosen = np.union1d(chosen, first)
    exact = np.sqrt(((vectors[chosen] - query) ** 2).sum(1))
    order = np.lexsort((ids[chosen], exact))[:k]
    return ids[chosen][order], exact[order]


def _nearer(best: tuple[np.ndarray, ...] | None, found: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """Ids, distances and whether there is none, with a row for each query: the k nearest of both, by distance and id."""
    if best is None:
        return found
    ids, scores, none = (np.concatenate(pair, axis=1) for pair in zip(best, found))
    order = np.lexsort((ids, scores, none), axis=-1)[:, :k]
    return tuple(np.take_along_axis(x, order, axis=1) for x in (ids, scores, none))


def _searching(d: int, centre: np.ndarray, k: int, kind: str, q_kind: str):
    """Each pair of blocks is searched by itself; a task gives k rows for each of its queries, whatever its pairs."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(d)
        last, codes, ids, vectors = None, None, None, None
        best = {}  # by the ids of a block of queries
        for batch in batches:
            for q_ids, q_vectors, b_ids, b_vectors in zip(*(batch.column(i) for i in range(4))):
                raw = b_ids.as_py(), b_vectors.as_py()
                if last is None or raw != last:
                    last = raw
                    ids = np.frombuffer(raw[0], "<i8")
                    vectors = np.frombuffer(raw[1], kind).reshape(-1, d).astype(np.float64)
                    codes = Codes(vectors, centre, turn)
                asked = q_ids.as_py()
                own = np.frombuffer(asked, "<i8")
                found = np.zeros((len(own), k), np.int64), np.zeros((len(own), k)), np.ones((len(own), k), bool)
                for i, query in enumerate(np.frombuffer(q_vectors.as_py(), q_kind).reshape(-1, d).astype(np.float64)):
                    near, score = nearest_in_block(ids, vectors, codes, own[i], query, centre, turn, k)
                    found[0][i, :len(near)], found[1][i, :len(near)], found[2][i, :len(near)] = near, score, False
                best[asked] = _nearer(best.get(asked), found, k)
        for asked, (near, score, none) in best.items():
            own = np.repeat(np.frombuffer(asked, "<i8"), (~none).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own, near[~none], score[~none])], names=["query_id", "vec_id", "score"])
    return work


def _averaging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The length of most vectors and the mean of the usable ones, as one row; none if all are empty."""
    columns = [batch.column(0) for batch in batches]
    sizes = Counter(n for column in columns for n in pc.list_value_length(column).to_pylist() if n)
    if sizes:
        d = max(sizes, key=lambda n: (sizes[n], n))
        found = np.concatenate([_usable(column, d)[1] for column in columns])
        centre = found.mean(0) if len(found) else np.zeros(d)
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int64()), pa.array([centre.tolist()], pa.list_(pa.float64()))], names=["d", "centre"])


def centre_of(rows: DataFrame, sample: int) -> tuple[int, int, np.ndarray] | None:
    """How many rows (id, v) there are, and of the `sample` rows with the least hash of their id the length of most and
    the mean; None without vectors.

    Rows are first counted by the power of two that their hash reaches, so that only about twice the sample is sorted.
    An executor takes the mean; the driver gets at most 65 counts and one row.
    """
    place = F.xxhash64("id")
    reach = F.floor(F.log2(place.cast("double") + F.lit(2.0 ** 63) + F.lit(1.0)))
    counts = rows.groupBy(reach.alias("reach")).agg(F.count(F.lit(1)).alias("n")).collect()
    far = held = 0
    for far, n in sorted((r.reach, r.n) for r in counts):
        held += n
        if held >= sample:
            break
    # One partition, also where Spark knows that there are fewer rows and leaves out the limit.
    some = rows.where(reach <= far).orderBy(place, "id").limit(sample).select("v").coalesce(1)
    got = map_batches(some, _averaging, "d bigint, centre array<double>").collect()
    return (sum(r.n for r in counts), got[0].d, np.array(got[0].centre)) if got else None


def grid(n: int, asked: int, d: int, k: int, block: int, query_block: int) -> tuple[int, int]:
    """Into how many parts vectors and queries are dealt; each part of one meets each of the other in a task.

    A task gives k rows for each of its queries, so more parts of vectors make more rows: no more bytes in all than half
    of the vectors' as doubles, but for small tables. More parts of queries only read the vectors more often.
    """
    lists = max(1, asked) * k * 24
    return max(1, min(-(-n // block), max(n * d * 4, LISTS) // lists)), max(1, -(-asked // (GROUP * query_block)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding",
            sample: int = SAMPLE, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest of `vectors`, never its own id."""
    spark = vectors.sparkSession

    def pick(df: DataFrame) -> DataFrame:
        return df.where(df[vec_id].isNotNull() & df[embedding].isNotNull()).select(
            df[vec_id].cast("bigint").alias("id"), df[embedding].cast("array<double>").alias("v"))

    middle = centre_of(pick(vectors), sample)
    if middle is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    n, d, centre = middle
    kind, q_kind = ("<f4" if df.schema[embedding].dataType.elementType == FloatType() else "<f8" for df in (vectors, queries))
    packed = "n bigint, ids binary, vectors binary"
    right = stash(map_batches(pick(queries), _packing(d, query_block, q_kind), packed), "query-blocks")
    parts, groups = grid(n, right.agg(F.sum("n")).first()[0] or 0, d, k, block, query_block)
    left = (map_batches(pick(vectors), _packing(d, block, kind), packed).select(F.col("ids").alias("b_ids"), F.col("vectors").alias("b_vectors"))
            .repartition(parts, F.xxhash64("b_ids")))
    right = right.select("ids", "vectors").repartition(groups, F.xxhash64("ids"))
    # Every pair of blocks meets once. No block is copied for it: tasks read a part of each side where it lies.
    pairs = left.crossJoin(right).select("ids", "vectors", "b_ids", "b_vectors")
    best = map_batches(pairs, _searching(d, centre, k, kind, q_kind), "query_id bigint, vec_id bigint, score double")
    own = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
