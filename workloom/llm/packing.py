"""Packing token sequences into windows by non-negative least squares over length combinations.

A document is its ids by the given tokenizer and an end id. It is cut into whole windows, and its rest
into a head, the largest multiple of `unit`, and a tail below `unit`. So few lengths occur, whatever the
input: a histogram over them is all the driver sees.

1. Shallow combinations of head lengths, at most three different ones with repeats, that fill a window
   exactly are the columns of A. Non-negative least squares solves A x = histogram.
2. x is rounded down, and lowered where it asks for more pieces than there are.
3. The residual heads and all tails are packed greedily, longest first, again by counts: one greedy window is
   repeated as long as the counts last.

A piece's place follows from its length and its number among the pieces of that length, which Spark counts
by salted groups; no task holds all pieces of a length. Null and empty texts are the end id alone. Repeated
rows are packed each on its own. Empty tables give no pieces.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from workloom.llm.frames import kept, map_batches, text_of
from workloom.llm.words import Words, chunks
from workloom.session import stash

WINDOW, UNIT, END_ID = 4096, 64, 2
_CACHE_WORDS = 200_000
#: Rows of one length that a task numbers at most, roughly.
_GROUP_ROWS = 2_000_000
_LEAST_GROUPS = 64

_BY_SPACE = np.arange(256, dtype=np.uint8)
_BY_SPACE[0] = 9  # the value of the tab, which separates, is free for the zero byte
_BY_SPACE[list(b"\t\n\v\f\r ")] = 0
#: Kinds of bytes: 1 letters of ASCII and what may be part of a Latin letter of two bytes, 2 signs of ASCII, 0 others.
_KINDS = np.zeros(256, np.uint8)
_KINDS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0xC0), 0xC3]] = 1
_KINDS[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in "'<"]] = 2
#: How byte-level vocabularies write bytes: printable ones as they are, the others in order from U+0100.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_SHOWN = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    """Pieces that the tokenizer surely cuts apart, and which of them are plain.

    Pieces end at white space. A piece of only the letters A-Z, a-z and U+00C0 to U+00FF and of signs of ASCII
    but the apostrophe and `<`, which may open a special token, is plain: it is in its normal form, its case is dropped, and its letters and its signs
    are pieces of their own. Any other piece stays whole and as it is.
    """
    folded = _BY_SPACE[data]
    pieces = Words(data, offsets, folded)
    kinds = _KINDS[data]
    # A lead byte 0xC3 and the byte after it are a letter together, but for the signs of times and division.
    lead = data == 0xC3
    follows = np.zeros(len(data), bool)
    follows[1:] = lead[:-1]
    high = (data >= 0x80) & (data < 0xC0)
    odd = (kinds == 0) | (high & ~follows) | (follows & ((data == 0x97) | (data == 0xB7)))
    total = np.concatenate([[0], np.cumsum(odd & (folded != 0))])
    plain = total[pieces.ends] == total[pieces.starts]
    change = np.zeros(len(data) + 1, np.int8)
    change[pieces.starts[plain]] += 1
    change[pieces.ends[plain]] -= 1
    inside = np.cumsum(change[:-1]).astype(bool)
    capital = inside & (data >= ord("A")) & (data <= ord("Z"))
    accented = inside & follows & (data >= 0x80) & (data <= 0x9E)
    folded = folded + (capital | accented) * np.uint8(32)
    cuts = np.zeros(len(data), bool)
    cuts[1:] = inside[1:] & (kinds[1:] != kinds[:-1])
    words = Words(data, offsets, folded, cuts)
    return words, inside[words.starts]


class Encoder:
    """Encodes texts piece by piece and remembers the ids of pieces by their hash.

    For tokenizers of bytes that drop white space and case and split letters from signs, as `segments` needs.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[int, int] = {}
        self.pool = np.zeros(1 << 20, np.uint32)
        self.bounds = np.zeros(1 << 18, np.int64)

    def _ids(self, piece: bytes, plain: bool) -> list[int]:
        if plain:  # normalised and split already: only the merges are left to do
            shown = piece.decode("latin-1")
            return [t.id for t in self.tokenizer.model.tokenize(shown if piece.isascii() else shown.translate(_SHOWN))]
        return self.tokenizer.encode(piece.decode("utf-8"), add_special_tokens=False).ids

    def _learn(self, keys: list[int], found: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        slot = len(self.slots)
        end = self.bounds[slot] + int(sizes.sum())
        while end > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while slot + len(found) >= len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        self.pool[self.bounds[slot]:end] = [x for ids in found for x in ids]
        self.bounds[slot + 1:slot + 1 + len(found)] = self.bounds[slot] + np.cumsum(sizes)
        self.slots.update(zip(keys, range(slot, slot + len(found))))

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, the end id last."""
        for _, data, offsets in chunks(column):
            words, plain = segments(data, offsets)
            unique, first, where = np.unique(words.hashes, return_index=True, return_inverse=True)
            if len(self.slots) + len(unique) > _CACHE_WORDS:
                self._clear()
            slots = np.array([self.slots.get(h, -1) for h in unique.tolist()], np.int64)
            new = np.flatnonzero(slots < 0)
            at = first[new]
            body, raw = words.folded.tobytes(), data.tobytes()
            found = [self._ids((body if p else raw)[a:b], p)
                     for a, b, p in zip(words.starts[at].tolist(), words.ends[at].tolist(), plain[at].tolist())]
            slots[new] = len(self.slots) + np.arange(len(new))
            self._learn(unique[new].tolist(), found)
            slot = slots[where]
            begin = self.bounds[slot]
            sizes = self.bounds[slot + 1] - begin
            total = np.concatenate([[0], np.cumsum(sizes)])
            ids = self.pool[np.repeat(begin - total[:-1], sizes) + np.arange(total[-1])]
            cuts = total[words.first]
            for d in range(len(offsets) - 1):
                yield np.append(ids[cuts[d]:cuts[d + 1]], np.uint32(self.end_id))


def encoder_of(*settings) -> Encoder:
    """This process's encoder."""
    return kept(("encoder", settings), lambda: Encoder(*settings))


def cuts_of(n: int, window: int = WINDOW, unit: int = UNIT) -> list[int]:
    """Where a document of n ids is cut, from 0 to n."""
    cuts = list(range(0, n + 1, window))
    head = cuts[-1] + (n - cuts[-1]) // unit * unit
    return sorted({*cuts, head, n})


def pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
           unit: int = UNIT, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, and the ids themselves if asked for."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, end_id)
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in enumerate(encoder.encode(batch.column(1))):
                cuts = cuts_of(len(ids), window, unit)
                raw = ids.astype("<u4").tobytes()
                rows += [(doc, a, b - a, zlib.crc32(raw[4 * a:4 * b]), len(ids), ids[a:b] if with_ids else None)
                         for a, b in zip(cuts, cuts[1:])]
            columns = list(zip(*rows)) or [()] * 6
            arrays = [batch.column(0).take(pa.array(columns[0], pa.int64())),
                      *[pa.array(columns[i], pa.int64()) for i in range(1, 5)]]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in columns[5]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    return map_batches(docs.select(docs[doc_id].alias("id"), text_of(docs, text)), work,
                       schema + (", ids array<int>" if with_ids else ""))


def combinations(units: int, most: int = 3) -> list[dict[int, int]]:
    """All ways to write `units` with at most `most` different lengths, as {length: times}."""
    found: list[dict[int, int]] = []

    def extend(left: int, below: int, chosen: dict[int, int]) -> None:
        if not left:
            found.append(dict(chosen))
            return
        if len(chosen) == most:
            return
        for length in range(min(below, left), 0, -1):
            for times in range(1, left // length + 1):
                chosen[length] = times
                extend(left - times * length, length - 1, chosen)
            del chosen[length]

    extend(units, units, {})
    return found


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2_000) -> np.ndarray:
    """The x >= 0 with the least |a x - b|, by an active set."""
    x = np.zeros(a.shape[1])
    inside: list[int] = []
    for _ in range(rounds):
        pull = a.T @ (b - a @ x)
        pull[inside] = -np.inf
        j = int(np.argmax(pull))
        if pull[j] <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        inside.append(j)
        while True:
            s = np.linalg.lstsq(a[:, inside], b, rcond=None)[0]
            if s.min() > 0:
                break
            now = x[inside]
            bad = s <= 0
            step = float((now[bad] / np.maximum(now[bad] - s[bad], 1e-300)).min())
            now = now + step * (s - now)
            x[:] = 0
            x[inside] = now
            inside = [i for i, v in zip(inside, now) if v > 1e-12]
            if not inside:
                break
        x[:] = 0
        if not inside:
            break
        x[inside] = s
    return x


def plan(histogram: dict[int, int], window: int = WINDOW, unit: int = UNIT) -> list[tuple[int, int, int, int, int, int]]:
    """Places for all pieces of a length histogram: rows (length, first, end, sequence, times, offset).

    The pieces numbered first .. end-1 of a length fill `times` places of each sequence from `sequence` on,
    side by side from `offset`.
    """
    left = {k: n for k, n in histogram.items() if n > 0}
    windows: list[tuple[dict[int, int], int]] = []

    def take(pattern: dict[int, int], repeats: int) -> None:
        if repeats > 0:
            windows.append((pattern, repeats))
            for length, times in pattern.items():
                left[length] -= times * repeats

    take({window: 1}, left.get(window, 0))
    heads = [k for k in range(unit, window, unit) if left.get(k)]
    if heads:
        ways = [{k * unit: t for k, t in way.items()} for way in combinations(window // unit)]
        ways = [way for way in ways if all(left.get(k) for k in way)]
        if ways:
            row = {k: i for i, k in enumerate(heads)}
            a = np.zeros((len(heads), len(ways)))
            for j, way in enumerate(ways):
                for k, t in way.items():
                    a[row[k], j] = t
            x = nnls(a, np.array([left[k] for k in heads], float))
            for j in np.argsort(-x, kind="stable"):
                take(ways[j], min(int(x[j] + 1e-6), *(left[k] // t for k, t in ways[j].items())))
    while any(left.values()):
        space, pattern = window, {}
        for length in sorted((k for k, n in left.items() if n), reverse=True):
            times = min(space // length, left[length])
            if times:
                pattern[length] = times
                space -= times * length
        take(pattern, min(left[k] // t for k, t in pattern.items()))
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, repeats in windows:
        offset = 0
        for length in sorted(pattern, reverse=True):
            first, times = used.get(length, 0), pattern[length]
            used[length] = first + times * repeats
            rows.append((length, first, used[length], sequence, times, offset))
            offset += length * times
        sequence += repeats
    return rows


def pack(docs: DataFrame, path: str, window: int = WINDOW, unit: int = UNIT, **options) -> DataFrame:
    """The rows of `pieces` with sequence_id and offset. Tokenizes when called and writes the pieces to the shared folder."""
    spark = docs.sparkSession
    cut = stash(pieces(docs, path, window=window, unit=unit, **options), "pieces")
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = plan(histogram, window, unit)  # a bounded number of lengths, and of rows for each
    groups = max(_LEAST_GROUPS, -(-max(histogram.values(), default=0) // _GROUP_ROWS))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("id", "start", "ids_crc32", "doc_tokens"), F.lit(groups)).cast("int"))
    before = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("length", "salt", F.coalesce(F.sum("n").over(
        Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("id", "start", "ids_crc32", "doc_tokens")
    numbered = (salted.withColumn("nth", F.row_number().over(own)).join(before, ["length", "salt"])
                .withColumn("nth", F.col("base") + F.col("nth") - 1))
    places = F.broadcast(spark.createDataFrame(
        rows, "length bigint, from_nth bigint, to_nth bigint, sequence bigint, times bigint, place bigint"))
    placed = numbered.join(places, (numbered["length"] == places["length"])
                           & (F.col("nth") >= F.col("from_nth")) & (F.col("nth") < F.col("to_nth"))).drop(places["length"])
    return placed.select(*cut.columns,
                         (F.col("sequence") + F.floor((F.col("nth") - F.col("from_nth")) / F.col("times"))).cast("bigint").alias("sequence_id"),
                         (F.col("place") + F.pmod(F.col("nth") - F.col("from_nth"), F.col("times")) * F.col("length")).cast("bigint").alias("offset"))
