"""Suffix-array dedup: removes every byte covered by a `width`-byte string that also starts anywhere else.

A sparse suffix array: not every suffix is sorted, only those at content-defined places, and only where a
repeat is possible at all.

1. Anchors. Each `width`-byte string has as its anchor the `gram`-byte piece with the least hash in it
   (the first of several), so equal strings have equal anchors at equal offsets. Strings that start one after
   another mostly share an anchor. An anchor whose piece occurs once in the corpus can't repeat anything.
2. Suffixes. The strings of a remaining anchor are cut into groups of `step` start places. A group is one
   suffix: the text from the group's last start on, as far as its strings reach, then, backwards, what stands
   before it. All strings of a group share its first `width + 1 - step` bytes, its core.
3. Merge sort. Each task sorts its suffixes into a run and front-codes it: each suffix says how many bytes
   it shares with the one before. Runs are cut at splitters and exchanged; a part's runs are combined by a loser
   tree whose players carry the length of their common prefix with the last winner, so bytes known to be
   equal are never compared again. Its winners come with that length, which shows where cores end.
4. Suffixes that share a core with others are resolved string by string: in place for up to `together`
   different suffixes, and otherwise, and at the edges of a part, by Spark, which counts the strings' hashes.
   Splitters may so fall anywhere, also inside a core that very many documents share.
5. Verdicts go back by a hash of the suffix, and per document become removed runs of bytes.

Equal suffixes of a run are sent once, so copies cost little. Strings never cross documents; they are judged on
the input. Null and empty texts, and texts shorter than `width`, lose nothing. Rows that repeat are documents of
their own, so all their strings repeat. Hashes of 128 bits name documents, suffixes and strings.
"""

import hashlib
import struct
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from workloom.llm.frames import map_batches, text_of
from workloom.llm.words import _power_tables, chunks, mix
from workloom.session import stash

WIDTH, GRAM, STEP, TOGETHER = 400, 48, 128, 64
#: Bytes of suffixes that a part of the exchange holds, roughly, and how many parts there are at most.
PART_BYTES, MOST_PARTS = 16 << 20, 20_000
RUN_BYTES, BLOCK_BYTES = 48 << 20, 1 << 18
#: Longer texts are searched for anchors in slices, at about 53 bytes of memory a byte.
_SLICE = 1 << 22
_HEAD = struct.Struct("<HHHBBI")


def anchors(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> list[tuple]:
    """Per text: places of its anchors, first and last start of the strings of each, and the anchors' hashes."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < width:
        return [(none, none, none, none)] * (len(offsets) - 1)
    powers, inverses = _power_tables(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n], out=total[1:])
    count = n - gram + 1
    hashes = mix((total[gram:] - total[:count]) * inverses[:count])
    least = (hashes & ~np.uint64(2 ** 28 - 1)) | np.arange(count, dtype=np.uint64)
    span, covered = width - gram + 1, 1
    while 2 * covered <= span:
        least = np.minimum(least[:len(least) - covered], least[covered:])
        covered *= 2
    rest = span - covered
    if rest:
        least = np.minimum(least[:len(least) - rest], least[rest:])
    place = (least & np.uint64(2 ** 28 - 1)).astype(np.int64)
    out = []
    for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if end - begin < width:
            out.append((none, none, none, none))
            continue
        own = place[begin:end - width + 1]
        cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
        first = np.concatenate([[0], cuts])
        last = np.append(cuts - 1, len(own) - 1)
        at = own[first]
        out.append((at - begin, first, last, hashes[at].view(np.int64)))
    return out


def _sliced_anchors(data: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> list[tuple]:
    """As `anchors`; a very long text goes in slices that overlap by a string."""
    if len(data) <= _SLICE:
        return anchors(data, offsets, width, gram)
    out = []
    for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        parts = []
        for at in range(begin, max(begin + 1, end - width + 1), _SLICE):
            piece = data[at:min(end, at + _SLICE + width - 1)]
            found = anchors(piece, np.array([0, len(piece)]), width, gram)[0]
            parts.append((*(x + (at - begin) for x in found[:3]), found[3]))
        out.append(tuple(np.concatenate(x) for x in zip(*parts)))
    return out


def suffixes(text: bytes, at: list[int], first: list[int], last: list[int], width: int = WIDTH,
             step: int = STEP) -> Iterator[tuple[bytes, int, int, int, int]]:
    """(suffix, bytes of it that run forward, least and most t, place): its strings start t bytes before its place."""
    for a, w0, w1 in zip(at, first, last):
        low, high = a - w1, a - w0
        for q in range(low // step, high // step + 1):
            base = q * step
            t0, t1, p = max(low - base, 0), min(high - base, step - 1), a - base
            forward = text[p:p + width - t0]
            yield forward + text[p - t1:p][::-1], len(forward), t0, t1, p


def name_of(suffix: bytes, t0: int, t1: int) -> tuple[int, int]:
    return struct.unpack("<qq", xxhash.xxh3_128_digest(suffix + bytes((t0, t1))))


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which `known` bytes need no look."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    size = 16
    while a[known:known + size] == b[known:known + size]:
        known += size
        size *= 2
    while size > 1:
        size //= 2
        if a[known:known + size] == b[known:known + size]:
            known += size
    return known


def front_code(run: list[tuple]) -> bytes:
    """A block of a sorted run of (suffix, forward, t0, t1, times); the first suffix is written whole."""
    out, before = [], b""
    for suffix, forward, t0, t1, times in run:
        shared = common_prefix(before, suffix)
        out.append(_HEAD.pack(shared, len(suffix), forward, t0, t1, times))
        out.append(suffix[shared:])
        before = suffix
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def decode(blocks: list[bytes]) -> Iterator[tuple[int, tuple]]:
    """(common prefix with the suffix before, suffix tuple) of a run; blocks are opened one at a time."""
    before = b""
    for block in blocks:
        raw, at = zstandard.ZstdDecompressor().decompress(block), 0
        opening = True
        while at < len(raw):
            shared, size, forward, t0, t1, times = _HEAD.unpack_from(raw, at)
            at += _HEAD.size
            suffix = before[:shared] + raw[at:at + size - shared]
            at += size - shared
            yield (common_prefix(before, suffix) if opening else shared), (suffix, forward, t0, t1, times)
            before, opening = suffix, False


def merge(runs: list[Iterator[tuple[int, tuple]]]) -> Iterator[tuple[int, tuple]]:
    """The runs' suffixes in order, each with its common prefix with the one before.

    A loser tree. `shared[r]` is the common prefix of run r's head with the last winner it lost to or followed.
    A head that shares more with the last winner is the smaller one; only heads that share the same are
    compared, from there on.
    """
    k = len(runs)
    heads: list[tuple | None] = [None] * k
    shared = [0] * k

    def draw(r: int) -> None:
        shared[r], heads[r] = next(runs[r], (-1, None))

    def wins(a: int, b: int) -> bool:
        """Whether a's head comes before b's; the loser's common prefix becomes that with the winner."""
        if shared[a] != shared[b]:
            return shared[a] > shared[b]
        if heads[a] is None:
            return True
        x, y = heads[a][0], heads[b][0]
        both = common_prefix(x, y, shared[a])
        if both == len(x) or (both < len(y) and x[both] < y[both]):
            shared[b] = both
            return True
        shared[a] = both
        return False

    for r in range(k):
        draw(r)
        if heads[r] is not None:
            shared[r] = 0
    losers = [0] * k

    def build(node: int) -> int:
        if node >= k:
            return node - k
        a, b = build(2 * node), build(2 * node + 1)
        if wins(a, b):
            losers[node] = b
            return a
        losers[node] = a
        return b

    champion = build(1) if k > 1 else 0
    while heads[champion] is not None:
        yield shared[champion], heads[champion]
        draw(champion)
        node = (champion + k) // 2
        while node:
            rival = losers[node]
            if not wins(champion, rival):
                losers[node], champion = champion, rival
            node //= 2


def resolve(group: list[tuple], width: int = WIDTH) -> list[list[tuple[int, int]]]:
    """For suffixes of one core, the ranges of t whose strings occur more than once."""
    counts: dict[tuple, int] = {}
    for suffix, forward, t0, t1, times in group:
        for t in range(t0, t1 + 1):
            key = t, suffix[:width - t] + suffix[forward:forward + t]
            counts[key] = counts.get(key, 0) + times
    out = []
    for suffix, forward, t0, t1, times in group:
        if times > 1:
            out.append([(t0, t1)])
            continue
        ranges: list[tuple[int, int]] = []
        for t in range(t0, t1 + 1):
            if counts[t, suffix[:width - t] + suffix[forward:forward + t]] > 1:
                if ranges and ranges[-1][1] == t - 1:
                    ranges[-1] = ranges[-1][0], t
                else:
                    ranges.append((t, t))
        out.append(ranges)
    return out


def verdicts(runs: list[Iterator], core: int, width: int, together: int) -> Iterator[tuple]:
    """Rows (suffix name, low t, high t, None) for repeated strings, and (suffix name, t, times, string hash)
    for the strings of suffixes that this part alone can't judge."""
    def settle(group: list[tuple]) -> Iterator[tuple]:
        if len(group) == 1 and group[0][4] == 1:
            return
        found = [[(group[0][2], group[0][3])]] if len(group) == 1 else resolve(group, width)
        for (suffix, _, t0, t1, _), ranges in zip(group, found):
            for low, high in ranges:
                yield (*name_of(suffix, t0, t1), low, high, None, None)

    def pass_on(group: list[tuple]) -> Iterator[tuple]:
        for suffix, forward, t0, t1, times in group:
            name = name_of(suffix, t0, t1)
            for t in range(t0, t1 + 1):
                string = xxhash.xxh3_128_digest(suffix[:width - t] + suffix[forward:forward + t][::-1] + bytes((t,)))
                yield (*name, t, times, *struct.unpack("<qq", string))

    group: list[tuple] = []
    edge = True  # the first group may have begun in the part before
    for shared, item in merge(runs):
        if shared < core or not group:
            if group:
                yield from pass_on(group) if edge else settle(group)
                edge = False
            group = [item]
        elif item[:4] == group[-1][:4]:
            group[-1] = (*item[:4], group[-1][4] + item[4])
        else:
            if len(group) >= together:
                edge = True
            if edge and len(group) >= together:
                yield from pass_on(group)
                group = []
            group.append(item)
    yield from pass_on(group)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = docs.select(docs[doc_id].alias("id"), text_of(docs, text))
    return body.select("id", "text", F.xxhash64("id", "text").alias("k1"), F.xxhash64(F.lit(17), "text", "id").alias("k2"))


def _anchor_rows(width: int, gram: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in chunks(batch.column(0)):
                found = _sliced_anchors(data, offsets, width, gram)
                keep = [i for i, x in enumerate(found) if len(x[0])]
                if keep:
                    at = pa.array([row + i for i in keep])
                    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(1).take(at), batch.column(2).take(at),
                         *[pa.array([found[i][j] for i in keep], pa.list_(kinds[j])) for j in range(4)]],
                        names=["k1", "k2", "at", "first", "last", "hashes"])
    return work


def _texts(batch: pa.RecordBatch) -> Iterator[tuple]:
    marks = (batch.column(i).to_pylist() for i in (3, 4, 5))
    for k1, k2, text, at, first, last in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), *marks):
        yield k1, k2, text.as_buffer().to_pybytes(), at, first, last


def _run_rows(splitters: list[bytes], width: int, step: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: list[tuple] = []
        task, size, number = TaskContext.get().partitionId(), 0, 0

        def cut() -> Iterator[pa.RecordBatch]:
            nonlocal number
            run.sort()
            name = task << 32 | number  # equal runs of two tasks are two runs
            parts, blocks, orders, block, held, part, seq = [], [], [], [], 0, None, 0

            def close() -> None:
                nonlocal block, held, seq
                if block:
                    parts.append(part)
                    orders.append(seq)
                    blocks.append(front_code(block))
                    block, held, seq = [], 0, seq + 1

            for item in run:
                if block and item[:4] == block[-1][:4]:
                    block[-1] = (*item[:4], block[-1][4] + 1)
                    continue
                own = bisect_right(splitters, item[0])
                if own != part or held > BLOCK_BYTES:
                    close()
                    part = own
                block.append((*item, 1))
                held += len(item[0])
            close()
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([name] * len(parts), pa.int64()),
                                              pa.array(orders, pa.int32()), pa.array(blocks, pa.binary())],
                                             names=["part", "run", "seq", "block"])
            number += 1
            run.clear()

        for batch in batches:
            for _, _, text, at, first, last in _texts(batch):
                for suffix, forward, t0, t1, _ in suffixes(text, at, first, last, width, step):
                    run.append((suffix, forward, t0, t1))
                    size += len(suffix)
                if size > RUN_BYTES:
                    size = 0
                    yield from cut()
        if run:
            yield from cut()
    return work


def _merge_rows(width: int, step: int, together: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(part: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            for row in verdicts([decode(blocks) for blocks in part], width + 1 - step, width, together):
                rows.append(row)
                if len(rows) >= 50_000:
                    yield table(rows)
                    rows = []
            if rows:
                yield table(rows)

        def table(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)],
                                              names=["e1", "e2", "low", "high", "s1", "s2"])

        part, run, runs = None, None, []
        for batch in batches:
            for own, name, seq, block in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if own != part:
                    if runs:
                        yield from out(runs)
                    part, run, runs = own, None, []
                if name != run:  # a run's blocks follow each other
                    runs.append([])
                runs[-1].append(block)
                run = name
        if runs:
            yield from out(runs)
    return work


def _place_rows(width: int, step: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*name_of(suffix, t0, t1), k1, k2, p)
                    for k1, k2, text, at, first, last in _texts(batch)
                    for suffix, _, t0, t1, p in suffixes(text, at, first, last, width, step)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=["e1", "e2", "k1", "k2", "place"])
    return work


def _cut_rows(width: int, with_text: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, shas, kept_texts = [], [], [], [], []
            for text, found in zip(batch.column(1), batch.column(2).to_pylist()):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                runs: list[list[int]] = []
                for begin, end in sorted(found or ()):
                    if runs and begin <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], end)
                    else:
                        runs.append([begin, end])
                edges = [0, *(x for run in runs for x in run), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                sizes.append(len(raw))
                removed.append(len(raw) - len(kept))
                spans.append([{"start": a, "end": b} for a, b in runs])
                shas.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept if with_text else None)
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                      pa.array(spans, pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()}))), pa.array(shas, pa.string())]
            names = ["id", "n_bytes", "n_removed", "spans", "kept_sha256"]
            if with_text:
                arrays.append(pa.array(kept_texts, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(arrays, names=names)
    return work


def _united(ranges: Column) -> Column:
    """Ranges (low, high) of whole numbers in order, with those that touch or overlap made one."""
    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        grown = F.struct(last["low"].alias("low"), F.greatest(last["high"], x["high"]).alias("high"))
        return F.when(F.coalesce(last["high"] >= x["low"] - 1, F.lit(False)),
                      F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.sort_array(ranges), F.array().cast("array<struct<low:int,high:int>>"), step)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM,
                   step: int = STEP, together: int = TOGETHER, part_bytes: int = PART_BYTES, with_text: bool = False) -> DataFrame:
    """One row per row of `docs`: id, n_bytes, n_removed, spans (maximal removed runs of bytes), kept_sha256, and
    `kept`, the bytes that stay, if asked for. Sorts and merges when called; `step` is at most 128."""
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    keyed = _keyed(docs, doc_id, text)
    ints = "array<int>"
    found = stash(map_batches(keyed.where(F.octet_length("text") >= width).select("text", "k1", "k2"), _anchor_rows(width, gram),
                              f"k1 bigint, k2 bigint, at {ints}, first {ints}, last {ints}, hashes array<bigint>"), "anchors")
    each = found.select("k1", "k2", F.explode(F.arrays_zip("at", "first", "last", "hashes")).alias("x"))
    # As a plain table, so that the join with it can split an anchor that very many documents share.
    repeated = stash(found.select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
                     .where("n > 1").drop("n"), "repeated-anchors")
    marks = stash(each.select("k1", "k2", F.col("x.hashes").alias("h"), F.struct("x.at", "x.first", "x.last").alias("x"))
                  .join(repeated, "h").groupBy("k1", "k2").agg(F.sort_array(F.collect_set("x")).alias("x"))
                  .select("k1", "k2", *[F.col("x")[c].alias(c) for c in ("at", "first", "last")]), "marks")
    groups = F.aggregate(F.arrays_zip("at", "first", "last"), F.lit(0).cast("bigint"), lambda n, x: n + 1 + F.floor(
        (x["at"] - x["first"]) / step) - F.floor((x["at"] - x["last"]) / step))
    total = marks.agg(F.sum(groups).alias("suffixes"), F.count(F.lit(1)).alias("docs")).first()
    parts = min(MOST_PARTS, max(1, -(-(total.suffixes or 0) * (width + step // 2) // part_bytes)))

    def marked(marks: DataFrame = marks) -> DataFrame:
        return keyed.select("k1", "k2", "text").join(marks, ["k1", "k2"]).select("k1", "k2", "text", "at", "first", "last")

    splitters: list[bytes] = []
    if parts > 1:
        # About 40 suffixes per part, from anchors that a hash of their place picks; they only place the cuts.
        one_in = max(1, total.suffixes // (40 * parts))
        some = marks.select("k1", "k2", F.filter(F.arrays_zip("at", "first", "last"), lambda x: F.pmod(
            F.xxhash64("k1", "k2", x["at"]), F.lit(one_in)) == 0).alias("x")).where(F.size("x") > 0)

        def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([s[0] for _, _, t, *m in _texts(batch) for s in suffixes(t, *m, width, step)], pa.binary())], names=["s"])

        # At most 40 times MOST_PARTS of them, but for chance, so they go to the texts and not the texts to them.
        sampled = marked(F.broadcast(some.select("k1", "k2", *[F.col("x")[c].alias(c) for c in ("at", "first", "last")])))
        got = sorted({bytes(r.s) for r in map_batches(sampled, picked, "s binary").collect()})
        splitters = sorted({got[len(got) * i // parts] for i in range(1, parts)}) if got else []
    runs = map_batches(marked(), _run_rows(splitters, width, step), "part int, run bigint, seq int, block binary")
    dealt = runs.repartition(parts, "part").sortWithinPartitions("part", "run", "seq")
    judged = stash(map_batches(dealt, _merge_rows(width, step, together),
                               "e1 bigint, e2 bigint, low int, high int, s1 bigint, s2 bigint"), "verdicts")
    open_ones = judged.where("s1 IS NOT NULL")
    twice = open_ones.groupBy("s1", "s2").agg(F.sum("high").alias("n")).where("n > 1").drop("n")
    known = judged.where("s1 IS NULL").select("e1", "e2", "low", "high").unionByName(
        open_ones.join(twice, ["s1", "s2"]).select("e1", "e2", "low", F.col("low").alias("high")))
    known = stash(known.groupBy("e1", "e2").agg(_united(F.collect_set(F.struct("low", "high"))).alias("ranges")), "ranges")
    places = map_batches(marked(), _place_rows(width, step), "e1 bigint, e2 bigint, k1 bigint, k2 bigint, place bigint")
    spans = places.join(known, ["e1", "e2"]).select("k1", "k2", F.transform("ranges", lambda r: F.array(
        F.col("place") - r["high"], F.col("place") - r["low"] + width)).alias("spans"))
    # A document's list is bounded by its length; adjoining spans are united where it is cut.
    spans = spans.groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    joined = keyed.join(spans, ["k1", "k2"], "left").select("id", "text", "spans")
    schema = f"id {kind}, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept_sha256 string"
    return map_batches(joined, _cut_rows(width, with_text), schema + (", kept binary" if with_text else ""))
