"""MinHash near-dedup by Order MinHash, with candidates verified by banded alignment.

A document is the sequence of its shingles: five consecutive words (see `words`), or all its words if it
has fewer. Two documents are linked if their shingle sequences align well enough: with L the length of
their longest common subsequence, L / (n + m - L) >= 0.8. This is the Jaccard similarity of the shingles,
with repeats counted and with matches in different order refused.

1. Documents with equal word sequences are one node, named by a hash of the words.
2. Each of `sketches` hash functions picks the `picks` least occurrence-labelled shingles of a node and keeps
   their text order. Nodes with the same ordered pick meet in a bucket.
3. In each bucket, nodes are compared with the bucket's least node; what is linked gets one label. Buckets that
   still hold several labels are searched on: small ones pair by pair across labels, so that no link is lost
   there; in large ones the nodes outside the main label are compared with members that a hash picks
   for each bucket. So a large bucket of n nodes costs about n comparisons, and copies of copies meet
   through labels instead of pairs.
4. The members of large buckets that then still hold several labels are joined on their rarest shingles by an
   exact prefix filter: sequences that align well enough share one of them. How rare a shingle is, counts in a
   fixed number of slots say. Bitmaps of the shingles leave out pairs that surely have too few in common. Every
   other pair across labels is verified, so that no link is lost in large buckets either.
5. A bit-parallel banded alignment verifies each candidate. The band is as wide as the threshold needs, so
   within it the result is exact.

All decisions read whole texts. Null and empty texts, and texts without any word, form one class per kind
of text: none is ever linked to another document, nor are they dropped as copies (`class_id` is their own
id). Repeated rows fall into one class. Ties go to the least doc_id; a class of null ids has a null class_id.
"""

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from workloom.llm.frames import free_name, map_batches, text_of
from workloom.llm.links import components
from workloom.llm.words import Words, chunks, mix
from workloom.session import stash

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES, PICKS = 16, 3
#: Buckets of so many nodes are compared pair by pair where labels differ.
SMALL = 64
#: So many of a node's earlier prefix shingles keep a pair from being met again and again.
EARLIER = 16
#: Counts of holders, by a hash of the shingle, that order the shingles of members of large buckets.
SLOTS = 1 << 21
BLOCK = 1 << 12
#: 64-bit parts of a node's bitmap, which shows at once that most pairs differ too much.
PARTS = 8

_SEEDS = mix(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(words: Words, size: int = SHINGLE) -> list[np.ndarray]:
    """Each text's shingle hashes, in order."""
    at, hashes = words.windows(size)
    bounds = np.searchsorted(at, words.first)
    counts, out = words.counts(), []
    for i in range(len(counts)):
        if counts[i] >= size or not counts[i]:
            out.append(hashes[bounds[i]:bounds[i + 1]])
        else:
            own = words.hashes[words.first[i]:words.first[i + 1]]
            out.append(mix((own * _SEEDS[:len(own)]).sum(keepdims=True) + np.uint64(len(own))))
    return out


def _labelled(row: np.ndarray) -> np.ndarray:
    """Shingles made distinct: the second, third, ... occurrence of one gets another hash."""
    order = np.argsort(row, kind="stable")
    ranked = row[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    if fresh.all():
        return row
    place = np.arange(len(row))
    nth = place - np.maximum.accumulate(np.where(fresh, place, 0))
    labelled = np.empty_like(row)
    labelled[order] = np.where(nth > 0, mix(ranked + nth.astype(np.uint64)), ranked)
    return labelled


def order_sketch(row: np.ndarray, sketches: int = SKETCHES, picks: int = PICKS) -> np.ndarray:
    """For each hash function, a hash of the least occurrence-labelled shingles in text order."""
    labelled = _labelled(row)
    keyed = labelled[None, :] ^ _SEEDS[:sketches, None]
    keyed *= np.uint64(0xBF58476D1CE4E5B9)
    keyed ^= keyed >> np.uint64(32)
    keyed *= np.uint64(0x94D049BB133111EB)
    if len(row) > picks:
        at = np.sort(np.argpartition(keyed, picks - 1, axis=1)[:, :picks], axis=1)
    else:
        at = np.broadcast_to(np.arange(len(row)), (sketches, len(row)))
    chosen = labelled[at]
    return mix((chosen * _SEEDS[64:64 + at.shape[1]]).sum(axis=1) + np.arange(sketches, dtype=np.uint64))


def common_subsequence(a: list[int], b: list[int], band: int) -> int:
    """Length of the longest common subsequence among alignments that stay within `band` of the diagonal.

    Row by row over `a`; bit j of the window says that column i - band + j brings no new match. Columns
    that leave the window below are counted in `done`.
    """
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    width = 2 * band + 1
    full, done = (1 << width) - 1, 0
    state = full  # columns -band .. band of row 0; those below 0 stay one
    for i, x in enumerate(a):
        if i:
            done += not state & 1
            state = (state >> 1) | (1 << (width - 1))
        low, match = i - band, 0
        for j in places.get(x, ()):
            if low <= j < low + width:
                match |= 1 << (j - low)
        if match:
            hit = state & match
            state = ((state + hit) | (state - hit)) & full
    return done + width - state.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """The aligned similarity of two shingle sequences; 0 if it is below `least`."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    need = int(np.ceil(least / (1 + least) * (n + m) - 1e-9))
    if min(n, m) < need:
        return 0.0
    shared = np.intersect1d(_labelled(a), _labelled(b), assume_unique=True).size
    if shared < need:
        return 0.0
    head = 0
    short = min(n, m)
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    a, b = a[head:], b[head:]
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:short] != b[::-1][:short])
    tail = int(differ[0]) if len(differ) else short
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    # An alignment with `need` matches leaves so many elements of either side alone, which bounds its drift.
    band = max(n - need, m - need, 0) + 1
    length = head + tail + (common_subsequence(a.tolist(), b.tolist(), band) if len(a) and len(b) else 0)
    return length / (n + m - length) if length >= need else 0.0


def _sketching(sketches: int, picks: int, size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in chunks(batch.column(1)):
                words = Words(data, offsets)
                nodes, keys = [], []
                for i, own in enumerate(shingles(words, size)):
                    if len(own):
                        first, end = words.first[i], words.first[i + 1]
                        nodes.append(blake2b(words.hashes[first:end].tobytes(), digest_size=16).digest())
                        keys.append(order_sketch(own, sketches, picks).view(np.int64))
                    else:
                        nodes.append(None)
                        keys.append(None)
                n = len(nodes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), pa.array(nodes, pa.binary()),
                     pa.array(keys, pa.list_(pa.int64())), batch.column(1).slice(row, n)],
                    names=["id", "name", "keys", "text"])
    return work


def _verifying(size: int, least: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = (None, None)
        for batch in batches:
            sides = []
            for column in (batch.column(2), batch.column(3)):
                rows: list[np.ndarray] = []
                for _, data, offsets in chunks(column):
                    rows += shingles(Words(data, offsets), size)
                sides.append(rows)
            score = [similarity(a, b, least) for a, b in zip(*sides)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64())],
                                             names=["a", "b", "score"])
    return work


def _shingling(size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in chunks(batch.column(2)):
                rows = [_labelled(own).view(np.int64) for own in shingles(Words(data, offsets), size)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(rows)), batch.column(1).slice(row, len(rows)),
                     pa.array(rows, pa.list_(pa.int64()))], names=["node", "label", "shingles"])
    return work


def _slots(row: np.ndarray, slots: int) -> np.ndarray:
    return (mix(row.view(np.uint64)) % np.uint64(slots)).astype(np.int64)


def _counting(slots: int):
    """A task's counts by slot, in blocks that are added up afterwards."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(slots, np.int64)
        for batch in batches:
            at, n = np.unique(_slots(batch.column(0).flatten().to_numpy(), slots), return_counts=True)
            held[at] += n
        for begin in range(0, slots, BLOCK):
            if held[begin:begin + BLOCK].any():
                yield pa.RecordBatch.from_arrays([pa.array([begin], pa.int32()), pa.array([held[begin:begin + BLOCK].tobytes()], pa.binary())],
                                                 names=["begin", "held"])
    return work


def _adding(slots: int):
    def work(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, total = None, np.zeros(0, np.int64)
        for block in blocks:
            for at, held in zip(block.column(0).to_pylist(), block.column(1)):
                if at != begin:
                    if begin is not None:
                        yield table(begin, total)
                    begin, total = at, np.zeros(min(BLOCK, slots - at), np.int64)
                total += np.frombuffer(held.as_buffer(), np.int64)
        if begin is not None:
            yield table(begin, total)

    def table(begin: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([begin], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["begin", "held"])
    return work


def bitmap(row: np.ndarray) -> np.ndarray:
    """Bits that each labelled shingle turns over. Two bitmaps differ in at most as many bits as shingles stand on one side alone."""
    odd = np.bincount((mix(row.view(np.uint64)) >> np.uint64(32)).astype(np.int64) % (64 * PARTS), minlength=64 * PARTS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefix(row: np.ndarray, held: np.ndarray, least: float = SIMILARITY) -> tuple[np.ndarray, int]:
    """The shingles, rarest slot first, of which a node alike must hold one, and how many are left from the first on.

    A slot with one holder is that of a shingle that no other node holds; those come first and are left out.
    """
    slots = held[_slots(row, len(held))]
    order = np.lexsort((row, slots))
    alone = int((slots < 2).sum())
    end = len(row) - int(np.ceil(least * len(row) - 1e-6)) + 1
    return row[order[alone:max(alone, end)]], len(row) - alone


def _prefixing(held, least: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)],
                                              names=["node", "label", "n", "left", "shingle", "earlier", "bits"])

        rows: list[tuple] = []
        for batch in batches:
            for node, label, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                own = own.values.to_numpy()
                start, left = prefix(own, held.value, least)
                bits = bitmap(own)
                for place, shingle in enumerate(start):
                    rows.append((node, label, len(own), left - place, shingle, start[max(place - EARLIER, 0):place], bits))
                    if len(rows) >= 50_000:
                        yield table(rows)
                        rows = []
        if rows:
            yield table(rows)
    return work


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _candidates(buckets: DataFrame, turn: int) -> DataFrame:
    """Pairs of nodes of different labels that share a bucket.

    First every node with its bucket's least one. Then, in buckets of at most SMALL nodes, all pairs across
    labels; in larger ones every node outside the label with the most nodes, with one node of that label and
    with one of any other label, each picked by a hash that differs from bucket to bucket.
    """
    key = ["sketch", "key"]
    if not turn:
        least = (buckets.groupBy(*key).agg(F.min("node").alias("x"), F.max("node").alias("most"))
                 .where("x <> most").drop("most"))
        least = stash(least, "least")  # a plain table: a join with it can split a hot bucket
        return _ordered(buckets.join(least, key).select("x", F.col("node").alias("y")))
    pick = F.struct(F.xxhash64("node", "sketch", F.lit(turn)).alias("h"), "node")
    of_label = buckets.groupBy(*key, "label").agg(F.min(pick).alias("pick"), F.count(F.lit(1)).alias("n"))
    several = of_label.groupBy(*key).agg(
        F.count(F.lit(1)).alias("labels"), F.sum("n").alias("n"), F.max(F.struct("n", "label", "pick.node")).alias("main"),
        F.min(F.struct(F.col("pick.h"), "label", "pick.node")).alias("other")).where("labels > 1")
    several = stash(several, "open-buckets")
    members = buckets.join(several, key)
    small = members.where(f"n <= {SMALL}").select(*key, "node", "label")
    across = small.select(*key, F.col("node").alias("x"), F.col("label").alias("x_label")).join(
        small.select(*key, F.col("node").alias("y"), F.col("label").alias("y_label")), key).where("x_label < y_label")
    large = members.where(f"n > {SMALL}").where(F.col("label") != F.col("main.label"))
    star = large.select(F.col("main.node").alias("x"), F.col("node").alias("y"))
    aside = large.where(F.col("label") != F.col("other.label")).select(F.col("other.node").alias("x"), F.col("node").alias("y"))
    return _ordered(across.select("x", "y").unionByName(star).unionByName(aside))


def _rest(members: DataFrame, bodies: DataFrame, size: int, least: float) -> DataFrame:
    """All pairs of `members` (node, label) of different labels that may be alike.

    With shingles in one order, a pair with `need` common ones has its first common one where both sides have at
    least `need` left. That holds in any order; a rare-first one keeps the pairs few. So shingles are ordered by
    the holders of their slot, one of SLOTS, and the counts go to the texts, not each shingle to its count. Shingles
    that share a slot only seem less rare. The label with most holders of a shingle doesn't meet itself. A large group of
    texts that are nearly alike enough shares many prefix shingles; the join itself drops its pairs whose bitmaps differ in
    more places than `need` common shingles allow, before any text is fetched.
    """
    texts = members.join(bodies, "node").select("node", "label", "text")
    found = stash(map_batches(texts, _shingling(size), "node bigint, label bigint, shingles array<bigint>"), "rest")
    blocks = map_batches(found.select("shingles"), _counting(SLOTS), "begin int, held binary")
    blocks = map_batches(blocks.repartition("begin").sortWithinPartitions("begin"), _adding(SLOTS), "begin int, held binary")
    held = np.zeros(SLOTS, np.int64)
    for block in blocks.collect():
        held[block.begin:block.begin + BLOCK] = np.frombuffer(block.held, np.int64)
    held = members.sparkSession.sparkContext.broadcast(held)  # SLOTS counts, whatever the number of members
    # A row also bears the few prefix shingles before its own: a pair that shares one of those has met there already.
    start = stash(map_batches(found, _prefixing(held, least), "node bigint, label bigint, n int, left int, shingle bigint, "
                              "earlier array<bigint>, bits array<bigint>"), "prefixes")
    of_label = start.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = stash(of_label.groupBy("shingle").agg(F.count(F.lit(1)).alias("labels"), F.max(F.struct("n", "label")).alias("most"))
                  .where("labels > 1").select("shingle", F.col("most.label").alias("main")), "mixed-shingles")
    met = start.join(mixed, "shingle")
    x, y = (stash(rows.select("shingle", *[F.col(c).alias(f"{side}_{c}") for c in ("node", "label", "n", "left", "earlier", "bits")], *more), f"rest-{side}")
            for side, rows, more in (("x", met.where("label <> main"), ["main"]), ("y", met, [])))
    need = F.ceil(least / (1 + least) * (F.col("x_n") + F.col("y_n")) - 1e-6)
    differ = sum((F.bit_count(F.col("x_bits")[i].bitwiseXOR(F.col("y_bits")[i])) for i in range(PARTS)), F.lit(0))
    pairs = x.join(y, "shingle").where(
        F.expr("x_label <> y_label AND (y_label = main OR x_label < y_label)") & (F.least("x_left", "y_left") >= need)
        & (differ <= F.col("x_n") + F.col("y_n") - 2 * need)
        & ~F.arrays_overlap("x_earlier", "y_earlier"))
    return _ordered(pairs.select(F.col("x_node").alias("x"), F.col("y_node").alias("y")))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE,
            least: float = SIMILARITY, sketches: int = SKETCHES, picks: int = PICKS) -> DataFrame:
    """One row per row of `docs`: id, digest (a hash of the text), node and label (of the words and of the
    class; null without words), class_id and n_class, the rows of its class.

    Runs its rounds when called and writes them to the shared folder.
    """
    base = docs.select(docs[doc_id].alias("id"), text_of(docs, text))
    kind = docs.schema[doc_id].dataType.simpleString()
    read = stash(map_batches(base, _sketching(sketches, picks, size),
                             f"id {kind}, name binary, keys array<bigint>, text string"), "sketches")
    # Nodes get whole numbers once and for all, which group and sort without their 128-bit names.
    nodes = stash(read.where("name IS NOT NULL").groupBy("name").agg(F.first("keys").alias("keys"))
                  .withColumn("node", F.monotonically_increasing_id()), "nodes")
    each = nodes.select("node", F.posexplode("keys").alias("sketch", "key"))
    # Buckets of one node can't bring a pair.
    shared = stash(each.groupBy("sketch", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "shared-keys")
    buckets = stash(each.join(shared, ["sketch", "key"]), "shared-buckets")
    involved = nodes.select("name", "node").join(buckets.select("node").distinct(), "node")
    bodies = stash(read.select("name", "text").where("name IS NOT NULL").join(involved, "name")
                   .groupBy("node").agg(F.min("text").alias("text")), "bodies")

    def verified(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(bodies.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        with_b = with_a.join(bodies.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        return stash(map_batches(with_b.select("a", "b", "text_a", "text_b"), _verifying(size, least),
                                 "a bigint, b bigint, score double"), "scored")

    def untested(pairs: DataFrame) -> DataFrame:
        return stash(pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti"), "pairs")

    def still_open(buckets: DataFrame) -> DataFrame:
        """The buckets that hold several labels, with labels and sizes; labels only unite, so the others are done with."""
        named = buckets.select("sketch", "key", "node")
        named = named.withColumn("label", F.col("node")) if labels is None else named.join(
            labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        kept = named.groupBy("sketch", "key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
        return stash(named.join(stash(kept.where("low <> high").select("sketch", "key", F.col("n").alias("size")), "open-keys"), ["sketch", "key"]), "open-buckets")

    def united(new: DataFrame) -> DataFrame | None:
        """The labels after more links, found among the labels that they join."""
        if not new.limit(1).count():
            return labels
        if labels is None:
            return components(new)
        ends = new
        for end in ("a", "b"):
            of_end = labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
            ends = ends.join(of_end, end, "left").withColumn(f"{end}_label", F.coalesce(f"{end}_label", end))
        tops = components(ends.select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).where("a <> b").distinct())
        moved = labels.join(tops.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select(
            "node", F.coalesce("top", "label").alias("label"))
        return stash(moved.unionByName(tops.join(labels.select("node"), "node", "left_anti")), "labels")

    labels = None
    tested = verified(_candidates(buckets, 0))
    labels = united(tested.where(F.col("score") >= least).select("a", "b"))
    buckets = still_open(buckets)
    more = verified(untested(_candidates(buckets, 1)))
    tested = tested.unionByName(more)
    labels = united(more.where(F.col("score") >= least).select("a", "b"))
    # Small buckets are done; what is still open in large ones is compared exactly.
    members = stash(still_open(buckets.where(f"size > {SMALL}")).select("node", "label").distinct(), "members")
    if members.limit(1).count():
        labels = united(verified(untested(_rest(members, bodies, size, least))).where(F.col("score") >= least).select("a", "b"))
    wide = read.select("id", F.col("name").alias("node"), F.xxhash64("text").alias("digest"))
    wide = wide.join(nodes.select(F.col("name").alias("node"), F.col("node").alias("number")), "node", "left")
    if labels is not None:
        wide = wide.join(labels.select(F.col("node").alias("number"), "label"), "number", "left").withColumn("label", F.coalesce("label", "number"))
    else:
        wide = wide.withColumn("label", F.col("number"))
    wide = wide.drop("number")
    named = wide.where("label IS NOT NULL").groupBy("label").agg(
        F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n_class"))
    named = stash(named, "class-ids")
    with_words = wide.where("label IS NOT NULL").join(named, "label")
    without = wide.where("label IS NULL").withColumn("class_id", F.col("id")).withColumn(
        "n_class", F.lit(1).cast("bigint"))
    return with_words.unionByName(without)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` with one row of each class: the one with the least id, then the least hash of its text.

    Rows without words all stay. Rows that repeat id and text are one row afterwards.
    """
    found = stash(classes(docs, doc_id, text, **options), "classes").where("node IS NOT NULL AND n_class > 1")
    chosen = found.groupBy("class_id", "label").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "digest")).alias("one"))
    rows = found.join(chosen.drop("class_id"), "label").select("id", "digest", (
        F.struct(F.col("id").isNull().alias("last"), "id", "digest") == F.col("one")).alias("stays"))
    # A hot class has one row here per id and text, and a plain join gives each to its document.
    verdicts = rows.groupBy("id", "digest").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n"))
    stays, n, digest = (free_name(docs, x) for x in ("stays", "n_rows", "digest"))
    verdicts = verdicts.select(F.col("id").alias("__id"), F.col("digest").alias("__digest"),
                               F.col("stays").alias(stays), F.col("n").alias(n))
    keyed = docs.withColumn(digest, F.xxhash64(text_of(docs, text)))
    judged = keyed.join(verdicts, keyed[doc_id].eqNullSafe(F.col("__id")) & (keyed[digest] == F.col("__digest")), "left")
    judged = judged.where(f"`{stays}` IS NULL OR `{stays}`")
    once = judged.where(f"`{n}` IS NULL OR `{n}` = 1").select(*docs.columns)
    if not verdicts.where(f"`{stays}` AND `{n}` > 1").limit(1).count():
        return once
    return once.unionByName(judged.where(f"`{n}` > 1").dropDuplicates([doc_id, digest]).select(*docs.columns))
