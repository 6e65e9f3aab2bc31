"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over document windows.

Every benchmark text gives windows of `n` consecutive words (a shorter text is one window). A document
word inside an occurrence of a window is hit. Window hashes only nominate; each nominated window is
compared word by word before it counts.

The benchmark is cut into blocks of about half of `block_bytes` of text, by a hash of id and text. Each block is collected,
indexed in arrays of about ten bytes a byte of text, broadcast, used in one pass over the documents without a shuffle, and
dropped before the next one is read; between two passes the documents are written to the shared folder. So driver and workers
hold one block at a time, whatever the size of the benchmark, and the work grows with documents times blocks. A
benchmark of one block needs no writing. A single item longer than a block is a block by itself.

Nulls and empty texts have no words and are never hit. Repeated benchmark rows count once per id; a null
id marks words but is not listed. Repeated documents are judged alike. Empty tables give empty results.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from workloom.llm.frames import free_name, map_batches, text_of
from workloom.llm.words import Words, chunks
from workloom.session import stash

#: Bytes of benchmark text that one broadcast holds at most; one longer item stands alone.
BLOCK_BYTES = 8 << 20


class _Windows:
    """The windows of one block of benchmark texts: per length, their hashes in order, and the words they begin with."""

    def __init__(self, texts: list[str], n: int):
        self.words: list[Words] = []
        found: dict[int, list[np.ndarray]] = {}
        for row, data, offsets in chunks(pa.array(texts, pa.large_string())):
            words = Words(data, offsets)
            counts = words.counts()
            for length in {min(n, int(c)) for c in counts if c}:
                at, hashes = words.windows(length)
                owner = np.searchsorted(words.first, at, "right") - 1
                wanted = (counts[owner] == length) if length < n else (counts[owner] >= n)
                kind = [("hash", np.uint64), ("part", np.int32), ("at", np.int32), ("owner", np.int32)]
                rows = np.empty(int(wanted.sum()), kind)
                rows["hash"], rows["part"], rows["at"], rows["owner"] = (
                    hashes[wanted], len(self.words), at[wanted], owner[wanted] + row)
                found.setdefault(length, []).append(rows)
            words.hashes = None  # not needed to compare words
            self.words.append(words)
        self.index = {}
        for length, parts in found.items():
            rows = np.concatenate(parts)
            rows = rows[np.argsort(rows["hash"], kind="stable")]  # a window's owners stay in order
            keys = np.ascontiguousarray(rows["hash"])
            coarse = np.zeros(1 << 20, bool)
            coarse[keys >> np.uint64(44)] = True
            self.index[length] = coarse, keys, rows[["part", "at", "owner"]]
        self.known: dict[tuple[int, int], dict[bytes, list[int]]] = {}

    def find(self, words: Words) -> Iterator[tuple[int, int, list[int]]]:
        """(first word, length, items) of every occurrence."""
        for length, (coarse, keys, _) in self.index.items():
            at, hashes = words.windows(length)
            near = np.flatnonzero(coarse[hashes >> np.uint64(44)])
            place = np.searchsorted(keys, hashes[near])
            same = keys[np.minimum(place, len(keys) - 1)] == hashes[near]
            for i, p in zip(at[near[same]].tolist(), place[same].tolist()):
                holders = self._holders(length, p).get(words.phrase(i, length))
                if holders:
                    yield i, length, holders

    def _holders(self, length: int, place: int) -> dict[bytes, list[int]]:
        """The different windows with the hash at `place`, and the items that hold each; kept once asked for."""
        if (length, place) not in self.known:
            _, keys, rows = self.index[length]
            held: dict[bytes, list[int]] = {}
            for part, at, owner in rows[place:np.searchsorted(keys, keys[place], "right")].tolist():
                items = held.setdefault(self.words[part].phrase(at, length), [])
                if not items or items[-1] != owner:
                    items.append(owner)
            self.known[length, place] = held
        return self.known[length, place]


def _runs(marked: np.ndarray) -> np.ndarray:
    """(start, end) of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marked.view(np.int8), [0]))))
    return edges.reshape(-1, 2)


def _pass(windows, ids, last: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, names = windows.value, ids.value
        for batch in batches:
            texts, before = batch.column(0), batch.column(1).to_pylist()
            results: list[dict] = []
            for row, data, offsets in chunks(texts):
                words = Words(data, offsets)
                hits: dict[int, list] = {}
                for i, length, holders in index.find(words):
                    doc = int(np.searchsorted(words.first, i, "right")) - 1
                    hits.setdefault(doc, []).append((i - int(words.first[doc]), length, holders))
                counts = words.counts()
                for doc in range(len(offsets) - 1):
                    old = before[row + doc] or {"runs": [], "items": []}
                    runs, items = old["runs"], old["items"]
                    if hits.get(doc):
                        marked = np.zeros(int(counts[doc]), bool)
                        for a, b in zip(runs[::2], runs[1::2]):
                            marked[a:b] = True
                        for i, length, holders in hits[doc]:
                            marked[i:i + length] = True
                        runs = _runs(marked).ravel().tolist()
                        items = sorted({*items, *(names[x] for _, _, held in hits[doc] for x in held
                                                  if names[x] is not None)})
                    result = {"n_words": int(counts[doc]), "runs": runs, "items": items}
                    if last:
                        first, base = int(words.first[doc]), int(offsets[doc])
                        result["spans"] = [{"start": int(words.starts[first + a]) - base,
                                            "end": int(words.ends[first + b - 1]) - base}
                                           for a, b in zip(runs[::2], runs[1::2])]
                    results.append(result)
            kind = {"n_words": pa.int64(), "runs": pa.list_(pa.int64()), "items": pa.list_(pa.string())}
            if last:
                kind["spans"] = pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()}))
            column = pa.array(results, pa.struct(kind))
            columns = dict(zip(batch.schema.names, [texts, column, *batch.columns[2:]]))
            if last:
                del columns[batch.schema.names[0]]
            yield pa.RecordBatch.from_pydict(columns)
    return work


def _blocks(benchmark: DataFrame, id_column: str, text_column: str, block_bytes: int):
    """The number of blocks, and their texts and ids; a block is all that reaches the driver at once."""
    rows = benchmark.select(F.col(id_column).cast("string").alias("id"), text_of(benchmark, text_column))
    rows = rows.distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-2 * size // block_bytes))

    def texts_and_ids():
        for block in range(n_blocks):
            part = rows if n_blocks == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)) == block)
            got = part.orderBy("text", "id").collect()
            yield [r.text for r in got], [r.id for r in got]

    return n_blocks, texts_and_ids()


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
         item_text: str = "text", n: int = 13, block_bytes: int = BLOCK_BYTES,
         keep: list[str] | None = None, into: str = "contamination") -> DataFrame:
    """The `keep` columns of `docs` (all by default), and a struct column `into`:

    n_words; runs, the hit words as first, end, first, end, ...; items, the ids of benchmark texts with
    an occurring window, sorted as strings; spans, the runs as byte offsets in the text.
    """
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    body = docs.select(text_of(docs, text, "__text"),
                       F.lit(None).cast("struct<n_words:bigint,runs:array<bigint>,items:array<string>>").alias("__found"),
                       *[docs[c].alias(f"__{i}") for i, c in enumerate(keep)])
    kept = [f"__{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    n_blocks, blocks = _blocks(benchmark, item_id, item_text, block_bytes)
    for k, (texts, names) in enumerate(blocks):
        last = k == n_blocks - 1
        windows, ids = (spark.sparkContext.broadcast(x) for x in (_Windows(texts, n), names))  # one block, see block_bytes
        found = "struct<n_words:bigint,runs:array<bigint>,items:array<string>" + (
            ",spans:array<struct<start:bigint,end:bigint>>>" if last else ">")
        columns = [f"__found {found}"] if last else ["__text string", f"__found {found}"]
        body = map_batches(body, _pass(windows, ids, last), ", ".join([*columns, *kept]))
        if not last:
            body = stash(body, "scanned")
            for used in (windows, ids):
                used.destroy()
    return body.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(keep)], F.col("__found").alias(into))


def n_hit(found) -> F.Column:
    """Hit words, from the struct of `scan`."""
    runs = found["runs"]
    return F.aggregate(F.transform(runs, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)),
                       F.lit(0).cast("bigint"), lambda a, x: a + x)


def is_contaminated(found) -> F.Column:
    """Whether at least one word in twenty is hit."""
    hit = n_hit(found)
    return (hit > 0) & (20 * hit >= found["n_words"])


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, unchanged."""
    into = free_name(docs, "contamination")
    found = scan(docs, benchmark, into=into, **options)
    return found.where(~is_contaminated(F.col(into))).drop(into)


def without_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """All documents, with the hit spans cut out of their texts."""
    into = free_name(docs, "contamination")
    found = scan(docs, benchmark, text=text, into=into, **options)
    spans = F.concat(F.col(into)["spans"], F.array(F.struct(
        F.octet_length(text).cast("bigint").alias("start"), F.octet_length(text).cast("bigint").alias("end"))))
    raw = F.col(text).cast("binary")
    # Each span gives the bytes between the end of the one before and its own start.
    parts = F.transform(spans, lambda s, i: F.substring(
        raw, (F.when(i > 0, spans[i - 1]["end"]).otherwise(F.lit(0)) + 1).cast("int"),
        (s["start"] - F.when(i > 0, spans[i - 1]["end"]).otherwise(F.lit(0))).cast("int")))
    kept = F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p)).cast("string")
    return found.withColumn(text, F.when(F.size(F.col(into)["spans"]) > 0, kept).otherwise(F.col(text))).drop(into)
