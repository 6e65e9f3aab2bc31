"""Toxicity: a learned lexicon in a trie, met by Levenshtein automata, scored in windows of context.

Training reads at most `max_train` labelled rows (those with the least hash of their id). The
lexicon is words, and stems of several words, that are far commoner in toxic than in clean texts. A logistic
curve over what a lexicon finds is fitted on one half of the rows with the lexicon of the other half, so that
it sees a lexicon's errors; scoring uses this curve with the lexicon of all training rows.

Matching: a word is in the lexicon, begins with a stem, or is one edit away from a term of five letters
or more. The automaton of a word runs over the trie, all terms at once.
Hits add up in windows of `2 * REACH + 1` words; a hit between quotation marks counts less, as quotation
reports abuse more often than it is abuse.

Null and empty texts, and texts without hits, get the same low score. With no toxic training rows, all
scores are the share of toxic rows. Labels that repeat for an id count once, by the highest.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from workloom.llm import logistic
from workloom.llm.frames import kept, map_batches, text_of
from workloom.llm.words import Words, chunks
from workloom.session import stash

MAX_TRAIN = 20_000
LEAST_FUZZY = 5
REACH = 20
#: How much of a hit's weight is left for a hit by one edit, and for one in quotation.
EDITED, QUOTED = 0.7, 0.3
THRESHOLD = 0.7
STEMS = range(4, 9)
#: Signs beyond ASCII count as parts of words; these are taken off before matching.
_MARKS = "“”„‘’‚«»‹›…–—"
_MARK_BYTES = np.array([m.encode() for m in _MARKS], "S3")
_CACHE_WORDS = 200_000


@dataclass
class Trie:
    """Terms and stems by character. A node: its children, the weight of the term and of the stem that end there."""

    children: dict[str, "Trie"] = field(default_factory=dict)
    term: float = 0.0
    stem: float = 0.0

    def add(self, text: str, weight: float, is_stem: bool = False) -> None:
        node = self
        for c in text:
            node = node.children.setdefault(c, Trie())
        if is_stem:
            node.stem = weight
        else:
            node.term = weight


def match(trie: Trie, word: str, fuzzy: bool = True) -> float:
    """The greatest weight with which `word` meets the trie; 0 if it does not.

    The states of the word's Levenshtein automaton after some trie path are two bit sets: the places in
    the word that the path can have reached with no edit, and with at most one.
    """
    places: dict[str, int] = {}
    for i, c in enumerate(word):
        places[c] = places.get(c, 0) | 1 << i
    goal, best = 1 << len(word), 0.0
    stack = [(trie, 1, 3 if fuzzy else 0)]
    while stack:
        node, exact, edited = stack.pop()
        if node.term:
            if exact & goal:
                best = max(best, node.term)
            elif edited & goal:
                best = max(best, EDITED * node.term)
        if node.stem and exact:
            best = max(best, node.stem)
        for c, child in node.children.items():
            here = places.get(c, 0)
            stay = (exact & here) << 1
            more = ((edited & here) << 1 | exact | exact << 1 | stay << 1) if fuzzy else 0
            if stay or more:
                stack.append((child, stay, more))
    return best


class Lexicon:
    """Finds the words of many texts that meet the terms; remembers words by their hash."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float]):
        self.exact, self.near = Trie(), Trie()
        for term, weight in terms.items():
            self.exact.add(term, weight)
        for stem, weight in stems.items():
            self.exact.add(stem, weight, True)
        fuzzy = [t for t in terms if len(t) >= LEAST_FUZZY]
        for term in fuzzy:
            self.near.add(term, terms[term])
        self.heads = np.array(sorted({s.encode()[:3] for s in [*stems, *terms]}), "S3")
        forms = sorted({(len(t.encode()), int(_letters(np.frombuffer(t.encode(), np.uint8)))) for t in fuzzy})
        self.sizes = np.array([n for n, _ in forms], np.int64)
        self.letters = np.array([x for _, x in forms], np.uint64)
        self.known: dict[int, float] = {}

    def weights(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Indexes and weights of the words that meet the lexicon."""
        unique, first, where = np.unique(words.hashes, return_index=True, return_inverse=True)
        if len(self.known) > _CACHE_WORDS:
            self.known.clear()
        got = np.array([self.known.get(h, -1.0) for h in unique.tolist()], float)
        new = np.flatnonzero(got < 0)
        got[new] = 0.0
        at = first[new]
        starts, sizes = words.starts[at], words.ends[at] - words.starts[at]
        padded = np.concatenate([words.folded, np.zeros(3, np.uint8)])
        heads = np.stack([np.where(sizes > k, padded[starts + k], 0) for k in range(3)], 1).astype(np.uint8)
        tails = np.stack([padded[words.ends[at] - k] for k in (3, 2, 1)], 1)
        # The filters below see marks as letters, so words with marks at either end all pass.
        may = np.isin(np.ascontiguousarray(heads).view("S3").ravel(), self.heads)
        for three in (heads, tails):
            may |= np.isin(np.ascontiguousarray(three).view("S3").ravel(), _MARK_BYTES)
        for two in (heads[:, :2], tails[:, 1:]):
            may |= np.isin(np.ascontiguousarray(two).view("S2").ravel(), _MARK_BYTES)
        if len(self.letters) and len(new):
            bits = _letters(words.folded, words.starts, words.ends)[at]
            for size, mask in zip(self.sizes, self.letters):
                may |= (np.abs(sizes - size) <= 4) & (np.bitwise_count(bits ^ mask) <= 4)
        for j in np.flatnonzero(may):
            word = words.word(int(at[j])).decode("utf-8", "replace").strip(_MARKS)
            got[new[j]] = match(self.exact, word, False) or (match(self.near, word) if len(word) >= LEAST_FUZZY - 1 else 0.0)
        self.known.update(zip(unique[new].tolist(), got[new].tolist()))
        hits = np.flatnonzero(got[where] > 0)
        return hits, got[where][hits]


def _lexicon_of(model) -> Lexicon:
    """This process's lexicon of a broadcast model."""
    key = hash((tuple(sorted(model.value[0].items())), tuple(sorted(model.value[1].items()))))
    return kept(("lexicon", key), lambda: Lexicon(*model.value))


def _letters(data: np.ndarray, starts: np.ndarray | None = None, ends: np.ndarray | None = None):
    """The set of byte values modulo 64 in `data`, or in each of its words."""
    bits = np.uint64(1) << (data & 63).astype(np.uint64)
    if starts is None:
        return np.bitwise_or.reduce(bits)
    if not len(starts):
        return np.zeros(0, np.uint64)
    edges = np.empty(2 * len(starts), np.int64)
    edges[::2], edges[1::2] = starts, ends
    if edges[-1] == len(data):
        edges = edges[:-1]
    return np.bitwise_or.reduceat(bits, edges)[::2]


def _quoted(text: bytes, places: list[int]) -> list[bool]:
    """Whether each place lies between quotation marks: straight ones by parity, curved and angled ones by depth."""
    marks = {b'"': text.count(b'"')}
    inside = []
    for p in places:
        before = text[:p]
        straight = marks[b'"'] > 1 and before.count(b'"') % 2 == 1 and b'"' in text[p:]
        paired = any(before.count(a.encode()) > before.count(b.encode()) and b.encode() in text[p:]
                     for a, b in ("“”", "«»", "„“"))
        inside.append(bool(straight or paired))
    return inside


def features(lexicon: Lexicon, column: pa.Array) -> np.ndarray:
    """Per text: the strongest window, all hits, hits by length, hits."""
    rows = []
    for _, data, offsets in chunks(column):
        words = Words(data, offsets)
        at, weights = lexicon.weights(words)
        out = np.zeros((len(offsets) - 1, 4))
        bounds = np.searchsorted(at, words.first)
        counts = words.counts()
        for doc in np.flatnonzero(np.diff(bounds)):
            a, b = bounds[doc], bounds[doc + 1]
            place, weight = at[a:b], weights[a:b].copy()
            text = data[offsets[doc]:offsets[doc + 1]].tobytes()
            if b'"' in text or b"\xe2\x80" in text or b"\xc2\xab" in text:
                quoted = _quoted(text, (words.starts[place] - offsets[doc]).tolist())
                weight[np.array(quoted)] *= QUOTED
            total = np.concatenate([[0], np.cumsum(weight)])
            window = total[np.searchsorted(place, place + REACH, "right")] - total[np.searchsorted(place, place - REACH)]
            out[doc] = window.max(), total[-1], 100 * total[-1] / counts[doc], b - a
        rows.append(out)
    return np.log1p(np.concatenate(rows)) if rows else np.zeros((0, 4))


def _lexicon(sample: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Terms and stems with their weights, from (text, toxic). Counts are of distinct texts.

    A term stands in at least three toxic texts of the bounded sample, which bounds the lexicon; nothing else does.
    """
    texts = sample.groupBy("text").agg(F.max("toxic").alias("toxic"))
    totals = {r.toxic: r.n for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic:
        return {}, {}
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = (texts.select("toxic", F.explode(F.array_distinct(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"))).alias("word"))
             .where("word <> ''")
             .groupBy("word").agg(F.sum("toxic").cast("long").alias("t"), F.sum(1 - F.col("toxic")).cast("long").alias("c")))
    words = stash(words, "words")

    def weight(t, c):
        return F.log((t + 0.5) / (n_toxic + 1)) - F.log((c + 0.5) / (n_clean + 1))

    least = max(3, n_toxic // 200)
    terms = (words.where(f"t >= {least} AND t >= 3 * c AND length(word) >= 3").withColumn("w", weight(F.col("t"), F.col("c")))
             .where("w >= 2.5").collect())
    stems = (words.select("t", "c", F.explode(F.array(*[F.when(F.length("word") >= k, F.substring("word", 1, k)) for k in STEMS])).alias("stem"))
             .where("stem IS NOT NULL").groupBy("stem")
             .agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count(F.lit(1)).alias("n"))
             .where(f"n >= 3 AND t >= {2 * least + 1} AND t >= 20 * c").withColumn("w", weight(F.col("t"), F.col("c")))
             .where("w >= 2.5").collect())
    kept: dict[str, float] = {}
    for r in sorted(stems, key=lambda r: r.stem):  # in order, so a stem comes before its own extensions
        if not any(r.stem[:k] in kept for k in STEMS if k < len(r.stem)):
            kept[r.stem] = min(float(r.w), 8.0)
    return {r.word: min(float(r.w), 8.0) for r in terms}, kept


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A logistic curve in which no finding speaks against toxicity: negative weights are dropped one by one."""
    used = list(range(x.shape[1]))
    while True:
        w = logistic.fit(x[:, used], y)
        if not used or w[:-1].min() >= 0:
            out = np.zeros(x.shape[1] + 1)
            out[used], out[-1] = w[:-1], w[-1]
            return out
        used.pop(int(np.argmin(w[:-1])))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[dict, dict, np.ndarray]:
    """(terms, stems, curve) from the rows of `labels` (doc_id, toxic) that are not held out."""
    usable = (labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
              .where("id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("id")))
              .groupBy("id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("id"), "id").limit(max_train))
    texts = docs.select(docs["doc_id"].alias("id"), text_of(docs, "text"))
    sample = texts.join(F.broadcast(usable), "id").withColumn("half", F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(2)))
    sample = stash(sample, "sample")
    terms, stems = _lexicon(sample.where("half = 0").select("text", "toxic"))
    fitted = _features_of(sample.where("half = 1").select("toxic", "text"), terms, stems, "toxic int").collect()
    terms, stems = _lexicon(sample.select("text", "toxic"))
    x, y = np.array([r.features for r in fitted]), np.array([r.toxic for r in fitted], float)
    if not len(y) or y.min() == y.max() or not (terms or stems):
        share = float(y.mean()) if len(y) else 0.0
        share = min(max(share, 1e-4), 1 - 1e-4)
        return terms, stems, np.array([0, 0, 0, 0, np.log(share / (1 - share))])
    return terms, stems, _fit(x, y)


def _features_of(df: DataFrame, terms: dict, stems: dict, carried: str, curve: np.ndarray | None = None) -> DataFrame:
    """The first columns of `df`, and from its last, the text, the features, or the score if a curve is given."""
    model = df.sparkSession.sparkContext.broadcast((terms, stems))  # bounded by the sample, see _lexicon

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon_of(model)
        for batch in batches:
            x = features(lexicon, batch.column(batch.num_columns - 1))
            if curve is None:
                last = pa.array(list(x), pa.list_(pa.float64()))
            else:
                last = pa.array(logistic.predict(x, curve), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], last],
                                             names=[*batch.schema.names[:-1], "features" if curve is None else "score"])

    return map_batches(df, work, carried + (", features array<double>" if curve is None else ", score double"))


def held_out(doc_id) -> F.Column:
    """Whether the id's crc32 leaves 1 when divided by 3; such rows are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score(docs: DataFrame, model: tuple[dict, dict, np.ndarray], keep: list[str] | None = None) -> DataFrame:
    """The `keep` columns of `docs` (all by default) with `toxicity`, 0 to 1. Labels play no part."""
    keep = docs.columns if keep is None else keep
    terms, stems, curve = model
    carried = ", ".join(f"__{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    body = docs.select(*[docs[c].alias(f"__{i}") for i, c in enumerate(keep)], text_of(docs, "text", "__text"))
    scored = _features_of(body, terms, stems, carried, curve)
    return scored.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(keep)], F.col("score").alias("toxicity"))
