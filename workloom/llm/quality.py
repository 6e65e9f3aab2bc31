"""Quality by hierarchical empirical Bayes: a document's own evidence, and the record of its path and host.

1. A logistic curve over shape features of the whole text gives each document's evidence. It is fitted on at
   most `max_train` labelled rows, those with the least hash of their id.
2. All labelled rows are counted per host and per path. A host's rate of good documents is shrunk towards the
   global rate, a path's rate towards its host's. How strongly is estimated from the counts themselves: the
   less the groups differ beyond chance, the more rows a group needs to leave its prior. A labelled row is judged by
   the counts without its own label.
3. log-odds of the score = log-odds of the document + log-odds of the path - log-odds of the global rate.

Hosts and paths are tables that Spark joins; nothing is collected but the bounded sample and a few sums.
Rows that are held out (see `toxicity.held_out`) are left out only if asked for. Null hosts and paths are groups
of their own. Null and empty texts have all features zero. Rows that repeat an id count its label each. Without labels every score is one half.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from workloom.llm import logistic
from workloom.llm.frames import map_batches, text_of
from workloom.llm.toxicity import held_out
from workloom.llm.words import Words, chunks, mix
from workloom.session import stash

MAX_TRAIN = 20_000
_CLASSES = np.zeros(256, np.int64)  # 1 lower-case letters and other scripts, 2 capitals, 3 digits, 4 space, 5 line ends, 6 other signs
_CLASSES[:] = 6
_CLASSES[ord("a"):ord("z") + 1] = 1
_CLASSES[0x80:] = 1
_CLASSES[ord("A"):ord("Z") + 1] = 2
_CLASSES[ord("0"):ord("9") + 1] = 3
_CLASSES[[9, 32]] = 4
_CLASSES[[10, 13]] = 5
N_FEATURES = 9


def features(column: pa.Array) -> np.ndarray:
    """Per text: shares of capitals, digits, signs and line ends, words' mean length, their variety, the share
    of words like the one before, signs per word, and length."""
    rows = []
    for _, data, offsets in chunks(column):
        words = Words(data, offsets)
        n_docs, counts = len(offsets) - 1, np.maximum(words.counts(), 1)
        kinds = _CLASSES[data]
        shares = np.zeros((n_docs, 7))
        for kind in (2, 3, 5, 6):
            total = np.concatenate([[0], np.cumsum(kinds == kind)])
            shares[:, kind] = np.diff(total[offsets])
        size = np.maximum(np.diff(offsets), 1)
        owner = np.repeat(np.arange(n_docs), words.counts())
        own = np.unique(mix(words.hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
        variety = np.bincount(owner[own], minlength=n_docs) / counts
        again = np.zeros(n_docs)
        if len(owner) > 1:
            same = (words.hashes[1:] == words.hashes[:-1]) & (owner[1:] == owner[:-1])
            again = np.bincount(owner[1:][same], minlength=n_docs) / counts
        length = np.bincount(owner, words.ends - words.starts, n_docs) / counts
        x = np.stack([shares[:, 2] / size, shares[:, 3] / size, shares[:, 6] / size, shares[:, 5] / size,
                      length / 10, variety, again, np.minimum(shares[:, 6] / counts, 5), np.log1p(words.counts()) / 10], 1)
        x[np.diff(offsets) == 0] = 0
        rows.append(x)
    return np.concatenate(rows) if rows else np.zeros((0, N_FEATURES))


def _with_text(df: DataFrame, schema: str, weights: np.ndarray | None) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(batch.num_columns - 1))
            last = pa.array(list(x), pa.list_(pa.float64())) if weights is None else pa.array(logistic.predict(x, weights))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], last], names=[*batch.schema.names[:-1], "made"])

    return map_batches(df, work, f"{schema}, made {'array<double>' if weights is None else 'double'}")


def _log_odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p) - F.log(1 - p)


def _strength(groups: DataFrame, prior: str) -> float:
    """How many rows the prior is worth, from (n, k, prior): the groups' spread beyond that of chance."""
    p = F.least(F.greatest(F.col(prior), F.lit(1e-6)), F.lit(1 - 1e-6))
    got = groups.agg(F.sum(F.col("n") * (F.col("k") / F.col("n") - p) ** 2 / (p * (1 - p))).alias("spread"),
                     F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows"),
                     F.sum(F.col("n") * F.col("n")).alias("squares")).first()
    if not got.rows:
        return 1.0
    room = got.rows - got.squares / got.rows - (got.groups - 1)
    alike = (got.spread - (got.groups - 1)) / room if room > 0 else 0.0
    alike = min(max(alike, 1e-4), 1 / 3)  # a prior is worth two rows at least
    return (1 - alike) / alike


def score(docs: DataFrame, labels: DataFrame, host: Column, path: Column, doc_id: str = "doc_id", text: str = "text",
          max_train: int = MAX_TRAIN, holding_out: bool = False) -> DataFrame:
    """One row per row of `docs`: id, host, path, evidence, host_rate, path_rate and quality, all 0 to 1. Fits when called.

    With `holding_out`, the labels of held-out rows are not used, so that they can measure the scores.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    sites = docs.select(docs[doc_id].alias("id"), host.cast("string").alias("host"), path.cast("string").alias("path"))
    marks = (labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("good"))
             .where("id IS NOT NULL AND good IN (0, 1)").where(F.lit(not holding_out) | ~held_out(F.col("id")))
             .groupBy("id").agg(F.min("good").alias("good")))
    chosen = F.broadcast(marks.orderBy(F.xxhash64("id"), "id").limit(max_train))
    sample = docs.select(docs[doc_id].alias("id"), text_of(docs, text)).join(chosen, "id").select("good", "text")
    rows = _with_text(sample, "good int", None).collect()
    x, y = np.array([r.made for r in rows]), np.array([r.good for r in rows], float)
    fitted = len(y) > 0 and y.min() < y.max()
    weights = logistic.fit(x, y) if fitted else np.zeros(N_FEATURES + 1)

    by_path = stash(sites.join(marks, "id").groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"), F.sum("good").alias("k")), "label-counts")
    total = by_path.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    rate = total.k / total.n if total.n else 0.5
    by_host = by_path.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    host_strength = _strength(by_host.withColumn("prior", F.lit(rate)), "prior")

    def shrunk(k, n, strength: float, prior):
        return (k + strength * prior) / (n + strength)

    hosts = by_host.select("host", shrunk(F.col("k"), F.col("n"), host_strength, F.lit(rate)).alias("host_rate"))
    nested = by_path.join(hosts.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of"))).drop("of")
    path_strength = _strength(nested, "host_rate")
    hosts, paths = (df.select(*[F.col(c).alias(f"{kind}_{c}") for c in df.columns]) for kind, df in (("h", by_host), ("p", by_path)))

    body = docs.select(docs[doc_id].alias("id"), host.cast("string").alias("host"), path.cast("string").alias("path"),
                       text_of(docs, text))
    own = _with_text(body, f"id {kind}, host string, path string", weights).withColumnRenamed("made", "evidence")
    joined = (own.join(paths, F.col("host").eqNullSafe(F.col("p_host")) & F.col("path").eqNullSafe(F.col("p_path")), "left")
              .join(hosts, F.col("host").eqNullSafe(F.col("h_host")), "left"))
    joined = joined.join(marks.withColumnRenamed("id", "m_id"), F.col("id") == F.col("m_id"), "left")
    # A row's own label is no evidence about it.
    counts = {f"{kind}_{c}": F.coalesce(f"{kind}_{c}", F.lit(0)) - own for kind in "hp"
              for c, own in (("n", F.col("good").isNotNull().cast("int")), ("k", F.coalesce("good", F.lit(0))))}
    joined = joined.withColumn("host_rate", shrunk(counts["h_k"], counts["h_n"], host_strength, F.lit(rate)))
    joined = joined.withColumn("path_rate", shrunk(counts["p_k"], counts["p_n"], path_strength, F.col("host_rate")))
    odds = _log_odds(F.col("evidence")) + _log_odds(F.col("path_rate")) - _log_odds(F.lit(rate))
    return joined.select("id", "host", "path", "evidence", "host_rate", "path_rate", (1 / (1 + F.exp(-odds))).alias("quality"))
