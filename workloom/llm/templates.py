"""Line dedup by a tree of log templates: fixed-depth parsing by token count and leading tokens.

A line is cut at white space. A token with a digit is a variable field, `<*>`, unless fewer than `min_chars`
characters of the line would stay: such a line counts by its own words. The line's leaf is its number
of tokens and its `depth` leading tokens. In a leaf, a place is constant if one token holds it in at least
`constant` of the leaf's different lines; if so many places are constant, the leaf is one template, in which
the others are variable fields, and the lines that agree with it belong to it. The other lines of a leaf are grouped
by what they share: for each power of two, a line's pattern holds the tokens that at least so many of the leaf's different
lines have at their places. Of the patterns with so many constant places that two or more of these lines have, a line
belongs to the one with the fewest; without any, it is a template of its own.

A template recurs if its lines stand in at least `min_docs` documents. Of a recurring template's lines the
first one stays (least doc_id, then least hash of the text, then line), all others are dropped. Lines of fewer
than `min_chars` characters besides white space are never dropped, as short lines recur by chance.

Lines are counted by hashes before anything else, so a line that very many documents share costs a row per
task. Null and empty texts stay as they are. Rows that repeat id and text count as documents, and keep the
same lines.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from workloom.llm.frames import free_name, map_batches, text_of
from workloom.session import stash

DEPTH, CONSTANT, MIN_DOCS, MIN_CHARS = 4, 0.6, 2, 10
VARIABLE = "<*>"
#: So many leaves are sent to every task; more are joined by shuffle, with the same result.
_BROADCAST_LEAVES = 500_000
#: Masked lines leave a task in batches of about so many characters.
_FLUSH_CHARS = 1 << 20
_DIGIT = re.compile(r"\d")


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)


def parse(line: str, min_chars: int = MIN_CHARS) -> list[str]:
    """The line's tokens; none if it has fewer than `min_chars` characters."""
    tokens = line.split()
    if sum(map(len, tokens)) < min_chars:
        return []
    if _DIGIT.search(line) and sum(len(t) for t in tokens if not _DIGIT.search(t)) >= min_chars:
        tokens = [VARIABLE if _DIGIT.search(t) else t for t in tokens]
    return tokens


def _parsing(depth: int, min_chars: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, leaves, lines, texts, numbers, fresh = [], [], [], [], [], []
            size = 0

            def flush() -> pa.RecordBatch:
                at = pa.array(rows, pa.int64())
                out = pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(numbers, pa.int32()),
                     pa.array(leaves, pa.int64()), pa.array(lines, pa.int64()), pa.array(fresh, pa.int32()),
                     pa.array(texts, pa.string())],
                    names=["id", "digest", "line_no", "leaf", "line", "fresh", "masked"])
                for x in (rows, leaves, lines, texts, numbers, fresh):
                    x.clear()
                return out

            for row, text in enumerate(batch.column(2)):
                seen = set()
                for number, line in enumerate(text.as_py().split("\n")):
                    tokens = parse(line, min_chars)
                    if not tokens:
                        continue
                    masked = " ".join(tokens)
                    key = _hash(masked)
                    rows.append(row)
                    numbers.append(number)
                    leaves.append(_hash(" ".join([str(len(tokens)), *tokens[:depth]])))
                    lines.append(key)
                    fresh.append(int(key not in seen))
                    seen.add(key)
                    texts.append(masked)
                    size += len(masked)
                if size > _FLUSH_CHARS:
                    size = 0
                    yield flush()
            if rows:
                yield flush()
    return work


def parsed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH,
                 min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per line that may be dropped: id, digest (a hash of the text), line_no, leaf and line (hashes),
    fresh (1 for a line's first place in its document) and the masked line."""
    kind = docs.schema[doc_id].dataType.simpleString()
    body = docs.select(docs[doc_id].alias("id"), F.xxhash64(text_of(docs, text)).alias("digest"), text_of(docs, text))
    return map_batches(body, _parsing(depth, min_chars),
                       f"id {kind}, digest bigint, line_no int, leaf bigint, line bigint, fresh int, masked string")


def templates(lines: DataFrame, constant: float = CONSTANT, min_docs: int = MIN_DOCS) -> DataFrame:
    """(leaf, line, template, pattern): the lines whose template may recur, from stashed `parsed_lines`."""
    spark = lines.sparkSession
    counted = stash(lines.groupBy("leaf", "line").agg(F.sum("fresh").alias("docs")), "line-counts")
    mixed = stash(counted.groupBy("leaf").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("docs").alias("docs"))
                  .where(f"n_lines > 1 AND docs >= {min_docs}").select("leaf", "n_lines"), "leaves")
    near = F.broadcast(mixed) if mixed.count() <= _BROADCAST_LEAVES else mixed
    different = stash(lines.join(near, "leaf").groupBy("leaf", "line").agg(
        F.first("masked").alias("masked"), F.first("n_lines").alias("n_lines")), "leaf-lines")
    split = different.select("leaf", "line", "n_lines", F.split("masked", " ").alias("tokens"))
    tokens = split.select("leaf", "n_lines", F.size("tokens").alias("n"), F.posexplode("tokens").alias("place", "token"))
    best = (tokens.groupBy("leaf", "n_lines", "n", "place", "token").agg(F.count(F.lit(1)).alias("held"))
            .groupBy("leaf", "n_lines", "n", "place").agg(F.max(F.struct("held", "token")).alias("best"))
            .where(F.col("best.held") >= constant * F.col("n_lines")))
    patterns = (best.groupBy("leaf", "n").agg(
        F.map_from_entries(F.collect_list(F.struct("place", "best.token"))).alias("fixed"))
        .where(F.size("fixed") >= constant * F.col("n"))
        .select("leaf", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.coalesce(
            F.element_at("fixed", i), F.lit(VARIABLE))).alias("pattern")))
    general = (split.join(patterns, "leaf")
               .where(F.forall(F.arrays_zip("tokens", "pattern"),
                               lambda x: (x["pattern"] == VARIABLE) | (x["pattern"] == x["tokens"])))
               .select("leaf", "line", F.col("leaf").alias("template"), F.array_join("pattern", " ").alias("pattern")))
    general = stash(general, "leaf-templates")
    rest = split.join(general.select("leaf", "line"), ["leaf", "line"], "left_anti")
    placed = rest.select("leaf", "line", F.size("tokens").alias("n"), F.posexplode("tokens").alias("place", "token"))
    often = stash(placed.groupBy("leaf", "place", "token").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "often")
    # A token counts at all powers of two up to the lines that hold it. As a plain table, so that a join can split a hot leaf.
    shared = placed.join(often, ["leaf", "place", "token"]).groupBy("leaf", "line", "n").agg(F.sort_array(F.collect_list(
        F.struct("place", "token", F.floor(F.log2("held")).cast("int").alias("power")))).alias("held"))
    # Few levels hold enough places; only theirs are made into patterns. `inline` makes `fixed` a column: inside a lambda it
    # would be filtered anew for every place.
    levels = F.transform(F.array_distinct("held.power"), lambda level: F.struct(
        level.alias("level"), F.filter("held", lambda x: x["power"] >= level).alias("fixed")))
    chosen = shared.select("leaf", "line", "n", F.inline(F.filter(levels, lambda x: F.size(x["fixed"]) >= constant * F.col("n"))))
    before = lambda i: F.coalesce(F.get("fixed", i - 1)["place"], F.lit(-1))
    signed = chosen.select("leaf", "line", "level", F.concat(
        F.array_join(F.transform("fixed", lambda x, i: F.concat(F.repeat(F.lit(VARIABLE + " "), x["place"] - before(i) - 1), x["token"])), " "),
        F.repeat(F.lit(" " + VARIABLE), F.col("n") - 1 - F.element_at("fixed", -1)["place"])).alias("pattern"))
    signed = stash(signed.withColumn("template", F.xxhash64("leaf", "pattern")), "signatures")
    several = stash(signed.groupBy("leaf", "template").agg(F.min("line").alias("low"), F.max("line").alias("high"))
                    .where("low <> high").select("leaf", "template"), "several-lines")
    grouped = (signed.join(several, ["leaf", "template"]).groupBy("leaf", "line")
               .agg(F.max(F.struct("level", "template", "pattern")).alias("best"))
               .select("leaf", "line", "best.template", "best.pattern"))
    general = general.unionByName(stash(grouped, "grouped-lines"))
    alone = counted.where(f"docs >= {min_docs}").join(general.select("leaf", "line"), ["leaf", "line"], "left_anti")
    return general.unionByName(alone.select("leaf", "line", F.col("line").alias("template"),
                                            F.lit(None).cast("string").alias("pattern")))


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH, constant: float = CONSTANT,
            min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, digest, dropped): the numbers of the lines to drop from each document that has any."""
    lines = stash(parsed_lines(docs, doc_id, text, depth, min_chars), "lines")
    named = templates(lines, constant, min_docs).select("leaf", "line", "template", F.col("pattern").isNotNull().alias("general"))
    places = stash(lines.drop("masked").join(named, ["leaf", "line"]), "places")
    place = F.struct(F.col("id").isNull().alias("last"), "id", "digest", "line_no")
    per_doc = places.groupBy("template", "general", "id", "digest").agg(
        F.min("line_no").alias("line_no"), F.max(F.col("fresh")).alias("one"), F.sum("fresh").alias("fresh"),
        F.count_distinct("line").alias("lines"))
    # A document's different lines of one template are one document; rows that repeat a document are several.
    recurring = (per_doc.groupBy("template", "general").agg(F.sum(F.col("fresh") / F.col("lines")).alias("docs"), F.min(place).alias("kept"))
                 .where(F.col("docs") > min_docs - 0.5).drop("docs"))
    recurring = stash(recurring, "recurring")  # a plain table: a join with it can split a hot template
    judged = places.join(recurring, ["template", "general"]).where(~place.eqNullSafe(F.col("kept")))
    return judged.groupBy("id", "digest").agg(F.collect_set("line_no").alias("dropped"))


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` without the lines of recurring templates. No row is dropped; a text may become empty."""
    gone = repeats(docs, doc_id, text, **options)
    digest, dropped = free_name(docs, "digest"), free_name(docs, "dropped")
    gone = gone.select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), F.col("dropped").alias(dropped))
    keyed = docs.withColumn(digest, F.xxhash64(text_of(docs, text)))
    joined = keyed.join(gone, keyed[doc_id].eqNullSafe(F.col("__id")) & (keyed[digest] == F.col("__digest")), "left")
    kept = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains(F.col(dropped), i)), "\n")
    return joined.withColumn(text, F.when(F.col(dropped).isNotNull(), kept).otherwise(F.col(text))).select(*docs.columns)
