"""The operators of this subpackage as named queries over the test tables.

Where SQL can state a query it is in ORACLES; the others are tested against brute force.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from workloom.llm import (
    ann, decontaminate, html, impacts, near, packing, quality, suffixes, templates, toxicity, trie, urls, whitening,
)
from workloom.llm.frames import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    gone = templates.repeats(docs)
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"), "text")
    joined = keyed.join(gone, keyed["doc_id"].eqNullSafe(gone["id"]) & (keyed["digest"] == gone["digest"]), "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.coalesce(F.array_contains("dropped", i), F.lit(False))), "\n")
    return joined.select("doc_id", F.size(lines).cast("bigint").alias("n_lines"),
                         F.coalesce(F.size("dropped"), F.lit(0)).cast("bigint").alias("n_dropped"),
                         F.array_sort(F.coalesce("dropped", F.array().cast("array<int>"))).alias("dropped"),
                         F.sha2(kept, 256).alias("kept_sha256"))


def op3_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op4_suffix_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed",
                        F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")


def op5_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(table(spark, sf_dir, "pages"), keep=["page_id"])
    return judged.select("page_id", "judged.*")


def op6_pack_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.withColumnRenamed("id", "doc_id")


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near.classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_class",
                        F.col("id").eqNullSafe(F.col("class_id")).alias("stays"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                               keep=["doc_id"], into="found")
    c = F.col("found")
    return found.select("doc_id", c["n_words"].alias("n_words"), decontaminate.n_hit(c).alias("n_hit"),
                        F.size(c["items"]).cast("bigint").alias("n_items"),
                        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"),
                        decontaminate.is_contaminated(c).alias("contaminated"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"),
                         F.col("toxicity").alias("score"),
                         (F.col("toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op10_bayes_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))
    return scored.select(F.col("id").alias("doc_id"), F.col("host").alias("source"), F.col("path").alias("lang"), "evidence",
                         "host_rate", "path_rate", "quality", (F.col("quality") >= 0.5).cast("int").alias("predicted"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, members = trie.rebuilt(trie.numbered(table(spark, sf_dir, "conversations")))
    return trie.prefix_nodes(turns, members)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return impacts.top_inner_products(vectors, vectors.where("vec_id % 50 = 0"))


QUERIES = {q.__name__: q for q in (
    op1_text_blocks, op2_line_templates, op3_one_bit_codes, op4_suffix_runs, op5_link_trust, op6_pack_combinations,
    op7_order_minhash, op8_decontaminate, op9_toxicity, op10_bayes_quality, op11_prefix_trie,
    op12_whitening, op13_impact_topk)}

#: Models, components, alignments and packings are no SQL; those queries are tested against brute force.
ORACLES: dict[str, str] = {
    # The checksum goes bit by bit, prefixes are compared by a digest of all their turns, and sums over subtrees come
    # from pairs of a node and an ancestor.
    "op11_prefix_trie": """
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(
           concat(length(coalesce(role, ''))::varchar, ':', coalesce(role, ''), coalesce(text, '')))) AS pos,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, max(pos) AS own, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ord(x)::bigint)),
           lambda crc, x: list_reduce(list_prepend(xor(crc, x), list_transform(range(8), lambda i: i::bigint)),
             lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295::bigint) % 4 AS h
  FROM turns GROUP BY conv_id),
leads AS (
  SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.own, 0)) AS lead FROM convs c LEFT JOIN convs b ON b.conv_id = c.base),
built AS (
  SELECT l.conv_id, t.pos, t.role, t.text FROM leads l JOIN turns t ON t.conv_id = l.base AND t.pos <= l.lead
  UNION ALL
  SELECT l.conv_id, t.pos - l.h + l.lead, t.role, t.text FROM leads l JOIN turns t ON t.conv_id = l.conv_id AND t.pos > l.h),
walks AS (
  SELECT conv_id, pos, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
         md5(string_agg(concat(md5(role), md5(text)), '') OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS k
  FROM built
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
lengths AS (SELECT conv_id, max(pos) AS length FROM walks GROUP BY conv_id),
nodes AS (SELECT k, pos AS depth, min(conv_id) AS rep, count(*) AS n_convs, min(words) AS words FROM walks GROUP BY k, pos),
paths AS (SELECT w.conv_id, w.pos, n.rep FROM walks w JOIN nodes n ON n.k = w.k AND n.depth = w.pos),
parents AS (SELECT n.*, p.rep AS up FROM nodes n LEFT JOIN paths p ON p.conv_id = n.rep AND p.pos = n.depth - 1),
children AS (SELECT up, depth - 1 AS depth, count(*) AS n FROM parents WHERE depth > 0 GROUP BY ALL),
full_nodes AS (
  SELECT p.rep, p.depth, p.up, p.n_convs, coalesce(c.n, 0) AS n_children, (p.n_convs - 1) * p.words AS saved
  FROM parents p LEFT JOIN children c ON c.up = p.rep AND c.depth = p.depth),
sums AS (
  SELECT a.rep, a.pos AS depth, sum((f.n_children = 0)::bigint) AS n_leaves, sum(f.saved) AS saved_tokens
  FROM full_nodes f JOIN paths a ON a.conv_id = f.rep AND a.pos <= f.depth GROUP BY a.rep, a.pos),
ends AS (
  SELECT p.rep, p.pos AS depth, string_agg(l.conv_id::varchar, ',' ORDER BY l.conv_id) AS ids
  FROM lengths l JOIN paths p ON p.conv_id = l.conv_id AND p.pos = l.length GROUP BY p.rep, p.pos)
SELECT f.rep AS conv_id, f.depth::bigint AS depth, f.up AS parent_conv_id, f.n_convs, f.n_children::bigint AS n_children,
       s.n_leaves::bigint AS n_leaves, s.saved_tokens::bigint AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM full_nodes f JOIN sums s ON s.rep = f.rep AND s.depth = f.depth LEFT JOIN ends e ON e.rep = f.rep AND e.depth = f.depth""",
    "op13_impact_topk": """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0))), 0)::bigint AS score
  FROM usable q JOIN usable c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, r::integer AS rank, vec_id, score FROM ranked WHERE r <= 5""",
}
