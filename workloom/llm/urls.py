"""URL filters: rules first, then trust and distrust that spread over links between hosts.

Rules name a host, with all its subdomains, and the beginning of a path; the longest rule that fits decides.
Every other url is judged by its host. A host is a seed of trust by the share of its urls that rules allow,
and personalised PageRank carries trust along links. It is a seed of distrust by the share that rules
block, and the same walk carries distrust against the links: who links to a bad host is suspect. A host that is
only linked to counts by the rule of its root. Ranks split over all neighbours of a host, so they shrink and grow with
the graph. Each is therefore taken against the plain PageRank of the same direction, which starts at every host: the
share of what a host receives there that comes from seeds, 0 to 1 (relative mass). A host is blocked if its share of
distrust exceeds its share of trust by more than `most`; a host that neither reaches is allowed.

Links are counted per pair of hosts before anything else, so a host with very many pages or links costs each
task a row per pair. Ranks are Spark tables, written to the shared folder in each round. Links within a host
carry nothing. Null urls, and urls without `://`, have an empty host and path and are allowed unless a rule fits
(none can). Pages that repeat are judged alike; their links count each time.
"""

from pyspark.sql import Column, DataFrame, functions as F

from workloom.session import stash

#: In so many rounds the walk comes as close as CLOSE at this damping, as 0.85 ** 200 < 1e-14.
DAMPING, ROUNDS, CLOSE, MOST = 0.85, 200, 1e-9, 0.5
#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*["']?\s*([^"'\s>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null. For rule lists of a size to write by hand."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # later ones win
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, weight): links between different hosts, from the anchors of all pages."""
    links = pages.select(host_of(F.col(url)).alias("src"), F.explode(
        F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(_HREF), 1))).alias("link"))
    link = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))
    return (links.where("link LIKE '%//%'").select("src", host_of(link).alias("dst"))
            .where("src <> '' AND dst <> '' AND src <> dst")
            .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight")))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, close: float = CLOSE) -> DataFrame:
    """(kind, host, rank, received): personalised PageRank over edges (kind, src, dst, weight) from seeds (kind, host, share).

    `received` is the rank without the host's own share as a seed; a seed that nobody links to has its share as rank.
    Ends when the ranks of each kind change by less than `close` of their sum, or after `rounds`.
    """
    out = edges.groupBy("kind", "src").agg(F.sum("weight").alias("out"))
    edges = stash(edges.join(stash(out, "edge-sums"), ["kind", "src"]).select(
        "kind", F.col("src").alias("host"), "dst", (damping * F.col("weight") / F.col("out")).alias("flow")), "edges")
    restart = stash(seeds.select("kind", "host", F.col("share").alias("rank"), F.lit(0.0).alias("received")), "restart")
    ranks = restart
    for _ in range(rounds):
        moved = edges.join(ranks, ["kind", "host"]).select(
            "kind", F.col("dst").alias("host"), (F.col("flow") * F.col("rank")).alias("rank"), (F.col("flow") * F.col("rank")).alias("received"))
        new = stash(restart.unionByName(moved).groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("received").alias("received")), "ranks")
        both = new.select("kind", "host", "rank", F.col("rank").alias("d")).unionByName(
            ranks.select("kind", "host", F.lit(0.0).alias("rank"), (-F.col("rank")).alias("d")))
        changed = both.groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("d").alias("d")).groupBy("kind").agg(
            F.sum("rank").alias("rank"), F.sum(F.abs("d")).alias("d"))
        ranks = new
        if not changed.where(F.col("d") > close * F.col("rank")).limit(1).count():
            break
    return ranks


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, url: str = "url", html: str = "html",
          keep: list[str] | None = None, most: float = MOST, **walk) -> DataFrame:
    """The `keep` columns (all by default), with one struct `judged`: host, path, rule, verdict, trust, distrust, and
    trust_share and distrust_share, which decide where no rule does.

    Runs the walk when called.
    """
    keep = pages.columns if keep is None else keep
    bare = pages.select(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"),
                        *[pages[c].alias(f"__{i}") for i, c in enumerate(keep)])
    ruled = bare.withColumn("ruled", rule_of(F.col("host"), F.col("path"), rules))
    edges = stash(host_edges(pages, url, html), "host-edges")
    linked = edges.select(F.col("src").alias("host")).union(edges.select("dst")).distinct()

    def share(verdict: str):
        return F.avg(F.when(F.col("ruled.verdict") == verdict, 1.0).otherwise(0.0))

    own = ruled.groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    root = rule_of(F.col("host"), F.lit("/"), rules)["verdict"]
    hosts = linked.join(own, "host", "full").select("host", *[
        F.coalesce(k, F.when(root == v, 1.0).otherwise(0.0)).alias(k) for k, v in (("trust", "allow"), ("distrust", "block"))])
    seeds = hosts.select("host", F.explode(F.create_map(
        F.lit("trust"), "trust", F.lit("distrust"), "distrust", F.lit("forward"), F.lit(1.0), F.lit("backward"), F.lit(1.0)
    )).alias("kind", "share")).where("share > 0 AND host <> ''")
    ways = edges.select(F.explode(F.array(
        *[F.struct(F.lit(k).alias("kind"), F.col("src").alias("src"), F.col("dst").alias("dst"), "weight") for k in ("trust", "forward")],
        *[F.struct(F.lit(k).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight") for k in ("distrust", "backward")],
    )).alias("way")).select("way.*")
    ranks = spread(ways, seeds, **walk)

    def of(kind: str, column: str):
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(column))), F.lit(0.0))

    ranks = ranks.groupBy("host").agg(
        of("trust", "rank").alias("trust"), of("distrust", "rank").alias("distrust"),
        F.coalesce(F.try_divide(of("trust", "received"), of("forward", "received")), F.lit(0.0)).alias("trust_share"),
        F.coalesce(F.try_divide(of("distrust", "received"), of("backward", "received")), F.lit(0.0)).alias("distrust_share"))
    joined = ruled.join(ranks, "host", "left")
    found = {k: F.coalesce(k, F.lit(0.0)) for k in ("trust", "distrust", "trust_share", "distrust_share")}
    verdict = F.coalesce(F.col("ruled.verdict"), F.when(found["distrust_share"] - found["trust_share"] > most, "block").otherwise("allow"))
    return joined.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(keep)], F.struct(
        "host", "path", F.col("ruled.rule").alias("rule"), verdict.alias("verdict"), *[v.alias(k) for k, v in found.items()]).alias("judged"))
