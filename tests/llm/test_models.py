"""Toxicity, quality, HTML blocks, URL trust and nearest neighbours: rules by brute force, models by held-out accuracy."""

import html as decoder
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from workloom.llm import ann, html, quality, toxicity, urls

rng = random.Random(23)
DATA = "/root/testdata/sf0.1"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_automata_meet_the_trie():
    terms = ["idiot", "idiots", "scum", "trash", "loser"]
    trie = toxicity.Trie()
    for i, t in enumerate(terms):
        trie.add(t, 2.0 + i)
    trie.add("lowei", 9.0, True)
    words = terms + ["loweient", "lowei", "lowe", "", "x"]
    for t in terms * 30:
        w = list(t)
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(w) + 1)
            w[k:k + rng.randrange(2)] = rng.choice(["", "x", "i", "s"])
        words.append("".join(w))
    for w in words:
        exact = [2.0 + i for i, t in enumerate(terms) if t == w] + [9.0] * w.startswith("lowei")
        near = [toxicity.EDITED * (2.0 + i) for i, t in enumerate(terms) if distance(t, w) == 1]
        assert toxicity.match(trie, w) == max(exact + near, default=0)
        assert toxicity.match(trie, w, False) == max(exact, default=0)


def test_all_terms_are_met_with_edits_and_in_marks():
    terms = {"".join(rng.choice("klmnoprst") for _ in range(9)): 8.0 - i / 100 for i in range(400)}
    lexicon = toxicity.Lexicon({**terms, "дурак": 3.0}, {"проклят": 4.0})
    texts = [f"{t[:4]}x{t[4:]}" for t in terms] + ["“дурак”", "«дурак", "„дуракк“", "„проклятый", "»проклятые«", "дура"]
    for text in texts:
        for _, data, offsets in toxicity.chunks(pa.array([text], pa.string())):
            assert lexicon.weights(toxicity.Words(data, offsets))[1].tolist(), text


def test_quotation_counts_less():
    lexicon = toxicity.Lexicon({"idiot": 5.0, "scum": 5.0}, {})
    x = toxicity.features(lexicon, pa.array(["you idiot", 'he said "you idiot" to him', "he said “you idiot” to him", "you idioot", None, ""], pa.string()))
    assert x[0, 1] > x[3, 1] > x[1, 1] == x[2, 1] > x[4, 1] == x[5, 1] == 0


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs.withColumn("score", F.lit(1)), toxicity.train(docs, labels))
    assert scored.columns == [*docs.columns, "score", "toxicity"]
    rows = scored.join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).select("doc_id", "toxicity", "toxic").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    clean, toxic = [[r.toxicity >= .7 for r in rows if r.toxic == k] for k in (0, 1)]
    assert np.mean(clean) < .02 and np.mean(toxic) > .6


def test_toxicity_without_evidence(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, ""), (1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    scores = [r.toxicity for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()]
    assert len(scores) == 4 and len(set(scores)) == 1 and 0 <= scores[0] < .7
    assert toxicity.score(docs.limit(0), toxicity.train(docs, labels)).count() == 0


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score(docs, labels, F.col("source"), F.col("lang"))
    rows = (scored.join(labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("good")), "id")
            .where(toxicity.held_out(F.col("id"))).collect())
    assert np.mean([(r.quality >= .5) == (r.good == 1) for r in rows]) > .97
    assert all(0 <= x <= 1 for r in rows for x in (r.evidence, r.host_rate, r.path_rate))


def test_quality_shrinks_sparse_sites(spark):
    good = {"a": (400, 360), "b": (400, 80), "c": (1, 0)}
    docs = spark.createDataFrame([(f"{h}{i}", h, "p", "some words here", "x") for h, (n, _) in good.items() for i in range(n)]
                                 + [("n0", None, None, None, "x")], "doc_id string, site string, path string, text string, host string")
    labels = spark.createDataFrame([(f"{h}{i}", int(i < k)) for h, (n, k) in good.items() for i in range(n)], "doc_id string, quality int")
    rates = {r.host: r.host_rate for r in quality.score(docs, labels, F.col("site"), F.col("path")).select("host", "host_rate").distinct().collect()}
    assert abs(rates["a"] - .9) < .05 and abs(rates["b"] - .2) < .05 and .1 < rates["c"] < .6 and .4 < rates[None] < .7
    none = quality.score(docs, labels.limit(0), F.col("site"), F.col("path")).select("quality").distinct().collect()
    assert [r.quality for r in none] == [pytest.approx(.5)]


def test_quality_rates_equal_brute_force(spark):
    g = random.Random(9)
    leaning = {(h, p): g.random() for h in ("a", "b", None) for p in ("x", "y", None)}
    rows = [(i, "some words", *g.choices(list(leaning), [50, 9, 1, 5, 5, 5, 2, 1, 1])[0]) for i in range(300)] + [(7, "again", "b", "y")]
    marks = {i: int(g.random() < leaning[h, p]) for i, _, h, p in rows[:200]}
    docs = spark.createDataFrame(rows, "doc_id long, text string, site string, path string")
    labels = spark.createDataFrame(list(marks.items()), "doc_id long, quality int")
    got = [(r.id, r.host, r.path, r.host_rate, r.path_rate) for r in quality.score(docs, labels, F.col("site"), F.col("path")).collect()]

    def counts(key):
        found = {}
        for r in rows:
            if r[0] in marks:
                n, k = found.get(key(r), (0, 0))
                found[key(r)] = n + 1, k + marks[r[0]]
        return found

    def strength(groups):  # (n, k, prior)
        total = sum(n for n, _, _ in groups)
        room = total - sum(n * n for n, _, _ in groups) / total - (len(groups) - 1)
        alike = (sum(n * (k / n - p) ** 2 / (p * (1 - p)) for n, k, p in groups) - (len(groups) - 1)) / room
        alike = min(max(alike, 1e-4), 1 / 3)
        return (1 - alike) / alike

    by_host, by_path = counts(lambda r: r[2]), counts(lambda r: r[2:])
    n_all, k_all = map(sum, zip(*by_host.values()))
    rate = k_all / n_all
    hs = strength([(n, k, rate) for n, k in by_host.values()])
    ps = strength([(n, k, (by_host[h][1] + hs * rate) / (by_host[h][0] + hs)) for (h, p), (n, k) in by_path.items()])
    want = []
    for i, _, h, p in rows:
        (hn, hk), (pn, pk), own = by_host.get(h, (0, 0)), by_path.get((h, p), (0, 0)), (i in marks, marks.get(i, 0))
        host_rate = (hk - own[1] + hs * rate) / (hn - own[0] + hs)
        want.append((i, h, p, host_rate, (pk - own[1] + ps * host_rate) / (pn - own[0] + ps)))
    key = lambda r: (r[0], str(r[1]), str(r[2]))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:])


def test_quality_counts_all_labels_unless_held_out(spark):
    docs = spark.createDataFrame([(i, "some words here", f"h{i % 2}", "p") for i in range(200)], "doc_id long, text string, site string, path string")
    held = docs.where(toxicity.held_out(F.col("doc_id"))).select("doc_id", (F.col("site") == "h0").cast("int").alias("quality"))
    rates = [{r.host: r.host_rate for r in quality.score(docs, held, F.col("site"), F.col("path"), holding_out=x).collect()} for x in (False, True)]
    assert rates[0]["h0"] > .8 > .2 > rates[0]["h1"] and rates[1] == {"h0": .5, "h1": .5}


def plain_article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = (" ".join(decoder.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(b for b in blocks if b)


def test_main_text_of_all_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    for r in html.extract(pages.withColumn("text", F.lit("x")), keep=["html"]).collect():
        assert r.text == plain_article(r.html)


def test_labelled_table_is_learned():
    tree = html.train()
    for page, labels in html.LABELLED:
        assert "".join(str(int(v >= .5)) for v in html.decide(tree, html.features(html.blocks(page)))) == labels


def test_odd_pages(spark):
    long = " ".join(["many words of a plain sentence"] * 8)
    cases = [
        (None, ""), ("", ""), ("<p></p>", ""), ("<!-- never closed", ""), ("<script>x</script", ""),
        (f"<article><p>a &lt; b&nbsp;&amp;  c<br>d <b>e</b>f</p>\n<P CLASS='x'>1 < 2</article>", "a < b & c d ef\n1 < 2"),
        (f"<article><h1>T</h1><div class='ad-slot'><p>{long}</p></div><p>Hm.</p><aside>{long}</aside><p class=notice>{long}</p>ok"
         f"<ol id=comments><li>{long}</li></ol></article><form>{long}</form>", "T\nHm.\nok"),
        (f"<header>{long}</header><main><p>{long}</p></main><div class=sidebar>{long}</div><footer>{long}</footer>", long),
        (f"<div hidden>{long}</div><article><style>p</style><p>x</p><!-- <p>no</p> --><textarea>no</textarea></article>", "x"),
        ("<article>" + "<p>w</p>" * 30_000 + "</article>", "\n".join(["w"] * 30_000)),
    ]
    pages = spark.createDataFrame([(i, h, 0) for i, (h, _) in enumerate(cases)], "page_id long, html string, text int")
    assert {r.page_id: r.text for r in html.extract(pages).collect()} == {i: t for i, (_, t) in enumerate(cases)}
    assert html.extract(pages).columns == ["page_id", "html", "text"] and html.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("page", [
    '<div class="x' * 80_000, '<a ">"' * 160_000, '<div class="x' * 80_000 + ">", "<a '>\"" * 150_000, "<" * 1_000_000, "<!-" * 300_000,
    "<p>" + "<div>" * 100_000 + "</section>" * 60_000, "<script" * 140_000, "</script <svg>" * 70_000, "<a b='" * 150_000 + '">'])
def test_a_page_is_scanned_once(page):
    start = time.process_time()
    html.blocks(page)
    assert time.process_time() - start < 6


TAGS = re.compile(  # the same tags by a pattern that may follow quotation marks again and again
    r"<!--.*?(?:-->|\Z)|<(RAW)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?:(?<=/)>|>.*?(?:</\1\s*>|\Z))"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z][^>]*>|<[!?/][^>]*>".replace("RAW", html._RAW), re.S | re.I)


def test_tags_equal_those_of_a_pattern():
    g = random.Random(8)
    pieces = ["<p>", "</p>", "<a href=", '"', "'", ">", "<", "/>", "<!--", "-->", "<script>", "</script >", "<SVG", "</svg>", "text ", "<br/>", "<!doctype", "</", "<1", "?", "="]
    for _ in range(20_000):
        page = "".join(g.choices(pieces, k=g.randrange(1, 14)))
        want = [(*m.span(), m[2] or "", (m[3] or "").lower(), m[4] or "") for m in TAGS.finditer(page)]
        assert list(html._tags(page)) == want, page


def judged(url):
    at = (url or "").find("://")
    host = path = ""
    if at >= 0:
        rest = url[at + 3:]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *max(fits, key=lambda x: len(x[0]), default=(None, None))


def test_url_rules(spark):
    given = [None, "", "x.net/", "http://x.net", "http://X.NET/", "http://example.net/en/a?b#c", "https://a.b.example.net/en", "ftp://example.com/de/",
             "http://notexample.com/de/", "http://o.org/fr/x", "http://org/fr/", "a://b://c.net/", "http://h.net?x/", "http://é.Example.com#/de/", "\n://k.net/\n"]
    pages = spark.createDataFrame([(i, u, None, 1) for i, u in enumerate(given)], "page_id long, url string, html string, host int")
    for r in urls.judge(pages).collect():
        host, path, rule, verdict = judged(r.url)
        assert (r.judged.host, r.judged.path, r.judged.rule) == (host, path, rule) and r.judged.verdict == (verdict or "allow"), r
    assert urls.judge(pages).columns == ["page_id", "url", "html", "host", "judged"] and urls.judge(pages.limit(0)).count() == 0


def test_trust_spreads_along_links_and_distrust_against_them(spark):
    links = {"good.org": ["friend.com", "friend.com/x"], "friend.com": ["far.com"], "bad.net": ["victim.com"], "fan.com": ["bad.net", "bad.net/2"],
             "mixed.com": ["bad.net", "good.org"], "alone.com": [], "lost.com": ["unseen.net"],
             "ring1.com": ["ring2.com"], "ring2.com": ["ring1.com"]}
    rows = [(h, f"http://{h}/{'fr/' if h == 'good.org' else ''}", "".join(f'<a class=x href="http://{t}">t</a>' for t in to)) for h, to in links.items()]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = {r.page_id: r.judged for r in urls.judge(pages).collect()}
    edges = {}
    for h, to in links.items():
        for t in to:
            edges[h, t.split("/")[0]] = edges.get((h, t.split("/")[0]), 0) + 1

    back = {(b, a): w for (a, b), w in edges.items()}
    everyone = {h for e in edges for h in e}

    def walk(edges, seeds):
        rank = dict.fromkeys(seeds, 1.0)
        for _ in range(urls.ROUNDS):
            got = {}
            for (a, b), w in edges.items():
                got[b] = got.get(b, 0) + urls.DAMPING * rank.get(a, 0) * w / sum(v for (s, _), v in edges.items() if s == a)
            rank = {h: got.get(h, 0) + (h in seeds) for h in {*got, *seeds}}
        return rank, got

    (trust, good), (distrust, bad) = walk(edges, {"good.org"}), walk(back, {"bad.net", "unseen.net"})
    forward, backward = walk(edges, everyone)[1], walk(back, everyone)[1]
    for h, j in got.items():
        assert j.trust == pytest.approx(trust.get(h, 0)) and j.distrust == pytest.approx(distrust.get(h, 0))
        shares = good.get(h, 0) / forward[h] if forward.get(h) else 0, bad.get(h, 0) / backward[h] if backward.get(h) else 0
        assert (j.trust_share, j.distrust_share) == pytest.approx(shares) and 0 <= min(shares) and max(shares) <= 1
        if not j.rule:
            assert j.verdict == ("block" if j.distrust_share - j.trust_share > .5 else "allow")
    assert got["fan.com"].verdict == got["lost.com"].verdict == "block"
    assert got["friend.com"].verdict == got["alone.com"].verdict == got["ring1.com"].verdict == "allow"


def test_all_linkers_of_a_blocked_host_are_blocked(spark):
    links = {f"fan{i}.com": ["bad.net"] for i in range(10_000)} | {"half.com": ["bad.net", "other.com"], "bad.net": [], "other.com": []}
    rows = [(h, f"http://{h}/", "".join(f'<a href="http://{t}">t</a>' for t in to)) for h, to in links.items()]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = {r.page_id: r.judged.verdict for r in urls.judge(pages).collect()}
    assert got == {h: "block" if h == "bad.net" or h.startswith("fan") else "allow" for h in links}


def test_nearest(spark):
    g = np.random.default_rng(3)
    centres = g.standard_normal((20, 24))
    x = (centres[g.integers(0, 20, 1500)] + .6 * g.standard_normal((1500, 24))).astype(np.float32)
    x[1000:1300] = x[1000]  # many copies
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 24, 0), (2003, [float("nan")] * 24, 0),
                                                          (2100, [None] * 24, 0), (2200, [1.0, 2.0], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, slot int").repartition(3)
    got = ann.nearest(vectors, vectors.where("vec_id % 100 = 0"), block=256, query_block=4).collect()
    hits = total = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(d)), d))[:10].tolist()
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r[0] for r in own] == list(range(1, 11)) and all(s == pytest.approx(d[i], abs=1e-12) for _, i, s in own)
        assert [r[1:][::-1] for r in own] == sorted(r[1:][::-1] for r in own)
        hits += len({r[1] for r in own} & set(want))
        total += 10
        if q in range(1000, 1300):
            assert [r[1] for r in own] == want
    assert len(got) == total and hits >= .95 * total
    assert ann.nearest(vectors.limit(0), vectors).count() == 0
    few = ann.nearest(vectors.where("vec_id < 3"), vectors.where("vec_id = 0")).collect()
    assert [r.rank for r in few] == [1, 2]


def test_error_bounds():
    g = np.random.default_rng(4)
    x = g.standard_normal((3000, 32))
    centre, turn = x.mean(0), ann.rotation(32)
    assert np.allclose(turn @ turn.T, np.eye(32))
    codes = ann.Codes(x, centre, turn)
    missed = []
    for q in g.standard_normal((20, 32)):
        estimate, less = codes.estimates(q, centre, turn)
        missed.append((((x - q) ** 2).sum(1) < estimate - less).mean())
    assert np.mean(missed) < .03
