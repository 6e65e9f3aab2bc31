"""Decontamination, near-dedup, line templates and suffix dedup against brute force."""

import hashlib
import pickle
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from workloom.llm import decontaminate, near, suffixes, templates
from workloom.llm.words import Words, chunks

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
rng = random.Random(11)


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def word():
    return "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))


def prose(n):
    return " ".join(word() for _ in range(n))


def edited(text, share):
    return " ".join(word() if rng.random() < share else w for w in text.split(" "))


@pytest.mark.parametrize("block_bytes", [8 << 20, 300])
def test_decontamination(spark, block_bytes):
    items = [(i, prose(rng.choice([4, 13, 30]))) for i in range(30)] + [(3, "ONE two"), (4, "one two"), (5, None), (6, ""), (None, "only here now"), (10, "!!")]
    texts = [prose(50) + " " + items[i % 30][1].upper() + ". " + prose(rng.choice([5, 900])) for i in range(60)]
    texts += [None, "", "one, two", "One Two one two", "only here now", prose(20)]
    windows = {}
    for i, t in items:
        w = words_of(t)
        for k in range(max(0, len(w) - min(13, len(w)) + 1) if w else 0):
            windows.setdefault(tuple(w[k:k + 13]), set()).add(i)
    want = {}
    for d, t in enumerate(texts):
        w, hit, found = words_of(t), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if tuple(w[k:k + m]) in windows:
                    hit |= set(range(k, k + m))
                    found |= windows[tuple(w[k:k + m])]
        want[d] = len(w), len(hit), sorted(str(x) for x in found if x is not None), bool(hit) and 20 * len(hit) >= len(w)
    docs = spark.createDataFrame([(d, t, "x") for d, t in enumerate(texts)], "doc_id long, text string, runs string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    c = F.col("contamination")
    found = decontaminate.scan(docs, bench, block_bytes=block_bytes)
    got = {r.doc_id: (r.n, r.h, r.i, r.c) for r in found.select(
        "doc_id", c["n_words"].alias("n"), decontaminate.n_hit(c).alias("h"), c["items"].alias("i"), decontaminate.is_contaminated(c).alias("c")).collect()}
    assert got == want
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {d for d, x in want.items() if not x[3]}
    for r in decontaminate.without_spans(docs, bench).collect():
        assert len(words_of(r.text)) == want[r.doc_id][0] - want[r.doc_id][1]
    assert found.where(F.lit(False)).count() == 0
    assert decontaminate.scan(docs, bench.limit(0)).where(decontaminate.n_hit(c) > 0).count() == 0


def test_a_block_of_the_benchmark_stays_small():
    texts = [prose(400) for _ in range(600)] + ["the same thirteen words stand in each of these short items of the test set again"] * 3000
    size = sum(map(len, texts))
    windows = decontaminate._Windows(texts, 13)
    assert len(pickle.dumps(windows)) < 14 * size + (1 << 20)
    found = list(windows.find(Words(*next(chunks(pa.array([texts[3], texts[-1]])))[1:])))
    assert [f[2] for f in found[:388]] == [[3]] * 388 and [len(f[2]) for f in found[388:]] == [3000] * (len(found) - 388)
    assert len(found) == 388 + len(words_of(texts[-1])) - 12


def test_common_subsequence():
    for t in range(200):
        a = [rng.randrange(6) for _ in range(rng.randrange(1, 40))]
        b = [x for x in a if rng.random() < .8] if t % 2 else [rng.randrange(6) for _ in range(rng.randrange(1, 40))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        length = table[-1][-1]
        assert near.common_subsequence(a, b, 50) == length
        share = length / (len(a) + len(b) - length)
        got = near.similarity(np.array(a, np.uint64), np.array(b, np.uint64))
        assert got == pytest.approx(share if share >= .8 else 0)


def test_near_copies(spark):
    base = [prose(rng.randrange(1, 150)) for _ in range(40)]
    texts = base + [edited(t, .02) for t in base for _ in range(3)] + base[:5] + [base[3].upper() + "!"]
    texts += ["", "", None, "!!", "one", "One"] + [edited(base[7], .01) for _ in range(40)]
    rows: list[np.ndarray] = []
    for _, data, offsets in chunks(pa.array(texts, pa.string())):
        rows += near.shingles(Words(data, offsets))
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(rows[i]) and len(rows[j]) and near.similarity(rows[i], rows[j]) >= .8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    docs = spark.createDataFrame([(d, t, "x") for d, t in enumerate(texts)], "doc_id long, text string, label string").repartition(3)
    got = {r.id: r.class_id for r in near.classes(docs).collect()}
    assert got == {d: root(d) for d in range(len(texts))}
    kept = near.keep_one(docs.union(docs.where("doc_id = 2")))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({root(d) for d in range(len(texts))})
    assert near.classes(docs.limit(0)).count() == 0


def test_near_copies_in_large_buckets(spark):
    form, tails = prose(200), [prose(25) for _ in range(300)]
    texts = [f"{form} {t}" for t in tails] + [f"{form} {' '.join(t.split(' ')[:2])} {prose(23)}" for t in tails[:60]]
    rows: list[np.ndarray] = []
    for _, data, offsets in chunks(pa.array(texts, pa.string())):
        rows += near.shingles(Words(data, offsets))
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if near.similarity(rows[i], rows[j]) >= .8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert 200 < len({root(d) for d in range(len(texts))}) < 310
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.id: r.class_id for r in near.classes(docs).collect()} == {d: root(d) for d in range(len(texts))}


def test_rest_of_large_buckets_joins_prefixes_only(spark, monkeypatch):
    passage, made = prose(150), []
    texts = [f"{passage} {prose(50)}" for _ in range(240)]

    frame = type(spark.range(1))
    join = frame.join

    def counted(self, other, on=None, how=None):
        out = join(self, other, on, how)
        if on == "shingle":
            made.append(out.count())
        return out

    monkeypatch.setattr(frame, "join", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.id: r.class_id for r in near.classes(docs).collect()} == {d: d for d in range(240)}
    # Each holds 146 of the passage's shingles, too few of its 196 for a copy.
    assert made and sum(made) < 240 * 146 / 10


@pytest.mark.parametrize("slots", [1, 50, 1 << 21])
def test_rest_in_any_order_of_shingles(spark, monkeypatch, slots):
    form = prose(200)
    texts = [f"{form} {prose(25)}" for _ in range(100)]
    texts += [f"{form} {' '.join(t.split(' ')[200:202])} {prose(23)}" for t in texts[:30]] + [edited(form, .01) for _ in range(30)]
    rows: list[np.ndarray] = []
    for _, data, offsets in chunks(pa.array(texts, pa.string())):
        rows += [near._labelled(x) for x in near.shingles(Words(data, offsets))]
    alike = {(i, j) for j in range(len(rows)) for i in range(j) if near.similarity(rows[i], rows[j]) >= .8}
    assert len(alike) > 30
    monkeypatch.setattr(near, "SLOTS", slots)
    members = spark.createDataFrame([(i, i) for i in range(len(texts))], "node long, label long")
    bodies = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    pairs = {(r.a, r.b) for r in near._rest(members, bodies, near.SHINGLE, near.SIMILARITY).collect()}
    assert alike <= pairs


def test_rest_leaves_out_pairs_that_differ_too_much(spark):
    # Every fifth or so of 30 places holds one of two words, so rare shingles are shared but few texts are alike.
    form, other = prose(150).split(" "), prose(150).split(" ")
    texts = []
    for _ in range(150):
        at = set(random.sample(range(0, 150, 5), 6))
        texts.append(" ".join(other[i] if i in at else w for i, w in enumerate(form)))
    rows: list[np.ndarray] = []
    for _, data, offsets in chunks(pa.array(texts, pa.string())):
        rows += [near._labelled(x) for x in near.shingles(Words(data, offsets))]
    alike = {(i, j) for j in range(len(rows)) for i in range(j) if near.similarity(rows[i], rows[j]) >= .8}
    members = spark.createDataFrame([(i, i) for i in range(len(texts))], "node long, label long")
    bodies = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    pairs = {(r.a, r.b) for r in near._rest(members, bodies, near.SHINGLE, near.SIMILARITY).collect()}
    assert alike <= pairs
    assert len(pairs) < 150 * 149 / 2 / 10


def test_line_templates(spark):
    common = "All rights reserved by the owner"
    texts = [f"{prose(8)}\nUser {i} logged in from host 10.0.0.{i}\n{common}\nok then\n{prose(9)}" for i in range(6)]
    texts += [f"Order was sent to the {w} depot by rail" for w in ("north", "south", "east", "west")]
    texts += [common + "\n" + common, "", None, prose(12), "ok then\nok then"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, line string").repartition(3)
    got = {r.id: sorted(r.dropped) for r in templates.repeats(docs).collect()}
    assert got == {**{i: [1, 2] for i in range(1, 6)}, 7: [0], 8: [0], 9: [0], 10: [0, 1]}
    kept = templates.drop_repeated_lines(docs)
    assert kept.columns == docs.columns
    after = {r.doc_id: r.text for r in kept.collect()}
    assert after[0] == texts[0] and after[11] == "" and after[12] is None and after[10] == ""
    assert after[1].split("\n") == [texts[1].split("\n")[i] for i in (0, 3, 4)]
    assert templates.repeats(docs.limit(0)).count() == 0
    null_ids = spark.createDataFrame([(None, common)] * 3, "doc_id long, text string")
    assert [r.text for r in templates.drop_repeated_lines(null_ids).collect()] == [common] * 3


def test_lines_of_two_documents_and_of_few_tokens(spark):
    passage, link = prose(60), "https://example.org/a/"
    texts = [f"{prose(9)}\n{passage}", f"{passage}\n{prose(9)}", "Terms & Conditions\n版权所有，未经许可不得转载本文内容", "版权所有，未经许可不得转载本文内容\nTerms & Conditions",
             f"{link}1\n2026年12月1日的会议记录", f"{link}2\n2026年12月2日的会议记录", "12 345 67890 1234", "98 765 43210 9876"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.id: sorted(r.dropped) for r in templates.repeats(docs).collect()} == {1: [0], 3: [0, 1]}


def test_templates_of_a_mixed_leaf(spark):
    lead = "This page was last"
    texts = [f"{lead} edited by {word()}{chr(97 + i)} z on a quiet day in spring" for i in range(6)]
    texts += [f"{lead} seen from the {word()}{chr(97 + i)} station near our old town hall" for i in range(6)]
    texts += [f"{lead} {' '.join(f'{word()}{chr(97 + i % 26)}{chr(97 + i // 26)}{j}' for j in 'pqrstuvwxy')}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert len({len(t.split()) for t in texts}) == 1
    assert {r.id for r in templates.repeats(docs).collect()} == {*range(1, 6), *range(7, 12)}


def test_loser_tree():
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(30))) for _ in range(7)]

    def source(run):
        before = b""
        for x in run:
            yield suffixes.common_prefix(before, x), (x,)
            before = x

    out = list(suffixes.merge([source(r) for r in runs]))
    assert [x for _, (x,) in out] == sorted(x for r in runs for x in r)
    assert all(n == suffixes.common_prefix(a, b) for (_, (a,)), (n, (b,)) in zip(out, out[1:]))


@pytest.mark.parametrize("options", [{}, {"part_bytes": 20_000, "together": 3}, {"part_bytes": 60_000, "step": 16, "width": 100, "gram": 12}])
def test_suffix_dedup(spark, options):
    width = options.get("width", 400)
    base, passage = [prose(rng.randrange(1, 400)) for _ in range(20)], prose(110)
    texts = base + [edited(t, .01) for t in base] + base[:4] + ["", None, "x" * 399, "x" * 400, "y" * 401, "é" * 2000, "z" * 3000, "ab" * 900]
    texts += [prose(rng.randrange(60)) + " " + passage + " " + prose(rng.randrange(60)) for _ in range(70)]
    raw = [(t or "").encode() for t in texts]
    places = {}
    for d, t in enumerate(raw):
        for i in range(len(t) - width + 1):
            places.setdefault(t[i:i + width], []).append((d, i))
    covered = [np.zeros(len(t), bool) for t in raw]
    for found in places.values():
        if len(found) > 1:
            for d, i in found:
                covered[d][i:i + width] = True
    want = {}
    for d, (t, c) in enumerate(zip(raw, covered)):
        kept = bytes(np.frombuffer(t, np.uint8)[~c])
        spans = int((np.diff(np.concatenate([[0], c.astype(int)])) == 1).sum())
        want[d] = len(t), int(c.sum()), spans, hashlib.sha256(kept).hexdigest(), kept
    docs = spark.createDataFrame([(d, t, 1) for d, t in enumerate(texts)], "doc_id long, text string, k1 int").repartition(3)
    got = {r.id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256, bytes(r.kept))
           for r in suffixes.remove_repeats(docs, with_text=True, **options).collect()}
    assert got == want


def test_suffix_dedup_of_repeated_rows(spark):
    text = prose(120)
    docs = spark.createDataFrame([(1, text), (1, text), (None, "short"), (None, prose(90))], "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed) for r in suffixes.remove_repeats(docs).collect())
    assert [x for x in got if x[1]] == [(len(text), len(text))] * 2
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("tasks", [2, 211])
def test_suffix_dedup_of_equal_runs(spark, tasks):
    """Tasks whose runs are equal byte by byte: each holds the same texts, so everything repeats."""
    from workloom.llm.suffixes import _merge_rows, _run_rows, anchors

    texts = [prose(200).encode() for _ in range(3)]
    marks = [anchors(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    row = [(1, 2, t.decode(), *[x.tolist() for x in m[:3]]) for t, m in zip(texts, marks)]
    df = spark.createDataFrame(row, "k1 bigint, k2 bigint, text string, at array<int>, first array<int>, last array<int>").coalesce(1)
    copies = spark.range(tasks).repartitionByRange(tasks, "id").crossJoin(F.broadcast(df)).drop("id")
    runs = copies.mapInArrow(_run_rows([], 400, 128), "part int, run bigint, seq int, block binary")
    assert runs.select("run").distinct().count() == tasks
    dealt = runs.repartition(1, "part").sortWithinPartitions("part", "run", "seq")
    found = dealt.mapInArrow(_merge_rows(400, 128, 64), "e1 bigint, e2 bigint, low int, high int, s1 bigint, s2 bigint")
    alone = df.mapInArrow(_run_rows([], 400, 128), "part int, run bigint, seq int, block binary")
    want = len({(k.e1, k.e2) for k in df.mapInArrow(suffixes._place_rows(400, 128), "e1 bigint, e2 bigint, k1 bigint, k2 bigint, place bigint").collect()})
    assert alone.count() == 1
    judged = found.groupBy("e1", "e2").agg(F.max(F.when(F.col("s1").isNull(), F.lit(99)).otherwise(F.col("high"))).alias("times")).collect()
    assert len(judged) == want and all(r.times > 1 for r in judged)


def test_ranges_are_united(spark):
    rows = [(1, 5, 9), (1, 0, 0), (1, 1, 1), (1, 2, 2), (1, 8, 12), (1, 20, 21), (2, 3, 3)]
    df = spark.createDataFrame(rows, "k int, low int, high int")
    got = {r.k: [(x.low, x.high) for x in r.u] for r in df.groupBy("k").agg(
        suffixes._united(F.collect_set(F.struct("low", "high"))).alias("u")).collect()}
    assert got == {1: [(0, 2), (5, 12), (20, 21)], 2: [(3, 3)]}


def test_suffix_dedup_of_a_long_text(spark):
    """Longer than a slice; a passage stands at both of its ends."""
    passage = "".join(chr(97 + rng.randrange(26)) for _ in range(700))
    middle = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=5_000_000))
    docs = spark.createDataFrame([(1, passage + middle + passage), (2, "other")], "doc_id long, text string")
    got = {r.id: (r.n_bytes, r.n_removed, [(s.start, s.end) for s in r.spans]) for r in suffixes.remove_repeats(docs).collect()}
    end = 700 + len(middle)
    assert got == {1: (end + 700, 1_400, [(0, 700), (end, end + 700)]), 2: (5, 0, [])}


def test_a_task_of_lines_leaves_in_small_batches():
    import pyarrow as pa
    from workloom.llm.templates import _parsing
    text = "\n".join(f"the line of words number {'x' * 100} {i}" for i in range(100))
    batch = pa.RecordBatch.from_pydict({"id": list(range(1000)), "digest": list(range(1000)), "text": [text] * 1000})
    made = list(_parsing(4, 10)(iter([batch])))
    assert sum(b.num_rows for b in made) == 100_000
    assert max(b.nbytes for b in made) < 4 << 20


def test_a_lines_tokens_are_filtered_once_a_level(spark, monkeypatch):
    """The pattern of a line is made in one pass over its tokens, not with one filter for each place."""
    plans, write = {}, templates.stash

    def watched(df, label):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, label)

    monkeypatch.setattr(templates, "stash", watched)
    lead, body = "This page was last", " ".join(f"{word()}x" for _ in range(40))
    texts = [f"{lead} {chr(97 + i)}o {chr(97 + i)}p {body} {chr(97 + i)}q of it" for i in range(16)]
    texts += [f"{lead} {' '.join(f'{word()}{chr(97 + i % 26)}{chr(97 + i // 26)}{j}' for j in 'pqr' * 15)}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = templates.templates(write(templates.parsed_lines(docs), "lines")).where("pattern IS NOT NULL").collect()
    assert [r.pattern for r in found] == [f"{lead} <*> <*> {body} <*> of it"] * 16
    made = [x for x in plans["signatures"].splitlines() if "Project" in x and "transform(" in x]
    assert made and not any("filter(" in x for x in made)
