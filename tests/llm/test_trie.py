"""The prefix trie against a brute force over all prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from workloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, family=20, shares=4):
    """The contract, prefix by prefix."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[conv].append((turn is not None, turn or 0, role, digest, text))
    own = {c: [(r, t) for _, _, r, _, t in sorted(x)] for c, x in turns.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % shares
        built[c] = own.get(c - c % family, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    out = []
    for prefix, who in members.items():
        below = [p for p in members if p[:len(prefix)] == prefix]
        childless = {p for p in below if not any(len(q) == len(p) + 1 and q[:len(p)] == p for q in members)}
        saved = sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        ends = sorted(c for c in who if len(built[c]) == len(prefix))
        out.append((min(who), len(prefix), min(members[prefix[:-1]]) if prefix else None, len(who),
                    sum(len(p) == len(prefix) + 1 for p in below), len(childless), saved,
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0], r[1]))


def found(spark, rows, bound=trie.BOUND, schema=SCHEMA, **extra):
    df = spark.createDataFrame(rows, schema)
    for name, value in extra.items():
        df = df.withColumn(name, F.lit(value))
    return sorted((tuple(r) for r in trie.prefix_nodes(*trie.rebuilt(trie.numbered(df)), bound).collect()), key=lambda r: (r[0], r[1]))


def talks(seed=3, n=60, words=3):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(rng.randint(1, 6)):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", " ".join(rng.choice("ab") for _ in range(rng.randint(1, words)))))
    return rows


def test_nodes_equal_brute_force_inside_a_task(spark):
    rows = talks()
    assert found(spark, rows) == brute(rows)


def test_nodes_equal_brute_force_by_distributed_splits(spark):
    rows = talks(4, 30, 2) + [(7, 10 + i, "user", f"long {i % 3}") for i in range(60)] + [(8, 10 + i, "user", f"long {i % 3}") for i in range(45)]
    assert found(spark, rows, bound=40) == brute(rows)


def test_nulls_ties_repeats_and_clashing_names(spark):
    rows = [(1, None, None, None), (1, None, "user", "x  y\tz"), (1, 2, "user", None), (1, 2, "user", None), (1, 2, "bot", "é ü"),
            (21, 0, "user", ""), (21, 1, None, "q"), (20, 5, "user", "only"), (None, 1, "user", "nobody's"), (-3, 1, "a", "b"), (45, 1, "u", "z")]
    got = found(spark, rows, pos=1, rep="r", a=2.5, weight="w", one="x", digest="d")
    assert got == brute(rows)
    assert found(spark, rows * 2) == brute(rows * 2)


def test_turnless_conversations_are_members_of_the_root(spark):
    # 3, 10: h is 3 and 1 or more; their family's first is absent and they have one turn only.
    lone = [c for c in range(1, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3][:3]
    rows = [(c, 1, "user", "hello") for c in lone]
    got = found(spark, rows)
    assert got == brute(rows) == [(lone[0], 0, None, 3, 0, 1, 0, hashlib.sha256(",".join(map(str, lone)).encode()).hexdigest())]


def test_empty_table(spark):
    assert found(spark, []) == []


def test_decompose_sums_subtrees():
    rng = random.Random(1)
    for n in (1, 2, 50, 400):
        parent = [-1] + [rng.choice([v - 1, rng.randrange(v)]) for v in range(1, n)]
        values = [(rng.randint(0, 9), v) for v in range(n)]
        weight, want = [1] * n, [list(x) for x in values]
        for v in range(n - 1, 0, -1):
            weight[parent[v]] += weight[v]
            want[parent[v]] = [x + y for x, y in zip(want[parent[v]], want[v])]
        assert trie.decompose(parent, weight, values) == want


def test_ends_are_hashed_in_chunks(spark):
    members = spark.range(5_000).select((F.col("id") * 7 - 3).alias("conv_id"), F.lit(1).cast("bigint").alias("length"))
    paths = members.select("conv_id", F.col("length").alias("pos"), F.lit(-3).cast("bigint").alias("rep"), F.lit(None).cast("bigint").alias("parent_rep"))
    got = [tuple(r) for r in trie.end_hashes(members, paths).collect()]
    ids = ",".join(str(7 * i - 3) for i in range(5_000))
    assert got == [(-3, 1, hashlib.sha256(ids.encode()).hexdigest())]
