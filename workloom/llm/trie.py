"""Prefix trie of conversations, rolled up by centroid decomposition of its parent edges.

1. Turns are numbered inside their conversation, and each prefix gets a name: the sum, in four parts of 32 bits, of 128
   bits hashed from each of its turns with the turn's place. Both are running sums over chained ranges, so a conversation
   of any length is spread over as many tasks as it needs. Prefixes of one name are one node.
2. A node is then called (rep, depth): its smallest member and the number of its turns. `paths` maps every
   (conversation, depth) to its node, so any node's ancestor at any depth is one equi-join away.
3. Roll-up. A node's weight is the number of (member, turn) pairs below it and at it; in the whole trie it is counted
   directly, without any roll-up. In a component with top t, the nodes with more than half of t's weight form one path
   from t; the deepest is the centroid c. Taking c out leaves its children's components and the part above it, each with
   at most half the weight. What lies at and below c in the component is added up, and the total is added to all nodes
   from c up to t: these are the nodes of c's own conversation between the two depths. c's weight is taken off the
   nodes above it, and the parts go on by themselves. Depth never matters, only the logarithm of the weight.
4. Components of at most `bound` weight are finished by the same recursion inside a task, many at a time.
5. The members that end at a node are joined to one text by range-sorted chunks, which one pass hashes as a stream.

Turns are ordered by `turn`, null first, ties by role and then by the text's digest; repeated rows are turns each. Null
roles and texts are empty. Rows without a conversation id take no part. An empty table gives no nodes. A conversation
without turns is a member of the root. Texts of any length pass through Spark's own functions only. Other columns
of the table, whatever their names, are not read.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from workloom.functions.chain import chained
from workloom.llm.frames import map_batches, text_of
from workloom.session import stash

#: Components of at most this weight are finished in one task.
BOUND = 4_096
_CHUNK = 8_192
_LOW = 0xFFFFFFFF
_WORD = r"[^\x20\x09-\x0D]+"
_NODE = ("conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
         "saved_tokens bigint, ends_sha256 string")


def numbered(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
             text: str = "text") -> DataFrame:
    """(conv_id, pos, digest, words): every turn, its place from 1, a digest of role and text, and its text's words."""
    rows = conversations.where(conversations[conv_id].isNotNull()).select(
        conversations[conv_id].cast("bigint").alias("conv_id"), conversations[turn].alias("turn"),
        text_of(conversations, role, "role"), text_of(conversations, text, "body"))
    rows = rows.select("conv_id", "turn", "role", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "body")).alias("digest"),
                       F.regexp_count("body", F.lit(_WORD)).cast("bigint").alias("words"), F.lit(1).cast("bigint").alias("one"))
    return chained(rows, ["conv_id"], ["turn", "role", "digest"], sums={"pos": "one"}).select("conv_id", "pos", "digest", "words")


def rebuilt(turns: DataFrame, family: int = 20, shares: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first h turns of their family's first, and go on with their own after h.

    The family's first is c - c % `family`, h is crc32 of c's decimal text modulo `shares`. Returns the turns, as
    `numbered` gives them, and (conv_id, length) of every conversation.
    """
    turns = stash(turns, "turns")
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("own"))
    c = F.col("conv_id")
    firsts = sizes.select(c.alias("base"), F.col("own").alias("base_own"))
    members = sizes.select(c, "own", (c - c % family).alias("base"), (F.crc32(c.cast("string")) % shares).alias("h"))
    members = members.join(firsts, "base", "left").withColumn("lead", F.least("h", F.coalesce("base_own", F.lit(0)))).select(
        "conv_id", "base", "h", "lead", (F.col("lead") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))
    members = stash(members, "members")
    after = turns.join(members.select("conv_id", "h", "lead"), "conv_id").where("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("lead")).alias("pos"), "digest", "words")
    opening = turns.where(F.col("pos") < shares).select(c.alias("base"), "pos", "digest", "words")
    before = members.where("lead > 0").select("conv_id", "base", F.explode(F.sequence(F.lit(1).cast("bigint"), "lead")).alias("pos"))
    before = before.join(opening, ["base", "pos"]).select("conv_id", "pos", "digest", "words")
    return after.unionByName(before), members.select("conv_id", "length")


def _halves(value: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(value, 32), value.bitwiseAND(F.lit(_LOW))


def _name(high: Column, low: Column) -> Column:
    return F.shiftleft(high.bitwiseAND(F.lit(_LOW)), 32).bitwiseOR(low.bitwiseAND(F.lit(_LOW)))


def trie(turns: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(nodes, paths) of conversations given as `rebuilt` returns them; None when there are none.

    nodes: rep, depth, parent_rep, n_convs, n_children, words (of the last turn) and weight. paths: conv_id, pos from 0,
    and the node there as rep with its parent's parent_rep.
    """
    members = stash(members, "members")
    root = members.agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.sum(F.col("length") + 1).alias("weight")).first()
    if not root.n:
        return None
    hashed = turns.select("conv_id", "pos", "words", *[F.xxhash64(F.lit(i), "pos", "digest").alias(f"h{i}") for i in (1, 2)])
    parts = {f"e{j}": half for i in (0, 1) for j, half in zip((2 * i, 2 * i + 1), _halves(F.col(f"h{i + 1}")))}
    summed = chained(hashed.withColumns(parts).drop("h1", "h2"), ["conv_id"], ["pos"], sums={f"s{j}": f"e{j}" for j in range(4)})
    s, e = [F.col(f"s{j}") for j in range(4)], [F.col(f"e{j}") for j in range(4)]
    keyed = summed.join(members, "conv_id").select(
        "conv_id", "pos", "words", "length", _name(s[0], s[1]).alias("a"), _name(s[2], s[3]).alias("b"),
        _name(s[0] - e[0], s[1] - e[1]).alias("up_a"), _name(s[2] - e[2], s[3] - e[3]).alias("up_b"))
    keyed = stash(keyed, "prefixes")
    found = stash(keyed.groupBy("a", "b").agg(
        F.min("conv_id").alias("rep"), F.min("pos").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"),
        F.sum(F.col("length") - F.col("pos") + 1).alias("weight"), F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b")), "nodes")
    children = found.groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = found.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("rep").alias("parent_rep"))
    nodes = (found.join(children, ["a", "b"], "left").join(parents, ["up_a", "up_b"], "left")
             .withColumn("parent_rep", F.when(F.col("depth") == 1, F.lit(root.rep)).otherwise(F.col("parent_rep")))
             .select("rep", "depth", "parent_rep", "n_convs", F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
                     "words", "weight", "a", "b"))
    nodes = stash(nodes, "nodes")
    first_turns = nodes.where("depth = 1").count()
    top = turns.sparkSession.createDataFrame([(root.rep, 0, None, root.n, first_turns, 0, root.weight)],
                                             "rep bigint, depth bigint, parent_rep bigint, n_convs bigint, n_children bigint, words bigint, weight bigint")
    paths = stash(keyed.select("conv_id", "pos", "a", "b").join(nodes.select("a", "b", "rep", "parent_rep"), ["a", "b"])
                  .select("conv_id", "pos", "rep", "parent_rep")
                  .unionByName(members.select("conv_id", F.lit(0).cast("bigint").alias("pos"), F.lit(root.rep).alias("rep"),
                                              F.lit(None).cast("bigint").alias("parent_rep"))), "paths")
    return nodes.drop("a", "b").unionByName(top), paths


def decompose(parent: list[int], weight: list[int], values: list[tuple]) -> list[list]:
    """Sums of `values` over the subtrees of a small forest by centroid decomposition; tops have parent -1.

    `weight` is each node's subtree weight, all weights positive; it is used up.
    """
    n, width = len(parent), len(values[0]) if values else 0
    children: list[list[int]] = [[] for _ in range(n)]
    for v, up in enumerate(parent):
        if up >= 0:
            children[up].append(v)
    gone = [False] * n
    pieces: list[list] = []  # [path from the centroid to the top, pieces below, piece above]
    waiting = [(v, None) for v in range(n) if parent[v] < 0]
    while waiting:
        top, owner = waiting.pop()
        half, c = weight[top] / 2, top
        while True:
            heavy = next((u for u in children[c] if not gone[u] and weight[u] > half), -1)
            if heavy < 0:
                break
            c = heavy
        path, u = [c], c
        while u != top:
            u = parent[u]
            weight[u] -= weight[c]
            path.append(u)
        mine = len(pieces)
        pieces.append([path, [], -1])
        if owner is not None:
            whose, below = owner
            if below:
                pieces[whose][1].append(mine)
            else:
                pieces[whose][2] = mine
        waiting.extend((u, (mine, True)) for u in children[c] if not gone[u])
        gone[c] = True
        if c != top:
            waiting.append((top, (mine, False)))
    sums = [[0] * width for _ in range(n)]
    totals: list[list[int]] = [[]] * len(pieces)
    for k in range(len(pieces) - 1, -1, -1):  # pieces come after the piece they are part of
        path, below, above = pieces[k]
        own = [values[path[0]][i] + sum(totals[p][i] for p in below) for i in range(width)]
        for v in path:
            for i in range(width):
                sums[v][i] += own[i]
        totals[k] = own if above < 0 else [x + y for x, y in zip(own, totals[above])]
    return sums


def _finishing(width: int):
    """Whole components, sorted by component and depth, finished some thousands of nodes at a time."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def solve(rows: list[tuple]) -> pa.RecordBatch:
            place = {(rep, depth): i for i, (_, _, rep, depth, *_) in enumerate(rows)}
            parent = [-1 if (rep, depth) == (top, level) else place[up, depth - 1] for top, level, rep, depth, up, *_ in rows]
            got = decompose(parent, [row[5] for row in rows], [row[6:6 + width] for row in rows])
            columns = [[row[2] for row in rows], [row[3] for row in rows],
                       *[[x[i] + row[6 + width + i] for x, row in zip(got, rows)] for i in range(width)]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                              names=["rep", "depth", *[f"sum_{i}" for i in range(width)]])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if len(held) >= 16_384 and row[:2] != held[-1][:2]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)
    return work


def rollup(nodes: DataFrame, paths: DataFrame, values: dict[str, Column], bound: int = BOUND) -> DataFrame:
    """(rep, depth, and each of `values` summed over the node's subtree), by centroid decomposition (steps 3 and 4 above)."""
    names, width = list(values), len(values)
    v, s = [f"value_{i}" for i in range(width)], [f"sum_{i}" for i in range(width)]
    root = nodes.where("depth = 0").select("rep", "weight").first()
    at, top = ["rep", "depth"], ["top_rep", "top_depth"]
    is_top = (F.col("rep") == F.col("top_rep")) & (F.col("depth") == F.col("top_depth"))
    live = nodes.select(F.lit(root.rep).alias("top_rep"), F.lit(0).cast("bigint").alias("top_depth"), "rep", "depth", "parent_rep", "weight",
                        *[values[n].cast("bigint").alias(c) for n, c in zip(names, v)], *[F.lit(0).cast("bigint").alias(c) for c in s])
    node_at = paths.select(F.col("conv_id").alias("on"), F.col("pos").alias("at"), F.col("rep").alias("found"), F.col("parent_rep").alias("found_up"))
    small, finished = [], []
    if root.weight <= bound:
        small.append(live)
        live = None
    while live is not None:
        live = stash(live, "components")
        tops = live.where(is_top).select(*top, F.col("weight").alias("whole"))
        centroids = (live.join(tops, top).where(F.col("weight") * 2 > F.col("whole")).groupBy(*top)
                     .agg(F.max_by("rep", "depth").alias("c_rep"), F.max_by("weight", "depth").alias("c_weight"), F.max("depth").alias("c_depth")))
        centroids = stash(centroids, "centroids")
        # The node that a node's own conversation passes right below the centroid's depth tells which part it falls to.
        asked = live.join(centroids, top).withColumn("at", F.when(F.col("depth") > F.col("c_depth"), F.col("c_depth") + 1))
        below = F.coalesce(F.col("found_up") == F.col("c_rep"), F.lit(False))
        marked = stash(asked.join(node_at.withColumnRenamed("on", "rep"), ["rep", "at"], "left").withColumn("below", below).withColumn(
            "is_c", (F.col("rep") == F.col("c_rep")) & (F.col("depth") == F.col("c_depth"))).drop("at", "found_up"), "marked")
        totals = marked.where("below OR is_c").groupBy(*top).agg(*[F.sum(c).alias(f"d_{c}") for c in v])
        along = centroids.join(totals, top).select(
            F.col("c_rep").alias("on"), F.explode(F.sequence("top_depth", "c_depth")).alias("at"), "c_depth", "c_weight", *[f"d_{c}" for c in v])
        adds = along.join(node_at, ["on", "at"]).select(
            F.col("found").alias("rep"), F.col("at").alias("depth"), *[f"d_{c}" for c in v],
            F.when(F.col("at") < F.col("c_depth"), F.col("c_weight")).otherwise(0).alias("d_weight"))
        moved = marked.join(adds, at, "left").select(
            F.when(F.col("below"), F.col("found")).otherwise(F.col("top_rep")).alias("top_rep"),
            F.when(F.col("below"), F.col("c_depth") + 1).otherwise(F.col("top_depth")).alias("top_depth"),
            "rep", "depth", "parent_rep", (F.col("weight") - F.coalesce("d_weight", F.lit(0))).alias("weight"), *v,
            *[(F.col(c) + F.coalesce(f"d_{x}", F.lit(0))).alias(c) for c, x in zip(s, v)], "is_c")
        moved = stash(moved, "moved")
        finished.append(moved.where("is_c").select(*at, *s))
        rest = moved.where("NOT is_c").drop("is_c")
        large = stash(rest.where(is_top & (F.col("weight") > bound)).select(*top), "large")
        if large.isEmpty():
            small.append(rest)
            break
        small.append(rest.join(large, top, "left_anti"))
        live = rest.join(large, top, "left_semi").select(rest.columns)
    ready = small[0]
    for more in small[1:]:
        ready = ready.unionByName(more)
    dealt = ready.select(*top, *at, "parent_rep", "weight", *v, *s).repartition(*top).sortWithinPartitions(*top, "depth")
    done = map_batches(dealt, _finishing(width), ", ".join(f"{c} bigint" for c in [*at, *s]))
    for more in finished:
        done = done.unionByName(more)
    return done.select(*at, *[F.col(c).alias(n) for c, n in zip(s, names)])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (rep, depth, conv_id) rows as comma-joined ids of at most some kilobytes."""
    node, first, ids, size = None, None, [], 0
    out: list[tuple] = []

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["rep", "depth", "first", "ids"])

    for batch in batches:
        for rep, depth, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if (rep, depth) != node or size > _CHUNK:
                if ids:
                    out.append((*node, first, ",".join(ids)))
                node, first, ids, size = (rep, depth), conv, [], 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        if len(out) > 1_000:
            yield table(out)
            out = []
    if ids:
        out.append((*node, first, ",".join(ids)))
    if out:
        yield table(out)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node from its chunks, sorted by their first id."""
    node, digest = None, None
    names = ["rep", "depth", "ends_sha256"]
    for batch in batches:
        out: list[tuple] = []
        for rep, depth, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
            if (rep, depth) == node:
                digest.update(b",")
            else:
                if node:
                    out.append((*node, digest.hexdigest()))
                node, digest = (rep, depth), hashlib.sha256()
            digest.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)
    if node:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, digest.hexdigest())], names=names)


def end_hashes(members: DataFrame, paths: DataFrame) -> DataFrame:
    """(rep, depth, ends_sha256) of every node at which conversations end."""
    ends = paths.join(members.select("conv_id", F.col("length").alias("pos")), ["conv_id", "pos"]).select("rep", F.col("pos").alias("depth"), "conv_id")
    order = ["rep", "depth", "conv_id"]
    chunks = map_batches(ends.repartitionByRange(*order).sortWithinPartitions(*order), _chunks, "rep bigint, depth bigint, first bigint, ids string")
    return map_batches(chunks.repartition("rep", "depth").sortWithinPartitions("rep", "depth", "first"), _hashes,
                       "rep bigint, depth bigint, ends_sha256 string")


def prefix_nodes(turns: DataFrame, members: DataFrame, bound: int = BOUND) -> DataFrame:
    """Every node of the trie: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves and
    saved_tokens over its subtree, ends_sha256. `turns` and `members` as `rebuilt` returns them. Runs when called."""
    members = stash(members, "members")
    built = trie(turns, members)
    if built is None:
        return turns.sparkSession.createDataFrame([], _NODE)
    nodes, paths = built
    sums = rollup(nodes, paths, {"n_leaves": (F.col("n_children") == 0).cast("bigint"),
                                 "saved_tokens": (F.col("n_convs") - 1) * F.col("words")}, bound)
    at = ["rep", "depth"]
    return nodes.join(sums, at).join(end_hashes(members, paths), at, "left").select(
        F.col("rep").alias("conv_id"), "depth", F.col("parent_rep").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
