"""Conversation prefix trie with balanced rollup by centroid decomposition.

Building. Every turn is reduced to a digest (SHA-256 of its depth, role and text), its words
and its place; texts go no further. A prefix is known by its depth and the sums of four 32-bit
lanes of the digests of its turns, 128 bits in all, so prefixes come from running sums, which
are taken within chunks of a conversation and carried over by chunk totals: no conversation
has to fit in a task. Nodes are the groups of equal prefixes.

Rollup. ``size`` of a node is the number of turns of its members from its own depth on, which
is known from their lengths alone; it is the subtree sum of the nodes' member counts. In each
component of the parent-edge forest (first: the whole trie) the nodes that hold more than half
of the component's size form one path from its top; the lowest of them is the centroid. The
component is cut there: each child of the centroid becomes the top of a component, as does
what is left above. A node below the centroid finds its new top by one look-up: the node at
the depth below the centroid's in the conversation it stands for. The total of what was cut
off is added (and its size taken off) along the path from the centroid to the top. Sizes
halve with every round, so there are at most log2(turns) rounds, whatever the shape: a chain
of a million turns, or a root with a million children. Components of at most ``LOCAL`` nodes
are decomposed to the end by the same rounds inside tasks, many components at once.

Hot groups. Members of a node, children of a node and nodes of a component are counted and
summed with map-side combining; joins on nodes are skewed joins that adaptive execution splits.
The ids for ``ends_sha256`` are numbered over any number of tasks and joined in strings of
``CHUNK`` ids; only where a node has more does a task hash such strings one after the other.

Defined results: turns are ordered by turn (null first), then role, then digest of the text;
repeated rows are turns of their own; null role and text count as empty. Rows without a
``conv_id`` belong to no conversation. Other columns are ignored, whatever their names. An
empty table gives an empty trie; else the root is always there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.llm.common import SPACE, column, ranked, staged

#: Conversations of a group, and the largest number of turns taken from the group's first one.
GROUP, SHARED = 20, 3
#: Nodes of a component that a task decomposes to the end; turns of a chunk of running sums; ids of a string.
LOCAL, STEP, CHUNK = 200, 4096, 8192
#: A round at least halves what it starts from.
MOST_ROUNDS = 64

LANES = 4
_NODE = ["k1", "k2", "depth"]


def n_words(text: Column) -> Column:
    """Words between white space, as 64-bit number."""
    parts = F.split(F.trim(F.regexp_replace(text, SPACE, " ")), " ")
    return F.when(F.trim(F.regexp_replace(text, SPACE, " ")) == "", F.lit(0)).otherwise(F.size(parts)).cast("long")


def turns(talks: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, place, digest, role, words)``: the turns of each conversation in order, from 1."""
    text = F.coalesce(column(talks, text_col, "string"), F.lit(""))
    rows = talks.select(column(talks, id_col, "long").alias("conv"), column(talks, turn_col, "long").alias("turn"),
                        F.coalesce(column(talks, role_col, "string"), F.lit("")).alias("role"), F.sha2(text.cast("binary"), 256).alias("digest"), n_words(text).alias("words"))
    rows = rows.filter("conv is not null").withColumn("timed", F.col("turn").isNotNull())
    placed = ranked(rows, ["conv"], ["timed", "turn", "role", "digest"], "place")
    return staged(placed.select("conv", F.col("place").cast("long").alias("place"), "role", "digest", "words"), "turns")


def shared_turns(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % (SHARED + 1)


def rebuilt(given: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv, depth, role, digest, words)`` of the rebuilt conversations, and ``(conv, len)`` of all of them."""
    own = given.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    first = (F.col("conv") - F.col("conv") % GROUP).alias("first")
    heads = own.select(F.col("conv").alias("head"), F.least("n", F.lit(SHARED)).alias("held"))
    convs = own.select("conv", "n", first, shared_turns(F.col("conv")).alias("h")).join(heads, F.col("first") == F.col("head"), "left")
    taken = F.least("h", F.coalesce("held", F.lit(0)))
    convs = staged(convs.select("conv", "first", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "conversations")
    rest = given.join(convs.select(F.col("conv").alias("c"), "h", "taken"), F.col("conv") == F.col("c")).filter(F.col("place") > F.col("h"))
    rest = rest.select("conv", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "role", "digest", "words")
    lead = given.filter(F.col("place") <= SHARED).withColumnRenamed("conv", "head")
    lead = convs.filter("taken > 0").join(lead, F.col("first") == F.col("head")).filter(F.col("place") <= F.col("taken"))
    return rest.unionByName(lead.select("conv", F.col("place").alias("depth"), "role", "digest", "words")), convs.select("conv", "len")


def _key(lanes: list[Column]) -> tuple[Column, Column]:
    low = [x.bitwiseAND(F.lit(0xFFFFFFFF)) for x in lanes]
    return F.shiftleft(low[0], 32).bitwiseOR(low[1]), F.shiftleft(low[2], 32).bitwiseOR(low[3])


def paths(rows: DataFrame) -> DataFrame:
    """``(conv, depth, k1, k2, up1, up2, words)``: each turn with the keys of the prefixes that end with it and before it."""
    mark = F.sha2(F.concat_ws(":", F.col("depth").cast("string"), "digest", "role").cast("binary"), 256)
    lane = [F.conv(F.substring("mark", 8 * i + 1, 8), 16, 10).cast("long").alias(f"x{i}") for i in range(LANES)]
    rows = rows.withColumn("mark", mark).select("conv", "depth", "words", F.floor((F.col("depth") - 1) / STEP).alias("step"), *lane)
    so_far = Window.partitionBy("conv", "step").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = staged(rows.select("conv", "depth", "words", "step", *[f"x{i}" for i in range(LANES)], *[F.sum(f"x{i}").over(so_far).alias(f"s{i}") for i in range(LANES)]), "sums")
    before = Window.partitionBy("conv").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    totals = local.groupBy("conv", "step").agg(*[F.sum(f"x{i}").bitwiseAND(F.lit(0xFFFFFFFF)).alias(f"t{i}") for i in range(LANES)])
    carried = totals.select(F.col("conv").alias("c"), F.col("step").alias("st"), *[F.sum(f"t{i}").over(before).alias(f"b{i}") for i in range(LANES)]).filter("st > 0")
    joined = local.join(carried, (F.col("conv") == F.col("c")) & (F.col("step") == F.col("st")), "left")
    sums = [F.col(f"s{i}") + F.coalesce(f"b{i}", F.lit(0)) for i in range(LANES)]
    k1, k2 = _key(sums)
    up1, up2 = _key([s - F.col(f"x{i}") for i, s in enumerate(sums)])
    return staged(joined.select("conv", "depth", "words", k1.alias("k1"), k2.alias("k2"), up1.alias("up1"), up2.alias("up2")), "paths")


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the strings of each node, which come in order; only a hash state is held."""
    names, now, state = ["k1", "k2", "depth", "sha"], None, None
    for batch in batches:
        out = []
        for k1, k2, depth, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if (k1, k2, depth) != now:
                if now:
                    out.append((*now, state.hexdigest()))
                now, state = (k1, k2, depth), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out])
    if now:
        yield pa.RecordBatch.from_pylist([dict(zip(names, (*now, state.hexdigest())))])


def ends(last: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(k1, k2, depth, n_ends, sha)`` from the end node of each conversation, ``(conv, k1, k2, depth)``."""
    numbered = ranked(last, _NODE, ["conv"], "place").withColumn("part", F.floor((F.col("place") - 1) / chunk))
    strings = numbered.groupBy(*_NODE, "part").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string")), ",").alias("ids"))
    strings = staged(strings, "ends")
    many = strings.filter("part > 0").select(*_NODE).distinct()
    short = strings.join(many, _NODE, "left_anti").select(*_NODE, F.sha2(F.col("ids").cast("binary"), 256).alias("sha"))
    long = strings.join(many, _NODE, "left_semi").repartition(*_NODE).sortWithinPartitions(*_NODE, "part")
    long = long.select(*_NODE, "part", "ids").mapInArrow(_hashes, "k1 long, k2 long, depth long, sha string")
    return strings.groupBy(*_NODE).agg(F.sum("n").alias("n_ends")).join(short.unionByName(long), _NODE)


def trie(path: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node: its key, its parent's (``up1, up2``), conv, n_convs, size, words, n_children, parent_conv."""
    rows = path.join(convs.withColumnRenamed("conv", "c"), F.col("conv") == F.col("c"))
    count = [F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.sum("len").alias("lens")]
    below = rows.groupBy(*_NODE).agg(*count, F.min("up1").alias("up1"), F.min("up2").alias("up2"), F.min("words").alias("words"))
    zero = F.lit(0).cast("long")
    none = F.lit(None).cast("long")
    root = convs.agg(*count).filter("n_convs > 0").select(zero.alias("k1"), zero.alias("k2"), zero.alias("depth"), "conv", "n_convs", "lens", none.alias("up1"), none.alias("up2"), zero.alias("words"))
    nodes = staged(below.unionByName(root).withColumn("size", F.col("lens") - F.col("n_convs") * (F.col("depth") - 1)).drop("lens"), "nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("up1").alias("k1"), F.col("up2").alias("k2"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("depth").alias("pd"), F.col("conv").alias("parent_conv"))
    at = (F.col("up1") == F.col("p1")) & (F.col("up2") == F.col("p2")) & (F.col("depth") - 1 == F.col("pd"))
    nodes = nodes.join(children, _NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    return staged(nodes.join(parents, at, "left").drop("p1", "p2", "pd"), "trie")


# ---- rollup

_PIECE = ["top1", "top2", "topd"]


def _same(a: list[str], b: list[str]) -> Column:
    out = F.lit(True)
    for x, y in zip(a, b):
        out &= F.col(x) == F.col(y)
    return out


def _local(up: np.ndarray, top: np.ndarray, size: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Subtree sums of ``own`` (a row for each value) over whole components, by rounds of centroids.

    Nodes are in order of depth; ``up`` is the place of the parent (the node itself for tops),
    ``top`` the place of the component's top.
    """
    size, top, added, out = size.copy(), top.copy(), np.zeros_like(own), np.zeros_like(own)
    here = np.arange(len(up))
    going = here
    for _ in range(MOST_ROUNDS + 1):
        if not len(going):
            return out
        heavy = going[2 * size[going] > size[top[going]]]
        centre = np.full(len(up), -1)
        np.maximum.at(centre, top[heavy], heavy)  # of the path of heavy nodes the lowest comes last
        c = centre[top[going]]
        # the nearest of: the component's top, the centroid, a child of the centroid; by pointer doubling
        near = here.copy()
        stays = (going == top[going]) | (going == c) | (up[going] == c)
        near[going] = np.where(stays, going, up[going])
        while not np.array_equal(nearer := near[near], near):
            near = nearer
        new = near[going]
        under = (new == c) | ((up[new] == c) & (new != top[going]))
        sums = np.zeros_like(own)
        for k in range(len(own)):
            np.add.at(sums[k], c[under], own[k][going[under]])
        cut = np.unique(c)
        out[:, cut] = sums[:, cut] + added[:, cut]
        path = heavy[heavy != centre[top[heavy]]]
        lost = centre[top[path]]
        added[:, path] += sums[:, lost]
        size[path] -= size[lost]
        top[going] = new
        going = going[new != c]
    raise RuntimeError("sizes do not halve")


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole small components, in order of component and depth."""
    held: list[pa.RecordBatch] = []

    def done(rows: pa.Table) -> pa.RecordBatch:
        col = lambda n: rows.column(n).to_numpy()
        n = rows.num_rows
        key = np.rec.fromarrays([col(x) for x in ("depth", "k1", "k2")], names="d,a,b")
        order = np.argsort(key, kind="stable")
        key = key[order]
        find = lambda d, a, b: np.searchsorted(key, np.rec.fromarrays([d[order], a[order], b[order]], names="d,a,b"))
        top = find(col("topd"), col("top1"), col("top2"))
        up = np.where(top == np.arange(n), np.arange(n), find(col("depth") - 1, col("up1"), col("up2")))
        own = np.stack([col("leaves")[order], col("saved")[order]])
        sums = _local(up, top, col("size")[order], own) + np.stack([col("more_leaves")[order], col("more_saved")[order]])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (key.a, key.b, key.d, *sums)], names=["k1", "k2", "depth", "n_leaves", "saved_tokens"])

    for batch in batches:
        held.append(batch)
        rows = pa.Table.from_batches(held)
        if rows.num_rows >= 50_000:
            last = np.stack([rows.column(x).to_numpy() for x in _PIECE])
            cuts = np.flatnonzero((last[:, 1:] != last[:, :-1]).any(axis=0))
            if len(cuts):
                yield done(rows.slice(0, int(cuts[-1]) + 1))
                held = rows.slice(int(cuts[-1]) + 1).combine_chunks().to_batches()
    if held and (rows := pa.Table.from_batches(held)).num_rows:
        yield done(rows)


def _round(nodes: DataFrame, path: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One cut of every component: the nodes that go on, and the finished centroids."""
    tops = nodes.groupBy(*_PIECE).agg(F.max("size").alias("whole"))
    rows = nodes.join(tops, _PIECE)
    heavy = 2 * F.col("size") > F.col("whole")
    lowest = F.max(F.struct("depth", "k1", "k2", "conv", "size")).alias("c")
    centres = staged(rows.filter(heavy).groupBy(*_PIECE).agg(lowest).select(
        *_PIECE, F.col("c.k1").alias("c1"), F.col("c.k2").alias("c2"), F.col("c.depth").alias("cd"), F.col("c.size").alias("lost")), "centres")
    rows = rows.join(centres, _PIECE)
    # the node at the depth below the centroid's, in the conversation that a node stands for
    look = path.select(F.col("conv").alias("pc"), F.col("depth").alias("pd"), F.col("k1").alias("n1"), F.col("k2").alias("n2"), F.col("up1").alias("u1"), F.col("up2").alias("u2"))
    under = rows.filter(F.col("depth") > F.col("cd")).join(look, (F.col("conv") == F.col("pc")) & (F.col("cd") + 1 == F.col("pd")))
    mine = (F.col("u1") == F.col("c1")) & (F.col("u2") == F.col("c2"))
    under = under.withColumn("below", mine).withColumns({"n1": F.when(mine, F.col("n1")), "n2": F.when(mine, F.col("n2"))}).drop("pc", "pd", "u1", "u2")
    rest = rows.filter(F.col("depth") <= F.col("cd")).withColumns({"n1": F.lit(None).cast("long"), "n2": F.lit(None).cast("long"), "below": F.lit(False)})
    at_centre = (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("depth") == F.col("cd"))
    rows = staged(under.unionByName(rest).withColumn("centre", at_centre).withColumn("heavy", heavy), "cut")
    off = rows.filter("below or centre").groupBy(*_PIECE).agg(F.sum("leaves").alias("off_leaves"), F.sum("saved").alias("off_saved"))
    rows = rows.join(off, _PIECE)
    done = rows.filter("centre").select(*_NODE, (F.col("off_leaves") + F.col("more_leaves")).alias("n_leaves"), (F.col("off_saved") + F.col("more_saved")).alias("saved_tokens"))
    add = lambda c, x: F.col(c) + F.when(F.col("heavy"), F.col(x)).otherwise(F.lit(0))  # noqa: E731  heavy nodes above the centroid are the path to the top
    going = rows.filter("not centre").select(
        *_NODE, "up1", "up2", "conv", "leaves", "saved", (F.col("size") - F.when(F.col("heavy"), F.col("lost")).otherwise(F.lit(0))).alias("size"),
        add("more_leaves", "off_leaves").alias("more_leaves"), add("more_saved", "off_saved").alias("more_saved"),
        F.coalesce("n1", "top1").alias("top1"), F.coalesce("n2", "top2").alias("top2"), F.when(F.col("below"), F.col("cd") + 1).otherwise(F.col("topd")).alias("topd"))
    return going, done


def rollup(nodes: DataFrame, path: DataFrame, local: int = LOCAL) -> DataFrame:
    """``(k1, k2, depth, n_leaves, saved_tokens)`` of every node of :func:`trie`."""
    zero = F.lit(0).cast("long")
    going = nodes.select(*_NODE, "up1", "up2", "conv", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
                         "size", zero.alias("more_leaves"), zero.alias("more_saved"), zero.alias("top1"), zero.alias("top2"), zero.alias("topd"))
    done, small = [], []
    going = staged(going.withColumn("held", F.lit(nodes.count())), "pieces")  # one component
    for _ in range(MOST_ROUNDS):
        small.append(going.filter(F.col("held") <= local).drop("held"))
        going = going.filter(F.col("held") > local).drop("held")
        if not going.take(1):
            break
        going, cut = _round(going, path)
        count = going.groupBy(*_PIECE).agg(F.count(F.lit(1)).alias("held"))
        going = staged(going.join(count, _PIECE), "pieces")
        done.append(cut)
    else:
        raise RuntimeError("sizes do not halve")
    rows = small[0]
    for more in small[1:]:
        rows = rows.unionByName(more)
    rows = rows.repartition(*_PIECE).sortWithinPartitions(*_PIECE, "depth").drop("conv")
    out = rows.mapInArrow(_finish, "k1 long, k2 long, depth long, n_leaves long, saved_tokens long")
    for more in done:
        out = out.unionByName(more)
    return staged(out, "rollup")


def prefix_trie(talks: DataFrame, local: int = LOCAL, chunk: int = CHUNK, **columns: str) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    rows, convs = rebuilt(turns(talks, **columns))
    path = paths(rows)
    nodes = trie(path, convs)
    sums = rollup(nodes, path, local)
    keys = path.select(F.col("conv").alias("c"), "k1", "k2", "depth")
    zero = F.lit(0).cast("long")
    last = convs.filter("len > 0").join(keys, (F.col("conv") == F.col("c")) & (F.col("len") == F.col("depth"))).select("conv", *_NODE)
    last = last.unionByName(convs.filter("len = 0").select("conv", zero.alias("k1"), zero.alias("k2"), zero.alias("depth")))
    found = nodes.join(sums, _NODE).join(ends(last, chunk).drop("n_ends"), _NODE, "left")
    return found.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
