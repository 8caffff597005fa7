"""Prefix trie of conversations, as a z-fast trie in tables.

Only branching points and ends are nodes of the compacted trie; a node stands
for the edge from below its parent's depth to its own. Its handle is the
prefix at the depth of that range that is divisible by the largest power of two.
A conversation finds the node where it leaves the trie by fat binary search: it
probes its own prefix at that depth, and goes on below the node that has this
handle, or above the depth if none has. Conversations are inserted in batches;
only their turns beyond the place where they leave are looked at, together with
those of the edge that is split. At last the edges are expanded to a row a turn.

Prefixes are known by 128 bits, the exclusive or of a hash of each turn and its
place, so prefixes of any length are made by windows over blocks of turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardfile.sources.store import cut, drop

#: Each batch but the first is inserted into a trie of about a quarter of the conversations so far.
BATCHES = 3
GROWTH = 4
#: Turns of one conversation that a window holds, and members' ids of one node that are joined to a text at a time.
BLOCK = 1 << 12
_WORD = r"[^\x20\x09-\x0D]+"
_KEY = ["k1", "k2"]


def _xor(a: Column | str, b: Column | str) -> Column:
    return (F.col(a) if isinstance(a, str) else a).bitwiseXOR(F.col(b) if isinstance(b, str) else b)


def fattest(a: str, b: str) -> Column:
    """The number in (a, b] that is divisible by the largest power of two; 0 <= a < b."""
    bits = f"(length(bin({a} ^ {b})) - 1)"
    return F.expr(f"shiftleft(shiftright({b}, {bits}), {bits})")


def ordered_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, pos, h1, h2, w): each conversation's turns numbered from 1, with two hashes of role and text and the text's words.

    Rows are ordered by turn, null first, then role, then the text's md5. Rows
    of a null conversation are left out. Rows are dealt by ranges of that order,
    and a range adds the counts of the conversation's earlier ranges, so one
    conversation may hold any share of the rows.
    """
    said, words = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    narrow = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("c"), F.col(turn).alias("turn"), words.alias("role"), F.md5(said.cast("binary")).alias("m"),
        F.xxhash64(words, said).alias("h1"), F.xxhash64(F.lit(7), said, words).alias("h2"), F.regexp_count(said, F.lit(_WORD)).cast("long").alias("w"),
    )
    order = ["c", "turn", "role", "m"]
    dealt = cut(narrow.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "turns")
    counts = dealt.groupBy("c", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("c", "part", F.sum("n").over(before).alias("start")).where("start > 0")
    own = dealt.withColumn("own", F.row_number().over(Window.partitionBy("c", "part").orderBy("turn", "role", "m")))
    return own.join(starts, ["c", "part"], "left").select("c", (F.col("own") + F.coalesce("start", F.lit(0))).alias("pos"), "h1", "h2", "w")


def with_common_starts(turns: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """(c, d, h1, h2, w): conversations rebuilt with the beginning of another, and a row with d 0 for each, turnless ones too.

    The first h turns of conversation c - c % every (all if fewer, none if there is no such one), then the own turns
    after the first h; h is the CRC-32 of c in decimal digits, modulo `most`.
    """
    sizes = cut(turns.groupBy("c").agg(F.count("*").alias("n")), "sizes")
    other = (F.col("c") - F.col("c") % every).alias("other")
    h = (F.crc32(F.col("c").cast("string").cast("binary")) % most).alias("h")
    named = sizes.select("c", "n", other, h)
    placed = named.join(sizes.select(F.col("c").alias("other"), F.col("n").alias("n_other")), "other", "left").select("c", "other", "h", F.least("h", F.coalesce("n_other", F.lit(0))).alias("taken"))
    placed = cut(placed, "starts")
    own = turns.join(placed.select("c", "h", "taken"), "c").where("pos > h").select("c", (F.col("pos") - F.col("h") + F.col("taken")).alias("d"), "h1", "h2", "w")
    first = turns.where((F.col("pos") < most) & (F.col("c") % every == 0)).withColumnRenamed("c", "other")
    taken = placed.where("taken > 0").select("c", "other", "h").join(first, "other").where("pos <= h").select("c", F.col("pos").alias("d"), "h1", "h2", "w")
    nothing = placed.select("c", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), F.lit(0).cast("long").alias("w"))
    return own.unionByName(taken).unionByName(nothing)


def plain(turns: DataFrame) -> DataFrame:
    """(c, d, h1, h2, w): conversations as they are, and a row with d 0 for each."""
    zero = F.lit(0).cast("long")
    return turns.withColumnRenamed("pos", "d").unionByName(turns.select("c").distinct().select("c", zero.alias("d"), zero.alias("h1"), zero.alias("h2"), zero.alias("w")))


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """(c, d, k1, k2, p1, p2, w, words): the key of each prefix and of the one before it, the last turn's words and all words. d 0 has key (0, 0)."""
    turn = [F.when(F.col("d") > 0, F.xxhash64(F.lit(i), "d", "h1", "h2")).otherwise(0).alias(f"x{i}") for i in (1, 2)]
    rows = rebuilt.select("c", "d", *turn, "w", F.expr(f"d div {BLOCK}").alias("block"))
    totals = rows.groupBy("c", "block").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.sum("w").alias("w"))
    before = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = totals.select("c", "block", *(F.bit_xor(x).over(before).alias(f"b{x[1]}") for x in ("x1", "x2")), F.sum("w").over(before).alias("bw")).where("block > 0")
    upto = Window.partitionBy("c", "block").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("c", "d", "block", "x1", "x2", "w", *(F.bit_xor(x).over(upto).alias(f"l{x[1]}") for x in ("x1", "x2")), F.sum("w").over(upto).alias("lw"))
    all_ = local.join(earlier, ["c", "block"], "left")
    keys = {i: _xor(f"l{i}", F.coalesce(f"b{i}", F.lit(0))) for i in (1, 2)}
    return all_.select("c", "d", *(keys[i].alias(f"k{i}") for i in keys), *(_xor(keys[i], f"x{i}").alias(f"p{i}") for i in keys), "w", (F.col("lw") + F.coalesce("bw", F.lit(0))).alias("words"))


def _at(df: DataFrame, paths: DataFrame, c: str, d: str, names: dict[str, str]) -> DataFrame:
    """df with columns of the prefix of conversation c at depth d; null where there is none."""
    side = paths.select(F.col("c").alias("_c"), F.col("d").alias("_d"), *(F.col(a).alias(b) for a, b in names.items()))
    return df.join(side, (F.col(c) == F.col("_c")) & (F.col(d) == F.col("_d")), "left").drop("_c", "_d")


def locate(asked: DataFrame, nodes: DataFrame, paths: DataFrame, rounds: int) -> DataFrame:
    """(c, size, base, e1, e2): of each asked (c, size) the depth from which its turns are not in the trie, and the extent of the edge that it leaves within, if any.

    Fat binary search with a join a round: nobody needs more than the bits of
    the longest conversation.
    """
    handles = nodes.select("f1", "f2", F.col("k1").alias("e1"), F.col("k2").alias("e2"), F.col("depth").alias("extent"), F.col("above").alias("under"))
    zero = F.lit(0).cast("long")
    state = asked.select("c", "size", zero.alias("a"), F.col("size").alias("b"), zero.alias("found1"), zero.alias("found2"), zero.alias("extent_"), zero.alias("under_"))
    for _ in range(rounds):
        probe = F.when(F.col("a") < F.col("b"), fattest("a", "b"))
        probed = _at(state.withColumn("f", probe), paths, "c", "f", {"k1": "f1", "k2": "f2"})
        met = probed.join(handles, ["f1", "f2"], "left")
        hit = F.col("e1").isNotNull()
        keep = lambda new, old: F.when(hit, F.col(new)).otherwise(F.col(old))
        state = met.select(
            "c", "size", keep("extent", "a").alias("a"), F.when(F.col("f").isNotNull() & ~hit, F.col("f") - 1).otherwise(F.col("b")).alias("b"),
            keep("e1", "found1").alias("found1"), keep("e2", "found2").alias("found2"), keep("extent", "extent_").alias("extent_"), keep("under", "under_").alias("under_"),
        )
    ended = _at(state, paths, "c", "extent_", {"k1": "o1", "k2": "o2"})
    passed = (F.col("extent_") == 0) | (F.col("o1").eqNullSafe(F.col("found1")) & F.col("o2").eqNullSafe(F.col("found2")))
    ended = ended.withColumn("passed", passed).withColumn("next", F.when(F.col("passed"), F.col("extent_") + 1))
    names = nodes.select("n1", "n2", F.col("k1").alias("e1"), F.col("k2").alias("e2"))
    below = _at(ended, paths, "c", "next", {"k1": "n1", "k2": "n2"}).join(names, ["n1", "n2"], "left")
    own = lambda i: F.when(F.col("passed"), F.col(f"e{i}")).otherwise(F.col(f"found{i}")).alias(f"e{i}")
    return below.select("c", "size", F.when(F.col("passed"), F.col("extent_")).otherwise(F.col("under_")).alias("base"), own(1), own(2))


def insert(batch: DataFrame, nodes: DataFrame | None, paths: DataFrame, rounds: int) -> DataFrame:
    """The nodes of the trie with a batch of (c, size), of which no two are the same sequence: k1, k2, depth, above (its parent's depth), rep, f1, f2 (handle), n1, n2 (name)."""
    if nodes is None:
        placed, split = batch.withColumn("base", F.lit(0).cast("long")), None
    else:
        located = cut(locate(batch, nodes, paths, rounds), "located")
        placed = located.select("c", "size", "base")
        split = located.where("e1 is not null").select(F.col("e1").alias("k1"), F.col("e2").alias("k2")).distinct()
        edges = nodes.join(split, _KEY, "left_semi").select(F.col("rep").alias("c"), F.col("depth").alias("size"), F.col("above").alias("base"))
        placed = placed.unionByName(edges)
    new = placed.where("size > base").join(paths, "c").where("d > base and d <= size").select("c", "base", "d", *_KEY, "p1", "p2", (F.col("d") == F.col("size")).alias("ends"))
    child = F.struct(*_KEY)
    branching = new.where("d - 1 > base").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.min(child).alias("lo"), F.max(child).alias("hi")).where("lo <> hi").select(*_KEY)
    explicit = branching.unionByName(new.where("ends").select(*_KEY)).distinct()
    on_path = new.select("c", "base", "d", *_KEY).distinct().join(explicit, _KEY)
    above = F.coalesce(F.lag("d").over(Window.partitionBy("c", "base").orderBy("d")), F.col("base"))
    made = on_path.withColumn("above", above).groupBy(*_KEY).agg(F.min("d").alias("depth"), F.min("above").alias("above"), F.min("c").alias("rep"))
    made = made.withColumn("f", fattest("above", "depth")).withColumn("n", F.col("above") + 1)
    made = _at(_at(made, paths, "rep", "f", {"k1": "f1", "k2": "f2"}), paths, "rep", "n", {"k1": "n1", "k2": "n2"}).drop("f", "n")
    if split is not None:
        made = made.unionByName(nodes.join(split, _KEY, "left_anti").select(*made.columns))
    return cut(made, "nodes")


def built(ends: DataFrame, paths: DataFrame, batches: int = BATCHES, growth: int = GROWTH) -> DataFrame:
    """The compacted trie of (c, size), each a sequence of its own; null if there is none with a turn."""
    longest = ends.agg(F.max("size")).first()[0] or 0
    dealt, nodes, known = F.pmod(F.xxhash64("c"), F.lit(growth ** (batches - 1))), None, 0
    for i in range(batches):
        share = growth**i
        batch = ends.select("c", "size").where((dealt >= known) & (dealt < share) & (F.col("size") > 0))
        known = share
        if batch.isEmpty():
            continue
        grown = insert(batch, nodes, paths, int(longest).bit_length())
        if nodes is not None:
            drop(nodes)
        nodes = grown
    return nodes


def end_digests(members: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256): of the ids c that share a key, in ascending order, comma-joined.

    Ids are joined to texts by ranges of them; a key with several is hashed text by
    text, in order, by the one task that a digest of them all in a row needs, with one text in hand.
    """
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda x: x.cast("string")), ",")
    texts = cut(members.groupBy(*_KEY, F.shiftright("c", BLOCK.bit_length() - 1).alias("block")).agg(ids.alias("ids")), "ends")
    counts = texts.groupBy(*_KEY).agg(F.count("*").alias("n"))
    sized = texts.join(counts, _KEY)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in batches:
            out = []
            for k1, k2, ids in pdf.itertuples(index=False):
                if (k1, k2) != key:
                    if state:
                        out.append((*key, state.hexdigest()))
                    key, state = (k1, k2), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=["k1", "k2", "ends_sha256"])
        if state:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=["k1", "k2", "ends_sha256"])

    many = sized.where("n > 1").repartition(*_KEY).sortWithinPartitions(*_KEY, "block").select(*_KEY, "ids")
    one = sized.where("n = 1").select(*_KEY, F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
    return one.unionByName(many.mapInPandas(run, "k1 long, k2 long, ends_sha256 string"))


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """nodes (id, parent, n, leaves, edge, total, least) with n, leaves, edge and total summed and least minimal over each one's subtree.

    Round k adds what has gathered at the nodes 2^k levels down, so the rounds
    are the bits of the height.
    """
    state = cut(nodes.withColumn("up", F.col("parent")), "sums")
    while not state.where("up is not null").isEmpty():
        gathered = state.where("up is not null").groupBy("up").agg(*(F.sum(x).alias(f"_{x}") for x in ("n", "leaves", "edge", "total")), F.min("least").alias("_least")).withColumnRenamed("up", "id")
        hops = state.select(F.col("id").alias("up"), F.col("up").alias("_up"))
        more = state.join(gathered, "id", "left").join(hops, "up", "left")
        sums = [(F.col(x) + F.coalesce(f"_{x}", F.lit(0))).alias(x) for x in ("n", "leaves", "edge", "total")]
        after = cut(more.select("id", "parent", *sums, F.least("least", "_least").alias("least"), F.col("_up").alias("up")), "sums")
        drop(state)
        state = after
    return state.drop("up")


def prefix_trie(rebuilt: DataFrame, batches: int = BATCHES, growth: int = GROWTH) -> DataFrame:
    """A row per node of the trie of conversations (c, d, h1, h2, w), the root included: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conv_id is the smallest member, and with depth tells nodes apart; n_convs
    counts members, n_children nodes right below, n_leaves childless nodes of
    the subtree (the node itself if it has none), saved_tokens the words that members
    beyond the first need not repeat in the subtree, ends_sha256 the digest of
    the members that end here. Equal conversations are searched and inserted
    as one. No conversations give no rows.
    """
    rows = cut(prefixes(rebuilt), "prefixes")
    sizes = rows.groupBy("c").agg(F.max("d").alias("size"))
    last = cut(rows.join(sizes, "c").where("d = size").select("c", "size", *_KEY, "words"), "last")
    ends = cut(last.groupBy(*_KEY).agg(F.min("c").alias("c"), F.max("size").alias("size"), F.count("*").alias("members"), F.max("words").alias("words")), "ends")
    paths = cut(rows.where("d > 0").join(ends.select("c"), "c", "left_semi"), "paths")
    nodes = built(ends, paths, batches, growth)
    zero = F.lit(0).cast("long")
    root = ends.limit(1).select(zero.alias("k1"), zero.alias("k2"), zero.alias("depth"), zero.alias("above"), F.lit(None).cast("long").alias("rep"))
    tree = root if nodes is None else nodes.select(*root.columns).unionByName(root)
    named = _at(_at(tree, paths, "rep", "above", {"k1": "u1", "k2": "u2", "words": "before"}), paths, "rep", "depth", {"words": "upto"})
    named = cut(named.withColumn("id", F.monotonically_increasing_id()), "tree")
    # below the root is what has no prefix above it
    keys = named.select("id", F.col("k1").alias("u1"), F.col("k2").alias("u2"))
    own = named.withColumns({f"u{i}": F.when(F.col("depth") > 0, F.coalesce(f"u{i}", zero)) for i in (1, 2)})
    linked = own.join(keys.withColumnRenamed("id", "parent"), ["u1", "u2"], "left").join(ends.select(*_KEY, "members", F.col("c").alias("least"), F.col("words").alias("own_words")), _KEY, "left")
    children = linked.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    full = linked.join(children, "id", "left").withColumns({"n_children": F.coalesce("n_children", zero), "before": F.coalesce("before", zero)})
    full = cut(full.withColumns({"upto": F.coalesce("upto", zero), "members": F.coalesce("members", zero)}), "full")
    start = full.select(
        "id", "parent", F.col("members").alias("n"), (F.col("n_children") == 0).cast("long").alias("leaves"), (F.col("upto") - F.col("before")).alias("edge"),
        (F.col("members") * F.coalesce("own_words", zero)).alias("total"), "least",
    )
    sums = subtree_sums(start)
    counted = full.select("id", *_KEY, "depth", "above", "rep", "before", "n_children").join(sums, "id")
    parents = sums.select(F.col("id").alias("parent"), F.col("least").alias("parent_least"))
    whole = counted.join(parents, "parent", "left").join(end_digests(last.select(*_KEY, "c")), _KEY, "left")
    whole = cut(whole, "counted")
    spread = whole.where("depth > 0").withColumn("d", F.explode(F.sequence(F.col("above") + 1, F.col("depth"))))
    side = paths.select(F.col("c").alias("rep"), "d", "w", "words")
    at = spread.join(side, ["rep", "d"])
    upto, inner = F.col("words") - F.col("w"), F.col("d") < F.col("depth")
    nothing = hashlib.sha256(b"").hexdigest()
    digest = F.coalesce("ends_sha256", F.lit(nothing))
    edges = at.select(
        F.col("least").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("d") == F.col("above") + 1, F.col("parent_least")).otherwise(F.col("least")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(inner, 1).otherwise(F.col("n_children")).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("total") - F.col("n") * upto - F.col("edge") + upto - F.col("before")).alias("saved_tokens"), F.when(inner, F.lit(nothing)).otherwise(digest).alias("ends_sha256"),
    )
    top = whole.where("depth = 0").select(
        F.col("least").alias("conv_id"), "depth", F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"),
        (F.col("total") - F.col("edge")).alias("saved_tokens"), digest.alias("ends_sha256"),
    )
    return edges.unionByName(top)
