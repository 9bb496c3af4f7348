"""Prefix trie of conversations, totalled from the leaves by messages.

A node is a distinct sequence of first turns, known by the exclusive or of the
hashes of its turns at their places (128 bits, from SHA-256 digests of the turns).
Each node counts the conversations below it and its children.  Totals of subtrees
are found by peeling leaves: every node with children waits with a counter of the
children that haven't reported; a node whose counter is at zero is complete and
sends its totals to its parent, round after round, until the root has reported.

Nodes that one conversation alone passes have nothing to report and are complete
at once.  Chains of nodes with one child would take a round for each; they are
shortened first by doubling pointers, so a conversation repeated with hundreds of
turns takes a logarithm of that, and get the totals of the node that ends them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritally.functions.stats import with_ordinal
from veritally.llm.common import checkpoint
from veritally.llm.folds import Joined, fold_sorted

#: Turns of a conversation that share a window; conversations over it are put together from blocks.
BLOCK = 4_096
#: Conversations whose numbers are joined to one string at once.
PAGE = 4_096
NODE = ("a", "b")


def ordered_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, n_turns, d1, d2, bytes) of every turn: its place from 1 in its conversation, digest and UTF-8 bytes.

    Turns come in order of ``turn``, nulls first, ties by role and then by digest
    (equal turns are interchangeable).  Null roles and texts are empty.  Rows
    without a ``conv_id`` belong to no conversation.  Places come from one global
    order, so a conversation with most of the rows is dealt to many tasks.
    """
    said, words = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    whole = F.sha2(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said, words).cast("binary"), 256)
    rows = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), said.alias("role"), F.octet_length(words).cast("long").alias("bytes"), whole.alias("sha")
    )
    rows = rows.select("conv_id", "turn", "role", "bytes", F.xxhash64(F.lit(1), "sha").alias("d1"), F.xxhash64(F.lit(2), "sha").alias("d2"))
    placed = with_ordinal(rows, "conv_id", F.col("turn").asc_nulls_first(), "role", "d1", "d2", name="_at")
    firsts = placed.groupBy("conv_id").agg(F.min("_at").alias("_first"), F.count("*").alias("n_turns"))
    return placed.join(firsts, "conv_id").select("conv_id", (F.col("_at") - F.col("_first") + 1).alias("pos"), "n_turns", "d1", "d2", "bytes")


def rebuilt(turns: DataFrame, every: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """(sequences, conversations) in which conversations share the heads of others.

    Conversation c gets the first h turns of conversation ``c - c % every``, h being
    crc32 of c's decimal modulo ``heads``, and then its own after its first h.
    ``sequences``: (conv_id, depth, length, d1, d2, bytes), depth from 1;
    ``conversations``: (conv_id, length), those left without a turn included.
    """
    base = F.col("conv_id") - F.col("conv_id") % every
    lent = turns.where((F.col("conv_id") == base) & (F.col("pos") < heads))
    lent = lent.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "d1", "d2", "bytes"))).alias("head"))
    convs = turns.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns")).withColumn("base", base)
    cut = F.when(F.col("base") == F.col("conv_id"), 0).otherwise((F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int"))
    convs = convs.join(lent, "base", "left").withColumn("cut", cut)
    given = F.when(F.col("head").isNull(), F.array().cast(lent.schema["head"].dataType)).otherwise(F.slice("head", F.lit(1), F.col("cut")))
    convs = convs.select("conv_id", "cut", given.alias("given"), (F.size(given) + F.greatest(F.col("n_turns") - F.col("cut"), F.lit(0))).cast("long").alias("length"))
    convs = checkpoint(convs)
    own = turns.join(convs.select("conv_id", "cut", "length", F.size("given").alias("before")), "conv_id").where("pos > cut")
    own = own.select("conv_id", (F.col("pos") - F.col("cut") + F.col("before")).cast("long").alias("depth"), "length", "d1", "d2", "bytes")
    first = convs.select("conv_id", "length", F.posexplode("given").alias("at", "x")).select("conv_id", (F.col("at") + 1).cast("long").alias("depth"), "length", "x.d1", "x.d2", "x.bytes")
    return own.unionByName(first), convs.select("conv_id", "length")


def paths(sequences: DataFrame) -> DataFrame:
    """(conv_id, depth, length, bytes, a, b, pa, pb) of every turn: the node it leads to, and that one's parent."""
    hashed = sequences.select("*", *[F.xxhash64(F.lit(k), "depth", "d1", "d2").alias(f"h{k}") for k in (1, 2)], F.floor((F.col("depth") - 1) / BLOCK).alias("block")).drop("d1", "d2")
    upto = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    within = hashed.select("*", F.bit_xor("h1").over(upto).alias("x1"), F.bit_xor("h2").over(upto).alias("x2"))
    blocks = hashed.where(F.col("length") > BLOCK).groupBy("conv_id", "block").agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", F.bit_xor("h1").over(before).alias("o1"), F.bit_xor("h2").over(before).alias("o2"))
    node = lambda k: F.col(f"x{k}").bitwiseXOR(F.coalesce(f"o{k}", F.lit(0)))
    found = within.join(blocks, ["conv_id", "block"], "left").withColumn("a", node(1)).withColumn("b", node(2))
    return found.select("conv_id", "depth", "length", "bytes", "a", "b", F.col("a").bitwiseXOR(F.col("h1")).alias("pa"), F.col("b").bitwiseXOR(F.col("h2")).alias("pb"))


def _same(left: str, right: str, names: tuple[str, str] = NODE) -> Column:
    return (F.col(f"{left}.{names[0]}") == F.col(f"{right}.a")) & (F.col(f"{left}.{names[1]}") == F.col(f"{right}.b"))


def _chains(tree: DataFrame) -> DataFrame:
    """(a, b, ta, tb, acc): for each node with one child the first node below that has none or several,
    and what the nodes from this one to before that save."""
    single = tree.where("n_children = 1 and n_convs > 1")
    hops = checkpoint(single.select("a", "b", F.col("ca").alias("ta"), F.col("cb").alias("tb"), F.col("own").alias("acc"), F.lit(False).alias("ended")))
    while hops.where("not ended").limit(1).count():
        going, all_ = hops.where("not ended").alias("v"), hops.alias("u")
        jumped = going.join(all_, (F.col("v.ta") == F.col("u.a")) & (F.col("v.tb") == F.col("u.b")), "left").select(
            "v.a", "v.b", F.coalesce("u.ta", "v.ta").alias("ta"), F.coalesce("u.tb", "v.tb").alias("tb"),
            (F.col("v.acc") + F.coalesce("u.acc", F.lit(0))).alias("acc"), F.coalesce("u.ended", F.lit(True)).alias("ended"),
        )
        hops = checkpoint(hops.where("ended").unionByName(jumped))
    return hops.drop("ended")


def subtree_totals(tree: DataFrame) -> DataFrame:
    """(a, b, n_leaves, saved) of every node, by peeling leaves.

    ``tree``: (a, b, pa, pb, n_convs, n_children, own, ca, cb), ca and cb being the
    child of a node with one.
    """
    chains = _chains(tree)
    inner = tree.where("n_children = 1 and n_convs > 1").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    tops = chains.join(inner, list(NODE), "left_anti").alias("c").join(tree.select("a", "b", "pa", "pb").alias("t"), _same("c", "t"))
    tops = tops.select(F.col("c.ta").alias("a"), F.col("c.tb").alias("b"), F.col("t.pa").alias("ua"), F.col("t.pb").alias("ub"), F.col("c.acc").alias("above"))
    heads = tree.where("n_children <> 1 or n_convs = 1").join(tops, list(NODE), "left")
    heads = heads.select("a", "b", F.coalesce("ua", "pa").alias("ua"), F.coalesce("ub", "pb").alias("ub"), F.coalesce("above", F.lit(0)).alias("above"), "n_convs", F.col("n_children").alias("missing"), F.col("own").alias("saved"))
    heads = heads.withColumn("waits", F.col("n_convs") * F.col("missing") > 1).withColumn("n_leaves", F.when(~F.col("waits"), 1).otherwise(0).cast("long"))
    state = checkpoint(heads.drop("n_convs"))
    finished = [state.where("not waits")]
    waiting = state.where("waits")
    while waiting.limit(1).count():
        sent = finished[-1].groupBy(F.col("ua").alias("a"), F.col("ub").alias("b")).agg(F.count("*").alias("got"), F.sum("n_leaves").alias("more_leaves"), F.sum(F.col("saved") + F.col("above")).alias("more_saved"))
        told = waiting.join(sent, list(NODE), "left")
        told = told.select(
            "a", "b", "ua", "ub", "above", (F.col("missing") - F.coalesce("got", F.lit(0))).alias("missing"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
            (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
        )
        state = checkpoint(told)
        finished.append(state.where("missing = 0"))
        waiting = state.where("missing > 0")
        if not finished[-1].limit(1).count():
            raise RuntimeError("nodes wait for children that never report")
    done = finished[0].select("a", "b", "n_leaves", "saved")
    for part in finished[1:]:
        done = done.unionByName(part.select("a", "b", "n_leaves", "saved"))
    done = checkpoint(done)
    within = chains.alias("c").join(done.alias("d"), (F.col("c.ta") == F.col("d.a")) & (F.col("c.tb") == F.col("d.b")))
    return done.unionByName(within.select("c.a", "c.b", "d.n_leaves", (F.col("d.saved") + F.col("c.acc")).alias("saved")))


def joined_ids(ends: DataFrame) -> DataFrame:
    """(a, b, ends_sha256): SHA-256 of the decimal conv_ids of each node, ascending, joined by commas.

    Ids are joined to pages by their place in one global order; only nodes whose
    ids stand on several pages are read page by page.
    """
    placed = with_ordinal(ends, "a", "b", "conv_id", name="at")
    pages = placed.groupBy("a", "b", F.floor(F.col("at") / PAGE).alias("page_no")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("page"))
    pages = checkpoint(pages)
    counts = pages.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("page").alias("page"))
    short = counts.where("n = 1").select("a", "b", F.sha2(F.col("page").cast("binary"), 256).alias("ends_sha256"))
    long_ = pages.join(counts.where("n > 1").select("a", "b"), list(NODE))
    digests = fold_sorted(long_, NODE, ["page_no"], lambda: Joined(","), T.StructType([T.StructField("ends_sha256", T.StringType())]))
    return short.unionByName(digests)


def trie(sequences: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row for each node of the prefix trie, the textless root (depth 0) included.

    ``sequences``: (conv_id, depth, length, d1, d2, bytes) with depths from 1 to
    length; ``conversations``: (conv_id, length) of all, also those without turns.
    Columns: conv_id (smallest member), depth, parent_conv_id (null for the root),
    n_convs, n_children, n_leaves, saved_tokens (over the subtree, (members - 1) times
    the bytes of a node's last turn), ends_sha256.  No conversations, no nodes.
    """
    found = checkpoint(paths(sequences))
    root = conversations.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = root.select(zero.alias("a"), zero.alias("b"), "n_convs", "conv_id", zero.alias("depth"), F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"), zero.alias("own"))
    nodes = found.groupBy("a", "b").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.max("bytes").alias("own"))
    nodes = checkpoint(nodes.withColumn("own", F.col("own") * (F.col("n_convs") - 1)).unionByName(root))
    children = nodes.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"), F.max("a").alias("ca"), F.max("b").alias("cb"))
    tree = checkpoint(nodes.join(children, list(NODE), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    parents = tree.where("n_children > 0").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    last = found.where("depth = length").select("a", "b", "conv_id").unionByName(conversations.where("length = 0").select(zero.alias("a"), zero.alias("b"), "conv_id"))
    out = tree.join(subtree_totals(tree), list(NODE)).join(joined_ids(last), list(NODE), "left").join(parents, ["pa", "pb"], "left")
    none = F.sha2(F.lit("").cast("binary"), 256)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"))
