"""Conversations from reply trees: root-to-leaf paths, ranked and written in a chat template.

Messages name the message they reply to.  Ancestors are found by self-joins that
double their reach: after k of them every message knows the one 2 ** k above it and
the score of those between, so a tree of any depth takes a logarithm of it.  The
leaves of a tree are ranked by the mean score of their branch, the best are
chosen, and the same tables, joined once each, list every message above a chosen
leaf.  Each path is written with marks around its turns; control strings inside a
text are broken by a backslash, so that the text can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritally.llm.common import checkpoint
from veritally.llm.folds import fold_sorted

#: Turns of a path that are written to one page; a path of more turns has several pages.
PAGE_TURNS = 16

# The template's control strings.
START, END = "<s>", "</s>"
USER, SYSTEM, ROLE = ("[INST]", "[/INST]"), ("[SYS]", "[/SYS]"), ("[ROLE]", "[/ROLE]")
CONTROL = r"/?s>|/?INST\]|/?SYS\]|/?ROLE\]"
#: The role whose texts are learned from.
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    """The text with backslashes doubled, and one after the first sign of each control string."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), rf"([<\[])(?={CONTROL})", r"$1\\")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def ancestors(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """((id, depth, total), hops): each message's path length and summed scores, and for k = 0, 1, ...
    the table (id, up) of the messages that have an ancestor 2 ** k above.

    ``messages``: (id, parent, score), ids unique.  A parent that isn't in the table
    makes a root.  Messages in or below a cycle have no root and are left out.
    """
    known = messages.select(F.col("id").alias("up"))
    replies = messages.where("parent is not null").join(known, F.col("parent") == F.col("up"), "left")
    first = messages.where("parent is null").withColumn("up", F.lit(None).cast("long"))  # not joined: all would meet in one task
    state = replies.unionByName(first).select("id", "up", F.lit(1).cast("long").alias("depth"), F.coalesce("score", F.lit(0.0)).alias("total"))
    state, hops, longest = checkpoint(state), [], 1
    n = state.count()
    while longest <= n and state.where("up is not null").limit(1).count():
        going = state.where("up is not null")
        hops.append(going.select("id", "up"))
        above = state.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"), F.col("total").alias("gain"))
        jumped = going.join(above, "up").select("id", F.col("up2").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("total") + F.col("gain")).alias("total"))
        state = checkpoint(state.where("up is null").unionByName(jumped))
        longest *= 2
    return state.where("up is null").drop("up"), hops


def best_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, branch, leaf, pos, id): the ``top`` branches of each tree, every message of them.

    ``messages``: (tree, id, parent, score).  Branches rank by mean score (a null
    score is 0), ties by length, the longer first, then by the leaf's id; ``branch``
    counts from 1, ``pos`` from 0 at the root.  An empty table gives an empty one.
    """
    depths, hops = ancestors(messages)
    leaves = messages.select("tree", "id").join(messages.select(F.col("parent").alias("id")).where("id is not null"), "id", "left_anti").join(depths, "id")
    order = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("depth")), F.desc("depth"), "id")
    chosen = leaves.withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= top)
    found = checkpoint(chosen.select("tree", "branch", F.col("id").alias("leaf"), "depth", "id", F.lit(0).cast("long").alias("back")))
    for k, hop in enumerate(hops):
        further = found.join(hop, "id").select("tree", "branch", "leaf", "depth", F.col("up").alias("id"), (F.col("back") + (1 << k)).alias("back"))
        found = checkpoint(found.unionByName(further))
    return found.select("tree", "branch", "leaf", (F.col("depth") - 1 - F.col("back")).alias("pos"), "id")


def written(turns: DataFrame) -> DataFrame:
    """(tree, branch, leaf, page, n_turns, text, spans) of (tree, branch, leaf, pos, role, text).

    Pages hold up to PAGE_TURNS turns in order; a path is the text of its pages one
    after another.  ``spans`` are (start, stop) in code points of its page around each
    escaped text of the role that is learned from.  Null roles and texts are empty.
    """
    role, text = F.coalesce("role", F.lit("")), escaped(F.coalesce("text", F.lit("")))
    opened = F.when(role == "user", USER[0] + " ").when(role == "system", SYSTEM[0] + " ").when(role == LEARNED, " ")
    opened = opened.otherwise(F.concat(F.lit(ROLE[0] + " "), escaped(role), F.lit(f" {ROLE[1]} ")))
    closed = F.when(role == "user", " " + USER[1]).when(role == "system", " " + SYSTEM[1]).otherwise(END)
    opened = F.concat(F.when(F.col("pos") == 0, START).otherwise(""), opened)
    part = turns.select("tree", "branch", "leaf", "pos", F.floor(F.col("pos") / PAGE_TURNS).alias("page"), opened.alias("o"), text.alias("t"), closed.alias("c"), (role == LEARNED).alias("learned"))
    part = part.select("tree", "branch", "leaf", "pos", "page", F.concat("o", "t", "c").alias("s"), F.length("o").alias("from"), F.length("t").alias("long"), F.length("c").alias("tail"), "learned")
    pages = part.groupBy("tree", "branch", "leaf", "page").agg(F.array_sort(F.collect_list(F.struct("pos", "s", "from", "long", "tail", "learned"))).alias("x"))
    sizes = F.transform("x", lambda x: x["from"] + x["long"] + x["tail"])
    begins = lambda i: F.aggregate(F.slice("sizes", F.lit(1), i), F.lit(0), lambda a, b: a + b)
    spans = F.transform("x", lambda x, i: F.struct(x["learned"].alias("learned"), (begins(i) + x["from"]).alias("start"), (begins(i) + x["from"] + x["long"]).alias("stop")))
    spans = F.transform(F.filter(spans, lambda s: s["learned"]), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))
    whole = F.array_join(F.transform("x", lambda x: x["s"]), "")
    return pages.withColumn("sizes", sizes).select("tree", "branch", "leaf", "page", F.size("x").cast("long").alias("n_turns"), whole.alias("text"), spans.alias("spans"))


def formatted(messages: DataFrame, top: int = 1) -> DataFrame:
    """Pages (see :func:`written`) of the ``top`` branches of each reply tree.

    ``messages``: (tree, id, parent, score, role, text) and any other columns.  Of
    repeated ids the least (parent, role, text) counts; rows without an id are left
    out; a null tree is a tree.
    """
    own = messages.where("id is not null").select("tree", "id", "parent", "score", "role", "text")
    own = own.groupBy("id").agg(F.min(F.struct("parent", "role", "text", "tree", "score")).alias("x")).select("id", "x.*")
    chosen = best_paths(own.select("tree", "id", "parent", "score"), top)
    return written(chosen.join(own.select("id", "role", "text"), "id"))


def turns_of(page: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn on a page, read back from its marks."""
    at = len(START) if page.startswith(START) else 0
    while at < len(page):
        for name, (opened, closed) in (("user", USER), ("system", SYSTEM)):
            if page.startswith(opened, at):
                end = page.index(" " + closed, at)
                yield name, unescaped(page[at + len(opened) + 1 : end])
                at = end + 1 + len(closed)
                break
        else:
            name, at = (LEARNED, at + 1) if page[at] == " " else (None, at + len(ROLE[0]) + 1)
            if name is None:
                end = page.index(f" {ROLE[1]} ", at)
                name, at = unescaped(page[at:end]), end + len(ROLE[1]) + 2
            end = page.index(END, at)
            yield name, unescaped(page[at:end])
            at = end + len(END)


class ReadBack:
    """Counts and digests of a path's turns and learned texts, from its pages."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, row: dict) -> None:
        for role, text in turns_of(row["text"]):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        for span in row["spans"]:
            text = unescaped(row["text"][span["start"] : span["stop"]])
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        self.chars += len(row["text"])

    def result(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


READ = T.StructType(
    [
        T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()),
        T.StructField("formatted_chars", T.LongType()),
    ]
)


def read_back(pages: DataFrame) -> DataFrame:
    """(tree, branch, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each path, read from its pages in order."""
    return fold_sorted(pages.select("tree", "branch", "page", "text", "spans"), ["tree", "branch"], ["page"], ReadBack, READ)
