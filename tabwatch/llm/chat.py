"""Chat formatting of reply trees.

Messages form trees. Self-joins enumerate root-to-leaf paths by doubling: step k
links every message to its 2**k-th ancestor and sums depth and score on the way, so a
thread of length n takes log2(n) joins, and only ids and numbers travel. Branches are
ranked by score; for each chosen one the stored steps are walked back from its leaf,
and the path's messages are formatted as one conversation.

Template: ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a newline per turn. In
roles and texts a backslash is doubled and ``<|`` becomes ``<\\|``; so no control
string survives inside them and the escape can be undone. A conversation is also
given as segments with a loss flag, set on assistant texts only; joined they are the
formatted string.

Only DataFrame operations are used. A conversation is one row, so one task holds it
whole; nothing else is gathered by tree.

Defined results: null roles and texts are empty; a message whose parent is missing is
a root; messages on a cycle of parents are on no path and are left out; messages with
equal ids in a tree are merged into the first by role and text; null scores are 0;
ties go to the smaller leaf id; an empty table gives no conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwatch.session import materialize

# The template's control strings and the trained role.
START, SEP, END, NEWLINE = "<|im_start|>", "<|im_sep|>", "<|im_end|>", "\n"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _climb(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, node, depth, total) of every message under a root, and the steps
    (tree, node, up) to the 2**k-th ancestor."""
    ids = messages.select("tree", "node", "parent", "score")
    known = ids.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    state = materialize(ids.join(known, ["tree", "parent"], "left").select(
        "tree", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total")))
    limit = max(1, state.count()).bit_length() + 1
    done, steps = [state.where("up is null").drop("up")], []
    for _ in range(limit):
        climbing = state.where("up is not null")
        if not climbing.limit(1).count():
            break
        steps.append(climbing.select("tree", "node", "up"))
        above = state.select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("total").alias("extra"))
        # those that reached a root before are in `done`; the others look them up there
        finished = done[0]
        for d in done[1:]:
            finished = finished.unionByName(d)
        there = above.where("next is not null").unionByName(finished.select("tree", F.col("node").alias("up"), F.lit(None).cast(above.schema["next"].dataType).alias("next"), F.col("depth").alias("more"), F.col("total").alias("extra")))
        state = materialize(climbing.join(there, ["tree", "up"]).select("tree", "node", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("total") + F.col("extra")).alias("total")))
        done.append(state.where("up is null").drop("up"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out, steps


def paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """(tree, leaf, rank, node, from_leaf): messages of each tree's best branches."""
    rooted, steps = _climb(messages)
    parents = messages.select("tree", F.col("parent").alias("node")).where("node is not null").distinct()
    order = Window.partitionBy("tree").orderBy(F.col("total").desc(), "leaf")
    leaves = rooted.join(parents, ["tree", "node"], "left_anti").withColumnRenamed("node", "leaf")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    found = materialize(chosen.select("tree", "leaf", "rank", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("from_leaf")))
    for k, step in enumerate(steps):
        up = found.join(step, ["tree", "node"]).select("tree", "leaf", "rank", F.col("up").alias("node"), (F.col("from_leaf") + (1 << k)).alias("from_leaf"))
        found = materialize(found.unionByName(up))
    return found


def format_trees(messages: DataFrame, best: int = 1) -> DataFrame:
    """(tree, leaf, rank, formatted, segments) from messages (tree, node, parent,
    role, text, score)."""
    clean = messages.select("tree", "node", "parent", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    order = Window.partitionBy("tree", "node").orderBy("role", "text", "parent")
    clean = materialize(clean.withColumn("copy", F.row_number().over(order)).where("copy = 1").drop("copy"))
    turn = F.struct((-F.col("from_leaf")).alias("place"), escape(F.col("role")).alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == TRAINED).alias("loss"))
    rows = paths(clean, best).join(clean.select("tree", "node", "role", "text"), ["tree", "node"])
    convs = rows.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    segments = F.flatten(F.transform("turns", lambda t: F.array(
        F.struct(F.concat(F.lit(START), t.head, F.lit(SEP)).alias("text"), F.lit(False).alias("loss")),
        F.struct(t.body.alias("text"), t.loss.alias("loss")),
        F.struct(F.lit(END + NEWLINE).alias("text"), F.lit(False).alias("loss")))))
    return convs.select("tree", "leaf", "rank", segments.alias("segments")).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s.text), ""))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) read back from a formatted conversation."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p.startswith(START))
    return F.transform(parts, lambda p: F.struct(
        unescape(F.split_part(F.substr(p, F.lit(len(START) + 1)), F.lit(SEP), F.lit(1))).alias("role"),
        unescape(F.split_part(p, F.lit(SEP), F.lit(2))).alias("text")))


def conversations_as_trees(conversations: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as trees: each row replies to
    the one before it by turn, then role and text. The tree id is the conv_id as text."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("node", place.cast("long")).select(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def digests(formatted: DataFrame) -> DataFrame:
    """What the contract asks for, read back from formatted conversations."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    trained = F.array_join(F.transform(F.filter("segments", lambda s: s.loss), lambda s: unescape(s.text)), "")
    return formatted.withColumn("turns", read_turns(F.col("formatted"))).withColumn("trained", trained).select(
        F.when(F.col("tree") != "null", F.col("tree")).cast("long").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"), F.sha2(F.col("trained").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
