"""Reply trees to conversations: root-to-leaf paths by iterative self-joins, ranked branches, one text for each chosen path.

Messages of a conversation form trees through their parents.  Where the table has no ``parent``
column, a message answers the latest earlier message of another role, so
messages of one role in a row are alternative replies to one message.

Paths are enumerated from the leaves by doubling: round ``k`` joins every (leaf, ancestor) row with the
table of ``2**k``-step ancestors and joins that table with itself, so a path of ``d`` messages
takes ``log2(d)`` rounds.  Only identifiers move until paths are chosen.  Rounds are cut
in the shared checkpoint folder.

A branch's score is the sum over its messages of ``score`` (where the table has that column)
or else of their lengths in characters; in each conversation the ``keep`` best branches stay.

Defined results
  * null conv_id or turn: ignored.  Null role: ``unknown``; null text: empty; null score: 0.
  * an identifier or score of another type counts as the number that it spells, or else as null.
  * repeated rows of one (conv_id, turn): the one with the least (role, text, parent, score) stays.
  * a parent that is null, is no message of the conversation or is the message itself: a root.
  * messages whose ancestry runs in a circle have no root and are on no path.
  * ties of score: the longer path, then the lesser leaf turn.
  * marks in a text that look like the format's own are broken by a space, so a text can't end its message.
  * empty table: empty result.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def single_rows(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text[, parent][, score])`` with one row of each (conv_id, turn).

    Only identifiers move to find repeated rows; texts move only if there are any.
    """
    have = conversations.columns
    base = conversations.select(
        F.col("conv_id").try_cast("bigint").alias("conv_id"), F.col("turn").try_cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *([F.col("parent").try_cast("bigint").alias("parent")] if "parent" in have else []),
        *([F.col("score").try_cast("double").alias("score")] if "score" in have else []),
    ).filter("conv_id is not null and turn is not null")
    again = cut(base.groupBy("conv_id", "turn").count().filter("count > 1").select("conv_id", "turn"))
    if again.isEmpty():
        return base
    rest = [c for c in base.columns if c not in ("conv_id", "turn")]
    least = base.join(again, ["conv_id", "turn"], "left_semi").groupBy("conv_id", "turn").agg(F.min(F.struct(*rest)).alias("m")).select("conv_id", "turn", "m.*")
    return base.join(again, ["conv_id", "turn"], "left_anti").unionByName(least)


def messages(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, parent, score)`` of single rows; parents that name nothing are null."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    score = F.coalesce("score", F.lit(0.0)) if "score" in rows.columns else F.char_length("text").cast("double")
    if "parent" not in rows.columns:
        turns = rows.select("conv_id", "turn", "role", score.alias("score")).withColumn("_jump", F.when(F.lag("role").over(order) != F.col("role"), F.lag("turn").over(order)))
        return turns.select("conv_id", "turn", F.last("_jump", ignorenulls=True).over(order).alias("parent"), "score")
    known = rows.select("conv_id", F.col("turn").alias("parent"), F.lit(True).alias("_known"))
    fits = F.col("_known") & (F.col("parent") != F.col("turn"))
    met = rows.select("conv_id", "turn", "parent", score.alias("score")).join(known, ["conv_id", "parent"], "left")
    return met.select("conv_id", "turn", F.when(fits, F.col("parent")).alias("parent"), "score")


def paths(nodes: DataFrame) -> DataFrame:
    """``(conv_id, leaf, node, up)``: every message above each leaf, ``up`` steps away, for leaves that reach a root.

    ``nodes``: ``(conv_id, turn, parent)``.
    """
    edges = cut(nodes.select("conv_id", "turn", "parent"))
    jump = edges.filter("parent is not null").select("conv_id", F.col("turn").alias("node"), F.col("parent").alias("to"))
    parents = jump.select("conv_id", F.col("to").alias("turn")).distinct()
    found = edges.join(parents, ["conv_id", "turn"], "left_anti").select("conv_id", F.col("turn").alias("leaf"), F.col("turn").alias("node"), F.lit(0).alias("up"))
    longest = edges.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    step = 1
    while step < longest:  # a longer way than all messages runs in a circle
        more = found.join(jump, ["conv_id", "node"]).select("conv_id", "leaf", F.col("to").alias("node"), (F.col("up") + step).alias("up"))
        found = cut(found.union(more))
        ahead = jump.select("conv_id", F.col("node").alias("to"), F.col("to").alias("_far"))
        jump = cut(jump.join(ahead, ["conv_id", "to"]).select("conv_id", "node", F.col("_far").alias("to")))
        if jump.isEmpty():
            break
        step *= 2
    roots = edges.filter("parent is null").select("conv_id", F.col("turn").alias("node"))
    whole = found.join(roots, ["conv_id", "node"], "left_semi").select("conv_id", "leaf")
    return found.join(whole, ["conv_id", "leaf"], "left_semi")


def conversations_of(conversations: DataFrame, keep: int = 2) -> DataFrame:
    """``(conv_id, leaf, rank, n_messages, score, text)``: the ``keep`` best branches of each conversation, each formatted from its root to its leaf."""
    if keep < 1:
        raise ValueError("keep must be positive")
    rows = single_rows(conversations)
    nodes = cut(messages(rows))
    steps = cut(paths(nodes))
    scored = steps.join(nodes.select("conv_id", F.col("turn").alias("node"), "score"), ["conv_id", "node"])
    # sums are exact for whole numbers; rounding keeps others free of the order of addition
    branches = scored.groupBy("conv_id", "leaf").agg(F.count("*").cast("int").alias("n_messages"), F.round(F.sum("score"), 6).alias("score"))
    best = Window.partitionBy("conv_id").orderBy(F.desc("score"), F.desc("n_messages"), "leaf")
    chosen = branches.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= keep)
    wanted = steps.join(chosen, ["conv_id", "leaf"]).withColumnRenamed("conv_id", "_conv")
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    turn = F.concat(F.lit("<|"), safe(F.col("role")), F.lit("|>\n"), safe(F.col("text")), F.lit("<|end|>\n"))
    texts = rows.select("conv_id", F.col("turn").alias("_turn"), turn.alias("turn"))
    # the conversation alone is the join's key, so its partitions also serve the grouping and texts move once
    held = wanted.join(texts, (F.col("_conv") == F.col("conv_id")) & (F.col("node") - F.col("_turn") == 0))
    told = held.groupBy("conv_id", "leaf", "rank", "n_messages", "score").agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "turn"))).alias("turns"))
    return told.select("conv_id", "leaf", "rank", "n_messages", "score", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("text"))
