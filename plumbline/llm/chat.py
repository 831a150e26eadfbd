"""Chat formatting over reply trees, with DataFrame functions only.

Self-joins with doubling reach find, in as many rounds as the depth has binary digits, each message's
ancestors at distances 1, 2, 4, ... and the score of its path from the root. The leaves are ranked by
that score, the chosen ones walk back along the same jumps, and every chosen path becomes one
conversation. No round holds more rows than there are messages, or messages on chosen paths.

Template: ``### role: text</turn>`` and a line break for every turn. Inside texts and roles a backslash
is doubled, ``##`` becomes ``#\\#`` and ``</turn>`` becomes ``<\\/turn>``, so no control string occurs
there; in roles ``: `` becomes ``:\\ `` as well. Removing the backslash of each escape gives the text back.
``loss_spans`` are byte ranges of the assistants' escaped texts.

Defined cases: null text or role: empty. A message whose parent is missing is a root; messages on a cycle
of replies have no root and belong to no path. Equal scores: the deeper leaf wins, then the smaller id. Rows
that agree in conversation and turn are ordered by role, then text. A null conversation id is a conversation
of its own. An empty table gives no rows. One conversation must fit in a task, since it is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import let, staged

END = "</turn>"
ASSISTANT = "assistant"


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit(END), F.lit("<\\/turn>"))
    return F.replace(text, F.lit("##"), F.lit("#\\#"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def linear_messages(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
                    text: str = "text") -> DataFrame:
    """Plain conversations as reply trees: each turn answers the one before it."""
    tree = F.coalesce(F.concat(F.lit("="), turns[conversation].cast("string")), F.lit(""))
    rows = turns.select(tree.alias("tree"), turns[turn].alias("turn"), F.coalesce(turns[role], F.lit("")).alias("role"),
                        F.coalesce(turns[text], F.lit("")).alias("text"))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long")
    return rows.select("tree", place.alias("id"), "role", "text").select(
        "tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit(1.0).alias("score"), "role", "text")


def chosen_paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """tree, leaf, rank, id and distance to the leaf, for every message on the ``best`` paths of each tree."""
    links = messages.select("tree", "id", "parent", "score")
    present = messages.select(F.col("tree").alias("t"), F.col("id").alias("i"))
    rooted = links.join(present, (links["tree"] == present["t"]) & (links["parent"] == present["i"]), "left")
    reach = staged(rooted.select("tree", "id", F.col("i").alias("up"), F.lit(1).cast("long").alias("depth"), "score"), "reach")
    # A path has no more messages than its tree; whoever still climbs then is on a cycle.
    most = reach.groupBy("tree").count().agg(F.max("count")).first()[0] or 1
    ended, climbing, jumps = reach.where("up IS NULL"), reach.where("up IS NOT NULL"), []
    for _ in range(most.bit_length()):
        if climbing.isEmpty():
            break
        jumps.append(climbing.select("tree", "id", "up"))
        above = ended.unionByName(climbing).select(F.col("tree").alias("t"), F.col("id").alias("i"), F.col("up").alias("up2"),
                                                   F.col("depth").alias("d2"), F.col("score").alias("s2"))
        higher = climbing.join(above, (climbing["tree"] == above["t"]) & (climbing["up"] == above["i"]))
        reach = staged(higher.select("tree", "id", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"),
                                     (F.col("score") + F.col("s2")).alias("score")), "reach")
        # Only messages that haven't reached their root climb on.
        ended, climbing = ended.unionByName(reach.where("up IS NULL")), reach.where("up IS NOT NULL")
    answered = messages.where("parent IS NOT NULL").select(F.col("tree").alias("t"), F.col("parent").alias("i"))
    leaves = ended.join(answered, (ended["tree"] == answered["t"]) & (ended["id"] == answered["i"]), "left_anti")
    order = Window.partitionBy("tree").orderBy(F.col("score").desc(), F.col("depth").desc(), "id")
    ranked = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    walked = staged(ranked.select("tree", F.col("id").alias("leaf"), "rank", "id", F.lit(0).cast("long").alias("distance")), "walked")
    for k, jump in enumerate(jumps):
        further = walked.join(jump, ["tree", "id"]).select("tree", "leaf", "rank", F.col("up").alias("id"),
                                                           (F.col("distance") + (1 << k)).alias("distance"))
        walked = staged(walked.unionByName(further), "walked")
    return walked


def formatted(messages: DataFrame, best: int = 1, learnt_role: str = ASSISTANT) -> DataFrame:
    """One row per chosen path: tree, leaf, rank, formatted and loss_spans (start, length in UTF-8 bytes)."""
    messages = staged(messages, "messages")
    path = chosen_paths(messages, best).join(messages, ["tree", "id"])
    head = F.concat(F.lit("### "), F.replace(escaped(F.col("role")), F.lit(": "), F.lit(":\\ ")), F.lit(": "))
    turns = path.select("tree", "leaf", "rank", "distance", (F.col("role") == learnt_role).alias("learnt"), head.alias("head"),
                        escaped(F.col("text")).alias("body"))
    order = Window.partitionBy("tree", "leaf", "rank").orderBy(F.col("distance").desc())
    size = F.octet_length("head") + F.octet_length("body") + len(END) + 1
    placed = turns.withColumn("start", F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
                              + F.octet_length("head"))
    rows = placed.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("distance")).alias("place"), F.concat("head", "body", F.lit(END + "\n")).alias("piece"), "learnt", "start",
        F.octet_length("body").cast("long").alias("length")))).alias("turns"))
    return rows.select("tree", "leaf", "rank", F.array_join(F.transform("turns", lambda x: x["piece"]), "").alias("formatted"),
                       F.transform(F.filter("turns", lambda x: x["learnt"]),
                                   lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss_spans"))


def parsed(formatted_text: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.filter(F.split(formatted_text, END + "\n", -1), lambda x: x != "")
    return F.transform(pieces, lambda x: let(F.locate(": ", x), lambda p: F.struct(
        unescaped(F.substring(x, F.lit(5), p - 5)).alias("role"), unescaped(F.substring(x, p + 2, F.char_length(x))).alias("text"))))


def learnt_text(formatted_text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return let(formatted_text.cast("binary"), lambda data: F.array_join(F.transform(spans, lambda s: unescaped(
        F.substring(data, (s["start"] + 1).cast("int"), s["length"].cast("int")).cast("string"))), ""))


def read_back(conversations: DataFrame) -> DataFrame:
    """Digests of formatted conversations, taken from the formatted text and its mask alone."""
    turns = conversations.select("tree", "formatted", parsed(F.col("formatted")).alias("turns"),
                                 learnt_text(F.col("formatted"), F.col("loss_spans")).alias("learnt"))
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return turns.select("tree", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
                        F.char_length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
                        F.char_length("formatted").cast("long").alias("formatted_chars"))
