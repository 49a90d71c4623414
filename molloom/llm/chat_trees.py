"""Chat formatting of reply trees, in DataFrame functions only.

Messages name the one that they answer. Root-to-leaf paths are enumerated by iterative self-joins: tables of the 2, 4, 8,
... times parent of a message double each other, and a leaf's path doubles with them, so long threads take as many rounds
as their length has bits. The branches of a tree are ranked by the scores along their paths; each chosen path is formatted as one
conversation.

A conversation is an array of segments (text, loss). Joined they are the formatted text:

    <s>{role}[INST] {text} [/INST]</s>      a turn that is read
    <s>assistant\n{text}</s>                a turn that is learned; the loss covers {text} alone

In roles and texts a backslash stands before a backslash and within each of the four control strings, so that none of them
occurs but as a mark; unescaped() takes these backslashes away, and read_turns() reads roles and texts back.

Null role and text are empty. A message whose parent is null or missing is a root. Ids are unique; messages on a cycle
of parents, or below one, have no root and are in no path. Missing scores count as 0, equal ones go by id. No row gives none.
One conversation is one row of the output, so its whole text passes through one task; all else is dealt by message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molloom.operators.transform import number_rows

from .common import stored, table

ASSISTANT = "assistant"
MARKS = ["<s>", "</s>", "[INST]", "[/INST]"]


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in MARKS:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def reply_paths(messages: DataFrame, best: int | None = None) -> DataFrame:
    """messages (id, parent, score): (leaf, id, up), a row for each message of each chosen path, up steps above the leaf.

    best: so many paths of each tree, those with the highest sum of scores; all by default.
    """
    nodes = stored(messages.select("id", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")))
    n = nodes.count()
    step = stored(nodes.select("id", "parent").join(nodes.select(F.col("id").alias("of")), F.col("parent") == F.col("of")).select("id", F.col("parent").alias("above")))
    leaves = nodes.select("id").join(step.select("above").distinct(), F.col("id") == F.col("above"), "left_anti")
    jumps, k = [], 0
    while step.limit(1).count():
        if 1 << k > n:  # more ancestors than messages: a cycle
            leaves = leaves.join(step.select(F.col("id").alias("round")), F.col("id") == F.col("round"), "left_anti")
            break
        jumps.append(step)
        step = stored(step.join(step.toDF("of", "higher"), F.col("above") == F.col("of")).select("id", F.col("higher").alias("above")))
        k += 1
    paths = stored(leaves.select(F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("up")))
    for k, jump in enumerate(jumps):
        more = paths.join(jump.toDF("of", "above"), F.col("id") == F.col("of")).select("leaf", F.col("above").alias("id"), (F.col("up") + (1 << k)).alias("up"))
        paths = stored(paths.unionByName(more))
    if best is None:
        return paths
    scored = paths.join(nodes.select(F.col("id").alias("of"), "score"), F.col("id") == F.col("of")).groupBy("leaf").agg(F.sum("score").alias("score"), F.max_by("id", "up").alias("root"))
    w = Window.partitionBy("root").orderBy(F.col("score").desc(), "leaf")
    chosen = scored.withColumn("n", F.row_number().over(w)).where(F.col("n") <= best).select(F.col("leaf").alias("picked"))
    return paths.join(chosen, F.col("leaf") == F.col("picked"), "left_semi")


def segments(role: Column, text: Column) -> Column:
    """A turn's segments."""
    learned = role == ASSISTANT
    start = F.when(learned, F.lit(f"<s>{ASSISTANT}\n")).otherwise(F.concat(F.lit("<s>"), escaped(role), F.lit("[INST] ")))
    end = F.when(learned, F.lit("</s>")).otherwise(F.lit(" [/INST]</s>"))
    one = lambda c, loss: F.struct(c.alias("text"), loss.alias("loss"))
    return F.array(one(start, F.lit(False)), one(escaped(text), learned), one(end, F.lit(False)))


def formatted(messages: DataFrame, best: int | None = None) -> DataFrame:
    """messages (id, parent, role, text, score): (leaf, segments) of each chosen path, from its root."""
    paths = reply_paths(messages, best)
    turns = messages.select(F.col("id").alias("of"), segments(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).alias("turn"))
    rows = paths.join(stored(turns), F.col("id") == F.col("of")).select("leaf", F.struct((-F.col("up")).alias("at"), "turn").alias("t"))
    full = rows.groupBy("leaf").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return full.select("leaf", F.flatten(F.transform("t", lambda t: t["turn"])).alias("segments"))


def whole(segments: Column) -> Column:
    """The formatted text."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def under_loss(segments: Column) -> Column:
    """The text that the loss covers, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def read_turns(text: Column) -> Column:
    """The turns (role, text) of a formatted text."""
    parts = F.split(text, "</s>")

    def turn(p: Column) -> Column:
        at = F.instr(p, "[INST] ")
        shown = F.struct(unescaped(p.substr(F.lit(4), at - 4)).alias("role"), unescaped(p.substr(at + 7, F.length(p) - at - 14)).alias("text"))
        learned = F.struct(F.lit(ASSISTANT).alias("role"), unescaped(p.substr(F.lit(5 + len(ASSISTANT)), F.length(p))).alias("text"))
        return F.when(at > 0, shown).otherwise(learned)

    return F.transform(F.slice(parts, 1, F.size(parts) - 1), turn)


def threads(conversations: DataFrame) -> DataFrame:
    """Conversations as reply trees of one branch: (id, parent, conv_id, role, text, score).

    Rows of a conversation, null conv_id as well, go by turn (null first), then role, then SHA-256 of the text; each answers the one before.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = stored(number_rows(rows.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256)), ["conv_id", "turn", "role", "sha"], "id"))
    before = rows.select((F.col("id") + 1).alias("next"), F.col("conv_id").alias("of_conv"), F.col("id").alias("parent"))
    tied = rows.join(before, (F.col("id") == F.col("next")) & F.col("conv_id").eqNullSafe(F.col("of_conv")), "left")
    return stored(tied.select("id", "parent", "conv_id", "role", "text", F.lit(0.0).alias("score")))


def op13_chat_trees(spark, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    control = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(control).alias("text"))
    messages = threads(given.unionByName(more))
    out = formatted(messages).join(messages.select("id", "conv_id"), F.col("leaf") == F.col("id")).select("conv_id", "segments")
    read = stored(out).select("conv_id", whole(F.col("segments")).alias("text"), under_loss(F.col("segments")).alias("learned"))
    turns = read.select("*", read_turns(F.col("text")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(said).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), sha(F.col("learned")).alias("loss_sha256"), F.length("text").cast("long").alias("formatted_chars"))


# the digests of the original turns; lengths by counting what the template and its escapes add
OP13_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') r, coalesce(text, '') x FROM conversations UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
e AS (SELECT *, r = 'assistant' a, length(x) + len(regexp_extract_all(x, '\\|</?s>|\[/?INST\]')) n, length(r) + len(regexp_extract_all(r, '\\|</?s>|\[/?INST\]')) m FROM c)
SELECT conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, sha256(x))) turns_sha256,
  coalesce(sum(length(x)) FILTER (a), 0)::BIGINT loss_chars, sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, r, sha256(x)) FILTER (a), '')) loss_sha256, sum(n + CASE WHEN a THEN 17 ELSE m + 22 END)::BIGINT formatted_chars
FROM e GROUP BY conv_id
"""
