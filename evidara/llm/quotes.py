"""Chat formatting: quotation linking. Quotes are parsed, linked to the messages they are from, and left out of the chat.

DataFrame functions only. Lines that begin with > are quotes, one level a mark. Consecutive lines of one
level are a passage. Passages, their paragraphs, lines and sentences, normalised and hashed, meet the
latest earlier message of the conversation that has them; the message that most of a passage comes from is its
original, and the original of a message's outermost passages is what it replies to. Messages of a thread, in that order,
make the conversation, in rows of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidara.llm.runtime import remove, table, written

QUOTE = r"^[ \t]*((?:>[ \t]?)+)"
#: White space after the end of a sentence.
SENTENCE = r"(?<=[.!?…。！？])\s+"
#: A line that only says whose words follow.
ATTRIBUTION = r"(?i)^\s*(on|am|le|el)\b.*\b(wrote|schrieb|écrit|escribió)\s*:\s*$"

#: Turns of a thread in one row, the most messages of a row, and the most spans or turns with more that are sent to every task.
TURNS, MOST_MESSAGES, MOST_SENT = 64, 256, 100_000


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def level(line: Column) -> Column:
    marks = F.regexp_extract(line, QUOTE, 1)
    return F.length(marks) - F.length(F.translate(marks, ">", ""))


def own_lines(lines: Column) -> Column:
    """The lines that aren't quotes, without attributions that stand right before one."""

    def stays(line: Column, i: Column) -> Column:
        following = F.get(lines, i + 1)
        return ~line.rlike(QUOTE) & ~(line.rlike(ATTRIBUTION) & F.coalesce(following.rlike(QUOTE), F.lit(False)))

    return F.filter(lines, stays)


def pieces(text: Column) -> Column:
    """The text, its paragraphs, lines and their sentences, normalised, each once."""
    paragraphs, lines = F.split(text, r"\n[ \t]*\n"), F.split(text, "\n")
    some = F.transform(F.concat(F.array(text), paragraphs, lines), normalised)
    sentences = F.flatten(F.transform(some, lambda x: F.split(x, SENTENCE)))
    return F.array_distinct(F.concat(some, sentences))


def units(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, hash, norm, turn, row): the pieces of each message; of messages of one turn the last row has them."""
    some = rows.where("turn is not null").select("conv_id", "turn", "row", F.explode(pieces(F.col("body"))).alias("norm")).where("norm <> ''")
    return some.groupBy("conv_id", F.xxhash64("norm").alias("hash"), "norm", "turn").agg(F.max("row").alias("row"))


def passages(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, row, passage, level, text): quoted passages in order, from 0 in each message."""
    lines = rows.where(F.col("text").rlike("(?m)" + QUOTE)).select("conv_id", "turn", "row", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.withColumn("level", level(F.col("line"))).withColumn("line", F.regexp_replace("line", QUOTE, ""))
    message = Window.partitionBy("row").orderBy("at")
    fresh = F.coalesce((F.col("level") != F.lag("level").over(message)).cast("int"), F.lit(0))
    lines = lines.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(message))
    held = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    runs = lines.where("level > 0").groupBy("conv_id", "turn", "row", "run", "level").agg(held.alias("text"))
    return runs.withColumn("passage", F.row_number().over(Window.partitionBy("row").orderBy("run")) - 1).drop("run").where(F.trim("text") != "")


def originals(quoted: DataFrame, rows: DataFrame) -> DataFrame:
    """quoted with from_turn and from_row: the earlier message that most characters of the passage are first found in, if any.

    A passage is looked for whole, by its paragraphs, lines and sentences, each in the latest earlier message that has it.
    """
    looked = quoted.select("conv_id", F.col("turn").alias("at_turn"), F.col("row").alias("at_row"), "passage", F.explode(pieces(F.col("text"))).alias("norm")).where("norm <> '' and at_turn is not null")
    looked = looked.withColumn("hash", F.xxhash64("norm"))
    sources = rows.join(quoted.select("conv_id").distinct(), "conv_id", "left_semi")
    key = ["conv_id", "hash", "norm"]
    held = units(sources).join(looked.select(*key).distinct(), key, "left_semi").select(*key, F.col("turn").alias("at"), F.struct("turn", "row").alias("source"), F.lit(None).cast("long").alias("at_row"), F.lit(None).cast("int").alias("passage"))
    asked = looked.select(*key, F.col("at_turn").alias("at"), F.lit(None).cast(held.schema["source"].dataType).alias("source"), "at_row", "passage")
    # One row a message and one a quote of a piece, never their pairs.
    earlier = Window.partitionBy(*key).orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    found = held.union(asked).withColumn("last", F.max("source").over(earlier)).where("at_row is not null and last is not null")
    found = found.select("at_row", "passage", "norm", F.col("last.turn").alias("turn"), F.col("last.row").alias("row"))
    share = found.groupBy("at_row", "passage", "turn", "row").agg(F.sum(F.length("norm")).alias("share"))
    best = share.groupBy("at_row", "passage").agg(F.max(F.struct("share", "turn", "row")).alias("b"))
    best = best.select(F.col("at_row").alias("row"), "passage", F.col("b.turn").alias("from_turn"), F.col("b.row").alias("from_row"))
    return quoted.join(best, ["row", "passage"], "left")


def roots(replies: DataFrame) -> DataFrame:
    """Rows (row, root, root_turn, depth) of rows (row, up, up_turn), by doubling: every round looks twice as far up."""
    spark = replies.sparkSession
    now, path = written(replies.select("row", F.col("up").alias("root"), F.col("up_turn").alias("root_turn"), F.lit(1).alias("depth"), F.lit(True).alias("moved")), "replies")
    while now.where("moved").limit(1).count():
        above = now.select(F.col("row").alias("root"), F.col("root").alias("more"), F.col("root_turn").alias("more_turn"), F.col("depth").alias("further"))
        far = now.drop("moved").join(above, "root", "left")
        known = F.col("more").isNotNull()
        far = far.select("row", F.coalesce("more", "root").alias("root"), F.when(known, F.col("more_turn")).otherwise(F.col("root_turn")).alias("root_turn"), (F.col("depth") + F.coalesce("further", F.lit(0))).alias("depth"), known.alias("moved"))
        after, new = written(far, "replies")
        remove(spark, path)
        now, path = after, new
    return now.drop("moved")


def linked(messages: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) without quotes, one row each, with what they reply to.

    Columns: row (a number of its own), conv_id, turn, role, body (text without quotes and attributions), chat (role and body in chat
    marks), n_passages, max_level, n_linked, reply_to (turn of the message replied to), thread (turn of the
    first message up the replies, its own without any) and depth (replies up to it). A reply is always to
    an earlier turn of its conversation, so every message follows what it replies to. Null
    texts are empty; messages with a null conversation or turn are linked with nothing; repeated
    rows are messages each. An empty table gives none.
    """
    rows, _ = written(messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id()), "messages")
    body = F.trim(F.array_join(F.transform(F.array(F.split("text", "\n")), lambda lines: F.array_join(own_lines(lines), "\n")), ""))
    rows = rows.withColumn("body", F.when(F.col("text").rlike("(?m)" + QUOTE), body).otherwise(F.col("text")))
    quoted, _ = written(originals(passages(rows), rows.select("conv_id", "turn", "row", "body")), "passages")
    best = F.max(F.when(F.col("from_row").isNotNull(), F.struct(-F.col("level"), F.length("text"), "from_turn", "from_row"))).alias("b")
    told = quoted.groupBy("row").agg(F.count("*").alias("n_passages"), F.max("level").alias("max_level"), F.count("from_row").alias("n_linked"), best)
    told = told.select("row", "n_passages", "max_level", "n_linked", F.col("b.from_row").alias("up"), F.col("b.from_turn").alias("up_turn"))
    told, _ = written(told, "told")
    top = roots(told.where("up is not null")).select("row", "root_turn", "depth")
    out = rows.join(told, "row", "left").join(top, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    chat = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("body"), F.lit("\n<|end|>\n"))
    out = out.select("conv_id", "turn", "role", "body", chat.alias("chat"), zero("n_passages"), zero("max_level"), zero("n_linked"), F.col("up_turn").alias("reply_to"), F.coalesce("root_turn", "turn").alias("thread"), zero("depth"), "row")
    return out


def conversations(messages: DataFrame, turns: int = TURNS, most: int = MOST_MESSAGES) -> DataFrame:
    """The conversations of messages (conv_id, turn, role, text) without quotes: rows of a thread's messages in reply order.

    A reply is to an earlier turn of its thread, so the order of turns is one of replies. A row has a thread's messages of
    `turns` turns, from first_turn to last_turn; where that is more than `most` messages, those of one turn; where that is
    still more, as repeated rows may be, `most` of them or so in each part. No row holds more,
    and rows (conv_id, thread, first_turn, part) in order are the whole thread. Columns: n_messages,
    n_passages, n_linked, max_level, replies (turn, role, reply_to, depth of each message) and chat (their texts in chat
    marks). Messages without a turn are in rows of their own conversation, whose turns are null.
    """
    said, _ = written(linked(messages), "linked")
    span = F.floor(F.col("turn") / turns).cast("long")
    thread = ["conv_id", "thread", "span"]
    said = said.withColumn("span", span)
    sizes, _ = written(said.groupBy(*thread, "turn").count(), "turns")
    # Of spans and turns with more than `most` messages there is at most one in `most` messages.
    full = sizes.groupBy(*thread).agg(F.sum("count").alias("n")).where(F.col("n") > most).select(*[F.col(c).alias(f"s_{c}") for c in thread], F.lit(True).alias("full"))
    fuller = sizes.where(F.col("count") > most).select(*[F.col(c).alias(f"t_{c}") for c in ("conv_id", "thread", "turn")], F.ceil(F.col("count") / most).cast("int").alias("parts"))
    full, fuller = (F.broadcast(x) if x.count() <= MOST_SENT else x for x in (written(full, "full")[0], written(fuller, "fuller")[0]))
    met = said.join(full, [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in thread], "left").join(fuller, [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in ("conv_id", "thread", "turn")], "left")
    own_turn = F.when(F.col("full"), F.col("turn"))
    part = F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1))).cast("int")
    held = F.array_sort(F.collect_list(F.struct("turn", "row", "role", "reply_to", "depth", "chat"))).alias("m")
    out = met.groupBy("conv_id", "thread", "span", own_turn.alias("own_turn"), part.alias("part")).agg(
        F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n_messages"), F.sum("n_passages").alias("n_passages"), F.sum("n_linked").alias("n_linked"), F.max("max_level").alias("max_level"), held
    )
    replies = F.transform("m", lambda x: F.struct(x["turn"].alias("turn"), x["role"].alias("role"), x["reply_to"].alias("reply_to"), x["depth"].alias("depth")))
    return out.select("conv_id", "thread", "first_turn", "last_turn", "part", "n_messages", "n_passages", "n_linked", "max_level", replies.alias("replies"), F.array_join("m.chat", "").alias("chat"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: conversations in reply order, without quotes."""
    return conversations(table(spark, sf_dir, "conversations"))
