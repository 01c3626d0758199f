"""Conversations in reply order, without quotes.

A line that starts with ``>`` marks is quoted, as many levels deep as there are
marks.  A passage is a run of lines of one level.  Its text without the marks,
A-Z in lower case and with single spaces, is hashed and looked up among the
messages of the same conversation: whole messages, blocks between blank or
quoted lines, and single lines, all without what they quote themselves.  The
earliest message that holds it is its original; a passage found nowhere is
looked up by its first line.  Quotes of later messages or of oneself are no
links.

A message replies to the original of its first linked passage of the lowest
level.  Replies to replies form a thread, known by its first turn; threads
follow each other by first turn, their messages by turn, so a reply comes after
what it quotes.

The index of a conversation has one row per hash, summed up in the tasks first,
so neither a conversation that holds a third of all messages nor a passage that
everybody quotes meets in one task.

Null texts have no lines; a null ``conv_id`` is a conversation of its own; rows
without ``turn`` quote and are quoted by nobody.  Repeated rows stay, and rows
that share a turn share its link.  Extra columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventweir.llm.text import lower_ascii
from eventweir.session import written_table

QUOTED = r"^[ \t]*>"
MARKS = r"^((?:[ \t]*>)*)"
MADE = ("own_text", "reply_to", "thread", "n_passages", "n_linked")


def normal(line: Column) -> Column:
    return F.btrim(F.regexp_replace(lower_ascii(line), r"[\x20\x09-\x0D]+", " "))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def without_quotes(text: Column) -> Column:
    """The lines that are not quoted."""
    return F.array_join(F.filter(lines(text), lambda line: ~line.rlike(QUOTED)), "\n")


def passages(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """Quoted passages: ``conv, turn, message`` (a hash of its text), ``passage``
    (its number in the message), ``level, body`` (normalised), ``first_line``."""
    rows = messages.select(F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), F.col(text).alias("text"))
    rows = rows.where(F.col("text").rlike(r"(?m)" + QUOTED) & F.col("turn").isNotNull())
    rows = rows.withColumn("message", F.xxhash64("text")).dropDuplicates(["conv", "turn", "message"])
    rows = rows.select("conv", "turn", "message", F.posexplode(lines(F.col("text"))).alias("line_no", "line"))
    marks = F.regexp_extract("line", MARKS, 1)
    rows = rows.withColumns(
        {"level": F.length(F.regexp_replace(marks, "[^>]", "")), "body": normal(F.regexp_replace("line", MARKS, ""))}
    )
    in_message = Window.partitionBy("conv", "turn", "message").orderBy("line_no")
    starts = F.coalesce(F.col("level") != F.lag("level").over(in_message), F.lit(True))
    rows = rows.withColumn("run", F.sum(starts.cast("int")).over(in_message)).where("level > 0 and body != ''")
    runs = rows.groupBy("conv", "turn", "message", "run", "level").agg(F.array_sort(F.collect_list(F.struct("line_no", "body"))).alias("parts"))
    bodies = F.transform("parts", lambda p: p["body"])
    runs = runs.select("conv", "turn", "message", "run", "level", F.array_join(bodies, "\n").alias("body"), F.get(bodies, F.lit(0)).alias("first_line"))
    return runs.withColumnRenamed("run", "passage")


def originals(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """``conv, hash, first_turn``: the earliest message that holds a text as a
    whole, as a block or as a line."""
    rows = messages.select(F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), lines(F.col(text)).alias("lines"))
    rows = rows.where(F.col("turn").isNotNull())
    # Quoted lines become blank ones: they end a block.
    own = F.transform("lines", lambda line: F.when(line.rlike(QUOTED), F.lit("")).otherwise(normal(line)))
    rows = rows.select("conv", "turn", F.array_join(own, "\n").alias("own"))
    whole = F.btrim(F.regexp_replace("own", "\n\n+", "\n"), F.lit("\n"))
    blocks, single = F.split("own", "\n\n+"), F.split("own", "\n")
    units = F.transform(F.concat(F.array(whole), blocks, single), lambda unit: F.btrim(unit, F.lit("\n")))
    rows = rows.select("conv", "turn", F.explode(F.array_distinct(units)).alias("unit")).where("unit != ''")
    return rows.groupBy("conv", F.md5("unit").alias("hash")).agg(F.min("turn").alias("first_turn"))


def quote_links(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """Every passage with ``original``, the turn it comes from, null if it is not found."""
    messages = messages.select(conv_id, turn, text)  # other columns may have any names
    found = written_table(passages(messages, conv_id, turn, text), "passages")
    quoting = found.select(F.col("conv").alias("its_conv")).distinct()
    with_quotes = messages.join(quoting, F.col(conv_id).eqNullSafe(F.col("its_conv")), "left_semi")
    index = originals(with_quotes, conv_id, turn, text)
    looked_up = found.select("*", F.posexplode(F.array(F.md5("body"), F.md5("first_line"))).alias("try", "sought"))
    index = index.withColumnRenamed("conv", "its_conv")
    here = F.col("conv").eqNullSafe(F.col("its_conv")) & (F.col("sought") == F.col("hash"))
    hits = looked_up.join(index, here & (F.col("first_turn") < F.col("turn")), "left")
    # The whole passage counts before its first line.
    best = F.min(F.when(F.col("first_turn").isNotNull(), F.struct("try", "first_turn")))
    keys = ["conv", "turn", "message", "passage", "level", "body"]
    return hits.groupBy(*keys).agg(best["first_turn"].alias("original"))


def threads(links: DataFrame) -> DataFrame:
    """First turn of the thread of every replying turn: ``conv, turn, reply_to, thread``.

    Replies point to earlier turns, so following two steps at a time ends after
    as many rounds as the longest chain has binary digits."""
    first = F.min(F.when(F.col("original").isNotNull(), F.struct("level", "passage", "original")))
    replies = links.groupBy("conv", "turn").agg(first["original"].alias("reply_to")).where("reply_to is not null")
    state = written_table(replies.withColumn("thread", F.col("reply_to")), "threads")
    while True:
        above = state.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("thread").alias("further"))
        joined = state.join(above, F.col("conv").eqNullSafe(F.col("c")) & (F.col("thread") == F.col("t")), "left")
        if not joined.where("further is not null").take(1):
            return state
        state = written_table(joined.select("conv", "turn", "reply_to", F.coalesce("further", "thread").alias("thread")), "threads")


def conversations(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """The messages sorted by conversation, thread and turn, with the columns
    ``own_text`` (without quotes), ``reply_to``, ``thread``, ``n_passages`` and ``n_linked``."""
    links = written_table(quote_links(messages, conv_id, turn, text), "quote-links")
    counts = links.groupBy("conv", "turn", "message").agg(F.count("*").alias("n_passages"), F.count("original").alias("n_linked"))
    per_turn = threads(links)
    counts = counts.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("message").alias("m"), "n_passages", "n_linked")
    per_turn = per_turn.select(F.col("conv").alias("c2"), F.col("turn").alias("t2"), "reply_to", "thread")
    kept = [c for c in messages.columns if c not in MADE]
    rows = messages.select(F.struct(*kept).alias("row"), F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), F.col(text).alias("text"))
    rows = rows.withColumn("message", F.xxhash64("text"))
    rows = rows.join(counts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("t")) & (F.col("message") == F.col("m")), "left")
    rows = rows.join(per_turn, F.col("conv").eqNullSafe(F.col("c2")) & (F.col("turn") == F.col("t2")), "left")
    result = rows.select(
        *[F.col("row")[c].alias(c) for c in kept],
        without_quotes(F.col("text")).alias("own_text"),
        "reply_to",
        F.coalesce("thread", "turn").alias("thread"),
        F.coalesce("n_passages", F.lit(0)).alias("n_passages"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
    )
    order = [conv_id, "thread", turn]
    return result.repartitionByRange(*order).sortWithinPartitions(*order)


def with_quotes(messages: DataFrame, depth: int = 3, conv_id: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """The messages as a mail program would have sent them: turn ``t`` starts
    with its ``t % depth`` predecessors in the conversation, the one ``j`` turns
    before quoted with ``j`` marks, oldest first.

    Of rows that share a turn the largest text is quoted; null texts, and
    messages without turn or conversation, quote and are quoted by nobody."""
    said = messages.where(F.col(text).isNotNull()).groupBy(F.col(conv_id).alias("_its_conv"), F.col(turn).alias("_its_turn"))
    said = said.agg(F.max(text).alias("_said"))
    rows = messages
    for level in range(1, depth):
        marks = ">" * level + " "
        quoted = F.concat(F.lit(marks), F.regexp_replace("_said", "\n", "\n" + marks))
        before = said.select("_its_conv", "_its_turn", quoted.alias(f"_quoted_{level}"))
        asks = F.when(F.pmod(F.col(turn), F.lit(depth)) >= level, F.col(turn) - level)
        here = (F.col(conv_id) == F.col("_its_conv")) & (asks == F.col("_its_turn"))
        rows = rows.join(before, here, "left").drop("_its_conv", "_its_turn")
    quotes = [F.col(f"_quoted_{level}") for level in range(depth - 1, 0, -1)]
    full = F.when(F.col(text).isNotNull(), F.concat_ws("\n", *quotes, F.col(text)))
    return rows.withColumn(text, full).select(*messages.columns)
