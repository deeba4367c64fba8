"""Chat formatting with a grammar round trip, in built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lullmap.llm.common import query, table, text_of
from lullmap.llm.winnowing import let

# Fixed values of the template: what stands before and after the text of a turn.
MARKS = {"user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>"), "system": ("<<SYS>>\n", "\n<</SYS>>\n\n")}
OTHER_OPEN, OTHER_NAMED, OTHER_CLOSE = "<<ROLE ", ">>\n", "\n<</ROLE>>\n\n"

# One turn of the grammar; what a turn holds has no closing mark of its own in it.
TURN = (
    r"(?s)<s>\[INST\] .*? \[/INST\]|<<SYS>>\n.*?\n<</SYS>>\n\n"
    r"|<<ROLE .*?>>\n.*?\n<</ROLE>>\n\n| .*? </s>"
)
# Starts of control strings, into which the escape is put after the first character.
CONTROL = r"<(?=/?s>|</?(?:SYS>>|ROLE))|\[(?=/?INST\])|>(?=>)"
ESCAPABLE = r"[\\<>\[]"


# Turns whose lengths are summed by one array expression.
TURNS = 256


def escaped(text: Column, level: int) -> Column:
    """Level 1 breaks control strings and escapes, 2 every character they are made of."""
    if level == 1:
        return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$0\\")
    return F.regexp_replace(text, ESCAPABLE, r"\\$0")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def rendered(turns: Column, level: int) -> Column:
    """Formatted text of an array of (role, text)."""

    def one(turn: Column) -> Column:
        text = escaped(turn["text"], level)
        out = F.concat(F.lit(OTHER_OPEN), escaped(turn["role"], level), F.lit(OTHER_NAMED), text, F.lit(OTHER_CLOSE))
        for role, (before, after) in MARKS.items():
            out = F.when(turn["role"] == role, F.concat(F.lit(before), text, F.lit(after))).otherwise(out)
        return out

    return F.array_join(F.transform(turns, one), "")


def parsed(formatted: Column) -> Column:
    """Turns recovered from a formatted text; null where turns do not cover it from end to end."""
    found = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0))

    def inner(turn: Column, before: str, after: str) -> Column:
        return unescaped(F.substring(turn, F.lit(len(before) + 1), F.length(turn) - len(before) - len(after)))

    def one(turn: Column) -> Column:
        name_end = F.locate(OTHER_NAMED, turn)
        text = F.substring(turn, name_end + len(OTHER_NAMED), F.length(turn) - name_end - (len(OTHER_NAMED) - 1) - len(OTHER_CLOSE))
        name = F.substring(turn, F.lit(len(OTHER_OPEN) + 1), name_end - len(OTHER_OPEN) - 1)
        out = F.struct(unescaped(name).alias("role"), unescaped(text).alias("text"))
        for role, (before, after) in MARKS.items():
            known = F.struct(F.lit(role).alias("role"), inner(turn, before, after).alias("text"))
            out = F.when(F.startswith(turn, F.lit(before)), known).otherwise(out)
        return out

    return F.when(F.array_join(found, "") == formatted, F.transform(found, one))


def loss_spans(formatted: Column) -> Column:
    """Bytes [start, end) of the assistants' texts, escapes included, in the UTF-8 of a formatted text.

    The length before a turn is that of the blocks of turns before its block and of the turns
    before it in the block.
    """
    before, after = (len(m) for m in MARKS["assistant"])
    total = lambda lengths: F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)

    def spans(turns: Column) -> Column:
        def placed(lengths: Column) -> Column:
            blocks = F.sequence(F.lit(0), F.call_function("div", F.size(lengths), F.lit(TURNS)).cast("int"))
            sums = F.transform(blocks, lambda b: total(F.slice(lengths, b * TURNS + 1, F.lit(TURNS))))
            passed = let(sums, lambda s: F.transform(blocks, lambda b: total(F.slice(s, F.lit(1), b))))

            def one(turn: Column, i: Column, passed: Column) -> Column:
                block = F.call_function("div", i, F.lit(TURNS)).cast("int")
                at = passed[block] + total(F.slice(lengths, block * TURNS + 1, i % TURNS))
                whole = F.struct((at + before).alias("start"), (at + lengths[i] - after).alias("end"))
                return F.when(F.startswith(turn, F.lit(MARKS["assistant"][0])), whole)

            each = let(passed, lambda p: F.transform(turns, lambda turn, i: one(turn, i, p)))
            return F.filter(each, lambda x: x.isNotNull())

        return let(F.transform(turns, lambda t: F.octet_length(t).cast("long")), placed)

    return let(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), spans)


def loss_text(formatted: Column, spans: Column) -> Column:
    """What the spans cover, cut out of the formatted text and unescaped, nothing between."""

    def cut(data: Column) -> Column:
        piece = lambda s: F.substring(data, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))
        return F.array_join(F.transform(spans, lambda s: unescaped(piece(s).cast("string"))), "")

    return let(formatted.cast("binary"), cut)


def format_chats(conversations: DataFrame) -> DataFrame:
    """One formatted text per conversation, read back and compared with its source.

    The control strings in every text and role are broken by an escape, so that none stands in
    a formatted text but those of the template. The result is parsed again, and where it does
    not give the same turns, every character that control strings are made of is escaped.
    Returns conv_id, turns (role, text) as read back, formatted, escape_level (1 or 2) and
    loss_spans: the bytes of the formatted text that a loss counts, those of assistants' texts.

    Null roles and texts count as empty; a null conversation id is a conversation of its own.
    Turns follow ``turn``, nulls first, and equal turns follow role and text; repeated rows are
    turns of their own. A conversation is one text by nature and so lies in one row.
    """
    turn = F.struct(
        F.col("turn"), text_of(F.col("role").cast("string")).alias("role"), text_of(F.col("text")).alias("text")
    )
    chats = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    source = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    out = chats.select("conv_id", source.alias("source"))
    fits = F.lit(None).cast("boolean")
    for level in (1, 2):
        done = F.coalesce(fits, F.lit(False))
        out = out.withColumn(f"f{level}", F.when(~done, rendered(F.col("source"), level)))
        out = out.withColumn(f"p{level}", F.when(~done, parsed(F.col(f"f{level}"))))
        out = out.withColumn(f"ok{level}", done | F.coalesce(F.col(f"p{level}") == F.col("source"), F.lit(False)))
        fits = F.col(f"ok{level}")
    level = F.when(F.col("ok1"), 1).when(F.col("ok2"), 2)
    level = F.coalesce(level, F.raise_error("a conversation does not survive its round trip").cast("int"))
    out = out.withColumn("formatted", F.coalesce("f2", "f1"))
    return out.select(
        "conv_id",
        F.coalesce("p2", "p1").alias("turns"),
        "formatted",
        level.alias("escape_level"),
        loss_spans(F.col("formatted")).alias("loss_spans"),
    )


def digests(chats: DataFrame) -> DataFrame:
    """Counts and digests of what was read back; those of the loss are of what its mask covers."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    chats = chats.withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


CONFLICT = "</s>[INST] ok [/INST]"

_SQL_ESCAPED = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({0}, '\', '\\'), '<(/?s>)', '<\\\1', 'g'),"
    r" '\[(/?INST\])', '[\\\1', 'g'), '<(</?(SYS>>|ROLE))', '<\\\1', 'g'), '>(>)', '>\\\1', 'g'), '>(>)', '>\\\1', 'g')"
)


@query(
    "op10_chat_format",
    f"""
    WITH c AS (SELECT false AS added, conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES (true, -1, 0, 'user', '{CONFLICT}'), (true, -1, 1, 'assistant', '{CONFLICT}')),
    f AS (SELECT *, {_SQL_ESCAPED.format('text')} AS body, {_SQL_ESCAPED.format('role')} AS name FROM c)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      CAST(length(coalesce(string_agg(text, '') FILTER (role = 'assistant'), '')) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      CAST(sum(length(body) + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 WHEN 'system' THEN 19 ELSE length(name) + 22 END) AS BIGINT)
        AS formatted_chars
    FROM f GROUP BY added, conv_id
    """,
)
def op10_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    """A table that has a conversation -1 of its own keeps it, beside the added one."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    conflict = spark.range(2).select(
        F.lit(-1).cast(rows.schema["conv_id"].dataType).alias("conv_id"),
        F.col("id").cast(rows.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONFLICT).alias("text"),
    )
    return digests(format_chats(rows)).unionByName(digests(format_chats(conflict)))
