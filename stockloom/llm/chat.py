"""Chat formatting by grammar round trip (operator 4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import let

#: The template: each turn is [INST], its role, a line end, its text, [/INST], and after an assistant's text </s> instead.
OPEN, LINE, CLOSE, END = "[INST]", "\n", "[/INST]", "</s>"
#: Escapes. "\" stands before what would read as markup; the parser takes it away again.
ESCAPES = (("\\", "\\\\"), (OPEN, "[\\INST]"), (CLOSE, "[\\/INST]"), (END, "<\\/s>"))
#: A role holds no "[", so that a match starts nowhere but at a turn's own mark and no text is read twice.
TURN = r"\[INST\]([^\n\[]*+)\n((?s:.*?))(?:\[/INST\]|</s>)"
#: In roles, "%", line ends and "[" are escaped by their code.
ROLE_ESCAPES = (("%", "%25"), ("\n", "%0A"), ("[", "%5B"))
TURNS = "array<struct<turn:bigint,role:string,text:string,level:int>>"


def escaped(text: Column, level: Column) -> Column:
    """Level 0: as it is. Level 1: escape characters and markup are escaped."""
    full = text
    for plain, safe in ESCAPES:
        full = F.replace(full, F.lit(plain), F.lit(safe))
    return F.when(level == 0, text).otherwise(full)


def unescaped(text: Column) -> Column:
    """Takes back what escaped() does at level 1. The pairs are read from left to right."""
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"\\(\\)|(\[)\\(/?INST\])|(<)\\(/s>)", "$1$2$3$4$5")).otherwise(text)


def role_mark(role: Column) -> Column:
    for plain, safe in ROLE_ESCAPES:
        role = F.replace(role, F.lit(plain), F.lit(safe))
    return role


def role_of(mark: Column) -> Column:
    for plain, safe in reversed(ROLE_ESCAPES):
        mark = F.replace(mark, F.lit(safe), F.lit(plain))
    return mark


def rendered(role: Column, text: Column, level: Column) -> Column:
    return F.concat(F.lit(OPEN), role_mark(role), F.lit(LINE), escaped(text, level), F.when(role == "assistant", END).otherwise(CLOSE))


def parsed(formatted: Column) -> Column:
    """The turns (role, text) that a formatted string holds."""
    roles = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(1))
    texts = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(2))
    return F.zip_with(roles, texts, lambda r, t: F.struct(role_of(r).alias("role"), unescaped(t).alias("text")))


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation: its id, formatted, levels (of each turn's escaping) and identical.

    Each turn is rendered as it is, parsed again and compared with its source; where they differ, its
    text is escaped. Whole conversations are then parsed and compared in the same way, and one that
    still differs has all its turns escaped, after which the round trip is exact. Turns are ordered by
    turn, then role, text; null turns come first, null roles and texts count as empty, and rows without
    a conversation id form one conversation. Repeated rows are repeated turns. An empty table gives an
    empty result. Other columns aren't carried.
    """
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    alone = parsed(rendered(F.col("role"), F.col("text"), F.lit(0)))
    same = (F.size(alone) == 1) & (F.get(alone, F.lit(0))["text"] == F.col("text"))
    rows = rows.withColumn("level", F.when(same, 0).otherwise(1))
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "level")))
    convs = rows.groupBy("conv").agg(turns.alias("turns"))

    def whole(items: Column, level: Column | None = None) -> Column:
        return F.array_join(F.transform(items, lambda t: rendered(t["role"], t["text"], t["level"] if level is None else level)), "")

    def equal(formatted: Column) -> Column:
        return parsed(formatted) == F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))

    first = let(whole(F.col("turns")), lambda f: F.struct(f.alias("formatted"), equal(f).alias("identical")))
    convs = convs.withColumn("first", first)
    again = let(whole(F.col("turns"), F.lit(1)), lambda f: F.struct(f.alias("formatted"), equal(f).alias("identical")))
    convs = convs.withColumn("last", F.when(F.col("first.identical"), F.col("first")).otherwise(again))
    levels = F.transform("turns", lambda t: F.when(F.col("first.identical"), t["level"]).otherwise(1))
    return convs.select(F.col("conv").alias(conv_col), F.col("last.formatted").alias("formatted"), levels.alias("levels"), F.col("last.identical").alias("identical"))


def digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What the formatted strings hold, read back from them: turns and loss text, as counts and digests.

    The loss mask covers what stands between an assistant's mark and its </s>.
    """
    f = formatted.select(F.col(conv_col).alias("conv"), "formatted", parsed(F.col("formatted")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return f.select(
        F.col("conv").alias(conv_col),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
