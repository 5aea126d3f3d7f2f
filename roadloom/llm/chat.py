"""Chat formatting by a grammar that is read back, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A conversation is a sequence of turns: OPEN role MIDDLE text CLOSE.
OPEN, MIDDLE, CLOSE = "<s>[ROLE]", "[/ROLE]", "</s>"
#: What looks like a control string, with any number of backslashes after its first character.
_LOOKS = r"([<\[])(\\*)(/?(?:s>|INST\]|ROLE\]))"
_ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]|ROLE\]))"


def escaped(c: Column) -> Column:
    """One more backslash in everything that looks like a control string; ``unescaped`` takes it away again."""
    return F.regexp_replace(c, _LOOKS, r"$1\\$2$3")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, _ESCAPED, "$1$2$3")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE))


def parsed(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text).  The parser is deterministic: CLOSE ends a turn,
    the first MIDDLE in it ends the role."""
    pieces = F.split(formatted, CLOSE)

    def turn(p: Column) -> Column:
        role = F.substring_index(F.substring(p, len(OPEN) + 1, 2**31 - 1), MIDDLE, 1)
        text = F.substr(p, F.char_length(role) + F.lit(len(OPEN) + len(MIDDLE) + 1))
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def _until_read_back(value: Column, back: Column, back_escaped: Column) -> Column:
    """The value as it is when the parser returns it, else escaped; that is read back too, or the job fails."""
    same = lambda found: (F.size(found) == 1)
    return (
        F.when(same(back[0]) & (back[1] == value), value)
        .when(same(back_escaped[0]) & (back_escaped[1] == value), escaped(value))
        .otherwise(F.raise_error(F.lit("a text cannot be read back")))
    )


def format_chats(chats: DataFrame, conv="conv_id", turn="turn", role="role", text="text", loss_role="assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (array of (start, length) in code points, one for each text of
    ``loss_role``).

    Turns are ordered by turn, then role and text; null roles and texts are empty strings, rows without conv_id are one
    conversation.  Repeated rows are turns of their own.  A text or role that the parser does not return as it was is
    escaped.  Other columns are not looked at, an empty table gives an empty one.  A conversation is one row of the output and has to
    fit in one.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = chats.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text"))
    x, none = F.lit("x"), F.lit("")
    read = lambda r, t, part: (parsed(rendered(r, t)), parsed(rendered(r, t))[0][part])
    rows = rows.withColumn("r", _until_read_back(F.col("role"), read(F.col("role"), none, "role"), read(escaped(F.col("role")), none, "role")))
    rows = rows.withColumn("t", _until_read_back(F.col("text"), read(x, F.col("text"), "text"), read(x, escaped(F.col("text")), "text")))
    rows = rows.select("conv_id", "turn", "role", "text", "t", F.char_length("r").alias("r_chars"), rendered(F.col("r"), F.col("t")).alias("piece"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("at", F.row_number().over(order))
    rows = rows.withColumn("first", F.sum(F.char_length("piece")).over(before) - F.char_length("piece") + F.col("r_chars") + len(OPEN) + len(MIDDLE))
    span = F.when(F.col("role") == loss_role, F.struct("at", F.col("first").cast("long").alias("start"), F.char_length("t").cast("long").alias("length")))
    out = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("at", "piece", "role", "text"))).alias("turns"),
        F.sort_array(F.collect_list(span)).alias("spans"),
    )
    formatted = F.concat_ws("", "turns.piece")
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    formatted = F.when(parsed(formatted) == source, formatted).otherwise(F.raise_error(F.lit("a conversation cannot be read back")))
    return out.select("conv_id", formatted.alias("formatted"), F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted) out of what ``format_chats`` returns: the parser's turns, and the unescaped text under the mask."""
    under = F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("conv_id", parsed(F.col("formatted")).alias("turns"), F.concat_ws("", under).alias("loss_text"), "formatted")
