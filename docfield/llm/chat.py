r"""Operator 10 (native): chat formatting with a grammar round trip.

Template: a header line `#n`, then for each turn, with nothing between turns,

    user       [INST] text [/INST]
    assistant  <s>text</s>
    system     <<SYS>>, line break, text, line break, <</SYS>>
    others     [ROLE name] text [/ROLE]

The rendered text is parsed again by a deterministic parser (turns from left to right, each up to the first
closing mark of its kind, nothing left over) and compared with the source. Where they differ, the texts of
that conversation are escaped once more (level n of the header) and the trip is made again, until both
are identical: escaping puts a backslash behind the first character of every control string, and of every
control string that has backslashes there already, so it can be undone and leaves no control string.

One level is always enough: an escaped text holds no control string (they don't overlap, and a backslash makes none),
so a turn's first closing mark is its own, and no mark can begin in a text and end behind it. LEVELS leaves one to spare.

The loss mask holds the places of the assistants' texts in the formatted text (code points, ends exclusive).

Turns stand in the order of `turn` (null first), equal ones by role and text. Null role and text count as
empty. Rows of a null conv_id are one conversation. An empty table gives no rows. A conversation becomes
one string and so has to fit a task; no other group is gathered. DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfield.llm.common import running, shared_path

#: What may follow the first character of a control string.
_TAILS = r"/?s>|</?SYS>>|/?INST\]|ROLE |/ROLE\]"
LEVELS = 2
TURN = r"(?s)\[INST\] .*? \[/INST\]|<s>.*?</s>|<<SYS>>\n.*?\n<</SYS>>|\[ROLE [^\]]*\] .*? \[/ROLE\]"
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>\n", "\n<</SYS>>")}


def escaped(text: Column, level: int) -> Column:
    for _ in range(level):
        text = F.regexp_replace(text, rf"([<\[])(\\*)({_TAILS})", r"$1\\$2$3")
    return text


def unescaped(text: Column, level: int) -> Column:
    for _ in range(level):
        text = F.regexp_replace(text, rf"([<\[])\\(\\*)({_TAILS})", r"$1$2$3")
    return text


def _name(role: Column) -> Column:
    """A role as a name without brackets, and back by _role."""
    return F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("]"), F.lit("%5D"))


def _role(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("%5D"), F.lit("]")), F.lit("%25"), F.lit("%"))


def _marked(role: Column, text: Column) -> Column:
    out = None
    for name, (start, end) in MARKS.items():
        turn = F.concat(F.lit(start), text, F.lit(end))
        out = F.when(role == name, turn) if out is None else out.when(role == name, turn)
    return out.otherwise(F.concat(F.lit("[ROLE "), _name(role), F.lit("] "), text, F.lit(" [/ROLE]")))


def rendered(turns: Column, level: int) -> Column:
    return F.concat(F.lit(f"#{level}\n"), F.array_join(F.transform(turns, lambda t: _marked(t["role"], escaped(t["text"], level))), ""))


def _parsed_turn(turn: Column, level: Column) -> Column:
    """struct(role, text, start, end) of a turn; start and end: where its raw text lies in it."""
    role, start, end = None, None, None
    for name, (a, b) in MARKS.items():
        hit = turn.startswith(a)
        role = F.when(hit, F.lit(name)) if role is None else role.when(hit, F.lit(name))
        start = F.when(hit, len(a)) if start is None else start.when(hit, len(a))
        end = F.when(hit, F.length(turn) - len(b)) if end is None else end.when(hit, F.length(turn) - len(b))
    role = role.otherwise(_role(F.regexp_extract(turn, r"^\[ROLE ([^\]]*)\] ", 1)))
    start = start.otherwise(F.instr(turn, "] ") + 1)
    end = end.otherwise(F.length(turn) - len(" [/ROLE]"))
    raw = turn.substr(start + 1, end - start)
    text = F.when(level == 0, raw)
    for n in range(1, LEVELS + 1):
        text = text.when(level == n, unescaped(raw, n))
    return F.struct(role.alias("role"), text.alias("text"), start.cast("long").alias("start"), end.cast("long").alias("end"), F.length(turn).alias("size"))


def parsed(formatted: Column) -> Column:
    """array<struct<role, text, start, end, size>> of a formatted text; null if anything is left over."""
    level = F.regexp_extract(formatted, r"^#(\d)\n", 1).cast("int")
    body = formatted.substr(F.lit(4), F.length(formatted))
    turns = F.regexp_extract_all(body, F.lit(TURN), F.lit(0))
    whole = F.array_join(turns, "") == body
    return F.when(whole, F.transform(turns, lambda t: _parsed_turn(t, level)))


def _source(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask array<struct<start, end>>: one row for each conversation.

    loss_mask would be null where the trip fails at every level, which can't be, as the module's text says.
    """
    turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    out = out.withColumn("formatted", rendered(F.col("turns"), 0)).withColumn("back", parsed(F.col("formatted")))
    same = F.coalesce(_source(F.col("back")) == _source(F.col("turns")), F.lit(False))
    for level in range(1, LEVELS + 1):
        out = out.withColumn("same", same)
        out = out.withColumn("formatted", F.when(F.col("same"), F.col("formatted")).otherwise(rendered(F.col("turns"), level)))
        out = out.withColumn("back", F.when(F.col("same"), F.col("back")).otherwise(parsed(F.col("formatted"))))
    return out.select("conv_id", "formatted", F.when(same, loss_mask(F.col("back"))).alias("loss_mask"))


def loss_mask(back: Column) -> Column:
    """Places of the assistants' raw texts, from the parsed turns."""
    ends = running(F.transform(back, lambda t: t["size"].cast("long")), lambda a, b: a + b, F.lit(0).cast("long"))
    begins = F.zip_with(back, ends, lambda t, end: F.struct(t["role"].alias("role"), (end - t["size"] + t["start"] + 3).alias("start"), (end - t["size"] + t["end"] + 3).alias("end")))
    return F.transform(F.filter(begins, lambda t: t["role"] == "assistant"), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))


def write_conversations(conversations: DataFrame, path: str | None = None) -> str:
    """Formats conversations into a Parquet table at `path` (a new folder of the shared one if None), and returns the path."""
    path = path or shared_path(conversations.sparkSession, "chat")
    format_conversations(conversations).write.parquet(path)
    return path


def _plain(texts: Column, level: int) -> Column:
    return F.transform(texts, lambda t: unescaped(t, level))


def digests(conversations: DataFrame) -> DataFrame:
    """Figures of the written conversations, read back from formatted text and mask alone."""
    read = conversations.sparkSession.read.parquet(write_conversations(conversations))
    level = F.regexp_extract("formatted", r"^#(\d)\n", 1).cast("int")
    raw = F.transform("loss_mask", lambda m: F.col("formatted").substr((m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")))
    loss = F.when(level == 0, F.array_join(raw, ""))
    for n in range(1, LEVELS + 1):
        loss = loss.when(level == n, F.array_join(_plain(raw, n), ""))
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    found = read.withColumn("back", parsed(F.col("formatted"))).withColumn("loss", loss)
    return found.select("conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
