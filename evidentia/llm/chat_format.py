"""Chat formatting with a grammar round trip, in DataFrame expressions only.

Grammar of the output: a conversation is a sequence of turns, and a turn is

    ### Role: TEXT NEWLINE </turn> NEWLINE

where Role comes from the table of roles below (or is the escaped role itself), and TEXT holds no
control string ("### " or "</turn>") without a backslash right before it. A parser for this grammar
needs no look-ahead: it cuts at NEWLINE </turn> NEWLINE, and takes any other bare control string for
a syntax error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, STOP = "### ", "</turn>"
END = f"\n{STOP}\n"
#: Roles with a header of their own; any other role stands in the header as it is.
NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}
#: Control strings, after any backslashes.
_CONTROL = r"(### |</turn>)"
#: Escaping once is enough for this grammar; the round trip is checked after each level all the same.
LEVELS = 2


def escape(text: Column) -> Column:
    """One more backslash before each control string."""
    return F.regexp_replace(text, _CONTROL, r"\\$1")


def unescape(text: Column) -> Column:
    """One backslash less before each control string."""
    return F.regexp_replace(text, rf"\\{_CONTROL}", "$1")


def _head(role: Column) -> Column:
    """The header's name of a role: one line without a colon, reversible."""
    safe = F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit(":"), F.lit("%3A"))
    # other roles get a mark, so that a role "User" isn't taken for "user"
    found = F.concat(F.lit("%"), safe)
    for role_name, name in NAMES.items():
        found = F.when(role == role_name, F.lit(name)).otherwise(found)
    return found


def _role(head: Column) -> Column:
    bare = F.substr(head, F.lit(2))
    found = F.replace(F.replace(F.replace(bare, F.lit("%3A"), F.lit(":")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))
    for role_name, name in NAMES.items():
        found = F.when(head == name, F.lit(role_name)).otherwise(found)
    return found


def render(role: Column, body: Column) -> Column:
    return F.concat(F.lit(HEAD), _head(role), F.lit(": "), body, F.lit(END))


def parse(formatted: Column) -> Column:
    """array<struct<role, text, raw>> of the turns in formatted text; raw is the text as it stands there,
    and text is null where raw breaks the grammar."""
    turns = F.split(formatted, END, -1)
    turns = F.slice(turns, F.lit(1), F.size(turns) - 1)  # nothing follows the last end

    def turn(whole: Column) -> Column:
        head = F.substring_index(whole, ": ", 1)
        raw = F.substr(whole, F.length(head) + 3)
        text = F.when(~F.regexp_like(raw, F.lit(rf"(?<!\\){_CONTROL}")), unescape(raw))
        return F.struct(_role(F.substr(head, F.lit(len(HEAD) + 1))).alias("role"), text.alias("text"), raw.alias("raw"))

    return F.transform(turns, turn)


def _comes_back(role: Column, text: Column, body: Column) -> Column:
    """Whether the rendered turn parses to exactly this turn."""
    found = parse(render(role, body))
    return (F.size(found) == 1) & F.coalesce((found[0]["role"] == role) & (found[0]["text"] == text), F.lit(False))


def format_conversations(rows: DataFrame) -> DataFrame:
    """One formatted text per conversation, checked by reading it back.

    rows: conv_id (long), turn (long), role, text; other columns are ignored. Null texts and roles
    count as empty. Turns stand in the order of turn (null first); rows of one turn in the order of
    role and text; repeated rows are repeated turns. Rows with null conv_id are one conversation.

    Each turn is rendered as it is and parsed again; only where that doesn't return the same turn, its
    control strings are escaped, until it does. Texts are escaped before they are shuffled, one row
    each; a conversation is put together once, and the whole text is parsed and compared again.
    A mismatch raises an error.

    Returns conv_id, formatted, turns (array of role, text, start, length as read back; start and length are
    code points of the text's place in formatted), loss_spans (start and length of assistant texts).
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    body = F.col("text")
    turns = turns.withColumn("body", body)
    for _ in range(LEVELS):
        again = F.when(_comes_back(F.col("role"), F.col("text"), F.col("body")), F.col("body")).otherwise(escape(F.col("body")))
        turns = turns.withColumn("body", again)
    turns = turns.select("conv_id", F.struct("turn", "role", "body", F.xxhash64("role", "text").alias("mark")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    rendered = F.array_join(F.transform("t", lambda t: render(t["role"], t["body"])), "")
    whole = whole.select("conv_id", rendered.alias("formatted"), F.transform("t", lambda t: t["mark"]).alias("marks"))
    whole = whole.withColumn("found", parse(F.col("formatted")))
    same = F.transform("found", lambda t: F.xxhash64(t["role"], t["text"])) == F.col("marks")
    checked = F.when(same, F.col("found")).otherwise(F.raise_error(F.concat(F.lit("formatted text doesn't read back: conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))))
    whole = whole.select("conv_id", "formatted", checked.alias("found"))

    step = lambda t: F.length(render(t["role"], t["raw"])).cast("long")
    start = F.aggregate(
        "found", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts")),
        lambda a, t: F.struct((a["at"] + step(t)).alias("at"), F.array_append(a["starts"], a["at"] + F.length(_head(t["role"])) + len(HEAD) + 2).alias("starts")),
    )["starts"]
    placed = F.zip_with("found", start, lambda t, s: F.struct(t["role"].alias("role"), t["text"].alias("text"), s.alias("start"), F.length(t["raw"]).cast("long").alias("length")))
    whole = whole.select("conv_id", "formatted", placed.alias("turns"))
    learned = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return whole.withColumn("loss_spans", learned)


def under_mask(formatted: Column, spans: Column) -> Column:
    """The unescaped text of the spans, one after another."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
