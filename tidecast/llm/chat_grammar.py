"""Chat formatting with a grammar round trip, in native functions only.

A turn is ``open + " " + text + " " + close``, by role:

    user      [INST] ... [/INST]
    system    <<SYS>> ... <</SYS>>
    assistant <s> ... </s>
    other     <|role:NAME|> ... <|end|>      (NAME is URL-encoded, so it has no control character)

A conversation is its turns, one after the other, with nothing between. The parser is
deterministic: from the left it takes the first opening mark, the text up to the first closing
mark, and so on; then it undoes escapes: a control string with n + 1 backslashes after its first
character stands for the one with n.

Rendering starts without escapes. The text is parsed again and compared, turn by turn, with the
source. Where a conversation comes back different, the turns that do not survive a round trip on
their own are escaped (each control string in them gets one more backslash), and it is parsed and
compared again; should it still differ, all its turns are escaped, which the grammar can always
read back. So only text in conflict is changed, and every result is checked.

Turns are ordered by turn, role and text. A null text is an empty one, a null role the empty role,
a null conv_id a conversation of its own. Repeated rows are repeated turns. A conversation is one
row of the result and has to fit in memory; its rows meet after they are dealt out by conv_id.
Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Opening and closing mark of each role that has marks of its own.
MARKS = {"user": ("[INST]", "[/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("<s>", "</s>")}
OTHER = ("<|role:", "|>", "<|end|>")
#: A control string split at its first character; backslashes between the parts are the escape.
_FIRST = r"([<\[])"
_REST = r"(/?INST\]|</?SYS>>|/?s>|\|role:[^|\s]*\|>|\|end\|>)"
CONTROL = _FIRST + r"(\\*)" + _REST
_OPEN = r"(?:\[INST\]|<<SYS>>|<s>|<\|role:[^|\s]*\|>)"
_CLOSE = r"(?:\[/INST\]|<</SYS>>|</s>|<\|end\|>)"
TURN = rf"(?s){_OPEN} .*? {_CLOSE}"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _FIRST + r"\\(\\*)" + _REST, "$1$2$3")


def _marks(role: Column) -> tuple[Column, Column]:
    first = F.concat(F.lit(OTHER[0]), F.url_encode(role), F.lit(OTHER[1]))
    last = F.lit(OTHER[2])
    for r, (a, b) in MARKS.items():
        first, last = F.when(role == r, a).otherwise(first), F.when(role == r, b).otherwise(last)
    return first, last


def render(turns: Column) -> Column:
    """Turns (role, text), texts as they are to appear, to the formatted text."""

    def one(t):
        first, last = _marks(t["role"])
        return F.concat(first, F.lit(" "), t["text"], F.lit(" "), last)

    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """Formatted text to turns (role, text); null where the grammar does not cover all of it."""

    def one(t):
        mark = F.substring_index(t, " ", 1)
        role = F.url_decode(F.regexp_extract(mark, r"^<\|role:([^|]*)\|>$", 1))
        for r, (a, _) in MARKS.items():
            role = F.when(mark == a, r).otherwise(role)
        close = F.length(F.substring_index(t, " ", -1))
        text = F.substr(t, F.length(mark) + 2, F.length(t) - F.length(mark) - close - 2)
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    found = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0))
    return F.when(F.array_join(found, "") == formatted, F.transform(found, one))


def _same(parsed: Column, turns: Column) -> Column:
    return F.coalesce(parsed == turns, F.lit(False))


def collect_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = F.sort_array(F.collect_list(F.struct("turn", role.alias("role"), text.alias("text"))))
    plain = F.transform(F.col("__turns"), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return rows.groupBy("conv_id").agg(turns.alias("__turns")).select("conv_id", plain.alias("turns"))


def format_chats(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) to (conv_id, formatted, turns), turns being read back from formatted.

    ``escaped`` says how many turns were escaped, ``identical`` that the round trip was exact.
    """
    df = collect_turns(rows).withColumnRenamed("turns", "source")
    df = df.withColumn("r0", render(F.col("source")))
    df = df.withColumn("ok0", _same(parse(F.col("r0")), F.col("source")))

    def mend(t):
        alone = F.array(F.struct(t["role"].alias("role"), t["text"].alias("text")))
        text = F.when(_same(parse(render(alone)), alone), t["text"]).otherwise(escape(t["text"]))
        return F.struct(t["role"].alias("role"), text.alias("text"))

    every = lambda t: F.struct(t["role"].alias("role"), escape(t["text"]).alias("text"))
    df = df.withColumn("s1", F.when(F.col("ok0"), F.col("source")).otherwise(F.transform("source", mend)))
    df = df.withColumn("r1", F.when(F.col("ok0"), F.col("r0")).otherwise(render(F.col("s1"))))
    df = df.withColumn("ok1", F.col("ok0") | _same(parse(F.col("r1")), F.col("source")))
    df = df.withColumn("s2", F.when(F.col("ok1"), F.col("s1")).otherwise(F.transform("source", every)))
    df = df.withColumn("formatted", F.when(F.col("ok1"), F.col("r1")).otherwise(render(F.col("s2"))))
    df = df.withColumn("turns", parse(F.col("formatted")))
    changed = F.filter(F.zip_with("s2", "source", lambda a, b: a["text"] != b["text"]), lambda x: x)
    return df.select(
        "conv_id",
        "formatted",
        "turns",
        F.size(changed).alias("escaped"),
        _same(F.col("turns"), F.col("source")).alias("identical"),
    )


def query(conversations: DataFrame) -> DataFrame:
    """op6: digests of all conversations and of conversation -7, read back from the formatted text."""
    clash = "</s>[INST] ok [/INST]"
    extra = conversations.sparkSession.createDataFrame(
        [(-7, 0, "user", clash), (-7, 1, "assistant", clash)], "conv_id long, turn long, role string, text string"
    )
    df = format_chats(conversations.select(*extra.columns).union(extra))
    said = F.filter("turns", lambda t: t["role"] == "assistant")
    loss = F.array_join(F.transform(said, lambda t: t["text"]), "")
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return df.withColumn("loss", loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The same for texts that hold no control strings besides conflicting ones; those get a backslash each.
_SQL_CONTROL = r"[<\[]\\*(/?INST\]|</?SYS>>|/?s>|\|role:[^|\s]*\|>|\|end\|>)"
ORACLE = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
m AS (
  SELECT *, CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 17 WHEN 'assistant' THEN 9
                      ELSE 18 + length(url_encode(role)) END
            + length(text) + len(regexp_extract_all(text, '{_SQL_CONTROL}')) AS chars
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""
