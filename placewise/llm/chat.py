"""Chat formatting by prefix-target expansion, in DataFrame operations only.

A turn is written as ``<s>role\ntext</s>``. Every assistant turn becomes an example: all turns before it are context, its text
is the only part under the loss mask. Turns after the last assistant turn (or all, if there is none) make one more example
without a trained part, so that nothing of a conversation is lost. Control strings inside texts and roles get a backslash
after their first character, after any backslashes already there, which can be undone exactly.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TAIL = r"(/?s>|/?INST\])"
BEGIN, END = "<s>", "</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + TAIL, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)\\" + TAIL, r"$1$2$3")


def _role(role: Column) -> Column:
    """A role is one line: backslashes and line ends are spelled out."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def _unrole(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """Examples of ``turns`` (conv_id, turn, role, text): conv_id, example (from 0, in order of turns), formatted,
    loss_start and loss_length (characters from 0; length 0 without a trained part), trained (whether an assistant turn ends it).

    Turns are ordered by turn, then role and text; repeated rows are turns of their own; null roles and texts are empty;
    rows with a null conv_id are one conversation; other columns are ignored. Each example repeats its context, as the method
    asks; a conversation's turns are brought together in one row."""
    empty = F.lit("")
    rows = turns.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    rows = rows.select("conv_id", F.struct("turn", "role", "text", F.concat(F.lit(BEGIN), _role(F.col("role")), F.lit("\n")).alias("head"),
                                           escape(F.col("text")).alias("body")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    n = F.size("t")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (F.element_at("t", i)["role"] == "assistant") | (i == n))
    ex = convs.select("conv_id", "t", F.posexplode(ends).alias("example", "end"))
    last = F.element_at("t", F.col("end"))
    whole = lambda t: F.concat(t["head"], t["body"], F.lit(END))
    before = F.concat_ws("", F.transform(F.slice("t", F.lit(1), F.col("end") - 1), whole))
    ex = ex.select("conv_id", "example", before.alias("before"), last.alias("last"), (last["role"] == "assistant").alias("trained"))
    return ex.select("conv_id", "example", F.concat("before", whole(F.col("last"))).alias("formatted"), (F.length("before") + F.length("last.head")).alias("loss_start"),
                     F.when(F.col("trained"), F.length("last.body")).otherwise(F.lit(0)).alias("loss_length"), "trained")


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a formatted example."""
    parts = F.filter(F.split(formatted, END, -1), lambda x: x.startswith(BEGIN))
    body = F.transform(parts, lambda x: F.substr(x, F.lit(len(BEGIN) + 1)))
    role = lambda x: F.substring_index(x, "\n", 1)
    return F.transform(body, lambda x: F.struct(_unrole(role(x)).alias("role"), unescape(F.substr(x, F.length(role(x)) + 2)).alias("text")))


def digest(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation hold, read back from their text: number and digest of the turns, characters and
    digest of all text under the loss mask, characters written."""
    under = unescape(F.substr("formatted", F.col("loss_start") + 1, F.col("loss_length")))
    e = examples.select("conv_id", "example", "formatted", under.alias("under"), F.length("formatted").cast("long").alias("chars"))
    c = e.groupBy("conv_id").agg(F.max_by("formatted", "example").alias("formatted"), F.array_sort(F.collect_list(F.struct("example", "under"))).alias("u"), F.sum("chars").alias("formatted_chars"))
    loss = F.concat_ws("", F.transform("u", lambda x: x["under"]))
    c = c.select("conv_id", parse(F.col("formatted")).alias("turns"), loss.alias("loss"), "formatted_chars")
    text = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return c.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
                    F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n, count(*) OVER (PARTITION BY conv_id) AS turns,
  8 + length(regexp_replace(replace(replace(role, '\', '\b'), chr(10), '\n'), '([<\[])(\\*)(/?s>|/?INST\])', '\1\2\\\3', 'g'))
    + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\2\\\3', 'g')) AS chars FROM c),
f AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY n) AS upto FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (role = 'assistant' OR n = turns))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""
