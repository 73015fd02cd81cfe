"""Chat formatting as relational steps: collect turn structs, sort, merge neighbours of one role, concatenate.

The template of a block (one role, one or more turns) is

    <|turn|>ROLE<|text|>TEXT<|next|>TEXT...<|end|>

Inside roles and texts a backslash is doubled and `<|` becomes `<\\|`, so no marker can occur in them and
`read_back` recovers every turn. Only Spark expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
#: Turns are first collected and sorted in stretches of so many turn numbers, so many tasks share a long conversation.
STRETCH = 512

def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _blocks(turns: Column) -> Column:
    """Neighbours of one role in an array of turns as blocks (role, texts): each block is a slice that begins where the role changes."""

    def of(t: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, i - 1)["role"]))

        def cut(starts: Column) -> Column:
            def block(s: Column, j: Column) -> Column:
                own = F.slice(t, s + 1, F.coalesce(F.get(starts, j + 1), F.size(t)) - s)
                return F.struct(F.get(t, s)["role"].alias("role"), F.transform(own, lambda x: x["text"]).alias("texts"))

            return F.transform(starts, block)

        return _let(heads, cut)

    return _let(turns, of)


def merge_turns(turns: DataFrame) -> DataFrame:
    """conv_id, blocks: turns ordered by turn (ties by role, then text), neighbours of one role merged.

    Null roles and texts count as empty; null turns come first; rows with a null conv_id are one
    conversation; repeated rows are turns of their own. An empty table gives no rows. Other columns are not read.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    by_stretch = turns.groupBy("conv_id", F.floor(F.col("turn") / STRETCH).alias("stretch")).agg(F.sort_array(F.collect_list(row)).alias("t"))
    whole = by_stretch.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("stretch", "t"))).alias("s"))
    return whole.select("conv_id", _blocks(F.flatten(F.transform("s", lambda x: x["t"]))).alias("blocks"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (start and end in code points of each assistant text, end exclusive). Rows as in merge_turns; a conversation is one
    string, so its texts together must stay within what a string holds (2 GB)."""

    def render(b: Column) -> Column:
        return F.concat(F.lit(TURN), escape(b["role"]), F.lit(TEXT), F.array_join(F.transform(b["texts"], escape), NEXT), F.lit(END))

    def spans(state: Column, b: Column) -> Column:
        first = state["at"] + len(TURN) + F.length(escape(b["role"])) + len(TEXT)

        def step(s: Column, text: Column) -> Column:
            end = s["at"] + F.length(escape(text))
            return F.struct((end + len(NEXT)).alias("at"), F.when(b["role"] == "assistant", F.concat(s["spans"], F.array(F.struct(s["at"].alias("start"), end.alias("end"))))).otherwise(s["spans"]).alias("spans"))

        inner = F.aggregate(b["texts"], F.struct(first.alias("at"), state["spans"].alias("spans")), step)
        return F.struct((inner["at"] - len(NEXT) + len(END)).alias("at"), inner["spans"].alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return merge_turns(turns).select("conv_id", F.array_join(F.transform("blocks", render), "").alias("formatted"), F.aggregate("blocks", zero, spans)["spans"].alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    lit = lambda s: s.replace("|", "\\|")
    blocks = F.filter(F.split(formatted, lit(END)), lambda b: b != "")

    def turns(b: Column) -> Column:
        role = unescape(F.substring_index(F.substr(b, F.lit(len(TURN) + 1)), TEXT, 1))
        texts = F.split(F.substr(b, F.instr(b, TEXT) + len(TEXT)), lit(NEXT))
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def masked_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask. Four bytes a code point, so a span is found without a scan."""
    wide = F.encode(formatted, "UTF-32")
    pieces = F.transform(F.array(wide), lambda w: F.array_join(F.transform(spans, lambda s: unescape(F.decode(F.substr(w, s["start"] * 4 + 1, (s["end"] - s["start"]) * 4), "UTF-32"))), ""))
    return F.element_at(pieces, 1)


def digest_chats(chats: DataFrame) -> DataFrame:
    """conv_id and digests of what is read back from `formatted` under `loss_spans`."""
    read = chats.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    hostile = r"\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", hostile), (-7, 1, "assistant", hostile)], turns.schema)
    return digest_chats(format_chats(turns.unionByName(extra)))


OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
             lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM t),
m AS (SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS esc,
             length(replace(replace(role, '\', '\\'), '<|', '<\|')) AS esc_role FROM n)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(CASE WHEN before = role THEN 8 + esc ELSE 23 + esc_role + esc END) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""
