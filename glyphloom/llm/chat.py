r"""Operator 3, chat formatting: messages rebuilt from an event log, then rendered.

An event log has columns conversation, turn, seq, op, role, text. Ops: `message` opens a message
with a first text, `delta` appends to the open message of that turn, `edit` replaces its text,
`regenerate` starts it again from the event's text (mostly empty). Within (conversation, turn),
events run by seq, then op in the order above, role, text. A message's text is its last event that
is not a delta and the deltas after it.

Folding works on (conversation, turn), so a conversation with a large share of the log is spread
over tasks while streamed and superseded text goes away; only final messages meet by conversation.
Offsets of the loss mask are running sums over a conversation's sorted messages. A conversation's
rendered form is one value and must fit one; nothing else is gathered in a row.

Template: `<s>[INST]role\ntext[/INST]</s>` for a prompt turn, `<s>role\ntext</s>` for a turn of the
assistant. Inside role and text a backslash is doubled, and a backslash goes after the first
character of `<s>`, `</s>`, `[INST]` and `[/INST]`; a newline in a role becomes `\n`.

Defined cases: null text and null role are empty; null conversation is a conversation of its own;
null turn and seq come first; a delta, edit or regeneration with no open message opens one; unknown
ops count as `message`; equal rows are separate messages; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import literal_rows, table

OPS = ("message", "delta", "edit", "regenerate")
_ESCAPE = r"\\|<(?=/?s>)|\[(?=/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$0\\")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\)?", "$1")


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def fold(events: DataFrame) -> DataFrame:
    """Final messages of an event log: conversation, turn, message (number within the turn), role, text."""
    e = events.select(
        F.col("conversation").alias("c"), F.col("turn").alias("t"), F.col("seq").alias("q"),
        F.coalesce(F.expr("nullif(array_position(array('message', 'delta', 'edit', 'regenerate'), op), 0)"), F.lit(1)).cast("int").alias("o"),
        F.coalesce("role", F.lit("")).alias("r"), F.coalesce("text", F.lit("")).alias("x"),
    )
    w = W.partitionBy("c", "t").orderBy("q", "o", "r", "x").rowsBetween(W.unboundedPreceding, W.currentRow)
    e = e.withColumn("k", F.row_number().over(W.partitionBy("c", "t").orderBy("q", "o", "r", "x")))
    e = e.withColumn("m", F.greatest(F.lit(1), F.sum((F.col("o") == 1).cast("int")).over(w) + F.max(F.when(F.col("k") == 1, (F.col("o") != 1).cast("int"))).over(w)))
    whole = W.partitionBy("c", "t", "m")
    e = e.withColumn("start", F.max(F.when(F.col("o") != 2, F.col("k"))).over(whole)).withColumn("role", F.min_by("r", "k").over(whole))
    e = e.where(F.col("start").isNull() | (F.col("k") >= F.col("start")))
    m = e.groupBy("c", "t", "m").agg(F.first("role").alias("role"), F.sort_array(F.collect_list(F.struct("k", "x"))).alias("parts"))
    return m.select(F.col("c").alias("conversation"), F.col("t").alias("turn"), F.col("m").alias("message"), "role", F.expr("array_join(parts.x, '')").alias("text"))


def render(messages: DataFrame, learner: str = "assistant") -> DataFrame:
    """conversation, formatted, loss: the loss mask as an array of (segment, segment_start, start, length):
    starts count code points of formatted, the text of each turn of the learner is one entry, segment is its turn's place."""
    own = F.col("role") == learner
    head = F.concat(F.when(own, F.lit("<s>")).otherwise(F.lit("<s>[INST]")), escape_role(F.col("role")), F.lit("\n"))
    d = messages.select("conversation", "turn", "message", own.alias("own"), head.alias("head"), escape(F.col("text")).alias("body"))
    d = d.withColumn("piece", F.concat("head", "body", F.when(F.col("own"), F.lit("</s>")).otherwise(F.lit("[/INST]</s>"))))
    w = W.partitionBy("conversation").orderBy("turn", "message")
    d = d.withColumn("n", F.row_number().over(w)).withColumn("end", F.sum(F.char_length("piece").cast("long")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    first = F.col("end") - F.char_length("piece")
    loss = F.when(F.col("own"), F.struct((F.col("n") - 1).alias("segment"), first.alias("segment_start"), (first + F.char_length("head")).alias("start"), F.char_length("body").cast("long").alias("length")))
    d = d.select("conversation", "n", "piece", loss.alias("mark"))
    g = d.groupBy("conversation").agg(F.sort_array(F.collect_list(F.struct("n", "piece", "mark"))).alias("p"))
    return g.select("conversation", F.expr("array_join(p.piece, '')").alias("formatted"), F.expr("filter(p.mark, x -> x IS NOT NULL)").alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conversation, turns (role, text), loss_texts, n_chars, from the rendered text and its loss mask.

    Marked spans are cut from their own segment, so that reading is linear in the text."""
    d = formatted.withColumn("seg", F.expr("split(formatted, '</s>')")).withColumn("seg", F.expr("slice(seg, 1, size(seg) - 1)"))
    turn = F.transform("seg", lambda x: F.regexp_replace(F.regexp_replace(x, r"^<s>(\[INST\])?", ""), r"\[/INST\]\z", ""))
    d = d.withColumn("t", turn)
    turns = F.transform("t", lambda x: F.struct(unescape_role(F.substring_index(x, "\n", 1)).alias("role"), unescape(F.substring(x, F.instr(x, "\n") + 1, F.char_length(x))).alias("text")))
    d = d.select("conversation", "seg", "loss", turns.alias("turns"), F.char_length("formatted").cast("long").alias("n_chars"))
    cut = F.transform("loss", lambda m: unescape(F.substring(F.col("seg")[m["segment"]], (m["start"] - m["segment_start"] + 1).cast("int"), m["length"].cast("int"))))
    return d.select("conversation", "turns", cut.alias("loss_texts"), "n_chars")


def as_events(conversations: DataFrame) -> DataFrame:
    """Rows of whole turns as the event log that writes them: a turn of the assistant is drafted, regenerated and
    streamed in two deltas, any other is sent with a slip and edited. Rows of one turn follow each other by role,
    then text."""
    c = conversations.select(F.col("conv_id").alias("conversation"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    c = c.withColumn("base", 4 * F.row_number().over(W.partitionBy("conversation", "turn").orderBy("role", "text")))
    half = F.expr("char_length(text) DIV 2")
    head, tail = F.substring("text", F.lit(1), half), F.substring(F.col("text"), half + 1, F.char_length("text"))
    event = lambda k, op, text: F.struct((F.col("base") + k).alias("seq"), F.lit(op).alias("op"), text.alias("text"))
    streamed = F.array(event(0, "message", head), event(1, "regenerate", F.lit("")), event(2, "delta", head), event(3, "delta", tail))
    edited = F.array(event(0, "message", tail), event(1, "edit", F.col("text")))
    return c.select("conversation", "turn", "role", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(edited)).alias("e")).select("conversation", "turn", "e.seq", "e.op", "role", "e.text")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    own = literal_rows(spark, c.columns, [(-7, 0, "user", odd), (-7, 1, "assistant", odd)])
    d = read_back(render(fold(as_events(c.unionByName(own)))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    d = d.select("conversation", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), F.array_join("loss_texts", "").alias("learnt"), "n_chars")
    return d.select(
        F.col("conversation").alias("conv_id"), "n_turns", F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"), F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"), F.col("n_chars").alias("formatted_chars"),
    )


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(text, '(\\|</?s>|\[/?INST\])', '\1x', 'g')) + length(replace(regexp_replace(role, '(\\|</?s>|\[/?INST\])', '\1x', 'g'), chr(10), 'xx'))
                + 8 + CASE WHEN role = 'assistant' THEN 0 ELSE 13 END AS chars FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       length(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
