"""Chat formatting from event logs, in DataFrame operations only.

A log holds events of messages: ``message`` starts one with its text, ``delta`` appends
streamed text, ``edit`` and ``regenerate`` put a new text in place of the old one (later
deltas append to it), ``delete`` takes the message away. Events are folded by sequence
into final messages, first each message by itself, so long streams do not meet in one
task before they are folded, then each conversation, which is rendered.

Template: ``<s>`` text ``</s>`` for an assistant, ``[INST]`` role newline text ``[/INST]`` for all
others. In roles and texts a backslash is doubled and each control string gets a backslash
after its first character, so that it no longer occurs; a newline in a role gets one before
it. Taking every backslash away that precedes another character undoes all three.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

CONTROLS = ("[INST]", "[/INST]", "<s>", "</s>")
_CONTROL = r"([\[<])(/?(?:INST\]|s>))"
#: An escaped role, up to the newline that ends it.
_ROLE = r"(?s)^[^\\\n]*+(?:\\.[^\\\n]*+)*+"
_TURN = r"(?s)\[INST\].*?\[/INST\]|<s>.*?</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\$2")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, seq, message_id, role, text) of events (conv_id, seq, message_id, kind, role, text).

    seq, of any type that can be ordered, nulls first: where the message began. Equal sequence numbers are taken in the order start,
    delta, edit, regenerate, delete, then by text. Events without message_id are messages of their own; a null kind is
    a message, a null text is empty, a null role is taken from the message's other events.
    """
    order = F.coalesce(F.array_position(F.array(*map(F.lit, ("message", "delta", "edit", "regenerate", "delete"))), F.coalesce("kind", F.lit("message"))), F.lit(1))
    text = F.coalesce("text", F.lit(""))
    event = F.struct("seq", order.cast("int").alias("step"), text.alias("text"), "role")
    alone = F.when(F.col("message_id").isNull(), F.struct("seq", "role", text.alias("text")))
    each = events.groupBy("conv_id", "message_id", alone.alias("alone")).agg(F.sort_array(F.collect_list(event)).alias("ev"))
    # equal messages without an id stay as many as they were
    each = each.select("conv_id", "message_id", F.explode(F.when(F.col("message_id").isNull(), F.transform("ev", lambda e: F.array(e))).otherwise(F.array("ev"))).alias("ev"))
    start = F.array_max(F.transform("ev", lambda e, i: F.when(e["step"] != 2, i).otherwise(0)))
    each = each.withColumn("from", F.coalesce(start, F.lit(0)))
    last = F.slice("ev", F.col("from") + 1, F.size("ev"))
    gone = F.element_at("ev", F.col("from") + 1)["step"] == 5
    return each.where(~gone).select(
        "conv_id",
        F.element_at("ev", 1)["seq"].alias("seq"),
        "message_id",
        F.get(F.array_compact(F.transform("ev", lambda e: e["role"])), F.lit(0)).alias("role"),
        F.array_join(F.transform(last, lambda e: e["text"]), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, segments, formatted): messages in order of seq, then role, text and message_id.

    segments: the formatted text in pieces with their loss mask; an assistant's text is
    under it, markers and all else are not. A null role is written as an empty one.
    """
    turn = F.struct("seq", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "message_id")
    turns = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def piece(text: Column, loss: bool) -> Column:
        return F.struct(text.alias("text"), F.lit(loss).alias("loss"))

    def pieces(t: Column) -> Column:
        spoken = F.array(piece(F.lit("<s>"), False), piece(escape(t["text"]), True), piece(F.lit("</s>"), False))
        other = F.array(piece(F.concat(F.lit("[INST]"), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit("[/INST]")), False))
        return F.when(t["role"] == "assistant", spoken).otherwise(other)

    out = turns.select("conv_id", F.flatten(F.transform("turns", pieces)).alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parse(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""

    def turn(x: Column) -> Column:
        inner = F.substr(x, F.lit(7), F.length(x) - 13)
        cut = F.length(F.regexp_extract(inner, _ROLE, 0)) + 1
        return F.when(
            F.startswith(x, F.lit("<s>")),
            F.struct(F.lit("assistant").alias("role"), unescape(F.substr(x, F.lit(4), F.length(x) - 7)).alias("text")),
        ).otherwise(F.struct(unescape(F.substr(inner, F.lit(1), cut - 1)).alias("role"), unescape(F.substr(inner, cut + 1)).alias("text")))

    return F.transform(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)), turn)


def format_chats(events: DataFrame) -> DataFrame:
    """(conv_id, segments, formatted) of an event log; see fold() and render() for nulls and ties.

    Columns other than the six named ones are not read. A conversation whose messages
    are all deleted has no row; rows of a null conv_id make one conversation. An empty log
    gives no rows. A text of any length stays whole.
    """
    return render(fold(events.select("conv_id", "seq", "message_id", "kind", "role", "text")))


def streamed(rows: DataFrame) -> DataFrame:
    """An event log (see fold()) that ends in the messages ``rows`` (conv_id, turn, role, text), as a chat service would have written it.

    A text is streamed in a start and two deltas. By a hash, one message in four first
    says something else, which an edit replaces as a whole or a regeneration streams anew, and one in
    eight is followed by a message that is deleted again. Events are not in order. Equal rows
    are messages of their own; a null turn comes first.
    """
    same = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    lot = F.pmod(F.xxhash64("conv_id", "turn", "role", "text"), F.lit(1 << 40))
    each = same.withColumn("lot", lot).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    text = F.coalesce("text", F.lit(""))
    third = F.ceil(F.length(text) / 3).cast("int")
    pieces = [F.substr(text, F.lit(1), third), F.substr(text, third + 1, third), F.substr(text, 2 * third + 1)]
    name = F.concat_ws("-", "lot", "copy")

    def event(step: int, kind: str, said: Column, message: Column = name) -> Column:
        return F.struct(F.struct("turn", F.lit(step).alias("step")).alias("seq"), message.alias("message_id"), F.lit(kind).alias("kind"), F.when(F.lit(kind == "message"), F.col("role")).alias("role"), said.alias("text"))

    draft, sent = F.concat(F.lit("draft: "), F.reverse(text)), [event(k, "delta", pieces[k]) for k in (1, 2)]
    plain = F.array(event(0, "message", pieces[0]), *sent)
    edited = F.array(event(0, "message", pieces[0]), event(1, "delta", draft), event(2, "edit", text))
    again = F.array(event(0, "message", draft), event(1, "regenerate", pieces[0]), event(2, "delta", pieces[1]), event(3, "delta", pieces[2]))
    gone = F.array(*[event(k, kind, draft, F.concat(name, F.lit("-gone"))) for k, kind in ((4, "message"), (5, "delta"), (6, "delete"))])
    events = F.when(F.col("lot") % 8 == 0, edited).when(F.col("lot") % 8 == 1, again).when(F.col("lot") % 8 == 2, F.concat(plain, gone)).otherwise(plain)
    log = each.select("conv_id", F.explode(F.reverse(events)).alias("event"))
    return log.select("conv_id", "event.*")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    log = streamed(rows.unionByName(spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], rows.schema)))
    out = format_chats(log).withColumn("turns", parse(F.col("formatted")))
    loss = unescape(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), ""))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(replace(text, '\', '\\'), '([\[<])(/?(?:INST\]|s>))', '\1\\\2', 'g') AS x,
  replace(regexp_replace(replace(role, '\', '\\'), '([\[<])(/?(?:INST\]|s>))', '\1\\\2', 'g'), chr(10), '\' || chr(10)) AS y FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(x) + CASE WHEN role = 'assistant' THEN 7 ELSE 14 + length(y) END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
