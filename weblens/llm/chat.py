"""Chat formatting from event logs: fold events into final messages, then render them with a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of events: a whole message, a streamed addition to it, a new text for it, a fresh start of
#: it (what was said so far is withdrawn), and its removal.
MESSAGE, DELTA, EDIT, REGENERATE, DELETE = "message", "delta", "edit", "regenerate", "delete"

#: Control strings of the template.  A turn is BEGIN role MIDDLE text END.
BEGIN, MIDDLE, END = "<s>[INST]", "[/INST]", "</s>"


def escape(text: Column) -> Column:
    r"""No control string is left in the result: ``\`` becomes ``\e``, ``<`` ``\l`` and ``[`` ``\b``."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\e")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def unescape(text: Column) -> Column:
    """The inverse of ``escape``: every backslash in an escaped text starts one of the three pairs."""
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("[")), F.lit("\\e"), F.lit("\\"))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages of an event log of (conv_id, seq, message_id, kind, role, text).

    Per message, events count in order of seq from the last one that sets or restarts its text;
    their texts are joined.  A message whose last such event is a deletion is gone.  The place of a
    message is its first seq.  The role is the last one given.  Null texts add nothing, null kinds
    are whole messages; events of equal seq go by kind, role, text.
    """
    kind = F.coalesce("kind", F.lit(MESSAGE))
    event = F.struct("seq", kind.alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    grouped = events.groupBy("conv_id", "message_id").agg(F.array_sort(F.collect_list(event)).alias("_log"))
    starts = F.filter(F.transform("_log", lambda e, i: F.when(e["kind"] != DELTA, i)), lambda i: i.isNotNull())
    last = F.coalesce(F.array_max(starts), F.lit(0))
    roles = F.filter(F.transform("_log", lambda e: e["role"]), lambda r: r.isNotNull())
    folded = grouped.withColumn("_last", last)
    live = F.slice("_log", F.col("_last") + 1, F.size("_log"))
    text = F.array_join(F.transform(live, lambda e: e["text"]), "")
    return (
        folded.filter(F.element_at("_log", F.col("_last") + 1)["kind"] != DELETE)
        .select("conv_id", F.element_at("_log", 1)["seq"].alias("seq"), "message_id", F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"), text.alias("text"))
    )


def render(messages: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, n_turns, formatted, loss_spans: array of (start, length) in code points of ``formatted``.

    The spans hold the escaped texts of the roles in ``learn``, each once, in order.
    """
    head = F.concat(F.lit(BEGIN), escape(F.col("role")), F.lit(MIDDLE))
    turns = messages.withColumn("_head", head).withColumn("_text", escape(F.col("text")))
    turns = turns.withColumn("_all", F.length("_head") + F.length("_text") + len(END))
    order = Window.partitionBy("conv_id").orderBy("seq", "message_id")
    before = F.coalesce(F.sum("_all").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turns = turns.withColumn("_at", before).withColumn("_k", F.row_number().over(order))
    span = F.when(F.col("role").isin(*learn), F.struct((F.col("_at") + F.length("_head")).cast("long").alias("start"), F.length("_text").cast("long").alias("length")))
    turn = F.struct("_k", F.concat("_head", "_text", F.lit(END)).alias("part"), span.alias("span"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("_turns"))
    return grouped.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("_turns", lambda t: t["part"]), "").alias("formatted"),
        F.filter(F.transform("_turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """The (role, text) of each turn, read back from a formatted conversation."""
    parts = F.filter(F.split(formatted, END), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(len(BEGIN) + 1)), MIDDLE, 1)).alias("role"),
            unescape(F.substr(p, F.locate(MIDDLE, p) + F.lit(len(MIDDLE)))).alias("text"),
        ),
    )


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the mask."""
    return F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"].cast("int") + 1, s["length"].cast("int"))))


def table_events(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A log of whole messages from a table of turns; rows that share a turn are messages of their own, by role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.withColumn("seq", F.row_number().over(order).cast("long")).select("conv_id", "seq", F.col("seq").alias("message_id"), F.lit(MESSAGE).alias("kind"), "role", "text")


def format_chats(events: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Reconstruct and render every conversation of an event log.

    Null roles and texts are empty; null conversation ids are one conversation; repeated events are
    events of their own; very long texts are rendered whole, and a conversation, which is one output,
    is held by one task; an empty log gives an empty table; columns other than the six are ignored.
    """
    return render(fold_events(events), learn)
