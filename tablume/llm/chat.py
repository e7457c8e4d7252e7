"""Chat formatting from event logs, in DataFrame operations only.

A log holds events of conversations. They are folded into final messages, the messages are
rendered with a template that marks turns and escapes its own marks inside texts, and a mask says
which characters a model is trained on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, BREAK = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
#: Code points of a streamed piece of an answer.
DELTA_CHARS = 200
EVENTS = ("message", "edit", "regenerate", "delta", "delete")


def escaped(text: Column) -> Column:
    """``text`` without the string ``<|``: each backslash is doubled, then a ``<|`` parted by one."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    """The inverse of ``escaped``."""
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def streamed_events(messages: DataFrame) -> DataFrame:
    """The log that a service with streamed answers keeps of given ``conversation, place, role, text``.

    An answer (role ``assistant``) starts empty and comes in deltas of ``DELTA_CHARS`` code points, other
    messages come whole. A hash of conversation and place picks what else happened: a quarter of the
    messages were edited from a draft, a quarter regenerated after a draft, and before a quarter another
    message was sent and deleted. :func:`fold_events` gives the messages back. ``place`` counts from 0
    and is unique in a conversation; a null text is empty, and an empty table gives an empty log.
    """
    text = F.coalesce("text", F.lit(""))
    own, other = F.col("place") * 2, F.col("place") * 2 + 1

    def event(kind: str, what: Column, message: Column = own) -> Column:
        return F.struct(
            message.cast("bigint").alias("message"), F.lit(kind).alias("kind"), what.alias("text")
        )

    nothing, draft = F.lit(""), F.concat(F.lit("draft: "), F.substring(text, 1, DELTA_CHARS))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{DELTA_CHARS}}}"), F.lit(0))
    deltas = F.transform(pieces, lambda piece: event("delta", piece))
    streamed = F.concat(F.array(event("message", nothing)), deltas)
    plain = F.when(F.col("role") == "assistant", streamed).otherwise(F.array(event("message", text)))
    again = F.array(event("message", nothing), event("delta", draft), event("regenerate", nothing))
    gone = F.array(event("message", draft, other), event("delete", nothing, other))
    drawn = F.pmod(F.xxhash64("conversation", "place"), F.lit(4))
    history = (
        F.when(drawn == 1, F.array(event("message", draft), event("edit", text)))
        .when(drawn == 2, F.concat(again, deltas))
        .when(drawn == 3, F.concat(gone, plain))
        .otherwise(plain)
    )
    return messages.select(
        "conversation", "place", "role", F.posexplode(history).alias("step", "event")
    ).select(
        "conversation",
        (F.shiftleft(F.col("place").cast("bigint"), 32) + F.col("step")).alias("seq"),
        "event.message",
        "event.kind",
        "role",
        "event.text",
    )


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages ``conversation, place, role, text`` from a log of events.

    ``events`` has ``conversation, seq, message, kind, role, text``; other columns are ignored.
    By ``seq``, a ``message``, ``edit`` or ``regenerate`` starts its message's text anew (a
    regeneration usually with an empty text that deltas then fill), a ``delta`` adds to the end,
    and a ``delete`` removes the message until it is started anew. A message stands where its
    first event does and has the role of its first event that names one; deltas before any start
    count from an empty text. A null text is empty and a null role is the empty role. Events of
    the same ``seq`` are taken by message, kind and text; repeated events count each time. Null
    conversations and messages are keys like any other.
    """
    key = ["conversation", "message"]
    log = events.select(
        *key,
        "seq",
        "kind",
        "role",
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = [F.col("seq"), F.col("kind"), F.col("text")]
    upto = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    starts = F.col("kind").isin("message", "edit", "regenerate", "delete")
    numbered = log.withColumn("version", F.sum(F.when(starts, 1).otherwise(0)).over(upto))
    versions = numbered.withColumn(
        "latest", F.max("version").over(Window.partitionBy(*key))
    ).withColumn("current", F.col("version") == F.col("latest"))
    now = F.when(F.col("current") & (F.col("kind") != "delete"), F.struct(*order))
    folded = versions.groupBy(*key).agg(
        F.min("seq").alias("seq"),
        F.min(F.when(F.col("role").isNotNull(), F.struct("seq", "kind", "role"))).alias("named"),
        F.array_sort(F.collect_list(now)).alias("parts"),
        F.max(F.col("current") & (F.col("kind") == "delete")).alias("deleted"),
    )
    texts = F.concat_ws("", F.transform("parts", lambda p: p["text"]))
    place = Window.partitionBy("conversation").orderBy("seq", "message", "text")
    return (
        folded.where(~F.coalesce("deleted", F.lit(False)) | (F.size("parts") > 0))
        .select(
            "conversation",
            "seq",
            "message",
            F.coalesce("named.role", F.lit("")).alias("role"),
            texts.alias("text"),
        )
        .withColumn("place", F.row_number().over(place) - 1)
        .select("conversation", "place", "role", "text")
    )


def render(messages: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``conversation, formatted, turns`` from folded messages.

    A turn is START, the escaped role, a line break, the escaped text, END; a line break in a
    role becomes BREAK. ``turns`` has, in order, ``start`` and ``length`` of each turn and
    ``mask_start`` and ``mask_length`` of the part that is trained on (the escaped text of a
    turn whose role is ``trained``, else nothing), in code points of ``formatted`` from 0.
    """
    role = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit(BREAK))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    body = escaped(F.col("text"))
    so_far = (
        Window.partitionBy("conversation")
        .orderBy("place")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    pieces = (
        messages.select("conversation", "place", "role", head.alias("head"), body.alias("body"))
        .withColumn("piece", F.concat("head", "body", F.lit(END)))
        .withColumn("length", F.length("piece").cast("bigint"))
        .withColumn("start", F.sum("length").over(so_far) - F.col("length"))
    )
    masked = F.when(F.col("role").isin(*trained), F.length("body")).otherwise(F.lit(0))
    turn = F.struct(
        "place",
        "piece",
        F.struct(
            "start",
            "length",
            (F.col("start") + F.length("head")).alias("mask_start"),
            masked.cast("bigint").alias("mask_length"),
        ).alias("turn"),
    )
    return (
        pieces.groupBy("conversation")
        .agg(F.array_sort(F.collect_list(turn)).alias("all"))
        .select(
            "conversation",
            F.concat_ws("", F.col("all.piece")).alias("formatted"),
            F.col("all.turn").alias("turns"),
        )
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """``conversation, roles, texts, trained_text, formatted_chars`` from rendered conversations.

    Roles and texts come from the marks in ``formatted`` alone, ``trained_text`` from the mask:
    all text under it, unescaped, in order.
    """
    pattern = r"(?s)<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n"
    every = lambda group: F.regexp_extract_all("formatted", F.lit(pattern), F.lit(group))
    under = F.transform(
        F.arrays_zip(every(0).alias("piece"), F.col("turns").alias("turn")),
        lambda x: F.substring(
            x["piece"],
            (x["turn"]["mask_start"] - x["turn"]["start"] + 1).cast("int"),
            x["turn"]["mask_length"].cast("int"),
        ),
    )
    roles = F.transform(every(1), lambda r: unescaped(F.replace(r, F.lit(BREAK), F.lit("\n"))))
    return rendered.select(
        "conversation",
        roles.alias("roles"),
        F.transform(every(2), unescaped).alias("texts"),
        F.concat_ws("", F.transform(under, unescaped)).alias("trained_text"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def digests(back: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``."""
    turns = F.transform(
        F.arrays_zip("roles", "texts"),
        lambda t: F.concat(t["roles"], F.lit("\n"), t["texts"], F.lit("\n")),
    )
    return back.select(
        F.col("conversation").alias("conv_id"),
        F.size("texts").cast("bigint").alias("n_turns"),
        F.sha2(F.encode(F.concat_ws("", turns), "UTF-8"), 256).alias("turns_sha256"),
        F.length("trained_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.encode("trained_text", "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
