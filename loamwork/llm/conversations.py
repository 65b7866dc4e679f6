"""Rebuilding ordered conversations from message rows.

Conversations are components of the links; messages are then sorted by (conversation, instant, speaker, identifier) over the whole cluster. The sort key is
unique, so its ranges are even however long a conversation is: no window or group ever holds one conversation in a task. In each range a message meets
the next one, the ranges' ends meet in a table of two rows a range, and a conversation is judged by sums of its rows' findings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.llm.components import connected_components
from loamwork.plans.durable import cut
from loamwork.plans.skew import skew_join

USER_ROLES = ("user", "human", "customer", "me", "person", "prompter", "u")
ASSISTANT_ROLES = ("assistant", "ai", "model", "bot", "chatbot", "gpt", "llm", "a")


def instant(text: Column) -> Column:
    """Microseconds since 1970 of an ISO 8601 text with or without a zone (none: UTC); null if it can't be read."""
    t = F.upper(F.trim(text))
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), F.unix_micros(t.try_cast("timestamp")))


def speaker(role: Column, fallback: Column) -> Column:
    """0 for user, 1 for assistant, null for anything else; ``fallback`` counts where ``role`` is null or blank."""
    word = F.lower(F.trim(F.when(role.rlike(r"(?U)\S"), role).otherwise(fallback)))
    return F.when(word.isin(*USER_ROLES), F.lit(0)).when(word.isin(*ASSISTANT_ROLES), F.lit(1))


def conversation_node(key: Column, salt: int = 0) -> Column:
    """The graph node of a conversation identifier: a negative number, so that it is the least of its component."""
    return -F.xxhash64(key, F.lit(salt)).bitwiseAND((1 << 62) - 1) - F.lit(1 << 61)


def conversation_nodes(keys: DataFrame, key: str, tries: int = 20) -> DataFrame:
    """``(key, node)`` of every distinct identifier, under a salt for which no two identifiers share a node."""
    distinct = cut(keys.select(key).distinct())
    for salt in range(tries):
        named = distinct.withColumn("node", conversation_node(F.col(key), salt))
        if named.groupBy("node").count().filter("count > 1").isEmpty():
            return named
    raise RuntimeError("identifiers share nodes under every salt")


def message_links(messages: DataFrame, ident: str, conversation: str | None = None, reply_to: str | None = None, quotes: str | None = None) -> DataFrame:
    """Links ``(a, b)`` between messages, and between messages and the nodes of their conversation identifiers.

    ``reply_to`` holds one message identifier, ``quotes`` an array of them; nulls give no link.
    """
    m = F.col(f"`{ident}`").cast("long").alias("a")
    parts = []
    if conversation:
        parts.append(messages.filter(F.col(f"`{conversation}`").isNotNull()).select(m, conversation_node(F.col(f"`{conversation}`")).alias("b")))
    if reply_to:
        parts.append(messages.select(m, F.col(f"`{reply_to}`").cast("long").alias("b")).dropna())
    if quotes:
        parts.append(messages.select(m, F.explode(F.col(f"`{quotes}`").cast("array<bigint>")).alias("b")).dropna())
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_MET = "comp bigint, id bigint, at bigint, who int, next_comp bigint, next_id bigint, next_who int, edge int, part int"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each message of a sorted range with the one after it; ``edge`` is 1 for the first of the range, 2 for the last, 3 for the only one."""
    part, held, first = TaskContext.get().partitionId(), None, True
    names = [f.split()[0] for f in _MET.split(", ")]
    kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 2 + [pa.int32()] * 3

    def rows(now: list[np.ndarray], after: list[np.ndarray], edge: np.ndarray) -> pa.RecordBatch:
        values = [*now, after[0], after[1], after[3], edge, np.full(len(edge), part)]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

    for b in batches:
        if not b.num_rows:
            continue
        now = [c.to_numpy() for c in b.columns]
        if held is not None:
            now = [np.concatenate([h, c]) for h, c in zip(held, now, strict=True)]
        n = len(now[0])
        if n > 1:
            edge = np.zeros(n - 1, np.int32)
            edge[0] = int(first)
            first = False
            yield rows([c[:-1] for c in now], [c[1:] for c in now], edge)
        held = [c[-1:] for c in now]
    if held is not None:
        yield rows(held, held, np.array([3 if first else 2], np.int32))


def neighbours(rows: DataFrame) -> DataFrame:
    """Messages ``(comp, id, at, who)`` with the next one of all in the order of comp, at, who, id; the very last one has nulls."""
    met = cut(rows.select("comp", "id", "at", F.col("who").cast("int").alias("who")).orderBy("comp", "at", "who", "id").mapInArrow(_meet, _MET))
    # the ends of the ranges: at most two rows a range, so this window is bounded by the number of partitions
    ends = Window.orderBy("part", "edge")
    last = met.filter("edge > 0").select("*", *[F.lead(c).over(ends).alias(f"n_{c}") for c in ("comp", "id", "who")]).filter("edge >= 2")
    last = last.select("comp", "id", "at", "who", F.col("n_comp").alias("next_comp"), F.col("n_id").alias("next_id"), F.col("n_who").alias("next_who"))
    return met.filter("edge < 2").drop("edge", "part").unionByName(last)


def rebuild_conversations(messages: DataFrame, links: DataFrame) -> DataFrame:
    """Reply pairs ``(component, user_id, assistant_id, turn_at)`` of every sound conversation.

    ``messages`` has ``id`` BIGINT, ``at`` BIGINT (instant, null if unreadable) and ``who`` (0 user, 1 assistant, null
    unknown), one row an id; ``links`` is what ``message_links`` gives. Conversations are the components of the links;
    a message without links is one of its own. A conversation is sound if every message has an instant and a speaker
    and they run user, assistant, ..., assistant by instant (a user first at equal instants, then the smaller id);
    all others are dropped whole. Empty tables give no rows.
    """
    parts = connected_components(links, "a", "b")
    messages = messages.select("id", "at", "who")
    # the components' table has one row a node, so this join is even however long a conversation is
    rows = cut(messages.join(parts, messages["id"] == parts["node"], "left").select("id", "at", "who", F.coalesce("component", "id").alias("comp")))
    broken = F.col("at").isNull() | F.col("who").isNull()
    met = cut(neighbours(rows.filter(~broken)))
    same = F.coalesce(F.col("next_comp") == F.col("comp"), F.lit(False))
    faults = met.select("comp", F.when(same & (F.col("who") == F.col("next_who")), 1).otherwise(0).alias("fault"), F.when(~same, F.col("who")).alias("closing"))
    faults = faults.unionByName(rows.filter(broken).select("comp", F.lit(1).alias("fault"), F.lit(None).cast("int").alias("closing")))
    # speakers that take turns and close with the assistant began with the user if their number is even
    sound = cut(faults.groupBy("comp").agg(F.count("*").alias("n"), F.sum("fault").alias("faults"), F.max("closing").alias("closing")).filter("faults = 0 and closing = 1 and n % 2 = 0").select("comp"))
    pairs = met.filter(same & (F.col("who") == 0) & (F.col("next_who") == 1)).select("comp", F.col("id").alias("user_id"), F.col("next_id").alias("assistant_id"), F.col("at").alias("turn_at"))
    return skew_join(pairs, sound, "comp").withColumnRenamed("comp", "component").select("component", "user_id", "assistant_id", "turn_at")


def session_messages(entries: DataFrame) -> DataFrame:
    """Messages ``(id, at, who, conversation)`` of a session log, one row an ``entry_id``.

    Rows of type 'queue-operation', with null or blank content, without ``entry_id`` or without session are no
    messages. Deliveries of one message agree in all that counts here, so their minima stand for them.
    """
    kept = entries.filter(
        F.col("entry_id").isNotNull() & F.col("session_id").rlike(r"(?U)\S") & F.col("content").rlike(r"(?U)\S") & ~F.coalesce(F.lower(F.trim("type")) == "queue-operation", F.lit(False))
    )
    return kept.groupBy(F.col("entry_id").alias("id")).agg(F.min(instant(F.col("timestamp"))).alias("at"), F.min(speaker(F.col("role"), F.col("type"))).alias("who"), F.min("session_id").alias("session_id"))


def session_reply_pairs(entries: DataFrame) -> DataFrame:
    """``(session_id, entry_a, entry_b)``: the reply pairs of kept sessions, the smaller entry first."""
    messages = cut(session_messages(entries))
    names = cut(conversation_nodes(messages, "session_id"))
    links = skew_join(messages, names, "session_id").select(F.col("id").alias("a"), F.col("node").alias("b"))
    pairs = rebuild_conversations(messages, links)
    named = skew_join(cut(pairs), names.withColumnRenamed("node", "component"), "component")
    return named.select("session_id", F.least("user_id", "assistant_id").alias("entry_a"), F.greatest("user_id", "assistant_id").alias("entry_b"))


def chained_reply_pairs(entries: DataFrame) -> DataFrame:
    """``(entry_a, entry_b)``: reply pairs where messages carry no session but the message they answer.

    The links are made from the log's order: each message replies to the one before it, and quotes the one before that.
    """
    messages = cut(session_messages(entries))
    ordered = neighbours(messages.withColumn("at", F.coalesce("at", F.lit(0).cast("long"))).withColumn("who", F.coalesce("who", F.lit(2))).withColumn("comp", F.xxhash64("session_id")))
    step = cut(ordered.filter("comp = next_comp").select(F.col("next_id").alias("id"), F.col("id").alias("reply_to")))
    quoted = step.join(step.select(F.col("id").alias("reply_to"), F.col("reply_to").alias("before")), "reply_to", "left").select("id", "reply_to", F.when(F.col("before").isNotNull(), F.array("before")).alias("quotes"))
    pairs = rebuild_conversations(messages, message_links(quoted, "id", reply_to="reply_to", quotes="quotes"))
    return pairs.select(F.least("user_id", "assistant_id").alias("entry_a"), F.greatest("user_id", "assistant_id").alias("entry_b"))
