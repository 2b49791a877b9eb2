"""Session log, feedback and conversation lists as merges over append tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import collapsed, title_of


def append_turns(messages: DataFrame, turns: DataFrame) -> DataFrame:
    """The rows that turns add: a user's and an assistant's message each, numbered on from the session's last.

    turns: (session_id, seq, question, answer, sources, created_at); seq orders turns of a session.
    """
    last = messages.groupBy("session_id").agg(F.max("idx").alias("last"))
    rows = turns.join(last, "session_id", "left")
    turn = F.row_number().over(Window.partitionBy("session_id").orderBy("seq")) - 1
    rows = rows.withColumn("base", F.coalesce(F.col("last"), F.lit(-1)) + 1 + 2 * turn)
    pair = F.array(
        F.struct(F.lit("user").alias("role"), F.col("question").alias("content"), F.lit("[]").alias("sources")),
        F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content"), F.coalesce("sources", F.lit("[]")).alias("sources")),
    )
    rows = rows.select("session_id", "base", "created_at", F.posexplode(pair).alias("k", "m"))
    return rows.select("session_id", (F.col("base") + F.col("k")).cast("long").alias("idx"), "m.role", "m.content", "m.sources", "created_at")


def session_messages(messages: DataFrame, session_id: str | None = None) -> DataFrame:
    """Messages in order with their sources decoded; unknown keys are dropped, bad JSON is an empty list."""
    rows = messages if session_id is None else messages.filter(F.col("session_id") == session_id)
    none = F.array().cast(schema.SOURCE)
    return rows.withColumn("sources", F.coalesce(F.from_json("sources", schema.SOURCE), none)).orderBy("session_id", "idx")


def history(messages: DataFrame, session_id: str, inline: DataFrame | None = None) -> DataFrame:
    """(role, content) in order: the caller's own messages, or the stored ones if there are none."""
    if inline is not None and not inline.isEmpty():
        return inline.orderBy("idx").select("role", "content")
    return messages.filter(F.col("session_id") == session_id).orderBy("idx").select("role", "content")


def upsert_feedback(events: DataFrame, keys: list[str], seq: Column, extra_first: list[str] | None = None) -> DataFrame:
    """One row a key: rating and created_at of the last event, the question and answer of the first."""
    first = ["question", "answer"] if extra_first is None else extra_first
    return events.withColumn("__seq", seq).groupBy(*keys).agg(
        F.max_by("rating", "__seq").alias("rating"), F.max_by("created_at", "__seq").alias("created_at"), *(F.min_by(c, "__seq").alias(c) for c in first)
    )


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """up, down, total."""
    up, down = F.count_if(F.col("rating") == "up"), F.count_if(F.col("rating") == "down")
    return feedback.agg(up.alias("up"), down.alias("down"), (up + down).alias("total"))


def conversation_list(messages: DataFrame, conv: str, idx: str, role: str, text: str, created: Column | None = None, updated: Column | None = None) -> DataFrame:
    """(conv, title, ...) most recently updated first; the title is the first user message that isn't blank."""
    said = (F.col(role) == "user") & (collapsed(F.coalesce(text, F.lit(""))) != "")
    out = messages.groupBy(conv).agg(
        F.coalesce(F.min_by(F.when(said, title_of(text)), F.when(said, F.col(idx))), F.lit("New conversation")).alias("title"),
        *([F.min(created).alias("created_at")] if created is not None else []),
        *([F.max(updated).alias("updated_at")] if updated is not None else []),
    )
    order = [F.col(c).desc() for c in ("updated_at", "created_at") if c in out.columns]
    return out.orderBy(*order, conv)


def drop_last_exchange(messages: DataFrame, session: str = "session_id", idx: str = "idx", role: str = "role") -> DataFrame:
    """Messages before each session's last user message; sessions without one stay whole."""
    last = F.max(F.when(F.col(role) == "user", F.col(idx))).over(Window.partitionBy(session))
    return messages.withColumn("__last", last).filter(F.col("__last").isNull() | (F.col(idx) < F.col("__last"))).drop("__last")


def put_conversation(store: DataFrame, changed: DataFrame, id_col: str = "id") -> DataFrame:
    """store with changed conversations in the place of those with their ids."""
    return store.join(changed.select(id_col), id_col, "left_anti").unionByName(changed)


def read_store(raw: DataFrame, version: int, kind: str, col: str = "value") -> DataFrame:
    """Conversations of stored JSON; corrupt text or another version gives none."""
    parsed = raw.select(F.from_json(F.col(col), f"version int, activeId string, conversations array<{kind}>").alias("s"))
    return parsed.filter(F.col("s.version") == version).select(F.explode("s.conversations").alias("c")).select("c.*")


def replay(log: DataFrame, title: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(conversations: id, title, messages, created_at, updated_at; active: one row, id): the state that a log of changes leaves.

    log: (seq, op, id, messages, at), op one of create, save, delete and activate. A conversation is empty and active
    when created; saving replaces its messages and makes it active, where there is one; deleting the active one leaves
    none active; activate takes any id, null included. seq is unique. title: of the messages, title_of the first user
    message that isn't blank if not given.
    """
    by_id = Window.partitionBy("id").orderBy("seq")
    rows = log.filter(F.col("op").isin("create", "save", "delete") & F.col("id").isNotNull())
    there = F.last(F.when(F.col("op") == "create", 1).when(F.col("op") == "delete", 0), ignorenulls=True)
    rows = rows.withColumn("__there", F.coalesce(there.over(by_id), F.lit(0)))
    rows = rows.filter((F.col("op") == "delete") | (F.col("__there") == 1))  # what was saved after its end goes
    life = F.count_if(F.col("op") == "create").over(by_id)
    rows = rows.withColumn("__life", life)
    last = rows.groupBy("id").agg(F.max_by(F.struct("op", "__life"), "seq").alias("__last"))
    alive = last.filter(F.col("__last.op") != "delete").select("id", F.col("__last.__life").alias("__life"))
    own = rows.join(alive, ["id", "__life"]).filter(F.col("op") != "delete").groupBy("id").agg(
        F.max_by("messages", F.when(F.col("op") == "save", F.col("seq"))).alias("messages"), F.min_by("at", "seq").alias("created_at"), F.max_by("at", "seq").alias("updated_at")
    )
    said = F.filter("messages", lambda m: (m["role"] == "user") & (collapsed(F.coalesce(m["content"], F.lit(""))) != ""))
    named = F.coalesce(title_of(F.try_element_at(said, F.lit(1))["content"]), F.lit("New conversation")) if title is None else title
    conversations = own.select("id", named.alias("title"), "messages", "created_at", "updated_at")
    # who made itself active last, and whether it was deleted after; one row of either
    moves = rows.filter(F.col("op") != "delete").select("seq", "id").unionByName(log.filter("op = 'activate'").select("seq", "id"))
    active = moves.agg(F.max("seq").alias("seq"), F.max_by(F.struct("id"), "seq").alias("m")).select("seq", F.col("m.id").alias("id"))
    ends = log.filter("op = 'delete'").select(F.col("id").alias("__gone"), F.col("seq").alias("__end"))
    active = active.join(ends, (F.col("id") == F.col("__gone")) & (F.col("__end") > F.col("seq")), "left").agg(F.max(F.when(F.col("__gone").isNull(), F.col("id"))).alias("id"))
    return conversations, active


def snapshot(conversations: DataFrame, active: DataFrame, version: int = 1) -> DataFrame:
    """(value): the store as one JSON text a conversation's client reads whole; for one user's conversations, which are few.

    read_store() reads it back.
    """
    listed = conversations.agg(F.sort_array(F.collect_list(F.struct(*conversations.columns))).alias("conversations"))
    rows = listed.join(F.broadcast(active.select(F.col("id").alias("activeId"))))  # one row each
    return rows.select(F.to_json(F.struct(F.lit(version).alias("version"), "activeId", "conversations")).alias("value"))
