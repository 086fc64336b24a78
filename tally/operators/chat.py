"""Chat logs: sessions, messages, and pending messages that move on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The order in which a pending message moves on.
STATES = ("pending", "entities_ready", "complete", "error")


def sessions(turns: DataFrame, limit: int = 50) -> DataFrame:
    """Sessions with their messages, newest first; a session was touched last when its last message came."""
    grouped = turns.groupBy("session", "user_id").agg(F.count("*").alias("messages"), F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"))
    return grouped.orderBy(F.desc("updated_at"), "session").limit(limit)


def pairs(turns: DataFrame) -> DataFrame:
    """Messages: a user turn with the assistant turn right after it; others are incomplete and go."""
    order = Window.partitionBy("session").orderBy("turn")
    joined = turns.select("*", F.lead("role").over(order).alias("next_role"), F.lead("text").over(order).alias("reply"))
    return joined.filter("role = 'user' AND next_role = 'assistant'").select("session", "turn", "user_id", "created_at", F.col("text").alias("content"), "reply")


def unpivot(messages: DataFrame) -> DataFrame:
    """Two rows for each message: the user's and the assistant's."""
    side = lambda role, text, at: F.struct(F.lit(role).alias("role"), F.coalesce(text, F.lit("")).alias("text"), F.lit(at).alias("side"))
    both = F.explode(F.array(side("user", F.col("content"), 0), side("assistant", F.col("reply"), 1))).alias("m")
    return messages.select("session", "turn", both).select("session", "turn", "m.*")


def visible(turns: DataFrame, user_id: int) -> DataFrame:
    """What a user may see: their own rows."""
    return turns.filter(F.col("user_id") == user_id)


def delete_sessions(turns: DataFrame, deleted: DataFrame) -> DataFrame:
    """turns without those of deleted sessions (session)."""
    return turns.join(deleted, "session", "left_anti")


def latest(updates: DataFrame) -> DataFrame:
    """The latest state of each pending message, ties by the event's number."""
    last = F.max_by(F.struct("status", "user_id"), F.struct("ts", "event_id"))
    return updates.groupBy("message_id").agg(last.alias("l"), F.count("*").alias("updates")).select("message_id", "l.user_id", "l.status", "updates")


def settle(updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(done, waiting): messages that are complete, which move to the log, and the others."""
    state = latest(updates)
    done = state.filter("status = 'complete'")
    return done, state.join(done, "message_id", "left_anti")


def expired(updates: DataFrame, now, minutes: int = 5) -> DataFrame:
    """Messages whose last update is older than the time to live, with how old it is."""
    last = updates.groupBy("message_id").agg(F.max("ts").alias("last"))
    return last.filter(F.col("last") < now - F.expr(f"interval {minutes} minutes"))


def profile_name(metadata, email):
    """The user name of the metadata, else what stands before the @."""
    return F.coalesce(F.get_json_object(metadata, "$.username"), F.split_part(email, F.lit("@"), F.lit(1)))
