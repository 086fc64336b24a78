"""Chat-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tally.operators import chat, chat_store
from tally.plans import roles
from tally.sources.scratch import scratch_path

NOW = "timestamp '2024-01-20 00:00:00'"


def _profiles(s, d):
    c = roles.table(s, d, "customer")
    meta = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('{"username": "u'), F.col("c_custkey").cast("string"), F.lit('"}'))).otherwise(F.lit("{}"))
    email = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.org"))
    return c.select("c_custkey", chat.profile_name(meta, email).alias("name"))


def pending_latest(s, d):
    done, waiting = chat.settle(roles.pending(s, d))
    return done.withColumn("place", F.lit("log")).union(waiting.withColumn("place", F.lit("pending")))


def chat_store_changes(s, d):
    """Stored sessions and messages after a rename by users, some of them not the owner, and a deletion; with the counts that the two gave."""
    log = roles.chat(s, d)
    sessions, messages = scratch_path(s, "chat-sessions"), scratch_path(s, "chat-messages")
    chat_store.write(log.groupBy("session", "user_id").agg(F.count("*").alias("messages")).withColumn("title", F.lit("untitled")), sessions, "session")
    chat_store.write(log.select("session", "turn", "role", "text"), messages, "session")
    some = log.select("session", "user_id").distinct()
    titles = some.filter("session % 3 = 0").select("session", F.when(F.col("session") % 2 == 0, F.col("user_id")).otherwise(F.col("user_id") + 1).alias("user_id"), F.concat(F.lit("Chat "), F.col("session").cast("string")).alias("title"))
    renamed = chat_store.rename(s, sessions, titles)
    gone = chat_store.delete(s, [sessions, messages], some.filter("session % 5 = 0"))
    left = chat_store.read(s, messages).groupBy("session").agg(F.count("*").alias("stored"))
    return chat_store.read(s, sessions).join(left, "session", "left").select("session", "user_id", "title", "messages", "stored", F.lit(renamed).alias("renamed"), F.lit(gone[0]).alias("deleted_sessions"), F.lit(gone[1]).alias("deleted_messages"))


def pending_expire(s, d):
    """Stored updates of pending messages after those of expired messages are deleted, with their count."""
    folder = scratch_path(s, "pending")
    chat_store.write(roles.pending(s, d), folder, "message_id")
    n = chat_store.expire(s, folder, F.expr(NOW))
    return chat_store.read(s, folder).agg(F.count("*").alias("stored"), F.count_distinct("message_id").alias("messages")).withColumn("deleted", F.lit(n))


QUERIES = {
    "chat_sessions": lambda s, d: chat.sessions(roles.chat(s, d)).select("session", "user_id", "messages", F.unix_timestamp("created_at").alias("created"), F.unix_timestamp("updated_at").alias("updated")),
    "chat_pairs": lambda s, d: chat.pairs(roles.chat(s, d)).select("session", "turn", "content", "reply"),
    "chat_unpivot": lambda s, d: chat.unpivot(chat.pairs(roles.chat(s, d))),
    "chat_rls": lambda s, d: chat.visible(roles.chat(s, d), 3).select("session", "turn", "role", "text"),
    "chat_cascade": lambda s, d: chat.delete_sessions(roles.chat(s, d), roles.chat(s, d).filter("session % 5 = 0").select("session").distinct()).groupBy("session").agg(F.count("*").alias("n")),
    "chat_store": chat_store_changes,
    "pending_expire": pending_expire,
    "profile_default": _profiles,
    "pending_latest": pending_latest,
    "pending_ttl": lambda s, d: chat.expired(roles.pending(s, d), F.expr(NOW)).select("message_id", F.unix_timestamp("last").alias("last")),
}

_CHAT = "WITH chat AS (SELECT conv_id AS session, turn, role, text, conv_id % 7 AS user_id, 1704067200 + conv_id * 3600 + turn * 60 AS made FROM conversations), pairs AS (SELECT session, turn, text AS content, lead(text) OVER w AS reply, role, lead(role) OVER w AS next_role FROM chat WINDOW w AS (PARTITION BY session ORDER BY turn)), p AS (SELECT session, turn, content, reply FROM pairs WHERE role = 'user' AND next_role = 'assistant') "
PENDING = "WITH u AS (SELECT event_id, user_id || '|' || strftime(ts, '%Y%m%d%H') AS message_id, user_id, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'entities_ready' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'error' END AS status, ts FROM events WHERE event_type IN ('view', 'click', 'purchase', 'error')) "

SQL = {
    "chat_sessions": _CHAT + "SELECT session, user_id, count(*) AS messages, min(made) AS created, max(made) AS updated FROM chat GROUP BY ALL ORDER BY updated DESC, session LIMIT 50",
    "chat_pairs": _CHAT + "SELECT * FROM p",
    "chat_unpivot": _CHAT + "SELECT session, turn, 'user' AS role, coalesce(content, '') AS text, 0 AS side FROM p UNION ALL SELECT session, turn, 'assistant', coalesce(reply, ''), 1 FROM p",
    "chat_rls": _CHAT + "SELECT session, turn, role, text FROM chat WHERE user_id = 3",
    "chat_cascade": _CHAT + "SELECT session, count(*) AS n FROM chat WHERE session % 5 <> 0 GROUP BY 1",
    "chat_store": _CHAT + "SELECT session, user_id, CASE WHEN session % 6 = 0 THEN 'Chat ' || session ELSE 'untitled' END AS title, count(*) AS messages, count(*) AS stored, (SELECT count(DISTINCT session) FROM chat WHERE session % 6 = 0)::INTEGER AS renamed, (SELECT count(DISTINCT session) FROM chat WHERE session % 5 = 0)::INTEGER AS deleted_sessions, (SELECT count(*) FROM chat WHERE session % 5 = 0)::INTEGER AS deleted_messages FROM chat WHERE session % 5 <> 0 GROUP BY session, user_id",
    "pending_expire": PENDING + ", o AS (SELECT message_id FROM u GROUP BY 1 HAVING max(ts) < timestamp '2024-01-20 00:00:00' - interval 5 minute) SELECT count(*) AS stored, count(DISTINCT message_id) AS messages, (SELECT count(*) FROM u WHERE message_id IN (FROM o))::INTEGER AS deleted FROM u WHERE message_id NOT IN (FROM o)",
    "profile_default": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'u' || c_custkey ELSE split_part(lower(replace(c_name, '#', '.')) || '@example.org', '@', 1) END AS name FROM customer",
    "pending_latest": PENDING + "SELECT message_id, arg_max(user_id, struct_pack(t := ts, e := event_id)) AS user_id, arg_max(status, struct_pack(t := ts, e := event_id)) AS status, count(*) AS updates, CASE WHEN arg_max(status, struct_pack(t := ts, e := event_id)) = 'complete' THEN 'log' ELSE 'pending' END AS place FROM u GROUP BY 1",
    "pending_ttl": PENDING + "SELECT message_id, floor(epoch(max(ts)))::BIGINT AS last FROM u GROUP BY 1 HAVING max(ts) < timestamp '2024-01-20 00:00:00' - interval 5 minute",
}
