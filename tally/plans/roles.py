"""The performance schema as views over order tables: who (group) built what (item) at which event, and how it went.

events: one for each order month and customer region. groups: nations of suppliers. attempts: order lines.
scores: parts. contests: an edition for each order year, a session-day for each order priority.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPLETE, LOADED, ATTEMPT, DISMANTLED = "Descarregat", "Carregat", "Intent", "Intent desmuntat"
STATUSES = (COMPLETE, LOADED, ATTEMPT, DISMANTLED)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of the fact for each part of its joins, so that what a task sorts does not grow with the tables.
PART_ROWS = 250_000


def parts_of(spark: SparkSession, sf_dir: str) -> int | None:
    """How many parts the joins of the fact need for PART_ROWS each, by the counts in the footers of its files; None where no more are needed than
    Spark takes by itself."""
    n = -(-table(spark, sf_dir, "lineitem").count() // PART_ROWS)
    return n if n > min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism) else None


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """df by the hash of the keys in so many parts, as a join or grouping by these keys takes it over."""
    return df.repartition(parts, *keys) if parts else df


def order_events(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """The event of each order: o_orderkey, event_id, event_date, region, the order's priority, and its own date,
    which filters on years reach the scan by."""
    t = lambda name: table(spark, sf_dir, name)
    places = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    month = F.trunc(F.col("o_orderdate").cast("date"), "month")
    number = (F.year("o_orderdate") * 100 + F.month("o_orderdate")) * 10 + F.col("r_regionkey")
    placed = dealt(t("orders"), parts, "o_custkey").join(dealt(places, parts, "c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    return placed.select("o_orderkey", number.cast("long").alias("event_id"), month.alias("event_date"), F.col("r_regionkey").alias("region_id"), F.col("r_name").alias("region"), F.col("o_orderpriority").alias("day"), F.col("o_orderdate").alias("ordered_on"))


ATTEMPT_COLUMNS = ["attempt_id", "order_key", "group_id", "item_name", "status", "day", "ordered_on", "event_id", "event_date", "date_text", "event_name", "place", "city"]
EVENT_COLUMNS = ["event_id", "event_date", "date_text", "event_name", "place", "city"]


def named(orders: DataFrame) -> DataFrame:
    """orders with what an event is called and where it is. It follows from the region, and is made when the rows have met, since it is
    longer than that."""
    text = F.when(F.col("region_id") % 2 == 0, F.date_format("event_date", "dd/MM/yyyy")).otherwise(F.date_format("event_date", "yyyy-MM-dd"))
    return orders.select("*", text.alias("date_text"), F.concat(F.lit("Fair "), "region").alias("event_name"), F.concat(F.lit("Square "), "region").alias("place"), F.col("region").alias("city"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(order_events(spark, sf_dir).select("event_id", "event_date", "region_id", "region").distinct()).select(*EVENT_COLUMNS)


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("group_id"), F.col("n_name").alias("group_name"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """attempt_id, event_id, group_id, item_name, status and the session-day of the order."""
    return attempts_at_events(spark, sf_dir).select("attempt_id", "event_id", "group_id", "item_name", "status", "day")


def attempts_at_events(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """attempts with the columns of their events, order_key and ordered_on, by one pass over the orders. Where the tables need `parts`, the
    rows of an order stay in one of them."""
    return named(attempts_in_regions(spark, sf_dir, parts)).select(*ATTEMPT_COLUMNS)


def attempts_in_regions(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """attempts_at_events() with the regions that named() makes the events' texts of."""
    t = lambda name: table(spark, sf_dir, name)
    p = F.col("l_partkey").cast("string")
    item = F.when(F.col("l_linenumber") % 4 == 0, p).when(F.col("l_linenumber") % 4 == 1, F.concat(F.lit("P"), p)).when(F.col("l_linenumber") % 4 == 2, F.concat(p, F.lit("de"))).otherwise(F.concat(F.lit("X"), p))
    status = F.when(F.col("l_returnflag") == "A", COMPLETE).when(F.col("l_returnflag") == "R", LOADED).when(F.col("l_linestatus") == "O", ATTEMPT).otherwise(DISMANTLED)
    lines = t("lineitem").select("l_orderkey", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus").alias("attempt_id"), "l_suppkey", item.alias("item_name"), status.alias("status"))
    parts = parts or parts_of(spark, sf_dir)
    orders = dealt(order_events(spark, sf_dir, parts), parts, "o_orderkey")
    joined = dealt(lines, parts, "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select("attempt_id", F.col("l_orderkey").alias("order_key"), F.col("s_nationkey").cast("long").alias("group_id"), "item_name", "status", "day", "ordered_on", "event_id", "event_date", "region_id", "region")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey").cast("string")
    full = F.floor("p_retailprice").cast("long")
    return table(spark, sf_dir, "part").select(p.alias("code"), F.concat(F.lit("P"), p).alias("external"), F.concat(p, F.lit("de")).alias("name"), full.alias("full"), (full - 100).alias("partial"), F.col("p_type").alias("tier"))


def group_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is written about a group: text_id, group_id, text."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), (F.col("doc_id") % 25).alias("group_id"), "text")


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat turns: session, turn, role, text; a turn's time is a minute for each turn after the session's hour."""
    start = F.expr("timestamp_seconds(1704067200 + conv_id * 3600 + turn * 60)")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn", "role", "text", start.alias("created_at"), (F.col("conv_id") % 7).alias("user_id"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as questions: qid, session, turn, text."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.col("conv_id").alias("session"), "turn", "text")


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status updates of messages: message_id, user_id, status, ts; a message for each user and hour."""
    kinds = F.create_map(*[F.lit(x) for x in ("view", "pending", "click", "entities_ready", "purchase", "complete", "error", "error")])
    found = stream_events(spark, sf_dir)
    message = F.concat_ws("|", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMddHH"))
    return found.select("event_id", message.alias("message_id"), "user_id", F.try_element_at(kinds, F.col("event_type")).alias("status"), "ts").filter("status IS NOT NULL")
