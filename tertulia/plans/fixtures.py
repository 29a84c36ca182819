"""Message tables derived from the driver's tables, in Spark and in DuckDB's SQL.

``v_messages``   a message per document, sent at the moment of event ``5 * doc_id``
``v_lines``      the same messages as raw export lines
``v_decorated``  the same messages with chat features added to their text
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tertulia.fixed_values import SYSTEM_SENDER

# What each tenth of the messages gets: text in front, text behind.
DECORATIONS = [
    ("", " 👍🏽👍"),
    ("", " ❤️ https://www.youtube.com/watch"),
    ("", " mira https://github.com/a/b, ok"),
    ("", " [Juan Perez] hola"),
    ("", " ~ Ana Maria"),
    ("Dra. Maria Perez - tema libre ", ""),
    ("", " hola Juan Perez y Maria Lopez"),
    ("", " 🇲🇽 https://lnkd.in/x"),
    ("", " +52 662 123 4567 x@y.mx"),
    ("", ""),
    ("Ing. Juan Lasso - tema ", ""),
    ("Dra. Ana Losada Lastra-", " y +1 (555) 010-9999"),
    ("Lic. Eva de la Cruz - ", " [Ana] a.b+c@d-e.org.mx"),
]
# Lines of one message are numbered within this width.
SEQ_WIDTH = 1_000_000
# Blocks of the line fixture cover seven messages and cut every eighth after its third line.
BLOCK_WIDTH = 7 * SEQ_WIDTH


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def v_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text", (F.col("doc_id") * 5).alias("sent"))
    # The tables are few row groups, which as many tasks would read; spread by the key of the join the texts move once.  A
    # number of partitions is kept as it is, where those sized by bytes would be few for the work on each text.
    docs = docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "sent")
    events = _table(spark, sf_dir, "events").where(F.col("event_id") % 5 == 0).select("event_id", "ts", "user_id", "event_type")
    sender = F.when(F.col("event_type") == "error", SYSTEM_SENDER).otherwise(
        F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    )
    return docs.join(events, F.col("event_id") == F.col("sent")).select(
        F.col("doc_id").alias("msg_id"),
        F.col("source").alias("chat_id"),
        sender.alias("sender"),
        "ts",
        F.date_format("ts", "dd/MM/yy, HH:mm").alias("timestamp"),
        F.col("text").alias("message"),
    )


def v_events_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events alone as messages: the temporal metrics at the size of the event table."""
    events = _table(spark, sf_dir, "events").select("ts", "event_type")
    return events.select(
        F.date_format("ts", "dd/MM/yyyy, HH:mm").alias("timestamp"),
        F.col("event_type").alias("message"),
    )


def v_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    sender = F.when(F.col("sender") == SYSTEM_SENDER, "").otherwise(F.concat("sender", F.lit(": ")))
    export = F.concat("timestamp", F.lit(" - "), sender, "message")
    lines = v_messages(spark, sf_dir).select(
        "chat_id", "msg_id", F.posexplode(F.split(export, "\n", -1)).alias("pos", "value")
    )
    seq = F.col("msg_id") * SEQ_WIDTH + F.col("pos")
    return lines.select(
        "chat_id",
        F.lit("").alias("part"),
        F.floor((seq + SEQ_WIDTH - 3) / BLOCK_WIDTH).alias("block"),
        seq.alias("seq"),
        "value",
    )


def v_decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    front = F.array(*[F.lit(f) for f, _ in DECORATIONS])
    back = F.array(*[F.lit(b) for _, b in DECORATIONS])
    spot = (F.col("msg_id") % len(DECORATIONS)).cast("int")
    return v_messages(spark, sf_dir).withColumn(
        "message", F.concat(F.get(front, spot), "message", F.get(back, spot))
    )


def _quoted(texts) -> str:
    return ", ".join("'" + t.replace("'", "''") + "'" for t in texts)


V_MESSAGES = f"""v_messages AS (
  SELECT d.doc_id AS msg_id, d.source AS chat_id,
         CASE WHEN e.event_type = 'error' THEN '{SYSTEM_SENDER}'
              ELSE 'user_' || CAST(e.user_id AS VARCHAR) END AS sender,
         e.ts AS ts, strftime(e.ts, '%d/%m/%y, %H:%M') AS timestamp, d.text AS message
  FROM documents d JOIN events e ON e.event_id = d.doc_id * 5)"""

V_EVENTS_MESSAGES = """v_events_messages AS (
  SELECT ts, strftime(ts, '%d/%m/%Y, %H:%M') AS timestamp, event_type AS message FROM events)"""

V_LINES = f"""{V_MESSAGES},
v_split AS (
  SELECT chat_id, msg_id, string_split(timestamp || ' - '
         || CASE WHEN sender = '{SYSTEM_SENDER}' THEN '' ELSE sender || ': ' END || message, chr(10)) AS parts
  FROM v_messages),
v_lines AS (
  SELECT chat_id, msg_id * {SEQ_WIDTH} + pos - 1 AS seq, parts[pos] AS value
  FROM (SELECT chat_id, msg_id, parts, unnest(range(1, len(parts) + 1)) AS pos FROM v_split))"""

V_DECORATED = f"""{V_MESSAGES},
v_decorated AS (
  SELECT msg_id, chat_id, sender, ts, timestamp,
         ([{_quoted(f for f, _ in DECORATIONS)}])[msg_id % {len(DECORATIONS)} + 1] || message
         || ([{_quoted(b for _, b in DECORATIONS)}])[msg_id % {len(DECORATIONS)} + 1] AS message
  FROM v_messages)"""
