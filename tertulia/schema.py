"""Table layouts shared by sources, operators and jobs."""

from pyspark.sql import types as T

# One row per physical line of a chat export.  (part, block, seq) orders the lines of a chat;
# a block is a bounded run of consecutive lines, never a whole chat.
LINES = T.StructType([
    T.StructField("chat_id", T.StringType()),
    T.StructField("part", T.StringType()),
    T.StructField("block", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("value", T.StringType()),
])

# One row per message; msg_idx counts the messages of a chat from 1.
MESSAGES = T.StructType([
    T.StructField("chat_id", T.StringType()),
    T.StructField("msg_idx", T.LongType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("sender", T.StringType()),
    T.StructField("message", T.StringType()),
])

# The message table as a CSV file of one chat.
MESSAGES_CSV = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("sender", T.StringType()),
    T.StructField("message", T.StringType()),
])

LEXICON = T.StructType([
    T.StructField("token", T.StringType()),
    T.StructField("pos", T.StringType()),
])
