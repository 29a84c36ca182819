"""Readers: chat exports (text) and message tables (CSV, Parquet)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tertulia.fixed_values import CSV_MISSING
from tertulia.operators.ingest import assemble_messages
from tertulia.operators.ranking import running_offsets
from tertulia.schema import MESSAGES_CSV

_ROW_BITS = 33   # monotonically_increasing_id keeps the row number of a partition in these
_CHUNK_BITS = 20  # a block holds at most 2**20 lines


def read_chat_lines(
    spark: SparkSession,
    paths: str | Sequence[str],
    chat_id: Column | None = None,
    part: Column | None = None,
) -> DataFrame:
    """Physical lines of chat exports, in an order that survives shuffles.

    A file is one chat by default, named by its path.  ``chat_id`` may derive another name
    from ``_metadata`` or a partition column; when a chat then has several files, ``part``
    must name a column that orders them (for instance the file name).  Large files are
    read in splits; a block is a split, or a piece of one when the split has many lines.

    Split sizes follow the session's settings and number of cores when a read is planned.  What reads these
    lines more than once (``anonymize`` does) needs equal splits each time: keep ``spark.sql.files.minPartitionNum``
    and the cores fixed, or stage the parsed lines as the anonymise job does.  Assembly fails rather than
    number wrongly when they differ.
    """
    return _scan(spark, paths, F.col("_metadata.file_path") if chat_id is None else chat_id, F.lit("") if part is None else part)


def _scan(spark: SparkSession, paths: str | Sequence[str], chat_id: Column, part: Column, **options) -> DataFrame:
    return (
        spark.read.options(**options).text(list(paths) if not isinstance(paths, str) else paths)
        .withColumn("row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        .select(
            chat_id.alias("chat_id"),
            part.alias("part"),
            F.shiftleft(F.col("_metadata.file_block_start"), _ROW_BITS - _CHUNK_BITS)
            .bitwiseOR(F.shiftright("row", _CHUNK_BITS)).alias("block"),
            F.col("row").alias("seq"),
            "value",
        )
    )


def read_messages_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType = MESSAGES_CSV,
    missing: Sequence[str] = CSV_MISSING,
    multi_line: bool = True,
) -> DataFrame:
    """Message table from CSV with a header; texts in ``missing`` are read as NULL.

    With ``multi_line`` fields in quotes may hold line breaks; large files are still read in splits
    (``csv_records``).  Without, every line is a record and Spark's reader is used.
    """
    if multi_line:
        df = csv_records(spark, path, schema)
    else:
        df = (
            spark.read.option("header", True).option("quote", '"').option("escape", '"').option("enforceSchema", False)
            .schema(schema).csv(list(path) if not isinstance(path, str) else path)
        )
    texts = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~F.col(c).isin(*missing), F.col(c)) for c in texts})


def csv_records(spark: SparkSession, path: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """Records of CSV files whose quoted fields may hold line breaks, each file read by as many tasks as it has splits.

    A quote outside a field opens one, the next closes it, and a doubled quote does both, so whether a line starts inside a
    field is the parity of the quotes before it: counted per block, summed over the blocks of a file (one row each),
    and carried into every block.  Lines that start outside begin a record; the others are joined to it.  Files must
    quote fields that hold quotes, as every CSV writer does; header names must be the schema's, in order.
    """
    lines = _scan(spark, path, F.col("_metadata.file_path"), F.lit(""), lineSep="\n")
    odd = F.pmod(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))), F.lit(2))
    lines = lines.withColumn("odd", odd)
    key = ["chat_id", "part", "block"]
    blocks = running_offsets(lines.groupBy(*key).agg(F.sum("odd").alias("n")), ["chat_id"], ["part", "block"], "n", "before")
    earlier = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    quotes = F.col("before") + F.coalesce(F.sum("odd").over(earlier), F.lit(0))
    known = lines.join(blocks.drop("n"), key).withColumn("is_header", F.pmod(quotes, F.lit(2)) == 0)
    none = F.lit(None).cast("string")
    parts = known.select(*key, "seq", "is_header", none.alias("timestamp"), none.alias("sender"), F.col("value").alias("text"))
    # Where records end in CR LF, line breaks inside fields are read as LF, as Spark's whole-file reader does.
    bare = F.replace(F.substring("message", F.lit(1), F.length("message") - 1), F.lit("\r\n"), F.lit("\n"))
    records = assemble_messages(parts).withColumn("record", F.when(F.endswith("message", F.lit("\r")), bare).otherwise(F.col("message")))
    # Spark's own parser takes one record at a time.
    options = {"quote": '"', "escape": '"', "multiLine": "true"}
    head = F.from_csv("record", ", ".join(f"c{i} string" for i in range(len(schema.names))), options)
    same = F.array(*[head[f"c{i}"] for i in range(len(schema.names))]) == F.array(*[F.lit(n) for n in schema.names])
    wrong = F.raise_error(F.concat(F.lit("CSV header is not " + ",".join(schema.names) + ": "), F.col("record"))).cast("boolean")
    kept = records.where(F.when(F.col("msg_idx") > 1, F.col("record") != "").otherwise(F.when(same, False).otherwise(wrong)))
    return kept.select(F.from_csv("record", schema.simpleString(), options).alias("r")).select("r.*")


def read_messages(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Message table from Parquet."""
    return spark.read.parquet(*([path] if isinstance(path, str) else path))
