"""Small tables and brute-force rules for the tests of this folder."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")

EDGES = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "x " * 3000), (7, "a b c d e f g h " * 40),
    (8, "Über die Maßen 👍🏽 schön.\r\nZwei."), (9, "z" * 70000), (10, "Home | About | Contact\n" + "A plain line of words. " * 9),
    (11, "  x \x0b y\x0cz"), (12, "%%% &&& ### *** $$$ !!! ??? " * 12),
]


def documents_of(spark, rows, extra=False):
    """A documents table of (doc_id, text); with extra, columns whose names may clash with results."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    full = [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows]
    df = spark.createDataFrame(full, schema)
    if extra:
        for name in ("kept", "size", "shard", "slot", "fingerprint", "sketch", "spans", "label", "pos", "rate"):
            df = df.selectExpr("*", f"'other' AS {name}")
    return df


def save_tables(spark, folder, rows):
    documents_of(spark, rows).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return str(folder)


def texts_of(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def python_nodes(df):
    """The plan's steps that hand rows to Python workers; each one in a stage has a worker of its own in every task."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"(?:ArrowEvalPython|BatchEvalPython|MapInArrow|MapInPandas) \[?(\w+)", plan)
