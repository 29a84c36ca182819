"""Messages of any length as pieces, the text output's manifest, and CSV read in splits."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from tertulia.operators import ingest
from tertulia.plans import jobs
from tertulia.schema import LINES
from tertulia.sources import readers, writers
from test_ingest import CHAT, lines_of


def plain_pieces(messages, limit):
    """The definition, line by line: a line that crosses a multiple of the limit stands alone."""
    out = []
    for (chat, idx), lines in messages.items():
        at, run = 0, {}
        for i, line in enumerate(lines):
            n = len(line) + (i > 0)
            key = at // limit + (at + max(n, 1) - 1) // limit
            run.setdefault(key, (at, []))[1].append(line)
            at += n
        out += [(chat, idx, a, "\n".join(x)) for a, x in run.values()]
    return sorted(out)


@pytest.mark.parametrize("limit, width", [(1, 1), (5, 2), (40, 5), (40, 1), (10 ** 6, 2), (7, 1000)])
def test_pieces_against_the_definition(spark, limit, width):
    rng = random.Random(limit * width)
    rows, want = [], {}
    for chat in "ab":
        idx, seq = 0, 0
        for _ in range(60):
            text = "x" * rng.randint(1, 12)
            if rng.random() < 0.15:
                idx += 1
                rows.append((chat, "", seq // width, seq, f"3/11/25, 20:05 - ana: {text}"))
                want[chat, idx] = [text]
            else:
                rows.append((chat, "", seq // width, seq, text))
                if idx:
                    want[chat, idx].append(text)
            seq += 1
    rng.shuffle(rows)
    parsed = ingest.parse_chat_lines(spark.createDataFrame(rows, LINES))
    found = ingest.message_pieces(parsed, limit).collect()
    assert sorted((r.chat_id, r.msg_idx, r["at"], r.text) for r in found) == plain_pieces(want, limit)
    assert all((r.sender is not None) == (r["at"] == 0) == (r.timestamp is not None) for r in found)
    whole = {(r.chat_id, r.msg_idx): r.message for r in ingest.assemble_messages(parsed).collect()}
    assert whole == {k: "\n".join(v) for k, v in want.items()}


def test_one_header_and_five_million_lines(spark, tmp_path):
    """An export whose header form changes: one message, in bounded pieces, and a text output equal to its lines."""
    n, limit = 5_000_000, 1 << 18
    rows = spark.range(0, n + 1, 1, 16).select(
        F.lit("c").alias("chat_id"), F.lit("").alias("part"), F.shiftright("id", 17).alias("block"), F.col("id").alias("seq"),
        (F.col("id") == 0).alias("is_header"), F.when(F.col("id") == 0, "t").alias("timestamp"), F.when(F.col("id") == 0, "ana").alias("sender"),
        F.concat(F.lit("line "), F.col("id")).alias("text"))
    pieces = ingest.message_pieces(rows, limit)
    pieces.write.parquet(f"{tmp_path}/pieces")
    pieces = spark.read.parquet(f"{tmp_path}/pieces")
    size = pieces.agg(F.max(F.length("text")), F.count("*"), F.sum(F.length("text") + 1)).first()
    assert size[0] <= limit and size[1] > 200
    first = pieces.where("at = 0").select("chat_id", "msg_idx", "timestamp", "sender", F.col("text").alias("message"))
    manifest = writers.write_anonymized_text(
        first, f"{tmp_path}/text", continued=pieces.where("at > 0"), part_bytes=1 << 23).orderBy("offset").collect()
    assert len(manifest) > 4
    i, at = 0, 0
    for part in manifest:
        with open(part.path.removeprefix("file:"), encoding="utf-8") as f:
            assert part.offset == at
            for line in f:
                assert line == (f"[t] ana: line {i}\n" if i == 0 else f"line {i}\n")
                i += 1
        at += part.bytes
    assert i == n + 1 and at == size[2] + len("[t] ana: ")


def test_job_with_a_long_message(spark, tmp_path):
    long = CHAT + "\n".join(f"más {i}" for i in range(200)) + "\n"
    (tmp_path / "chat.txt").write_text(long, encoding="utf-8")
    short, cut = (jobs.run_anonymize(spark, str(tmp_path / "chat.txt"), str(tmp_path / name), max_chars=size)
                  for name, size in (("whole", 1 << 20), ("cut", 64)))
    assert short.count() == cut.count() == 5
    assert spark.read.parquet(str(tmp_path / "whole" / "continued")).count() == 0
    assert spark.read.parquet(str(tmp_path / "cut" / "continued")).count() > 10

    def text(name):
        rows = spark.read.parquet(str(tmp_path / name / "text_manifest")).orderBy("offset").collect()
        return "".join(open(r.path.removeprefix("file:"), encoding="utf-8").read() for r in rows)

    assert text("whole") == text("cut") and text("cut").count("\n") == 9 + 200


def test_second_run_keeps_pseudonyms(spark, tmp_path):
    """A file of earlier lines and new senders joins the chat; nobody's pseudonym changes."""
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "b.txt").write_text("3/11/25, 20:06 - Ana: hola\n3/11/25, 20:07 - Beto: x\n3/11/25, 20:08 - cambio\n", encoding="utf-8")
    run = lambda name, **more: jobs.run_anonymize(
        spark, str(folder), str(tmp_path / name), chat_id=F.lit("c"), part=F.col("_metadata.file_name"), names_table=str(tmp_path / "names"), **more)
    first = [r.sender for r in run("one").orderBy("msg_idx").collect()]
    assert first == ["Miembro_GDG_1", "Miembro_GDG_2", "Sistema"]
    (folder / "a.txt").write_text("3/11/25, 20:01 - Carla: antes\n3/11/25, 20:02 - Beto: y\n3/11/25, 20:03 - Dora: z\n", encoding="utf-8")
    second = [r.sender for r in run("two").orderBy("msg_idx").collect()]
    assert second == ["Miembro_GDG_4", "Miembro_GDG_2", "Miembro_GDG_5", "Miembro_GDG_1", "Miembro_GDG_2", "Sistema"]
    assert [r.sender for r in run("three").orderBy("msg_idx").collect()] == second
    assert spark.read.parquet(str(tmp_path / "names")).count() == 5


def test_manifest_of_odd_chat_names(spark, tmp_path):
    names = ["a b", "a/b", "100%", "c=d", "e+f", "ñ👍", "x:y"]
    rows = spark.createDataFrame([(n, i, "t", "s", f"text {n}") for n in [*names, None] for i in (1, 2)], "chat_id string, msg_idx long, timestamp string, sender string, message string")
    manifest = writers.write_anonymized_text(rows, f"{tmp_path}/text").collect()
    assert {r.chat_id for r in manifest} == {*names, None}
    for r in manifest:
        files = [f for f in glob.glob(f"{tmp_path}/text/*/part-*.txt") if os.path.getsize(f) == r.bytes]
        assert any(f"text {r.chat_id}" in open(f, encoding="utf-8").read() or r.chat_id is None for f in files)


def csv_texts(rng, n):
    parts = ["a", "é", '"', '""', ",", "\n", "\r\n", " ", "'", "long text ", "|", "\t"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(n)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_in_splits_equals_the_whole_file_reader(spark, tmp_path, end):
    import csv
    rng = random.Random(7)
    for name in ("a.csv", "b.csv"):
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, lineterminator=end)
            out.writerow(["timestamp", "sender", "message"])
            out.writerows([[f"t{i}", s, m] for i, (s, m) in enumerate(zip(csv_texts(rng, 3000), csv_texts(rng, 3000)))])
    whole = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').schema(
        readers.MESSAGES_CSV).csv(str(tmp_path))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        split = readers.csv_records(spark, str(tmp_path), readers.MESSAGES_CSV)
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        assert sorted(map(repr, split.collect())) == sorted(map(repr, whole.collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_csv_header_and_types(spark, tmp_path):
    (tmp_path / "n.csv").write_text('id,name\n1,"a\nb"\n\n2,\nx,c\n', encoding="utf-8")
    schema = readers.T.StructType().add("id", "integer").add("name", "string")
    assert sorted(map(tuple, readers.csv_records(spark, str(tmp_path / "n.csv"), schema).collect()), key=repr) == [(1, "a\nb"), (2, None), (None, "c")]
    (tmp_path / "w.csv").write_text("id,other\n1,a\n", encoding="utf-8")
    with pytest.raises(Exception, match="CSV header"):
        readers.csv_records(spark, str(tmp_path / "w.csv"), schema).collect()
