import csv
import glob

from pyspark.sql import functions as F

from tertulia.functions.lexicon import spanish_adjectives
from tertulia.plans import jobs
from tertulia.sources import readers, writers
from tertulia.sources.staging import shared_folder
from tertulia.streaming.redaction import start_redaction
from test_ingest import CHAT


def text_of(folder):
    lines = []
    for path in sorted(glob.glob(f"{folder}/**/part-*", recursive=True)):
        with open(path, encoding="utf-8") as f:
            lines += f.read().split("\n")[:-1]
    return lines


def test_anonymize_and_report(spark, tmp_path):
    source = tmp_path / "chat.txt"
    source.write_text(CHAT, encoding="utf-8")
    stages = set(glob.glob(shared_folder(spark) + "/*"))
    messages = jobs.run_anonymize(spark, str(source), str(tmp_path / "out"))
    assert [r.sender for r in messages.orderBy("msg_idx").collect()] == [
        "Sistema", "Miembro_GDG_2", "Miembro_GDG_3", "Miembro_GDG_2", "Miembro_GDG_4"]
    assert text_of(tmp_path / "out" / "text") == [
        "antes de todo",
        "[3/11/25, 20:05 ] Sistema: Los mensajes están cifrados.",
        "[3/11/25, 20:06 ] Miembro_GDG_2: hola", "segunda línea", "tercera -x",
        "[3/11/25, 20:07 ] Miembro_GDG_3: uno: dos",
        "[3/11/25, 8:07 p. m.] Miembro_GDG_2: tarde",
        "[3/11/25, 20:08 ] Miembro_GDG_4: Ana cambió", "[NOMBRE_OCULTO] Ana: otro formato",
    ]
    # Staged tables hold real names and are gone.
    assert set(glob.glob(shared_folder(spark) + "/*")) == stages

    names = jobs.run_report(spark, str(tmp_path / "out" / "messages"), str(tmp_path / "report"), spanish_adjectives(spark))
    assert "adjective_frequency" in names
    for name in names:
        assert spark.read.parquet(str(tmp_path / "report" / name)).columns
    top = spark.read.parquet(str(tmp_path / "report" / "top_active_members")).orderBy("sender").collect()
    assert [(r.sender, r["count"]) for r in top] == [("Miembro_GDG_2", 2), ("Miembro_GDG_3", 1), ("Miembro_GDG_4", 1)]


def test_features(spark, tmp_path):
    with open(tmp_path / "in.csv", "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(["timestamp", "sender", "message"])
        out.writerows([["t", "ana", 'con "comillas",\ny salto'], ["t", "ana", "nan"], ["t", "Sistema", "x"], ["t", "b", ""]])
    df = readers.read_messages_csv(spark, str(tmp_path / "in.csv"))
    assert [r.message for r in df.collect()] == ['con "comillas",\ny salto', None, "x", None]
    jobs.run_features(spark, str(tmp_path / "in.csv"), str(tmp_path / "deep" / "features"))
    with open(glob.glob(str(tmp_path / "deep" / "features" / "part-*"))[0], encoding="utf-8") as f:
        rows = list(csv.DictReader(f))
    assert rows[0] == {"sender": "ana", "total_messages": "1", "total_characters": "26", "avg_message_size": "13.0"}
    assert rows[1]["total_messages"] == "0"


def test_csv_round_trip(spark, tmp_path, messages):
    df = messages(("3/1/25, 1:00 ", "a", 'x "y"\nz'), ("t", "b", "1,2")).drop("chat_id", "msg_idx")
    writers.write_csv(df, str(tmp_path / "m"))
    assert sorted(readers.read_messages_csv(spark, str(tmp_path / "m")).collect()) == sorted(df.collect())


def test_command_line(capsys):
    assert jobs.main(["what"]) == 2
    assert "anonymize" in capsys.readouterr().err


def test_stream_equals_batch(spark, tmp_path, messages):
    df = messages(("t", "a", "soy Juan Perez +52 662 1"), ("t", "b", "~ Ana https://x.mx 👍"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = start_redaction(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out")).orderBy("msg_idx").collect()
    from tertulia.functions.redaction import redact_text

    batch = df.withColumn("message", redact_text(F.col("message"))).orderBy("msg_idx").collect()
    assert streamed == batch and batch[0].message == "soy [NOMBRE_OCULTO] [NUMERO_OCULTO]"



def test_chats_keep_their_members_and_hide_their_names(spark, tmp_path):
    for name, people in (("Chat con Ana Ruiz", ("Ana Ruiz", "Beto")), ("Chat con Eva Sol", ("Eva Sol", "Carla"))):
        lines = [f"3/11/25, 20:0{i} - {p}: hola numero {i}" for i, p in enumerate(people * 2)]
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.txt").write_text("\n".join(lines) + "\n", encoding="utf-8")
    jobs.run_anonymize(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    jobs.run_report(spark, str(tmp_path / "out" / "messages"), str(tmp_path / "report"))
    top = spark.read.parquet(str(tmp_path / "report" / "top_active_members")).collect()
    assert len({(r.chat_id, r.sender) for r in top}) == 4 and {r["count"] for r in top} == {2}
    profile = spark.read.parquet(str(tmp_path / "report" / "participation_profile"))
    assert profile.count() == 4
    for path in glob.glob(f"{tmp_path}/out/**/*", recursive=True):
        assert not any(x in path for x in ("Ana", "Eva", "Chat"))
    for r in spark.read.parquet(str(tmp_path / "out" / "messages")).collect():
        assert not any(x in str(r) for x in ("Ana", "Eva", "Chat", "in/"))


def test_report_keeps_word_clouds_per_chat(spark, tmp_path, messages):
    rows = messages(*[("t", "a", "sol")] * 3).unionByName(messages(("t", "b", "luna")).selectExpr("'d' AS chat_id", "* EXCEPT (chat_id)"))
    rows.write.parquet(str(tmp_path / "messages"))
    jobs.run_report(spark, str(tmp_path / "messages"), str(tmp_path / "report"))
    terms = spark.read.parquet(str(tmp_path / "report" / "term_weights")).collect()
    assert {(r.chat_id, r.term, r.weight) for r in terms} == {("c", "sol", 1.0), ("d", "luna", 1.0)}
    assert "chat_id" in spark.read.parquet(str(tmp_path / "report" / "bigram_collocations")).columns


def test_export_without_headers(spark, tmp_path):
    (tmp_path / "x.txt").write_text("".join(f"3/11/25 20:05 line {i}\n" for i in range(20000)), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        messages = jobs.run_anonymize(spark, str(tmp_path / "x.txt"), str(tmp_path / "out"))
        assert messages.count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert text_of(tmp_path / "out" / "text") == [f"3/11/25 20:05 line {i}" for i in range(20000)]


def test_model_is_loaded_once_per_worker(spark, tmp_path):
    from tertulia.functions.detectors import model_detector

    folder = str(tmp_path)

    def load():
        import os
        import tempfile
        tempfile.mkstemp(prefix=f"load-{os.getpid()}-", dir=folder)

        def model(texts):
            assert all(t.strip() for t in texts)
            return [["Ana"] if "Ana" in t else [] for t in texts]
        return model

    found = spark.range(200).repartition(20).select(
        F.when(F.col("id") % 3 == 0, F.lit("")).otherwise(F.lit("soy Ana")).alias("t")).select(model_detector(load)(F.col("t")).alias("n"))
    assert found.where("size(n) = 1").count() == 133
    pids = [p.split("-")[-2] for p in glob.glob(f"{folder}/load-*")]
    assert len(pids) == len(set(pids)) < 20
