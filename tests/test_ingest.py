import random

import pytest
from pyspark.sql import functions as F

from tertulia.functions.text import sanitize_line
from tertulia.operators import ingest
from tertulia.schema import LINES
from tertulia.sources.readers import read_chat_lines

CHAT = """\
antes de todo

3/11/25, 20:05 - Los mensajes están cifrados.
3/11/25, 20:06 - Ana Ruiz: hola
segunda línea

  tercera - x
3/11/25, 20:07 - Beto: uno: dos
3/11/25, 8:07 p. m. - Ana Ruiz: tarde
3/11/25, 20:08 - Grupo: Ana cambió
[3/11/25, 20:09] Ana: otro formato
"""


def lines_of(spark, text, block_of=lambda i: 0):
    rows = [("c", "", block_of(i), i, v) for i, v in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, LINES)


def collect(df):
    return [tuple(r) for r in df.orderBy("chat_id", "msg_idx").collect()]


@pytest.mark.parametrize("line, clean", [
    (" - x", "-x"), ("- ~ Ana", "- Ana"), ("a - ~b", "a - b"), ("\u200eA\u202fB ", "A B"),
    ("", "[Sistema]"), ("\n", ""), ("a -  - b", "a - -b"),
])
def test_sanitize(on_texts, line, clean):
    assert on_texts(sanitize_line, [line]) == [clean]


def test_headers(spark):
    parsed = ingest.parse_chat_lines(lines_of(spark, CHAT)).orderBy("seq").collect()
    assert [(r.timestamp, r.sender, r.text) for r in parsed] == [
        (None, None, "antes de todo"),
        ("3/11/25, 20:05 ", "Sistema", "Los mensajes están cifrados."),
        ("3/11/25, 20:06 ", "Ana Ruiz", "hola"),
        (None, None, "segunda línea"),
        (None, None, "tercera -x"),
        ("3/11/25, 20:07 ", "Beto", "uno: dos"),
        ("3/11/25, 8:07 p. m.", "Ana Ruiz", "tarde"),
        ("3/11/25, 20:08 ", "Grupo", "Ana cambió"),
        (None, None, "[3/11/25, 20:09] Ana: otro formato"),
    ]


@pytest.mark.parametrize("line, matches", [
    ("3/11/25, 20:05 - a", True), ("13/11/2025, 20:05:01 - a: b", True), ("3/11/25, 8:05 AM - a: b", True),
    ("3/11/2, 20:05 - a", False), ("3/11/25 20:05 - a: b", False), ("x 3/11/25, 20:05 - a: b", False),
    ("٣/١١/٢٥, ٢٠:٠٥ - a: b", True),
])
def test_header_forms(spark, line, matches):
    assert ingest.parse_chat_lines(lines_of(spark, line)).first().is_header is matches


def test_line_separators_inside_a_message_stay(spark):
    row = ingest.parse_chat_lines(lines_of(spark, "3/11/25, 20:05 - a: b\u2028c\u0085d")).first()
    assert row.text == "b\u2028c\u0085d"


def test_assembly_and_pseudonyms(spark):
    parsed = ingest.parse_chat_lines(lines_of(spark, CHAT))
    messages = ingest.assemble_messages(parsed)
    assert [tuple(r) for r in ingest.preamble_lines(parsed).collect()] == [("c", "", 0, 0, "antes de todo")]
    named = ingest.pseudonymize_senders(messages, ingest.pseudonyms_of_lines(parsed))
    assert [(m[3], m[4]) for m in collect(named)] == [
        ("Sistema", "Los mensajes están cifrados."),
        ("Miembro_GDG_2", "hola\nsegunda línea\ntercera -x"),
        ("Miembro_GDG_3", "uno: dos"),
        ("Miembro_GDG_2", "tarde"),
        ("Miembro_GDG_4", "Ana cambió\n[3/11/25, 20:09] Ana: otro formato"),
    ]
    assert collect(ingest.pseudonymize_senders(messages)) == collect(named)
    skipping = ingest.pseudonymize_senders(messages, prefix="P", skip_system=True)
    assert [m[3] for m in collect(skipping)] == ["Sistema", "P1", "P2", "P1", "P3"]
    text = [r.value for r in ingest.render_anonymized(named).orderBy("msg_idx", "line_no").collect()]
    assert text[1:3] == ["[3/11/25, 20:06 ] Miembro_GDG_2: hola", "segunda línea"]


def test_lines_are_masked_one_by_one(spark):
    chat = "3/11/25, 20:05 - a: tel +52\n662 123 y +52 662\nx"
    out = collect(ingest.anonymize(lines_of(spark, chat)))
    assert out[0][4] == "tel [NUMERO_OCULTO]\n662 123 y [NUMERO_OCULTO]\nx"


def random_chat(seed, n):
    rnd = random.Random(seed)
    kinds = ["", "   ", "sigue", "3/11/25, 20:05 - aviso"] + [f"3/11/25, 20:05 - s{i}: m{i}" for i in range(9)]
    return [rnd.choice(kinds) if rnd.random() < 0.5 else "más texto" for _ in range(n)]


def one_after_another(lines):
    """Sequential assembly, for comparison."""
    order, out = {}, []
    for line in lines:
        head, dash, rest = line.partition(" - ")
        if dash:
            sender, colon, text = rest.partition(": ")
            sender, text = (sender, text) if colon else ("Sistema", rest)
            order.setdefault(sender, len(order) + 1)
            out.append([sender if sender == "Sistema" else f"Miembro_GDG_{order[sender]}", text])
        elif line.strip() and out:
            out[-1][1] += "\n" + line.strip()
    return [tuple(m) for m in out]


@pytest.mark.parametrize("size", [1, 2, 7, 36, 10_000])
def test_blocks_do_not_change_the_result(spark, size):
    chat = random_chat(size, 400)
    lines = lines_of(spark, "\n".join(chat), lambda i: i // size)
    out = collect(ingest.anonymize(lines, lambda c: c))
    assert [m[1] for m in out] == list(range(1, len(out) + 1))
    assert [(m[3], m[4]) for m in out] == one_after_another(chat)


@pytest.mark.parametrize("bucket_size", [1, 3, 1000])
def test_pseudonym_buckets(spark, bucket_size):
    chat = random_chat(5, 300)
    rows = ingest.assemble_messages(ingest.parse_chat_lines(lines_of(spark, "\n".join(chat))))
    out = ingest.pseudonymize_senders(rows, bucket_size=bucket_size)
    assert [(m[3], m[4]) for m in collect(out)] == one_after_another(chat)


@pytest.mark.parametrize("split_bytes", ["200", "1000", "128m"])
def test_files_in_many_splits(spark, tmp_path, split_bytes):
    chats = {f"chat{i}": random_chat(i, 500) for i in range(3)}
    for name, chat in chats.items():
        (tmp_path / f"{name}.txt").write_bytes(b"\xef\xbb\xbf" + "\r\n".join(chat).encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1)
        lines = read_chat_lines(spark, str(tmp_path), name)
        if split_bytes == "200":
            assert lines.select("chat_id", "block").distinct().count() > 30
        out = ingest.anonymize(lines, lambda c: c).orderBy("chat_id", "msg_idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for chat_id, chat in chats.items():
        assert [(r.sender, r.message) for r in out if r.chat_id == chat_id] == one_after_another(chat)


def test_chat_in_several_files(spark, tmp_path):
    chat = random_chat(3, 300)
    folder = tmp_path / "chat_id=x"
    folder.mkdir()
    for i in range(3):
        (folder / f"part-{i}.txt").write_text("\n".join(chat[i * 100:(i + 1) * 100]) + "\n")
    lines = read_chat_lines(spark, str(tmp_path), F.col("chat_id"), F.col("_metadata.file_name"))
    out = collect(ingest.anonymize(lines, lambda c: c))
    assert [(m[3], m[4]) for m in out] == one_after_another(chat)


def test_text_is_shuffled_once(spark):
    parsed = ingest.parse_chat_lines(lines_of(spark, CHAT, lambda i: i // 3))
    df = ingest.assemble_messages(parsed)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.find("== Initial Plan ==")]
    assert any("ReusedExchange" in line and "text" in line for line in final.split("\n"))
    assert "EvalPython" not in final


def test_null_chats_and_senders_stay(spark):
    rows = [("c", 1, "t", "a", "x"), ("c", 2, "t", None, "y"), (None, 1, "t", "a", "z")]
    df = spark.createDataFrame(rows, "chat_id string, msg_idx long, timestamp string, sender string, message string")
    named = {(r.chat_id, r.msg_idx): r.sender for r in ingest.pseudonymize_senders(df).collect()}
    assert named == {("c", 1): "Miembro_GDG_1", ("c", 2): "Miembro_GDG_2", (None, 1): "Miembro_GDG_1"}
