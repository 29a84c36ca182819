import pytest
from pyspark.sql import functions as F

from tertulia.functions import redaction as R
from tertulia.functions.detectors import model_detector
from tertulia.operators import content, names

NAME, NUMBER, MAIL = R.MASKS["name"], R.MASKS["number"], R.MASKS["mail"]


@pytest.mark.parametrize("function, cases", [
    (R.redact_marks, [("a\u200eb\u200f", "ab"), ("plain", "plain")]),
    (R.redact_brackets, [
        ("a[x]b c", f"{NAME} c"),
        ("[x][y]z", NAME),
        (NUMBER, NUMBER),
        ("[LIVE CODING] hoy", f"{NAME} hoy"),
        ("[]", "[]"),
        ("[a\nb]", NAME),
    ]),
    (R.redact_phones, [
        ("+52 662 123 4567 y", f"{NUMBER} y"),
        ("+1", "+1"),
        ("+52", NUMBER),
        ("662 123 4567", "662 123 4567"),
        ("+52 (662)\n123", NUMBER),
    ]),
    (R.redact_emails, [
        ("a.b@c.mx.", MAIL),
        ("https://h/u@c.mx/p", f"https://h/{MAIL}/p"),
        ("a@b.c_d@e.f", MAIL + MAIL),
        ("a@b", "a@b"),
    ]),
    (R.redact_tilde_names, [
        ("~ Ana Maria y 3", f"{NAME} 3"),
        ("https://h/~user/x", f"https://h/{NAME}/x"),
        ("~3", "~3"),
    ]),
    (R.redact_speaker_lines, [
        ("Dra. Maria Perez - tema libre", f"{NAME} - tema libre"),
        ("hoy Ing Juan de la Cruz-IA\notra", f"{NAME} - IA"),
        ("Dra. Maria - tema", "Dra. Maria - tema"),
        ("Dra. Maria Perez - https://a-b.mx/x 👍 fin", f"{NAME} - https://a-b.mx/x 👍 fin"),
        ("https://a-b.mx Dr. Juan Perez - ver https://c-d.mx", f"{NAME} - ver https://c-d.mx"),
        ("👍Dr. Juan Perez - x", "👍Dr. Juan Perez - x"),
    ]),
    (R.redact_person_names, [
        ("vino Juan Perez y Juan Perez", f"vino {NAME} y {NAME}"),
        ("solo Juan", "solo Juan"),
        ("Taller Práctico Grande", "Taller Práctico Grande"),
        ("Nuevo Workshop", "Nuevo Workshop"),
        ("Dr. Juan Perez", f"Dr. {NAME}"),
        ("https://h/Juan Perez y Juan Perez", f"https://h/Juan Perez y {NAME}"),
        ("Juan Perez 👍 https://h/x", f"{NAME} 👍 https://h/x"),
    ]),
])
def test_steps(on_texts, function, cases):
    assert on_texts(function, [c[0] for c in cases]) == [c[1] for c in cases]


def test_all_steps_and_options(on_texts):
    text = "\u200e~ Ana y\n[Beto] +52 1 234 a@b.mx Juan Perez https://x.mx/a"
    masked = on_texts(R.redact_text, [text, None])
    assert masked == [f"{NAME}\n{NAME} {NUMBER} {MAIL} {NAME} https://x.mx/a", None]
    assert on_texts(lambda c: R.redact_text(c, null_text="None"), [None]) == ["None"]
    assert on_texts(lambda c: R.redact_text(c, detector=None), ["Juan Perez"]) == ["Juan Perez"]
    listed = R.listed_names(["ana lopez", "Beto Diaz"])
    assert on_texts(lambda c: R.redact_text(c, detector=listed), ["de ana lopez"]) == [f"de {NAME}"]


def test_masks_survive_a_second_pass(on_texts):
    text = "Dr. X [a] +52 123 x@y.z ~ Ana 3 Juan Perez 👍 www.a.b "
    once = on_texts(R.redact_text, [text])
    assert on_texts(R.redact_text, once) == once


def test_long_messages_do_not_overflow(on_texts):
    words = " ".join(["Palabra"] * 20000)
    digits = "+52 " + " ".join(["123"] * 20000)
    dotted = "a." * 50000
    results = on_texts(R.redact_text, ["~ " + words, "Dr. " + words, digits, dotted, "x" * 200000 + "@"])
    assert results[0] == NAME and results[2] == NUMBER and results[3] == dotted


def test_false_positive_filter(spark):
    spans = ["Juan Perez", "Juan", "Rigor Perez", "Google Maps", "Claude Code", "Mi Nuevo Video Hoy"]
    rows = spark.createDataFrame([(s,) for s in spans], "span string")
    assert [r.span for r in names.filter_name_candidates(rows).collect()] == ["Juan Perez"]
    own = names.filter_name_candidates(rows, exceptions=["juan p"], blocked=[])
    assert sorted(r.span for r in own.collect()) == ["Claude Code", "Google Maps", "Mi Nuevo Video Hoy", "Rigor Perez"]


def test_gazetteer(spark):
    rows = spark.createDataFrame([(1, "hoy Juan Perez y Mesa Grande")], "id int, message string")
    found = names.match_gazetteer(
        names.name_candidates(rows, ["id"]), spark.createDataFrame([("Juan",)], "name string"))
    assert [tuple(r) for r in found.collect()] == [(1, "Juan Perez")]


def test_model_detector(spark):
    def load():
        return lambda texts: [[w for w in ("ana lopez",) if w in t] for t in texts]

    rows = spark.createDataFrame(
        [(1, "soy ana lopez 👍 www.x/ana lopez"), (2, None), (3, "Dra. Ana Perez - ana lopez")], "id int, message string")
    masked = names.redact_with_model(rows, model_detector(load)).orderBy("id")
    assert [r.message for r in masked.collect()] == [
        f"soy {NAME} 👍 www.x/ana lopez", None, f"{NAME} - ana lopez"]
    by_rule = names.redact_with_model(rows, R.listed_names(["ana lopez"])).orderBy("id")
    assert by_rule.collect() == masked.collect()


def test_audit(messages):
    rows = messages(("t", "a", f"{NAME} {NAME} {NUMBER}"), ("t", "a", NAME), ("t", "b", "x"), ("t", "b", MAIL))
    found = {(r.sender, r.kind): r["count"] for r in content.redaction_counts(rows).collect()}
    assert found == {("a", "name"): 3, ("a", "number"): 1, ("b", "mail"): 1}


def test_detector_is_a_plain_expression(spark):
    rows = spark.createDataFrame([("x",)], "t string").select(R.redact_text(F.col("t")).alias("t"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan


@pytest.mark.parametrize("line, want", [
    ("Ing. Juan Lasso - tema", "[NOMBRE_OCULTO] - tema"), ("Dra. Ana Losada - x", "[NOMBRE_OCULTO] - x"),
    ("Lic. Eva de la Cruz - y", "[NOMBRE_OCULTO] - y"), ("Prof. Leo Lastra Ruiz - z", "[NOMBRE_OCULTO] - z"),
    ("Dr. Luis de Los Rios - w", "[NOMBRE_OCULTO] - w"),
])
def test_speakers_whose_surname_starts_like_an_article(on_texts, line, want):
    from tertulia.functions.redaction import redact_speaker_lines

    assert on_texts(redact_speaker_lines, [line]) == [want]
