"""What is learned from tables: names, endings, phrase lists, date order."""

import datetime
import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tertulia.functions import name_model as N
from tertulia.functions.redaction import capitalised_names, redact_text
from tertulia.operators import leaks, names, phrases, tagging
from tertulia.operators.date_order import infer_date_order
from tertulia.operators.temporal import messages_by_day
from tertulia.schema import LEXICON

GIVEN = "Ana Luis Maria Jorge Elena Pablo Rosa Diego Carmen Hugo Irene Raul Sofia Tomas Lucia Marcos Julia Andres Clara Felipe".split()
FAMILY = "Perez Lopez Garcia Ruiz Torres Molina Castro Vega Nieto Campos Rojas Soto Fuentes Medina Cabrera Luna Reyes Ortega Salas Duran".split()
OTHER = ["Buenos Dias", "Google Cloud", "Ciudad Obregon", "Feliz Navidad", "Estados Unidos", "Gran Taller", "Muchas Gracias", "Inteligencia Artificial"]
FRAMES = [
    "hola {n}, como estas", "nos vemos con {n} en {o}", "{o} a todos", "Gracias {n} por el taller", "el curso de {o} empieza hoy.", "dice {n} que si",
    "Saludos a {n} y {m}", "Mañana hay {o}. Vamos", "{n} llega tarde", "con {n} todo bien. {o} sigue",
]


def texts(rng, n, given, family, other):
    out = []
    for i in range(n):
        name, second = (f"{rng.choice(given)} {rng.choice(family)}" for _ in "12")
        frame = rng.choice(FRAMES)
        held = [x for x, mark in ((name, "{n}"), (second, "{m}")) if mark in frame]
        out.append((i, frame.format(n=name, m=second, o=rng.choice(other)), held))
    return out


SCHEMA = "id long, text string, names array<string>"


@pytest.fixture(scope="module")
def model(spark):
    """Trained on half of the names and half of the other capitalised runs."""
    return N.train_names(spark.createDataFrame(texts(random.Random(1), 1500, GIVEN[::2], FAMILY[::2], OTHER[::2]), SCHEMA))


def plain_names(text, model):
    """The best of all paths, by dynamic programming over the definition."""
    pieces = re.findall(r"[^\W\d_]+|(?:[\W\d_])+", text)
    spots = [i for i, p in enumerate(pieces) if p[0].isalpha()]
    code = lambda w, k: ord(w[k - 1 if k > 0 else k]) if len(w) >= abs(k) else 0
    best = {0: (0.0, [])}
    for j, i in enumerate(spots):
        w, gap, before = pieces[i], pieces[i - 1] if i else "", pieces[i - 2] if i > 1 else ""
        case = 0 if w == w.lower() else 2 if len(w) > 1 and w == w.upper() else 1 if w[1:] == w[1:].lower() else 3
        blanks = bool(re.fullmatch(" +", gap))
        lead = 0 if j == 0 else 1 if re.search(r"[.!?:\n]", gap) else 2 if blanks else 3
        low, last = w.lower(), before.lower()
        seen = {"shape": case * 4 + lead, "prefix": (code(low, 1) * 961 + code(low, 2) * 31 + code(low, 3)) % 1024,
                "suffix": (code(low, -1) * 31 + code(low, -2)) % 256, "before": (code(last, 1) * 961 + code(last, -1) * 31 + len(last)) % 512}
        new = {}
        for s in range(3):
            if s == 2 and (j == 0 or not blanks):
                continue
            own = sum(model.scores[f][s][seen[f]] for f in ("shape", "prefix", "suffix", "before"))
            options = [(best[b][0] + model.scores["step"][s][b] + own, -b, b) for b in best if s != 2 or b]
            if options:
                score, _, b = max(options)
                new[s] = (score, [*best[b][1], s])
        best = new
    states = max(best.items(), key=lambda x: (x[1][0], -x[0]))[1][1] if spots else []
    found = []
    for j, s in enumerate(states):
        if s == 1:
            found.append([j, j + 1])
        elif s == 2:
            found[-1][1] = j + 1
    return ["".join(pieces[spots[a]:spots[b - 1] + 1]) for a, b in found]


def test_decoder_equals_plain_search(spark, on_texts, model):
    rng = random.Random(2)
    parts = [*GIVEN[:6], *FAMILY[:6], "hola", "de", "la", "el", ". ", ", ", "  ", "\n", "ÁNGEL", "x", "McX", "3", "!", "Buenos"]
    cases = ["", "   ", "12 3", "Ana", "Ana Ruiz", *(" ".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(150))]
    for text, found in zip(cases, on_texts(N.hmm_names(model), cases)):
        assert found == plain_names(text, model), text
    assert on_texts(N.hmm_names(model), [None]) in ([None], [[]])


def test_held_out_names(spark, model):
    """Names and other capitalised runs that training never saw; spans of two words or more, as the masks use them."""
    rows = texts(random.Random(3), 600, GIVEN[1::2], FAMILY[1::2], OTHER[1::2])
    df = spark.createDataFrame(rows, SCHEMA)

    def scores(detector):
        hit = given = real = 0
        for r in df.select("names", detector(F.col("text")).alias("found")).collect():
            found = [f for f in r.found if " " in f]
            hit += sum(n in found for n in r.names)
            given, real = given + len(found), real + len(r.names)
        return hit / given, hit / real

    precision, recall = scores(N.hmm_names(model))
    plain_precision, plain_recall = scores(capitalised_names)
    print(precision, recall, plain_precision, plain_recall)
    assert precision > 0.75 and recall > 0.85 and precision > plain_precision + 0.1
    masked = df.select(redact_text(F.col("text"), N.hmm_names(model)).alias("t")).collect()
    assert sum("OCULTO" in r.t for r in masked) > 300
    assert "EvalPython" not in df.select(N.hmm_names(model)(F.col("text")))._jdf.queryExecution().executedPlan().toString()


def test_training_counts(spark):
    rows = [(1, "ana maria de la paz ana", ["Ana Maria", "ana maria de la paz"]), (2, None, ["x"]), (3, "solo", None), (4, "", [])]
    counts = {(r.feature, r.bucket, r.state): r.n for r in N.count_names(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: v for k, v in counts.items() if k[0] == "step"} == {
        ("step", 0, 1): 1, ("step", 1, 2): 1, ("step", 2, 2): 3, ("step", 2, 0): 1, ("step", 0, 0): 1}
    empty = N.train_names(spark.createDataFrame([], SCHEMA))
    assert spark.createDataFrame([("Ana Ruiz",)], "t string").select(N.hmm_names(empty)(F.col("t"))).first()[0] is not None


def test_phrase_tables_equal_the_expression(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abÁé", k=rng.randint(1, 4)))
    spans = [" ".join(word().capitalize() for _ in range(rng.randint(1, 4))) for _ in range(400)]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(spans)] + [(900, None), (901, "Ab ab")], "id long, span string")
    listed = [" ".join(word() for _ in range(rng.randint(2, 4))).title() for _ in range(25)] + ["bé"]
    blocked = ["Ab", "Bb ab"]
    for some in (listed, listed[:3], []):
        tables = spark.createDataFrame([(p,) for p in [*some, None]], "phrase string"), spark.createDataFrame([(w,) for w in [*blocked, None]], "word string")
        found = sorted(r.id for r in phrases.filter_candidates_by_table(rows, *tables).collect())
        want = sorted(r.id for r in names.filter_name_candidates(rows, some, blocked).collect())
        assert found == want
    everything = spark.createDataFrame([("",)], "phrase string")
    assert phrases.filter_candidates_by_table(rows, everything).count() == names.filter_name_candidates(rows, [""], []).count() == 0


def test_a_million_phrases(spark):
    listed = spark.range(1_000_000).select(F.concat_ws(" ", F.substring(F.md5(F.col("id").cast("string")), 1, 6), F.substring(F.md5(F.col("id").cast("string")), 9, 7)).alias("phrase"))
    some = [r.phrase for r in listed.where("id % 9973 = 0").collect()]
    rng = random.Random(6)
    spans = [f"Xx {p} Yy" for p in some[::2]] + [p[1:-1].title() for p in some[1::2]] + [f"Zz{rng.random()} Ww{rng.random()}" for _ in range(100)]
    candidates = spark.createDataFrame([(i, s) for i, s in enumerate(spans)], "id long, span string")
    left = {r.id for r in phrases.filter_candidates_by_table(candidates, listed).collect()}
    assert left == set(range(len(some), len(spans)))


ADJECTIVES = "bonito rapido lento claro nuevo viejo alto bajo hermoso famoso curioso precioso nervioso ansioso activo creativo negativo positivo masivo amable notable estable posible visible sensible terrible horrible comodo publico logico magico tecnico clasico economico".split()
NOUNS = "cancion nacion emocion accion reunion sesion tension ciudad verdad bondad calidad libertad amistad momento documento elemento alimento viaje mensaje lenguaje paisaje libro perro gato mesa casa profesor director autor color".split()
ADVERBS = "rapidamente lentamente claramente facilmente normalmente finalmente realmente altamente solamente igualmente".split()


def test_held_out_words(spark):
    rows = [(w, p) for ws, p in ((ADJECTIVES, "ADJ"), (NOUNS, "NOUN"), (ADVERBS, "ADV")) for w in ws]
    known, held = rows[::2], rows[1::2]
    endings = tagging.learn_endings(spark.createDataFrame(known, LEXICON))
    words = spark.createDataFrame([(w,) for w, _ in held], "token string")
    found = {r.token: r.pos for r in tagging.guess_pos(words, endings).collect()}
    right = sum(found.get(w) == p for w, p in held)
    print(right, len(held))
    assert right / len(held) > 0.75
    assert {r.ending: r.pos for r in endings.collect()}["mente"] == "ADV"


@pytest.mark.parametrize("block", [1, 3, 1 << 16])
def test_date_orders(spark, block):
    day = lambda i: (i % 28 + 1, i // 28 + 1)
    rows = []
    for i in range(0, 300, 7):
        d, m = day(i)
        rows += [("dmy", i, f"{d}/{m}/24, 10:00"), ("mdy", i, f"{m}/{d}/24, 10:00"), (None, i, f"{d}/{m}/24, 9:00")]
    rows += [("same", 1, "1/1/24, 10:00"), ("same", 2, "2/2/24, 10:00"), ("unread", 1, "no date"), ("unread", 2, None)]
    df = spark.createDataFrame(rows, "chat_id string, msg_idx long, timestamp string")
    found = {r.chat_id: r for r in infer_date_order(df, block=block).collect()}
    assert {c: (r.date_order, r.ambiguous) for c, r in found.items()} == {
        "dmy": ("dmy", False), "mdy": ("mdy_fallback", False), None: ("dmy", False), "same": ("mdy_fallback", True), "unread": ("mdy_fallback", True)}
    for chat, order in (("dmy", lambda s: s.split("/")[:2]), ("mdy", lambda s: s.split("/")[1::-1])):
        own = [(int(order(t)[1]), int(order(t)[0])) for c, _, t in rows if c == chat]
        assert found[chat].back_dmy == (sum(b < a for a, b in itertools.pairwise(own)) if chat == "dmy" else found[chat].back_dmy)
        assert own == sorted(own)
    counts = messages_by_day(df, by=["chat_id"], date_order="infer").where("chat_id = 'dmy'").collect()
    want = Counter(datetime.date(2024, day(i)[1], day(i)[0]).weekday() for i in range(0, 300, 7))
    assert {r.day_idx: r["count"] for r in counts} == {k: want[k] for k in range(7)}


def test_left_names(spark):
    """Misspelt names are found by the definition (distance of all pairs), in their own chat only."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abé", k=rng.randint(3, 6)))
    texts = [(rng.choice(["x", "y", None]), " ".join(word() for _ in range(8))) for _ in range(60)] + [("x", None), ("x", "")]
    senders = [(c, f"{word().title()} {word().upper()}") for c in ("x", "y", None) for _ in range(6)] + [("x", None)]
    found = leaks.left_names(spark.createDataFrame(texts, "chat_id string, message string"), spark.createDataFrame(senders, "chat_id string, sender string"))

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        long, short = sorted((a, b), key=len, reverse=True)
        return len(long) - len(short) == 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))

    counts = Counter((c, w) for c, t in texts for w in (t or "").split() if len(w) >= 4)
    want = {(c, s, n, w, int(n != w), k) for c, s in senders for n in (s or "").lower().split() if len(n) >= 4
            for (d, w), k in counts.items() if c == d and near(n, w)}
    assert {tuple(r) for r in found.collect()} == want and len(want) > 20
