"""Personal data: exact patterns, and terms that reveal the entities the patterns find.

Protected entities are the values of e-mail addresses, IP addresses, card and phone numbers.  Which other
terms give an entity away is estimated from the corpus: a term that stands near an entity in several distinct
contexts, and rarely elsewhere, carries most of the entity's information.  With N distinct texts, n(e)
distinct contexts of the entity, n(e, t) of them with the term and n(t) texts with the term,

    PMI(e, t) = log(N n(e, t) / (n(e) n(t)))      IC(e) = log(N / n(e))

a term is disclosing when n(e, t) >= ``min_support`` and PMI >= ``threshold`` x IC.  Disclosing terms are marked
(and generalised by ``sanitise``) in the texts that hold their entity.  A context is the words around
an occurrence, other findings left out; equal contexts count once, so copies of a text are no evidence.

Defined results: NULL text counts as empty and stays NULL when sanitised; texts without findings stay as
they are; repeated rows are treated alike; an empty table gives an empty table; input columns named
spans, base_spans or values are replaced in ``find``.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tertulia.llm.common import checkpointed, text_of, words_of

BROADCAST_TERMS = 200_000
KINDS = ("email", "ip", "card", "phone")
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive, and only from the start of a run of digits: linear, with the same leftmost matches.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
WORD = re.compile(r"\S+")
EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")


@dataclass(frozen=True)
class Disclosure:
    min_support: int = 3
    threshold: float = 0.8
    reach: int = 10  # words on each side
    min_letters: int = 3


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_findings(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value), by kind as in ``KINDS``, then start."""
    found = [("email", a, b, text[a:b].lower()) for a, b in _emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return found
    for m in IP.finditer(text):
        # a part of many digits is above 255 unless the front ones are zeros
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end(), m[0]))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end(), digits))
    for m in PHONE.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 9 <= len(digits) <= 15:
            found.append(("phone", m.start(), m.end(), digits))
    return found


def _term(word: str, least: int) -> str | None:
    word = EDGE.sub("", word.lower())
    return word if sum(map(str.isalpha, word)) >= least else None


def _contexts(text: str, found: list, rule: Disclosure) -> list[tuple[str, list[str]]]:
    """For each finding the terms among ``reach`` words on each side, in order, other findings left out."""
    words, begins, ends, at = [], [], [], 0
    # The words between findings, in page order, however long they or the texts are.
    for a, b in [*sorted((a, b) for _, a, b, _ in found), (len(text), len(text))]:
        for m in WORD.finditer(text, at, max(at, a)):
            words.append(m[0])
            begins.append(m.start())
            ends.append(m.end())
        at = max(at, b)
    out = []
    for kind, a, b, value in found:
        i, j = bisect_right(ends, a), bisect_left(begins, b)
        around = words[max(0, i - rule.reach):i] + words[j:j + rule.reach]
        out.append((f"{kind}:{value}", [t for t in (_term(w, rule.min_letters) for w in around) if t]))
    return out


_FOUND = T.StructType([
    T.StructField("base_spans", T.StringType()), *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS],
    T.StructField("values", T.ArrayType(T.StringType())),
])


def _scanner(mask: bool = False):
    """The base findings of a text; with ``mask`` also the text without them, NULL where there are none."""
    schema = T.StructType([*_FOUND.fields, *[T.StructField("__masked", T.StringType())][:mask]])

    @F.pandas_udf(schema)
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            found = base_findings(text or "")
            kinds = [f[0] for f in found]
            spans = ",".join(f"{k}:{a}:{b}" for k, a, b, _ in found)
            row = (spans, *map(kinds.count, KINDS), sorted({f"{k}:{v}" for k, _, _, v in found}))
            rows.append((*row, _mask(text, spans) if spans else None) if mask else row)
        return pd.DataFrame(rows, columns=schema.names)
    # A filter on the result of a deterministic function is pushed below it, which runs the function twice, by a worker each.
    return scan.asNondeterministic()


def contexts(docs: DataFrame, text: str = "text", rule: Disclosure = Disclosure()) -> DataFrame:
    """Distinct (h, value, context): hashes of texts and the terms around each occurrence of each entity."""
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def near(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            found = base_findings(t or "")
            out.append([f"{v}\n{' '.join(terms)}" for v, terms in _contexts(t, found, rule)] if found else [])
        return pd.Series(out)

    each = docs.select(F.xxhash64(text_of(text)).alias("h"), F.explode(near(text)).alias("c"))
    return each.select(
        "h", F.substring_index("c", "\n", 1).alias("value"), F.substring_index("c", "\n", -1).alias("context")).distinct()


def disclosing_terms(docs: DataFrame, text: str = "text", rule: Disclosure = Disclosure()) -> DataFrame:
    """(value, term, n_both, n_value, n_term, share): terms that reveal an entity, by corpus co-occurrence."""
    found = checkpointed(contexts(docs, text, rule))
    seen = found.select("value", "context").distinct()
    words = F.explode(F.array_distinct(F.split("context", " "))).alias("term")
    entities = seen.groupBy("value").agg(F.count("*").alias("n_value")).where(F.col("n_value") >= rule.min_support)
    pairs = (
        seen.select("value", words).where("term <> ''")
        .groupBy("value", "term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= rule.min_support)
    )
    texts = docs.select(text_of(text).alias("text"), F.xxhash64(text_of(text)).alias("h"))
    n_texts = max(2, texts.select("h").distinct().count())

    def share(n_term: str) -> Column:
        pmi = F.log(F.lit(float(n_texts)) * F.col("n_both") / (F.col("n_value") * F.col(n_term)))
        return pmi / F.log(F.greatest(F.lit(float(n_texts)) / F.col("n_value"), F.lit(1.000001)))

    # A term stands in at least the texts that have it near an entity; what fails by that number fails by the true one.
    near = found.select("h", words).distinct().groupBy("term").agg(F.count("*").alias("n_near"))
    pairs = pairs.join(entities, "value").join(near, "term").where(share("n_near") >= rule.threshold).drop("n_near")
    pairs = checkpointed(pairs)
    if pairs.isEmpty():  # an empty table of Python's would start Python workers
        return pairs.select(
            "value", "term", "n_both", "n_value", F.lit(None).cast("long").alias("n_term"), F.lit(None).cast("double").alias("share"))
    edge = r"^[\W\d_]+|[\W\d_]+$"
    terms = F.transform(words_of(F.lower("text")), lambda w: F.regexp_replace(w, f"(?U){edge}", ""))
    # Only words that may turn out as terms go on, as pairs of hashes: n_term counts distinct texts, as n_texts does.
    wanted = checkpointed(pairs.select(F.xxhash64("term").alias("w")).distinct())
    if wanted.count() <= BROADCAST_TERMS:  # 8 bytes each; beyond, the join shuffles both sides
        wanted = F.broadcast(wanted)
    held = texts.select("h", F.explode(F.array_distinct(F.transform(terms, lambda t: F.xxhash64(t)))).alias("w"))
    counted = held.join(wanted, "w", "left_semi").distinct().groupBy("w").agg(F.count("*").alias("n_term"))
    vocabulary = pairs.select("term").distinct().withColumn("w", F.xxhash64("term")).join(counted, "w").drop("w")
    scored = pairs.join(vocabulary, "term").withColumn("share", share("n_term")).where(F.col("share") >= rule.threshold)
    return checkpointed(scored.select("value", "term", "n_both", "n_value", "n_term", "share"))


def _term_spans(rule: Disclosure):
    @F.pandas_udf(T.StringType())
    def spans(texts: pd.Series, terms: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, terms, strict=True):
            own, base = set(own), [(a, b) for _, a, b, _ in base_findings(text)]
            hits = []
            for m in WORD.finditer(text):
                word = m[0]
                if _term(word, rule.min_letters) in own:
                    lead = len(word) - len(re.sub(r"^[\W\d_]+", "", word))
                    a = m.start() + lead
                    b = a + len(EDGE.sub("", word))
                    if not any(x < b and a < y for x, y in base):
                        hits.append(f"term:{a}:{b}")
            out.append(",".join(hits))
        return pd.Series(out)
    return spans


def _by_terms(docs: DataFrame, text: str, rule: Disclosure, mask: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """The documents with what ``find`` adds: those without a finding, and those with one; all of them first if no term reveals any."""
    scan = _scanner(mask)
    names = [c for c in docs.columns if c not in (*_FOUND.names, "spans")]
    scanned = docs.select(*names, scan(F.col(text)).alias("__f")).select(*names, "__f.*")
    terms = disclosing_terms(docs, text, rule)
    if terms.isEmpty():
        return scanned.withColumn("spans", F.col("base_spans")), None
    # texts with a revealed entity are few; all others pass without a shuffle
    marked = scanned.where(F.size("values") > 0).withColumn("__h", F.xxhash64(text_of(text)))
    own = (
        marked.select("__h", F.col(text).alias("t"), F.explode("values").alias("value")).join(terms, "value")
        .groupBy("__h").agg(F.first("t").alias("t"), F.collect_set("term").alias("terms"))
        .select("__h", _term_spans(rule)("t", "terms").alias("__terms"))
    )
    joined = marked.join(own, "__h", "left").withColumn(
        "spans", F.array_join(F.array_compact(F.array(
            F.nullif("base_spans", F.lit("")), F.nullif("__terms", F.lit("")))), ","))
    plain = scanned.where(F.size("values") == 0).withColumn("spans", F.col("base_spans"))
    return plain, joined.select(*plain.columns)


def find(docs: DataFrame, text: str = "text", rule: Disclosure = Disclosure()) -> DataFrame:
    """The documents with ``base_spans``, ``spans`` (kind:start:end), n_email, n_ip, n_card, n_phone and ``values``."""
    plain, marked = _by_terms(docs, text, rule)
    return plain if marked is None else plain.unionByName(marked)


def _mask(text: str, listed: str) -> str:
    """The text with each span replaced by its kind; overlapping spans become one."""
    parts, at = [], 0
    cut = sorted((int(a), -int(b), k) for k, a, b in (s.split(":") for s in listed.split(",")))
    for a, b, kind in cut:
        if a >= at:
            parts += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, -b)
    return "".join(parts) + text[at:]


@F.pandas_udf(T.StringType())
def masked(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """The texts with each span replaced by its kind; overlapping spans become one."""
    return pd.Series([_mask(t, s) if s else t for t, s in zip(texts, spans, strict=True)], dtype=object)


def sanitise(docs: DataFrame, text: str = "text", rule: Disclosure = Disclosure()) -> DataFrame:
    """The documents with their findings replaced; same columns, n_chars kept up to date."""
    names = docs.columns
    inner = docs.select(F.struct(*names).alias("__doc"), F.col(text).alias("__text"))
    # Base findings are masked where they are found: a second function would need a second worker beside the first.
    plain, marked = _by_terms(inner, "__text", rule, mask=True)
    out = plain.select("__doc.*", F.col("__masked").alias("__new"))
    if marked is not None:
        out = out.unionByName(marked.select(
            "__doc.*", F.when(F.col("spans") != "", masked("__text", "spans")).alias("__new")))
    new: dict[str, Column] = {text: F.coalesce("__new", text)}
    if "n_chars" in names:
        new["n_chars"] = F.coalesce(F.length("__new").cast(docs.schema["n_chars"].dataType), "n_chars")
    return out.withColumns(new).select(*names)
