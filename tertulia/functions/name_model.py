"""A trained recogniser of person names: a hidden Markov model decoded inside the JVM.

A text's words (runs of letters) are a chain of three states: outside, first word of a name, later word of one.  What a word
shows are four small numbers: its case and what stands before it, its first letters, its last ones, and the word before.
``count_names`` counts them per state over labelled texts, one aggregation; ``NameModel`` turns the counts, whose
number is bounded by the sizes below, into logarithms; ``hmm_names`` is Viterbi's search as one ``aggregate`` over
the words, linear in their number: each state carries its score and the names on its best path.

A later word must follow after blanks only.  Of equal scores, outside wins, then the earlier state.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tertulia.functions.base import let
from tertulia.functions.redaction import Detector

# How many values each thing a word shows can take; three states, and as many steps before them.
SIZES = {"shape": 16, "prefix": 1024, "suffix": 256, "before": 512, "step": 3}
OUT, FIRST, LATER = 0, 1, 2
PIECE = r"\p{L}+|[^\p{L}]+"
NEVER = -1e300
DIGITS = 6  # of the logarithms kept


def _code(text: Column, at: int) -> Column:
    """Code point of the letter at a place from the start (1) or the end (-1); 0 where there is none."""
    return F.ascii(text if at == 1 else F.substring(text, at, 1))


def _seen(word: Column, low: Column, gap: Column, first: Column) -> list[Column]:
    """What a word shows by itself; ``low`` is the word in lower case, ``gap`` what stands before it, ``tail`` what the next word sees of it."""
    rest = F.substring(word, F.lit(2), F.length(word))
    case = (
        F.when(word == low, 0).when((F.length(word) > 1) & (word == F.upper(word)), 2)
        .when(rest == F.lower(rest), 1).otherwise(3)
    )
    # One blank is what stands between most words.
    lead = F.when(first, 0).when(gap == " ", 2).when(gap.rlike(r"[.!?:\n]"), 1).when(gap.rlike(r"^ +$"), 2).otherwise(3)
    return [
        (case * 4 + lead).cast("int").alias("shape"),
        ((_code(low, 1) * 961 + _code(low, 2) * 31 + _code(low, 3)) % SIZES["prefix"]).cast("int").alias("prefix"),
        ((_code(low, -1) * 31 + _code(low, -2)) % SIZES["suffix"]).cast("int").alias("suffix"),
        ((_code(low, 1) * 961 + _code(low, -1) * 31 + F.length(low)) % SIZES["before"]).cast("int").alias("tail"),
        (((gap == " ") | gap.rlike(r"^ +$")) & ~first).alias("joined"),
    ]


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def _offset(pieces: Column) -> Column:
    """Place of the first word among the pieces, which are words and gaps in turn."""
    return F.when(F.get(pieces, F.lit(0)).rlike(r"^\p{L}"), 0).otherwise(1)


def _n_words(pieces: Column) -> Column:
    return F.floor((F.size(pieces) - _offset(pieces) + 1) / 2).cast("int")


def _places(pieces: Column) -> Column:
    """Where the words stand among the pieces."""
    return F.when(F.size(pieces) > _offset(pieces), F.sequence(_offset(pieces), F.size(pieces) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))


def _gap(pieces: Column, at: Column) -> Column:
    return F.coalesce(F.get(pieces, at - 1), F.lit(""))


def labelled_states(pieces: Column, names: Column) -> Column:
    """State of each word: names are lists of words, and stand wherever their words follow one another.  NULL where there are no names."""
    words = F.transform(_places(pieces), lambda i: F.get(pieces, i))
    lists = F.filter(F.transform(names, lambda n: F.regexp_extract_all(n, F.lit(r"\p{L}+"), F.lit(0))), lambda n: F.size(n) > 0)

    def states(words: Column, lists: Column, reach: Column) -> Column:
        # A name is compared word by word: a slice would copy the text at each of its words.
        held = lambda n, j: F.forall(F.sequence(F.lit(0), F.size(n) - 1), lambda k: F.get(words, j + k).eqNullSafe(F.get(n, k)))
        begun = F.transform(words, lambda _, j: F.coalesce(F.array_max(F.transform(
            lists, lambda n: F.when((F.get(words, j) == F.get(n, F.lit(0))) & held(n, j), F.size(n)).otherwise(0))), F.lit(0)))
        return let(begun, lambda b: F.transform(b, lambda own, j: F.when(
            F.exists(reach, lambda k: F.coalesce(F.get(b, j - k), F.lit(0)) > k), LATER)
            .when(own > 0, FIRST).otherwise(OUT)))

    return let(lists, lambda ls: F.when(F.size(ls) > 0, let(words, lambda ws: let(
        F.sequence(F.lit(1), F.array_max(F.transform(ls, F.size))), lambda ks: states(ws, ls, ks)))))


def count_names(labelled: DataFrame, text: str = "text", names: str = "names") -> DataFrame:
    """(feature, bucket, state, n): how often words of each state show each value; ``names`` lists the names of a text.

    At most three times the sum of ``SIZES`` rows, whatever the input.  NULL texts teach nothing, NULL names mean none.
    Words become rows before anything is computed of them: lambdas over arrays are interpreted, columns are compiled.
    """
    named = F.coalesce(F.col(names), F.array().cast("array<string>"))

    def told(p: Column, s: Column) -> Column:
        before = lambda j: F.when(j > 0, F.coalesce(F.get(s, j - 1), F.lit(OUT))).otherwise(OUT)
        return F.transform(_places(p), lambda i, j: F.struct(
            F.get(p, i).alias("w"), _gap(p, i).alias("gap"), F.coalesce(F.get(p, i - 2), F.lit("")).alias("last"),
            (j == 0).alias("first"), F.coalesce(F.get(s, j), F.lit(OUT)).alias("s"), before(j).alias("step")))

    each = labelled.where(F.col(text).isNotNull()).select(F.explode_outer(
        let(_pieces(F.col(text)), lambda p: let(labelled_states(p, named), lambda s: told(p, s)))).alias("x"))
    each = each.where(F.col("x").isNotNull()).select("x.*")
    low, last = F.lower("w"), F.lower("last")
    before = ((_code(last, 1) * 961 + _code(last, -1) * 31 + F.length(last)) % SIZES["before"]).alias("before")
    shown = each.select("s", "step", before, *_seen(F.col("w"), low, F.col("gap"), F.col("first")))
    # Feature, value and state as one number: the aggregation's only key.
    width = max(SIZES.values())
    keys = F.array(*[(F.col(f) + i * width) * 3 + F.col("s") for i, f in enumerate(SIZES)])
    counted = shown.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    feature = F.element_at(F.array(*[F.lit(f) for f in SIZES]), F.floor(F.col("key") / (3 * width)).cast("int") + 1)
    return counted.select(
        feature.alias("feature"), (F.floor(F.col("key") / 3) % width).cast("int").alias("bucket"), (F.col("key") % 3).cast("int").alias("state"), "n")


@dataclass(frozen=True)
class NameModel:
    """Logarithms by feature, state and value; steps by state before and state."""

    scores: dict[str, list[list[float]]]

    @classmethod
    def of_counts(cls, rows: Iterable[tuple[str, int, int, int]]) -> NameModel:
        counts = {f: [[0] * size for _ in range(3)] for f, size in SIZES.items()}
        for feature, bucket, state, n in rows:
            counts[feature][state][bucket] += n
        scores = {}
        for feature, size in SIZES.items():
            if feature == "step":
                # Of a state before, how the states after it share its words.
                total = [sum(counts[feature][s][b] for s in range(3)) for b in range(3)]
                scores[feature] = [[round(math.log((counts[feature][s][b] + 1) / (total[b] + 3)), DIGITS) for b in range(3)] for s in range(3)]
            else:
                scores[feature] = [[round(math.log((c + 1) / (sum(row) + size)), DIGITS) for c in row] for row in counts[feature]]
        return cls(scores)


def train_names(labelled: DataFrame, text: str = "text", names: str = "names") -> NameModel:
    return NameModel.of_counts((r.feature, r.bucket, r.state, r.n) for r in count_names(labelled, text, names).collect())


def hmm_names(model: NameModel) -> Detector:
    """Detector: the names on the best path, as they stand in the text, in its order."""
    tables = {
        (f, s): F.split(F.lit(",".join(map(repr, model.scores[f][s]))), ",").cast("array<double>")
        for f in SIZES if f != "step" for s in range(3)
    }
    step = lambda before, state: model.scores["step"][state][before]
    spans = "array<struct<a:int,b:int>>"

    def own(state: int, acc: Column, x: Column) -> Column:
        found = (F.get(tables[f, state], v) for f, v in (("prefix", x["prefix"]), ("suffix", x["suffix"]), ("before", acc["tail"])))
        return sum(found, F.get(tables["shape", state], x["shape"]))

    def move(acc: Column, x: Column) -> Column:
        def closed(kind: str) -> Column:
            return F.concat(acc[f"{kind}_spans"], F.array(F.struct(acc[f"{kind}_from"].alias("a"), acc["j"].alias("b"))))

        def arrive(state: int) -> tuple[Column, Column]:
            o, f, m = (acc[k] + step(i, state) for i, k in enumerate(("o", "f", "m")))
            best = F.when((o >= f) & (o >= m), acc["o_spans"]).when(f >= m, closed("f")).otherwise(closed("m"))
            return F.greatest(o, f, m), best

        (o, o_spans), (f, f_spans) = arrive(OUT), arrive(FIRST)
        on_f, on_m = acc["f"] + step(FIRST, LATER), acc["m"] + step(LATER, LATER)
        early = on_f >= on_m
        return F.struct(
            (o + own(OUT, acc, x)).alias("o"), (f + own(FIRST, acc, x)).alias("f"),
            F.when(x["joined"], F.greatest(on_f, on_m) + own(LATER, acc, x)).otherwise(F.lit(NEVER)).alias("m"),
            o_spans.alias("o_spans"), f_spans.alias("f_spans"), F.when(early, acc["f_spans"]).otherwise(acc["m_spans"]).alias("m_spans"),
            acc["j"].alias("f_from"), F.when(early, acc["f_from"]).otherwise(acc["m_from"]).alias("m_from"),
            (acc["j"] + 1).alias("j"), x["tail"].alias("tail"),
        )

    def search(pieces: Column) -> Column:
        none = F.array().cast(spans)
        start = F.struct(
            F.lit(0.0).alias("o"), F.lit(NEVER).alias("f"), F.lit(NEVER).alias("m"), none.alias("o_spans"), none.alias("f_spans"),
            none.alias("m_spans"), F.lit(0).alias("f_from"), F.lit(0).alias("m_from"), F.lit(0).alias("j"), F.lit(0).alias("tail"))
        read = F.transform(_places(pieces), lambda i: F.struct(
            F.get(pieces, i).alias("w"), F.lower(F.get(pieces, i)).alias("low"), _gap(pieces, i).alias("gap"), (i < 2).alias("first")))
        words = F.transform(read, lambda x: F.struct(*_seen(x["w"], x["low"], x["gap"], x["first"])))
        n = _n_words(pieces)

        def last(acc: Column) -> Column:
            f = F.concat(acc["f_spans"], F.array(F.struct(acc["f_from"].alias("a"), n.alias("b"))))
            m = F.concat(acc["m_spans"], F.array(F.struct(acc["m_from"].alias("a"), n.alias("b"))))
            return F.when((acc["o"] >= acc["f"]) & (acc["o"] >= acc["m"]), acc["o_spans"]).when(acc["f"] >= acc["m"], f).otherwise(m)

        # From the first word's piece to the last one's, one by one: a slice would copy all pieces for each name.
        spots = lambda s: F.sequence(_offset(pieces) + 2 * s["a"], _offset(pieces) + 2 * s["b"] - 2)
        texts = lambda s: F.array_join(F.transform(spots(s), lambda i: F.get(pieces, i)), "")
        return F.transform(F.aggregate(words, start, move, last), texts)

    return lambda text: let(_pieces(text), lambda p: F.when(F.size(p) > 0, search(p)).otherwise(F.array().cast("array<string>")))
