"""Secret scan whose false positives a random forest removes.

Candidates are runs of at least ``MIN_LENGTH`` letters, digits and ``+/_.-`` that hold a digit or change from lower
to upper case inside.  The forest sees a candidate's length, its composition and entropy, how usual its character
transitions are in the corpus' own vocabulary, how much of it dictionary words cover, the path of its document and the
neighbouring words.  It is trained on labelled findings: the caller's, or those that ``labelled`` decides by shape and
context alone; at most ``MAX_TRAIN`` distinct ones, those with the smallest hashes, half of them of each label where there are
as many.  Equal findings count once.

Transitions count every word of every document; the dictionary holds the words of at least ``DICTIONARY_SHARE`` of the
distinct texts, and of two.  The transition table has at most 29 x 29
entries and is the only thing sent through the driver besides the forest.  No Python runs on the executors.

Defined results: NULL text has no candidate, NULL path counts as empty; repeated rows give their findings again; without
labelled findings of both kinds every score is NULL and the finding counts as a secret; an empty
table gives an empty table; input columns other than key, text and path are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tertulia.functions.base import let
from tertulia.llm.common import checkpointed, text_of, words_of
from tertulia.sources.staging import Staged

MIN_LENGTH = 12
MAX_TRAIN = 20_000
DICTIONARY_SHARE = 0.001  # of the distinct texts, two at least: texts a word stands in to be in the dictionary
TREES, DEPTH, SEED = 40, 6, 7
RUN = r"[A-Za-z0-9+/_.-]{12,}+"
MIXED = r"[0-9]|[a-z][A-Z]"
SECRET_WORD = r"(?i)token|secret|passw|api_?key|auth|private|credential|bearer"
EXAMPLE_PATH = r"(?i)test|example|sample|doc|spec|mock|fixture"

FEATURES = (
    "length", "digits", "uppers", "marks", "distinct_share", "entropy", "longest_digits", "only_hex", "changes",
    "transitions", "covered", "example_path", "secret_before", "assigned", "quoted", "plain_after",
)


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """(key, path, word_index, candidate, word, before, before2, after): one row per candidate."""
    def found(words: Column) -> Column:
        numbered = F.transform(words, lambda w, i: F.struct(i.alias("i"), w.alias("w")))
        hits = F.filter(numbered, lambda e: e["w"].rlike(MIXED) & e["w"].rlike(RUN))
        return F.transform(hits, lambda e: F.struct(
            e["i"].alias("word_index"), e["w"].alias("word"), F.coalesce(F.get(words, e["i"] - 1), F.lit("")).alias("before"),
            F.coalesce(F.get(words, e["i"] - 2), F.lit("")).alias("before2"), F.coalesce(F.get(words, e["i"] + 1), F.lit("")).alias("after")))

    held = docs.where(F.col(text).rlike(MIXED))
    rows = held.select(
        F.col(key).alias("key"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"),
        F.explode(let(words_of(text_of(text)), found)).alias("c")).select("key", "path", "c.*")
    each = rows.withColumn("candidate", F.explode(F.regexp_extract_all("word", F.lit(RUN), F.lit(0))))
    return each.where(F.col("candidate").rlike(MIXED)).select(
        "key", "path", F.col("word_index").cast("long").alias("word_index"), "candidate", "word", "before", "before2", "after")


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n, distinct_n): words of three letters or more, lower case, and the number of texts and of distinct texts
    that hold them; the empty word stands for every text."""
    texts = docs.select(text_of(text).alias("text")).groupBy(F.xxhash64("text").alias("h")).agg(
        F.first("text").alias("text"), F.count("*").alias("copies"))
    words = F.array_union(F.array(F.lit("")), F.split(F.lower("text"), r"[^\p{L}]+"))
    return texts.select("copies", F.explode(words).alias("word")).where(
        (F.col("word") == "") | (F.length("word") >= 3) & (F.length("word") <= 40)).groupBy("word").agg(
        F.sum("copies").alias("n"), F.count("*").alias("distinct_n"))


def _classes(text: Column) -> Column:
    """Letters a to z, 0 for digits, * for the rest: at most 28 signs."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]", "0"), "[^a-z0]", "*")


def _pairs(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))


def transition_table(words: DataFrame) -> dict[str, float]:
    """Log probability of the second of two signs after the first, over the vocabulary; at most 29 x 29 entries."""
    pairs = words.where("word <> ''").select("n", F.explode(_pairs(F.concat(_classes(F.col("word")), F.lit("*")))).alias("pair"))
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("n"))
    first = F.substring("pair", 1, 1)
    total = counts.groupBy(first.alias("first")).agg(F.sum("n").alias("all"))
    rows = counts.withColumn("first", first).join(total, "first").select("pair", F.log((F.col("n") + 1) / (F.col("all") + 28)).alias("p"))
    return {r.pair: r.p for r in rows.collect()}


def with_features(found: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with the columns of ``FEATURES``."""
    c, n = F.col("candidate"), F.length("candidate").cast("double")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    signs = F.split(c, "")
    entropy = let(F.filter(signs, lambda x: x != ""), lambda s: F.aggregate(
        F.array_distinct(s), F.lit(0.0),
        lambda a, x: a - let(F.size(F.filter(s, lambda y: y == x)) / F.size(s), lambda p: p * F.log2(p))))
    table = transition_table(words)
    usual = F.lit(-8.0)
    if table:
        pairs = F.create_map(*[F.lit(x) for item in sorted(table.items()) for x in item])
        mean = lambda ps: F.aggregate(ps, F.lit(0.0), lambda a, p: a + F.coalesce(F.element_at(pairs, p), F.lit(-8.0))) / F.size(ps)
        usual = let(_pairs(_classes(c)), mean)
    longest = F.array_max(F.transform(F.regexp_extract_all(c, F.lit("[0-9]+|$"), F.lit(0)), lambda x: F.length(x)))
    base = found.withColumns({
        "length": n, "digits": share("[0-9]"), "uppers": share("[A-Z]"), "marks": share("[+/_.-]"),
        "distinct_share": F.size(F.array_distinct(signs)) / n, "entropy": entropy, "longest_digits": F.coalesce(longest, F.lit(0)).cast("double"),
        "only_hex": c.rlike("^[0-9a-fA-F]+$").cast("double"), "changes": share("[0-9][A-Za-z]|[A-Za-z][0-9]|[a-z][A-Z]"),
        "transitions": usual, "example_path": F.col("path").rlike(EXAMPLE_PATH).cast("double"),
        "secret_before": (F.col("before").rlike(SECRET_WORD) | F.col("before2").rlike(SECRET_WORD) | F.col("word").rlike(SECRET_WORD)).cast("double"),
        "assigned": (F.col("before").rlike("[=:]$") | F.col("word").rlike("[=:].")).cast("double"),
        "quoted": F.col("word").rlike("[\"'`]").cast("double"), "plain_after": F.col("after").rlike(r"^\p{L}+[.,]?$").cast("double"),
    })
    # letters of the candidate inside dictionary words; distinct pieces only meet the dictionary
    pieces = F.filter(F.split(F.lower(c), "[^a-z]+"), lambda x: F.length(x) >= 3)
    flat = base.select("candidate").distinct().select("candidate", F.explode(pieces).alias("word"))
    texts = words.where("word = ''").agg(F.max("distinct_n")).first()[0] or 0
    known = words.where((F.col("distinct_n") >= max(2, DICTIONARY_SHARE * texts)) & (F.col("word") != "")).select("word")
    covered = flat.join(known, "word").groupBy("candidate").agg(F.sum(F.length("word")).alias("in_words"))
    return base.join(covered, "candidate", "left").withColumn(
        "covered", F.coalesce("in_words", F.lit(0)) / n).drop("in_words")


def labelled(found: DataFrame) -> DataFrame:
    """Findings that shape and context decide: ``label`` 1 or 0; all others are left out.

    A long run of hex or mixed signs assigned to a secret's name is one; numbers, addresses and versions in running text are none.
    """
    c = F.col("candidate")
    named = F.col("before2").rlike(SECRET_WORD) | F.col("before").rlike(SECRET_WORD) | F.col("word").rlike(SECRET_WORD)
    secret = named & (F.length("candidate") >= 20) & c.rlike("[0-9]") & c.rlike("[A-Za-z]")
    harmless = ~named & (c.rlike("^[0-9.-]+$") | c.rlike(r"^[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$") | F.col("word").contains("@"))
    return found.withColumn("label", F.when(secret, 1.0).when(harmless, 0.0)).where("label IS NOT NULL")


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep").transform(rows)


def train(examples: DataFrame, max_train: int = MAX_TRAIN) -> RandomForestClassificationModel | None:
    """A forest from examples with features and ``label``; None unless both labels occur."""
    content = ["candidate", "word", "before", "before2", "after"]
    order = F.xxhash64(*content)
    findings = checkpointed(examples.select(*content, *FEATURES, "label").distinct().select(*FEATURES, "label", order.alias("h")))
    sizes = {r.label: r["count"] for r in findings.groupBy("label").count().collect()}
    part = None
    for label, size in sorted(sizes.items()):
        share = max(max_train // 2, max_train - (sum(sizes.values()) - size))
        rows = findings.where(F.col("label") == label).orderBy("h", *FEATURES).limit(share)
        part = rows if part is None else part.unionByName(rows)
    if len(sizes) < 2:
        return None
    part = checkpointed(part)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt")
    return forest.fit(_assembled(part))


def scored(rows: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    """Candidates with ``score`` and ``is_secret``."""
    if model is None:
        return rows.withColumn("score", F.lit(None).cast("double")).withColumn("is_secret", F.lit(True))
    out = model.transform(_assembled(rows)).withColumn("score", vector_to_array("probability")[1])
    return out.withColumn("is_secret", F.col("score") >= 0.5)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source", findings: DataFrame | None = None) -> DataFrame:
    """Every candidate with its score; ``findings``: labelled ones (candidate, word, before, before2, after, path, label)."""
    found = checkpointed(candidates(docs, key, text, path))
    words = Staged(vocabulary(docs, text), "vocabulary").df
    rows = checkpointed(with_features(found, words))
    examples = labelled(rows) if findings is None else with_features(findings, words)
    return scored(rows, train(examples)).select(
        F.col("key").alias(key), "word_index", "candidate", "score", "is_secret", *FEATURES)
