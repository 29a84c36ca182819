"""What keeps the queries' cost in proportion to the input: texts moved once, nothing quadratic in a text."""

import datetime
import pathlib
import random
import time

from pyspark.sql import functions as F

from tertulia.functions import name_model as N
from tertulia.operators import ingest
from tertulia.plans import fixtures as fx


def tables(spark, path, n=40):
    """Documents and events of the driver's form, one document twice."""
    day = datetime.datetime(2024, 1, 2, 3, 4)
    docs = [(i, f"w{i % 7} hola Ana Ruiz\nfin {i}", "es", f"s{i % 3}", 20) for i in [*range(n), 5]]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    events = [(i, day + datetime.timedelta(minutes=i), i % 4, "error" if i % 9 == 0 else "view") for i in range(5 * n)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(f"{path}/events.parquet")
    return str(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def without_broadcast(spark, body):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return body()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_fixture_moves_texts_once(spark, tmp_path):
    d = tables(spark, tmp_path)
    found = without_broadcast(spark, lambda: plan(fx.v_messages(spark, d)))
    assert found.count("Exchange hashpartitioning") == 2, found  # documents and events, each by the key of their join
    rows = fx.v_messages(spark, d).select("msg_id", "chat_id", "sender", "message").collect()
    assert sorted(r.msg_id for r in rows) == sorted([*range(40), 5])
    assert {r.sender for r in rows if r.msg_id % 9 == 0} == {"Sistema"}


def test_names_of_a_long_text(spark):
    """A hundred thousand words and five names: no step copies the text at each of its words."""
    n = 100_000
    held = ["Eva Cruz", "Ana Maria Ruiz", "Luis", "Juan Perez", "Rosa Soto Vega"]
    text = " ".join(["hola"] * n + ["Ana Maria Ruiz", "y", "Luis"])
    begin = time.time()
    rows = N.count_names(spark.createDataFrame([(1, text, held), (2, None, held), (3, "Luis", None)], "id long, text string, names array<string>")).collect()
    assert time.time() - begin < 20
    steps = {(r.bucket, r.state): r.n for r in rows if r.feature == "step"}
    assert steps == {(0, 0): n + 1, (0, 1): 2, (1, 2): 1, (2, 2): 1, (2, 0): 1}


def test_pieces_and_preamble_move_texts_once(spark, tmp_path):
    """Both branches of the assembly share one shuffle of the lines; few early blocks move no line."""
    d = tables(spark, tmp_path)
    ingest.parse_chat_lines(fx.v_lines(spark, d)).write.parquet(f"{d}/lines")
    lines = spark.read.parquet(f"{d}/lines")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for assembled in (ingest.message_pieces(lines, 50), ingest.assemble_messages(lines)):
            found = without_broadcast(spark, lambda df=assembled: plan(df))
            # Scans of the text column in full, not the narrow ones that only count.
            assert len([x for x in found.splitlines() if "FileScan" in x and "sender#" in x.split("Batched")[0]]) == 1, found
        ingest.early_blocks(lines).write.parquet(f"{d}/early")
        found = plan(ingest.preamble_lines(lines, spark.read.parquet(f"{d}/early")))
        assert "hashpartitioning" not in found and "BroadcastHashJoin" in found, found
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_early_blocks_give_the_same_preamble(spark, tmp_path):
    rows = [("a", "", 0, 0, "before"), ("a", "", 0, 1, "1/2/25, 10:00 - Ana: hola"), ("a", "", 0, 2, "more"), ("a", "", 1, 3, "tail"),
            ("b", "", 0, 0, "none here"), ("b", "", 1, 1, "still none"), (None, "", 0, 0, "x"), (None, "", 0, 1, "1/2/25, 10:00 - Eva: si")]
    lines = ingest.parse_chat_lines(spark.createDataFrame(rows, "chat_id string, part string, block long, seq long, value string"))
    ingest.early_blocks(lines).write.parquet(f"{tmp_path}/early")
    found = ingest.preamble_lines(lines, spark.read.parquet(f"{tmp_path}/early"))
    assert sorted((r.chat_id, r.text) for r in found.collect()) == [("", "x"), ("a", "before"), ("b", "none here"), ("b", "still none")]
    assert sorted(found.collect()) == sorted(ingest.preamble_lines(lines).collect())


def test_counts_are_staged_not_checkpointed(spark, tmp_path):
    """Only the result is checkpointed; the counts' tables are gone when it is there."""
    from tertulia.plans.registry import QUERIES
    from tertulia.sources.staging import shared_folder

    d = tables(spark, tmp_path)
    held = lambda: {x.name for x in pathlib.Path(shared_folder(spark)).glob("counts-*")}
    before = held()
    out = QUERIES["term_weights_by_chat"](spark, d)
    assert plan(out).count("Scan ExistingRDD") == 1
    assert held() == before
    assert sorted({r.chat_id for r in out.collect()}) == ["s0", "s1", "s2"]


def test_report_counts_words_once(spark, tmp_path, monkeypatch):
    """The report explodes its words once for all counts of words and scores its pairs once; its tables are those of the operators."""
    from tertulia.functions.lexicon import spanish_adjectives
    from tertulia.operators import content, tokens
    from tertulia.plans import jobs

    rng = random.Random(4)
    said = [("c" if i % 3 else None, i, "01/02/24, 10:00", f"u{i % 4}" if i % 5 else None,
             None if i == 9 else " ".join(["buen viaje"] * (i % 3) + rng.choices(["libre", "casa", "casas", "mesa", "perro"], k=9))) for i in range(60)]
    spark.createDataFrame(said, "chat_id string, msg_idx long, timestamp string, sender string, message string").write.parquet(f"{tmp_path}/in")
    scored, plain = [], content._scored_pairs
    monkeypatch.setattr(content, "_scored_pairs", lambda *a, **k: scored.append(1) or plain(*a, **k))
    jobs.run_report(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert len(scored) == 1
    by, words = ("chat_id",), spark.read.parquet(f"{tmp_path}/out/words")
    counts = content.word_and_pair_counts(words, by=by)
    expected = {
        "top_words": tokens.top_words(words, by=by), "top_words_per_member": tokens.top_words_per_member(words, by=by),
        "adjective_frequency": content.adjective_frequency(words, spanish_adjectives(spark), by=by),
        "term_weights": content.term_weights(counts, by=by), "bigram_collocations": content.bigram_collocations(counts, by=by),
    }
    for name, df in expected.items():
        found = spark.read.parquet(f"{tmp_path}/out/{name}")
        assert found.dtypes == df.dtypes
        assert sorted(map(repr, found.collect())) == sorted(map(repr, df.collect())), name
        assert name == "adjective_frequency" or found.count()


def test_pairs_left_out_early_could_not_pass(spark):
    """Leaving out pairs before their second word is known changes no row: rare and frequent words, repeated and NULL groups, plurals."""
    from tertulia.operators import content, tokens

    rng = random.Random(9)
    frequent, rare = ["red", "azul", "verde", "mesas", "mesa"], [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    said = []
    for i in range(900):
        words = rng.choices(frequent, weights=[9, 5, 3, 1, 1], k=8) + rng.choices(rare, k=2)
        rng.shuffle(words)
        said.append((rng.choice(["a", "b", None]), " ".join([*words, "eco", "eco"] if i % 50 == 0 else words)))
    words = tokens.tokenize(spark.createDataFrame(said, "chat_id string, message string")).localCheckpoint()
    for by in ([], ["chat_id"]):
        counts = content.word_and_pair_counts(words, by=by).localCheckpoint()
        single = content.unigrams(counts, by).localCheckpoint()
        every = content._scored_pairs(counts, single, by).localCheckpoint()
        for least in (0.0, 5.0, 12.0, 30.0):
            kept = content._scored_pairs(counts, single, by, least)
            want = sorted(map(repr, every.where(F.col("score") > least).collect()))
            assert sorted(map(repr, kept.where(F.col("score") > least).collect())) == want and want
        assert kept.count() < 0.7 * every.count()


def test_pairs_move_once_for_their_first_word(spark, tmp_path):
    from tertulia.operators import content

    rows = [("c", "sol", "mar", 3), (None, "sol", None, 2), ("c", "mar", None, 3)]
    spark.createDataFrame(rows, "chat_id string, word string, next_word string, n long").write.parquet(f"{tmp_path}/counts")
    counts = spark.read.parquet(f"{tmp_path}/counts")
    content.unigrams(counts, ["chat_id"]).write.parquet(f"{tmp_path}/single")
    single = spark.read.parquet(f"{tmp_path}/single")
    found = without_broadcast(spark, lambda: plan(content.collocated_pairs(counts, single, ["chat_id"])))
    moves = [x for x in found.splitlines() if "Exchange hashpartitioning" in x]
    # Pairs by their first word and by their second, the vocabulary for each, its sums by chat and the two sides of their join.
    assert len(moves) == 6 and sum("first_word" in x for x in moves) == 0, found


def test_report_parts_do_not_grow_with_the_input(spark, tmp_path):
    """Large parts would make a counting task hold more words than its memory; the session's settings come back."""
    from tertulia.plans import jobs

    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"]
    read = lambda: [spark.conf.get(n, None) for n in names]
    spark.range(1000).write.parquet(f"{tmp_path}/in")
    before, df = read(), spark.read.parquet(f"{tmp_path}/in")
    with jobs.bounded_parts(spark, df):
        assert read() == [f"{jobs.PART_BYTES}b", f"{jobs.PART_BYTES}b", spark.conf.get("spark.sql.shuffle.partitions")]
    assert read() == before
    large = spark.range(1 << 30)  # eight bytes a row
    spark.conf.set(names[0], "1m")
    try:
        with jobs.bounded_parts(spark, large):
            assert read() == ["1048576b", f"{jobs.PART_BYTES}b", "1024"]
            raise KeyError
    except KeyError:
        assert read() == ["1m", *before[1:]]
    finally:
        spark.conf.unset(names[0])
