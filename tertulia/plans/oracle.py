"""DuckDB SQL that states the registered queries independently.

DuckDB's regular expressions have no look-around and ASCII ``\\b``; the forms here are free of
look-around and equal to the library's on the driver's tables.
"""

from __future__ import annotations

import glob
import os
import zipfile

import pyspark

from tertulia import fixed_values as V
from tertulia.functions.content import DOMAIN_GROUPS, DOMAIN_HOSTS
from tertulia.plans import fixtures as fx
from tertulia.plans.registry import FIXTURE_LEXICON, MIXED_FORMS, PARTIAL_STOP_TABLE

_W = r"\p{L}\p{N}_"
_TITLE = r"\b(?:Dra?|Lic|Ing|Mtro?|Prof?)"
_CAP = "[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+"
_NAME_WORD = r"(?:\p{Lu}\p{Ll}+)+"
_LATIN = "[A-Za-zÁÉÍÓÚáéíóúÑñ]"
_HEADER = (
    r"^\s*(\d{1,2}/\d{1,2}/\d{2,4},\s\d{1,2}:\d{2}(?::\d{2})?\s*(?:[ap]\.?\s?m\.?)?)"
    r"\s*-\s*(?:([^:]+):\s*)?(.*)$"
)
_DAYS = fx._quoted(V.WEEKDAYS_ES)


def _spanish_stop_words() -> list[str]:
    """Spark's list, read from its jar: the SQL is built without a running session."""
    jars = os.path.join(os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__), "jars")
    with zipfile.ZipFile(glob.glob(os.path.join(jars, "spark-mllib_*.jar"))[0]) as jar:
        return jar.read("org/apache/spark/ml/feature/stopwords/spanish.txt").decode().split()


def _list(texts) -> str:
    return f"[{fx._quoted(texts)}]"


def _sub(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"


def _emoji_pattern() -> str:
    spans = "".join("-".join(rf"\x{{{p}}}" for p in r.split("-")) for r in V.EMOJI_RANGES.split())
    unit = rf"[{spans}]\x{{FE0F}}?[\x{{1F3FB}}-\x{{1F3FF}}]?"
    return (
        r"[0-9#*]\x{FE0F}?\x{20E3}|[\x{1F1E6}-\x{1F1FF}]{2}"
        r"|\x{1F3F4}[\x{E0020}-\x{E007E}]+\x{E007F}"
        rf"|{unit}(?:\x{{200D}}{unit})*"
    )


# --- expressions ----------------------------------------------------------------------


def brackets(x: str) -> str:
    return _sub(x, rf"(?:[{_W}]*\[[^\]]+\][{_W}]*)+", V.NAME_MASK)


def phones(x: str) -> str:
    return _sub(x, r"\+\d{1,3}(?:[\s().-]*\d+)+", V.NUMBER_MASK)


def mails(x: str) -> str:
    return _sub(x, r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+", V.MAIL_MASK)


def tildes(x: str) -> str:
    return _sub(x, rf"~\s*{_LATIN}+(?:\s+{_LATIN}+)*", V.NAME_MASK)


def spans(x: str) -> str:
    plain = _sub(x, rf"{_TITLE}\.\s*", "")
    return f"regexp_extract_all({plain}, '(?:^|[^{_W}])({_NAME_WORD}(?: +{_NAME_WORD})+)', 1)"


def keep_span(s: str) -> str:
    return (
        f"(len(regexp_extract_all({s}, '\\S+')) >= 2"
        f" AND NOT list_has_any(regexp_extract_all({s}, '\\S+'), {_list(V.BLOCKED_NAME_WORDS)})"
        f" AND NOT list_contains({_list(V.BLOCKED_NAME_WORDS)}, {s})"
        f" AND len(list_filter({_list(p.lower() for p in V.NAME_EXCEPTIONS)},"
        f" lambda p: contains(lower({s}), p) OR contains(p, lower({s})))) = 0)"
    )


def person_names(x: str) -> str:
    kept = f"list_filter({spans(x)}, lambda s: {keep_span('s')})"
    return (
        f"list_reduce(list_prepend({x}, list_reverse({kept})),"
        f" lambda acc, s: replace(acc, s, '{V.NAME_MASK}'))"
    )


def is_speaker(x: str) -> str:
    tail = rf"(?:\s+(?:de\s+la|del|de|la|Los|Las|{_CAP}))+\s*-\s*"
    return rf"regexp_matches({x}, '{_TITLE}\.?\s+{_CAP}{tail}')"


def speaker_line(x: str) -> str:
    return rf"'{V.NAME_MASK} - ' || regexp_extract({x}, '{_TITLE}\.?\s+(?:[^\n]*?\s*)-\s*([^\n]*)', 1)"


def masked(relation: str, keys: str) -> str:
    """CTEs that apply every masking step to ``message`` of a relation, as ``v_redacted``."""
    return f"""v_masked AS (
  SELECT {keys}, {tildes(mails(phones(brackets("message"))))} AS message FROM {relation}),
v_redacted AS (
  SELECT {keys}, CASE WHEN {is_speaker("message")} THEN {speaker_line("message")}
    ELSE {person_names("message")} END AS message FROM v_masked)"""


def no_urls(x: str) -> str:
    return _sub(
        x,
        rf"(?i)https?://\S+|www\.\S+|\S+\.\S+/\S+|(?:[{_W}]+\.)+(?:com|org|net|edu|gob|mx|es)\b\S*",
        "",
    )


def normal(x: str) -> str:
    return _sub(f"lower({x})", r"[^a-zA-ZáéíóúÁÉÍÓÚñÑ0-9\s]", "")


def clean(x: str) -> str:
    return f"translate({normal(no_urls(f"replace({x}, '_', ' ')"))}, 'áéíóú', 'aeiou')"


def words(x: str, stop: list[str]) -> str:
    return (
        f"list_filter(regexp_split_to_array({clean(x)}, '\\s+'),"
        f" lambda w: NOT list_contains({_list(['', *stop])}, w))"
    )


STOP = sorted({*_spanish_stop_words(), *V.CHAT_STOP_WORDS})


def _tokens(view_sql: str, view: str, keys: str, stop: list[str] = STOP) -> str:
    return f"""{view_sql},
v_words AS (SELECT {keys}, {words("message", stop)} AS words FROM {view})"""


def _domain(url: str, strict: bool = False) -> str:
    host = f"regexp_extract(regexp_replace(lower(trim({url})), 'https?://(?:www\\.)?', '', 'g'), '^[^/?#]*')"
    if strict:
        bare = f"regexp_replace({host}, ':[0-9]*$', '')"
        tests = [
            (" OR ".join(f"{bare} = '{h}' OR ends_with({bare}, '.{h}')" for h in hosts), name)
            for hosts, name in DOMAIN_HOSTS
        ]
    else:
        tests = [(" OR ".join(f"contains({host}, '{m}')" for m in marks), name) for marks, name in DOMAIN_GROUPS]
    cases = " ".join(f"WHEN {condition} THEN '{name}'" for condition, name in tests)
    return f"CASE WHEN {host} = '' THEN '{V.UNKNOWN_DOMAIN}' {cases} ELSE {host} END"


def _links(x: str) -> str:
    found = rf"""regexp_extract_all({x}, 'https?://[^\s<>"A-Z¡!¿?,]+')"""
    return f"list_transform({found}, lambda l: rtrim(l, '.,;:!?'))"


# A day-first text read month first where that is possible.
_DAY, _MONTH, _YEAR = (f"CAST(strftime(ts, '%{c}') AS INTEGER)" for c in "dmY")
MOMENT = (
    f"CASE WHEN {_DAY} > 12 THEN date_trunc('minute', ts)"
    f" ELSE make_timestamp({_YEAR}, {_DAY}, {_MONTH}, hour(ts), minute(ts), 0) END"
)
DAY_IDX = "CAST((isodow(moment) - 1) AS INTEGER)"
HOUR = "CAST(hour(moment) AS INTEGER)"


def _timed(view_sql: str, view: str) -> str:
    return f"{view_sql}, v_timed AS (SELECT *, {MOMENT} AS moment FROM {view})"


MEMBERS = f"SELECT * FROM v_messages WHERE sender <> '{V.SYSTEM_SENDER}'"
STATS = f"""{fx.V_MESSAGES},
stats AS (
  SELECT sender, count(message) AS total_messages,
         CAST(sum(length(message)) AS BIGINT) AS total_characters,
         avg(length(message)) AS avg_message_size
  FROM ({MEMBERS}) GROUP BY sender)"""

PARSED = rf"""{fx.V_LINES},
v_clean AS (
  SELECT chat_id, seq, value, trim(regexp_replace(value, '(\s*-\s*)[\s~]+', '\1', 'g'), E' \t\n\r\f\x0b') AS clean
  FROM v_lines WHERE regexp_matches(value, '\S')),
v_parsed AS (
  SELECT chat_id, seq, regexp_matches(clean, '{_HEADER}', 'i') AS is_header,
         regexp_extract(clean, '{_HEADER}', 1, 'i') AS ts_text,
         regexp_extract(clean, '{_HEADER}', 2, 'i') AS sender_text,
         regexp_extract(clean, '{_HEADER}', 3, 'i') AS rest, clean
  FROM v_clean),
v_fields AS (
  SELECT chat_id, seq, is_header,
         CASE WHEN is_header THEN ts_text END AS timestamp,
         CASE WHEN is_header THEN CASE WHEN sender_text = '' THEN '{V.SYSTEM_SENDER}'
              ELSE trim(sender_text) END END AS sender,
         CASE WHEN is_header THEN rest ELSE clean END AS text
  FROM v_parsed)"""


def _assembled(fields: str) -> str:
    return f"""v_numbered AS (
  SELECT *, sum(CASE WHEN is_header THEN 1 ELSE 0 END)
    OVER (PARTITION BY chat_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS n FROM {fields}),
v_assembled AS (
  SELECT chat_id, CAST(n AS BIGINT) AS msg_idx, max(timestamp) AS timestamp, max(sender) AS sender,
         string_agg(text, chr(10) ORDER BY seq) AS message
  FROM v_numbered WHERE n > 0 GROUP BY chat_id, n),
v_names AS (
  SELECT chat_id, sender, CASE WHEN sender = '{V.SYSTEM_SENDER}' THEN sender
    ELSE '{V.PSEUDONYM_PREFIX}' || row_number() OVER (PARTITION BY chat_id ORDER BY min(msg_idx)) END AS pseudonym
  FROM v_assembled GROUP BY chat_id, sender),
v_pseudonymous AS (
  SELECT m.chat_id, m.msg_idx, m.timestamp, n.pseudonym AS sender, m.message
  FROM v_assembled m JOIN v_names n ON m.chat_id = n.chat_id AND m.sender = n.sender)"""


def _clouds(score_floor: float = 30.0) -> str:
    stop = _list(V.CLOUD_STOP_WORDS)
    stem = lambda c: f"CASE WHEN {c} LIKE '%s' AND {c} NOT LIKE '%ss' THEN left({c}, -1) ELSE {c} END"
    ll = lambda k, n, p: f"(ln(greatest({p}, 1e-10)) * ({k}) + ln(greatest(1 - ({p}), 1e-10)) * (({n}) - ({k})))"
    score = (
        f"-2 * ({ll('n', 'n1', 'n2 / t')} + {ll('n2 - n', 't - n1', 'n2 / t')}"
        f" - {ll('n', 'n1', 'n / n1')} - {ll('n2 - n', 't - n1', '(n2 - n) / (t - n1)')})"
    )
    return f"""{_tokens(fx.V_MESSAGES, "v_messages", "msg_id")},
c_words AS (SELECT list_filter(words, lambda w: len(w) >= 1 AND NOT regexp_matches(w, '^[0-9]+$')) AS words FROM v_words),
c_one AS (
  SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM c_words)
  WHERE NOT list_contains({stop}, word) GROUP BY word),
c_stems AS (SELECT word, n, {stem("word")} AS stem FROM c_one),
c_uni AS (
  SELECT stem, CASE WHEN bool_or(word = stem) THEN stem ELSE stem || 's' END AS word, sum(n) AS n
  FROM c_stems GROUP BY stem),
c_pairs AS (
  SELECT a, b, count(*) AS n FROM (
    SELECT words[i] AS a, words[i + 1] AS b FROM (SELECT words, unnest(range(1, len(words))) AS i FROM c_words))
  WHERE NOT list_contains({stop}, a) AND NOT list_contains({stop}, b) GROUP BY a, b),
c_pair_stems AS (SELECT a, b, n, {stem("b")} AS stem FROM c_pairs),
c_merged AS (
  SELECT a, CASE WHEN bool_or(b = stem) THEN stem ELSE stem || 's' END AS b, sum(n) AS n
  FROM c_pair_stems GROUP BY a, stem),
c_sides AS (
  SELECT p.a || ' ' || p.b AS bigram, u.word AS w1, v.word AS w2, CAST(p.n AS DOUBLE) AS n,
         CAST(u.n AS DOUBLE) AS n1, CAST(v.n AS DOUBLE) AS n2,
         CAST((SELECT sum(n) FROM c_uni) AS DOUBLE) AS t
  FROM c_merged p JOIN c_uni u ON u.stem = {stem("p.a")} JOIN c_uni v ON v.stem = {stem("p.b")}),
c_scored AS (SELECT *, CASE WHEN t <= n1 OR t <= n2 THEN 0 ELSE {score} END AS score FROM c_sides),
c_kept AS (SELECT * FROM c_scored WHERE score > {score_floor}),
c_terms AS (
  SELECT term, CAST(sum(n) AS BIGINT) AS count FROM (
    SELECT word AS term, CAST(n AS DOUBLE) AS n FROM c_uni UNION ALL SELECT bigram, n FROM c_kept
    UNION ALL SELECT w1, -n FROM c_kept UNION ALL SELECT w2, -n FROM c_kept)
  GROUP BY term HAVING sum(n) > 0)"""


def _clouds_by_chat() -> str:
    """The statement of ``_clouds`` with every count, total and join inside one chat."""
    sql = _clouds()
    for old, new in (
        ("SELECT msg_id, ", "SELECT chat_id, "), ("SELECT list_filter", "SELECT chat_id, list_filter"),
        ("SELECT word, count(*) AS n FROM (SELECT unnest", "SELECT chat_id, word, count(*) AS n FROM (SELECT chat_id, unnest"),
        ("GROUP BY word)", "GROUP BY chat_id, word)"), ("c_stems AS (SELECT", "c_stems AS (SELECT chat_id,"),
        ("SELECT stem, CASE", "SELECT chat_id, stem, CASE"), ("GROUP BY stem)", "GROUP BY chat_id, stem)"),
        ("SELECT a, b, count", "SELECT chat_id, a, b, count"), ("SELECT words[i]", "SELECT chat_id, words[i]"),
        ("SELECT words, unnest", "SELECT chat_id, words, unnest"), ("GROUP BY a, b)", "GROUP BY chat_id, a, b)"),
        ("c_pair_stems AS (SELECT", "c_pair_stems AS (SELECT chat_id,"), ("SELECT a, CASE", "SELECT chat_id, a, CASE"),
        ("GROUP BY a, stem)", "GROUP BY chat_id, a, stem)"), ("SELECT p.a ||", "SELECT p.chat_id, p.a ||"),
        ("(SELECT sum(n) FROM c_uni)", "(SELECT sum(c.n) FROM c_uni c WHERE c.chat_id = p.chat_id)"),
        ("JOIN c_uni u ON", "JOIN c_uni u ON u.chat_id = p.chat_id AND"),
        ("JOIN c_uni v ON", "JOIN c_uni v ON v.chat_id = p.chat_id AND"),
        ("SELECT term, CAST", "SELECT chat_id, term, CAST"), ("SELECT word AS term", "SELECT chat_id, word AS term"),
        ("SELECT bigram, n FROM", "SELECT chat_id, bigram, n FROM"), ("SELECT w1,", "SELECT chat_id, w1,"),
        ("SELECT w2,", "SELECT chat_id, w2,"), ("GROUP BY term HAVING", "GROUP BY chat_id, term HAVING"),
    ):
        assert sql.count(old) == 1, old
        sql = sql.replace(old, new)
    return sql


def _masked_query(expression: str) -> str:
    return f"WITH {fx.V_DECORATED} SELECT msg_id, {expression} AS message FROM v_decorated"


def _marked(x: str) -> str:
    return f"replace({x}, '. ', '.' || chr(8207) || ' ')"


def _peaks() -> str:
    return f"""WITH {_timed(fx.V_EVENTS_MESSAGES, "v_events_messages")},
cells AS (SELECT {DAY_IDX} AS d, {HOUR} AS h, count(*) AS n FROM v_timed GROUP BY ALL),
days AS (SELECT r.d, coalesce(sum(n), 0) AS n FROM (SELECT unnest(range(7)) AS d) r LEFT JOIN cells USING (d) GROUP BY r.d),
hours AS (SELECT h, sum(n) AS n FROM cells GROUP BY h)
SELECT 'busiest_day' AS peak, ([{_DAYS}])[d + 1] AS day_name, -1 AS hour, CAST(n AS BIGINT) AS count
  FROM (SELECT * FROM days ORDER BY n DESC, d LIMIT 1)
UNION ALL SELECT 'quietest_day', ([{_DAYS}])[d + 1], -1, CAST(n AS BIGINT) FROM (SELECT * FROM days ORDER BY n, d LIMIT 1)
UNION ALL SELECT 'busiest_hour', '', h, CAST(n AS BIGINT) FROM (SELECT * FROM hours ORDER BY n DESC, h LIMIT 1)
UNION ALL SELECT 'busiest_cell', ([{_DAYS}])[d + 1], h, n FROM (SELECT * FROM cells ORDER BY n DESC, d, h LIMIT 1)"""


def _heatmap() -> str:
    cells = ", ".join(
        f'CAST(count(message) FILTER ({DAY_IDX} = {i}) AS BIGINT) AS "{name}"' for i, name in enumerate(V.WEEKDAYS_ES)
    )
    return f"WITH {_timed(fx.V_EVENTS_MESSAGES, 'v_events_messages')} SELECT {HOUR} AS hour, {cells} FROM v_timed GROUP BY 1"


def _ids(columns: str) -> str:
    return f"WITH t AS (SELECT event_id, {MOMENT} AS moment FROM events) SELECT event_id, {columns} FROM t"


def oracle_sql() -> dict[str, str]:
    lexicon = ", ".join(f"('{t}', '{p}')" for t, p in FIXTURE_LEXICON)
    chat_stats = STATS.replace("SELECT sender,", "SELECT chat_id, sender,").replace("GROUP BY sender)", "GROUP BY chat_id, sender)")
    # chats of even number begin with lines that no header matches
    kept_lines = PARSED.replace("FROM v_lines WHERE", "FROM v_kept WHERE").replace("v_clean AS (", f"""v_kept AS (
  SELECT chat_id, seq, CASE WHEN regexp_matches(chat_id, '[02468]$') AND seq % {7 * fx.SEQ_WIDTH} < {5 * fx.SEQ_WIDTH}
    THEN '> ' || value ELSE value END AS value FROM v_lines),
v_clean AS (""")
    mixed = " ".join(
        f"WHEN event_id % {len(MIXED_FORMS)} = {i} THEN date_trunc('{unit}', ts)" for i, (_, unit) in enumerate(MIXED_FORMS))
    stop_table = ", ".join(f"('{t}')" for (t,) in PARTIAL_STOP_TABLE)
    decorated = f"WITH {fx.V_DECORATED}"
    messages = f"WITH {fx.V_MESSAGES}"
    events = f"WITH {_timed(fx.V_EVENTS_MESSAGES, 'v_events_messages')}"
    top = "SELECT sender FROM stats ORDER BY total_messages DESC, sender LIMIT 10"
    redacted_fields = f"""v_line AS (SELECT chat_id, seq, is_header, timestamp, sender, text AS message FROM v_fields),
{masked("v_line", "chat_id, seq, is_header, timestamp, sender")},
v_safe AS (SELECT chat_id, seq, is_header, timestamp, sender, message AS text FROM v_redacted)"""
    emoji = _emoji_pattern()
    pos = lambda f: f"list_transform({f}, lambda x, i: {{'pos': CAST(i - 1 AS INTEGER), 'v': x}})"
    return {
        "chat_line_scan": f"WITH {fx.V_LINES} SELECT chat_id, count(*) AS n_lines,"
                          " CAST(sum(length(value)) AS BIGINT) AS n_chars FROM v_lines GROUP BY chat_id",
        "sanitize_lines": f"WITH {PARSED} SELECT chat_id, seq, clean FROM v_clean",
        "parse_chat_lines": f"WITH {PARSED} SELECT chat_id, seq, is_header, coalesce(timestamp, '') AS timestamp,"
                            " coalesce(sender, '') AS sender, text FROM v_fields",
        "assemble_messages": f"WITH {PARSED}, {_assembled('v_fields')} SELECT * FROM v_assembled",
        "pseudonymize_senders": f"WITH {PARSED}, {_assembled('v_fields')} SELECT * FROM v_pseudonymous",
        "render_anonymized": f"WITH {PARSED}, {_assembled('v_fields')},"
                             " r AS (SELECT chat_id, msg_idx, string_split('[' || timestamp || '] ' || sender || ': '"
                             " || message, chr(10)) AS parts FROM v_pseudonymous),"
                             " s AS (SELECT chat_id, msg_idx, parts, unnest(range(1, len(parts) + 1)) AS i FROM r)"
                             " SELECT chat_id, msg_idx, CAST(i - 1 AS INTEGER) AS line_no, parts[i] AS value FROM s",
        "anonymize_chat": f"WITH {PARSED}, {redacted_fields}, {_assembled('v_safe')} SELECT * FROM v_pseudonymous",
        "redact_marks": f"{messages} SELECT msg_id, replace({_marked('message')}, chr(8207), '') AS message FROM v_messages",
        "redact_brackets": _masked_query(brackets("message")),
        "redact_phones": _masked_query(phones("message")),
        "redact_emails": _masked_query(mails("message")),
        "redact_tilde_names": _masked_query(tildes("message")),
        "redact_speaker_lines": _masked_query(
            f"CASE WHEN {is_speaker('message')} THEN {speaker_line('message')} ELSE message END"),
        "redact_person_names": _masked_query(person_names("message")),
        "filter_name_candidates": f"{decorated} SELECT * FROM (SELECT msg_id, unnest({spans('message')}) AS span"
                                  f" FROM v_decorated) WHERE {keep_span('span')}",
        "redact_text": f"{decorated}, {masked('v_decorated', 'msg_id')} SELECT msg_id, message FROM v_redacted",
        "redaction_counts": f"{decorated}, {masked('v_decorated', 'msg_id, sender')}, k AS ("
                            + " UNION ALL ".join(
                                f"SELECT sender, '{kind}' AS kind, (length(message) - length(replace(message,"
                                f" '{mask}', ''))) // {len(mask)} AS n FROM v_redacted"
                                for kind, mask in (("name", V.NAME_MASK), ("number", V.NUMBER_MASK), ("mail", V.MAIL_MASK)))
                            + ") SELECT sender, kind, CAST(sum(n) AS BIGINT) AS count FROM k GROUP BY ALL HAVING sum(n) > 0",
        "remove_accents": f"{messages} SELECT msg_id, replace(strip_accents(replace(message, 'ñ', chr(57345))),"
                          " chr(57345), 'ñ') AS message FROM v_messages",
        "strip_urls": _masked_query(no_urls("message")),
        "normalize_text": _masked_query(normal("message")),
        "filter_stopwords": f"WITH {_tokens(fx.V_DECORATED, 'v_decorated', 'msg_id', [])},"
                            " t AS (SELECT unnest(words) AS token FROM v_words)"
                            f" SELECT token, count(*) AS count FROM t WHERE token NOT IN (SELECT * FROM (VALUES {stop_table})) GROUP BY token",
        "clean_tokens": f"WITH {_tokens(fx.V_DECORATED, 'v_decorated', 'msg_id')},"
                        f" t AS (SELECT msg_id, unnest({pos('words')}) AS x FROM v_words)"
                        " SELECT msg_id, x.pos AS pos, x.v AS token FROM t",
        "clean_text_by_sender": f"WITH {_tokens(fx.V_MESSAGES, 'v_messages', 'msg_id, chat_id, sender')}"
                                " SELECT chat_id, sender, msg_id // 250 AS text_no,"
                                " string_agg(array_to_string(words, ' '), ' ' ORDER BY msg_id) AS clean_text"
                                " FROM v_words WHERE len(words) > 0 GROUP BY ALL",
        "exclude_system": f"{messages} SELECT msg_id, sender, message FROM ({MEMBERS})",
        "message_word_count": f"{messages} SELECT msg_id, CAST(len(regexp_extract_all(message, '\\S+')) AS INTEGER)"
                              " AS word_count FROM v_messages",
        "message_size": f"{messages} SELECT msg_id, CAST(length(message) AS INTEGER) AS message_size FROM v_messages",
        "export_scan_anonymize": f"WITH {PARSED}, {redacted_fields}, {_assembled('v_safe')} SELECT * FROM v_pseudonymous",
        "preamble_lines": f"WITH {kept_lines}, first AS (SELECT chat_id, min(seq) FILTER (is_header) AS head FROM v_fields"
                          " GROUP BY chat_id) SELECT chat_id, seq, text FROM v_fields JOIN first USING (chat_id)"
                          " WHERE head IS NULL OR seq < head",
        "features_csv": f"WITH {STATS} SELECT * FROM stats",
        "redact_null_text": f"WITH {fx.V_DECORATED}, v_some AS (SELECT msg_id,"
                            " CASE WHEN msg_id % 3 > 0 THEN message ELSE 'nan' END AS message FROM v_decorated),"
                            f" {masked('v_some', 'msg_id')} SELECT msg_id, message FROM v_redacted",
        "conversation_statistics": "SELECT conv_id, role AS sender, count(text) AS total_messages,"
                                   " CAST(sum(length(text)) AS BIGINT) AS total_characters, avg(length(text)) AS avg_message_size"
                                   f" FROM conversations WHERE role <> '{V.SYSTEM_SENDER}' GROUP BY ALL",
        "parse_mixed_timestamps": f"SELECT event_id, CASE {mixed} END AS moment FROM events",
        "top_active_members_by_chat": f"{messages} SELECT chat_id, sender, count(*) AS count FROM ({MEMBERS}) GROUP BY chat_id, sender"
                                      " QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY count(*) DESC, sender) <= 10",
        "participation_profile_by_chat": f"WITH {chat_stats}, l AS (SELECT chat_id, quantile_cont(total_messages, 0.75) AS v,"
                                         " quantile_cont(CAST(floor(avg_message_size) AS BIGINT), 0.75) AS s FROM stats GROUP BY chat_id)"
                                         " SELECT chat_id, sender, total_messages, avg_message_size,"
                                         " CASE WHEN total_messages >= v THEN 'many' ELSE 'few' END || '_' ||"
                                         " CASE WHEN floor(avg_message_size) >= s THEN 'long' ELSE 'short' END AS profile"
                                         " FROM stats JOIN l USING (chat_id)",
        "messages_of_top_members_by_chat": f"WITH {chat_stats}, top AS (SELECT chat_id, sender FROM stats QUALIFY row_number()"
                                           " OVER (PARTITION BY chat_id ORDER BY total_messages DESC, sender) <= 3)"
                                           " SELECT msg_id, chat_id, sender, message FROM v_messages JOIN top USING (chat_id, sender)",
        "top_active_members": f"{messages} SELECT sender, count(*) AS count FROM ({MEMBERS}) GROUP BY sender"
                              " ORDER BY count DESC, sender LIMIT 10",
        "avg_user_word_count": f"{messages} SELECT sender, avg(len(regexp_extract_all(message, '\\S+'))) AS word_count"
                               f" FROM ({MEMBERS}) GROUP BY sender ORDER BY word_count DESC, sender LIMIT 10",
        "user_statistics": f"WITH {STATS} SELECT * FROM stats",
        "users_short_messages": f"WITH {STATS} SELECT sender, avg_message_size, total_messages FROM stats"
                                " ORDER BY avg_message_size, sender LIMIT 10",
        "message_size_boxplot": f"WITH {STATS}, s AS (SELECT sender, length(message) AS size FROM ({MEMBERS})"
                                f" WHERE sender IN ({top})),"
                                " q AS (SELECT sender, count(*) AS total_messages, quantile_cont(size, 0.25) AS q1,"
                                " quantile_cont(size, 0.5) AS median, quantile_cont(size, 0.75) AS q3 FROM s GROUP BY sender)"
                                " SELECT sender, total_messages, q1, median, q3,"
                                " least(min(CASE WHEN size >= q1 - 1.5 * (q3 - q1) THEN size END), q1) AS whisker_low,"
                                " greatest(max(CASE WHEN size <= q3 + 1.5 * (q3 - q1) THEN size END), q3) AS whisker_high"
                                " FROM s JOIN q USING (sender) GROUP BY sender, total_messages, q1, median, q3",
        "messages_of_top_members": f"WITH {STATS} SELECT msg_id, sender, message FROM v_messages WHERE sender IN ({top})",
        "participation_profile": f"WITH {STATS}, l AS (SELECT quantile_cont(total_messages, 0.75) AS v,"
                                 " quantile_cont(CAST(floor(avg_message_size) AS BIGINT), 0.75) AS s FROM stats)"
                                 " SELECT sender, total_messages, avg_message_size,"
                                 " CASE WHEN total_messages >= v THEN 'many' ELSE 'few' END || '_' ||"
                                 " CASE WHEN floor(avg_message_size) >= s THEN 'long' ELSE 'short' END AS profile"
                                 " FROM stats, l",
        "parse_chat_timestamp": _ids("moment"),
        "message_hour": _ids(f"{HOUR} AS hour"),
        "message_weekday": _ids(f"{DAY_IDX} AS day_idx, ([{_DAYS}])[{DAY_IDX} + 1] AS day_name"),
        "messages_by_day": f"{events}, c AS (SELECT {DAY_IDX} AS day_idx, count(*) AS n FROM v_timed GROUP BY 1)"
                           f" SELECT CAST(r.day_idx AS INTEGER) AS day_idx, ([{_DAYS}])[r.day_idx + 1] AS day_name,"
                           " coalesce(n, 0) AS count FROM (SELECT unnest(range(7)) AS day_idx) r LEFT JOIN c USING (day_idx)",
        "messages_by_hour": f"{events} SELECT {HOUR} AS hour, count(*) AS count FROM v_timed GROUP BY 1",
        "messages_by_hour_dense": f"{events}, c AS (SELECT {HOUR} AS hour, count(*) AS n FROM v_timed GROUP BY 1)"
                                  " SELECT CAST(r.hour AS INTEGER) AS hour, coalesce(n, 0) AS count"
                                  " FROM (SELECT unnest(range(24)) AS hour) r LEFT JOIN c USING (hour)",
        "activity_heatmap": _heatmap(),
        "activity_peaks": _peaks(),
        "date_range": f"{events} SELECT min(moment) AS first_message,"
                      " max(moment) AS last_message, count(moment) AS dated_messages FROM v_timed",
        "adjective_frequency": f"WITH {_tokens(fx.V_DECORATED, 'v_decorated', 'msg_id')},"
                               " t AS (SELECT unnest(words) AS token FROM v_words)"
                               f" SELECT token AS adjetivo, count(*) AS count FROM t WHERE token IN (SELECT a FROM"
                               f" (VALUES {lexicon}) l(a, p) WHERE p = 'ADJ') GROUP BY token",
        "extract_emojis": f"{decorated}, t AS (SELECT msg_id, unnest({pos(f"regexp_extract_all(message, '{emoji}')")}) AS x"
                          " FROM v_decorated) SELECT msg_id, x.pos AS pos, x.v AS emoji FROM t",
        "emoji_frequency": f"{decorated}, t AS (SELECT unnest(regexp_extract_all(message, '{emoji}')) AS emoji FROM v_decorated)"
                           " SELECT emoji, count(*) AS count FROM t GROUP BY emoji ORDER BY count DESC, emoji LIMIT 10",
        "extract_links": f"{decorated}, t AS (SELECT msg_id, unnest({pos(_links('message'))}) AS x FROM v_decorated)"
                         " SELECT msg_id, x.pos AS pos, x.v AS link FROM t",
        "url_domain": f"SELECT page_id, {_domain('url')} AS dominio FROM pages",
        "url_domain_strict": f"SELECT page_id, {_domain('url', True)} AS dominio FROM pages",
        "top_shared_domains": f"{decorated}, t AS (SELECT unnest({_links('message')}) AS link FROM v_decorated)"
                              f" SELECT {_domain('link')} AS dominio, count(*) AS count FROM t GROUP BY 1"
                              " ORDER BY count DESC, dominio LIMIT 10",
        "term_weights": f"WITH {_clouds()}, top AS (SELECT * FROM c_terms ORDER BY count DESC, term LIMIT 200)"
                        " SELECT term, count, count / (SELECT max(count) FROM top) AS weight FROM top",
        "term_weights_by_chat": f"WITH {_clouds_by_chat()}, top AS (SELECT * FROM c_terms"
                                " QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY count DESC, term) <= 200)"
                                " SELECT chat_id, term, count, count / max(count) OVER (PARTITION BY chat_id) AS weight FROM top",
        "bigram_collocations": f"WITH {_clouds()} SELECT bigram, CAST(n AS BIGINT) AS count, round(score, 4) AS score FROM c_kept",
        "top_words": f"WITH {_tokens(fx.V_MESSAGES, 'v_messages', 'msg_id')}, t AS (SELECT unnest(words) AS token FROM v_words)"
                     " SELECT token, count(*) AS count FROM t GROUP BY token ORDER BY count DESC, token LIMIT 10",
        "top_words_per_member": f"WITH {_tokens(fx.V_MESSAGES, 'v_messages', 'msg_id, sender')},"
                                " t AS (SELECT sender, unnest(words) AS token FROM v_words),"
                                " c AS (SELECT sender, token, count(*) AS count FROM t GROUP BY ALL)"
                                " SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY sender ORDER BY count DESC, token) <= 10",
    }
