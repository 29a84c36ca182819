"""SQL of the queries in ``learned``."""

from __future__ import annotations

from tertulia import fixed_values as V
from tertulia.functions.name_model import DIGITS, NEVER, SIZES
from tertulia.plans import fixtures as fx, oracle as o
from tertulia.plans.learned import ENDINGS_LEXICON, MISSPELT, MORE_PHRASES, PLANTED


def _bytes(x: str) -> str:
    """A lower-case word with accented letters as capitals: DuckDB's edit distance counts bytes."""
    return f"translate({x}, 'áéíóúñäöüßàèìòùâêîôûçëïœ', 'ABCDEFGHIJKLMNOPQRSTUVWX')"


def _code(x: str, at: int) -> str:
    spot = str(at) if at > 0 else f"length({x}) - {-at - 1}"
    return f"CASE WHEN length({x}) >= {abs(at)} THEN unicode(substr({x}, {spot}, 1)) ELSE 0 END"


def _shown() -> str:
    """CTEs: words of every message with what they show and, where labelled, their state."""
    planted = " ".join(
        f"WHEN {rest} THEN [{', '.join('[' + fx._quoted(n.split()) + ']' for n in held)}]" for rest, held in PLANTED.items())
    low, last = "lower(w)", "lower(before)"
    return f"""{fx.V_DECORATED},
pieces AS (
  SELECT msg_id, regexp_extract_all(message, '\\p{{L}}+|[^\\p{{L}}]+') AS p, CASE msg_id % {len(fx.DECORATIONS)} {planted} END AS names FROM v_decorated),
starts AS (SELECT *, CASE WHEN regexp_matches(p[1], '^\\p{{L}}') THEN 0 ELSE 1 END AS off FROM pieces),
spots AS (SELECT *, unnest(range(off, len(p), 2)) AS i FROM starts),
words AS (
  SELECT msg_id, CAST((i - off) // 2 AS INTEGER) AS j, p[i + 1] AS w, CASE WHEN i > 0 THEN p[i] ELSE '' END AS gap,
         CASE WHEN i > 1 THEN p[i - 1] ELSE '' END AS before FROM spots),
shown AS (
  SELECT msg_id, j, w,
         CASE WHEN w = lower(w) THEN 0 WHEN length(w) > 1 AND w = upper(w) THEN 2 WHEN substr(w, 2) = lower(substr(w, 2)) THEN 1 ELSE 3 END * 4
           + CASE WHEN j = 0 THEN 0 WHEN regexp_matches(gap, '[.!?:\\n]') THEN 1 WHEN regexp_matches(gap, '^ +$') THEN 2 ELSE 3 END AS shape,
         ({_code(low, 1)} * 961 + {_code(low, 2)} * 31 + {_code(low, 3)}) % {SIZES["prefix"]} AS prefix,
         ({_code(low, -1)} * 31 + {_code(low, -2)}) % {SIZES["suffix"]} AS suffix,
         ({_code(last, 1)} * 961 + {_code(last, -1)} * 31 + length({last})) % {SIZES["before"]} AS before,
         j > 0 AND regexp_matches(gap, '^ +$') AS joined
  FROM words),
lists AS (SELECT msg_id, list(w ORDER BY j) AS ws FROM words GROUP BY msg_id),
named AS (SELECT msg_id, unnest(names) AS nm FROM starts),
begun AS (
  SELECT w.msg_id, w.j, max(len(nm)) AS n FROM words w JOIN named USING (msg_id) JOIN lists USING (msg_id)
  WHERE list_slice(ws, w.j + 1, w.j + len(nm)) = nm GROUP BY ALL),
states AS (
  SELECT s.*, CASE WHEN EXISTS (SELECT 1 FROM begun b WHERE b.msg_id = s.msg_id AND b.j < s.j AND s.j < b.j + b.n) THEN 2
    WHEN EXISTS (SELECT 1 FROM begun b WHERE b.msg_id = s.msg_id AND b.j = s.j) THEN 1 ELSE 0 END AS state FROM shown s),
stepped AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY msg_id ORDER BY j), 0) AS step FROM states),
counts AS (
  SELECT feature, CAST(bucket AS INTEGER) AS bucket, CAST(state AS INTEGER) AS state, count(*) AS n FROM (
    {" UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS bucket, state FROM stepped" for f in SIZES)}) GROUP BY ALL)"""


def _decoded() -> str:
    ln = lambda n, of: f"round(ln(({n} + 1) / ({of})), {DIGITS})"
    features = [f for f in SIZES if f != "step"]
    tables = "".join(f"""
t_{f} AS (
  SELECT b.bucket, {", ".join(f"{ln(f'coalesce(sum(n) FILTER (state = {s}), 0)', f'(SELECT coalesce(sum(n), 0) FROM counts WHERE feature = {chr(39)}{f}{chr(39)} AND state = {s}) + {SIZES[f]}')} AS s{s}" for s in range(3))}
  FROM (SELECT unnest(range({SIZES[f]})) AS bucket) b LEFT JOIN counts c ON c.feature = '{f}' AND c.bucket = b.bucket GROUP BY b.bucket),""" for f in features)
    steps = ", ".join(
        f"(SELECT {ln(f'coalesce(sum(n) FILTER (state = {s}), 0)', 'coalesce(sum(n), 0) + 3')} FROM counts WHERE feature = 'step' AND bucket = {b}) AS t{b}{s}"
        for b in range(3) for s in range(3))
    own = lambda s: " + ".join(f"t_{f}.s{s}" for f in ("shape", "prefix", "suffix", "before"))
    joins = " ".join(f"JOIN t_{f} ON t_{f}.bucket = x.{f}" for f in features)
    closed = {"f": "acc.fs || acc.ff || '-' || x.j || ';'", "m": "acc.ms || acc.mf || '-' || x.j || ';'"}
    to = lambda s: [f"(acc.{k} + t{b}{s})" for b, k in enumerate("ofm")]
    path = lambda s: (
        f"CASE WHEN {to(s)[0]} >= {to(s)[1]} AND {to(s)[0]} >= {to(s)[2]} THEN acc.os WHEN {to(s)[1]} >= {to(s)[2]} THEN {closed['f']} ELSE {closed['m']} END")
    early = f"{to(2)[1]} >= {to(2)[2]}"
    return f"""WITH {_shown()},{tables}
steps AS (SELECT {steps}),
chains AS (
  SELECT msg_id, list({{'o': {own(0)}, 'f': {own(1)}, 'm': {own(2)}, 'os': '', 'fs': '', 'ms': '', 'ff': 0, 'mf': 0, 'joined': joined, 'j': j}} ORDER BY j) AS xs
  FROM shown x {joins} GROUP BY msg_id),
reduced AS (
  SELECT msg_id, len(xs) AS n, list_reduce(list_prepend({{'o': CAST(0 AS DOUBLE), 'f': CAST({NEVER} AS DOUBLE), 'm': CAST({NEVER} AS DOUBLE), 'os': '', 'fs': '', 'ms': '',
      'ff': 0, 'mf': 0, 'joined': false, 'j': 0}}, xs), lambda acc, x: {{
      'o': greatest({", ".join(to(0))}) + x.o, 'f': greatest({", ".join(to(1))}) + x.f,
      'm': CASE WHEN x.joined THEN greatest({to(2)[1]}, {to(2)[2]}) + x.m ELSE CAST({NEVER} AS DOUBLE) END,
      'os': {path(0)}, 'fs': {path(1)}, 'ms': CASE WHEN {early} THEN acc.fs ELSE acc.ms END,
      'ff': x.j, 'mf': CASE WHEN {early} THEN acc.ff ELSE acc.mf END, 'joined': x.joined, 'j': x.j}}) AS a
  FROM chains, steps),
found AS (
  SELECT msg_id, CASE WHEN a.o >= a.f AND a.o >= a.m THEN a.os WHEN a.f >= a.m THEN a.fs || a.ff || '-' || n || ';'
    ELSE a.ms || a.mf || '-' || n || ';' END AS spans FROM reduced),
each AS (
  SELECT msg_id, pos, string_split(span, '-') AS ab FROM (
    SELECT msg_id, unnest(range(len(s))) AS pos, unnest(s) AS span FROM (SELECT msg_id, list_filter(string_split(spans, ';'), lambda t: t <> '') AS s FROM found)))
SELECT msg_id, CAST(pos AS INTEGER) AS pos,
       array_to_string(list_slice(p, off + 2 * CAST(ab[1] AS INTEGER) + 1, off + 2 * CAST(ab[2] AS INTEGER) - 1), '') AS name
FROM each JOIN starts USING (msg_id)"""


def _orders() -> str:
    """Both readings of every timestamp; January only, so the other reading swaps day and month where the day allows."""
    day, month, year = (f"CAST(strftime(ts, '%{c}') AS INTEGER)" for c in "dmY")
    real = "date_trunc('minute', ts)"
    swapped = f"make_timestamp({year}, {day}, {month}, hour(ts), minute(ts), 0)"
    odd = "regexp_matches(chat_id, '[13579]$')"
    step = lambda k: f"last_value({k} IGNORE NULLS) OVER (PARTITION BY chat_id ORDER BY epoch(date_trunc('second', ts)) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""WITH {fx.V_MESSAGES},
readings AS (
  SELECT msg_id, chat_id, ts, CASE WHEN {odd} OR {day} > 12 THEN {real} ELSE {swapped} END AS m,
         CASE WHEN NOT {odd} THEN {real} WHEN {day} <= 12 THEN {swapped} END AS d FROM v_messages),
steps AS (SELECT *, m < {step("m")} AS back_m, d < {step("d")} AS back_d FROM readings),
scores AS (
  SELECT chat_id, count(*) FILTER (back_m) AS back_mdy, count(*) FILTER (back_d) AS back_dmy, count(*) FILTER (m IS NULL) AS unread_mdy,
         count(*) FILTER (d IS NULL) AS unread_dmy FROM steps GROUP BY chat_id),
orders AS (
  SELECT *, CASE WHEN back_dmy + unread_dmy < back_mdy + unread_mdy THEN 'dmy' ELSE 'mdy_fallback' END AS date_order,
         back_dmy + unread_dmy = back_mdy + unread_mdy AS ambiguous FROM scores)"""


def oracle_sql() -> dict[str, str]:
    listed = ", ".join(f"('{p.lower()}')" for p in [*V.NAME_EXCEPTIONS, *MORE_PHRASES])
    lexicon = ", ".join(f"('{t}', '{p}')" for t, p in ENDINGS_LEXICON)
    words = "regexp_extract_all(span, '\\S+')"
    return {
        "name_model_counts": f"WITH {_shown()} SELECT feature, bucket, state, n FROM counts",
        "hmm_name_spans": _decoded(),
        "candidates_by_phrase_table": f"""WITH {fx.V_DECORATED}, phrases(p) AS (VALUES {listed}),
c AS (SELECT msg_id, unnest({o.spans("message")}) AS span FROM v_decorated)
SELECT msg_id, span FROM c WHERE len({words}) >= 2 AND NOT list_has_any({words}, {o._list(V.BLOCKED_NAME_WORDS)})
  AND NOT list_contains({o._list(V.BLOCKED_NAME_WORDS)}, span)
  AND NOT EXISTS (SELECT 1 FROM phrases WHERE contains(lower(span), p) OR contains(p, lower(span)))""",
        "adjective_guessed": f"""WITH {o._tokens(fx.V_DECORATED, "v_decorated", "msg_id")},
counts AS (SELECT token, count(*) AS count FROM (SELECT unnest(words) AS token FROM v_words) GROUP BY token),
lexicon(token, pos) AS (VALUES {lexicon}),
ends AS (SELECT token, pos, unnest(range(1, least(length(token), 4) + 1)) AS k FROM lexicon),
per_pos AS (SELECT right(token, k) AS ending, pos, count(*) AS n FROM ends GROUP BY ALL),
trie AS (SELECT ending, first(pos ORDER BY n DESC, pos) AS pos FROM per_pos GROUP BY ending HAVING sum(n) >= 2),
unknown AS (SELECT token, unnest(range(1, least(length(token), 4) + 1)) AS k FROM counts WHERE token NOT IN (SELECT token FROM lexicon)),
guesses AS (SELECT u.token, first(t.pos ORDER BY k DESC) AS pos FROM unknown u JOIN trie t ON t.ending = right(u.token, k) GROUP BY u.token)
SELECT c.token AS adjetivo, c.count, g.token IS NOT NULL AS guessed
FROM counts c LEFT JOIN guesses g ON g.token = c.token AND g.pos = 'ADJ'
WHERE g.token IS NOT NULL OR c.token IN (SELECT token FROM lexicon WHERE pos = 'ADJ')""",
        "left_names": f"""WITH {fx.V_DECORATED}, {o.masked("v_decorated", "msg_id, chat_id")},
words AS (
  SELECT chat_id, word, count(*) AS count FROM (SELECT chat_id, unnest(regexp_extract_all(lower(message), '\\p{{L}}+')) AS word FROM v_redacted)
  WHERE length(word) >= 4 GROUP BY ALL),
names AS (
  SELECT DISTINCT sender, name_word FROM (SELECT sender, unnest(string_split(lower(sender), ' ')) AS name_word
    FROM (SELECT unnest({o._list(MISSPELT)}) AS sender)) WHERE length(name_word) >= 4),
near AS (SELECT *, levenshtein({_bytes('word')}, name_word) AS distance FROM words, names WHERE abs(length(word) - length(name_word)) <= 1)
SELECT chat_id, sender, name_word, word, CAST(distance AS INTEGER) AS distance, count FROM near WHERE distance <= 1""",
        "date_order_by_chat": f"{_orders()} SELECT * FROM orders",
        "inferred_moments": f"{_orders()} SELECT msg_id, CASE WHEN date_order = 'dmy' THEN d ELSE m END AS moment FROM readings JOIN orders USING (chat_id)",
    }
