"""SQL of the queries in ``round_trips``: what must come back from the files."""

from __future__ import annotations

from tertulia import fixed_values as V
from tertulia.plans import fixtures as fx, oracle as o
from tertulia.plans.round_trips import PIECE_CHARS


def _masked_lines() -> str:
    return f"""v_line AS (SELECT chat_id, seq, is_header, timestamp, sender, text AS message FROM v_fields),
{o.masked("v_line", "chat_id, seq, is_header, timestamp, sender")},
v_safe AS (SELECT chat_id, seq, is_header, timestamp, sender, message AS text FROM v_redacted)"""


def _report() -> str:
    return f"""WITH {o._clouds_by_chat()}, moments AS (SELECT chat_id, {o.MOMENT} AS moment FROM v_messages),
words AS (SELECT chat_id, sender, unnest({o.words('message', o.STOP)}) AS token FROM v_messages),
stats AS (SELECT chat_id, sender, count(message) AS n FROM ({o.MEMBERS}) GROUP BY ALL),
parts AS (
  SELECT chat_id, 'top_active_members' AS metric, n FROM
    (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY n DESC, sender) AS spot FROM stats) WHERE spot <= 10
  UNION ALL SELECT chat_id, 'user_statistics', n FROM stats
  UNION ALL SELECT chat_id, 'messages_by_day', count(m.moment) FROM
    (SELECT chat_id, unnest(range(7)) AS d FROM (SELECT DISTINCT chat_id FROM moments)) LEFT JOIN moments m USING (chat_id)
    WHERE m.moment IS NULL OR isodow(m.moment) - 1 = d GROUP BY chat_id, d
  UNION ALL SELECT chat_id, 'messages_by_hour', count(*) FROM moments GROUP BY chat_id, hour(moment)
  UNION ALL SELECT chat_id, 'top_words', n FROM
    (SELECT chat_id, token, count(*) AS n FROM words GROUP BY chat_id, token QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY count(*) DESC, token) <= 10)
  UNION ALL SELECT chat_id, 'top_words_per_member', n FROM
    (SELECT chat_id, sender, token, count(*) AS n FROM words GROUP BY chat_id, sender, token
     QUALIFY row_number() OVER (PARTITION BY chat_id, sender ORDER BY count(*) DESC, token) <= 10)
  UNION ALL SELECT chat_id, 'term_weights', count FROM c_terms QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY count DESC, term) <= 200)
SELECT chat_id, metric, CASE WHEN metric = 'messages_by_day' THEN 7 ELSE count(*) END AS n_rows, CAST(sum(n) AS BIGINT) AS total
FROM parts GROUP BY chat_id, metric"""


def oracle_sql() -> dict[str, str]:
    safe = f"WITH {o.PARSED}, {_masked_lines()}, {o._assembled('v_safe')}"
    limit = PIECE_CHARS
    return {
        "message_pieces": f"""WITH {o.PARSED},
numbered AS (
  SELECT *, CAST(sum(CASE WHEN is_header THEN 1 ELSE 0 END) OVER (PARTITION BY chat_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS msg_idx,
         length(text) + CASE WHEN is_header THEN 0 ELSE 1 END AS n FROM v_fields),
placed AS (
  SELECT *, CAST(sum(n) OVER (PARTITION BY chat_id, msg_idx ORDER BY seq ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS spot
  FROM numbered WHERE msg_idx > 0)
SELECT chat_id, msg_idx, min(spot) AS "at", coalesce(max(timestamp), '') AS timestamp, coalesce(max(sender), '') AS sender,
       string_agg(text, chr(10) ORDER BY seq) AS text
FROM placed GROUP BY chat_id, msg_idx, spot // {limit} + (spot + greatest(n, 1) - 1) // {limit}""",
        "csv_in_splits": f"WITH {fx.V_DECORATED} SELECT timestamp, sender || ' \"x\", ' || msg_id AS sender, message FROM v_decorated",
        "anonymize_job": f"{safe} SELECT * FROM v_pseudonymous",
        "anonymized_text": f"""{safe},
r AS (SELECT chat_id, msg_idx, string_split('[' || timestamp || '] ' || sender || ': ' || message, chr(10)) AS parts FROM v_pseudonymous),
s AS (SELECT chat_id, msg_idx, i, parts[i] AS value FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM r))
SELECT chat_id, CAST(sum(strlen(value) + 1) OVER (PARTITION BY chat_id ORDER BY msg_idx, i ROWS UNBOUNDED PRECEDING) - strlen(value) - 1 AS BIGINT)
       AS byte_offset, value FROM s""",
        "kept_pseudonyms": f"""WITH {o.PARSED},
senders AS (
  SELECT chat_id, sender, min(seq) FILTER (seq // {fx.SEQ_WIDTH} % 2 = 0) AS early, min(seq) AS spot FROM v_fields WHERE is_header GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY early IS NULL, coalesce(early, spot)) AS number FROM senders)
SELECT chat_id, sender, CASE WHEN sender = '{V.SYSTEM_SENDER}' THEN sender ELSE '{V.PSEUDONYM_PREFIX}' || number END AS pseudonym, number FROM numbered""",
        "features_job": f"WITH {o.STATS} SELECT * FROM stats",
        "report_job": _report(),
    }

