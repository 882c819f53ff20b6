"""DuckDB SQL for the operators' queries that SQL can express, written apart from the operators.

Where a query's method has parameters of its own (lengths, fences), the SQL takes them from the
operator's module, so that both speak of the same thresholds.
"""

from __future__ import annotations

from ravine.llm import fmindex, quality, suffixes
from ravine.llm.common import WORD

#: Base32 of a 40-digit hex string: five hex digits are four base32 digits.
_BASE32 = "array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(digest, 5 * (k // 4) + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::BIGINT), 1) for k in range(32)], '')"

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS digest FROM pages),
top AS (SELECT digest, max(page_id) AS first_id FROM p GROUP BY digest)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN first_id <> coalesce(page_id, first_id - 1) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> coalesce(page_id, first_id - 1) THEN first_id END AS refers_to
FROM p JOIN top USING (digest)
"""

_PARTS = f"parts AS (SELECT doc_id, first, substr(h, 2 * first + 1, 2 * (512 + {suffixes.LENGTH - 1})) AS part FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2, 512)) AS first FROM d))"


def _repeated(name: str, n: int, having: str) -> str:
    """Maximal runs of bytes (doc_id, a, b) covered by strings of n bytes that meet a condition."""
    return f"""
{name}_starts AS (SELECT doc_id, first + i AS pos, hash(substr(part, 2 * i + 1, 2 * {n})) AS k
           FROM (SELECT doc_id, first, part, unnest(range(0, least(512, length(part) // 2 - {n - 1}))) AS i FROM parts)),
{name}_hits AS (SELECT doc_id, pos FROM {name}_starts WHERE k IN (SELECT k FROM {name}_starts GROUP BY k HAVING {having})),
{name}_turns AS (SELECT doc_id, pos, CASE WHEN pos <= lag(pos) OVER w + {n} THEN 0 ELSE 1 END AS fresh FROM {name}_hits WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
{name}_islands AS (SELECT doc_id, pos, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM {name}_turns),
{name} AS (SELECT doc_id, min(pos) AS a, max(pos) + {n} AS b FROM {name}_islands GROUP BY doc_id, island)"""


SUFFIXES = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
{_PARTS},
{_repeated("runs", suffixes.LENGTH, "count(*) > 1")},
{_repeated("shared", suffixes.REPORT, "count(DISTINCT doc_id) > 1")},
gaps AS (SELECT doc_id, coalesce(lag(b) OVER w, 0) AS x, a AS y FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY a)
         UNION ALL
         SELECT doc_id, coalesce(max(b), 0), length(any_value(h)) // 2 FROM d LEFT JOIN runs USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS kept FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
removed AS (SELECT doc_id, sum(b - a) AS n, count(*) AS spans FROM runs GROUP BY doc_id),
common AS (SELECT doc_id, sum(b - a) AS n_shared FROM shared GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256, coalesce(n_shared, 0)::BIGINT AS n_shared
FROM d JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id) LEFT JOIN common USING (doc_id)
"""

_WORDS = f"w AS (SELECT *, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents)"

FM_INDEX = f"""
WITH {_WORDS},
starts AS (SELECT doc_id, pos, array_to_string(words[pos : pos + {fmindex.LENGTH - 1}], ' ') AS k
           FROM (SELECT doc_id, words, unnest(range(1, len(words) - {fmindex.LENGTH - 2})) AS pos FROM w)),
least AS (SELECT k, min(doc_id) AS low FROM starts GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + {fmindex.LENGTH})) AS place FROM starts JOIN least USING (k) WHERE low < doc_id),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS kept FROM each ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


def _quality() -> str:
    ratios = {k: e.replace(" div ", " // ") for k, e in quality._ratios().items()}
    rows = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS measure, {e} AS value, {quality.SLACK[k]} AS slack FROM m WHERE NOT base_failed" for k, e in ratios.items())

    def fences(keys: str) -> str:
        by = f"{keys}, measure" if keys else "measure"
        return f"""
            SELECT {by}, q80 + {quality.FENCE} * (q80 - q50) + slack AS fence, n FROM (
              SELECT {by}, any_value(slack) AS slack, max(total) AS n, min(bucket) FILTER (100 * upto >= 50 * total) AS q50, min(bucket) FILTER (100 * upto >= 80 * total) AS q80
              FROM (SELECT {by}, bucket, slack, count(*) OVER (PARTITION BY {by}) AS total, count(*) OVER (PARTITION BY {by} ORDER BY bucket) AS upto FROM sketch)
              GROUP BY {by})"""

    fence = lambda k: f"coalesce((SELECT min(fence) FROM own WHERE n >= {quality.ENOUGH} AND measure = '{k}' AND lang IS NOT DISTINCT FROM g.lang AND source IS NOT DISTINCT FROM g.source), (SELECT min(fence) FROM by_lang WHERE n >= {quality.ENOUGH} AND measure = '{k}' AND lang IS NOT DISTINCT FROM g.lang), (SELECT min(fence) FROM corpus WHERE measure = '{k}')) AS max_{k}"
    within = " AND ".join(f"{e} <= coalesce(max_{k}, {e})" for k, e in ratios.items())
    return f"""
WITH {_WORDS},
windows AS (SELECT doc_id, pos, array_to_string(words[pos : pos + {quality.N - 1}], ' ') AS k FROM (SELECT doc_id, words, unnest(range(1, len(words) - {quality.N - 2})) AS pos FROM w)),
again AS (SELECT doc_id, k FROM windows GROUP BY doc_id, k HAVING count(*) > 1),
covered AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(pos, pos + {quality.N})) AS place FROM windows JOIN again USING (doc_id, k)) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM w) WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
base AS (SELECT w.doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
                length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g'))::BIGINT AS n_capitals,
                coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
         FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
measures AS ({rows}),
sketch AS (SELECT *, value - value % (1::BIGINT << greatest(length(bin(value)) - 7, 0)::BIGINT) AS bucket FROM measures),
own AS ({fences("lang, source")}),
by_lang AS ({fences("lang")}),
corpus AS ({fences("")}),
limits AS (SELECT lang, source, {", ".join(fence(k) for k in ratios)} FROM (SELECT DISTINCT lang, source FROM sketch) g)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {within} AS kept
FROM m LEFT JOIN limits l ON m.lang IS NOT DISTINCT FROM l.lang AND m.source IS NOT DISTINCT FROM l.source
"""


QUALITY = _quality()

_ESCAPED = r"replace(replace(replace(replace({0}, '\', '\\'), '<', '\l'), '[', '\o'), ']', '\c')"

CHAT = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, md5(text))) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, md5(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(10 + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, four bits at a time."""
    table = []
    for i in range(16):
        for _ in range(4):
            i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    nibbles = f"flatten([[ascii(c) & 15, ascii(c) >> 4] for c in string_split({text}, '')])"
    return f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {nibbles}), lambda a, n: xor(list_extract({table}::BIGINT[], (xor(a, n::BIGINT) & 15) + 1), a >> 4)))"


def _batch(day: str) -> str:
    return f"greatest(0, least(10 - 1, floor(({day} - 19723) * 10 / 152)))::INTEGER"


_DAY = "date_diff('day', DATE '1970-01-01', {}::DATE)"

VALID_TIME = f"""
WITH s AS (SELECT *, row_number() OVER () AS rid, {_batch(_DAY.format("arrived_at"))} AS batch FROM sales),
c AS (SELECT *, {_batch(_DAY.format("valid_at") + " + coalesce(delay, 0)")} AS batch, floor(100 * balance + 0.5)::BIGINT AS cents
      FROM (SELECT DISTINCT change_id, client_id, seq, op, valid_at, source, segment, city, balance, {_crc32("change_id::VARCHAR")} % 4 AS delay FROM client_changes WHERE valid_at IS NOT NULL)),
marks AS (SELECT b, (SELECT max(sold_at) FROM s WHERE batch < b) - INTERVAL 36 HOUR AS ws, (SELECT max(valid_at) FROM c WHERE batch < b) - INTERVAL 36 HOUR AS wc FROM range(10) t(b)),
h AS (SELECT b, CASE WHEN ws IS NOT NULL AND wc IS NOT NULL THEN least(ws, wc) END AS h FROM marks),
late AS (SELECT c.* FROM c JOIN marks ON batch = b WHERE valid_at < wc),
on_time AS (SELECT c.* FROM c JOIN marks ON batch = b WHERE client_id IS NOT NULL AND coalesce(valid_at >= wc, true)),
passed AS (SELECT *, greatest(batch, coalesce((SELECT min(b) FROM h WHERE valid_at <= h), 99)) AS q FROM on_time),
v AS (SELECT *, greatest(batch, coalesce(min(q) OVER (PARTITION BY client_id ORDER BY valid_at, seq NULLS FIRST, change_id NULLS FIRST ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 99)) AS pruned FROM passed),
e AS (SELECT *, CASE WHEN sold_at IS NULL THEN batch ELSE coalesce((SELECT min(b) FROM h WHERE b >= s.batch AND sold_at < h), 10) END AS emitted FROM s),
found AS (SELECT rid, any_value(e.sale_id) AS id, any_value(emitted) AS batch, count(v.batch) AS n_held,
                 max({{'valid_at': valid_at, 'seq': seq, 'change_id': change_id, 'cents': cents, 'op': op}}) FILTER (valid_at <= sold_at) AS last
          FROM e LEFT JOIN v ON e.client_id = v.client_id AND v.batch <= emitted AND pruned >= emitted GROUP BY rid)
SELECT 'sale' AS rec, id, batch::BIGINT AS batch, n_held::BIGINT AS n_held, last.change_id AS change_id, last.cents AS balance_cents, last.op AS op FROM found
UNION ALL
SELECT 'late', change_id, batch::BIGINT, NULL, NULL, NULL, NULL FROM late
"""

ORACLES: dict[str, str] = {"op2_warc": WARC, "op4_suffix_array": SUFFIXES, "op6_fm_index": FM_INDEX, "op9_quality_rules": QUALITY, "op12_valid_time": VALID_TIME, "op13_chat": CHAT}
