"""Reference SQL of this folder's queries, for DuckDB. It recounts in its own way what the operators do."""

from __future__ import annotations

from tabscope.llm import chat, codes, quality, secrets

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS ws FROM documents
), b AS (
  SELECT row_number() OVER () AS ir, item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS ws FROM benchmark
), win AS (
  SELECT ir, item_id, q, k, ws[q:q + k - 1] AS g
  FROM (SELECT *, least(13, len(ws)) AS k FROM b WHERE len(ws) > 0), unnest(range(1, len(ws) - k + 2)) AS u(q)
), dw AS (
  SELECT r, i, k, ws[i:i + k - 1] AS g
  FROM (SELECT r, ws, k FROM d, (SELECT DISTINCT k FROM win) WHERE len(ws) >= k), unnest(range(1, len(ws) - k + 2)) AS u(i)
), hit AS (SELECT dw.r, dw.i, dw.k, win.ir, win.item_id, win.q FROM dw JOIN win USING (k, g)
), words AS (
  SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM hit) GROUP BY r
), items AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY r
), runs AS (
  SELECT r, max(n) AS longest FROM (
    SELECT r, count(*) + any_value(k) - 1 AS n
    FROM (SELECT *, i - row_number() OVER (PARTITION BY r, ir, i - q ORDER BY i) AS run FROM hit)
    GROUP BY r, ir, i - q, run) GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated,
       coalesce(longest, 0)::BIGINT AS longest_match
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r) LEFT JOIN runs USING (r)
"""

QUALITY = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), win AS (
  SELECT r, i, ws[i:i + 2] AS g FROM d, unnest(range(1, len(ws) - 1)) AS u(i)
), covered AS (
  SELECT r, count(DISTINCT j) AS n FROM (
    SELECT r, unnest([i, i + 1, i + 2]) AS j FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1) GROUP BY r
), facts AS (
  SELECT doc_id, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN covered USING (r)
), judged AS (
  SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM facts
), hosts AS (
  SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM judged GROUP BY source
), fit AS (
  SELECT sum(f) / sum(n) AS m, sum(f * f / n) / sum(n) - (sum(f) / sum(n)) ** 2 - (sum(f) / sum(n)) * (1 - sum(f) / sum(n)) * count(*) / sum(n) AS v FROM hosts
), prior AS (
  SELECT m, least(greatest(CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE 10000 END, 1), 10000) AS s FROM fit
), rated AS (SELECT source, (f + s * m) / (n + s) AS rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rate <= {quality.MAX_HOST_RATE} AS kept, round(rate, 6) AS host_rate, rate > {quality.MAX_HOST_RATE} AS host_rejected
FROM judged JOIN rated ON judged.source IS NOT DISTINCT FROM rated.source
"""

_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v // {}) % 32 + 1)::BIGINT, 1)"
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY t) AS best, sha1(t) AS h FROM p)
SELECT page_id, strlen(t)::BIGINT AS payload_bytes,
       list_aggregate(list_transform(list_transform(range(0, 8), lambda j: ('0x' || substr(h, j * 5 + 1, 5))::BIGINT),
         lambda v: {' || '.join(_DIGIT.format(32**k) for k in (3, 2, 1, 0))}), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to, CASE WHEN page_id = best THEN true END AS digest_ok
FROM q
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _kind(number: int, pattern: str, keep: str) -> str:
    p = _quoted(pattern)
    return f"""
  SELECT r, {number} AS kind, hits[k] AS found, (list_sum(list_transform(gaps[1:k], lambda x: length(x))) +
         coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0))::BIGINT AS start
  FROM (SELECT r, regexp_extract_all(t, {p}) AS hits, string_split_regex(t, {p}) AS gaps FROM d), unnest(range(1, len(hits) + 1)) AS u(k)
  WHERE {keep}"""


def _allowed(found: str, window: int) -> str:
    """The allow-list: a whole match, a path of plain names, or a placeholder beside plain names or few characters."""
    def whole(text: str) -> str:
        return " OR ".join(f"regexp_matches({text}, {_quoted(p)})" for p in secrets.ALLOWED[:3])

    placeholder, path = (_quoted(p) for p in secrets.ALLOWED[3:])
    rest = f"regexp_replace({found}, {placeholder}, '', 'g')"
    pieces = f"len(regexp_extract_all(s, {_quoted('[A-Z]?[a-z]+|[A-Z]+|[0-9]+')}))"
    names = f"len(list_filter(string_split({rest}, '/'), lambda s: NOT (({pieces} - 1) * 4 <= greatest(4, length(s)) OR {whole('s')}))) = 0"
    return f"""{whole(found)} OR (regexp_matches({found}, {path}) AND {names})
      OR (regexp_matches({found}, {placeholder}) AND (length({rest}) < {window} OR {names}))"""


def _secrets() -> str:
    base = " UNION ALL ".join([
        _kind(0, secrets.ASSIGN, f"length(regexp_extract(hits[k], {_quoted(secrets.ASSIGN)}, 2)) >= {secrets.ASSIGN_LENGTH}"),
        _kind(1, "AKIA[A-Z0-9]+", "length(hits[k]) >= 18"), _kind(2, "[0-9a-f]+", "length(hits[k]) >= 16"),
    ])
    parts = []
    for k, (_, pattern, window, least) in enumerate(secrets.CLASSES):
        table = "[" + ", ".join(map(str, secrets._table(window))) + "]"
        parts.append(f"""
  SELECT r, {3 + k} AS kind, start + min(i) AS start, start + max(i) + {window} AS stop FROM (
    SELECT r, start, unnest(range(0, length(found) - {window} + 1)) AS i, found FROM ({_kind(3 + k, pattern, f"NOT ({_allowed('hits[k]', window)})")}))
  WHERE list_sum(list_transform(map_values(list_aggregate(string_split(substr(found, i + 1, {window}), ''), 'histogram')), lambda c: {table}[c::BIGINT + 1]))
        <= {secrets.entropy_limit(window, least)}
  GROUP BY r, start, found""")
    names = "[" + ", ".join(_quoted(n) for n in secrets.KINDS) + "]"
    listed = f"string_agg({names}[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
base AS (SELECT r, kind, start, start + length(found) AS stop FROM ({base})),
dense AS ({' UNION ALL '.join(parts)}),
more AS (SELECT * FROM dense x WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = x.r AND b.start <= x.start AND x.stop <= b.stop)),
n AS (SELECT r, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c, {listed} AS s FROM base GROUP BY r),
e AS (SELECT r, count(*) AS n FROM more GROUP BY r),
every AS (SELECT r, {listed} AS s FROM (SELECT * FROM base UNION ALL SELECT * FROM more) GROUP BY r)
SELECT doc_id, coalesce(n.a, 0)::BIGINT AS n_assign, coalesce(n.b, 0)::BIGINT AS n_access, coalesce(n.c, 0)::BIGINT AS n_hex,
       coalesce(e.n, 0)::BIGINT AS n_entropy, sha256(coalesce(n.s, '')) AS base_sha256, coalesce(every.s, '') AS spans
FROM d LEFT JOIN n USING (r) LEFT JOIN e USING (r) LEFT JOIN every USING (r)
"""

_CONTROLS = "|".join("".join(f"\\{c}" if c in "|[]" else c for c in control) for control in chat.CONTROLS)
_ESCAPED = "length({0}) + length({0}) - length(replace({0}, '\\', '')) + len(regexp_extract_all({0}, '" + _CONTROLS + "'))"
CHAT = rf"""
WITH RECURSIVE said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), turns AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id) AS c, coalesce(floor(turn / {chat.SEGMENT}.0)::BIGINT, 1099511627776) AS seg,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS i, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + {chat.MARKS} AS k,
         {len(chat.START) + len(chat.END) + 2} + {_ESCAPED.format("role")} + length(role) - length(replace(role, chr(10), '')) + {_ESCAPED.format("text")} AS n
  FROM said
), heads AS (
  SELECT c, min(i) AS head, min_by(seg, i) AS head_seg, min_by(k, i) AS head_k, min_by(n, i) AS head_n FROM turns WHERE role = '{chat.ROLE_SYSTEM}' GROUP BY c
), t AS (
  SELECT *, sum(k) OVER (PARTITION BY c ORDER BY i) - k AS p, seg >= head_seg AS known,
         greatest({chat.BUDGET - chat.HISTORY} - CASE WHEN seg >= head_seg THEN head_k ELSE 0 END, {(chat.BUDGET - chat.HISTORY) // 4}) AS room
  FROM turns LEFT JOIN heads USING (c)
), following AS (
  SELECT a.c, a.seg, a.i, min(b.i) AS j FROM t a JOIN t b ON a.c = b.c AND a.seg = b.seg AND b.i > a.i AND b.p + b.k - a.p > a.room GROUP BY a.c, a.seg, a.i
), firsts AS (
  SELECT c, seg, min(i) AS i FROM t GROUP BY c, seg
  UNION ALL SELECT x.c, x.seg, y.j FROM firsts x JOIN following y ON x.c = y.c AND x.seg = y.seg AND x.i = y.i
), spans AS (
  SELECT f.c, f.seg, f.i AS first, t.p, t.known, t.head, t.head_n, lead(f.i, 1, (SELECT max(m.i) FROM t m WHERE m.c = f.c) + 1) OVER (PARTITION BY f.c ORDER BY f.i) AS stop
  FROM firsts f JOIN t ON t.c = f.c AND t.i = f.i
), shown AS (
  SELECT s.c, s.first, any_value(s.known) AS known, any_value(s.head) AS head, any_value(s.head_n) AS head_n, min(t.i) AS begin, sum(t.n) AS n
  FROM spans s JOIN t ON t.c = s.c AND t.i < s.stop AND (t.i >= s.first OR (t.i >= s.first - {chat.HISTORY_TURNS} AND s.p - t.p <= {chat.HISTORY}
       AND (t.seg = s.seg OR (t.seg = s.seg - 1 AND t.turn % {chat.SEGMENT} >= {chat.SEGMENT - chat.HISTORY_TURNS}))))
  GROUP BY s.c, s.first
), sizes AS (
  SELECT c, sum(n + CASE WHEN known AND head < begin THEN head_n ELSE 0 END) AS n, count(*) AS windows FROM shown GROUP BY c
)
SELECT any_value(conv_id) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = '{chat.ROLE_LOSS}'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = '{chat.ROLE_LOSS}'), '')) AS loss_sha256,
       any_value(sizes.n)::BIGINT AS formatted_chars, any_value(sizes.windows)::BIGINT AS n_windows
FROM t JOIN sizes USING (c) GROUP BY c
"""

_TERMS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SEARCH = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, ws, len(ws)::BIGINT AS n FROM (SELECT doc_id, {_TERMS} AS ws FROM documents) WHERE len(ws) > 0
), corpus AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS size FROM d
), asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark
), counts AS (
  SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY r, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counts, corpus GROUP BY term
), parts AS (
  SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // size))) AS part
  FROM counts JOIN weights USING (term) JOIN d USING (r), corpus
), scores AS (SELECT item_id, r, sum(part)::BIGINT AS score FROM asked JOIN parts USING (term) GROUP BY item_id, r
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM scores JOIN d USING (r) WHERE score > 0)
WHERE rank <= 50
"""


def _codes() -> str:
    def nearest(k: int) -> str:
        return f"""a{k} AS MATERIALIZED (
  SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT r, p, e, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts JOIN b{k} USING (p)) GROUP BY r, p)"""

    def moved(k: int) -> str:
        return f"""b{k + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(m, c) AS c FROM b{k} LEFT JOIN (
    SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS m FROM (
      SELECT p, e, j, sum(v[j])::BIGINT AS s, count(*)::BIGINT AS n FROM parts JOIN a{k} USING (r, p), unnest(range(1, len(v) + 1)) AS u(j) GROUP BY p, e, j)
    GROUP BY p, e) USING (p, e))"""

    rounds = ", ".join(f"{nearest(k)}, {moved(k)}" for k in range(codes.ROUNDS))
    return f"""
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({codes.SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT r, p, v[p * (len(v) // {codes.PARTS}) + 1:(p + 1) * (len(v) // {codes.PARTS})] AS v FROM kept, unnest(range(0, {codes.PARTS})) AS u(p)
), seeds AS (
  SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT min_by(r, v) AS r, vec_id FROM kept WHERE vec_id IS NOT NULL GROUP BY vec_id ORDER BY vec_id LIMIT {codes.ENTRIES})
), b0 AS MATERIALIZED (SELECT p, e, v AS c FROM parts JOIN seeds USING (r)
), {rounds}, {nearest(codes.ROUNDS)},
coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{codes.ROUNDS} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{codes.ROUNDS}) AS codebooks_sha256
FROM kept JOIN coded USING (r)
"""


SQL: dict[str, str] = {"op11_codes": _codes(), "op12_search": SEARCH, "op13_chat": CHAT, "op2_secrets": _secrets(), "op3_decontaminate": DECONTAMINATE, "op6_warc": WARC, "op10_quality": QUALITY}
