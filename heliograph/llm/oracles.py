"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from heliograph.llm.url_filter import PATTERNS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op3_sql() -> str:
    fits = lambda host, path: f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
    pattern = " ".join(f"WHEN regexp_matches(host || path, '{e}') THEN '{n}'" for n, e, _ in sorted(PATTERNS))
    return f"""
WITH cut AS (
  SELECT page_id, coalesce(regexp_extract(url, '://([^/?#]*)', 1), '') AS raw_host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
parts AS (SELECT page_id, translate(raw_host, '{UPPER}', '{LOWER}') AS host, path FROM cut),
judged AS (
  SELECT *, CASE WHEN {fits("www.example.com", "/en/")} THEN 'www.example.com/en/'
                 WHEN {fits("example.com", "/en/")} THEN 'example.com/en/'
                 WHEN {fits("net", "/es/")} THEN 'net/es/' WHEN {fits("net", "/fr/")} THEN 'net/fr/'
                 WHEN {fits("com", "/")} THEN 'com/' END AS rule,
         CASE {pattern} END AS pattern FROM parts)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern
FROM judged"""


WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def op2_sql() -> str:
    return f"""
WITH docs AS (SELECT doc_id, {WORDS} AS w FROM documents),
items AS (SELECT item_id, {WORDS} AS w FROM benchmark),
cut AS (SELECT item_id, w, least(len(w), 10) AS n FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM cut)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, s, p.n, item_id FROM places p JOIN windows v ON v.n = p.n AND v.win = p.win),
covered AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS word FROM hits) GROUP BY 1),
held AS (SELECT doc_id, list(DISTINCT CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
 sha256(coalesce(array_to_string(list_sort(ids), ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN held h ON h.doc_id = d.doc_id"""


def op4_sql() -> str:
    return f"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))) END) AS gram FROM docs),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
edges AS (SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * s.n >= 90 * (x.n + y.n - s.n)),
reach AS (SELECT doc_id AS id, doc_id AS r FROM docs UNION SELECT reach.id, edges.b FROM reach JOIN edges ON edges.a = reach.r),
least_id AS (SELECT id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM docs LEFT JOIN sizes USING (doc_id) JOIN least_id ON id = doc_id"""


def op9_sql() -> str:
    return """
WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(range(0, len(ls))) AS line_no, unnest(ls) AS line FROM cut),
worded AS (SELECT doc_id, line_no, line, list_filter(list_distinct(string_split(lower(line), ' ')), lambda x: x <> '') AS w FROM lines),
classes AS (SELECT dense_rank() OVER (ORDER BY list_sort(w)) AS k, * FROM worded WHERE len(w) > 0),
sets AS (SELECT k, any_value(w) AS w, min(doc_id * 1000000 + line_no) AS first FROM classes GROUP BY k),
tokens AS (SELECT k, len(w) AS n, unnest(w) AS x FROM sets),
met AS (SELECT a.k AS a, b.k AS b, a.n AS n, b.n AS m, count(*) AS s FROM tokens a JOIN tokens b ON a.x = b.x AND a.k <> b.k AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n GROUP BY 1, 2, 3, 4),
near AS (SELECT a AS k, min(first) AS near FROM met JOIN sets ON sets.k = b WHERE 5 * s >= 4 * (n + m - s) GROUP BY 1),
gone AS (SELECT doc_id, line_no FROM classes c JOIN sets USING (k) LEFT JOIN near USING (k) WHERE doc_id * 1000000 + line_no > least(sets.first, coalesce(near, sets.first))),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.line_no) AS text, count(*) AS n FROM lines l ANTI JOIN gone g ON g.doc_id = l.doc_id AND g.line_no = l.line_no GROUP BY 1)
SELECT c.doc_id, coalesce(kept.text, '') AS text, CAST(len(ls) AS INTEGER) AS n_lines, CAST(len(ls) - coalesce(kept.n, 0) AS INTEGER) AS n_removed FROM cut c LEFT JOIN kept ON kept.doc_id = c.doc_id"""


def op11_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    assigned = lambda book: f"""
SELECT vec_id, p, arg_min(e, (far, e)) AS e, min(far) AS far FROM (
 SELECT c.vec_id, c.p, b.e, sum((c.x - b.x) * (c.x - b.x)) AS far FROM cells c JOIN {book} b ON b.p = c.p AND b.s = c.s GROUP BY 1, 2, 3) GROUP BY 1, 2"""  # noqa: E731
    steps = "".join(f"""
code{r} AS MATERIALIZED ({assigned(f"book{r}")}),
mean{r} AS (SELECT c.p, a.e, c.s, sum(c.x) AS t, count(*) AS n FROM cells c JOIN code{r} a ON a.vec_id = c.vec_id AND a.p = c.p GROUP BY 1, 2, 3),
book{r + 1} AS MATERIALIZED (SELECT b.p, b.e, b.s, coalesce((t - ((t % n + n) % n)) // n, b.x) AS x FROM book{r} b LEFT JOIN mean{r} m ON m.p = b.p AND m.e = b.e AND m.s = b.s),"""
        for r in range(rounds))
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v
 FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
places AS (SELECT vec_id, len(v) // {parts} AS width, unnest(range(0, len(v))) AS pos, unnest(v) AS x FROM kept),
cells AS MATERIALIZED (SELECT vec_id, pos // width AS p, pos % width AS s, x FROM places),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {entries}),
book0 AS MATERIALIZED (SELECT p, e, s, x FROM cells JOIN seeds USING (vec_id)),{steps}
told AS MATERIALIZED ({assigned(f"book{rounds}")}),
rows AS (SELECT vec_id, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM told GROUP BY 1),
sha AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, s)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM rows JOIN kept USING (vec_id), sha"""


def op12_sql(length: int = 100) -> str:
    return f"""
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
cut AS (SELECT doc_id, b, substr(h, 2 * b + 1, 2 * (999 + {length})) AS h FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2, 1000)) AS b FROM docs)),
starts AS (SELECT doc_id, b, h, unnest(range(0, least(1000, len(h) // 2 - {length - 1}))) AS s FROM cut),
marked AS (SELECT doc_id, s FROM (SELECT doc_id, b + s AS s, row_number() OVER (PARTITION BY substr(h, 2 * s + 1, {2 * length}) ORDER BY doc_id, b + s) AS r FROM starts) WHERE r > 1),
begun AS (SELECT doc_id, s, coalesce(s > lag(s) OVER w + {length}, true) AS new FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY s)),
numbered AS (SELECT doc_id, s, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM begun),
spans AS (SELECT doc_id, k, min(s) AS lo, max(s) + {length} AS hi FROM numbered GROUP BY 1, 2),
between_ AS (SELECT doc_id, lo AS until, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS since FROM spans
 UNION ALL SELECT doc_id, len(h) // 2, coalesce((SELECT max(hi) FROM spans x WHERE x.doc_id = d.doc_id), 0) FROM docs d),
left_ AS (SELECT b.doc_id, string_agg(substr(h, 2 * since + 1, 2 * (until - since)), '' ORDER BY since, until) AS h FROM between_ b JOIN docs USING (doc_id) GROUP BY 1),
told AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM spans GROUP BY 1)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(left_.h)) AS kept_sha256
FROM docs d JOIN left_ USING (doc_id) LEFT JOIN told USING (doc_id)"""


#: CRC-32 of an ASCII string, bit by bit.
CRC32 = """xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({}, ''), lambda c: CAST(unicode(c) AS UBIGINT))),
 lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, o: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)))"""


def op13_sql() -> str:
    crc = CRC32.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")
    blanks = r"[\x20\x09-\x0D]*"
    return f"""
WITH RECURSIVE hit AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, CAST({crc} % 20 AS INTEGER) AS kind FROM conversations),
damaged AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
 unnest(range(0, CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hit WHERE kind <> 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
rows AS MATERIALIZED (SELECT conv_id, turn, i, role, text, role[1:1] AS own, CASE WHEN regexp_full_match(text, '{blanks}') THEN 'b'
  WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?]{blanks}$') THEN 't' ELSE '' END AS fault FROM ranked),
convs AS (SELECT conv_id, count(i) AS n FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN rows USING (conv_id) GROUP BY 1),
moves(state, initial, next, role) AS (VALUES (0, 's', 1, NULL), (0, 'u', 2, 'user'), (1, 'u', 2, 'user'), (2, 'a', 3, 'assistant'), (3, 'u', 2, 'user')),
grow(state, next, cost, audit, lines) AS (SELECT s, s, 0, '', [] FROM range(4) t(s)
 UNION ALL SELECT m.state, m.next, 3, 'I', [m.role || ':'] FROM moves m WHERE role IS NOT NULL
 UNION ALL SELECT m.state, o.next, 6, 'II', [m.role || ':', o.role || ':'] FROM moves m JOIN moves o ON o.state = m.next AND m.role IS NOT NULL AND o.role IS NOT NULL),
paths AS (
 SELECT conv_id, 0 AS i, g.next AS state, CAST({{'cost': g.cost, 'audit': g.audit, 'lines': g.lines}} AS STRUCT(cost INTEGER, audit VARCHAR, lines VARCHAR[])) AS best FROM convs, grow g WHERE g.state = 0
 UNION ALL
 SELECT conv_id, i, state, min(best) FROM (
  SELECT e.conv_id, e.i, g.next AS state, CAST({{'cost': e.cost + g.cost, 'audit': e.audit || g.audit, 'lines': e.lines || g.lines}} AS STRUCT(cost INTEGER, audit VARCHAR, lines VARCHAR[])) AS best FROM (
   SELECT p.conv_id, r.i, p.state, p.best.cost + 4 AS cost, p.best.audit || 'D' AS audit, p.best.lines AS lines FROM paths p JOIN rows r ON r.conv_id = p.conv_id AND r.i = p.i + 1
   UNION ALL SELECT p.conv_id, r.i, m.next, p.best.cost + CASE fault WHEN 't' THEN 3 ELSE 0 END, p.best.audit || 'K', p.best.lines || [r.role || ':' || r.text]
    FROM paths p JOIN rows r ON r.conv_id = p.conv_id AND r.i = p.i + 1 AND fault NOT IN ('b', 'd') JOIN moves m ON m.state = p.state AND m.initial = r.own
   UNION ALL SELECT p.conv_id, r.i, m.next, p.best.cost + 3 + CASE fault WHEN 't' THEN 3 ELSE 0 END, p.best.audit || 'R', p.best.lines || [m.role || ':' || r.text]
    FROM paths p JOIN rows r ON r.conv_id = p.conv_id AND r.i = p.i + 1 AND fault NOT IN ('b', 'd') JOIN moves m ON m.state = p.state AND m.role IS NOT NULL) e
  JOIN grow g ON g.state = e.state) GROUP BY ALL),
ended AS (SELECT c.conv_id, min(p.best) AS best FROM convs c JOIN paths p ON p.conv_id = c.conv_id AND p.i = c.n AND p.state IN (0, 3) GROUP BY 1),
pairs AS (SELECT conv_id, own || lead(own) OVER (PARTITION BY conv_id ORDER BY i) AS pair FROM rows),
illegal AS (SELECT conv_id, count(*) AS illegal FROM pairs WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au') GROUP BY 1),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated FROM rows GROUP BY 1)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 CAST(e.best.cost AS BIGINT) AS cost, e.best.audit AS audit, sha256(array_to_string(e.best.lines, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN counts c ON c.conv_id = e.conv_id LEFT JOIN illegal g ON g.conv_id = e.conv_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": op2_sql(), "op3_url_filter": op3_sql(), "op4_ngram_join": op4_sql(), "op9_line_dedup": op9_sql(),
        "op11_vector_codes": op11_sql(), "op12_suffix_dedup": op12_sql(), "op13_conversation_repair": op13_sql(),
    }
