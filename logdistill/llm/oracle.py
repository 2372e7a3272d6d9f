"""What the queries must return, as DuckDB SQL, where SQL can say it."""

from __future__ import annotations

# Fixed values, written on their own: the words and thresholds of the quality rules.
_STOP = (
    "the of and to in a is that it for on was be with as are from by at this have or not he his "
    "der die das und ist den von zu mit dem ein eine nicht im auch auf sich des "
    "de la le les et en un une du que est pour dans qui par sur au ne se pas "
    "el los las y es por con una del al lo como para su"
).split()
_IN_STOP = ", ".join(f"'{w}'" for w in _STOP)
_WORD = r"[^\x20\x09-\x0D]+"

SQL: dict[str, str] = {}

SQL["op6_quality_rules"] = rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '{_WORD}')) AS ls
  FROM documents),
win AS (
  SELECT r, i, array_to_string(ws[i:i+7], ' ') AS win
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (
  SELECT r, i FROM win JOIN (SELECT r, win FROM win GROUP BY ALL HAVING count(*) > 1) USING (r, win)),
rep AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY r),
m AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
         len(ls) AS n_lines,
         len(list_filter(ws, lambda x: lower(x) IN ({_IN_STOP}))) AS n_stop_words
  FROM w LEFT JOIN rep USING (r)),
b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    list_filter([
      CASE WHEN n_words > 0 AND (word_chars / n_words < 2.5 OR word_chars / n_words > 12) THEN 'word_length' END,
      CASE WHEN n_words > 0 AND n_symbols / n_words > 0.1::DOUBLE THEN 'symbols' END,
      CASE WHEN n_words > 0 AND n_stop_words / n_words < 0.04::DOUBLE THEN 'stop_words' END,
      CASE WHEN n_lines > 0 AND n_dup_lines / n_lines > 0.5::DOUBLE THEN 'duplicate_lines' END,
      CASE WHEN n_lines > 0 AND n_words / n_lines < 1.5::DOUBLE THEN 'line_length' END
    ], lambda x: x IS NOT NULL) AS broken
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words,
       base_failed, NOT base_failed AND len(broken) = 0 AS kept,
       array_to_string(broken, ',') AS broken_rules
FROM b
"""

# Fixed values, written on their own: the kinds of secrets, in order.
_ASSIGN = (
    """(password|passwd|secret|token|api_?key)["\\']?\\x20*[:=]\\x20*["\\']?([A-Za-z0-9+/_.=-]+)"""
)
for _w in ("password", "passwd", "secret", "token", "api", "key"):
    _ASSIGN = _ASSIGN.replace(_w, "".join(f"[{c.upper()}{c}]" for c in _w), 1)
_ASSIGN = _ASSIGN.replace("\\'", "''")
_SECRETS = (
    ("assign", _ASSIGN, 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("github", "gh[pousr]_[A-Za-z0-9]{36}", 0, 0),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("google", "AIza[A-Za-z0-9_-]{35}", 0, 0),
    ("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+", 0, 0),
    ("stripe", "[rs]k_live_[A-Za-z0-9]{16,}", 0, 0),
)
_FOUND = " UNION ALL ".join(
    f"""
  SELECT r, {i} AS rank, '{kind}' AS kind, start, start + length(m) AS stop, held
  FROM (SELECT r, unnest(ms) AS m, unnest(hs) AS held,
               unnest(list_transform(range(1, len(ms) + 1), lambda k:
                 list_sum(list_transform(gaps[1:k], lambda g: length(g))) +
                 coalesce(list_sum(list_transform(ms[1:k - 1], lambda g: length(g))), 0))) AS start
        FROM (SELECT r, regexp_extract_all(text, '{pattern}') AS ms,
                     regexp_extract_all(text, '{pattern}', {group}) AS hs,
                     string_split_regex(text, '{pattern}') AS gaps FROM d
              WHERE regexp_matches(text, '{pattern}')))
  WHERE length(held) >= {least}"""
    for i, (kind, pattern, group, least) in enumerate(_SECRETS)
)

SQL["op8_secret_scan"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({_FOUND}),
a AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank)
           FILTER (rank < 3) AS base,
         string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank) AS spans
  FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)
"""

_RULES = [  # fixed values, written on their own
    ("allow", "org", "/", "org/"),
    ("block", "example.org", "/es/", "example.org/es/"),
    ("block", "example.org", "/en/1", "example.org/en/1"),
    ("allow", "com", "/fr/", "com/fr/"),
    ("block", "com", "/de/", "com/de/"),
]
_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}', '{r}')" for v, h, p, r in _RULES)

# No page of the given tables declares a redirect or a canonical address, so the
# rules alone decide; tests/llm checks the equivalences against brute force.
SQL["op1_url_filter"] = rf"""
WITH rules(verdict, h, p, rule) AS (VALUES {_RULE_ROWS}),
u AS (SELECT row_number() OVER () AS r, page_id,
        regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', ['h', 'p']) AS x FROM pages),
v AS (SELECT r, page_id,
        coalesce(translate(x.h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(x.p, '') AS path FROM u),
best AS (
  SELECT r, arg_max(struct_pack(verdict := verdict, rule := rule), length(rule) * 2 + (verdict = 'allow')::INT) AS b
  FROM v JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict, false AS by_alias
FROM v LEFT JOIN best USING (r)
"""

_B32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, {1 + 5 * i}, 5))::INTEGER >> {s}) & 31) + 1, 1)"
    for i in range(8)
    for s in (15, 10, 5, 0)
)
SQL["op10_warc_archive"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT html, min(page_id) AS first_id FROM p GROUP BY html)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_B32} AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p JOIN f USING (html)
"""

SQL["op9_repeated_passages"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w
           FROM documents),
x AS (SELECT r, doc_id, i, array_to_string(w[i:i+12], ' ') AS win
      FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT win, min(doc_id) AS lo FROM x GROUP BY win HAVING count(*) > 1),
g AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM x JOIN f USING (win)
      WHERE lo < doc_id OR (doc_id IS NULL AND lo IS NOT NULL)),
a AS (SELECT r, list(p) AS ps FROM g GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed,
       sha256(array_to_string(
         CASE WHEN ps IS NULL THEN w
              ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN a USING (r)
"""


def _crc32(codes: str) -> str:
    """SQL for the CRC-32 of a list of byte values, bit by bit."""
    met = f"(CASE WHEN k % 8 = 0 THEN xor(c, {codes}[1 + k // 8]) ELSE c END)"
    step = f"CASE WHEN {met} & 1 = 1 THEN xor({met} >> 1, 3988292384) ELSE {met} >> 1 END"
    steps = f"list_prepend(4294967295, range(8 * len({codes})))"
    return f"xor(list_reduce({steps}, lambda c, k: {step}), 4294967295)"


SQL["op11_spelling_variants"] = rf"""
WITH RECURSIVE r AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS k FROM r WHERE length(run) >= 7 GROUP BY ALL),
b AS (SELECT *, flatten(list_transform(string_split(doc_id || ':' || run, ''),
        lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [195::BIGINT, ord(x)::BIGINT - 64] END)) AS codes FROM g),
h AS (SELECT run, k, {_crc32("codes")} AS h, length(run) AS m FROM b),
t AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % m) || substr(run, h % m + 2) ELSE run END AS word, k FROM h),
v AS (SELECT word, sum(k)::BIGINT AS n FROM t WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS gap
      FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
e AS (
  SELECT a.word, b.word AS other, b.n FROM d a JOIN d b ON a.gap = b.gap AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.gap = v.word
  UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.gap = v.word),
near AS (SELECT word, count(*) AS n_near, min(struct_pack(n := -n, other := other)) AS best FROM e GROUP BY word),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near,
        CASE WHEN -best.n >= 10 * n THEN best.other END AS form, CASE WHEN -best.n >= 10 * n THEN -best.n END AS form_n
      FROM v LEFT JOIN near USING (word)),
way AS (SELECT word, word AS root, form AS ahead FROM f
        UNION ALL SELECT way.word, f.word, f.form FROM way JOIN f ON f.word = way.ahead)
SELECT word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, root FROM way WHERE ahead IS NULL) USING (word)
"""

SQL["op12_minhash_dedup"] = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 2], ' ') AS sh
      FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1))) AS i FROM d)),
n AS (SELECT r, count(*) AS size FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.r < b.r GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * c >= 85 * (a.size + b.size - c)),
both_ways AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT r AS x, r AS y FROM d UNION SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON reach.y = both_ways.x),
c AS (SELECT x AS r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.y GROUP BY x)
SELECT doc_id, coalesce(size, 0)::BIGINT AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM d LEFT JOIN n USING (r) JOIN c USING (r)
"""

# A run has 16 words or more that equal those a period later, so it holds a window
# of 16 words that comes again after a period.
SQL["op13_periodic_runs"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
             list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT) AS codes FROM documents),
h AS (SELECT r, doc_id, w, len(w) AS n, {_crc32("codes")} AS h FROM d),
a AS (SELECT *, (h // 10) % n AS a, (h // 10) % 8 AS e FROM h),
o AS (SELECT r, doc_id, n,
        CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i:
          w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + e)) END]) ELSE w END AS w FROM a),
x AS (SELECT r, n, i, md5(array_to_string(w[i + 1:i + 16], ' ')) AS win
      FROM (SELECT r, n, w, unnest(range(n - 15)) AS i FROM o)),
m AS (SELECT r, b.i - c.i AS q, c.i AS i FROM x c JOIN x b USING (r, win) WHERE b.i > c.i AND 3 * (b.i - c.i) <= c.n),
y AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM m),
t AS (SELECT r, q, min(i) AS start, max(i) - min(i) + 16 + q AS length FROM y GROUP BY r, q, g),
u AS (SELECT r, start, length, min(q) AS period FROM t WHERE length >= greatest(24, 3 * q) GROUP BY r, start, length),
best AS (SELECT r, start, length, period FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY length / period DESC, start, period) AS k FROM u) WHERE k = 1),
z AS (SELECT r, count(*) AS n_runs,
        string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM u GROUP BY r),
gone AS (SELECT r, list(DISTINCT i) AS gone FROM (SELECT r, unnest(range(start + period, start + length)) AS i FROM u) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w
         ELSE list_filter(w, lambda v, i: NOT list_contains(gone, i - 1)) END, ' ')) AS collapsed_sha256
FROM o LEFT JOIN best USING (r) LEFT JOIN z USING (r) LEFT JOIN gone USING (r)
"""
