"""The registered queries in plain SQL, for DuckDB over the same tables."""

from __future__ import annotations

from ..functions.stem import STEP_2, STEP_3, STEP_4
from ..operators.search import Expr, Phrase, _leaves
from . import inputs, queries

NL = "chr(10)"
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(8195) || chr(8232) || chr(12288)"
SQL: dict[str, str] = {}


def ctes(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(p.strip() for p in parts if p.strip()) + "\n"


def strip(x: str) -> str:
    return f"trim({x}, {SPACES})"


def split(x: str) -> str:
    body = f"CASE WHEN ends_with({x}, {NL}) THEN left({x}, length({x}) - 1) ELSE {x} END"
    return f"string_split({body}, {NL})"


DOCS = """src AS (SELECT doc_id AS id, source AS session_id, lang AS entry_type,
    CAST(doc_id AS DOUBLE) AS ts, text AS raw FROM documents)"""
LOGS = f"""src AS (SELECT o_orderkey AS id, 'cust-' || CAST(o_custkey AS STRING) AS session_id,
    CAST(o_orderkey * 10 AS DOUBLE) AS ts, {inputs.KIND} AS kind,
    {inputs.log_text('duckdb')} AS raw, {inputs.NEEDLE} AS needle FROM orders)"""
SESSIONS = """sess AS (SELECT 'cust-' || CAST(c_custkey AS STRING) AS session_id,
    'run ' || chr(27) || '[1m' || c_name || ' --segment ' || c_mktsegment || ' --all' AS agent_command,
    CAST(c_custkey % 97 * 1000 AS DOUBLE) AS started_at,
    CASE WHEN c_nationkey < 20 THEN CAST(c_custkey % 97 * 1000 + 60 AS DOUBLE) END AS ended_at
    FROM customer)"""


def order_text(expr: str) -> str:
    return f"src AS (SELECT o_orderkey AS id, {expr} AS raw FROM orders)"


def lines(src: str = "src", text: str = "raw", out: str = "ln") -> str:
    return f"""{out} AS (SELECT id, unnest(range(0, len(p))) AS pos, unnest(p) AS line
    FROM (SELECT id, {split(text)} AS p FROM {src} WHERE {text} <> ''))"""


def clean(src: str = "src") -> str:
    ansi = r"chr(27) || '\[[0-9;]*[mGKHFJA-Z]'"
    return f"cl AS (SELECT *, regexp_replace(raw, {ansi}, '', 'g') AS t FROM {src})"


HEADER = r"'^\s*Traceback \(most recent call last\):'"
FRAME = r"""'^\s+File "([^"]+)", line (\d+), in (.+)$'"""
RUST = r"'^error\[E\d+\]:'"
GCC = r"'^\S+\.(c|cpp|cc|cxx|h|hpp):\d+:\d+: (error|warning|note):'"


def multi(pattern: str) -> str:
    return pattern.replace("'^", "'(?m)^", 1)


# --- floods: part tables (id, part, pos, line) -> (id, part, table) ---------------
def flood(src: str, share: str = "0.6", out: str = "fl") -> str:
    shown = "CASE WHEN length(line) > 120 THEN left(line, 120) || '…' ELSE line END"
    return f"""{out}_c AS (SELECT id, part, line, count(*) AS n, min(pos) AS first_pos FROM (
        SELECT id, part, pos, {strip('line')} AS line FROM {src}) WHERE line <> '' GROUP BY ALL),
    {out}_s AS (SELECT id, part, sum(n) AS total, count(*) AS uniq, max(n) AS top
        FROM {out}_c GROUP BY ALL),
    {out}_r AS (SELECT *, row_number() OVER (PARTITION BY id, part ORDER BY n DESC, first_pos) AS r
        FROM {out}_c),
    {out} AS (SELECT s.id, s.part, '[Repetitive output: ' || any_value(total) || ' total line(s), '
        || any_value(uniq) || ' unique]' || {NL} || string_agg('  × ' || printf('%5d', n) || '  ' ||
        {shown}, {NL} ORDER BY r) || CASE WHEN any_value(uniq) > 8 THEN {NL} || '  … and ' ||
        (any_value(uniq) - 8) || ' more unique line(s)' ELSE '' END AS summary
        FROM {out}_s s JOIN {out}_r r ON s.id = r.id AND s.part = r.part AND r <= 8
        WHERE total >= 10 AND top / total >= {share} GROUP BY s.id, s.part)"""


# --- tracebacks: needs tl(id, pos, line) --------------------------------------------
BLOCKS = rf"""th AS (SELECT *, regexp_matches(line, {HEADER}) AS h, regexp_matches(line, {FRAME}) AS f
        FROM tl),
    tb AS (SELECT *, sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) AS blk
        FROM th),
    te AS (SELECT id, blk, min(pos) AS e, arg_min({strip('line')}, pos) AS exc FROM tb
        WHERE blk > 0 AND NOT h AND NOT f AND line <> '' AND left(line, 1) NOT IN (' ', chr(9))
        GROUP BY ALL),
    t0 AS (SELECT id, blk, min(pos) AS s FROM tb WHERE h GROUP BY ALL),
    tf AS (SELECT tb.id, tb.blk, pos,
        regexp_replace(line, {FRAME}, '\1:\2 in \3') AS frame FROM tb
        LEFT JOIN te USING (id, blk) WHERE f AND tb.blk > 0 AND (e IS NULL OR pos < e)),
    tg AS (SELECT *, regexp_matches(frame, 'site-packages|/lib/python|<frozen|/lib64/python|distlib')
        AS lib FROM tf),
    tk AS (SELECT *, row_number() OVER (PARTITION BY id, blk ORDER BY pos DESC) AS r FROM (
        SELECT *, bool_and(lib) OVER (PARTITION BY id, blk) AS all_lib FROM tg)
        WHERE all_lib OR NOT lib),
    tn AS (SELECT id, blk, string_agg('  at ' || frame, {NL} ORDER BY pos) AS shown,
        string_agg(frame, '|' ORDER BY pos) AS kept FROM tk WHERE r <= 3 GROUP BY ALL),
    tc AS (SELECT id, blk, count(*) AS n FROM tf GROUP BY ALL),
    bl AS (SELECT t0.id, t0.blk, count(*) OVER (PARTITION BY t0.id) AS total, s, e,
        coalesce(exc, '') AS exc, coalesce(shown, '') AS shown, coalesce(kept, '') AS kept,
        coalesce(n, 0) AS n_frames FROM t0 LEFT JOIN te USING (id, blk)
        LEFT JOIN tn USING (id, blk) LEFT JOIN tc USING (id, blk)),
    ed AS (SELECT id, min(s) AS lo, max(e) AS hi FROM bl GROUP BY id),
    cx AS (SELECT id, 'pre' AS part, pos, line FROM tl JOIN ed USING (id) WHERE pos < lo
        UNION ALL SELECT id, 'post', pos, line FROM tl JOIN ed USING (id) WHERE pos > hi),
    {flood('cx', out='cf')},
    cj AS (SELECT id, part, {strip(f"string_agg(line, {NL} ORDER BY pos)")} AS body FROM cx GROUP BY ALL),
    ct AS (SELECT cj.id, cj.part, coalesce(cf.summary, cj.body) AS body FROM cj
        LEFT JOIN cf ON cj.id = cf.id AND cj.part = cf.part),
    cp AS (SELECT ed.id, coalesce(max(body) FILTER (part = 'pre'), '') AS preamble,
        coalesce(max(body) FILTER (part = 'post'), '') AS postamble
        FROM ed LEFT JOIN ct USING (id) GROUP BY ed.id),
    bt AS (SELECT id, string_agg(CASE WHEN total > 1 THEN '── Traceback ' || blk || '/' || total || ' ──'
        ELSE '── Traceback ──' END || {NL} || shown || {NL} || '  ↳ ' || exc, {NL} || {NL} ORDER BY blk) AS body
        FROM bl GROUP BY id),
    ts AS (SELECT id, CASE WHEN preamble <> '' THEN preamble || {NL} || {NL} ELSE '' END || body ||
        CASE WHEN postamble <> '' THEN {NL} || {NL} || postamble ELSE '' END AS summary
        FROM bt JOIN cp USING (id))"""

# --- compiler walls: need rl / gl (id, pos, line) -------------------------------------
RUST_WALL = rf"""re AS (SELECT id, pos, line, split_part(line, ':', 1) AS code FROM rl
        WHERE regexp_matches(line, {RUST})),
    ru AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS r FROM (
        SELECT id, code, min(pos) AS pos, arg_min(line, pos) AS line FROM re GROUP BY id, code)),
    rw AS (SELECT id, count(*) FILTER (starts_with(line, 'warning[')) AS w,
        count(*) FILTER (regexp_matches(line, {RUST})) AS n FROM rl GROUP BY id),
    rs AS (SELECT id, '[Rust build: ' || n || ' error(s), ' || w || ' warning(s) → ' || u ||
        ' unique error(s)]' || coalesce({NL} || body, '') || CASE WHEN u > 30 THEN {NL} || '  … and ' || (u - 30) ||
        ' more unique error(s)' ELSE '' END AS summary FROM rw JOIN (
        SELECT id, count(*) AS u, string_agg('  ' || line, {NL} ORDER BY r) FILTER (r <= 30) AS body
        FROM ru GROUP BY id) USING (id))"""
GCC_WALL = rf"""gd AS (SELECT id, pos, line FROM gl WHERE regexp_matches(line, {GCC})),
    gu AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS r FROM (
        SELECT id, line, min(pos) AS pos FROM gd GROUP BY id, line)),
    gs AS (SELECT id, '[C/C++ build: ' || e || ' error(s), ' || w || ' warning(s) → ' || u ||
        ' unique diagnostic(s)]' || {NL} || body || CASE WHEN u > 15 THEN {NL} || '  … and ' || (u - 15) ||
        ' more' ELSE '' END AS summary
        FROM (SELECT id, count(*) FILTER (contains(line, ': error:')) AS e,
            count(*) FILTER (contains(line, ': warning:')) AS w FROM gd GROUP BY id)
        JOIN (SELECT id, count(*) AS u, string_agg('  ' || line, {NL} ORDER BY r) FILTER (r <= 15) AS body
            FROM gu GROUP BY id) USING (id))"""

# --- all kinds: needs src(id, raw) -> sm(id, summary) -----------------------------------
SUMMARY = rf"""{clean()},
    kd AS (SELECT *, CASE WHEN regexp_matches(t, {multi(HEADER).replace('s*', '[ ]*', 1).replace(chr(92) + '[ ]*', '[ ]*')}) THEN 'traceback'
        WHEN regexp_matches(t, {multi(RUST)}) THEN 'rust' WHEN regexp_matches(t, {multi(GCC)}) THEN 'gcc'
        ELSE 'other' END AS k FROM cl),
    {lines('kd', 't')},
    kl AS (SELECT ln.*, k FROM ln JOIN (SELECT id, k FROM kd) USING (id)),
    wl AS (SELECT id, 'whole' AS part, pos, line FROM kl WHERE k = 'other'),
    {flood('wl')},
    tl AS (SELECT id, pos, line FROM kl WHERE k = 'traceback'),
    {BLOCKS},
    rl AS (SELECT id, pos, line FROM kl WHERE k = 'rust'),
    {RUST_WALL},
    gl AS (SELECT id, pos, line FROM kl WHERE k = 'gcc'),
    {GCC_WALL},
    sm AS (SELECT id, summary FROM fl UNION ALL SELECT id, summary FROM ts
        UNION ALL SELECT id, summary FROM rs UNION ALL SELECT id, summary FROM gs)"""


TOKENS_IN = ("[Y/n]", "[y/N]", "[Y/N]", "[yes/no]", "(y/n)", "(yes/no)", "? ")


def asks(tail: str) -> str:
    return "(" + " OR ".join(f"contains({tail}, '{t}')" for t in TOKENS_IN) + ")"


def is_prompt(x: str) -> str:
    r = f"rtrim({x}, {SPACES})"
    return (
        f"((right({r}, 1) IN ('?', ':', '>') AND length(string_split({r}, {NL})[-1]) <= 120) "
        f"OR {asks(f'right({x}, 200)')})"
    )


def pruned(min_lines: int = 30) -> str:
    return f"""{SUMMARY},
    lc AS (SELECT id, count(*) AS line_count FROM {{lines}} GROUP BY id),
    pr AS (SELECT src.*, coalesce(line_count, 0) AS line_count, length(raw) // 4 AS token_estimate,
        sm.summary AS any_summary, CASE WHEN coalesce(line_count, 0) >= {min_lines} AND NOT {is_prompt('raw')}
        AND length(sm.summary) <= 0.75 * length(raw) THEN sm.summary END AS summary
        FROM src LEFT JOIN lc USING (id) LEFT JOIN sm USING (id)),
    p AS (SELECT *, summary IS NOT NULL AS was_pruned, coalesce(summary, '') AS compressed_summary,
        CASE WHEN summary IS NULL THEN 0 ELSE greatest(0, (length(raw) - length(summary)) // 4) END
        AS net_tokens_saved FROM pr)""".replace("{lines}", "ln")


LOGS_PRUNED = ctes(LOGS, pruned())
DOCS_PRUNED = ctes(DOCS, pruned())


# --- lines and floods ---------------------------------------------------------------------
SQL["line_table"] = ctes(DOCS, lines()) + "SELECT id, pos, line FROM ln"
SQL["line_counts"] = ctes(DOCS, lines()) + """SELECT src.id, count(line) AS line_count
    FROM src LEFT JOIN ln USING (id) GROUP BY src.id"""
SQL["token_estimates"] = """SELECT doc_id AS id, length(text) // 4 AS tokens,
    greatest(1, length(text) // 4) AS tokens_floor_1 FROM documents"""
DOC_PARTS = f"{lines()}, wl AS (SELECT id, 'whole' AS part, pos, line FROM ln)"
SQL["line_frequency"] = ctes(DOCS, lines()) + f"""SELECT id, line, count(*) AS n, min(pos) AS first_pos FROM (
    SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS pos, line FROM (
    SELECT id, pos, {strip('line')} AS line FROM ln) WHERE line <> '') GROUP BY id, line"""
SQL["top_lines"] = ctes(DOCS, DOC_PARTS, flood("wl")) + """SELECT id, line, n, r AS rank FROM fl_r WHERE r <= 8"""
SQL["first_seen_lines"] = ctes(DOCS, lines()) + """SELECT id, line,
    row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS ord FROM (
    SELECT id, line, min(pos) AS pos FROM ln GROUP BY id, line)"""
SQL["flood_flag"] = ctes(DOCS, DOC_PARTS, flood("wl")) + """SELECT src.id,
    coalesce(total >= 10 AND top / total >= 0.6, false) AS repetitive,
    coalesce(total >= 10 AND top / total >= 0.3, false) AS repetitive_at_30
    FROM src LEFT JOIN fl_s USING (id)"""
SQL["flood_summary"] = ctes(DOCS, DOC_PARTS, flood("wl"), flood("wl", "0.3", "fm")) + """SELECT src.id,
    fl.summary, fm.summary AS summary_at_30 FROM src LEFT JOIN fl USING (id) LEFT JOIN fm USING (id)"""
SQL["flood_log_summary"] = ctes(order_text(inputs.flood("duckdb")), DOC_PARTS, flood("wl")) + """SELECT src.id,
    fl.summary FROM src LEFT JOIN fl USING (id)"""

# --- gates and escapes ------------------------------------------------------------------------
SQL["prompt_flag"] = ctes(LOGS) + f"""SELECT 'page' AS origin, page_id AS id, {is_prompt('html')} AS is_prompt,
    {asks('right(html, 200)')} AS tail_is_prompt FROM pages
    UNION ALL SELECT 'log', id, {is_prompt('raw')}, {asks('right(raw, 200)')} FROM src"""
SQL["small_output_gate"] = ctes(DOCS, lines()) + """SELECT src.id, count(line) AS line_count
    FROM src LEFT JOIN ln USING (id) GROUP BY src.id HAVING count(line) < 30"""
SQL["ansi_stripped"] = ctes(order_text(inputs.ANSI), clean()) + "SELECT id, t AS clean FROM cl"
SQL["sanitized"] = ctes(order_text(inputs.ANSI)) + r"""SELECT id, regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(raw, '\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)', '', 'g'), '\x1b\[[0-9;?]*[ -/]*[@-~]', '', 'g'),
    '\x1b[@-Z\\-_]', '', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g') AS clean FROM src"""
SQL["decoded_output"] = """WITH h AS (SELECT doc_id AS id, text, hex(encode(text)) AS x, strlen(text) // 2 AS n
        FROM documents),
    c AS (SELECT *, substr(x, 2 * n + 1, 1) IN ('8', '9', 'A', 'B') AS broken FROM h),
    b AS (SELECT id, array_to_string(list_transform(regexp_extract_all(left(x, 2 * n), '..'), lambda y:
        chr(CAST(16 * instr('123456789ABCDEF', left(y, 1)) + instr('123456789ABCDEF', right(y, 1)) AS INT))), '') AS latin
        FROM c WHERE broken)
    SELECT id, 'whole' AS part, text, strlen(text) AS n_bytes FROM c
    UNION ALL SELECT id, 'half', latin, n FROM c JOIN b USING (id)
    UNION ALL SELECT id, 'half', decode(unhex(left(x, 2 * n))), n FROM c WHERE NOT broken"""
SQL["class_gate"] = ctes(LOGS, SUMMARY) + """SELECT src.id, kind, CASE WHEN k <> 'other' THEN k
    WHEN fl.summary IS NOT NULL THEN 'flood' END AS class
    FROM src JOIN (SELECT id, k FROM kd) USING (id) LEFT JOIN fl USING (id)"""
SQL["incomplete_traceback"] = ctes(order_text(inputs.TRACEBACK), clean(), lines("cl", "t")) + f"""SELECT id,
    regexp_matches(last, {HEADER}) OR left(last, 1) IN (' ', chr(9)) AS incomplete FROM (
    SELECT id, arg_max(line, pos) AS last FROM ln WHERE {strip('line')} <> '' GROUP BY id)"""
SQL["command_routes"] = rf"""SELECT id, contains(script, ' eval ') AND contains(script, 'pwd -P >|') AS is_tool,
    regexp_matches(script, '(?:^|[\s/''"(;&|])arch[''"]?\s+(?:recall|search)([\s''"]|$)') AS is_reader,
    CASE WHEN regexp_matches(script, 'snapshot-(bash|zsh)-')
    THEN regexp_extract(script, 'snapshot-(bash|zsh)-', 1) ELSE '/bin/sh' END AS shell
    FROM (SELECT o_orderkey AS id, {inputs.SCRIPT} AS script FROM orders)"""

# --- summaries ------------------------------------------------------------------------------------
TB = (order_text(inputs.TRACEBACK), clean(), lines("cl", "t", "tl"), BLOCKS)
SQL["traceback_blocks"] = ctes(*TB) + """SELECT id, blk AS block_no, total AS n_blocks, s AS start_pos,
    e AS exception_pos, n_frames, kept, exc AS exception FROM bl"""
SQL["traceback_frames"] = ctes(*TB) + """SELECT id, blk AS block_no, frame, lib AS is_library,
    row_number() OVER (PARTITION BY id, blk ORDER BY pos) AS frame_no FROM tg"""
SQL["context_parts"] = ctes(*TB) + "SELECT id, preamble, postamble FROM cp"
SQL["traceback_summary"] = ctes(*TB) + "SELECT id, summary FROM ts"
SQL["rust_summary"] = ctes(order_text(inputs.rust("duckdb")), lines(out="rl"), RUST_WALL) + """SELECT id,
    summary FROM rs"""
SQL["gcc_summary"] = ctes(order_text(inputs.gcc("duckdb")), lines(out="gl"), GCC_WALL) + """SELECT id,
    summary FROM gs"""

# --- the prune chain ------------------------------------------------------------------------------
SQL["prune_pipeline"] = LOGS_PRUNED + """SELECT id, kind, compressed_summary, was_pruned, net_tokens_saved,
    line_count, token_estimate FROM p"""
SQL["prune_documents"] = ctes(DOCS, pruned(10)) + """SELECT id, compressed_summary, was_pruned,
    net_tokens_saved, token_estimate FROM p"""
SQL["python_pruner_chain"] = LOGS_PRUNED + f"""SELECT id, was_pruned OR chatty AS was_pruned,
    CASE WHEN was_pruned THEN 'output' WHEN chatty THEN 'ends' END AS pruner_name,
    CASE WHEN chatty THEN ends ELSE compressed_summary END AS compressed_summary FROM (
    SELECT *, line_count >= 30 AND starts_with(raw, 'step ') AND length(ends) <= 0.75 * length(raw)
    AND NOT was_pruned AS chatty FROM (SELECT *, split_part(raw, {NL}, 1) || {NL} || '...' || {NL} ||
    string_split(raw, {NL})[-1] AS ends FROM p))"""
SQL["prune_fail_open"] = LOGS_PRUNED + f"""SELECT id, was_pruned OR chatty AS was_pruned,
    CASE WHEN chatty THEN 'ends' WHEN was_pruned THEN 'output' END AS pruner_name,
    CASE WHEN chatty THEN ends ELSE compressed_summary END AS compressed_summary FROM (
    SELECT *, line_count >= 30 AND starts_with(raw, 'step ') AND length(ends) <= 0.75 * length(raw)
    AND id % 4 <> 0 AS chatty FROM (SELECT *, split_part(raw, {NL}, 1) || {NL} || '...' || {NL} ||
    string_split(raw, {NL})[-1] AS ends FROM p))"""
SQL["archive_cap"] = LOGS_PRUNED + """SELECT id, was_pruned, strlen(raw) AS n_bytes FROM p
    WHERE was_pruned OR strlen(raw) <= 1000"""
SQL["archive_cap_documents"] = DOCS_PRUNED + """SELECT id, was_pruned FROM p
    WHERE was_pruned OR strlen(raw) <= 65536"""
SQL["tokens_saved"] = LOGS_PRUNED + """SELECT kind, CAST(sum(net_tokens_saved) AS BIGINT) AS net_tokens_saved,
    CAST(sum(token_estimate) AS BIGINT) AS raw_tokens,
    CAST(sum(CASE WHEN was_pruned THEN 1 ELSE 0 END) AS BIGINT) AS pruned FROM p GROUP BY kind"""


def shown(dim: str, cyan: str, reset: str, recall: str) -> str:
    return f"""{dim} || '[{queries.TAG}] Compressed ' || line_count || ' lines → ' ||
    len(string_split(summary, {NL})) || ' lines  (' || {recall} || ')' || {reset} || {NL} ||
    {cyan} || summary || {reset} || {NL}"""


PLAIN = shown("''", "''", "''", f"'recall: {queries.TAG.lower()} #' || id")
SQL["injection_text"] = LOGS_PRUNED + f"""SELECT id, CASE WHEN was_pruned THEN {PLAIN} ELSE raw END AS shown
    FROM p"""
SQL["injection_hint"] = LOGS_PRUNED + f"""SELECT id, {shown("chr(27) || '[2m'", "chr(27) || '[36m'",
    "chr(27) || '[0m'", "'full log: arch recall --db a.db ' || id")} AS shown FROM p WHERE was_pruned"""

# --- the archive --------------------------------------------------------------------------------------
STATS = """st AS (SELECT sess.session_id, count(p.id) AS total_entries,
    coalesce(sum(CASE WHEN was_pruned THEN 1 END), 0)::BIGINT AS pruned_entries,
    coalesce(sum(token_estimate), 0)::BIGINT AS raw_tokens,
    coalesce(sum(CASE WHEN was_pruned THEN token_estimate END), 0)::BIGINT AS pruned_raw_tokens,
    coalesce(sum(net_tokens_saved), 0)::BIGINT AS net_tokens_saved
    FROM sess LEFT JOIN p USING (session_id) GROUP BY sess.session_id)"""
SQL["session_stats"] = ctes(LOGS, pruned(), SESSIONS, STATS) + """SELECT session_id, total_entries,
    pruned_entries, raw_tokens, pruned_raw_tokens FROM st"""
SQL["session_stats_stored"] = ctes(
    LOGS, pruned(), SESSIONS, STATS.replace("LEFT JOIN p USING", "LEFT JOIN (FROM p WHERE NOT contains(raw, 'CRITICAL')) p USING")
) + """SELECT session_id, total_entries,
    pruned_entries, raw_tokens, pruned_raw_tokens FROM st"""
SQL["session_cost"] = ctes(LOGS, pruned(), SESSIONS, STATS) + """SELECT session_id, total_entries AS chunks,
    pruned_entries AS pruned, net_tokens_saved, round(CASE WHEN pruned_raw_tokens > 0
    THEN net_tokens_saved / pruned_raw_tokens * 100 ELSE 0.0 END, 6) AS saved_pct,
    round(net_tokens_saved / 1000000 * 3.0, 6) AS saved_usd FROM st WHERE total_entries > 0"""
COUNTERS = f"""ctr AS (SELECT session_id, sum(strlen(raw))::BIGINT AS bytes_read,
    sum(CASE WHEN was_pruned THEN strlen({PLAIN}) ELSE 0 END)::BIGINT AS bytes_injected,
    sum(CASE WHEN was_pruned THEN 1 ELSE 0 END)::BIGINT AS pruner_hits,
    sum(net_tokens_saved)::BIGINT AS tokens_saved FROM p GROUP BY session_id)"""
SQL["pipeline_counters"] = ctes(LOGS, pruned(), COUNTERS) + "SELECT * FROM ctr"
SQL["live_compression"] = ctes(LOGS, pruned(), COUNTERS) + """SELECT session_id,
    round(tokens_saved / greatest(1, bytes_read // 4), 6) AS compression FROM ctr"""
SQL["list_sessions"] = ctes(SESSIONS) + """SELECT session_id, started_at FROM sess
    ORDER BY started_at DESC, session_id LIMIT 20"""
CLOCK = "strftime(TIMESTAMP '1970-01-01' + to_seconds(CAST(floor({}) AS BIGINT)), '%Y-%m-%d %H:%M:%S')"
SANE = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)',
    '', 'g'), '\x1b\[[0-9;?]*[ -/]*[@-~]', '', 'g'), '\x1b[@-Z\\-_]', '', 'g'),
    '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')"""
SQL["session_view"] = ctes(SESSIONS) + f"""SELECT session_id, {CLOCK.format('started_at')} AS started,
    left({SANE.format('agent_command')}, 40) AS command,
    CASE WHEN ended_at IS NOT NULL AND ended_at <> 0 THEN '✓' ELSE '…' END AS state FROM sess"""
SQL["recent_entries"] = ctes(DOCS) + """SELECT session_id, id, rank FROM (SELECT session_id, id, row_number() OVER (
    PARTITION BY session_id ORDER BY ts DESC, id DESC) AS rank FROM src) WHERE rank <= 5"""
SQL["recent_of_one_session"] = ctes(DOCS) + """SELECT session_id, id FROM src WHERE session_id = 'src7'
    ORDER BY ts DESC, id DESC LIMIT 50"""
TURNS = """turns AS (SELECT 'conv-' || CAST(conv_id AS STRING) AS session_id, turn AS seq,
    CAST(conv_id % 9 * 100 + turn AS DOUBLE) AS ts, text, role FROM conversations)"""
SQL["append_entries"] = ctes(TURNS) + """SELECT session_id, seq,
    1000 + row_number() OVER (ORDER BY ts, session_id, seq) AS id FROM turns"""
SQL["archive_commits"] = ctes(TURNS) + """SELECT row_number() OVER (ORDER BY ts, session_id, seq) AS id, session_id,
    text AS raw_content FROM turns UNION ALL SELECT (SELECT count(*) FROM turns) +
    row_number() OVER (ORDER BY CAST(doc_id AS DOUBLE), source, doc_id), source, text FROM documents"""
SQL["create_sessions"] = ctes(TURNS) + """SELECT sha256(text || '|' || CAST(CAST(ts AS BIGINT) AS STRING)) AS session_id,
    CAST(ts AS BIGINT) AS started_at FROM turns"""
SQL["ensure_sessions"] = ctes(LOGS, SESSIONS) + """, new AS (SELECT session_id, kind AS cmd, ts FROM src
    UNION ALL SELECT source, lang, CAST(doc_id AS DOUBLE) FROM documents),
    old AS (SELECT * FROM sess WHERE ended_at IS NULL)
    SELECT session_id, started_at, 0::BIGINT AS total_tokens_saved, agent_command FROM old
    UNION ALL SELECT session_id, min(ts), 0, min_by(cmd, (ts, cmd)) FROM new
    WHERE session_id NOT IN (SELECT session_id FROM old) GROUP BY session_id""".replace("WITH RECURSIVE , ", "")
SQL["close_sessions"] = ctes(LOGS, SESSIONS) + """SELECT sess.session_id,
    coalesce(max(ts), any_value(ended_at)) AS ended_at, coalesce(max_by(src.id, (ts, src.id)), 0)::BIGINT AS total_tokens_saved
    FROM sess LEFT JOIN src USING (session_id) GROUP BY sess.session_id"""
SQL["session_log"] = ctes(LOGS, SESSIONS) + """SELECT sess.session_id, any_value(started_at) AS started_at,
    max(ts) AS ended_at, coalesce(max_by(src.id, (ts, src.id)), 0)::BIGINT AS total_tokens_saved
    FROM sess LEFT JOIN src USING (session_id) GROUP BY sess.session_id"""
SQL["delete_entries"] = """SELECT doc_id AS id, source AS session_id FROM documents WHERE NOT contains(text, 'that')"""
SQL["delete_session_cascade"] = ctes(LOGS, SESSIONS) + """SELECT id, session_id FROM src WHERE session_id NOT IN (
    SELECT session_id FROM sess WHERE ended_at IS NULL)"""
SQL["archive_session_cascade"] = ctes(LOGS, SESSIONS) + """SELECT sess.session_id, any_value(started_at) AS started_at,
    count(src.id) AS n_entries, count(src.id) AS n_postings, 1::BIGINT AS n_events FROM sess
    LEFT JOIN src USING (session_id) WHERE ended_at IS NOT NULL GROUP BY sess.session_id"""
SQL["fk_orphans"] = ctes(LOGS, SESSIONS) + """SELECT id, session_id FROM src WHERE session_id NOT IN (
    SELECT session_id FROM sess WHERE ended_at IS NOT NULL)"""

# --- recall ----------------------------------------------------------------------------------------------
SQL["recall_by_id"] = """SELECT h.id, d.source AS session_id, d.text AS raw_content FROM (
    SELECT doc_id * 2 AS id FROM documents) h LEFT JOIN documents d ON d.doc_id = h.id"""
LATEST = "(SELECT session_id FROM sess ORDER BY started_at DESC, session_id LIMIT 1)"
SQL["recall_scope"] = ctes(SESSIONS) + f"""SELECT o_orderkey AS id, coalesce(CASE WHEN o_orderkey % 3 = 0
    THEN 'asked-' || CAST(o_custkey AS STRING) END, session_id, {LATEST}) AS scope
    FROM orders LEFT JOIN sess ON session_id = 'cust-' || CAST(o_custkey * 2 AS STRING)"""
SQL["recall_scope_at"] = ctes(SESSIONS) + """, byt AS (SELECT started_at, min(session_id) AS newest
    FROM sess GROUP BY started_at), req AS (SELECT *, CAST(o_orderkey * 37 % 100000 - 500 AS DOUBLE) AS t FROM orders)
    SELECT o_orderkey AS id, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 'asked-' || CAST(o_custkey AS STRING) END,
    sess.session_id, newest) AS scope FROM req ASOF LEFT JOIN byt ON req.t >= byt.started_at
    LEFT JOIN sess ON sess.session_id = 'cust-' || CAST(o_custkey * 2 AS STRING)"""
SQL["recall_view"] = LOGS_PRUNED + f"""SELECT id, left(session_id, 8) AS session, {CLOCK.format('ts')} AS time,
    was_pruned, {SANE.format('raw')} AS content FROM p"""
SQL["recall_latest_session"] = ctes(LOGS, SESSIONS) + f"""SELECT id, session_id FROM src WHERE session_id = {LATEST}"""
SQL["entry_preview"] = LOGS_PRUNED + f"""SELECT id, {strip('left(c, 300)')} || CASE WHEN length(c) > 300
    THEN {NL} || '  …' ELSE '' END AS preview FROM (SELECT id, {SANE.format(
    "CASE WHEN compressed_summary <> '' THEN compressed_summary ELSE raw END")} AS c FROM p)"""

SQL["needle_lookup"] = """WITH nd AS (SELECT unnest(string_split(text, ' ')) AS needle FROM benchmark
    UNION SELECT text FROM benchmark) SELECT needle, count(doc_id) AS n_entries, min(doc_id) AS first_id
    FROM nd LEFT JOIN documents ON contains(text, needle) WHERE needle <> '' GROUP BY needle"""

# --- search ------------------------------------------------------------------------------------------------
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tok(col: str, n: int) -> str:
    return f"""SELECT id, {n} AS col, unnest(range(0, len(w))) AS pos, unnest(w) AS word FROM (
        SELECT id, list_filter(regexp_split_to_array(translate({col}, '{UPPER}', '{LOWER}'),
        '[\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+'), lambda x: x <> '') AS w FROM src)"""


def z(x: str) -> str:
    return f"regexp_replace({x}, '^y', 'z')"


V_ANY = r"'^([^aeiou][^aeiouy]*)?[aeiouy]'"
M1 = r"'^([^aeiou][^aeiouy]*)?[aeiouy][aeiou]*[^aeiou]'"
M2 = r"'^([^aeiou][^aeiouy]*)?[aeiouy][aeiou]*[^aeiou][^aeiouy]*[aeiouy][aeiou]*[^aeiou]'"
SHORT = r"'^[^aeiou][^aeiouy]*[aeiouy][bcdfghjklmnpqrstvz0-9]$'"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({z(x)}, {pattern})"


def cut(n: int) -> str:
    return f"left(w, length(w) - {n})"


def suffix_step(suffixes: dict[str, str], measure: str, extra: str = "true") -> str:
    found = f"regexp_extract(w, '^.+?({'|'.join(suffixes)})$', 1)"
    case = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in suffixes.items())
    stem = "left(w, length(w) - length(x))"
    return f"""SELECT word, CASE WHEN x <> '' AND {has(stem, measure)} AND {extra.format(stem=stem)}
        THEN {stem} || CASE x {case} END ELSE w END AS w FROM (SELECT word, w, {found} AS x FROM {{prev}})"""


STEM_STEPS = [
    f"""SELECT word, CASE WHEN ends_with(w, 'sses') AND length(w) > 4 THEN {cut(2)}
        WHEN ends_with(w, 'ies') AND length(w) > 3 THEN {cut(2)}
        WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {cut(1)} ELSE w END AS w FROM {{prev}}""",
    f"""SELECT word, CASE WHEN NOT shorter THEN w WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e'
        WHEN right(w, 1) = substr(w, length(w) - 1, 1) AND length(w) > 1
            AND regexp_matches(w, '[bcdfghjkmnpqrtvwxy0-9]$') THEN {cut(1)}
        WHEN {has('w', SHORT)} THEN w || 'e' ELSE w END AS w FROM (
        SELECT word, CASE WHEN eed THEN CASE WHEN {has(cut(3), M1)} THEN {cut(1)} ELSE w END
            WHEN ed THEN {cut(2)} WHEN ing THEN {cut(3)} ELSE w END AS w, NOT eed AND (ed OR ing) AS shorter
        FROM (SELECT word, w, ends_with(w, 'eed') AND length(w) > 3 AS eed,
            ends_with(w, 'ed') AND {has(cut(2), V_ANY)} AS ed,
            ends_with(w, 'ing') AND length(w) > 3 AND {has(cut(3), V_ANY)} AS ing FROM {{prev}}))""",
    f"""SELECT word, CASE WHEN ends_with(w, 'y') AND {has(cut(1), V_ANY)} THEN {cut(1)} || 'i' ELSE w END AS w
        FROM {{prev}}""",
    suffix_step(STEP_2, M1),
    suffix_step(STEP_3, M1),
    suffix_step({s: "" for s in STEP_4}, M2, "(x <> 'ion' OR right({stem}, 1) IN ('s', 't'))"),
    f"""SELECT word, CASE WHEN ends_with(w, 'e') AND ({has(cut(1), M2)} OR ({has(cut(1), M1)}
        AND NOT {has(cut(1), SHORT)})) THEN {cut(1)} ELSE w END AS w FROM {{prev}}""",
    f"""SELECT word, CASE WHEN ends_with(w, 'll') AND {has(cut(1), M2)} THEN {cut(1)} ELSE w END AS w
        FROM {{prev}}""",
]


def stems(words: str) -> str:
    """CTEs from a table of distinct ``word``s to stem(word, term)."""
    out = [f"v0 AS (SELECT word, word AS w FROM {words} WHERE strlen(word) BETWEEN 3 AND 64)"]
    for i, step in enumerate(STEM_STEPS, start=1):
        out.append(f"v{i} AS ({step.replace('{prev}', f'v{i - 1}')})")
    out.append(f"""stem AS (SELECT word, w AS term FROM v{len(STEM_STEPS)}
        UNION ALL SELECT word, word FROM {words} WHERE strlen(word) NOT BETWEEN 3 AND 64)""")
    return ",\n".join(out)


def index(extra_words: tuple[str, ...] = (), src: str = DOCS) -> str:
    extra = "".join(f" UNION SELECT '{w}'" for w in extra_words)
    return f"""{src}, tw AS ({tok('raw', 0)} UNION ALL {tok('entry_type', 1)}),
    words AS (SELECT DISTINCT word FROM tw{extra}),
    {stems('words')},
    tk AS (SELECT id, col, pos, term FROM tw JOIN stem USING (word)),
    dl AS (SELECT src.id, count(term) AS doc_len FROM src LEFT JOIN tk USING (id) GROUP BY src.id),
    cs AS (SELECT count(*) AS n_docs, avg(doc_len) AS avg_len FROM dl)"""


def stem_of(word: str) -> str:
    return f"(SELECT term FROM stem WHERE word = '{word}')"


def leaf(p: Phrase, j: int) -> str:
    def test(i: int) -> str:
        if p.prefix and i == len(p.words) - 1:
            return f"starts_with(t{i}.term, {stem_of(p.words[i])})"
        return f"t{i}.term = {stem_of(p.words[i])}"

    joins = "".join(
        f" JOIN tk t{i} ON t{i}.id = t0.id AND t{i}.col = t0.col AND t{i}.pos = t0.pos + {i} AND {test(i)}"
        for i in range(1, len(p.words))
    )
    return f"l{j} AS (SELECT t0.id, count(*) AS n FROM tk t0{joins} WHERE {test(0)} GROUP BY t0.id)"


def holds(e: Expr, names: dict[Phrase, str]) -> str:
    if isinstance(e, Phrase):
        return f"{names[e]} > 0"
    parts = [f"({holds(p, names)})" for p in e.parts]
    if e.kind == "none":
        return parts[0] + "".join(f" AND NOT {p}" for p in parts[1:])
    return (" AND " if e.kind == "all" else " OR ").join(parts)


def ranked(e: Expr, src: str = DOCS) -> str:
    ls = _leaves(e)
    words = tuple(sorted({w for p in ls for w in p.words}))
    counts = ", ".join(f"coalesce(l{j}.n, 0) AS c{j}" for j in range(len(ls)))
    joins = " ".join(f"LEFT JOIN l{j} USING (id)" for j in range(len(ls)))
    score = " + ".join(
        f"greatest(ln((n_docs - d{j} + 0.5) / (d{j} + 0.5)), 1e-6) * c{j} * 2.2 / "
        f"(c{j} + 1.2 * (0.25 + 0.75 * doc_len / avg_len))"
        for j in range(len(ls))
    )
    dfs = ", ".join(f"(SELECT count(*) FROM l{j}) AS d{j}" for j in range(len(ls)))
    names = {p: f"c{j}" for j, p in enumerate(ls)}
    return (
        ctes(index(words, src), *[leaf(p, j) for j, p in enumerate(ls)])
        + f""", cn AS (SELECT dl.id, doc_len, {counts} FROM dl {joins}),
    rk AS (SELECT id, -({score}) AS rank FROM cn, cs, (SELECT {dfs}) WHERE {holds(e, names)})
    """
    )


for _name, _expr in queries.SEARCHES.items():
    SQL[_name] = ranked(_expr) + "SELECT id AS entry_id, round(rank, 6) AS rank FROM rk"
SQL["search_index"] = ranked(queries.SEARCHES["search_none"]) + "SELECT id AS entry_id, round(rank, 6) AS rank FROM rk"
SQL["search_top_k"] = ranked(queries.SEARCHES["search_any"]) + """SELECT id, session_id, round(rank, 6) AS rank
    FROM rk JOIN src USING (id) ORDER BY rk.rank, id LIMIT 20"""
SQL["search_in_session"] = ranked(queries.THE) + """SELECT id, session_id, round(rank, 6) AS rank
    FROM rk JOIN src USING (id) WHERE session_id = 'src3' ORDER BY rk.rank, id LIMIT 20"""
SQL["search_stored_index"] = ranked(queries.SEARCHES["search_any"]) + """SELECT id, session_id, round(rank, 6) AS rank
    FROM rk JOIN src USING (id) WHERE session_id = 'src3' ORDER BY rk.rank, id LIMIT 20"""
STDOUT_LOGS = LOGS.replace("AS raw,", "AS raw, 'stdout' AS entry_type,")
SQL["recall_by_query"] = ranked(queries.search.any_of(queries.search.term("WARNINGS"),
    queries.search.phrase("timed out")), f"{STDOUT_LOGS}, {SESSIONS}") + f"""SELECT id, session_id, round(rank, 6) AS rank
    FROM rk JOIN src USING (id) WHERE session_id = {LATEST} ORDER BY rk.rank, id LIMIT 3"""
SQL["postings"] = ctes(index()) + """SELECT term, id AS entry_id, any_value(doc_len) AS doc_len, count(*) AS tf
    FROM tk JOIN dl USING (id) GROUP BY term, id"""
SQL["delete_postings"] = SQL["postings"].replace("GROUP BY", """WHERE id NOT IN (
    SELECT doc_id FROM documents WHERE contains(text, 'that')) GROUP BY""")
LEFT = f"""{TURNS}, src AS (SELECT * FROM (SELECT row_number() OVER (ORDER BY ts, session_id, seq) AS id,
    role AS entry_type, text AS raw FROM turns UNION ALL SELECT (SELECT count(*) FROM turns) +
    row_number() OVER (ORDER BY CAST(doc_id AS DOUBLE), source, doc_id), lang, text FROM documents)
    WHERE NOT contains(raw, 'that'))"""
SQL["search_after_delete"] = ranked(queries.SEARCHES["search_any"], LEFT) + """SELECT id AS entry_id,
    round(rank, 6) AS rank FROM rk"""
SQL["search_best_stored"] = SQL["search_after_delete"] + " ORDER BY rk.rank, id LIMIT 20"
SQL["term_frequencies"] = ctes(index()) + """SELECT term, count(DISTINCT id) AS df, count(*) AS cf
    FROM tk GROUP BY term"""
SQL["corpus_stats"] = ctes(index()) + "SELECT n_docs, round(avg_len, 6) AS avg_len FROM cs"
SQL["porter_vocab"] = ctes(DOCS, f"tw AS ({tok('raw', 0)})", "words AS (SELECT DISTINCT word FROM tw)",
                           stems("words")) + "SELECT word, term AS stem FROM stem"

# --- reports ---------------------------------------------------------------------------------------------------


def sigs(src: str, col: str, out: str) -> str:
    py = rf"regexp_extract_all({col}, '\w+(?:Error|Exception|Warning):\s*.{{1,60}}')"
    gcc = rf"regexp_extract_all({col}, '\S+\.(?:c|cpp):\d+:\d+: error: (.{{1,60}})', 1)"
    code = rf"regexp_extract_all({col}, '(error\[E\d+\]):', 1)"
    return f"""{out} AS (SELECT DISTINCT id, s FROM (
        SELECT id, split_part(h, ':', 1) || ':' || left({strip("substr(h, strpos(h, ':') + 1)")}, 40) AS s
            FROM (SELECT id, unnest({py}) AS h FROM {src})
        UNION ALL SELECT id, unnest({code}) FROM {src}
        UNION ALL SELECT id, 'gcc:' || left({strip('h')}, 40) FROM (SELECT id, unnest({gcc}) AS h FROM {src})))"""


SQL["signature_table"] = ctes(LOGS, sigs("src", "raw", "sg")) + "SELECT id, s AS signature FROM sg"
ITEMS = f"""{LOGS}, {SUMMARY}, it AS (SELECT src.*, summary, coalesce(summary, raw) AS shown
    FROM src LEFT JOIN sm USING (id)), {sigs('it', 'raw', 'sa')}, {sigs('it', 'shown', 'sb')},
    sn AS (SELECT sa.id, count(*) AS a, count(sb.s) AS b FROM sa LEFT JOIN sb ON sa.id = sb.id AND sa.s = sb.s
        GROUP BY sa.id),
    res AS (SELECT kind AS suite, id AS name, length(raw) AS naked_chars, length(shown) AS proxied_chars,
        greatest(1, length(raw) // 4) AS naked_tokens, greatest(1, length(shown) // 4) AS proxied_tokens,
        coalesce(a, 0) AS naked_sigs, coalesce(b, 0) AS preserved_sigs, summary IS NOT NULL AS pruner_fired,
        coalesce(b / a, 1.0) AS fidelity_ratio FROM it LEFT JOIN sn USING (id)),
    ir AS (SELECT *, (naked_tokens - proxied_tokens) / naked_tokens AS compression_ratio FROM res)"""
SQL["signature_fidelity"] = ctes(ITEMS) + """SELECT suite, name, naked_chars, proxied_chars, naked_tokens,
    proxied_tokens, naked_sigs, preserved_sigs, pruner_fired, round(compression_ratio, 6) AS compression_ratio,
    round(fidelity_ratio, 6) AS fidelity_ratio FROM ir"""
SQL["missing_signatures"] = ctes(ITEMS) + """SELECT kind AS suite, id AS name, s AS signature FROM (
    SELECT * FROM sa EXCEPT SELECT * FROM sb) JOIN src USING (id)"""
REPORT = f"""{ITEMS}, rp AS (SELECT suite, count(*) AS n_items, avg(compression_ratio) AS mean_compression,
    coalesce(stddev_samp(compression_ratio), 0) AS std_compression,
    quantile_cont(compression_ratio, 0.1) AS p10_compression, quantile_cont(compression_ratio, 0.5) AS p50_compression,
    quantile_cont(compression_ratio, 0.9) AS p90_compression, avg(fidelity_ratio) AS mean_fidelity,
    min(fidelity_ratio) AS min_fidelity, sum(naked_tokens)::BIGINT AS total_naked_tokens,
    sum(proxied_tokens)::BIGINT AS total_pruned_tokens,
    (sum(naked_tokens) - sum(proxied_tokens)) / sum(naked_tokens) AS overall_compression FROM ir GROUP BY suite)"""
_RATIOS = ("mean_compression", "std_compression", "p10_compression", "p50_compression", "p90_compression",
           "mean_fidelity", "min_fidelity", "overall_compression")
SQL["suite_report"] = ctes(REPORT) + f"""SELECT suite, n_items, total_naked_tokens, total_pruned_tokens,
    {', '.join(f'round({c}, 6) AS {c}' for c in _RATIOS)} FROM rp"""
_CHECKS = (("mean_compression", "0.6"), ("p10_compression", "0.3"), ("overall_compression", "0.6"),
           ("mean_fidelity", "0.95"), ("min_fidelity", "0.8"))
SQL["suite_assertions"] = ctes(REPORT) + " UNION ALL ".join(
    f"""SELECT suite, '{c}' AS "check", round({c}, 6) AS actual, CAST({t} AS DOUBLE) AS threshold, {c} >= {t} AS passed FROM rp"""
    for c, t in _CHECKS
)
SQL["json_report"] = ctes(REPORT) + """SELECT suite, n_items, total_naked_tokens, mean_compression >= 0.6
    AND p10_compression >= 0.3 AND overall_compression >= 0.6 AND mean_fidelity >= 0.95 AND min_fidelity >= 0.8 AS passed,
    5::BIGINT AS n_checks, n_fired FROM rp JOIN (SELECT suite, sum(CASE WHEN pruner_fired THEN 1 ELSE 0 END)::BIGINT AS n_fired
    FROM ir GROUP BY suite) USING (suite)"""
SQL["global_summary"] = ctes(REPORT) + """SELECT sum(total_naked_tokens)::BIGINT AS total_naked_tokens,
    sum(total_pruned_tokens)::BIGINT AS total_pruned_tokens,
    round((sum(total_naked_tokens) - sum(total_pruned_tokens)) / sum(total_naked_tokens), 6) AS global_compression,
    round(avg(mean_fidelity), 6) AS global_fidelity FROM rp"""
ARMS = f"""{LOGS}, {SUMMARY}, it AS (SELECT src.*, coalesce(summary, raw) AS shown FROM src LEFT JOIN sm USING (id)),
    sz AS (SELECT *, greatest(1, length(raw) // 4) AS rt, greatest(1, length(shown) // 4) AS st FROM it),
    arms AS (SELECT id AS name, 'A' AS arm, 'keep-everything' AS label, contains(raw, needle) AS needle_recovered,
        rt AS resident_tokens, 0::BIGINT AS recall_tokens FROM sz
    UNION ALL SELECT id, 'B', 'prune-and-lose', contains(shown, needle), st, 0 FROM sz
    UNION ALL SELECT id, 'C', 'prune-and-recall', contains(raw, needle), st, rt FROM sz),
    ar AS (SELECT *, resident_tokens * 8 + recall_tokens AS total_tokens FROM arms),
    rr AS (SELECT {', '.join(f"avg(CASE WHEN needle_recovered THEN 1.0 ELSE 0.0 END) FILTER (arm = '{a.upper()}') AS recovery_{a}" for a in 'abc')},
        {', '.join(f"(sum(total_tokens) FILTER (arm = '{a.upper()}'))::BIGINT AS total_{a}_tokens" for a in 'abc')} FROM ar)"""
SQL["recall_arms"] = ctes(ARMS) + "SELECT * FROM ar"
SQL["recall_report"] = ctes(ARMS) + f"""SELECT {', '.join(f'round(recovery_{a}, 6) AS recovery_{a}' for a in 'abc')},
    total_a_tokens, total_b_tokens, total_c_tokens,
    round((total_a_tokens - total_c_tokens) / total_a_tokens, 6) AS saving_c_vs_a FROM rr"""
SQL["recall_assertions"] = ctes(ARMS) + """SELECT 'C recovers every needle' AS "check", recovery_c = 1 AS passed FROM rr
    UNION ALL SELECT 'C recovers what B loses', recovery_c > recovery_b FROM rr
    UNION ALL SELECT 'C matches A on recovery', recovery_c >= recovery_a FROM rr
    UNION ALL SELECT 'C processes fewer tokens than A', total_c_tokens < total_a_tokens FROM rr"""

LIVE = shown("''", "''", "''", f"'recall: {queries.TAG.lower()} #0'")
SQL["live_stats_replay"] = ctes(LOGS, pruned(), COUNTERS.replace(PLAIN, LIVE)) + "SELECT * FROM ctr"

# --- segments --------------------------------------------------------------------------------------------------------
_P = queries.POLICY
CHUNKS = """ch AS (SELECT 'user-' || CAST(user_id AS STRING) AS session_id, event_id AS seq, epoch_us(ts) AS us,
    event_type || ' ' || props || chr(10) AS data FROM events),
    o AS (SELECT *, strlen(data) AS n, row_number() OVER (PARTITION BY session_id ORDER BY us, seq) AS rn,
        lag(us) OVER (PARTITION BY session_id ORDER BY us, seq) AS prev FROM ch)"""


def runs(gap: int, cut_at_gap: bool = True) -> str:
    test = ">=" if cut_at_gap else ">"
    return f"""rn AS (SELECT *, sum(CASE WHEN prev IS NULL OR us - prev {test} {gap} THEN 1 ELSE 0 END)
        OVER (PARTITION BY session_id ORDER BY us, seq) AS run_no FROM o)"""


GAP = int(_P.silence * 1e6)
SQL["segments_silence"] = ctes(CHUNKS, runs(GAP)) + """SELECT session_id, run_no::BIGINT AS run_no,
    min(seq) AS first_seq, count(*) AS n_chunks, min(us) AS first_us, max(us) AS last_us FROM rn GROUP BY ALL"""
SQL["session_windows"] = ctes(CHUNKS, runs(GAP, False)) + """SELECT session_id, n_chunks, n_bytes, first_us, last_us
    FROM (SELECT session_id, run_no, count(*) AS n_chunks, sum(n)::BIGINT AS n_bytes, min(us) AS first_us,
    max(us) AS last_us FROM rn GROUP BY ALL)"""
_CUT = (
    f"(o.us - g.last >= {GAP} OR o.us - g.first >= {int(_P.max_hold * 1e6)} OR g.held >= {_P.max_bytes})"
)
GREEDY = f"""g AS (SELECT session_id, rn, seq, us, n, data, us AS first, us AS last, n AS held, 1 AS seg_no
        FROM o WHERE rn = 1
    UNION ALL SELECT o.session_id, o.rn, o.seq, o.us, o.n, o.data, CASE WHEN {_CUT} THEN o.us ELSE g.first END, o.us,
        CASE WHEN {_CUT} THEN o.n ELSE g.held + o.n END, g.seg_no + CASE WHEN {_CUT} THEN 1 ELSE 0 END
        FROM g JOIN o ON o.session_id = g.session_id AND o.rn = g.rn + 1)"""
SQL["segments_greedy"] = ctes(CHUNKS, GREEDY) + """SELECT session_id, seg_no::BIGINT AS seg_no, count(*) AS n_chunks,
    sum(n)::BIGINT AS n_bytes, min(us) AS first_us, max(us) AS last_us FROM g GROUP BY session_id, seg_no"""
SQL["segment_text"] = ctes(CHUNKS, GREEDY) + """SELECT session_id, seg_no::BIGINT AS seg_no,
    string_agg(data, '' ORDER BY us, seq) AS text FROM g GROUP BY session_id, seg_no"""

_HELD = -(-queries.BYTES_POLICY.max_bytes // inputs.PIECE) * inputs.PIECE  # bytes of whole pieces
SQL["segment_text_cut_characters"] = f"""WITH c AS (SELECT doc_id, unnest(l) AS ch, unnest(range(len(l))) AS i
        FROM (SELECT doc_id, regexp_extract_all(text, '(?s).') AS l FROM documents)),
    e AS (SELECT *, sum(strlen(ch)) OVER (PARTITION BY doc_id ORDER BY i) AS ends FROM c)
    SELECT 'doc-' || CAST(doc_id AS STRING) AS session_id, ((ends - 1) // {_HELD} + 1)::BIGINT AS seg_no,
    string_agg(ch, '' ORDER BY i) AS text FROM e GROUP BY doc_id, 2"""
SQL["stream_segments_replay"] = SQL["segments_greedy"]
_ASKED = "o.us - g.last >= " + str(GAP) + " OR g.rows >= 3"
TERMINAL = f"""g AS (SELECT session_id, rn, seq, us, n, us AS last, 1 AS rows, 1 AS seg_no FROM o WHERE rn = 1
    UNION ALL SELECT o.session_id, o.rn, o.seq, o.us, o.n, o.us, CASE WHEN {_ASKED} THEN 1 ELSE g.rows + 1 END,
        g.seg_no + CASE WHEN {_ASKED} THEN 1 ELSE 0 END
        FROM g JOIN o ON o.session_id = g.session_id AND o.rn = g.rn + 1)"""
SQL["stream_terminal_replay"] = ctes(CHUNKS, TERMINAL) + """SELECT session_id, seg_no::BIGINT AS seg_no,
    count(*) AS n_chunks, sum(n)::BIGINT AS n_bytes, min(us) AS first_us, max(us) AS last_us
    FROM g GROUP BY session_id, seg_no"""
SQL["stream_archive_replay"] = ctes(CHUNKS, GREEDY) + """SELECT row_number() OVER (ORDER BY last_us / 1000000.0,
    session_id, seg_no) AS id, session_id, raw_content, length(raw_content) // 4 AS token_estimate, false AS was_pruned
    FROM (SELECT session_id, seg_no, max(us) AS last_us, string_agg(data, '' ORDER BY us, seq) AS raw_content
    FROM g GROUP BY session_id, seg_no)"""

SQL["stream_archive_logs"] = LOGS_PRUNED + """SELECT row_number() OVER (ORDER BY ts) AS id, session_id,
    raw AS raw_content, compressed_summary, token_estimate, was_pruned FROM p"""

# --- symbols ---------------------------------------------------------------------------------------------------------
FILES = f"src AS (SELECT {inputs.PATH} AS id, {inputs.SOURCE} AS raw FROM part)"
SQL["source_files"] = ctes(FILES, lines()) + """SELECT src.id AS path, 'python' AS language,
    left(sha256(any_value(raw)), 16) AS file_hash, count(line) AS line_count FROM src JOIN ln USING (id) GROUP BY src.id"""
SYMBOLS = rf"""hit AS (SELECT id, pos + 1 AS line_no, regexp_extract(line, '^class\s+(\w+)', 1) AS cls,
        regexp_extract(line, '^(\s*)def\s+(\w+)', 2) AS def,
        length(regexp_extract(line, '^(\s*)def\s+(\w+)', 1)) AS indent FROM ln),
    own AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line_no) - 1 AS ord,
        coalesce(last_value(nullif(cls, '') IGNORE NULLS) OVER (PARTITION BY id ORDER BY line_no
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS owner FROM hit WHERE cls <> '' OR def <> ''),
    nx AS (SELECT id, line_no, lead(line_no) OVER (PARTITION BY id ORDER BY line_no) AS nxt FROM own WHERE cls <> ''),
    fl AS (SELECT id, count(*) AS total FROM ln GROUP BY id),
    sy AS (SELECT own.id AS path, ord, line_no AS start_line,
        CASE WHEN cls <> '' THEN coalesce(nxt - 1, total) ELSE line_no END AS end_line,
        CASE WHEN cls <> '' THEN cls ELSE def END AS name,
        CASE WHEN cls <> '' THEN 'class' WHEN indent > 0 AND owner <> '' THEN 'method' ELSE 'function' END AS kind,
        '' AS docstring, CASE WHEN cls = '' AND indent > 0 THEN owner ELSE '' END AS parent, total
        FROM own LEFT JOIN nx USING (id, line_no) JOIN fl USING (id))"""
SQL["symbol_ranges"] = ctes(FILES, lines(), SYMBOLS) + """SELECT path, ord, start_line, end_line, name, kind,
    docstring, parent FROM sy"""
SQL["symbols_cached"] = ctes(FILES, lines(), SYMBOLS) + """SELECT p || path AS path, ord, start_line, end_line,
    name, kind, docstring, parent FROM sy, (VALUES (''), ('copy/')) AS v(p)"""
SQL["symbol_children"] = ctes(FILES, lines(), SYMBOLS) + """SELECT c.path, c.name AS parent, m.name AS method,
    c.start_line AS class_line, m.start_line AS method_line FROM sy c JOIN sy m
    ON m.path = c.path AND m.parent = c.name WHERE c.kind = 'class' AND m.parent <> ''"""
SQL["symbol_outline"] = ctes(FILES, lines(), SYMBOLS) + f"""SELECT path, '# ' || path || '  (' || any_value(total)
    || ' lines)' || {NL} || string_agg(row, {NL} ORDER BY a, b) AS outline FROM (
    SELECT path, total, ord AS a, -1 AS b, printf('%-10s %-38s [%d–%d]', kind, name, start_line, end_line) AS row
        FROM sy WHERE parent = ''
    UNION ALL SELECT c.path, c.total, c.ord, m.ord, printf('  %-8s %-36s [%d–%d]', 'def', m.name, m.start_line, m.end_line)
        FROM sy c JOIN sy m ON m.path = c.path AND m.parent = c.name WHERE c.kind = 'class' AND m.parent <> '')
    GROUP BY path"""
