"""Table schemas of the archive, as Spark DDL."""

ENTRY = (
    "id BIGINT, session_id STRING, timestamp DOUBLE, entry_type STRING, raw_content STRING, "
    "compressed_summary STRING, token_estimate BIGINT, was_pruned BOOLEAN"
)
SESSION = (
    "session_id STRING, agent_command STRING, started_at DOUBLE, ended_at DOUBLE, "
    "total_tokens_saved BIGINT"
)
SESSION_EVENT = (
    "session_id STRING, kind STRING, event_ts DOUBLE, agent_command STRING, tokens_saved BIGINT"
)
CHUNK = "session_id STRING, seq BIGINT, ts TIMESTAMP, data BINARY, eof BOOLEAN"
SEGMENT = (
    "session_id STRING, seg_no BIGINT, first_ts TIMESTAMP, last_ts TIMESTAMP, "
    "n_chunks BIGINT, n_bytes BIGINT, data BINARY"
)
POSTING = "term STRING, entry_id BIGINT, doc_len BIGINT, tf INT, positions ARRAY<INT>"
DOCUMENT = "entry_id BIGINT, doc_len BIGINT"
DELETED = "id BIGINT, session_id STRING, token_estimate BIGINT, was_pruned BOOLEAN"
TOTALS = (
    "session_id STRING, total_entries BIGINT, pruned_entries BIGINT, raw_tokens BIGINT, "
    "pruned_raw_tokens BIGINT"
)
