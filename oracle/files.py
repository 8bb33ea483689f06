"""SQL for what is read back out of files and archive: the conversations' transcripts, less the refused."""

from __future__ import annotations

from oracle.ingest import _BASE, SQL as INGEST

SQL: dict[str, str] = {}

# A session whose main transcript has a damaged line before its last line is withheld whole.
_HELD = """, main AS (SELECT c, max(n) AS last_n FROM cv WHERE source = 'main' GROUP BY c),
refused AS (SELECT c FROM main WHERE c % 7 = 3 AND last_n >= 1),
tails AS (SELECT c FROM main WHERE c % 7 = 5 OR (c % 7 = 3 AND last_n < 1)),
held AS (SELECT 'v' || c AS session_id, c FROM main WHERE c NOT IN (SELECT c FROM refused))
"""
_FILES = _BASE.rstrip() + _HELD

for _name in (
    "sessions", "turns", "api_calls", "tool_calls", "agent_runs", "compactions", "interjections", "pr_links",
):
    _key = "id" if _name == "sessions" else "session_id"
    SQL[f"files_{_name}"] = (
        f"SELECT * FROM ({INGEST['ingest_' + _name]}) WHERE {_key} IN ({_FILES} SELECT session_id FROM held)"
    )
SQL["files_offload_files"] = _FILES + """SELECT session_id, 'out ' || c || '%.txt' AS name,
  'printed é ' || c || chr(10) AS content, false AS lossy_decode, octet_length(encode('printed é ' || c)) + 1 AS size_bytes
FROM held WHERE c % 4 = 2"""
SQL["files_session_tags"] = _FILES + "SELECT session_id, 'batch' AS key, 'first' AS value FROM held"
SQL["files_state"] = _FILES + """SELECT session_id, '/t/' || session_id || '.jsonl' AS transcript_path,
  'transcripts' AS extractor, 64 AS fingerprint_length FROM held"""
SQL["files_one_session"] = (
    f"SELECT session_id, source, id, index FROM ({INGEST['ingest_turns']}) "
    f"WHERE session_id IN ('v2', 'v8', 'v11', 'v3') AND session_id IN ({_FILES} SELECT session_id FROM held)"
)

SQL["files_roles"] = _FILES + """, roles AS (
  SELECT c, 'main' AS role FROM main
  UNION ALL SELECT c, unnest(['agent', 'meta']) FROM (SELECT DISTINCT c, source FROM cv WHERE source <> 'main')
  UNION ALL SELECT c, 'offload' FROM main WHERE c % 4 = 2)
SELECT '-p-' || (c % 3) AS project_folder, role, count(*) AS files FROM roles GROUP BY ALL"""
SQL["files_projects"] = _FILES + """SELECT '-p-' || (c % 3) AS project_folder, count(*) AS sessions,
  count(*) AS recent_sessions FROM main GROUP BY ALL"""
SQL["files_report"] = _FILES + """SELECT '-p-' || (c % 3) AS project_folder, count(*) AS sessions,
  count(*) FILTER (c NOT IN (SELECT c FROM refused)) AS extracted, count(*) FILTER (c IN (SELECT c FROM refused)) AS refused,
  0::BIGINT AS skipped, count(*) FILTER (c IN (SELECT c FROM tails))::BIGINT AS dropped_tails FROM main GROUP BY ALL"""
SQL["files_report_again"] = _FILES + """SELECT '-p-' || (c % 3) AS project_folder, count(*) AS sessions,
  0::BIGINT AS extracted, count(*) FILTER (c IN (SELECT c FROM refused)) AS refused,
  count(*) FILTER (c NOT IN (SELECT c FROM refused)) AS skipped,
  count(*) FILTER (c IN (SELECT c FROM refused) AND c IN (SELECT c FROM tails))::BIGINT AS dropped_tails FROM main GROUP BY ALL"""
SQL["files_rejects"] = _FILES + "SELECT 'v' || c AS session_id, 'unparseable line' AS rule, 'main 9' AS detail FROM refused"
SQL["files_kinds"] = _FILES + """SELECT CASE WHEN c % 6 = 1 THEN 'mystery' ELSE 'system.weird' END AS name,
  count(*)::BIGINT AS lines, count(*) AS sessions, min('v' || c) AS first_session, 10 AS first_line
FROM main WHERE c % 6 IN (1, 2) GROUP BY c % 6"""
SQL["files_lines"] = _FILES + """, said AS (
  SELECT *, unnest(CASE role
    WHEN 'user' THEN list_filter([0, CASE WHEN c % 4 = 0 THEN 1 END, CASE WHEN x % 9 = 0 THEN 2 END], lambda j: j IS NOT NULL)
    WHEN 'assistant' THEN list_filter([0, 1, CASE WHEN x % 3 = 0 THEN 2 END, CASE WHEN x % 6 = 0 THEN 3 END, 4,
      CASE WHEN x % 6 = 1 THEN 5 END], lambda j: j IS NOT NULL)
    ELSE [0, 1, 2, 3] END) AS j FROM cv)
SELECT session_id, source, (n * 10 + j + 1)::INT AS line_no,
  CASE WHEN role NOT IN ('user', 'assistant') AND j = 0 THEN NULL
       ELSE c || '-' || n || '-' || (CASE WHEN role = 'assistant' AND j = 5 THEN 1 ELSE j END) END AS uuid,
  CASE role WHEN 'user' THEN CASE WHEN j = 1 THEN 'attachment' ELSE 'user' END
    WHEN 'assistant' THEN CASE WHEN j = 4 THEN 'user' ELSE 'assistant' END
    ELSE ['custom-title', 'system', 'system', 'pr-link'][j + 1] END AS type,
  CASE WHEN role = 'user' AND j = 0 AND NOT (x % 11 = 0 AND x % 13 <> 0 AND x % 5 <> 0) THEN
    CASE WHEN x % 13 = 0 THEN '<bash-stdout>out</bash-stdout>'
         WHEN x % 5 = 0 THEN '<command-name>/go</command-name><command-args> a' || n || ' </command-args>'
         ELSE 'say: ' || text END END AS content
FROM said WHERE c NOT IN (SELECT c FROM refused)
UNION ALL
SELECT session_id, 'main', 10, NULL, CASE WHEN c % 6 = 1 THEN 'mystery' ELSE 'system' END, NULL FROM held WHERE c % 6 IN (1, 2)"""
