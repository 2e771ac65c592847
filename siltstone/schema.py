"""Schemas of the event sources and of the stored tables."""

EVENT = "session_id string, hook_event_name string, tool_name string, tool_input map<string,string>, tool_response string, cwd string"
SESSIONS = "session_id string, web_tool_call_count long, started_at timestamp"
BLOCKLIST = "domain string, reason string, added_at timestamp, source string, expires_at timestamp, session_id string"
ROBOTS_CACHE = "domain string, fetched_at timestamp, body string, parsed_disallow_paths string, status_code int"
FETCH_LOG = "id long, url string, domain string, fetched_at timestamp, content_sha256 string, original_bytes long, risk_signals string, strip_diff string, sanitiser_version string, session_id string, simhash string, abort_decision boolean"
CONFIG = "key string, value string, updated_at timestamp"
REFETCHES = "url string, ok boolean, status int, body string, redirect_hops int, content_type string, error string"
#: Columns that later versions added; older files lack them and read as null.
ADDED = {"fetch_log": ("abort_decision",), "blocklist": ("session_id",)}
