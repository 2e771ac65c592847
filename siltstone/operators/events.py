"""Tool events: which concern the web, where they go, and what their responses hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of web tools.
WEB_TOOLS = ("WebFetch", "WebSearch")
WEB_PATTERN = r"^mcp__claude-in-chrome__(navigate|read_page|get_page_text|read_network_requests|read_console_messages|javascript_tool|find|browser_batch)$|^mcp__brightdata__"
SEARCH, SHELL = "WebSearch", "Bash"


def is_web_tool(name: Column) -> Column:
    return F.coalesce(name.isin(*WEB_TOOLS) | name.rlike(WEB_PATTERN), F.lit(False))


def is_mcp_tool(name: Column) -> Column:
    return F.startswith(F.coalesce(name, F.lit("")), F.lit("mcp__"))


def url_or_query(tool_input: Column) -> Column:
    """The url, else the query, else an empty string, of an event's input map."""
    return F.coalesce(F.try_element_at(tool_input, F.lit("url")), F.try_element_at(tool_input, F.lit("query")), F.lit(""))


def route(tool: Column, url: Column, mode: str = "enforce") -> Column:
    """What happens to an event before it runs: shell, search, deny, inspect or pass."""
    mode = mode.lower()
    web = F.lit("deny") if mode == "strict" else F.when(F.startswith(url, F.lit("http")), F.lit("inspect")).otherwise(F.lit("pass"))
    return F.when(tool == SHELL, F.lit("shell")).when(tool == SEARCH, F.lit("search")).when(is_web_tool(tool), web).otherwise(F.lit("pass"))


def post_mode(mode: str) -> str:
    """After a fetch there is nothing to refuse: strict counts as enforce."""
    mode = mode.lower()
    return "enforce" if mode == "strict" else mode


def body_of(response: Column) -> Column:
    """The text of a response that is JSON or plain text.

    A string is its own body; of an object the first string among content, text and body counts,
    then a content list's texts, one a line; anything else stays as its JSON.
    """
    is_object = F.coalesce(response.rlike(r"^\s*\{"), F.lit(False))
    parsed = F.try_parse_json(response)

    def text(key: str) -> Column:
        v = F.try_variant_get(parsed, f"$.{key}", "variant")
        return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(parsed, f"$.{key}", "string"))

    items = F.try_variant_get(parsed, "$.content", "array<variant>")
    lines = F.array_join(F.transform(items, lambda i: F.coalesce(F.try_variant_get(i, "$.text", "string"), F.lit(""))), "\n")
    plain = F.when(F.schema_of_variant(parsed) == "STRING", F.try_variant_get(parsed, "$", "string"))
    listed = F.when(F.startswith(F.schema_of_variant(F.try_variant_get(parsed, "$.content", "variant")), F.lit("ARRAY")), lines)
    return F.coalesce(plain, F.when(is_object, F.coalesce(text("content"), text("text"), text("body"), listed)), response)
