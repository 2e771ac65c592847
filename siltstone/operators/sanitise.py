"""Sanitising pages: six ordered rules, each on what the one before left, with what each removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup, text

RULES = ("comments", "hidden", "scripts", "event_handlers", "boilerplate", "zwsp")
CONCEALING = ("comments", "hidden", "zwsp")
COLUMNS = "sanitised rules_applied original_bytes sanitised_bytes content_sha256 zero_width_count tag_char_count tag_char_decoded stripped_bytes concealed_bytes stripped_by_rule hidden_content_ratio diff_summary".split()


def sanitise(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with COLUMNS. A null body counts as empty.

    comments, scripts, event_handlers and zwsp count UTF-8 bytes, hidden and boilerplate UTF-16
    units. The two structural rules are one Arrow UDF each; the rest are expressions, in steps so
    that no body is rewritten twice.
    """

    def size(c: str) -> Column:
        return F.octet_length(c).cast("long")

    p = pages.drop(*COLUMNS).withColumn("__0", F.coalesce(F.col(html), F.lit("")))
    p = p.withColumn("__1", text.strip_comments(F.col("__0")))
    p = p.withColumn("__2", markup.hidden_stripped("__1"))
    p = p.withColumn("__3", text.strip_scripts(F.col("__2.html")))
    p = p.withColumn("__4", text.strip_handlers(F.col("__3")))
    p = p.withColumn("__5", markup.furniture_stripped("__4"))
    p = p.withColumns({"tag_char_count": text.tag_char_count(F.col("__5.html")), "zero_width_count": text.invisible_count(F.col("__5.html")), "sanitised": text.strip_invisible(F.col("__5.html"))})
    p = p.withColumns({
        "original_bytes": size("__0"),
        "sanitised_bytes": size("sanitised"),
        "content_sha256": text.sha256(F.col("__0")),
        "tag_char_decoded": F.when(F.col("tag_char_count") > 0, text.decode_tag_chars(F.col("__5.html"))).otherwise(F.lit("")),
        "__comments": size("__0") - size("__1"),
        "__hidden": F.col("__2.removed"),
        "__scripts": size("__2.html") - size("__3"),
        "__event_handlers": size("__3") - size("__4"),
        "__boilerplate": F.col("__5.removed"),
        "__zwsp": size("__5.html") - size("sanitised"),
    })
    n = {r: F.col(f"__{r}") for r in RULES}
    zero, tags = F.col("zero_width_count"), F.col("tag_char_count")
    said = {
        **{r: F.concat(F.lit(f"{name}: -"), n[r], F.lit("B")) for r, name in zip(RULES, ("comments", "hidden", "scripts/style/iframe", "event_handlers/js_uris", "boilerplate"), strict=False)},
        "zwsp": F.concat(F.lit("invisible: -"), zero, F.lit(" chars"), F.when(tags > 0, F.concat(F.lit(" ("), tags, F.lit(" unicode tag chars)"))).otherwise(F.lit(""))),
    }
    concealed = sum((n[r] for r in CONCEALING), F.lit(0).cast("long"))
    p = p.withColumns({
        "rules_applied": F.array_compact(F.array(*(F.when(n[r] > 0, F.lit(r)) for r in RULES))),
        "stripped_by_rule": F.map_filter(F.map_from_arrays(F.array(*map(F.lit, RULES)), F.array(*n.values())), lambda _, v: v > 0),
        "stripped_bytes": sum(n.values(), F.lit(0).cast("long")),
        "concealed_bytes": concealed,
        "hidden_content_ratio": F.when(F.col("original_bytes") == 0, F.lit(0.0)).otherwise(concealed / F.col("original_bytes")),
        "diff_summary": F.array_compact(F.array(*(F.when(n[r] > 0, said[r]) for r in RULES))),
    })
    return p.select(*[c for c in pages.columns if c not in COLUMNS], *COLUMNS)
