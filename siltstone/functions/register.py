"""The functions that need Python, registered for SQL, and a table function over the urls of a text."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import hashing, markup, shell, text, urls

FUNCTIONS = {
    "nfkc": text.nfkc,
    "repetition_ratio": text.repetition_ratio,
    "strip_hidden": markup.hidden_stripped,
    "strip_furniture": markup.furniture_stripped,
    "url_fields": urls.url_fields,
    "punycode_label": urls.decoded_label,
    "shell_match": shell.matched,
    "strip_heredocs": shell.heredocs_stripped,
    "simhash64": hashing.simhash,
}


def register(spark: SparkSession) -> None:
    """Register FUNCTIONS, and scan_urls(body): pos, url, host of the distinct urls of a text, the first MOST_URLS of them."""
    import re

    token = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), urls.URL_TOKEN))
    most, parsed = urls.MOST_URLS, urls.parsed

    class ScanUrls:
        def eval(self, body: str) -> Iterator[tuple]:
            for pos, url in enumerate(list(dict.fromkeys(token.findall(body or "")))[:most]):
                fields = parsed(url)
                yield pos, url, fields[2] if fields else None

    for name, f in FUNCTIONS.items():
        spark.udf.register(name, f)
    spark.udtf.register("scan_urls", udtf(ScanUrls, returnType="pos int, url string, host string"))
