"""Links of directory listings: extraction and choice, as expressions over HTML."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of a link that mark it as no data file. Fixed values.
SKIPPED = ("parent", "..", "index", "readme")
_ANCHOR = r"""(?is)<a\s(?:[^>"']|"[^"]*"|'[^']*')*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


#: Named characters that occur in addresses, the ampersand last. Fixed values.
ENTITIES = {"&quot;": '"', "&apos;": "'", "&lt;": "<", "&gt;": ">", "&nbsp;": "\u00a0", "&amp;": "&"}


def unescaped(text: Column) -> Column:
    """Text with numbered characters (&#38; and &#x26;) and those named in ENTITIES for themselves."""

    def numbered(x: Column, mark: str, code) -> Column:
        letter = lambda n: F.decode(F.unhex(F.lpad(F.hex(code(n)), 8, "0")), "UTF-32")
        letters = F.transform(F.regexp_extract_all(x, F.lit(mark), F.lit(1)), letter)
        return F.array_join(F.zip_with(F.split(x, mark), letters, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    out = numbered(text, r"&#0*([0-9]{1,6});?", lambda n: n.cast("int"))
    out = numbered(out, r"&#[xX]0*([0-9A-Fa-f]{1,5});?", lambda n: F.conv(n, 16, 10).cast("int"))
    for name, value in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(value))
    return F.when(text.contains("&"), out).otherwise(text)


def hrefs(html: Column) -> Column:
    """The targets of a page's links, in order, with duplicates."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(_ANCHOR), F.lit(1))
    return F.transform(found, lambda x: unescaped(F.regexp_replace(x, r"""^["']|["']$""", "")))


def links(pages: DataFrame, html: str = "html", keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """(keys..., pos, href): one row for each link of each page."""
    return pages.select(*keys, F.posexplode(hrefs(F.col(html))).alias("pos", "href"))


def has_extension(href: Column, extensions: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.endswith(F.lower(href), F.lit(f".{e.lower()}")) for e in extensions], F.lit(False))


def is_skipped(href: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(href), F.lit(s)) for s in SKIPPED])


def is_file(href: Column, extensions: Sequence[str]) -> Column:
    """Whether a link names a file beside the page: of an extension, not rooted, without a query, and not skipped."""
    return has_extension(href, extensions) & ~href.startswith("/") & ~href.contains("?") & ~is_skipped(href)


def file_links(pages: DataFrame, extensions: Sequence[str], html: str = "html", keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """The links() that name files."""
    return links(pages, html, keys).where(is_file(F.col("href"), extensions))


def classified(found: DataFrame, extensions: Sequence[str]) -> DataFrame:
    """links() with a flag for each rule of file_links()."""
    href = F.col("href")
    return found.withColumns({"has_ext": has_extension(href, extensions), "rooted": href.startswith("/"), "has_query": href.contains("?"), "skipped": is_skipped(href)})


def get_file_list(spark, base_url: str, extensions: Sequence[str], timeout: float = 30, verify: bool = True) -> DataFrame:
    """(url, pos, href, error) of one listing, fetched by one task; a failure is a row with its error and no link."""

    def fetch(frames):
        import pandas as pd
        import requests

        for pdf in frames:
            out = []
            for url in pdf["url"]:
                try:
                    got = requests.get(f"{url}/", timeout=timeout, verify=verify)
                    got.raise_for_status()
                    out.append((url, got.text, None))
                except Exception as e:
                    out.append((url, None, str(e)))
            yield pd.DataFrame(out, columns=["url", "html", "error"])

    page = spark.createDataFrame([(base_url,)], "url string").mapInPandas(fetch, "url string, html string, error string")
    found = page.select("url", "error", F.posexplode_outer(hrefs(F.col("html"))).alias("pos", "href"))
    return found.where(F.col("error").isNotNull() | is_file(F.col("href"), extensions)).select("url", "pos", "href", "error")
