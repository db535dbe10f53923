"""Line dedup by site-relative frequency.

A line that more than boilerplate_ratio of a host's pages contain is boilerplate of that host and is
dropped from its pages. The list of one host's boilerplate is short by construction: with r the ratio
and n the mean number of distinct lines of its pages, at most n / r lines exceed it. DataFrame
functions only.

Defined results: null html has no lines; a null or malformed url has the host ''; a line counts once
per page; repeated page rows count as pages; on hosts where fewer than min_pages pages hold a line it
stays; pages without lines return the empty text; an empty table gives an empty result; columns other
than page_id, url and html are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import stored

#: What ends a line besides a line feed, and what is no text (fixed patterns): an opening and its closing, and block tags but for their last sign.
HIDDEN = ((r"(?is)<script\b.*?</script\s*>", r"(?is)^.*</script\s*>"), (r"(?is)<style\b.*?</style\s*>", r"(?is)^.*</style\s*>"), (r"(?s)<!--.*?-->", r"(?s)^.*-->"))
BLOCK = r"(?i)</?(?:html|head|title|body|nav|ul|ol|li|div|article|section|header|footer|main|aside|p|br|hr|h[1-6]|table|tr|td|th|blockquote|pre)(?:\s[^>]*)?/?\z"
TAG = r"<[^<>]*>"
HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """A body with a value that it names several times and that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _after(text: Column, head: Column) -> Column:
    return F.substring(text, F.length(head) + 1, F.length(text))


def _without(text: Column, whole: str, to_last: str) -> Column:
    """Text without what a pattern hides. It is looked for up to the last closing only, where every opening finds one: unclosed ones cost nothing."""
    return _let(text, lambda t: _let(F.regexp_extract(t, to_last, 0), lambda head: F.concat(F.regexp_replace(head, whole, ""), _after(t, head))))


def _broken(text: Column) -> Column:
    """Text with a line feed for each block tag. A tag lasts until the next >, so it is the end of what stands before one."""
    end = lambda x: F.when(x.rlike(BLOCK), F.regexp_replace(x, BLOCK, "\n")).otherwise(F.concat(x, F.lit(">")))
    ended = lambda head: F.array_join(F.transform(F.split(head, ">"), end), "")
    cut = lambda joined: F.substring(joined, F.lit(1), F.length(joined) - 1)  # noqa: E731  the empty text after the last > has got one too many
    return _let(text, lambda t: _let(F.regexp_extract(t, "(?s)^.*>", 0), lambda head: F.concat(_let(ended(head), cut), _after(t, head))))


def html_lines(html: Column) -> Column:
    """Text lines of a page: block tags break lines, other tags vanish, blanks are trimmed, empty lines go. Linear in the text, closed tags or not."""
    out = F.coalesce(html, F.lit(""))
    for whole, to_last in HIDDEN:
        out = _without(out, whole, to_last)
    out = F.regexp_replace(_broken(out), TAG, "")
    return F.filter(F.transform(F.split(out, "\n"), lambda x: F.btrim(x)), lambda x: x != "")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def boilerplate(lines: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """host, drop (its boilerplate lines). lines: host and lines of each page."""
    totals = stored(lines.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages")), "host-pages")
    held = lines.select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    over = held.where(F.col("n") >= min_pages).join(totals, "host").where(F.col("n") > F.lit(ratio) * F.col("n_pages"))
    return over.groupBy("host").agg(F.collect_list("line").alias("drop"))


def drop_boilerplate(pages: DataFrame, ratio: float = 0.3, min_pages: int = 3) -> DataFrame:
    """page_id, host, n_lines, n_dropped and the text of the lines that stay, in order."""
    lines = stored(pages.select("page_id", host(F.col("url")).alias("host"), html_lines(F.col("html")).alias("lines")), "page-lines")
    drop = stored(boilerplate(lines, ratio, min_pages), "boilerplate")
    joined = lines.join(drop, "host", "left")
    rest = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("drop", x)))
    return joined.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), "lines", rest.alias("rest")).select(
        "page_id", "host", "n_lines", (F.col("n_lines") - F.size("rest")).alias("n_dropped"), F.array_join("rest", "\n").alias("text")
    )
