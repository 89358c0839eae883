"""HTML pages: plain text, asset references, links, tags, policy audit, sanitised corpus."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from postmill.functions import html as h
from postmill.functions.text import crlf_breaks, blank, trimmed

# The text given where a page has none, and the address put for a link with forbidden characters.
NO_TEXT = "To view this email message, open it in a program that understands HTML!\r\n\r\n"
INVALID_LINK = "http://invalid-stuff-detected.example.com"

# Entities decoded natively. & comes last so that nothing is decoded twice.
ENTITIES = (
    ("&quot;", '"'), ("&#039;", "'"), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "),
    ("&middot;", "·"), ("&copy;", "©"), ("&reg;", "®"), ("&euro;", "€"), ("&hellip;", "…"),
    ("&ndash;", "–"), ("&mdash;", "—"), ("&laquo;", "«"), ("&raquo;", "»"), ("&amp;", "&"),
)


def stripped(html: Column) -> Column:
    """The page without head, title, style and script and their content, without tags, trimmed."""
    kept = F.regexp_replace(html, h.element(h.NOT_TEXT), "")
    return trimmed(F.regexp_replace(kept, f"(?s){h.MARKUP}", ""))


def plain_text(html: Column) -> Column:
    """Text of a page with the usual entities decoded, all in the JVM."""
    text = stripped(html)
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


@F.pandas_udf(StringType())
def _decode_entities(texts: pd.Series) -> pd.Series:
    closed = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
    return texts.str.replace(closed, lambda m: html.unescape(m.group()), regex=True)


def full_text(page: Column) -> Column:
    """The same with every HTML entity, through Arrow."""
    return _decode_entities(stripped(page))


def html_to_text(pages: DataFrame, converter: Callable[[Column], Column] = plain_text, column: str = "html") -> DataFrame:
    """Add ``text``. ``converter`` may be any Column function, a pandas UDF included."""
    return pages.withColumn("text", converter(F.col(column)))


def alt_bodies(pages: DataFrame, converter: Callable[[Column], Column] = plain_text, column: str = "html") -> DataFrame:
    """Add ``alt_body``: the text with CRLF breaks, or a fixed notice where there is none."""
    return pages.withColumn("_text", crlf_breaks(converter(F.col(column)))).withColumn(
        "alt_body", F.when(blank(F.col("_text")), NO_TEXT).otherwise(F.col("_text"))
    ).drop("_text")


def asset_references(
    pages: DataFrame, attrs: Sequence[str] = ("src", "background"), host: str = "inline.0", column: str = "html"
) -> DataFrame:
    """One row per quoted reference: ``page_id, pos, attr, url, ref, class, mime, cid``; ``ref`` is its text in the page.

    ``class`` is data_uri, cid, absolute or relative; ``mime`` the type of a data URI.
    """
    pattern = "(?id)(?:" + "|".join(attrs) + r")=[\"'].*?[\"']"
    refs = pages.select(
        "page_id", F.posexplode(F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(0))).alias("pos", "ref")
    )
    ref, url = F.col("ref"), F.col("url")
    attr = F.substring_index(ref, "=", 1)
    mime = F.regexp_extract(url, r"^data:(image[^;,]*)(;base64)?,", 1)
    return (
        refs.withColumn("attr", F.lower(attr))
        .withColumn("url", F.substr(ref, F.length("attr") + 3, F.length(ref) - F.length("attr") - 3))
        .withColumns(
            {
                "pos": F.col("pos").cast("bigint"),
                "mime": mime,
                "class": F.when(url.rlike(r"^data:image[^;,]*(;base64)?,"), "data_uri")
                .when(url.startswith("cid:"), "cid")
                .when(url.rlike(r"^[A-z]+://"), "absolute")
                .otherwise("relative"),
                "cid": F.concat(F.md5("url"), F.lit(f"@{host}")),
            }
        )
    )


def embed_assets(pages: DataFrame, assets: DataFrame, host: str = "inline.0") -> DataFrame:
    """``page_id, html``: data URIs and existing relative references become ``cid:`` references; others stay.

    ``assets`` lists the ``url`` that exist. The replacements of a page are as many as its own references. All
    pages are joined with them on ``page_id``.
    """
    refs = asset_references(pages, host=host).select("page_id", "attr", "url", "ref", "class", "cid", "pos")
    data = refs.filter(F.col("class") == "data_uri")
    files = refs.filter(F.col("class") == "relative").join(assets.select("url").distinct(), "url", "left_semi")
    pair = F.struct("pos", "ref", F.concat(F.substring_index("ref", "=", 1), F.lit('="cid:'), "cid", F.lit('"')).alias("new"))
    pairs = data.unionByName(files).groupBy("page_id").agg(F.array_sort(F.collect_list(pair)).alias("_pairs"))
    replaced = F.aggregate("_pairs", F.col("html"), lambda page, p: F.replace(page, p["ref"], p["new"]))
    return pages.join(pairs, "page_id", "left").withColumn(
        "html", F.when(F.col("_pairs").isNull(), F.col("html")).otherwise(replaced)
    ).select(*pages.columns)


def url_policy(links: DataFrame, placeholder: str = "blank.png", block_external: bool = False) -> DataFrame:
    """Add ``verdict, safe_url`` to links ``attr, url``.

    Verdicts: empty, invalid (8-bit or control characters), keep, blocked (external or without a path), scheme
    (not allowed), relative. All but keep are replaced.
    """
    url = F.col("_url")
    # The schemes allowed, external or not.
    external = F.col("_scheme").isin("mailto", "http", "https", "ftp")
    internal = F.col("_scheme").isin("outbind", "cid")
    path = F.regexp_extract(url, r"^[^:]*:(?://[^/?#]*)?([^?#]*)", 1)
    href = F.lower("attr") == "href"
    verdict = (
        F.when(url == "", "empty")
        .when(url.rlike(r"[\x00-\x1F]") | (F.octet_length(url) != F.length(url)), "invalid")
        .when(external & (href | (F.lit(not block_external) & (path != ""))), "keep")
        .when(external, "blocked")
        .when(internal, "keep")
        .when(F.col("_scheme") != "", "scheme")
        .when(url == placeholder, "keep")
        .otherwise("relative")
    )
    raw = trimmed(F.col("url"))
    quoted = (F.length(raw) > 1) & F.left(raw, F.lit(1)).isin('"', "'")
    return (
        links.withColumn("_url", F.when(quoted, trimmed(F.substr(raw, F.lit(2), F.length(raw) - 2))).otherwise(raw))
        .withColumn("_scheme", F.lower(F.regexp_extract("_url", r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)))
        .withColumn("verdict", verdict)
        .withColumn(
            "safe_url",
            F.when(F.col("verdict") == "keep", url)
            .when((F.col("verdict") == "invalid") & href, INVALID_LINK)
            .otherwise(F.lit(placeholder)),
        )
        .drop("_url", "_scheme")
    )


def tags(pages: DataFrame, column: str = "html") -> DataFrame:
    """One row per tag: ``page_id, pos, tag, name, kind``. Comments are no tags, and hide what they hold."""
    found = pages.filter(F.instr(column, "<") > 0).select(
        "page_id", F.posexplode(h.tag_texts(F.col(column))).alias("pos", "tag")
    )
    return found.withColumn("pos", F.col("pos").cast("bigint")).withColumn("name", h.tag_name(F.col("tag"))).withColumn(
        "kind", h.tag_kind(F.col("tag"), F.col("name"))
    )


def tag_attributes(tag_rows: DataFrame) -> DataFrame:
    """One row per attribute of an opening tag: ``page_id, pos, name, attr, value`` (value without its quotes)."""
    inside = F.regexp_replace("tag", r"(?s)^<[A-Za-z][\w-]*|/?>$", "")
    rows = tag_rows.filter("kind <> 'close'").select(
        "page_id", "pos", "name", F.explode(F.regexp_extract_all(inside, F.lit(h.ATTRIBUTE), F.lit(0))).alias("_text")
    )
    value = F.regexp_replace("_text", r"(?s)^[\w-]+(?:\s*=\s*)?", "")
    return rows.select(
        "page_id",
        "pos",
        "name",
        F.lower(F.regexp_extract("_text", r"^[\w-]+", 0)).alias("attr"),
        F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2").alias("value"),
    )


def _attribute_rule(text: Column) -> Column:
    """(rule, name) of one attribute; a null rule where it may stay."""
    value = F.regexp_replace(F.regexp_replace(text, r"(?s)^[\w-]+(?:\s*=\s*)?", ""), r"""(?s)^(["'])(.*)\1$""", "$2")
    checked = h.unspaced(h.defanged(value))

    def judged(name: Column) -> Column:
        rule = (
            F.when(name.rlike(h.REMOVED_ATTRIBUTES), "removed_attribute")
            .when(name.rlike("^src|background|^href|action") & checked.rlike(h.BAD_LINK), "script_value")
            .when(name.startswith("style") & checked.rlike(h.BAD_STYLE), "style_value")
        )
        return F.struct(rule.alias("rule"), name.alias("name"))

    return h.bound(F.lower(F.regexp_extract(text, r"^[\w-]+", 0)), judged)


def policy_violations(pages: DataFrame, column: str = "html") -> DataFrame:
    """``page_id, rule, name, n``: what the policy would take out of each page.

    Rules: removed_tag, removed_with_content, removed_attribute, script_value (script, mocha or about links) and
    style_value. What stands inside an element that goes with its content is not counted. One pass over the pages.
    """
    name, tag = h.tag_name(F.col("tag")), F.col("tag")
    tag_rule = F.when(F.col("name").isin(*h.REMOVED_TAGS), "removed_tag").when(
        F.col("name").isin(*h.REMOVED_WITH_CONTENT) & ~tag.endswith("/>"), "removed_with_content"
    )
    inside = F.regexp_replace(tag, r"(?s)^<[A-Za-z][\w-]*|/?>$", "")
    attributes = F.transform(F.regexp_extract_all(inside, F.lit(h.ATTRIBUTE), F.lit(0)), _attribute_rule)
    rules = F.when(tag_rule.isNotNull(), F.array(F.struct(tag_rule.alias("rule"), F.col("name")))).when(
        inside.rlike(r"\w"), F.filter(attributes, lambda a: a["rule"].isNotNull())
    )
    return (
        pages.filter(F.instr(column, "<") > 0)
        .select("page_id", F.explode(h.audited_tags(F.col(column))).alias("tag"))
        .filter(~tag.startswith("</"))
        .withColumn("name", name)
        .select("page_id", F.explode(rules).alias("_rule"))
        .groupBy("page_id", F.col("_rule.rule").alias("rule"), F.col("_rule.name").alias("name"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _kept_tags(html: Column) -> Column:
    """Array of (name, kind) of the tags that stay, body as div."""
    found = F.transform(h.tag_texts(h.audited(html)), lambda t: F.struct(t.alias("tag"), h.tag_name(t).alias("name")))
    gone = (*h.REMOVED_TAGS, *h.REMOVED_WITH_CONTENT)
    stay = F.filter(found, lambda t: ~t["name"].isin(*gone) | t["tag"].endswith("/>"))
    return F.transform(
        stay,
        lambda t: F.struct(
            F.when(t["name"] == "body", "div").otherwise(t["name"]).alias("name"), h.tag_kind(t["tag"], t["name"]).alias("kind")
        ),
    )


def tag_balance(pages: DataFrame, column: str = "html") -> DataFrame:
    """``page_id, name, dropped, left_open``: closers without an opener, and openers never closed, where there are any.

    Counted inside each page's own row, so no tag is shuffled: one sort of its tags by name, one fold over them.
    """
    paired = F.filter(_kept_tags(F.col(column)), lambda t: t["kind"] != "self")
    return (
        pages.filter(F.instr(column, "<") > 0)
        .select("page_id", F.explode(h.name_totals(h.balance(paired))).alias("_t"))
        .select("page_id", "_t.name", F.col("_t.dropped").cast("bigint").alias("dropped"), F.col("_t.open").cast("bigint").alias("left_open"))
        .filter("dropped > 0 or left_open > 0")
    )
