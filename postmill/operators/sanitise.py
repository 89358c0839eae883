"""A page corpus made safe to show. Every page is worked on inside its own row: no shuffle, no Python."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import html as h
from postmill.functions.text import has_8bit

# What stands in for forbidden style words, values and blocks.
DEFUSED = "idiocy"
STYLE_REMOVED = "<!-- style block removed by html filter due to presence of 8bit characters -->"
IMPORT_REMOVED = "\n<!-- @import rules forbidden -->\n"

OWN_COMMENTS = "|".join(re.escape(c.strip()[1:]) for c in (STYLE_REMOVED, IMPORT_REMOVED))

TOKEN = rf"(?is){h.STYLE}|(?-i:{h.TAG})|(?:[^<]++|<(?=\s))++|<"


def _chain(value: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        value = F.regexp_replace(value, pattern, replacement)
    return value


def _foreign_url(block_external: bool) -> str:
    """A style url whose address may not stay: no scheme or one that is not allowed."""
    schemes = "outbind|cid" if block_external else "https?|ftp|mailto|outbind|cid"
    return rf"(?is)url\s*\(\s*[\"']?(?!(?:{schemes}):)[^)]*\)"


def _without_markup(value: Column) -> Column:
    """A value in which no browser finds a tag, whatever element it takes to be open around it."""
    return F.replace(F.replace(value, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _safe_attribute(attr: Column, placeholder: str, block_external: bool) -> Column:
    """``name=value`` as printed, quotes included."""
    name, given = attr["name"], attr["value"]
    script = r"(?is)^([\"'])(?:\S+script:|mocha:*|about:).*([\"'])"
    outside = r"(?is)^([\"'])https*:.*([\"'])"
    style_rules = [
        (r"/\*.*\*/", ""),
        (r"(?i)expression|binding|behaviou*r|include-source|position:", DEFUSED),
        (r"(?i)\\?u\\?r\\?l\\?", "url"),
        (_foreign_url(block_external), f"url({placeholder})"),
    ]

    def source(checked: Column) -> Column:
        safe = F.regexp_replace(checked, script, f"$1{placeholder}$2")
        return F.regexp_replace(safe, outside, f"$1{placeholder}$1") if block_external else safe

    def style(decoded: Column) -> Column:
        # A style value that only reads well once decoded is hiding something.
        start = F.when(decoded != given, DEFUSED).otherwise(h.unspaced(decoded))
        return h.bound(
            _chain(start, style_rules),
            lambda v: F.when(v.rlike(r"[\x00-\x1F]") | has_8bit(v), '"disallowed character"').otherwise(v),
        )

    def printed(decoded: Column) -> Column:
        checked = h.unspaced(decoded)
        fixed = (
            F.when(name.rlike("^src|background"), source(checked))
            .when(name.rlike("^href|action|^(?:values|to|from|by)$"), F.regexp_replace(checked, script, "$1#$1"))
            .when(name.startswith("style"), style(decoded))
            .otherwise(checked)
        )
        # The tests run on decoded text; a value that passed them is printed as it was given.
        return h.bound(fixed, lambda v: F.when(v == checked, given).otherwise(v))

    return F.concat(name, F.lit("="), _without_markup(h.bound(h.defanged(given), printed)))


def _attributes(tag: Column, name: Column, placeholder: str, block_external: bool) -> Column:
    inside = F.regexp_replace(tag, r"(?s)^<[A-Za-z][\w-]*|/?>$", "")
    texts = F.regexp_extract_all(inside, F.lit(h.ATTRIBUTE), F.lit(0))

    def pair(text: Column) -> Column:
        value = F.regexp_replace(text, r"(?s)^[\w-]+(?:\s*=\s*)?", "")
        bare = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit("&quot;")), F.lit('"'))
        quoted = F.when(~F.contains(text, F.lit("=")), '"yes"').when(value.rlike("^[\"']"), value).otherwise(bare)
        return F.struct(F.lower(F.regexp_extract(text, r"^[\w-]+", 0)).alias("name"), quoted.alias("value"))

    pairs = F.transform(texts, pair)
    stay = F.filter(pairs, lambda a: ~a["name"].rlike(h.REMOVED_ATTRIBUTES) & ~((name == "a") & (a["name"] == "target")))
    printed = F.transform(stay, lambda a: _safe_attribute(a, placeholder, block_external))
    return F.when(name == "body", _body_attributes(pairs, placeholder)).otherwise(
        F.when(name == "a", F.concat(printed, F.array(F.lit('target="_blank"')))).otherwise(printed)
    )


def _body_attributes(pairs: Column, placeholder: str) -> Column:
    """A body becomes a div; its colours and background become a style."""

    def value(name: str) -> Column:
        found = F.get(F.filter(pairs, lambda a: a["name"] == name), F.lit(0))["value"]
        return F.translate(found, "\"'", "")

    back, text = value("bgcolor"), value("text")
    style = F.concat_ws(
        "",
        F.when(value("background").isNotNull(), f"background-image: url('{placeholder}'); "),
        F.concat(F.lit("background-color: "), back, F.lit("; ")),
        F.when(text.isNotNull(), F.concat(F.lit("color: "), text, F.lit("; "))).when(back.isNotNull(), "color: #000000; "),
    )
    mark = F.array(F.lit("class='bodyclass'"))
    return F.when(style == "", mark).otherwise(F.concat(mark, F.array(F.concat(F.lit('style="'), style, F.lit('"')))))


def _safe_style(block: Column, placeholder: str, block_external: bool) -> Column:
    """A whole style element with its rules made safe."""
    content = F.regexp_replace(block, r"(?is)^<style(?:\s[^>]*)?>|</\s*style\s*>\z|<!--.*?(?:-->|\z)", "")
    content = F.regexp_replace(content, r"(?is)body(\s*\{.*?\})", ".bodyclass$1")

    def safe(text: Column) -> Column:
        return _chain(
            text,
            [
                (r"(?im)^\s*@import.*$", IMPORT_REMOVED),
                (r"(?i)\\?u\\?r\\?l\\?", "url"),
                (_foreign_url(block_external), f"url({placeholder})"),
            ],
        )

    def checked(text: Column) -> Column:
        return _chain(
            text,
            [
                (r"/\*.*\*/", ""),
                (r"(?i)expression|behaviou*r|binding|include-source|javascript|script", DEFUSED),
                (r"(?i)position", ""),
            ],
        )

    def rules(text: Column) -> Column:
        seen = h.bound(h.unspaced(h.defanged(text)), lambda v: F.struct(v.alias("seen"), checked(v).alias("checked")))
        return h.bound(seen, lambda v: F.when(v["checked"] == v["seen"], text).otherwise(v["checked"]))

    forbidden = r"[\x0E-\x1F]"
    body = h.bound(
        content,
        lambda c: F.when(c.rlike(forbidden) | has_8bit(c), STYLE_REMOVED).otherwise(h.bound(safe(c), rules)),
    )
    # Inside svg and math a browser reads rules as markup, so none of them may hold a <; in a rule, its escape means the same.
    return F.concat(F.lit("<style>"), F.regexp_replace(body, rf"<(?!{OWN_COMMENTS})", r"\\3C "), F.lit("</style>"))


def _balanced(items: Column) -> Column:
    """(html, n_dropped, n_closed) of a page's printed tokens: surplus closers left out, missing ones added in the order of
    their openers."""

    def paired(i: Column) -> Column:
        return i["kind"].isin("open", "close")

    def result(both: Column) -> Column:
        all_, states = both["items"], both["states"]
        pairs = F.filter(F.transform(all_, lambda i, k: F.struct(i["kind"].alias("kind"), k.alias("k"))), paired)
        surplus = h.bound(pairs, lambda p: F.transform(F.filter(states, lambda s: s["surplus"]), lambda s: F.get(p, s["pos"])["k"]))
        open_ = F.array_sort(F.transform(
            F.filter(h.name_totals(states), lambda s: s["open"] > 0), lambda s: F.struct(s["first"].alias("first"), s["name"].alias("name"), s["open"].alias("open"))
        ))

        def joined(found: Column) -> Column:
            every = F.transform(all_, lambda _, k: k)
            texts = F.transform(F.array_except(every, found["surplus"]), lambda k: F.get(all_, k)["text"])
            closers = F.transform(found["open"], lambda c: F.repeat(F.concat(F.lit("</"), c["name"], F.lit(">")), c["open"]))
            n_closed = F.aggregate(found["open"], F.lit(0).cast("bigint"), lambda n, c: n + c["open"])
            return F.struct(
                F.concat(F.array_join(texts, ""), F.array_join(closers, ""), F.lit("\n")).alias("html"),
                F.size(found["surplus"]).cast("bigint").alias("n_dropped"), n_closed.alias("n_closed"),
            )

        return h.bound(F.struct(surplus.alias("surplus"), open_.alias("open")), joined)

    return h.bound(
        items, lambda all_: h.bound(F.struct(all_.alias("items"), h.balance(F.filter(all_, paired)).alias("states")), result)
    )


def sanitize_pages(
    pages: DataFrame, placeholder: str = "blank.png", block_external: bool = False, column: str = "html"
) -> DataFrame:
    """``page_id, html, n_dropped, n_closed``: each page made safe, with the closers dropped and added in balancing it."""
    start = F.regexp_replace(F.col(column), r"(?is)&(\{.*?\};)", "&amp;$1")
    body = F.regexp_replace(start, f"(?is){h.COMMENT}|<![^>]*>|{h.WITH_CONTENT}|({h.STYLE})", "$3")
    tokens = F.regexp_extract_all(body, F.lit(TOKEN), F.lit(0))

    def item(token: Column, pos: Column) -> Column:
        is_style = token.rlike(r"(?i)^<style[\s>]")
        is_tag = token.rlike("^</?[A-Za-z]") & ~is_style
        return h.bound(
            F.when(is_tag, h.tag_name(token)).otherwise(""),
            lambda name: F.struct(
                token.alias("token"), pos.alias("pos"), is_style.alias("style"), name.alias("name"),
                F.when(name != "", h.tag_kind(token, name)).otherwise("text").alias("kind"),
            ),
        )

    def printed(i: Column) -> Column:
        shown = F.when(i["name"] == "body", "div").otherwise(i["name"])
        attributes = h.bound(
            F.array_join(_attributes(i["token"], i["name"], placeholder, block_external), " "),
            lambda a: F.when(a == "", "").otherwise(F.concat(F.lit(" "), a)),
        )
        opening = F.concat(F.lit("<"), shown, attributes, F.when(i["kind"] == "self", " />").otherwise(">"))
        bare = F.concat(F.lit("<"), shown, F.lit(">"))
        has_attributes = i["token"].rlike(r"[\s/]") | (i["name"] == "body")
        text = (
            F.when(i["style"], _safe_style(i["token"], placeholder, block_external))
            # A < without white space behind it could make a tag with what follows once something between the two is gone.
            .when(i["kind"] == "text", F.when(i["token"] == "<", "&lt;").otherwise(i["token"]))
            .when(i["kind"] == "close", F.concat(F.lit("</"), shown, F.lit(">")))
            .when(has_attributes | (i["kind"] == "self") | (i["name"] == "a"), opening)
            .otherwise(bare)
        )
        return F.struct(i["pos"].alias("pos"), shown.alias("name"), i["kind"].alias("kind"), text.alias("text"))

    # What goes with its content goes here once more: taking out an element can leave the tags of another.
    gone = (*h.REMOVED_TAGS, *h.REMOVED_WITH_CONTENT)
    kept = F.filter(F.transform(tokens, item), lambda i: ~i["name"].isin(*gone))
    return pages.select("page_id", h.bound(F.transform(kept, printed), _balanced).alias("_safe")).select(
        "page_id", "_safe.html", "_safe.n_dropped", "_safe.n_closed"
    )
