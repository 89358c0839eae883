"""Patterns and column rules for HTML. All work on one page at a time, inside its row."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.arrays import bound, running

# Which tags are taken out, alone or with their content, which close themselves, which attributes go.
REMOVED_TAGS = ("object", "meta", "html", "head", "base", "link", "frame", "iframe", "plaintext", "marquee")
REMOVED_WITH_CONTENT = ("script", "applet", "embed", "title", "frameset", "xmp", "xml")
SELF_CLOSING = ("img", "br", "hr", "input", "outbind")
REMOVED_ATTRIBUTES = r"^(?:on|dynsrc|data|lowsrc)"

# Elements that hold no text of the page.
NOT_TEXT = ("head", "title", "style", "script")

# Link and style values that are never let through, tested without white space.
BAD_LINK = r"(?is)^\S+script:|^mocha|^about:"
BAD_STYLE = r"(?i)expression|binding|behaviou*r|include-source|position:"

# A comment, or a tag whose quoted attribute values may hold >.
COMMENT = r"<!--.*?(?:-->|\z)"
# Repeats of groups are possessive: the engine goes through them in a loop, where it would recurse once per repeat. Where quotes leave
# no tag, it ends at its first >.
TAG = r"""(?:</?[A-Za-z][^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+')?+[^>=]*+)*+>|</?[A-Za-z][^>]*+>)"""
ATTRIBUTE = r"""(?s)([\w-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?"""
STYLE = r"<style(?:\s[^>]*)?>.*?(?:</\s*style\s*>|\z)"
# An element that goes with its content; unclosed, it runs to the end of the page. Group 1 is its opening tag.
WITH_CONTENT = (
    "(<(" + "|".join(REMOVED_WITH_CONTENT) + r")(?:\s(?:[^>]*[^/>])?)?>).*?(?:</\2\s*>|\z)"
)
# What a browser takes for a tag when only the text is wanted: < and no white space, up to the next > outside quotes.
QUOTED = r"""(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z))"""
MARKUP = rf"""{COMMENT}|<(?:>|(?:[^\s>"']|{QUOTED})[^>"']*+(?:{QUOTED}[^>"']*+)*+(?:>|\z))"""


def element(names: Iterable[str], closed: str = r"</{name}>") -> str:
    """Pattern of whole elements, content included, one alternative per name."""
    return "(?is)" + "|".join(rf"<{n}[^>]*>.*?{closed.format(name=n)}" for n in names)


def audited(html: Column) -> Column:
    """The page as its tags are counted: no comments and style blocks, and of an element that goes with its content
    only the opening tag."""
    return F.regexp_replace(html, f"(?is){COMMENT}|{WITH_CONTENT}|{STYLE}", "$1")


# Elements whose content a browser reads by other rules: a style block inside them holds markup.
FOREIGN = r"(?i)^</?(?:svg|math)(?=[\s/>])"
CONTEXT_TOKEN = f"(?is){COMMENT}|{WITH_CONTENT}|{STYLE}|(?-i:{TAG})"


def audited_tags(html: Column) -> Column:
    """The tags the policy looks at, read as a browser would: style blocks are text, but markup inside svg and math.

    One fold over the page's tokens carries how many svg and math elements are open.
    """

    def step(state: Column, token: Column) -> Column:
        foreign = token.rlike(FOREIGN) & ~token.endswith("/>")
        depth = state["depth"] + F.when(~foreign, 0).when(token.startswith("</"), F.when(state["depth"] > 0, -1).otherwise(0)).otherwise(1)
        style = token.rlike(r"(?i)^<style[\s>]")
        opener = F.regexp_extract(token, f"(?is)^{WITH_CONTENT}", 1)
        shown = (
            F.when(token.startswith("<!--") | (style & (state["depth"] == 0)), F.array().cast("array<string>"))
            .when(style, F.regexp_extract_all(token, F.lit(f"(?s){TAG}"), F.lit(0)))
            .otherwise(F.array(F.when(opener != "", opener).otherwise(token)))
        )
        return F.struct(depth.alias("depth"), shown.alias("shown"))

    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("shown"))
    tokens = F.regexp_extract_all(html, F.lit(CONTEXT_TOKEN), F.lit(0))
    in_context = F.flatten(F.transform(running(tokens, start, step), lambda s: s["shown"]))
    return F.when(html.rlike(r"(?i)<(?:svg|math)[\s/>]"), in_context).otherwise(tag_texts(audited(html)))


def tag_texts(html: Column) -> Column:
    """Array of the page's tags, comments left out."""
    found = F.regexp_extract_all(html, F.lit(f"(?s){COMMENT}|{TAG}"), F.lit(0))
    return F.filter(found, lambda t: ~t.startswith("<!--"))


def tag_name(tag: Column) -> Column:
    return F.lower(F.regexp_extract(tag, r"^</?([A-Za-z][\w-]*)", 1))


def tag_kind(tag: Column, name: Column) -> Column:
    """close, self (written so, or a tag that always is) or open."""
    return (
        F.when(tag.startswith("</"), "close")
        .when(tag.endswith("/>") | name.isin(*SELF_CLOSING), "self")
        .otherwise("open")
    )


def balance(tags: Column) -> Column:
    """Openers and closers ``(name, kind)`` of a page, sorted by name and place, each with the state of its name.

    ``open``: openers not yet closed; ``dropped``: closers so far that had none; ``surplus``: whether this is one; ``pos``: its
    index in ``tags``; ``first``: that of the name's first opener.
    """
    placed = F.transform(tags, lambda t, k: F.struct(t["name"].alias("name"), k.alias("pos"), (t["kind"] == "open").alias("opens")))
    none, no = F.lit(None).cast("int"), F.lit(0)
    start = F.struct(
        F.lit("").alias("name"), no.alias("pos"), no.alias("open"), no.alias("dropped"), F.lit(False).alias("surplus"), none.alias("first")
    )

    def step(state: Column, tag: Column) -> Column:
        same = state["name"] == tag["name"]
        before = F.when(same, state["open"]).otherwise(0)
        surplus = ~tag["opens"] & (before == 0)
        return F.struct(
            tag["name"].alias("name"), tag["pos"].alias("pos"),
            (before + F.when(tag["opens"], 1).when(surplus, 0).otherwise(-1)).alias("open"),
            (F.when(same, state["dropped"]).otherwise(0) + surplus.cast("int")).alias("dropped"), surplus.alias("surplus"),
            F.coalesce(F.when(same, state["first"]), F.when(tag["opens"], tag["pos"])).alias("first"),
        )

    return running(F.array_sort(placed), start, step)


def name_totals(states: Column) -> Column:
    """The last state of each name."""
    return bound(states, lambda all_: F.filter(
        all_, lambda s, k: F.coalesce(F.get(all_, k + 1)["name"] != s["name"], F.lit(True))
    ))


def _named(value: Column) -> Column:
    """The named entities that can hide a scheme as characters."""
    for name, char in (("colon", ":"), ("tab", "\t"), ("newline", "\n"), ("lpar", "("), ("rpar", ")"), ("sol", "/"), ("bsol", r"\\")):
        value = F.regexp_replace(value, f"(?i)&{name};", char)
    return value


def _decoded_once(value: Column) -> Column:
    """Numeric entities and backslash escapes as characters; other text as it is."""
    pieces = F.regexp_extract_all(value, F.lit(r"(?i)&#[0-9]+;*|&#x[0-9a-f]+;*|\\[0-9]+|[^&\\]+|[&\\]"), F.lit(0))

    def literal(piece: Column) -> Column:
        digits = F.regexp_extract(piece, r"(?i)^(?:&#x?|\\)0*([0-9a-f]+);*$", 1)
        base16 = piece.rlike(r"(?i)^(?:&#x|\\)")
        number = F.when(base16, F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")
        coded = F.length(piece) > 1
        return F.when(
            coded & piece.rlike(r"(?i)^(?:&#[0-9]+;*|&#x[0-9a-f]+;*|\\[0-9]+)$"), F.coalesce(F.char(number), F.lit(""))
        ).otherwise(piece)

    return F.array_join(F.transform(pieces, literal), "")


def _defanged(value: Column) -> Column:
    digits = F.length(value) - F.length(F.translate(value, "0123456789abcdefABCDEF", ""))
    start = F.struct(value.alias("text"), F.lit(True).alias("more"))

    def decode(state: Column, _: Column) -> Column:
        text = state["text"]
        coded = text.rlike(r"(?i)&#[0-9]|&#x[0-9a-f]|\\[0-9]")
        decoded = bound(
            coded, lambda yes: F.struct(F.when(yes, _decoded_once(text)).otherwise(text).alias("text"), yes.alias("more"))
        )
        return F.when(state["more"], decoded).otherwise(state)

    decoded = F.aggregate(F.sequence(F.lit(0), digits), start, decode)["text"]
    hiding = value.contains("&") | value.contains("\\")
    return F.when(hiding, F.regexp_replace(decoded, r"(?s)\\(.?)", "$1")).otherwise(value)


def defanged(value: Column) -> Column:
    """Decode again and again until nothing is left to decode, then drop backslashes.

    Every decoding pass uses up more digits than it can bring forth, so their number bounds the passes; once a pass
    finds nothing, the rest only pass the text along.
    """
    return bound(F.when(value.contains("&"), _named(value)).otherwise(value), _defanged)


def unspaced(value: Column) -> Column:
    return F.translate(value, "\t\r\n\x00 ", "")
