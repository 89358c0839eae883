"""Texts made to break a rule: none may stop a task, and no script may get through."""

import re

import pytest
from pyspark.sql import functions as F

from postmill.functions.address import is_address
from postmill.operators import content as con
from postmill.operators import pages as pag
from postmill.operators.sanitise import sanitize_pages

MANY = 100_000
SCRIPTS = [
    "<scr<script>x</script>ipt>alert(1)</script>", "<scr<!---->ipt>alert(1)</script>", "<script/src=//evil.example/x.js>",
    "<script src=x />", '<a href="javascript&colon;alert(1)">x</a>', '<a href="java&Tab;script&colon;alert(1)">x</a>',
    "<<script>script>alert(1)<</script>/script>", "<img src=x onerror=alert(1)>", "<a/onclick=alert(1)>x</a>", "<SCRIPT\n>alert(1)</SCRIPT >",
    # What another reading of the page would take for markup: styles in svg and math, and elements whose content is raw text.
    "<svg><style><img src=x onerror=alert(1)></style></svg>", "<math><style><a href=javascript:alert(1)>x</a></style></math>",
    "<svg></p><style><a title='</style><img src onerror=alert(1)>'></style>", '<noscript><p title="</noscript><img src=x onerror=alert(1)>">',
    '<textarea><p title="</textarea><script>alert(1)</script>"></textarea>', '<title><p title="</title><img src=x onerror=alert(1)>"></title>',
    "<svg><a><animate attributeName=href values='javascript:alert(1)' to='javascript:alert(2)' /></a></svg>",
    "<style><!-- </style><img src=x onerror=alert(1)> --></style>", "<svg><style>&lt;img src=x onerror=alert(1)&gt; expression</style></svg>",
    "<noembed><img alt='</noembed><iframe onload=alert(1)>'></noembed>", "<math><mtext><table><mglyph><style><img src onerror=alert(1)>",
    '<a href="&#106;avascript:alert(1)">x</a>', "<xmp><script>1</script></xmp><script>2",
]


@pytest.mark.parametrize("pattern", ["html5", "pcre", "noregex"])
def test_addresses(spark, pattern):
    texts = ["a@b" + ".c" * MANY, "a" * MANY + "@b.c", "a@" + "b-" * MANY, '"' * MANY + "@b", "a@b.c"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    assert rows.filter(is_address(F.col("t"), pattern) & (F.length("t") < 10)).count() == 1


def test_pages(spark):
    texts = ["<b " + "it's " * MANY, "<b " + "x='1' " * MANY + ">t</b>", "<" * MANY, "<a " + 'x="' * MANY, "<b>" * MANY + "</b>" * 20, "".join(f"<a{k}>" for k in range(MANY)), "</i>" * MANY,
             "<svg>" + "<style>a</style>" * MANY + "</svg>"]
    pages = spark.createDataFrame(list(enumerate(texts)), "page_id bigint, html string").repartition(2)
    assert pag.html_to_text(pages).filter("text is not null").count() == len(texts)
    assert pag.policy_violations(pages).count() == 0
    balance = pag.tag_balance(pages).filter("page_id > 3").groupBy("page_id").agg(F.count("*"), F.sum("dropped"), F.sum("left_open"))
    assert {tuple(r) for r in balance.collect()} == {(4, 1, 0, MANY - 20), (5, MANY, 0, MANY), (6, 1, MANY, 0)}
    safe = {r.page_id: (r.n_dropped, r.n_closed) for r in sanitize_pages(pages).filter("html is not null").select("page_id", "n_dropped", "n_closed").collect()}
    assert len(safe) == len(texts) and (safe[4], safe[5], safe[6]) == ((0, MANY - 20), (0, MANY), (MANY, 0))


def test_no_script_gets_through(spark):
    """Every < of a safe page opens a tag that was printed, without < or > in its values, or stands before white space; the content
    of a style holds none. So no reading of the page, whatever elements it takes to be open, finds other tags."""
    pages = spark.createDataFrame(list(enumerate(SCRIPTS)), "page_id bigint, html string")
    for r in sanitize_pages(pages).collect():
        shown, given = r.html.lower(), SCRIPTS[r.page_id]
        bare = re.sub(r"<style>(?:[^<]|<!-- [^<>]* -->)*</style>", "", shown)
        tags = re.findall(r"""</?[a-z][\w-]*(?: [\w-]+=(?:"[^"<>]*"|'[^'<>]*'))*(?: /)?>""", bare)
        assert len(tags) == len(re.findall(r"<(?!\s)", bare)), (given, r.html)
        assert not any(t.startswith(("<script", "</script")) for t in tags), (given, r.html)
        names = [re.findall(r" ([\w-]+)=", re.sub(r""""[^"]*"|'[^']*'""", "", t)) for t in tags]
        assert not any(n.startswith("on") for n in sum(names, [])), (given, r.html)
        assert not any(re.search(r"""\s(?:href|values|to)=["']?[^"']*script:""", t) for t in tags), (given, r.html)


def test_audit_reads_styles_in_foreign_elements(spark):
    rows = ["<svg><style><img src=x onerror=alert(1)></style></svg>", "<svg></svg><style><img src=x onerror=alert(1)></style>",
            "<svg/><style><script></style>", "<math><svg></svg><style><a href=javascript:x></style>", "<svg><!-- </svg> --><style><base></style>"]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id bigint, html string")
    found = {(r.page_id, r.rule, r.name, r.n) for r in pag.policy_violations(pages).collect()}
    assert found == {(0, "removed_attribute", "onerror", 1), (3, "script_value", "href", 1), (4, "removed_tag", "base", 1)}


def test_long_lines(spark):
    """Lines of a megabyte are wrapped and split for the wire as a plain walk over them does."""
    texts = ["abc defgh " * 100_000, "x" * 1_000_000, " " * 5000 + "a  b " * 3000, ("y" * 997 + " ") * 5 + "z" * 999, "é" * 3000 + " " + "w" * 998]
    rows = spark.createDataFrame(list(enumerate(texts)), "message_id bigint, body string")
    wrapped = {i: [] for i in range(len(texts))}
    for r in con.reflow(rows, 72).orderBy("message_id", "line_no").collect():
        wrapped[r.message_id].append(r.line)
    audit = {r.message_id: (r.n_soft, r.n_hard) for r in con.wire_line_audit(rows).collect()}
    for i, text in enumerate(texts):
        lines, words = [], text.split(" ")
        now = words[0]
        for word in words[1:]:
            if now and len(now.encode()) + 1 + len(word.encode()) > 72:
                lines.append(now)
                now = word
            else:
                now += " " + word
        assert wrapped[i] == [*lines, now], i
        line, at, soft, hard = text.encode(), 0, 0, 0
        while len(line) - at > 998:
            space = line.rfind(b" ", at, at + 998) - at
            at, soft, hard = (at + space + 1, soft + 1, hard) if space > 0 else (at + 997, soft, hard + 1)
        assert audit[i] == (soft, hard), i
