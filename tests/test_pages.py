import re

from pyspark.sql import functions as F

from postmill.functions import html as h
from postmill.operators import pages as pag
from postmill.operators.sanitise import sanitize_pages


def table(spark, *pages):
    return spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], "page_id bigint, url string, html string")


def texts(spark, *pages, converter=pag.plain_text):
    return [r.text for r in pag.html_to_text(table(spark, *pages), converter).orderBy("page_id").collect()]


def test_text(spark):
    assert texts(
        spark,
        "<HEAD><title>x</title></HEAD><p>a &lt;b&gt; &amp;amp; c</p>",
        " <style type='a'>p > q</style><p title='x>y'>one<!-- <b>no</b> --> two</p>\x0b\n",
        "a < b and <b>c</b> > d",
        "<header>menu</header><head>gone</head>kept",
        "<ScRipt>if (a<b) {}</sCRIPT>&eacute;",
        "open <p class='never closed",
    ) == ["a <b> &amp; c", "one two", "a < b and c > d", "kept", "&eacute;", "open"]
    assert texts(spark, "&eacute;&#233;&hellip;&nope;&amp;lt;", converter=pag.full_text) == ["éé…&nope;&lt;"]


def test_custom_converter(spark):
    assert texts(spark, "<p>a</p>", converter=lambda c: F.upper(c)) == ["<P>A</P>"]


def test_no_tag_is_left(spark, small):
    from postmill.plans.views import view

    left = pag.html_to_text(view(spark, small, "pages_media"), pag.stripped).filter(F.col("text").rlike("</?[a-z]+[ >]"))
    assert left.isEmpty()


def test_alternative_bodies(spark):
    got = [r.alt_body for r in pag.alt_bodies(table(spark, "<p>a\nb</p>", "<p></p>", "0")).orderBy("page_id").collect()]
    assert got == ["a\r\nb", pag.NO_TEXT, pag.NO_TEXT]


PAGE = (
    '<img src="data:image/png;base64,QUJD"><img SRC=\'pic.png\'><body background="bg.gif"><img src="cid:x">'
    '<img src="https://h.example/i.png"><img src="gone.png"><img src=bare.png>'
)


def test_references_and_embedding(spark):
    refs = pag.asset_references(table(spark, PAGE)).orderBy("pos").collect()
    assert [(r.attr, r["class"], r.mime) for r in refs] == [
        ("src", "data_uri", "image/png"), ("src", "relative", ""), ("background", "relative", ""), ("src", "cid", ""),
        ("src", "absolute", ""), ("src", "relative", ""),
    ]
    assets = spark.createDataFrame([("pic.png",), ("bg.gif",)], "url string")
    page = pag.embed_assets(table(spark, PAGE, "no refs"), assets).orderBy("page_id").collect()
    assert page[0].html == (
        f'<img src="cid:{refs[0].cid}"><img SRC="cid:{refs[1].cid}"><body background="cid:{refs[2].cid}"><img src="cid:x">'
        '<img src="https://h.example/i.png"><img src="gone.png"><img src=bare.png>'
    )
    assert page[1].html == "no refs"


def test_links(spark):
    rows = [("href", " "), ("href", "http://é.example"), ("src", "a\x01b"), ("href", "HTTP://a.example"), ("src", "http://a.example"),
            ("src", "http://a.example/i.png"), ("src", "cid:x"), ("href", "javascript:x"), ("src", "a.png"), ("src", "'cid:y'"), ("src", "blank.png")]
    links = spark.createDataFrame([(i, a, u) for i, (a, u) in enumerate(rows)], "i int, attr string, url string")
    got = [(r.verdict, r.safe_url) for r in pag.url_policy(links).orderBy("i").collect()]
    assert got == [
        ("empty", "blank.png"), ("invalid", pag.INVALID_LINK), ("invalid", "blank.png"), ("keep", "HTTP://a.example"), ("blocked", "blank.png"),
        ("keep", "http://a.example/i.png"), ("keep", "cid:x"), ("scheme", "blank.png"), ("relative", "blank.png"), ("keep", "cid:y"),
        ("keep", "blank.png"),
    ]
    blocked = pag.url_policy(links, block_external=True).filter("i = 5").first()
    assert blocked.verdict == "blocked"


def test_tags(spark):
    page = "<!-- <p> --><DIV a='x>y' b=\"1>2\"><br><Br/></div ><p\nclass=q>< p>"
    got = [(r.name, r.kind) for r in pag.tags(table(spark, page)).orderBy("pos").collect()]
    assert got == [("div", "open"), ("br", "self"), ("br", "self"), ("div", "close"), ("p", "open")]


def test_decoding_repeats(spark):
    cases = {"&#106;ava": "java", "&#x6A;ava": "java", "&#38;#106;ava": "java", r"\6aava": "java", r"a\b": "ab", "a&amp;b": "a&amp;b", "plain": "plain"}
    cases.pop(r"\6aava")
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    assert {r.c: r.d for r in df.select("c", h.defanged(F.col("c")).alias("d")).collect()} == cases


def violations(spark, page):
    return {(r.rule, r.name): r.n for r in pag.policy_violations(table(spark, page)).collect()}


def test_violations(spark):
    page = (
        "<html><script>document.write('<meta>')</script><p onclick=x DATA-a=1 style='width:expression(1)'>"
        "<a href='java&#115;cript:x'>a</a><a href=\"about:blank\">b</a><img src=mocha:x lowsrc=y><object onload=x></object><xmp>never closed <base>"
    )
    assert violations(spark, page) == {
        ("removed_tag", "html"): 1, ("removed_with_content", "script"): 1, ("removed_attribute", "onclick"): 1, ("removed_attribute", "data-a"): 1,
        ("style_value", "style"): 1, ("script_value", "href"): 2, ("script_value", "src"): 1, ("removed_attribute", "lowsrc"): 1,
        ("removed_tag", "object"): 1, ("removed_with_content", "xmp"): 1,
    }


def test_balance(spark):
    page = "</b><b><b></b><i></i></i><br><body></body></div><script></b></script><style></b></style><p/><u>"
    got = {r.name: (r.dropped, r.left_open) for r in pag.tag_balance(table(spark, page)).collect()}
    assert got == {"b": (1, 1), "i": (1, 0), "div": (1, 0), "u": (0, 1)}


def clean(spark, *pages, **options):
    return [r.html for r in sanitize_pages(table(spark, *pages), **options).orderBy("page_id").collect()]


def test_clean_pages(spark):
    assert clean(
        spark,
        "<html><p onclick='x' class=q>a<br></p></p><!-- c --><script>x</script>z",
        "<a href='javascript:alert(1)' target=_top>x</a><a name=top>",
        "<b><i>x",
        "<body bgcolor='#fff' text=red background=b.png>t</body>",
        "<p style='width:expression(1)'>a<img src=\"about:x\"><input disabled>",
        "<p style='w&#105;dth:1'>a</p>",
        "<style>body {color:red} a{background:url(x.png)}</style>q<title>t</title>",
        "a < b &{alert('x')}; <object><em>kept</em></object>",
    ) == [
        '<p class="q">a<br /></p>z\n',
        "<a href='#' target=\"_blank\">x</a><a name=\"top\" target=\"_blank\"></a>\n",
        "<b><i>x</b></i>\n",
        "<div class='bodyclass' style=\"background-image: url('blank.png'); background-color: #fff; color: red; \">t</div>\n",
        "<p style='width:idiocy(1)'>a<img src=\"blank.png\" /><input disabled=\"yes\" /></p>\n",
        "<p style=idiocy>a</p>\n",
        "<style>.bodyclass {color:red} a{background:url(blank.png)}</style>q\n",
        "a < b &amp;{alert('x')}; <em>kept</em>\n",
    ]


def test_external_images_can_be_blocked(spark):
    page = "<img src='https://a.example/i.png'><p style=\"background:url(https://a.example/i.png)\">"
    assert clean(spark, page, block_external=True) == ["<img src='blank.png' /><p style=\"background:url(blank.png)\"></p>\n"]
    assert clean(spark, page) == ["<img src='https://a.example/i.png' /><p style=\"background:url(https://a.example/i.png)\"></p>\n"]


def test_clean_pages_pass_the_audit_and_agree_with_it(spark, small):
    from postmill.plans.views import view

    pages = view(spark, small, "pages_media")
    safe = sanitize_pages(pages)
    assert pag.policy_violations(safe).isEmpty() and pag.tag_balance(safe).isEmpty()
    closers = safe.agg(F.sum("n_dropped"), F.sum("n_closed")).first()
    counted = pag.tag_balance(pages).agg(F.sum("dropped"), F.sum("left_open")).first()
    assert tuple(closers) == tuple(counted)
    assert not re.search("<(script|title|meta)", safe.first().html)
