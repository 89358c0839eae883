import pytest
from pyspark.sql import functions as F

from postmill.functions.address import is_address
from postmill.functions.headers import encoded_words, encoding_scheme, phrase
from postmill.operators import recipients as rec

COLUMNS = "message_id bigint, kind_rank int, kind string, seq bigint, t1 bigint, t2 bigint, address string, name string"


def table(spark, *rows):
    rank = {"to": 0, "cc": 1, "bcc": 2, "Reply-To": 3}
    full = [(1, 0, kind, i, 0, 0, address, name) for i, (kind, address, name) in enumerate(rows)]
    assert all(k in rank for k, _, _ in rows)
    return spark.createDataFrame(full, COLUMNS)


def verdicts(spark, pattern, addresses):
    df = spark.createDataFrame([(a,) for a in addresses], "address string")
    rows = df.select("address", is_address(F.col("address"), pattern).alias("ok")).collect()
    return {r.address: r.ok for r in rows}


def test_patterns_differ_on_quotes_literals_and_dots(spark):
    cases = ["a@b.example", "a@b.example.", "a@b..example", '"a b"@c.example', "a@[127.0.0.1]", "a@[IPv6:::1]", "a.@b.example",
             "bad", "@b.example", "a@", "x" * 65 + "@b.example", "a@b\n.example", "a@" + "l" * 64 + ".example", "", "é@b.example"]
    html5 = verdicts(spark, "html5", cases)
    pcre = verdicts(spark, "pcre", cases)
    rough = verdicts(spark, "noregex", cases)
    assert {a for a in cases if html5[a]} == {"a@b.example", "a.@b.example", "x" * 65 + "@b.example"}
    assert {a for a in cases if pcre[a]} == {"a@b.example", '"a b"@c.example', "a@[127.0.0.1]", "a@[IPv6:::1]"}
    assert not any(rough[a] for a in ("bad", "@b.example", "a@", "a@b\n.example", ""))
    assert rough["a@b..example"] and rough["é@b.example"]


def test_unknown_pattern():
    with pytest.raises(ValueError):
        is_address(F.lit("a"), "other")


def test_first_use_wins_across_kinds_and_reply_to_is_apart(spark):
    added = table(
        spark, ("to", "", ""), ("to", "a@example..com", ""), ("to", " a@example.com ", "A\r\nB "), ("to", "A@example.com", ""),
        ("cc", "b@example.com", ""), ("cc", "a@example.com", ""), ("bcc", "B@Example.com", ""), ("bcc", "c@example.com", ""),
        ("Reply-To", "a@example.com", ""), ("Reply-To", "a@EXAMPLE.com", ""),
    )
    kept = [(r.kind, r.address, r.name) for r in rec.accepted_recipients(added).orderBy("seq").collect()]
    assert kept == [
        ("to", "a@example.com", "AB"), ("cc", "b@example.com", ""), ("bcc", "c@example.com", ""), ("Reply-To", "a@example.com", "")
    ]
    reasons = {(r.reason, r.domain): r.n for r in rec.reject_reasons(added).collect()}
    assert reasons == {
        ("invalid_address", ""): 1, ("invalid_address", "example..com"): 1, ("duplicate", "example.com"): 4
    }


def test_every_row_is_kept_refused_or_a_duplicate_and_dedup_is_idempotent(spark, small):
    from postmill.plans.views import view

    added = view(spark, small, "raw_recipients")
    kept = rec.accepted_recipients(added)
    lost = rec.reject_reasons(added).agg(F.sum("n")).first()[0]
    assert kept.count() + lost == added.count()
    assert rec.dedup_reply_to(kept).exceptAll(kept).isEmpty() and rec.dedup_reply_to(kept).count() == kept.count()


def test_bad_kind_is_refused(spark):
    df = spark.createDataFrame([(1, 0, "from", 0, 0, 0, "a@example.com", "")], COLUMNS)
    assert rec.validate_addresses(df)[1].first().reason == "Invalid recipient kind"


def test_international_twins_are_one(spark):
    names = ["françois.ch", "françois.ch", "FRANÇOIS.CH", "FRANÇOIS.CH", "xn--franois-xxa.ch", "xn--franois-xxa.ch", "XN--FRANOIS-XXA.CH"]
    rows = [("to", f"test@{n}", "") for n in names] + [("Reply-To", f"test@{n}", "") for n in names]
    kept = rec.dedup_idn(table(spark, *rows)).orderBy("kind").collect()
    # The plain twin wins although it was added later.
    assert [(r.kind, r.address, r.seq) for r in kept] == [
        ("Reply-To", "test@xn--franois-xxa.ch", 11), ("to", "test@xn--franois-xxa.ch", 4)
    ]


def test_sharp_s(spark):
    assert rec.dedup_idn(table(spark, ("to", "x@straße.example", ""))).first().address == "x@strasse.example"


def test_headers(spark):
    df = table(spark, ("to", "foo@example.com", 'Tim "The Book" O\'Reilly'), ("to", "x@example.com", "0"), ("bcc", "b@example.com", ""))
    lines = {r.kind: r.header for r in rec.recipient_headers(df).collect()}
    assert lines == {"To": 'To: "Tim \\"The Book\\" O\'Reilly" <foo@example.com>, x@example.com'}
    shown = {r.kind: r.header for r in rec.recipient_headers(df, transport="qmail").collect()}
    assert shown["Bcc"] == "Bcc: b@example.com"
    hidden = rec.recipient_headers(table(spark, ("bcc", "b@example.com", ""))).collect()
    assert [r.header for r in hidden] == ["To: undisclosed-recipients:;"]


def test_phrases_escape_controls(spark):
    got = spark.range(1).select(phrase(F.lit('a\tb\\"\x01')).alias("p"), phrase(F.lit("O'Neil 3")).alias("q")).first()
    assert got.p == '"a\\tb\\\\\\"\\001"' and got.q == "O'Neil 3"


def test_encoded_words_round_trip_and_stay_short(spark):
    from email.header import decode_header, make_header

    texts = ["plain text", "Mañana", "飛兒樂 團光茫 " * 12, "a=b_c? é", "é" * 200]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", encoded_words()(F.col("t")).alias("e"), encoding_scheme(F.col("t")).alias("s")).collect()
    for r in rows:
        assert str(make_header(decode_header(r.e.replace("\r\n", "")))) == r.t
        assert all(len(word) <= 76 for word in r.e.split("\r\n"))
        assert {"none": "=?" not in r.e, "Q": "?Q?" in r.e, "B": "?B?" in r.e}[r.s]


def test_address_lists(spark):
    df = spark.createDataFrame(
        [(1, "Joe User <joe@example.com>, Jill User <jill@example.net>"), (2, "Tim \"The Book\" O'Reilly <foo@example.com>"),
         (3, "joe@example.com"), (4, "Joe User <joe@example.com.>, Jill User <jill.@example..net>")], "id int, addresses string")
    got = [(r.id, r.name, r.address) for r in rec.parse_address_lists(df).orderBy("id", "pos").collect()]
    assert got == [(1, "Joe User", "joe@example.com"), (1, "Jill User", "jill@example.net"), (2, "Tim The Book OReilly", "foo@example.com"),
                   (3, "", "joe@example.com")]


def test_suppression_keeps_reply_to(spark):
    df = table(spark, ("to", "a@example.com", ""), ("cc", "b@example.com", ""), ("Reply-To", "c@example.com", ""))
    assert [r.kind for r in rec.suppress(df).collect()] == ["Reply-To"]
    assert sorted(r.kind for r in rec.suppress(df, "cc").collect()) == ["Reply-To", "to"]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_domains_go_to_python_once(spark):
    """A filter below the Python call would call it again, and trim the address for each time it is named."""
    plan = plan_of(rec.accepted_recipients(table(spark, ("to", " a@b\u00fccher.example ", "n"))))
    assert plan.count("ArrowEvalPython") == 1


def test_addresses_are_trimmed_once_per_verdict(spark):
    source = table(spark, ("to", " a@x.example ", "n"))
    valid, refused = rec.validate_addresses(rec.clean_recipients(source.withColumn("address", F.lower("address"))), "noregex")
    assert plan_of(valid).count("lower(") == 1 and plan_of(refused).count("lower(") == 1
    assert valid.first().address == "a@x.example" and refused.isEmpty()
