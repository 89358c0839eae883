from postmill.operators import replies as rep
from postmill.operators.catalogue import latest_translations, localise, translation_coverage


def parsed(spark, *replies):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, reply string")
    return [(r.code, r.code_ex, r.detail) for r in rep.parse_replies(df).orderBy("i").collect()]


def test_parse(spark):
    assert parsed(
        spark, "250 ok", "550-5.1.1 no such\n550 5.1.1 user", "250-first\n250 last", "550-5.1.1 a\n550 plain", "odd reply", "250", "354-\n354 go"
    ) == [
        (250, None, "ok"), (550, "5.1.1", "no such\nuser"), (250, None, "first\nlast"), (550, "5.1.1", "a\n550 plain"),
        (None, None, "reply"), (250, None, ""), (354, None, "\ngo"),
    ]


def test_replies_end_at_a_space(spark):
    lines = ["220 hi", "250-a", "250-b", "250 c", "354-x"]
    df = spark.createDataFrame([(1, i, line, "X") for i, line in enumerate(lines)], "session_id bigint, line_no bigint, line string, command string")
    got = [(r.reply_no, r.reply) for r in rep.assemble_replies(df).orderBy("reply_no").collect()]
    assert got == [(0, "220 hi"), (1, "250-a\n250-b\n250 c"), (2, "354-x")]


def test_expected_codes(spark):
    df = spark.createDataFrame([("RCPT TO", 251), ("RCPT TO", 550), ("DATA", 250), ("Username", 235), ("QUIT", 221), ("QUIT", None)], "command string, code bigint")
    assert sorted((r.command, r.code) for r in rep.unexpected_replies(df).collect() if r.code) == [("DATA", 250), ("RCPT TO", 550)]
    own = spark.createDataFrame([("QUIT", 250)], "command string, code bigint")
    assert rep.unexpected_replies(df, own).count() == 6


def test_capabilities(spark):
    reply = "250-mx.example hello\n250-SIZE\n250-AUTH PLAIN CRAM-MD5\n250-SIZE 99\n250- \n250 8BITMIME"
    df = spark.createDataFrame([("a", "EHLO", reply), ("b", "HELO", "250 b.example")], "server string, command string, reply string")
    caps = rep.server_caps(rep.capabilities(df)).orderBy("server").collect()
    assert caps[0].caps == {"EHLO": ["mx.example"], "SIZE": ["99"], "AUTH": ["PLAIN", "CRAM-MD5"], "8BITMIME": ["true"]}
    assert caps[0].auth == "CRAM-MD5" and caps[1].caps == {"HELO": ["b.example"]} and caps[1].auth is None


def test_outcomes(spark):
    rows = [(1, 1, "a", True, ""), (2, 1, "a", True, ""), (2, 2, "b", False, "no"), (2, 3, "c", False, "never"), (3, 1, "d", False, "x")]
    df = spark.createDataFrame(rows, "message_id bigint, attempt int, address string, accepted boolean, detail string")
    got = {r.message_id: (r.n_accepted, r.n_rejected, r.data_sent, r.status) for r in rep.send_outcome(df).collect()}
    assert got == {1: (1, 0, True, "sent"), 2: (1, 2, True, "partial"), 3: (0, 1, False, "failed")}
    assert {r.message_id: r.failures for r in rep.failure_texts(df, ["attempt"]).collect()} == {2: "b: noc: never", 3: "d: x"}


def test_relays(spark):
    rows = [(1, 1, "bad host", True, ""), (1, 2, "tls://a.example:587", False, "e1"), (1, 3, "b.example", True, ""), (1, 4, "c.example", False, "late"),
            (2, 1, "a.example", False, "e1"), (2, 2, "b.example", False, "e2"), (2, 3, "not a host", False, "e3"), (3, 1, "no host", True, "")]
    df = spark.createDataFrame(rows, "message_id bigint, attempt int, host string, ok boolean, error string")
    got = {r.message_id: (r.connected, r.host, r.error) for r in rep.relay_attempts(df, ["attempt"]).collect()}
    assert got == {1: (True, "b.example", None), 2: (False, None, "e2"), 3: (False, None, None)}


def test_texts_fall_back(spark):
    lines = [("en", 1, "a", "A"), ("en", 2, "smtp_connect_failed", "No connection."), ("fr", 1, "a", "old"), ("fr", 2, "a", "le A"), ("fr", 3, "more", "x"), ("de", 1, "a", "das A"),
             ("de", 2, "smtp_connect_failed", "Nein.")]
    texts = latest_translations(spark.createDataFrame(lines, "lang string, line_no bigint, message_key string, message string"))
    errors = spark.createDataFrame([(1, "fr", "a"), (2, "fr", "smtp_connect_failed"), (3, "xx", "a"), (4, "de", "unheard of"), (5, "de", "smtp_connect_failed")], "i int, lang string, message_key string")
    got = [r.text for r in localise(errors, texts, help_text=" Help!").orderBy("i").collect()]
    assert got == ["le A", "No connection. Help!", "A", "unheard of", "Nein. Help!"]
    assert sorted(map(tuple, translation_coverage(texts).collect())) == [("fr", "more", "extra"), ("fr", "smtp_connect_failed", "missing")]
