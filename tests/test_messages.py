from pyspark.sql import functions as F

from postmill.operators import attachments as att
from postmill.operators import content as con
from postmill.operators import messages as msg

BODY = "message_id bigint, body string, alt_body string, encoding string, charset string"


def encodings(spark, *bodies):
    rows = [(i, body, alt, enc, "utf-8") for i, (body, alt, enc) in enumerate(bodies)]
    got = msg.transfer_encoding(spark.createDataFrame(rows, BODY)).orderBy("message_id").collect()
    return [(r.body_encoding, r.body_charset, r.message_encoding, r.alt_encoding, r.alt_charset) for r in got]


def test_line_limits(spark):
    ok, bad = ("0" * 998 + "\r\n") * 10, ("1" * 999 + "\r\n") * 2
    docs = spark.createDataFrame([(ok,), (bad,), (ok + bad,), (bad + ok,), ("é" * 499 + "\r\n",), ("é" * 500 + "\n",)], "body string")
    got = [r[0] for r in docs.select(con.has_long_line(F.col("body"))).collect()]
    assert got == [False, True, True, True, False, True]


def test_encodings_chain(spark):
    long = "x" * 1200
    qp = "quoted-printable"
    assert encodings(
        spark, ("hi", "", "8bit"), ("hé", "alt", "8bit"), (long, "alt", "8bit"), ("hi", long, "8bit"), (long, long, "base64"), ("hi", "é", "7bit")
    ) == [
        ("7bit", "us-ascii", "8bit", "7bit", "us-ascii"),
        ("8bit", "utf-8", "8bit", "7bit", "us-ascii"),
        (qp, "us-ascii", qp, qp, "utf-8"),
        ("7bit", "us-ascii", "8bit", qp, "us-ascii"),
        ("base64", "utf-8", "base64", "base64", "utf-8"),
        ("7bit", "utf-8", "7bit", "7bit", "utf-8"),
    ]


def test_line_breaks(spark):
    docs = spark.createDataFrame([(t,) for t in ("a\nb\n", "a\rb\r", "a\r\nb\r\n", "a\nb\r\n", "\r\r\n\n")], "body string")
    rows = con.line_breaks(docs).collect()
    assert [r.normalised for r in rows[:4]] == ["a\r\nb\r\n"] * 4
    assert [(r.n_crlf, r.n_cr, r.n_lf) for r in rows] == [(0, 0, 2), (0, 2, 0), (2, 0, 0), (1, 0, 1), (1, 1, 1)]


def wire(body):
    soft = hard = 0
    lines = body.replace(b"\r\n", b"\n").replace(b"\r", b"\n").split(b"\n")
    for line in lines:
        while len(line) > 998:
            pos = line[:998].rfind(b" ")
            if pos > 0:
                soft, line = soft + 1, line[pos + 1:]
            else:
                hard, line = hard + 1, line[997:]
    return len(lines), sum(len(x) > 998 for x in lines), sum(x.startswith(b".") for x in lines), soft, hard


def test_wire_lines(spark):
    bodies = ["", ".a\n..b\nc", "x" * 998, "x" * 999, " " + "y" * 5000, ("é " * 700) + "\r" + "z" * 2000, "a " * 3000, "w " + "y" * 1500 + " v" * 900]
    docs = spark.createDataFrame(list(enumerate(bodies)), "message_id bigint, body string")
    got = {r.message_id: (r.n_lines, r.n_long, r.n_dots, r.n_soft, r.n_hard) for r in con.wire_line_audit(docs).collect()}
    assert got == {i: wire(b.encode()) for i, b in enumerate(bodies)}


def test_canonical_bodies(spark):
    docs = spark.createDataFrame([(0, ""), (1, "\n\n\n"), (2, "\r\n"), (3, "a\n\n\n"), (4, "a\r\n"), (5, "a")], "message_id bigint, body string")
    sizes = {r.message_id: r.canonical_bytes for r in con.canonical_fingerprint(docs).collect()}
    assert sizes == {0: 2, 1: 2, 2: 2, 3: 3, 4: 3, 5: 1}
    assert sorted((r.n, r.first_id, r.last_id) for r in con.duplicate_bodies(docs).collect()) == [(2, 3, 4), (3, 0, 2)]


def wrapped(text, width):
    out = []
    for line in text.split("\n"):
        buf = None
        for word in line.split(" "):
            if buf is None:
                buf = word
            elif buf and len((buf + " " + word).encode()) > width:
                out.append(buf)
                buf = word
            else:
                buf = buf + " " + word
        out.append(buf)
    return out


def test_wrap(spark):
    text = "Here is the body.  It has quite a few lines, and  double spaces; " * 4 + "\n\n飛兒樂 團光茫 飛兒樂 團光茫 飛兒樂\n " + "w" * 60 + " end"
    docs = spark.createDataFrame([(1, text + "\n")], "message_id bigint, body string")
    for width in (1, 10, 40):
        assert [r.line for r in con.reflow(docs, width).orderBy("line_no").collect()] == wrapped(text, width)
    assert [r.line for r in con.reflow(docs, 0).orderBy("line_no").collect()] == text.split("\n")


def test_blank_bodies_are_refused(spark):
    df = spark.createDataFrame([(1, ""), (2, "0"), (3, None), (4, "00")], "message_id bigint, body string")
    go, refused = msg.non_empty_gate(df)
    assert [r.message_id for r in go.collect()] == [4] and refused.count() == 3
    assert msg.non_empty_gate(df, allow_empty=True)[0].count() == 4


def test_envelope_fields_take_international_domains(spark):
    df = spark.createDataFrame(
        [(1, " a@example.com", "", "test@example..com"), (2, "a@example.com", "0", " test@example.com"), (3, "a@example.com", "", "test@françois.ch"),
         (4, "bad", "worse", "worst")], "message_id bigint, from_address string, sender string, confirm_to string")
    got = {r.message_id: (r.bad_field, r.bad_value) for r in msg.validate_envelope_fields(df).collect()}
    assert got == {1: ("confirm_to", "test@example..com"), 2: (None, None), 3: (None, None), 4: ("from_address", "bad")}


def test_senders(spark):
    df = spark.createDataFrame([(1, "a@example.com", ""), (2, "a@example.com", "b@example.com")], "message_id bigint, from_address string, sender string")
    auto = [(r.sender, r.envelope_sender) for r in msg.default_sender(df).orderBy("message_id").collect()]
    manual = [(r.sender, r.envelope_sender) for r in msg.default_sender(df, auto=False).orderBy("message_id").collect()]
    assert auto == [("a@example.com",) * 2, ("b@example.com",) * 2]
    assert manual == [("", "a@example.com"), ("b@example.com",) * 2]


def test_message_ids_are_stable(spark):
    df = spark.createDataFrame([(1, "bare"), (2, "<x@example.com>"), (3, None)], "message_id bigint, given_id string")
    first = [r.message_ref for r in msg.message_ids(df, "h").orderBy("message_id").collect()]
    assert first[1] == "<x@example.com>" and first[0].endswith("@h>") and first[0] != "bare"
    assert first == [r.message_ref for r in msg.message_ids(df, "h").orderBy("message_id").collect()]


def test_custom_headers_split_once(spark):
    df = spark.createDataFrame([(1, i, raw) for i, raw in enumerate(["foo:bar", "foo:baz", "yux", "Content-Type: a/b:c"])], "message_id bigint, seq bigint, raw string")
    got = [(r.name, r.value) for r in msg.custom_headers(df).orderBy("seq").collect()]
    assert got == [("foo", "bar"), ("foo", "baz"), ("yux", None), ("Content-Type", "a/b:c")]


def test_canonical_headers(spark):
    rows = spark.range(1).select(msg.canonical_header(F.lit("SubJect:  a\t b \r\n\t c ")).alias("h"), msg.canonical_header(F.lit("X")).alias("x")).first()
    assert rows.h == "subject:a b c" and rows.x == "x:"


def test_sizes_against_base64(spark):
    import base64

    for n in (0, 1, 56, 57, 58, 1000):
        lines = base64.encodebytes(b"x" * n)
        want = len(lines.replace(b"\n", b"\r\n"))
        df = spark.createDataFrame([(1, "base64", n)], "message_id bigint, encoding string, n_bytes bigint")
        assert msg.message_size(df).first().encoded_bytes == want


def test_paths_and_types(spark):
    paths = ["/mnt/files/飛兒樂 團光茫.mp3", "c:\\mnt\\files\\飛兒樂 團光茫.mp3", "a.PDF?x=1.png", "noext", "dir/x.tar.gz/", ".hidden"]
    df = spark.createDataFrame(list(enumerate(paths)), "i int, path string")
    got = [(r.dirname, r.basename, r.filename, r.extension, r.mime) for r in att.mime_types(df).orderBy("i").collect()]
    assert got[0] == ("/mnt/files", "飛兒樂 團光茫.mp3", "飛兒樂 團光茫", "mp3", "audio/mpeg")
    assert got[1] == ("c:\\mnt\\files", "飛兒樂 團光茫.mp3", "飛兒樂 團光茫", "mp3", "audio/mpeg")
    assert got[2][3:] == ("PDF", "application/pdf") and got[3][3:] == ("", "application/octet-stream")
    assert got[4][1:4] == ("x.tar.gz", "x.tar", "gz")


def test_attachments_once(spark):
    rows = [(1, 1, "a.png", "inline", "c1"), (1, 2, "a.png", "inline", "c1"), (1, 3, "b.png", "inline", "c1"), (1, 4, "b.png", "attachment", "c1"),
            (1, 5, "b.png", "attachment", "c1"), (2, 1, "a.png", "inline", "c1")]
    df = spark.createDataFrame(rows, "message_id bigint, seq bigint, name string, disposition string, cid string")
    kept = att.attachment_dedup(df, ["name", "disposition", "cid"], ["seq"])
    assert sorted((r.message_id, r.seq) for r in kept.collect()) == [(1, 1), (1, 4), (2, 1)]


def test_size_with_a_quoted_printable_part_is_unknown(spark):
    parts = spark.createDataFrame(
        [(1, "quoted-printable", 10), (1, "base64", 3), (2, "base64", 3), (3, None, None)], "message_id bigint, encoding string, n_bytes bigint"
    )
    sizes = {r.message_id: (r.n_parts, r.encoded_bytes, r.fits) for r in msg.message_size(parts, 0).collect()}
    assert sizes[1] == (2, None, None)
    assert sizes[2][0] == 1 and sizes[2][1] is not None and sizes[2][2] is True
    assert sizes[3] == (1, None, None)


def test_quoted_printable_sizes(spark):
    """Sizes worked out without encoding are those of the bytes that rendering makes."""
    import quopri
    import random

    draw = random.Random(4)
    made = ["", ".", ".\n.", ". \n..\t", " ", "\t\n ", "=" * 200, "a" * 75, "a" * 76, "a" * 77 + "\n" + "b" * 76 + " ", "é" * 60, ".\x00a", "\x85\n\u2028", "x\r\ny\rz\n"]
    made += ["".join(draw.choice(["a", "b", " ", "\t", "=", "é", "\n", "\r\n", ".", "word", "\x01", "🙂"]) for _ in range(draw.randint(0, 400))) for _ in range(400)]
    made += ["".join(draw.choice("ab é=") for _ in range(k)) + end for k in range(60, 90) for end in ("", " ", "\n", " \n.", "=", "é\n")]
    rows = spark.createDataFrame([(k, "quoted-printable", None, t) for k, t in enumerate(made)], "message_id bigint, encoding string, n_bytes bigint, content string")
    got = {r.message_id: r.encoded_bytes for r in msg.message_size(rows, text="content").collect()}
    for k, text in enumerate(made):
        data = text.encode().replace(b"\r\n", b"\n").replace(b"\r", b"\n")
        assert got[k] == len(quopri.encodestring(data).replace(b"\n", b"\r\n")), repr(text)
    unknown = msg.message_size(rows.withColumn("content", F.lit(None).cast("string")), 10, "content").select("encoded_bytes", "fits").distinct().collect()
    assert [tuple(r) for r in unknown] == [(None, None)]
