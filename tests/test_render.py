"""Rendered messages are read back with the standard library's parser."""

import base64
import email
import email.header
import email.policy

import pytest
from pyspark.sql import functions as F

from postmill.functions import headers as header_rules
from postmill.operators import ordered, recipients, render
from postmill.operators.render import own_texts, ready, render_corpus
from postmill.session import stored
from postmill.sources.sinks import write_corpus

LONG = "é" * 300 + " " + "word " * 300
CASES = {
    # name: (body, alt, ical, attachments as (disposition, name, encoding, content))
    "plain": ("Hello\nthere", "", "", []),
    "plain 8bit": ("Größe\n.dot", "", "", []),
    "plain long": (LONG, "", "", []),
    "alt": ("<p>hi</p>", "hi", "", []),
    "alt ical": ("<p>hi</p>", "hi", "BEGIN:VCALENDAR\nEND:VCALENDAR", []),
    "alt long": (LONG, "é", "", []),
    "attach": ("hi", "", "", [("attachment", "a b.bin", "base64", bytes(range(256)) * 3)]),
    "inline": ("<img>", "", "", [("inline", "i.png", "base64", b"\x89PNG")]),
    "inline_attach": ("<img>", "", "", [("inline", "i.png", "base64", b"x"), ("attachment", "naïve.txt", "quoted-printable", "ü = ü\r\n".encode())]),
    "alt_inline": ("<img>", "t", "", [("inline", "i.png", "base64", b"x"), ("inline", "j.png", "base64", b"y")]),
    "alt_attach": ("<p>", "t", "", [("attachment", "", "7bit", b"text\n")]),
    "alt_inline_attach": ("<p>", "t", "", [("attachment", "z", "base64", b"z" * 100), ("inline", "i.png", "base64", b"x")]),
}


@pytest.fixture(scope="module")
def corpus(spark):
    names = list(CASES)
    rows, files = [], []
    for i, name in enumerate(names):
        body, alt, ical, attached = CASES[name]
        rows.append((i, body, alt, ical, "8bit", "utf-8", "text/html" if alt else "text/plain", "s@example.com", "Zoë", f"Über {i}", "", "r@example.com"))
        files += [(i, k, 0, 0, n, "application/x-test", d, e, f"c{k}", bytearray(c)) for k, (d, n, e, c) in enumerate(attached)]
    messages = spark.createDataFrame(
        rows, "message_id bigint, body string, alt_body string, ical string, encoding string, charset string, content_type string,"
        " from_address string, from_name string, subject string, given_id string, confirm_to string",
    ).withColumn("sent_at", F.timestamp_seconds(F.lit(1704423845)))
    to = spark.createDataFrame(
        [(i, 0, "to", k, 0, 0, f"r{k}@example.com", "Ann, B." if k else "Łukasz") for i in range(len(names)) for k in range(2)],
        "message_id bigint, kind_rank int, kind string, seq bigint, t1 bigint, t2 bigint, address string, name string",
    )
    headers = messages.select("message_id", F.lit(1).alias("seq"), F.lit("X-Note").alias("name"), F.lit("ça va").alias("value"))
    attachments = spark.createDataFrame(
        files, "message_id bigint, seq bigint, t1 bigint, t2 bigint, name string, mime string, disposition string, encoding string, cid string, content binary"
    )
    return names, render_corpus(messages, to, headers, attachments, host="h.example"), (messages, to, headers, attachments)


def parse(text):
    return email.message_from_bytes(text.encode("utf-8"), policy=email.policy.default)


def test_parse_back(corpus):
    names, rendered, _ = corpus
    rows = rendered.collect()
    assert len(rows) == len(names)
    for r in rows:
        name = names[r.message_id]
        body, alt, ical, attached = CASES[name]
        assert "\n" not in r.message.replace("\r\n", "")
        m = parse(r.message)
        assert not m.defects, (name, m.defects)
        assert m["Subject"] == f"Über {r.message_id}" and m["X-Note"] == "ça va"
        assert r.message.startswith("Date: Fri, 5 Jan 2024 03:04:05 +0000\r\n")
        assert [(a.display_name, a.addr_spec) for a in m["To"].addresses] == [("Łukasz", "r0@example.com"), ("Ann, B.", "r1@example.com")]
        assert m["From"].addresses[0].display_name == "Zoë" and m["Disposition-Notification-To"] == "<r@example.com>"
        kind = name.split()[0]
        top = {"plain": "text/plain", "alt": "multipart/alternative", "alt_inline": "multipart/alternative", "inline": "multipart/related"}
        assert m.get_content_type() == top.get(kind, "multipart/mixed")
        leaves = [p for p in m.walk() if not p.is_multipart()]
        for p in leaves:
            assert not p.defects, (name, p.defects)
        got = [(p.get_content_type(), p.get_payload(decode=True)) for p in leaves if p.get_content_type().startswith("text/")]
        want = ([("text/plain", alt)] if alt else []) + [("text/html" if alt else "text/plain", body)]
        want += [("text/calendar", ical)] if ical and kind == "alt" else []
        assert [t for t, _ in got] == [t for t, _ in want]
        for (_, data), (_, text) in zip(got, want):
            assert data.decode("utf-8").replace("\r\n", "\n").rstrip("\n") == text.rstrip("\n")
        files = [(p.get_content_disposition(), p.get_filename() or "", p.get_payload(decode=True)) for p in leaves if p.get_content_type() == "application/x-test"]
        order = [a for a in attached if a[0] == "inline"] + [a for a in attached if a[0] == "attachment"]
        assert [(d, n) for d, n, _ in files] == [(d, n) for d, n, _, _ in order]
        for (_, _, data), (_, _, enc, content) in zip(files, order):
            assert data == content if enc == "base64" else data.replace(b"\r\n", b"\n").rstrip(b"\n") == content.replace(b"\r\n", b"\n").rstrip(b"\n")
        assert [p["Content-ID"] for p in leaves if p.get_content_disposition() == "inline"] == [f"<c{k}>" for k, a in enumerate(attached) if a[0] == "inline"]


def test_segments_join_to_the_same_message(corpus, spark):
    names, rendered, (messages, to, headers, attachments) = corpus
    whole = {r.message_id: r.message for r in rendered.collect()}
    many = attachments.filter(F.col("message_id") == names.index("attach")).withColumn("seq", F.explode(F.sequence(F.lit(1), F.lit(30))))
    many = many.withColumn("name", F.concat(F.col("seq").cast("string"), F.lit("-"), F.col("name")))
    one = messages.filter(F.col("message_id") == names.index("attach"))
    full = render_corpus(one, to.join(one, "message_id", "left_semi"), headers.join(one, "message_id", "left_semi"), many, host="h.example").first().message
    cut = render_corpus(one, to.join(one, "message_id", "left_semi"), headers.join(one, "message_id", "left_semi"), many, segment_rows=5, host="h.example")
    parts = [r.message for r in cut.orderBy("segment").collect()]
    assert len(parts) > 5 and "".join(parts) == full
    assert len([p for p in parse(full).walk() if p.get_content_type() == "application/x-test"]) == 30
    assert whole[names.index("attach")].split("\r\n\r\n")[0] == full.split("\r\n\r\n")[0]


def test_corpus_is_stored(corpus, spark, tmp_path):
    _, rendered, _ = corpus
    write_corpus(rendered, str(tmp_path / "corpus"), 4)
    assert spark.read.parquet(str(tmp_path / "corpus")).drop("bucket").exceptAll(rendered).isEmpty()


def test_repeated_attachments_are_left_out(corpus):
    """An identical part counts once, and a later inline part of a cid goes; parts that differ in content stay."""
    names, _, (messages, to, headers, attachments) = corpus
    at = names.index("alt_inline_attach")
    one = F.col("message_id") == at
    own = attachments.filter(one)
    again = own.withColumn("seq", F.col("seq") + 10)
    other = own.filter("disposition = 'inline'").withColumns({"seq": F.lit(30).cast("bigint"), "content": F.lit(b"other")})
    differs = own.filter("disposition = 'attachment'").withColumns({"seq": F.lit(40).cast("bigint"), "content": F.lit(b"differs")})
    files = own.unionByName(again).unionByName(other).unionByName(differs)
    tables = [t.filter(one) for t in (messages, to, headers)]
    (row,) = render_corpus(*tables, files).collect()
    parts = [p.get_payload(decode=True) for p in parse(row.message).walk() if p.get_content_type() == "application/x-test"]
    assert sorted(parts) == sorted([b"z" * 100, b"x", b"differs"])


def test_pieces_of_a_type_are_written_out(corpus):
    """Spark compiles no function over array elements: only finished header lines go through one."""
    _, _, (messages, _, _, attachments) = corpus
    own = own_texts(ready(messages, attachments), host="h.example")
    made = own._jdf.queryExecution().optimizedPlan().toString().split("AS pieces")[0]
    assert "transform(" not in made and made.count("lambdafunction(") == 1
    rows = own.collect()
    assert len(rows) == len(CASES) and all(p.piece is not None for r in rows for p in r.pieces)


def test_header_words_are_encoded_once(monkeypatch):
    """The length of a word is added up, not found by encoding it again with each character."""
    calls = []
    monkeypatch.setattr(header_rules.base64, "b64encode", lambda data, real=base64.b64encode: calls.append(data) or real(data))
    for text in ("é" * 300, "日本語 and ünïcödé " * 20, "ab" * 40 + "é" * 5):
        calls.clear()
        written = header_rules._words(text, "text", "utf-8")
        words = written.split("\r\n ")
        assert all(len(w) <= 75 for w in words) and len(calls) in (0, len(words))
        assert "".join(d.decode(c) for d, c in email.header.decode_header(written)) == text


def test_texts_are_neither_shuffled_nor_stored(corpus, monkeypatch):
    """What goes into a message meets as it is given: nothing moves once texts are made, and none is written to be joined."""
    _, _, tables = corpus
    kept = []

    def watched(df):
        kept.append(df.columns)
        return stored(df)

    for module in (ordered, recipients, render):
        monkeypatch.setattr(module, "stored", watched, raising=False)
    rendered = render_corpus(*tables, host="h.example")
    plan = rendered._jdf.queryExecution().executedPlan().toString()
    joined, _, made = plan.partition("Union")
    assert made and "Exchange" not in joined
    assert kept and not {"piece", "pieces", "text"} & {c for columns in kept for c in columns}


def test_a_message_is_cut_as_by_ranges_alone(corpus):
    """Whether a message can be large is told from what goes into it, and holds for messages that are there twice or have no id."""
    names, _, (messages, to, headers, attachments) = corpus
    at = names.index("inline_attach")
    files = attachments.withColumn("seq", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(20).cast("bigint"))))
    files = files.withColumn("name", F.concat("name", F.col("seq").cast("string")))

    def more(table):
        own = table.filter(F.col("message_id") == at)
        return table.unionByName(own.withColumn("message_id", F.lit(None).cast("bigint")))

    tables = more(messages).unionByName(messages.filter(F.col("message_id") == at)), more(to), more(headers), more(files)
    entries = render._entries(tables[1])
    pieces = render._pieces(tables[0], entries, tables[2], tables[3], together=False)
    want = ordered.ordered_concat(pieces, ["message_id"], render.PIECE_ORDER, "piece", "", 50, bundle="pieces")
    want = want.select("message_id", "segment", F.col("text").alias("message")).collect()
    assert max(r.segment for r in want) > 0 and len({r.message_id for r in want}) == len(names) + 1
    assert sorted(render_corpus(*tables, segment_rows=50).collect(), key=str) == sorted(want, key=str)
    large = render._large_messages(tables[0], entries, tables[2], tables[3], 60)
    assert at in {r.message_id for r in large.collect()}
    assert render._large_messages(tables[0], entries, tables[2], tables[3], 20_000) is None


def test_quoted_files_are_told_apart_as_they_are_given(corpus):
    """Contents that differ in their breaks alone are sent alike, and are two files; names in 8 bits are sent as words."""
    names, _, (messages, to, headers, attachments) = corpus
    one = F.col("message_id") == names.index("inline_attach")
    file = attachments.filter(one & (F.col("disposition") == "attachment"))
    files = [file.withColumns({"seq": F.lit(n).cast("bigint"), "content": F.lit(c)}) for n, c in ((1, b"\xc3\xbc\r\n"), (2, b"\xc3\xbc\n"), (3, b"\xc3\xbc\n"))]
    (row,) = render_corpus(*[t.filter(one) for t in (messages, to, headers)], files[0].unionByName(files[1]).unionByName(files[2])).collect()
    parts = [p for p in parse(row.message).walk() if p.get_content_type() == "application/x-test"]
    assert [(p.get_filename(), p.get_payload(decode=True).rstrip(b"\r\n")) for p in parts] == [("naïve.txt", "ü".encode())] * 2
