import random
import time

import pytest
from pyspark.sql import functions as F

from postmill.plans.views import view
from postmill.sources.catalogues import read_catalogue
from postmill.sources.files import attachment_files
from postmill.sources.sinks import CSV, write_delivery_log
from postmill.sources.transcripts import read_transcript
from postmill.streaming import delivery as live
from postmill.streaming import ledger
from postmill.streaming.ledger import live_ledger, recipient_ledger


def test_attachment_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"\x00\x01")
    (tmp_path / "b.txt").write_bytes(b"hello")
    got = {r.name: (r.n_bytes, bytes(r.content)) for r in attachment_files(spark, str(tmp_path / "*")).collect()}
    assert got == {"a.bin": (2, b"\x00\x01"), "b.txt": (5, b"hello")}


def test_transcript_file(spark, tmp_path):
    log = "".join(
        f"2024-01-01 00:00:{i % 60:02d}\tSERVER -> CLIENT: 250-line {i}\n" + f"{'':19}\t{'':18}250 more {i}\n" * (i % 3) for i in range(400)
    )
    (tmp_path / "s.log").write_text("stray\n" + log)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    rows = read_transcript(spark, str(tmp_path)).orderBy("_block", "line_no").collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({r._block for r in rows}) > 3
    assert rows[0].ts is None and rows[0].text == "stray"
    want = [(i % 60, t) for i in range(400) for t in [f"250-line {i}"] + [f"250 more {i}"] * (i % 3)]
    assert [(r.ts.second, r.text) for r in rows[1:]] == want and {r.direction for r in rows[1:]} == {"SERVER -> CLIENT"}


def test_catalogue_files(spark, tmp_path):
    (tmp_path / "texts.lang-fr.php").write_text(
        "<?php\n$T['a'] = 'vieux';\n//$T['b'] = 'non';\n$T['a'] = 'c\\'est';\n  $T[\"d\"]  =  \"deux\" ;\n"
    )
    (tmp_path / "readme.txt").write_text("$T['x'] = 'no';\n")
    got = {(r.lang, r.message_key): r.message for r in read_catalogue(spark, str(tmp_path)).collect()}
    assert got == {("fr", "a"): "c'est", ("fr", "d"): "deux"}


@pytest.fixture()
def feed(spark, small, tmp_path):
    """The delivery log as a stream of several files."""
    folder = str(tmp_path / "feed")
    log = view(spark, small, "delivery_log").withColumn("email", F.concat(F.lit("u"), F.col("session_id") % 9, F.lit("@example.com")))
    log.repartitionByRange(4, "ts").write.parquet(folder)
    batch = spark.read.parquet(folder)
    return batch, spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(df, mode, tmp_path, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def same(a, b):
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and not a.isEmpty()


def test_rates_and_sessions_equal_their_batch(feed, tmp_path):
    batch, stream = feed
    same(drain(live.delivery_rate(stream), "complete", tmp_path, "rate"), live.delivery_rate(batch))
    same(drain(live.delivery_rate(stream, slide="30 minutes"), "complete", tmp_path, "sliding"), live.delivery_rate(batch, slide="30 minutes"))
    same(drain(live.connection_sessions(stream, lateness="400 days"), "complete", tmp_path, "sessions"), live.connection_sessions(batch))


def test_unexpected_stream(feed, tmp_path):
    batch, stream = feed
    same(drain(live.live_unexpected(stream), "append", tmp_path, "unexpected"), live.live_unexpected(batch))


def test_live_dedup(feed, tmp_path):
    batch, stream = feed
    def rows(df):
        return df.select((F.col("session_id") % 5).alias("message_id"), "ts", F.upper("email").alias("address"))
    kept = drain(live.live_dedup(rows(stream), "400 days"), "append", tmp_path, "dedup")
    same(kept.select("message_id", "address"), live.live_dedup(rows(batch)).select("message_id", "address"))


def test_outbox_survives_a_rerun(feed, spark, small, tmp_path):
    batch, stream = feed
    log, sent = str(tmp_path / "log"), str(tmp_path / "sent")
    live.outbox(stream, log, sent, str(tmp_path / "cp")).awaitTermination()
    live.outbox(stream, log, sent, str(tmp_path / "cp2")).awaitTermination()  # all batches run again
    same(spark.read.parquet(log).drop("batch"), batch)
    people = spark.createDataFrame([("u1@example.com", False), ("none@example.com", False), ("old@example.com", True)], "email string, sent boolean")
    assert {r.email: r.sent for r in live.current_list(people, sent).collect()} == {"u1@example.com": True, "none@example.com": False, "old@example.com": True}


def test_delivery_log_sinks(feed, spark, tmp_path):
    batch, stream = feed
    write_delivery_log(batch, str(tmp_path / "b"), "csv")
    assert spark.read.options(**CSV).csv(str(tmp_path / "b")).count() == batch.count()
    write_delivery_log(stream, str(tmp_path / "s"), checkpoint=str(tmp_path / "scp")).awaitTermination()
    same(spark.read.parquet(str(tmp_path / "s")), batch)


def replay(commands):
    listed, accepted = {}, []
    for m, seq, op, kind, address in sorted(commands, key=lambda c: c[:2]):
        if op == "clear":
            gone = ("to", "cc", "bcc") if kind == "all" else (kind,)
            listed = {k: v for k, v in listed.items() if k[0] != m or v[0] not in gone}
        elif (m, kind == "Reply-To", address.lower()) not in listed:
            listed[m, kind == "Reply-To", address.lower()] = (kind, seq)
            accepted.append((m, seq, kind, address))
    live_seqs = {(k[0], v[1]) for k, v in listed.items()}
    return sorted((*a, a[:2] in live_seqs) for a in accepted)


def test_ledger_batch_and_stream(spark, tmp_path):
    rnd = random.Random(7)
    kinds = ["to", "cc", "bcc", "Reply-To"]
    commands = []
    for seq in range(1200):
        clear = rnd.random() < 0.15
        m = 1 if rnd.random() < 0.4 else rnd.randrange(2, 8)
        commands.append((m, seq, "clear" if clear else "add", rnd.choice([*kinds, "all"] if clear else kinds), "" if clear else rnd.choice("aAbBcd") + "@x.example"))
    schema = "message_id bigint, seq bigint, op string, kind string, address string"
    df = spark.createDataFrame(commands, schema)
    want = replay(commands)
    assert sorted(map(tuple, recipient_ledger(df).select("message_id", "seq", "kind", "address", "listed").collect())) == want
    folder = str(tmp_path / "commands")
    for part in range(3):
        df.filter((F.col("seq") >= part * 400) & (F.col("seq") < part * 400 + 400)).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = drain(live_ledger(stream), "append", tmp_path, "ledger").select("message_id", "seq", "kind", "address").collect()
    assert sorted(map(tuple, got)) == [w[:4] for w in want]


def test_a_refused_copy_does_not_return(spark):
    rows = [(1, 1, "add", "to", "a@x"), (1, 2, "add", "cc", "A@x"), (1, 3, "clear", "to", ""), (1, 4, "add", "Reply-To", "a@x"), (1, 5, "clear", "all", "")]
    got = recipient_ledger(spark.createDataFrame(rows, "message_id bigint, seq bigint, op string, kind string, address string")).collect()
    assert sorted((r.seq, r.listed) for r in got) == [(1, False), (4, True)]


def test_long_chains_of_listings(spark):
    """One address listed and cleared again and again, by lists that are cleared at different paces, and a null one beside it."""
    commands = []
    for k in range(300):
        commands.append((1, 4 * k, "add", ["to", "cc", "bcc"][k % 3], "a@x.example"))
        commands.append((1, 4 * k + 1, "clear", ["to", "cc", "to", "bcc", "all"][k % 5], ""))
        commands.append((1, 4 * k + 2, "add", "cc", "b@x.example"))
    df = spark.createDataFrame(commands, "message_id bigint, seq bigint, op string, kind string, address string")
    got = recipient_ledger(df).select("message_id", "seq", "kind", "address", "listed").collect()
    assert sorted(map(tuple, got)) == replay(commands)
    nulls = [(None, s, op, kind, address) for _, s, op, kind, address in commands]
    got = recipient_ledger(spark.createDataFrame(nulls, df.schema)).select("seq", "kind", "address", "listed").collect()
    assert sorted(map(tuple, got)) == [w[1:] for w in replay(commands)]


def test_listings_end(spark, tmp_path):
    """With a time limit a listing is forgotten and its state goes; without one it stays."""
    schema = "message_id bigint, seq bigint, op string, kind string, address string"
    folder = str(tmp_path / "commands")
    for part in range(3):
        rows = [(m, part * 10 + 1, "add", "to", "a@x.example") for m in range(20)] if part != 1 else [(99, 11, "add", "to", "b@x.example")]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    counts = {}
    for name, ttl in (("kept", None), ("ended", 1)):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        query = live_ledger(stream, ttl).writeStream.format("memory").queryName(f"ledger_{name}").option(
            "checkpointLocation", str(tmp_path / name)
        ).start()
        # With a time limit batches without rows follow for good, so the query is stopped once it has read all rows.
        ends = time.monotonic() + 120
        while sum(p["numInputRows"] for p in query.recentProgress) < 41 and time.monotonic() < ends:
            time.sleep(0.5)
        query.stop()
        sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["numInputRows"]]
        counts[name] = (spark.table(f"ledger_{name}").count(), sizes)
    assert counts["kept"][0] == 21 and counts["kept"][1] == [20, 21, 21]
    assert counts["ended"][0] == 41 and counts["ended"][1][1] < counts["ended"][1][0]


def test_ledger_is_the_same_by_ranges_and_by_message(spark, monkeypatch):
    """Only messages of many commands go by ranges, which shuffle all rows several times."""
    rnd = random.Random(11)
    kinds = ["to", "cc", "bcc", "Reply-To"]
    commands = []
    for seq in range(900):
        clear = rnd.random() < 0.2
        m = 1 if rnd.random() < 0.3 else rnd.randrange(2, 9)
        commands.append((m, seq, "clear" if clear else "add", rnd.choice([*kinds, "all"] if clear else kinds), "" if clear else rnd.choice("aAbBc") + "@x.example"))
    df = spark.createDataFrame(commands, "message_id bigint, seq bigint, op string, kind string, address string")
    for most in (0, 150):
        assert sorted(map(tuple, recipient_ledger(df, most).select("message_id", "seq", "kind", "address", "listed").collect())) == replay(commands)
    monkeypatch.setattr(ledger, "in_ranges", None)
    assert recipient_ledger(df).count() == len(replay(commands))


def test_ledger_ends_where_a_clear_has_no_place(spark):
    rows = [(1, None, "clear", "to", ""), (1, 1, "add", "to", "a@x"), (1, 2, "clear", "cc", ""), (1, 3, "add", "to", "a@x")]
    df = spark.createDataFrame(rows, "message_id bigint, seq bigint, op string, kind string, address string")
    short, long_ = ([tuple(r) for r in recipient_ledger(df, most).orderBy("seq").collect()] for most in (10, 0))
    assert short == long_ == [(1, 1, "to", "a@x", False), (1, 3, "to", "a@x", False)]
