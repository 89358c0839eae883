"""The ordered steps on groups of very different size, against plain Python."""

import pytest
from pyspark.sql import functions as F

from postmill.operators import ordered
from postmill.operators import recipients as rec
from postmill.operators.calendar import calendar_export
from postmill.operators.campaigns import send_until_failure
from postmill.operators.ordered import carry_last, in_ranges, ordered_concat, running_total


@pytest.fixture(scope="module")
def rows(spark):
    # One group holds a third of all rows.
    data = [(0 if i % 3 == 0 else 1 + i % 40, i, f"p{i}", i % 7 == 0) for i in range(3000)]
    return spark.createDataFrame(data, "g int, seq bigint, piece string, flag boolean").repartition(5)


def by_group(rows):
    groups = {}
    for r in sorted(rows.collect(), key=lambda r: r.seq):
        groups.setdefault(r.g, []).append(r)
    return groups


def test_concat_in_segments(rows):
    want = {g: ",".join(r.piece for r in rs) for g, rs in by_group(rows).items()}
    for limit in (1, 60, 150, 10_000):
        got = {}
        for r in sorted(ordered_concat(rows, ["g"], ["seq"], "piece", ",", limit).collect(), key=lambda r: (r.g, r.segment)):
            assert r.segment == len(got.setdefault(r.g, [])) and r.segment < r.segments
            assert r.text.count(",") < limit
            got[r.g].append(r.text)
        assert {g: ",".join(t) for g, t in got.items()} == want
        assert max(len(t) for t in got.values()) >= (1000 + limit - 1) // limit if limit < 1000 else True


def test_running_total_over_blocks(rows):
    got = running_total(in_ranges(rows, ["g"], ["seq"], "b", 30), ["g"], ["seq"], F.lit(1), "before", "b")
    for rs in by_group(got).values():
        assert [r.before for r in rs] == list(range(len(rs)))


def test_carry_over_blocks(rows):
    marked = in_ranges(rows.withColumn("mark", F.when(F.col("flag"), F.col("seq"))), ["g"], ["seq"], "b", 50)
    for rs in by_group(carry_last(marked, ["g"], ["seq"], "mark", "last", "b")).values():
        seen = None
        for r in rs:
            seen = r.seq if r.flag else seen
            assert r["last"] == seen


def test_until_failure(spark, rows):
    sent = rows.withColumn("is_sent", ~((F.col("seq") > 900) & F.col("flag")))
    got = by_group(send_until_failure(sent, ["g"], ["seq"]))
    for g, rs in by_group(sent).items():
        first = next((r.seq for r in rs if not r.is_sent), None)
        assert [r.seq for r in got.get(g, [])] == [r.seq for r in rs if first is None or r.seq < first]


def test_long_address_header_and_calendar_come_in_segments(spark):
    many = spark.range(500).select(
        (F.col("id") % 2).alias("message_id"), F.lit(0).alias("kind_rank"), F.lit("to").alias("kind"), F.col("id").alias("seq"),
        F.lit(0).cast("bigint").alias("t1"), F.lit(0).cast("bigint").alias("t2"),
        F.format_string("u%03d@example.com", "id").alias("address"), F.lit("").alias("name"),
    ).filter("message_id = 0 or id < 20")
    parts = rec.recipient_headers(many, segment_rows=40).orderBy("message_id", "segment").collect()
    whole = ", ".join(p.header for p in parts if p.message_id == 0)
    assert whole == "To: " + ", ".join(f"u{i:03d}@example.com" for i in range(0, 500, 2))
    assert sum(p.message_id == 1 for p in parts) == 1
    events = many.select(
        F.col("message_id").alias("calendar"), "seq", F.timestamp_seconds("seq").alias("start_at"), F.timestamp_seconds("seq").alias("end_at"),
        F.lit("a\nb").alias("summary"), F.lit("").alias("description"), F.lit("u").alias("url"), F.lit("").alias("uid"),
    )
    whole = calendar_export(events, "20200101T000000Z").filter("calendar = 0").first().ics
    cut = calendar_export(events, "20200101T000000Z", 40).filter("calendar = 0").orderBy("segment").collect()
    assert len(cut) > 5 and "\n".join(c.ics for c in cut) == whole
    assert whole.startswith("BEGIN:VCALENDAR\n") and whole.endswith("END:VEVENT\nEND:VCALENDAR") and "SUMMARY:a\\nb\n" in whole
    assert "DTSTART:19700101T000002Z" in whole


def test_no_ranges_where_every_text_is_one_segment(spark, rows, monkeypatch):
    """Ranges write and shuffle all rows several times: only groups that need several segments go by them."""
    seen = []

    def watched(df, *args):
        seen.extend(r.g for r in df.select("g").distinct().collect())
        return in_ranges(df, *args)

    monkeypatch.setattr(ordered, "in_ranges", watched)
    want = {g: "".join(r.piece for r in rs) for g, rs in by_group(rows).items()}
    got = ordered_concat(rows, ["g"], ["seq"], "piece")
    assert {r.g: r.text for r in got.collect()} == want and not seen
    got = ordered_concat(rows, ["g"], ["seq"], "piece", segment_rows=100).collect()
    assert seen == [0] and sum(r.g == 0 for r in got) == 10 and all(r.segments == (10 if r.g == 0 else 1) for r in got)
    nulls = rows.withColumn("g", F.when(F.col("g") > 0, F.col("g")))
    got = ordered_concat(nulls, ["g"], ["seq"], "piece", segment_rows=100).orderBy("segment").collect()
    assert "".join(r.text for r in got if r.g is None) == want[0]


def test_bundled_pieces_are_cut_like_single_ones(rows):
    bundled = rows.groupBy("g", (F.col("seq") % 100).alias("k")).agg(F.collect_list(F.struct("seq", "piece")).alias("pieces"))
    for limit in (60, 10_000):
        single = ordered_concat(rows, ["g"], ["seq"], "piece", ",", limit)
        assert sorted(single.collect()) == sorted(ordered_concat(bundled, ["g"], ["seq"], "piece", ",", limit, bundle="pieces").collect())


def test_joining_is_compiled(rows):
    """Spark compiles neither a sort by a function nor a function over array elements."""
    bundled = rows.select("g", F.array(F.struct("seq", "piece")).alias("pieces"))
    for got in (ordered_concat(rows, ["g"], ["seq"], "piece"), ordered_concat(bundled, ["g"], ["seq"], "piece", bundle="pieces")):
        assert "lambdafunction(" not in got._jdf.queryExecution().optimizedPlan().toString()
