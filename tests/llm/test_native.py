"""Line dedup, mixing, quality rules, personal data and sharding against plain Python, on odd rows and on empty tables."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from postmill.llm import linededup, mixing, pii, quality, sharding
from tests.llm import brute
from tests.llm.data import ODD, documents


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


def test_line_dedup(docs, none):
    rows = linededup.dedup_lines(docs).collect()
    # Rows with one id are one document: the brute version takes texts by id, and repeated rows are alike.
    expected = brute.without_common_lines({i: t for i, t in ODD}, linededup.MIN_DOCS)
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in ODD)
    for r in rows:
        assert (r["_n_lines"], r["_n_dropped"], r.text or "") == expected[r.doc_id], r.doc_id
    assert sum(r["_n_dropped"] for r in rows) == 12 * 3 + 11 * 2
    assert linededup.dedup_lines(none).count() == 0


def test_line_runs_are_compacted(spark, docs):
    few = linededup.common_lines(docs.select("doc_id", "text"), batches=7, fanout=3).count()
    assert few == linededup.common_lines(docs.select("doc_id", "text"), batches=1).count() == 2


def test_quality(docs, none):
    for r in quality.judge(docs).collect():
        if r.doc_id is not None:
            text = dict(ODD)[r.doc_id]
            expected = brute.figures(text)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected, r.doc_id
            assert r.base_failed == (expected[0] < 10 or 100 * expected[4] > 20 * expected[0])
            assert not (r.base_failed and r.kept)
    assert quality.judge(none).count() == 0


def test_quality_judges_lines(spark):
    prose = "This is a line of plain prose that ends as it should, with a stop."
    menu = "Home | News | About | Contact"
    own = [" ".join(f"word{k}x{i}" for k in range(9)) + "." for i in range(9)]
    rows = [(1, "\n".join([prose, *own])), (2, "\n".join([prose] + [f"{menu} {i}" for i in range(9)])),
            (3, "\n".join([prose, "All rights reserved by the owners of this page."]))]
    out = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out[1].kept and not out[2].kept
    assert out[2].clean_text == prose and out[3].clean_text == prose


def test_personal_data(docs, none):
    rows = pii.find_personal_data(docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in ODD)
    for r in rows:
        spans = brute.base_spans(dict(ODD)[r.doc_id])
        assert r.base_sha256 == brute.sha(brute.listed(spans)), r.doc_id
        counts = Counter(s[3] for s in spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [counts[k] for k in brute.SHAPES]
        if not r.n_added:
            assert r.spans == brute.listed(spans)
    assert pii.find_personal_data(none).count() == 0


def test_personal_data_learns_a_context(spark):
    """Numbers that no shape knows are found behind a label that cards taught, and nowhere else."""
    seeds = [(i, f"Please bill my card: 4{i:02d}{brute_luhn(i)} at once.") for i in range(60)]
    unknown = [(1000, "Please bill my card: 77-AB-1234 at once."), (1001, "Version 77-AB-1234 is out since 2024.")]
    rows = spark.createDataFrame(seeds + unknown, "doc_id bigint, text string")
    out = {r.doc_id: r for r in pii.find_personal_data(rows).collect()}
    assert all(out[i].n_card == 1 and out[i].n_added == 0 for i, _ in seeds)
    assert out[1000].spans == "card:21:31" and out[1000].n_added == 1
    assert out[1001].n_added == 0


def test_personal_data_learns_from_what_it_found(spark):
    """Found numbers are seeds themselves: their other contexts find the next, hop after hop, and no further than those reach."""
    rows = [(i, f"Please bill my card: 4{i:02d}{brute_luhn(i)} at once.") for i in range(60)]
    first, second, third = ([f"{c}{k}-AB-12{k}" for k in range(8)] for c in "567")
    rows += [(100 + k, f"Please bill my card: {t} at once.") for k, t in enumerate(first)]
    rows += [(200 + k, f"Redeem voucher code {t} today please.") for k, t in enumerate(first + second[:4])]
    rows += [(300 + k, f"Our desk keeps ledger entry {t} for audits.") for k, t in enumerate(first[:2] + second[:4] + third[:1])]
    rows += [(400 + k, f"The bus number {t} leaves soon.") for k, t in enumerate(third)]
    out = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    found = {i for i, r in out.items() if r.n_added}
    assert found == {*range(100, 108), *range(200, 212), *range(300, 307)}
    assert all(out[i].spans.startswith("card:") for i in found)


def brute_luhn(i: int) -> str:
    """13 more digits that make ``4`` and two digits of ``i`` a valid card number."""
    body = f"{i * 7919:012d}"
    return next(body + str(d) for d in range(10) if brute._luhn(f"4{i:02d}{body}{d}"))


def test_mixing(spark, docs, none):
    rows = mixing.mix_documents(docs).collect()
    assert len(rows) == len(ODD)
    size = Counter()
    for k, (_, text) in enumerate(ODD):
        size[[None, "", "a", "B", "é"][k % 5]] += brute.figures(text)[0]
    weights = dict(zip(["", "B", "a", "é", None], [5, 2, 1, 5, 2]))
    total, capped = sum(size.values()), set()
    while True:
        level = (total - sum(3 * size[s] for s in capped)) / sum(w for s, w in weights.items() if s not in capped)
        more = {s for s, w in weights.items() if s not in capped and w * level > 3 * size[s]}
        if not more:
            break
        capped |= more
    expected = {size[s]: min(3 * size[s], weights[s] * level) for s in weights}
    taken, longest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.target == pytest.approx(expected[r.source_size]) and r.taken <= 3 * r["size"]
        taken[r.source_size] += r.taken
        longest[r.source_size] = max(longest[r.source_size], r["size"])
    for source_size, target in expected.items():
        assert abs(taken[source_size] - target) <= longest[source_size]
    assert sorted(mixing.mix_documents(docs.repartition(2)).collect(), key=repr) == sorted(rows, key=repr)
    assert mixing.mix_documents(none).count() == 0


def test_mixed_rows(docs, none):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    copies = Counter(r.doc_id for r in out.collect())
    single = docs.dropDuplicates()
    taken = Counter()
    for r in mixing.mix_documents(single).collect():
        if r.taken:
            taken[r.doc_id] += r.taken // r["size"]
    assert copies == taken
    assert mixing.mixed_documents(none).count() == 0


def test_curriculum_moves_sources_through_time(spark):
    rows = [(i, "w " * 20, s) for s in "ab" for i in range(ord(s) * 1000, ord(s) * 1000 + 400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    each = mixing.mix(mixing.sized(docs), "doc_id", weights=(1.0, 1.0), schedules=((1.8, 0.2), (0.2, 1.8)))
    mean = {r.source: r.m for r in each.select("source", F.explode(F.flatten("_times")).alias("t")).groupBy("source").agg(F.avg("t").alias("m")).collect()}
    assert mean["b"] > 0.6 and mean["a"] + mean["b"] == pytest.approx(1, abs=0.02)


def test_sharding(docs, none):
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == len(ODD)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard_documents(none).count() == 0


def test_shards_follow_weights_and_move_little(spark):
    keys = spark.range(40_000).select(F.col("id").alias("k"))
    before = {r.k: r.shard for r in sharding.place(keys, "k", ["k"], [1.0, 1.0, 2.0]).collect()}
    after = {r.k: r.shard for r in sharding.place(keys, "k", ["k"], [1.0, 1.0, 2.0, 1.0]).collect()}
    share = Counter(before.values())
    assert share[2] / 40_000 == pytest.approx(0.5, abs=0.01) and share[0] / 40_000 == pytest.approx(0.25, abs=0.01)
    moved = [k for k in before if before[k] != after[k]]
    assert all(after[k] == 3 for k in moved) and len(moved) / 40_000 == pytest.approx(0.2, abs=0.01)


def test_a_repeated_row_keeps_its_own_slots(spark):
    rows = spark.createDataFrame([(7, "same")] * 5000 + [(8, "other")], "doc_id bigint, text string")
    out = sharding.shard_documents(rows).filter("doc_id = 7").collect()
    assert len({r.slot for r in out}) == 5000 and len({r.shard for r in out}) == 1
