"""Filter audit, embedding near-dedup and importance resampling against plain Python, on odd rows and on empty tables."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from postmill.llm import audit, descent, resample
from tests.llm import brute
from tests.llm.data import ODD, documents

LABELS = [(4, 1, 0), (5, 0, 1), (5, 1, None), (6, None, 1), (7, 1, 1), (8, 0, 0), (None, 1, 1), (999, 1, 1), (14, 1, 0), (100, 1, 0), (9, 1, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    lang = F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 1, F.lit("")).otherwise(F.lit("de"))
    return documents(spark).withColumn("lang", lang).withColumn("mask", F.lit("x")).withColumn("part", F.lit(1)).repartition(5).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int").withColumn("text", F.lit("clash"))


def failures(rows):
    least = defaultdict(lambda: math.inf)
    for i, text in rows:
        least[text or ""] = min(least[text or ""], math.inf if i is None else i)
    for i, text in rows:
        t = text or ""
        words = brute.WORD.findall(t)
        yield i, (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            any(c in "#$%&*|" for c in t), i is not None and i > least[t],
        )


def test_audit(spark, docs, labels):
    good = {i for i, q, _ in LABELS if q == 1 and i is not None}
    toxic = {i for i, _, t in LABELS if t == 1 and i is not None}
    parts = defaultdict(list)
    for i, fails in failures(ODD):
        parts["de" if i is None or i % 3 == 2 else ""].append((i, fails))
    expected = {}
    for part, rows in parts.items():
        share = Counter()
        for order in permutations(range(5)):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [i for i, fails in left if fails[f]]
                left = [r for r in left if not r[1][f]]
                before = [fails for _, fails in rows if fails[f] and any(fails[g] for g in order[:step - 1])]
                alone = [fails for _, fails in rows if fails[f] and sum(fails) == 1]
                share[f] += len(gone)
                expected[part, "".join("ABCDE"[g] for g in order), step] = [
                    len(left), len(gone), len(before), len(alone), sum(i in good for i in gone), sum(i in toxic for i in gone), f
                ]
        for key in [k for k in expected if k[0] == part]:
            expected[key][-1] = share[expected[key][-1]]
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = {(r.part, r.filter_order, r.step): [r[c] for c in names] for r in audit.audit_documents(docs, labels).collect()}
    assert len(got) == 2 * 600 and got == expected
    assert audit.audit_documents(docs.limit(0), labels).count() == 0
    unlabelled = audit.audit_documents(docs, labels.limit(0))
    assert unlabelled.agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


def test_audit_of_any_filters(spark):
    """Two filters by hand: three rows, a null counts as passing."""
    rows = spark.createDataFrame([("p", True, False, 3), ("p", True, True, 4), ("p", None, True, None)], "g string, x boolean, y boolean, w int")
    out = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.w_lost, r.shapley) for r in audit.audit(rows, "g", ["x", "y"], ["w"]).collect()}
    assert out == {
        ("xy", 1): (1, 2, 0, 1, 7, 3), ("xy", 2): (0, 1, 1, 1, 0, 3), ("yx", 1): (1, 2, 0, 1, 4, 3), ("yx", 2): (0, 1, 1, 1, 3, 3),
    }
    with pytest.raises(ValueError):
        audit.audit(rows, "g", [f"f{k}" for k in range(8)])


def nearest_of_all(rows, threshold=0.93):
    """Links and components of ``(vec_id, vec, label)`` by comparing all pairs of a label."""
    def sound(i, v, label):
        return i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    size = max([len(v) for _, v, _ in rows if v] or [1])
    units = [np.array([*v, *[0.0] * (size - len(v))]) if sound(i, v, label) else None for i, v, label in rows]
    units = [u if u is None else (u / np.abs(u).max()) / np.linalg.norm(u / np.abs(u).max()) for u in units]
    by_label = defaultdict(list)
    for k, (u, (_, _, label)) in enumerate(zip(units, rows)):
        if u is not None:
            by_label[label].append(k)
    links, root = Counter(), list(range(len(rows)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for members in by_label.values():
        near = np.array([units[k] for k in members])
        for a, b in zip(*np.nonzero(np.triu(near @ near.T >= threshold, 1))):
            links[members[a]] += 1
            links[members[b]] += 1
            root[find(members[a])] = find(members[b])
    least = defaultdict(lambda: math.inf)
    for k, (i, _, _) in enumerate(rows):
        least[find(k)] = min(least[find(k)], math.inf if i is None else i)
    return Counter((i, links[k], None if i is None else least[find(k)], i is None or i == least[find(k)]) for k, (i, _, _) in enumerate(rows))


def test_embedding_dedup(spark):
    draw = np.random.default_rng(3)
    near = lambda v, spread: [float(x) for x in v + spread * draw.standard_normal(16)]
    centres = draw.standard_normal((6, 16)) * 5
    rows = [(i, [float(x) for x in draw.standard_normal(16)], "ab"[i % 2]) for i in range(300)]
    rows += [(1000 + i, near(centres[0], 0.05), "a") for i in range(90)]  # a group of near copies larger than a list
    rows += [(2000 + i, near(centres[0] + 1.8 * np.eye(16)[0] * np.linalg.norm(centres[0]) / 6, 0.05), "a") for i in range(60)]  # and one beside it
    rows += [(3000 + i, near(centres[1] * (1 - i / 40) + centres[2] * (i / 40), 0.02), "b") for i in range(41)]  # a chain
    rows += [(4000 + i, [1.0] * 16, "a") for i in range(50)] + [(4000, [1.0] * 16, "a"), (4100, [2.0] * 16, "a"), (4200, [1.0] * 16, "b")]
    rows += [(5000, None, "a"), (5001, [], "a"), (5002, [0.0] * 16, "a"), (5003, [math.nan] * 16, "a"), (5004, [math.inf] + [1.0] * 15, "a")]
    rows += [(5005, [None] + [1.0] * 15, "a"), (5006, [1.0] * 16, None), (None, [1.0] * 16, "a"), (5007, [1.0, 2.0], "a"), (5008, [1.0, 2.0, 0.0], "a")]
    rows += [(5009, [1e200] * 16, "a"), (5010, [-0.0] * 15 + [1.0], "a"), (5011, [0.0] * 15 + [1.0], "a")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, label string, component string").repartition(6)
    got = Counter(tuple(r) for r in descent.dedup_embeddings(table).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == nearest_of_all(rows)
    assert descent.dedup_embeddings(table.limit(0)).count() == 0


def test_tiles_settle_all_links(spark):
    """Small tiles of one component: some pairs are settled by centre and radius, some one by one."""
    draw = np.random.default_rng(9)
    start = draw.standard_normal(8)
    rows, at = [], start / np.linalg.norm(start)
    for i in range(400):
        at = at + 0.02 * draw.standard_normal(8)
        at /= np.linalg.norm(at)
        rows.append((i, [float(x) for x in at], "a"))
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string")
    got = Counter(tuple(r) for r in descent.dedup_embeddings(table).collect())
    assert got == nearest_of_all(rows)
    held = np.array([v for _, v, _ in rows])
    points = spark.createDataFrame(
        [(i, 2, np.array(v).tobytes(), np.rint(np.array(v) * 127).astype(np.int8).tobytes()) for i, v, _ in rows], "p bigint, copies bigint, unit binary, bytes binary"
    )
    named = spark.createDataFrame([(i, 0) for i, _, _ in rows], "node bigint, component bigint")
    counts = {r.p: r.n for r in descent.link_counts(points, named, 0.93, tile=16).collect()}
    expected = 2 * ((held @ held.T >= 0.93).sum(axis=1) - 1)
    assert [counts.get(i, 0) for i in range(400)] == expected.tolist()


RUN_WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = RUN_WORD.findall((text or "").translate(brute.ASCII))
    return len(words), [zlib.crc32(f.encode()) % 10000 for f in [*words, *map(" ".join, zip(words, words[1:]))]]


def resampled(rows, target):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    all_s, all_t = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in {*s, *t}}
    out, fit = [], []
    for i, text in rows:
        n_words, found = features(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        row = [i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        out.append(row)
        fit += [row] * (n_words >= 20)
    fit = sorted(map(id, fit), key={id(r): (-r[3], r[0] is not None, r[0] or 0) for r in fit}.get)
    by_id = {id(r): r for r in out}
    for rank, row in enumerate(fit[:25 * len(fit) // 100], 1):
        by_id[row][4] = rank
    return Counter(map(tuple, out))


def test_resampling(spark, docs):
    target = ["the quick brown fox jumps over the lazy dog", None, "", "Own é🙂 words"]
    wanted = spark.createDataFrame([(k, t, "x") for k, t in enumerate(target)], "item_id bigint, text string, weight string")
    got = Counter(tuple(r) for r in resample.resample(docs, wanted).collect())
    want = resampled(ODD, target)
    assert got - want == Counter() == want - got and sum(n for r, n in got.items() if r[4] is not None) > 3
    assert resample.resample(docs.limit(0), wanted).count() == 0
    assert Counter(tuple(r) for r in resample.resample(docs, wanted.limit(0)).collect()) == resampled(ODD, [])


def test_pieces_of_a_long_text(monkeypatch):
    text = " ".join(f"Word{i},é" for i in range(900))
    whole = Counter(b for found, _ in resample.buckets_of(text.encode()) for b in found.tolist())
    monkeypatch.setattr(resample, "CHUNK", 7)
    cut = Counter(b for found, _ in resample.buckets_of(text.encode()) for b in found.tolist())
    assert whole == cut == Counter(features(text)[1])


@pytest.mark.parametrize("take", [0, 1, 77, 499, 500, 999, 1000])
def test_cutoff_among_ties(spark, monkeypatch, take):
    """Brackets too narrow to hold the cutoff are widened, and a score that half of the rows share is cut by id."""
    monkeypatch.setattr(resample, "ACCURACY", 10)
    monkeypatch.setattr(resample, "MARGIN", 0.01)
    rows = [(i, 5 if i % 2 else i % 37, "x") for i in range(1000)]
    table = spark.createDataFrame(rows, "doc_id bigint, score bigint, extra string").cache()
    got = {r.doc_id: r["rank"] for r in resample.highest(table, "score", take, ["doc_id"]).collect()}
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert got == {r[0]: k if k <= take else None for k, r in enumerate(order, 1)}
