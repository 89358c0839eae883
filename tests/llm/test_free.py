"""Search, language, formatting, tokens and near duplicates against plain Python, on odd rows and on empty tables."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from public_tokenizers import PATTERN, path
from pyspark.sql import functions as F

from postmill.llm import ann, bpe, chat, components, langid, simhash
from tests.llm import brute
from tests.llm.data import ODD, documents


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


def vectors(spark, n, seed=1, dims=32):
    made = np.random.default_rng(seed).standard_normal((n, dims)).astype(np.float32)
    return made, spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(made)], "vec_id bigint, embedding array<float>, query string")


def test_neighbours_of_a_small_table_are_exact(spark):
    made, rows = vectors(spark, 300)
    odd = [(1000, None), (1001, [0.0] * 32), (1002, [float("nan")] * 32), (1003, [float("inf")] + [0.0] * 31), (1004, []), (None, [1.0] * 32)]
    odd += [(1005, [None] + [1.0] * 31), (1020, made[0].tolist()), (1020, made[0].tolist()), (1021, made[0].tolist()), (1040, [1.0, 2.0])]
    rows = rows.drop("query").unionByName(spark.createDataFrame(odd, "vec_id bigint, embedding array<float>"))
    sound = {**{i: v.astype(float) for i, v in enumerate(made)}, 1020: made[0].astype(float), 1021: made[0].astype(float),
             1040: np.array([1.0, 2.0] + [0.0] * 30)}
    found = defaultdict(list)
    for r in ann.search_embeddings(rows).collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(found) == {i for i in sound if i % 20 == 0}
    for q, got in found.items():
        scores = sorted(((-float(np.dot(v, sound[q])), i) for i, v in sound.items() if i != q))[:20]
        assert [r for r, _, _ in sorted(got)] == list(range(1, 21))
        assert np.allclose([s for _, _, s in sorted(got)], [-s for s, _ in scores])
        assert {i for _, i, _ in got} == {i for _, i in scores}
    assert ann.search_embeddings(rows.limit(0)).count() == 0


def test_fewer_candidates_than_asked_for(spark):
    _, rows = vectors(spark, 5)
    out = ann.search_embeddings(rows).collect()
    assert sorted((r.query_id, r["rank"]) for r in out) == [(0, k) for k in (1, 2, 3, 4)]


@pytest.mark.parametrize("kind,n", [("normal", 9000), ("normal", 20_000), ("uniform", 9000), ("unit", 9000), ("clustered", 9000)])
def test_forest_recall(spark, kind, n):
    """Recall with the production settings, over several blocks; directions without any clusters are the hardest case."""
    draw = np.random.default_rng(5)
    made = draw.uniform(-1, 1, (n, 64)) if kind == "uniform" else draw.standard_normal((n, 64))
    if kind == "unit":
        made /= np.linalg.norm(made, axis=1, keepdims=True)
    if kind == "clustered":
        made += 2 * draw.standard_normal((50, 64))[draw.integers(0, 50, n)]
    exact = made.astype(np.float32).astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(exact)], "vec_id bigint, vec array<float>")
    asked = rows.filter(F.col("vec_id") % (n // 100) == 0)
    found = defaultdict(set)
    for r in ann.nearest_neighbours(rows, asked).collect():
        found[r.query_id].add(r.vec_id)
    hits = 0
    for q, got in found.items():
        scores = exact @ exact[q]
        scores[q] = -np.inf
        hits += len(got & set(np.argsort(-scores)[:20].tolist()))
    assert len(found) >= 100 and hits / (20 * len(found)) >= 0.9


def test_language(spark):
    sample = {"en": "the house of the old man and his dog ", "de": "das haus und der alte mann mit dem hund ", "fr": "la maison du vieil homme et son chien "}
    texts = [(k * 10 + i, text * (i + 3), lang) for k, (lang, text) in enumerate(sample.items()) for i in range(8)]
    labelled = spark.createDataFrame(texts + [(99, None, "en"), (98, "x", None)], "doc_id bigint, text string, lang string")

    def page(lang, text):
        return f"<!DOCTYPE html><html class='a' lang=\"{lang}\"><script>the of and</script><p>{text}</p></html>"

    rows = [(i, f"https://www.host{lang}.example.{lang}/x/{i}", page(lang, text * 4)) for i, (lang, text) in enumerate(list(sample.items()) * 10)]
    rows += [(100, None, None), (101, "no address", ""), (102, "http://u@WWW.hostde.example.de:80/", "<p>"), (103, "https://a.org/", page("en", sample["fr"] * 9)),
             (104, "https://www.hostfr.example.fr/y", "<html><body>1 2 3</body>"), (105, "http://b", "<" * 50_000 + "<script" * 9000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, declared string")
    out = {r.page_id: r for r in langid.identify(pages, labelled).collect()}
    assert len(out) == len(rows)
    assert all(out[i].lang == lang for i, (lang, _) in enumerate(list(sample.items()) * 10))
    assert out[103].lang == out[103].text_lang == "fr" and out[103].declared == "en"
    assert out[102].lang == "de" and out[104].lang == "fr" and out[102].host == "www.hostde.example.de" and out[100].host is None
    assert langid.identify(pages.limit(0), labelled).count() == 0
    assert langid.identify(pages, labelled.limit(0)).count() == 0


def test_chat(spark):
    rows = [(-2, 0, "user", None), (-2, 1, "assistant", "<\\s> a <\\\\/s> [\\INST] </s></s> [[INST]] é🙂"), (-3, 0, None, ""), (None, 0, "user", "x"),
            (-4, None, "as[INST]sistant", "\\<s>"), (-5, 0, "assistant", ""), (-5, 1, "assistant", "x</s>"), (-5, 1, "assistant", "x</s>"),
            (-5, 2, "user", "<s>[INST]user[/INST]"), (-6, 3, "assistant", "y " * 50_000), *[(-7, 0, "assistant", str(i)) for i in range(3000)]]
    turns = chat.with_probe(spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, ids int"))
    by = defaultdict(list)
    for r in turns.collect():
        by[r.conv_id].append((-1 if r.turn is None else r.turn, r.role or "", r.text or ""))
    out = chat.format_conversations(turns).collect()
    assert len(out) == len(by)
    for r in out:
        order = sorted(by[r.conv_id])
        learned = "".join(t for _, role, t in order if role == "assistant")
        assert r.n_turns == len(order) and r.turns_sha256 == brute.sha("".join(f"{role}\n{t}\n" for _, role, t in order))
        assert (r.loss_chars, r.loss_sha256) == (len(learned), brute.sha(learned))
    formed = chat.format_turns(turns)
    masks = formed.select("ids", "spans", chat.mask_of(F.col("ids"), F.col("spans")).alias("mask")).collect()
    for r in masks:
        expected = [0] * len(r.ids)
        for s in r.spans:
            expected[s.start:s.end] = [1] * (s.end - s.start)
        assert r["mask"] == expected
    probe = chat.rendered(formed.filter("conv_id = -1")).first()
    assert all(probe.text.count(c) == 2 for c in chat.CONTROLS) and probe.learned == "</s>[INST] ok [/INST]"
    assert all(probe.ids.count(i) == 2 for i in (chat.OPEN, chat.ROLE, chat.TEXT, chat.CLOSE))
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_transducer_follows_the_merges():
    plain, pieces, cut = brute.encoding(), bpe.Pieces(bpe.Transducer(bpe.read_ranks(path(bpe.RANKS)))), regex.compile(PATTERN).findall
    made = random.Random(3)
    texts = ["".join(made.choice("aabcdet hing  \n\t'sé中🙂‍0123!!--") for _ in range(made.randint(0, 60))) for _ in range(2000)]
    texts += ["a" * 50_000, "".join(made.choice("abcdefghij") for _ in range(20_000)), " " * 1000 + "x", "\x00\x85 "]
    for text in texts:
        ids = np.frombuffer(b"".join(map(pieces.__getitem__, cut(text))), np.int32)
        assert ids.tolist() == plain.encode_ordinary(text)
        assert bpe._vocabulary(path(bpe.RANKS)).decode(ids) == text


def test_transducer_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(bpe, "COMPILED", 20_000)
    monkeypatch.setattr(bpe, "MOST_PAIRS", 20)
    monkeypatch.setattr(bpe, "REMEMBERED", 1000)
    plain, pieces = brute.encoding(), bpe.Pieces(bpe.Transducer(bpe.read_ranks(path(bpe.RANKS))))
    for word in ["thonanering", "ciónboes", "enschheit", "éaieau", "unbelievable", "thonanering"] * 3:
        assert np.frombuffer(pieces[word], np.int32).tolist() == plain.encode_ordinary(word)


def test_utf8_stream():
    text = "aé中🙂" * 50
    data = text.encode()
    for step in (1, 2, 3, 5, 7):
        stream = bpe.Utf8Stream()
        assert "".join(stream.feed(data[i:i + step]) for i in range(0, len(data), step)) + stream.end() == text
    stream = bpe.Utf8Stream()
    assert stream.feed("é".encode()[:1]) + stream.end() == "�"


def test_encoding(docs, none):
    plain, texts = brute.encoding(), {i: t or "" for i, t in ODD}
    rows = bpe.encode_documents(docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in ODD)
    for r in rows:
        ids = plain.encode_ordinary(texts[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids)
        assert (r.ids_sha256, r.decoded_sha256) == (brute.sha(" ".join(map(str, ids))), brute.sha(texts[r.doc_id]))
    back = bpe.decode(bpe.encode(docs, ["doc_id"]), ["doc_id"]).collect()
    assert all(r.decoded == texts[r.doc_id] for r in back)
    assert bpe.encode_documents(none).count() == 0


def test_decoding_unknown_ids(spark):
    rows = spark.createDataFrame([(1, [64, -5, 10**6, None]), (2, None), (3, [])], "doc_id bigint, ids array<int>")
    out = {r.doc_id: r.decoded for r in bpe.decode(rows, ["doc_id"]).collect()}
    assert out[1].endswith("���") and out[2] == out[3] == ""


def test_near_groups(spark, none):
    rows = [(i, t) for i, t in dict(ODD).items() if i is not None]
    made = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    rows += [(1000 + i, " ".join([*words[:390], *made.sample(words, 1 + i % 3)])) for i in range(120)]
    out = simhash.near_groups(documents(spark, rows)).collect()
    prints = {i: brute.fingerprint(t) for i, t in rows}
    named = brute.groups(prints)
    assert len(out) == len(rows) and len(set(named.values())) < len(set(prints.values()))
    for r in out:
        assert r.fp & (2**64 - 1) == prints[r.doc_id] and r.component_id == named[r.doc_id]
    kept = simhash.one_per_group(documents(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(named.values()))
    assert simhash.near_groups(none).count() == 0 and simhash.one_per_group(none).count() == 0


def test_one_row_stays_of_rows_with_one_id(spark):
    docs = documents(spark)
    kept = simhash.one_per_group(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and kept.columns == docs.columns and ids.count(5) == 0 and ids.count(4) == 1


@pytest.mark.parametrize("leaf, fan", [(4, 2), (16, 3)])
def test_index_finds_all_close_codes(spark, leaf, fan):
    made = random.Random(7)
    codes = set()
    for _ in range(150):
        code = made.getrandbits(64)
        codes.add(code)
        for _ in range(made.randint(0, 3)):
            for _ in range(made.randint(1, 4)):
                code ^= 1 << made.randrange(64)
            codes.add(code)
    codes |= {0, 1, 3, 2**64 - 1}
    signed = [c - 2**64 if c >= 2**63 else c for c in codes]
    frame = spark.createDataFrame([(c,) for c in signed], "fp bigint")
    got = {tuple(sorted((r.u & (2**64 - 1), r.v & (2**64 - 1)))) for r in simhash.close_codes(frame, 2, leaf, fan).collect()}
    order = sorted(codes)
    assert got == {(a, b) for k, a in enumerate(order) for b in order[k + 1:] if (a ^ b).bit_count() <= 2}


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(5, i) for i in range(300, 360)]
    edges = spark.createDataFrame([*chain, *star, (7, 7), (9, 8), (8, 9)], "u bigint, v bigint")
    out = {r.node: r.component for r in components.components(edges).collect()}
    assert out == {**{i: 100 for i in range(100, 161)}, **{i: 5 for i in [5, *range(300, 360)]}, 8: 8, 9: 8}
