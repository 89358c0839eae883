"""The pipeline's stages one by one against plain Python, each on what the one before it kept, and the whole run."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from postmill.llm import linededup, mixing, quality
from tests.llm import brute
from tests.llm.data import ODD, documents

SENTENCES = [" ".join(f"w{(k * 7 + j * 13) % 997}" for j in range(12)) + "." for k in range(60)]
ROWS = [r for r in ODD if r[0] is not None] + [
    *[(300 + i, "\n".join([*SENTENCES[i:i + 9], "Shared closing words of many pages, as they are.", *SENTENCES[i + 9:i + 14]])) for i in range(40)],
    *[(400 + i, "\n".join(SENTENCES[20:45])) for i in range(9)],
    *[(500 + i, "\n".join(SENTENCES[:30]) + f" more{i}") for i in range(9)],
]


def line_fails(line: str) -> bool:
    words, parts = len(brute.WORD.findall(line)), len(re.findall(quality.SEPARATORS, line))
    signs = sum(c in quality.SYMBOLS for c in line)
    return (
        any(b in line.lower() for b in quality.BOILERPLATE) or signs > quality.MOST_SIGNS * len(line)
        or (parts > quality.MOST_SEPARATORS and parts * quality.WORDS_PER_SEPARATOR >= words)
        or (not re.search(quality.SENTENCE_END, line) and words < quality.PROSE_WORDS)
    )


def is_good(text: str | None) -> bool:
    n_words, *_, repeated = brute.figures(text)
    lines = [x for x in (text or "").split("\n") if brute.WORD.search(x)]
    left, whole = sum(len(x) for x in lines if not line_fails(x)), sum(map(len, lines))
    return n_words >= 10 and 100 * repeated <= 20 * n_words and left >= whole * quality.LEAST_KEPT


def targets(size: dict) -> dict:
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    capped = set()
    while len(capped) < len(size):
        level = (sum(size.values()) - 3 * sum(size[s] for s in capped)) / sum(weight[s] for s in size if s not in capped)
        more = {s for s in size if s not in capped and weight[s] * level > 3 * size[s]}
        if not more:
            break
        capped |= more
    return {s: 3 * size[s] if s in capped else weight[s] * level for s in size}


def test_stages_and_run(spark, tmp_path):
    source = documents(spark, ROWS)
    source.write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if number < 4:
            assert out.columns == source.columns
            out.write.parquet(f"{tmp_path}/{number}")
            docs = spark.read.parquet(f"{tmp_path}/{number}")
            out = docs
        seen.append(out.collect())
    good, lines, apart, mixed, encoded = seen

    kept = Counter((i, t) for i, t in ROWS if is_good(t))
    assert Counter((r.doc_id, r.text) for r in good) == kept and 0 < len(good) < len(ROWS)

    left = brute.without_common_lines({r.doc_id: r.text for r in good}, linededup.MIN_DOCS)
    assert Counter((r.doc_id, r.text) for r in lines) == Counter((r.doc_id, left[r.doc_id][2]) for r in good)
    assert any(n for _, n, _ in left.values()) and all(r.n_chars == len(r.text) for r in lines)

    named = brute.groups({r.doc_id: brute.fingerprint(r.text) for r in lines})
    assert sorted(r.doc_id for r in apart) == sorted(set(named.values())) and len(apart) < len(lines)

    size, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    words = {r.doc_id: len(brute.WORD.findall(r.text)) for r in apart}
    for r in apart:
        size[r.source] += words[r.doc_id]
        longest[r.source] = max(longest[r.source], words[r.doc_id])
    for r in mixed:
        taken[r.source] += words[r.doc_id]
    assert all(abs(taken[s] - t) <= longest[s] for s, t in targets(size).items())
    assert set(mixed) <= set(apart) and max(Counter(r.doc_id for r in mixed).values()) <= 3

    plain = brute.encoding()
    ids = {r.doc_id: plain.encode_ordinary(r.text) for r in apart}
    expected = Counter((r.doc_id, len(ids[r.doc_id]), brute.sha(" ".join(map(str, ids[r.doc_id]))), brute.sha(r.text)) for r in mixed)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encoded) == expected
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run) == expected


def test_empty_tables(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
