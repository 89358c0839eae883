"""Personal data by bootstrapped contextual extraction.

Base rules find e-mail addresses, IP addresses, card and phone numbers by shape. They are the seeds: the words around them become
lexical patterns. Patterns and the identifier-like tokens found with them form a graph, on which scores go back and forth for a
few rounds: a pattern is as good for a kind as the share of its tokens that are of the kind, a token as likely as its patterns
together make it. Tokens of no known shape that stand in patterns of high confidence are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import ascii_lower, let, text_of, words_of
from postmill.session import durable

# The shapes, in the order in which kinds are listed. Repeats are possessive and a match starts where its run of
# characters does (or where the last match ended), so no text makes them recurse or start over.
SHAPES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Tokens with a digit or an at sign: what may be an identifier of a shape nobody has listed.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
IP_PARTS = r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$"
KINDS = list(SHAPES)
# Characters on each side in which the words of a pattern are looked for.
CONTEXT = 64
ROUNDS = 3
# A pattern needs so many different seeds, so many documents with one, and such a score to find new tokens; a token such a score.
MIN_SEEDS = 5
MIN_DOCS = 5
PATTERN_SCORE = 0.9
TOKEN_SCORE = 0.9
# Patterns that start below this share of seeds never reach the score and leave the graph.
LEAST_START = 0.5


def _hits(text: Column, kind: str, shape: str) -> Column:
    """Matches in order, each with the characters between it and the match before, and with its surroundings."""

    def placed(both: Column) -> Column:
        gap = both["gaps"]
        return F.transform(both["hits"], lambda hit, k: F.struct(
            F.lit(kind).alias("kind"), k.alias("nth"), F.char_length(F.get(gap, k)).alias("gap"), F.char_length(hit).alias("length"),
            hit.alias("value"), F.right(F.get(gap, k), F.lit(CONTEXT)).alias("before"), F.left(F.get(gap, k + 1), F.lit(CONTEXT)).alias("after"),
        ))

    found = F.regexp_extract_all(text, F.lit(shape), F.lit(0))
    return let(F.struct(F.split(text, shape, -1).alias("gaps"), found.alias("hits")), placed)


def _valid() -> Column:
    value = F.col("value")
    bare = F.translate(value, " -", "")
    n_digits = F.char_length(F.regexp_replace(value, "[^0-9]", ""))
    card = F.char_length(bare).between(14, 19) & F.call_function("luhn_check", F.when(F.char_length(bare) <= 19, bare).otherwise("1"))
    return (
        (F.col("kind") == "email") | (F.col("kind") == "token") | ((F.col("kind") == "ip") & value.rlike(IP_PARTS))
        | ((F.col("kind") == "card") & card) | ((F.col("kind") == "phone") & n_digits.between(10, 15))
    )


def _base_and_tokens(found: DataFrame) -> DataFrame:
    """One row per valid base match and per token outside of all base matches: ``_id, kind, start, end, value, before, after``."""
    rows = found.filter(F.size("_hits") > 0).select("_id", F.explode("_hits").alias("_hit")).select("_id", "_hit.*")
    earlier = Window.partitionBy("_id", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("gap") + F.col("length")).over(earlier), F.lit(0)) + F.col("gap")
    placed = rows.withColumn("start", start).withColumn("end", F.col("start") + F.col("length")).filter(_valid())
    base = F.col("kind") != "token"
    order = Window.partitionBy("_id").orderBy("start", base.desc())
    so_far = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    to_come = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    marked = placed.withColumn("_far", so_far).withColumn("_next", to_come)
    clear = (F.coalesce("_far", F.lit(0)) <= F.col("start")) & (F.coalesce("_next", F.col("end")) >= F.col("end"))
    return marked.filter(base | clear).drop("_far", "_next", "gap", "length", "nth")


def _patterns() -> Column:
    """The lexical patterns of an occurrence: two words before, the word before with the word after, and a label ending in a colon."""
    left, right = F.col("_left"), F.col("_right")
    one, two = F.get(left, F.size(left) - 1), F.get(left, F.size(left) - 2)
    return F.filter(F.array(
        F.concat(F.lit("before:"), two, F.lit(" "), one), F.concat(F.lit("around:"), one, F.lit(" _ "), F.get(right, 0)),
        F.when(one.rlike("[:=]$"), F.concat(F.lit("label:"), one)),
    ), lambda p: p.isNotNull())


def _trusted(pairs: DataFrame, documents: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """``(pattern, sought, trust)`` and ``(token, sought)`` of high confidence, given ``(pattern, token, kind)`` as far as known.

    ``documents`` tells in how many documents each pattern stands with a known identifier of a kind.
    """
    total = pairs.groupBy("pattern").agg(F.count(F.lit(1)).alias("tokens"))
    seeds = pairs.filter("kind <> 'token'").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("seeds"))
    promising = seeds.join(total, "pattern").join(documents, ["pattern", "kind"]).filter(
        (F.col("seeds") >= MIN_SEEDS) & (F.col("docs") >= MIN_DOCS) & (F.col("seeds") >= LEAST_START * F.col("tokens"))
    ).select("pattern", F.col("kind").alias("sought"), "tokens")
    # An edge joins a pattern and a token for the kind sought; seeds of the kind are certain, of another kind impossible.
    edges = durable(promising.join(pairs, "pattern").select(
        "pattern", "sought", "tokens", "token",
        F.when(F.col("kind") == "token", F.lit(None)).otherwise((F.col("kind") == F.col("sought")).cast("double")).alias("known"),
    ))
    scored = edges.withColumn("score", F.coalesce("known", F.lit(0.0)))
    for _ in range(rounds):
        patterns = scored.groupBy("pattern", "sought").agg((F.sum("score") / F.max("tokens")).alias("trust"))
        doubts = edges.filter("known is null").join(patterns, ["pattern", "sought"])
        # 1 - product of (1 - trust), by logarithms.
        likely = doubts.groupBy("token", "sought").agg(
            (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-9)))))).alias("likely")
        )
        scored = durable(edges.join(likely, ["token", "sought"], "left").withColumn(
            "score", F.coalesce("known", "likely", F.lit(0.0))
        ).drop("likely"))
    trusted = scored.groupBy("pattern", "sought").agg((F.sum("score") / F.max("tokens")).alias("trust")).filter(F.col("trust") >= PATTERN_SCORE)
    tokens = scored.filter(F.col("known").isNull() & (F.col("score") >= TOKEN_SCORE)).select("token", "sought")
    return trusted, tokens.join(trusted.select("sought").distinct(), "sought", "left_semi").distinct()


def discovered(spans: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``_id, kind, start, end`` of the tokens that patterns of high confidence find.

    What is found becomes a seed: its own contexts are patterns of the next hop, until a hop finds nothing new. Patterns and tokens
    only ever meet as counted pairs; what a frequent pattern holds is summed before it is shuffled.
    """
    seen = durable(spans.select(
        "_id", "kind", "start", "end", ascii_lower(F.col("value")).alias("token"),
        words_of(ascii_lower(F.col("before"))).alias("_left"), words_of(ascii_lower(F.col("after"))).alias("_right"),
    ).select("_id", "kind", "start", "end", "token", F.explode(_patterns()).alias("pattern")))
    pairs = durable(seen.groupBy("pattern", "token", "kind").agg(F.count(F.lit(1)).alias("n")).drop("n"))
    standing = seen.select("pattern", "token", "kind", "_id").distinct()
    found = None
    while True:
        if found is None:
            known, stands = pairs, standing.filter("kind <> 'token'")
        else:
            # A token is one kind: that of the most trusted pattern that found it first.
            known = pairs.join(found, "token", "left").withColumn("kind", F.when(F.col("kind") == "token", F.coalesce("sought", "kind")).otherwise(F.col("kind")))
            known = known.select("pattern", "token", "kind").distinct()
            stands = standing.join(found, "token", "left").withColumn("kind", F.when(F.col("kind") == "token", F.coalesce("sought", "kind")).otherwise(F.col("kind"))).filter("kind <> 'token'")
        documents = stands.groupBy("pattern", "kind").agg(F.count_distinct("_id").alias("docs"))
        trusted, tokens = _trusted(known, documents, rounds)
        hit = seen.filter("kind = 'token'").join(trusted, "pattern").join(tokens, ["token", "sought"], "left_semi")
        best = durable(hit.groupBy("token").agg(F.max_by("sought", F.struct("trust", "sought")).alias("sought")))
        if best.isEmpty():
            break
        found = best if found is None else durable(found.unionByName(best.join(found, "token", "left_anti")))
    if found is None:
        return spans.select("_id", "kind", "start", "end").limit(0)
    # The places of what was found: those where a trusted pattern of its kind stands, with all that is known by now.
    sites = seen.filter("kind = 'token'").join(found, "token").join(
        trusted.select("pattern", F.col("sought")), ["pattern", "sought"], "left_semi"
    )
    return sites.select("_id", "start", "end", F.col("sought").alias("kind")).distinct()


def _listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind in listed order, then end."""
    return F.array_join(F.transform(
        F.array_sort(spans), lambda s: F.concat_ws(":", F.get(F.array(*[F.lit(k) for k in KINDS]), s["at"]), s["start"], s["end"])
    ), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone (base matches), base_sha256, spans (base and added), n_added.

    Null and empty texts have no span: the digest of the empty string and an empty list. Repeated rows, and rows with one doc_id
    but different texts, each get their own spans. An empty table gives no rows; other columns are ignored.
    """
    text = F.col("_text")
    # One look tells which texts have none of the signs any shape or token needs.
    none = F.array().cast("array<struct<kind:string,nth:int,gap:int,length:int,value:string,before:string,after:string>>")
    hits = F.concat(*[_hits(text, k, s) for k, s in [*SHAPES.items(), ("token", TOKEN)]])
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of("text").alias("_text"))
    found = durable(rows.select(
        "doc_id", F.struct("doc_id", F.xxhash64("_text").alias("a"), F.xxhash64(F.lit("text"), text).alias("b")).alias("_id"),
        F.when(text.rlike("[0-9@]"), hits).otherwise(none).alias("_hits"),
    ))
    distinct = found.filter(F.size("_hits") > 0).dropDuplicates(["_id"])
    spans = durable(_base_and_tokens(distinct))
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    base = spans.filter("kind <> 'token'").select("_id", "start", "end", place.alias("at"), F.lit(True).alias("base"))
    added = discovered(spans).select("_id", "start", "end", place.alias("at"), F.lit(False).alias("base"))
    span = F.struct("start", "at", "end")
    lists = base.unionByName(added).groupBy("_id").agg(
        F.collect_list(span).alias("_all"), F.collect_list(F.when(F.col("base"), span)).alias("_base"),
    )

    def count_of(at: int) -> Column:
        return F.coalesce(F.size(F.filter("_base", lambda s: s["at"] == at)), F.lit(0)).cast("bigint").alias(f"n_{KINDS[at]}")

    return found.select("doc_id", "_id").join(lists, "_id", "left").select(
        "doc_id", *[count_of(at) for at in range(len(KINDS))], F.sha2(F.coalesce(_listed(F.col("_base")), F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce(_listed(F.col("_all")), F.lit("")).alias("spans"),
        (F.coalesce(F.size("_all") - F.size("_base"), F.lit(0))).cast("bigint").alias("n_added"),
    )
