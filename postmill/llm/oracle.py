"""SQL twins of the queries, for DuckDB, where SQL has what they need."""

from __future__ import annotations

from postmill.llm import audit, linededup, mixing, quality, resample
from postmill.llm.common import LOWER, UPPER, WORD

WHITE = r"[\x20\x09-\x0D]"


def _hash60(key: str) -> str:
    return f"('0x' || substr(md5({key}), 1, 15))::bigint"


CHAT = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized as (
  select *, length('<s>[INST][/INST]</s>') + length(role) + length(text)
    + len(regexp_extract_all(role, '[<\[]\\*/?(?:s>|INST\])')) + len(regexp_extract_all(text, '[<\[]\\*/?(?:s>|INST\])')) as chars
  from t
), joined as (
  select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as lines,
    coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '') as learned, sum(chars)::bigint as formatted_chars
  from sized group by conv_id
)
select conv_id, n_turns, sha256(lines) as turns_sha256, length(learned) as loss_chars, sha256(learned) as loss_sha256, formatted_chars
from joined
"""

LINES = rf"""
with cut as (
  select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents
), lines as (
  select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as pos from cut
), keyed as (
  select *, translate(regexp_replace(line, '^{WHITE}+|{WHITE}+$', '', 'g'), '{UPPER}', '{LOWER}') as key from lines
), common as (
  select key from keyed where length(key) >= {linededup.MIN_CHARS} group by key having count(distinct doc_id) >= {linededup.MIN_DOCS}
), marked as (
  select k.*, c.key is not null as gone from keyed k left join common c on k.key = c.key
)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""

NTH = f"(row_number() over (order by source is null, source) - 1) % {len(mixing.WEIGHTS)} + 1"
STARTS, ENDS = ([s[k] for s in mixing.SCHEDULES] for k in (0, 1))
WEIGHT = f"[{', '.join(map(str, mixing.WEIGHTS))}][(row_number() over (order by source is null, source) - 1) % {len(mixing.WEIGHTS)} + 1]"
MIX = f"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as size,
    {_hash60("coalesce(doc_id::varchar, 'null') || ':mix'")} as h from documents
), s as (
  select source, sum(size)::bigint as source_size from d group by source
), w as (
  select *, {WEIGHT} as weight, {mixing.MOST_REPEATS} * source_size as most, ({STARTS}::double[])[{NTH}] as s0, ({ENDS}::double[])[{NTH}] as s1 from s
), ranked as (
  select *, sum(source_size) over () as total, coalesce(sum(most) over before, 0) as fixed, sum(weight) over () - coalesce(sum(weight) over before, 0) as free
  from w window before as (order by most / weight, source is null, source rows between unbounded preceding and 1 preceding)
), level as (
  select coalesce(max(l), 0) as l from (
    select (total - fixed)::double / free as l from ranked where (total - fixed)::double / free * weight <= most
    order by most / weight, source is null, source limit 1
  )
), targets as (
  select source, source_size, s0, s1, least(weight * l, most::double) as target from ranked, level
), placed as (
  select d.*, row_number() over () as row, coalesce(sum(size) over (partition by source order by h, doc_id, size rows between unbounded preceding and 1 preceding), 0) as c from d
), drawn as (
  select p.row, p.doc_id, p.size::bigint as size, t.source_size, t.target, s0, s1,
    list_filter([p.c + r * t.source_size + p.size / 2 for r in [0, 1, 2]], lambda m: p.size > 0 and m <= t.target) as middles
  from placed p join targets t on p.source is not distinct from t.source
), shares as (
  select row, doc_id, size, s0, s1, greatest(0.0::double, least(1.0::double, unnest(middles)::double / target)) * (s0 + s1) as need from drawn
), times as (
  select row, row_number() over (order by need / (s0 + sqrt(s0 * s0 + (s1 - s0) * need)), doc_id nulls first, size, row) - 1 as place from shares
)
select doc_id, size, source_size, target, (size * len(middles))::bigint as taken, min(place) as first_position
from drawn left join times using (row) group by row, doc_id, size, source_size, target, middles
"""

QUALITY = rf"""
with d as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{WORD}') as words from documents
), windows as (
  select doc_id, i, array_to_string(words[i + 1 : i + {quality.WINDOW}], ' ') as win
  from (select doc_id, words, unnest(range(0, len(words) - {quality.WINDOW - 1})) as i from d where len(words) >= {quality.WINDOW})
), twice as (
  select doc_id, win from windows group by doc_id, win having count(*) > 1
), covered as (
  select doc_id, count(distinct place) as n from (
    select w.doc_id, unnest(range(w.i, w.i + {quality.WINDOW})) as place from windows w join twice t on w.doc_id = t.doc_id and w.win = t.win
  ) group by doc_id
), lines as (
  select doc_id, line from (select doc_id, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '{WORD}')
), judged as (
  select doc_id, line, len(regexp_extract_all(line, '{WORD}')) as nw, len(regexp_extract_all(line, '{quality.SEPARATORS}')) as parts,
    regexp_matches(lower(line), '{"|".join(quality.BOILERPLATE)}') as boiler,
    len(regexp_extract_all(line, '[#*$%&|<>]')) > {quality.MOST_SIGNS} * length(line) as signs,
    not regexp_matches(line, '{quality.SENTENCE_END.replace("'", "''")}') as unended
  from lines
), per_doc as (
  select doc_id, count(*) - count(distinct line) as n_dup_lines, sum(length(line)) as whole,
    coalesce(sum(length(line)) filter (not (
      boiler or signs or (parts > {quality.MOST_SEPARATORS} and parts * {quality.WORDS_PER_SEPARATOR} >= nw) or (unended and nw < {quality.PROSE_WORDS})
    )), 0) as kept_chars
  from judged group by doc_id
), figures as (
  select d.doc_id, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words,
    coalesce(kept_chars, 0) >= coalesce(whole, 0) * {quality.LEAST_KEPT} as good
  from d left join per_doc p on d.doc_id = p.doc_id left join covered c on d.doc_id = c.doc_id
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words) as base_failed,
  not (n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words) and good as kept
from figures
"""

SHARDS = 16
# CRC-32 byte by byte over the text's UTF-8 in hexadecimal; the table of 256 remainders is made by eight shifts each.
SHARDING = f"""
with recursive crc(i, k, c) as (
  select range, 0, range::bigint from range(256)
  union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from crc where k < 8
), table_of as (
  select list(c order by i) as t from crc where k = 8
), d as (
  select doc_id, hex(encode(coalesce(text, ''))) as bytes from documents
), sized as (
  select doc_id, (length(bytes) / 2 + 1)::bigint as size, xor(4294967295, list_reduce(
    list_prepend(4294967295::bigint, list_transform(regexp_extract_all(bytes, '..'), lambda x: ('0x' || x)::bigint)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) as text_crc32
  from d, table_of
), scored as (
  select *, unnest(range({SHARDS + 1})) as s from sized
), best as (
  select doc_id, size, text_crc32, arg_min(s, score) filter (s < {SHARDS}) as shard, arg_min(s, score) as grown_shard from (
    select *, -ln(({_hash60("coalesce(doc_id::varchar, 'null') || ':' || s")} + 1) / {float(2**60)!r}) as score from scored
  ) group by all
)
select doc_id, size, text_crc32, 'key' as law, shard::int as shard, grown_shard::int as grown_shard,
  row_number() over (partition by shard order by {_hash60("doc_id || ':' || size || ':' || text_crc32")}, doc_id, size, text_crc32) - 1 as slot
from best
"""

FILTERS = "ABCDE"
AUDIT = rf"""
with d as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{WORD}') as words from documents
), firsts as (
  select text, min(doc_id) as least from d group by text
), l as (
  select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id
), fails as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, [
    len(words) < {audit.MIN_WORDS}, 100 * len(list_distinct(words)) < {audit.LEAST_DISTINCT} * len(words),
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {audit.MOST_CAPITALS} * length(text), regexp_matches(text, '[{audit.SIGNS}]'),
    coalesce(d.doc_id > least, false)] as f
  from d join firsts using (text) left join l on d.doc_id = l.doc_id
), counted as (
  select part, f, count(*) as n, sum(good) as good, sum(toxic) as toxic from fails group by part, f
), letter as (
  select range + 1 as i from range({len(FILTERS)})
), orders as (
  select [a.i, b.i, c.i, d.i, e.i] as o from letter a, letter b, letter c, letter d, letter e
  where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = {len(FILTERS)}
), steps as (
  select o, i as step, o[i] as filter from orders, letter
), gone as (
  select part, o, f, n, good, toxic, list_position(list_transform(o, lambda x: f[x]), true) as hit from counted, orders
), figures as (
  select g.part, s.o, s.step, s.filter,
    coalesce(sum(n) filter (coalesce(hit > step, true)), 0) as kept, coalesce(sum(n) filter (hit = step), 0) as removed,
    coalesce(sum(n) filter (f[filter] and hit < step), 0) as redundant,
    coalesce(sum(n) filter (f[filter] and len(list_filter(f, lambda x: x)) = 1), 0) as unique_fails,
    coalesce(sum(good) filter (hit = step), 0) as good_lost, coalesce(sum(toxic) filter (hit = step), 0) as toxic_lost
  from gone g join steps s on g.o = s.o group by all
)
select part, array_to_string(list_transform(o, lambda x: '{FILTERS}'[x]), '') as filter_order, step::int as step, kept::bigint as kept,
  removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost,
  toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, filter))::bigint as shapley
from figures
"""

RUN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RESAMPLE = rf"""
with recursive crc(i, k, c) as (
  select range, 0, range::bigint from range(256)
  union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from crc where k < 8
), table_of as (
  select list(c order by i) as t from crc where k = 8
), texts as (
  select true as corpus, doc_id as id, text from documents union all select false, item_id, text from benchmark
), cut as (
  select row_number() over () as row, corpus, id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{RUN_WORD}') as w from texts
), runs as (
  select row, corpus, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as run from cut
), hashed as (
  select run, xor(4294967295, list_reduce(
    list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(run)), '..'), lambda x: ('0x' || x)::bigint)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % {resample.BUCKETS} as bucket
  from (select distinct run from runs), table_of
), counts as (
  select bucket, count(*) filter (corpus) as s, count(*) filter (not corpus) as t from runs join hashed using (run) group by bucket
), gain as (
  select bucket, floor(1000 * ln(((t + 1) * (sum(s) over () + {resample.BUCKETS}))::double / ((s + 1) * (sum(t) over () + {resample.BUCKETS}))::double))::bigint as g
  from counts
), sums as (
  select row, count(*) as n, sum(g)::bigint as total from runs join hashed using (run) join gain using (bucket) where corpus group by row
), scored as (
  select id as doc_id, len(w) as n_words, coalesce(n, 0) as n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::bigint as weight,
    (('0x' || substr(sha256('{resample.SEED}:' || coalesce(id::varchar, 'null')), 1, 8))::bigint + 0.5) / 4294967296.0 as u
  from cut left join sums using (row) where corpus
), noisy as (
  select *, weight + floor(-1000 * ln(-ln(u::double)))::bigint as score, n_words >= {resample.MIN_WORDS} as fit from scored
), ranked as (
  select *, row_number() over (partition by fit order by score desc, doc_id nulls first, n_features, weight) as r, count(*) filter (fit) over () as all_fit from noisy
)
select doc_id, n_features::bigint as n_features, weight, score, case when fit and r <= {resample.PERCENT} * all_fit // 100 then r end as rank
from ranked
"""

ORACLE = {
    "op3_chat_format": CHAT, "op5_line_dedup": LINES, "op8_mixing": MIX, "op9_quality_rules": QUALITY, "op10_sharding": SHARDING,
    "op11_filter_audit": AUDIT, "op13_resampling": RESAMPLE,
}
