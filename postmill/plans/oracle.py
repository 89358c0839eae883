"""The SQL twins of the queries, for DuckDB over the same tables."""

from __future__ import annotations

from postmill.plans.views import with_views

SPACE = "' ' || chr(9) || chr(10) || chr(13) || chr(11)"
HTML5 = (
    r"'^[a-zA-Z0-9.!#$%&''*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
    r"(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*\z'"
)
ROW = "message_id, kind, seq, t1, t2, address"

SQL: dict[str, str] = {}


def blank(c: str) -> str:
    return f"({c} is null or {c} in ('', '0'))"


def valid(c: str) -> str:
    return f"(regexp_matches({c}, {HTML5}) and not contains({c}, chr(10)) and not contains({c}, chr(13)))"


def secured(c: str) -> str:
    return f"trim(replace(replace({c}, chr(13), ''), chr(10), ''), {SPACE})"


CLEAN = f"""clean as (
  select message_id, kind_rank, kind, seq, t1, t2, trim(address, {SPACE}) as address, {secured('name')} as name
  from raw_recipients)"""

REASON = """case when not contains(address, '@') then 'invalid_address'
       when kind not in ('to', 'cc', 'bcc', 'Reply-To') then 'Invalid recipient kind'
       when not {valid} then 'invalid_address' end"""

ACCEPTED = f"""{CLEAN},
accepted as (
  select * from clean where {REASON.format(valid=valid('address'))} is null
  qualify row_number() over (partition by message_id, kind = 'Reply-To', lower(address)
                             order by kind_rank, seq, t1, t2, address) = 1)"""

SQL["clean_recipients"] = f"with {CLEAN} select {ROW}, name from clean"
SQL["domain_of_address"] = f"""
select {ROW}, case when contains(address, '@') then regexp_extract(address, '[^@]*$') else '' end as domain
from raw_recipients"""
SQL["validate_addresses"] = f"""
with {CLEAN} select {ROW}, coalesce({REASON.format(valid=valid('address'))}, '') as reason from clean"""
NOREGEX = "(strlen(address) >= 3 and strpos(address, '@') >= 2 and strpos(address, '@') <> length(address))"
SQL["validate_addresses_noregex"] = f"""
with {CLEAN} select {ROW}, coalesce({REASON.format(valid=NOREGEX)}, '') as reason from clean"""
REJECTS = f"""{CLEAN},
judged as (select *, {REASON.format(valid=valid('address'))} as reason,
  lower(case when contains(address, '@') then regexp_extract(address, '[^@]*$') else '' end) as domain from clean),
repeats as (select 'duplicate' as reason, domain from judged where reason is null
  qualify row_number() over (partition by message_id, kind = 'Reply-To', lower(address) order by seq, t1, t2) > 1),
rejects as (select reason, domain, count(*) as n
  from (select reason, domain from judged where reason is not null union all select * from repeats) group by all)"""
SQL["reject_reasons"] = f"with {REJECTS} select reason, domain, n from rejects"
SQL["top_rejected_domains"] = f"""
with {REJECTS} select domain, cast(sum(n) as bigint) as n from rejects group by domain order by n desc, domain limit 5"""
SQL["pattern_agreement"] = f"""
with {CLEAN} select cast({valid('address')} as bigint) as html5, cast({NOREGEX} as bigint) as noregex, count(*) as n
from clean group by 1, 2"""
SQL["header_injection_scan"] = f"""
select message_id, field, md5({secured('value')}) as cleaned_md5
from (select message_id, 'body' as field, body as value from messages_text
      union all select message_id, 'source', source from messages_text
      union all select message_id, 'lang', lang from messages_text)
where contains(value, chr(10)) or contains(value, chr(13))"""
SQL["dedup_recipients"] = f"""
select {ROW}, name from recipients where {valid('address')}
qualify row_number() over (partition by message_id, lower(address) order by kind_rank, seq, t1, t2, address) = 1"""
SQL["dedup_reply_to"] = f"with {ACCEPTED} select {ROW} from accepted"
SQL["dedup_idn"] = f"""
with rows as (
  select *, cast(strlen(address) <> length(address) as bigint) as pass from idn_recipients),
queue as (
  select * from rows where pass = 1
  qualify row_number() over (partition by message_id, kind = 'Reply-To', address order by kind_rank, seq, t1, t2) = 1),
handled as (
  select message_id, kind_rank, kind, seq, t1, t2, pass, address from rows where pass = 0
  union all
  select message_id, kind_rank, kind, seq, t1, t2, pass,
         replace(replace(replace(address, 'françois.ch', 'xn--franois-xxa.ch'), 'FRANÇOIS.CH', 'xn--franois-xxa.ch'),
                 'straße.example', 'strasse.example') from queue)
select {ROW}, pass from handled where {valid('address')}
qualify row_number() over (partition by message_id, kind = 'Reply-To', lower(address)
                           order by pass, kind_rank, seq, t1, t2) = 1"""
IDN_ASCII = "replace(replace(replace({c}, 'françois.ch', 'xn--franois-xxa.ch'), 'FRANÇOIS.CH', 'xn--franois-xxa.ch'), 'straße.example', 'strasse.example')"
SQL["recipient_counts_idn"] = f"""
with accepted as ({SQL['dedup_idn']})
select message_id, count(*) filter (kind = 'to') as n_to, count(*) filter (kind = 'cc') as n_cc,
  count(*) filter (kind = 'bcc') as n_bcc, count(*) filter (kind = 'Reply-To') as n_reply_to,
  count(*) filter (kind <> 'Reply-To') as n_total from accepted group by message_id"""
SQL["reject_reasons_idn"] = f"""
with rows as (
  select message_id, kind, {IDN_ASCII.format(c='address')} as address from idn_recipients),
judged as (
  select *, lower(split_part(address, '@', 2)) as domain, {valid('address')} as fits from rows)
select 'invalid_address' as reason, domain, count(*) as n from judged where not fits group by domain
union all
select 'duplicate', domain, cast(sum(more) as bigint) from (
  select domain, count(*) - 1 as more from judged where fits group by message_id, kind = 'Reply-To', lower(address), domain)
where more > 0 group by domain"""
SQL["recipient_headers"] = f"""
with {ACCEPTED},
entries as (
  select *, case kind when 'to' then 'To' when 'cc' then 'Cc' when 'bcc' then 'Bcc' else kind end as label,
    case when {blank('name')} then address
         when regexp_matches(name, '^[A-Za-z0-9!#$%&''*+/=?^_`{{|}}~ -]*$') then name || ' <' || address || '>'
         else '"' || replace(replace(name, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '" <' || address || '>'
    end as entry
  from accepted)
select message_id, label as kind, cast(0 as bigint) as segment,
       label || ': ' || string_agg(entry, ', ' order by kind_rank, seq, t1, t2, address) as header
from entries group by message_id, label
union all
select message_id, 'To', 0, 'To: undisclosed-recipients:;' from accepted
group by message_id having count(*) filter (kind in ('to', 'cc')) = 0"""
SQL["recipient_counts"] = f"""
with {ACCEPTED} select message_id, count(*) filter (kind = 'to') as n_to, count(*) filter (kind = 'cc') as n_cc,
  count(*) filter (kind = 'bcc') as n_bcc, count(*) filter (kind = 'Reply-To') as n_reply_to,
  count(*) filter (kind <> 'Reply-To') as n_total from accepted group by message_id"""
SQL["no_recipient_messages"] = f"""
with {ACCEPTED} select message_id, 'provide_address' as error from messages m
where not exists (select 1 from accepted a where a.message_id = m.message_id and a.kind <> 'Reply-To')"""
SQL["single_to"] = f"""
with {ACCEPTED} select m.message_id, m.subject, a.address as copy_to, a.name as copy_name
from messages m join accepted a on a.message_id = m.message_id where a.kind = 'to'"""
SQL["recipient_order"] = f"""
with {ACCEPTED} select {ROW}, row_number() over (partition by message_id
  order by case kind when 'to' then 0 when 'cc' then 1 else 2 end, seq, t1, t2, address) as position
from accepted where kind <> 'Reply-To'"""
SQL["envelope"] = f"with {ACCEPTED} select message_id, kind, address from accepted where kind <> 'Reply-To'"
SQL["suppress"] = f"select {ROW} from raw_recipients where kind not in ('cc', 'bcc')"
SQL["suppress_all"] = f"select {ROW} from raw_recipients where kind not in ('to', 'cc', 'bcc')"
SQL["parse_address_lists"] = f"""
with pieces as (
  select list_id, unnest(range(len(string_split(addresses, ',')))) as pos,
         trim(unnest(string_split(addresses, ',')), {SPACE}) as piece from address_lists),
parsed as (
  select list_id, pos,
    case when contains(piece, '<') then trim(replace(replace(split_part(piece, '<', 1), '"', ''), '''', ''), {SPACE})
         else '' end as name,
    case when contains(piece, '<') then trim(replace(split_part(piece, '<', 2), '>', ''), {SPACE}) else piece end as address
  from pieces)
select list_id, pos, name, address from parsed where {valid('address')}"""

# Messages

SQL["validate_envelope_fields"] = f"""
with fields as (
  select message_id, 1 as rank, 'from_address' as field, trim(from_address, {SPACE}) as address from messages
  union all select message_id, 2, 'sender', trim(sender, {SPACE}) from messages
  union all select message_id, 3, 'confirm_to', trim(confirm_to, {SPACE}) from messages),
bad as (
  select * from fields where not {blank('address')} and not {valid('address')}
  qualify row_number() over (partition by message_id order by rank) = 1)
select m.message_id, coalesce(b.field, '') as bad_field, coalesce(b.address, '') as bad_value
from messages m left join bad b on b.message_id = m.message_id"""
SQL["default_sender"] = f"""
select message_id, case when {blank('sender')} then trim(from_address) else sender end as sender,
       case when {blank('sender')} then trim(from_address) else sender end as envelope_sender from messages"""
SQL["non_empty_gate"] = f"""
select message_id, case when {blank('body')} then 'empty_message' else '' end as error from messages"""
SQL["message_ids"] = """
select message_id, case when regexp_matches(given_id, '^<.*@.*>$') then given_id
       else '<' || md5(cast(message_id as varchar)) || '@mx.example.com>' end as message_ref from messages"""
TYPED = f"""flags as (
  select message_id, max(cast(disposition = 'inline' as bigint)) as has_inline,
         max(cast(disposition = 'attachment' as bigint)) as has_attachment from attachments group by message_id),
flagged as (
  select m.*, coalesce(f.has_inline, 0) as has_inline, coalesce(f.has_attachment, 0) as has_attachment
  from messages m left join flags f on f.message_id = m.message_id),
typed as (
  select *, coalesce(nullif(concat_ws('_', case when not {blank('alt_body')} then 'alt' end,
    case when has_inline = 1 then 'inline' end, case when has_attachment = 1 then 'attach' end), ''), 'plain') as message_type
  from flagged)"""
SQL["attachment_flags"] = f"with {TYPED} select message_id, has_inline, has_attachment from flagged"
SQL["message_type"] = f"with {TYPED} select message_id, message_type from typed"
SQL["content_type"] = f"""
with {TYPED} select message_id, message_type,
  case when message_type = 'inline' then 'multipart/related'
       when message_type in ('alt', 'alt_inline') then 'multipart/alternative'
       when message_type = 'plain' then content_type || '; charset=' || charset
       else 'multipart/mixed' end as full_type from typed"""


def long_line(c: str) -> str:
    return f"(len(list_filter(string_split({c}, chr(10)), lambda x: strlen(x) >= 1000)) > 0)"


ENTITY_PAIRS = (
    ("&quot;", '"'), ("&#039;", "''"), ("&#39;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&middot;", "·"), ("&copy;", "©"),
    ("&amp;", "&"),
)
QUOTED = r"""(?:"[^"]*(?:"|\z)|''[^'']*(?:''|\z))"""
MARKUP = rf"""(?s)<!--.*?(?:-->|\z)|<(?:>|(?:[^\s>"'']|{QUOTED})[^>"'']*(?:{QUOTED}[^>"'']*)*(?:>|\z))"""


def page_text(c: str) -> str:
    elements = "(?is)" + "|".join(f"<{n}[^>]*>.*?</{n}>" for n in ("head", "title", "style", "script"))
    text = f"trim(regexp_replace(regexp_replace({c}, '{elements}', '', 'g'), '{MARKUP}', '', 'g'), {SPACE})"
    for entity, char in ENTITY_PAIRS:
        text = f"replace({text}, '{entity}', '{char}')"
    return text


def crlf(c: str) -> str:
    lf = f"replace(replace({c}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    return f"replace({lf}, chr(10), chr(13) || chr(10))"


NOTICE = (
    "'To view this email message, open it in a program that understands HTML!' || chr(13) || chr(10) || chr(13) || chr(10)"
)


def alt_text(c: str) -> str:
    text = crlf(page_text(c))
    return f"case when {text} in ('', '0') then {NOTICE} else {text} end"


SQL["transfer_encoding"] = f"""
with all_messages as (
  select message_id, body, alt_body, encoding, charset from messages_text
  union all
  select -1 - message_id, body, {alt_text('body')}, encoding, charset from messages_html),
bodies as (
  select *, {long_line('body')} as long_body, {long_line('alt_body')} as long_alt,
         strlen(body) = length(body) as plain_body, strlen(alt_body) = length(alt_body) as plain_alt from all_messages)
select message_id,
  case when long_body then 'quoted-printable' when plain_body then '7bit' else '8bit' end as body_encoding,
  case when plain_body then 'us-ascii' else charset end as body_charset,
  case when long_body then 'quoted-printable' else '8bit' end as message_encoding,
  case when long_alt or long_body then 'quoted-printable' when plain_alt then '7bit' else '8bit' end as alt_encoding,
  case when plain_alt and not long_body then 'us-ascii' else charset end as alt_charset
from bodies"""
SQL["part_layout"] = f"""
with {TYPED},
layout(message_type, pos, part, level) as (values
  ('plain', 1, 'body', 0), ('inline', 1, 'body', 1), ('inline', 2, 'inline', 1), ('attach', 1, 'body', 1),
  ('attach', 2, 'attachment', 1), ('inline_attach', 1, 'multipart/related', 1), ('inline_attach', 2, 'body', 2),
  ('inline_attach', 3, 'inline', 2), ('inline_attach', 4, 'attachment', 1), ('alt', 1, 'text/plain', 1),
  ('alt', 2, 'text/html', 1), ('alt', 3, 'text/calendar', 1), ('alt_inline', 1, 'text/plain', 1),
  ('alt_inline', 2, 'multipart/related', 1), ('alt_inline', 3, 'text/html', 2), ('alt_inline', 4, 'inline', 2),
  ('alt_attach', 1, 'multipart/alternative', 1), ('alt_attach', 2, 'text/plain', 2), ('alt_attach', 3, 'text/html', 2),
  ('alt_attach', 4, 'attachment', 1), ('alt_inline_attach', 1, 'multipart/alternative', 1),
  ('alt_inline_attach', 2, 'text/plain', 2), ('alt_inline_attach', 3, 'multipart/related', 2),
  ('alt_inline_attach', 4, 'text/html', 3), ('alt_inline_attach', 5, 'inline', 3), ('alt_inline_attach', 6, 'attachment', 1)),
placed as (
  select t.message_id, t.message_type, cast(l.pos as bigint) as pos, l.part, cast(l.level as bigint) as level
  from typed t join layout l on l.message_type = t.message_type
  where l.part <> 'text/calendar' or not {blank('t.ical')})
select message_id, message_type, pos, part, level, cast(0 as bigint) as seq, cast(0 as bigint) as t1, cast(0 as bigint) as t2
from placed where part not in ('inline', 'attachment')
union all
select p.message_id, message_type, pos, part, level, cast(a.seq as bigint), a.t1, a.t2
from placed p join attachments a on a.message_id = p.message_id and a.disposition = p.part"""
SIZES = """sizes as (
  select message_id, count(*) as n_parts, cast(sum(case when encoding = 'base64'
    then ceil(n_bytes / 3.0) * 4 + ceil(ceil(n_bytes / 3.0) * 4 / 76.0) * 2 else n_bytes + 2 end) as bigint) as encoded_bytes
  from attachments group by message_id)"""
SQL["message_size"] = f"with {SIZES} select *, cast(encoded_bytes <= 20000 as bigint) as fits from sizes"
SQL["largest_messages"] = f"with {SIZES} select * from sizes order by encoded_bytes desc, message_id limit 10"
# Quoted-printable byte by byte: a fold over classes (1 stays, 3 is escaped, 0 stays at the end of a line), the state 128 * bytes + column.
SQL["message_size_quoted"] = f"""
with split as (
  select *, row_number() over () as part, string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) as ls from text_parts
), lines as (
  select part, unnest(ls) as line, generate_subscripts(ls, 1) as k, len(ls) as n from split where encoding = 'quoted-printable'
), bytes as (
  select part, k, n, line, regexp_extract_all(hex(encode(line)), '..') as b from lines
), classes as (
  select part, k, n, len(b) as nb, b, list_transform(b, lambda x, i: case
    when x in ('20', '09') and i = len(b) then 3
    when x = '2E' and i = 1 and (len(b) = 1 or b[2] = '00') then 3
    when x <> '3D' and (x = '09' or x between '20' and '7E') then case when i = len(b) then 0 else 1 end
    else 3 end) as c from bytes
), folded as (
  select part, k, n, nb, b, c, list_reduce(list_prepend(0::bigint, list_transform(
      case when k < n and nb > 0 and b[nb] in ('20', '09') then c[:nb - 1] else c end, lambda x: x::bigint)),
    lambda s, x: case when x = 0 then s + 128 + 1
      when x = 1 then case when s % 128 >= 75 then s - s % 128 + 128 * 4 + 1 else s + 128 + 1 end
      else case when s % 128 >= 73 then s - s % 128 + 128 * 6 + 3 else s + 128 * 3 + 3 end end) as s from classes
), quoted as (
  select part, (sum(s // 128 + case when k < n and nb > 0 and b[nb] in ('20', '09') then 3 else 0 end) + 2 * (count(*) - 1))::bigint as size
  from folded group by part
), sizes as (
  select message_id, count(*) as n_parts, sum(case encoding when 'binary' then n_bytes when 'quoted-printable' then size
    else (n_bytes + 2) // 3 * 4 + ((n_bytes + 2) // 3 * 4 + 75) // 76 * 2 end)::bigint as encoded_bytes
  from split left join quoted using (part) group by message_id
)
select *, cast(encoded_bytes <= 4000 as bigint) as fits from sizes"""
SQL["text_size"] = f"""
select message_id, cast(strlen({crlf('body')}) + case when right(body, 1) in (chr(10), chr(13)) then 0 else 2 end as bigint)
  as encoded_bytes from messages_text"""
SQL["duplicate_headers"] = f"""
with prints as (
  select message_id, to_base64(unhex(sha256('from:' || trim(regexp_replace(trim(from_address), '\\s+', ' ', 'g'))
    || chr(13) || chr(10) || 'to:c.' || cast(o_custkey % 10 as varchar) || '@example.com, x@example.com'
    || chr(13) || chr(10) || 'date:' || strftime(sent_at, '%Y')
    || chr(13) || chr(10) || 'subject:' || o_orderstatus))) as fingerprint from messages)
select fingerprint, count(*) as n, min(message_id) as first_id, max(message_id) as last_id
from prints group by fingerprint having count(*) > 1"""
SQL["error_totals"] = """
select m.message_id, count(e.message_id) as n_errors, cast(count(e.message_id) > 0 as bigint) as is_error,
  coalesce(max_by(e.message_key, e.seq), '(none)') as last_error
from messages m left join errors e on m.message_id = e.message_id group by m.message_id"""
HEADERS = f"""split_headers as (
  select message_id, seq, trim(case when contains(raw, ':') then left(raw, strpos(raw, ':') - 1) else raw end, {SPACE}) as name,
         case when contains(raw, ':') then trim(substr(raw, strpos(raw, ':') + 1), {SPACE}) end as value from raw_headers)"""
SQL["custom_headers"] = f"with {HEADERS} select message_id, seq, name, coalesce(value, '(none)') as value from split_headers"
SQL["header_frequency"] = f"""
with {HEADERS} select name, count(*) as n, count(value) as n_valued, coalesce(max(value), '') as top_value
from split_headers group by name"""

# Attachments

TYPES = """types(ext, mime) as (values ('pdf', 'application/pdf'), ('png', 'image/png'), ('jpg', 'image/jpeg'),
  ('docx', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'))"""
SQL["mime_types"] = f"""
with {TYPES},
cut as (select *, split_part(path, '?', 1) as plain from file_names),
trimmed as (select *, regexp_replace(plain, '[/.\\\\]*$', '') as whole from cut),
parts as (
  select *, regexp_extract(whole, '[^/\\\\]*$') as basename from trimmed),
named as (
  select *, case when contains(basename, '.') then regexp_extract(basename, '[^.]*$') else '' end as extension,
    regexp_replace(left(whole, length(whole) - length(basename)), '[/\\\\]*$', '') as dirname from parts)
select file_id, t1, t2, path, dirname, basename,
       case when extension = '' then basename else left(basename, length(basename) - length(extension) - 1) end as filename,
       extension, coalesce(t.mime, 'application/octet-stream') as mime
from named n left join types t on t.ext = lower(n.extension)"""
SQL["blob_attachments"] = """
select cust_id, full_name || '.jpg' as name, 'image/jpeg' as mime, 'attachment' as disposition, 'base64' as encoding,
       strlen(photo) as n_bytes from mailinglist where not sent and photo <> ''"""
SQL["attachment_dedup"] = """
with once as (
  select * from attachments
  qualify row_number() over (partition by message_id, name, disposition, encoding, cid order by seq, t1, t2, n_bytes) = 1)
select message_id, cast(seq as bigint) as seq, t1, t2, name, disposition, cid, n_bytes from once
qualify disposition <> 'inline'
  or row_number() over (partition by message_id, disposition, cid order by seq, t1, t2, n_bytes) = 1"""
SQL["attachment_inventory"] = """
with typed as (
  select *, case when name like '%.pdf' then 'application/pdf' when name like '%.PNG' then 'image/png'
                 else 'application/octet-stream' end as mime from attachments)
select case when grouping(mime) = 1 then 'all' else mime end as mime,
       case when grouping(disposition) = 1 then 'all' else disposition end as disposition,
       case when grouping(encoding) = 1 then 'all' else encoding end as encoding,
       count(*) as n, cast(sum(n_bytes) as bigint) as n_bytes
from typed group by rollup(mime, disposition, encoding)"""


def references(attrs: str) -> str:
    return f"""found as (
  select page_id, regexp_extract_all(html, '(?i)(?:{attrs})=["''].*?["'']') as refs from pages_media),
listed as (select page_id, unnest(range(len(refs))) as pos, unnest(refs) as ref from found),
links as (
  select page_id, pos, ref, lower(split_part(ref, '=', 1)) as attr,
    substr(ref, length(split_part(ref, '=', 1)) + 3, length(ref) - length(split_part(ref, '=', 1)) - 3) as url from listed),
refs as (
  select *, regexp_extract(url, '^data:(image[^;,]*)(;base64)?,', 1) as mime, md5(url) || '@inline.0' as cid,
    case when regexp_matches(url, '^data:image[^;,]*(;base64)?,') then 'data_uri'
         when url like 'cid:%' then 'cid' when regexp_matches(url, '^[A-z]+://') then 'absolute'
         else 'relative' end as class from links)"""


SQL["missing_attachments"] = f"""
with {references('src|background')}
select page_id, pos, url as path, 'file_access' as error from refs
where class = 'relative' and url not in (select url from assets)"""

# Campaigns

SQL["pending_recipients"] = "select full_name, email, photo from mailinglist where not sent"
SQL["campaign_messages"] = """
select campaign, cust_id, email, 'News for ' || n_name as subject
from mailinglist join nation on n_nationkey = campaign where not sent"""
SQL["send_until_failure"] = """
select session_id, event_id from delivery_log
qualify max(cast(not is_sent as int)) over (partition by session_id order by event_id
  rows between unbounded preceding and current row) = 0"""
SQL["mark_sent"] = """
select cust_id, email, cast(sent or email in (select email from mailinglist where cust_id % 7 = 0) as bigint) as sent
from mailinglist"""

# Body texts

CRLF = "chr(13) || chr(10)"
SQL["line_break_profile"] = f"""
with counted as (
  select source, (length(body) - length(replace(body, {CRLF}, ''))) // 2 as crlf,
    length(body) - length(replace(body, chr(13), '')) as cr, length(body) - length(replace(body, chr(10), '')) as lf,
    strlen({crlf('body')}) as bytes from messages_text)
select source, count(*) as n_docs, cast(sum(crlf) as bigint) as n_crlf, cast(sum(cr - crlf) as bigint) as n_cr,
  cast(sum(lf - crlf) as bigint) as n_lf, cast(sum(bytes) as bigint) as normalised_bytes from counted group by source"""
SQL["long_line_profile"] = f"""
select source, count(*) as n_docs, count(*) filter ({long_line('body')}) as n_long from messages_text group by source"""
SQL["charset_profile"] = """
select lang, source, count(*) as n_docs, count(*) filter (strlen(body) <> length(body)) as n_8bit,
  cast(sum(strlen(body) - length(body)) as bigint) as extra_bytes from messages_text group by lang, source"""
# One letter per byte: every 8-bit character becomes as many x as it has bytes.
BYTES = (
    r"regexp_replace(regexp_replace(regexp_replace({c}, '[\x{{80}}-\x{{7FF}}]', 'xx', 'g'),"
    r" '[\x{{800}}-\x{{FFFF}}]', 'xxx', 'g'), '[\x{{10000}}-\x{{10FFFF}}]', 'xxxx', 'g')"
)
WIRE = f"""lines as (
  select message_id, unnest(range(len(parts))) as line_no, unnest(parts) as line
  from (select message_id, string_split(replace(replace({BYTES.format(c='body')}, {CRLF}, chr(10)), chr(13), chr(10)), chr(10)) as parts
        from messages_text)),
wire(message_id, line_no, rest, soft, hard) as (
  select message_id, line_no, line, 0, 0 from lines where length(line) > 998
  union all
  select message_id, line_no,
    case when last > 0 then substr(rest, last + 2) else substr(rest, 998) end,
    soft + case when last > 0 then 1 else 0 end, hard + case when last > 0 then 0 else 1 end
  from (select *, case when contains(left(rest, 998), ' ') then length(regexp_extract(left(rest, 998), '^(.*) ', 1)) else 0 end as last
        from wire where length(rest) > 998)),
splits as (
  select message_id, sum(soft) as soft, sum(hard) as hard from wire where length(rest) <= 998 group by message_id),
audit as (
  select l.message_id, count(*) as n_lines, count(*) filter (length(line) > 998) as n_long,
    count(*) filter (line like '.%') as n_dots, cast(coalesce(max(s.soft), 0) as bigint) as n_soft,
    cast(coalesce(max(s.hard), 0) as bigint) as n_hard
  from lines l left join splits s on s.message_id = l.message_id group by l.message_id)"""
SQL["wire_line_audit"] = f"with recursive {WIRE} select message_id, n_lines, n_long, n_dots, n_soft, n_hard from audit"
SQL["wire_line_totals"] = f"""with recursive {WIRE}
select count(*) as n_docs, cast(sum(n_lines) as bigint) as n_lines, cast(sum(n_long) as bigint) as n_long,
  cast(sum(n_dots) as bigint) as n_dots, cast(sum(n_soft) as bigint) as n_soft, cast(sum(n_hard) as bigint) as n_hard from audit"""
SQL["header_encoding_profile"] = rf"""
with needs as (
  select strlen({secured('body')}) as bytes,
    strlen(regexp_replace({secured('body')}, '[^\x00-\x08\x0B\x0C\x0E-\x1F\x{{7F}}-\x{{10FFFF}}]', '', 'g')) as need
  from messages_text)
select case when need = 0 then 'none' when need * 3 > bytes then 'B' else 'Q' end as scheme, count(*) as n,
  cast(sum(bytes) as bigint) as n_bytes, cast(sum(need) as bigint) as n_encoded from needs group by 1"""
PRINTS = f"""bodies as (
  select message_id, case when body = '' then {CRLF}
    else regexp_replace(replace(replace(body, {CRLF}, chr(10)), chr(10), {CRLF}), '(?:\\r\\n){{2,}}\\z', chr(13) || chr(10)) end as canonical
  from messages_text),
prints as (
  select message_id, strlen(canonical) as canonical_bytes, to_base64(unhex(sha256(canonical))) as fingerprint from bodies)"""
SQL["canonical_fingerprint"] = f"with {PRINTS} select message_id, canonical_bytes, fingerprint from prints"
SQL["duplicate_bodies"] = f"""
with {PRINTS} select fingerprint, count(*) as n, min(message_id) as first_id, max(message_id) as last_id
from prints group by fingerprint having count(*) > 1"""
SQL["reflow"] = """
with paragraphs as (
  select message_id, unnest(range(len(parts))) as p, unnest(parts) as line
  from (select message_id, string_split(regexp_replace(body, '\\n\\z', ''), chr(10)) as parts from messages_text)),
folded as (
  select message_id, p, list_reduce(
    list_transform(string_split(line, ' '), lambda w: {'done': '', 'open': w}),
    lambda a, w: case when strlen(a.open) + 1 + strlen(w.open) > 72 and a.open <> ''
      then {'done': a.done || a.open || chr(10), 'open': w.open}
      else {'done': a.done, 'open': a.open || ' ' || w.open} end) as f
  from paragraphs),
texts as (
  select message_id, string_split(string_agg(f.done || f.open, chr(10) order by p), chr(10)) as lines
  from folded group by message_id)
select message_id, unnest(range(len(lines))) as line_no, md5(unnest(lines)) as line_md5 from texts"""

# Pages

SQL["html_to_text"] = f"""
select page_id, strlen(text) as n_bytes, md5(text) as text_md5 from (select page_id, {page_text('html')} as text from pages_media)"""
SQL["html_to_text_full"] = SQL["html_to_text"]
SQL["alt_bodies"] = f"select page_id, md5({alt_text('html')}) as alt_md5 from pages_media"
SQL["asset_references"] = f"""
with {references('src|background|href')} select page_id, pos, attr, url, class, mime, cid from refs"""
SQL["url_policy"] = rf"""
with {references('src|background|href')},
parsed as (
  select *, trim(url, {SPACE}) as u, lower(regexp_extract(trim(url, {SPACE}), '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) as scheme,
    regexp_extract(trim(url, {SPACE}), '^[^:]*:(?://[^/?#]*)?([^?#]*)', 1) as path from refs),
judged as (
  select *, case when u = '' then 'empty' when strlen(u) <> length(u) or regexp_matches(u, '[\x00-\x1F]') then 'invalid'
    when scheme in ('mailto', 'http', 'https', 'ftp') then case when attr = 'href' or path <> '' then 'keep' else 'blocked' end
    when scheme in ('outbind', 'cid') then 'keep' when scheme <> '' then 'scheme' else 'relative' end as verdict from parsed)
select page_id, pos, verdict, case when verdict = 'keep' then u
  when verdict = 'invalid' and attr = 'href' then 'http://invalid-stuff-detected.example.com' else 'blank.png' end as safe_url
from judged"""
TAG = r"""</?[A-Za-z][^>=]*(?:=\s*(?:"[^"]*"|''[^'']*'')?[^>=]*)*>"""
TAGS = rf"""found as (
  select page_id, list_filter(regexp_extract_all(html, '(?s)<!--.*?(?:-->|\z)|{TAG}'), lambda t: not starts_with(t, '<!--')) as parts
  from {{source}}),
tag_rows as (
  select page_id, unnest(range(len(parts))) as pos, unnest(parts) as tag from found),
named as (
  select *, lower(regexp_extract(tag, '^</?([A-Za-z][\w-]*)', 1)) as name from tag_rows),
kinds as (
  select *, case when starts_with(tag, '</') then 'close'
    when ends_with(tag, '/>') or name in ('img', 'br', 'hr', 'input', 'outbind') then 'self' else 'open' end as kind from named)"""
SQL["tags"] = f"with {TAGS.format(source='pages_media')} select page_id, pos, name, kind, md5(tag) as tag_md5 from kinds"
WITH_CONTENT = ("script", "applet", "embed", "title", "frameset", "xmp", "xml")
REMOVABLE = r"(?is)<!--.*?(?:-->|\z)|" + "|".join(
    rf"(<{n}(?:\s(?:[^>]*[^/>])?)?>).*?(?:</{n}\s*>|\z)" for n in WITH_CONTENT
) + r"|<style(?:\s[^>]*)?>.*?(?:</\s*style\s*>|\z)"
AUDITED = rf"""audited as (
  select page_id, regexp_replace(html, '{REMOVABLE}', '\1\2\3\4\5\6\7', 'g') as html from pages_media)"""
REMOVED = "('object', 'meta', 'html', 'head', 'base', 'link', 'frame', 'iframe', 'plaintext', 'marquee')"
GONE = "('script', 'applet', 'embed', 'title', 'frameset', 'xmp', 'xml')"
SQL["policy_violations"] = rf"""
with {AUDITED}, {TAGS.format(source='audited')},
ruled as (
  select *, case when name in {REMOVED} then 'removed_tag'
    when name in {GONE} and not ends_with(tag, '/>') then 'removed_with_content' end as rule from kinds where kind <> 'close'),
attribute_rows as (
  select page_id, unnest(regexp_extract_all(regexp_replace(tag, '(?s)^<[A-Za-z][\w-]*|/?>$', '', 'g'),
    '(?s)([\w-]+)(?:\s*=\s*("[^"]*"|''[^'']*''|[^\s>]*))?')) as a from ruled where rule is null),
attributes as (
  select page_id, lower(regexp_extract(a, '^[\w-]+')) as attr,
    regexp_replace(regexp_replace(regexp_replace(a, '(?s)^[\w-]+(?:\s*=\s*)?', ''), '(?s)^"(.*)"$|^''(.*)''$', '\1\2'), '\s', '', 'g') as value
  from attribute_rows),
hits as (
  select page_id, rule, name from ruled where rule is not null
  union all
  select page_id, case when regexp_matches(attr, '^(?:on|dynsrc|data|lowsrc)') then 'removed_attribute'
    when regexp_matches(attr, '^src|background|^href|action') and regexp_matches(value, '(?is)^\S+script:|^mocha|^about:') then 'script_value'
    when starts_with(attr, 'style') and regexp_matches(value, '(?i)expression|binding|behaviou*r|include-source|position:') then 'style_value'
    end, attr from attributes)
select page_id, rule, name, count(*) as n from hits where rule is not null group by all"""
SQL["tag_balance"] = f"""
with {AUDITED}, {TAGS.format(source='audited')},
counted as (
  select page_id, pos, case name when 'body' then 'div' else name end as name, case kind when 'open' then 1 else -1 end as step
  from kinds where kind <> 'self' and name not in {REMOVED} and name not in {GONE}),
running as (
  select *, sum(step) over (partition by page_id, name order by pos) as c from counted),
ends as (
  select page_id, name, least(min(c), 0) as low, arg_max(c, pos) as last from running group by page_id, name)
select page_id, name, cast(-low as bigint) as dropped, cast(last - low as bigint) as left_open
from ends where low < 0 or last - low > 0"""

# Replies and outcomes

REPLIES = """ends as (
  select *, coalesce(sum(cast(substr(line, 4, 1) = ' ' as int)) over (partition by session_id order by line_no
    rows between unbounded preceding and 1 preceding), 0) as reply_no from transcript_lines),
replies as (
  select session_id, cast(reply_no as bigint) as reply_no, command, cast(0 as bigint) as segment,
    min(line_no) as first_line_no, string_agg(line, chr(10) order by line_no) as reply from ends group by session_id, reply_no, command)"""
SQL["assemble_replies"] = f"with {REPLIES} select session_id, reply_no, first_line_no, command, segment, reply from replies"
CODES = r"""parsed as (
  select *, regexp_extract(reply, '^([0-9]{3})[ -](?:([0-9]\.[0-9]\.[0-9]) )?', 1) as code,
    regexp_extract(reply, '^([0-9]{3})[ -](?:([0-9]\.[0-9]\.[0-9]) )?', 2) as code_ex from replies),
detailed as (
  select *, regexp_replace(reply, code || '[ -]' || case when code_ex = '' then '' else replace(code_ex, '.', '\.') || ' ' end, '', 'g')
    as detail from parsed)"""
SQL["parse_replies"] = f"""
with {REPLIES}, {CODES} select session_id, reply_no, command, cast(code as bigint) as code, code_ex, detail from detailed"""
SQL["reply_classes"] = f"""
with {REPLIES}, {CODES} select cast(code as bigint) // 100 as code_class, code_ex, count(*) as n,
  cast(sum(strlen(detail)) as bigint) as detail_bytes from detailed group by 1, 2"""
UNEXPECTED = """
select event_id, command, cast(left(reply, 3) as bigint) as code, substr(reply, 11) as detail
from delivery_log where not (left(reply, 3) = '250' or (command = 'RCPT TO' and left(reply, 3) = '251'))"""
SQL["unexpected_replies"] = UNEXPECTED
CAPS = f"""caps as (
  select server, command, unnest(range(len(lines))) as pos, trim(substr(unnest(lines), 5), {SPACE}) as text
  from (select server, command, string_split(reply, chr(10)) as lines from ehlo_replies)),
extensions as (
  select server, pos, case when pos = 0 then command else split_part(text, ' ', 1) end as extension,
    case when pos = 0 then split_part(text, ' ', 1)
         when split_part(text, ' ', 1) = 'SIZE' then case when contains(text, ' ') then split_part(text, ' ', 2) else '0' end
         when split_part(text, ' ', 1) = 'AUTH' then regexp_replace(text, '^AUTH ?', '') else 'true' end as args
  from caps where text not in ('', '0'))"""
SQL["capabilities"] = f"""
with {CAPS} select server, extension, args from extensions
qualify row_number() over (partition by server, extension order by pos desc) = 1"""
SQL["server_auth"] = f"""
with {CAPS} select server, count(distinct extension) as n_caps,
  coalesce(max(args) filter (extension = 'SIZE'), '') as size_limit,
  coalesce(max(case when extension <> 'AUTH' then null when list_contains(string_split(args, ' '), 'LOGIN') then 'LOGIN'
    when list_contains(string_split(args, ' '), 'PLAIN') then 'PLAIN'
    when list_contains(string_split(args, ' '), 'XOAUTH2') then 'XOAUTH2' end), '') as auth
from extensions group by server"""
SQL["capability_rollup"] = f"with {CAPS} select extension, count(distinct server) as n_servers from extensions group by extension"
SQL["send_outcome"] = """
with counted as (
  select message_id, count(*) filter (accepted) as n_accepted, count(*) filter (not accepted) as n_rejected
  from rcpt_results group by message_id)
select *, cast(n_accepted > 0 as bigint) as data_sent,
  case when n_rejected = 0 then 'sent' when n_accepted > 0 then 'partial' else 'failed' end as status from counted"""
SQL["failure_texts"] = """
select message_id, cast(0 as bigint) as segment,
  string_agg(address || ': ' || detail, '' order by attempt, t1, t2, address || ': ' || detail) as failures
from rcpt_results where not accepted group by message_id"""
SQL["relay_attempts"] = """
with usable as (
  select *, regexp_matches(trim(host), '^((ssl|tls)://)*([a-zA-Z0-9.-]*):?([0-9]*)$') as entry,
    row_number() over (partition by message_id order by attempt, t1, t2) as place from relay_attempts),
found as (
  select message_id, arg_min(host, place) filter (entry and ok) as worked,
    arg_max(error, place) filter (entry and not ok) as failed from usable group by message_id)
select message_id, cast(worked is not null as bigint) as connected, coalesce(worked, '') as host,
  case when worked is null then coalesce(failed, '') else '' end as error from found"""

# Catalogues and calendars

TEXTS = """texts as (
  select lang, message_key, arg_max(message, line_no) as message from translation_lines group by lang, message_key)"""
SQL["localise"] = f"""
with {TEXTS}
select e.event_id, e.lang, e.message_key, coalesce(o.message, f.message, e.message_key)
  || case when e.message_key = 'smtp_connect_failed' and coalesce(o.message, f.message) is not null then ' See the manual.' else '' end as text
from errors e left join texts o on o.lang = e.lang and o.message_key = e.message_key
left join texts f on f.lang = 'brand#1' and f.message_key = e.message_key"""
SQL["translation_coverage"] = f"""
with {TEXTS}, wanted as (select message_key from texts where lang = 'brand#1'),
others as (select lang, message_key from texts where lang <> 'brand#1')
select l.lang, w.message_key, 'missing' as problem from (select distinct lang from others) l, wanted w
where not exists (select 1 from others o where o.lang = l.lang and o.message_key = w.message_key)
union all
select lang, message_key, 'extra' from others where message_key not in (select message_key from wanted)"""
SQL["calendar_export"] = """
with entries as (
  select calendar, seq, concat_ws(chr(10), 'BEGIN:VEVENT',
    'UID:' || case when uid = '' then md5(cast(calendar as varchar) || '/' || cast(seq as varchar)) || '@calendar' else uid end,
    'DTSTAMP:20240101T000000Z', 'DTSTART:' || strftime(start_at, '%Y%m%dT%H%M%SZ'), 'DTEND:' || strftime(end_at, '%Y%m%dT%H%M%SZ'),
    'SUMMARY:' || replace(summary, chr(10), chr(92) || 'n'), 'DESCRIPTION:' || replace(description, chr(10), chr(92) || 'n'),
    'URL;VALUE=URI:' || url, 'END:VEVENT') as entry from calendar_events),
texts as (
  select calendar, concat_ws(chr(10), 'BEGIN:VCALENDAR', 'METHOD:PUBLISH', 'VERSION:2.0', 'X-WR-CALNAME:' || cast(calendar as varchar),
    'PRODID:-//postmill//calendar//EN', string_agg(entry, chr(10) order by seq), 'END:VCALENDAR') as ics
  from entries group by calendar)
select calendar, cast(0 as bigint) as segment, strlen(ics) as n_bytes, md5(ics) as ics_md5 from texts"""


SQL["sanitize_pages_counts"] = f"""
with balance as ({SQL['tag_balance']})
select p.page_id, cast(coalesce(sum(dropped), 0) as bigint) as n_dropped, cast(coalesce(sum(left_open), 0) as bigint) as n_closed
from pages p left join balance b on b.page_id = p.page_id group by p.page_id"""
SQL["embed_assets"] = f"""
with {references('src|background')},
pairs as (
  select page_id, list({{'page': ref, 'new': split_part(ref, '=', 1) || '="cid:' || cid || '"'}} order by pos) as swaps
  from refs where class = 'data_uri' or (class = 'relative' and url in (select url from assets)) group by page_id)
select p.page_id, md5(case when swaps is null then html else list_reduce(
  list_prepend({{'page': html, 'new': ''}}, swaps), lambda a, s: {{'page': replace(a.page, s.page, s.new), 'new': ''}}).page end) as html_md5
from pages_media p left join pairs on pairs.page_id = p.page_id"""
ATOM = "[!#-''*+/-9=?^-~-]+"
LABEL = "[a-z0-9]([a-z0-9-]*[a-z0-9])?"
# No address here is quoted or has a literal host, so what is left of the stricter pattern is atoms and labels.
PCRE = (
    f"(regexp_matches(address, '(?i)^{ATOM}(\\.{ATOM})*@{LABEL}(\\.{LABEL}){{0,126}}\\z') and strlen(address) < 255"
    " and strpos(address, '@') <= 65 and not regexp_matches(address, '(?i)[@.][a-z0-9-]{64}'))"
)
SQL["validate_addresses_pcre"] = f"""
with {CLEAN} select {ROW}, coalesce({REASON.format(valid=PCRE)}, '') as reason from clean"""

# Sources

SQL["read_transcript"] = r"""
with stamped as (
  select *, regexp_extract(value, '^([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2})\t', 1) as stamp,
    regexp_replace(value, '^[0-9: -]{19}\t', '') as rest from debug_lines),
parsed as (
  select log, line_no, nullif(stamp, '') as ts,
    case when stamp = '' then null else regexp_extract(rest, '^(CLIENT -> SERVER|SERVER -> CLIENT): ?', 1) end as direction,
    case when stamp = '' then ltrim(replace(value, chr(9), '')) else regexp_replace(rest, '^(CLIENT -> SERVER|SERVER -> CLIENT): ?', '') end as text
  from stamped)
select log, line_no, last_value(ts ignore nulls) over w as ts, coalesce(last_value(direction ignore nulls) over w, '') as direction, text
from parsed window w as (partition by log order by line_no rows between unbounded preceding and current row)"""
SQL["read_catalogue"] = """
select lower(p_brand) as lang, p_name as message_key, arg_max(p_type, p_partkey) || '''s' as message
from part where p_size % 5 <> 0 group by 1, 2"""

# Rendering

MESSAGE_REF = SQL["message_ids"].split("message_id, ", 1)[1].split(" as message_ref", 1)[0]
CONTENT = """case when message_type = 'inline' then 'multipart/related' when message_type in ('alt', 'alt_inline')
  then 'multipart/alternative' when message_type = 'plain' then content_type || '; charset=' || charset else 'multipart/mixed' end"""
SQL["header_lines"] = f"""
with {ACCEPTED}, {TYPED},
named as (
  select *, {MESSAGE_REF} as message_ref, trim(from_address, {SPACE}) as sent_by, {secured('from_name')} as phrase,
    trim(confirm_to, {SPACE}) as confirm from typed),
lines as (
  select message_id, 1 as pos, 0 as seq, 'Date' as name, strftime(sent_at, '%a, %-d %b %Y %H:%M:%S +0000') as value from named
  union all select message_id, 3, 0, 'From', '"' || replace(phrase, '"', chr(92) || '"') || '" <' || sent_by || '>' from named
  union all select message_id, 7, 0, 'Subject', {secured('subject')} from named
  union all select message_id, 8, 0, 'Message-ID', message_ref from named
  union all select message_id, 10, 0, 'X-Mailer', 'postmill' from named
  union all select message_id, 11, 0, 'Disposition-Notification-To', '<' || confirm || '>' from named where confirm <> ''
  union all select message_id, 13, 0, 'MIME-Version', '1.0' from named
  union all select message_id, 14, 0, 'Content-Type', {CONTENT} || case when message_type = 'plain' then '' else ';' || chr(13) || chr(10)
    || chr(9) || 'boundary="b1_' || md5(cast(message_id as varchar)) || '"' end from named
  union all select message_id, 15, 0, 'Content-Transfer-Encoding', encoding from named where message_type = 'plain' or encoding = '8bit'
  union all
  select message_id, case label when 'To' then 2 when 'Cc' then 4 else 6 end, 0, label,
    string_agg('"' || replace(name, '"', chr(92) || '"') || '" <' || address || '>', ', ' order by kind_rank, seq, t1, t2, address)
  from (select *, case kind when 'to' then 'To' when 'cc' then 'Cc' else kind end as label from accepted where kind <> 'bcc')
  group by message_id, label
  union all
  select message_id, 2, 0, 'To', 'undisclosed-recipients:;' from messages m
  where not exists (select 1 from accepted a where a.message_id = m.message_id and a.kind in ('to', 'cc'))
  union all
  select message_id, 12, seq, trim(split_part(raw, ':', 1), {SPACE}),
    case when contains(raw, ':') then trim(substr(raw, strpos(raw, ':') + 1), {SPACE}) else '' end from raw_headers)
select message_id, cast(pos as bigint) as pos, cast(seq as bigint) as seq, name, value from lines"""

SQL["attachment_parts"] = f"""
with {TYPED},
slots(message_type, disposition, pos, level) as (values
  ('inline', 'inline', 2, 1), ('attach', 'attachment', 2, 1), ('inline_attach', 'inline', 3, 2), ('inline_attach', 'attachment', 4, 1),
  ('alt_inline', 'inline', 4, 2), ('alt_attach', 'attachment', 4, 1), ('alt_inline_attach', 'inline', 5, 3),
  ('alt_inline_attach', 'attachment', 6, 1)),
files as (
  select a.*, s.pos, s.level, chr(13) || chr(10) as nl,
    case when name like '%.pdf' then 'application/pdf' when name like '%.PNG' then 'image/png' else 'application/octet-stream' end as mime
  from attachments a join typed t on t.message_id = a.message_id
  join slots s on s.message_type = t.message_type and s.disposition = a.disposition)
select message_id, cast(pos as bigint) as pos, cast(seq as bigint) as seq, t1, t2, md5(
  '--b' || level || '_' || md5(cast(message_id as varchar)) || nl || 'Content-Type: ' || mime || '; name="' || name || '"' || nl
  || 'Content-Transfer-Encoding: ' || encoding || nl
  || case when disposition = 'inline' then 'Content-ID: <' || cid || '>' || nl else '' end
  || 'Content-Disposition: ' || disposition || '; filename=' || name || nl || nl
  || case when encoding = 'base64' then to_base64(encode('content of ' || name)) else 'content of ' || name end
  || nl || nl || nl) as piece_md5
from files"""

TEXT_TYPED = f"typed as (select *, case when {blank('alt_body')} then 'plain' else 'alt' end as message_type from messages)"


def text_part(mime: str, text: str, encoding: str, charset: str) -> str:
    """One part under the first boundary; ``nl`` and ``mark`` are columns."""
    shown = f"case when {encoding} = '7bit' then '' else 'Content-Transfer-Encoding: ' || {encoding} || nl end"
    body = f"case when {encoding} = 'base64' then to_base64(encode({text})) else {text} end"
    return f"'--' || mark || nl || 'Content-Type: {mime}; charset=' || {charset} || nl || {shown} || nl || {body} || nl || nl || nl"


SQL["render_texts"] = SQL["header_lines"].replace(f"{TYPED}", TEXT_TYPED).rsplit("select message_id, cast(pos", 1)[0].rstrip() + f""",
blocks as (
  select message_id, string_agg(name || ': ' || value, chr(13) || chr(10) order by pos, seq) as block from lines group by message_id),
ready as (
  select t.*, b.block, chr(13) || chr(10) as nl, 'b1_' || md5(cast(t.message_id as varchar)) as mark,
    case when encoding = '8bit' then '7bit' else encoding end as enc, case when encoding = '8bit' then 'us-ascii' else charset end as cs
  from typed t join blocks b on b.message_id = t.message_id)
select message_id, cast(0 as bigint) as segment, block || nl || nl || case when message_type = 'plain'
    then case when enc = 'base64' then to_base64(encode(body)) else body end || nl
    else 'This is a multi-part message in MIME format.' || nl || nl || {text_part('text/plain', 'alt_body', 'enc', 'cs')}
      || {text_part('text/html', 'body', 'enc', 'cs')}
      || case when ical = '' then '' else {text_part('text/calendar; method=REQUEST', 'ical', 'encoding', 'charset')} end
      || nl || '--' || mark || '--' || nl end as message from ready"""
SQL["write_corpus"] = SQL["render_texts"]

# Streams, as batches

SQL["delivery_rate"] = """
select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as window_start, command, count(*) as n_attempts,
  count(*) filter (not is_sent) as n_failed from delivery_log group by 1, 2"""
SQL["delivery_rate_sliding"] = """
with slots as (select *, time_bucket(interval '30 minutes', ts) as half from delivery_log),
windows as (select *, half as window_start from slots union all select *, half - interval '30 minutes' from slots)
select strftime(window_start, '%Y-%m-%d %H:%M:%S') as window_start, command, count(*) as n_attempts,
  count(*) filter (not is_sent) as n_failed from windows group by 1, 2"""
SQL["connection_sessions"] = """
with gaps as (
  select *, coalesce(ts - lag(ts) over (partition by session_id order by ts) > interval '300 seconds', true) as starts from delivery_log),
numbered as (
  select *, sum(cast(starts as int)) over (partition by session_id order by ts, event_id rows unbounded preceding) as n from gaps)
select session_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as started, count(*) as n_attempts,
  count(*) filter (not is_sent) as n_failed from numbered group by session_id, n"""
SQL["live_dedup"] = """
with feed as (
  select session_id % 20 as message_id, ts, event_id,
    concat(case when is_sent then 'U.' else 'u.' end, cast(event_id % 50 as varchar), '@example.com') as address from delivery_log)
select message_id, address, event_id from feed
qualify row_number() over (partition by message_id, lower(address) order by ts, event_id) = 1"""
SQL["live_unexpected"] = UNEXPECTED
SQL["recipient_ledger"] = """
with clears as (select message_id, seq, op, kind from ledger_commands where op = 'clear'),
adds as (
  select *, lower(address) as name, kind = 'Reply-To' as reply from ledger_commands where op = 'add'),
names as (select distinct message_id, name, reply from adds),
steps as (
  select message_id, name, reply, seq, op, kind from adds
  union all
  select n.message_id, n.name, n.reply, c.seq, c.op, c.kind from names n join clears c on c.message_id = n.message_id
  where (n.reply and c.kind = 'Reply-To') or (not n.reply and c.kind <> 'Reply-To')),
replayed as (
  select message_id, name, reply, list_reduce(
    list_prepend({'seq': cast(-1 as bigint), 'op': '', 'kind': '', 'owner': '', 'got': cast([] as bigint[])},
      list({'seq': seq, 'op': op, 'kind': kind, 'owner': '', 'got': cast([] as bigint[])} order by seq)),
    lambda a, x: {'seq': x.seq, 'op': '', 'kind': '',
      'owner': case when x.op = 'add' and a.owner = '' then x.kind
                    when x.op = 'clear' and (x.kind = 'all' or x.kind = a.owner) then '' else a.owner end,
      'got': case when x.op = 'add' and a.owner = '' then list_append(a.got, x.seq) else a.got end}) as r
  from steps group by message_id, name, reply),
accepted as (
  select message_id, unnest(r.got) as seq, r.got[len(r.got)] as newest, r.owner as owner from replayed)
select a.message_id, a.seq, c.kind, c.address, cast(a.seq = a.newest and a.owner <> '' as bigint) as listed
from accepted a join adds c on c.message_id = a.message_id and c.seq = a.seq"""

# Sinks, read back

SQL["write_delivery_log"] = "select event_id, session_id, command, reply from delivery_log"
SQL["outbox"] = """
select cust_id, email, cast(sent or email in (
  select concat('customer.', cast(user_id % 400 as varchar), '@building.example.com') from events where event_type = 'purchase')
  as bigint) as sent from mailinglist"""


def oracle_queries() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in SQL.items()}
