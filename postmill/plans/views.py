"""Mail tables derived from the star-schema tables.

Each text is one SQL query that Spark and DuckDB both run; ``{text}`` is the engine's name of the string type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS: dict[str, str] = {}

VIEWS["mailinglist"] = """
select c_custkey as cust_id, c_name as full_name,
       concat('customer.', cast(c_custkey % 400 as {text}), '@', lower(c_mktsegment), '.example.com') as email,
       case when c_custkey % 5 = 0 then '' else concat('photo of ', c_name) end as photo,
       (c_custkey % 3 = 0) as sent, c_nationkey as campaign
from customer"""

VIEWS["recipients"] = """
select o_orderkey as message_id, 0 as kind_rank, 'to' as kind, cast(0 as bigint) as seq,
       cast(0 as bigint) as t1, cast(0 as bigint) as t2,
       concat('customer.', cast(o_custkey as {text}), '@shop.example.com') as address,
       concat('Customer ', cast(o_custkey as {text})) as name
from orders
union all
select l_orderkey, 1, 'cc', cast(l_linenumber as bigint), l_suppkey, l_partkey,
       case when l_partkey % 17 = 0 then concat('supplier.', cast(l_suppkey as {text}), '@supply..example.com')
            when l_linenumber % 2 = 0 then concat('SUPPLIER.', cast(l_suppkey as {text}), '@supply.example.com')
            else concat('supplier.', cast(l_suppkey as {text}), '@supply.example.com') end,
       ''
from lineitem"""

# The same people with all four kinds, unclean text, missing @ and an unknown kind.
VIEWS["raw_recipients"] = """
select l_orderkey as message_id,
       case l_linenumber when 1 then 0 when 2 then 1 when 3 then 1 when 4 then 2 when 5 then 3 when 6 then 0 else 4 end
           as kind_rank,
       case l_linenumber when 1 then 'to' when 2 then 'cc' when 3 then 'cc' when 4 then 'bcc' when 5 then 'Reply-To'
           when 6 then 'to' else 'from' end as kind,
       cast(l_linenumber as bigint) as seq, l_suppkey as t1, l_partkey as t2,
       concat('  ', case when l_partkey % 19 = 0 then 'supplier.nowhere'
                         when l_partkey % 17 = 0 then concat('s.', cast(l_suppkey as {text}), '@supply..example.com')
                         when l_partkey % 2 = 0 then concat('S.', cast(l_suppkey % 9 as {text}), '@Supply.example.com')
                         else concat('s.', cast(l_suppkey % 9 as {text}), '@supply.example.com') end, ' ') as address,
       concat(' Supplier', chr(13), chr(10), ' "', cast(l_suppkey as {text}), '"', chr(9)) as name
from lineitem"""

# International domains in both cases and in their ASCII form.
VIEWS["idn_recipients"] = """
select l_orderkey as message_id, case when l_linenumber = 5 then 3 when l_linenumber > 3 then 1 else 0 end as kind_rank,
       case when l_linenumber = 5 then 'Reply-To' when l_linenumber > 3 then 'cc' else 'to' end as kind,
       cast(l_linenumber as bigint) as seq, l_suppkey as t1, l_partkey as t2,
       concat('s', cast(l_suppkey % 3 as {text}), '@',
              case l_partkey % 7 when 0 then 'françois.ch' when 1 then 'FRANÇOIS.CH' when 2 then 'xn--franois-xxa.ch'
                   when 3 then 'XN--FRANOIS-XXA.CH' when 4 then 'straße.example' when 5 then 'strasse.example'
                   else 'bad..é' end) as address,
       '' as name
from lineitem"""

VIEWS["attachments"] = """
select l_orderkey as message_id, l_linenumber as seq, l_partkey as t1, l_suppkey as t2,
       concat('part-', cast(l_partkey as {text}),
              case when l_linenumber % 4 = 0 then '.pdf' when l_linenumber % 4 = 1 then '.PNG'
                   when l_linenumber % 4 = 2 then '.tar.gz' else '' end) as name,
       case when l_returnflag = 'R' then 'inline' else 'attachment' end as disposition,
       case when l_tax > 0.05 then '8bit' else 'base64' end as encoding,
       concat('cid', cast(l_suppkey as {text})) as cid,
       cast(l_quantity as bigint) * 100 as n_bytes
from lineitem"""

VIEWS["delivery_log"] = """
select event_id, cast(ts as timestamp) as ts, user_id as session_id, value, event_type <> 'error' as is_sent,
       case when event_type = 'error' then '550-5.1.1 unknown' else '250 2.1.5 ok' end as reply,
       case when event_type = 'purchase' then 'DATA END' else 'RCPT TO' end as command
from events"""

VIEWS["messages_text"] = """
select doc_id as message_id, text as body, '' as alt_body, '8bit' as encoding, 'utf-8' as charset, source, lang
from documents"""

# Two text parts per document, in encodings that take turns.
VIEWS["text_parts"] = """
select doc_id as message_id, case doc_id % 3 when 0 then 'base64' else 'quoted-printable' end as encoding,
       {size}(text) as n_bytes, text as content
from documents
union all
select doc_id, case doc_id % 2 when 0 then 'quoted-printable' else 'binary' end, {size}(lang), lang
from documents"""

VIEWS["messages_html"] = """
select page_id as message_id, url, html as body, '8bit' as encoding, 'utf-8' as charset
from pages"""

# One message per order: envelope fields with blanks and errors, a given id or none, bodies of every emptiness.
VIEWS["messages"] = """
select o_orderkey as message_id,
       concat(' shop', case when o_orderkey % 23 = 0 then '..' else '.' end, cast(o_custkey % 50 as {text}), '@shop',
              case when o_orderkey % 29 = 0 then '..' else '.' end, 'example.com') as from_address,
       concat('Shop "', cast(o_custkey % 50 as {text}), '"') as from_name,
       case when o_orderkey % 3 = 0 then '' when o_orderkey % 31 = 0 then 'bounce' else 'bounce@shop.example.com ' end
           as sender,
       case when o_orderkey % 7 = 0 then 'receipt@shop.example.com' when o_orderkey % 37 = 0 then 'receipt@' else '' end
           as confirm_to,
       case when o_orderkey % 4 = 0 then concat('<', cast(o_orderkey as {text}), '@shop.example.com>')
            when o_orderkey % 4 = 1 then cast(o_orderkey as {text}) else '' end as given_id,
       concat('Order ', cast(o_orderkey % 5000 as {text}), '  ', o_orderpriority) as subject,
       case when o_orderkey % 11 = 0 then '' when o_orderkey % 13 = 0 then '0'
            else concat('Your order of ', cast(o_totalprice as {text})) end as body,
       case when o_orderkey % 2 = 0 then '' when o_orderkey % 6 = 1 then '0' else 'Your order.' end as alt_body,
       case when o_orderkey % 5 = 0 then 'base64' else '8bit' end as encoding, 'utf-8' as charset,
       'text/html' as content_type,
       case when o_orderkey % 8 = 3 then 'BEGIN:VCALENDAR' else '' end as ical,
       cast(o_orderdate as timestamp) as sent_at,
       o_custkey, o_orderstatus
from orders"""

# Pages with media of every kind in front of their own html.
VIEWS["pages_media"] = """
select page_id, url, concat(
         '<body background="bg/', cast(page_id % 7 as {text}), '.png" bgcolor=#ffffff onload="go()">',
         '<img src="cid:logo', cast(page_id as {text}), '"><IMG SRC=''data:image/png;base64,QUJD', cast(page_id % 3 as {text}),
         '''><img src="https://img.example.com/', cast(page_id as {text}), '.gif">',
         '<a href="javascript:go(', cast(page_id as {text}), ')" onclick="x>y">go</a><a href=about:blank style="color:red">',
         '<object data="x"><b style="width:expression(1)">bold</b></object></a></u><IMG src="pic/',
         cast(page_id % 5 as {text}), '.jpg" lowsrc=a.gif/>', html) as html
from pages"""

VIEWS["assets"] = """
select distinct concat('bg/', cast(page_id % 7 as {text}), '.png') as url from pages where page_id % 7 <> 3
union all
select distinct concat('pic/', cast(page_id % 5 as {text}), '.jpg') from pages"""

# Server lines: three per event, of which the first two may announce more.
VIEWS["transcript_lines"] = """
select user_id as session_id, event_id * 3 as line_no,
       case when event_type = 'signup' then '250-mx.example.com' when event_type = 'error' then '550-5.1.1 no such user'
            else '354 go on' end as line,
       case when event_type = 'signup' then 'EHLO' when event_type = 'error' then 'RCPT TO' else 'DATA' end as command
from events
union all
select user_id, event_id * 3 + 1,
       case when event_type = 'signup' then '250-SIZE 1000' when event_type = 'error' then '550 5.1.1 try elsewhere'
            else '250 2.0.0 queued' end,
       case when event_type = 'signup' then 'EHLO' when event_type = 'error' then 'RCPT TO' else 'DATA END' end
from events
union all
select user_id, event_id * 3 + 2,
       case when event_type = 'signup' then '250 HELP' when event_type = 'click' then '421 closing' else '221 bye' end,
       case when event_type = 'signup' then 'EHLO' else 'QUIT' end
from events"""

# Debug log lines: every second event is followed by a folded line.
VIEWS["debug_lines"] = """
select user_id as log, event_id * 2 as line_no,
       concat(substr(cast(ts as {text}), 1, 19), chr(9),
              case when event_type = 'click' then 'CLIENT -> SERVER: RCPT TO' when event_type = 'view' then 'connecting'
                   else 'SERVER -> CLIENT: 250 ok' end) as value
from events
union all
select user_id, event_id * 2 + 1, concat('                   ', chr(9), '                  more ', event_type)
from events where event_id % 2 = 0"""

VIEWS["rcpt_results"] = """
select l_orderkey as message_id, l_linenumber as attempt, l_suppkey as t1, l_partkey as t2,
       concat('supplier.', cast(l_suppkey as {text}), '@supply.example.com') as address,
       l_returnflag <> 'R' as accepted,
       case when l_returnflag = 'R' then concat('5.1.1 unknown ', cast(l_partkey as {text})) else '' end as detail
from lineitem"""

VIEWS["relay_attempts"] = """
select l_orderkey as message_id, l_linenumber as attempt, l_suppkey as t1, l_partkey as t2,
       concat(case when l_suppkey % 3 = 0 then 'tls://' else '' end, 'mx', cast(l_suppkey as {text}), '.example.com',
              case when l_partkey % 13 = 0 then ' bad' when l_partkey % 2 = 0 then ':587' else '' end) as host,
       l_returnflag = 'A' as ok,
       case when l_returnflag = 'A' then '' else concat('error ', cast(l_partkey as {text})) end as error
from lineitem"""

VIEWS["errors"] = """
select event_id, user_id as message_id, event_id as seq,
       lower(concat('brand#', cast(event_id % 29 as {text}))) as lang,
       case when event_type = 'error' then 'smtp_connect_failed'
            when event_type = 'click' then 'unheard of' else concat('red ', case when event_id % 2 = 0 then 'ring' else 'widget' end)
       end as message_key
from events"""

VIEWS["translation_lines"] = """
select lower(p_brand) as lang, p_partkey as line_no, p_name as message_key, concat(p_type, ' ', cast(p_size as {text})) as message
from part
union all
select 'brand#1', cast(-1 as bigint), 'smtp_connect_failed', 'no connection'"""

VIEWS["raw_headers"] = """
select o_orderkey as message_id, cast(0 as bigint) as seq, concat(' X-Priority : ', o_orderpriority) as raw from orders
union all
select o_orderkey, cast(1 as bigint), concat('X-Status:', o_orderstatus, ':', o_orderpriority, ' ') from orders
union all
select o_orderkey, cast(2 as bigint), concat('X-Customer-', cast(o_custkey % 10 as {text})) from orders"""

VIEWS["calendar_events"] = """
select o_custkey as calendar, o_orderkey as seq, cast(o_orderdate as timestamp) as start_at,
       cast(o_orderdate as timestamp) + interval '90' minute as end_at,
       concat('Order ', cast(o_orderkey as {text}), chr(10), o_orderpriority) as summary,
       case when o_orderkey % 2 = 0 then '' else concat('Status', chr(10), o_orderstatus) end as description,
       concat('https://shop.example.com/', cast(o_orderkey as {text})) as url,
       case when o_orderkey % 3 = 0 then '' else concat(cast(o_orderkey as {text}), '@shop.example.com') end as uid
from orders"""

VIEWS["ehlo_replies"] = """
select s_name as server, case when s_suppkey % 10 = 9 then 'HELO' else 'EHLO' end as command,
       concat('250-', lower(s_name), ' at your service', chr(10),
              case when s_suppkey % 10 = 9 then '' else concat(
                '250-SIZE', case when s_suppkey % 4 = 0 then '' else concat(' ', cast(1000 + s_nationkey as {text})) end,
                chr(10), '250-AUTH', case s_suppkey % 3 when 0 then ' PLAIN LOGIN' when 1 then ' PLAIN XOAUTH2' else '' end,
                chr(10), case when s_suppkey % 2 = 0 then concat('250-STARTTLS', chr(10)) else '' end,
                '250 8BITMIME') end) as reply
from supplier"""

VIEWS["address_lists"] = """
select o_orderkey as list_id,
       concat('Joe "', cast(o_custkey as {text}), '" User <joe.', cast(o_custkey as {text}), '@example.com>, ',
              'plain', cast(o_orderkey as {text}), '@example.net,bad <bad@example..com>, "Last, First" <lf@example.org> ,,x')
           as addresses
from orders"""

VIEWS["ledger_commands"] = """
select l_orderkey as message_id,
       l_linenumber * cast(1000000000000 as bigint) + l_suppkey * 1000000 + l_partkey as seq,
       case when l_quantity < 8 then 'clear' else 'add' end as op,
       case when l_quantity < 3 then 'all' when l_partkey % 4 = 0 then 'cc' when l_partkey % 4 = 1 then 'bcc'
            when l_partkey % 4 = 2 then 'to' else 'Reply-To' end as kind,
       case when l_quantity < 8 then '' when l_partkey % 2 = 0 then concat('S.', cast(l_suppkey % 3 as {text}), '@example.com')
            else concat('s.', cast(l_suppkey % 3 as {text}), '@example.com') end as address
from (select l_orderkey, l_linenumber, l_suppkey, l_partkey, min(l_quantity) as l_quantity from lineitem
      group by l_orderkey, l_linenumber, l_suppkey, l_partkey) lines"""

VIEWS["file_names"] = """
select l_partkey as file_id, l_suppkey as t1, l_linenumber as t2,
       concat(case when l_partkey % 3 = 0 then concat('c:', chr(92), 'files', chr(92)) when l_partkey % 3 = 1 then '/mnt/files/'
                   else '' end, 'part-', cast(l_partkey as {text}),
              case when l_linenumber % 7 = 0 then '.pdf?version=1.2' when l_linenumber % 7 = 1 then '.PNG'
                   when l_linenumber % 7 = 2 then '.tar.gz' when l_linenumber % 7 = 3 then '.docx'
                   when l_linenumber % 7 = 4 then '.unknown' when l_linenumber % 7 = 5 then '/'
                   else '' end) as path
from lineitem"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name].format(text="string", size="octet_length")
    used = [t for t in TABLES if f"from {t}" in sql]
    for t in used:
        sql = sql.replace(f"from {t}", "from {" + t + "}")
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in used})


def with_views(sql: str) -> str:
    """A DuckDB query whose mail tables are defined up front."""
    names: list[str] = [n for n in VIEWS if n in sql]
    defined = ", ".join(f"{n} as ({VIEWS[n].format(text='varchar', size='strlen')})" for n in names)
    if not defined:
        return sql
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {defined}, {body[len('with recursive '):]}"
    if body.lower().startswith("with "):
        return f"with {defined}, {body[5:]}"
    return f"with {defined} {body}"
