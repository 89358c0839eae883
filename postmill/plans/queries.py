"""The registered queries: each operator over whole tables of a scale-factor folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.address import domain_of
from postmill.functions.text import trimmed
from postmill.operators import attachments as att
from postmill.operators import calendar as cal
from postmill.operators import campaigns as cam
from postmill.operators import catalogue as cat
from postmill.operators import content as con
from postmill.operators import messages as msg
from postmill.operators import pages as pag
from postmill.operators import recipients as rec
from postmill.operators import replies as rep
from postmill.operators.render import attachment_texts, header_block, ready, render_corpus, render_text_messages
from postmill.operators.sanitise import sanitize_pages
from postmill.plans.views import table, view
from postmill.session import shared_dir
from postmill.sources.catalogues import parse_catalogue
from postmill.sources.files import attachment_files
from postmill.sources.sinks import CSV
from postmill.sources.sinks import write_corpus as store_corpus
from postmill.sources.sinks import write_delivery_log as store_log
from postmill.sources.transcripts import parse_transcript
from postmill.streaming import delivery as live
from postmill.streaming.ledger import recipient_ledger as ledger

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# Recipients

ROW = ["message_id", "kind", "seq", "t1", "t2", "address"]


@query
def clean_recipients(spark: SparkSession, d: str) -> DataFrame:
    return rec.clean_recipients(view(spark, d, "raw_recipients")).select(*ROW, "name")


@query
def domain_of_address(spark: SparkSession, d: str) -> DataFrame:
    rows = rec.with_domain(view(spark, d, "raw_recipients"))
    return rows.select(*ROW, F.coalesce("domain", F.lit("")).alias("domain"))


def _judged(spark: SparkSession, d: str, pattern: str) -> DataFrame:
    valid, refused = rec.validate_addresses(rec.clean_recipients(view(spark, d, "raw_recipients")), pattern)
    return valid.select(*ROW, F.lit("").alias("reason")).unionByName(refused.select(*ROW, "reason"))


@query
def validate_addresses(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d, "html5")


@query
def validate_addresses_noregex(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d, "noregex")


@query
def validate_addresses_pcre(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d, "pcre")


@query
def reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    return rec.reject_reasons(view(spark, d, "raw_recipients"))


@query
def top_rejected_domains(spark: SparkSession, d: str) -> DataFrame:
    return rec.top_rejected_domains(view(spark, d, "raw_recipients"), 5)


@query
def pattern_agreement(spark: SparkSession, d: str) -> DataFrame:
    return rec.pattern_agreement(view(spark, d, "raw_recipients"), ["html5", "noregex"])


@query
def header_injection_scan(spark: SparkSession, d: str) -> DataFrame:
    found = rec.header_injection_scan(view(spark, d, "messages_text"), ["body", "source", "lang"], "message_id")
    return found.select("message_id", "field", F.md5("cleaned").alias("cleaned_md5"))


@query
def dedup_recipients(spark: SparkSession, d: str) -> DataFrame:
    valid, _ = rec.validate_addresses(rec.clean_recipients(view(spark, d, "recipients")))
    return rec.dedup_recipients(valid).select(*ROW, "name")


@query
def dedup_reply_to(spark: SparkSession, d: str) -> DataFrame:
    return rec.accepted_recipients(view(spark, d, "raw_recipients")).select(*ROW)


@query
def dedup_idn(spark: SparkSession, d: str) -> DataFrame:
    return rec.dedup_idn(view(spark, d, "idn_recipients")).select(*ROW, F.col("pass").cast("bigint").alias("pass"))


@query
def recipient_headers(spark: SparkSession, d: str) -> DataFrame:
    added = view(spark, d, "raw_recipients")
    return rec.recipient_headers(rec.accepted_recipients(added), transport="sendmail")


@query
def recipient_counts_idn(spark: SparkSession, d: str) -> DataFrame:
    return rec.recipient_counts(rec.accepted_recipients(view(spark, d, "idn_recipients")))


@query
def reject_reasons_idn(spark: SparkSession, d: str) -> DataFrame:
    return rec.reject_reasons(view(spark, d, "idn_recipients"))


@query
def recipient_counts(spark: SparkSession, d: str) -> DataFrame:
    return rec.recipient_counts(rec.accepted_recipients(view(spark, d, "raw_recipients")))


@query
def no_recipient_messages(spark: SparkSession, d: str) -> DataFrame:
    lines = rec.accepted_recipients(view(spark, d, "raw_recipients"))
    return rec.no_recipient_messages(view(spark, d, "messages").select("message_id"), lines)


@query
def single_to(spark: SparkSession, d: str) -> DataFrame:
    to = rec.accepted_recipients(view(spark, d, "raw_recipients"))
    return rec.single_to(view(spark, d, "messages").select("message_id", "subject"), to)


@query
def recipient_order(spark: SparkSession, d: str) -> DataFrame:
    ordered = rec.recipient_order(rec.accepted_recipients(view(spark, d, "raw_recipients")))
    return ordered.select(*ROW, "position")


@query
def envelope(spark: SparkSession, d: str) -> DataFrame:
    rows = rec.accepted_recipients(view(spark, d, "raw_recipients"))
    return rec.envelope_rows(rows).select("message_id", "kind", "address")


@query
def suppress(spark: SparkSession, d: str) -> DataFrame:
    return rec.suppress(view(spark, d, "raw_recipients"), "cc", "bcc").select(*ROW)


@query
def suppress_all(spark: SparkSession, d: str) -> DataFrame:
    return rec.suppress(view(spark, d, "raw_recipients")).select(*ROW)


@query
def parse_address_lists(spark: SparkSession, d: str) -> DataFrame:
    return rec.parse_address_lists(view(spark, d, "address_lists"))


# Messages


@query
def validate_envelope_fields(spark: SparkSession, d: str) -> DataFrame:
    checked = msg.validate_envelope_fields(view(spark, d, "messages"))
    none = F.lit("")
    return checked.select(
        "message_id", F.coalesce("bad_field", none).alias("bad_field"), F.coalesce("bad_value", none).alias("bad_value")
    )


@query
def default_sender(spark: SparkSession, d: str) -> DataFrame:
    return msg.default_sender(view(spark, d, "messages")).select("message_id", "sender", "envelope_sender")


@query
def non_empty_gate(spark: SparkSession, d: str) -> DataFrame:
    go, refused = msg.non_empty_gate(view(spark, d, "messages"))
    return go.select("message_id", F.lit("").alias("error")).unionByName(refused.select("message_id", "error"))


@query
def message_ids(spark: SparkSession, d: str) -> DataFrame:
    return msg.message_ids(view(spark, d, "messages"), "mx.example.com").select("message_id", "message_ref")


def _typed(spark: SparkSession, d: str) -> DataFrame:
    return msg.message_type(view(spark, d, "messages"), view(spark, d, "attachments"))


@query
def attachment_flags(spark: SparkSession, d: str) -> DataFrame:
    flags = msg.attachment_flags(view(spark, d, "messages"), view(spark, d, "attachments"))
    as_number = [F.col(c).cast("bigint").alias(c) for c in ("has_inline", "has_attachment")]
    return flags.select("message_id", *as_number)


@query
def message_type(spark: SparkSession, d: str) -> DataFrame:
    return _typed(spark, d).select("message_id", "message_type")


@query
def content_type(spark: SparkSession, d: str) -> DataFrame:
    return msg.content_type(_typed(spark, d)).select("message_id", "message_type", "full_type")


@query
def transfer_encoding(spark: SparkSession, d: str) -> DataFrame:
    texts = view(spark, d, "messages_text").select("message_id", "body", "alt_body", "encoding", "charset")
    html = pag.alt_bodies(view(spark, d, "messages_html"), column="body").select(
        (-1 - F.col("message_id")).alias("message_id"), "body", "alt_body", "encoding", "charset"
    )
    return msg.transfer_encoding(texts.unionByName(html)).select(
        "message_id", "body_encoding", "body_charset", "message_encoding", "alt_encoding", "alt_charset"
    )


@query
def part_layout(spark: SparkSession, d: str) -> DataFrame:
    return msg.part_layout(_typed(spark, d), view(spark, d, "attachments"))


@query
def message_size(spark: SparkSession, d: str) -> DataFrame:
    sizes = msg.message_size(view(spark, d, "attachments"), 20_000)
    return sizes.withColumn("fits", F.col("fits").cast("bigint"))


@query
def message_size_quoted(spark: SparkSession, d: str) -> DataFrame:
    sizes = msg.message_size(view(spark, d, "text_parts"), 4000, "content")
    return sizes.withColumn("fits", F.col("fits").cast("bigint"))


@query
def largest_messages(spark: SparkSession, d: str) -> DataFrame:
    return msg.largest_messages(view(spark, d, "attachments"), 10)


@query
def text_size(spark: SparkSession, d: str) -> DataFrame:
    docs = view(spark, d, "messages_text")
    return docs.select(
        "message_id", msg.encoded_size(F.col("encoding"), F.lit(None).cast("bigint"), F.col("body")).alias("encoded_bytes")
    )


@query
def duplicate_headers(spark: SparkSession, d: str) -> DataFrame:
    lines = view(spark, d, "messages").select(
        "message_id",
        F.concat(F.lit("From:  "), trimmed(F.col("from_address")), F.lit(" ")).alias("from_line"),
        F.concat(F.lit("TO: c."), (F.col("o_custkey") % 10).cast("string"), F.lit("@example.com,\r\n\t x@example.com")).alias("to_line"),
        F.concat(F.lit("Date: "), F.date_format("sent_at", "yyyy")).alias("date_line"),
        F.concat(F.lit("Subject: "), F.col("o_orderstatus")).alias("subject_line"),
    )
    return msg.duplicate_headers(lines)


@query
def error_totals(spark: SparkSession, d: str) -> DataFrame:
    errors = view(spark, d, "errors").withColumnRenamed("message_key", "error")
    totals = msg.error_totals(view(spark, d, "messages"), errors).withColumn("is_error", F.col("is_error").cast("bigint"))
    return totals.withColumn("last_error", F.coalesce("last_error", F.lit("(none)")))


@query
def custom_headers(spark: SparkSession, d: str) -> DataFrame:
    split = msg.custom_headers(view(spark, d, "raw_headers"))
    return split.select("message_id", "seq", "name", F.coalesce("value", F.lit("(none)")).alias("value"))


@query
def header_frequency(spark: SparkSession, d: str) -> DataFrame:
    counted = msg.header_frequency(view(spark, d, "raw_headers"))
    return counted.withColumn("top_value", F.coalesce("top_value", F.lit("")))


# Attachments


@query
def mime_types(spark: SparkSession, d: str) -> DataFrame:
    typed = att.mime_types(view(spark, d, "file_names"))
    return typed.select("file_id", "t1", "t2", "path", "dirname", "basename", "filename", "extension", "mime")


@query
def blob_attachments(spark: SparkSession, d: str) -> DataFrame:
    pending = cam.pending_recipients(view(spark, d, "mailinglist"))
    named = pending.withColumn("file", F.concat(F.lit("photos/"), F.col("full_name"), F.lit(".jpg")))
    blobs = att.blob_attachments(named, "photo", "file")
    return blobs.select("cust_id", "name", "mime", "disposition", "encoding", "n_bytes")


@query
def attachment_dedup(spark: SparkSession, d: str) -> DataFrame:
    kept = att.attachment_dedup(
        view(spark, d, "attachments"), ["name", "disposition", "encoding", "cid"], ["seq", "t1", "t2", "n_bytes"]
    )
    return kept.select("message_id", F.col("seq").cast("bigint").alias("seq"), "t1", "t2", "name", "disposition", "cid", "n_bytes")


@query
def attachment_inventory(spark: SparkSession, d: str) -> DataFrame:
    return att.attachment_inventory(att.mime_types(view(spark, d, "attachments"), "name"))


@query
def missing_attachments(spark: SparkSession, d: str) -> DataFrame:
    """Assets the pages ask for and nobody holds."""
    wanted = pag.asset_references(view(spark, d, "pages_media")).filter("class = 'relative'")
    return att.missing_attachments(
        wanted.select("page_id", "pos", F.col("url").alias("path")), view(spark, d, "assets").withColumnRenamed("url", "path")
    )


# Campaigns


@query
def pending_recipients(spark: SparkSession, d: str) -> DataFrame:
    return cam.pending_recipients(view(spark, d, "mailinglist")).select("full_name", "email", "photo")


@query
def campaign_messages(spark: SparkSession, d: str) -> DataFrame:
    templates = spark.read.parquet(f"{d}/nation.parquet").select(
        F.col("n_nationkey").alias("campaign"), F.concat(F.lit("News for "), "n_name").alias("subject")
    )
    rows = cam.campaign_messages(templates, cam.pending_recipients(view(spark, d, "mailinglist")))
    return rows.select("campaign", "cust_id", "email", "subject")


@query
def send_until_failure(spark: SparkSession, d: str) -> DataFrame:
    sent = cam.send_until_failure(view(spark, d, "delivery_log"), ["session_id"], ["event_id"])
    return sent.select("session_id", "event_id")


@query
def mark_sent(spark: SparkSession, d: str) -> DataFrame:
    mailing = view(spark, d, "mailinglist")
    delivered = mailing.filter(F.col("cust_id") % 7 == 0)
    return cam.mark_sent(mailing, delivered).select("cust_id", "email", F.col("sent").cast("bigint").alias("sent"))


# Body texts


@query
def line_break_profile(spark: SparkSession, d: str) -> DataFrame:
    return con.line_break_profile(view(spark, d, "messages_text"))


@query
def long_line_profile(spark: SparkSession, d: str) -> DataFrame:
    return con.long_line_profile(view(spark, d, "messages_text"))


@query
def charset_profile(spark: SparkSession, d: str) -> DataFrame:
    return con.charset_profile(view(spark, d, "messages_text"))


@query
def wire_line_audit(spark: SparkSession, d: str) -> DataFrame:
    return con.wire_line_audit(view(spark, d, "messages_text"))


@query
def wire_line_totals(spark: SparkSession, d: str) -> DataFrame:
    return con.wire_line_totals(con.wire_line_audit(view(spark, d, "messages_text")))


@query
def header_encoding_profile(spark: SparkSession, d: str) -> DataFrame:
    return con.header_encoding_profile(view(spark, d, "messages_text"), "body")


@query
def canonical_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    prints = con.canonical_fingerprint(view(spark, d, "messages_text"))
    return prints.select("message_id", "canonical_bytes", "fingerprint")


@query
def duplicate_bodies(spark: SparkSession, d: str) -> DataFrame:
    return con.duplicate_bodies(view(spark, d, "messages_text"))


@query
def reflow(spark: SparkSession, d: str) -> DataFrame:
    lines = con.reflow(view(spark, d, "messages_text"), 72)
    return lines.select("message_id", "line_no", F.md5("line").alias("line_md5"))


# Pages


@query
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    texts = pag.html_to_text(view(spark, d, "pages_media"))
    return texts.select("page_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.md5("text").alias("text_md5"))


@query
def html_to_text_full(spark: SparkSession, d: str) -> DataFrame:
    texts = pag.html_to_text(view(spark, d, "pages_media"), pag.full_text)
    return texts.select("page_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.md5("text").alias("text_md5"))


@query
def alt_bodies(spark: SparkSession, d: str) -> DataFrame:
    return pag.alt_bodies(view(spark, d, "pages_media")).select("page_id", F.md5("alt_body").alias("alt_md5"))


@query
def asset_references(spark: SparkSession, d: str) -> DataFrame:
    refs = pag.asset_references(view(spark, d, "pages_media"), ("src", "background", "href"))
    return refs.select("page_id", "pos", "attr", "url", "class", "mime", "cid")


@query
def embed_assets(spark: SparkSession, d: str) -> DataFrame:
    pages = pag.embed_assets(view(spark, d, "pages_media"), view(spark, d, "assets"))
    return pages.select("page_id", F.md5("html").alias("html_md5"))


@query
def url_policy(spark: SparkSession, d: str) -> DataFrame:
    links = pag.asset_references(view(spark, d, "pages_media"), ("src", "background", "href"))
    return pag.url_policy(links).select("page_id", "pos", "verdict", "safe_url")


@query
def tags(spark: SparkSession, d: str) -> DataFrame:
    return pag.tags(view(spark, d, "pages_media")).select("page_id", "pos", "name", "kind", F.md5("tag").alias("tag_md5"))


@query
def policy_violations(spark: SparkSession, d: str) -> DataFrame:
    return pag.policy_violations(view(spark, d, "pages_media"))


@query
def tag_balance(spark: SparkSession, d: str) -> DataFrame:
    return pag.tag_balance(view(spark, d, "pages_media"))


@query
def sanitize_pages_counts(spark: SparkSession, d: str) -> DataFrame:
    return sanitize_pages(view(spark, d, "pages_media")).select("page_id", "n_dropped", "n_closed")


@query
def sanitize_pages_html(spark: SparkSession, d: str) -> DataFrame:
    return sanitize_pages(view(spark, d, "pages_media"))


# Replies and outcomes


@query
def assemble_replies(spark: SparkSession, d: str) -> DataFrame:
    return rep.assemble_replies(view(spark, d, "transcript_lines"))


@query
def parse_replies(spark: SparkSession, d: str) -> DataFrame:
    parsed = rep.parse_replies(rep.assemble_replies(view(spark, d, "transcript_lines")))
    return parsed.select(
        "session_id", "reply_no", "command", F.col("code").cast("bigint").alias("code"),
        F.coalesce("code_ex", F.lit("")).alias("code_ex"), "detail",
    )


@query
def reply_classes(spark: SparkSession, d: str) -> DataFrame:
    return rep.reply_classes(rep.parse_replies(rep.assemble_replies(view(spark, d, "transcript_lines"))))


@query
def unexpected_replies(spark: SparkSession, d: str) -> DataFrame:
    parsed = rep.parse_replies(view(spark, d, "delivery_log"))
    return rep.unexpected_replies(parsed).select("event_id", "command", F.col("code").cast("bigint").alias("code"), "detail")


@query
def capabilities(spark: SparkSession, d: str) -> DataFrame:
    caps = rep.capabilities(view(spark, d, "ehlo_replies"))
    return caps.select("server", "extension", F.array_join("args", " ").alias("args"))


@query
def server_auth(spark: SparkSession, d: str) -> DataFrame:
    caps = rep.server_caps(rep.capabilities(view(spark, d, "ehlo_replies")))
    return caps.select(
        "server", F.size("caps").cast("bigint").alias("n_caps"),
        F.coalesce(F.element_at("caps", "SIZE")[0], F.lit("")).alias("size_limit"), F.coalesce("auth", F.lit("")).alias("auth"),
    )


@query
def capability_rollup(spark: SparkSession, d: str) -> DataFrame:
    return rep.capability_rollup(rep.capabilities(view(spark, d, "ehlo_replies")))


@query
def send_outcome(spark: SparkSession, d: str) -> DataFrame:
    outcome = rep.send_outcome(view(spark, d, "rcpt_results"))
    return outcome.withColumn("data_sent", F.col("data_sent").cast("bigint"))


@query
def failure_texts(spark: SparkSession, d: str) -> DataFrame:
    return rep.failure_texts(view(spark, d, "rcpt_results"), ["attempt", "t1", "t2"])


@query
def relay_attempts(spark: SparkSession, d: str) -> DataFrame:
    found = rep.relay_attempts(view(spark, d, "relay_attempts"), ["attempt", "t1", "t2"])
    none = F.lit("")
    return found.select(
        "message_id", F.col("connected").cast("bigint").alias("connected"), F.coalesce("host", none).alias("host"),
        F.coalesce("error", none).alias("error"),
    )


# Catalogues and calendars


@query
def localise(spark: SparkSession, d: str) -> DataFrame:
    texts = cat.latest_translations(view(spark, d, "translation_lines"))
    errors = view(spark, d, "errors")
    found = cat.localise(errors, texts, "brand#1", help_text=" See the manual.")
    return found.select("event_id", "lang", "message_key", "text")


@query
def translation_coverage(spark: SparkSession, d: str) -> DataFrame:
    return cat.translation_coverage(cat.latest_translations(view(spark, d, "translation_lines")), "brand#1")


@query
def calendar_export(spark: SparkSession, d: str) -> DataFrame:
    texts = cal.calendar_export(view(spark, d, "calendar_events"), "20240101T000000Z")
    return texts.select("calendar", "segment", F.octet_length("ics").cast("bigint").alias("n_bytes"), F.md5("ics").alias("ics_md5"))


# Sources


@query
def attachment_files_list(spark: SparkSession, d: str) -> DataFrame:
    return attachment_files(spark, f"{d}/*.parquet").select("name", "n_bytes")


@query
def read_transcript(spark: SparkSession, d: str) -> DataFrame:
    lines = parse_transcript(view(spark, d, "debug_lines"))
    return lines.select("log", "line_no", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "direction", "text")


@query
def read_catalogue(spark: SparkSession, d: str) -> DataFrame:
    value = F.concat(
        F.when(F.col("p_size") % 5 == 0, "// ").otherwise(""), F.lit("$TEXTS['"), "p_name", F.lit("'] = '"), "p_type", F.lit("\\'s';")
    )
    lines = table(spark, d, "part").select(F.lower("p_brand").alias("lang"), F.col("p_partkey").alias("line_no"), value.alias("value"))
    return cat.latest_translations(parse_catalogue(lines))


# Rendering


def _message_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    messages = msg.default_sender(view(spark, d, "messages"))
    recipients = rec.accepted_recipients(view(spark, d, "raw_recipients"))
    headers = msg.custom_headers(view(spark, d, "raw_headers"))
    files = att.mime_types(view(spark, d, "attachments"), "name").select(
        "message_id", "seq", "t1", "t2", "name", "mime", "disposition", "encoding", "cid",
        F.concat(F.lit("content of "), "name").cast("binary").alias("content"),
    )
    return messages, recipients, headers, files


@query
def header_lines(spark: SparkSession, d: str) -> DataFrame:
    messages, recipients, headers, files = _message_parts(spark, d)
    return header_block(ready(messages, files), recipients, headers, host="mx.example.com")


@query
def attachment_parts(spark: SparkSession, d: str) -> DataFrame:
    messages, _, _, files = _message_parts(spark, d)
    parts = attachment_texts(msg.message_type(messages, files), files)
    return parts.select("message_id", "pos", "seq", "t1", "t2", F.md5("piece").alias("piece_md5"))


@query
def render_messages(spark: SparkSession, d: str) -> DataFrame:
    return render_corpus(*_message_parts(spark, d), host="mx.example.com")


@query
def render_texts(spark: SparkSession, d: str) -> DataFrame:
    messages, recipients, headers, _ = _message_parts(spark, d)
    return render_text_messages(messages, recipients, headers, host="mx.example.com")


@query
def render_documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents as messages: 8-bit, 7-bit and, for long lines, quoted-printable bodies."""
    docs = view(spark, d, "messages_text").select(
        "message_id", "body", "alt_body", "encoding", "charset", F.lit("text/plain").alias("content_type"),
        F.lit("").alias("ical"), F.lit("").alias("given_id"), F.lit("").alias("confirm_to"), F.lit("Mañana").alias("from_name"),
        F.lit("docs@example.com").alias("from_address"), F.concat(F.lit("Über "), "source").alias("subject"),
        F.timestamp_seconds("message_id").alias("sent_at"),
    )
    zero = F.lit(0).cast("bigint")
    to = docs.select(
        "message_id", zero.alias("kind_rank"), F.lit("to").alias("kind"), zero.alias("seq"), zero.alias("t1"), zero.alias("t2"),
        F.concat(F.lit("reader."), F.col("message_id").cast("string"), F.lit("@example.com")).alias("address"), F.lit("").alias("name"),
    )
    none = view(spark, d, "raw_headers").filter("false").withColumns({"name": F.lit(""), "value": F.lit("")})
    return render_text_messages(docs, to, none)


# Streams, as batches


def _rate(log: DataFrame, *window: str) -> DataFrame:
    rate = live.delivery_rate(log, *window)
    return rate.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query
def delivery_rate(spark: SparkSession, d: str) -> DataFrame:
    return _rate(view(spark, d, "delivery_log"), "1 hour")


@query
def delivery_rate_sliding(spark: SparkSession, d: str) -> DataFrame:
    return _rate(view(spark, d, "delivery_log"), "1 hour", "30 minutes")


@query
def connection_sessions(spark: SparkSession, d: str) -> DataFrame:
    sessions = live.connection_sessions(view(spark, d, "delivery_log"))
    return sessions.withColumn("started", F.date_format("started", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query
def live_dedup(spark: SparkSession, d: str) -> DataFrame:
    feed = view(spark, d, "delivery_log").select(
        (F.col("session_id") % 20).alias("message_id"), "ts", "event_id",
        F.concat(F.when(F.col("is_sent"), "U.").otherwise("u."), (F.col("event_id") % 50).cast("string"), F.lit("@example.com")).alias("address"),
    )
    return live.live_dedup(feed).select("message_id", "address", "event_id")


@query
def live_unexpected(spark: SparkSession, d: str) -> DataFrame:
    found = live.live_unexpected(view(spark, d, "delivery_log"))
    return found.select("event_id", "command", F.col("code").cast("bigint").alias("code"), "detail")


@query
def recipient_ledger(spark: SparkSession, d: str) -> DataFrame:
    kept = ledger(view(spark, d, "ledger_commands"))
    return kept.withColumn("listed", F.col("listed").cast("bigint"))


# Sinks, read back


@query
def write_delivery_log(spark: SparkSession, d: str) -> DataFrame:
    path = shared_dir(spark) + "/log"
    log = view(spark, d, "delivery_log").select("event_id", "session_id", "command", "reply")
    store_log(log, path, "csv")
    return spark.read.schema(log.schema).options(**CSV).csv(path)


@query
def write_corpus(spark: SparkSession, d: str) -> DataFrame:
    path = shared_dir(spark) + "/corpus"
    store_corpus(render_texts(spark, d), path, 8)
    return spark.read.parquet(path).drop("bucket")


@query
def outbox(spark: SparkSession, d: str) -> DataFrame:
    """The delivery log as a stream: attempts appended, delivered emails marked on the list."""
    folder = shared_dir(spark)
    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events*.parquet")
    attempts = stream.select(
        "event_id",
        (F.col("event_type") == "purchase").alias("is_sent"),
        F.concat(F.lit("customer."), (F.col("user_id") % 400).cast("string"), F.lit("@building.example.com")).alias("email"),
    )
    live.outbox(attempts, f"{folder}/log", f"{folder}/sent", f"{folder}/checkpoint").awaitTermination()
    current = live.current_list(view(spark, d, "mailinglist"), f"{folder}/sent")
    return current.select("cust_id", "email", F.col("sent").cast("bigint").alias("sent"))
