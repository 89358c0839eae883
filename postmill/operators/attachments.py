"""Attachment tables: sources, types, duplicates, inventory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.session import small_table

# File extensions and their types. Anything else is DEFAULT_TYPE.
DEFAULT_TYPE = "application/octet-stream"
TYPES = {
    "ai": "application/postscript",
    "aif": "audio/x-aiff",
    "aifc": "audio/x-aiff",
    "aiff": "audio/x-aiff",
    "avi": "video/x-msvideo",
    "bin": "application/macbinary",
    "bmp": "image/bmp",
    "cpt": "application/mac-compactpro",
    "css": "text/css",
    "dcr": "application/x-director",
    "dir": "application/x-director",
    "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "dotx": "application/vnd.openxmlformats-officedocument.wordprocessingml.template",
    "dvi": "application/x-dvi",
    "dxr": "application/x-director",
    "eml": "message/rfc822",
    "eps": "application/postscript",
    "gif": "image/gif",
    "gtar": "application/x-gtar",
    "hqx": "application/mac-binhex40",
    "htm": "text/html",
    "html": "text/html",
    "jpe": "image/jpeg",
    "jpeg": "image/jpeg",
    "jpg": "image/jpeg",
    "js": "application/javascript",
    "log": "text/plain",
    "mid": "audio/midi",
    "midi": "audio/midi",
    "mif": "application/vnd.mif",
    "mov": "video/quicktime",
    "movie": "video/x-sgi-movie",
    "mp2": "audio/mpeg",
    "mp3": "audio/mpeg",
    "mpe": "video/mpeg",
    "mpeg": "video/mpeg",
    "mpg": "video/mpeg",
    "mpga": "audio/mpeg",
    "oda": "application/oda",
    "pdf": "application/pdf",
    "php": "application/x-httpd-php",
    "php3": "application/x-httpd-php",
    "php4": "application/x-httpd-php",
    "phps": "application/x-httpd-php-source",
    "phtml": "application/x-httpd-php",
    "png": "image/png",
    "potx": "application/vnd.openxmlformats-officedocument.presentationml.template",
    "ppsx": "application/vnd.openxmlformats-officedocument.presentationml.slideshow",
    "ppt": "application/vnd.ms-powerpoint",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "ps": "application/postscript",
    "qt": "video/quicktime",
    "ra": "audio/x-realaudio",
    "ram": "audio/x-pn-realaudio",
    "rm": "audio/x-pn-realaudio",
    "rpm": "audio/x-pn-realaudio-plugin",
    "rtf": "text/rtf",
    "rtx": "text/richtext",
    "rv": "video/vnd.rn-realvideo",
    "shtml": "text/html",
    "sit": "application/x-stuffit",
    "sldx": "application/vnd.openxmlformats-officedocument.presentationml.slide",
    "smi": "application/smil",
    "smil": "application/smil",
    "swf": "application/x-shockwave-flash",
    "tar": "application/x-tar",
    "text": "text/plain",
    "tgz": "application/x-tar",
    "tif": "image/tiff",
    "tiff": "image/tiff",
    "txt": "text/plain",
    "vcard": "text/vcard",
    "vcf": "text/vcard",
    "wav": "audio/x-wav",
    "wbxml": "application/vnd.wap.wbxml",
    "wmlc": "application/vnd.wap.wmlc",
    "word": "application/msword",
    "xht": "application/xhtml+xml",
    "xhtml": "application/xhtml+xml",
    "xl": "application/excel",
    "xlam": "application/vnd.ms-excel.addin.macroEnabled.12",
    "xls": "application/vnd.ms-excel",
    "xlsb": "application/vnd.ms-excel.sheet.binary.macroEnabled.12",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "xltx": "application/vnd.openxmlformats-officedocument.spreadsheetml.template",
    "xml": "text/xml",
    "xsl": "text/xml",
    "zip": "application/zip",
}


def type_table(spark: SparkSession) -> DataFrame:
    return small_table(spark, ("ext", "mime"), list(TYPES.items()))


def path_parts(path: Column) -> dict[str, Column]:
    """Folder, base name, stem and extension of a path. / and \\ both separate; they and dots are cut at the end."""
    whole = F.rtrim(path, F.lit("/\\."))
    base = F.substring_index(F.translate(whole, "\\", "/"), "/", -1)
    extension = F.when(F.contains(base, F.lit(".")), F.substring_index(base, ".", -1)).otherwise("")
    return {
        "dirname": F.rtrim(F.left(whole, F.length(whole) - F.length(base)), F.lit("/\\")),
        "basename": base,
        "filename": F.when(F.contains(base, F.lit(".")), F.left(base, F.length(base) - F.length(extension) - 1)).otherwise(base),
        "extension": extension,
    }


def mime_types(files: DataFrame, column: str = "path", types: DataFrame | None = None) -> DataFrame:
    """Add the path's parts and ``mime``, its type by extension. A query string is cut first.

    The built-in type table has under two hundred rows and is broadcast; give another as ``types``
    (``ext, mime``) and Spark picks the join by its size.
    """
    known = F.broadcast(type_table(files.sparkSession)) if types is None else types
    parts = path_parts(F.substring_index(F.col(column), "?", 1))
    named = files.withColumns(parts).withColumn("ext", F.lower("extension"))
    return named.join(known, "ext", "left").withColumn("mime", F.coalesce("mime", F.lit(DEFAULT_TYPE))).drop("ext")


def blob_attachments(
    rows: DataFrame, content: str, filename: str, disposition: str = "attachment", mime: str | None = None
) -> DataFrame:
    """Rows with a binary or text column become attachments; empty content makes none.

    Adds ``name`` (the base name), ``mime`` (by name where ``mime`` is not given), ``disposition, encoding, n_bytes``.
    """
    blob = F.col(content)
    skip = blob.isNull() | (F.octet_length(blob) == 0) | (blob.cast("binary") == F.lit("0").cast("binary"))
    kept = rows.filter(~skip)
    columns = {
        "name": F.regexp_extract(F.rtrim(F.col(filename), F.lit("/")), r"[^/]*$", 0),
        "disposition": F.lit(disposition),
        "encoding": F.lit("base64"),
        "n_bytes": F.octet_length(blob).cast("bigint"),
    }
    if mime is not None:
        return kept.withColumns({**columns, "mime": F.lit(mime)})
    typed = mime_types(kept, filename).drop("dirname", "basename", "extension")
    if filename != "filename":
        typed = typed.drop("filename")
    return typed.withColumns(columns)


def missing_attachments(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of ``manifest`` whose ``path`` is no file, with the error ``file_access``."""
    present = files.select("path").distinct()
    return manifest.join(present, "path", "left_anti").withColumn("error", F.lit("file_access"))


def attachment_dedup(attachments: DataFrame, identity: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Identical rows of a message count once; then the first inline row of each cid wins.

    ``identity`` lists the columns that make two attachments the same. Both steps keep only the first row per key
    in each map task before the shuffle.
    """
    same = Window.partitionBy("message_id", *identity).orderBy(*order)
    once = attachments.withColumn("_nth", F.row_number().over(same)).filter("_nth = 1").drop("_nth")
    per_cid = Window.partitionBy("message_id", "cid").orderBy(*order)
    inline = once.filter("disposition = 'inline'")
    first = inline.withColumn("_nth", F.row_number().over(per_cid)).filter("_nth = 1").drop("_nth")
    return once.filter("disposition <> 'inline'").unionByName(first)


def attachment_inventory(attachments: DataFrame) -> DataFrame:
    """``mime, disposition, encoding, n, n_bytes`` with subtotals by type and in all; a total shows ``all``."""
    keys = ("mime", "disposition", "encoding")
    totals = attachments.rollup(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("n_bytes").alias("n_bytes"),
        *[F.grouping(c).alias(f"_{c}") for c in keys],
    )
    labelled = [F.when(F.col(f"_{c}") == 1, "all").otherwise(F.col(c)).alias(c) for c in keys]
    return totals.select(*labelled, "n", "n_bytes")
