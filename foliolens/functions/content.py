"""Tests on raw file content (binary columns)."""

from pyspark.sql import Column, functions as F

# The leading bytes of a PDF file and of an HTML error page.
PDF_MAGIC = b"%PDF-"
HTML_STARTS = ("<!doctype html", "<html")


def has_magic(content: Column, magic: bytes = PDF_MAGIC) -> Column:
    """Non-empty content that starts with ``magic``; null and empty give false."""
    head = F.substring(content, 1, len(magic))
    return F.coalesce(head == F.lit(bytearray(magic)), F.lit(False))


#: Lengths of the head that is looked at for HTML; the whole only where all of these are blank.
_HEADS = (256, 65_536)


def _starts_html(head: Column) -> Column:
    shown = F.lower(F.regexp_replace(F.decode(head, "ISO-8859-1"), r"^\s+", "").substr(1, 32))
    found = F.lit(False)
    for start in HTML_STARTS:
        found = found | shown.startswith(start)
    return found


def content_kind(content: Column, magic: bytes = PDF_MAGIC) -> Column:
    """'pdf', 'html', 'empty' or 'other', told from the leading bytes; white space before HTML is passed over.

    A short head decides unless it is blank; the start that follows may run on past it by a few bytes.
    """
    room = max(map(len, HTML_STARTS))
    html = _starts_html(content)
    for length in reversed(_HEADS):
        blank = F.decode(F.substring(content, 1, length), "ISO-8859-1").rlike(r"^\s*\z")
        html = F.when(~blank, _starts_html(F.substring(content, 1, length + room))).otherwise(html)
    return (
        F.when(content.isNull() | (F.octet_length(content) == 0), "empty")
        .when(has_magic(content, magic), "pdf")
        .when(html, "html")
        .otherwise("other")
    )


def content_preview(content: Column, n: int = 200) -> Column:
    """The first ``n`` bytes as text, one character per byte."""
    return F.decode(F.substring(content, 1, n), "ISO-8859-1")
