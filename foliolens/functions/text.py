"""Scalar functions over document text."""

from pyspark.sql import Column, functions as F

from foliolens.functions.arrays import let, running_totals, sql_string
from foliolens.functions.patterns import WORD, WS, escape_literal

PREVIEW_CHARS = 500


def text_preview(text: Column, n: int = PREVIEW_CHARS, always_dots: bool = False) -> Column:
    """First ``n`` characters; dots only where something was cut, unless ``always_dots``."""
    head = F.concat(F.substring(text, 1, n), F.lit("..."))
    return head if always_dots else F.when(F.char_length(text) > n, head).otherwise(text)


def text_length(text: Column) -> Column:
    return F.char_length(text)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def strip(text: Column) -> Column:
    """Trim white space of any kind on both sides."""
    return F.regexp_replace(text, f"^[{WS}]+|[{WS}]+\\z", "")


def split_pages(text: Column, sep: str = "\f") -> Column:
    return F.split(text, escape_literal(sep), -1)


def page_offsets(text: str, sep: str = "\f") -> Column:
    """Start position of every page of the column named ``text``; the first is 0."""
    pages = f"split({text}, {sql_string(escape_literal(sep))}, -1)"
    steps = f"transform({pages}, p -> char_length(p) + {len(sep)})"
    # the end of each page is the start of the next; the last page starts no other
    starts = let("ends", "slice(s, 1, size(s) - 1)", f"concat(array(0), {running_totals('ends')})")
    return F.expr(let("s", steps, starts))


def position_to_page(position: Column, offsets: Column) -> Column:
    """1-based page of a position; null where there are no offsets."""
    found = F.greatest(F.lit(1), F.size(F.filter(offsets, lambda o: o <= position)))
    return F.when(F.size(offsets) > 0, found)


def parse_info(raw: Column) -> Column:
    """``Key: Value`` lines as a map: cut at the first colon, trimmed, a later key wins."""
    lines = F.filter(F.split(raw, "\n", -1), lambda line: line.contains(":"))
    entries = F.transform(lines, lambda line: F.struct(
        strip(F.substring_index(line, ":", 1)).alias("key"),
        strip(F.substr(line, F.locate(":", line) + 1)).alias("value"),
    ))
    return F.aggregate(
        entries,
        F.create_map().cast("map<string,string>"),
        lambda seen, e: F.map_concat(
            F.map_filter(seen, lambda k, _: k != e["key"]),
            F.create_map(e["key"], e["value"]),
        ),
    )


def lenient_int(value: Column) -> Column:
    """A whole number or 0."""
    return F.coalesce(strip(value).try_cast("int"), F.lit(0))


def join_pages(pages: Column) -> dict[str, Column]:
    """Join page structs (page_number, text): text is trimmed, text_length is not."""
    texts = F.transform(F.array_sort(pages), lambda p: F.concat(F.coalesce(p["text"], F.lit("")), F.lit("\n\n")))
    joined = F.array_join(texts, "")
    return {"full_text": strip(joined), "text_length": F.char_length(joined)}
