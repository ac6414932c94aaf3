"""Match positions and snippets, computed inside each document row (no shuffle)."""

from pyspark.sql import Column, DataFrame, functions as F

from foliolens.functions.arrays import count_while, pin, running_totals, search_steps, sql_string

CHUNK_BITS = 10
CHUNK = 1 << CHUNK_BITS
CONTEXT_CHARS = 300


def find(text: str, pattern: str) -> dict[str, str]:
    """The matches of a pattern and the pieces of text between them."""
    return {"_pieces": f"split({text}, {sql_string(pattern)}, -1)",
            "_found": f"regexp_extract_all({text}, {sql_string(pattern)}, 0)"}


# Positions come from the pieces between matches, which a match of no length would upset.
_REFUSED = "array(cast(raise_error('the pattern matched the empty string') AS string))"


def with_spans(df: DataFrame, pattern: str, out: str = "spans", text: str = "text") -> DataFrame:
    """Add ``out``: every non-overlapping match as struct(start, end, match), in order.

    Spark returns the matched strings but not where they are; the pieces between the
    matches give their distances, and running totals of those the positions.
    """
    df = pin(df, find(text, pattern))
    df = pin(df, {"_kept": f"if(exists(_found, m -> m = ''), {_REFUSED}, _found)"}, drop=("_found",))
    df = pin(df, {"_steps": "zip_with(slice(_pieces, 1, size(_kept)), _kept,"
                            " (piece, m) -> char_length(piece) + char_length(m))"}, drop=("_pieces",))
    spans = (f"zip_with({running_totals('_steps')}, _kept, (e, m) ->"
             " named_struct('start', e - char_length(m), 'end', e, 'match', m))")
    return pin(df, {out: spans}, drop=("_steps", "_kept"))


def with_snippet_parts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add what ``context_sql`` looks things up in.

    Taking a substring counts characters from the start of the text, so doing it once per
    match is quadratic; cutting the text into chunks first makes each snippet cost the
    same wherever it lies. The page of a match is found by binary search.
    """
    offsets = "page_offsets" if "page_offsets" in df.columns else "cast(null AS array<int>)"
    return pin(df, {
        "_chunks": f"regexp_extract_all({text}, '(?s).{{1,{CHUNK}}}', 0)",
        "_length": f"char_length({text})",
        "_offsets": offsets,
        "_offset_steps": search_steps(offsets),
    })


def _snippet(start: str, end: str, context_chars: int) -> str:
    """Text around a match, with dots on a side where text was left out."""
    a = f"greatest({start} - {context_chars}, 0)"
    b = f"least({end} + {context_chars}, _length)"
    first, last = f"shiftright({a}, {CHUNK_BITS})", f"shiftright({b} - 1, {CHUNK_BITS})"
    around = f"array_join(slice(_chunks, {first} + 1, {last} - {first} + 1), '')"
    return (f"concat(if({start} > {context_chars}, '...', ''),"
            f" substring({around}, {a} % {CHUNK} + 1, {b} - {a}),"
            f" if({end} + {context_chars} < _length, '...', ''))")


def context_sql(start: str, end: str, match: str, context_chars: int = CONTEXT_CHARS) -> str:
    """struct(position, context, match, page) of one match.

    The page counts from 1 and is null for a document without page offsets.
    """
    before = count_while("_offset_steps", lambda i: f"get(_offsets, {i}) <= {start}")
    return (f"named_struct('position', {start}, 'context', {_snippet(start, end, context_chars)},"
            f" 'match', {match}, 'page', if(size(_offsets) > 0, greatest(1, {before}), null))")


def contexts(spans: str, context_chars: int = CONTEXT_CHARS, most: int | None = None,
             label: str | None = None) -> Column:
    """Contexts of all spans of a column, or of the first ``most`` of them.

    ``label`` stands in for the matched text where the spans have none.
    """
    if most is not None:
        spans = f"slice({spans}, 1, {most})"
    match = "s.match" if label is None else sql_string(label)
    return F.expr(f"transform({spans}, s -> {context_sql('s.start', 's.end', match, context_chars)})")
