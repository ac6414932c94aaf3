"""Search for one term: documents, match counts, positions, snippets and pages."""

from pyspark.sql import DataFrame, functions as F

from foliolens.functions.arrays import blocks
from foliolens.functions.patterns import regex_pattern, term_pattern
from foliolens.functions.trigrams import required_literals
from foliolens.operators.spans import (
    CONTEXT_CHARS, contexts, with_snippet_parts, with_spans,
)
from foliolens.schema import DOC_COLUMNS

MATCHES_AT_ONCE = 1024


def having(corpus: DataFrame, pattern: str, literal: str | None = None) -> DataFrame:
    """Documents with at least one match.

    A case-sensitive literal is also given as a plain ``contains``, which reaches the
    Parquet scan; case-folded terms have no exact pushed form.
    """
    if literal is not None:
        corpus = corpus.filter(F.col("text").contains(literal))
    return corpus.filter(F.col("text").rlike(pattern))


def _hits(corpus: DataFrame, pattern: str, context_chars: int, literal: str | None,
          max_contexts: int | None) -> DataFrame:
    found = with_snippet_parts(with_spans(having(corpus, pattern, literal), pattern))
    return found.select(
        *DOC_COLUMNS,
        F.size("spans").alias("match_count"),
        contexts("spans", context_chars, max_contexts).alias("contexts"),
    )


def _matches(corpus: DataFrame, pattern: str, context_chars: int, literal: str | None) -> DataFrame:
    found = with_snippet_parts(with_spans(having(corpus, pattern, literal), pattern))
    # a block of matches at a time: one by one would copy the text per match, and all at
    # once would hold every snippet of a document in memory
    found = found.select("*", F.explode(F.expr(blocks("spans", MATCHES_AT_ONCE))).alias("some"))
    found = found.select(*DOC_COLUMNS, contexts("some", context_chars).alias("contexts"))
    return found.select(*DOC_COLUMNS, F.inline("contexts"))


def search(corpus: DataFrame, term: str, case_sensitive: bool = False, whole_word: bool = False,
           context_chars: int = CONTEXT_CHARS, max_contexts: int | None = None) -> DataFrame:
    """One row per document that has the term, with its match count and contexts.

    A narrow plan: scan, filter, project. ``match_count`` counts every match also where
    ``max_contexts`` shortens the list of contexts.
    """
    return _hits(corpus, term_pattern(term, case_sensitive, whole_word), context_chars,
                 term if case_sensitive else None, max_contexts)


def search_matches(corpus: DataFrame, term: str, case_sensitive: bool = False,
                   whole_word: bool = False, context_chars: int = CONTEXT_CHARS) -> DataFrame:
    """One row per match: the flat form of ``search``, for results of any size."""
    return _matches(corpus, term_pattern(term, case_sensitive, whole_word), context_chars,
                    term if case_sensitive else None)


def search_regex(corpus: DataFrame, pattern: str, case_sensitive: bool = False,
                 context_chars: int = CONTEXT_CHARS, max_contexts: int | None = None) -> DataFrame:
    """``search`` with a regular expression in Java syntax.

    Of a case-sensitive pattern, the longest literal that every match holds goes to the scan.
    """
    return _hits(corpus, regex_pattern(pattern, case_sensitive),
                 context_chars, _needed_literal(pattern, case_sensitive), max_contexts)


def search_regex_matches(corpus: DataFrame, pattern: str, case_sensitive: bool = False,
                         context_chars: int = CONTEXT_CHARS) -> DataFrame:
    """One row per match of a regular expression."""
    return _matches(corpus, regex_pattern(pattern, case_sensitive),
                    context_chars, _needed_literal(pattern, case_sensitive))


def _needed_literal(pattern: str, case_sensitive: bool) -> str | None:
    if not case_sensitive or "(?" in pattern:  # flags inside the pattern may fold case
        return None
    return max(required_literals(pattern), key=len, default=None)


def count_matches(corpus: DataFrame, term: str, case_sensitive: bool = False,
                  whole_word: bool = False) -> DataFrame:
    """Documents and match counts without contexts: one pass of the pattern."""
    pattern = term_pattern(term, case_sensitive, whole_word)
    docs = having(corpus, pattern, term if case_sensitive else None)
    return docs.select(*DOC_COLUMNS, F.regexp_count("text", F.lit(pattern)).alias("match_count"))


def match_spans(corpus: DataFrame, term: str, case_sensitive: bool = False,
                whole_word: bool = False) -> DataFrame:
    """One row per match: start, end and matched text, without snippets."""
    pattern = term_pattern(term, case_sensitive, whole_word)
    found = with_spans(having(corpus, pattern, term if case_sensitive else None), pattern)
    return found.select(*DOC_COLUMNS, F.inline("spans"))


def contains_filter(corpus: DataFrame, term: str) -> DataFrame:
    return corpus.filter(F.col("text").contains(term)).select("filename")


def icontains_filter(corpus: DataFrame, term: str) -> DataFrame:
    """Lower-cased substring test; not the same folding as ``search`` for a few letters."""
    return (corpus.filter(F.lower("text").contains(term.lower()))
            .select("filename", "dataset", "pages"))


def filenames(corpus: DataFrame, dataset: int | None = None) -> DataFrame:
    """File names of everything or of one data set."""
    if dataset is not None:
        corpus = corpus.filter(F.col("dataset") == dataset)
    return corpus.select("filename")
