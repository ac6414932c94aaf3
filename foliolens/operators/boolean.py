"""AND, OR, NOT and NEAR merging over hits.

``key`` says which documents count as the same one; by default the file name alone.
``unique_key=True`` states that no two documents share a key. Then every operator here is
decided inside the document row: one scan, no shuffle.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from foliolens.functions.arrays import blocks
from foliolens.functions.patterns import clause_pattern
from foliolens.operators.search import MATCHES_AT_ONCE, search, search_matches
from foliolens.operators.spans import CONTEXT_CHARS, contexts, with_snippet_parts, with_spans
from foliolens.plans.marks import with_marks
from foliolens.plans.merge import DOC_ORDER, first_contexts, first_contexts_at, join_on_key, merge_counts
from foliolens.plans.skew import drop_by_key
from foliolens.schema import DOC_COLUMNS
from foliolens.session import shared_table

MAX_CONTEXTS = 50


def as_key(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def has_term(term: str, **switches: bool) -> Column:
    """The text has a match; ``switches`` are those of ``clause_pattern``."""
    return F.col("text").rlike(clause_pattern(term, **switches))


def has_any(terms: list[str], **switches: bool) -> Column:
    return reduce(Column.__or__, [has_term(t, **switches) for t in terms], F.lit(False))


def without_terms(corpus: DataFrame, terms: list[str], **switches: bool) -> DataFrame:
    """Documents that have none of the terms: NOT where a document decides alone, as part of the
    scan of the search that follows."""
    return corpus.filter(~has_any(terms, **switches)) if terms else corpus


def search_all(corpus: DataFrame, terms: list[str], key: str | list[str] = "filename",
               unique_key: bool = False, context_chars: int = CONTEXT_CHARS,
               max_contexts: int | None = None, case_sensitive: bool = False,
               whole_word: bool = False) -> DataFrame:
    """Documents whose key has every term; counts and contexts are those of the first term.

    By key, the keys are decided on flags alone; snippets are made only for the documents that stay.
    """
    if not terms:
        raise ValueError("at least one term is needed")
    first, rest = terms[0], terms[1:]
    switches = {"case_sensitive": case_sensitive, "whole_word": whole_word}
    if unique_key or not rest:
        for term in rest:
            corpus = corpus.filter(has_term(term, **switches))
        return search(corpus, first, **switches, context_chars=context_chars, max_contexts=max_contexts)
    key = as_key(key)
    flags = [F.max(has_term(t, **switches)).alias(f"t{i}") for i, t in enumerate(rest)]
    every = reduce(Column.__and__, [F.col(f"t{i}") for i in range(len(rest))], F.col("n"))
    keys = corpus.groupBy(*key).agg(F.max(has_term(first, **switches)).alias("n"), *flags).filter(every).select(*key)
    return search(with_marks(corpus, keys, key), first, **switches, context_chars=context_chars, max_contexts=max_contexts)


def search_any(corpus: DataFrame, terms: list[str], key: str | list[str] = "filename",
               unique_key: bool = False, context_chars: int = CONTEXT_CHARS,
               max_contexts: int | None = None, case_sensitive: bool = False,
               whole_word: bool = False) -> DataFrame:
    """Documents with any term: counts summed over terms, contexts in order of the terms.

    The list of contexts holds all of a document, or the first ``max_contexts``. Documents
    that share a key have no bounded list in common: there ``max_contexts`` has to be given,
    and ``search_any_rows`` gives all contexts as rows.
    """
    if not terms:
        raise ValueError("at least one term is needed")
    switches = {"case_sensitive": case_sensitive, "whole_word": whole_word}
    patterns = [clause_pattern(t, **switches) for t in terms]
    if unique_key:
        docs = with_snippet_parts(corpus.filter(has_any(terms, **switches)))
        names = [f"_spans{i}" for i in range(len(terms))]
        for name, pattern in zip(names, patterns):
            docs = with_spans(docs, pattern, name)
        first = f"concat({', '.join(n if max_contexts is None else f'slice({n}, 1, {max_contexts})' for n in names)})"
        return docs.select(*DOC_COLUMNS,
                           F.expr(" + ".join(f"size({n})" for n in names)).alias("match_count"),
                           contexts(first, context_chars, max_contexts).alias("contexts"))
    _check_list(max_contexts)
    key = as_key(key)
    docs = corpus.filter(has_any(terms, **switches))
    merged = merge_counts(_part_counts(docs, patterns), key)
    found = docs
    for i, pattern in enumerate(patterns):
        found = with_spans(found, pattern, f"_spans{i}")
    first = F.array(*[F.expr(f"slice(_spans{i}, 1, {max_contexts})") for i in range(len(patterns))])
    places = found.select(*{*key, *DOC_ORDER}, F.posexplode(first).alias("part", "_s"))
    places = places.select(*{*key, *DOC_ORDER}, "part", F.posexplode("_s").alias("i", "s"))
    lists = first_contexts_at(docs, places, key, max_contexts, context_chars)
    return join_on_key(merged, lists, key)


def _part_counts(docs: DataFrame, patterns: list[str]) -> DataFrame:
    """(document columns, part, match_count): narrow rows of the terms that a document has."""
    counted = F.array(*[F.regexp_count("text", F.lit(p)) for p in patterns])
    return docs.select(*DOC_COLUMNS, F.posexplode(counted).alias("part", "match_count")).filter("match_count > 0")


def _check_list(max_contexts: int | None) -> None:
    if max_contexts is None:
        raise ValueError("a list of contexts over documents that share a key needs max_contexts; "
                         "the forms that end in _rows give all contexts")


def search_any_rows(corpus: DataFrame, terms: list[str], key: str | list[str] = "filename",
                    context_chars: int = CONTEXT_CHARS, case_sensitive: bool = False,
                    whole_word: bool = False) -> DataFrame:
    """``search_any`` over documents that share a key, every context as a row.

    Counts are merged per key first; then every document makes its own rows, a block of matches
    at a time, under the merged head that is brought to it.
    """
    if not terms:
        raise ValueError("at least one term is needed")
    key = as_key(key)
    switches = {"case_sensitive": case_sensitive, "whole_word": whole_word}
    patterns = [clause_pattern(t, **switches) for t in terms]
    docs = corpus.filter(has_any(terms, **switches))
    found = with_snippet_parts(with_marks(docs, _heads(merge_counts(_part_counts(docs, patterns), key), key), key))
    for i, pattern in enumerate(patterns):
        found = with_spans(found, pattern, f"_spans{i}")
    pieces = ", ".join(blocks(f"_spans{i}", MATCHES_AT_ONCE) for i in range(len(patterns)))
    found = found.select("*", F.explode(F.expr(f"concat({pieces})")).alias("some"))
    return _under_heads(found.withColumn("contexts", contexts("some", context_chars)))


def _heads(merged: DataFrame, key: list[str]) -> DataFrame:
    """Merged hits as marks: the key, and the document that stands for it."""
    return merged.select(*key, *[F.col(c).alias(f"_head_{c}") for c in DOC_COLUMNS], F.col("match_count").alias("_total"))


def _under_heads(rows: DataFrame) -> DataFrame:
    rows = rows.select(*[F.col(f"_head_{c}").alias(c) for c in DOC_COLUMNS], F.col("_total").alias("match_count"), "contexts")
    return rows.select(*DOC_COLUMNS, "match_count", F.inline("contexts"))


def search_any_matches(corpus: DataFrame, terms: list[str],
                       context_chars: int = CONTEXT_CHARS) -> DataFrame:
    """Every match of every term as a row; (part, dataset, filename, filepath, position) is their order."""
    parts = [search_matches(corpus, t, context_chars=context_chars).withColumn("part", F.lit(i))
             for i, t in enumerate(terms)]
    return reduce(DataFrame.unionByName, parts)


def exclude_terms(hits: DataFrame, corpus: DataFrame, terms: list[str],
                  key: str | list[str] = "filename") -> DataFrame:
    """Drop hits whose key has any of the terms in any document.

    For hits that exist already. Where a search is still to be run, ``without_terms`` (unique
    keys) and ``query`` (any key) need one pass over the texts.
    """
    if not terms:
        return hits
    key = as_key(key)
    # a key has at most as many hits as documents, and counting those reads no text
    counts = corpus.groupBy(*key).agg(F.count("*").alias("n"))
    gone = corpus.filter(has_any(terms)).select(*key).distinct()
    return drop_by_key(hits, shared_table(gone), key, DOC_ORDER, counts)


def merge_near(hits: DataFrame, near_hits: list[DataFrame], key: str | list[str] = "filename",
               max_contexts: int | None = None) -> DataFrame:
    """Add NEAR hits to a result: counts added, contexts appended, new documents joined in.

    Of result rows that share a key the last one stands, as when a result is put into a
    map by key; NEAR hits that share a key add up.
    """
    _check_list(max_contexts)
    key = as_key(key)
    rows = _as_parts([_last_of_key(hits, key), *near_hits])
    return join_on_key(merge_counts(rows, key), first_contexts(rows, key, max_contexts), key)


def merge_near_rows(hits: DataFrame, near_hits: list[DataFrame], key: str | list[str] = "filename") -> DataFrame:
    """``merge_near`` with every context as a row.

    Which document stands for a key, and the counts, are decided on rows without contexts; the
    rows of contexts then come from the documents themselves.
    """
    key = as_key(key)
    narrow = [h.select(*DOC_COLUMNS, "match_count") for h in [hits, *near_hits]]
    base = _last_of_key(narrow[0], key)
    merged = merge_counts(_as_parts([base, *narrow[1:]]), key)
    shown = base.select(*[F.col(k).alias(f"_b_{k}") for k in key], *[F.col(c).alias(f"_shown_{c}") for c in ("dataset", "filepath")])
    heads = _heads(merged, key)
    heads = heads.join(shown, reduce(Column.__and__, [heads[k].eqNullSafe(shown[f"_b_{k}"]) for k in key]), "left").drop(*[f"_b_{k}" for k in key])
    rows = with_marks(hits.drop("match_count"), heads, key)
    stands = F.col("dataset").eqNullSafe(F.col("_shown_dataset")) & F.col("filepath").eqNullSafe(F.col("_shown_filepath"))
    parts = [rows.filter(stands)] + [with_marks(n.drop("match_count"), heads, key) for n in near_hits]
    return reduce(DataFrame.unionByName, [_under_heads(p) for p in parts])


def _last_of_key(hits: DataFrame, key: list[str]) -> DataFrame:
    return hits.groupBy(*[F.col(k).alias(f"_key_{k}") for k in key]).agg(
        F.max_by(F.struct(*hits.columns), F.struct(*DOC_ORDER)).alias("hit")).select("hit.*")


def _as_parts(lists: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [one.withColumn("part", F.lit(i)) for i, one in enumerate(lists)])
