"""A whole search: base terms, exclusions, NEAR clauses, filters, order and page.

Three steps. Scores: one scan gives a narrow row of counts per relevant document. Hits:
scores are combined per key, filtered and ordered. Page: snippets are made only for the
documents of the page asked for.
"""

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, functions as F

from foliolens.functions.arrays import let, pin, sql_string
from foliolens.functions.patterns import clause_pattern
from foliolens.operators.boolean import MAX_CONTEXTS, as_key, has_any
from foliolens.operators.near import has_both, pair_label, reach_columns, reach_count, with_pairs, with_reach
from foliolens.operators.ranking import bounds, check_page, filter_hits, hit_totals, page_hits, rank_page
from foliolens.operators.spans import CONTEXT_CHARS, contexts, with_snippet_parts, with_spans
from foliolens.plans import percolate
from foliolens.plans.marks import with_marks
from foliolens.plans.merge import DOC_ORDER, first_contexts, first_rows
from foliolens.plans.percolate import Saved, probed
from foliolens.plans.skew import keep_by_key
from foliolens.schema import DOC_COLUMNS
from foliolens.session import shared_table

Near = tuple[str, str, int]

_SWITCHES = ("case_sensitive", "whole_word", "regex")
FEW_QUERIES = 16


@dataclass(frozen=True)
class SearchResult:
    """``hits`` without contexts; ``totals`` over all of them; ``page`` with contexts.

    All share the scores. ``hits.persist()`` before using more than one of them saves a
    scan where the scores were not written to the shared folder.
    """

    hits: DataFrame
    _build_page: Callable[[], DataFrame]

    @property
    def totals(self) -> DataFrame:
        return hit_totals(self.hits)

    @cached_property
    def page(self) -> DataFrame:
        return self._build_page()


@dataclass(frozen=True)
class _Spec:
    counted: list[str]
    required: list[str]
    none: list[str]
    near: list[Near]
    either: bool
    switches: dict[str, bool]

    @property
    def case_sensitive(self) -> bool:
        return self.switches.get("case_sensitive", False)

    def pattern(self, term: str) -> str:
        return clause_pattern(term, **self.switches)

    def has(self, term: str) -> Column:
        return F.col("text").rlike(self.pattern(term))

    def count(self, term: str) -> Column:
        """Matches in the text. A user's own pattern is refused where it matches the empty string."""
        pattern = sql_string(self.pattern(term))
        if not self.switches.get("regex"):
            return F.expr(f"regexp_count(text, {pattern})")
        refused = "cast(raise_error('the pattern matched the empty string') AS int)"
        return F.expr(let("found", f"regexp_extract_all(text, {pattern}, 0)",
                          f"if(exists(found, m -> m = ''), {refused}, size(found))"))

    def near_clauses(self) -> list[tuple[str, str, int, bool]]:
        return [(*clause, self.case_sensitive) for clause in self.near]

    def relevant(self, by_key: bool) -> Column:
        """Documents that can matter: those that decide alone, or by key all that carry any term."""
        tests = [F.expr(has_both(a, b, self.case_sensitive)) for a, b, _ in self.near]
        if by_key and self.counted:
            tests += [self.has(t) for t in self.counted + self.required + self.none]
        elif self.counted:
            # cheapest first: a test stops at its first match, and one that fails spares the others
            every = [reduce(Column.__or__, [self.has(t) for t in self.counted])] + [self.has(t) for t in self.required]
            tests.insert(0, reduce(Column.__and__, every) & ~has_any(self.none, **self.switches))
        return reduce(Column.__or__, tests)


def _spec(all_, any_, none, near, **switches: bool) -> _Spec:
    all_, any_, none, near = list(all_ or []), list(any_ or []), list(none or []), list(near or [])
    if all_ and any_:
        raise ValueError("give either all or any, not both")
    if not (all_ or any_ or near):
        raise ValueError("give at least one term or NEAR clause")
    return _Spec(any_ or all_[:1], all_[1:], none, near, bool(any_), switches)


def _scores(corpus: DataFrame, specs: dict[str, _Spec], by_key: bool) -> DataFrame:
    """One narrow row per query and relevant document: counts per clause, flags.

    All queries are scored in the same pass over the texts.
    """
    docs = corpus.filter(reduce(Column.__or__, [s.relevant(by_key) for s in specs.values()]))
    clauses = list(dict.fromkeys(clause for s in specs.values() for clause in s.near_clauses()))
    for i, (one, two, distance, case) in enumerate(clauses):
        docs = pin(docs, {"_both": f"if({has_both(one, two, case)}, text, null)"})
        docs = with_reach(docs, one, two, distance, "_reach", case, text="_both", drop=("_both",))
        docs = pin(docs, {f"_near{i}": f"coalesce({reach_count('_reach')}, 0L)"}, drop=reach_columns("_reach"))

    def row(name: str, spec: _Spec) -> Column:
        near = [F.col(f"_near{clauses.index(c)}") for c in spec.near_clauses()]
        return F.struct(
            F.lit(name).alias("query_name"),
            F.array(*[spec.count(t) for t in spec.counted])
            .cast("array<bigint>").alias("counts"),
            F.array(*near).cast("array<bigint>").alias("near"),
            F.array(*[spec.has(t) for t in spec.required]).cast("array<boolean>").alias("has"),
            has_any(spec.none, **spec.switches).alias("excluded"),
        )

    rows = F.array(*[row(name, spec) for name, spec in specs.items()])
    return docs.select(*DOC_COLUMNS, F.inline(rows))


def _total(counts: str) -> Column:
    return F.expr(f"aggregate({counts}, 0L, (s, x) -> s + x)")


def _first_part(counts: str) -> Column:
    """Number of the first clause with a count; null where none has."""
    return F.expr(f"nullif(array_position(transform({counts}, c -> c > 0), true), 0)")


def _hits_unique(scores: DataFrame) -> DataFrame:
    """With unique keys a document decides alone."""
    base = (_total("counts") > 0) & F.expr("forall(has, h -> h)") & ~F.col("excluded")
    scored = scores.withColumn("base", base)
    count = F.when(F.col("base"), _total("counts")).otherwise(0) + _total("near")
    return (scored.withColumn("match_count", count).filter("match_count > 0")
            .select("query_name", *DOC_COLUMNS, "match_count", "base"))


def _key_flags(scores: DataFrame, spec: _Spec, key: list[str]) -> DataFrame:
    every = [F.max(F.col("has")[i]) for i in range(len(spec.required))]
    found = F.count_if(_total("counts") > 0)
    base = reduce(Column.__and__, every, (found > 0) & ~F.max("excluded"))
    return scores.groupBy(*key).agg(found.alias("n"), base.alias("base"))


def _hits_per_document(scores: DataFrame, spec: _Spec, key: list[str]) -> DataFrame:
    """AND / NOT by key without NEAR: rows stay per document."""
    flags = _key_flags(scores, spec, key)
    found = scores.filter(_total("counts") > 0)
    kept = keep_by_key(found, flags.filter("base"), key, DOC_ORDER, flags.filter("n > 0"))
    return kept.select(*DOC_COLUMNS, _total("counts").alias("match_count"), F.lit(True).alias("base"))


def _hits_merged(scores: DataFrame, spec: _Spec, key: list[str]) -> DataFrame:
    """OR or NEAR by key: one row per key, from one aggregation that combines map-side."""
    doc = F.struct(*DOC_COLUMNS)
    count = _total("counts")
    every = [F.max(F.col("has")[i]) for i in range(len(spec.required))]
    if spec.either:
        at = F.when(count > 0, F.struct(_first_part("counts").alias("part"), *DOC_ORDER))
        base_doc, base_count = F.min_by(doc, at), F.sum(count)
    else:
        # a result put into a map by key keeps the last row of each key
        at = F.when(count > 0, F.struct(*DOC_ORDER))
        base_doc, base_count = F.max_by(doc, at), F.max_by(count, at)
    near_at = F.when(_total("near") > 0, F.struct(_first_part("near").alias("part"), *DOC_ORDER))
    merged = scores.groupBy(*[F.col(k).alias(f"_key_{k}") for k in key]).agg(
        base_doc.alias("base_doc"),
        base_count.alias("base_count"),
        F.min_by(doc, near_at).alias("near_doc"),
        F.sum(_total("near")).alias("near_count"),
        reduce(Column.__and__, every, (F.max(count) > 0) & ~F.max("excluded")).alias("base"),
    )
    total = F.when(F.col("base"), F.col("base_count")).otherwise(0) + F.col("near_count")
    return (merged
            .withColumn("match_count", total)
            .filter("match_count > 0")
            .withColumn("doc", F.when(F.col("base"), F.col("base_doc")).otherwise(F.col("near_doc")))
            .select("doc.*", "match_count", "base"))


def _clause_contexts(docs: DataFrame, spec: _Spec, context_chars: int, most: int) -> DataFrame:
    """Add ``_lists``: per clause (base terms, then NEAR) the first ``most`` contexts."""
    docs = with_snippet_parts(docs)
    lists = []
    for i, term in enumerate(spec.counted):
        docs = with_spans(docs, spec.pattern(term), f"_c{i}")
        lists.append(F.when(F.col("_use_base"), contexts(f"_c{i}", context_chars, most)))
    for i, (one, two, distance, case) in enumerate(spec.near_clauses()):
        docs = pin(docs, {"_both": f"if({has_both(one, two, case)}, text, null)"})
        docs = with_pairs(docs, one, two, distance, f"_n{i}", case, text="_both", drop=("_both",), most=most)
        lists.append(contexts(f"_n{i}", context_chars, most, pair_label(one, two)))
    none = F.array().cast("array<struct<position:int,context:string,match:string,page:int>>")
    return docs.withColumn("_lists", F.array(*[F.coalesce(one, none) for one in lists]))


def _page_by_document(page: DataFrame, corpus: DataFrame, spec: _Spec, context_chars: int,
                      most: int) -> DataFrame:
    """Contexts of a page whose rows are documents. A page is at most 10,000 narrow rows, which are
    brought to their documents: only the row groups that may hold those are read."""
    marks = page.select(*[F.col(c) for c in ("dataset", "filepath", "filename")],
                        F.col("match_count").alias("_count"), F.col("base").alias("_use_base"))
    docs = with_marks(corpus, marks, ["dataset", "filepath", "filename"])
    found = _clause_contexts(docs, spec, context_chars, most)
    return found.select(*DOC_COLUMNS, F.col("_count").alias("match_count"), F.slice(F.flatten("_lists"), 1, most).alias("contexts"))


def _page_by_key(page: DataFrame, scores: DataFrame, corpus: DataFrame, spec: _Spec,
                 key: list[str], context_chars: int, most: int) -> DataFrame:
    """Contexts of a page whose rows are keys, each gathered from several documents.

    A document with a hit gives at least one context, so the first ``most`` documents per
    key and clause are enough; the row limit is applied before the shuffle.
    """
    page = shared_table(page)
    marks = page.select(*key, F.col("base").alias("_use_base"), F.col("filepath").alias("_shown"))
    of_page = scores.join(F.broadcast(marks), key)
    base_ok = F.col("_use_base") if spec.either else (
        F.col("_use_base") & (F.col("filepath") == F.col("_shown")))
    of_page = of_page.withColumn("_use_base", base_ok)
    counts = F.expr("concat(transform(counts, c -> if(_use_base, c, 0L)), near)")
    found = of_page.select(*DOC_COLUMNS, "_use_base", F.posexplode(counts).alias("part", "n")).filter("n > 0")
    needed = first_rows(found, [*key, "part"], DOC_ORDER, most)
    wanted = needed.groupBy("dataset", "filepath", "filename").agg(
        F.max("_use_base").alias("_use_base"), F.collect_set("part").alias("_parts"))
    docs = with_marks(corpus, wanted, ["dataset", "filepath", "filename"])
    lists = _clause_contexts(docs, spec, context_chars, most).select(
        *DOC_COLUMNS, "_parts", F.posexplode("_lists").alias("part", "contexts"))
    lists = lists.filter(F.array_contains("_parts", F.col("part")))
    return F.broadcast(page.drop("base")).join(first_contexts(lists, key, most), key)


def _hits(scores: DataFrame, spec: _Spec, key: list[str]) -> DataFrame:
    """Hits of one query where several documents may share a key."""
    if spec.either or spec.near:
        return _hits_merged(scores, spec, key)
    if spec.required or spec.none:
        return _hits_per_document(scores, spec, key)
    return _hits_unique(scores).drop("query_name")


def query(corpus: DataFrame, all: list[str] | None = None, any: list[str] | None = None,
          none: list[str] | None = None, near: list[Near] | None = None,
          dataset: int | None = None, min_pages: int = 0, max_pages: int | None = None,
          sort: str = "relevance", page: int = 1, per_page: int = 20,
          key: str | list[str] = "filename", unique_key: bool = False,
          context_chars: int = CONTEXT_CHARS, max_contexts: int = MAX_CONTEXTS,
          case_sensitive: bool = False, whole_word: bool = False, regex: bool = False) -> SearchResult:
    """Search: ``all`` or ``any`` terms, minus ``none``, plus documents of ``near`` clauses.

    NEAR documents are added after the exclusions and are not subject to them; the filters
    apply to everything. (dataset, filepath) must tell documents apart. With ``unique_key``
    the hits come from one scan without a shuffle and the filters reach the scan.
    ``case_sensitive`` holds for all terms, ``whole_word`` and ``regex`` (Java syntax) for those
    of ``all``, ``any`` and ``none``; NEAR terms are literal.
    """
    spec = _spec(all, any, none, near, case_sensitive=case_sensitive, whole_word=whole_word, regex=regex)
    key = as_key(key)
    filters = {"dataset": dataset, "min_pages": min_pages, "max_pages": max_pages}
    if unique_key:
        corpus = filter_hits(corpus, **filters)
        hits = _hits_unique(_scores(corpus, {"": spec}, by_key=False)).drop("query_name")
    else:
        scores = _scores(corpus, {"": spec}, by_key=True)
        if spec.either or spec.near or spec.required or spec.none:
            scores = shared_table(scores)
        hits = filter_hits(_hits(scores, spec, key), **filters)
    check_page(page, per_page)

    def build_page() -> DataFrame:
        rows = page_hits(hits, page, per_page, sort)
        if not unique_key and (spec.either or spec.near):
            shown = _page_by_key(rows, scores, corpus, spec, key, context_chars, max_contexts)
        else:
            shown = _page_by_document(rows, corpus, spec, context_chars, max_contexts)
        return rank_page(shown, sort)

    return SearchResult(hits.drop("base"), build_page)


def query_many(corpus: DataFrame, queries: dict[str, dict], key: str | list[str] = "filename",
               unique_key: bool = False) -> DataFrame:
    """Hits of several saved queries, found in one pass over the corpus.

    Each entry has the clauses, filters and switches of ``query``; every row carries its ``query_name``.
    More than ``FEW_QUERIES`` go through ``percolate``, which tests a text only for queries whose
    trigrams it has; those with NEAR clauses, expressions or terms too short for a trigram take the other pass.
    """
    key = as_key(key)
    clauses = ("all", "any", "none", "near")
    limits = ("dataset", "min_pages", "max_pages")
    unknown = {k for q in queries.values() for k in q} - {*clauses, *limits, *_SWITCHES}
    if unknown:
        raise ValueError(f"not a clause, filter or switch: {sorted(unknown)}")
    specs = {name: _spec(*[q.get(c) for c in clauses], **{s: q[s] for s in _SWITCHES if s in q})
             for name, q in queries.items()}
    parts = []
    if len(specs) > FEW_QUERIES:
        rows = probed(corpus.sparkSession, [_saved(name, spec, queries[name], not unique_key)
                                                     for name, spec in specs.items() if not spec.near and not spec.switches.get("regex")])
        done = {r[0] for r in rows}
        specs = {name: spec for name, spec in specs.items() if name not in done}
        if rows:
            found = percolate.scores(corpus, rows, alone=unique_key)
            parts.append(percolate.hits_unique(found) if unique_key else percolate.hits_by_key(found, key))
    if specs:
        parts.append(_hits_of_each(corpus, specs, queries, key, unique_key))
    return reduce(DataFrame.unionByName, parts)


def _saved(name: str, spec: _Spec, given: dict, by_key: bool) -> Saved:
    patterns = lambda terms: [spec.pattern(t) for t in terms]
    # a text that decides alone has a counted term; by key others matter too
    terms = spec.counted + (spec.required + spec.none if by_key else [])
    literals = {spec.pattern(t): t for t in spec.counted + spec.required + spec.none}
    return Saved(name, patterns(spec.counted), patterns(spec.required), patterns(spec.none), spec.either, terms, literals=literals,
                 **{k: given[k] for k in ("dataset", "min_pages", "max_pages") if k in given})


def _hits_of_each(corpus: DataFrame, specs: dict[str, _Spec], queries: dict[str, dict], key: list[str], unique_key: bool) -> DataFrame:
    scores = _scores(corpus, specs, by_key=not unique_key)

    def within(name: str) -> Column:
        given = {k: queries[name][k] for k in ("dataset", "min_pages", "max_pages") if k in queries[name]}
        return (F.col("query_name") == name) & bounds(**given)

    if unique_key:
        wanted = reduce(Column.__or__, [within(name) for name in specs])
        return _hits_unique(scores).filter(wanted).drop("base")
    scores = shared_table(scores)
    parts = []
    for name, spec in specs.items():
        hits = _hits(scores.filter(F.col("query_name") == name), spec, key).drop("base")
        parts.append(hits.withColumn("query_name", F.lit(name)).filter(within(name)))
    return reduce(DataFrame.unionByName, parts)
