"""Many saved queries in one pass: a text is tested only for the queries whose trigrams it has.

Each term of a query stands under one of its trigrams. The distinct trigrams of a text that stand for
any term are looked up in a broadcast table of the queries, and only the queries found are
evaluated, in the row of the text. The table grows with the queries, not with the corpus, and is refused
beyond ``MAX_QUERIES``; hits are combined per key for all queries together.
"""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliolens.functions.arrays import pin
from foliolens.functions.trigrams import chunks, folded, term_trigrams, trigrams
from foliolens.plans.merge import DOC_ORDER
from foliolens.plans.skew import keep_by_key
from foliolens.schema import DOC_COLUMNS
from foliolens.session import shared_table

MAX_QUERIES = 100_000
_TESTS = "array<struct<pattern:string,gram:string>>"
_QUERY = (f"query_name string, counted {_TESTS}, required {_TESTS}, none {_TESTS}, either boolean, wanted int, "
          "min_pages int, max_pages int, probes array<string>")
# a text without a term's trigram needs no test for it
_MAY = "(p.gram IS NULL OR array_contains(_grams, p.gram))"


@dataclass(frozen=True)
class Saved:
    """One query: patterns of its clauses, its filters, and terms of which each text that matters has one.

    ``literals`` has the terms that patterns stand for; a pattern without one is tested on every text.
    """

    name: str
    counted: list[str]
    required: list[str]
    none: list[str]
    either: bool
    terms: list[str]
    dataset: int | None = None
    min_pages: int = 0
    max_pages: int | None = None
    literals: dict[str, str] = field(default_factory=dict)


def probed(spark: SparkSession, queries: list[Saved]) -> list[tuple]:
    """Rows of ``_QUERY``, without the queries that have a term without a trigram.

    Of a term's trigrams the one that fewest terms share stands for it.
    """
    if len(queries) > MAX_QUERIES:
        raise ValueError(f"at most {MAX_QUERIES} saved queries in one pass, not {len(queries)}")
    terms = list(dict.fromkeys(t for q in queries for t in [*q.terms, *q.literals.values()]))
    grams = {}
    for at in range(0, len(terms), 1000):
        grams |= zip(terms[at:at + 1000], term_trigrams(spark, terms[at:at + 1000]))
    shared: dict[str, int] = {}
    for found in grams.values():
        for g in found:
            shared[g] = shared.get(g, 0) + 1
    probe = {t: min(found, key=lambda g: (shared[g], g), default=None) for t, found in grams.items()}
    rows = []
    for q in queries:
        probes = [probe[t] for t in q.terms]
        if None not in probes and len(q.required) <= 62:
            counted, required, none = ([(p, probe.get(q.literals.get(p))) for p in clause] for clause in (q.counted, q.required, q.none))
            rows.append((q.name, counted, required, none, q.either, q.dataset, q.min_pages, q.max_pages, sorted(set(probes))))
    return rows


def scores(corpus: DataFrame, rows: list[tuple], alone: bool = False) -> DataFrame:
    """One narrow row per query and document that has one of its trigrams: counts, flags, the query's filters.

    ``has`` has a bit for each required term, so that flags of a key combine before a shuffle. Where a document decides
    ``alone``, only those inside the query's filters that have a count are tested further.
    """
    spark = corpus.sparkSession
    every = F.array(*[F.lit(g) for g in sorted({g for r in rows for g in [*r[-1], *(g for clause in r[1:4] for _, g in clause if g)]})])
    queries = spark.createDataFrame(rows, _QUERY)
    probes = queries.select("*", F.explode("probes").alias("_gram"))
    # piece by piece, so that a very long text is never a list of all its trigrams
    grams = F.array_distinct(F.flatten(F.transform(chunks(folded(F.col("text"))), lambda piece: F.array_intersect(trigrams(piece), every))))
    docs = pin(corpus.select(*DOC_COLUMNS, "text", grams.alias("_found")), {"_grams": "_found"}, drop=("_found",))
    pairs = docs.select("*", F.explode("_grams").alias("_gram")).join(F.broadcast(probes), "_gram")
    # a query with several trigrams in the text is evaluated under the first of them
    pairs = pairs.filter("_gram = get(filter(probes, g -> array_contains(_grams, g)), 0)")
    if alone:
        pairs = pairs.filter(_WITHIN)
    pairs = pairs.selectExpr(
        "query_name", *DOC_COLUMNS, "either", "wanted", "min_pages", "max_pages", "shiftleft(1L, size(required)) - 1 AS every",
        "text", "_grams", "counted", "required", "none")
    # pinned: filters that reach into these values would test the texts again, one by one, for each use of them
    counted = pin(pairs, {"counts": f"transform(counted, p -> if({_MAY}, cast(regexp_count(text, p.pattern) AS bigint), 0L))"}, drop=("counted",))
    if alone:
        counted = counted.filter(f"{_TOTAL} > 0")
    scored = pin(counted, {
        "has": f"aggregate(transform(required, (p, i) -> if({_MAY} AND regexp_like(text, p.pattern), shiftleft(1L, i), 0L)), 0L, (a, b) -> a + b)",
        "excluded": f"exists(none, p -> {_MAY} AND regexp_like(text, p.pattern))"}, drop=("text", "_grams", "required", "none"))
    return scored.filter(f"{_TOTAL} > 0 OR has > 0 OR excluded")


_TOTAL = "aggregate(counts, 0L, (a, b) -> a + b)"
_WITHIN = "(wanted IS NULL OR dataset = wanted) AND (min_pages <= 0 OR pages >= min_pages) AND (max_pages IS NULL OR pages <= max_pages)"
_HIT = ["query_name", *DOC_COLUMNS, "match_count"]


def hits_unique(scored: DataFrame) -> DataFrame:
    """Hits where a document decides alone."""
    found = scored.withColumn("match_count", F.expr(_TOTAL))
    return found.filter(f"match_count > 0 AND has = every AND NOT excluded AND {_WITHIN}").select(_HIT)


def hits_by_key(scored: DataFrame, key: list[str]) -> DataFrame:
    """Hits of all queries where documents may share a key: two plans, however many queries there are.

    ``any`` queries give one merged row per key; others keep their documents.
    """
    by = ["query_name", *key]
    scored = shared_table(scored.withColumn("total", F.expr(_TOTAL)))
    doc = F.struct(*DOC_COLUMNS)
    part = F.expr("array_position(transform(counts, c -> c > 0), true)")
    at = F.when(F.col("total") > 0, F.struct(part.alias("part"), *DOC_ORDER))
    merged = scored.filter("either").groupBy("query_name", *[F.col(k).alias(f"_key_{k}") for k in key]).agg(
        F.min_by(doc, at).alias("doc"), F.sum("total").alias("match_count"), F.max("excluded").alias("excluded"),
        *[F.first(c).alias(c) for c in ("wanted", "min_pages", "max_pages")])
    merged = merged.filter("match_count > 0 AND NOT excluded").select("query_name", "doc.*", "match_count", "wanted", "min_pages", "max_pages")
    alone = scored.filter("NOT either")
    flags = alone.groupBy(*by).agg(F.count_if(F.col("total") > 0).alias("n"), F.bit_or("has").alias("has"), F.first("every").alias("every"),
                                   F.max("excluded").alias("excluded")).filter("n > 0")
    kept = keep_by_key(alone.filter("total > 0"), flags.filter("has = every AND NOT excluded"), by, DOC_ORDER, flags.select(*by, "n"))
    kept = kept.select("query_name", *DOC_COLUMNS, F.col("total").alias("match_count"), "wanted", "min_pages", "max_pages")
    return merged.unionByName(kept).filter(_WITHIN).select(_HIT)
