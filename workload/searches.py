"""Search queries: terms, Boolean clauses, NEAR, whole searches, filters, orders, pages."""

from pyspark.sql import DataFrame, functions as F

from foliolens.operators import boolean, near, ranking, search
from foliolens.plans.query import query as run_query, query_many
from foliolens.schema import DOC_COLUMNS
from foliolens.sources import signatures
from workload import tables as t
from workload.registry import query

DOC = "dataset, filename, filepath, pages"


def flat(hits: DataFrame) -> DataFrame:
    """Hits with one row per context."""
    return hits.select(*DOC_COLUMNS, "match_count", F.inline("contexts"))


def _flat_sql(term: str, where: str = "true", flags: str = "(?i)", regex: str | None = None,
              source: str = "corpus") -> str:
    return f"""WITH {t.CORPUS}, {t.spans(term, 'm', where, source, flags, regex)}
      SELECT {DOC}, match_count, {t.context()} FROM m"""


@query("search_term", _flat_sql("the"))
def _(spark, sf):
    return flat(search.search(t.corpus(spark, sf), "the"))


@query("search_case", _flat_sql("The", flags=""))
def _(spark, sf):
    return flat(search.search(t.corpus(spark, sf), "The", case_sensitive=True))


# \b is ASCII only there, so other letters are first turned into one that is
_ASCII = "ascii AS (SELECT * REPLACE (regexp_replace(text, '[^\\x00-\\x7f]', 'x', 'g') AS text) FROM corpus)"


@query("search_whole_word", f"""WITH {t.CORPUS}, {_ASCII}, {t.spans('', 'm', source='ascii', regex=r'\bon\b')}
  SELECT {DOC}, match_count, {t.context()} FROM m""")
def _(spark, sf):
    return flat(search.search(t.corpus(spark, sf), "on", whole_word=True))


@query("search_regex", _flat_sql("", regex="th[ae]t?[ ,.]"))
def _(spark, sf):
    return flat(search.search_regex(t.corpus(spark, sf), "th[ae]t?[ ,.]"))


@query("search_regex_case", _flat_sql("", regex="L[a-z]+ under the", flags="").replace("match_count, ", ""))
def _(spark, sf):
    return search.search_regex_matches(t.corpus(spark, sf), "L[a-z]+ under the", case_sensitive=True)


@query("search_indexed", _flat_sql("token").replace("match_count, ", ""))
def _(spark, sf):
    return search.search_matches(signatures.narrowed(spark, t.signed(spark, sf), all=["token"]), "token")


@query("search_indexed_regex", _flat_sql("", regex="licen[cs]ed? (under|of)").replace("match_count, ", ""))
def _(spark, sf):
    pattern = "licen[cs]ed? (under|of)"
    return search.search_regex_matches(signatures.narrowed_by_pattern(spark, t.signed(spark, sf), pattern), pattern)


@query("search_indexed_or", f"""WITH {t.CORPUS} SELECT {DOC}, CAST(len(regexp_extract_all(text, '(?i)über')) + len(regexp_extract_all(text,
    '(?i)license')) AS INTEGER) AS match_count FROM corpus WHERE regexp_matches(text, '(?i)über|license')""")
def _(spark, sf):
    docs = signatures.narrowed(spark, t.signed(spark, sf), any=["über", "license"])
    return boolean.search_any(docs, ["über", "license"], unique_key=True, max_contexts=1).drop("contexts")


@query("search_phrase", _flat_sql("ing the"))
def _(spark, sf):
    return flat(search.search(t.corpus(spark, sf), "ing the"))


@query("search_accent", _flat_sql("é"))
def _(spark, sf):
    return flat(search.search(t.corpus(spark, sf), "é"))


@query("search_matches", _flat_sql("und").replace("match_count, ", ""))
def _(spark, sf):
    return search.search_matches(t.corpus(spark, sf), "und")


@query("search_counts", f"""WITH {t.CORPUS}
  SELECT {DOC}, CAST(len(regexp_extract_all(text, '(?i)the')) AS INTEGER) AS match_count
  FROM corpus WHERE regexp_matches(text, '(?i)the')""")
def _(spark, sf):
    return search.count_matches(t.corpus(spark, sf), "the")


@query("search_symbols", f"""WITH {t.CORPUS}
  SELECT {DOC}, CAST(len(regexp_extract_all(text, '2\\.0\\.')) AS INTEGER) AS match_count
  FROM corpus WHERE contains(text, '2.0.')""")
def _(spark, sf):
    return search.count_matches(t.corpus(spark, sf), "2.0.")


@query("page_after", f"""WITH {t.CORPUS}, hits AS (SELECT {DOC}, CAST(len(regexp_extract_all(text, '(?i)the')) AS INTEGER) AS match_count
    FROM corpus WHERE regexp_matches(text, '(?i)the'))
  SELECT * FROM hits ORDER BY match_count DESC, dataset, filename LIMIT 20 OFFSET 40""")
def _(spark, sf):
    hits = search.count_matches(t.corpus(spark, sf), "the")
    last = None
    for _ in range(2):
        last = ranking.page_after(hits, last).collect()[-1]
    return ranking.page_after(hits, last)


@query("match_spans", f"""WITH {t.CORPUS}, {t.spans('tion', 'm')}
  SELECT {DOC}, s AS "start", e AS "end", m AS match FROM m""")
def _(spark, sf):
    return search.match_spans(t.corpus(spark, sf), "tion")


@query("snippet", f"""WITH {t.CORPUS}, {t.spans('é', 'm')}
  SELECT filename, position, context FROM (SELECT filename, {t.context(chars=40)} FROM m)""")
def _(spark, sf):
    hits = search.search(t.corpus(spark, sf), "é", context_chars=40)
    return flat(hits).select("filename", "position", "context")


@query("contains_filter", f"WITH {t.CORPUS} SELECT filename FROM corpus WHERE contains(text, 'The')")
def _(spark, sf):
    return search.contains_filter(t.corpus(spark, sf), "The")


@query("icontains_filter", f"""WITH {t.CORPUS}
  SELECT filename, dataset, pages FROM corpus WHERE contains(lower(text), lower('Über'))""")
def _(spark, sf):
    return search.icontains_filter(t.corpus(spark, sf), "Über")


def _has(term: str) -> str:
    return f"regexp_matches(text, '(?i){term}')"


@query("search_and", _flat_sql("the", f"{_has('license')} AND {_has('and')}"))
def _(spark, sf):
    return flat(boolean.search_all(t.corpus(spark, sf), ["the", "license", "and"], unique_key=True))


@query("search_and_by_name", f"""WITH {t.BY_NAME},
  names AS (SELECT filename FROM corpus GROUP BY filename
    HAVING bool_or({_has('über')}) AND bool_or({_has('license')})),
  {t.spans('über', 'm', "filename IN (SELECT filename FROM names)")}
  SELECT {DOC}, match_count, {t.context()} FROM m""")
def _(spark, sf):
    return flat(boolean.search_all(t.corpus_by_name(spark, sf), ["über", "license"]))


def _any_sql(tables: str, key: str) -> str:
    """OR of two terms: counts summed per key, all contexts."""
    return f"""WITH {tables}, {t.spans('über', 'a')}, {t.spans('license', 'b')},
    m AS (SELECT *, 0 AS part FROM a UNION ALL SELECT *, 1 AS part FROM b),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY {key}
        ORDER BY part, dataset, filename, filepath, s) AS rn,
        count(*) OVER (PARTITION BY {key}) AS n FROM m),
    heads AS (SELECT {key} AS k, dataset, filename, filepath, pages FROM ranked WHERE rn = 1)
    SELECT h.dataset, h.filename, h.filepath, h.pages, CAST(n AS {{kind}}) AS match_count, {t.context(m='m')}
    FROM ranked r JOIN heads h ON r.{key} = h.k"""


@query("search_or", _any_sql(t.CORPUS, "filepath").format(kind="INTEGER"))
def _(spark, sf):
    return flat(boolean.search_any(t.corpus(spark, sf), ["über", "license"], unique_key=True))


@query("search_or_by_name", _any_sql(t.BY_NAME, "filename").format(kind="BIGINT"))
def _(spark, sf):
    return boolean.search_any_rows(t.corpus_by_name(spark, sf), ["über", "license"])


@query("search_or_matches", f"""WITH {t.CORPUS}, {t.spans('über', 'a')}, {t.spans('license', 'b')},
  m AS (SELECT *, 0 AS part FROM a UNION ALL SELECT *, 1 AS part FROM b)
  SELECT {DOC}, {t.context()}, part FROM m""")
def _(spark, sf):
    return boolean.search_any_matches(t.corpus(spark, sf), ["über", "license"])


@query("search_not", f"""WITH {t.CORPUS} SELECT {DOC},
    CAST(len(regexp_extract_all(text, '(?i)the')) AS INTEGER) AS match_count
  FROM corpus WHERE {_has('the')} AND NOT {_has('license')} AND NOT {_has('ing the')}""")
def _(spark, sf):
    docs = t.corpus(spark, sf)
    return search.count_matches(boolean.without_terms(docs, ["license", "ing the"]), "the")


@query("search_not_by_name", f"""WITH {t.BY_NAME} SELECT {DOC},
    CAST(len(regexp_extract_all(text, '(?i)the')) AS BIGINT) AS match_count
  FROM corpus WHERE {_has('the')}
    AND filename NOT IN (SELECT filename FROM corpus WHERE {_has('license')})""")
def _(spark, sf):
    return run_query(t.corpus_by_name(spark, sf), all=["the"], none=["license"]).hits


@query("search_near", f"""WITH {t.CORPUS}, {t.pairs('the', 'and', 3, 'n')}
  SELECT {DOC}, CAST(count(*) OVER (PARTITION BY filepath) AS BIGINT) AS match_count,
    {t.context(m="'the...and'")} FROM n""")
def _(spark, sf):
    return near.search_near_matches(t.corpus(spark, sf), "the", "and", 3)


@query("search_near_same_term", f"""WITH {t.CORPUS}, {t.pairs('on', 'on', 1, 'n')}
  SELECT {DOC}, CAST(count(*) AS BIGINT) AS match_count FROM n GROUP BY ALL""")
def _(spark, sf):
    return near.count_near(t.corpus(spark, sf), "on", "on", 1)


@query("search_near_cap", f"""WITH {t.CORPUS}, {t.pairs('the', 'and', 20, 'n')},
  taken AS (SELECT *, sum(c) OVER (PARTITION BY filepath ORDER BY i) - c AS before
    FROM (SELECT {DOC}, i, count(*) AS c FROM n GROUP BY ALL))
  SELECT {DOC}, CAST(sum(c) AS BIGINT) AS match_count FROM taken WHERE before < 50 GROUP BY ALL""")
def _(spark, sf):
    return near.count_near(t.corpus(spark, sf), "the", "and", 20, cap=50)


_NEAR_MERGE = f"""WITH {t.BY_NAME}, {t.spans('license', 'b')}, {t.pairs('of', 'license', 12, 'n')},
  base AS (SELECT b.* FROM b JOIN (SELECT filename, max((dataset, filename, filepath)) AS newest FROM b GROUP BY filename) x
    ON b.filename = x.filename AND (b.dataset, b.filename, b.filepath) = x.newest),
  m AS (SELECT dataset, filename, filepath, pages, text, 0 AS part, s, e, m, i, 0 AS j FROM base
    UNION ALL SELECT dataset, filename, filepath, pages, text, 1, s, e, 'of...license', i, j FROM n),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY part, dataset, filepath, i, j) AS rn,
      count(*) OVER (PARTITION BY filename) AS total FROM m),
  heads AS (SELECT filename AS k, dataset, filepath, pages FROM ranked WHERE rn = 1)
  SELECT h.dataset, filename, h.filepath, h.pages, CAST(total AS BIGINT) AS match_count, {t.context()}
  FROM ranked r JOIN heads h ON r.filename = h.k"""


@query("search_near_merge", _NEAR_MERGE)
def _(spark, sf):
    docs = t.corpus_by_name(spark, sf)
    return boolean.merge_near_rows(search.search(docs, "license"), [near.search_near(docs, "of", "license", 12)])


# --- whole searches ------------------------------------------------------------------------

_FULL = dict(all=["the", "and"], none=["license"], near=[("of", "license", 12)],
             min_pages=2, max_pages=60, per_page=25)

_FULL_SQL = f"""WITH {t.CORPUS}, {t.pairs('of', 'license', 12, 'n')},
  base AS (SELECT * FROM corpus WHERE {_has('the')} AND {_has('and')} AND NOT {_has('license')}),
  {t.spans('the', 'b', source='base')},
  m AS (SELECT dataset, filename, filepath, pages, text, 0 AS part, s, e, m, i, 0 AS j FROM b
    UNION ALL SELECT dataset, filename, filepath, pages, text, 1, s, e, 'of...license', i, j FROM n),
  hits AS (SELECT {DOC}, CAST(count(*) AS BIGINT) AS match_count FROM m
    WHERE pages BETWEEN 2 AND 60 GROUP BY ALL)"""

_FULL_PAGE = """
  page AS (SELECT *, CAST(row_number() OVER (ORDER BY match_count DESC, dataset, filename) AS INTEGER) AS rank
    FROM hits ORDER BY match_count DESC, dataset, filename LIMIT 25),
  ranked AS (SELECT m.*, p.match_count, p.rank, row_number() OVER (PARTITION BY m.filepath
      ORDER BY part, m.i, j) AS rn FROM m JOIN page p USING (filepath))"""


@query("search_full", f"""{_FULL_SQL},{_FULL_PAGE}
  SELECT {DOC}, match_count, rank, {t.context()} FROM ranked WHERE rn <= 50""")
def _(spark, sf):
    page = run_query(t.corpus(spark, sf), **_FULL, unique_key=True).page
    return page.select(*DOC_COLUMNS, "match_count", "rank", F.inline("contexts"))


@query("search_full_hits", f"{_FULL_SQL} SELECT * FROM hits")
def _(spark, sf):
    return run_query(t.corpus(spark, sf), **_FULL, unique_key=True).hits


@query("search_full_totals", f"""{_FULL_SQL}
  SELECT count(*) AS total, CAST(sum(match_count) AS BIGINT) AS total_matches FROM hits""")
def _(spark, sf):
    return run_query(t.corpus(spark, sf), **_FULL, unique_key=True).totals


def _switched_sql(first: str, second: str, without: str, source: str = "corpus") -> str:
    """Hits of a whole search for two patterns, less a third."""
    return f"""WITH {t.CORPUS}, {_ASCII} SELECT {DOC},
        CAST(len(regexp_extract_all(text, '{first}')) AS BIGINT) AS match_count FROM {source}
      WHERE regexp_matches(text, '{first}') AND regexp_matches(text, '{second}')
        AND NOT regexp_matches(text, '{without}')"""


@query("search_full_case", _switched_sql("the", "The", "License"))
def _(spark, sf):
    return run_query(t.corpus(spark, sf), all=["the", "The"], none=["License"], unique_key=True, case_sensitive=True).hits


@query("search_full_whole_word", _switched_sql(r"(?i)\bon\b", r"(?i)\bthe\b", r"(?i)\bor\b", "ascii"))
def _(spark, sf):
    return run_query(t.corpus(spark, sf), all=["on", "the"], none=["or"], unique_key=True, whole_word=True).hits


@query("search_full_regex", _switched_sql("(?i)th[ae]t?[ ,.]", "(?i)w[aeiou]r", "(?i)lic[ei]n"))
def _(spark, sf):
    return run_query(t.corpus(spark, sf), all=["th[ae]t?[ ,.]", "w[aeiou]r"], none=["lic[ei]n"], unique_key=True,
                     regex=True).hits


_FULL_NAME_SQL = f"""WITH {t.BY_NAME}, {t.pairs('of', 'license', 12, 'n')},
  names AS (SELECT filename FROM corpus GROUP BY filename
    HAVING bool_or({_has('the')}) AND bool_or({_has('and')}) AND NOT bool_or({_has('license')})),
  {t.spans('the', 'b', "filename IN (SELECT filename FROM names)")},
  final_doc AS (SELECT filename, max((dataset, filename, filepath)) AS newest FROM b GROUP BY filename),
  m AS (SELECT b.dataset, b.filename, b.filepath, b.pages, text, 0 AS part, s, e, m, i, 0 AS j
      FROM b JOIN final_doc f ON b.filename = f.filename AND (b.dataset, b.filename, b.filepath) = newest
    UNION ALL SELECT dataset, filename, filepath, pages, text, 1, s, e, 'of...license', i, j FROM n),
  ranked_all AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY part, dataset, filepath, i, j) AS rn,
      count(*) OVER (PARTITION BY filename) AS total FROM m),
  hits AS (SELECT {DOC}, CAST(total AS BIGINT) AS match_count FROM ranked_all
    WHERE rn = 1 AND pages BETWEEN 2 AND 60)"""


@query("search_full_by_name", f"""{_FULL_NAME_SQL},
  page AS (SELECT *, CAST(row_number() OVER (ORDER BY match_count DESC, dataset, filename) AS INTEGER) AS rank
    FROM hits ORDER BY match_count DESC, dataset, filename LIMIT 25)
  SELECT p.dataset, filename, p.filepath, p.pages, p.match_count, p.rank, {t.context()}
  FROM ranked_all r JOIN page p USING (filename) WHERE rn <= 50""")
def _(spark, sf):
    page = run_query(t.corpus_by_name(spark, sf), **_FULL).page
    return page.select(*DOC_COLUMNS, "match_count", "rank", F.inline("contexts"))


@query("search_full_hits_by_name", f"{_FULL_NAME_SQL} SELECT * FROM hits")
def _(spark, sf):
    return run_query(t.corpus_by_name(spark, sf), **_FULL).hits


@query("search_and_not_by_name", f"""WITH {t.BY_NAME},
  names AS (SELECT filename FROM corpus GROUP BY filename
    HAVING bool_or({_has('über')}) AND bool_or({_has('and')}) AND NOT bool_or({_has('license')}))
  SELECT {DOC}, CAST(len(regexp_extract_all(text, '(?i)über')) AS BIGINT) AS match_count
  FROM corpus WHERE {_has('über')} AND filename IN (SELECT filename FROM names)""")
def _(spark, sf):
    return run_query(t.corpus_by_name(spark, sf), all=["über", "and"], none=["license"]).hits


_BATCH = {
    "either": dict(any=["über", "nicht"], none=["license"]),
    "both": dict(all=["of", "license"], min_pages=3),
    "close": dict(near=[("the", "license", 5)]),
}


@query("search_batch", f"""WITH {t.CORPUS}, {t.pairs('the', 'license', 5, 'n')}
  SELECT {DOC}, CAST(len(regexp_extract_all(text, '(?i)über')) + len(regexp_extract_all(text, '(?i)nicht')) AS BIGINT)
      AS match_count, 'either' AS query_name
    FROM corpus WHERE ({_has('über')} OR {_has('nicht')}) AND NOT {_has('license')}
  UNION ALL SELECT {DOC}, CAST(len(regexp_extract_all(text, '(?i)of')) AS BIGINT), 'both'
    FROM corpus WHERE {_has('of')} AND {_has('license')} AND pages >= 3
  UNION ALL SELECT {DOC}, CAST(count(*) AS BIGINT), 'close' FROM n GROUP BY ALL""")
def _(spark, sf):
    return query_many(t.corpus(spark, sf), _BATCH, unique_key=True)


@query("search_batch_by_name", f"""WITH {t.BY_NAME}, {t.pairs('the', 'license', 5, 'n')},
  flags AS (SELECT filename, bool_or({_has('license')}) AS lic, bool_or({_has('of')}) AS of_,
    bool_or({_has('über')} OR {_has('nicht')}) AS either FROM corpus GROUP BY filename),
  a AS (SELECT *, CAST(len(regexp_extract_all(text, '(?i)über')) AS BIGINT) AS c1,
    CAST(len(regexp_extract_all(text, '(?i)nicht')) AS BIGINT) AS c2 FROM corpus),
  e AS (SELECT *, sum(c1 + c2) OVER (PARTITION BY filename) AS total,
    row_number() OVER (PARTITION BY filename ORDER BY c1 = 0, dataset, filepath) AS rn FROM a WHERE c1 + c2 > 0),
  near_n AS (SELECT {DOC}, count(*) AS c FROM n GROUP BY ALL),
  near_k AS (SELECT *, sum(c) OVER (PARTITION BY filename) AS total,
    row_number() OVER (PARTITION BY filename ORDER BY dataset, filepath) AS rn FROM near_n)
  SELECT {DOC}, CAST(total AS BIGINT) AS match_count, 'either' AS query_name FROM e JOIN flags USING (filename) WHERE rn = 1 AND NOT lic
  UNION ALL SELECT {DOC}, CAST(len(regexp_extract_all(text, '(?i)of')) AS BIGINT), 'both'
    FROM corpus JOIN flags USING (filename) WHERE {_has('of')} AND lic AND pages >= 3
  UNION ALL SELECT {DOC}, CAST(total AS BIGINT), 'close' FROM near_k WHERE rn = 1""")
def _(spark, sf):
    return query_many(t.corpus_by_name(spark, sf), _BATCH)


def saved_queries(n: int) -> dict[str, dict]:
    """Saved queries by rule: three-letter terms, alone in a data set, with a second term and without a third, or either of two."""
    terms = [a + b + c for c in "bdlmnrst" for b in "aeiou" for a in "bdlmnrst"]
    kinds = [lambda i, a, b: dict(all=[a], dataset=i % 12 + 1), lambda i, a, b: dict(all=[a, b], none=["license"], min_pages=2),
             lambda i, a, b: dict(any=[a, b], none=["the"])]
    return {f"q{i}": kinds[i % 3](i, terms[i % 320], terms[(i * 7 + i // 320 + 5) % 320]) for i in range(n)}


def _saved_sql(n: int, tables: str, key: str) -> str:
    """The saved queries as rows (name, kind, a, b); counts by the length that taking a term out costs."""
    rows = []
    for name, q in saved_queries(n).items():
        a, *b = q.get("all") or q["any"]
        kind = "either" if "any" in q else "both" if b else "one"
        rows.append(f"('{name}', '{kind}', '{a}', '{b[0] if b else a}', {q.get('dataset', 0)})")
    times = lambda term: f"CAST((length(low) - length(replace(low, {term}, ''))) // 3 AS BIGINT)"
    return f"""WITH {tables}, q(query_name, kind, a, b, wanted) AS (VALUES {', '.join(rows)}),
  c AS (SELECT {DOC}, lower(text) AS low, {key} AS k, bool_or({_has('license')}) OVER (PARTITION BY {key}) AS lic,
    bool_or({_has('the')}) OVER (PARTITION BY {key}) AS the FROM corpus),
  s AS (SELECT q.*, c.* EXCLUDE (low), {times('a')} AS na, {times('b')} AS nb FROM c JOIN q ON contains(low, a) OR contains(low, b)),
  f AS (SELECT *, max(nb) OVER (PARTITION BY query_name, k) > 0 AS has_b,
      row_number() OVER (PARTITION BY query_name, k ORDER BY na = 0, dataset, filename, filepath) AS rn,
      sum(na + nb) OVER (PARTITION BY query_name, k) AS total FROM s)
  SELECT query_name, {DOC}, na AS match_count FROM f WHERE kind = 'one' AND dataset = wanted AND na > 0
  UNION ALL SELECT query_name, {DOC}, na FROM f WHERE kind = 'both' AND na > 0 AND has_b AND NOT lic AND pages >= 2
  UNION ALL SELECT query_name, {DOC}, CAST(total AS BIGINT) FROM f WHERE kind = 'either' AND NOT the AND rn = 1"""


@query("search_saved", _saved_sql(300, t.CORPUS, "filepath"))
def _(spark, sf):
    return query_many(t.corpus(spark, sf), saved_queries(300), unique_key=True)


@query("search_saved_by_name", _saved_sql(60, t.BY_NAME, "filename"))
def _(spark, sf):
    return query_many(t.corpus_by_name(spark, sf), saved_queries(60))


# --- filters, orders, pages ------------------------------------------------------------------

_HITS = f"""WITH {t.CORPUS}, hits AS (SELECT {DOC},
    CAST(len(regexp_extract_all(text, '(?i)the')) AS INTEGER) AS match_count FROM corpus WHERE {_has('the')})"""


def _hits(spark, sf):
    return search.count_matches(t.corpus(spark, sf), "the")


@query("filter_dataset", f"{_HITS} SELECT * FROM hits WHERE dataset = 3")
def _(spark, sf):
    return ranking.filter_hits(_hits(spark, sf), dataset=3)


@query("filter_pages", f"{_HITS} SELECT * FROM hits WHERE pages >= 5 AND pages <= 20")
def _(spark, sf):
    return ranking.filter_hits(_hits(spark, sf), min_pages=5, max_pages=20)


@query("select_datasets", f"{_HITS} SELECT * FROM hits WHERE dataset IN (1, 5, 12)")
def _(spark, sf):
    return ranking.select_datasets(_hits(spark, sf), [1, 5, 12])


def _page_sql(order: str, page: int, n: int) -> str:
    return f"""{_HITS} SELECT *, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rank
      FROM (SELECT * FROM hits ORDER BY {order} LIMIT {n} OFFSET {(page - 1) * n})"""


_ORDERS = {"relevance": "match_count DESC, dataset, filename", "filename": "filename, dataset",
           "dataset": "dataset, filename"}

for _name, _order in _ORDERS.items():
    @query(f"sort_{_name}", f"{_HITS} SELECT *, row_number() OVER (ORDER BY {_order}) AS rank FROM hits")
    def _(spark, sf, sort=_name):
        return ranking.rank_hits(_hits(spark, sf), sort)


@query("page_hits", _page_sql(_ORDERS["relevance"], 3, 20))
def _(spark, sf):
    return ranking.rank_page(ranking.page_hits(_hits(spark, sf), 3, 20))


@query("hit_totals", f"""{_HITS} SELECT count(*) AS total,
  CAST(coalesce(sum(match_count), 0) AS BIGINT) AS total_matches FROM hits""")
def _(spark, sf):
    return ranking.hit_totals(_hits(spark, sf))


@query("cap_contexts", f"""WITH {t.CORPUS}, {t.spans('the', 'm')}
  SELECT filename, match_count, more, position, context FROM (
    SELECT filename, match_count, greatest(match_count - 3, 0) AS more, {t.context()}, i FROM m) WHERE i <= 3""")
def _(spark, sf):
    hits = ranking.cap_contexts(search.search(t.corpus(spark, sf), "the"), 3)
    return hits.select("filename", "match_count", "more", F.inline("contexts")).select(
        "filename", "match_count", "more", "position", "context")
