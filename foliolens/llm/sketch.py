"""Document fingerprints: a bottom-k sketch of shingle hashes, in DataFrame functions alone.

A sketch holds the ``k`` smallest distinct hashes of a text's word shingles, ascending.
Sketches of parts merge into the sketch of the whole. Two of them estimate resemblance and
containment, and one alone the number of distinct shingles.

Words are runs of anything but white space, case folded; fewer words than a shingle make one
shingle; no words make an empty sketch. Null texts count as empty. Two empty sketches
resemble each other by 1, an empty and a full one by 0. Repeated rows are documents of their
own; an empty table gives no rows; other columns are ignored. Ties cannot change a sketch, which is a set
of hashes; documents that repeat an id follow each other in order of their texts. A very long text is one
array of eight bytes a word in its row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliolens.llm.common import text_or_empty

K, SHINGLE = 128, 5


def folded(text: str) -> str:
    """SQL: lower case letter by letter. A capital sigma, the one letter whose lower form depends on its
    neighbours, always becomes the common form, so a part of a text folds as it does in the whole."""
    return f"lower(replace({text}, 'Σ', 'σ'))"


def word_hashes(text: str) -> str:
    """SQL: the hash of each word of the SQL expression ``text``."""
    return f"transform(filter(split({folded(text)}, '[\\\\s]+'), w -> w <> ''), w -> xxhash64(w))"


def shingle_hashes(words: str, shingle: int = SHINGLE) -> str:
    """SQL: the hashes of all shingles of an array of word hashes."""
    window = ", ".join(f"{words}[i + {j}]" if j else f"{words}[i]" for j in range(shingle))
    return (f"CASE WHEN size({words}) = 0 THEN array() WHEN size({words}) < {shingle} THEN array(xxhash64({words})) "
            f"ELSE transform(sequence(0, size({words}) - {shingle}), i -> xxhash64({window})) END")


def smallest(hashes: str, k: int = K) -> str:
    """SQL: the bottom-k sketch of an array of hashes; of sketches put together, it is their merge."""
    return f"slice(sort_array(array_distinct({hashes})), 1, {k})"


def resemblance(a: str, b: str, k: int = K, union: str | None = None) -> str:
    """SQL: the share of the union's sketch that both have. ``union`` names that sketch where
    a column already holds it."""
    union = union or smallest(f"concat({a}, {b})", k)
    return (f"CASE WHEN size({a}) = 0 AND size({b}) = 0 THEN 1D ELSE "
            f"size(array_intersect({union}, array_intersect({a}, {b}))) / CAST(size({union}) AS DOUBLE) END")


def distinct_shingles(a: str, k: int = K) -> str:
    """SQL: the estimated number of distinct shingles; exact below ``k``."""
    share = f"((CAST({a}[{k - 1}] AS DOUBLE) + 9223372036854775808D) / 18446744073709551616D)"
    return f"CASE WHEN size({a}) < {k} THEN CAST(size({a}) AS DOUBLE) ELSE {k - 1} / {share} END"


def containment(a: str, b: str, k: int = K) -> str:
    """SQL: the estimated share of a's shingles that b has."""
    r = resemblance(a, b, k)
    both = f"({r}) / (1 + ({r})) * (({distinct_shingles(a, k)}) + ({distinct_shingles(b, k)}))"
    return f"CASE WHEN size({a}) = 0 THEN 1D ELSE least(1D, {both} / ({distinct_shingles(a, k)})) END"


def spelled(sketch: str) -> str:
    """SQL: a sketch as text, base64 of its hashes."""
    return f"base64(unhex(array_join(transform({sketch}, h -> lpad(hex(h), 16, '0')), '')))"


def sketches(docs: DataFrame, k: int = K, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sketch, distinct_estimate)."""
    return (docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
            .select("doc_id", F.expr(word_hashes("text")).alias("words"))
            .select("doc_id", F.expr(shingle_hashes("words", shingle)).alias("hashes"))
            .select("doc_id", F.expr(smallest("hashes", k)).alias("sketch"))
            .withColumn("distinct_estimate", F.expr(distinct_shingles("sketch", k))))


def in_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """Adds ``range``: contiguous ranges of ascending ``doc_id``, null ids in the first. The
    bounds are quantiles, so no range holds much more than its share."""
    share = F.array(*(F.lit(i / ranges) for i in range(1, ranges)))
    bounds = docs.agg(F.percentile_approx("doc_id", share, 20 * ranges).alias("b")).first()["b"]
    edges = sorted(set(bounds or []))
    # Two steps of about the square root each find the range among many.
    step = max(1, round(len(edges) ** 0.5))
    groups = [edges[i:i + step] for i in range(0, len(edges), step)]
    listed = lambda numbers: "array(" + ", ".join(f"{n}L" for n in numbers) + ")"
    if not edges:
        return docs.withColumn("range", F.lit(0))
    coarse = f"coalesce(size(filter({listed(g[0] for g in groups)}, b -> b < doc_id)), 0)"
    return docs.withColumn("__g", F.expr(coarse)).withColumn("range", F.expr(
        f"CASE WHEN __g = 0 THEN 0 ELSE (__g - 1) * {step} + size(filter(array({', '.join(map(listed, groups))})[__g - 1], b -> b < doc_id)) END"
    )).drop("__g")


def with_followers(docs: DataFrame, ranges: int) -> DataFrame:
    """(range, guest, doc_id, text): every row once as itself, and the first row of each range
    again as the guest at the end of the range before (of the last, for the first), so that
    each row's follower by ascending id is in its range. The driver sees one id per range.
    """
    own = in_ranges(docs, ranges).withColumn("guest", F.lit(0))
    first = sorted((r["range"], r["first"]["doc_id"]) for r in
                   own.groupBy("range").agg(F.min(F.struct("doc_id")).alias("first")).collect())
    if not first:
        return own.select("range", "guest", "doc_id", "text")
    hosts = docs.sparkSession.createDataFrame(
        [(r, i, first[n - 1][0]) for n, (r, i) in enumerate(first)], "range int, first_id long, host int")
    guests = (own.join(F.broadcast(hosts), "range").where(F.col("doc_id").eqNullSafe(F.col("first_id")))
              .groupBy("host", "doc_id").agg(F.min("text").alias("text"))
              .select(F.col("host").alias("range"), F.lit(1).alias("guest"), "doc_id", "text"))
    return own.select("range", "guest", "doc_id", "text").unionByName(guests)


def edited_pairs(docs: DataFrame, k: int = K, shingle: int = SHINGLE, ranges: int | None = None,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document with the sketches of itself, of its edited text and of the next document.

    The edited text has the last quarter of the code points replaced by as many of the next
    document's first (or all). Shingles of words that end before the cut are hashed once for
    both: the edited sketch is the merge of theirs with that of the changed end. Texts go
    through one shuffle, into ranges of ids.
    """
    ranges = ranges or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = with_followers(base, ranges)
    order = Window.partitionBy("range").orderBy("guest", "doc_id", "text")
    cut = (rows.withColumn("next", F.coalesce(F.lead("text").over(order), F.lit("")))
           .withColumn("n", F.char_length("text").cast("long"))
           .withColumn("prefix", F.expr("substring(text, 1, CAST(n - floor(n / 4) AS INT))"))
           .withColumn("head", F.expr("substring(next, 1, CAST(floor(n / 4) AS INT))"))
           .withColumn("before", F.expr(f"split({folded('prefix')}, '[\\\\s]+')"))
           .withColumn("words", F.expr(word_hashes("text"))))
    # The last piece before the cut may go on in the new end, so it belongs to that.
    ends = (cut.withColumn("whole", F.expr("size(before) - 1 - CAST(before[0] = '' AND size(before) > 1 AS INT)"))
            .withColumn("end", F.expr(word_hashes("concat(element_at(before, -1), head)")))
            .withColumn("end", F.expr(f"concat(slice(words, greatest(1, whole - {shingle - 2}), least(whole, {shingle - 1})), end)"))
            .withColumn("sha", F.sha2(F.concat("prefix", "head").cast("binary"), 256))
            .select("range", "guest", "doc_id", "text", "n", "whole", "words", "end", "sha"))
    hashed = ends.withColumn("hashes", F.expr(shingle_hashes("words", shingle)))
    # With fewer whole words than a shingle, the end holds them all.
    sketched = (hashed.withColumn("changed", F.expr(shingle_hashes("end", shingle)))
                .withColumn("kept", F.expr(f"slice(hashes, 1, greatest(0, whole - {shingle - 1}))"))
                .select("range", "guest", "doc_id", "text", "n", "sha", F.expr(smallest("hashes", k)).alias("sketch"),
                        F.expr(smallest("concat(kept, changed)", k)).alias("edited")))
    paired = sketched.withColumn("follower", F.lead("sketch").over(order)).where("guest = 0")
    return (paired.withColumn("u1", F.expr(smallest("concat(sketch, edited)", k)))
            .withColumn("u2", F.expr(smallest("concat(sketch, follower)", k)))
            .select("doc_id", F.col("n").alias("n_chars"), F.col("sha").alias("edited_sha256"),
                    F.expr(spelled("sketch")).alias("fingerprint"), F.expr(spelled("edited")).alias("edited_fingerprint"),
                    F.expr(resemblance("sketch", "edited", k, "u1")).alias("near_edited"),
                    F.expr(resemblance("sketch", "follower", k, "u2")).alias("near_next"),
                    F.expr(distinct_shingles("sketch", k)).alias("distinct_estimate")))
