"""Secrets in texts, and how widely each is copied over a corpus.

Spans are found in the whole text: the base kinds (``assign``, ``access``, ``hex``) and
further ones (``jwt``, ``pem``, ``vendor``). Then every candidate is hashed and counted by
distinct repositories and owners over all documents, with repeats inside one owner merged
before the shuffle. A candidate of several owners is a widely copied example; one that a
single owner has and that looks random is a live-looking credential.

Null texts count as empty; a null repository or owner counts as one more value; repeated
rows give a row each; an empty table gives no rows; other columns are ignored. Spans that begin together stand in the
order of their kinds; equal secrets of one document count once in its verdict. Texts of any length are searched whole, one
at a time in a task.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import map_texts, stored

BASE = ("assign", "access", "hex")
# Fixed values of the result's definition; the runs of `access` and `hex` are maximal, so their
# least length can stand in the pattern, while `assign` drops short values after matching.
ASSIGN = (r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
FURTHER = {
    "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}",
    "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}",
    "vendor": r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{20,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})",
}
KINDS = (*BASE, *FURTHER)


def finder():
    """A function from a text to (kind, start, end, secret), ordered by start and kind."""
    assign = re.compile(ASSIGN[0], re.IGNORECASE | re.ASCII).finditer
    access, hexes = re.compile(ACCESS).finditer, re.compile(HEX).finditer
    further = {k: re.compile(p, re.ASCII).finditer for k, p in FURTHER.items()}

    def find(text: str):
        found = []
        if ":" in text or "=" in text:
            found += [("assign", m.start(), m.end(), m[2]) for m in assign(text) if len(m[2]) >= ASSIGN[1]]
        if "AKIA" in text:
            found += [("access", m.start(), m.end(), m[0]) for m in access(text)]
        found += [("hex", m.start(), m.end(), m[0]) for m in hexes(text)]
        if "eyJ" in text or "PRIVATE KEY" in text or "_" in text or "-" in text or "AIza" in text:
            for kind, finds in further.items():
                found += [(kind, m.start(), m.end(), m[0]) for m in finds(text)]
        return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))
    return find


def entropy(value: str) -> float:
    """Bits per character."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def spelled(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end, _ in spans)


SPANS = "struct<kind:string,start:int,end:int,secret_hash:string,entropy:double>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository: str = "source",
         owner: str = "source") -> DataFrame:
    """A row per row of ``docs``: counts of the base kinds, the digest of the base spans, all
    spans as text and as ``found`` (kind, start, end, hash and entropy of the secret)."""
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                      ("secret_hash", pa.string()), ("entropy", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("repository", pa.string()), ("owner", pa.string()),
                        ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
                        ("base_sha256", pa.string()), ("spans", pa.string()), ("found", pa.list_(item))])

    def make(batches):
        find = finder()
        for batch in batches:
            rows = []
            for doc, text, repo, own in zip(*(batch.column(i).to_pylist() for i in range(4))):
                spans = find(text or "")
                base = [s for s in spans if s[0] in BASE]
                kinds = Counter(s[0] for s in base)
                rows.append((doc, repo, own, *(kinds[k] for k in BASE),
                             hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(spans),
                             [{"kind": k, "start": a, "end": b, "entropy": entropy(s),
                               "secret_hash": hashlib.sha256(s.encode("utf-8", "replace")).hexdigest()[:32]}
                              for k, a, b, s in spans]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 9, schema)], schema=schema)
    inputs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                         F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"))
    return map_texts(inputs, ["doc_id", "text", "repository", "owner"], make,
                     "doc_id long, repository string, owner string, n_assign long, n_access long, n_hex long, "
                     f"base_sha256 string, spans string, found array<{SPANS}>")


def ownership(found: DataFrame, shared_owners: int = 2, live_entropy: float = 3.0) -> DataFrame:
    """Per candidate hash: documents, distinct repositories, distinct owners and a verdict.

    Rows of one (hash, repository, owner) are added up before the shuffle, so a hash that a
    third of the documents carry arrives as a row per repository and task.
    """
    hits = (found.select("repository", "owner", F.explode("found").alias("f"))
            .select("repository", "owner", "f.secret_hash", "f.entropy"))
    pairs = hits.groupBy("secret_hash", "repository", "owner").agg(
        F.count("*").alias("uses"), F.max("entropy").alias("entropy"))
    null_safe = lambda c: F.struct(F.col(c))  # noqa: E731  a null value counts as one more
    return (pairs.groupBy("secret_hash")
            .agg(F.sum("uses").alias("uses"), F.max("entropy").alias("entropy"),
                 F.count_distinct(null_safe("repository")).alias("repositories"),
                 F.count_distinct(null_safe("owner")).alias("owners"))
            .withColumn("verdict", F.when(F.col("owners") >= shared_owners, "example")
                        .when(F.col("entropy") >= live_entropy, "live").otherwise("plain")))


def classify(found: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``found`` with the number of its candidates that are examples, live-looking, or plain.

    ``found`` needs a column ``row`` that tells its rows apart. Only (row, hash) goes
    through the join; documents without candidates skip it.
    """
    hits = (found.where(F.size("found") > 0)
            .select("row", F.explode(F.array_distinct(F.transform("found", lambda f: f["secret_hash"]))).alias("secret_hash"))
            .join(verdicts.select("secret_hash", "verdict", "owners"), "secret_hash")
            .groupBy("row").agg(*(F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("example", "live", "plain")),
                                F.max("owners").alias("most_owners")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return (found.join(hits, "row", "left")
            .select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans",
                    zero("n_example"), zero("n_live"), zero("n_plain"), zero("most_owners")))


def secret_report(docs: DataFrame, shared_owners: int = 2, live_entropy: float = 3.0, **columns) -> DataFrame:
    """The whole operator: scan once, count over the corpus, judge each document's candidates."""
    found = stored(scan(docs, **columns).withColumn("row", F.monotonically_increasing_id()))
    return classify(found, ownership(found, shared_owners, live_entropy))
