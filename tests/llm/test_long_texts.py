"""Every operator on texts of megabytes, whole, beside short ones: results are complete and take no quadratic time."""

import random

import pytest

from foliolens.llm import (decontaminate, language, nearcopies, packing, passages, pii, prefix_trie, quality, queries, secrets, simhash, sketch,
                           toxicity)

PICK = random.Random(1)
WORDS = [f"w{i}" for i in range(3000)]


def prose(n):
    return " ".join(PICK.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    item = prose(40)
    long = prose(200_000) + f" password=hunter22x a.b@c.de Mrs. Anna Lee {item} " + prose(60)
    texts = [long, long, "x" * 1_000_000, "é " * 400_000] + [prose(80) for _ in range(20)]
    rows = [(i, t, "en" if i % 2 else "de", "s", len(t), item) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, item string").repartition(2)


def graded(spark, docs):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(24)], "doc_id long, quality int, toxic int")


RUNS = {
    "secrets": (lambda s, d: secrets.secret_report(d), 24),
    "decontaminate": (lambda s, d: decontaminate.matches(d, d.limit(1).selectExpr("0L AS item_id", "item AS text")), 2),
    "simhash": (lambda s, d: simhash.near_duplicates(d), 24),
    "fingerprints": (lambda s, d: sketch.edited_pairs(d), 24),
    "language": (lambda s, d: language.predict(d, *language.prototypes(d)), 24),
    "packing": (lambda s, d: packing.pack_documents(d, **queries.tokenizer()).groupBy("doc_id").count(), 24),
    "personal data": (lambda s, d: pii.pseudonymise(d, "k"), 24),
    "toxicity": (lambda s, d: toxicity.score(d, toxicity.learn(d, graded(s, d))), 24),
    "passages": (lambda s, d: passages.repeated_passages(d), 2),
    "quality": (lambda s, d: quality.rate(d, quality.learn(d, graded(s, d))), 24),
    "near copies": (lambda s, d: nearcopies.keep_first(d), 23),
    "trie": (lambda s, d: prefix_trie.trie(d.selectExpr("doc_id AS conv_id", "0L AS turn", "'u' AS role", "text")).groupBy("depth").count(), 2),
}


@pytest.mark.parametrize("name", RUNS)
def test_long_texts(spark, docs, name):
    run, rows = RUNS[name]
    got = run(spark, docs).collect()
    assert len(got) == rows
    if name == "personal data":
        assert not any(secret in r["text"] for r in got for secret in ("a.b@c.de", "Anna Lee"))
