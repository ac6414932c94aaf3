"""Operators without SQL against plain restatements of their rules."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from foliolens.llm import language, quality, secrets, toxicity

WORDS = ["password", "PASSWD", "secret", "Token", "api_key", "APIKEY", "api-key", "key", "x"]
HEX, VALUE = "0123456789abcdef", set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


def plain_base(text):
    """The base spans, character by character."""
    spans, at = [], 0
    keys = ["password", "passwd", "secret", "token", "api_key", "apikey"]
    lowered = "".join(c.lower() if c.isascii() else c for c in text)
    while at < len(text):
        key = next((k for k in keys if lowered.startswith(k, at)), None)
        end = None
        if key:
            i = at + len(key)
            for quote in ((1, 0) if i < len(text) and text[i] in "\"'" else (0,)):
                j = i + quote
                while j < len(text) and text[j] == " ":
                    j += 1
                if j < len(text) and text[j] in ":=":
                    j += 1
                    while j < len(text) and text[j] == " ":
                        j += 1
                    j += j < len(text) and text[j] in "\"'"
                    k = j
                    while k < len(text) and text[k] in VALUE:
                        k += 1
                    if k > j:
                        end = k, k - j
                        break
                    # the value may begin with the equals sign that was taken for the separator's blank end
        if end:
            if end[1] >= 6:
                spans.append(("assign", at, end[0]))
            at = end[0]
        else:
            at += 1
    for kind, start, alphabet, least in (("access", "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20), ("hex", "", HEX, 24)):
        at = 0
        while at < len(text):
            end = at
            if text.startswith(start, at):
                end = at + len(start)
                while end < len(text) and text[end] in alphabet:
                    end += 1
            if end > at + len(start):
                if end - at >= least:
                    spans.append((kind, at, end))
                at = end
            else:
                at += 1
    return sorted(spans, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_secrets_equal_a_plain_scanner(spark):
    pick = random.Random(2)
    texts = []
    for _ in range(600):
        parts = []
        for _ in range(pick.randrange(1, 9)):
            kind = pick.randrange(5)
            if kind == 0:
                parts.append(pick.choice(WORDS) + pick.choice(["", '"', "'", " "]) + pick.choice([":", "=", " = ", ": ", "==", ""])
                             + pick.choice(["", '"', "'"]) + "".join(pick.choice("aZ9+/_.-é") for _ in range(pick.choice([3, 5, 6, 7, 12]))))
            elif kind == 1:
                parts.append("AKIA" + "".join(pick.choice("AK9I") for _ in range(pick.choice([0, 14, 15, 16, 17, 30]))))
            elif kind == 2:
                parts.append("".join(pick.choice(HEX) for _ in range(pick.choice([5, 22, 23, 24, 25, 60]))))
            else:
                parts.append(pick.choice(["ſecret=abcdefgh", "é ", "\n", "tokentoken:", "K", "AAKIA", "="]))
        texts.append(pick.choice(["", " "]).join(parts))
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for r in secrets.secret_report(docs).collect():
        want = plain_base(texts[r["doc_id"]])
        spelled = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(spelled.encode()).hexdigest(), texts[r["doc_id"]]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == kind for k, _, _ in want) for kind in secrets.BASE]


def test_profiles_equal_plain_sums():
    """Letter vectors, permuted by their place in the n-gram, bound by products and bundled by sums."""
    texts = ["Abc, déf!", "ß ÄÖ 12 x", "", "....", "a", "the then other"]
    got, lettered = language.Profiler()(texts)
    for text, vector, has in zip(texts, got, lettered):
        letters = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
        while "  " in letters:
            letters = letters.replace("  ", " ")
        total = np.zeros(language.DIMENSIONS)
        for i in range(len(letters) - language.GRAM + 1):
            bound = np.ones(language.DIMENSIONS)
            for j, c in enumerate(letters[i:i + language.GRAM]):
                own = np.random.default_rng([7, ord(c)]).integers(0, 2, language.DIMENSIONS) * 2 - 1
                bound *= np.roll(own, language.GRAM - 1 - j)
            total += bound
        assert has == any(c.isalpha() for c in text)
        assert np.allclose(vector, total / max(np.linalg.norm(total), 1e-9), atol=1e-5)


def test_ftrl_equals_a_scalar_one():
    pick = random.Random(5)
    rows = [(np.array(sorted(pick.sample(range(30), pick.randrange(9))), np.int64), pick.randrange(2)) for _ in range(120)]
    alpha, beta, l1, l2, epochs = 0.5, 1.0, 0.8, 0.3, 3
    z, n = [0.0] * 31, [0.0] * 31

    def weight(i):
        hold = 0 if i == 30 else l1
        return 0.0 if abs(z[i]) <= hold else -(z[i] - math.copysign(hold, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for features, label in rows:
            at = [*features.tolist(), 30]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i in at:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    got = toxicity.ftrl(rows, 30, alpha, beta, l1, l2, epochs)
    assert np.allclose(got, [weight(i) for i in range(31)]) and 0 < (got == 0).sum() < 31


def test_skip_grams_are_features():
    make = toxicity.Featurer()
    ids = lambda t: set(make(t).tolist())
    assert ids("one two three") - ids("one two") - ids("two three") - ids("three")  # the pair around a word
    assert zlib.crc32(b"one") and ids("ONE two") == ids("one TWO") and not ids("")


@pytest.mark.parametrize("n_grades", [2, 3, 5])
def test_ordinal_fit_is_a_minimum_of_the_plain_likelihood(n_grades):
    """At the end no small step of any weight or threshold betters the penalised likelihood by much."""
    pick = np.random.default_rng(n_grades)
    docs, dimensions, l2 = 200, 6, 1e-2
    x = pick.standard_normal((docs, dimensions))
    latent = x @ pick.standard_normal(dimensions) + pick.logistic(size=docs)
    grade = np.searchsorted(np.quantile(latent, np.arange(1, n_grades) / n_grades), latent)
    w, cut = quality.cumulative_link(np.tile(np.arange(dimensions), docs), x.ravel(), np.repeat(np.arange(docs), dimensions), grade,
                                     n_grades, dimensions, l2, 1500, 0.02)

    def loss(w, cut):
        total = 0.0
        for row, g in zip(x, grade):
            upto = lambda k: 1.0 if k == n_grades - 1 else 0.0 if k < 0 else 1 / (1 + math.exp(-(cut[k] - float(row @ w))))
            total -= math.log(max(upto(g) - upto(g - 1), 1e-12))
        return total / docs + l2 / 2 * float(w @ w)

    assert list(cut) == sorted(cut) and len(cut) == n_grades - 1
    least = loss(w, cut)
    for i in range(dimensions):
        for step in (-0.05, 0.05):
            moved = w.copy()
            moved[i] += step
            assert loss(moved, cut) > least - 1e-5
    for i in range(n_grades - 1):
        for step in (-0.05, 0.05):
            moved = np.array(cut, float)
            moved[i] += step
            assert loss(w, moved) > least - 1e-5
