"""The operators on hand-made rows, against brute force: nulls, empty and long texts, ties,
repeated rows, empty tables and extra columns."""

import hashlib
import random
import re
import zlib
from array import array

import numpy as np
import pytest
import xxhash

from foliolens.llm import (decontaminate, language, nearcopies, packing, passages, pii, quality, queries, secrets, simhash,
                           sketch, toxicity)
from foliolens.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, fp string, rank long"


def frame(spark, texts, langs=None, sources=None):
    rows = [(i, t, langs[i] if langs else "en", sources[i] if sources else f"src{i % 3}", len(t or ""), "k", "f", 1)
            for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed, n, words=("alpha", "beta", "gamma", "delta", "eta", "theta", "iota", "kappa", "lamda", "mu")):
    pick = random.Random(seed)
    return " ".join(pick.choice(words) + str(pick.randrange(50)) for _ in range(n))


ODD = [None, "", " ", "\n\t", "x", "ÄÖ ß", "a " * 30_000, prose(1, 40), prose(1, 40)]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_secrets(spark, odd, empty):
    texts = ["password = hunter22 and token:'abc'", "TOKEN=token : abcdefgh", "AKIA" + "A" * 16, "key " + "0f" * 12, None, "",
             'api_key="' + "0123456789abcdef" * 2 + '"', 'apikey: "' + "0123456789abcdef" * 2 + '"', "ſecret=abcdefgh"]
    rows = {r["doc_id"]: r for r in secrets.secret_report(frame(spark, texts)).collect()}
    assert rows[0]["spans"] == "assign:0:19" and rows[0]["n_assign"] == 1
    assert rows[1]["spans"] == ""  # the short value takes the text that a later match would need
    assert rows[2]["spans"] == "access:0:20" and rows[3]["spans"] == "hex:4:28"
    assert rows[4]["base_sha256"] == hashlib.sha256(b"").hexdigest() and rows[8]["spans"] == ""
    assert rows[6]["n_example"] == rows[7]["n_example"] == 1 and rows[6]["most_owners"] == 2
    assert rows[3]["n_plain"] == 1 and rows[0]["n_live"] + rows[0]["n_plain"] == 1
    assert secrets.secret_report(odd).count() == len(ODD) and secrets.secret_report(empty).count() == 0


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, empty):
    base = prose(5, 300)
    texts = ODD + [base, base.upper(), base.replace("alpha1 ", "beta2 ", 1), base + " end", prose(6, 200)] + [
        base.replace(w, "other", 1) for w in dict.fromkeys(base.split()[:40])]
    found = {r["doc_id"]: r for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(prints):
            for k, b in enumerate(prints):
                if (a ^ b).bit_count() <= 3:
                    root[i] = root[k] = min(root[i], root[k])
    assert [found[i]["fp"] % 2**64 for i in range(len(texts))] == prints
    assert [found[i]["component_id"] for i in range(len(texts))] == root
    kept = simhash.keep_first(frame(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root)) and kept.columns == frame(spark, texts).columns
    assert simhash.near_duplicates(empty).count() == 0


def test_keep_first_goes_by_row(spark):
    a, b, c = prose(5, 100), prose(6, 100), prose(7, 100)
    rows = [(1, a, 0), (1, a, 1), (2, a, 2), (2, b, 3), (None, b, 4), (None, c, 5), (None, c, 6), (3, None, 7), (4, "", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `Row` long")
    kept = simhash.keep_first(docs)
    found = kept.collect()
    assert kept.columns == docs.columns
    assert {(r["doc_id"], r["text"]) for r in found} == {(1, a), (2, b), (None, c), (3, None)} and len(found) == 4
    assert simhash.keep_first(docs.where("false")).count() == 0


def resemblance(a, b, n=5):
    grams = [(lambda w: {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())((t or "").lower().split()) for t in (a, b)]
    return len(grams[0] & grams[1]) / len(grams[0] | grams[1]) if grams[0] | grams[1] else 1.0


def edited(text, places):
    words = text.split()
    for p in places:
        words[p] = f"changed{p}"
    return " ".join(words)


@pytest.mark.parametrize("chunk", [4_000, 4])
def test_near_copies(spark, empty, chunk):
    """Row by row what all pairs of resemblance >= 0.8 connect, also where a group's first text
    resembles none of the others; texts that merely link by few bits stay."""
    base, lead = prose(5, 200), prose(6, 400)
    texts = ODD + [base, edited(base, [50]), edited(base, [20, 90]), edited(base, [10, 60, 120]), base.upper(), edited(base, range(5, 200, 25)),
                   edited(base, [30, 70, 110, 150]), edited(edited(base, [30, 70, 110, 150]), [5, 50, 90, 130]), prose(7, 200), "one two three", "one two four"]
    for i in range(12):  # one long common part, own beginnings: in groups together without being copies
        own = lead + " " + prose(800 + i, 300)
        texts += [own, edited(own, [450, 600])]
    root, alike = list(range(len(texts))), [(i, k) for i, a in enumerate(texts) for k in range(i) if resemblance(a, texts[k]) >= 0.8]
    for _ in texts:
        for i, k in alike:
            root[i] = root[k] = min(root[i], root[k])
    kept = nearcopies.keep_first(frame(spark, texts), chunk=chunk)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root)) and len(set(root)) < len(texts) - 18
    assert kept.columns == empty.columns and nearcopies.keep_first(empty).count() == 0


@pytest.mark.parametrize("with_base", [True, False])
def test_near_copies_of_one_text_that_are_no_copies_of_each_other(spark, with_base):
    """They belong together by way of the text that they were made from, wherever it stands, and not without it."""
    pick = random.Random(12)
    base = prose(5, 220)
    copies = [edited(base, pick.sample(range(5, 215), 4)) for _ in range(40)]
    copies = [" ".join(w + str(i) if w.startswith("changed") else w for w in c.split()) for i, c in enumerate(copies)]
    assert all(resemblance(base, c) >= 0.8 for c in copies)
    texts = copies[:33] + [base] * with_base + copies[33:]
    pairs = [(i, k) for i in range(len(texts)) for k in range(i) if resemblance(texts[i], texts[k]) >= 0.8]
    root = list(range(len(texts)))
    for _ in texts:
        for i, k in pairs:
            root[i] = root[k] = min(root[i], root[k])
    kept = sorted(r["doc_id"] for r in nearcopies.keep_first(frame(spark, texts)).collect())
    assert kept == sorted(set(root)) and (kept == [0]) == with_base


def test_near_copies_go_by_row(spark):
    a, b, c = prose(5, 100), prose(6, 100), prose(7, 100)
    rows = [(1, a, 0), (1, a, 1), (2, edited(a, [50]), 2), (2, b, 3), (None, b, 4), (None, c, 5), (None, c, 6), (3, None, 7), (4, "", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `Row` long")
    kept = nearcopies.keep_first(docs)
    found = kept.collect()
    assert kept.columns == docs.columns
    assert {(r["doc_id"], r["text"]) for r in found} == {(1, a), (2, b), (None, c), (3, None)} and len(found) == 4


def test_pipeline_drops_near_copies(spark):
    import corpus_pipeline

    base = prose(5, 200)
    texts = [base, edited(base, [40, 80, 120, 160]), prose(6, 200)]
    assert resemblance(*texts[:2]) >= 0.8 and (plain_fingerprint(texts[0]) ^ plain_fingerprint(texts[1])).bit_count() > 3
    docs = corpus_pipeline.without_near_copies(spark, frame(spark, texts), "")
    assert sorted(r["doc_id"] for r in docs.collect()) == [0, 2]


def test_links_of_a_bucket_in_shares(spark):
    """Cut into shares, a bucket still connects what all pairs connect."""
    pick = random.Random(3)
    prints = list({pick.getrandbits(8) << 1 | (7 << 40) for _ in range(120)})
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    edges = simhash.links(df, chunk=16)
    assert all((r["a"] ^ r["b"]).bit_count() <= 3 for r in edges.collect())
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert set(got.values()) == {min(prints)} and len(got) == len(prints)


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 102), (101, 102), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_stars_take_no_round(spark, monkeypatch):
    from foliolens.llm import components as module
    from foliolens.llm import nearcopies

    written = []
    kept = module.stored
    monkeypatch.setattr(module, "stored", lambda df: written.append(1) or kept(df))
    star = spark.createDataFrame([(1, 5), (7, 1), (9, 2), (1, 5), (3, 3)], "a long, b long")
    found = module.components(star)
    assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 2), (5, 1), (7, 1), (9, 2)] and len(written) == 1
    assert nearcopies.joined(found, spark.createDataFrame([], "a long, b long")) is found
    more = nearcopies.joined(found, spark.createDataFrame([(9, 7), (12, 11)], "a long, b long"))
    assert sorted(map(tuple, more.collect())) == [(1, 1), (2, 1), (5, 1), (7, 1), (9, 1), (11, 11), (12, 11)]
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(40, 41)], "a long, b long")
    assert {tuple(r) for r in module.components(chain).collect()} == {(i, 0) for i in range(21)} | {(40, 40), (41, 40)}


def test_sketch(spark, empty):
    texts = ODD + [prose(7, 2000), prose(8, 30), " lead " + prose(9, 50) + " ", prose(9, 60), "one two three"]
    docs = frame(spark, texts)
    rows = {r["doc_id"]: r for r in sketch.edited_pairs(docs, ranges=4).collect()}
    edited = []
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
        edited.append(t[:len(t) - len(t) // 4] + nxt[:len(t) // 4])
        assert rows[i]["n_chars"] == len(t) and rows[i]["edited_sha256"] == hashlib.sha256(edited[-1].encode()).hexdigest()
        assert 0 <= rows[i]["near_edited"] <= 1 and 0 <= rows[i]["near_next"] <= 1
    direct = {r["doc_id"]: r["f"] for r in sketch.sketches(frame(spark, edited)).selectExpr("doc_id", f"{sketch.spelled('sketch')} AS f").collect()}
    assert {i: r["edited_fingerprint"] for i, r in rows.items()} == direct
    assert rows[7]["fingerprint"] == rows[8]["fingerprint"] and rows[7]["near_next"] == 1 and rows[0]["near_next"] == 1
    grams = {tuple(texts[9].split()[i:i + 5]) for i in range(1996)}
    other = {tuple(edited[9].split()[i:i + 5]) for i in range(len(edited[9].split()) - 4)}
    assert abs(rows[9]["near_edited"] - len(grams & other) / len(grams | other)) < 0.15
    assert abs(rows[9]["distinct_estimate"] / len(grams) - 1) < 0.3
    assert sketch.edited_pairs(empty).count() == 0 and sketch.edited_pairs(docs.limit(1)).count() == 1


def test_sketches_merge(spark):
    df = spark.createDataFrame([(list(range(0, 500, 2)), list(range(0, 500, 3)))], "a array<long>, b array<long>").selectExpr(
        f"{sketch.smallest('a')} AS a", f"{sketch.smallest('b')} AS b", f"{sketch.smallest('concat(a, b)')} AS whole")
    r = df.selectExpr(f"{sketch.smallest('concat(a, b)')} = whole AS same", f"{sketch.containment('a', 'a')} AS own").first()
    assert r["same"] and r["own"] == 1


def test_language(spark, odd, empty):
    texts = [prose(i, 60, ("the", "then", "there")) for i in range(20)] + [prose(i, 60, ("des", "dieu", "aux")) for i in range(20)] + ODD
    docs = frame(spark, texts, ["en"] * 20 + ["fr"] * 20 + [None] * len(ODD))
    langs, matrix = language.prototypes(docs)
    got = {r["doc_id"]: r for r in language.predict(docs, langs, matrix).collect()}
    assert [got[i]["lang_pred"] for i in range(40)] == ["en"] * 20 + ["fr"] * 20
    assert [got[40 + i]["lang_pred"] for i in range(4)] == ["und"] * 4 and all(0 <= r["score"] <= 1 for r in got.values())
    none, nothing = language.prototypes(empty)
    assert none == [] and {r["lang_pred"] for r in language.predict(odd, none, nothing).collect()} == {"und"}
    assert language.predict(empty, langs, matrix).count() == 0


def test_packing(spark, odd, empty):
    where = queries.tokenizer()
    texts = ODD + ["<|endoftext|> 'tis\r\n  ok\t\t x's", "日本語 text", "a" * 3000, " " * 700 + "x", prose(2, 4000)] + [prose(i, i) for i in range(1, 60)]
    rows = packing.pack_documents(frame(spark, texts), **where).collect()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(where["json_path"])  # not by way of the operator
    encode = lambda t: plain.encode(t, add_special_tokens=False).ids
    assert encode("<|endoftext|>") == [50256]
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = [*encode(t or ""), 0]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            part = array("I", ids[at:at + r["length"]]).tobytes()
            assert (r["start"], r["ids_crc32"], r["doc_tokens"]) == (at, zlib.crc32(part), len(ids))
            at += r["length"]
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert packing.pack_documents(empty, **where).count() == 0


def test_shortest_pack_first():
    assert sorted(packing.shortest_pack_first({100: 25}, 1024)) == [([100] * 5, 1), ([100] * 10, 2)]
    pick = random.Random(1)
    counts = {n: pick.randrange(40) for n in range(1, 1025)}
    patterns = packing.shortest_pack_first(counts, 1024)
    used = {}
    for lengths, n in patterns:
        assert sum(lengths) <= 1024 and n > 0
        for length in lengths:
            used[length] = used.get(length, 0) + n
    assert used == {k: v for k, v in counts.items() if v}
    total = sum(k * v for k, v in counts.items())
    assert total / (1024 * sum(n for _, n in patterns)) > 0.95


def test_pii(spark, odd, empty):
    texts = ["Mail ann.lee@corp.example.com or ANN.LEE@corp.example.com, bob@corp.example.com.", "Call +1 (212) 555-0100 or (212) 555-0101.",
             "IP 10.0.0.1, 10.0.0.2, 10.0.0.1; version 1.2.3", "Card 4539 1488 0343 6467 and 4539148803436467.", "ssn 078-05-1120",
             "Mrs. Jane Roe met Mr. John Roe and Herr MÜLLER. Госпожа", "IBAN DE89 3704 0044 0532 0130 00", "no data in here", None, ""]
    docs = frame(spark, texts)
    out = {r["doc_id"]: r for r in pii.pseudonymise(docs, "k1").collect()}
    new = [out[i]["text"] for i in range(len(texts))]
    assert new[7:] == ["no data in here", None, ""] and [out[i]["n_entities"] for i in (7, 8, 9)] == [0, 0, 0]
    mails = re.findall(r"\S+@\S+?example", new[0])
    assert mails[0] == mails[1] != mails[2] and len({m.split("@")[1] for m in mails}) == 1 and "corp" not in new[0]
    assert re.fullmatch(r"Call \+1 \(\d{3}\) \d{3}-\d{4} or \(\d{3}\) \d{3}-\d{4}\.", new[1]) and "555-0100" not in new[1]
    a, b, c = re.findall(r"\d+\.\d+\.\d+\.\d+", new[2])
    assert a == c != b and "1.2.3" in new[2] and all(0 <= int(o) < 256 for o in (a + "." + b).split("."))
    spaced, joined = re.fullmatch(r"Card ([\d ]+) and (\d+)\.", new[3]).groups()
    assert spaced.replace(" ", "") == joined != "4539148803436467"
    digits = [int(d) for d in joined]
    assert (sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])) % 10 == 0
    assert re.fullmatch(r"ssn \d{3}-\d{2}-\d{4}", new[4]) and new[4] != texts[4]
    names = re.fullmatch(r"Mrs\. (\w+ia) (\w+) met Mr\. (\w+or) (\w+) and Herr ([A-Z]+)\. Госпожа", new[5])
    assert names and names[2] == names[4] and "Roe" not in new[5]
    assert re.fullmatch(r"IBAN DE\d\d( \d{4}){4} \d\d", new[6]) and all(out[i]["n_chars"] == len(new[i]) for i in range(8))
    assert pii.pseudonymise(docs, "k2").where("doc_id = 4").first()["text"] != new[4]
    assert pii.pseudonymise(odd, "k").count() == len(ODD) and pii.pseudonymise(empty, "k").count() == 0


FORMS = ["+15551234567", "+33612345678", "+49 30 1234567", "+49 30123456", "+4915112345678", "555 123 4567", "3782 822463 10005",
         "2001:db8::8a2e:370:7334", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "jürgen.größe@münchen.example.de", "GB82 WEST 1234 5698 7654 32",
         "+1 (212) 555-0100", "10.11.12.13", "078-05-1120", "DE89370400440532013000"]


def account_remainder(account):
    turned = re.sub(r"\W", "", account)
    return int("".join(str(int(c, 36)) for c in turned[4:] + turned[:4])) % 97


@pytest.mark.parametrize("key", ["k1", "k2"])
def test_pii_forms(spark, key):
    """No form stays in clear, a surrogate keeps its form, the same value has the same one, others have others."""
    docs = frame(spark, [f"see {f} and, again, {f}." for f in FORMS])
    out = {r["doc_id"]: r for r in pii.pseudonymise(docs, key).collect()}
    shown = []
    for i, form in enumerate(FORMS):
        one, other = re.fullmatch(r"see (.*) and, again, (.*)\.", out[i]["text"]).groups()
        assert one == other != form and out[i]["n_entities"] == 2, form
        shape = r"[0-9]+" if form.count(".") == 3 else r"[0-9A-Za-z]"  # octets have no fixed length
        assert "@" in form or re.sub(shape, "x", one) == re.sub(shape, "x", form), form
        shown.append(one)
    assert len(set(shown)) == len(FORMS) and not set(shown) & set(FORMS)
    assert account_remainder(shown[10]) == account_remainder(shown[14]) == 1 and shown[14].startswith("DE")
    clean = ["at 12:30:45, 1:2:3 and a::b", "1 + 2 = 3; +5 C", "pages 100 200 300", "C++ 11", "v1.2.3.4.5", "ratio 16:9, std::vector<int>"]
    assert [r["text"] for r in pii.pseudonymise(frame(spark, clean), key).orderBy("doc_id").collect()] == clean


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(i, prose(i, 30), "kept", 0.5, "f") for i in range(40)], "doc_id long, text string, keep string, expected_grade double, __found string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    got = quality.select_documents(docs, quality.learn(docs, labels))
    assert got.schema == docs.schema and {(r["keep"], r["expected_grade"]) for r in got.collect()} == {("kept", 0.5)}
    assert {r["__found"] for r in pii.pseudonymise(docs, "k").collect()} == {"f"}


def test_equal_texts_have_equal_fingerprints(spark):
    """Edited texts put together from parts are fingerprinted as if they had always been whole."""
    pick = random.Random(8)
    texts = ["bcd ΔΣzz", "Αq …", "bcd ΔΣΑq"] + ["".join(pick.choice("ΣσςΑa İi.ßẞ\n ") for _ in range(pick.randrange(40))) for _ in range(60)]
    rows = sketch.edited_pairs(frame(spark, texts)).orderBy("doc_id").collect()
    cut = [len(t) - len(t) // 4 for t in texts]
    edited = [t[:c] + texts[(i + 1) % len(texts)][:len(t) - c] for i, (t, c) in enumerate(zip(texts, cut))]
    assert [r["edited_sha256"] for r in rows] == [hashlib.sha256(t.encode()).hexdigest() for t in edited]
    alone = sketch.edited_pairs(frame(spark, edited)).orderBy("doc_id").collect()
    assert [r["edited_fingerprint"] for r in rows] == [r["fingerprint"] for r in alone]


def test_pii_permutes(spark):
    """The permutation of digit strings is one to one."""
    df = spark.range(1000).selectExpr("lpad(CAST(id AS STRING), 3, '0') AS d").selectExpr(f"{pii.permuted('k', 'digits', 'd')} AS p")
    assert df.distinct().count() == 1000 and {len(r["p"]) for r in df.collect()} == {3}


def test_toxicity(spark, odd, empty):
    texts = [prose(i, 40) + (" vile" if i % 4 == 0 else "") for i in range(240)] + ODD
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0), "x") for i in range(240)] + [(0, 0, "x"), (5, None, "x"), (None, 1, "x")],
                                   "doc_id long, toxic int, text string")
    weights = toxicity.learn(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, weights).collect()}
    assert min(got[i] for i in range(0, 240, 4)) > max(got[i] for i in range(240) if i % 4)
    assert (weights != 0).sum() < 500 and got[240] == got[241]
    assert {r["score"] for r in toxicity.score(odd, toxicity.learn(docs, labels.limit(0))).collect()} == {0.5}
    assert toxicity.score(empty, weights).count() == 0


def test_quality(spark, odd, empty):
    texts = [prose(i, 40) + (" ### $$$ ###" * (i % 3) * 4) for i in range(150)] + ODD
    docs = frame(spark, texts)
    ratings = spark.createDataFrame([(i, 2 - i % 3) for i in range(150)] + [(3, None), (None, 1)], "doc_id long, quality int")
    model = quality.learn(docs, ratings)
    assert model.grades == [0, 1, 2] and model.thresholds[0] < model.thresholds[1]
    got = {r["doc_id"]: r for r in quality.rate(docs, model).collect()}
    mean = [np.mean([got[i]["expected_grade"] for i in range(k, 150, 3)]) for k in range(3)]
    assert mean[0] > mean[1] + 0.3 > mean[2] + 0.6 and all(got[i]["keep"] for i in range(0, 150, 3))
    kept = quality.select_documents(docs, model)
    assert kept.columns == docs.columns and kept.count() < len(texts)
    alone = quality.learn(docs, ratings.where("quality = 1"))
    assert quality.select_documents(odd, alone).count() == len(ODD)
    assert quality.select_documents(odd, quality.learn(empty, ratings)).count() == len(ODD)
    assert quality.rate(empty, model).count() == 0


def test_cumulative_link_gradient():
    """Thresholds of a sample without features are the logits of the shares."""
    grade = np.array([0] * 20 + [1] * 30 + [2] * 50)
    w, cut = quality.cumulative_link(np.arange(100) % 4, np.zeros(100), np.arange(100), grade, 3, 4, 1e-3, 400)
    assert np.allclose(1 / (1 + np.exp(-cut)), [0.2, 0.5], atol=0.02) and not w.any()


def test_shapes_of_long_words():
    """Long words that differ after twelve characters of their shape have shapes of their own."""
    make = quality.Featurer()
    assert make.word("a1b2c3d4e5f6g7-h")[1] != make.word("a1b2c3d4e5f6g7_h")[1]
    assert make.word("a1b2c3d4e5f6g7-h")[1] == make.word("b2c3d4e5f6g7h8-i")[1]


def test_decontaminate(spark, odd, empty):
    items = [prose(100 + i, 20 + 15 * i) + ". " + prose(200 + i, 8) + "." for i in range(12)] + [None, "", "Short one"]
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(0, items[0]), (None, "x y z")], "item_id long, text string")
    texts = ODD + [prose(300, 500) + " " + items[i].upper() + " " + prose(301, 300) for i in (0, 3, 11)] + [
        prose(302, 200) + " " + items[5][: len(items[5]) // 2] + " " + prose(303, 200), items[4].replace("alpha", "omega", 1), "a short one here"]
    grams = lambda t: (lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())(re.findall(r"\w+", (t or "").lower()))
    want = set()
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            words = f" {' '.join(re.findall(r'\w+', (t or '').lower()))} "
            shares = []
            for part in decontaminate.split_item(item or ""):
                g = grams(part)
                if g:
                    shares.append(len(g & grams(t)) / len(g) if len(next(iter(g))) == 5 else float(f" {' '.join(next(iter(g)))} " in words))
            if shares and min(shares) >= 0.8:
                want.add((d, i))
    got = decontaminate.matches(frame(spark, texts), benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want) and len(want) >= 4
    kept = decontaminate.clean(frame(spark, texts), benchmark)
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want} and kept.columns == odd.columns
    assert decontaminate.matches(odd, benchmark.limit(0)).count() == 0 and decontaminate.matches(empty, benchmark).count() == 0


def test_decontaminate_whole_items(spark):
    """One changed word in a short last sentence: by brute force on whole items."""
    items = [prose(100 + i, 60) + ". " + prose(200 + i, 8) + "." for i in range(6)]
    texts = [prose(300 + i, 50) + ". " + edited(item, [-4]) + " " + prose(400 + i, 50) for i, item in enumerate(items)] + [prose(500, 200)]
    grams = lambda t: (lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)})(re.findall(r"\w+", t.lower()))
    want = {(d, i) for d, t in enumerate(texts) for i, item in enumerate(items) if len(grams(item) & grams(t)) >= 0.8 * len(grams(item))}
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.matches(frame(spark, texts), benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want == {(i, i) for i in range(6)}


def test_block_maxima_lose_nothing():
    """Skipping blocks gives the same scores as scoring every item."""
    pick = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(pick.choices(vocabulary, k=30)), "") for i in range(150)]
    frequency = {}
    for _, q, _ in items:
        for w in set(q.split()):
            frequency[w] = frequency.get(w, 0) + 1
    index = decontaminate.build([(i, q, q) for i, q, _ in items], frequency, 150, 30.0)
    words = pick.choices(vocabulary, k=40) + items[7][1].split() + pick.choices(vocabulary, k=300)
    tight = index.maxima
    got = decontaminate.candidates(index, words, 0.3)
    index.maxima = np.where(tight > 0, 9, 0).astype(np.float32)
    assert got == decontaminate.candidates(index, words, 0.3) and 7 in got


def test_passages(spark, odd, empty):
    shared, other = prose(400, 60), prose(401, 55)
    near = " ".join(w if i != 30 else "changed" for i, w in enumerate(shared.split()))
    texts = [prose(500 + i, 120) + " " + shared + " " + prose(600 + i, 80) for i in range(6)] + [
        prose(700, 90) + " " + other, other + " " + prose(701, 300) + " " + shared, prose(702, 100) + " " + near, prose(703, 400), prose(703, 400),
        prose(704, 100) + " " + " ".join(shared.split()[:30]), "echo " * 500, "more echo " + "echo " * 300] + ODD
    rows = passages.repeated_passages(frame(spark, texts)).collect()
    spans = {}
    for r in rows:
        spans.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"], (r["class_doc_id"], r["class_start"])))
    for i in range(6):
        assert any(a <= 120 and b >= 180 for a, b, _ in spans[i])
    assert {c for i in range(6) for *_, c in spans[i]} == {c for a, _, c in spans[7] if a > 200}
    assert any(a <= 90 and b >= 145 for a, b, _ in spans[6]) and 8 in spans and 12 in spans and 13 in spans
    assert spans[9] == spans[10] == [(0, 400, (9, 0))] and 11 not in spans and 15 not in spans
    assert passages.repeated_passages(empty).count() == 0 and passages.repeated_passages(odd).count() == 0


def test_compact_windows():
    """Every subsequence of at least the least width lies in one window that has its minimum."""
    pick = random.Random(4)
    for case in range(60):
        texts = [[pick.randrange(1, 12 if case % 2 else 10**6) for _ in range(pick.randrange(1, 40))] for _ in range(3)]
        values = np.array([0] + [v for t in texts for v in [*t, 0]], np.uint64)
        for least in (1, 2, 3, 5, 8):
            got = list(zip(*(c.tolist() for c in passages.windows(values, least))))
            for x in range(1, len(values)):
                for y in range(x + least - 1, len(values)):
                    if (values[x:y + 1] > 0).all():
                        v = values[x:y + 1].min()
                        assert sum(lo <= x and y <= hi and lo <= node <= hi and values[node] == v for lo, node, hi in got) == 1
            assert all((values[lo:hi + 1] > 0).all() and values[lo:hi + 1].min() == values[node] for lo, node, hi in got)


def test_word_hashes(monkeypatch):
    """Those of the words one by one, wherever long texts are cut."""
    pick, signs = random.Random(9), list("abc ABC_09.,\n\tİΣσς\u0301é漢字𝔘😀\u200d٣²\x00\uffff\x85")
    texts = [None, "", ".", "x" * 500, " ".join("y" * k + "é" * (k % 3) for k in range(70))] + [
        "".join(pick.choice(signs) for _ in range(pick.randrange(150))) for _ in range(300)]
    for piece in (7, 64, 1 << 17):
        monkeypatch.setattr(passages, "PIECE", piece)
        plain = [re.findall(r"\w+", (t or "").lower()) for t in texts]
        assert [h.tolist() for h in passages.word_hashes(texts)] == [[xxhash.xxh64_intdigest(w) for w in words] for words in plain]
        assert passages.word_counts(texts).tolist() == [len(re.findall(r"\w+", t or "")) for t in texts]


def spans_of(spark, texts):
    spans = {}
    for r in passages.repeated_passages(frame(spark, texts)).collect():
        spans.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"], (r["class_doc_id"], r["class_start"])))
    return spans


def test_passages_around_a_frequent_line(spark):
    """Passages of 60 words of which 40 are a line that hundreds of other documents carry."""
    line = prose(40, 40)
    texts, n = [], 60
    for i in range(n):
        passage = prose(2000 + i, 10) + " " + line + " " + prose(3000 + i, 10)
        texts += [prose(4000 + 2 * i + k, 50) + " " + passage + " " + prose(6000 + 2 * i + k, 50) for k in range(2)]
    texts += [prose(8000 + i, 60) + " " + line + " " + prose(9000 + i, 60) for i in range(600)]
    spans = spans_of(spark, texts)
    found = sum(any(a <= 50 and b >= 110 for a, b, _ in spans.get(2 * i + k, [])) for i in range(n) for k in range(2))
    assert found >= 0.97 * 2 * n and not any(d >= 2 * n for d in spans)


@pytest.mark.parametrize("words", [55, 90])
def test_a_passage_of_very_many_documents(spark, words):
    """All of them are found, in one class."""
    passage = prose(77, words)
    texts = [prose(4000 + i, 30 + i % 40) + " " + passage + " " + prose(6000 + i, 50) for i in range(200)]
    spans = spans_of(spark, texts)
    found = [c for i in range(200) for a, b, c in spans.get(i, []) if a <= 30 + i % 40 + 1 and b >= 30 + i % 40 + words - 1]
    assert len(found) >= 195 and max(found.count(c) for c in set(found)) >= 195


def test_links_within_a_group(spark):
    """Whatever lies between the windows of a group: a passage is linked to all texts that have it, and edited ones around a
    frequent line are one class, also where the group is compared in shares."""
    line, passage, n = prose(40, 42), prose(5, 70), 15
    texts = [prose(20000 + i, 40) + " " + passage + " " + prose(21000 + i, 30) for i in range(20)]
    for i in range(n):
        around = prose(2000 + i, 3) + " " + line + " " + prose(3000 + i, 3)
        texts += [prose(4000 + 2 * i + k, 40) + " " + around + " " + prose(6000 + 2 * i + k, 40) for k in range(2)]
    texts += [prose(8000 + i, 50) + " " + line + " " + prose(9000 + i, 50) for i in range(150)]
    rows = passages.repeated_passages(frame(spark, texts), chunk=60).collect()
    assert [r["n_linked"] for r in rows if r["doc_id"] < 20] == [19] * 20
    spans = {r["doc_id"]: (r["class_doc_id"], r["class_start"]) for r in rows}
    assert sum(20 + 2 * i in spans and spans[20 + 2 * i] == spans.get(21 + 2 * i) for i in range(n)) == n
    assert not any(d >= 20 + 2 * n for d in spans)


def test_windows_around_a_node():
    """Pairs of windows of different classes are those that a comparison place by place finds."""
    pick = random.Random(2)
    for case in range(20):
        base = [pick.randrange(10**6) for _ in range(91)]
        rows = [[v if pick.random() < 0.9 - 0.3 * (case % 2) else pick.randrange(10**6) for v in base[pick.randrange(30):91 - pick.randrange(15)]] for _ in range(12)]
        rows += [[7] * 60, [7] * 50 + base[:41]]
        component = np.array([pick.randrange(6) for _ in rows])
        want = set()
        for i, x in enumerate(rows):
            near = {}
            for k, y in enumerate(rows):
                hit = [v in y for v in x]
                dense = max(sum(hit[a:a + passages.LEAST]) for a in range(len(x) - passages.LEAST + 1))
                if component[i] != component[k] and dense >= passages.NEEDED and len(x) - hit.index(True) - hit[::-1].index(True) >= 41:
                    near.setdefault(component[k], []).append((dense < passages.LEAST, k))
            for found in near.values():
                whole = [k for part, k in found if not part]
                want |= {(min(i, k), max(i, k)) for k in whole[:1] or [k for _, k in found]}
        one, other = passages.around(np.zeros(len(rows), np.int64), component, rows)
        assert set(zip(one.tolist(), other.tolist())) == want


def changed_shingles(pick, base):
    """Shingles of which some stretches are others."""
    out = list(base[pick.randrange(30):])
    for _ in range(pick.randrange(4)):
        at = pick.randrange(len(out))
        out[at:at + 5] = [pick.randrange(10**6) for _ in out[at:at + 5]]
    return out


def test_pairs_that_join_classes():
    """Windows that share a passage end in one class, with fewer pairs than windows, however many are alike."""
    pick = random.Random(8)
    for case in range(12):
        bases = [[pick.randrange(10**6) for _ in range(91)] for _ in range(3)]
        rows = [changed_shingles(pick, pick.choice(bases)) for _ in range(60)] + [[7] * 60, [7] * 50 + bases[0][:41]]
        rows += rows[:5]
        at, component = np.zeros(len(rows), np.int64), np.array([pick.randrange(20, 30) if pick.random() < 0.3 else 1000 + i for i in range(len(rows))])

        def classes(pairs):
            root = {c: c for c in component.tolist()}
            for i, k in pairs:
                a, b = root[component[i]], root[component[k]]
                root = {c: b if r == a else r for c, r in root.items()}
            return {frozenset(c for c in root if root[c] == r) for r in root.values()}

        values = [np.array(r, np.int32) for r in rows]
        held = [(i, k) for i in range(len(rows)) for k in range(i) if component[i] != component[k]
                and min(np.isin(values[i], values[k]).sum(), np.isin(values[k], values[i]).sum()) >= passages.NEEDED
                and passages.similar_runs(values[i], values[k], (np.isin(values[i], values[k]), np.isin(values[k], values[i])))]
        got = list(zip(*(c.tolist() for c in passages.joining(at, component, rows))))
        assert classes(got) == classes(held) and len(got) < len(rows) < len(held)


def test_pairs_that_hold_no_passage():
    """None in which a passage is found is passed over."""
    pick, found, kept = random.Random(5), 0, 0
    for case in range(60):
        base = [pick.randrange(10**6) for _ in range(91)]
        ones, twos = ([np.array(changed_shingles(pick, base), np.int32) for _ in range(20)] for _ in "xy")
        marks = [np.zeros((20, 91), bool) for _ in "xy"]
        for i, (x, y) in enumerate(zip(ones, twos)):
            marks[0][i, :len(x)], marks[1][i, :len(y)] = np.isin(x, y), np.isin(y, x)
        for i, may in enumerate(passages.may_hold(*marks)):
            holds = bool(passages.similar_runs(ones[i], twos[i], (marks[0][i, :len(ones[i])], marks[1][i, :len(twos[i])])))
            assert may or not holds
            found, kept = found + holds, kept + bool(may)
    assert 200 < found <= kept < 1000


def test_equal_texts_are_compared_once(spark, monkeypatch):
    """Only the first of equal texts has windows; all have the passages."""
    seen, grouped = [], passages.grouped
    monkeypatch.setattr(passages, "grouped", lambda docs: seen.extend(r["doc_id"] for r in docs.select("doc_id").collect()) or grouped(docs))
    text, shared = prose(5, 90), prose(6, 70)
    spans = spans_of(spark, [text, shared + " " + prose(7, 30), text, text, prose(8, 40) + " " + shared, text])
    assert sorted(seen) == [0, 1, 4] and sorted(spans) == [0, 1, 2, 3, 4, 5]
    assert spans[0] == spans[2] == spans[3] == spans[5] == [(0, 90, (0, 0))]


def test_windows_that_share_too_little(spark):
    """Windows with fewer shared shingles than a passage needs are found without a row for each shingle."""
    pick = random.Random(6)
    common = [pick.randrange(-2**31, 2**31) for _ in range(60)]
    rows = [(key, 100 * key + i, [pick.randrange(-2**31, 2**31) for _ in range(20)] + common[:pick.randrange(25, 45)] + [key] * pick.randrange(3))
            for key in range(3) for i in range(30 if key < 2 else 1)]
    rows.append((1, 500, [5] * 60))
    want = set()
    for key, row, shingles in rows:
        others = {v for k, r, vs in rows if (k, r) != (key, row) and k == key for v in vs}
        if sum(v in others for v in shingles) < passages.NEEDED:
            want.add(row)
    frame_ = spark.createDataFrame(rows, "key long, row long, shingles array<int>")
    sizes = frame_.groupBy("key").count()
    for chunk in (4, 1000):
        few = passages.few_shared(frame_, sizes, chunk)
        assert "explode" not in few._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(r["row"] for r in few.collect()) == sorted(want) and 10 < len(want) < 60
    assert passages.few_shared(frame_, sizes.where("count > 100"), 4).count() == 0


def test_passages_with_words_put_in_and_left_out(spark):
    """Near-duplicates of resemblance 0.8 and more, whatever the edit."""
    texts, n = [], 40
    for i in range(n):
        words = prose(100 + i, 90).split()
        other = list(words)
        for place in ([45], [30, 62])[i // 2 % 2]:
            if i % 2:
                other.insert(place, f"new{place}")
            else:
                del other[place]
        texts += [prose(4000 + i, 40) + " " + " ".join(words) + " " + prose(5000 + i, 30), prose(6000 + i, 70) + " " + " ".join(other) + " " + prose(7000 + i, 30)]
    spans = spans_of(spark, texts)
    found = 0
    for i in range(n):
        assert resemblance(*(" ".join(texts[2 * i + k].split()[at:-30]) for k, at in ((0, 40), (1, 70)))) >= 0.8
        both = spans.get(2 * i, []), spans.get(2 * i + 1, [])
        found += any(abs(a[0] - 40) <= 12 and abs(a[1] - 130) <= 12 and a[2] == b[2] for a in both[0] for b in both[1])
    assert found >= 0.9 * n


def test_passages_of_repeated_ids(spark):
    a, b = prose(5, 80), prose(6, 80)
    rows = [(1, a), (1, b), (2, a), (3, b), (4, prose(7, 80)), (4, prose(7, 80)), (None, a)]
    kinds = "doc_id long, text string"
    one, other = (sorted(map(str, passages.repeated_passages(spark.createDataFrame(r, kinds)).collect())) for r in (rows, rows[::-1]))
    assert one == other and len(one) == 2


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    clean = [prose(i, 80) for i in range(30)]
    junk = ["### $$$ " * 40 + str(i) for i in range(10)]
    item = prose(900, 40)
    texts = clean + junk + [clean[0], clean[1], prose(901, 60) + " " + item + " " + prose(902, 60), "write to ann@corp.example.com " + prose(903, 60)]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, int(i < 30), 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} == {*range(30), 43}
    encode = packing.Encoder(queries.tokenizer()["json_path"], None, None)
    lengths = {r["doc_id"]: r["doc_tokens"] for r in rows}
    assert all(lengths[i] == len(encode(texts[i])) + 1 for i in range(30))
