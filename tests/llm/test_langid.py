import itertools
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from paperloom.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.op2_language_mixture(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out").collect()
    assert len(got) > 150
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_mixtures_and_edges(spark):
    rng = random.Random(3)
    syll = {"aa": ["ka", "to", "mi", "ru"], "bb": ["strach", "pfen", "gung"], "cc": ["eau", "oux", "ille"]}
    word = lambda k: "".join(rng.choice(syll[k]) for _ in range(3))
    text = lambda k, n: " ".join(word(k) for _ in range(n))
    rows = [(i, text(k, 60), k, "clash") for i, k in enumerate(["aa", "bb", "cc"] * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.train(docs)
    assert model.languages == ("aa", "bb", "cc")
    probe = [(1, text("aa", 40)), (2, text("aa", 60) + " " + text("cc", 30)), (3, None), (4, ""), (5, "12 34 !!"), (None, text("bb", 2)), (7, "日本"), (8, text("bb", 50_000))]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(probe, "doc_id long, text string"), model).collect()}
    assert got[1]["lang_pred"] == "aa" and got[1]["score"] > 0.99 and len(got[1]["mixture"]) == 1
    mixed = {m["lang"]: m["share"] for m in got[2]["mixture"]}
    assert set(mixed) == {"aa", "cc"} and abs(mixed["aa"] - 2 / 3) < 0.02
    assert [got[i]["lang_pred"] for i in (3, 4, 5)] == ["und"] * 3
    assert got[None]["lang_pred"] == "bb" and got[8]["lang_pred"] == "bb" and got[7]["lang_pred"] in model.languages
    out = langid.identify(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score", "mixture"]
    assert langid.identify(docs.limit(0), model).count() == 0
    none = langid.train(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.confident_documents(docs.withColumn("text", F.when(F.col("doc_id") == 4, "!!").otherwise(F.col("text")))).count() == 89


def test_unrecognisable_documents_go_and_clean_ones_stay(spark):
    rng = random.Random(7)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    letters = ["abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "".join(map(chr, range(0x4E00, 0x5A00))), "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"]
    junk = lambda al, n: " ".join("".join(rng.choice(al) for _ in range(rng.randint(4, 9))) for _ in range(n))
    planted = [junk(al, n) for al in letters for n in (3, 60, 2000) if n > 3 or al != letters[-1]] + [rows[0][1][:200] + " " + junk(letters[0], 300)]
    by = {k: [t for _, t, lang in rows if lang == k] for k in ("de", "en", "es", "fr")}
    clean = [t[0][:40] for t in by.values()] + [" ".join(t[1][:500] for t in by.values()), by["de"][2] + " " + junk(letters[0], 5)]
    clean += ["The erin a password=32bb02aa3b580bf8ab thes as.", "4397110767823743 +1 (654) 555-4136 fhctton.79@mail5.example.com That the as the."]
    # ids of 2 modulo 4 by crc32 are not learnt from; nothing planted is
    held = [i for i in range(10**6, 10**6 + 400) if zlib.crc32(str(i).encode()) % 4 == 2]
    extra = list(zip(held, planted + clean))
    more = spark.createDataFrame([(i, t, "en") for i, t in extra], "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in langid.confident_documents(docs.select("doc_id", "text", "lang").union(more)).select("doc_id").collect()}
    assert kept == {i for i, _, _ in rows} | {i for i, t in extra if t in clean}


def test_texts_in_more_than_four_languages(spark):
    rng = random.Random(5)
    syll = {"aa": "kato miru", "bb": "strach pfengung", "cc": "eaux ouille", "dd": "zyx qyv", "ee": "hwlo gwdd", "ff": "njehu jjaba"}
    text = lambda k, n: " ".join("".join(rng.choice(syll[k].split()) for _ in range(3)) for _ in range(n))
    model = langid.train(spark.createDataFrame([(i, text(k, 60), k) for i, k in enumerate(list(syll) * 20)], "doc_id long, text string, lang string"))
    probe = [(n, " ".join(text(k, 40) for k in list(syll)[:n])) for n in range(1, 7)]
    for r in langid.identify(spark.createDataFrame(probe, "doc_id long, text string"), model).collect():
        shares = {m["lang"]: m["share"] for m in r["mixture"]}
        assert set(shares) == set(list(syll)[: r["doc_id"]]) and all(abs(x - 1 / r["doc_id"]) < 0.02 for x in shares.values())
        assert abs(r["score"] - 1 / r["doc_id"]) < 0.02


def brute_mixture(words):
    """(best penalised log-likelihood, its set) over all sets of languages, by plain expectation-maximisation."""
    n, langs = words.shape
    best = (-1e300, ())
    for k in range(1, langs + 1):
        for names in itertools.combinations(range(langs), k):
            like = np.exp(words[:, names].astype(float))
            share = np.full(k, 1 / k)
            for _ in range(200):
                part = like * share
                share = (part / part.sum(1, keepdims=True)).mean(0)
            value = np.log((like * share).sum(1)).sum() - 0.5 * np.log(max(n, 2)) * (k - 1)
            best = max(best, (value, names))
    return best


def test_sets_against_all_subsets():
    rng = np.random.default_rng(11)
    per, parts = [], []
    for _ in range(120):
        langs, n = 5, int(rng.integers(1, 60))
        chosen = rng.choice(langs, rng.integers(1, 5), replace=False)
        of = rng.choice(chosen, n)
        words = rng.normal(-12, 2.5, (n, langs))
        words[np.arange(n), of] += rng.uniform(0, 8, n)
        words[:, 1] = words[:, 0] + rng.normal(0, 0.4, n)  # two languages that are hard to tell apart
        per.append(n)
        parts.append(words)
    words, per = np.concatenate(parts).astype(np.float32), np.array(per)
    share, _ = langid.mixtures(words, per)
    at, exact = 0, 0
    for n, s in zip(per.tolist(), share):
        own = words[at : at + n].astype(float)
        at += n
        value, names = brute_mixture(own)
        got = np.log((np.exp(own) * s).sum(1)).sum() - 0.5 * np.log(max(n, 2)) * ((s > 0).sum() - 1)
        exact += tuple(np.flatnonzero(s > 0)) == names
        # eight rounds of EM stop short of the limit, and of two languages nearly alike the lesser one may be held
        assert got > value - 2.0, (n, names, s)
    assert exact >= 110
