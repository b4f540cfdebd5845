import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from paperloom.llm import langid, wavelet

SF = "/root/testdata/sf0.001"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def plain_groups(rows):
    """Representative of each row index by links of similarity 0.8, all pairs."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    return group


def plain_contaminated(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    windows = set()
    for item in items:
        w = words(item)
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    w, hit = words(text), set()
    for size in {len(x) for x in windows}:
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in windows:
                hit |= set(range(i, i + size))
    return len(hit) > 0 and 20 * len(hit) >= len(w)


def plain_copies(rows, seed=17):
    """(doc_id, copies) by inverting each source's Poisson distribution at 52 bits of an MD5."""
    import hashlib

    sources = {}
    for i, _, source in rows:
        sources.setdefault(source or "", []).append(i)
    out = []
    for i, _, source in rows:
        rate = len(rows) / len(sources) / len(sources[source or ""])
        u = int(hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
        n, total = 0, math.exp(-rate)
        while total <= u:
            n += 1
            total += math.exp(-rate + n * math.log(rate) - math.lgamma(n + 1))
        out.append((i, n))
    return out


def planted(spark):
    rng = np.random.default_rng(3)
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*P.COLUMNS).collect()]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    first = max(r[0] for r in docs) + 1
    junk = " ".join("".join(rng.choice(list("qxzjkvw"), 9)) for _ in range(80))
    base = docs[3][1] + " " + " ".join(f"{docs[4][1].split()[i % 7]}{i}" for i in range(60))
    more = [(junk, "en"), (base, "en"), (base + " and one", "en"), (items[0] or "", "en"), (None, "en"), ("", "de"), ("12 34", None)]
    extra = [(first + i, t, lang, "web" if i % 2 else None, len(t or "")) for i, (t, lang) in enumerate(more)]
    extra += [(docs[5][0], "another text under an id that is taken, of some length and in plain words of the day", "en", "web", 1)]
    return docs + extra, items, {first: "junk", first + 4: "null", first + 5: "empty", first + 6: "digits"}


def test_stages_against_plain_python(spark):
    rows, items, unread = planted(spark)
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, kind)
    assert [n for n, _ in P.STAGES] == ["language", "near_dedup", "decontaminate", "mix", "tokens"] and P.ORACLE_SQL is None
    steps = [docs]
    for _, stage in P.STAGES:
        steps.append(stage(spark, steps[-1], SF).persist())
    got = [[tuple(r) for r in s.collect()] for s in steps]
    for after in steps[1:5]:
        assert after.columns == P.COLUMNS
    # language: what has no letters or no recognisable words goes, all else stays
    assert {r[0] for r in rows} - {r[0] for r in got[1]} == set(unread)
    # near duplicates: one row of each group of all pairs
    group = plain_groups([(r[0], r[1]) for r in got[1]])
    kept = [group[got[1].index(r)] for r in got[2]]
    assert sorted(kept) == sorted(set(group)) and set(got[2]) <= set(got[1])
    # decontamination: exactly the rows without enough words in windows of items
    assert sorted(got[3], key=str) == sorted((r for r in got[2] if not plain_contaminated(r[1], items)), key=str)
    assert len(got[3]) < len(got[2])
    # mix: every row as often as its draw says
    want = sorted(r[:1] + r[1:] for r, (_, n) in zip(got[3], plain_copies([(r[0], r[1], r[3]) for r in got[3]])) for _ in range(n))
    assert sorted(got[4], key=str) == sorted(want, key=str)
    # tokens: each row's ids by the library, in order
    from tokenizers import Tokenizer

    tok, at = Tokenizer.from_file(wavelet.default_tokenizer()), 0
    left = {}
    for r in got[4]:
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 0]
        left.setdefault(r[0], []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for doc, start, n, crc in sorted(got[5], key=lambda r: r[1]):
        assert start == at
        at += n
        left[doc].remove((n, crc))
    assert not any(left.values())


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(map(tuple, P.run(spark, SF).collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_columns_with_names_of_the_operators(spark):
    docs = spark.createDataFrame([(i, "the cat and the dog went home to eat and to sleep", "en", "x", "s", "m", 1) for i in range(5)], "doc_id long, text string, lang string, Score string, mixture string, items string, n_hit int")
    model = langid.train(docs)
    assert model.languages == ("en",)
    out = langid.confident_documents(docs)
    assert out.columns == docs.columns and out.where(F.col("Score") == "x").count() == 5
    from paperloom.llm import decontam

    bench = spark.createDataFrame([("b", "nothing of this kind is in any text that we have here today or at all")], "item_id string, text string")
    clean = decontam.clean_documents(docs, bench)
    assert clean.columns == docs.columns and sorted(clean.collect()) == sorted(docs.collect())
