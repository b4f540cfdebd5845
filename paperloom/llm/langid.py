"""Operator 2: language ID by mixture inference.

A model holds log P(trigram | language) over hashed byte trigrams of words. Each word of a text is drawn from one
language of a mixture: expectation-maximisation estimates the proportions, and the language set is the one whose
likelihood, less half the logarithm of the number of words for every language beyond the first, is highest.

A word is recognised if the text's mixture makes it likelier than an unknown language, UNKNOWN a trigram, does.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import append_columns, map_arrow, set_aside, slabs, word_spans

#: Documents per language, at most about so many, that the model is fitted on (chosen by a hash of doc_id and text).
SAMPLE = 3000
#: Distinct training languages; more are refused, so that the model that is broadcast stays below BITS x this x 4 bytes.
MAX_LANGUAGES = 256
BITS, ROUNDS, SMOOTHING = 17, 8, 0.5
#: Log-likelihood of a trigram in an unknown language: some 36,000 trigrams, each as likely. Words of the training
#: languages are at about -6 to -8 a trigram, letters at random and foreign scripts at -12 or less.
UNKNOWN = -10.5
#: A text is in a recognised language if so much of it, by letters, is in recognised words. A short sentence with an
#: address or a key in it is at about 0.4, letters at random at 0.12 at most.
RECOGNISED = 0.3
#: Words are runs of a-z (A-Z lower-cased) and bytes over 0x7F.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def trigrams(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams of all words with a space on either side, letters per word, words per text."""
    raw, starts, ends, per_text = word_spans(text, LETTERS)
    sizes = ends - starts
    if not len(starts):
        return np.zeros(0, np.int64), sizes, per_text
    upto = np.cumsum(sizes)
    at = np.repeat(starts - (upto - sizes), sizes) + np.arange(int(upto[-1]))
    mid = raw[at].astype(np.uint32)
    left, right = np.full(len(at), 32, np.uint32), np.full(len(at), 32, np.uint32)
    left[1:], right[:-1] = mid[:-1], mid[1:]
    left[upto - sizes] = 32
    right[upto - 1] = 32
    keys = (left << np.uint32(16)) | (mid << np.uint32(8)) | right
    return ((keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64), sizes, per_text


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    logs: np.ndarray  # (2**BITS, languages) float32


def train(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Fit on the texts and non-null lang of docs; a language with more than `sample` documents is sampled by hash."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = dict(rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect())
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return LanguageModel((), np.zeros((1 << BITS, 0), np.float32))
    rates = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample / n))])
    chosen = F.pmod(F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary"))), F.lit(1 << 20)) < F.element_at(rates, F.col("lang")) * (1 << 20)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slabs(batch, 0):
                names = np.array(part.column(1).to_pylist(), object)
                for name in set(names.tolist()):
                    grams, *_ = trigrams(part.column(0).filter(pa.array(names == name)))
                    which, n = np.unique(grams, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([which.astype(np.uint32).tobytes()]), pa.array([n.astype(np.uint32).tobytes()])], ["lang", "grams", "counts"])

    def total(table: pa.Table) -> pa.Table:
        out = np.zeros(1 << BITS, np.int64)
        for g, n in zip(table.column("grams").to_pylist(), table.column("counts").to_pylist()):
            out[np.frombuffer(g, np.uint32)] += np.frombuffer(n, np.uint32)
        return pa.table({"lang": table.column("lang").slice(0, 1), "counts": pa.array([out.tobytes()])})

    # bounded: at most about `sample` documents of a language reach its group
    counted = map_arrow(rows.where(chosen).select("text", "lang"), count, "lang string, grams binary, counts binary").groupBy("lang").applyInArrow(total, "lang string, counts binary")
    got = sorted((r["lang"], np.frombuffer(r["counts"], np.int64)) for r in counted.collect())
    if not got:
        return LanguageModel((), np.zeros((1 << BITS, 0), np.float32))
    counts = np.stack([c for _, c in got], 1) + SMOOTHING
    return LanguageModel(tuple(k for k, _ in got), np.log(counts / counts.sum(0)).astype(np.float32))


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, first, axis=0) if len(first) else x[:0]


def mixtures(words: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(share by language, confidence) per text from words' log-likelihoods by language; texts have a word at least.

    The sets compared are, at each size, the languages of largest share in the mixture of all, and the best set so far
    with one more language. They grow until no larger one can do better: the log-likelihood is concave in the shares, so
    its slope bounds what any mixture, and any further language, can add.
    """
    texts, langs = len(per_text), words.shape[1]
    first = np.cumsum(per_text) - per_text
    high = words.max(1)
    like = np.exp(words - high[:, None]).astype(np.float32)
    floor = _sums(high.astype(np.float64), first)

    def em(share: np.ndarray, rounds: int, like: np.ndarray, sizes: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(share, log-likelihood, the most that any mixture can have)."""
        first, of = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
        for i in range(rounds + 1):
            part = like * share[of]
            mass = np.maximum(part.sum(1), np.float32(1e-30))
            if i == rounds:
                got = floor + _sums(np.log(mass.astype(np.float64)), first)
                return share, got, got + _sums(like / mass[:, None], first).max(1) - sizes
            part /= mass[:, None]
            share = (_sums(part, first) / sizes[:, None]).astype(np.float32)

    alone = _sums(words.astype(np.float64), first)
    best = np.zeros((texts, langs), np.float32)
    best[np.arange(texts), alone.argmax(1)] = 1
    value = alone.max(1)
    odds = np.exp(alone - value[:, None])
    sure = 1 / odds.sum(1)
    if langs > 1:
        full, _, most = em(np.full((texts, langs), 1 / langs, np.float32), ROUNDS, like, per_text, floor)
        rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
        cost = 0.5 * np.log(np.maximum(per_text, 2))
        open_ = np.arange(texts)
        fresh = np.ones(texts, bool)  # the best set has changed since languages were last added to it
        for k in range(2, langs + 1):
            open_ = open_[most[open_] - cost[open_] * (k - 1) + 0.01 > value[open_]]  # 0.01: rounding of float32
            if not len(open_):
                break
            pick = np.repeat(np.isin(np.arange(texts), open_), per_text)
            start = np.where(rank[open_] < k, full[open_] + np.float32(1e-3), 0).astype(np.float32)
            share, got, _ = em(start / start.sum(1, keepdims=True), ROUNDS, like[pick], per_text[open_], floor[open_])
            got -= cost[open_] * (k - 1)
            better = got > value[open_]
            now, high_now = best.copy(), value.copy()
            now[open_[better]], high_now[open_[better]] = share[better], got[better]
            for rows, one in _additions(open_[fresh[open_]], best, like, per_text, cost):
                pick = np.repeat(np.isin(np.arange(texts), rows), per_text)
                start = best[rows] * np.float32(0.8)
                start[:, one] = 0.2
                share, got, _ = em(start, ROUNDS, like[pick], per_text[rows], floor[rows])
                got -= cost[rows] * (best[rows] > 0).sum(1)
                better = got > high_now[rows]
                now[rows[better]], high_now[rows[better]] = share[better], got[better]
            fresh = high_now > value
            best, value = now, high_now
    mixed = best.max(1) < 1
    return best, np.where(mixed, 1.0, sure)


def _additions(rows: np.ndarray, best: np.ndarray, like: np.ndarray, per_text: np.ndarray, cost: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """(texts, language): those to whose best mixture the language could add more than it costs."""
    if not len(rows):
        return
    part = like[np.repeat(np.isin(np.arange(len(per_text)), rows), per_text)]
    sizes = per_text[rows]
    mass = np.maximum((part * best[rows][np.repeat(np.arange(len(rows)), sizes)]).sum(1, keepdims=True), np.float32(1e-30))
    slope = _sums(part / mass, np.cumsum(sizes) - sizes) - sizes[:, None]
    fits = (best[rows] <= 0) & (slope > cost[rows][:, None])
    for one in np.flatnonzero(fits.any(0)).tolist():
        yield rows[fits[:, one]], one


def recognised(words: np.ndarray, letters: np.ndarray, per_text: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Share of the letters of each text in words that its mixture makes likelier than an unknown language does."""
    first, high = np.cumsum(per_text) - per_text, words.max(1)
    mass = (np.exp(words - high[:, None]) * share[np.repeat(np.arange(len(per_text)), per_text)]).sum(1)
    known = high + np.log(np.maximum(mass, 1e-30)) > UNKNOWN * letters
    return _sums(letters * known, first) / _sums(letters, first)


def identify(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None) -> DataFrame:
    """Columns of docs with lang_pred, score (0 to 1) and mixture (lang, share; largest first).

    Only the text is looked at, all of it. lang_pred is the language of the largest share; score is that share, for a
    text in one language the posterior probability of it, and 0 if less than RECOGNISED of the text is in recognised
    words (lang_pred is the nearest language then). Null text or one without a letter, or a model without
    languages: `und`, 0 and an empty mixture. Rows pass one to one, repeated ones with equal results; kept columns with
    the new names are replaced. Of languages with equal shares the first in the model's order counts as larger. Texts of
    any length are one row's work, their trigrams gathered in bounded pieces. An empty table gives an empty result.
    """
    keep = list(docs.columns if keep is None else keep)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.logs))
    lettered = F.coalesce(F.col("text").cast("string").rlike("\\p{L}"), F.lit(False))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep if c != "text"], F.col("text").cast("string").alias("text"), lettered.alias("_lettered"))

    def make(text: pa.Array, lettered: pa.Array) -> list[pa.Array]:
        languages, logs = shared.value
        n = len(text)
        names, scores, mixed = ["und"] * n, np.zeros(n), [[] for _ in range(n)]
        if languages:
            grams, letters, per_text = trigrams(text)
            use = np.flatnonzero(lettered.to_numpy(zero_copy_only=False).astype(bool) & (per_text > 0))
            words = np.empty((len(letters), len(languages)), np.float32)
            begin, i = np.cumsum(letters) - letters, 0
            while i < len(letters):  # gathers a bounded number of trigrams at a time
                j = max(i + 1, int(np.searchsorted(begin, begin[i] + (1 << 22) // len(languages))))
                end = begin[j] if j < len(begin) else len(grams)
                words[i:j] = _sums(logs[grams[begin[i] : end]], begin[i:j] - begin[i])
                i = j
            pick = np.repeat(np.isin(np.arange(n), use), per_text)
            share, sure = mixtures(words[pick], per_text[use]) if len(use) else (np.zeros((0, len(languages))), np.zeros(0))
            if len(use):
                sure = np.where(recognised(words[pick], letters[pick], per_text[use], share) >= RECOGNISED, sure, 0.0)
            order = np.argsort(-share, axis=1, kind="stable")
            for row, ranked, s, c in zip(use.tolist(), order.tolist(), share.tolist(), sure.tolist()):
                names[row] = languages[ranked[0]]
                scores[row] = min(1.0, s[ranked[0]] * c)
                mixed[row] = [{"lang": languages[x], "share": s[x]} for x in ranked if s[x] > 0]
        return [pa.array(names), pa.array(scores), pa.array(mixed, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))]

    return append_columns(rows, keep, ["text", "_lettered"], "lang_pred string, score double, mixture array<struct<lang:string,share:double>>", make, 1 << 20)


def learns(doc_id: Column) -> Column:
    """Documents that the model may learn from: crc32 of the id as text is not 2 modulo 4; null ids are."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 != 2


def confident_documents(docs: DataFrame, least: float = 0.2) -> DataFrame:
    """The documents in a recognised language, with their own columns.

    `und`, texts that are mostly not in recognised words, and texts in one language with a posterior probability of it
    below `least` go; the shares of a recognised mixture don't count against it.
    """
    model = train(docs.where(learns(F.col("doc_id"))))
    rows, own = set_aside(docs, ("lang_pred", "score", "mixture"))
    tagged = identify(rows, model)
    return tagged.where(f"lang_pred <> 'und' AND score > 0 AND score >= {least} * mixture[0].share").select(*own)


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; see identify(). held_out: the model has not seen the row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(learns(F.col("doc_id"))))
    found = identify(docs.select("doc_id", "text"), model, ["doc_id"])
    return found.select("doc_id", (~learns(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")
