import zlib

import numpy as np
import pyarrow as pa
import pytest

from paperloom.llm import wavelet
from paperloom.llm.wavelet import PieceEncoder, WaveletMatrix, shard_image

EDGE = [None, "", " ", "  ", "a", " a", "a ", "a  b", "a   b\n", "foo \nbar", "foo\n  bar", "x\x1cy \x1c z", "don't stop", "<|endoftext|> a", "naïve ß 12ab!?", "日本 語", "a\xa0b \xa0c", "tab\tx \t y", "İx   z", "٣٤ ½x", "éx", "soft\xadx", "🙂 🙂🙂"]


def test_matrix_access_rank_select_round_trip():
    rng = np.random.default_rng(3)
    ids = (rng.zipf(1.3, 3000) % 700).astype(np.uint32)
    wm = WaveletMatrix.from_bytes(shard_image(ids, [5], [0], [len(ids)], 64))
    assert (wm.decode() == ids).all()
    assert [wm.access(i) for i in range(0, 3000, 37)] == ids[::37].tolist()
    for token in [1, 2, 3, 650, 699, 9999]:
        where = np.flatnonzero(ids == token).tolist()
        assert wm.count(token) == len(where)
        assert wm.rank(token, 1234) == sum(w < 1234 for w in where)
        assert wm.occurrences(token)[:20] == where[:20]
    with pytest.raises(IndexError):
        wm.access(3000)


@pytest.mark.parametrize("n", [0, 1, 2, 511, 512, 513])
def test_matrix_small(n):
    ids = np.arange(n) % 3
    wm = WaveletMatrix.from_bytes(shard_image(ids, chunk=64))
    assert wm.decode().tolist() == ids.tolist()
    assert [wm.access(i) for i in range(n)] == ids.tolist()


def test_pieces_encode_like_the_library():
    enc = PieceEncoder(wavelet.default_tokenizer())
    rng = np.random.default_rng(1)
    alphabet = list("ab AB'  \n\t.,!12é\xa0\x1c 語½́")
    texts = EDGE + ["".join(rng.choice(alphabet, rng.integers(0, 30))) for _ in range(800)]
    flat, per = enc.encode(pa.array(texts))
    at = 0
    for t, k in zip(texts, per.tolist()):
        assert flat[at : at + k].tolist() == enc.whole.encode(t or "", add_special_tokens=False).ids, repr(t)
        at += k
    assert at == len(flat)


def test_token_output_against_the_library(spark):
    from tokenizers import Tokenizer

    rows = [(i * 7 % 101, t, "x") for i, t in enumerate(EDGE)] + [(3, "again", "x"), (3, "again", "x"), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)
    got = wavelet.token_output(docs).orderBy("start").collect()
    tok, at, seen = Tokenizer.from_file(wavelet.default_tokenizer()), 0, []
    want = {}
    for i, t, _ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        seen.append(r["doc_id"])
        want[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
    assert seen == sorted(seen, key=lambda x: -1 if x is None else x)
    assert not any(want.values())
    assert wavelet.token_output(docs.limit(0)).count() == 0


def test_queries_read_a_part_of_the_file(tmp_path):
    rng = np.random.default_rng(5)
    ids = (rng.zipf(1.2, 400_000) % 3000).astype(np.uint32)
    image = shard_image(ids, [1], [0], [len(ids)])
    (tmp_path / "x.wmx").write_bytes(image)
    fetched = []

    def read(at, size):
        fetched.append(size)
        return image[at : at + size]

    rare = int(np.bincount(ids).argsort()[-1000])
    where = np.flatnonzero(ids == rare)
    for ask, want in [(lambda w: w.access(123_456), ids[123_456]), (lambda w: w.rank(rare, 300_000), (where < 300_000).sum()), (lambda w: w.select(rare, 3), where[3])]:
        fetched.clear()
        assert ask(WaveletMatrix(read)) == want
        assert sum(fetched) < len(image) / 3
    assert WaveletMatrix.open(f"file://{tmp_path}/x.wmx").occurrences(rare) == where.tolist()
    with pytest.raises(IndexError):
        WaveletMatrix(read).select(rare, len(where))


def test_exported_shards_are_files_of_their_own(spark, tmp_path):
    docs = spark.createDataFrame([(i, "some words " * 50) for i in range(40)], "doc_id long, text string")
    shards = wavelet.write_shards(docs, wavelet.default_tokenizer(), shard_tokens=500)
    rows = wavelet.export_shards(shards, f"file://{tmp_path}/out").collect()
    assert len(rows) == shards.count() > 1
    assert len(shards.inputFiles()) == len(rows)
    got = [x for r in sorted(rows) for x in WaveletMatrix.open(r["path"]).doc_ids.tolist()]
    assert got == list(range(40))


def test_the_store_of_words_tells_hashes_alike_apart(monkeypatch):
    enc = PieceEncoder(wavelet.default_tokenizer())
    monkeypatch.setattr(wavelet, "span_hashes", lambda raw, starts, ends: (ends - starts).astype(np.uint64))
    for texts in (["aa"], ["bb"], ["aa bbb cccc"], ["aa", "ddd"]):
        flat, per = enc.encode(pa.array(texts))
        assert flat.tolist() == [x for t in texts for x in enc.whole.encode(t).ids] and len(per) == len(texts)


def test_the_store_of_words_begins_anew_when_full(monkeypatch):
    enc = PieceEncoder(wavelet.default_tokenizer())
    monkeypatch.setattr(wavelet, "CACHED", 3)
    for texts in (["aa bb cc dd"], ["aa ee"], ["dd", "ff gg"]):
        flat, _ = enc.encode(pa.array(texts))
        assert flat.tolist() == [x for t in texts for x in enc.whole.encode(t).ids]
