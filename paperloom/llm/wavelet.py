"""Operator 9: token ids in wavelet-matrix shards, one compressed file per shard.

File layout, little-endian:
  magic "WMX2", uint32 header length, JSON header: n tokens, d documents, s symbols, width planes, chunk bytes, and
  where each section begins and how long it is, counted from the header's end,
  ids, null, tokens: int64 ids[d], uint8 null flags[d], int64 token counts[d],
  symbols: uint32 ids by falling frequency in the shard (a symbol is the rank of its id),
  ones: for each plane int64 ones before each chunk, and in all (the rank directory),
  at: uint64 place of each chunk in bits, plane by plane, and the end,
  bits: planes, most significant bit first: the packed bits of n symbols, stably parted by the planes before, cut into
  chunks that are compressed apart.
A reader fetches the header, the directories and the chunks that it needs, never the whole file.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, shuffle_partitions, slabs, span_hashes, string_bytes, written

#: Tokens gathered into one shard before it is emitted; longer documents make a longer shard.
SHARD_TOKENS = 2 << 20
#: Bytes of an uncompressed chunk, and inflated chunks that a reader keeps.
CHUNK, KEPT_CHUNKS = 4096, 64
#: Words remembered by a Python worker, in about 60 bytes each; when there are more, it starts anew.
CACHED = 500_000
MAGIC = b"WMX2"


def shard_image(ids: np.ndarray, doc_ids=(), doc_null=(), doc_tokens=(), chunk: int = CHUNK) -> bytes:
    """The file of a token sequence."""
    ids = np.asarray(ids, np.uint32)
    n = len(ids)
    counts = np.bincount(ids) if n else np.zeros(0, np.int64)
    used = np.flatnonzero(counts)
    symbols = used[np.argsort(-counts[used], kind="stable")].astype(np.uint32)
    width = max(1, int(len(symbols) - 1).bit_length()) if n else 0
    rank = np.zeros(len(counts), np.uint16 if width <= 16 else np.uint32)
    rank[symbols] = np.arange(len(symbols), dtype=rank.dtype)
    seq = rank[ids]
    spare = np.empty_like(seq)
    z = zstandard.ZstdCompressor(level=1)
    pieces, ones = [], np.zeros((width, -(-n // (8 * chunk)) + 1), np.int64)
    for level in range(width):
        one = ((seq >> seq.dtype.type(width - 1 - level)) & seq.dtype.type(1)).astype(bool)
        packed = np.packbits(one, bitorder="little")
        ones[level, 1:] = np.cumsum(np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), chunk), dtype=np.int64))
        raw = packed.tobytes()
        pieces += [z.compress(raw[i : i + chunk]) for i in range(0, len(raw), chunk)]
        zeros = n - int(ones[level, -1])
        np.compress(~one, seq, out=spare[:zeros])
        np.compress(one, seq, out=spare[zeros:])
        seq, spare = spare, seq
    at = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype("<u8")
    sections = {
        "ids": np.asarray(doc_ids, "<i8").tobytes(), "null": np.asarray(doc_null, "u1").tobytes(), "tokens": np.asarray(doc_tokens, "<i8").tobytes(),
        "symbols": symbols.astype("<u4").tobytes(), "ones": ones.astype("<i8").tobytes(), "at": at.tobytes(), "bits": b"".join(pieces),
    }
    where, begin = {}, 0
    for name, body in sections.items():
        where[name] = [begin, len(body)]
        begin += len(body)
    head = json.dumps({"n": n, "d": len(doc_ids), "s": len(symbols), "width": width, "chunk": chunk, "sections": where}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *sections.values()])


class WaveletMatrix:
    """Access, rank, count, select and occurrences on a shard file, read in parts by read(offset, length)."""

    def __init__(self, read: Callable[[int, int], bytes]):
        start = read(0, 1024)
        if start[:4] != MAGIC:
            raise ValueError("not a wavelet-matrix shard")
        self._begin = 8 + struct.unpack("<I", start[4:8])[0]
        head = json.loads(start[8 : self._begin] if len(start) >= self._begin else read(8, self._begin - 8))
        self.n, self.width, self.chunk, self._where, self._read = head["n"], head["width"], head["chunk"], head["sections"], read
        self._held: dict[str, np.ndarray] = {}
        self._chunks: dict[tuple[int, int], np.ndarray] = {}

    @classmethod
    def from_bytes(cls, image: bytes) -> WaveletMatrix:
        return cls(lambda at, size: image[at : at + size])

    @classmethod
    def open(cls, uri: str) -> WaveletMatrix:
        """A shard file in any store that pyarrow reaches."""
        from pyarrow.fs import FileSystem

        store, path = FileSystem.from_uri(uri)
        file = store.open_input_file(path)
        return cls(lambda at, size: file.read_at(size, at))

    def _section(self, name: str, dtype: str) -> np.ndarray:
        if name not in self._held:
            begin, size = self._where[name]
            self._held[name] = np.frombuffer(self._read(self._begin + begin, size) if size else b"", dtype)
        return self._held[name]

    doc_ids = property(lambda self: self._section("ids", "<i8"))
    doc_null = property(lambda self: self._section("null", "u1"))
    doc_tokens = property(lambda self: self._section("tokens", "<i8"))
    symbols = property(lambda self: self._section("symbols", "<u4"))

    def _ones(self, level: int) -> np.ndarray:
        """Ones of a plane before each chunk, and in all."""
        return self._section("ones", "<i8").reshape(self.width, -1)[level]

    def _bits(self, level: int, chunk: int) -> np.ndarray:
        """The packed bits of one chunk."""
        if (level, chunk) not in self._chunks:
            at = self._section("at", "<u8")
            place = level * (len(self._ones(level)) - 1) + chunk
            begin, end = int(at[place]), int(at[place + 1])
            raw = self._read(self._begin + self._where["bits"][0] + begin, end - begin)
            if len(self._chunks) >= KEPT_CHUNKS:
                del self._chunks[next(iter(self._chunks))]
            self._chunks[level, chunk] = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
        return self._chunks[level, chunk]

    def decode(self) -> np.ndarray:
        """All token ids in order, by undoing the stable partitions from the last plane up."""
        n, chunks = self.n, -(-self.n // (8 * self.chunk))
        seq = np.zeros(n, np.uint16 if self.width <= 16 else np.uint32)
        if not n:
            return seq.astype(np.uint32)
        at = self._section("at", "<u8").tolist()
        begin, size = self._where["bits"]
        body, z = self._read(self._begin + begin, size), zstandard.ZstdDecompressor()
        for k in range(self.width):
            level = self.width - 1 - k
            plane = b"".join([z.decompress(body[at[i] : at[i + 1]]) for i in range(level * chunks, (level + 1) * chunks)])
            one = np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little").view(bool)
            high, low = np.flatnonzero(one), np.flatnonzero(~one)
            up = np.empty_like(seq)
            up[low] = seq[: len(low)]
            up[high] = seq[len(low) :] | seq.dtype.type(1 << k)
            seq = up
        return self.symbols[seq]

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        chunk, rest = divmod(i, 8 * self.chunk)
        ones = int(self._ones(level)[chunk])
        if rest:
            bits = self._bits(level, chunk)
            ones += int(np.bitwise_count(bits[: rest // 8]).sum())
            if rest % 8:
                ones += int(bits[rest // 8] & ((1 << (rest % 8)) - 1)).bit_count()
        return ones

    def _select(self, level: int, bit: int, which: np.ndarray) -> np.ndarray:
        """The places of the ones (bit 1) or zeros (bit 0) of a plane with the given rising numbers, from 0."""
        before = self._ones(level)
        if not bit:
            before = np.minimum(np.arange(len(before)) * 8 * self.chunk, self.n) - before
        chunk = np.searchsorted(before, which, "right") - 1
        out = np.empty(len(which), np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1], [True]]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            c = int(chunk[a])
            left = min(8 * self.chunk, self.n - c * 8 * self.chunk)
            places = np.flatnonzero(np.unpackbits(self._bits(level, c), count=left, bitorder="little") == bit)
            out[a:b] = places[which[a:b] - before[c]] + c * 8 * self.chunk
        return out

    def _zeros(self, level: int) -> int:
        return self.n - int(self._ones(level)[-1])

    def access(self, i: int) -> int:
        """The token id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        symbol = 0
        for level in range(self.width):
            chunk, rest = divmod(i, 8 * self.chunk)
            bit = int(self._bits(level, chunk)[rest // 8]) >> (rest % 8) & 1
            ones = self._rank1(level, i)
            symbol, i = symbol * 2 + bit, self._zeros(level) + ones if bit else i - ones
        return int(self.symbols[symbol])

    def _range(self, token: int, upto: int) -> tuple[int, int, int] | None:
        """(symbol, begin, end) of the token's first occurrences, up to position upto, in the order below the last plane."""
        found = np.flatnonzero(self.symbols == token)
        if not len(found):
            return None
        symbol, lo, hi = int(found[0]), 0, upto
        for level in range(self.width):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            one = symbol >> (self.width - 1 - level) & 1
            lo, hi = (self._zeros(level) + a, self._zeros(level) + b) if one else (lo - a, hi - b)
        return symbol, lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences of token among the first i ids."""
        if not 0 <= i <= self.n:
            raise IndexError(i)
        r = self._range(token, i)
        return r[2] - r[1] if r else 0

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _places(self, token: int, first: int, last: int) -> np.ndarray:
        r = self._range(token, self.n)
        if not r or not 0 <= first <= last <= r[2] - r[1]:
            raise IndexError(first)
        symbol, at = r[0], np.arange(r[1] + first, r[1] + last)
        for level in range(self.width - 1, -1, -1):
            bit = symbol >> (self.width - 1 - level) & 1
            at = self._select(level, bit, at - self._zeros(level) if bit else at)
        return at

    def select(self, token: int, k: int) -> int:
        """The position of occurrence k (from 0) of token."""
        if k < 0:
            raise IndexError(k)
        return int(self._places(token, k, k + 1)[0])

    def occurrences(self, token: int) -> list[int]:
        """All positions of token, found together plane by plane."""
        return self._places(token, 0, self.count(token)).tolist() if self.count(token) else []


#: White space in any of the regex dialects concerned; a piece may be cut before a space or newline that follows none of it.
SPACE = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u180e\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CUT = re.compile(f"(?<=[^{SPACE}])(?=[ \\n])")
LETTER, DIGIT = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f", "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
PLAIN = re.compile("[ \\n]?[!-~\\xa1-\\u024f]+\\Z")
#: White space before a space or newline: such texts are cut by CUT instead.
DOUBLED = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}][ \\n]"
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{DIGIT}]+| ?[^ \\n{LETTER}{DIGIT}]+|\\n")
#: Classes of bytes: newline, space, letter, digit, other visible ASCII; PART: of a longer character; ODD: for the library.
NEWLINE, BLANK, ALPHA, NUMBER, OTHER, PART, ODD = range(7)


def _byte_classes() -> bytes:
    def kind(b: int) -> int:
        c = chr(b)
        if b >= 128:
            return PART
        if c == "'" or not (33 <= b < 127 or c in " \n"):
            return ODD
        return NEWLINE if c == "\n" else BLANK if c == " " else ALPHA if c.isalpha() else NUMBER if c.isdigit() else OTHER

    return bytes(map(kind, range(256)))


CLASSES = _byte_classes()
#: Classes of the characters of two bytes from U+00A1 to U+024F; all others are for the library.
TWO_BYTE = np.full(0x800, ODD, np.uint8)
TWO_BYTE[0xA1:0x250] = [ALPHA if re.match(f"[{LETTER}]", chr(c)) else NUMBER if re.match(f"[{DIGIT}]", chr(c)) else OTHER for c in range(0xA1, 0x250)]


def words_of(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first bytes of the words that byte-level pre-tokenisation makes, whether the library must take a word apart).

    A piece (text up to the next space or newline) with an apostrophe or a character out of the ordinary is left whole.
    """
    n = len(raw)
    kind = np.frombuffer(raw.tobytes().translate(CLASSES), np.uint8).copy()
    part = np.flatnonzero(kind == PART)
    if len(part):
        lead = part[(raw[part] >= 0xC0) & (raw[part] < 0xE0)]
        two = TWO_BYTE[((raw[lead].astype(np.int32) & 31) << 6) | (raw[lead + 1] & 63)]
        kind[lead], kind[lead + 1] = two, two
        kind[part[kind[part] == PART]] = ODD
    rows = offs[:-1][np.diff(offs) > 0]
    cut = kind <= BLANK
    cut[rows] = True
    begin = np.empty(n, bool)
    begin[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begin[1:])
    begin[1:] &= kind[:-1] != BLANK
    begin |= cut
    odd = np.flatnonzero(kind == ODD)
    if not len(odd):
        starts = np.flatnonzero(begin)
        return starts, np.zeros(len(starts), bool)
    pieces = np.flatnonzero(cut)
    whole = np.zeros(len(pieces), bool)
    whole[np.searchsorted(pieces, odd, "right") - 1] = True
    inside = np.repeat(whole, np.diff(np.append(pieces, n)))
    begin &= ~inside | cut
    starts = np.flatnonzero(begin)
    return starts, inside[starts]


def _byte_alphabet() -> str:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 as is, the rest from U+0100 up."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return "".join(chr(b) if b in keep else chr(256 + rest.index(b)) for b in range(256))


class WordStore:
    """The ids of words by hash, checked on the words' bytes. Sorted runs of keys are merged when they grow alike."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.flat, self.text = np.zeros(0, np.uint32), np.zeros(0, np.uint8)
        self.begin = self.size = self.place = self.long = np.zeros(0, np.int64)

    def find(self, keys: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The numbers of rising distinct keys in the store; -1: not there, -2: there with other bytes."""
        got = np.full(len(keys), -1, np.int64)
        for have, number in self.levels:
            at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
            hit = have[at] == keys
            got[hit] = number[at[hit]]
        known = np.flatnonzero(got >= 0)
        size, number = (ends - starts)[known], got[known]
        same = self.long[number] == size
        got[known[~same]] = -2
        known, size, number = known[same], size[same], number[same]
        if len(known):
            upto = np.cumsum(size)
            step = np.arange(int(upto[-1])) - np.repeat(upto - size, size)
            differ = self.text[np.repeat(self.place[number], size) + step] != raw[np.repeat(starts[known], size) + step]
            if differ.any():
                got[known[np.add.reduceat(differ, upto - size) > 0]] = -2
        return got

    def add(self, keys: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, ids: list[list[int]]) -> np.ndarray:
        """The numbers of new words, whose keys rise."""
        sizes, lens, base = np.fromiter(map(len, ids), np.int64, len(ids)), ends - starts, len(self.size)
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))
        upto = np.cumsum(lens)
        text = raw[np.repeat(starts - (upto - lens), lens) + np.arange(int(upto[-1]))]
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(sizes) - sizes])
        self.place = np.concatenate([self.place, len(self.text) + upto - lens])
        self.size, self.long = np.concatenate([self.size, sizes]), np.concatenate([self.long, lens])
        self.flat, self.text = np.concatenate([self.flat, flat]), np.concatenate([self.text, text])
        number = np.arange(base, base + len(keys))
        self.levels.append((keys, number))
        while len(self.levels) > 1 and 2 * len(self.levels[-1][0]) > len(self.levels[-2][0]):
            (a, x), (b, y) = self.levels.pop(), self.levels.pop()
            both, numbers = np.concatenate([a, b]), np.concatenate([x, y])
            order = np.argsort(both)
            self.levels.append((both[order], numbers[order]))
        return number

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of words in order, and ids per word."""
        each = self.size[numbers]
        upto = np.cumsum(each)
        return self.flat[np.repeat(self.begin[numbers] - (upto - each), each) + np.arange(int(upto[-1]) if len(upto) else 0)], each


class PieceEncoder:
    """Encodes texts like Tokenizer.encode(add_special_tokens=False), each distinct word of many texts once.

    Byte-level pre-tokenisation always ends a token before white space that follows other text, and between runs of
    letters, digits and other characters, so the words of ordinary text are found by byte classes and given to the
    vocabulary's own model. Other pieces go through the whole library, texts that name a special token as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        spec = json.loads(self.whole.to_str())
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        self.byte_level = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and model.get("type") == "BPE" and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding")
        self.model, self.alphabet = self.whole.model, _byte_alphabet()
        self.points = np.array([ord(c) for c in self.alphabet], "<u4")
        self.store = WordStore()

    def _piece(self, piece: str) -> list[int]:
        if not PLAIN.match(piece):
            return self.whole.encode(piece, add_special_tokens=False).ids
        return [t.id for word in WORDS.findall(piece) for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.alphabet))]

    def _slow(self, text: str) -> list[int]:
        if not self.byte_level or any(s in text for s in self.specials):
            return self.whole.encode(text, add_special_tokens=False).ids
        return [i for piece in CUT.split(text) for i in self._piece(piece)]

    def _new(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, odd: np.ndarray) -> list[list[int]]:
        lens = ends - starts
        upto = np.cumsum(lens)
        text = raw[np.repeat(starts - (upto - lens), lens) + np.arange(int(upto[-1]))]
        shown, plain = self.points[text].tobytes().decode("utf-32-le"), text.tobytes()
        tokenize, out = self.model.tokenize, []
        for a, b, x in zip((upto - lens).tolist(), upto.tolist(), odd.tolist()):
            out.append(self._piece(plain[a:b].decode()) if x else [t.id for t in tokenize(shown[a:b])])
        return out

    def _fast(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, offs = string_bytes(col)
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(offs) - 1, np.int64)
        starts, odd = words_of(raw, offs)
        ends = np.append(starts[1:], len(raw))
        keys, first, back = np.unique(span_hashes(raw, starts, ends), return_index=True, return_inverse=True)
        starts_, ends_, odd_ = starts[first], ends[first], odd[first]
        if ((ends - starts) != (ends_ - starts_)[back]).any():  # two words of one hash
            return self._each(col)
        numbers = self.store.find(keys, raw, starts_, ends_)
        new = np.flatnonzero(numbers == -1)
        if len(new):
            numbers[new] = self.store.add(keys[new], raw, starts_[new], ends_[new], self._new(raw, starts_[new], ends_[new], odd_[new]))
        if (numbers == -2).any():
            return self._each(col)
        flat, each = self.store.gather(numbers[back])
        if len(self.store.size) > CACHED:
            self.store.clear()
        upto = np.concatenate([[0], np.cumsum(each)])
        return flat, np.diff(upto[np.searchsorted(starts, offs)])

    def _each(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        got = [np.array(self._slow(t), np.uint32) for t in col.to_pylist()]
        return np.concatenate(got) if got else np.zeros(0, np.uint32), np.array([len(x) for x in got], np.int64)

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and ids per text."""
        col = col.fill_null("")
        slow = pc.match_substring_regex(col, DOUBLED).to_numpy(zero_copy_only=False).astype(bool)
        for s in self.specials:
            slow |= pc.match_substring(col, s).to_numpy(zero_copy_only=False).astype(bool)
        if not self.byte_level:
            slow[:] = True
        if not slow.any():
            return self._fast(col)
        parts = [self._fast(col.filter(pa.array(~slow))), self._each(col.filter(pa.array(slow)))]
        per = np.zeros(len(col), np.int64)
        per[~slow], per[slow] = parts[0][1], parts[1][1]
        out = np.empty(int(per.sum()), np.uint32)
        of_slow = np.repeat(slow, per)
        out[~of_slow], out[of_slow] = parts[0][0], parts[1][0]
        return out, per


_ENCODERS: dict[str, PieceEncoder] = {}


def _encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


SHARD_SCHEMA = "part int, seq int, n_docs long, n_tokens long, image binary"


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write doc_id, text as wavelet-matrix shards in ascending doc_id order (nulls first) and return the shard table.

    tokenizer: the vocabulary file's path, the same on every executor. Equal doc_ids are ordered by a hash of
    their text, so that repeated ids do not pile up in one range. Null text counts as empty: only the end id.
    An empty table gives a table without shards. Other columns are ignored. Each file of the table holds one shard;
    export_shards() writes the bare files.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = _encoder(tokenizer), TaskContext.get().partitionId()
        held: list[tuple] = []
        seq = tokens = 0

        def shard() -> pa.RecordBatch:
            ids, docs_, null, per = (np.concatenate(x) for x in zip(*held))
            image = shard_image(ids, docs_, null, per)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(docs_)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([image], pa.binary())], ["part", "seq", "n_docs", "n_tokens", "image"])

        for batch in batches:
            for piece in slabs(batch, batch.schema.names.index("text")):
                flat, per = enc.encode(piece.column("text"))
                ends = np.cumsum(per + 1)
                ids = np.full(len(flat) + len(per), end_id, np.uint32)
                keep = np.ones(len(ids), bool)
                keep[ends - 1] = False
                ids[keep] = flat
                col = piece.column("doc_id")
                held.append((ids, col.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), col.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), per + 1))
                tokens += len(ids)
                if tokens >= shard_tokens:
                    yield shard()
                    held, tokens, seq = [], 0, seq + 1
        if held:
            yield shard()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("_tie", F.xxhash64("text"))
    ranged = rows.repartitionByRange(shuffle_partitions(rows), "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    return written(map_arrow(ranged.select("doc_id", "text"), encode, SHARD_SCHEMA), "none", maxRecordsPerFile=1)


def export_shards(shards: DataFrame, folder: str) -> DataFrame:
    """Write each shard as a file of its own, folder/part-seq.wmx, and return part, seq, path, n_bytes.

    folder: a URI in a store that pyarrow reaches from every executor. A retried task writes the same files again,
    each under another name first, so that no reader meets half a file. WaveletMatrix.open() reads them in parts.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        store, root = FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for part, seq, image in zip(*(batch.column(i).to_pylist() for i in range(3))):
                name = f"{part:06d}-{seq:06d}.wmx"
                with store.open_output_stream(f"{root}/_{name}") as out:
                    out.write(image)
                store.move(f"{root}/_{name}", f"{root}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([f"{folder.rstrip('/')}/{name}"]), pa.array([len(image)], pa.int64())], ["part", "seq", "path", "n_bytes"])

    return written(map_arrow(shards.select("part", "seq", "image"), put, "part int, seq int, path string, n_bytes long"))


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the shard images."""
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    # a row per written partition, not per document
    starts = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("part_start"))
    within = Window.partitionBy("part").orderBy("seq")
    offsets = shards.select("part", "seq", "n_tokens").withColumn("seq_start", F.sum("n_tokens").over(within) - F.col("n_tokens"))
    offsets = offsets.join(starts, "part").select("part", "seq", (F.col("part_start") + F.col("seq_start")).alias("shard_start"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, image in zip(*(batch.column(i).to_pylist() for i in range(3))):
                wm = WaveletMatrix.from_bytes(image)
                ids = wm.decode().astype("<u4")
                ends = np.cumsum(wm.doc_tokens)
                begins = ends - wm.doc_tokens
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
                null = wm.doc_null.astype(bool)
                k = len(ends)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, part, np.int32)), pa.array(np.full(k, seq, np.int32)), pa.array(wm.doc_ids, mask=null), pa.array(begins), pa.array(wm.doc_tokens), pa.array(crcs, pa.int64())], ["part", "seq", "doc_id", "begin", "n_tokens", "ids_crc32"])

    docs = map_arrow(shards.select("part", "seq", "image"), digest, "part int, seq int, doc_id long, begin long, n_tokens long, ids_crc32 long")
    return docs.join(offsets, ["part", "seq"]).select("doc_id", (F.col("shard_start") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_output(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the documents' ids as shards and return each document's place, length and checksum as read back."""
    return read_documents(write_shards(docs, str(tokenizer or default_tokenizer())))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place, length and checksum of every document's ids, read back from the shards; see write_shards()."""
    return token_output(spark.read.parquet(f"{sf_dir}/documents.parquet"))
