"""Token ids in Simple-8b files.

A 64-bit word holds a selector in its top four bits and as many ids as the selector says in the
other sixty: 60 of one bit, 30 of two, and so on to one of 60.  Selector 0 is an escape:
the id, of over 60 bits, is the next of the file's escape list.  The greatest
number of ids that fit is taken.  Blocks of 8192 ids start a word, and a table keeps
each block's first word and first escape, so blocks decode on their own, all words of one
selector at once.

File: magic, words, escapes, then a footer of block table, document ids (with
a byte each that says whether it is null) and lengths, and the counts.  Documents of a file are in
ascending id order, and files in the order of their names.

Edge cases: null and empty texts are the end id alone; null ids come first; equal ids are
ordered by a hash of their text; an empty table writes no file and gives no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_sizes, scratch_path, slices
from .store import create, listing, open_read
from .textscan import IS_SPACE, buffer_of, mix

MAGIC = b"TLS8B\x00\x00\x01"
BLOCK = 8192
#: Count and bits of selectors 1 to 14: fixed values of the code.
PACKS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
_COUNT = np.array([1, *(c for c, _ in PACKS)] + [0], dtype=np.int64)


_SMALL = np.array([max(1, x.bit_length()) for x in range(1 << 16)], dtype=np.uint8)


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits of each uint64, 1 at least."""
    out = np.zeros(len(values), dtype=np.uint8)
    for shift in (0, 16, 32, 48):
        part = (values >> np.uint64(shift)).astype(np.uint16)
        out = np.where(part > 0, _SMALL[part] + np.uint8(shift), out) if shift else _SMALL[part]
        if not (values >> np.uint64(shift + 15) >> np.uint64(1)).any():
            break
    return out


def encode_block(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """uint64 values to (words, escapes)."""
    n = len(values)
    bits_of = bit_lengths(values)
    choice = np.zeros(n, dtype=np.int8)  # 0: escape
    widest = {1: bits_of}  # the most bits in the next 1, 2, 4 ... values of each place
    for s in range(len(PACKS), 0, -1):  # from wide to dense; the densest that fits is set last
        count, bits = PACKS[s - 1]
        if count > n:
            break
        half = 1 << count.bit_length() - 1
        if half not in widest:
            last = widest[half // 2]
            widest[half] = np.maximum(last[: -half // 2], last[half // 2 :])
        most = widest[half]
        fits = np.maximum(most[: n - count + 1], most[count - half :]) <= bits
        if not fits.any():  # nor does a denser one, which takes more values of fewer bits
            break
        np.copyto(choice[: n - count + 1], s, where=fits)
    step = _COUNT.astype(np.uint8)[choice].tobytes()
    at, i = [], 0
    while i < n:
        at.append(i)
        i += step[i]
    at = np.array(at, dtype=np.int64)
    picked = choice[at]
    words = picked.astype(np.uint64) << np.uint64(60)
    for s in np.unique(picked):
        if s:
            count, bits = PACKS[s - 1]
            rows = np.flatnonzero(picked == s)
            first, packed = at[rows], words[rows]
            for k in range(count):
                packed |= values[first + k] << np.uint64(k * bits)
            words[rows] = packed
    return words, values[bits_of > 60]


def decode_block(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    picked = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNT[picked]
    start = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), dtype=np.uint64)
    for s in np.unique(picked):
        rows = np.flatnonzero(picked == s)
        if s == 0:
            out[start[rows]] = escapes[: len(rows)]
            continue
        count, bits = PACKS[s - 1]
        shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
        out[start[rows][:, None] + np.arange(count)] = (words[rows][:, None] >> shifts) & np.uint64((1 << bits) - 1)
    return out


class Writer:
    """Writes documents one after another, holding one block of ids."""

    def __init__(self, file: BinaryIO) -> None:
        self.file, self.words, self.total, self.held, self.held_n = file, 0, 0, [], 0
        self.escapes: list[np.ndarray] = []
        self.blocks: list[tuple[int, int]] = []
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        file.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.lengths.append(len(ids))
        self.total += len(ids)
        self.held.append(ids)
        self.held_n += len(ids)
        if self.held_n >= BLOCK:
            flat = np.concatenate(self.held).astype(np.uint64)
            whole = len(flat) // BLOCK * BLOCK
            for i in range(0, whole, BLOCK):
                self._block(flat[i : i + BLOCK])
            self.held, self.held_n = [flat[whole:]], len(flat) - whole

    def _block(self, values: np.ndarray) -> None:
        words, escapes = encode_block(values)
        self.blocks.append((self.words, sum(map(len, self.escapes))))
        self.file.write(words.astype("<u8").tobytes())
        self.words += len(words)
        if len(escapes):
            self.escapes.append(escapes)

    def close(self) -> None:
        if self.held_n:
            self._block(np.concatenate(self.held).astype(np.uint64))
        escapes = np.concatenate(self.escapes) if self.escapes else np.zeros(0, np.uint64)
        self.file.write(escapes.astype("<u8").tobytes())
        self.file.write(np.array([*self.blocks, (self.words, len(escapes))], dtype="<u8").tobytes())
        self.file.write(np.array([0 if x is None else x for x in self.ids], dtype="<i8").tobytes())
        self.file.write(np.array([x is None for x in self.ids], dtype="u1").tobytes())
        self.file.write(np.array(self.lengths, dtype="<u8").tobytes())
        self.file.write(np.array([self.words, len(escapes), len(self.blocks), len(self.ids), self.total], dtype="<u8").tobytes())


class Reader:
    def __init__(self, file: BinaryIO) -> None:
        self.file = file
        file.seek(0)
        if file.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a Simple-8b token file")
        file.seek(-40, 2)
        self.n_words, self.n_escapes, n_blocks, n_docs, self.total = np.frombuffer(file.read(40), dtype="<u8").tolist()
        at = len(MAGIC) + 8 * self.n_words
        file.seek(at)
        self.escapes = np.frombuffer(file.read(8 * self.n_escapes), dtype="<u8")
        self.blocks = np.frombuffer(file.read(16 * (n_blocks + 1)), dtype="<u8").reshape(-1, 2).astype(np.int64)
        ids = np.frombuffer(file.read(8 * n_docs), dtype="<i8")
        null = np.frombuffer(file.read(n_docs), dtype="u1")
        self.ids = [None if z else int(x) for x, z in zip(ids, null, strict=True)]
        self.lengths = np.frombuffer(file.read(8 * n_docs), dtype="<u8").astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))

    def block(self, k: int) -> np.ndarray:
        (a, e), (b, f) = self.blocks[k].tolist(), self.blocks[k + 1].tolist()
        self.file.seek(len(MAGIC) + 8 * a)
        return decode_block(np.frombuffer(self.file.read(8 * (b - a)), dtype="<u8"), self.escapes[e:f])

    def span(self, start: int, end: int) -> Iterator[np.ndarray]:
        """The ids from ``start`` up to ``end``, block by block."""
        for k in range(start // BLOCK, -(-end // BLOCK)):
            yield self.block(k)[max(0, start - k * BLOCK) : end - k * BLOCK]

    def documents(self) -> Iterator[tuple[int | None, int, int, Iterator[np.ndarray]]]:
        """(id, start in the file, length, pieces of ids), decoding each block once."""
        k, block = -1, np.zeros(0, np.uint64)

        def pieces(start: int, end: int) -> Iterator[np.ndarray]:
            nonlocal k, block
            for b in range(start // BLOCK, -(-end // BLOCK)):
                if b != k:
                    k, block = b, self.block(b)
                yield block[max(0, start - b * BLOCK) : end - b * BLOCK]

        for i, doc_id in enumerate(self.ids):
            yield doc_id, int(self.starts[i]), int(self.lengths[i]), pieces(int(self.starts[i]), int(self.starts[i + 1]))


#: What ``\s`` is to the tokenizers library: Unicode's White_Space.
SPACE = "\t-\r \x85\xa0  -     　"
_inner = re.compile(f" (?=[^{SPACE}])")
_odd = re.compile(f" (?:[{SPACE}]|\\Z)")
#: The pre-tokenizer's pattern, a fixed value of byte-level BPE, with white space spelt out.
_split = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


class Remembered(dict):
    """What ``make`` gives for short strings, held in two generations of bounded size."""

    MOST, LONGEST = 400_000, 64

    def __init__(self, make) -> None:
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


def byte_letters() -> list[str]:
    """The printable letter that byte-level BPE files write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


_LETTERS = {i: c for i, c in enumerate(byte_letters())}


class Encoder:
    """The tokenizers library over a byte-level BPE file, with ids of repeated pieces remembered.

    Its pre-tokenizer never lets a token reach over a space that a non-space follows, so a
    text is cut before each such space, and each distinct pre-token goes through the
    library's model once.  Special tokens are cut out first, as the library does.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.special = {k: np.array([v], dtype="<u4").tobytes() for k, v in special.items()}
        self.cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(special, key=len, reverse=True)) + ")") if special else None
        model = self.library.model

        def ids(letters: str) -> bytes:
            return array("I", [x.id for x in model.tokenize(letters)]).tobytes()

        def in_letters(text: str) -> str:
            return text if text.isascii() and text.isalpha() else text.encode().decode("latin-1").translate(_LETTERS)

        def tokenize(t: str) -> bytes:
            return self.pieces[t[1:]] if t[0] == " " and t[1:].isalpha() else ids(in_letters(t))

        def after_space(piece: str) -> bytes:
            """Of a space and ``piece``, which begins with none."""
            if piece.isalpha():
                return ids("\u0120" + in_letters(piece))
            if piece[:-1].isalpha() and piece[-1] in ".,":
                return self.pieces[piece[:-1]] + self.tokens[piece[-1]]
            return self.encode(" " + piece)

        self.tokens = Remembered(tokenize)
        self.pieces = Remembered(after_space)

    def encode(self, text: str) -> bytes:
        """Without remembering the whole."""
        return b"".join(map(self.tokens.__getitem__, _split.findall(text)))

    def _plain(self, text: str) -> bytes:
        pieces = _inner.split(text) if _odd.search(text) else text.split(" ")
        return self.encode(pieces[0]) + b"".join(map(self.pieces.__getitem__, pieces[1:]))

    def __call__(self, text: str) -> np.ndarray:
        if self.cut is None or not self.cut.search(text):
            return np.frombuffer(self._plain(text), dtype="<u4")
        return np.frombuffer(b"".join(self.special.get(x) or self._plain(x) for x in self.cut.split(text) if x), dtype="<u4")


#: White space of two and three bytes, as whole numbers.
_WIDE = [np.array([int.from_bytes(c.encode()) for c in map(chr, range(128, 0x3001)) if re.match(f"[{SPACE}]", c) and len(c.encode()) == n]) for n in (2, 3)]

_LETTER, _MARK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[list(b'.,;:!?)"\n')] = True


class Batches:
    """Ids of whole Arrow arrays of texts: what :class:`Encoder` gives, words looked up all at once.

    Words of up to 16 bytes are known by their first and last eight bytes and their length, so they
    are compared exactly.  They stand in an open-addressed table of bounded size, which
    is emptied when full; longer words and texts with special tokens go through the encoder one by one.
    """

    SLOTS, MOST, CHUNK, SHORT, FIRST = 1 << 21, 1 << 20, 1 << 18, 16, 32

    def __init__(self, encode: Encoder) -> None:
        self.encode = encode
        self.head, self.tail = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.uint64)
        self.kind = np.zeros(self.SLOTS, np.uint8)  # length, and FIRST for a word that no space leads; 0: a free slot
        self.at, self.many = np.zeros(self.SLOTS, np.int32), np.zeros(self.SLOTS, np.uint8)
        self.pool = np.zeros(1 << 20, dtype="<u4")
        self.clear()

    def clear(self) -> None:
        self.kind[:] = 0
        self.held = self.used = 0

    def _put(self, ids: array, many: np.ndarray) -> tuple[np.ndarray, int]:
        """Writes ids behind those in use; where each word's start, and the new end."""
        end = self.used + len(ids)
        if end > len(self.pool):
            self.pool = np.concatenate((self.pool[: self.used], np.zeros(2 * end - self.used, dtype="<u4")))
        self.pool[self.used : end] = ids
        return self.used + np.cumsum(many) - many, end

    def _find(self, head: np.ndarray, tail: np.ndarray, kind: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """The slot of each word, -1 if it has none."""
        out, todo = np.full(len(head), -1), np.arange(len(head))
        while len(todo):
            s = slot[todo]
            hit = (self.kind[s] == kind[todo]) & (self.head[s] == head[todo]) & (self.tail[s] == tail[todo])
            out[todo[hit]] = s[hit]
            on = ~hit & (self.kind[s] != 0)
            todo, slot = todo[on], slot.copy()
            slot[todo] = (slot[todo] + 1) & (self.SLOTS - 1)
        return out

    def _insert(self, head: np.ndarray, tail: np.ndarray, kind: np.ndarray, slot: np.ndarray, ids: array, many: np.ndarray) -> None:
        """Distinct words that have no slot."""
        at, self.used = self._put(ids, many)
        self.held += len(head)
        todo, slot = np.arange(len(head)), slot.copy()
        while len(todo):
            free = todo[self.kind[slot[todo]] == 0]
            won = free[np.unique(slot[free], return_index=True)[1]]
            s = slot[won]
            self.head[s], self.tail[s], self.kind[s], self.at[s], self.many[s] = head[won], tail[won], kind[won], at[won], many[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & (self.SLOTS - 1)

    def _make(self, raw: str, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[array, np.ndarray]:
        """The ids of words by the library's model, one after another, and how many each has."""
        tokenize, encode, make = self.encode.library.model.tokenize, self.encode.encode, self.encode.pieces.make
        ids, many = array("I"), []
        for i, j, f in zip(start.tolist(), end.tolist(), first.tolist(), strict=True):
            word = raw[i:j]
            if word.isascii() and word.isalpha():
                found = [x.id for x in tokenize(word if f else "\u0120" + word)]
                ids.extend(found)
                many.append(len(found))
            else:
                word = word.encode("latin-1").decode()
                found = encode(word) if f else make(word)
                ids.frombytes(found)
                many.append(len(found) // 4)
        return ids, np.array(many, dtype=np.int64)

    def _words(self, data: np.ndarray, raw: str, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of one chunk of words: how many ids each has, and all ids."""
        eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        n = end - start
        short = np.flatnonzero(n <= self.SHORT)
        size, a, b = n[short], start[short], end[short]
        head = eight[a] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - np.minimum(size, 8)) * 8 % 64).astype(np.uint64))
        head[size == 0] = 0
        tail = np.where(size > 8, eight[np.maximum(b - 8, 0)], np.uint64(0))
        kind = (size + self.FIRST * first[short]).astype(np.uint8)
        mark = mix(head ^ mix(tail + kind))
        slot = (mark & np.uint64(self.SLOTS - 1)).astype(np.int64)
        found = self._find(head, tail, kind, slot)
        while len(lost := np.flatnonzero(found < 0)):
            new = lost[np.unique(mark[lost], return_index=True)[1]]
            if self.held + len(new) > self.MOST:
                self.clear()
                found[:] = -1
                continue
            self._insert(head[new], tail[new], kind[new], slot[new], *self._make(raw, a[new], b[new], first[short[new]]))
            found[lost] = self._find(head[lost], tail[lost], kind[lost], slot[lost])  # words of equal marks, if ever, take another round
        at, many = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        at[short], many[short] = self.at[found], self.many[found]
        rest = np.flatnonzero(n > self.SHORT)
        if len(rest):
            spans = zip(start[rest].tolist(), end[rest].tolist(), first[rest].tolist(), strict=True)
            blobs = [self.encode.encode(w) if f else self.encode.pieces[w] for w, f in ((raw[i:j].encode("latin-1").decode(), f) for i, j, f in spans)]
            many[rest] = [len(b) // 4 for b in blobs]
            at[rest], _ = self._put(array("I", b"".join(blobs)), many[rest])
        return many, self.pool[np.repeat(at - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null is empty."""
        data, offsets = buffer_of(texts)
        if not len(texts):
            return []
        size = len(data)
        data = np.concatenate((data, np.zeros(16, np.uint8)))
        raw = data.tobytes().decode("latin-1")  # a letter a byte
        cut = np.flatnonzero(data[:size] == 32)
        after = data[cut + 1]
        good = ~IS_SPACE[after]
        wide = np.flatnonzero(good & np.isin(after, (0xC2, 0xE1, 0xE2, 0xE3)))
        codes = data[cut[wide][:, None] + (1, 2, 3)].astype(np.int64) @ (65536, 256, 1)
        good[wide] = ~(np.isin(codes >> 8, _WIDE[0]) | np.isin(codes, _WIDE[1]))
        # Nor does a token reach from a letter to a mark, or from a line's end, if no other space is beside it, to a letter.
        bare = np.zeros(size, dtype=bool)
        letter = _LETTER[data[:size]]
        bare[1:] = letter[:-1] & _MARK[data[1:size]]
        bare[2:] |= (data[1 : size - 1] == 10) & letter[2:] & (data[: size - 2] < 128) & ~IS_SPACE[data[: size - 2]]
        bare[offsets[1:] - 1] = False
        bare[offsets[:-1]] = False
        begins = bare.copy()
        begins[cut[good] + 1] = True
        begins[offsets[:-1]] = True
        start = np.flatnonzero(begins)
        first = bare[start]
        end = np.append(start[1:] - ~first[1:], size - 1)  # a cut, a space, or the newline behind each text
        head = np.searchsorted(start, offsets[:-1])
        first[head] = True
        parts = [self._words(data, raw, start[i : i + self.CHUNK], end[i : i + self.CHUNK], first[i : i + self.CHUNK]) for i in range(0, len(start), self.CHUNK)]
        many, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        upto = np.concatenate(([0], np.cumsum(many)))[np.append(head, len(start))]
        out = [ids[i:j] for i, j in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
        for token in self.encode.special:
            token = token.encode().decode("latin-1")
            at = raw.find(token)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, side="right")) - 1
                out[row] = self.encode(texts[row].as_py())
                at = raw.find(token, int(offsets[row + 1]))
        return out


_encoders: dict[str, Batches] = {}


def encoder(path: str) -> Batches:
    """One a worker process and file."""
    if path not in _encoders:
        _encoders[path] = Batches(Encoder(path))
    return _encoders[path]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int, int]]:
    """Encodes ``docs`` in ascending id order into ``folder``; (file, first id's place, ids) of each file, in order.

    The order is by range partitions, so each task writes one file; what comes to the
    driver is a row a file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        uri = f"{folder}/part-{TaskContext.get().partitionId():08d}.s8b"
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        with create(uri) as f:
            writer = Writer(f)
            while first is not None:
                texts, known = first.column(1), first.column(0).to_pylist()
                for a, b in slices(byte_sizes(texts), 2 << 20):
                    for doc_id, ids in zip(known[a:b], encode(texts.slice(a, b - a)), strict=True):
                        writer.add(doc_id, np.append(ids, np.uint32(end_id)))
                first = next((b for b in batches if b.num_rows), None)
            writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([writer.total], pa.int64())], names=["file", "n"])

    tie = F.xxhash64("text")
    ranged = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).repartitionByRange(F.col("id"), tie).sortWithinPartitions("id", tie)
    files = sorted((r.file, r.n) for r in ranged.mapInArrow(run, "file string, n bigint").collect())
    out, at = [], 0
    for file, n in files:
        out.append((file, at, n))
        at += n
    return out


def read_tokens(spark: SparkSession, files: list[tuple[str, int, int]], id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) of each document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open_read(uri) as f:
                    rows = []
                    for doc_id, start, n, pieces in Reader(f).documents():
                        crc = 0
                        for piece in pieces:
                            crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                        rows.append((doc_id, base + start, n, crc))
                    for i in range(0, len(rows), 10_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + 10_000], strict=True)], names=[id_col, "start", "n_tokens", "ids_crc32"])

    given = spark.createDataFrame([(f, s) for f, s, _ in files], "file string, start bigint")
    return given.repartition(max(1, len(files)), "file").mapInArrow(run, f"`{id_col}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def known_files(spark: SparkSession, folder: str) -> list[tuple[str, int, int]]:
    """Files of an earlier run, as :func:`write_tokens` gave them."""
    out, at = [], 0
    for uri, _ in listing(spark, folder, ".s8b"):
        with open_read(uri) as f:
            n = Reader(f).total
        out.append((uri, at, n))
        at += n
    return out


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    spark = docs.sparkSession
    return read_tokens(spark, write_tokens(docs, scratch_path(spark, "tokens"), tokenizer, end_id))
