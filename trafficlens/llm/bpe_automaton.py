"""Byte-pair encoding by a deterministic automaton that is built merge by merge.

The automaton reads token labels.  At first one state takes every base symbol.  The gadget
of a merge (u, v) splits the state that u leads to: its copy lacks the arc v, so u can no
longer be followed by v, and wherever an arc u is, an arc uv is added that leads to where v
would have led.  After all merges, just the token sequences that BPE makes are accepted.  All arcs of
one label lead to one state, so a state is named by the token that leads to it, and a gadget
is three entries: from which state it was copied, when, and which arc is cut.
Whether a state has an arc is looked up by unwinding the gadgets, younger first, once, and
then kept in the arc table.

A word is encoded from left to right: the state after each prefix is the one label that
ends there and whose arc leaves the state where it begins; longer labels are tried first.
States are read off the table, no merge is replayed.  Labels of the path back from the
end are the tokens.  Decoding emits the labels of the ids.

Texts are normalised (NFC, lower case) and cut into words as the tokenizer file says; the
forms supported are those of ``word_bpe_49k.json``: a BPE with an end-of-word suffix, special
tokens taken from the raw text, and no decoder, which joins labels by a space.

Edge cases: null and empty texts have no tokens and decode to an empty text; ids of repeated rows
are equal; other columns are ignored or, if named like the operator's own, replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .simple8b import SPACE, Remembered, byte_letters

_LETTERS = {i: c for i, c in enumerate(byte_letters())}


MOST_ARCS = 1_000_000


class Automaton:
    """States and arcs over the ids of a BPE vocabulary."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        self.vocab, self.suffix = vocab, suffix
        self.made: dict[int, int] = {}  # when a token's label came to be; base symbols are absent
        self.left: dict[int, int] = {}
        self.copied: dict[int, int] = {}  # the state that a state was copied from
        self.cut: dict[tuple[int, int], int] = {}
        self.arcs: dict[int, bool] = {}
        for when, (u, v) in enumerate(merges):
            self.gadget(when, vocab[u], vocab[v], vocab[u + v])
        self.longest = max(len(t) for t in vocab)

    def gadget(self, when: int, u: int, v: int, joined: int) -> None:
        if joined not in self.made:
            self.made[joined], self.left[joined], self.copied[joined] = when, u, v
        self.cut.setdefault((u, v), when)

    def has_arc(self, state: int, label: int) -> bool:
        """In the finished automaton."""
        key = state << 32 | label
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) >= MOST_ARCS:
                self.arcs.clear()
            known = self.arcs[key] = self._unwind(state, label)
        return known

    def _unwind(self, state: int, label: int) -> bool:
        upto = len(self.cut) + len(self.made) + 1
        while True:
            if self.cut.get((state, label), upto) < upto:
                return False
            s, t = self.made.get(state, -1), self.made.get(label, -1)
            if s < 0 and t < 0:
                return True
            if t >= s:  # the label is younger: its arcs were laid beside those of its left half
                label, upto = self.left[label], t + 1
            else:  # the state is younger: it was copied with its arcs
                state, upto = self.copied[state], s

    def encode(self, word: str) -> list[int]:
        """The labels of the accepted path through ``word``, written in byte letters."""
        vocab, suffix, n = self.vocab, self.suffix, len(word)
        states: list[int | None] = [None] * (n + 1)
        begins = [0] * (n + 1)
        for end in range(1, n + 1):
            tail = suffix if end == n else ""
            for begin in range(max(0, end - self.longest), end):
                if begin and states[begin] is None:
                    continue
                label = vocab.get(word[begin:end] + tail)
                if label is not None and (not begin or self.has_arc(states[begin], label)):
                    states[end], begins[end] = label, begin
                    break
        out, end = [], n
        while end:
            if states[end] is None:
                raise ValueError("a symbol of the word is not in the vocabulary")
            out.append(states[end])
            end = begins[end]
        return out[::-1]


class Codec:
    """Encoding and decoding of whole texts by the automaton of a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or spec["decoder"] is not None:
            raise ValueError("not a word-end BPE file without a decoder")
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"])
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern.replace(r"\s", SPACE))
        self.words = Remembered(lambda w: tuple(self.automaton.encode(w.encode().decode("latin-1").translate(_LETTERS))))
        self.pieces = Remembered(lambda p: tuple(chain.from_iterable(map(self.words.__getitem__, self.split.findall(p)))))
        self.labels = {**{i: t for t, i in model["vocab"].items()}, **{i: t for t, i in special.items()}}
        self.library, self.seen = Tokenizer.from_file(path), set()
        self.decimal = {i: str(i) for i in self.labels}

    def _unknown(self, text: str) -> bool:
        """Whether a character is younger than Python's Unicode tables: for those the library's are used."""
        new = set(text) - self.seen
        if any(unicodedata.category(c) == "Cn" for c in new):
            return True
        self.seen |= new
        return False

    def _plain(self, text: str) -> Iterator[int]:
        if not text.isascii():
            if self._unknown(text):
                words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
                return chain.from_iterable(self.automaton.encode(w) for w, _ in words)
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return chain.from_iterable(map(self.pieces.__getitem__, text.lower().split(" ")))  # no word holds a space

    def encode(self, text: str) -> list[int]:
        if self.cut is None or not self.cut.search(text):
            return list(self._plain(text))
        return list(chain.from_iterable([self.special[x]] if x in self.special else self._plain(x) for x in self.cut.split(text) if x))

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.labels.__getitem__, ids))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """Compiled once a worker process."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_texts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_ids = codec(tokenizer)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([with_ids.encode(t.as_py() or "") for t in part.column(1)], pa.list_(pa.int32()))], names=[id_col, "ids"])

    inner = docs.select(id_col, text_col)
    return inner.mapInArrow(run, f"`{id_col}` {inner.schema[0].dataType.simpleString()}, ids array<int>")


def decode_ids(rows: DataFrame, tokenizer: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the decoded ``text`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_labels = codec(tokenizer)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([with_labels.decode(x or []) for x in batch.column(batch.num_columns - 1).to_pylist()], pa.string())], names=[*keep, "text"])

    inner = rows.select(*keep, ids_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema[: len(keep)])
    return inner.mapInArrow(run, f"{schema}, text string")


def digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): each text encoded and decoded again, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = codec(tokenizer)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1):
                ids = both.encode(text.as_py() or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(both.decimal.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(both.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    inner = docs.select(F.col(id_col), F.col(text_col))
    return inner.mapInArrow(run, f"`{id_col}` {inner.schema[0].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
