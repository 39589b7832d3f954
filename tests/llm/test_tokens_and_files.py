import gzip
import hashlib
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from trafficlens.llm import simple8b, warc
from trafficlens.llm.bpe_automaton import Codec, decode_ids, digests, encode_texts
from trafficlens.llm.queries import tokenizer_path

WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
ALPHABET = ["a", "b", "th", "ing", " ", " ", "\n", "\t", "é", "É", "1", "'s", "'", "!", ".", ",", "<|endoftext|>", "<|startoftext|>", "　", "\xa0", "\x1c", "\x85", "🙂", "中", "ΑΣ", "İ", "aaaa", "²", "ﬁ", "\U00010d55", "Ᲊ"]


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randrange(0, 16))) for _ in range(n)]


def test_automaton_equals_the_library():
    codec, tok = Codec(WORD), library(WORD)
    for t in [*texts(4000, 1), "abcdefgh" * 200, *("".join(random.Random(i).choices("abehinorst", k=25)) for i in range(1500))]:
        ids = tok.encode(t, add_special_tokens=False).ids
        assert codec.encode(t) == ids, t
        assert codec.decode(ids) == tok.decode(ids, skip_special_tokens=False)


def test_gadgets_by_hand():
    from trafficlens.llm.bpe_automaton import Automaton

    vocab = {t: i for i, t in enumerate(["a", "b", "a/", "b/", "aa", "ab", "aab", "aa/"])}
    auto = Automaton(vocab, [("a", "a"), ("aa", "b"), ("a", "a/")], "/")
    arc = lambda u, v: auto.has_arc(vocab[u], vocab[v])
    assert not arc("a", "a") and arc("aa", "a") and not arc("a", "aa") and not arc("aa", "b") and arc("aa", "aa") and not arc("a", "aab")
    names = {i: t for t, i in vocab.items()}
    assert [names[i] for i in auto.encode("aaaa")] == ["aa", "a", "a/"] or [names[i] for i in auto.encode("aaaa")] == ["aa", "aa/"]


def test_encode_decode_tables(docs_of, odd):
    tok = library(WORD)
    rows = {r.doc_id: r.ids for r in encode_texts(docs_of(odd), WORD).collect()}
    assert rows == {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(odd)}
    back = {r.doc_id: r.text for r in decode_ids(encode_texts(docs_of(odd), WORD), WORD).collect()}
    assert back == {i: tok.decode(v, skip_special_tokens=False) for i, v in rows.items()}
    assert digests(docs_of([]), WORD).count() == 0


@pytest.mark.parametrize("top", [1, 2, 127, 50_257, 1 << 40, (1 << 64) - 1])
def test_simple8b_blocks(top):
    rng = np.random.default_rng(top % 97)
    for n in (0, 1, 2, 59, 60, 61, 500):
        values = rng.integers(0, top, n, dtype=np.uint64, endpoint=True)
        if n > 5:
            values[2:5] = [(1 << 60) - 1, (1 << 60), (1 << 64) - 1]
        words, escapes = simple8b.encode_block(values)
        assert (simple8b.decode_block(words, escapes) == values).all() and len(escapes) == (values >= 1 << 60).sum()


def plain_words(values):
    """Each word by the rule: the greatest number of ids that fit."""
    i, words = 0, []
    while i < len(values):
        s, (count, bits) = next(((s, p) for s, p in enumerate(simple8b.PACKS, 1) if i + p[0] <= len(values) and max(values[i : i + p[0]]) < 1 << p[1]), (0, (1, 0)))
        words.append(s << 60 | (sum(v << k * bits for k, v in enumerate(values[i : i + count])) if s else 0))
        i += count
    return words


def test_simple8b_takes_the_most_that_fit():
    rng = np.random.default_rng(5)
    for _ in range(300):
        top = 1 << rng.integers(1, 64, rng.integers(1, 200)).astype(np.uint64)
        values = np.where(rng.random(len(top)) < rng.random(), rng.integers(0, top, dtype=np.uint64), rng.integers(0, 3, len(top), dtype=np.uint64))
        assert simple8b.encode_block(values)[0].tolist() == plain_words(values.tolist())


def test_a_word_is_kept_once():
    """A word met bare and before marks has one entry, so that twice as many are remembered."""
    encode, tok = simple8b.Encoder(BYTE), library(BYTE)
    for w in ["plain", "été", "Ωmega"]:
        for t in (f"a {w} {w}, {w}.", f"b {w}"):
            assert list(encode(t)) == tok.encode(t, add_special_tokens=False).ids
        assert w in encode.pieces and f" {w}" not in encode.tokens


def test_file_holds_documents():
    rng = np.random.default_rng(3)
    docs = [(None if i == 0 else i, rng.integers(0, 50_000, rng.integers(0, 9000))) for i in range(12)]
    f = io.BytesIO()
    w = simple8b.Writer(f)
    for doc_id, ids in docs:
        w.add(doc_id, ids)
    w.close()
    reader = simple8b.Reader(f)
    start = 0
    for (doc_id, ids), (got, at, n, pieces) in zip(docs, reader.documents(), strict=True):
        assert (got, at, n) == (doc_id, start, len(ids)) and np.array_equal(np.concatenate([*pieces, np.zeros(0, np.uint64)]), ids)
        start += n
    assert np.array_equal(np.concatenate(list(reader.span(5000, 20_000))), np.concatenate([d for _, d in docs])[5000:20_000])


def test_encoder_equals_the_library():
    encode, tok = simple8b.Encoder(BYTE), library(BYTE)
    for t in [*texts(4000, 2), "a  b \n c ", " ", "  a", "x" * 5000]:
        assert list(encode(t)) == tok.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("slots", [1 << 21, 256])
def test_batches_equal_the_library(monkeypatch, slots):
    """Whole arrays at once, with a table that is emptied again and again too; no word of up to 16 bytes is made twice."""
    monkeypatch.setattr(simple8b.Batches, "SLOTS", slots)
    if slots == 256:
        monkeypatch.setattr(simple8b.Batches, "MOST", 128)
        monkeypatch.setattr(simple8b.Batches, "CHUNK", 100)
    encode, tok = simple8b.Batches(simple8b.Encoder(BYTE)), library(BYTE)
    more = [None, "", " ", "  a", "a  b \n c ", "x" * 5000, "\0 \0\0 a\0", "One. Two, it's.\nThree!\n\nFour \nFive\n", "\n", "a\n", "a\nb", "«\nb", "b\xa0\nc", "sixteen-letters! seventeen-letters", "x «y» – 中 \u2003z \u3000 \x85", "12345678 123456789 1234567 12345678"]
    given = [*texts(4000, 5), *more]
    for t, got in zip(given, encode(pa.array(given, pa.string())), strict=True):
        assert got.tolist() == tok.encode(t or "", add_special_tokens=False).ids, t
    assert encode(pa.array([], pa.string())) == []
    if slots > 256:
        short = [t for t in given if t and max(map(len, t.encode().split(b" "))) <= 16 and "<|" not in t]
        monkeypatch.setattr(encode, "_make", None)
        again = encode(pa.array([None, *short], pa.string()).slice(1))
        assert len(short) > 1000 and all(a.tolist() == tok.encode(t, add_special_tokens=False).ids for a, t in zip(again, short, strict=True))


def test_token_files(docs_of, odd):
    tok = library(BYTE)
    given = odd + texts(40, 3)
    ids = [*range(len(given) - 3, -1, -1), None, 5]
    rows = simple8b.round_trip(docs_of(given, ids), BYTE).collect()
    want = {}
    for i, t in zip(ids, given, strict=True):
        v = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.setdefault(i, []).append((len(v), zlib.crc32(np.array(v, dtype="<u4").tobytes())))
    got = {}
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: -1 if x is None else x)
    assert simple8b.round_trip(docs_of([]), BYTE).count() == 0


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archives(spark, tmp_path):
    big, inner = "ä" * 800, gzip.compress(warc.record(9, "u", b"x" * 50, b"\0" * 20, None, "d")).decode("latin-1")
    rows = [(1, "http://a/ b", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (None, "u", big), (7, "u", inner), (8, "u", "q\r\n\r\nWARC/1.1\r\n" * 300)]
    folder = f"file://{tmp_path}/w"
    assert warc.write_archives(warc.roles(pages(spark, rows).repartition(2), 1000), folder) == len(rows)
    for split in (1, 97, 1 << 20):
        got = {r.page_id: r for r in warc.read_archives(spark, folder, split).collect()}
        assert len(got) == len(rows)
        assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {k: (("revisit", 2) if k in (1, None) else ("response", None)) for k, *_ in rows}
        assert all(r.payload_bytes == len((h or "").encode()) for k, _, h in rows for r in [got[k]])
        assert bytes(got[8].payload).decode() == rows[-1][2] and got[2].url is None and got[1].url == "http://a/%20b"
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_broken_members_are_passed_over():
    whole = [warc.gzip_member(warc.record(i, "u", bytes([65 + i]) * 100, b"\0" * 20, None, "d")) for i in range(5)]
    broken = bytearray(whole[2])
    broken[len(broken) // 2] ^= 255
    data = b"junk\x1f\x8b\x08junk" + whole[0] + whole[1] + bytes(broken) + whole[3] + whole[4]
    found = [at for at, _ in warc.RangeReader(io.BytesIO(data), 0, len(data), len(data))]
    assert [data.index(whole[i]) for i in (0, 1, 3, 4)] == found
    middle = data.index(whole[3]) - 1
    parts = [[at for at, _ in warc.RangeReader(io.BytesIO(data), a, b, len(data))] for a, b in ((0, middle), (middle, len(data)))]
    assert sum(parts, []) == found


def test_padding_between_members():
    whole = [warc.gzip_member(warc.record(i, "u", bytes([65 + i]) * 100, b"\0" * 20, None, "d")) for i in range(3)]
    data = whole[0] + b"\0" * 200 + whole[1] + b"\r\n" + whole[2] + b"\0" * 8
    want = [data.index(x) for x in whole]
    for cut in (1, want[1] - 1, want[1], want[2] - 1, len(data) - 4):
        assert [at for a, b in ((0, cut), (cut, len(data))) for at, _ in warc.RangeReader(io.BytesIO(data), a, b, len(data))] == want
    cut_off = data[:-8] + b"junk"
    assert [at for at, _ in warc.RangeReader(io.BytesIO(cut_off), 0, len(cut_off), len(cut_off))] == want[:2]


def test_records_of_others(spark, tmp_path):
    head = "WARC-Type: {}\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://a/\r\n"
    http = b"HTTP/1.1 200 OK\r\n\r\nbody"

    def member(kind, block, more="", size=None):
        fields = head.format(kind) + more + f"Content-Length: {len(block) if size is None else size}\r\n\r\n"
        return warc.gzip_member(b"WARC/1.0\r\n" + fields.encode() + block + b"\r\n\r\n")

    right, wrong = hashlib.sha1(b"body"), "WARC-Payload-Digest: sha1:" + "A" * 32 + "\r\n"
    given = [
        member("warcinfo", b"software: x"), member("response", http), member("response", http, wrong), member("response", http, f"WARC-Payload-Digest: sha1:{right.hexdigest()}\r\n"),
        member("response", http, "WARC-Payload-Digest: md5:abc\r\n"), member("revisit", b"HTTP/1.1 200 OK\r\n\r\n", wrong), member("revisit", b""), member("response", b"20240101 a 1.2.3.4", "Content-Type: text/dns\r\n"),
    ]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(given))
    rows = sorted(warc.read_archives(spark, f"file://{tmp_path}", 100).collect(), key=lambda r: r.offset)
    body = right.hexdigest()
    assert [(r.record_type, r.payload_bytes, r.payload_digest, r.digest_ok) for r in rows] == [
        ("response", 4, body, None), ("response", 4, body, False), ("response", 4, body, True), ("response", 4, body, None),
        ("revisit", None, "0" * 40, None), ("revisit", None, None, None), ("response", 18, hashlib.sha1(b"20240101 a 1.2.3.4").hexdigest(), None),
    ]
    assert all(r.page_id is None and r.url == "http://a/" for r in rows) and bytes(rows[-1].payload).startswith(b"2024")
    assert warc.parse(member("x", b"ab", size="?") and b"WARC/1.0\r\nContent-Length: ?\r\n\r\nab")[1] == b"ab"
