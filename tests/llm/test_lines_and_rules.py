import random
from collections import Counter

import numpy as np
import pyarrow as pa

from trafficlens.llm import quality_rules as R
from trafficlens.llm import textscan
from trafficlens.llm.line_dedup import CuckooFilter, LineDedup, dedup_lines, line_key


def brute_lines(texts, least):
    keys = lambda t: [line_key(x) for x in (t or "").encode().split(b"\n")]
    n = Counter(k for t in texts for k in set(keys(t)) if k)
    return ["\n".join(x for x, k in zip((t or "").split("\n"), keys(t), strict=True) if not k or n[k] < least) for t in texts]


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    pool = ["Shared line", "  shared LINE\t", "rare", "", "other line", "é line", "x" * 50]
    return ["\n".join(rng.choice([*pool, f"own {rng.randrange(500)}"]) for _ in range(rng.randrange(1, 9))) for _ in range(n)]


def test_lines_match_brute_force(docs_of, odd):
    texts = corpus() + odd
    rows = {r.doc_id: r for r in dedup_lines(docs_of(texts), 5).collect()}
    want = brute_lines(texts, 5)
    for i, text in enumerate(want):
        assert rows[i].text == text and rows[i].n_lines == len((texts[i] or "").split("\n"))
    assert rows[0].lang == "en" and rows[0].score == "y"


def test_no_documents(docs_of):
    assert dedup_lines(docs_of([])).count() == 0


def test_deletion_restores(spark, docs_of):
    old, new = corpus(50, 2), corpus(50, 3)
    state = LineDedup(spark, 8, shards=4).insert(docs_of(old)).insert(docs_of(new)).delete(docs_of(new))
    alone = LineDedup(spark, 8, shards=4).insert(docs_of(old))
    as_set = lambda df: {(bytes(r.key), r.n) for r in df.collect()}
    assert as_set(state.counts) == as_set(alone.counts)
    texts = lambda s: [r.text for r in s.apply(docs_of(old + new)).orderBy("doc_id").collect()]
    assert texts(state) == texts(alone)


def test_waves_give_the_same(spark, docs_of):
    texts = corpus(80, 4)
    one = LineDedup(spark, 3, shards=16).insert(docs_of(texts))
    many = LineDedup(spark, 3, shards=16, wave_bytes=1).insert(docs_of(texts))
    assert len(many.waves()) > 1 == len(one.waves())
    get = lambda s: [(r.text, r.n_lines, r.n_dropped) for r in s.apply(docs_of(texts)).orderBy("doc_id").collect()]
    assert get(one) == get(many)


def test_cuckoo_filter_overfull():
    rng = np.random.default_rng(1)
    low, high = rng.integers(0, 1 << 63, 300, dtype=np.uint64), rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    c = CuckooFilter(32)
    c.add(low, high)
    assert c.stash and c.has(low, high).all()
    c = CuckooFilter.load(c.dump())
    c.remove(low[:150], high[:150])
    assert c.has(low[150:], high[150:]).all() and c.has(low[:150], high[:150]).sum() < 5
    c.remove(low[150:], high[150:])
    assert not c.table.any() and not c.stash


def brute_counts(text):
    text = text or ""
    words = text.encode().split()
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if grams[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return [len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)]


def test_counts_match_brute_force(odd):
    texts = [*odd, *corpus(40, 5), "a b c a b c", "a\nb\na\n\n\nb", "# * $ é|é", " a ", "\n\na a a a"]
    got = R.measure_texts(pa.array(texts, pa.string()))
    assert np.column_stack([got[c] for c in R.COUNTS]).tolist() == [brute_counts(t) for t in texts]


def clean(rng, n=120):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(n))


def test_rules_keep_the_clean(docs_of, odd):
    rng = random.Random(6)
    texts = [clean(rng) for _ in range(150)] + [" ".join(w + "###" for w in clean(rng).split()) for _ in range(30)] + odd
    rows = R.rate(docs_of(texts)).orderBy("doc_id").collect()
    assert all(r.kept for r in rows[:150]) and not any(r.kept for r in rows[150:180])
    assert all(r.base_failed for r in rows[180:])
    assert {r.doc_id for r in R.filter_rules(docs_of(texts)).collect()} == set(range(150))
    assert R.rate(docs_of([])).count() == 0


def test_thresholds_follow_language_and_source(docs_of):
    """The same text is kept or not as its language and source write; no constant changes."""
    rng = random.Random(8)
    plain = [clean(rng) for _ in range(160)]
    marked = [" ".join(w + "#" * (i % 3 == 0) for i, w in enumerate(clean(rng).split())) for _ in range(31)]
    texts = plain + marked + [marked[0], marked[0], marked[0], plain[0]]
    lang = ["en"] * 120 + ["de"] * 40 + ["en"] * 31 + ["de", "fr", None, None]
    source = ["web"] * 100 + ["code"] * 20 + ["code"] * 40 + ["code"] * 31 + ["code", "code", None, None]
    kept = [r.kept for r in R.rate(docs_of(texts, lang=lang, source=source)).orderBy("doc_id").collect()]
    assert all(kept[:191])  # in (en, code) over a quarter of the texts have symbols
    assert kept[191:] == [False, False, False, True]  # (de, code) has none; of (fr, code) and null too few are known
    fences = R.fences(R.sketch(R.measure(docs_of(texts, lang=lang, source=source)), ["lang", "source"]), ["lang", "source"]).collect()
    assert len({r.fence_symbols for r in fences}) > 1 and len({r.fence_word_length_high for r in fences}) > 1
    added = marked * 2 + plain
    more = [r.kept for r in R.rate(docs_of(texts + added, lang=lang + ["de"] * 62 + ["en"] * 160, source=source + ["code"] * 62 + ["web"] * 160)).orderBy("doc_id").collect()]
    assert more[191] and not more[192]


def test_sketches_merge(spark, docs_of):
    rng = random.Random(7)
    texts = [clean(rng, rng.randrange(60, 200)) for _ in range(60)]
    groups = ["lang", "source"]
    part = lambda a, b: R.sketch(R.measure(docs_of(texts[a:b])), groups)
    whole = {tuple(r) for r in part(0, 60).collect()}
    assert {tuple(r) for r in R.merge(part(0, 25).unionByName(part(25, 60)), groups).select(*part(0, 1).columns).collect()} == whole


def test_bins_hold_their_values(spark):
    from pyspark.sql import functions as F

    rows = spark.range(0, 5000).withColumn("v", F.col("id") * F.col("id")).select("v", R.bin_floor(R.bin_of(F.col("v"))).alias("f")).collect()
    assert all(r.f <= r.v <= r.f * 33 / 32 + 1 for r in rows)


def test_word_hashes_over_long_texts():
    texts = ["a b " * 400_000, "z" * 2_000_000 + " q", "", "a b"]
    data, offsets = textscan.buffer_of(pa.array(texts))
    w = textscan.words(data, offsets)
    assert np.diff(w.row_start).tolist() == [800_000, 2, 0, 2]
    assert len(set(w.hash[:800_000].tolist())) == 2 and w.hash[-2:].tolist() == w.hash[:2].tolist()
