import random

import numpy as np
import pyarrow as pa
import pytest

from trafficlens.llm import chroma, packing, pseudo_likelihood
from trafficlens.llm import quality_classifier as Q


def brute_pack(items, capacity, per_source):
    """Best fit by looking at every bin."""
    bins, out = [], []
    for length, source, cluster in items:
        parts = []
        while length > capacity:
            bins.append({"room": 0, "sources": [], "clusters": set()})
            parts.append((len(bins) - 1, capacity))
            length -= capacity
        fits = [i for i, b in enumerate(bins) if b["room"] >= length and (cluster is None or cluster not in b["clusters"]) and (source is None or b["sources"].count(source) < per_source)]
        fits = [i for i in fits if not bins[i].get("full")]
        if fits:
            at = min(fits, key=lambda i: (bins[i]["room"], bins[i]["stamp"]))
        else:
            bins.append({"room": capacity, "sources": [], "clusters": set(), "stamp": 0})
            at = len(bins) - 1
        b = bins[at]
        b["room"] -= length
        b["sources"].append(source)
        b["clusters"].add(cluster)
        b["stamp"] = len(out)
        parts.append((at, length))
        out.append(parts)
        for x in bins:
            if "stamp" not in x:
                x["full"], x["stamp"] = True, -1
    return out, len(bins)


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_equals_brute_force(seed):
    rng = random.Random(seed)
    items = [(rng.choice([0, 1, 5, 17, 40, 99, 100, 250, 301]), rng.choice(["a", "a", "a", "b", None]), rng.choice(["x", "x", None, "y", f"c{i}"])) for i in range(300)]
    items.sort(key=lambda x: -x[0])
    want, n = brute_pack(items, 100, 2)
    got, part = [], []
    for p, number, _, length in packing.best_fit(items, 100, 2):
        if p < 0:
            got.append(part)
            part = []
        else:
            part.append((number, length))
    assert got == want


def test_packing_respects_conflicts(docs_of, odd):
    texts = [f"w{i} " * (i % 90 + 1) for i in range(300)] + ["same words here"] * 40 + odd
    docs = docs_of(texts, source=["hot"] * 200 + [f"s{i % 5}" for i in range(len(texts) - 200)])
    given = packing.with_lengths(docs.select("doc_id", "text", "source"))
    rows = packing.pack(given, capacity=128, shard_rows=100).collect()
    info = {r.doc_id: r for r in given.collect()}
    total, bins = {}, {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
        bins.setdefault(r.bin_id, []).append(r)
    assert total == {k: v.n_tokens for k, v in info.items()}
    for members in bins.values():
        members.sort(key=lambda r: (r.start, r.n_tokens))
        at = 0
        for r in members:
            assert r.start == at
            at += r.n_tokens
        assert at <= 128
        clusters = [info[r.doc_id].cluster for r in members]
        sources = [info[r.doc_id].source for r in members]
        assert len(set(clusters)) == len(clusters) and all(sources.count(s) <= 2 for s in sources)
    assert packing.pack(packing.with_lengths(docs_of([]).select("doc_id", "text", "source"))).count() == 0


def junk(rng, good):
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(rng.randrange(30, 200))]
    return " ".join(words) + "." if good else " ".join(w + "###" for w in words) if rng.random() < 0.5 else " ".join(w for w in words[:9] for _ in range(9))


def test_classifier(spark, docs_of, odd):
    rng = random.Random(1)
    marks = [rng.random() < 0.7 for _ in range(500)]
    docs = docs_of([junk(rng, m) for m in marks] + odd)
    labels = spark.createDataFrame([*((i, int(m), 0) for i, m in enumerate(marks)), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = Q.rate(docs, labels).orderBy("doc_id").collect()
    held = [r for r in rows if r.held_out and r.doc_id < 500]
    assert len(held) > 50 and np.mean([r.predicted == marks[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows) and len(rows) == 500 + len(odd)
    # Labels of the held-out fifth change nothing.
    import zlib

    flipped = spark.createDataFrame([(i, int(m) if zlib.crc32(str(i).encode()) % 5 else int(not m), 0) for i, m in enumerate(marks)], "doc_id long, quality int, toxic int")
    assert [round(r.score, 9) for r in Q.rate(docs, flipped).orderBy("doc_id").collect()] == [round(r.score, 9) for r in rows]
    one_class = Q.rate(docs, labels.where("quality = 1")).first().score
    assert 0.5 < one_class < 1 and Q.rate(docs_of([]), labels).count() == 0


def test_moments_give_the_textbook_density():
    rng = np.random.default_rng(1)
    d = len(Q.STATISTICS)
    m = Q.Discriminant(np.zeros(d), np.ones(d), np.array([np.zeros(d), np.ones(d)]), np.array([np.eye(d), 2 * np.eye(d)]), 0.0, 1.0)
    x = rng.normal(size=(5, d))
    a, b = (x**2).sum(1), ((x - 1) ** 2).sum(1) / 4
    assert np.allclose(m.score(x), 1 / (1 + np.exp(-0.5 * (a - b))))


def test_pseudo_likelihood(docs_of, odd):
    rng = random.Random(2)
    grammar = lambda: " ".join(w for _ in range(12) for w in rng.choice([["the", "cat", "sat", "down"], ["a", "dog", "ran", "home"]]))
    texts = [grammar() for _ in range(800)]
    mixed = [" ".join(sorted(t.split(), key=lambda _: rng.random())) for t in texts[:40]]
    model = pseudo_likelihood.train(docs_of(texts), share=1, rounds=3)
    rows = pseudo_likelihood.score(docs_of(texts[:40] + mixed + odd), model).orderBy("doc_id").collect()
    assert np.mean([r.mean_log_likelihood for r in rows[:40]]) > np.mean([r.mean_log_likelihood for r in rows[40:80]]) + 0.5
    assert [r.n_tokens for r in rows[80:]] == [len((t or "").encode().split()) for t in odd]
    assert rows[80].log_likelihood == 0 and rows[80].mean_log_likelihood is None
    assert pseudo_likelihood.rate(docs_of([])).count() == 0 and pseudo_likelihood.rate(docs_of(["", None])).count() == 2


def test_training_reaches_every_document(docs_of):
    # All documents of one first word and length have one mark; each share of eight is tried.
    from trafficlens.llm import textscan

    marks = {}
    for i in range(200):
        spans = textscan.words(*textscan.buffer_of(pa.array([f"w{i} cat sat down"]), lower=True))
        marks.setdefault(int(textscan.mix(spans.hash[:1] + np.uint64(4))[0] % np.uint64(8)), f"w{i} cat sat down")
    for share in (2, 7):
        rows = pseudo_likelihood.rate(docs_of([marks[share]] * 300)).collect()
        assert all(r.mean_log_likelihood > -6 for r in rows)  # untrained: -log(1024)
    with pytest.raises(ValueError, match="untrained"):
        pseudo_likelihood.train(docs_of([]), rounds=2, share=8)


def test_words_beyond_the_vocabulary_are_scored(docs_of):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(12))
    known = [word() for _ in range(1500)]
    texts = [" ".join(rng.choice(known[-500:] if rng.random() < 0.02 else known[:1000]) for _ in range(60)) for _ in range(400)] + [" ".join(known)]
    model = pseudo_likelihood.train(docs_of(texts))
    rare, unseen = " ".join(known[-200:]), " ".join(word() for _ in range(200))
    asked = docs_of([texts[0], rare, unseen, unseen, "", None])
    rows = pseudo_likelihood.score(asked, model).orderBy("doc_id").collect()
    assert rows[1].mean_log_likelihood > rows[2].mean_log_likelihood + 0.5 and np.isclose(rows[2].log_likelihood, rows[3].log_likelihood)
    # Words and unseen mass of each bucket share its whole probability.
    within = model.within
    bucket = model.number(within.words) - model.number.shift
    p = np.bincount(bucket, weights=np.exp(within(within.words, bucket)[0]), minlength=64)
    types = np.bincount(bucket, minlength=64)
    assert len(within.words) == 540 and np.allclose(p + (types + 1) * 0.5 / np.exp(within.log_total), 1)
    # With a smaller table the counts are joined, to the same scores.
    number, small, others = pseudo_likelihood.vocabulary(docs_of(texts), "text", 1200)
    assert not small.whole and others.count() >= 300
    joined = pseudo_likelihood.score(asked, pseudo_likelihood.Model(number, model.net, small, others)).orderBy("doc_id").collect()
    assert [r.n_tokens for r in joined] == [r.n_tokens for r in rows] and joined[4].log_likelihood == 0 and joined[5].mean_log_likelihood is None
    assert np.allclose([r.log_likelihood for r in joined], [r.log_likelihood for r in rows], atol=1e-3)


def test_vocabulary_grows():
    assert pseudo_likelihood.sides(0) == 32 and pseudo_likelihood.sides(400_000) > 32 and pseudo_likelihood.sides(40_000_000) > 2 * pseudo_likelihood.sides(400_000)
    net = pseudo_likelihood.Network.fresh(40, 40)
    assert np.allclose(np.exp(net.log_probability(np.zeros((1600, 4), dtype=int), np.arange(1600))).sum(), 1, atol=1e-3)


def test_near_scores_need_no_maximum(monkeypatch):
    """Without and with each row's maximum taken off, all is the same; weights whose exponentials are no floats are told apart."""
    rng = np.random.default_rng(3)
    net = pseudo_likelihood.Network.fresh()
    net.by_class *= 20
    context, target = rng.integers(0, pseudo_likelihood.VOCAB + 1, (3000, 4)), rng.integers(0, pseudo_likelihood.VOCAB, 3000)
    assert net.near() == (True, [True] * pseudo_likelihood.CLASSES)
    near = [net.log_probability(context, target), *net.gradients(context, target)]
    monkeypatch.setattr(pseudo_likelihood, "NEAR", 0)
    assert net.near() == (False, [False] * pseudo_likelihood.CLASSES)
    far = [net.log_probability(context, target), *net.gradients(context, target)]
    assert all(np.allclose(a, b, rtol=1e-4, atol=1e-6) for a, b in zip(near, far, strict=True))
    monkeypatch.undo()
    net.member_bias[3, 5] = 500
    assert net.near() == (True, [c != 3 for c in range(pseudo_likelihood.CLASSES)])
    assert np.isfinite(net.log_probability(context, target)).all() and all(np.isfinite(g).all() for g in net.gradients(context, target))


def test_network_gradients():
    rng = np.random.default_rng(4)
    net = pseudo_likelihood.Network.fresh()
    for x in vars(net).values():
        x[...] = rng.normal(0, 0.3, x.shape)
    context, target = rng.integers(0, 50, (20, 4)), rng.integers(0, 1024, 20)
    grads = net.gradients(context, target)
    loss = lambda: -net.log_probability(context, target).astype(np.float64).mean()
    for x, g in zip(vars(net).values(), grads, strict=True):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        before = x[i]
        x[i] = before + 1e-2
        up = loss()
        x[i] = before - 1e-2
        down = loss()
        x[i] = before
        assert abs((up - down) / 2e-2 - g[i]) < 0.05 * abs(g[i]) + 1e-4


def tune(rng, n=24):
    return [rng.uniform(-1, 1) for _ in range(n)]


def test_chroma_alignment():
    rng = random.Random(3)
    notes = tune(rng, 40)
    at = np.arange(2 * chroma.HOP) / chroma.RATE
    play = lambda v: np.concatenate([0.5 * np.sin(2 * np.pi * 220 * 2 ** (round(x * 12) / 12) * at) for x in v])
    prints = lambda v: chroma.fingerprint(chroma.chroma(play(v), chroma.RATE))
    whole, cut, other = prints(notes), prints(notes[10:30]), prints(tune(rng, 20))
    best = min((chroma.bit_errors(whole, cut, o)[1], o) for o in range(-5, 60) if chroma.bit_errors(whole, cut, o)[0] >= 8)
    assert best[1] == 20 and best[0] < 0.05
    assert min(chroma.bit_errors(whole, other, o)[1] for o in range(0, 30)) > 0.15
    assert chroma.samples_of(b"junk") is None and chroma.samples_of(None) is None
    samples, rate = chroma.samples_of(chroma.wav_bytes(play(notes)))
    assert rate == chroma.RATE and np.allclose(samples, play(notes), atol=1e-3)


def test_chroma_search(spark):
    rng = random.Random(5)
    base = [tune(rng) for _ in range(30)]
    rows = [(i, v) for i, v in enumerate(base)] + [(50, base[3]), (100, [x + 0.004 for x in base[4]]), (101, None), (102, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = chroma.search(chroma.render(vectors, "vec_id", "embedding"), "vec_id", "media").collect()
    by = {r.vec_id: r for r in got}
    assert by[50]["class"] == by[3]["class"] == 3 and by[101]["class"] is None and by[50].query and not by[3].query
    assert {r.match_class for r in got if r.vec_id == 100} == {4} and set(by) == {i for i, _ in rows}
    assert all(r.match_class is None for r in got if not r.query)


def test_render_plays_every_component(spark):
    rng = random.Random(6)
    base = [1.0, *tune(rng, 63)]
    other = base[:24] + tune(rng, 40)
    rows = [(50, base), (1, other), (2, base), (3, base[:10]), (4, None), (5, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    media = chroma.render(vectors, "vec_id", "embedding")
    n = {r.vec_id: r.media and len(chroma.samples_of(r.media)[0]) for r in media.collect()}
    assert n == {50: 64 * 2 * chroma.HOP, 1: 64 * 2 * chroma.HOP, 2: 64 * 2 * chroma.HOP, 3: 10 * 2 * chroma.HOP, 4: None, 5: None}
    found = chroma.search(media, "vec_id", "media").collect()
    by = {r.vec_id: r for r in found}
    assert by[2]["class"] == by[50]["class"] == 2 and by[1]["class"] == 1
    assert {r.match_class for r in found if r.vec_id == 50} == {3}  # its beginning, and not what only begins alike


def test_alignment_finds_all_that_brute_force_does(spark):
    rng = random.Random(9)
    words = lambda n: [rng.randrange(1 << 32) for _ in range(n)]
    a, b, c, held = words(12), words(12), words(12), [7] * 30
    own = {1: a + b + a + c, 2: a + c, 3: b + b + a, 4: words(5) + held + c, 5: held + words(3), 6: held + c + held, 7: words(40), 8: c[:2] + b[2:] + a, 9: words(3)}
    least = (3, 8, 0.15)
    want = set()
    for q, x in own.items():
        for k, y in own.items():
            x, y = np.array(x), np.array(y)
            for o in range(-len(y) + 1, len(x)) if q != k else ():
                i, j = max(o, 0), max(-o, 0)
                n, error = chroma.bit_errors(x, y, o)
                hits = int((x[i : i + n] == y[j : j + n]).sum())
                if hits >= least[0] and n >= least[1] and error <= least[2]:
                    want.add((q, k, o, hits, n, round(error, 9)))
    table = spark.createDataFrame(list(own.items()), "class long, prints array<bigint>")
    got = [(*r[:5], round(r[5], 9)) for r in chroma.align(table, table, "class", *least).collect()]
    assert set(got) <= want and sorted((r[0], r[1]) for r in got) == sorted({(r[0], r[1]) for r in want})
    assert (2, 1, -24, 24, 24, 0.0) in got  # the second copy of a
    assert all(r[3] == max(w[3] for w in want if w[:2] == r[:2]) for r in got)


def test_block_alignment_in_small_steps(monkeypatch):
    rng = random.Random(12)
    lists = [[rng.randrange(4)] * rng.randrange(1, 50) + [rng.randrange(3) for _ in range(rng.randrange(40))] for _ in range(12)] + [[9] * 200, [9, 8] * 70]
    values, lengths = np.concatenate([np.array(x, dtype=np.uint32) for x in lists]), np.array([len(x) for x in lists])
    want = {}
    for r, y in enumerate(lists):
        for q, x in enumerate(lists):
            for o in range(-len(y) + 1, len(x)):
                n = sum(a == b for a, b in zip(x[max(o, 0) :], y[max(-o, 0) :], strict=False))
                if n >= 3:
                    want[r, q, o] = n
    ways = []
    for meetings in (3, 500, 1 << 20):
        monkeypatch.setattr(chroma, "MEETINGS", meetings)
        block = chroma.Block(np.arange(len(lists)), values, lengths)
        assert {k[:3]: k[3] for k in zip(*(x.tolist() for x in block.hits(values, lengths, 3)), strict=True)} == want
        ways.append([x.tolist() for x in block.best(values, lengths, 3, 8, 0.15)])
    assert ways[0] == ways[1] == ways[2] and len(ways[0][0]) >= len(lists)
    none = np.zeros(0, dtype=np.int64)
    assert all(len(x) == 0 for x in block.best(none.astype(np.uint32), none, 3, 8, 0.15))


def test_chroma_reads_all_widths_and_rates(spark):
    import io
    import wave

    notes = tune(random.Random(10), 40)

    def media(rate, width):
        at = np.arange(int(0.256 * rate)) / rate
        x = np.concatenate([0.5 * np.sin(2 * np.pi * 220 * 2 ** (round(v * 12) / 12) * at) for v in notes])
        scaled = np.round(x * (2 ** (8 * width - 1) - 1)).astype(np.int64) + (128 if width == 1 else 0)
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(width)
            w.setframerate(rate)
            w.writeframes(scaled.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes())
        return out.getvalue()

    kinds = [(4000, 2), (4000, 1), (4000, 3), (4000, 4), (8000, 2), (44100, 3)]
    table = spark.createDataFrame([(i, bytearray(media(*k))) for i, k in enumerate(kinds)], "id long, media binary")
    prints = {r.id: r.prints for r in chroma.fingerprints(table, "id", "media").collect()}
    for i in range(1, len(kinds)):
        n, error = chroma.bit_errors(np.array(prints[0]), np.array(prints[i]), 0)
        assert abs(len(prints[i]) - len(prints[0])) <= 1 and n > 60 and error < 0.15
