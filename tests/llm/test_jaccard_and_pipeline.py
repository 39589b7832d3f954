import os
import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from trafficlens.llm import components, jaccard
from trafficlens.llm.packing import with_lengths

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def sets(text):
    w = (text or "").encode().translate(LOWER).split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute(texts, ids):
    """(n_shingles, component) of each row by comparing all pairs."""
    own = [sets(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        if own[i] and own[j] and 100 * len(own[i] & own[j]) >= 80 * len(own[i] | own[j]):
            root[find(j)] = find(i)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(least.get(find(i), x), x)
    return [(len(s), least.get(find(i))) for i, s in enumerate(own)]


def family(rng, words, copies, change):
    base = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randrange(change + 1)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(30))
    texts = [t for _ in range(12) for t in family(rng, words, rng.randrange(2, 9), 6)]
    texts += family(rng, words, 45, 5)  # more than are common
    texts += [f"{passage} " + " ".join(rng.choice(words) for _ in range(40)) for _ in range(50)]
    texts += [" ".join(rng.choice(words) for _ in range(60)) for _ in range(40)] + ["Same Text here OK now yes"] * 40 + ["a b", "A B", "a b c"]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_brute_force(docs_of, odd, seed):
    texts = corpus(seed) + odd
    ids = list(range(1000, 1000 + len(texts)))
    random.Random(seed).shuffle(ids)
    ids[3], ids[7], ids[11] = None, (1 << 63) - 1, (1 << 62) + 3
    want = dict(zip(ids, brute(texts, ids), strict=True))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_components(docs_of(texts, ids), common=8).collect()}
    assert got == want


def test_one_stays(docs_of):
    texts = ["a b c d e f g h i j"] * 3 + ["A b c d e f g h i j", "other words that are not like those at all", "", None, ""]
    assert sorted(r.doc_id for r in jaccard.keep_one(docs_of(texts)).collect()) == [0, 4, 5, 6, 7]
    assert jaccard.link_components(docs_of([])).count() == 0


def test_one_row_stays_of_repeated_and_null_ids(docs_of):
    same, near, other = "a b c d e f g h i j k l m n o p q r s t u v w x y z", "a b c d e f g h i j k l m n o p q r s t u v w x y Z", "quite another text of more than five words here"
    kept = sorted((r.doc_id or -1, r.text or "") for r in jaccard.keep_one(docs_of([same, same, near, near + " end", other, other, other + "!", ""], [5, 5, 5, 9, None, None, 7, 5])).collect())
    assert len(kept) == 3 + 1 and kept[0] == (-1, other) and (5, "") in kept and (7, other + "!") in kept and sum(i == 5 for i, _ in kept) == 2
    assert {(r.doc_id, r.component_id) for r in jaccard.link_components(docs_of([same, near, other], [(1 << 63) - 1, (1 << 62) + 1, None])).collect()} == {((1 << 63) - 1, (1 << 62) + 1), ((1 << 62) + 1, (1 << 62) + 1), (None, None)}


def test_both_ways_of_joining_components(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7)]
    edges = spark.createDataFrame(rows, "a long, b long")
    few = {tuple(r) for r in components.components(edges).collect()}
    assert {tuple(r) for r in components.components(edges, one_task=0).collect()} == few and few


def test_shingles_by_hand():
    got = jaccard.shingle_sets(pa.array(["A b\tc d E", "a b c d e", "a b", "b a", "", None, "a b c d e f a b c d e"]), 5)
    assert [len(x) for x in got] == [1, 1, 1, 1, 0, 0, 7 - 1] and got[0] == got[1] and got[2] != got[3]
    common = np.array([got[6][2]], dtype=np.uint64), np.array([7], dtype=np.uint8)
    assert jaccard.ordered(got[6], common, 6)[-1] == got[6][2] and len(jaccard.ordered(got[6], common, 5)) == 5


def test_signatures_bound_the_difference():
    rng = np.random.default_rng(5)
    for n, m, both in [(1, 1, 0), (3, 70, 2), (64, 64, 64), (900, 1100, 800), (5000, 300, 300)]:
        x = np.unique(rng.integers(0, 1 << 63, n + m - both, dtype=np.uint64))
        a, b = x[:n], x[n - both :]
        assert jaccard.differing(jaccard.signature(a), jaccard.signature(b)) <= len(np.setxor1d(a, b))
        assert jaccard.differing(jaccard.signature(a), jaccard.signature(a)) == 0
    x = np.unique(rng.integers(0, 1 << 63, 2000, dtype=np.uint64))
    assert jaccard.differing(jaccard.signature(x[:1000]), jaccard.signature(x[1000:])) > 300


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_equals_brute_force(spark):
    """Every stage against plain Python on what the stage before it kept."""
    import corpus_pipeline as pipeline

    from .test_lines_and_rules import brute_counts, brute_lines

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stages = dict(pipeline.STAGES)
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "quality_classifier", "line_dedup", "jaccard_join", "best_fit_packing"]
    ruled = stages["quality_rules"](spark, docs, SF).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    counts = {i: brute_counts(t) for i, t in texts.items()}
    passed = {i for i, (n, _, _, _, rep) in counts.items() if n >= 50 and 2 * rep <= n}
    kept = {r.doc_id for r in ruled}
    assert kept <= passed and all(i in kept for i in passed if labels.get(i) == 1) and not any(labels.get(i) == 0 and i in kept for i in passed)
    judged = stages["quality_classifier"](spark, spark.createDataFrame(ruled, docs.schema), SF).collect()
    assert {r.doc_id for r in judged} <= kept and all(r.doc_id in {x.doc_id for x in judged} for r in ruled if labels.get(r.doc_id) == 1)
    lined = stages["line_dedup"](spark, spark.createDataFrame(judged, docs.schema), SF).collect()
    want = dict(zip([r.doc_id for r in judged], brute_lines([r.text for r in judged], 10), strict=True))
    assert {r.doc_id: r.text for r in lined} == want and all(r.n_chars == len(r.text) for r in lined)
    one = stages["jaccard_join"](spark, spark.createDataFrame(lined, docs.schema), SF).collect()
    ids = [r.doc_id for r in lined]
    groups = brute([r.text for r in lined], ids)
    assert {r.doc_id for r in one} == {i for i, (_, c) in zip(ids, groups, strict=True) if c == i}
    packed = stages["best_fit_packing"](spark, spark.createDataFrame(one, docs.schema), SF).collect()
    total = {}
    for r in packed:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    given = with_lengths(spark.createDataFrame(one, docs.schema).select("doc_id", "text", "source")).collect()
    assert total == {r.doc_id: r.n_tokens for r in given} == {r.doc_id: len(r.text.split()) + 1 for r in one}


def test_scratch_tables_have_small_row_groups(spark):
    """A task holds a row group in its heap: with Parquet's 128 MB, the pipeline's second stage failed at 0.6 GB."""
    from urllib.parse import urlparse

    import pyarrow.dataset as ds

    from trafficlens.llm.common import ROW_GROUP, materialize

    texts = spark.range(0, 8000, 1, 1).selectExpr("id", "concat_ws(' ', transform(sequence(1, 100), i -> sha2(concat(id, '-', i), 256))) AS text")
    table = materialize(texts, "row-groups")
    sizes = [g.total_byte_size for f in ds.dataset(urlparse(table._scratch).path, format="parquet").get_fragments() for g in f.row_groups]
    assert len(sizes) > 1 and max(sizes) <= 1.5 * ROW_GROUP
    assert table.count() == 8000 and table.exceptAll(texts).isEmpty()


def test_stages_bound_the_bytes_of_batches(spark):
    """10,000 rows were a batch whatever their texts, and executors of the pipeline's second stage went over 3000 MB."""
    import corpus_pipeline as pipeline

    from trafficlens.llm.common import BATCH

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 6000, 1, 1).selectExpr("id AS doc_id", "repeat(concat('some words ', id, ' '), 300) AS text", "'en' AS lang", "'web' AS source", "1L AS n_chars")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["bytes", "rows"])

    try:
        for name, stage in pipeline.STAGES:
            spark.conf.unset(key)
            if name == "quality_classifier" and not os.path.isdir(SF):  # reads the labels
                continue
            stage(spark, docs.limit(50), SF)
            seen = docs.mapInArrow(sizes, "bytes bigint, rows bigint").collect()
            assert max(r.bytes for r in seen) <= 1.5 * BATCH and sum(r.rows for r in seen) == 6000, name
        spark.conf.set(key, "1000000")  # the session's own bound stays
        pipeline.rules(spark, docs.limit(50), SF)
        assert spark.conf.get(key) == "1000000"
    finally:
        spark.conf.unset(key)


def test_what_is_read_and_written_of_a_stage_is_bounded(spark, tmp_path):
    """Who wrote a stage's rows wrote row groups of 128 MB, and the reader decoded 4096 texts at once: at 0.6 GB the heap ran out."""
    import pyarrow.dataset as ds

    import corpus_pipeline as pipeline
    from trafficlens.llm.common import READ_ROWS, ROW_GROUP

    keys = ["spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize", "parquet.block.size"]
    texts = spark.range(0, 8000, 1, 1).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 100), i -> sha2(concat(id, '-', i), 256))) AS text", "'en' AS lang", "'web' AS source", "1L AS n_chars")
    try:
        for key in keys:
            spark.conf.unset(key)
        pipeline.rules(spark, texts, SF).write.parquet(f"{tmp_path}/kept")
        sizes = [g.total_byte_size for f in ds.dataset(f"{tmp_path}/kept", format="parquet").get_fragments() for g in f.row_groups]
        assert len(sizes) > 1 and max(sizes) <= 1.5 * ROW_GROUP
        assert spark.conf.get(keys[1]) == str(READ_ROWS)
        assert spark.read.parquet(f"{tmp_path}/kept").exceptAll(texts).isEmpty()
    finally:
        for key in keys:
            spark.conf.unset(key)
