"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), k AS (
  SELECT doc_id, line, pos, translate(trim(line, {SPACE_CHARS}), '{UPPER}', '{LOWER}') AS key FROM l
), hot AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(hot.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (hot.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN hot USING (key) GROUP BY doc_id
"""


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import rate

    return rate(table(spark, sf_dir, "documents"))


def _op7_sql() -> str:
    """The same rules: sketch bins, fences and joined filter, for DuckDB."""
    from .quality_rules import QUANTILES, RATIOS, SURE

    value = lambda r: f"(({RATIOS[r][2]} * {RATIOS[r][0]}) // greatest({RATIOS[r][1]}, 1))"
    # A bin's least value: the value with all but its six leading bits cleared.
    pairs = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS ratio, {value(r)} AS v FROM b WHERE NOT base_failed" for r in RATIOS)
    spread = lambda x: f"{x[5]} * CASE WHEN q{x[4]} > q{x[3]} THEN q{x[4]} - q{x[3]} WHEN q{x[4]} <= q{x[3]} THEN 0 END"
    fence = "CASE ratio " + " ".join(f"WHEN '{r}' THEN " + (f"q{x[4]} + {spread(x)}" if x[6] == "high" else f"q{x[3]} - {spread(x)}") for r, x in RATIOS.items()) + " END"
    wide = ", ".join(f"max(fence) FILTER (ratio = '{r}') AS f_{r}" for r in RATIOS)
    # Ranks are moved by standard errors: lower quantiles up, upper ones down; these give their bin's greatest value.
    short, errors = "(size * {q} - upto * 100)::DOUBLE", f"(size * ({SURE * SURE} * {{q}} * (100 - {{q}})))::DOUBLE"
    top = "CASE WHEN v < 64 THEN v ELSE v + (1 << (length(bin(v)) - 6)::INT) - 1 END"
    low = f"min(v) FILTER ({short} <= 0 AND {short} * {short} >= {errors})"
    high = f"min({top}) FILTER (size * {{q}} > {SURE * SURE} * (100 - {{q}}) AND ({short} <= 0 OR {short} * {short} <= {errors}))"
    at = ", ".join((low if q <= 50 else high).format(q=q) + f" AS q{q}" for q in QUANTILES)
    verdict = " AND ".join(f"{value(r)} <= greatest(o.f_{r}, w.f_{r})" if x[6] == "high" else f"{value(r)} >= least(o.f_{r}, w.f_{r})" for r, x in RATIOS.items())

    def fences(name: str, groups: str) -> str:
        by = f"{groups}ratio"
        return f"""{name}_c AS (SELECT {groups}ratio, v, count(*) AS n FROM p GROUP BY {groups}ratio, v),
{name}_r AS (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY v) AS upto, sum(n) OVER (PARTITION BY {by}) AS size FROM {name}_c),
{name}_q AS (SELECT {groups}ratio, {at} FROM {name}_r GROUP BY {by}),
{name} AS (SELECT {groups}{wide} FROM (SELECT *, {fence} AS fence FROM {name}_q) {"GROUP BY lang, source" if groups else ""})"""

    return f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, lang, source, text, regexp_extract_all(text, '{WORD}') AS ws FROM d),
g AS (SELECT doc_id, i, (ws[i], ws[i + 1], ws[i + 2]) AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rg AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
rw AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM rg, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dl AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM ln WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
m AS (
  SELECT doc_id, lang, source, len(ws) AS n_words,
         coalesce(length(array_to_string(ws, '')), 0) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
         coalesce(dl.n, 0) AS n_dup_lines, coalesce(rw.n, 0) AS n_repeat_words
  FROM w LEFT JOIN rw USING (doc_id) LEFT JOIN dl USING (doc_id)
),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
p AS (SELECT lang, source, ratio, CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)::INT) << (length(bin(v)) - 6)::INT END AS v FROM ({pairs})),
{fences("own", "lang, source, ")},
{fences("whole", "")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce({verdict}, true) AS kept
FROM b LEFT JOIN own o
  ON b.lang IS NOT DISTINCT FROM o.lang AND b.source IS NOT DISTINCT FROM o.source CROSS JOIN whole w
"""


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import link_components

    return link_components(table(spark, sf_dir, "documents"))


OP10_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents
), sh AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END)) AS s
  FROM w WHERE len(ws) > 0
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (max(x.n) + max(y.n) - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.b) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id
"""


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import rate

    return rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack, with_lengths

    return pack(with_lengths(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM m
"""


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_automaton import digests

    return digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simple8b import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op2_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chroma import render, search

    return search(render(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vec_id", "media")


def op3_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pseudo_likelihood import rate

    return rate(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit() and callable(f)}

    def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
        import corpus_pipeline

        return corpus_pipeline.run(spark, sf_dir)

    return {**out, "pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op7_quality_rules": _op7_sql(), "op6_warc": OP6_SQL, "op10_jaccard_join": OP10_SQL}
