"""Quality rules with thresholds that follow each language and source.

The statistics of each text (:func:`measure`) are made into whole-number ratios.  For each
language and source, a quantile sketch of each ratio is kept: a log-linear histogram with
32 steps an octave, so relative error is at most 1/32, its size is bounded by the width
of a bin number, and two sketches merge by adding the counts of equal bins.  Sketches are
plain rows (group, ratio, bin, count) and their merge is a sum, so Spark builds them with
map-side aggregation, and every run gives the same thresholds.

A threshold is a fence: an upper quantile of the group and ``reach`` times its distance from a
lower one, both read off the sketch (mirrored for ratios with a lower fence).  Of few texts a quantile is uncertain:
the upper one is taken ``SURE`` standard errors of its rank lower and the lower one as much
higher, and where that leaves no rank, the group has no fence of its own.  No fixed cutoff
takes part: where a language and source write with symbols, symbols are let pass.  The pair of
quantiles says how large a share of junk a fence withstands: a quarter for symbols and word
lengths; repeats and doubled lines have long tails in good texts and junk of that kind is
rare past the base rule, so theirs stand at 99 %.  A group's fence
is never tighter than that of the merged sketch of all texts, so a small or uniform group
throws out nothing that is common elsewhere.

Edge cases: null texts have no words and fail the base rule; null languages and sources
are a group of their own; rows with the same id are judged each; an empty table gives an
empty table; columns named like the operator's own are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textscan
from .common import byte_sizes, drop_own, extend_schema, materialize, slices

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Ratio: numerator, denominator, scale, lower and upper quantile, reach, side.  "high" rejects above the fence.
RATIOS: dict[str, tuple[str, str, int, int, int, int, str]] = {
    "symbols": ("n_symbols", "n_words", 1000, 50, 75, 6, "high"),
    "word_length_high": ("word_chars", "n_words", 100, 25, 75, 6, "high"),
    "word_length_low": ("word_chars", "n_words", 100, 25, 75, 6, "low"),
    "repeats": ("n_repeat_words", "n_words", 1000, 50, 99, 3, "high"),
    "dup_lines": ("n_dup_lines", "n_words", 1000, 50, 99, 10, "high"),
}
SURE = 3
QUANTILES = sorted({q for r in RATIOS.values() for q in r[3:5]})  # up to 50 lower ones
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def repeated(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Marks keys found twice or more in their row."""
    both = textscan.mix(keys + textscan.mix(rows.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(both, kind="stable")
    same = both[order][1:] == both[order][:-1]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def measure_texts(texts: pa.Array) -> dict[str, np.ndarray]:
    data, offsets = textscan.buffer_of(texts)
    n = len(offsets) - 1
    words = textscan.words(data, offsets)

    def per_row(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]

    grams, first = textscan.windows(words, 3)
    covered = np.zeros(len(words.hash) + 3, dtype=bool)
    twice = first[repeated(grams, words.row[first])]
    for k in range(3):
        covered[twice + k] = True
    lines = textscan.lines(data, offsets)
    with_word = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
    hashes, rows = lines.hash[with_word], lines.row[with_word]
    both = textscan.mix(hashes + textscan.mix(rows.astype(np.uint64) + np.uint64(1)))
    distinct = np.bincount(rows[np.unique(both, return_index=True)[1]], minlength=n) if len(rows) else np.zeros(n, dtype=np.int64)
    return {
        "n_words": np.diff(words.row_start),
        "word_chars": per_row(((data & 0xC0) != 0x80) & ~textscan.IS_SPACE[data]),
        "n_symbols": per_row(_SYMBOL[data]),
        "n_dup_lines": np.bincount(rows, minlength=n) - distinct,
        "n_repeat_words": np.bincount(words.row[covered[: len(words.hash)]], minlength=n),
    }


def measure(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if None) plus those of :data:`COUNTS`."""
    docs = drop_own(docs, [*COUNTS, *RATIOS, "base_failed", "kept"])
    names = docs.columns if keep is None else keep
    inner = docs.select(*dict.fromkeys([*names, text_col]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            sizes = byte_sizes(texts)
            for a, b in slices(sizes, 2 << 20):
                got = measure_texts(texts.slice(a, b - a))
                columns = [batch.column(batch.schema.get_field_index(c)).slice(a, b - a) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(got[c].astype(np.int64)) for c in COUNTS)], names=[*names, *COUNTS])

    return inner.mapInArrow(run, extend_schema(inner.select(*names), *((c, T.LongType()) for c in COUNTS)))


def bin_of(value: Column) -> Column:
    """Bins of the sketch, in whole-number arithmetic: exact below 64, then 32 an octave."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.when(value < 64, value).otherwise((shift * 32).cast("bigint") + F.call_function("shiftright", value, shift))


def bin_floor(b: Column) -> Column:
    """The least value of a bin."""
    shift = F.when(b < 64, F.lit(0)).otherwise(F.floor(b / 32) - 1).cast("int")
    return F.call_function("shiftleft", b - (shift * 32).cast("bigint"), shift)


def bin_top(b: Column) -> Column:
    """The greatest value of a bin."""
    return bin_floor(b + 1) - 1


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ratio(name: str) -> Column:
    top, bottom, scale, *_ = RATIOS[name]
    return F.expr(f"({scale} * {top}) div greatest({bottom}, 1)")


def sketch(measured: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, ratio, bin, n) over texts that pass the base rule; the sum of two sketches is that of both."""
    pairs = F.explode(F.array(*(F.struct(F.lit(r).alias("ratio"), bin_of(ratio(r)).alias("bin")) for r in RATIOS)))
    return measured.where(~base_failed()).select(*groups, pairs.alias("p")).groupBy(*groups, "p.ratio", "p.bin").agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, groups: list[str]) -> DataFrame:
    return sketches.groupBy(*groups, "ratio", "bin").agg(F.sum("n").alias("n"))


def _quantile(q: int) -> Column:
    """A quantile of (bin, upto, size) rows, by the careful rank."""
    short = (F.col("size") * q - F.col("upto") * 100).cast("double")
    errors = (F.col("size") * (SURE * SURE * q * (100 - q))).cast("double")
    if q <= 50:
        return F.min(F.when((short <= 0) & (short * short >= errors), bin_floor(F.col("bin"))))
    known = F.col("size") * q > SURE * SURE * (100 - q)
    return F.min(F.when(known & ((short <= 0) | (short * short <= errors)), bin_top(F.col("bin"))))


def fences(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, and one fence a ratio) from merged sketches."""
    group = ", ".join([*groups, "ratio"])
    ranked = sketches.withColumn("upto", F.expr(f"sum(n) over (partition by {group} order by bin)")).withColumn("size", F.expr(f"sum(n) over (partition by {group})"))
    found = ranked.groupBy(*groups, "ratio").agg(*(_quantile(q).alias(f"q{q}") for q in QUANTILES))
    fence = F.lit(None).cast("bigint")
    for name, (*_, low, high, reach, side) in RATIOS.items():
        q, p = F.col(f"q{low}"), F.col(f"q{high}")
        spread = reach * F.when(p > q, p - q).otherwise(p - p)
        fence = F.when(F.col("ratio") == name, p + spread if side == "high" else q - spread).otherwise(fence)
    return found.withColumn("fence", fence).groupBy(*groups).agg(*(F.max(F.when(F.col("ratio") == r, F.col("fence"))).alias(f"fence_{r}") for r in RATIOS))


def judge(measured: DataFrame, sketches: DataFrame, groups: list[str]) -> DataFrame:
    """``measured`` joined with its group's fences, giving ``base_failed`` and ``kept``."""
    own = fences(sketches, groups)
    own = own.select(*(F.col(g).alias(f"g_{g}") for g in groups), *(F.col(f"fence_{r}").alias(f"own_{r}") for r in RATIOS))
    whole = fences(merge(sketches, []), []).first()  # one row
    on = [F.col(g).eqNullSafe(F.col(f"g_{g}")) for g in groups]
    joined = measured.join(own, on, "left")
    fine = F.lit(True)
    for name, (*_, side) in RATIOS.items():
        own_fence, all_fence = F.col(f"own_{name}"), F.lit(whole[f"fence_{name}"]).cast("bigint")
        fine = fine & (ratio(name) <= F.greatest(own_fence, all_fence) if side == "high" else ratio(name) >= F.least(own_fence, all_fence))
    return joined.select(*measured.columns, base_failed().alias("base_failed"), (~base_failed() & F.coalesce(fine, F.lit(True))).alias("kept"))


def rate(docs: DataFrame, text_col: str = "text", groups: tuple[str, ...] = ("lang", "source"), id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``id_cols``, the counts, ``base_failed`` and ``kept`` of each row of ``docs``."""
    keep = list(dict.fromkeys([*id_cols, *groups]))
    measured = materialize(measure(docs, text_col, keep), "rules-measured")
    sketches = materialize(sketch(measured, list(groups)), "rules-sketches")
    return judge(measured, sketches, list(groups)).select(*id_cols, *COUNTS, "base_failed", "kept")


def filter_rules(docs: DataFrame, text_col: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The rows of ``docs`` that pass.  Texts are measured again rather than shuffled to meet their verdict."""
    sketches = materialize(sketch(measure(docs, text_col, list(groups)), list(groups)), "rules-sketches")
    verdicts = judge(measure(docs, text_col), sketches, list(groups))
    return verdicts.where("kept").select(*docs.columns)
