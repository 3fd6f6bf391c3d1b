"""Quality rules whose cut-offs follow the data: quantile sketches per language and source, then a joined filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breathline.llm.shared import Workspace

SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: measure -> (sides on which a text can be out of line, smallest spread that counts)
MEASURES = {
    "word_length": ("both", 1.0),
    "symbol_share": ("high", 0.05),
    "dup_line_share": ("high", 0.10),
    "repeat_share": ("high", 0.10),
}


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def text_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add word and line counts of whole texts; every step is one array expression of the row.

    Words are runs outside ``[\\x20\\x09-\\x0D]``; null has none. Three-word
    windows are sorted with their positions, so equal ones are neighbours;
    the words under windows found twice are the union of ``p, p+1, p+2``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select("*", F.array_remove(F.split(text, SPACE), "").alias("_words"))
    n = F.size("_words")
    windows = F.zip_with(
        F.zip_with("_words", F.slice("_words", 2, n), lambda a, b: F.concat_ws(" ", a, b)),
        F.slice("_words", 3, n),
        lambda ab, c: F.concat_ws(" ", ab, c),
    )
    df = df.select("*", F.slice(windows, 1, F.greatest(n - 2, F.lit(0))).alias("_windows"))
    df = df.select("*", F.sort_array(F.transform("_windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))).alias("_sorted"))
    none = F.array().cast("array<int>")
    same = F.zip_with(
        "_sorted", F.slice("_sorted", 2, F.greatest(F.size("_sorted"), F.lit(1))),
        lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])).otherwise(none),
    )
    df = df.select("*", F.sort_array(F.array_distinct(F.flatten(same))).alias("_at"))
    covered = F.zip_with(
        "_at", F.slice("_at", 2, F.greatest(F.size("_at"), F.lit(1))),
        lambda a, b: F.coalesce(F.least(F.lit(3), b - a), F.lit(3)),
    )
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(_without(line, SPACE_CHARS)) > 0)
    df = df.select("*", lines.alias("_lines"))
    return df.select(
        *[F.col(c) for c in docs.columns],
        F.size("_words").cast("long").alias("n_words"),
        F.length(_without(text, SPACE_CHARS)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.aggregate(covered, F.lit(0), lambda s, x: s + x).cast("long").alias("n_repeat_words"),
    )


def quality_rules(
    docs: DataFrame,
    work: Workspace,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_cols: Sequence[str] = ("lang", "source"),
    min_words: int = 50,
    max_repeat_percent: int = 50,
    reach: float = 3.0,
    min_group: int = 200,
    sketch_k: int = 800,
) -> DataFrame:
    """One row per document: its counts, ``base_failed`` and ``kept``.

    Fixed base rules come first. The other documents feed one quantile sketch
    per measure and group (all ``group_cols``); sketches of groups are merged
    into one per first column and one over all. A document is out of line if
    a measure lies beyond the quartile by more than ``reach`` spreads, where
    the spread is the larger of the quartile distance and the floor in
    ``MEASURES``. A group under ``min_group`` documents takes the cut-offs of
    the next wider sketch.

    Null group values form groups of their own; null and empty texts have no
    words and fail the base rules; repeated rows stay repeated; other columns
    are not read. An empty table gives an empty result. The sketches hold a
    bounded number of values each, are built before the shuffle and are all
    that is shuffled.
    """
    keys = [f"_g{i}" for i in range(len(group_cols))]
    picked = docs.select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.col(c).cast("string").alias(k) for c, k in zip(group_cols, keys, strict=True)]
    )
    counts = text_measures(picked, "_text").drop("_text")
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    measured = work.write(
        counts.select(
            "*",
            ((F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))).alias("base_failed"),
            (F.col("word_chars") / n).alias("word_length"),
            (F.col("n_symbols") / n).alias("symbol_share"),
            (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_line_share"),
            (F.col("n_repeat_words") / n).alias("repeat_share"),
        )
    )
    sketches = work.write(
        measured.where(~F.col("base_failed")).groupBy(*keys).agg(
            F.count("*").alias("_n"), *[F.kll_sketch_agg_double(m, F.lit(sketch_k)).alias(m) for m in MEASURES]
        )
    )

    def cut_offs(by: Sequence[str], level: int) -> DataFrame:
        merged = sketches.groupBy(*by).agg(
            F.sum("_n").alias(f"_n{level}"), *[F.kll_merge_agg_double(m, F.lit(sketch_k)).alias(m) for m in MEASURES]
        ) if list(by) != keys else sketches.withColumnRenamed("_n", f"_n{level}")
        ends = []
        for m, (sides, floor) in MEASURES.items():
            low, high = (F.when(F.col(f"_n{level}") > 0, F.kll_sketch_get_quantile_double(F.col(m), F.lit(q))) for q in (0.25, 0.75))
            spread = reach * F.greatest(high - low, F.lit(floor))
            ends.append(F.struct((low - spread if sides == "both" else F.lit(float("-inf"))).alias("low"), (high + spread).alias("high")).alias(m))
        return merged.select(*by, f"_n{level}", F.struct(*ends).alias(f"_cut{level}"))

    levels = [keys, keys[:1], []]
    judged = measured
    for level, by in enumerate(levels):
        cuts = cut_offs(by, level)
        if by:
            judged = judged.join(
                cuts.select(*[F.col(k).alias(f"{k}_") for k in by], f"_n{level}", f"_cut{level}"),
                [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in by],
                "left",
            ).drop(*[f"{k}_" for k in by])
        else:  # one row over all groups
            total = cuts.first()
            judged = judged.withColumn(
                f"_cut{level}",
                F.struct(*[F.struct(F.lit(total[f"_cut{level}"][m][0]).cast("double").alias("low"), F.lit(total[f"_cut{level}"][m][1]).cast("double").alias("high")).alias(m) for m in MEASURES]),
            )
    cut = F.when(F.col("_n0") >= min_group, F.col("_cut0")).when(F.col("_n1") >= min_group, F.col("_cut1")).otherwise(F.col("_cut2"))
    judged = judged.withColumn("_cut", cut)
    in_line = F.lit(True)
    for m in MEASURES:
        in_line &= F.coalesce(F.col(m).between(F.col("_cut")[m]["low"], F.col("_cut")[m]["high"]), F.lit(True))
    return judged.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & in_line).alias("kept"),
    )
