"""Quality rules: base counts of each text and the frequency of its lines across documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgauge.llm.common import SPACES, let, settle, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
# Most words, in percent, that repeated windows may cover.
REPEAT_PERCENT = 30
# A line is boilerplate if at least so many distinct texts of its host hold it ...
MIN_HOLDERS = 10
# ... and they are more than this share of the host's distinct texts, or
LINE_SHARE = 0.1
# so many, however large the host.
MOST_HOLDERS = 100
# A document is depleted if less than this share of its words is left without boilerplate lines.
LEFT_SHARE = 0.3


def repeat_words(hashes: Column, window: int = WINDOW) -> Column:
    """Words in windows of ``window`` words that occur twice or more in the text, first included.

    ``hashes``: one hash for each word. Most texts repeat no window and stop at the distinct count; for the
    rest windows are sorted with their places, and the union of the repeated places is measured in order."""
    n = F.size(hashes)
    starts = F.sequence(F.lit(0), n - window)
    windows = F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i + 1, window)))

    def covered(ws: Column) -> Column:
        pairs = F.sort_array(F.transform(ws, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = let(
            pairs,
            lambda p: F.sort_array(
                F.transform(
                    F.filter(
                        p,
                        lambda x, i: ((i > 0) & (F.get(p, i - 1)["h"] == x["h"]))
                        | ((i + 1 < F.size(p)) & (F.get(p, i + 1)["h"] == x["h"])),
                    ),
                    lambda x: x["i"],
                )
            ),
        )
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(
            places,
            start,
            lambda s, i: F.struct(
                (s["n"] + F.least(F.lit(window), i - s["last"])).cast("long").alias("n"), i.cast("int").alias("last")
            ),
            lambda s: s["n"],
        )

    zero = F.lit(0).cast("long")
    some = let(windows, lambda ws: F.when(F.size(F.array_distinct(ws)) == F.size(ws), zero).otherwise(covered(ws)))
    return F.when(n <= window, zero).otherwise(some)


def base_counts(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    bare = F.translate(text, SPACES, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    hashes = F.transform(words_of(text), lambda w: F.xxhash64(w))
    counted = let(hashes, lambda h: F.struct(F.size(h).cast("long").alias("n"), repeat_words(h).alias("r")))
    return {
        "_counted": counted,
        "word_chars": F.char_length(bare).cast("long"),
        "n_symbols": (F.char_length(bare) - F.char_length(F.translate(bare, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def _normal(line: Column) -> Column:
    """Hashes of the words of a line in lower case with runs of digits as one zero; so the kind and amount of white space
    do not matter."""
    return F.transform(words_of(F.regexp_replace(F.lower(line), "[0-9]+", "0")), lambda w: F.xxhash64(w))


def normal_lines(text: Column) -> Column:
    """Lines with a word as (h, w): hash of the normalised line and its number of words."""
    hashed = F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n"),
        lambda x: let(_normal(x), lambda ws: F.struct(F.xxhash64(ws).alias("h"), F.size(ws).alias("w"))),
    )
    return F.filter(hashed, lambda x: x["w"] > 0)


def without_lines(text: Column, hashes: Column) -> Column:
    """(kept_text, n_removed_lines): the text without the lines whose normalised form has one of the hashes, and how many they are."""
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains(hashes, F.xxhash64(_normal(x))))
    cut = let(
        kept,
        lambda x: F.struct(F.array_join(x, "\n").alias("kept_text"), (F.size(lines) - F.size(x)).cast("long").alias("n_removed_lines")),
    )
    whole = F.struct(text.alias("kept_text"), F.lit(0).cast("long").alias("n_removed_lines"))
    return F.when(F.size(hashes) > 0, cut).otherwise(whole)


def line_rules(
    docs: DataFrame,
    host: str = "source",
    min_holders: int = MIN_HOLDERS,
    line_share: float = LINE_SHARE,
    most_holders: int = MOST_HOLDERS,
) -> DataFrame:
    """Columns _key, boilerplate_words, boilerplate: words in boilerplate lines, and the hashes of those lines,
    of each distinct text of each host that has any; the key is a hash of both.

    Lines are hashed, one row for each distinct line of each distinct text, and written once for both uses; exact copies of a text
    count as one document. Counts have map-side combine; frequent lines meet texts in a join that adaptive execution
    can split, so neither a hot host nor a hot line is a hot task."""
    texts = (
        docs.select(F.col(host).cast("string").alias("_host"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
        .withColumn("_text", F.xxhash64("text"))
    )
    lines = (
        texts.select("_host", "_text", F.explode(normal_lines(F.col("text"))).alias("_line"))
        .groupBy("_host", "_text", F.col("_line.h").alias("_h"), F.col("_line.w").alias("_w"))
        .agg(F.count(F.lit(1)).alias("_times"))
    )
    lines = settle(lines, "lines")
    # Copies of a text add to _times alike for every line of it; the text's own count takes that out again.
    copies = texts.groupBy("_host", "_text").agg(F.count(F.lit(1)).alias("_copies"))
    held = lines.groupBy("_host", "_h").agg(F.count(F.lit(1)).alias("_holders"))
    sizes = copies.groupBy("_host").agg(F.count(F.lit(1)).alias("_texts"))
    enough = F.col("_holders") >= most_holders
    frequent = (
        held.where(F.col("_holders") >= min_holders)
        .join(sizes.withColumnRenamed("_host", "_of"), F.col("_host").eqNullSafe(F.col("_of")))
        .where((F.col("_holders") > F.col("_texts") * line_share) | enough)
        .select(F.xxhash64("_host", "_h").alias("_key"))
    )
    hit = lines.withColumn("_key", F.xxhash64("_host", "_h")).join(frequent, "_key", "left_semi")
    words = hit.groupBy("_host", "_text").agg(
        F.sum(F.col("_w") * F.col("_times")).alias("_words"), F.collect_set("_h").alias("boilerplate")
    )
    key = F.xxhash64("_host", "_text")
    return words.withColumn("_key", key).join(copies.select(key.alias("_key"), "_copies"), "_key").select(
        "_key", (F.col("_words") / F.col("_copies")).cast("long").alias("boilerplate_words"), "boilerplate"
    )


def quality_rules(
    docs: DataFrame,
    host: str = "source",
    min_holders: int = MIN_HOLDERS,
    line_share: float = LINE_SHARE,
    left_share: float = LEFT_SHARE,
    most_holders: int = MOST_HOLDERS,
) -> DataFrame:
    """``docs`` as struct ``doc`` with the base counts, base_failed, boilerplate_words, kept, kept_text, the
    text without boilerplate lines, and n_removed_lines.

    A document fails the base for fewer than 20 words or for repeated 8-word windows over more than 30
    percent of its words. Of the others, one is rejected as depleted if less than ``left_share`` of its
    words, or fewer than 20, are outside boilerplate lines: lines held by ``min_holders`` or more distinct
    texts of its host, if these are more than ``line_share`` of them or ``most_holders`` or more. Exact copies count as one text, so a text is
    not boilerplate because it was copied.

    Null text: no words, fails. Null host: a host like others. Repeated rows get equal verdicts. Very long
    texts are taken whole. An empty table gives no rows."""
    key = F.xxhash64("_host", "_text")
    flat = docs.select(
        F.struct("*").alias("doc"), F.col(host).cast("string").alias("_host"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text")
    )
    counts = flat.select("doc", key.alias("_key"), *(c.alias(n) for n, c in base_counts(F.col("doc.text")).items()))
    counts = counts.select(
        "*", F.col("_counted.n").alias("n_words"), F.col("_counted.r").alias("n_repeat_words")
    ).withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")),
    )
    rules = line_rules(docs, host, min_holders, line_share, most_holders)
    left = F.col("n_words") - F.coalesce("boilerplate_words", F.lit(0))
    hashes = F.coalesce("boilerplate", F.array().cast("array<bigint>"))
    met = counts.join(rules, "_key", "left").withColumn("_cut", without_lines(F.col("doc.text"), hashes))
    return met.select(
        "doc",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        F.coalesce("boilerplate_words", F.lit(0)).cast("long").alias("boilerplate_words"),
        (~F.col("base_failed") & (left >= MIN_WORDS) & (left >= F.col("n_words") * left_share)).alias("kept"),
        F.col("_cut.kept_text").alias("kept_text"),
        F.col("_cut.n_removed_lines").alias("n_removed_lines"),
    )
