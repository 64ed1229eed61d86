"""Language identification: interpolated Kneser-Ney character models, one a language, in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgauge.llm.common import settle, text_hash
from cellgauge.llm.shingles import mix

# Characters of the longest gram. A character is 16 bits of a gram, so four fill a 64-bit number.
ORDER = 4
BITS, CODE = 16, (1 << 16) - 1
# Of an unseen character each code is as likely as any other.
UNIFORM = 1.0 / (1 << BITS)
# Characters worked on at once, and distinct grams held before they are passed on.
PIECE, HELD = 200_000, 500_000
# A model of more grams and contexts is not sent to the tasks; texts' grams then meet it in a shuffle.
MODEL_ROWS = 2_000_000
# Training texts whose hash is 0 modulo this are left out of the counts and calibrate the result.
CALIBRATE_ONE_IN = 16
# A text is rejected if so small a share of its language's calibration texts of like length is as unlikely; with fewer such
# texts than LEAST, beyond so many standard deviations of all of the language.
REJECT_SHARE, LEAST, REJECT_Z = 0.002, 200, 5.0
# Sharpness of the score, chosen by the calibration texts.
SHARPNESS = (0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0)
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def _letters() -> np.ndarray:
    """Code of each character: letters are themselves, those beyond 16 bits are folded into the private use area, all else is a blank."""
    codes = np.full(0x110000, 32, np.uint16)
    letter = np.array([c for c in range(0x110000) if chr(c).isalpha()], np.uint32)
    codes[letter] = np.where(letter <= CODE, letter, 0xE000 + letter % 0x1800)
    return codes


def _coded(texts: pa.Array, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """grams, row: every gram that ends in a character of the texts in lower case, runs of other characters as one blank, each text
    between blanks; and the number of the text. Long texts come in parts that overlap by what a gram reaches back. Texts without a
    letter have none."""
    held: list[tuple[int, np.ndarray]] = []
    size = 0

    def laid():
        chars = np.concatenate([c for _, c in held]).astype(np.uint64)
        sizes = np.array([len(c) for _, c in held])
        at = np.arange(len(chars)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        gram = chars.copy()
        for k in range(1, ORDER):
            gram[k:] |= chars[:-k] << np.uint64(BITS * k)
        real = at >= ORDER - 1
        return gram[real], np.repeat(np.array([r for r, _ in held]), sizes)[real]

    for row, text in enumerate(pc.utf8_lower(texts)):
        chars = codes[np.frombuffer((text.as_py() or "").encode("utf-32-le"), np.uint32)]
        keep = chars != 32
        if not keep.any():
            continue
        # The first of a run of blanks stays; ends are trimmed and set anew.
        keep[1:] |= chars[:-1] != 32
        chars = chars[keep]
        chars = chars[int(chars[0] == 32) : len(chars) - int(chars[-1] == 32)]
        chars = np.concatenate([np.full(ORDER - 1, 32, np.uint16), chars, [np.uint16(32)]])
        for at in range(0, len(chars) - ORDER + 1, PIECE):
            part = chars[at : at + PIECE + ORDER - 1]
            if held and size + len(part) > PIECE:
                yield laid()
                held, size = [], 0
            held.append((row, part))
            size += len(part)
    if held:
        yield laid()


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of ``docs`` (text, lang): counted a task at a time, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _letters()
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def flushed() -> pa.RecordBatch:
            langs = pa.array([x for x, (g, _) in held.items() for _ in range(len(g))], pa.string())
            grams = np.concatenate([g for g, _ in held.values()] or [np.zeros(0, np.uint64)]).view(np.int64)
            n = np.concatenate([c for _, c in held.values()] or [np.zeros(0, np.int64)])
            held.clear()
            return pa.RecordBatch.from_arrays([langs, pa.array(grams), pa.array(n)], names=["lang", "gram", "n"])

        for batch in batches:
            langs = batch.column(1)
            for lang in langs.unique().to_pylist():
                for gram, _ in _coded(batch.column(0).filter(pc.equal(langs, lang)), codes):
                    found, n = np.unique(gram, return_counts=True)
                    if lang in held:
                        g, c = held[lang]
                        found, at = np.unique(np.concatenate([g, found]), return_inverse=True)
                        n = np.bincount(at, np.concatenate([c, n])).astype(np.int64)
                    held[lang] = found, n.astype(np.int64)
                    if sum(len(g) for g, _ in held.values()) > HELD:
                        yield flushed()
        yield flushed()

    return docs.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _last(gram: Column, k: int) -> Column:
    """The last k characters."""
    return gram if k == ORDER else gram.bitwiseAND(F.lit((1 << BITS * k) - 1))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """lang, level, context, gram, value: of each level (characters of a gram) the discounted probability of every gram seen, and
    with ``context`` the share that each context leaves to the level below. Counts of the highest level are occurrences; below it
    a gram counts once for each different character before it. A level's discount is n1 / (n1 + 2 n2), of the numbers of
    grams that count once and twice, held between 0.05 and 0.95."""
    seen = counts.select("lang", "gram", F.col("n").alias("c"))
    parts = []
    for level in range(ORDER, 0, -1):
        once, twice = F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)
        rate = F.coalesce(F.try_divide(once, once + 2 * twice), F.lit(0.75))
        discount = seen.groupBy("lang").agg(F.least(F.greatest(rate, F.lit(0.05)), F.lit(0.95)).alias("d"))
        # One row a language.
        told = seen.join(F.broadcast(discount), "lang").withColumn("context", F.shiftrightunsigned("gram", BITS))
        sums = told.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds"), F.first("d").alias("d"))
        probability = told.join(sums.drop("d", "kinds"), ["lang", "context"]).select(
            "lang", F.lit(level).alias("level"), F.lit(False).alias("context"), "gram", ((F.col("c") - F.col("d")) / F.col("total")).alias("value")
        )
        left = sums.select(
            "lang", F.lit(level).alias("level"), F.lit(True).alias("context"), F.col("context").alias("gram"), (F.col("d") * F.col("kinds") / F.col("total")).alias("value")
        )
        parts += [probability, left]
        below = seen.withColumn("gram", _last(F.col("gram"), level - 1))
        seen = below.groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("c"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@dataclass(frozen=True)
class HashArrays:
    """Per language and level, hashes of grams in order with their probabilities, and of contexts with what they leave."""

    langs: list[str]
    grams: list[list[tuple[np.ndarray, np.ndarray]]]
    contexts: list[list[tuple[np.ndarray, np.ndarray]]]

    @staticmethod
    def of(rows: pa.Table) -> HashArrays:
        langs = sorted(set(rows["lang"].to_pylist()))
        number = {x: i for i, x in enumerate(langs)}
        where = np.array([number[x] for x in rows["lang"].to_pylist()], np.int64)
        level, kind = rows["level"].to_numpy(), rows["context"].to_numpy()
        hashed = mix(rows["gram"].to_numpy().astype(np.int64).view(np.uint64))
        value = rows["value"].to_numpy()

        def part(i: int, k: int, context: bool):
            at = np.flatnonzero((where == i) & (level == k) & (kind == context))
            at = at[np.argsort(hashed[at])]
            return hashed[at], value[at]

        return HashArrays(langs, *([[part(i, k, c) for k in range(1, ORDER + 1)] for i in range(len(langs))] for c in (False, True)))

    def probabilities(self, gram: np.ndarray) -> np.ndarray:
        """Row for each gram, column for each language: probability of the last character after those before it."""
        out = np.full((len(gram), len(self.langs)), UNIFORM)
        for k in range(1, ORDER + 1):
            own = gram & np.uint64((1 << BITS * k) - 1) if k < ORDER else gram
            tail, context = mix(own), mix(own >> np.uint64(BITS))
            for i in range(len(self.langs)):
                out[:, i] = _found(*self.grams[i][k - 1], tail, 0.0) + _found(*self.contexts[i][k - 1], context, 1.0) * out[:, i]
        return out


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), default)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


def _scored_in_place(docs: DataFrame, model: HashArrays) -> DataFrame:
    """``docs`` (without text) with n_chars and bits: characters scored, and the whole text's cost in bits for each language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c != "text"]
    width = len(model.langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, model = _letters(), shared.value
        for batch in batches:
            n, bits = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, width))
            for gram, row in _coded(batch.column(batch.num_columns - 1), codes):
                found, at = np.unique(gram, return_inverse=True)
                cost = -np.log2(model.probabilities(found))
                n += np.bincount(row, minlength=batch.num_rows)
                for i in range(width):
                    bits[:, i] += np.bincount(row, cost[at, i], batch.num_rows)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(bits.ravel()), width).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n), lists], names=[*rest, "n_chars", "bits"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest).schema)
    return docs.select(*rest, "text").mapInArrow(run, f"{schema}, n_chars bigint, bits array<double>")


def _scored_by_shuffle(docs: DataFrame, model: DataFrame, langs: list[str]) -> DataFrame:
    """The same for a model of any size: grams of distinct texts meet it level by level."""
    named = settle(docs.withColumns({"h1": text_hash(F.col("text")), "h2": F.xxhash64(F.lit(7), F.coalesce("text", F.lit("")))}), "named")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _letters()
        for batch in batches:
            h1, h2 = (batch.column(i).to_numpy() for i in (0, 1))
            for gram, row in _coded(batch.column(2), codes):
                by = np.lexsort((gram, row))
                gram, row = gram[by], row[by]
                new = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])]))
                n = np.diff(np.append(new, len(gram)))
                cols = [h1[row[new]], h2[row[new]], gram[new].view(np.int64), n]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["h1", "h2", "gram", "n"])

    texts = named.groupBy("h1", "h2").agg(F.min("text").alias("text"))
    own = settle(texts.mapInArrow(run, "h1 bigint, h2 bigint, gram bigint, n bigint"), "grams-of-texts")
    every = own.select("gram").distinct().select("gram", F.explode(F.array(*map(F.lit, langs))).alias("lang"), F.lit(UNIFORM).alias("p"))
    for k in range(1, ORDER + 1):
        told = model.where(F.col("level") == k)
        seen = told.where("NOT context").select("lang", F.col("gram").alias("_own"), F.col("value").alias("_p"))
        left = told.where("context").select("lang", F.col("gram").alias("_before"), F.col("value").alias("_left"))
        every = every.withColumn("_own", _last(F.col("gram"), k)).withColumn("_before", F.shiftrightunsigned("_own", BITS))
        every = every.join(seen, ["lang", "_own"], "left").join(left, ["lang", "_before"], "left").select(
            "gram", "lang", (F.coalesce("_p", F.lit(0.0)) + F.coalesce("_left", F.lit(1.0)) * F.col("p")).alias("p")
        )
    cost = own.join(settle(every, "costs"), "gram").groupBy("h1", "h2", "lang").agg(
        F.sum(-F.log2("p") * F.col("n")).alias("b"), F.sum("n").alias("n")
    )
    rows = cost.groupBy("h1", "h2").agg(
        F.max("n").alias("n_chars"), F.transform(F.sort_array(F.collect_list(F.struct("lang", "b"))), lambda x: x["b"]).alias("bits")
    )
    rest = [c for c in docs.columns if c != "text"]
    none = F.transform(F.array(*map(F.lit, langs)), lambda x: F.lit(0.0))
    return named.join(rows, ["h1", "h2"], "left").select(
        *rest, F.coalesce("n_chars", F.lit(0)).cast("long").alias("n_chars"), F.coalesce("bits", none).alias("bits")
    )


def identify(docs: DataFrame, model_rows: int = MODEL_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected, n_chars, cross_entropy for each row of ``docs`` (doc_id, text, lang): the language
    whose model gives the whole text the lowest cross-entropy, in bits a character (of equals the first by name).

    Models count the grams of all rows with a language that are not held out, but for one in 16 of them by the text's hash. Those
    calibrate: the score's sharpness, and up to what cross-entropy a text of its length passes as one of its language;
    ``rejected`` texts are beyond that, and still get the nearest language. Only the text is an input of a prediction. A model that is
    larger than ``model_rows`` is not sent to the tasks, but joined, with the same result.

    Null texts and those without a letter are 'und' with score 0; so are all if there is no language to learn. Very long texts are
    worked on in parts. Repeated rows and null ids get a row each. An empty table gives no rows."""
    rows = docs.select("doc_id", "text", F.when(~held_out(F.col("doc_id")), F.col("lang").cast("string")).alias("lang"))
    rows = rows.withColumn("aside", F.pmod(text_hash(F.col("text")), F.lit(CALIBRATE_ONE_IN)) == 0)
    model = settle(kneser_ney(settle(gram_counts(rows.where("lang IS NOT NULL AND NOT aside")), "gram-counts")), "model")
    langs = sorted(r[0] for r in model.select("lang").distinct().collect())
    if not langs:
        return docs.select(
            "doc_id",
            held_out(F.col("doc_id")).alias("held_out"),
            F.lit(UNKNOWN).alias("lang_pred"),
            F.lit(0.0).alias("score"),
            F.lit(False).alias("rejected"),
            F.lit(0).cast("long").alias("n_chars"),
            F.lit(None).cast("double").alias("cross_entropy"),
        )
    if model.limit(model_rows + 1).count() <= model_rows:
        scored = _scored_in_place(rows, HashArrays.of(model.toArrow()))
    else:
        scored = _scored_by_shuffle(rows, model, langs)
    each = F.when(F.col("n_chars") > 0, F.transform("bits", lambda b: b / F.col("n_chars")))
    scored = settle(scored.withColumn("each", each).withColumn("least", F.array_min("each")), "scored")
    names = F.array(*map(F.lit, langs))
    mine = F.array_position("each", F.col("least")).cast("int")
    told = scored.withColumns({"mine": mine, "size": F.floor(F.log2(F.greatest("n_chars", F.lit(1)))).cast("int")})

    # Sharpness by the calibration texts' log loss: one number for each choice.
    def share(of: Column, k: float) -> Column:
        """Of the language's exponential share, each exponent the distance from the best times the root of the length."""
        weigh = lambda x: F.exp(-(x - F.col("least")) * F.sqrt("n_chars") * k)
        return weigh(of) / F.aggregate("each", F.lit(0.0), lambda s, x: s + weigh(x))

    known = told.where(F.col("lang").isin(langs) & F.col("aside") & (F.col("n_chars") > 0))
    own = F.get("each", F.array_position(names, F.col("lang")).cast("int") - 1)
    losses = known.agg(*(F.avg(-F.log(F.greatest(share(own, k), F.lit(1e-12)))) for k in SHARPNESS)).first()
    k = min(zip((x if x is not None else 0.0 for x in losses), SHARPNESS))[1]
    limits = known.select(F.array_position(names, F.col("lang")).cast("int").alias("mine"), "size", own.alias("own"))
    by_lang = limits.groupBy("mine").agg((F.avg("own") + REJECT_Z * F.coalesce(F.stddev("own"), F.lit(0.0))).alias("far"))
    by_size = limits.groupBy("mine", "size").agg(F.percentile_approx("own", 1 - REJECT_SHARE, 10_000).alias("limit"), F.count(F.lit(1)).alias("texts"))
    by_size = by_size.where(F.col("texts") >= LEAST).drop("texts")
    # A row for each language, and one for each power of two of a length.
    judged = told.join(F.broadcast(by_lang), "mine", "left").join(F.broadcast(by_size), ["mine", "size"], "left")
    some = F.col("n_chars") > 0
    return judged.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.when(some, F.get(names, F.col("mine") - 1)).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(some, share(F.col("least"), k)).otherwise(0.0).alias("score"),
        (some & F.coalesce(F.col("least") > F.coalesce("limit", "far"), F.lit(False))).alias("rejected"),
        "n_chars",
        F.col("least").alias("cross_entropy"),
    )
