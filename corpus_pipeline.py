"""Raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) with the columns of ``documents`` and works on all rows it is given; all but the
last return the same columns. Between stages the rows are written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgauge.llm.common import settle, single, table, text_hash
from cellgauge.llm.mixing import ORDER, in_mixed_order, mix_sources
from cellgauge.llm.neardup import verdicts
from cellgauge.llm.packing import pack_in_order, token_pieces
from cellgauge.llm.quality import quality_rules
from cellgauge.llm.queries import vocabulary
from cellgauge.llm.repeats import remove_repeats
from cellgauge.operators.joins import spread_join


def _with_kept_text(rows: DataFrame, changed: Column, columns: list[str]) -> DataFrame:
    """The documents ``doc``, with ``kept_text`` as their text where it is another one."""
    doc = F.when(
        changed,
        F.col("doc").withField("text", F.col("kept_text")).withField("n_chars", F.char_length("kept_text").cast("long")),
    ).otherwise(F.col("doc"))
    return rows.select(doc.alias("doc")).select("doc.*").select(*columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their boilerplate lines; n_chars counts what is left."""
    kept = quality_rules(docs).where("kept")
    return _with_kept_text(kept, F.col("kept_text") != F.col("doc.text"), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id, and one row of it. Texts that
    share an id are judged one by one. Rows without an id stay."""
    key = ["doc_id", "_th"]
    gone = verdicts(docs).where("NOT kept AND doc_id IS NOT NULL").select("doc_id", F.col("th").alias("_th")).distinct()
    # Rows travel as one struct, so their columns cannot clash with those of the joins.
    named = docs.select("doc_id", text_hash(F.col("text")).alias("_th"), F.struct("*").alias("doc"))
    left = spread_join(named, settle(gone, "near-duplicates"), key, "left_anti", F.monotonically_increasing_id())
    return single(left, key, "near-duplicates").select("doc.*").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur earlier; n_chars counts what is left. No document goes."""
    cut = remove_repeats(docs, with_text=True)
    return _with_kept_text(cut, F.col("n_removed") > 0, docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in an order that holds the sources to their target weights."""
    return in_mixed_order(mix_sources(docs)).select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in training sequences, which by number follow the mixing schedule.

    The schedule depends on the rows alone, so it is worked out again from them: the order of files does not survive
    every reader."""
    mixed = mix_sources(docs.select("doc_id", "text", "source")).select("doc.doc_id", "doc.text", *ORDER)
    return pack_in_order(token_pieces(mixed, vocabulary("byte_bpe_50k.json"), carry=ORDER), ORDER)


STAGES = [
    ("quality rules", drop_low_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

# No SQL: sketches, the packing search and byte-pair ids have no SQL form; tests hold stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
