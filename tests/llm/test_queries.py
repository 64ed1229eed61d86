"""The registered queries against their SQL, and the stages of the pipeline."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from cellgauge.llm.oracle import SQL
from cellgauge.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, found.fetchall()))


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline") == list(range(1, 14))


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept.append(docs.count())
        if i < 4:
            assert docs.columns == columns, name
            assert docs.select("doc_id").subtract(before.select("doc_id")).isEmpty()
    # Rules and near duplicates drop documents; cutting and mixing keep them; packing keeps their ids.
    assert kept[0] >= kept[1] == kept[2] == kept[3] and 0 < kept[0] < 200
    assert docs.select("doc_id").distinct().count() == kept[3]


def test_sequences_follow_the_mixing_schedule(spark, monkeypatch):
    """Sources' shares in each range of sequences are those of the schedule, by brute force from its rows."""
    monkeypatch.setattr(corpus_pipeline.pack_in_order, "__defaults__", (1024, 200))
    rows = [(i, "word " * (5 + i % 400), "big" if i % 10 < 7 else "mid" if i % 10 < 9 else None) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.pack(spark, corpus_pipeline.mix(spark, docs, SF), SF).toPandas().sort_values(["sequence_id", "offset"])
    told = corpus_pipeline.mix_sources(docs).select("doc.doc_id", "source", "slot", "place").collect()
    order = [r.doc_id for r in sorted(told, key=lambda r: (r.slot, r.place))]
    source = {r.doc_id: r.source for r in told}
    assert sorted(got.doc_id) == sorted(order) and (got.groupby("sequence_id").length.sum() <= 1024).all()
    packed = got.doc_id.tolist()
    rank = {d: i for i, d in enumerate(order)}
    for i in range(0, len(order), 200):
        assert Counter(source[d] for d in packed[i : i + 200]) == Counter(source[d] for d in order[i : i + 200])
    firsts = got.drop_duplicates("sequence_id").doc_id.map(rank).tolist()
    assert firsts == sorted(firsts)


def test_boilerplate_lines_leave_the_pipeline(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    boiler = "Subscribe to our newsletter now"
    bodies = [" ".join(f"w{letters[i]}{x}{y}" for x in "abcde" for y in "vwxyz") for i in range(20)]
    rows = [(i, f"{boiler} {i}\n{body}", "a", 10**6) for i, body in enumerate(bodies)] + [(20, bodies[0] + "\n\nnone here", "b", 10**6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_low_quality(spark, docs, SF).collect()}
    assert got == {i: (body, len(body)) for i, body in enumerate(bodies)} | {20: (rows[20][1], 10**6)}


def test_lines_of_many_documents_leave_a_hot_host(spark):
    """A line in 100 of 1,100 texts is under a tenth of its host and goes all the same; one in 99 stays."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    bodies = [" ".join(f"{letters[i // 26 // 26]}{letters[i // 26 % 26]}{letters[i % 26]}{x}{y}" for x in "abcde" for y in "vwxyz") for i in range(1100)]
    heads = ["Read more of our stories here\n"] * 100 + ["A line that stays\n"] * 99 + [""] * 901
    docs = spark.createDataFrame([(i, h + b, "hot", 0) for i, (h, b) in enumerate(zip(heads, bodies))], "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_low_quality(spark, docs, SF).collect()}
    assert got == {i: (h + b if i >= 100 else b) for i, (h, b) in enumerate(zip(heads, bodies))}


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_stages_with_columns_of_the_operators_own_names(spark):
    """Extra columns that are called like those inside the operators pass through every stage as they are."""
    names = ["_th", "th", "_salt", "_salts", "_spread", "_n", "_one", "_row", "_rows", "doc", "kept", "kept_text", "slot", "place", "block", "component_id"]
    body = lambda i: " ".join(f"w{chr(97 + i)}{x}{y}" for x in "abcdefgh" for y in "stuvwxyz")
    rows = [(i, body(i), None if i % 4 == 0 else "s", 1) for i in range(8)] + [(9, body(1), "s", 1)] + [(3, body(3), "s", 1)] * 2
    rows += [(None, body(20), "s", 1), (30, None, None, None), (31, "", "s", 0)]
    told = [(*r, *(f"{n} {r[0]}" for n in names)) for r in rows]
    docs = spark.createDataFrame(told, "doc_id long, text string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.settle(stage(spark, docs, SF), "clash")
        assert docs.columns == before.columns, name
        assert all(r[n] == f"{n} {r.doc_id}" for r in docs.collect() for n in names), name
    assert Counter(r.doc_id for r in docs.collect()) == Counter([0, 1, 2, 3, 4, 5, 6, 7, None])
    assert corpus_pipeline.pack(spark, docs, SF).select("doc_id").distinct().count() == 9


def test_cut_repeats_hands_on_whole_characters(spark):
    """A passage that begins inside a character of the later text: what is left of the character goes too."""
    passage = "".join(chr(0x100 + 7 * i % 300) for i in range(120))
    rows = [(1, "first é" + passage + " end", "s", 1), (2, None, "s", 2), (3, "", "s", 3), (4, "other ũ" + passage + " tail", "s", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.cut_repeats(spark, docs, SF).collect()}
    # é and ũ end in the same byte, so the repeat begins with it.
    assert "é".encode()[-1:] == "ũ".encode()[-1:]
    assert got == {1: (rows[0][1], 1), 2: (None, 2), 3: ("", 3), 4: ("other tail", 10)}
