"""Token counts, packing, near duplicates, toxicity, top-k and repeats against plain Python."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellgauge.llm import neardup, packing, repeats, shingles, tokens, topk, toxicity
from cellgauge.llm.queries import vocabulary

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, shared passages, repeats inside a text, odd white space, nulls, empty and long texts."""
    rng = random.Random(5)
    base = prose(rng, 120)
    words = base.split()
    out = [base, base, None, "", "  ", "two words", "Two  WORDS", base.upper(), prose(rng, 9000)]
    for k in range(30):
        edited = list(words)
        for i in rng.sample(range(120), k % 6):
            edited[i] = f"edit{k}x{i}"
        out.append(" ".join(edited))
    passage = prose(rng, 60)
    for _ in range(25):
        out.append(prose(rng, rng.randrange(5, 60)) + "\n" + passage + " " + prose(rng, rng.randrange(0, 60)))
    out.append(passage[3:200] + " and again " + passage[3:200] + "ééé☃" * 60)
    out.append("ab" * 300)
    out += ["<|endoftext|> in text", "a\n <|endoftext|>  b ", "tab\t\there\n\n  x", "it's  we'll   q r", "漢字かな交じり文 🙂"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    schema = "doc_id long, text string, piece string, th int, n_shingles int, `end` string"
    return spark.createDataFrame([(i, t, "p", 1, 2, "e") for i, t in enumerate(texts)], schema)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# --- token counts ------------------------------------------------------------------------------


def plain_pieces(token, pieces, byte_score):
    best = [(0.0, 0)]
    for j in range(1, len(token) + 1):
        n = len(token[j - 1].encode())
        options = [(best[j - 1][0] + n * byte_score, -(best[j - 1][1] + n))]
        options += [(best[i][0] + pieces[token[i:j]], -(best[i][1] + 1)) for i in range(j) if token[i:j] in pieces]
        s, k = max(options)
        best.append((s, -k))
    return best[-1][1]


def test_token_counts(docs, texts, none):
    path = vocabulary("piece_bpe_32k.model")
    pieces, byte_score = tokens.zipf_unigram(path)
    assert math.isclose(sum(map(math.exp, pieces.values())), 1)
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in tokens.token_counts(docs, path).collect()}
    for i, t in enumerate(texts):
        words = (t or "").encode().split()
        known = {w: plain_pieces("▁" + w.decode(), pieces, byte_score) for w in set(words)}
        assert got[i] == (len(words), sum(known[w] for w in words))
    assert tokens.token_counts(none, path).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text("abc▁", min_size=1, max_size=12), min_size=1, max_size=20))
def test_trie_scores_shared_prefixes_once(words):
    pieces = {"▁": -1.0, "a": -2.0, "b": -2.5, "ab": -3.0, "abc": -3.2, "▁a": -1.5, "ca": -4.0}
    trie = tokens.TokenTrie(pieces, -3.0)
    for w in words:
        assert trie.insert(w.encode()) == plain_pieces("▁" + w, pieces, -3.0)
    assert len(trie.score) == 1 + len({("▁" + w)[:k] for w in words for k in range(1, len(w) + 2)})


# --- packing -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))


def test_ids_are_the_tokenizers(texts, tokenizer):
    coder = tokens.BytePairIds(vocabulary("byte_bpe_50k.json"))
    for t in texts:
        assert np.frombuffer(coder.ids(t or ""), "<u4").tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"ab1é' \n\t .,!漢", " the", "'s", "<|endoftext|>", "  "]), max_size=30).map("".join))
def test_ids_of_odd_white_space(text):
    global _coder, _tokenizer
    try:
        _coder
    except NameError:
        from tokenizers import Tokenizer

        _coder, _tokenizer = tokens.BytePairIds(vocabulary("byte_bpe_50k.json")), Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    assert np.frombuffer(_coder.ids(text), "<u4").tolist() == _tokenizer.encode(text, add_special_tokens=False).ids


def test_packing(docs, texts, tokenizer, none):
    path = vocabulary("byte_bpe_50k.json")
    got = packing.best_fit_packing(docs, path).toPandas()
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        mine = got[got.doc_id == i].sort_values("piece")
        assert mine.piece.tolist() == list(range(len(mine)))
        assert mine.start.tolist() == [0, *np.cumsum(mine.length)[:-1].tolist()] and mine.length.sum() == len(ids)
        assert (mine.length[1:] == 1024).all() and len(mine) == -(-len(ids) // 1024)
        for r in mine.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1].tolist()] and s.length.sum() <= 1024
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 1024) + 1
    assert packing.best_fit_packing(none, path).count() == 0
    odd = packing.best_fit_packing(docs.limit(2).selectExpr("if(doc_id = 0, null, 9007199254740993) AS doc_id", "text"), path)
    assert {r.doc_id for r in odd.collect()} == {None, 9007199254740993}


def test_packing_in_many_blocks(spark):
    rng = random.Random(1)
    rows = [(i, 0, 0, rng.randrange(1, 1025), i) for i in range(6000)] + [(7, 0, 0, 600, 7)] * 500
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack_pieces(pieces, block_pieces=700).toPandas()
    assert Counter(got.length) == Counter(r[3] for r in rows) and (got.fill <= 1024).all()
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1].tolist()] and s.length.sum() == s.fill.iloc[0]
    least = max(got.length.sum() / 1024, (got.length > 512).sum())
    assert got.sequence_id.nunique() <= 1.02 * least + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=40), st.randoms())
def test_local_search_never_loses(lengths, rng):
    bins = packing.Bins(60, lengths)
    order = list(range(len(lengths)))
    rng.shuffle(order)
    for i in order:  # next fit, so that there is something to do
        if bins.items and bins.free[-1] >= lengths[i]:
            bins.put(i, len(bins.items) - 1)
        else:
            bins.open([i])
    before = bins.used()
    bins.local_search()
    assert sorted(i for b in bins.items for i in b) == sorted(order) and bins.used() <= before
    assert all(f == 60 - sum(lengths[i] for i in b) >= 0 for f, b in zip(bins.free, bins.items))


def test_local_search_swaps(spark):
    # 6+3 and 5+4+... : only exchanges empty the last bin.
    bins = packing.Bins(10, [6, 3, 5, 4, 1, 1])
    for b in ([0, 1], [2, 3], [4], [5]):
        bins.open(b)
    bins.local_search()
    assert bins.used() == 2


# --- near duplicates ---------------------------------------------------------------------------


def plain_sets(text):
    words = (text or "").encode()
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in words).split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if len(words) >= 5 else frozenset([tuple(words)])


def plain_components(sets, percent):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] and sets[b]:
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(docs, texts, percent):
    sets = [plain_sets(t) for t in texts]
    want = plain_components(sets, percent)
    got = {r.doc_id: r for r in neardup.near_duplicates(docs, percent).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(texts))] == want
    assert all(got[i].kept == (want[i] == i) for i in range(len(texts)))
    assert len(set(want)) < len(want)


@pytest.mark.parametrize("slice_size", [2048, 9])
def test_near_duplicates_whose_smallest_id_is_no_centre(spark, slice_size, monkeypatch):
    """One large group, in one block and cut into slices that meet pair by pair."""
    monkeypatch.setattr(neardup, "SLICE", slice_size)
    rng = random.Random(9)
    words = prose(rng, 200).split()
    texts = []
    for k in range(80):  # each copy is linked to the base, few to each other
        edited = list(words)
        for i in rng.sample(range(0, 200, 7), 3):
            edited[i] = f"x{k}y{i}"
        texts.append(" ".join(edited))
    texts.append(" ".join(words))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = plain_components([plain_sets(t) for t in texts], 85)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame, 85).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_near_duplicates_odd_rows(spark, none):
    assert neardup.near_duplicates(none).count() == 0
    text = "one two three four five six"
    rows = [(None, text), (4, text), (4, text), (2, text + "!"), (None, "all alone here"), (9, None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == Counter(
        [(None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (2, 2, 2, True), (None, 1, None, False), (9, 0, 9, True)]
    )


def test_near_duplicates_that_share_ids(spark):
    """One id for two texts: each group keeps one row, and a text that is no copy stays."""
    import corpus_pipeline

    rng = random.Random(21)
    one, two, three, four = (prose(rng, 60) for _ in range(4))
    rows = [(1, one), (1, two), (2, one + " end"), (3, two + " end"), (3, three), (4, four), (4, four.upper()), (5, four), (6, "x y z"), (6, "x y z"), (7, None), (None, one)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(frame).collect())
    assert got == Counter([(1, 1, True)] * 2 + [(2, 1, False), (3, 1, False), (3, 3, True), (4, 4, True), (4, 4, False), (5, 4, False)] + [(6, 6, True)] * 2 + [(7, 7, True), (None, 1, False)])
    left = Counter(map(tuple, corpus_pipeline.drop_near_duplicates(spark, frame, "").collect()))
    fours = [r for r in left if r[0] == 4]
    assert len(fours) == 1 and fours[0][1].lower() == four
    assert left == Counter([(1, one), (1, two), (3, three), fours[0], (6, "x y z"), (7, None), (None, one)])


def test_sketches_merge_and_estimate():
    x = shingles.stream(3000, 99)
    a, b, both = x[:2000], x[1000:], x
    assert (np.maximum(neardup.registers(a), neardup.registers(b)) == neardup.registers(both)).all()
    guess = [
        neardup.estimated(neardup.registers(y[:2000])[None], neardup.registers(y[1000:])[None], np.array([2000.0]), np.array([2000.0]))[0]
        for y in (shingles.stream(3000, s) for s in range(30))
    ]
    assert abs(np.mean(guess) - 1 / 3) < 0.04


# --- toxicity ----------------------------------------------------------------------------------


def test_toxicity_on_held_out_documents(spark, none):
    rng = random.Random(3)
    bad = ["vile", "rotten", "filth"]
    rows, labels = [], []
    for i in range(900):
        sentences = [prose(rng, 8) for _ in range(rng.randrange(1, 12))]
        toxic = i % 4 == 0
        if toxic:
            k = rng.randrange(len(sentences))
            sentences[k] = f"you {rng.choice(bad).title()} thing " + sentences[k]
        rows.append((i, ". ".join(sentences) + ".", 1.0))
        labels.append((i, int(toxic), 3))
    rows += [(1000, None, 1.0), (1001, "", 1.0), (None, "vile rotten filth", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    told = spark.createDataFrame([*labels, (1, None, 0), (None, 1, 0)], "doc_id long, toxic int, text int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, told).collect()}
    assert len(got) == len(rows)
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in set(held)) for i in range(900))
    assert sum(got[i].predicted == labels[i][1] for i in held) / len(held) > 0.98
    for i in held:
        if got[i].predicted:
            assert any(b in o.sentence.lower() for o in got[i].offending for b in bad)
    assert got[1000].score == got[1001].score < 0.5 < got[None].score and all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.toxicity(none, told).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, told.where("toxic IS NULL")).collect()} == {0.5}


def test_toxicity_by_plain_python(spark):
    """Every score is the noisy-or written out, and the fit is a minimum of the penalised loss written out."""
    rng = random.Random(8)
    rows = [(i, ". ".join(prose(rng, 5) + (" vile" if i % 5 == 0 and j == 0 else " rotten" if rng.random() < 0.02 else "") for j in range(4))) for i in range(600)]
    rows += [(700, None), (701, ""), (702, "VILE!vile\nrotten . é vile?"), (703, "rotten " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    truth = {i: int(i % 5 == 0) for i, _ in rows[:600]}
    labels = spark.createDataFrame(list(truth.items()), "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert b"vile" in model.weights and len(model.weights) < 20

    def bags(text):
        words = (re.findall(r"[0-9a-z\u0080-\U0010ffff]+", x.lower()) for x in re.split(r"[.!?\n]+", text or ""))
        return [s for s in ({w.encode() for w in found} & model.weights.keys() for found in words) if s]

    def score(text, weights, bias, leak):
        clean = 1 - leak
        for found in bags(text):
            clean *= 1 - 1 / (1 + math.exp(-(bias + sum(weights[w] for w in found))))
        return 1 - clean

    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    assert all(math.isclose(got[i], score(t, model.weights, model.bias, model.leak), rel_tol=1e-9) for i, t in rows)

    taught = [(t, truth[i]) for i, t in rows[:600] if zlib.crc32(str(i).encode()) % 3 != 1]

    def loss(theta):
        weights, leak = dict(zip(model.weights, theta)), 1 / (1 + math.exp(-theta[-1]))
        cost = 0.0
        for text, y in taught:
            p = min(max(score(text, weights, theta[-2], leak), 1e-12), 1 - 1e-12)
            cost -= math.log(p if y else 1 - p)
        return cost / len(taught) + toxicity.SHRINK / 2 * sum(w * w for w in theta[:-2])

    def slope(theta):
        step = 1e-5
        return [(loss([*theta[:k], x + step, *theta[k + 1 :]]) - loss([*theta[:k], x - step, *theta[k + 1 :]])) / (2 * step) for k, x in enumerate(theta)]

    fitted = [*model.weights.values(), model.bias, math.log(model.leak / (1 - model.leak))]
    start = [1.0] * len(model.weights) + [-2.0, -3.0]
    assert loss(fitted) < loss(start) / 2
    assert max(map(abs, slope(fitted))) < 0.05 * max(map(abs, slope(start)))


# --- top-k -------------------------------------------------------------------------------------


def plain_top(rows, queries, k):
    fine = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in fine:
        if q in queries:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in fine if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 40)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[5][1]) for i in range(60)]  # ties in any number
    rows += [(400, None), (401, [None] + [1.0] * 15), (402, [float("nan")] * 16), (403, [float("inf")] * 16), (None, [1.0] * 16), (404, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    base = topk.integer_vectors(frame)
    got = topk.exact_top_k(base.where("id % 20 = 0"), base, 20)
    assert sorted(map(tuple, got.collect())) == plain_top(rows, set(range(0, 400, 20)), 20)
    few = topk.integer_vectors(frame.where("vec_id < 8"))
    assert sorted(map(tuple, topk.exact_top_k(few.where("id = 0"), few, 20).collect())) == plain_top(rows[:8], {0}, 20)
    assert topk.exact_top_k(base.where("false"), base).count() == 0 and topk.exact_top_k(base, base.where("false")).count() == 0


def test_top_k_in_many_tasks(spark, monkeypatch):
    """Queries and candidates of one pair of blocks meet in one task, however many tasks there are."""
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 50)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(200)]
    base = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "31"}
    before = {name: spark.conf.get(name) for name in held}
    try:
        for name, value in held.items():
            spark.conf.set(name, value)
        got = topk.exact_top_k(base.where("id % 20 = 0"), base, 20).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sorted(map(tuple, got)) == plain_top(rows, set(range(0, 200, 20)), 20)


def test_top_k_prunes_before_full_products(spark, monkeypatch):
    """Vectors whose energy lies in few components: the answers are the same, and few entries are scored in full."""
    monkeypatch.setattr(topk, "QUERY_BLOCK", 16)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 200)
    rng = np.random.default_rng(8)
    scale = np.concatenate([np.full(4, 8.0), np.full(28, 0.2)])
    rows = [(i, (rng.normal(size=32) * scale).astype(np.float32).tolist()) for i in range(1000)]
    base = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = topk.exact_top_k(base.where("id % 20 = 0"), base, 5, report=True).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == plain_top(rows, set(range(0, 1000, 20)), 5)
    resolved = {r.query_id: r.resolved for r in got}
    assert len(resolved) == 50 and sum(resolved.values()) < 0.1 * 50 * 999 and min(resolved.values()) >= 5


def test_top_k_refuses_scores_that_doubles_cannot_hold(spark):
    base = topk.integer_vectors(spark.createDataFrame([(0, [2e6, 1.0]), (1, [2e6, 3.0])], "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="2\\^53"):
        topk.exact_top_k(base, base).collect()


def test_top_k_beyond_doubles(spark, monkeypatch):
    """Scores that doubles round are told apart and returned exactly; components may pass the longs if no answer does."""
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 50)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=8) * 1e6).tolist()) for i in range(150)]
    # All nearly equal: scores above 2^53 that differ by less than a double's step there.
    rows += [(150 + i, [3e6] * 7 + [i / 64]) for i in range(60)]
    rows += [(300, [1.0] * 7 + [0.5])]
    # Their products with all of the queries' vectors are far below the longs, or zero.
    rows += [(301 + i, [-1e30] * 7 + [1.0 + i]) for i in range(3)]
    rows = [(i, v) for i, v in rows if i % 20 or min(v[:7]) >= 0 or i >= 150]
    queries = {i for i, _ in rows if i % 20 == 0}
    base = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    want = plain_top(rows, queries, 20)
    assert max(s for *_, s in want) > 2**53 and any(float(s) != s for *_, s in want)
    got = topk.exact_top_k(base.where("id % 20 = 0"), base, 20, wide=True)
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("sign", [1.0, -1.0])
def test_top_k_refuses_scores_that_longs_cannot_hold(spark, sign):
    base = topk.integer_vectors(spark.createDataFrame([(0, [1e18, 1.0]), (1, [sign * 1e18, 3.0])], "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="range of a long"):
        topk.exact_top_k(base, base, wide=True).collect()


# --- repeats -----------------------------------------------------------------------------------


def plain_repeats(rows, n=100):
    """rows: (id, text) in order; windows seen before are covered."""
    seen, out = set(), {}
    for i, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - n + 1):
            w = data[p : p + n]
            if w in seen:
                gone[p : p + n] = b"\1" * n
            seen.add(w)
        spans = sum(1 for p in range(len(data)) if gone[p] and (p == 0 or not gone[p - 1]))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def digests(df):
    return {r[0]: tuple(r)[1:] for r in df.select("doc.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}


@pytest.mark.parametrize("hot, filter_bits", [(False, 1 << 28), (True, 1 << 28), (False, 1)])
def test_repeats(docs, texts, hot, filter_bits, monkeypatch):
    """With one bit at most for the filter, flanks meet in a shuffle."""
    if hot:
        monkeypatch.setattr(repeats, "GRAM_PHRASES", 2)
    monkeypatch.setattr(repeats, "MOST_FILTER_BITS", filter_bits)
    monkeypatch.setattr(repeats, "ARRAY_SUFFIXES", 500)
    monkeypatch.setattr(repeats, "PIECE_BYTES", 5000)
    got = digests(repeats.remove_repeats(docs))
    want = plain_repeats(enumerate(texts))
    assert got == want and sum(v[1] for v in want.values()) > 1000


def test_repeats_odd_rows(spark, none):
    assert repeats.remove_repeats(none).count() == 0
    t = prose(random.Random(8), 25) + "é" * 10
    rows = [(3, t), (3, t), (None, "x" + t), (1, None), (2, "")]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()
    assert Counter((r.doc.doc_id, r.n_removed > 0) for r in got) == Counter([(3, True), (3, True), (None, False), (1, False), (2, False)])
    by = {(r.doc.doc_id, r.doc.text): r.kept_text for r in got}
    assert by[(None, "x" + t)] == "x" + t and by[(3, t)] == "" and by[(1, None)] == ""


@pytest.mark.parametrize("hot", [False, True])
def test_repeated_rows_keep_first_occurrences(spark, hot, monkeypatch):
    """A repeated row is the first holder of a passage that stands elsewhere with other surroundings."""
    if hot:
        monkeypatch.setattr(repeats, "GRAM_PHRASES", 1)
    rng = random.Random(12)
    core, t = prose(rng, 60), prose(rng, 40)
    first = prose(rng, 20) + " " + core + " " + prose(rng, 20)
    rows = [(3, t), (5, "x" + t), (7, first), (8, prose(rng, 15) + "; " + core + "; " + prose(rng, 15))]
    doubled = spark.createDataFrame([*rows, rows[0], rows[0], rows[2]], "doc_id long, text string")
    want = plain_repeats(rows)
    assert digests(repeats.remove_repeats(doubled)) == want and want[3][1] == want[7][1] == 0 < min(want[5][1], want[8][1])
    assert repeats.remove_repeats(doubled).count() == 7

    def groups(frame):
        by = defaultdict(set)
        for r in repeats.maximal_repeats(frame).collect():
            by[r.group, r.length].add((r.doc_id, r.start))
        return Counter((n, frozenset(places)) for (_, n), places in by.items())

    assert groups(doubled) == groups(spark.createDataFrame(rows, doubled.schema))


def test_maximal_repeats_list_all_occurrences(spark):
    rng = random.Random(4)
    core = prose(rng, 30)
    texts = [prose(rng, 10) + f" {k} " + core + f" {k + 1} " + prose(rng, 10) for k in range(12)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = repeats.maximal_repeats(frame).collect()
    groups = defaultdict(list)
    for r in found:
        groups[r.group, r.length].append((r.doc_id, r.start))
    assert groups
    for (_, n), places in groups.items():
        strings = {texts[d].encode()[p : p + n] for d, p in places}
        assert len(strings) == 1 and len(places) >= 2
        whole = strings.pop().decode()
        assert sorted(places) == sorted((d, i) for d, t in enumerate(texts) for i in range(len(t)) if t.startswith(whole, i))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", min_size=6, max_size=30), min_size=2, max_size=8))
def test_suffix_intervals(bodies):
    """Against all pairs of suffixes: later windows, and maximal repeats with all their occurrences."""
    n = 5
    bodies = sorted({b.encode() for b in bodies})
    windows = np.array([len(b) - n + 1 for b in bodies])
    later, groups = repeats.suffix_intervals(bodies, [b""] * len(bodies), windows, np.arange(len(bodies)), n)
    places = [(i, p) for i, b in enumerate(bodies) for p in range(len(b) - n + 1)]
    seen, want = set(), []
    for i, p in places:
        want.append(bodies[i][p : p + n] in seen)
        seen.add(bodies[i][p : p + n])
    assert later.tolist() == want
    by = defaultdict(set)
    for i, p in places:
        for m in range(n, len(bodies[i]) - p + 1):
            by[bodies[i][p : p + m]].add((i, p))
    right = {s: {bodies[i][p + len(s) : p + len(s) + 1] or (i, p) for i, p in at} for s, at in by.items()}
    left = {s: {bodies[i][p - 1 : p] or (i, p) for i, p in at} for s, at in by.items()}
    maximal = {(len(s), frozenset(at)) for s, at in by.items() if len(at) > 1 and len(right[s]) > 1 and len(left[s]) > 1}
    assert {(d, frozenset(places[x] for x in m.tolist())) for d, m in groups} == maximal
