"""Language identification, conversation repair and whitening against plain Python."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellgauge.llm import audits, language, repair, whitening
from cellgauge.llm.audits import Audits, Costs

# --- language ----------------------------------------------------------------------------------

SYLLABLES = {"aa": "ka lo mi tu re sa", "bb": "ßen schu ich ung der tz", "cc": "ção ñu ¡el que los ér"}


def spoken(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def normal(text):
    """Characters of a text as the models see them, between blanks."""
    letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    words = letters.split()
    return "   " + " ".join(words) + " " if words else ""


def plain_model(texts):
    """Of a text, the bits of each character, by interpolated Kneser-Ney over dictionaries."""
    levels = {4: Counter(t[i - 3 : i + 1] for t in map(normal, texts) for i in range(3, len(t)))}
    for k in (3, 2, 1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    discounts, totals, kinds = {}, {}, {}
    for k, seen in levels.items():
        one, two = (sum(1 for c in seen.values() if c == n) for n in (1, 2))
        discounts[k] = min(max(one / (one + 2 * two) if one + 2 * two else 0.75, 0.05), 0.95)
        totals[k], kinds[k] = Counter(), Counter()
        for g, c in seen.items():
            totals[k][g[:-1]] += c
            kinds[k][g[:-1]] += 1

    def p(gram, k):
        if k == 0:
            return 1 / 65536
        lower, before = p(gram, k - 1), gram[4 - k : -1]
        if not totals[k][before]:
            return lower
        c = levels[k][gram[4 - k :]]
        return (c - discounts[k] if c else 0) / totals[k][before] + discounts[k] * kinds[k][before] / totals[k][before] * lower

    return lambda t: [-math.log2(p(t[i - 3 : i + 1], 4)) for i in range(3, len(t))]


@pytest.fixture(scope="module")
def spoken_rows():
    rng = random.Random(3)
    rows = [(i, spoken(rng, lang, rng.randrange(1, 40)), lang) for i, lang in enumerate(rng.choices(["aa", "bb", "cc"], k=240))]
    rows += [(300, None, "aa"), (301, "", "bb"), (302, " 12 !? ", "cc"), (303, "кириллица", "aa"), (304, spoken(rng, "bb", 3000), None)]
    rows += [(None, rows[0][1], "aa"), rows[1], rows[1], (305, "𐐨𐐩 ﬀ Ǆ İ", None)]
    return rows


def test_language_matches_plain_models(spark, spoken_rows, monkeypatch):
    # Every grown text of the model's share counts; every 16th by its hash calibrates.
    schema = "doc_id long, text string, lang string, n_chars int, bits int, least int"
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in spoken_rows], schema)
    monkeypatch.setattr(language, "PIECE", 500)
    monkeypatch.setattr(language, "HELD", 50)
    aside = {r[0] for r in docs.select("text").where(f"pmod(xxhash64(coalesce(text, '')), {language.CALIBRATE_ONE_IN}) = 0").collect()}
    texts = defaultdict(list)
    for i, t, lang in spoken_rows:
        if lang and t not in aside and not is_held_out(i):
            texts[lang].append(t)
    models = {lang: plain_model(those) for lang, those in texts.items()}
    got = language.identify(docs).collect()
    assert len(got) == len(spoken_rows)
    want = Counter()
    for i, t, _ in spoken_rows:
        chars = normal(t)
        if not chars:
            want[i, is_held_out(i), "und", 0, None] += 1
            continue
        cost = {lang: sum(m(chars)) / (len(chars) - 3) for lang, m in models.items()}
        want[i, is_held_out(i), min(cost, key=cost.get), len(chars) - 3, round(min(cost.values()), 6)] += 1
    found = Counter((r.doc_id, r.held_out, r.lang_pred, r.n_chars, None if r.n_chars == 0 else round(r.cross_entropy, 6)) for r in got)
    odd = {k for k in (found - want) if k[0] != 305}
    assert not odd, odd
    assert all(0 <= r.score <= 1 for r in got) and all(r.score == 0 and not r.rejected for r in got if r.lang_pred == "und")
    truth = {r[0]: r[2] for r in spoken_rows[:240]}
    assert all(r.lang_pred == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth)
    by_shuffle = language.identify(docs, model_rows=5).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.held_out, r.lang_pred, round(r.score, 9), r.rejected, r.n_chars, round(r.cross_entropy or 0, 9))
    assert sorted(map(key, by_shuffle), key=repr) == sorted(map(key, got), key=repr)


def test_language_rejects_what_no_language_holds(spark):
    rng = random.Random(9)
    rows = [(i, spoken(rng, lang, 30), lang) for i, lang in enumerate(rng.choices(["aa", "bb"], k=900))]
    odd = [(2000 + i, " ".join("".join(rng.choice("qwxzvjy") for _ in range(5)) for _ in range(30)), None) for i in range(20)]
    got = language.identify(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")).collect()
    assert all(r.rejected for r in got if r.doc_id >= 2000)
    assert sum(r.rejected for r in got if r.doc_id < 2000) < 10


def test_language_without_anything_to_learn(spark):
    schema = "doc_id long, text string, lang string"
    assert language.identify(spark.createDataFrame([], schema)).count() == 0
    got = language.identify(spark.createDataFrame([(1, "some text", None), (2, None, None)], schema)).collect()
    assert {(r.lang_pred, r.score, r.rejected) for r in got} == {("und", 0.0, False)}


# --- conversations -----------------------------------------------------------------------------

def legal(initials):
    """(s?(ua)+)?"""
    rest = initials[1:] if initials.startswith("s") else initials
    return initials == "" or (len(rest) > 0 and len(rest) % 2 == 0 and rest == "ua" * (len(rest) // 2))


def plain_repair(rows, costs, most_inserts):
    """rows: (role, text) in order. Every way to edit them, one by one."""
    faults, seen = [], set()
    for role, text in rows:
        bare = "".join(c for c in text if c not in " \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    options = []
    for (role, text), fault in zip(rows, faults):
        ways = [("D", None, costs.delete)]
        if fault not in ("blank", "duplicate"):
            more = costs.truncated * (fault == "truncated")
            ways += [("K", (role, text), more), *(("R", (r, text), costs.rerole + more) for r in ("user", "assistant"))]
        options.append(ways)
    made = [()] + [tuple(p) for n in range(1, most_inserts + 1) for p in itertools.product(["user", "assistant"], repeat=n)]
    best = None
    for ways in itertools.product(*options):
        for puts in itertools.product(made, repeat=len(rows) + 1):
            audit, out, cost = "", [], 0
            for put, way in itertools.zip_longest(puts, ways):
                audit += "I" * len(put) + (way[0] if way else "")
                out += [(r, "") for r in put] + ([way[1]] if way and way[1] else [])
                cost += costs.insert * len(put) + (way[2] if way else 0)
            if legal("".join(r[:1] or "-" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, "\n".join(f"{r}:{t}" for r, t in out)
    return Counter(faults), best


def conversations(rng, n, most):
    turns = ["Yes.", "No!", "Why?", "and then", "", " \t"]
    out = {}
    for c in range(n):
        out[c] = [(rng.choice(["user", "user", "assistant", "assistant", "system", "tool", ""]), rng.choice(turns)) for _ in range(rng.randrange(0, most + 1))]
    return out


@pytest.mark.parametrize("costs, inserts", [(Costs(), 0), (Costs(insert=1, delete=3, truncated=2), 1), (Costs(rerole=2, delete=2, insert=1, truncated=0), 1)])
@pytest.mark.parametrize("stretch", [0, 1, 10])
def test_repairs_are_the_cheapest(spark, monkeypatch, costs, inserts, stretch):
    monkeypatch.setattr(repair, "STRETCH_LOG2", stretch)
    those = conversations(random.Random(17), 60, 4 if inserts else 6)
    rows = [(c, i, role, text, 1) for c, turns in those.items() for i, (role, text) in enumerate(turns)]
    # A repeated row counts as often as it is there.
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n long").repartition(5)
    done = repair.repair(frame, costs)
    shas = {r.conv: r.sha256 for r in repair.digests(done.turns).collect()}
    got = {r.conv: r for r in done.audits.collect()}
    for c, turns in those.items():
        if not turns:
            continue
        faults, (cost, audit, text) = plain_repair(turns, costs, inserts)
        r = got[f"#{c}"]
        assert (r.cost, r.audit) == (cost, audit), turns
        assert shas.get(f"#{c}", hashlib.sha256(b"").hexdigest()) == hashlib.sha256(text.encode()).hexdigest(), turns
        assert (r.blank, r.duplicate, r.truncated) == (faults["blank"], faults["duplicate"], faults["truncated"])
        pairs = [a[:1] + b[:1] for (a, _), (b, _) in zip(turns, turns[1:])]
        assert r.illegal == sum(p not in ("su", "ua", "au") for p in pairs)


def test_a_long_conversation_in_short_stretches(spark, monkeypatch):
    """One conversation holds nearly all rows; its repair does not depend on the length of stretches."""
    rng = random.Random(5)
    rows = [(1, i, rng.choice(["user", "assistant", "assistant", "system"]), f"turn {rng.randrange(500)}" + rng.choice([".", ".", "!", ""]), "x") for i in range(1500)]
    rows += [(2, 0, "user", "Hi.", "x"), (None, None, "user", None, "x"), (None, 3, None, "So.", "x"), (None, 3, None, "So.", "x"), (None, 7, "user", "Hm?", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, conv string").repartition(7)
    want = sorted(map(tuple, repair.repair_conversations(frame).collect()), key=repr)
    assert len(want) == 3 and max(len(r[7]) for r in want) > 1300
    monkeypatch.setattr(repair, "STRETCH_LOG2", 3)
    assert sorted(map(tuple, repair.repair_conversations(frame).collect()), key=repr) == want


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in (None, 1, 2) for t in (None, *range(30))]
    got = defaultdict(list)
    for r in repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got[r.conv_id, r.turn].append((r.role, r.text, r.n))
    kinds = set()
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        kinds.add(min(kind, 5))
        want = {0: [], 1: [(role, "", 1)], 2: [(role, "One Two Three", 1)], 3: [(role, text, 2)], 4: [("user", text, 1)]}.get(kind, [(role, text, 1)])
        assert got.get((c, t), []) == want
    assert kinds == set(range(6))


def test_conversations_that_vanish(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert repair.repair_conversations(spark.createDataFrame([], schema)).count() == 0
    c = next(c for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = repair.repair_conversations(spark.createDataFrame([(c, 0, "user", "Hi.")], schema)).collect()
    assert [tuple(r) for r in got] == [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("modulus", [audits.MODULUS, 3])
def test_audits_compare_as_strings(monkeypatch, modulus):
    """With a modulus of 3 most hashes collide, and are found out."""
    monkeypatch.setattr(audits, "MODULUS", modulus)
    rng = random.Random(1)
    held = Audits()
    strings = {0: ""}
    for _ in range(400):
        parent = rng.choice(list(strings))
        symbol = rng.choice("DIKR")
        strings[held.add(parent, ord(symbol), symbol)] = strings[parent] + symbol
    nodes = list(strings)
    for _ in range(4000):
        a, b = rng.choice(nodes), rng.choice(nodes)
        assert held.less(a, b) == (strings[a] < strings[b]), (strings[a], strings[b])
    deep = max(strings, key=lambda n: len(strings[n]))
    assert "".join(held.tag[n] for n in held.path(deep)) == strings[deep]
    assert all(strings[held.ancestor(deep, d)] == strings[deep][:d] for d in range(len(strings[deep]) + 1))


# --- whitening ---------------------------------------------------------------------------------


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 9), st.integers(1, 12), st.integers(0, 10**6))
def test_principal(d, n, seed):
    y = np.random.default_rng(seed).normal(size=(n, d)) * 10.0 ** np.arange(0, -d / 3, -1 / 3)[:d]
    v = y.T @ y / n
    e, u = whitening.principal(v)
    want = np.linalg.eigvalsh(v)[::-1]
    assert len(e) <= min(d, n) and np.allclose(e, want[: len(e)], rtol=1e-8, atol=1e-13 * want[0]) and np.all(want[len(e) :] <= 1e-11 * want[0])
    assert np.allclose(u.T @ u, np.eye(len(e)), atol=1e-9) and np.allclose(v @ u, u * e, atol=1e-10 * want[0])


def plain_whitening(rows, components):
    """vec_id -> list of (n, deviation, |whitened| ..., explained) by the eigenvectors of a dense covariance."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(x) for _, x in kept), default=0)
    kept = [(i, x + [1_000_000] * (width - len(x))) for i, x in kept]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    out = []
    for i, x in kept:
        z = [n * a - s for a, s in zip(x, sums)]
        for k in range(min(components, width)):
            if e[k] > 1e-9 * e[0]:
                out.append((i, k + 1, n, sum(a * a for a in z), abs(float(np.array(z) / n @ u[:, k] / math.sqrt(e[k]))), float(e[k] / e.sum())))
    return out


def test_whitening(spark):
    rng = np.random.default_rng(7)
    scale = np.array([3.0, 2.0, 1.0, 0.5, 0.0, 1.5])
    rows = [(i, (rng.normal(size=6) * scale + 5).astype(np.float32).tolist()) for i in range(200)]
    rows += [(200 + i, rows[0][1]) for i in range(90)]  # copies weigh no more than one
    rows += [(400, None), (401, [None] + [1.0] * 5), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (None, [1.0] * 6), (404, [1.0, 2.0]), rows[3]]
    frame = spark.createDataFrame([(i, v, "n", 1) for i, v in rows], "vec_id long, embedding array<float>, n string, id int")
    got = whitening.whiten(frame, components=4).collect()
    want = plain_whitening(rows, 4)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    got_rows = sorted(((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in got), key=key)
    assert [r[:4] for r in got_rows] == [r[:4] for r in sorted(want, key=key)]
    assert np.allclose([r[4:] for r in got_rows], [r[4:] for r in sorted(want, key=key)], atol=1e-8)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10
    # One sign for all rows.
    signs = {r.component: r.whitened for r in got if r.vec_id == 0}
    assert all(r.whitened == signs[r.component] for r in got if r.vec_id in range(200, 290))


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<double>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).count() == 0
    got = whitening.whiten(spark.createDataFrame([(1, [1.0, 0.0]), (2, [3.0, 0.0])], schema)).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, round(abs(r.whitened), 12), r.explained) for r in got) == [
        (1, 1, 2, 128**2, 1.0, 1.0),
        (2, 1, 2, 128**2, 1.0, 1.0),
    ]
    with pytest.raises(Exception):
        whitening.whiten(spark.createDataFrame([(1, [1e12]), (2, [-1e15]), (3, [1e15])], schema)).collect()
