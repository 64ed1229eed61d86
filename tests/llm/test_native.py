"""Sharding, mixing, quality rules and url filters against plain Python."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
import xxhash
from pyspark.sql import functions as F

from cellgauge.llm import mixing, quality, sharding, urls
from cellgauge.llm.components import components

SCHEMA = "doc_id long, text string, source string, shard int, slot string, _row int, node string"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with the operators' own names."""
    boiler = "Subscribe to our newsletter now please and read the next page for more news"
    # Letters, because digits count alike in a line.
    name = lambda k: chr(97 + k // 26) + chr(97 + k % 26)
    rows = [(i, f"{boiler}\n" + " ".join(f"w{name(i)}{name(j)}" for j in range(40)), "a" if i % 3 else "b") for i in range(60)]
    rows += [(60 + i, f"{boiler} 1{i}\nshort tail {i} of some page", "a") for i in range(30)]
    rows += [(100, None, "a"), (101, "", None), (102, " \n\t ", "b"), (None, "no id at all", None), (103, None, None)]
    rows += [(104, "one two three four five six seven eight nine " * 3000, "c")]
    rows += [(105, "#a $b &&\nsame\nsame\n\nsame \x0b é☃ <x>|*%", "c")] * 3
    return spark.createDataFrame([(*r, 1, "x", 2, "n") for r in rows], SCHEMA)


def test_shards_hold_equal_counts_without_gaps(docs):
    got = sharding.feistel_shards(docs).collect()
    texts = {(r.doc_id, (r.text or "")) for r in docs.collect()}
    assert len(got) == docs.count()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert set(by) <= set(range(16))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and len(by) == 16
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    want = Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in ((r.doc_id, r.text or "") for r in docs.collect()))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want and texts


def spark_hash(*values):
    """Spark's xxhash64 of 32-bit ints (as pairs with their width), 64-bit ints and strings, unsigned; nulls are passed over."""
    seed = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else v[0].to_bytes(v[1], "little", signed=True)
            seed = xxhash.xxh64_intdigest(data, seed)
    return seed


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def wide(x):
    return None if x is None else (signed(x % (1 << 64)), 8)


def plain_place(number, n, seed):
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    while True:
        left, right = number % a, number // a
        for k in range(sharding.ROUNDS):
            side = a if k % 2 == 0 else b
            left, right = right, (left + signed(spark_hash((seed, 4), (k, 4), (right, 8))) % side) % side
        number = right * a + left
        if number < n:
            return number


def test_every_place_by_plain_python(docs):
    rows = [(r.doc_id, spark_hash(r.text or "")) for r in docs.collect()]
    order = sorted(rows, key=lambda r: (spark_hash(wide(r[0]), wide(r[1])), r[0] is not None, r[0] or 0, signed(r[1])))
    crc = {spark_hash(r.text or ""): zlib.crc32((r.text or "").encode()) for r in docs.collect()}
    for seed in (1, 9):
        places = [plain_place(i, len(order), seed) for i in range(len(order))]
        assert sorted(places) == list(range(len(order)))
        want = Counter((d, crc[t], p % 16, p // 16) for (d, t), p in zip(order, places))
        got = sharding.feistel_shards(docs, seed=seed).select("doc_id", "text_crc32", "shard", "slot").collect()
        assert Counter(map(tuple, got)) == want


def test_shards_are_reproducible(docs):
    key = lambda d: sorted(tuple(r) for r in d.select("shard", "slot", "text_crc32").collect())
    assert key(sharding.feistel_shards(docs)) == key(sharding.feistel_shards(docs.repartition(7)))
    assert key(sharding.feistel_shards(docs)) != key(sharding.feistel_shards(docs, seed=2))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 10, 16, 17, 100, 1000, 4097])
def test_permutation_is_a_bijection(spark, n):
    got = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 3)).collect()]
    assert sorted(got) == list(range(n))
    if n >= 100:
        assert sum(abs(a - b) == 1 for a, b in zip(got, got[1:])) < n / 4


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert sharding.feistel_shards(none).count() == 0
    assert mixing.mix_sources(none).count() == 0
    assert quality.quality_rules(none).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert urls.url_verdicts(pages, [("block", "com", "/")]).count() == 0


@pytest.mark.parametrize("weights", [{"a": 1.0}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 7, "b": 1, None: 1}, {c: 1 for c in "abcdefg"}])
def test_schedule_meets_windows_and_stays_within_one_block(weights):
    slots = mixing.quotas(weights, 100)
    period = sum(slots.values())
    done = Counter()
    for t, (s, j, release, deadline, slot) in enumerate(mixing.schedule(slots)):
        assert slot == t and release <= t < deadline and j == done[s]
        done[s] += 1
        for k, n in slots.items():
            assert abs(done[k] - (t + 1) * n / period) < 1
    assert done == Counter(slots)


def test_mixing_keeps_rows_and_weights(spark):
    rows = [(i, f"t{i}", "big") for i in range(6000)] + [(10**6 + i, f"u{i}", "mid") for i in range(3000)]
    rows += [(2 * 10**6 + i, f"v{i}", None) for i in range(1000)] + [(3 * 10**6, "odd", "unweighted")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix_sources(docs, {"big": 0.5, "mid": 0.3, None: 0.2}, block_rows=10, period=20)
    got = mixed.orderBy("slot", "source", "place").select("doc.doc_id", "source", "slot", "place", "release", "deadline").collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    assert got[-1].source == "unweighted" and got[-1].slot >= 2**62
    assert all(r.release <= r.slot < r.deadline for r in got[:-1])
    done = Counter()
    # Until the first source ends (the unnamed one, after 100 blocks of 5 slots).
    for n, r in enumerate(got[:4900], 1):
        done[r.source] += 1
        for s, w in (("big", 0.5), ("mid", 0.3), (None, 0.2)):
            assert abs(done[s] - n * w) < 2 * 10
    laid = mixing.in_mixed_order(mixed).select("doc.doc_id").collect()
    assert [r[0] for r in laid] == [r.doc_id for r in got]


def plain_slots(quota):
    """Release, deadline and slot of each block: in every slot all sources are looked at, and the released block with the
    earliest deadline goes, of equal ones that of the source named first."""
    period, out, done = sum(quota.values()), {}, dict.fromkeys(quota, 0)
    for t in range(period):
        best = None
        for s, n in quota.items():
            release, deadline = math.floor(Fraction(done[s] * period, n)), math.ceil(Fraction((done[s] + 1) * period, n))
            if done[s] < n and release <= t and (best is None or deadline < best[1]):
                best = s, deadline, release
        s, deadline, release = best
        out[s, done[s]] = release, deadline, t
        done[s] += 1
    return out


def test_schedule_of_many_sources():
    quota = mixing.quotas({f"s{i:05}": 1 + i % 97 for i in range(700)} | {None: 5000.0})
    assert {(s, j): (r, d, t) for s, j, r, d, t in mixing.schedule(quota)} == plain_slots(quota)


def test_every_slot_by_plain_python(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, i]), rng.choice([None, "", f"t{i}"]), rng.choice(["big"] * 6 + ["mid"] * 3 + [None, "rare"])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {"big": 5.0, "mid": 3.0, None: 1.0}
    quota = mixing.quotas(weights, 40)
    period, plan = sum(quota.values()), plain_slots(quota)
    numbered = defaultdict(list)
    for d, t, s in rows:
        numbered[s].append((spark_hash(wide(d), t), d, t))
    want = Counter()
    for s, found in numbered.items():
        for i, (_, d, t) in enumerate(sorted(found, key=lambda r: r[0])):
            block, place = divmod(i, 7)
            if s not in quota:
                want[d, t, s, block, place, None, None, 2**62 + block] += 1
                continue
            cycle, j = divmod(block, quota[s])
            want[d, t, s, block, place, *(x + cycle * period for x in plan[s, j])] += 1
    got = mixing.mix_sources(docs, weights, block_rows=7, period=40)
    assert Counter(map(tuple, got.select("doc.doc_id", "doc.text", "source", "block", "place", "release", "deadline", "slot").collect())) == want


def test_any_number_of_sources_stays_within_one_block(spark):
    """2,501 rare sources in a period of 50: those of nearly equal weight take their entry's slots in turn."""
    weights = {f"s{i:04}": 1.0 + i % 5 for i in range(2500)} | {None: 1.0, "big": 5000.0, "mid": 2500.0, "nothing": 0.0}
    level = {s: math.floor(math.log2(w) * 8) for s, w in weights.items() if w}
    entries, total = defaultdict(list), sum(weights.values())
    for s in level:
        entries[level[s] if weights[s] * 50 < total else s].append(s)
    size = {s: len(e) for e in entries.values() for s in e}
    quota = mixing.quotas({min(filter(None, e)): len(e) * weights[e[0]] for e in entries.values()}, 50)
    share = {s: Fraction(quota[min(filter(None, e))], sum(quota.values()) * len(e)) for e in entries.values() for s in e}
    assert sum(share.values()) == 1 and len(quota) == len(entries) < 10 and max(size.values()) == 501

    rounds = {s: 2 if s not in ("big", "mid") else 6000 for s in weights}
    docs = spark.createDataFrame([(i, f"{s}{i}", s) for s, n in rounds.items() for i in range(n)], "doc_id long, text string, source string")
    got = mixing.mix_sources(docs, weights, block_rows=1, period=50).select("source", "block", "release", "deadline", "slot").collect()
    assert Counter(r.source for r in got) == Counter(rounds)
    placed = sorted((r for r in got if r.source != "nothing"), key=lambda r: r.slot)
    assert all(r.slot >= 2**62 for r in got if r.source == "nothing")
    assert len({r.slot for r in placed}) == len(placed) and all(r.release <= r.slot < r.deadline for r in placed)
    assert [r.slot for r in placed[:4000]] == list(range(4000))
    at = defaultdict(list)
    for r in placed[:4000]:
        at[r.source].append(r.slot)
    for s, x in share.items():
        # A deviation is greatest just before or just after a block of the source.
        for n, t in enumerate([*at[s], 4000]):
            assert abs(n - t * x) < 1 and (t == 4000 or abs(n + 1 - (t + 1) * x) < 1)


def test_weights_as_a_table(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "ab"[i % 2]) for i in range(100)], "doc_id long, text string, source string")
    by_name = {"a": 3.0, "b": 1.0, None: math.nan, "c": math.inf}
    table = spark.createDataFrame([(s, w) for s, w in by_name.items()], "source string, weight double")
    want = Counter(mixing.mix_sources(docs, {"a": 3.0, "b": 1.0}, block_rows=4).collect())
    assert Counter(mixing.mix_sources(docs, table, block_rows=4).collect()) == want
    assert Counter(mixing.mix_sources(docs, by_name, block_rows=4).collect()) == want


def test_mixing_of_odd_rows(docs):
    got = mixing.mix_sources(docs, block_rows=4).select("doc.*").collect()
    assert Counter(map(str, got)) == Counter(map(str, docs.collect()))


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {i + k for w in windows.values() if len(w) > 1 for i in w for k in range(8)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def plain_kept(rows):
    def norm(line):
        return tuple(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[0-9]+", "0", line.lower())))

    holders, texts = defaultdict(set), defaultdict(set)
    for r in rows:
        t = r.text or ""
        texts[r.source].add(t)
        for line in t.split("\n"):
            if norm(line):
                holders[r.source, norm(line)].add(t)
    out = []
    for r in rows:
        n, _, _, _, rep = plain_counts(r.text)
        failed = n < 20 or 100 * rep > 30 * n
        gone = sum(
            len(norm(x))
            for x in (r.text or "").split("\n")
            if norm(x) and len(holders[r.source, norm(x)]) >= 10 and len(holders[r.source, norm(x)]) > 0.1 * len(texts[r.source])
        )
        out.append((r.doc_id, *plain_counts(r.text), failed, gone, not failed and n - gone >= 20 and n - gone >= 0.3 * n))
    return Counter(out)


def test_quality_rules_match_plain_python(docs):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "boilerplate_words", "kept"]
    got = quality.quality_rules(docs).select("doc.doc_id", *names).collect()
    want = plain_kept(docs.collect())
    assert Counter(map(tuple, got)) == want
    texts = {r.doc.doc_id: (r.doc.text, r.kept_text) for r in quality.quality_rules(docs).collect()}
    assert texts[1][1] == texts[1][0].split("\n")[1] and texts[61][1] == "" and texts[105][1] == texts[105][0]
    assert texts[100] == (None, None)
    assert any(r.boilerplate_words for r in got) and any(not r.kept and not r.base_failed for r in got) and any(r.kept for r in got)


RULES = [("allow", "com", "/"), ("block", "spam.com", "/x/"), ("block", "bad.org", "/"), ("allow", "ok.bad.org", "/fine/")]


def page(url, canonical=None, refresh=None):
    html = "<html>"
    html += f"<LINK href='{canonical}' rel='canonical'>" if canonical else ""
    html += f'<meta http-equiv="refresh" content="0; URL={refresh}">' if refresh else ""
    return url, html


def test_url_verdicts(spark):
    rows = [
        page("http://A.com/x?y#z"),
        page("https://spam.com/x/1"),
        page("http://alias.net/1", canonical="http://bad.org/p"),
        page("http://alias.net/2", refresh="/1"),
        page("https://alias.net/2#frag"),
        page("http://mixed.net/1", canonical="http://bad.org/q"),
        page("http://mixed.net/2", canonical="//mixed.net/1"),
        page("http://mixed.net/2#again", canonical="http://ok.bad.org/fine/1"),
        page("http://free.net/"),
        page("http://ok.bad.org/fine/2", refresh="http://bad.org/r"),
        page("not a url", canonical="http://bad.org/p"),
        (None, None),
        page("http://notbad.org/"),
        page("http://host.net", canonical="rel.html"),
        page("http://moved.net/old"),
    ]
    pages = spark.createDataFrame([(i, *r, "extra") for i, r in enumerate(rows)], "page_id long, url string, html string, verdict string")
    redirects = spark.createDataFrame([("http://moved.net/old", "http://bad.org/new"), (None, "http://bad.org/z")], "src string, dst string")
    got = {r.page_id: r for r in urls.url_verdicts(pages, RULES, redirects).collect()}
    assert len(got) == len(rows)
    verdicts = [got[i].verdict for i in range(len(rows))]
    assert verdicts == "allow block block block block allow allow allow allow allow allow allow allow allow block".split()
    assert (got[0].host, got[0].path, got[0].rule) == ("a.com", "/x", "com/")
    assert (got[1].rule, got[9].rule, got[2].rule) == ("spam.com/x/", "ok.bad.org/fine/", None)
    assert (got[10].host, got[10].path, got[11].host) == ("", "", "")
    assert (got[13].host, got[13].path) == ("host.net", "")


def plain_rule(host, path, rules):
    fit = [(v, h, p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return min(fit, key=lambda r: (-len(r[1] + r[2]), r), default=None)


@pytest.mark.parametrize("as_table", [False, True])
def test_verdicts_spread_by_plain_python(spark, as_table):
    """Chains, stars, cycles and conflicts over 1,500 pages with links and redirects."""
    rng = random.Random(11)
    hosts = [f"{a}.{b}" for a in ("a", "www.a", "x.y.z.b", "b", "Q") for b in ("net", "com", "org")] + ["", "." * 3000 + "net"]
    paths = ["", "/", "/en/", "/en/deep/er", "/es/", "/é/☃"]
    rules = [("block", "net", "/es/"), ("allow", "a.net", "/es/"), ("block", "y.z.b.com", "/"), ("allow", "org", "/en/"), ("block", "org", "/en/deep")]
    rules += [("block", "b.org", "/é/"), ("allow", "b.org", "/é/"), ("block", "q.com", "")]
    made = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(paths)}?{i % 700}" for i in range(1500)]
    target = [rng.choice(made) if rng.random() < 0.5 else None for _ in made]
    target[:200] = made[1:201]
    target[300:400] = [made[299]] * 100
    rows = [(i, *(page(u, canonical=t) if i % 2 else page(u, refresh=t))) for i, (u, t) in enumerate(zip(made, target))] + [(5000, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    moved = [(rng.choice(made), f"http://b.net/es/{i}") for i in range(20)]
    table = spark.createDataFrame([*rules, (None, "a.net", "/"), ("block", None, "/")], "verdict string, host string, path string")
    got = {r.page_id: r for r in urls.url_verdicts(pages, table if as_table else rules, spark.createDataFrame(moved, "src string, dst string")).collect()}

    def parts(url):
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        return host.lower(), re.match(r"[^?#]*", rest[len(host) :])[0], rest[len(host) :].split("#")[0]

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    up, told = {}, defaultdict(set)
    node = lambda u: parts(u)[0] + parts(u)[2]
    links = [(u, t) for u, t in zip(made, target) if t] + moved
    for u, t in links:
        up[find(node(u))] = find(node(t))
    for u in {x for link in links for x in link}:
        if rule := plain_rule(*parts(u)[:2], rules):
            told[find(node(u))].add(rule[0])
    for i, u in enumerate(made):
        host, path, _ = parts(u)
        rule = plain_rule(host, path, rules)
        heard = told.get(find(node(u)), set())
        want = rule[0] if rule else "block" if heard == {"block"} else "allow"
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule and rule[1] + rule[2], want)
    assert len(got) == len(rows) and got[5000].verdict == "allow"
    assert sum(r.rule is None and r.verdict == "block" for r in got.values()) > 50


def test_components_of_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 400)]
    odd = [(5000, 5000), (None, 5), (2000, 1999), (1999, 2000), (2000, 1999)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain + star + odd, "a long, b long")).collect()}
    want = {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(400)} | {1999: 1999, 2000: 1999}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
