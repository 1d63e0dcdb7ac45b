import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodespark.llm.neardup import banded_edit_distance, connected_components, near_duplicate_groups, near_duplicate_pairs

WORDS = [f"{a}{b}" for a in "bcdfghklmn" for b in ("ar", "el", "in", "os", "up", "ay")]
SCHEMA = "hash string, doc string, id long, n int, key string, class_id int"


def shingles(text):
    w = re.findall(r"[^\W_]+", text.lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def brute(rows, least=0.7):
    s = {h: shingles(d) for h, d in rows if h is not None and d is not None}
    keys = sorted(k for k in s if s[k])
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(s[a] & s[b]) / len(s[a] | s[b]) >= least}


def corpus(seed, n=60):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = [r.choice(WORDS) for _ in range(r.choice([3, 4, 6, 9, 15, 30, 80, 200]))]
        rows.append((f"h{i:03d}", " ".join(words)))
        for j in range(r.choice([0, 0, 1, 3])):
            w = list(words)
            for _ in range(r.randint(0, max(1, len(w) // 18))):
                k = r.randrange(len(w))
                x = r.random()
                w[k : k + 1] = [r.choice(WORDS)] if x < 0.4 else [] if x < 0.6 else [w[k], r.choice(WORDS)]
            if r.random() < 0.3 and len(w) > 20:
                w = w[len(w) // 2 :] + w[: len(w) // 2]
            rows.append((f"h{i:03d}_{j}", " ".join(w).upper() if r.random() < 0.3 else ", ".join(w)))
    return rows


def pairs_of(spark, rows, **options):
    df = spark.createDataFrame([(h, d, 1, 2, "x", 3) for h, d in rows], SCHEMA)
    return {tuple(x) for x in near_duplicate_pairs(df, "hash", "doc", **options).collect()}


def test_pairs_equal_brute_force(spark):
    rows = corpus(1) + [("null", None), (None, "one two three four"), ("empty", ""), ("stub", "one two"), ("h000", None)] + corpus(1)[:9]
    assert pairs_of(spark, rows) == brute([x for x in rows if x[1] is not None])


def test_hot_keys_lose_no_pair(spark):
    rows = corpus(2, 25)
    base = " ".join(WORDS[:40])
    rows += [(f"v{i}", base.replace(WORDS[i], "changed")) for i in range(25)]
    assert pairs_of(spark, rows, hot_key=3) == brute(rows)


def test_many_copies_are_one_class(spark):
    text = " ".join(WORDS[:30])
    rows = [(f"c{i}", text + "!" * i) for i in range(40)] + [("other", text + " and then a few more words")]
    df = spark.createDataFrame(rows, "hash string, doc string")
    out = near_duplicate_groups(df, "hash", "doc").collect()
    assert len({r["class_id"] for r in out}) == 2 and len({r["group_id"] for r in out}) == 1
    assert {r["n_links"] for r in out} == {1}


def test_very_long_and_empty(spark):
    r = random.Random(5)
    long = " ".join(r.choice(WORDS) for _ in range(30_000))
    rows = [("a", long), ("b", long + " tail"), ("c", "x" * 100_000)]
    assert pairs_of(spark, rows) == {("a", "b")}
    assert near_duplicate_pairs(spark.createDataFrame([], "hash string, doc string"), "hash", "doc").count() == 0
    assert near_duplicate_groups(spark.createDataFrame([], "hash string, doc string"), "hash", "doc").count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, 101), (102, 101), (7, 7)]
    nodes = spark.createDataFrame([(i,) for i in [*range(1, 31), 100, 101, 102, 500]], "node long")
    out = {r["node"]: r["component"] for r in connected_components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {out[i] for i in range(1, 31)} == {1} and out[102] == out[101] == 100 and out[500] == 500


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        nxt = [i]
        for j, y in enumerate(b, 1):
            nxt.append(min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (x != y)))
        row = nxt
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 4), max_size=12), st.lists(st.integers(1, 4), max_size=12)), min_size=1, max_size=6))
def test_banded_distance(pairs):
    arrays = [(np.array(a, np.uint64), np.array(b, np.uint64)) for a, b in pairs]
    assert banded_edit_distance(arrays, 14).tolist() == [edit(a, b) for a, b in pairs]


def test_filter_loses_nothing(spark):
    from lodespark.llm.neardup import _probably_in

    rows = spark.range(-4000, 4000).toDF("id")
    wanted = rows.filter("id % 10 = 3").unionByName(rows.filter("id = 3"))
    out = {r["id"] for r in _probably_in(rows, wanted).collect()}
    want = {r["id"] for r in wanted.collect()}
    assert want <= out and len(out) <= len(want) + 5
    assert _probably_in(rows, wanted.limit(0)).count() == 0


def substituted(seed, copies, words=104, edits=3):
    """Copies of one text with ``edits`` words replaced by words of their own; most pairs are at 84 / 120 = 0.70."""
    r = random.Random(seed)
    base = [f"w{seed}x{i}" for i in range(words)]
    rows = []
    for c in range(copies):
        w = list(base)
        for k in r.sample(range(words), edits):
            w[k] = f"n{r.randrange(10**9)}"
        rows.append((f"g{seed}_{c:04d}", " ".join(w)))
    return rows


def test_hot_keys_of_large_groups_lose_no_pair(spark):
    rows = substituted(1, 300) + substituted(2, 300)
    found = pairs_of(spark, rows)
    assert found == pairs_of(spark, rows, hot_key=1_000_000)
    assert len(brute(rows) - found) <= 10  # the sketch's own misses at 0.70


def test_blocks_meet_once(spark):
    from pyspark.sql import functions as F

    from lodespark.llm.neardup import _blocks

    hot = spark.range(50).select(F.lit(3).cast("long").alias("k"), F.lit(0).alias("o"), "id", F.lit(1).alias("n"), F.lit(50).alias("c"))
    rows = _blocks(hot, 7).collect()
    met = [(a["id"], b["id"]) for a in rows for b in rows if a["k"] == b["k"] and a["id"] < b["id"] and (a["side"] == 0 or a["side"] != b["side"])]
    assert len(met) == len(set(met)) == 50 * 49 // 2


def test_hot_keys_of_short_texts(spark):
    rows = [(f"s{i:03d}", f"a b c d e x{i}") for i in range(150)] + [("stub", "a b c d e")]
    assert pairs_of(spark, rows) == brute(rows) == {(f"s{i:03d}", "stub") for i in range(150)}


def test_order_and_repeats_do_not_matter(spark):
    r = random.Random(8)
    rows = []
    for i in range(30):
        lines = [" ".join(f"v{r.randrange(10**6)}" for _ in range(15)) for _ in range(20)]
        rows += [(f"o{i:02d}", " ".join(lines)), (f"r{i:02d}", " ".join(lines[::-1]))]
        passage = " ".join(lines[:7])
        rows += [(f"p{i:02d}", passage), (f"q{i:02d}", " ".join([passage] * 10))]
    assert pairs_of(spark, rows) == brute(rows)
    assert len(brute(rows)) >= 60


def test_large_groups_equal_brute_force(spark):
    rows = substituted(3, 300) + substituted(4, 300)
    assert pairs_of(spark, rows) == brute(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 6), max_size=25), min_size=1, max_size=5))
def test_entries_equal_brute_force(docs):
    """Each entry against the three least labelled k-mers, picked and ordered one by one."""
    from lodespark.functions.text import mix, shingles
    from lodespark.llm.neardup import _seeds, order_min_hashes

    k, entries = 3, 5
    flat = np.array([w for d in docs for w in d], np.uint64)
    offsets = np.cumsum([0, *map(len, docs)])
    packed, many, _, distinct = order_min_hashes(flat, offsets, k, entries)
    xor, mul = _seeds(entries, 1)
    at = 0
    for i, d in enumerate(docs):
        x = shingles(np.array(d, np.uint64), k)
        seen, labelled = {}, []
        for v in x:
            n = seen[v] = seen.get(v, -1) + 1
            labelled.append((n, v if n == 0 else mix(np.array([v]) + mix(np.array([n], np.uint64)))[0]))
        kinds = [[(p, v) for p, (n, v) in enumerate(labelled) if n == 0], [(p, v) for p, (_, v) in enumerate(labelled)]]
        want = set()
        for kind in kinds:
            for f in range(entries if kind else 0):
                hashed = []
                for place, v in kind:
                    with np.errstate(over="ignore"):
                        h = int((np.uint64(v) ^ xor[f]) * mul[f])
                    hashed.append((h ^ (h >> 31), place))
                hashed = sorted(hashed)[:3]
                if len(hashed) == 3:
                    key = np.array([f + 1], np.uint64)
                    for h, _ in hashed:
                        key = mix(key + mix(np.array([h], np.uint64)))
                    a, b, c = (p for _, p in hashed)
                    want.add((int(key[0]) >> 3, (a < b) | (b < c) << 1 | (a < c) << 2))
        got = {(int(e) >> 3, int(e) & 7) for e in packed[at : at + many[i]]}
        at += many[i]
        assert distinct[i] == len(seen) and want <= got and (len(seen) < 3 or want == got)


def test_short_texts_equal_brute_force(spark):
    rows = []
    r = random.Random(12)
    for i in range(120):
        w = [r.choice("abc") + str(i % 9) for _ in range(r.randint(3, 30))]
        rows.append((f"t{i:03d}", " ".join(w)))
        w[r.randrange(len(w))] = "z"
        rows.append((f"u{i:03d}", " ".join(w)))
    for hot in (3, 64):
        assert pairs_of(spark, rows, hot_key=hot) == brute(rows)
