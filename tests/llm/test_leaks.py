import random
import re

import numpy as np

from lodespark.functions.text import mix
from lodespark.llm.leaks import leaked_items, window_fingerprints

WORDS = [f"{a}{b}" for a in "bcdfghk" for b in ("ar", "el", "in", "os", "up")]


def grams(text, n=10):
    w = re.findall(r"[^\W_]+", text.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_fingerprints_are_majorities():
    flat = np.random.default_rng(0).integers(0, 2**63, 500).astype(np.uint64)
    bits = ((mix(flat + np.uint64(0xA5A5))[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(int)
    for window in (1, 3, 8, 10, 15):
        counts = np.stack([bits[i : i + window].sum(0) for i in range(len(flat) - window + 1)])
        got = ((window_fingerprints(flat, window)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(int)
        assert (got == (2 * counts > window)).all(), window
    assert len(window_fingerprints(flat[:4], 5)) == 0


def test_leaks_equal_brute_force(spark):
    r = random.Random(4)
    items = [(i, " ".join(r.choice(WORDS) for _ in range(r.choice([5, 10, 30, 60])))) for i in range(25)]
    items += [(25, items[2][1]), (25, items[2][1]), (26, None), (None, "x y"), (27, "")]
    docs = []
    for d in range(120):
        w = [r.choice(WORDS) for _ in range(r.choice([0, 3, 40, 200]))]
        if r.random() < 0.5:
            src = r.choice(items[:25])[1].split()
            a = r.randrange(len(src))
            part = src[a : a + r.choice([6, 9, 10, 11, 40])]
            at = r.randrange(len(w) + 1)
            w[at:at] = part if r.random() < 0.6 else [x.upper() + "," for x in part]
        docs.append((d, "  ".join(w)))
    docs += [(500, None), (None, items[3][1]), (501, items[3][1] * 2), (502, " ".join(WORDS * 3000) + " " + items[4][1])]
    d = spark.createDataFrame([(a, b, 1, "i") for a, b in docs], "doc_id long, text string, item_id int, content string")
    i = spark.createDataFrame([(a, b, 1, "i") for a, b in items], "item_id long, content string, doc_id int, text string")
    want = {(x, y) for x, t in docs if t and x is not None for y, c in items if c and y is not None and grams(t) & grams(c)}
    for blocks in (200_000, 100):
        out = leaked_items(d, i, "doc_id", "text", "item_id", "content", block_windows=blocks).collect()
        assert {(x["doc_id"], x["item_id"]) for x in out} == want and len(out) == len(want)
    assert want
    assert leaked_items(d.limit(0), i, "doc_id", "text", "item_id", "content").count() == 0
    assert leaked_items(d, i.limit(0), "doc_id", "text", "item_id", "content").count() == 0


def test_similar_windows(spark):
    item = " ".join(WORDS[:10])
    near = " ".join([*WORDS[:9], "changed"])
    d = spark.createDataFrame([(1, near), (2, item)], "doc_id long, text string")
    i = spark.createDataFrame([(7, item)], "item_id long, content string")
    out = leaked_items(d, i, "doc_id", "text", "item_id", "content", radius=20, similarity=0.9).collect()
    assert {x["doc_id"] for x in out} == {1, 2}


def test_long_items_are_cut_without_loss(spark):
    from lodespark.llm.leaks import _parts

    words = [f"w{i}" for i in range(57)]
    parts = list(_parts(" ".join(words), 10, 7))
    windows = [p.split()[i : i + 10] for p, n in parts for i in range(n)]
    assert windows == [words[i : i + 10] for i in range(48)] and all(n <= 7 for _, n in parts) and not list(_parts("a b", 10, 7))
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:12])), (3, "w1 w2")], "doc_id long, text string")
    items = spark.createDataFrame([(5, " ".join(words)), (6, " ".join(words[:10])), (7, None), (8, "")], "item_id long, content string")
    out = sorted(map(tuple, leaked_items(docs, items, "doc_id", "text", "item_id", "content", block_windows=7).collect()))
    assert out == [(1, 5, 48), (1, 6, 1), (2, 5, 3), (2, 6, 1)]
