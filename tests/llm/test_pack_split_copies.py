import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodespark.llm.copies import formatting_copies
from lodespark.llm.pack import _Histogram, batch_items, container_fills, pack_histogram, pack_items
from lodespark.llm.split import split_documents, split_text

BATCHES = "batch_id long, work_class string, token_ids array<array<int>>, lengths array<int>, pad_token_id int, created_at timestamp, capacity int, bucket string"
BUDGETS = "work_class string, max_batch_tokens int, length int"


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 30), max_size=12))))
def test_histogram_is_packed_whole(case):
    capacity, counts = case
    patterns = pack_histogram(capacity, counts)
    used = Counter()
    for pattern, times in patterns:
        assert sum(k * n for k, n in pattern.items()) <= capacity and times > 0
        for k, n in pattern.items():
            used[k] += n * times
    assert used == Counter(counts)
    total = sum(k * n for k, n in counts.items())
    # No two containers could be merged into one by first fit: never more than twice the bound.
    assert sum(t for _, t in patterns) <= max(1, 2 * -(-total // capacity)) or not counts


def test_triple_behind_many_used_up_pairs():
    """Seventy first lengths come before the triple, whose pairs are in the index but used up."""
    h = _Histogram(1000, {x: 1 for x in [*range(900, 970), 10, *range(21, 91), 500, 300, 200]})
    h.n[21:91] = 0
    assert h.three(1000) == (500, 300, 200)


def test_exact_complements_fill_all():
    assert sum(t for _, t in pack_histogram(10, {7: 5, 3: 5, 6: 3, 2: 6, 5: 4})) == 5 + 3 + 2


def test_items_and_containers(spark):
    r = random.Random(3)
    rows, truth = [], {}
    for b in range(60):
        ids = [[7] * r.choice([1, 5, 20, 33, 64, 200, 0]) for _ in range(r.randint(0, 9))]
        pad = r.choice([0, 9, None])
        padded = [x + [pad] * r.randint(0, 4) if pad is not None else x for x in ids]
        cls = r.choice(["a", "b", "zz", None])
        for _ in range(r.choice([1, 1, 2])):
            rows.append((b, cls, padded, None, pad, None, 1, "x"))
        truth.update({(b, i): (cls, len(x)) for i, x in enumerate(ids)})
    rows += [(100, "a", [None, [0, 0]], [4, 2], 0, None, 1, "x"), (101, "a", None, None, 0, None, 1, "x"), (None, "a", [[1]], None, 0, None, 1, "x")]
    truth |= {(100, 0): ("a", 4), (100, 1): ("a", 0)}
    budgets = spark.createDataFrame([("a", 64, 0), ("b", 50, 0), ("c", 10, 0)], BUDGETS)
    items = batch_items(spark.createDataFrame(rows, BATCHES))
    assert {(x["batch_id"], x["item_idx"]): (x["work_class"], x["length"]) for x in items.collect()} == truth
    packed = pack_items(items, budgets)
    pieces = defaultdict(list)
    fill = defaultdict(int)
    for x in packed.collect():
        pieces[x["batch_id"], x["item_idx"]].append((x["piece_no"], x["piece_start"], x["piece_length"]))
        if x["work_class"] in ("a", "b"):
            fill[x["work_class"], x["container_no"]] += x["piece_length"]
        else:
            assert x["container_no"] is None
    assert set(pieces) == set(truth)
    for key, (cls, n) in truth.items():
        got, cap = sorted(pieces[key]), {"a": 64, "b": 50}.get(cls)
        assert sum(p[2] for p in got) == n and [p[0] for p in got] == list(range(len(got)))
        assert len(got) == (max(1, -(-n // cap)) if cap else 1)
    fills = {(x["work_class"], x["container_no"]): x["fill"] for x in container_fills(packed, budgets).collect()}
    assert fills == dict(fill)
    for cls, cap in (("a", 64), ("b", 50)):
        used = [v for (c, _), v in fill.items() if c == cls]
        assert max(used) <= cap and len(used) <= -(-sum(used) // cap) + 3


def test_one_hot_length_and_empty(spark):
    items = spark.createDataFrame([(i, 0, "a", 32) for i in range(2001)], "batch_id long, item_idx int, work_class string, length int")
    budgets = spark.createDataFrame([("a", 64, 0)], BUDGETS)
    fills = container_fills(pack_items(items, budgets), budgets)
    assert sorted(x["n_pieces"] for x in fills.collect()) == [1] + [2] * 1000
    assert pack_items(items.limit(0), budgets).count() == 0 and pack_items(items, budgets.limit(0)).filter("container_no is null").count() == 2001


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .#\n\r`-é汉", max_size=600), st.integers(20, 80))
def test_pieces_cover_the_text(text, limit):
    overlap = limit // 7
    pieces = split_text(text, limit, overlap)
    if not text:
        assert pieces == []
        return
    assert pieces[0][:2] == (0, 0) and pieces[-1][2] == len(text)
    for start, core, end in pieces:
        assert end - start <= limit and core < end
    for (_, _, end), (start, core, _) in zip(pieces, pieces[1:]):
        assert core == end and core - start == overlap
        assert text[core - 1 : core + 1] != "\r\n"


def test_cuts_at_headings_and_not_in_fences():
    para = "Some words in a row that make a sentence. " * 12
    text = "\n\n".join([f"# Part {i}\n\n{para}\n\n```\n{'code line' * 5}\n\n# no heading\n```" for i in range(12)])
    pieces = split_text(text)
    assert len(pieces) > 2
    for _, core, _ in pieces[1:]:
        assert text[core:].startswith("# Part")


def test_split_table(spark):
    rows = [("a", "x" * 5000, 1), ("a", "x" * 5000, 2), ("b", "short", 1), ("c", None, 1), (None, "y" * 5000, 1), ("d", "", 1), ("e", "z" * 3600, 1), ("f", "\U0001f600" * 3601, 1)]
    out = split_documents(spark.createDataFrame(rows, "hash string, doc string, seq int"), "hash", "doc").collect()
    assert {r["key"] for r in out} == {"a", "f"} and all(len(r["piece"]) == r["end_pos"] - r["start_pos"] <= 3600 for r in out)
    every = split_documents(spark.createDataFrame(rows, "hash string, doc string, seq int"), "hash", "doc", only_oversized=False)
    assert {r["key"] for r in every.collect()} == {"a", "b", "e", "f"}
    with pytest.raises(ValueError):
        split_text("x", 100, 60)


EX = "example_id long, query string, loaded_at timestamp, key string, fp int, c int"


def key_of(q):
    letters = lambda s: "".join(c for c in s.upper().lower() if c.isalnum())
    lines = [x for x in re.split(r"\r\n|\r|\n", q) if x.strip()]
    if len(lines) > 1 and all(re.match(r"\s*(lex|vec|hyde|intent)\s*:", x, re.I) for x in lines):
        return ("typed", *sorted(letters(x) for x in lines))
    return letters(q)


def test_copies_equal_brute_force(spark):
    r = random.Random(9)
    base = ["How do I split it", "lex: a b\nvec: how a\nhyde: c", "lex: a b\nvec: how\nhyde: a c", "Don't: go", "straße 5", "", "?!", "lex: only one", "one\ntwo", "vec: x\nvec: x\nlex: y", "vec: x\nlex: y\nlex: y"]
    rows = []
    for i in range(300):
        q = r.choice(base)
        lines = q.split("\n")
        if r.random() < 0.4:
            r.shuffle(lines)
        q = r.choice(["\n", "\r\n", "\n \n"]).join(x.upper() if r.random() < 0.3 else x.replace(" ", "  ") for x in lines) + r.choice(["", "!", " ", "…"])
        rows.append((i, q, None, "k", 1, 2))
    rows += [(5, rows[5][1], None, "k", 1, 2), (400, None, None, "k", 1, 2), (401, None, None, "k", 1, 2), (None, "x", None, "k", 1, 2)]
    out = {x["key"]: (x["first_key"], x["n_copies"]) for x in formatting_copies(spark.createDataFrame(rows, EX), "example_id", "query", "loaded_at").collect()}
    groups = defaultdict(list)
    for i, q, *_ in {x[0]: x for x in rows if x[0] is not None}.values():
        groups[("null", i) if q is None else key_of(q)].append(i)
    assert out == {i: (min(g), len(g)) for g in groups.values() for i in g}
    assert formatting_copies(spark.createDataFrame([], EX), "example_id", "query", "loaded_at").count() == 0


def test_large_groups_are_spread(spark):
    rows = [(i, f"Copper {'-' * (i % 7)} ledger!" if i % 3 else f"lex: a{i % 2}\nvec: b", i) for i in range(400)] + [(900, None, 1), (901, "alone", 1)]
    df = spark.createDataFrame(rows, "k long, q string, v long")
    one, many = (sorted(map(tuple, formatting_copies(df, "k", "q", "v", per_salt=n).collect())) for n in (10**6, 9))
    assert one == many and len(one) == 402 and max(r[2] for r in one) == 266
