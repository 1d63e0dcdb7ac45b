import math
import random
import re

import pytest

from lodespark.llm.mixing import entropy, mix_sources, mixture, share_exponent, temperature_weights

DOCS = "doc_id long, text string, source string, tokens int, target_share double, block int"
TARGETS = "source string, target_share double, max_repeats int, tokens int"


def n_tokens(t):
    return len(re.findall(r"[^\W\d_]+|\d+|[^\w\s]|_", t))


def make(spark, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(900):
        src = r.choice(["big_one"] * 12 + ["Big-One ", "mid", "mid", "small", "none", None])
        rows.append((i, " ".join(r.choice(["ab", "c1", "?", "x,y", "12"]) for _ in range(r.randint(1, 60))) + f" {i // 2 if i % 9 == 0 else i}", src, 1, 0.5, 2))
    rows += [(2000, None, "mid", 1, 0.5, 2), (2001, "  ", "mid", 1, 0.5, 2), (None, "a b", "mid", 1, 0.5, 2), (3000, rows[0][1], "small", 1, 0.5, 2)]
    return rows, spark.createDataFrame(rows, DOCS)


def test_shares_and_repeats(spark):
    rows, docs = make(spark)
    targets = spark.createDataFrame([("big_one", 0.5, 1, 0), ("mid", 0.3, 2, 0), ("small", 0.2, 3, 0)], TARGETS)
    chosen, shares = mix_sources(docs, targets)
    picked = chosen.collect()
    assert len({x["doc_id"] for x in picked}) == len(picked)
    text = {r[0]: r for r in rows}
    limits = {"big_one": 1, "mid": 2, "small": 3}
    assert len({text[x["doc_id"]][1] for x in picked}) == len(picked)
    used = {}
    for x in picked:
        assert x["tokens"] == n_tokens(text[x["doc_id"]][1]) and 1 <= x["repeats"] <= limits[x["source"]]
        used[x["source"]] = used.get(x["source"], 0) + x["tokens"] * x["repeats"]
    total = sum(used.values())
    out = {x["source"]: x for x in shares.collect()}
    for s, share in (("big_one", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert out[s]["budget_tokens"] - 200 < out[s]["used_tokens"] <= out[s]["budget_tokens"] and out[s]["most_repeats"] <= out[s]["max_repeats"]
        assert out[s]["used_tokens"] == used[s] and out[s]["actual_share"] == pytest.approx(used[s] / total)
        assert abs(used[s] / total - share) < 200 / total
    # The scarcest source is used up.
    assert any(out[s]["available_tokens"] * limits[s] - used[s] < 200 for s in limits)


def test_given_total_and_empty(spark):
    _, docs = make(spark, 2)
    targets = spark.createDataFrame([("big_one", 0.5, 1, 0), ("mid", 0.5, 1, 0), ("absent", 0.3, 5, 0), (None, 0.1, 1, 0)], TARGETS)
    chosen, shares = mix_sources(docs, targets, total=1000)
    assert abs(sum(x["tokens"] * x["repeats"] for x in chosen.collect()) - 1000) < 400
    assert {x["source"]: x["used_tokens"] for x in shares.collect()}["absent"] == 0
    for d, t in ((docs.limit(0), targets), (docs, targets.limit(0))):
        chosen, _ = mix_sources(d, t)
        assert chosen.count() == 0


def test_exponents():
    w, t = temperature_weights({"a": 900, "b": 90, "c": 10}, 0.8)
    assert 0 < t < 1 and entropy(w) == pytest.approx(0.8 * math.log(3), rel=1e-6) and w["a"] > w["b"] > w["c"]
    assert temperature_weights({"a": 5}, 0.5) == ({"a": 1.0}, 1.0)
    # More than the targets allow: the exponent moves towards the shares as they are, until nothing is repeated too often.
    w, total, t = mixture({"a": 1000, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}, total=500)
    assert 0 < t["b"] < 1 < t["a"] and w["b"] * total <= 20 + 1e-6 and total == pytest.approx(500)
    assert mixture({}, {"a": 1.0}, {"a": 1}) == ({}, 0.0, {})
    # Without a total: the targets, by an exponent each, and as much as the limits allow.
    w, total, t = mixture({"a": 1000, "b": 10}, {"a": 0.6, "b": 0.4}, {"a": 1, "b": 2})
    assert w == pytest.approx({"a": 0.6, "b": 0.4}, abs=1e-12) and total == pytest.approx(50)
    assert t == pytest.approx({"a": math.log(0.6) / math.log(1000 / 1010), "b": math.log(0.4) / math.log(10 / 1010)}, rel=1e-9)
    for natural, target in ((0.5, 0.5), (0.999999, 1e-6), (1e-9, 0.9), (1.0, 1.0), (0.3, 1.0)):
        assert natural ** share_exponent(natural, target) == pytest.approx(target, rel=1e-9)


def test_target_entropy(spark):
    _, docs = make(spark, 3)
    targets = spark.createDataFrame([("big_one", 3), ("mid", 2), ("small", 3), ("absent", 1)], "source string, max_repeats int")
    for total in (None, 3000):
        chosen, shares = mix_sources(docs, targets, total=total, target_entropy=0.8)
        out = {x["source"]: x for x in shares.collect()}
        assert out["absent"]["used_tokens"] == 0 and out["big_one"]["target_share"] > out["mid"]["target_share"] > out["small"]["target_share"] > 0
        assert entropy({s: x["target_share"] for s, x in out.items()}) == pytest.approx(0.8 * math.log(3), rel=1e-6)
        used = sum(x["used_tokens"] for x in out.values())
        assert all(abs(x["actual_share"] - x["target_share"]) < 200 / used for x in out.values())
    assert abs(used - 3000) < 400
    assert mix_sources(docs.limit(0), targets, target_entropy=0.8)[0].count() == 0
