import pytest
from pyspark.sql import functions as F

from lodespark.functions import display
from lodespark.operators.expansion_reward import entities, key_terms, rewards

SCHEMA = "example_id long, query string, output array<struct<type string, text string>>, hyde int"


def test_entities_and_keys(spark):
    cases = {"TDS motorsports team": ["tds", "motorsports"], "Bob asked about deploy": ["bob"], "configure node.js now": ["node.js", "now"], "Configure React hooks": ["react", "hooks"], "how to paint": [], "the best API": ["api"]}
    rows = spark.createDataFrame([(q,) for q in cases], "q string").select("q", entities(F.col("q")).alias("e"), key_terms(F.col("q")).alias("k")).collect()
    assert {r["q"]: r["e"] for r in rows} == cases
    assert next(r["k"] for r in rows if r["q"] == "how to paint") == ["paint"]


def test_points(spark):
    good = [("lex", "react hooks lifecycle state"), ("lex", "effect cleanup react"), ("vec", "how do hooks keep state in React components"), ("vec", "ways to clean up effects when a part unmounts"), ("hyde", "React hooks keep state between renders and clean up their effects on unmount.")]
    rows = [
        (1, "React hooks", good, 1), (2, "React hooks", [("lex", "react hooks"), ("vec", "how do hooks keep state in React")], 1), (3, "React hooks", None, 1), (4, None, good, 1),
        (5, "React hooks", [("lex", " "), ("vec", None), None], 1), (6, "paint walls", [("lex", "how to"), ("vec", "walls")], 1), (7, "", good, 1),
    ]
    out = {r["example_id"]: r for r in rewards(spark.createDataFrame(rows, SCHEMA)).collect()}
    one = out[1]
    assert (one["format"], one["diversity"], one["hyde"], one["quality"], one["entity"]) == (30, 30, 20, 20, 20)
    assert one["percentage"] == 100 and one["rating"] == "Excellent"
    assert out[2]["percentage"] == 50 and out[2]["rating"] == "Acceptable"  # capped: a lex line echoes the query
    assert all(out[i]["percentage"] == 0 and out[i]["rating"] == "Failed" for i in (3, 4, 5))
    assert out[6]["quality"] == 5 + 2 + 0 and out[6]["entity"] == 10
    assert out[7]["rating"] and rewards(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("got, want", [(display.size_text(1536), "1.5 KB"), (display.size_text(10), "10 B"), (display.duration_text(0.25), "250ms"), (display.duration_text(75), "1m 15s"), (display.age_text(7300), "2h ago"), (display.eta_text(1, 3, 10), "20s"), (display.eta_text(0, 3, 10), "...")])
def test_display(got, want):
    assert got == want


def test_highlight_and_short_paths():
    assert display.highlight("a copper Ledger", "ledger a", "<", ">") == "a copper <Ledger>"
    assert display.short_paths(["/x/a/b.md", "/y/a/b.md", "/x/c.md"]) == {"/x/a/b.md": "a/b.md", "/y/a/b.md": "y/a/b.md", "/x/c.md": "x/c.md"}
