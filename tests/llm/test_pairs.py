import pytest

from lodespark.llm import pairs as P
from lodespark.llm.pairs import Refusals, SuffixAutomaton, WordClassifier, copied_coverage, defect, defective_pairs, unfinished

LABELLED = [
    ("where is the report kept and how do I read it", "en"), ("what happens when the pump is cold", "en"), ("wo liegen die Berichte und wie werden sie gelesen", "de"),
    ("Überblick über die Pumpen mit ihren Ventilen", "de"), ("où sont les rapports et comment les lire", "fr"), ("dónde están los informes y cómo se leen", "es"),
] * 12
SCHEMA = "example_id long, query string, output array<struct<type string, text string>>, loaded_at timestamp, defect string, kind int"


@pytest.fixture(scope="module")
def judge():
    a, c = Refusals(), WordClassifier(LABELLED)
    return lambda q, o: defect(q, o, a, c)


@pytest.mark.parametrize(
    "query, items, want",
    [
        ("what is x", None, "empty"), ("what is x", [], "empty"), ("what is x", [("lex", " "), ("vec", "N/A"), ("hyde", "..."), None, ("vec", None)], "empty"),
        ("what is x for", [("lex", "Query: what is X for"), ("vec", "for x is what")], "copied"), ("what is x for", [("lex", "what is x for"), ("vec", "the use of x")], None),
        ("where are the files", [("lex", "files"), ("hyde", "I'm sorry, but I can't help with that.")], "refusal"), ("where are the files", [("hyde", "I’m unable to do that. Ask again.")], "refusal"),
        ("where are the files", [("hyde", '"I am unable to go" was the note that they left on the files.')], None), ("where are the files", [("hyde", "The pump cannot help when it is cold.")], None),
        ("wo liegen die Berichte", [("hyde", "Leider muss ich diese Bitte ablehnen.")], "refusal"), ("水泵在哪里", [("hyde", "抱歉，我不能协助处理该请求。")], "refusal"),
        ("where are the files", [("vec", "wo liegen die Berichte und wie werden sie gelesen")], "language"), ("where are the files", [("lex", "wo liegen die Berichte und wie werden sie")], None),
        ("where are the files", [("hyde", 'They say "wo liegen die Berichte und wie werden sie gelesen" to each other.')], None), ("where are the files", [("vec", "关于水泵的说明")], "language"),
        ("where are the files", [("hyde", "The files are in the")], "truncated"), ("where are the files", [("hyde", "They are here, e.g.")], "truncated"), ("where are the files", [("hyde", "They are (in the box.")], "truncated"),
        ("where are the files", [("hyde", "They are here (in the box, etc.).")], None), ("where are the files", [("hyde", "They are...")], "truncated"), ("where are the files", [("hyde", 'It prints "ready, 5 left."')], None),
        ("lex: a b\nvec: where are they", [("hyde", "broken off in the")], None), (None, [("hyde", "They are in the")], "truncated"), ("", [("lex", "a")], None), ("!!", None, "empty"),
    ],
)
def test_defects(judge, query, items, want):
    assert judge(query, items) == want


def test_automaton_coverage():
    a = SuffixAutomaton(list("abcabd"))
    assert a.coverage(list("abd")) == 1 and a.coverage(list("xabx"), 2) == 0.5 and a.coverage([]) == 0 and a.coverage(list("zz")) == 0
    assert a.coverage(list("abxcabd"), 3) == pytest.approx(4 / 7)


def test_long_texts(judge):
    assert judge("where are the files", [("hyde", "The files are here. " * 20_000)]) is None
    assert unfinished("word " * 50_000)


def test_table(spark):
    rows = [
        (1, "where are the files", None, None, "x", 1), (1, "where are the files", None, None, "x", 1), (2, "where are the files", [("hyde", "They are in the")], None, "x", 1),
        (3, "where are the files", [("hyde", "They are here.")], None, "x", 1), (None, "q", None, None, "x", 1), (4, None, None, None, None, None),
    ]
    out = sorted(map(tuple, defective_pairs(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert out == [(1, "empty"), (2, "truncated"), (4, "empty")]
    assert defective_pairs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_quotes(judge):
    foreign = "wo liegen die Berichte und wie werden sie gelesen, " * 12
    for a, b in ('""', "“”", "«»", "「」"):
        assert judge("where are the files", [("hyde", f"They say {a}{foreign}{b} to each other.")]) is None
        assert judge("where are the files", [("hyde", f"They say {a}wo liegen die Berichte\r\nund wie werden sie gelesen{b} to each other.")]) is None
    assert judge("where are the files", [("hyde", f'They wrote "the files are old.\nI am unable to do that. {"The files were moved. " * 20}" on the door.')]) is None
    # An open mark quotes nothing beyond its paragraph.
    assert P._QUOTED.sub("", 'a 5" pipe\n \nwo liegen die 6" Berichte') == 'a 5" pipe\n \nwo liegen die 6" Berichte'
    assert P._QUOTED.sub("", "“" * 20_000) == "“" * 20_000


@pytest.mark.parametrize(
    "text",
    [
        "I'm sorry, but I cannot discuss that topic.", "Sorry, I won't provide instructions for this.", "Unfortunately I am not able to share those details.", "I must decline this one.", "As a language model I have no opinion on that.", "We cannot comply with this request.",
        "Dabei kann ich leider nicht weiterhelfen.", "Ich darf nicht antworten.", "Es ist mir nicht möglich, darauf einzugehen.", "Je ne peux malheureusement pas répondre à cette demande.", "Je préfère ne pas en parler.", "Lo siento, no puedo ayudarte con eso.", "Me niego a contestar.", "抱歉，我没办法回答这个问题。",
    ],
)
def test_refusals_not_in_the_data(judge, text):
    """Refusals written for this test, none of which the tables have."""
    assert judge("tell me something", [("hyde", text)]) == "refusal"


@pytest.mark.parametrize("text", ["The pump can't help it.", "Visitors cannot write on the wall.", "They were unable to go.", "Man kann nicht alles haben.", "On ne peut pas tout avoir.", "No se puede entrar.", "机器无法启动。"])
def test_no_refusals(text):
    assert not Refusals().match(text, P.words(text))


def test_copied_coverage(spark):
    rows = [
        (1, "one two three four five six", [("vec", "so two three four five end"), ("lex", "one two three"), None, ("hyde", None)], None, "x", 1),
        (2, "one two three", [("vec", "one two three")], None, "x", 1), (3, None, [("vec", "a b c d")], None, "x", 1), (4, "a b c d", None, None, "x", 1), (None, "a b c d", [("vec", "a b c d")], None, "x", 1),
        (5, "b a b a b a", [("hyde", "a b a b a b a b")], None, "x", 1),
    ]
    df = spark.createDataFrame(rows + rows[:1], SCHEMA)
    assert sorted(map(tuple, copied_coverage(df).collect())) == [(1, 9, 4), (5, 8, 8)]
    assert copied_coverage(df.limit(0)).count() == 0
