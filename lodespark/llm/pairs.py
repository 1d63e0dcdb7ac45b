"""Broken prompt and response pairs, with the type of defect.

Of a query and its output items, in this order: ``empty`` (nothing but blanks, punctuation and placeholders),
``copied`` (the walk through a suffix automaton of the query covers every word of every item, in runs of any length, as the definition
asks only for words of the query; ``copied_coverage`` reports what longer runs cover), ``refusal`` (an Aho-Corasick automaton of
refusal phrases, made of ways to say no and of verbs, matches outside quotes), ``language`` (stopword votes of a vec or hyde item against those of the query),
``truncated`` (a hyde item ends within a sentence, or its delimiter stack isn't empty).

Texts without stopwords, such as queries of a few nouns, are voted on by a classifier of words. It is fitted once a
run on at most ``fit_rows`` examples whose stopword votes are clear.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespark.functions.text import words
from lodespark.session import spread

DEFECTS = ("empty", "copied", "refusal", "language", "truncated")
FIT_ROWS = 4000  #: examples that the classifier for texts without stopwords is fitted on, at most

# Placeholders, labels, refusal phrases, stopwords, abbreviations.
PLACEHOLDERS = {"n a", "na", "none", "null", "nil", "nan", "empty", "no output", "todo", "tbd", "undefined", "missing", "blank", "no answer", "no response", "keine", "leer", "vide", "vacío", "ninguno", "无", "空"}
LABEL = re.compile(r"^\W*(?:q|query|question|prompt|input|user|search|frage|anfrage|suche|pregunta|consulta|question|requête|recherche|问题|查询|提问)\s*[:：\-–—=>]+", re.I)
# Ways to say no that need a verb behind (or between), the verbs, and those that stand alone.
_CANNOT = {
    "en": (
        ["i can't", "i cannot", "i can not", "i could not possibly", "i won't", "i will not", "we can't", "we cannot"],
        "help assist answer provide respond comply fulfil fulfill write generate create continue discuss share offer give support complete engage produce process proceed recommend advise participate facilitate accommodate".split() + ["do that", "do this", "do so", "go into that"],
    ),
    "de": (
        ["kann ich nicht", "kann ich leider nicht", "ich kann nicht", "ich kann leider nicht", "darf ich nicht", "ich darf nicht", "werde ich nicht", "ich werde nicht", "ich kann dabei nicht", "kann ich dabei nicht", "ich kann hierbei nicht", "kann ich hierbei nicht", "ich kann ihnen nicht", "ich kann dir nicht"],
        "helfen weiterhelfen beantworten behilflich antworten unterstützen bearbeiten erfüllen liefern nennen ausführen erstellen dienen".split(),
    ),
    "fr": (
        ["je ne peux pas", "je ne peux malheureusement pas", "je ne puis", "je ne saurais", "je ne vais pas", "nous ne pouvons pas"],
        "répondre aider fournir traiter donner écrire satisfaire produire rédiger continuer accéder assister générer".split() + ["vous aider", "t'aider", "vous fournir", "vous répondre", "y répondre"],
    ),
    "es": (
        ["no puedo", "no podemos", "no podré", "no voy a", "no me es posible"],
        "ayudar ayudarte ayudarle responder atender proporcionar contestar ofrecer generar escribir cumplir facilitar continuar dar".split(),
    ),
    "zh": (["我不能", "我无法", "我没办法", "恕我不能", "恕我无法", "很抱歉不能", "抱歉无法"], "协助 帮助 帮您 帮你 回答 提供 处理 满足 完成 答复 生成 继续 讨论".split()),
}
_ALONE = {
    "en": [
        "i won't be able to", "i will not be able to", "i'm unable to", "i am unable to", "i'm not able to", "i am not able to", "i must decline", "i have to decline", "i need to decline", "i'd rather not", "i would rather not", "i must refuse", "i have to refuse", "i refuse to",
        "not something i can answer", "not something i can help", "not something i'm able", "against my guidelines", "against my policy", "violates my guidelines", "i have no access to that", "i don't have access to that", "i do not have access to that",
        "i don't feel comfortable", "i do not feel comfortable", "i'm not comfortable", "i am not comfortable", "as an ai language model", "as a language model", "i'm not allowed to", "i am not allowed to", "i'm not permitted to", "i am not permitted to",
    ],
    "de": [
        "kann ich bei dieser", "ich kann bei dieser", "ich kann diese frage nicht", "kann ich diese frage nicht", "kann ich diese anfrage nicht", "ich kann diese anfrage nicht", "ich kann diese bitte nicht", "kann ich diese bitte nicht", "darf ich dazu keine", "ich darf dazu keine", "ich darf dazu nicht",
        "muss ich ablehnen", "ich muss ablehnen", "muss ich diese bitte ablehnen", "ich muss diese bitte ablehnen", "muss ich diese anfrage ablehnen", "ich muss diese anfrage ablehnen", "ich lehne diese", "muss ich leider ablehnen", "ich muss leider ablehnen",
        "ist es mir nicht möglich", "es ist mir nicht möglich", "ist mir nicht möglich", "ich bin nicht in der lage", "bin ich nicht in der lage", "als sprachmodell",
    ],
    "fr": ["je ne suis pas en mesure", "je dois refuser", "je dois décliner", "il m'est impossible", "je refuse de", "je ne suis pas autorisé", "je ne suis pas capable de", "je préfère ne pas", "en tant que modèle de langage"],
    "es": ["no me es posible", "debo rechazar", "tengo que rechazar", "debo declinar", "no estoy autorizado", "me es imposible", "no soy capaz de", "no estoy en condiciones", "me niego a", "prefiero no", "como modelo de lenguaje"],
    "zh": ["恕我不便", "我必须拒绝", "我只能拒绝", "我拒绝回答", "不便提供这些内容", "无法满足您的请求", "我不便", "作为语言模型", "我需要拒绝"],
}
REFUSALS = {lang: _ALONE[lang] + [no + ("" if lang == "zh" else " ") + verb for no in start for verb in verbs] for lang, (start, verbs) in _CANNOT.items()}
STOPWORDS = {
    "en": "a an the and or but of to in on at for with without from by as is are was were be been does do did how what where why which who when that this these those it its our their they we you your i my not no can will would should if then than so into over until since keep kept best way about may yet only nothing anyone there here such both each every some any ways guide explanation",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber nicht kein keine von zu im in am an auf für mit ohne aus bei nach vor als ist sind war waren wird werden wurde wurden wie was wo warum welche welcher welches wer wann wenn weil dass es sie er wir ihr ich man sich hat haben hatte auch nur noch schon über unter zwischen seit bis durch gegen zum zur beim vom ihren ihre alle hat liegen siehe danach",
    "fr": "le la les l un une des du de et ou mais ne pas sans avec pour par dans sur sous chez au aux en est sont était étaient sera comment pourquoi où quel quelle quels quelles qui que quoi quand si ce cet cette ces il elle ils elles on nous vous je se ont avait aussi seulement encore entre depuis jusqu vers leur leurs tous toutes tout comme dont puis qu notre ses son sa avant après faut sont",
    "es": "el la los las lo un una unos unas de del y o pero no sin con para por en sobre bajo es son era eran está están cómo como por qué dónde cuál cuáles quién que cuando cuándo si este esta estos estas ese esa esos esas al se su sus nos le les ha han había también solo aún entre desde hasta hacia todos todas todo ya más muy antes tras hay nuestro nadie pasa ni pone faltan sus",
}
ABBREVIATIONS = ("e.g.", "i.e.", "z. b.", "z.b.", "d. h.", "d.h.", "p. ex.", "p.ex.", "par ex.", "p. ej.", "p.ej.", "c.-à-d.", "vs.", "bzw.", "cf.", "incl.", "inkl.", "u. a.", "u.a.", "es decir", "比如", "例如")

_SPEAKERS: dict[str, list[str]] = {}
for _lang, _words in STOPWORDS.items():
    for _w in set(_words.split()):
        _SPEAKERS.setdefault(_w, []).append(_lang)
#: Votes of each stopword: one, shared by the languages that have it.
_VOTES = {w: [(lang, 1 / len(langs)) for lang in langs] for w, langs in _SPEAKERS.items()}
_HAN = re.compile(r"[㐀-䶿一-鿿豈-﫿]")
# A quote has no bound of length, but ends with its paragraph at the latest.
_QUOTED = re.compile("|".join(rf"{a}(?:[^{b}\r\n]|(?:\r\n|\r|\n)(?![ \t]*[\r\n]))++[{b}]" for a, b in ('""', "“”", "«»", ("„", "“”"), "「」", "『』", "``")))
_QUOTE_MARKS = re.compile(r'["“”«»„「」『』`]')
_TYPED = re.compile(r"\s*(?:lex|vec|hyde|intent)\s*:", re.I)
_LINES = re.compile(r"\r\n|\r|\n")
_PAIRS = {")": "(", "]": "[", "}": "{", "）": "（", "】": "【", "」": "「", "』": "『", "”": "“", "»": "«", "》": "《"}
_OPEN = set(_PAIRS.values())
_MARKS = re.compile("[" + re.escape("".join([*_PAIRS, *_PAIRS.values(), '"`'])) + "]")


class SuffixAutomaton:
    """All runs of a sequence; ``coverage`` is the share of another sequence that lies in common runs of at least ``least``."""

    def __init__(self, sequence: list):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for x in sequence:
            cur = len(self.next)
            self.next.append({})
            self.link.append(0)
            self.length.append(self.length[last] + 1)
            p = last
            while p >= 0 and x not in self.next[p]:
                self.next[p][x] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][x]
                if self.length[q] == self.length[p] + 1:
                    self.link[cur] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.link.append(self.link[q])
                    self.length.append(self.length[p] + 1)
                    while p >= 0 and self.next[p].get(x) == q:
                        self.next[p][x] = copy
                        p = self.link[p]
                    self.link[q] = self.link[cur] = copy
            last = cur

    def covered(self, sequence: list, least: int = 1) -> int:
        """How many places of the sequence lie in common runs of at least ``least``."""
        state = run = upto = covered = 0
        for i, x in enumerate(sequence):
            while state and x not in self.next[state]:
                state = self.link[state]
                run = self.length[state]
            if x in self.next[state]:
                state, run = self.next[state][x], run + 1
            else:
                run = 0
            if run >= least:
                covered += i + 1 - max(upto, i + 1 - run)
                upto = i + 1
        return covered

    def coverage(self, sequence: list, least: int = 1) -> float:
        return self.covered(sequence, least) / len(sequence) if sequence else 0.0


class Refusals:
    """An Aho-Corasick automaton of the refusal phrases; texts without the rarest word of any are not walked through."""

    def __init__(self):
        self.automaton = ahocorasick.Automaton()
        self.marks = set()
        for lang, phrases in REFUSALS.items():
            for p in phrases:
                self.automaton.add_word(p if lang == "zh" else f" {p} ", p)
                if lang != "zh":
                    self.marks.add(max(words(p), key=len))
        self.automaton.make_automaton()

    def match(self, text: str, found: list[str]) -> bool:
        """Whether a refusal phrase stands outside of quotes; ``found`` are the words of the text."""
        return (not self.marks.isdisjoint(found) or bool(_HAN.search(text))) and refuses(text, self.automaton)


def refuses(text: str, automaton: ahocorasick.Automaton) -> bool:
    """Whether a refusal phrase stands outside of quotes."""
    plain = _QUOTED.sub(" ", text)
    if plain.count('"') == 1 and plain.strip().startswith('"') or plain.strip().startswith("“"):
        plain = plain.replace('"', " ")
    spaced = " " + re.sub(r"[^\w'\-.]+|\.(?!\w)", " ", plain.lower().replace("’", "'").replace("ʼ", "'").replace("`", "'")).strip() + " "
    # Phrases have a blank at either end; those within a longer word do not count.
    return any(True for _ in automaton.iter(re.sub(r"\s+", " ", spaced)))


def is_placeholder(text: str | None, found: list[str] | None = None) -> bool:
    """Null, blank, bare punctuation, or a value that stands for nothing."""
    found = words(text) if found is None else found
    return not found or len(found) < 4 and " ".join(found) in PLACEHOLDERS


def unfinished(text: str) -> bool:
    """Whether a text breaks off before its last sentence is complete."""
    t = text.rstrip().rstrip("​﻿").rstrip()
    if not t:
        return False
    stack: list[str] = []
    quotes = {'"': 0, "`": 0}
    for c in _MARKS.findall(t):
        if c in quotes:
            quotes[c] ^= 1
        elif c in _OPEN:
            stack.append(c)
        elif c in _PAIRS and stack and stack[-1] == _PAIRS[c]:
            stack.pop()
    if stack or any(quotes.values()):
        return True
    if re.search(r"[\[(（【<]\s*(?:\.{2,}|…+)\s*[\])）】>]$", t):
        return True
    core = t.rstrip("\"'”’»」』)]）】*_` ")
    low = core.lower()
    if low.endswith(ABBREVIATIONS) and any(low.endswith(a) and (len(low) == len(a) or not low[-len(a) - 1].isalnum() or not a[0].isascii()) for a in ABBREVIATIONS):
        return True
    if core.endswith(("...", "…", "..")):
        return True
    return not core.endswith((".", "!", "?", "。", "！", "？", "‽", "؟"))


class WordClassifier:
    """Naive Bayes over words, for texts that no stopword speaks for. Words seen fewer than ``least`` times, such as names, have no say."""

    def __init__(self, labelled: list[tuple[str, str]], least: int = 12):
        counts: dict[str, Counter] = {}
        for text, lang in labelled:
            if lang == "zh":
                continue  # told by its characters alone
            counts.setdefault(lang, Counter()).update(w for w in words(text) if w.isalpha())
        total: Counter = sum(counts.values(), Counter())
        self.known = {w for w, n in total.items() if n >= least}
        self.logs = {}
        for lang, c in counts.items():
            mass = math.log(sum(n for w, n in c.items() if w in self.known) + 0.3 * len(self.known) + 1)
            self.logs[lang] = ({w: math.log(c[w] + 0.3) - mass for w in c if w in self.known}, math.log(0.3) - mass)

        self.langs = list(self.logs)
        self.scores = {w: [logs.get(w, unseen) for logs, unseen in self.logs.values()] for w in self.known}

    def margin(self, found: list[str]) -> tuple[str | None, float]:
        """The best language of the words and its log-likelihood lead over the next."""
        scores = [self.scores[w] for w in found if w in self.scores]
        if not scores or len(self.langs) < 2:
            return None, 0.0
        totals = [sum(x) for x in zip(*scores)]
        ranked = sorted(zip(totals, self.langs), reverse=True)
        return ranked[0][1], ranked[0][0] - ranked[1][0]


def without_quotes(text: str) -> str:
    """The text without what it quotes; all of it, if the whole text stands in quotes."""
    if not _QUOTE_MARKS.search(text):
        return text
    plain = _QUOTED.sub(" ", text)
    return plain if words(plain) else text


def votes(plain: str, found: list[str]) -> dict[str, float]:
    """Stopword votes by language, of a text without quotes and its words; Han characters vote for Chinese."""
    c: dict[str, float] = {}
    han = 0 if plain.isascii() else len(_HAN.findall(plain))
    if han:
        c["zh"] = han / 2
    for w in found:
        for lang, share in _VOTES.get(w, ()):
            c[lang] = c.get(lang, 0) + share
    return c


def _voted(counted: dict[str, float], lead: float) -> str | None:
    ranked = sorted(counted.items(), key=lambda x: -x[1])[:2]
    if not ranked or ranked[0][1] < lead:
        return None
    return ranked[0][0] if len(ranked) == 1 or ranked[0][1] - ranked[1][1] >= lead else None


def stopword_language(text: str, lead: float = 1.0) -> str | None:
    plain = without_quotes(text)
    return _voted(votes(plain, words(plain)), lead)


def language(text: str, found: list[str], parts: WordClassifier, lead: float, expected: str | None = None) -> str | None:
    """The language that stopwords vote for, unless the classifier is sure of another; without votes, the classifier's, if it leads.

    ``found`` are the words of the text. A vote for the ``expected`` language is taken as it is.
    """
    plain = without_quotes(text)
    found = found if plain is text else words(plain)
    voted = _voted(votes(plain, found), 1.0)
    if voted is not None and voted == expected:
        return voted
    guess, margin = parts.margin(found)
    if voted is None:
        return guess if margin >= lead else None
    return voted if guess == voted or margin < 3 else None


def is_query_document(query: str) -> bool:
    if "\n" not in query and "\r" not in query:
        return False
    lines = [x for x in _LINES.split(query) if x.strip()]
    return len(lines) >= 2 and all(_TYPED.match(x) for x in lines)


def defect(query: str | None, items: list[tuple[str | None, str | None] | None] | None, refusals: Refusals, parts: WordClassifier) -> str | None:
    """The first defect that fits, or None."""
    if query is not None and is_query_document(query):
        return None
    real = [(kind, text, found) for kind, text, found in ((x[0], x[1], words(x[1])) for x in items or [] if x is not None) if not is_placeholder(text, found)]
    if not real:
        return "empty"
    query_words = words(query)
    known, automaton = set(query_words), None

    def covered(found: list[str]) -> bool:
        nonlocal automaton
        if not known.issuperset(found):
            return False  # a word that the query lacks is in no run
        automaton = automaton or SuffixAutomaton(query_words)
        return automaton.coverage(found) == 1

    if query_words and all(covered(found) or covered(words(LABEL.sub("", text, count=1))) for _, text, found in real):
        return "copied"
    if any(refusals.match(text, found) for _, text, found in real):
        return "refusal"
    if query_words:
        own = language(query, query_words, parts, 1.0)
        if own is not None:
            for kind, text, found in real:
                if kind in ("vec", "hyde") and language(text, found, parts, 4.0, own) not in (None, own) and not covered(found):
                    return "language"
    if any(kind == "hyde" and unfinished(text) for kind, text, _ in real):
        return "truncated"
    return None


def _judge(labelled: list[tuple[str, str]]):
    schema = pa.schema([("example_id", pa.int64()), ("defect", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refusals, parts = Refusals(), WordClassifier(labelled)
        for batch in batches:
            ids, kinds = [], []
            for i, q, o in zip(*(batch.column(c).to_pylist() for c in range(3))):
                d = defect(q, None if o is None else [None if x is None else (x["type"], x["text"]) for x in o], refusals, parts)
                if d:
                    ids.append(i)
                    kinds.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string())], schema=schema)

    return run


def _latest(examples: DataFrame) -> DataFrame:
    rows = examples.select("example_id", "query", "output", "loaded_at").filter("example_id is not null")
    return rows.groupBy("example_id").agg(F.max(F.struct("loaded_at", "query", "output")).alias("x")).select("example_id", "x.query", "x.output")


def copied_coverage(examples: DataFrame, least: int = 4) -> DataFrame:
    """``example_id, n_words, n_copied``: how many words of the output lie in runs of at least ``least`` words that the query has, too, in that order.

    One row per example with such a run. Of rows with one id the latest counts; null ids, queries, items and texts give none.
    """
    schema = pa.schema([("example_id", pa.int64()), ("n_words", pa.int64()), ("n_copied", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [], [], []
            for i, q, texts in zip(*(batch.column(c).to_pylist() for c in range(3))):
                found, sought = words(q), [words(t) for t in texts]
                if len(found) < least:
                    continue
                automaton = SuffixAutomaton(found)
                copied = sum(automaton.covered(x, least) for x in sought)
                if copied:
                    for column, v in zip(out, (i, sum(map(len, sought)), copied)):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=schema)

    texts = F.transform(F.filter("output", lambda x: x["text"].isNotNull()), lambda x: x["text"])
    once = _latest(examples).filter("query is not null and output is not null").select("example_id", "query", texts.alias("texts"))
    return spread(once, "example_id").mapInArrow(run, "example_id long, n_words long, n_copied long")


def defective_pairs(examples: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``example_id, defect``: one row per defective example.

    ``examples``: ``example_id, query, output, loaded_at``; other columns are ignored. Of rows with one id the latest counts;
    null ids are left out. A null or wordless query has no copied or foreign items. An empty table gives an empty result.
    Texts are read whole, whatever their length.
    """
    rows = examples.select("example_id", "query", "output", "loaded_at").filter("example_id is not null")
    sample = rows.filter("query is not null and output is not null").orderBy(F.xxhash64("example_id"), "loaded_at").select("query", F.transform("output", lambda x: x["text"]).alias("t")).limit(fit_rows).collect()
    labelled = []
    for r in sample:
        for text in [r["query"], *r["t"]]:
            lang = stopword_language(text, 2.0) if text else None
            if lang:
                labelled.append((without_quotes(text), lang))
    return spread(_latest(examples), "example_id").mapInArrow(_judge(labelled), "example_id long, defect string")
