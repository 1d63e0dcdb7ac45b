"""Personal information in free text: a linear-chain conditional random field.

Texts are cut into tokens (words, chains of digits with their separators, single marks, line ends). Features are word
shapes: case pattern, digit pattern, first and last letters, length, blank before, membership in the list of given names. They
are looked up at up to four tokens before and behind. The field is trained by gradient ascent on the likelihood, from the
labelled table in ``pii_labels``, and decoded by Viterbi in numpy.

All features hang on token types, so a type's scores are computed once and a text costs a few table lookups a token. A
token whose lead of the label O exceeds what two transitions can make up for is O on every best path; texts are cut
there, and only the runs between are decoded. That is exact: the paths are those of the whole text.

After decoding, spans are trimmed to whole words; what the field has found is dropped only where nothing of its kind is left.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespark.llm.pii_labels import COPIES, KINDS, known_names, labelled_lines, plain_letters
from lodespark.session import spread

LABELS = ["O", *KINDS]
K = len(LABELS)
_PAD = 4
OFFSETS = (-4, -3, -2, -1, 0, 1, 2, 3, 4)
_AROUND = tuple(o for o in OFFSETS if o)
_GAZETTEER_ROWS = 1_000_000
EPOCHS = 10  #: passes over the labelled table
_CHUNK_CHARS = 4_000_000

TOKEN = re.compile(
    r"[^\S\r\n]*(?:[+(]{0,2}\d++(?![^\W\d_])(?:(?: \(|\) ?|[ .\-/])\d++(?![^\W\d_]))*+|[^\W_]++(?:['’][^\W_]++)*+|[^\w\s]|_)|\r\n|\r|\n|[^\S\r\n]+"
)
_EDGE = {"\r": "\n", "\r\n": "\n"}  #: line ends are alike
_DIGIT = str.maketrans("123456789", "999999999")


def tokens(text: str) -> list[str]:
    """Tokens with the blanks before them; together they are the text."""
    return TOKEN.findall(text)


def _shape(w: str) -> str:
    if w.isupper():
        return "X" if len(w) == 1 else "XX"
    if w.istitle() or (w[0].isupper() and w[1:].islower()):
        return "Xx"
    if w.islower():
        return "x" if len(w) > 1 else "x1"
    return re.sub(r"(.)\1+", r"\1+", "".join("X" if c.isupper() else "x" if c.islower() else "9" if c.isdigit() else c if not c.isalnum() else "c" for c in w))[:12]


def type_features(token: str, given: frozenset) -> list[str]:
    """Features of a token type; those that start with a mark are looked up beside the token, too."""
    if token in ("\n", "\r", "\r\n", ""):
        return ["~w=\n"]
    w = token.lstrip()
    if not w:
        return ["~w= "]
    space = "s" if len(w) < len(token) else "n"
    low = w.lower()
    if w[0].isdigit() or (len(w) > 1 and w[0] in "+(" and any(c.isdigit() for c in w)):
        n = sum(c.isdigit() for c in w)
        shape = w.translate(_DIGIT)
        flat = shape.replace("0", "9")
        kind = re.sub(r"9+", "9", flat)
        if all(not c.isalpha() for c in w):
            return [f"~d={flat[:24]}", f"~n={min(n, 16)}", f"~k={kind[:14]}", f"z={shape[:2]}|{min(n, 16)}", f"~b={space}|num", "num"]
        return [f"~d={re.sub(r'[a-z]', 'x', re.sub(r'[A-Z]', 'X', flat))[:14]}", f"~n={n}a", f"~b={space}|mix", "mix"]
    out = [f"~w={low[:20]}", f"~b={space}|{_shape(w)}"]
    if w[0].isalpha():
        if any(c.isdigit() for c in w):
            return [f"~d={re.sub(r'[a-z]', 'x', re.sub(r'[A-Z]', 'X', w)).translate(_DIGIT).replace('0', '9')[:14]}", f"~b={space}|mix", "mix"]
        bare = plain_letters(low)
        out += [f"~s={_shape(w)}", f"p3={bare[:3]}", f"s3={bare[-3:]}", f"~s4={bare[-4:]}", f"s5={bare[-5:]}", f"p4={bare[:4]}", f"l={min(len(w), 12)}"]
        if bare in given:
            out += ["~given", f"given|{_shape(w)}"]
    return out


class Types:
    """Token types and their scores at each offset; new types are added as they come."""

    def __init__(self, model: "Model | None", given: frozenset, limit: int = 400_000):
        self.model, self.given, self.limit = model, given, limit
        self.ids: dict[str, int] = {}
        self.feats: list[list[int]] = []
        self.table = np.zeros((0, len(OFFSETS), K), np.float32)
        self.features: dict[str, int] = {} if model is None else model.features

    def encode(self, toks: list[str]) -> np.ndarray:
        if self.model is not None and len(self.ids) > self.limit:
            self.ids, self.feats, self.table = {}, [], self.table[:0]
        ids = self.ids
        for t in set(toks).difference(ids):
            ids[t] = len(self.feats)
            names = type_features(t, self.given)
            if self.model is None:
                self.feats.append([self.features.setdefault(f, len(self.features)) for f in names])
            else:
                self.feats.append([self.features[f] for f in names if f in self.features])
        return np.fromiter(map(ids.__getitem__, toks), np.int32, len(toks))

    def scores(self) -> np.ndarray:
        """(types, offsets, labels)"""
        old = len(self.table)
        if old < len(self.feats):
            new = self.feats[old:]
            lens = np.array([len(f) for f in new])
            flat = np.array([x for f in new for x in f], np.int64)
            rows = np.repeat(np.arange(len(new)), lens)
            add = np.zeros((len(new), len(OFFSETS), K), np.float32)
            np.add.at(add, rows, self.model.weights[flat])
            self.table = np.concatenate([self.table, add])
        return self.table


class Model:
    def __init__(self, features: dict[str, int], weights: np.ndarray, trans: np.ndarray):
        self.features, self.weights, self.trans = features, weights, trans


def _padded(seqs: list[np.ndarray], pad: int) -> np.ndarray:
    out = np.full((len(seqs), max(map(len, seqs))), pad, np.int64)
    for i, s in enumerate(seqs):
        out[i, : len(s)] = s
    return out


def _gold(line: str, spans: list[tuple[int, int, str]], toks: list[str]) -> np.ndarray:
    out, at = np.zeros(len(toks), np.int64), 0
    for i, t in enumerate(toks):
        start = at + len(t) - len(t.lstrip())
        at += len(t)
        for a, b, kind in spans:
            if start < b and at > a:
                out[i] = LABELS.index(kind)
    return out


class _Bags:
    """Bags of features: sums of their weights by bag, and back."""

    def __init__(self, bags: list[list[int]]):
        lens = np.array([len(x) for x in bags])
        self.bag_at = np.concatenate([[0], np.cumsum(lens)[:-1]])
        self.own, self.flat = np.unique(np.concatenate(bags), return_inverse=True)
        by_feature = np.argsort(self.flat, kind="stable")
        self.owner = np.repeat(np.arange(len(bags)), lens)[by_feature]
        self.feature_at = np.searchsorted(self.flat[by_feature], np.arange(len(self.own)))

    def sums(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(w[self.own][self.flat], self.bag_at, axis=0)

    def back(self, d: np.ndarray) -> np.ndarray:
        """By feature in ``own``."""
        return np.add.reduceat(d[self.owner], self.feature_at, axis=0)


class _Batch:
    """Lines of like length, with the tables that one step of training needs."""

    def __init__(self, seqs: list[np.ndarray], golds: list[np.ndarray], feats: list[list[int]], beside: np.ndarray, pad: int):
        wide = _padded(seqs, pad)
        self.y, self.n = _padded(golds, 0), np.array([len(s) for s in seqs])
        self.m, self.length = wide.shape
        self.live = np.arange(self.length)[None, :] < self.n[:, None]
        kinds, ids = np.unique(wide, return_inverse=True)
        pad_at = int(np.searchsorted(kinds, pad))
        self.wide = np.pad(ids.reshape(wide.shape), ((0, 0), (-OFFSETS[0], OFFSETS[-1])), constant_values=pad_at)
        self.n_kinds = len(kinds)
        self.here = _Bags([feats[k] for k in kinds])
        self.around = _Bags([[beside[f] for f in feats[k] if beside[f] >= 0] for k in kinds])
        self.gold = np.zeros((self.m, self.length, K), np.float32)
        np.put_along_axis(self.gold, self.y[:, :, None], 1, 2)
        self.gold *= self.live[:, :, None]
        self.gold_trans = np.zeros((K, K), np.float32)
        np.add.at(self.gold_trans, (self.y[:, :-1][self.live[:, 1:]], self.y[:, 1:][self.live[:, 1:]]), 1)

    def gradient(self, w: list[np.ndarray], trans: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Of the log-likelihood, by the weights of the batch's own features (here and around) and by the transitions (forward-backward, scaled)."""
        m, length, live = self.m, self.length, self.live
        em = self.here.sums(w[0])[self.wide[:, _PAD : _PAD + length]]
        table = self.around.sums(w[1])
        for i, off in enumerate(_AROUND):
            em += table[self.wide[:, _PAD + off : _PAD + off + length], i]
        e = np.exp(em - em.max(2, keepdims=True)) + np.float32(1e-30)
        t = np.exp(trans - trans.max())
        alpha, beta = np.empty_like(e), np.ones_like(e)
        alpha[:, 0] = e[:, 0]
        for i in range(1, length):
            step = (alpha[:, i - 1] @ t) * e[:, i]
            step /= step.sum(1, keepdims=True)
            alpha[:, i] = np.where(live[:, i, None], step, alpha[:, i - 1])
        d_trans = self.gold_trans.copy()
        for i in range(length - 2, -1, -1):
            on = live[:, i + 1, None]
            behind = e[:, i + 1] * beta[:, i + 1]
            step = behind @ t.T
            z = (alpha[:, i] * step).sum(1, keepdims=True)
            d_trans -= t * ((alpha[:, i] / z * on).T @ behind)
            beta[:, i] = np.where(on, step / step.sum(1, keepdims=True), 1)
        post = alpha * beta
        d_em = self.gold - post / post.sum(2, keepdims=True) * live[:, :, None]
        by_label = [np.ascontiguousarray(d_em[:, :, k]).ravel() for k in range(K)]
        kind_sums = lambda off: np.stack([np.bincount(self.wide[:, _PAD + off : _PAD + off + length].ravel(), x, self.n_kinds) for x in by_label], 1).astype(np.float32)
        return [self.here.back(kind_sums(0)), self.around.back(np.stack([kind_sums(off) for off in _AROUND], 1))], d_trans


def train(given: list[str], epochs: int = EPOCHS, rate: float = 0.15, decay: float = 2e-3, copies: int = COPIES, seed: int = 11, half: int | None = None, rows_half: int | None = None) -> Model:
    """Maximum likelihood over the whole labelled table, by AdaGrad in batches of lines of like length.

    ``half`` and ``rows_half`` train on a part of the table, see there.
    """
    names = frozenset(plain_letters(g).lower() for g in known_names(given))
    types = Types(None, names)
    seqs, golds = [], []
    for line, spans in labelled_lines(given, copies, seed, half, rows_half):
        toks = [_EDGE[t] if t in _EDGE else t for t in ("\n", *tokens(line), "\n")]
        seqs.append(types.encode(toks).astype(np.int64))
        golds.append(np.concatenate([[0], _gold(line, spans, toks[1:-1]), [0]]))
    n_feats = len(types.features)
    marked = np.array([f[0] == "~" for f in types.features])
    beside = np.where(marked, np.cumsum(marked) - 1, -1)
    rng = np.random.default_rng(seed)
    shuffled = rng.permutation(len(seqs))  # so that lines of one row do not all share a batch
    order = sorted(shuffled, key=lambda i: len(seqs[i]))
    batches = [_Batch([seqs[i] for i in part], [golds[i] for i in part], types.feats, beside, types.ids["\n"]) for part in (order[s : s + 500] for s in range(0, len(order), 500))]
    w = [np.zeros((n_feats, K), np.float32), np.zeros((int(marked.sum()), len(_AROUND), K), np.float32)]
    seen = [np.full_like(x, 1e-4) for x in w]
    trans, trans_seen = np.zeros((K, K), np.float32), np.full((K, K), 1e-4, np.float32)
    for _ in range(epochs):
        for bi in rng.permutation(len(batches)):
            batch = batches[bi]
            d_w, d_trans = batch.gradient(w, trans)
            for x, total, d, own in zip(w, seen, d_w, (batch.here.own, batch.around.own)):
                d = d / batch.m - decay * x[own] / len(batches)
                total[own] += d * d
                x[own] += rate * d / np.sqrt(total[own])
            d_trans = d_trans / batch.m
            trans_seen += d_trans * d_trans
            trans += rate * d_trans / np.sqrt(trans_seen)
    weights = np.zeros((n_feats, len(OFFSETS), K), np.float32)
    weights[:, OFFSETS.index(0)] = w[0]
    for i, off in enumerate(_AROUND):
        weights[marked, OFFSETS.index(off)] = w[1][:, i]
    return Model(types.features, weights, trans)


def viterbi(em: np.ndarray, starts: np.ndarray, lens: np.ndarray, trans: np.ndarray, n_tokens: int) -> np.ndarray:
    """Best labels of runs of tokens (``starts``, ``lens`` into ``em``), each between two O."""
    out = np.zeros(n_tokens, np.int8)
    order = np.argsort(lens, kind="stable")
    for s in range(0, len(order), 8192):
        part = order[s : s + 8192]
        a, n = starts[part], lens[part]
        length, m = int(n.max()), len(part)
        back = np.zeros((length, m, K), np.int8)
        score = em[a] + trans[0]
        final = np.where((n == 1)[:, None], score, 0)
        for t in range(1, length):
            live = np.flatnonzero(n > t)  # a suffix, as runs are sorted by length
            step = score[live][:, :, None] + trans
            back[t, live] = step.argmax(1)
            score[live] = step.max(1) + em[a[live] + t]
            ends = live[n[live] == t + 1]
            final[ends] = score[ends]
        y = (final + trans[:, 0]).argmax(1).astype(np.int8)
        for t in range(length - 1, -1, -1):
            live = n > t
            out[a[live] + t] = y[live]
            if t:
                y[live] = back[t, live, y[live]]
    return out


# An e-mail address as a whole, spelled out or not: its end is where the form ends, not where a token does.
_EMAIL = re.compile(
    r"[^\W_](?:[\w.+\-]*\w)?(?:@| ?[\[({<] ?(?:at|arroba) ?[\])}>] ?| (?:AT|at|arroba) )[^\W_](?:[\w\-]*[^\W_])?(?:(?:\.| ?[\[({<] ?(?:dot|punto|point|punkt) ?[\])}>] ?| (?:DOT|dot|punto|point|punkt) )[^\W_](?:[\w\-]*[^\W_])?)+", re.I
)
_ABBREVIATED = re.compile(r"\b(?:Rd|Ave|Ln|St|Dr|Ct|Blvd|Sq|Str)$", re.I)
_PARTICLES = {"de", "la", "del", "von", "van", "der", "den", "di", "da", "dos", "du", "le", "el", "al", "bin", "ter", "zu"}
_NAME_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
LEAST = {"N": 0.1, "A": 0.75}  #: log odds a token that a span of a kind needs at least


def _whole_words(text: str, a: int, b: int) -> tuple[int, int]:
    """The span with the rest of a word, or of words joined by hyphens, that it cuts through."""
    if a < b and text[a].isalnum():
        while a and (text[a - 1].isalnum() or a > 1 and text[a - 1] in "-'’" and text[a - 2].isalnum()):
            a -= 1 if text[a - 1].isalnum() else 2
    if a < b and text[b - 1].isalnum():
        while b < len(text) and (text[b].isalnum() or b + 1 < len(text) and text[b] in "-'’" and text[b + 1].isalnum()):
            b += 1 if text[b].isalnum() else 2
    return a, b


def check_span(text: str, a: int, b: int, kind: str) -> tuple[int, int] | None:
    """A decoded span, trimmed to whole words and without the marks around it; None if nothing of its kind is left.

    That is: an e-mail address without a host, numbers of fewer than five digits, an address without a number or a word, a name without two words.
    """
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    if kind == "E":
        line = max(text.rfind("\n", 0, a), text.rfind("\r", 0, a)) + 1
        for m in _EMAIL.finditer(text, line):
            if m.start() >= b:
                break
            if m.end() > a:
                return m.span()
        return None
    if kind in "PI":
        while a < b and not (text[a].isalnum() or kind == "P" and text[a] in "+("):
            a += 1
        if kind == "P":
            m = re.search(r"[+(]*\d", text[a:b])
            a += m.start() if m else 0
            if text[a:b].count("(") > text[a:b].count(")") and text[a] == "(":
                a += 1
        while b > a and not (text[b - 1].isdigit() if kind == "P" else text[b - 1].isalnum()):
            b -= 1
        if kind == "I":
            a, b = _whole_words(text, a, b)
        return (a, b) if sum(c.isdigit() for c in text[a:b]) >= 5 else None
    while b > a and not text[b - 1].isalnum():
        b -= 1
    while a < b and not text[a].isalnum():
        a += 1
    a, b = _whole_words(text, a, b)
    if kind == "A":
        if text[b : b + 1] == "." and _ABBREVIATED.search(text[a:b]):
            b += 1
        s = text[a:b]
        return (a, b) if any(c.isdigit() for c in s) and re.search(r"[^\W\d_]{2}", s) else None
    # Words in small letters at either end of a capitalised name are not part of it, nor are particles without a name behind.
    parts = [m.span() for m in _NAME_WORD.finditer(text, a, b)]
    real = [p for p in parts if text[p[0] : p[1]].lower() not in _PARTICLES and p[1] - p[0] > 1]
    upper = [p for p in real if text[p[0]].isupper()]
    keep = upper if len(upper) > 1 else real
    if len(keep) < 2 or len(upper) == 1:
        return None
    first = parts.index(keep[0])
    while first and text[slice(*parts[first - 1])].lower() in _PARTICLES:
        first -= 1
    return parts[first][0], keep[-1][1]


class Tagger:
    """Finds spans in whole texts."""

    def __init__(self, model: Model, given: list[str]):
        self.model = model
        self.types = Types(model, frozenset(plain_letters(g).lower() for g in known_names(given)))
        t = model.trans
        self.sure = float(-2 * (t.max() - t.min()))

    def label(self, toks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Labels of all tokens, and by how much the score of each label exceeds that of O."""
        edges = self.types.encode(["\n", "\r", "\r\n"])
        ids = self.types.encode(toks)
        edge = self.types.ids["\n"]
        ids[np.isin(ids, edges)] = edge
        table = self.types.scores()
        n = len(ids)
        em = table[ids, OFFSETS.index(0)]
        wide = np.concatenate([np.full(_PAD, edge, np.int32), ids, np.full(_PAD, edge, np.int32)])
        for o, off in enumerate(OFFSETS):
            if off:
                em += np.take(table[:, o], wide[_PAD + off : _PAD + off + n], axis=0)
        certain = (em[:, 1:].max(1) - em[:, 0] < self.sure) | (ids == edge)
        change = np.flatnonzero(np.diff(np.concatenate([[True], certain, [True]]).astype(np.int8)))
        starts, ends = change[::2], change[1::2]
        y = viterbi(em, starts, ends - starts, self.model.trans, n) if len(starts) else np.zeros(n, np.int8)
        return y, em[np.arange(n), y] - em[:, 0]

    def lead(self, y: np.ndarray, gain: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Log odds of each span, from token ``first`` to ``last`` of one label, against none in its place."""
        t, total, kind = self.model.trans, np.concatenate([[0], np.cumsum(gain, dtype=np.float64)]), y[first]
        before = np.where(first > 0, y[first - 1], 0)
        after = np.where(last + 1 < len(y), y[np.minimum(last + 1, len(y) - 1)], 0)
        steps = t[before, kind] - t[before, 0] + (last - first) * (t[kind, kind] - t[0, 0]) + t[kind, after] - t[0, after]
        return total[last + 1] - total[first] + steps

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """``(start, end, kind)`` of each text, in order and without overlap."""
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        begin = 0
        while begin < len(texts):
            end, size, toks, owner = begin, 0, [], []
            while end < len(texts) and (end == begin or size < _CHUNK_CHARS):
                if texts[end]:
                    mine = tokens(texts[end])
                    toks += mine
                    toks += ["\n"] * _PAD  # no feature is looked up in another text
                    owner.append((end, len(mine)))
                    size += len(texts[end])
                end += 1
            if toks:
                y, gain = self.label(toks)
                pos = np.concatenate([[0], np.cumsum(np.fromiter(map(len, toks), np.int64, len(toks)))])
                hot = np.flatnonzero(y)
                if len(hot):
                    cut = np.flatnonzero((np.diff(hot) != 1) | (np.diff(y[hot]) != 0)) + 1
                    first, last = hot[np.concatenate([[0], cut])], hot[np.concatenate([cut - 1, [len(hot) - 1]])]
                    tok_from = np.concatenate([[0], np.cumsum([n + _PAD for _, n in owner])])
                    which = np.searchsorted(tok_from, first, "right") - 1
                    lead = self.lead(y, gain, first, last) / (last - first + 1)
                    for i, j, d, sure in zip(first, last, which, lead):
                        doc = owner[d][0]
                        base = pos[tok_from[d]]
                        kind = LABELS[y[i]]
                        if kind == "N" and texts[doc][int(pos[j + 1] - base) :][:1] == "@":
                            kind = "E"  # a local part that reads like a name
                        if sure < LEAST.get(kind, 0):
                            continue
                        span = check_span(texts[doc], int(pos[i] - base), int(pos[j + 1] - base), kind)
                        if span and (not out[doc] or span[0] >= out[doc][-1][1]):
                            out[doc].append((*span, kind))
            begin = end
        return out


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for a, b, kind in spans:
        parts += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = b
    return "".join([*parts, text[at:]])


def _run(model: Model, given: list[str], replace: bool):
    found = pa.struct([("pii_kind", pa.string()), ("pii_text", pa.string())])
    schema = pa.schema([("doc_id", pa.int64()), ("redacted", pa.string()), ("found", pa.list_(found))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model, given)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [[], [], []]
            for i, text, spans in zip(ids, texts, tagger.spans(texts)):
                if not replace and not spans:
                    continue
                rows[0].append(i)
                rows[1].append(redact(text, spans) if replace and text is not None else None)
                rows[2].append([{"pii_kind": KINDS[k], "pii_text": text[a:b]} for a, b, k in spans])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, schema.types)], schema=schema)

    return run


@lru_cache(maxsize=4)
def _model(given: tuple[str, ...]) -> Model:
    return train(list(given))


def _tagged(docs: DataFrame, given_names: DataFrame, key: str, text: str, replace: bool) -> DataFrame:
    given = [r[0] for r in given_names.select("given_name").filter("given_name is not null").distinct().limit(_GAZETTEER_ROWS + 1).collect()]
    if len(given) > _GAZETTEER_ROWS:
        raise ValueError("the list of given names is too long to be sent to every executor")
    given = sorted(given)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if not replace:
        rows = rows.filter("doc_id is not null and text is not null")
    return spread(rows, "doc_id").mapInArrow(_run(_model(tuple(given)), given, replace), "doc_id long, redacted string, found array<struct<pii_kind string, pii_text string>>")


def tag_pii(docs: DataFrame, given_names: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, redacted, found``: every row, redacted, with the kinds and values found in the order of the text."""
    return _tagged(docs, given_names, key, text, True)


def restore_pii(tagged: DataFrame) -> DataFrame:
    """``doc_id, text``: what ``tag_pii`` has redacted, as it was (where no text held a placeholder of its own)."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                parts, at = [], 0
                for f in found or []:
                    mark = f"[{f['pii_kind'].upper()}]"
                    here = text.index(mark, at)
                    parts += [text[at:here], f["pii_text"]]
                    at = here + len(mark)
                out.append(None if text is None else "".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], schema=schema)

    return tagged.select("doc_id", "redacted", "found").mapInArrow(run, "doc_id long, text string")


def find_pii(docs: DataFrame, given_names: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, pii_kind, pii_text``: one row per distinct value in a document.

    ``given_names``: a reference list with a column ``given_name``, which need not be complete. Other columns are ignored.
    Null keys and texts give no rows. Empty tables give an empty result.
    """
    found = _tagged(docs, given_names, key, text, False)
    return found.select("doc_id", F.explode(F.array_distinct("found")).alias("f")).select("doc_id", "f.*").distinct()


def redact_pii(docs: DataFrame, given_names: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text``: every row, with a typed placeholder for each value found and the text otherwise unchanged; null stays null."""
    return _tagged(docs, given_names, key, text, True).select("doc_id", F.col("redacted").alias("text"))
