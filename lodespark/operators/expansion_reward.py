"""A rubric for query expansions, as column expressions: format, diversity, hyde, quality, entities; at most half for an echoed query.

The points add up to 120, or 140 with a hyde text. All list lengths are those of one example, so that pairs within an example stay few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that are no key terms, verbs that open queries, empty phrases, filler.
NO_KEY = (
    "what is how to the a an in on for of and or with my your do does can i me we who where when why which find get show tell about from into between through during after before like than then that this "
    "their its was were has had been being have not but just also very so if at by up out all some any no each every both few more most other only same such here there asked said notes meeting email "
    "discussion conversation call"
).split()
OPENING = (
    "configure setup install build create make run start stop check test debug fix update change add remove delete use using need want should would could help please best good new old latest recent setting "
    "settings compare comparing implement implementing deploy deploying migrate migrating optimize optimizing understand understanding explain list describe define convert connecting performance overview "
    "introduction tutorial example difference between about review resolve resolving troubleshoot troubleshooting monitor monitoring manage managing enable disable set write read search possible common typical "
    "recommended alternative"
).split()
GENERIC = ("find information about", "search for", "look up", "get information", "learn about", "information on", "details about", "find out about", "what is", "how to", "guide to", "help with")
FILLER = ("overview", "basics")
FREQUENT = "the a an is are to for of in and or it this that be with as on by".split()

RATINGS = ((80, "Excellent"), (60, "Good"), (40, "Acceptable"), (20, "Poor"))


def _split(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def _low(text: Column) -> Column:
    return F.lower(F.trim(text))


def key_terms(query: Column) -> Column:
    return F.array_except(_split(F.lower(query)), F.array(*[F.lit(w) for w in NO_KEY]))


def entities(query: Column) -> Column:
    """Acronyms, capitalised words (the first one only if it is no usual opening), words with technical marks, and the word behind each of them."""
    clean = F.transform(_split(query), lambda w: F.regexp_replace(w, "^[.,!?:;()\\[\\]\"']+|[.,!?:;()\\[\\]\"']+$", ""))

    def base(w: Column, i: Column) -> Column:
        low = F.lower(w)
        acronym = (F.length(w) >= 2) & w.rlike(r"\p{Lu}") & ~w.rlike(r"\p{Ll}")
        proper = w.rlike(r"^\p{Lu}") & ~low.isin(NO_KEY) & ((i > 0) | ~low.isin(OPENING))
        technical = ~(w.rlike(r"^\p{Lu}") & ~low.isin(NO_KEY)) & (F.length(w) >= 2) & w.rlike(r"[.+\-#@]")
        camel = w.rlike(r"^\p{Lu}.*\p{Lu}") & (F.length(w) > 1)
        return acronym | proper | technical | camel

    marked = F.transform(clean, lambda w, i: F.struct(F.lower(w).alias("w"), base(w, i).alias("b")))

    def chosen(x: Column, i: Column) -> Column:
        behind = (i > 0) & F.coalesce(F.get(marked, i - 1)["b"], F.lit(False)) & ~x["w"].isin(NO_KEY)
        return (x["w"] != "") & (x["b"] | behind)

    return F.array_distinct(F.transform(F.filter(marked, chosen), lambda x: x["w"]))


def _echo(item: Column, query: Column) -> Column:
    e, q = _low(item), _low(query)
    return (e == q) | (F.contains(e, q) & (F.length(e) < F.length(q) + 10))


def _alike(a: Column, b: Column, least: Column) -> Column:
    x, y = _low(a), _low(b)
    wx, wy = F.array_distinct(_split(x)), F.array_distinct(_split(y))
    unlike = F.size(F.array_except(wx, wy)) + F.size(F.array_except(wy, wx))
    return F.contains(x, y) | F.contains(y, x) | (unlike < least)


def _pairs_alike(items: Column, least: Column) -> Column:
    per = F.transform(items, lambda a, i: F.size(F.filter(F.slice(items, i + 2, F.greatest(F.size(items), F.lit(1))), lambda b: _alike(a, b, least))))
    return F.aggregate(per, F.lit(0), lambda acc, n: acc + n)


def _count(items: Column, ok) -> Column:
    return F.size(F.filter(items, ok))


def _generic(item: Column) -> Column:
    """Nothing but an empty phrase is left of it."""
    out = F.lit(False)
    for phrase in GENERIC:
        words = phrase.split()
        rest = _low(item)
        for w in words:
            rest = F.trim(F.regexp_replace(rest, f"^(.*?){w}", "$1"))
        out = out | ((F.contains(_low(item), F.lit(phrase)) | _low(item).startswith(words[0])) & (F.length(rest) < 3))
    return out


def _repetition(text: Column) -> Column:
    """Two points for each time beyond the second that a word of three letters or more is said."""
    found = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: (F.length(w) > 2) & ~w.isin(FREQUENT))
    return F.aggregate(F.array_distinct(found), F.lit(0), lambda acc, w: acc + F.greatest(F.size(F.filter(found, lambda x: x == w)) - 2, F.lit(0)) * 2)


def rewards(examples: DataFrame) -> DataFrame:
    """``example_id, format, diversity, hyde, quality, entity, percentage, rating`` for ``example_id, query, output`` (an array of type and text).

    Null and blank items are left out; an example without a query or any item fails with 0.
    """
    trim = lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
    of = lambda k: F.filter(F.transform(F.filter(F.coalesce("output", F.array().cast("array<struct<type:string,text:string>>")), lambda x: x["type"] == k), lambda x: trim(x["text"])), lambda t: t != "")
    rows = examples.select("example_id", "query", of("lex").alias("lex"), of("vec").alias("vec"), of("hyde").alias("hyd"))
    rows = rows.withColumn("ents", entities(F.coalesce("query", F.lit("")))).withColumn("keys", key_terms(F.coalesce("query", F.lit(""))))
    q, lex, vec, hyd, ents = F.col("query"), F.col("lex"), F.col("vec"), F.col("hyd"), F.col("ents")
    nl, nv = F.size(lex), F.size(vec)
    pts = lambda cond, n: F.when(cond, n).otherwise(0)
    least = F.when(F.size(_split(q)) >= 5, 3).otherwise(2)
    fmt = F.lit(10) + pts(nl > 0, 10) + pts(nv > 0, 10)
    lex_echo = _count(lex, lambda x: _echo(x, q))
    echo = F.lit(5) - lex_echo * 10 - _count(vec, lambda x: _echo(x, q)) * 3
    diversity = pts((nl > 0) & (nv > 0), 10) + pts(nl + nv >= 2, 5) + F.greatest(F.lit(0), 5 - 2 * _pairs_alike(lex, least)) + F.greatest(F.lit(0), 5 - 2 * _pairs_alike(vec, least)) + F.greatest(F.lit(-10), echo)
    first = F.get(hyd, F.lit(0))
    n = F.length(first)
    hyde = F.when(first.isNull(), 0).otherwise(5 + F.when((n >= 50) & (n <= 200), 5).when(n < 50, 2).otherwise(0) + pts(~F.contains(first, F.lit("\n")), 5) + F.greatest(F.lit(0), 5 - _repetition(first)))
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + F.length(x)) / F.size(xs)
    keyed = _count(lex, lambda x: (F.size("keys") == 0) | F.arrays_overlap(F.col("keys"), _split(F.lower(x))))
    natural = _count(vec, lambda x: F.contains(x, F.lit(" ")) & (F.length(x) > 15))
    words = _split(F.lower(q))
    filler = _count(lex, lambda x: F.exists(_split(F.lower(x)), lambda w: w.isin(*FILLER) & ~F.array_contains(words, w)))
    quality = (
        F.lit(5) + pts((nl > 0) & (nv > 0) & (mean(lex) <= mean(vec)), 5) + F.when(nv == 0, 0).when(natural == nv, 5).otherwise(2) + F.when(nl == 0, 0).when(keyed == nl, 5).when(keyed > 0, 2).otherwise(0)
        - filler * 3 + pts((F.size(words) >= 2) & F.exists(lex, lambda x: F.contains(x, F.lit('"'))), 3)
    )
    named = lambda x: F.exists(ents, lambda e: F.contains(F.lower(x), e))
    with_names = _count(lex, named)
    said = F.lower(F.array_join(F.concat(lex, vec), " "))
    dropped = _count(ents, lambda e: ~F.contains(said, e))
    some = F.when(with_names == nl, 15).when(with_names > 0, 5).otherwise(-30) - dropped * 20 - _count(lex, _generic) * 15 + pts(F.exists(vec, named), 5)
    entity = F.when(F.size(ents) == 0, 10).when(nl > 0, some).otherwise(0)
    rows = rows.select("example_id", fmt.alias("format"), diversity.alias("diversity"), hyde.alias("hyde"), quality.alias("quality"), entity.alias("entity"), lex_echo.alias("echoes"), (F.size(hyd) > 0).alias("has_hyde"), (q.isNull() | ((nl + nv + F.size(hyd)) == 0)).alias("failed"))
    total = F.col("format") + F.col("diversity") + F.col("hyde") + F.col("quality") + F.col("entity") + 20
    raw = F.least(F.lit(100.0), F.greatest(F.lit(0.0), total / F.when(F.col("has_hyde"), 140).otherwise(120) * 100))
    capped = F.when(F.col("failed"), 0.0).when(F.col("echoes") > 0, F.least(raw, F.lit(50.0))).otherwise(raw)
    rating = F.lit("Failed")
    for bound, name in reversed(RATINGS):
        rating = F.when(F.col("percentage") >= bound, name).otherwise(rating)
    parts = [F.when(F.col("failed"), 0).otherwise(F.col(c)).alias(c) for c in ("format", "diversity", "hyde", "quality")]
    out = rows.select("example_id", *parts, F.when(F.col("failed"), 0).otherwise(F.greatest(F.lit(0), F.col("entity"))).alias("entity"), capped.alias("percentage"))
    return out.withColumn("rating", rating).withColumn("percentage", F.round("percentage", 1))
