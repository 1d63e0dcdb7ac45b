"""Records that differ only in formatting: multiset fingerprints of normalised fields.

A record is a bag of (field name, normalised value) pairs. Each pair is hashed, the hashes are added up
(so the order of fields has no part in it, and repeated fields still count), and records are grouped by
the sum. Every member is then compared field by field with its group's first record, by
counting equal fields instead of sorting them; members that differ (a hash collision) form groups by
their exact text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPED = r"(?iUs)^\s*(lex|vec|hyde|intent)\s*:"
PER_SALT = 1_000_000  #: members of a group that meet its first record under one salt


def normalised(text: Column) -> Column:
    """Letters and digits only, without case; ``ß`` counts as ``ss``, and a final sigma as any other."""
    bare = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")
    return F.translate(F.replace(bare, F.lit("ß"), F.lit("ss")), "ς", "σ")


def query_fields(query: Column) -> Column:
    """The fields of a query: its typed lines if it is a query document, else one field ``query``."""
    lines = F.filter(F.split(query, r"\r\n|\r|\n"), lambda x: x.rlike(r"(?U)\S"))
    typed = (F.size(lines) >= 2) & F.forall(lines, lambda x: x.rlike(TYPED))
    as_lines = F.transform(
        lines,
        lambda x: F.struct(F.lower(F.regexp_extract(x, TYPED, 1)).alias("name"), normalised(F.regexp_replace(x, TYPED, "")).alias("value")),
    )
    # Most queries have one line, and need no look at lines.
    one = F.array(F.struct(F.lit("query").alias("name"), normalised(query).alias("value")))
    return F.when(query.rlike(r"[\r\n]"), F.when(typed, as_lines).otherwise(one)).otherwise(one)


def _fingerprint(fields: Column) -> Column:
    """Sums of the two halves of the field hashes: commutative, and far from overflow."""
    hashes = F.transform(fields, lambda x: F.xxhash64(x["name"], x["value"]))
    half = lambda f: F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: acc + f(h))
    low = half(lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    return F.struct(low.alias("lo"), half(lambda h: F.shiftrightunsigned(h, 32)).alias("hi"), F.size(fields).alias("n"))


def _same_fields(a: Column, b: Column) -> Column:
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return (F.size(a) == F.size(b)) & F.forall(a, lambda x: count(a, x) == count(b, x))


def formatting_copies(records: DataFrame, key: str, query: str, version: str, per_salt: int = PER_SALT) -> DataFrame:
    """``key, first_key, n_copies`` for each record: the least key of its group and the group's size.

    ``records`` needs a unique-after-delivery ``key``, a text column ``query`` and a column ``version`` to order
    deliveries; of rows with the same key the latest counts. Other columns are ignored.
    Null keys are left out; a null query is a copy of nothing; queries without any letter or digit are
    copies of each other. An empty table gives an empty result.
    """
    rows = records.select(F.col(key).alias("key"), F.col(query).alias("q"), F.col(version).alias("v")).filter("key is not null")
    rows = rows.groupBy("key").agg(F.max(F.struct("v", "q")).alias("x")).select("key", F.col("x.q").alias("q"))
    known = rows.filter("q is not null").select("key", query_fields(F.col("q")).alias("fields"))
    known = known.select("key", "fields", _fingerprint(F.col("fields")).alias("fp"))
    groups = known.groupBy("fp").agg(F.min(F.struct("key", "fields")).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    # A large group's row is repeated for as many salts as its size asks for, and its members are spread over them; others have one.
    # What is broadcast is one row of 30 bytes a large group, so at most one for every million records: 30 MB at 10 ** 12.
    salts = F.ceil(F.col("c") / per_salt).cast("int")
    large = F.broadcast(groups.filter(F.col("c") > per_salt).select("fp", salts.alias("salts")))
    salted = groups.select("fp", "first", "c", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    spread_out = known.join(large, "fp", "left").withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("key"), F.col("salts"))).cast("int")).drop("salts")
    every = spread_out.join(salted, ["fp", "salt"], "left")
    member = every.filter("c is not null")
    judged = member.withColumn("same", _same_fields(F.col("fields"), F.col("first.fields")))
    odd = judged.filter("not same").select("key", F.concat_ws("\n", F.array_sort(F.transform("fields", lambda x: F.concat_ws(":", x["name"], x["value"])))).alias("exact"))
    odd_groups = odd.groupBy("exact").agg(F.min("key").alias("first_key"), F.count(F.lit(1)).alias("n_copies"))
    lost = judged.filter("not same").groupBy("fp").agg(F.count(F.lit(1)).alias("lost"))
    plain = judged.filter("same").join(lost, "fp", "left")
    return (
        plain.select("key", F.col("first.key").alias("first_key"), (F.col("c") - F.coalesce("lost", F.lit(0))).alias("n_copies"))
        .unionByName(every.filter("c is null").select("key", F.col("key").alias("first_key"), F.lit(1).cast("long").alias("n_copies")))
        .unionByName(odd.join(odd_groups, "exact").select("key", "first_key", "n_copies"))
        .unionByName(rows.filter("q is null").select("key", F.col("key").alias("first_key"), F.lit(1).cast("long").alias("n_copies")))
    )
