"""Near-duplicate documents: Order MinHash, then verification by banded alignment.

Each of ``entries`` hash functions picks the three k-mers (shingles of words) of least hash and keeps the order in which the text has them.
A sketch entry is the key of what was picked, and the order. Two documents are candidates if two entries agree in their keys,
or one does and the signatures (two bits of each of 31 minima) are alike. Where the order agrees in an entry too, the pair is
verified by a banded alignment of the words: an edit touches at most three shingles of either text, so a short distance proves the similarity.
Where no order agrees, or the distance proves nothing, the sets of shingles are compared exactly.

Order MinHash alone, with k-mers labelled by their occurrence and the order in the key, can't give the result that is asked for, a
similarity of sets: turned-round lines change the order and repeated passages add labelled k-mers, while the sets stay as they are. So
the order is kept beside the key, not in it, and a document that repeats a k-mer has entries of both kinds: of its labelled k-mers, and of those
with the first label alone. Documents without repeats have one kind, as both are the same.

At a set similarity of 0.70 the three least k-mers of two texts agree with a probability of about 0.7 ** 3 = 0.34, so of 40
entries none does with 5e-8, and just one with 1e-6; above 0.70 both fall quickly. This is the only loss: the method is not exact. Strangers
that share a tenth of their shingles agree in an entry with 0.001, so candidates stay in proportion to true pairs.

Skew: documents of the same words are collapsed to one representative before anything is paired
(a partial aggregate). Keys held by more than ``hot_key`` documents are joined whole too, as pairs of
blocks of about ``hot_key`` documents each: that loses no pair, and no key has to pass through one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodespark.functions.text import WordHashes, hashed_words, inside, mix, shingles
from lodespark.session import cut_lineage, spread

_FILTER_BITS = 25
_GROUPS = 31  #: minima that the signature has two bits of
_MINIMA = 3  #: k-mers in an entry
_ORDER = np.uint64(7)  #: bits of a packed entry that tell the order, the others are its key
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_BLOCK = 1 << 16  #: shingles that go through all functions at a time, so that they stay in the cache


def _seeds(n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    r = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) + np.uint64(salt * 1_000_003))
    return r[:n], r[n:] | np.uint64(1)


def _least(x: np.ndarray, counts: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, entries) packed entries, and a signature of two bits of each of the first ``_GROUPS`` minima.

    ``x`` holds the different k-mers of each document in text order, ``counts`` (at least 1 each) how many there are.
    """
    n_docs = len(counts)
    out, signature = np.zeros((n_docs, entries), np.uint64), np.zeros(n_docs, np.uint64)
    ends = np.cumsum(counts)
    starts = ends - counts
    xor, mul = _seeds(entries, 1)
    first = 0
    while first < n_docs:  # whole documents, as many as make up a block, at least one
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + _BLOCK, "right")))
        part, begin, many = x[starts[first] : ends[last - 1]], starts[first:last] - starts[first], counts[first:last]
        rows, owner = slice(first, last), np.repeat(np.arange(last - first), many)
        h, shifted, place = np.empty_like(part), np.empty_like(part), np.zeros((_MINIMA, last - first), np.int64)
        for f in range(entries):
            np.bitwise_xor(part, xor[f], out=h)
            np.multiply(h, mul[f], out=h)
            np.right_shift(h, np.uint64(31), out=shifted)
            np.bitwise_xor(h, shifted, out=h)
            key = np.full(last - first, f + 1, np.uint64)
            for j in range(_MINIMA):
                low = np.minimum.reduceat(h, begin)
                at = np.flatnonzero(h == low[owner])
                place[j, owner[at[::-1]]] = at[::-1]  # the first of equal ones
                key = mix(key + mix(low))
                if j == 0 and f < _GROUPS:
                    signature[rows] |= (mix(low) & np.uint64(3)) << np.uint64(2 * f)
                if j + 1 < _MINIMA:
                    h[at] = _NONE
            order = (place[0] < place[1]).astype(np.uint64) | (place[1] < place[2]).astype(np.uint64) << np.uint64(1) | (place[0] < place[2]).astype(np.uint64) << np.uint64(2)
            out[rows, f] = (key & ~_ORDER) | order
        first = last
    return out, signature


def order_min_hashes(flat: np.ndarray, offsets: np.ndarray, shingle: int, entries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each document its packed entries end to end, how many it has, its signature, and its number of different shingles.

    A document of fewer words than a shingle has none of it.
    """
    n_docs = len(offsets) - 1
    n_entries, signature, distinct = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.uint64), np.zeros(n_docs, np.int32)
    at, doc = inside(offsets, shingle)
    if not len(at):
        return np.zeros(0, np.uint64), n_entries, signature, distinct
    x = shingles(flat, shingle)[at]
    # The occurrence of each k-mer within its document: its number among equal ones.
    own = mix(x + mix(doc.astype(np.uint64) + np.uint64(5)))
    order = np.argsort(own, kind="stable")
    group = np.flatnonzero(np.concatenate([[True], own[order][1:] != own[order][:-1]]))
    occurrence = np.empty(len(x), np.int64)
    occurrence[order] = np.arange(len(x)) - np.repeat(group, np.diff(np.append(group, len(x))))
    once = occurrence == 0
    distinct = np.bincount(doc[once], minlength=n_docs).astype(np.int32)
    have = np.flatnonzero(distinct)
    of_sets, signature[have] = _least(x[once], distinct[have].astype(np.int64), entries)
    keep = np.ones(of_sets.shape, bool)
    repeats = np.bincount(doc[~once], minlength=n_docs) > 0
    labelled, new = np.zeros((0, entries), np.uint64), np.zeros((0, entries), bool)
    if repeats.any():
        mine = repeats[doc]
        label = occurrence[mine].astype(np.uint64)
        marked = np.where(label > 0, mix(x[mine] + mix(label)), x[mine])
        labelled, _ = _least(marked, np.bincount(doc[mine], minlength=n_docs)[repeats], entries)
        new = labelled != of_sets[repeats[have]]
    packed = np.concatenate([of_sets[keep], labelled[new]])
    whose = np.concatenate([np.repeat(have, entries), np.repeat(np.flatnonzero(repeats), entries)[new.ravel()]])
    return packed[np.argsort(whose, kind="stable")], np.bincount(whose, minlength=n_docs), signature, distinct


def _whole(flat: np.ndarray, offsets: np.ndarray, salt: int) -> np.ndarray:
    """Hash of each document's whole word sequence."""
    pos = np.arange(len(flat)) - np.repeat(offsets[:-1], np.diff(offsets))
    h = mix(flat + mix(pos.astype(np.uint64) + np.uint64(salt)))
    total = np.concatenate([[np.uint64(0)], np.cumsum(h, dtype=np.uint64)])
    return mix(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(np.uint64))


def _sketch(entries: int, shingle: int):
    fields = [("id", pa.int64()), ("key", pa.string()), ("w1", pa.int64()), ("w2", pa.int64()), ("n", pa.int32()), ("entries", pa.list_(pa.int64())), ("sig", pa.int64())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, off = hashed_words(batch.column(1).to_pylist(), cache)
            packed, many, sig, n = order_min_hashes(flat, off, shingle, entries)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(_whole(flat, off, 11).view(np.int64)),
                    pa.array(_whole(flat, off, 12).view(np.int64)),
                    pa.array(n),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), pa.array(packed.view(np.int64))),
                    pa.array(sig.view(np.int64)),
                ],
                schema=schema,
            )

    return run


def banded_edit_distance(pairs: list[tuple[np.ndarray, np.ndarray]], band: int) -> np.ndarray:
    """Unit-cost word edit distance of each pair within ``band`` diagonals beside the main one.

    All pairs of a call go through one dynamic programme, row by row over the band. A path that would
    leave the band isn't found, so the result is an upper bound of the true distance.
    """
    if not pairs:
        return np.zeros(0, np.int32)
    m = len(pairs)
    la = np.array([len(a) for a, _ in pairs])
    lb = np.array([len(b) for _, b in pairs])
    width, big = 2 * band + 1, np.int32(1 << 28)
    A = np.zeros((m, la.max() + 1), np.uint64)
    B = np.zeros((m, max(lb.max(), la.max()) + width + 1), np.uint64)
    for i, (a, b) in enumerate(pairs):
        A[i, : len(a)] = a
        B[i, band + 1 : band + 1 + len(b)] = b  # B[i, band + j] is word j of b, from 1 on
    lane = np.arange(width, dtype=np.int32)
    row = np.where(lane[None, :] >= band, lane[None, :] - band, big).astype(np.int32).repeat(m, 0)
    row = np.where(lane[None, :] - band <= lb[:, None], row, big)
    out = np.full(m, big, np.int32)
    end = lb - la + band
    ok = (end >= 0) & (end < width)
    done = ok & (la == 0)
    out[done] = row[done, end[done]]
    for i in range(1, la.max() + 1):
        j = i - band + lane  # column of each lane
        step = row + (A[:, i - 1 : i] != B[:, i : i + width])
        step[:, :-1] = np.minimum(step[:, :-1], row[:, 1:] + 1)
        step = np.where((j[None, :] < 0) | (j[None, :] > lb[:, None]), big, step)
        at0 = band - i
        if 0 <= at0 < width:
            step[:, at0] = i
        row = np.minimum.accumulate(step - lane, axis=1) + lane
        row = np.where((j[None, :] < 0) | (j[None, :] > lb[:, None]), big, row).astype(np.int32)
        done = ok & (la == i)
        out[done] = row[done, end[done]]
    return np.minimum(out, np.maximum(la, lb)).astype(np.int32)


def _verify(similarity: float, shingle: int, band: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("edit_similarity", pa.float64()), ("jaccard", pa.float64())])

    def sets(texts: list[str], cache: WordHashes) -> tuple[list[np.ndarray], list[np.ndarray]]:
        flat, off = hashed_words(texts, cache)
        seqs = [flat[off[i] : off[i + 1]] for i in range(len(texts))]
        return seqs, [np.unique(shingles(s, shingle)) for s in seqs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            if not batch.num_rows:
                continue
            ta, tb = batch.column(2).dictionary_encode(), batch.column(3).dictionary_encode()
            qa, sa = sets(ta.dictionary.to_pylist(), cache)
            qb, sb = sets(tb.dictionary.to_pylist(), cache)
            xa, xb = ta.indices.to_numpy(), tb.indices.to_numpy()
            m = batch.num_rows
            edits, jac = np.zeros(m, np.int64), np.full(m, np.nan)
            # Without a common order an alignment within the band proves nothing.
            aligned = batch.column(4).to_numpy(zero_copy_only=False)
            edits[~aligned] = [max(len(qa[xa[r]]), len(qb[xb[r]])) for r in np.flatnonzero(~aligned)]
            order = sorted(np.flatnonzero(aligned), key=lambda r: len(qa[xa[r]]))
            for s in range(0, len(order), 256):
                part = order[s : s + 256]
                edits[part] = banded_edit_distance([(qa[xa[r]], qb[xb[r]]) for r in part], band)
            na, nb = np.array([len(sa[i]) for i in xa]), np.array([len(sb[j]) for j in xb])
            # An edit of a word touches at most `shingle` shingles of either text.
            lost = shingle * edits
            proven = np.maximum((na - lost) / (nb + lost), (nb - lost) / (na + lost)) >= similarity
            for r in np.flatnonzero(~proven & (na > 0) & (nb > 0)):
                both = len(np.intersect1d(sa[xa[r]], sb[xb[r]], assume_unique=True))
                jac[r] = both / (na[r] + nb[r] - both)
            keep = np.flatnonzero(proven | (jac >= similarity - 1e-12))
            longest = np.array([max(len(qa[xa[r]]), len(qb[xb[r]]), 1) for r in keep])
            edit = np.where(aligned[keep], 1 - edits[keep] / longest, np.nan) if len(keep) else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), pa.array(edit, from_pandas=True), pa.array(jac[keep], from_pandas=True)], schema=schema
            )

    return run


def _blocks(hot: DataFrame, size: int) -> DataFrame:
    """``(k, o, id, n, side)`` of hot keys ``(k, o, id, n, c)``, with a key for each pair of blocks of about ``size`` ids.

    Two ids of a key meet exactly once: on ``side`` 0 if they are of the same block, else on the sides 1 and 2 of their blocks' pair.
    """
    blocks = F.ceil(F.col("c") / size).cast("int")
    own = hot.select("k", "o", "id", "n", blocks.alias("blocks"), F.pmod(F.xxhash64(F.lit(9), "id"), blocks).cast("int").alias("block"))
    meets = own.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    return meets.select(F.xxhash64("k", F.least("block", "other"), F.greatest("block", "other")).alias("k"), "o", "id", "n", side.alias("side"))


def candidate_pairs(classes: DataFrame, similarity: float, hot_key: int, groups: int) -> DataFrame:
    """Pairs ``(a, b, ordered)`` of class representatives that sizes allow, with two keys in common, or one and like signatures; ``ordered`` if an entry agrees in its order, too.

    Texts of a set similarity of 0.70 agree in about three quarters of the signature's groups, strangers in little more than a quarter; 45 % are asked for.
    """
    entry = classes.select(F.explode("s.entries").alias("e"), "s.id", "s.n")
    keyed = entry.select(F.shiftright("e", 3).alias("k"), F.col("e").bitwiseAND(F.lit(7).cast("long")).cast("byte").alias("o"), "id", "n")
    # Counted by a partial aggregate and joined back: no key has to pass through one task.
    busy = keyed.join(keyed.groupBy("k").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "k")
    cold = busy.filter(F.col("c") <= hot_key).select("k", "o", "id", "n", F.lit(0).alias("side"))
    keys = cold.unionByName(_blocks(busy.filter(F.col("c") > hot_key), hot_key))
    a, b = keys.alias("a"), keys.alias("b")
    near = (F.col("a.id") < F.col("b.id")) & (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * (similarity - 1e-9))
    near &= (F.col("a.side") == 0) | (F.col("a.side") != F.col("b.side"))
    pairs = a.join(b, (F.col("a.k") == F.col("b.k")) & near).groupBy(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    pairs = pairs.agg(F.count(F.lit(1)).alias("n"), F.max(F.col("a.o") == F.col("b.o")).alias("ordered"))
    sig = classes.select("s.id", "s.sig")
    for x in "ab":
        pairs = pairs.join(sig.select(F.col("id").alias(x), F.col("sig").alias(f"sig_{x}")), x)
    differ = F.col("sig_a").bitwiseXOR(F.col("sig_b"))
    unlike = F.bit_count(differ.bitwiseOR(F.shiftrightunsigned(differ, 1)).bitwiseAND(F.lit(0x1555555555555555).cast("long")))
    like = (F.col("sig_a") == 0) | (F.col("sig_b") == 0) | (groups - unlike >= 0.45 * groups)
    return pairs.filter((F.col("n") > 1) | like).select("a", "b", "ordered")


def _slot(id_: Column) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(1 << _FILTER_BITS)) + 1


def _probably_in(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``id`` is not among ``wanted(id)``; none that is gets lost.

    A Bloom filter of one hash, as bitmaps of 32,768 bits: 1,024 rows of 4 KB at most, whatever the data, so it can be broadcast. It
    spares texts that are in no pair the shuffle; where more ids are wanted than it has bits for, it lets more through.
    """
    slot = _slot(F.col("id"))
    bitmaps = wanted.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bitmap"))
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("bitmap", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.floor(byte / F.pow(F.lit(2), at % 8)) % 2
    joined = rows.withColumn("bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(bitmaps), "bucket")
    return joined.filter(bit == 1).select(*rows.columns)


def near_duplicate_links(
    docs: DataFrame,
    key: str,
    text: str,
    similarity: float = 0.70,
    shingle: int = 3,
    entries: int = 40,
    hot_key: int = 64,
    band: int = 32,
) -> tuple[DataFrame, DataFrame]:
    """Members and links of near-duplicate documents.

    ``docs`` needs a string column ``key`` and a string column ``text``; other columns are ignored.
    Returns ``members(key, class_id)``, where documents of the same words share a class, and
    ``links(class_a, class_b, edit_similarity, jaccard)`` between classes, each link once, with
    ``class_a < class_b``. ``jaccard`` is null where the alignment alone has proven the similarity, ``edit_similarity`` where the
    sketches have no common order, so that there was nothing to align.

    Rows with a null key or text are left out; texts of fewer than ``shingle`` words are in no class.
    A key that comes twice counts once (its rows are taken to have the same text). An empty
    table gives empty results.
    """
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(key)).alias("id"), F.col(text).alias("text")).filter("key is not null and text is not null")
    run = _sketch(entries, shingle)
    out = "id long, key string, w1 long, w2 long, n int, entries array<long>, sig long"
    sketch = cut_lineage(spread(rows.select("id", "text", "key"), "id").mapInArrow(run, out).filter("n > 0"))
    classes = sketch.groupBy("w1", "w2").agg(F.min(F.struct("id", "n", "entries", "sig")).alias("s"))
    members = sketch.join(classes.select("w1", "w2", F.col("s.id").alias("class_id")), ["w1", "w2"]).select("key", "class_id").distinct()

    pairs = cut_lineage(candidate_pairs(classes, similarity, hot_key, min(entries, _GROUPS)))

    # The smaller side first: each pair carries one text, the other comes in by the last join.
    texts = _probably_in(rows.select("id", "text"), pairs.select(F.explode(F.array("a", "b")).alias("id")))
    left = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = left.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    links = both.select("a", "b", "text_a", "text_b", "ordered").mapInArrow(
        _verify(similarity, shingle, band), "class_a long, class_b long, edit_similarity double, jaccard double"
    )
    return members, links.dropDuplicates(["class_a", "class_b"])


def near_duplicate_pairs(docs: DataFrame, key: str, text: str, **options) -> DataFrame:
    """All pairs ``(key_a, key_b)`` of different keys, ``key_a < key_b``, that reach the similarity.

    Links between classes are spread over their members, and members of one class pair with each other.
    """
    members, links = near_duplicate_links(docs, key, text, **options)
    members = cut_lineage(members)
    ma, mb = (members.select(F.col("key").alias(f"key_{x}"), F.col("class_id").alias(f"class_{x}")) for x in "ab")
    across = links.join(ma, "class_a").join(mb, "class_b").select("key_a", "key_b")
    within = ma.join(mb, (F.col("class_a") == F.col("class_b")) & (F.col("key_a") < F.col("key_b"))).select("key_a", "key_b")
    return across.select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b")).unionByName(within)


def connected_components(nodes: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``(node, component)`` over ``nodes(node)`` and undirected ``edges(a, b)``; the component is its least node.

    Alternates large-star and small-star steps on a distributed edge table, which end after about the
    logarithm of the longest path; lineage is cut in every round. Nothing but two counters comes to the driver.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    e = cut_lineage(e)
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        e = cut_lineage(small.filter("u != v").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return nodes.join(e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")), "node", "left").select("node", F.coalesce("v", "node").alias("component"))


def near_duplicate_groups(docs: DataFrame, key: str, text: str, **options) -> DataFrame:
    """One row per document of at least a shingle: ``key, class_id, group_id, n_links, best_edit_similarity``.

    ``n_links`` counts other classes that the document's class is linked to.
    """
    members, links = near_duplicate_links(docs, key, text, **options)
    members, links = cut_lineage(members), cut_lineage(links)
    ends = links.select(F.explode(F.array("class_a", "class_b")).alias("class_id"), "edit_similarity")
    degree = ends.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"), F.round(F.max("edit_similarity"), 6).alias("best_edit_similarity"))
    nodes = members.select(F.col("class_id").alias("node")).distinct()
    comp = connected_components(nodes, links.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")))
    per_class = comp.select(F.col("node").alias("class_id"), F.col("component").alias("group_id")).join(degree, "class_id", "left")
    return members.join(per_class, "class_id").select(
        "key", "class_id", "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "best_edit_similarity"
    )
