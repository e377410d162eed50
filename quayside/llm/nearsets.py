"""Near-duplicates by exact Jaccard similarity of sets: two texts are alike if LEAST of the union of their sets is shared.

The sets are those of five-word shingles unless another function makes them. With a distance, as in one_of_each, SimHash
names the pairs: fingerprints of the sets, blocks, verified Hamming distance, forests (simhash.links); these pairs are
compared in full and joined to components. Sets that are alike can have fingerprints further apart, so keys of members,
which follow, find what this leaves apart, and pairs within a component aren't met again. Without a distance keys do all.

Of two sets that are alike, the first
n - ceil(LEAST n) + 1 members of each in any common order share one. So each set gets a key for each of these, and pairs
that share a key and pass the bounds on sizes and places are compared in full. The order puts members that are common in a
sample of the documents last (a passage of many texts makes no key then) and goes by hash otherwise; the result doesn't
depend on it. By size, a key is also cut into partitions of set lengths, of which a set is in its own and the one below:
sets further apart can't be alike. Before that, a pair's parities (2,048 bits a set) must leave room for what they would
share. Equal sets meet once.

Members of a key with over DENSE sets are first compared with one of them, the set with the least before the key;
after that only pairs that no links connect yet are. A set is its hashes of 64 bits; no link is guessed.

Words are those of simhash: ASCII case and spaces. A text of under five words is one shingle; null, empty and blank
texts are all alike, as empty sets are. Nulls, ties, repeated rows and the row that stays are as in one_of_each. A task
holds one text's set at a time and the pairs of one key; an empty table gives an empty result. Columns of docs other than
doc_id and text are passed through, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm import simhash
from quayside.llm.common import Stored, free_shuffles, mapped, order_id, store
from quayside.llm.components import components

WIDTH, SEED = 5, 42
#: The least similarity, as a fraction, so that bounds are whole numbers.
LEAST = (4, 5)
#: Bits in which the fingerprints of pairs to compare differ at most, in one_of_each.
DISTANCE = 10
#: Sets of one key that are compared in pairs at once.
DENSE = 32
#: One document in SAMPLE is looked at for common shingles; those seen COMMON times or more are ordered last, MOST of them at most.
SAMPLE, COMMON, MOST = 16, 8, 100_000
#: Ids that are broadcast at most to pick the documents to compare.
_PICKED = 500_000
#: Bits of a set's parities.
PARITIES = 2048
_STEP = 1 << 15
_PAIRS = 1 << 18


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of the text's word shingles."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    total = len(words) - width + 1
    parts = []
    for at in range(0, total, _STEP):
        end = min(total, at + _STEP)
        spans = zip(starts[at:end].tolist(), ends[at + width - 1 : end + width - 1].tolist())
        parts.append(np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, end - at))
    return np.unique(np.concatenate(parts))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Of two sorted sets."""
    if not len(a) or not len(b):
        return len(a) == len(b)
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return LEAST[1] * shared >= LEAST[0] * (len(both) - shared)


def parities(own: np.ndarray) -> np.ndarray:
    """PARITIES bits, in longs: of the members that fall on a bit, whether their number is odd."""
    odd = np.bincount((own % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _texts(column: pa.Array) -> Iterator[bytes]:
    return (t.as_buffer().to_pybytes() if t.is_valid else b"" for t in column.cast(pa.large_binary()))


#: The sorted distinct hashes of each text of a column.
SetsOf = Callable[[pa.Array], Iterator[np.ndarray]]


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    return map(shingles, _texts(column))


def common_members(keyed: DataFrame, sets_of: SetsOf) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes that are common in a sample, and their counts there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in sets_of(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], names=["sig"])

    seen = mapped(keyed.filter(F.pmod(F.xxhash64("_ord"), F.lit(SAMPLE)) == 0).select("text"), run, "sig long")
    top = seen.groupBy("sig").count().filter(F.col("count") >= COMMON).orderBy(F.desc("count"), "sig").limit(MOST).toArrow()
    sigs, counts = top.column("sig").to_numpy().astype(np.int64).view(np.uint64), top.column("count").to_numpy().astype(np.int64)
    order = np.argsort(sigs)
    return sigs[order], counts[order]


def with_keys(keyed: DataFrame, common: tuple[np.ndarray, np.ndarray], sets_of: SetsOf, fingerprints: bool = False) -> DataFrame:
    """ord, hash, id (of the set), n (its size) and keys, in order, of each row; with fingerprints also fp, the set's."""
    sigs, counts = common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ns, keys, fps = [], [], [], []
            for own in sets_of(batch.column(2)):
                n = len(own)
                if fingerprints:
                    fps.append(simhash.of_set(own))
                ids.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                ns.append(n)
                if len(sigs):
                    at = np.minimum(np.searchsorted(sigs, own), len(sigs) - 1)
                    own = own[np.argsort(np.where(sigs[at] == own, counts[at], 0), kind="stable")]
                keys.append(own[: n - -(-LEAST[0] * n // LEAST[1]) + 1].view(np.int64))
            columns = [batch.column(0), batch.column(1), pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(ns, pa.int32()), pa.array(keys, pa.list_(pa.int64()))]
            if fingerprints:
                columns.append(pa.array(np.array(fps, np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, names=["ord", "hash", "id", "n", "keys", "fp"][: len(columns)])

    return mapped(keyed.select("_ord", "_hash", "text"), run, "ord long, hash long, id long, n int, keys array<long>" + (", fp long" if fingerprints else ""))


def fingerprint_pairs(rows: DataFrame, distance: int) -> DataFrame:
    """u, v (u > v): pairs of sets that connect what the distance of fingerprints connects. rows: the stored table of with_keys."""
    ids = rows.select("id", "fp").distinct()
    firsts = Stored(ids.groupBy("fp").agg(F.min("id").alias("first")))
    edges = simhash.links(firsts.df.select("fp"), firsts.df.count(), distance).distinct()
    a, b = (firsts.df.select(F.col("fp").alias(k), F.col("first").alias(f"first_{k}")) for k in ("u", "v"))
    near = edges.join(a, "u").join(b, "v").select(F.greatest("first_u", "first_v").alias("u"), F.least("first_u", "first_v").alias("v"))
    equal = ids.join(firsts.df, "fp").filter("id > first").select(F.col("id").alias("u"), F.col("first").alias("v"))
    return near.unionByName(equal)


def _can(na: np.ndarray, i: np.ndarray, nb: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets with a key at places i and j can be alike, if it is the first that they share."""
    p, q = LEAST
    most = 1 + np.minimum(na - 1 - i, nb - 1 - j)
    return (q * np.minimum(na, nb) >= p * np.maximum(na, nb)) & ((p + q) * most >= p * (na + nb))


def _pairs(groups: DataFrame, stars: bool) -> DataFrame:
    """u, v (u > v): pairs of a key that can be alike and whose roots differ; with stars, of large keys only those with
    the set with the least place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            u, v = np.concatenate(us), np.concatenate(vs)
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

        us, vs, held = [], [], 0
        for batch in batches:
            offsets = np.asarray(batch.column(0).offsets)
            members = batch.column(0).values
            ids, ns, places, roots = (np.asarray(members.field(k)) for k in range(4))
            ns, places = ns.astype(np.int64), places.astype(np.int64)
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                order = a + np.lexsort((ids[a:b], places[a:b]))
                for k in range(1 if stars and b - a > DENSE else b - a - 1):
                    x, rest = order[k], order[k + 1 :]
                    rest = rest[(roots[rest] != roots[x]) & _can(ns[rest], places[rest], ns[x], places[x])]
                    us.append(ids[rest])
                    vs.append(np.full(len(rest), ids[x]))
                    held += len(rest) + 1
                    if held >= _PAIRS:
                        yield out()
                        us, vs, held = [], [], 0
        if us:
            yield out()

    return mapped(groups.select("members"), run, "u long, v long").distinct()


def _linked(pairs: DataFrame, keyed: DataFrame, firsts: DataFrame, sets_of: SetsOf) -> DataFrame:
    """The pairs that are alike. firsts: id, ord, hash of the row that a set's text is taken from."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, own in enumerate(sets_of(batch.column(1))):
                columns = [pa.array([len(own)], pa.int32()), pa.array([parities(own)], pa.list_(pa.int64())), pa.array([own.view(np.int64)], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *columns], names=["id", "n", "bits", "sigs"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [alike(*(np.asarray(s[i].values).view(np.uint64) for s in (batch.column(2), batch.column(3)))) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(near, pa.bool_()))

    asked = Stored(pairs)
    picked = Stored(asked.df.select(F.explode(F.array("u", "v")).alias("id")).distinct().join(firsts, "id"))
    few = F.broadcast(picked.df) if picked.df.count() <= _PICKED else picked.df
    texts = keyed.join(few, (F.col("_ord") == F.col("ord")) & (F.col("_hash") == F.col("hash"))).select("id", "text")
    found = Stored(mapped(texts, sets, "id long, n int, bits array<long>, sigs array<long>"))
    # what differs in parity is in one set only, which bounds what a pair can share: most pairs end here, by small rows
    marks = found.df.select("id", "n", "bits").dropDuplicates(["id"])  # rows can be repeated
    a, b = (marks.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"bits{k}")) for k in ("u", "v"))
    apart = F.aggregate(F.zip_with("bitsu", "bitsv", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    both = F.col("nu") + F.col("nv")
    near = Stored(asked.df.join(a, "u").join(b, "v").filter(sum(LEAST) * (both - apart) >= 2 * LEAST[0] * both).select("u", "v"))
    one = found.df.select("id", "sigs").join(near.df.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "id").dropDuplicates(["id"])
    both = near.df.join(one.select(F.col("id").alias("u"), F.col("sigs").alias("a")), "u").join(one.select(F.col("id").alias("v"), F.col("sigs").alias("b")), "v").select("u", "v", "a", "b")
    out = Stored(mapped(both, compare, "u long, v long"))
    for x in (asked, picked, found, near):
        x.drop()
    return out.df


def size_partition(n: str) -> Column:
    """Of set lengths from 1 on, in geometric steps a little wider than 1 / LEAST, so that rounding can't part sets that are alike."""
    return F.floor(F.log(F.col(n).cast("double")) / math.log(1.01 * LEAST[1] / LEAST[0])).cast("int")


def links(keyed: DataFrame, rows: DataFrame, sets_of: SetsOf, by_size: bool, distance: int | None = None) -> DataFrame:
    """u, v (u > v): edges that connect what similarity connects. rows: the stored table of with_keys, with fingerprints if
    there is a distance: then pairs of fingerprints come first, and keys for what these leave apart."""
    sets = rows.groupBy("id").agg(F.min(F.struct("ord", "hash", "n", "keys")).alias("x"))
    firsts = rows.groupBy("id").agg(F.min(F.struct("ord", "hash")).alias("x")).select("id", "x.ord", "x.hash")
    part = size_partition("n")
    member = lambda root: F.struct("id", "n", "place", F.col(root).alias("root"))
    sets = sets.select("id", "x.n", "x.keys")
    if distance is None:
        # a group's roots are its members themselves at first
        near, root, apart = None, "id", F.size("members") > 1
    else:
        near = _linked(fingerprint_pairs(rows, distance), keyed, firsts, sets_of)
        sets = sets.join(components(near).withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        root, apart = "root", F.expr("exists(members, m -> m.root != members[0].root)")
    keys = sets.select(*dict.fromkeys(["id", root, "n"]), F.posexplode("keys").alias("place", "key"))
    keys = keys.withColumn("part", F.explode(F.array(part, part - 1)) if by_size else F.lit(0))
    groups = Stored(keys.groupBy("key", "part").agg(F.collect_list(member(root)).alias("members")).filter(apart))
    found = _linked(_pairs(groups.df, True), keyed, firsts, sets_of)
    found = found if near is None else near.unionByName(found)
    large = groups.df.filter(F.size("members") > DENSE)
    if not large.isEmpty():
        roots = components(found)
        parts = large.select("key", "part", F.explode("members").alias("m")).select("key", "part", "m.id", "m.n", "m.place")
        parts = parts.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        again = parts.groupBy("key", "part").agg(F.collect_list(member("root")).alias("members"), F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b")
        found = found.unionByName(_linked(_pairs(again, False), keyed, firsts, sets_of))
    groups.drop()
    free_shuffles(rows.sparkSession)
    return found


def classes(docs: DataFrame, sets_of: SetsOf = shingle_sets, by_size: bool = False, distance: int | None = None) -> DataFrame:
    """ord, hash (of the text), first: a row for each different pair of ord and hash of docs; first has the least ord and hash
    that links reach. Stored. With a distance, fingerprints of the sets name pairs first."""
    texts = docs.select(order_id().alias("_ord"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"), "text")
    rows = Stored(with_keys(texts, common_members(texts, sets_of), sets_of, distance is not None))
    found = components(links(texts, rows.df, sets_of, by_size, distance)).withColumnRenamed("node", "id")
    rooted = rows.df.select("id", "ord", "hash").distinct().join(found, "id", "left").withColumn("root", F.coalesce("root", "id"))
    first = rooted.groupBy("root").agg(F.min(F.struct("ord", "hash")).alias("first"))
    out = store(rooted.join(first, "root").select("ord", "hash", "first"))
    rows.drop()
    return out


def one_of_each(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """docs without near-duplicates, by SimHash and an exact check, and by keys for the rest: of each component the row with the least id stays, of equal ids that with the least hash
    of its text, of repeated rows any one."""
    best = classes(docs, distance=distance).select("first").distinct().select(F.col("first.ord").alias("ord"), F.col("first.hash").alias("hash"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), order_id().alias("ord"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    return whole.join(best, ["ord", "hash"]).dropDuplicates(["ord", "hash"]).select("row.*")
