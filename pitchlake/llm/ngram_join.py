"""Jaccard join of word n-grams by token-combination prefixes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .common import cut, lookup, text_of
from .components import connected_components, forest_edges

CLASS_BITS = 18  # token classes are the first bits of the tokens' hashes
SHARED = 3  # tokens that similar sets share in their extended prefixes
MOST_COMBINED = 48  # frequent tokens of a prefix that are indexed by pairs
LEAST_BITS = 1024  # of a set's sketch; larger sets have a bit for each token, rounded up to a power of two
SMALL = 32  # rows of a key up to which its pairs are listed
SKETCHES = 2048  # sketches on each side of a block of comparisons
SIDE = 1024  # documents on each side of a block of comparisons on whole texts
SIDE_TOKENS = 1 << 20  # and tokens of their sets
PIVOTS = 32  # representatives of a large cluster
BROADCAST_ROWS = 1_000_000  # of two longs


def shingles(text: str, known: words.WordHashes, size: int) -> np.ndarray:
    """Sorted hashes of the distinct ``size``-word shingles; of all words if there are fewer."""
    hashes = known.of(words.split(text, lower=True))
    if not len(hashes):
        return hashes
    if len(hashes) < size:
        return words.runs(hashes, len(hashes)) + np.uint64(len(hashes))
    return np.unique(words.runs(hashes, size))


def class_counts(docs: DataFrame, text: str, size: int, bits: int) -> np.ndarray:
    """How many (document, shingle) pairs each token class has: a table of fixed size."""
    part_bits = min(12, bits)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, total = words.WordHashes(), np.zeros(1 << bits, dtype=np.int64)
        for b in batches:
            for t in b[text]:
                s = shingles(t, known, size)
                np.add.at(total, (s >> np.uint64(64 - bits)).astype(np.int64), 1)
        parts = total.reshape(-1, 1 << part_bits)
        yield pd.DataFrame({"part": np.arange(len(parts)), "counts": [zlib.compress(p.tobytes(), 1) for p in parts]})

    def added(g: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(c), dtype=np.int64) for c in g["counts"])
        return pd.DataFrame({"part": g["part"].iloc[:1], "counts": [total.tobytes()]})

    schema = "part long, counts binary"
    parts = docs.select(text_of(text).alias(text)).mapInPandas(counted, schema).groupBy("part").applyInPandas(added, schema)
    out = np.zeros((1 << (bits - part_bits), 1 << part_bits), dtype=np.int64)
    for r in parts.collect():
        out[r["part"]] = np.frombuffer(r["counts"], dtype=np.int64)
    return out.reshape(-1)


def index_keys(s: np.ndarray, counts: np.ndarray, limit: float, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys under which a set is indexed, and those by which it only seeks others.

    Tokens are put in order of their class's count. Sets x, y with 100 |x & y| >= percent |x | y|
    share at least ceil(percent |x| / 100) tokens, so at least SHARED in the first
    |x| - ceil(percent |x| / 100) + SHARED of each. Of those, either two are of rare classes
    or two of frequent ones. Rare tokens are keys by themselves (last bit 0), frequent ones in
    pairs (last bit 1). A set with very many frequent tokens is indexed by each of them alone,
    and the others seek it so.
    """
    n = len(s)
    none = np.zeros(0, dtype=np.uint64)
    if (n + 1) * percent > 100 * n:  # only an equal set is that similar
        return none, none
    bits = (len(counts) - 1).bit_length()
    count = counts[(s >> np.uint64(64 - bits)).astype(np.int64)]
    prefix = np.lexsort((s, count))[: n + (-percent * n) // 100 + SHARED]
    tokens, often = s[prefix], count[prefix] >= limit
    one = np.uint64(1)
    rare, frequent = words.mix(tokens[~often]) & ~one, np.sort(tokens[often])
    alone = words.mix(frequent) & ~one
    if len(frequent) > MOST_COMBINED:
        return np.concatenate([rare, alone]), none
    i, j = np.triu_indices(len(frequent), 1)
    with np.errstate(over="ignore"):
        pairs = words.mix(frequent[i] * words.FACTOR + frequent[j]) | one
    return np.concatenate([rare, pairs]), alone


def sketch(s: np.ndarray) -> list[int]:
    """A bit by place of a hash: whether an odd number of the set's tokens has the place.

    A token that only one of two sets has turns one bit, so two sketches differ in at most as
    many bits as tokens are in one set alone. ``folded`` gives the sketch of half as many bits.
    """
    bits = max(LEAST_BITS, 1 << (len(s) - 1).bit_length()) if len(s) else LEAST_BITS
    places = (words.mix(s) & np.uint64(bits - 1)).astype(np.int64)
    odd = np.bincount(places, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def folded(s: Column, size: Column) -> Column:
    """A sketch brought to ``size`` longs, if it has twice as many."""
    half = F.zip_with(F.slice(s, 1, size), F.slice(s, size + 1, size), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(s) > size, half).otherwise(s)


def described(docs: DataFrame, doc_id: str, text: str, size: int, percent: int, counts: np.ndarray) -> DataFrame:
    """(id, n, s1, s2, keys, seeks, sketch) of each document: its set's size, digest and keys."""
    mean = counts.mean()
    shared, limit = docs.sparkSession.sparkContext.broadcast(counts), mean + 8 * np.sqrt(mean) + 32

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = words.WordHashes()
        for b in batches:
            out = []
            for t in b["t"]:
                s = shingles(t, known, size)
                keys, seeks = index_keys(s, shared.value, limit, percent)
                with np.errstate(over="ignore"):
                    out.append((len(s), int(words.mix(s).sum(dtype=np.uint64).astype(np.int64)), int(words.mix(s * words.FACTOR).sum(dtype=np.uint64).astype(np.int64)), keys.astype(np.int64), seeks.astype(np.int64), sketch(s)))
            yield pd.DataFrame({"id": b["id"], **{c: [r[i] for r in out] for i, c in enumerate(("n", "s1", "s2", "keys", "seeks", "sketch"))}})

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id).alias("id"), text_of(text).alias("t")).mapInPandas(rows, f"id {kind}, n long, s1 long, s2 long, keys array<long>, seeks array<long>, sketch array<long>")


def differences(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """In how many bits the sketches (arrays of bits of one length) of both sides differ."""
    both = np.zeros((len(left), len(right)), dtype=np.float32)
    for at in range(0, len(left[0]), 4096):
        x, y = (np.stack([b[at : at + 4096] for b in side]).astype(np.float32) * 2 - 1 for side in (left, right))
        both += x @ y.T
    return (len(left[0]) - both) / 2


def near_sketches(sketches: list[np.ndarray], n: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of rows of both sides may be as similar as ``percent``, by sizes and sketches."""
    near = 100 * np.minimum.outer(n[left], n[right]) >= percent * np.maximum.outer(n[left], n[right])
    bits = [np.unpackbits(np.asarray(s, dtype=np.int64).view(np.uint8)) for s in sketches]
    length = np.array([len(b) for b in bits])
    for size in np.unique(length):  # sizes that similar sets may have differ at most by a factor of two
        at = {s: [np.flatnonzero(length[side] == k) for k in (size, 2 * size)] for s, side in (("l", left), ("r", right))}
        for i, j in ((0, 0), (0, 1), (1, 0)):
            a, b = at["l"][i], at["r"][j]
            if len(a) and len(b):
                small = [[x if len(x) == size else x[:size] ^ x[size:] for x in (bits[k] for k in side)] for side in (left[a], right[b])]
                near[np.ix_(a, b)] &= differences(*small) * (100 + percent) <= np.add.outer(n[left[a]], n[right[b]]) * (100 - percent)
    return near


def _forest(near: np.ndarray, left: np.ndarray, right: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
    """Enough of the pairs that ``near`` marks between two sides to connect what they connect."""
    whole = np.zeros((len(ids), len(ids)), dtype=bool)
    whole[np.ix_(left, right)] = near
    np.fill_diagonal(whole, False)
    edges = np.array(forest_edges(whole | whole.T), dtype=np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": ids[edges[:, 0]], "b": ids[edges[:, 1]]})


def _plausible(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Pairs of blocks whose sketches are near enough: enough of them to connect such pairs."""
    out = []
    for (_, i, j), g in pdf.groupby(["key", "i", "j"], sort=False):
        side, n = g["block"].to_numpy(), g["n"].to_numpy()
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        if len(left) and len(right):
            out.append(_forest(near_sketches(list(g["sketch"]), n, left, right, percent), left, right, g["id"].to_numpy()))
    return pd.concat(out) if out else pdf[["id", "id"]].iloc[:0].set_axis(["a", "b"], axis=1)


def blocks(rows: DataFrame, sides: Column) -> DataFrame:
    """``rows`` of groups cut into ``sides`` by id: columns block, i, j, so that each pair of
    sides of a group is together once."""
    rows = rows.withColumn("_sides", sides).withColumn("block", F.pmod(F.xxhash64(F.lit(3), "id"), F.col("_sides")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_sides") - 1)))
    return rows.withColumn("i", F.least("block", "_other")).withColumn("j", F.greatest("block", "_other")).drop("_sides", "_other")


def hot_groups(sets: DataFrame, hot: DataFrame, rounds: int = 3) -> DataFrame:
    """(key, id): the sets of keys with many rows, in few groups that hold each key's rows together.

    Sets that are alike share most of their frequent keys. Keys whose rows are mostly the same
    are merged: two keys get the same min-hash of their rows with the probability of the rows'
    similarity, and the keys of one min-hash become one group with the rows of all of them, so
    no pair of a key is lost. ``hot``: (key, mark), ``mark`` being a key's first min-hash. The
    keys are looked up within tasks while they are few enough for a broadcast, beyond by a join.
    """
    kind = dict(sets.dtypes)["id"]
    hot = cut(hot)
    if hot.count() <= BROADCAST_ROWS:
        table = hot.toPandas().sort_values("key")
        shared = sets.sparkSession.sparkContext.broadcast((table["key"].to_numpy(), table["mark"].to_numpy()))

        def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            keys, marks = shared.value
            for b in batches:
                ids, found = [], []
                for i, *lists in zip(b["id"], b["keys"], b["seeks"]):
                    own = np.concatenate([np.asarray(k, dtype=np.int64) for k in lists])
                    at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
                    m = np.unique(marks[at[keys[at] == own]]) if len(keys) else own[:0]
                    ids += [i] * len(m)
                    found.append(m)
                yield pd.DataFrame({"key": np.concatenate([*found, np.zeros(0, dtype=np.int64)]), "id": pd.Series(ids, dtype=b["id"].dtype)})

        rows = sets.select("id", "keys", "seeks").mapInPandas(marked, f"key long, id {kind}")
    else:
        posted = sets.select("id", F.explode(F.concat("keys", "seeks")).alias("key"))
        rows = posted.join(hot, "key").select(F.col("mark").alias("key"), "id").distinct()
    rows = cut(rows)
    n = rows.count()
    for i in range(1, rounds):
        marks = rows.groupBy("key").agg(F.min(F.xxhash64(F.lit(i), "id")).alias("mark"))
        rows, before = cut(rows.join(marks, "key").select(F.col("mark").alias("key"), "id").distinct(), n), n
        n = rows.count()
        if 10 * n > 9 * before:
            break
    return rows


def candidates(sets: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) that connect the sets that share two tokens, or a pair of frequent ones, in their
    prefixes, and whose sketches differ in no more bits than similar sets of their sizes can.

    Keys of one set only go first. The pairs of keys with few rows are listed and counted. Those
    of keys with many rows are never listed: such keys are merged by ``hot_groups``, a group's
    sketches are compared in blocks, and each block gives only what connects its near pairs.
    """
    index = sets.select("id", F.explode("keys").alias("key"), F.lit(2).alias("role"))
    seek = sets.select("id", F.explode("seeks").alias("key"), F.lit(1).alias("role"))
    posted = index.union(seek)
    used = posted.groupBy("key").agg(F.count("*").alias("rows"), F.max("role").alias("top"), F.min(F.xxhash64("id")).alias("mark"))
    used = cut(used.where("rows > 1 and top = 2"))
    few = posted.join(used.where(F.col("rows") <= SMALL).select("key"), "key").groupBy("key").agg(F.collect_list(F.struct("id", "role")).alias("m"))
    few = few.select("key", F.explode("m").alias("x"), "m").select("key", "x", F.explode("m").alias("y"))
    few = few.where("x.id < y.id and greatest(x.role, y.role) = 2").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.expr("1 + (key & 1)").alias("w"))
    pairs = few.groupBy("a", "b").agg(F.sum("w").alias("w")).where("w > 1").select("a", "b")
    of = lambda side: rows.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    size = F.least(F.size("s_a"), F.size("s_b"))
    differ = F.aggregate(F.zip_with(folded(F.col("s_a"), size), folded(F.col("s_b"), size), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda acc, x: acc + x)
    alike = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")  # else no similarity of percent
    near = both.where(alike & (differ * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent))).select("a", "b")

    groups = hot_groups(sets, used.where(F.col("rows") > SMALL).select("key", "mark"))
    hot = groups.join(rows.select("id", "n", "sketch"), "id")
    sides = hot.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / SKETCHES), F.ceil(F.sum(F.size("sketch")) / (32 * SKETCHES))).cast("int").alias("sides"))
    hot = blocks(hot.join(sides, "key"), F.col("sides"))
    kind = dict(sets.dtypes)["id"]
    return near.union(hot.groupBy("key", "i", "j").applyInPandas(partial(_plausible, percent=percent), f"a {kind}, b {kind}"))


def _linked(pdf: pd.DataFrame, size: int, percent: int) -> pd.DataFrame:
    """Links of the documents of blocks: enough of them to connect what is linked."""
    known, out = words.WordHashes(), []
    for (_, i, j), g in pdf.groupby(["cluster", "i", "j"], sort=False):
        sets = [shingles(t, known, size) for t in g["text"]]
        side = g["block"].to_numpy()
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        n = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), n)
        _, token, count = np.unique(flat, return_inverse=True, return_counts=True)
        owner, token = owner[count[token] > 1], token[count[token] > 1]
        token = np.unique(token, return_inverse=True)[1]
        both = np.zeros((len(left), len(right)), dtype=np.float32)
        for at in range(0, int(token.max()) + 1 if len(token) else 0, 8192):
            here = (token >= at) & (token < at + 8192)
            x = np.zeros((len(sets), min(8192, int(token.max()) + 1 - at)), dtype=np.float32)
            x[owner[here], token[here] - at] = 1
            both += x[left] @ x[right].T
        both = np.rint(both).astype(np.int64)
        similar = (100 * both >= percent * (n[left][:, None] + n[right][None, :] - both)) & (both > 0)
        out.append(_forest(similar, left, right, g["id"].to_numpy()))
    return pd.concat(out)


def links(docs: DataFrame, pairs: DataFrame, rows: DataFrame, doc_id: str, text: str, size: int, percent: int) -> DataFrame:
    """True links (a, b) that connect whatever is linked among the clusters of ``pairs``.

    Small clusters of candidates are compared exactly, on their whole texts, many to a task. In
    a large one (over SIDE documents or SIDE_TOKENS tokens) every document is compared with the
    PIVOTS representatives of most candidates first, in rows that grow with the cluster. Where
    that leaves one component nothing is left to do. Otherwise documents of different
    components meet in blocks of two sides: large components have sides of their own, which
    never meet each other, so the part that is joined already is not compared with itself.
    """
    kind = dict(docs.dtypes)[doc_id]
    clusters = cut(connected_components(pairs))
    weights = rows.groupBy("id").agg(F.max("n").alias("n"))
    clusters = cut(clusters.join(weights, F.col("node") == F.col("id")).select("id", F.col("component").alias("cluster"), "n"), clusters.count())
    count, tokens = clusters.select(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    parts = max(1, count // (SIDE // 4), tokens // (SIDE_TOKENS // 4))
    sides = F.greatest(F.ceil(F.count("*") / SIDE), F.ceil(F.sum("n") / SIDE_TOKENS)).cast("int").alias("sides")
    large = cut(clusters.groupBy("cluster").agg(sides).where("sides > 1"), count)
    texts = lambda members: docs.select(F.col(doc_id).alias("id"), text_of(text).alias("text")).join(F.broadcast(members) if count <= BROADCAST_ROWS else members, "id")
    compare = lambda placed: placed.groupBy("g").applyInPandas(partial(_linked, size=size, percent=percent), f"a {kind}, b {kind}")

    part = F.pmod(F.xxhash64("cluster", "i", "j"), F.lit(parts)).alias("g")
    small = clusters.join(large, "cluster", "left_anti").select("id", "cluster", F.lit(0).alias("block"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    if not large.count():
        return compare(texts(small.select("*", part)))
    members = cut(clusters.join(large, "cluster"), count)
    chunk = F.pmod(F.xxhash64(F.lit(5), "id"), F.col("sides")).cast("int")
    chunks = members.select("id", "cluster", chunk.alias("block"), F.lit(-1).alias("i"), chunk.alias("j"))
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("degree"))
    first = Window.partitionBy("cluster").orderBy(F.desc("degree"), "id")
    pivots = members.join(ends, "id").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= PIVOTS)
    pivots = pivots.select("id", "cluster", F.lit(-1).alias("block"), F.lit(-1).alias("i"), F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("j"))
    found = cut(compare(texts(small.union(chunks).union(pivots).select("*", part))))

    known = members.select("id").withColumnRenamed("id", "a").join(found, "a").union(members.select(F.col("id").alias("b")).join(found, "b").select("a", "b"))
    joined = members.join(connected_components(known).withColumnRenamed("node", "id"), "id", "left")
    joined = cut(joined.select("id", "cluster", "n", F.coalesce("component", "id").alias("component")), count)
    own = joined.groupBy("cluster", "component").agg(F.count("*").alias("count"), F.sum("n").alias("n"))
    own = own.withColumn("pure", (F.col("count") >= SIDE // 2) | (F.col("n") >= SIDE_TOKENS // 2))
    own = cut(own.withColumn("part", F.when(F.col("pure"), F.col("component"))), count)
    split = own.groupBy("cluster", "part").agg(F.sum("count").alias("count"), F.sum("n").alias("n"), F.count("*").alias("components"))
    split = split.withColumn("own", F.greatest(F.ceil(F.col("count") / SIDE), F.ceil(F.col("n") / SIDE_TOKENS)).cast("int"))
    order = Window.partitionBy("cluster").orderBy(F.col("part").asc_nulls_last())  # of two sides at least for each large part
    whole = Window.partitionBy("cluster")
    split = split.withColumn("base", (F.sum("own").over(order) - F.col("own")).cast("int")).withColumn("all", F.sum("own").over(whole).cast("int"))
    split = cut(split.withColumn("components", F.sum("components").over(whole)).where("components > 1"), count)
    if not split.count():
        return found
    placed = joined.join(own.select("cluster", "component", "part"), ["cluster", "component"]).join(split.select("cluster", F.col("part").alias("_part"), "own", "base", "all"), "cluster").where(F.col("part").eqNullSafe(F.col("_part")))
    placed = placed.withColumn("block", (F.col("base") + F.pmod(F.xxhash64(F.lit(9), "id"), F.col("own"))).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("all") - 1), lambda k: F.col("part").isNull() | (k < F.col("base")) | (k >= F.col("base") + F.col("own")))
    placed = placed.withColumn("_other", F.explode(others))
    placed = placed.select("id", "cluster", "block", F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"))
    return found.union(compare(texts(placed.select("*", F.xxhash64("cluster", "i", "j").alias("g")))))


def join_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, percent: int = 90, class_bits: int = CLASS_BITS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs``.

    Words are runs without ASCII white space, A-Z lower-cased. A document's set: its distinct
    ``size``-word shingles, or the whole sequence if it is shorter. Documents link when
    100 |x & y| >= percent |x | y| (percent from 75 to 100); ``component_id`` is the smallest
    id reachable by links, its own without any.

    Equal sets are collapsed to one first; the rest are joined by ``index_keys`` and verified
    on whole texts by ``links``. No key, group or set is capped; shingles are told apart by 64
    bits of their hashes, equal sets by two sums of 64 bits and their size.

    Null and empty texts have the size 0 and no link. Rows of equal id are one node with the
    links of each of their texts; rows with a null id have no component and link nothing. An
    empty table stays empty.
    """
    if not 75 <= percent <= 100:
        raise ValueError("percent must be from 75 to 100")
    counts = class_counts(docs, text, size, class_bits)
    rows = cut(described(docs, doc_id, text, size, percent, counts))
    full = rows.where("n > 0 and id is not null")
    classes = full.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.count("*").alias("rows"))
    same = full.select("id", "n", "s1", "s2").join(classes.where("rows > 1"), ["n", "s1", "s2"]).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    reps = full.groupBy("n", "s1", "s2").agg(F.min_by(F.struct("id", "keys", "seeks"), "id").alias("r")).select("r.*")
    found = links(docs, cut(candidates(reps, full, percent)), full, doc_id, text, size, percent)
    components = connected_components(same.union(found))
    out = rows.select("id", "n").join(components, rows["id"] == F.col("node"), "left")
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def without(docs: DataFrame, gone: DataFrame, doc_id: str) -> DataFrame:
    """The rows of ``docs`` whose id is not in ``gone`` (distinct ids), null ids included.

    The ids are broadcast if they are few enough; more of them are joined by a shuffle.
    """
    return docs.join(lookup(gone, BROADCAST_ROWS), doc_id, "left_anti")
