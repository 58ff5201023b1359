"""Benchmark passages in documents by the q-gram lemma and banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lookup, text_of

Q = 12  # characters of a q-gram
PIECE, STRIDE = 64, 16  # items are sought by pieces of this many characters, begun this far apart
RATE = 0.05  # edits a character that a piece may need
LEAST_BITS, MOST_BITS = 20, 30  # of the table of a benchmark's q-grams: 128 kB to 128 MB
SLICE = 15  # bits of the table that are put together at a time
BLOCK = 1 << 19  # characters of documents searched at a time
GAP = "\uffff" * 8  # between texts
FAR = 1 << 20  # more edits than any piece has
FOUND = "array<struct<item:string,start:int,end:int,edits:int>>"


def lower(text: str) -> str:
    """Lower case, character by character where the whole would change its length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def normal(low: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a lower-case text with single spaces, and the place of each in the text."""
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    space = (codes == 32) | (codes - np.uint32(9) < 5)
    keep = ~space
    keep[1:] |= ~space[:-1]
    at = np.flatnonzero(keep)
    return np.where(space, np.uint32(32), codes)[at], at


def grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash of the q characters that begin at each place."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    k = np.uint64(0x9E3779B97F4A7C15)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        one = codes.astype(np.uint64) + np.uint64(1)
        two = one[:-1] * k + one[1:]
        four = two[:-2] * (k * k) + two[2:]
        out, done, power = four[:n].copy(), 4, k * k * k * k
        while done + 4 <= q:
            out = out * power + four[done : done + n]
            done += 4
        for j in range(done, q):
            out = out * k + one[j : j + n]
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def budget(size: int, q: int = Q) -> int:
    """Edits allowed to a piece: RATE a character, and no more than leave it a q-gram."""
    return min(int(RATE * size), (size - q) // q)


def pieces_of(benchmark: DataFrame, item_id: str, text: str, q: int = Q) -> DataFrame:
    """(piece, item, codes, size, edits): the pieces that items are sought by."""

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for item, t in zip(b["item"], b["t"]):
                codes, _ = normal(lower(t.strip(" \t\n\v\f\r")))
                if len(codes) >= q:
                    ends = range(STRIDE + PIECE, len(codes) + STRIDE, STRIDE) if len(codes) > PIECE else []
                    for s in sorted({0, *(min(e, len(codes)) - PIECE for e in ends)}):
                        piece = codes[s : s + PIECE]
                        rows.append((item, piece.tobytes(), len(piece), budget(len(piece), q)))
            yield pd.DataFrame(rows, columns=["item", "codes", "size", "edits"])

    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), text_of(text).alias("t"))
    found = rows.mapInPandas(cut_up, "item string, codes binary, size int, edits int")
    return found.select(F.xxhash64("codes").alias("piece"), "*").distinct()


def posted(pieces: DataFrame, q: int = Q) -> DataFrame:
    """(gram, piece, offset, size, edits): the q-grams of each different piece."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hashes = [grams(np.frombuffer(c, dtype=np.uint32), q).view(np.int64) for c in b["codes"]]
            n = [len(h) for h in hashes]
            out = {c: np.repeat(b[c].to_numpy(), n) for c in ("piece", "size", "edits")}
            yield pd.DataFrame({"gram": np.concatenate([np.zeros(0, dtype=np.int64), *hashes]), "offset": np.concatenate([np.zeros(0, dtype=np.int64), *map(np.arange, n)]), **out})

    return pieces.select("piece", "codes", "size", "edits").dropDuplicates(["piece"]).mapInPandas(listed, "gram long, offset int, piece long, size int, edits int")


def places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each q-gram in a table of 2**bits bits."""
    return (h >> np.uint64(64 - bits)).astype(np.int64), (h & np.uint64((1 << bits) - 1)).astype(np.int64)


def bit_table(index: DataFrame, bits: int) -> np.ndarray:
    """A table of 2**bits bits in which both places of each q-gram are set."""

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = np.unique(np.concatenate(places(b["gram"].to_numpy().view(np.uint64), bits)))
            yield pd.DataFrame({"slice": at >> SLICE, "place": (at & ((1 << SLICE) - 1)).astype(np.int32)})

    def packed(g: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(1 << SLICE, dtype=np.uint8)
        own[g["place"]] = 1
        return pd.DataFrame({"slice": g["slice"].iloc[:1], "bytes": [np.packbits(own, bitorder="little").tobytes()]})

    slices = index.select("gram").mapInPandas(placed, "slice long, place int").distinct().groupBy("slice").applyInPandas(packed, "slice long, bytes binary")
    table = np.zeros((1 << max(0, bits - SLICE), 1 << (SLICE - 3)), dtype=np.uint8)
    for r in slices.toLocalIterator():  # slices of 4 kB of a table of bounded size
        table[r["slice"]] = np.frombuffer(r["bytes"], dtype=np.uint8)
    return table.reshape(-1)


def known(h: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Which q-grams may be the benchmark's."""
    one, two = places(h, bits)
    out = (table[one >> 3] >> (one & 7).astype(np.uint8)) & 1 == 1
    maybe = np.flatnonzero(out)
    out[maybe] = (table[two[maybe] >> 3] >> (two[maybe] & 7).astype(np.uint8)) & 1 == 1
    return out


def regions(low: str, heads: np.ndarray, table: np.ndarray, bits: int, need: int, wide: int, q: int = Q) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(text, code points, their places in it) of the parts of texts that begin at ``heads``
    which have ``need`` q-grams of the table within ``wide`` characters, and as much around them."""
    codes, at = normal(low)
    hits = np.flatnonzero(known(grams(codes, q), table, bits))
    if len(hits) < need:
        return []
    near = np.flatnonzero(hits[need - 1 :] - hits[: len(hits) - need + 1] <= wide)
    cover = np.zeros(len(hits) + 1, dtype=np.int64)
    np.add.at(cover, near, 1)
    np.add.at(cover, near + need, -1)
    dense = hits[np.cumsum(cover)[:-1] > 0]
    if not len(dense):
        return []
    text = np.searchsorted(heads, at[dense], side="right") - 1
    ends = np.append(heads[1:], len(low) + len(GAP)) - len(GAP)
    first, last = np.searchsorted(at, heads), np.searchsorted(at, ends)
    lo, hi = np.maximum(dense - wide, first[text]), np.minimum(dense + wide + q, last[text])
    new = np.flatnonzero(np.concatenate([[True], (lo[1:] > hi[:-1]) | (text[1:] != text[:-1])]))
    out = []
    for i, j in zip(new, np.append(new[1:], len(dense))):
        s, e = int(lo[i]), int(hi[j - 1])
        out.append((int(text[i]), codes[s:e], at[s:e] - heads[text[i]]))
    return out


def align(pieces: list[np.ndarray], parts: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """(edits, start, end) of the best place of each piece in its part, all pairs side by side.

    Row by row of the pieces, with free ends in the parts, which are no wider than a band of
    diagonals and the piece. Of places of the same edits the first is taken.
    """
    n, m = max(map(len, parts), default=0), np.array([len(p) for p in pieces])
    region = np.full((len(parts), n), 0xFFFFFFFF, dtype=np.int64)
    want = np.full((len(parts), m.max(initial=0)), 0xFFFFFFFE, dtype=np.int64)
    for i, (p, r) in enumerate(zip(pieces, parts)):
        region[i, : len(r)], want[i, : len(p)] = r, p
    size = np.array([len(r) for r in parts])
    ramp = np.arange(n + 1)
    outside = ramp[None, :] > size[:, None]
    cost, origin = np.where(outside, FAR, 0), np.broadcast_to(ramp, (len(parts), n + 1)).copy()
    out: list[tuple[int, int, int]] = [(0, 0, 0)] * len(parts)
    for i in range(1, want.shape[1] + 1):
        new, source = cost + 1, origin.copy()
        diagonal = cost[:, :-1] + (region != want[:, i - 1 : i])
        better = diagonal <= new[:, 1:]
        new[:, 1:] = np.where(better, diagonal, new[:, 1:])
        source[:, 1:] = np.where(better, origin[:, :-1], source[:, 1:])
        rest = new - ramp
        run = np.minimum.accumulate(rest, axis=1)
        left = np.maximum.accumulate(np.where(rest == run, ramp, 0), axis=1)
        cost, origin = np.where(outside, FAR, run + ramp), np.take_along_axis(source, left, axis=1)
        for k in np.flatnonzero(m == i):
            end = int(np.argmin(cost[k]))
            out[k] = (int(cost[k, end]), int(origin[k, end]), end)
    return out


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", q: int = Q) -> DataFrame:
    """``docs`` with ``leaks``: (item, start, end, edits) of benchmark passages in each whole text.

    Case and the kind and length of white space don't count. Items are sought by pieces of 64
    characters begun every 16 (shorter items whole), each allowed an edit for every 20 characters
    (short ones fewer, so that a q-gram is left): a passage that holds a piece within its edits is
    found. A piece of m characters that occurs with e edits shares at least m - q + 1 - q e
    q-grams with the text, on e + 1 neighbouring diagonals (place in the text minus place in the
    piece), so within one of the bands of 2 (e + 1) diagonals that overlap by half.

    How: a bit table of the benchmark's q-grams, of bounded size, goes to all tasks; the parts of
    texts with as many q-grams of it as a piece must share go on, once for equal texts. Their
    q-grams are joined to the benchmark's (a shuffled join, or a broadcast of checked size) and
    counted by piece and band; bands with enough are aligned. Overlapping matches of an item are
    joined. The benchmark never passes through the driver, texts are read
    once and not shuffled, and what moves grows with the parts that look like a benchmark's.

    Items with fewer than ``q`` characters tell no leak and aren't sought, nor are empty and null
    ones; rows of one item_id are one item. Null and empty texts have no leaks. Rows stay as they
    are; a column ``leaks`` is replaced; an empty table or benchmark gives empty lists.
    """
    kept = [c for c in docs.columns if c.lower() != "leaks"]
    pieces = cut(pieces_of(benchmark, item_id, item_text, q))
    index = cut(posted(pieces, q))
    total, need, wide = index.agg(F.count("*"), F.min(F.greatest(F.lit(1), F.col("size") - q + 1 - q * F.col("edits"))), F.max(F.col("size") + F.col("edits"))).first()
    if not total:
        return docs.select(*[docs[f"`{c}`"] for c in kept], F.array().cast(FOUND).alias("leaks"))
    bits = min(MOST_BITS, max(LEAST_BITS, (64 * total).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(bit_table(index, bits))

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, block, heads, owners, size = [], [], [], [], 0
            for i, t in enumerate([*b["t"], None]):
                if t is not None:
                    block += [lower(t), GAP]
                    heads.append(size)
                    owners.append(i)
                    size += len(t) + len(GAP)
                if block and (t is None or size >= BLOCK):
                    for k, codes, at in regions("".join(block), np.array(heads), shared.value, bits, need, wide, q):
                        rows.append((b["h1"].iloc[owners[k]], b["h2"].iloc[owners[k]], int(at[0]), codes.tobytes(), at.astype(np.int32).tobytes()))
                    block, heads, owners, size = [], [], [], 0
            yield pd.DataFrame(rows, columns=["h1", "h2", "k", "codes", "at"])

    hashes = [F.xxhash64(text_of(text)).alias("h1"), F.xxhash64(F.lit(2), text_of(text)).alias("h2")]
    parts = docs.select(*hashes, text_of(text).alias("t")).where(F.length("t") >= q).mapInPandas(searched, "h1 long, h2 long, k int, codes binary, at binary")
    parts = cut(parts.dropDuplicates(["h1", "h2", "k"]))

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for h1, h2, k, codes in zip(b["h1"], b["h2"], b["k"], b["codes"]):
                h = grams(np.frombuffer(codes, dtype=np.uint32), q)
                place = np.flatnonzero(known(h, shared.value, bits))
                yield pd.DataFrame({"h1": h1, "h2": h2, "k": k, "gram": h[place].view(np.int64), "place": place})

    hits = parts.mapInPandas(listed, "h1 long, h2 long, k int, gram long, place int").join(lookup(index), "gram")
    band = F.floor((F.col("place") - F.col("offset") + F.col("size")) / (F.col("edits") + 1)).cast("int")
    both = hits.withColumn("_band", band).withColumn("band", F.explode(F.array("_band", F.col("_band") - 1))).where("band >= 0")  # band b holds the diagonals of b and b + 1
    enough = both.groupBy("h1", "h2", "k", "piece", "band", "size", "edits").agg(F.count("*").alias("shared"))
    enough = enough.where(F.col("shared") >= F.greatest(F.lit(1), F.col("size") - q + 1 - q * F.col("edits")))

    def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i in range(0, len(b), 500):
                g = b.iloc[i : i + 500]
                want = [np.frombuffer(c, dtype=np.uint32) for c in g["want"]]
                diagonal = (g["band"] * (g["edits"] + 1) - g["size"]).to_numpy()
                lo = np.maximum(0, diagonal - g["edits"].to_numpy())
                hi = np.maximum(lo, diagonal + 3 * g["edits"].to_numpy() + 2 + g["size"].to_numpy())
                codes = [np.frombuffer(c, dtype=np.uint32)[s:e] for c, s, e in zip(g["codes"], lo, hi)]
                for r, s, at, (edits, start, end) in zip(g.itertuples(), lo, g["at"], align(want, codes)):
                    if edits <= r.edits and end > start:
                        at = np.frombuffer(at, dtype=np.int32)
                        rows.append((r.h1, r.h2, r.piece, int(at[s + start]), int(at[s + end - 1]) + 1, edits))
            yield pd.DataFrame(rows, columns=["h1", "h2", "piece", "start", "end", "edits"])

    pairs = enough.join(parts, ["h1", "h2", "k"]).join(lookup(pieces.select("piece", F.col("codes").alias("want")).dropDuplicates(["piece"])), "piece")
    places_of = pairs.select("h1", "h2", "piece", "band", "size", "edits", "want", "codes", "at").mapInPandas(aligned, "h1 long, h2 long, piece long, start int, end int, edits int")
    named = places_of.join(lookup(pieces.select("piece", "item")), "piece").groupBy("h1", "h2", "item").agg(F.array_sort(F.collect_set(F.struct("start", "end", "edits"))).alias("m"))

    def joined(m: Column) -> Column:  # overlapping matches of an item, in order of their starts
        def step(acc: Column, x: Column) -> Column:
            last = F.get(acc, F.size(acc) - 1)
            one = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), F.greatest(last["edits"], x["edits"]).alias("edits"))
            over = (F.size(acc) > 0) & (x["start"] <= last["end"])
            return F.when(over, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(one))).otherwise(F.concat(acc, F.array(x)))

        return F.aggregate(m, F.array().cast("array<struct<start:int,end:int,edits:int>>"), step)

    spans = F.transform(joined(F.col("m")), lambda x: F.struct(F.col("item").alias("item"), x["start"].alias("start"), x["end"].alias("end"), x["edits"].alias("edits")))
    found = named.select("h1", "h2", spans.alias("s")).groupBy("h1", "h2").agg(F.array_sort(F.flatten(F.collect_list("s"))).cast(FOUND).alias("_leaks"))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in kept]).alias("_row"), *hashes).join(lookup(found), ["h1", "h2"], "left")
    return rows.select(*[F.col("_row")[c].alias(c) for c in kept], F.coalesce("_leaks", F.array().cast(FOUND)).alias("leaks"))
