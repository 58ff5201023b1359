"""Near-duplicate vectors by a forest of random-projection trees with overlapping halves."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lookup
from .components import connected_components, forest_edges

SAMPLE = 20_000  # vectors that the forest is fitted on
LEAF = 1536  # vectors that a leaf is meant to hold
SIDE = 4096  # vectors of one side of a block of a larger leaf
WAYS = 32  # random directions of a split at most, each with two ends
COPIES = 1.6  # that a split is expected to make
SPILL = 0.35  # of the spread of a linked pair's difference: vectors this near to the border go to both parts
STUCK = 3.0  # a split that makes this many copies is given up
GOAL = 0.97  # share of the pairs at the least similarity that the forest should find
MOST_TREES = 64


@dataclass
class Tree:
    """A random-projection tree.

    A node at a level projects its vectors, less its centre, on the level's directions. A vector
    goes to the end of a direction where it lies farthest, and to each other one that is less
    than ``spill`` short of it. Nodes that the sample is too thin to know take the centre of the
    last one that it knows, for as many more levels as their number of vectors needs.
    """

    seed: int
    directions: list[np.ndarray]
    spill: float
    nodes: dict[int, tuple[np.ndarray, bool]] = field(default_factory=dict)  # centre's projections on all levels, whether it is split
    extra: dict[int, int] = field(default_factory=dict)  # further levels below a node that isn't

    def columns(self, level: int) -> slice:
        """A level's columns among the projections on all directions."""
        widths = [d.shape[1] for d in self.directions[: level + 1]]
        return slice(sum(widths[:-1]), sum(widths))

    def parts(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, end of a direction) by projections of rows."""
        ends = np.concatenate([at, -at], axis=1)
        return np.nonzero(ends >= ends.max(axis=1, keepdims=True) - self.spill)

    def child(self, node: int, end: int) -> int:
        """The number of a node's child."""
        k = (node * 0x9E3779B97F4A7C15 + (end + 1) * 0xD6E8FEB86659FD93) & ((1 << 64) - 1)
        k = ((k ^ (k >> 31)) * 0xBF58476D1CE4E5B9) & ((1 << 64) - 1)
        return (k ^ (k >> 29)) & ((1 << 63) - 1)

    def route(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf's number, rows that reach it)."""
        projected = x @ np.concatenate(self.directions, axis=1)
        waiting = [(self.seed, 0, np.arange(len(x)), None, 0)]
        while waiting:
            node, level, rows, centre, more = waiting.pop()
            if node in self.nodes:
                centre, split = self.nodes[node]
                more = 0 if split else self.extra.get(node, 0)
            else:
                split = False
            if not split and not more or centre is None:
                yield node, rows
                continue
            at = self.columns(level)
            row, end = self.parts(projected[rows, at] - centre[at])
            for e in np.unique(end):
                waiting.append((self.child(node, int(e)), level + 1, rows[row[end == e]], centre, max(0, more - 1)))


def plant(sample: np.ndarray, total: int, number: int, seed: int, least: float, leaf: int = LEAF) -> Tree:
    """A tree for ``total`` vectors that are spread like the sample.

    A node is split while its share of ``total`` is over ``leaf``, unless the split would make
    many copies, as its vectors lie too close together; such a leaf is compared in blocks.
    """
    size = sample.shape[1]
    rng = np.random.default_rng([seed, number])
    ways, rest = [], total / leaf
    while rest > 1:
        ways.append(min(WAYS, size, math.ceil(rest * COPIES / 2)))
        rest *= COPIES / (2 * ways[-1])
    ways += [min(4, size)] * 2  # for vectors that lie closer together
    directions = [np.linalg.qr(rng.standard_normal((size, k)))[0] for k in ways]
    tree = Tree(int(rng.integers(1 << 62)), directions, SPILL * math.sqrt(2 * (1 - least) / size))
    scale = total / max(1, len(sample))
    every = np.concatenate(directions, axis=1)
    projected = sample @ every
    waiting = [(tree.seed, 0, np.arange(len(sample)))]
    while waiting:
        node, level, rows = waiting.pop()
        centre = projected[rows].mean(axis=0)
        split = False
        if len(rows) * scale > leaf and level < len(ways):
            at = tree.columns(level)
            row, end = tree.parts(projected[rows, at] - centre[at])
            if len(row) < STUCK * len(rows):
                if len(rows) >= 4 * ways[level] or scale <= 1:
                    split = True
                    waiting += [(tree.child(node, int(e)), level + 1, rows[row[end == e]]) for e in np.unique(end)]
                else:
                    left = len(rows) * scale / leaf
                    while left > 1 and level < len(ways):
                        left, level = left * COPIES / (2 * ways[level]), level + 1
                        tree.extra[node] = tree.extra.get(node, 0) + 1
        tree.nodes[node] = (centre, split)
    return tree


def forest(sample: np.ndarray, total: int, seed: int, least: float, leaf: int = LEAF) -> list[Tree]:
    """As many trees as it takes to find a share of GOAL of the pairs at the least similarity.

    The first two trees are tried on the sample: each vector gets a neighbour at that similarity
    in a random direction, and the share of these pairs that meet in a leaf gives the number.
    """
    trees = [plant(sample, total, i, seed, least, leaf) for i in range(2)]
    rng = np.random.default_rng(seed)
    x = sample[rng.permutation(len(sample))[:2000]]
    z = rng.standard_normal(x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    norm = np.linalg.norm(z, axis=1, keepdims=True)
    y = least * x + math.sqrt(1 - least**2) * z / np.maximum(norm, 1e-12)
    met = 0
    for tree in trees:
        of_x, of_y = ({(leaf, int(r)) for leaf, rows in tree.route(side) for r in rows} for side in (x, y))
        met += len({r for _, r in of_x & of_y})
    share = min(max(met / max(1, 2 * len(x)), 0.02), 0.999)
    wanted = min(MOST_TREES, max(1, math.ceil(math.log(1 - GOAL) / math.log(1 - share))))
    return trees[:wanted] + [plant(sample, total, i, seed, least, leaf) for i in range(2, wanted)]


def unit(vectors: pd.Series) -> np.ndarray:
    """Unit vectors in double precision."""
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _compare(key, g: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links between the two sides of a leaf's block that no earlier leaf has.

    (a, null, n): n further vectors linked to a; (a, b, 0): enough links to connect the block.
    """
    leaf, i, j = key
    x = np.frombuffer(b"".join(g["v"])).reshape(len(g), -1)
    ids, weight, side = g["id"].to_numpy(), g["weight"].to_numpy(), g["block"].to_numpy()
    left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
    linked = np.concatenate([x[left[k : k + 1024]] @ x[right].T >= least for k in range(0, len(left), 1024)])
    if i == j:
        np.fill_diagonal(linked, False)
    left, right, linked = (*(side[linked.any(axis=1 - a)] for a, side in enumerate((left, right))), linked[linked.any(axis=1)][:, linked.any(axis=0)])
    if not linked.any():
        return pd.DataFrame({"a": np.zeros(0, dtype=np.int64), "b": np.zeros(0, dtype=np.int64), "n": np.zeros(0, dtype=np.int64)})
    numbers = np.frombuffer(b"".join(g["leaves"]), dtype=np.int64)
    owner = np.repeat(np.arange(len(g)), [len(m) // 8 for m in g["leaves"]])
    earlier = (numbers < leaf) & np.isin(owner, np.concatenate([left, right]))
    column = np.unique(numbers[earlier], return_inverse=True)[1]
    seen = np.zeros((len(g), int(column.max(initial=0)) + 1), dtype=np.float32)
    seen[owner[earlier], column] = 1
    new = linked & (seen[left] @ seen[right].T == 0)
    n = np.zeros(len(g), dtype=np.int64)
    n[left] += new @ weight[right]
    if i != j:
        n[right] += weight[left] @ new
    whole = np.zeros((len(g), len(g)), dtype=bool)
    whole[np.ix_(left, right)] = linked
    edges = np.array(forest_edges(whole | whole.T), dtype=np.int64).reshape(-1, 2)
    counted = np.flatnonzero(n)
    b = pd.array(np.concatenate([np.zeros(len(counted), dtype=np.int64), ids[edges[:, 1]]]), dtype="Int64")
    b[: len(counted)] = pd.NA
    return pd.DataFrame({"a": np.concatenate([ids[counted], ids[edges[:, 0]]]), "b": b, "n": np.concatenate([n[counted], np.zeros(len(edges), dtype=np.int64)])})


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = 0.9, seed: int = 11, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors``.

    Vectors link when their cosine in double precision is at least ``least``. Equal vectors are
    collapsed to one with a weight. A forest of random-projection trees is fitted on a sample of
    at most ``sample`` vectors (the first by a hash of the id); all vectors are routed down every
    tree, to each part that they lie near to. The trees are as deep as the number of vectors
    asks, and as many as ``forest`` finds to be needed. Vectors that share a leaf are compared
    exactly, a link being counted in the first leaf that its two vectors share. Leaves are
    counted over all vectors; a large one (close vectors that no direction parts) is compared in
    blocks of two sides, each block a task of its own; pairs never leave a task.

    The forest finds nearly all links, not surely all; tests measure recall against brute force.
    Null, zero and non-finite vectors, vectors of another length than most, and rows with a null
    id link with nothing (null ids have no component). Repeated rows are separate vectors of one
    node. An empty table stays empty.
    """
    v = F.col(embedding)
    whole = v.isNotNull() & F.col(vec_id).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).alias("id"), v.cast("array<double>").alias("v"), F.coalesce(whole, F.lit(False)).alias("ok"))
    usual = rows.where("ok").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if usual is None:
        none = F.lit(0).cast("long")
        return rows.select(F.col("id").alias(vec_id), none.alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    rows = rows.withColumn("ok", F.col("ok") & (F.size("v") == usual["d"])).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(7), "v"))
    classes = rows.where("ok").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
    reps = rows.where("ok").join(classes, ["h1", "h2"]).where("id = rep").dropDuplicates(["h1", "h2"]).select("id", "v", "weight")
    reps = cut(reps)
    total = reps.count()
    hashed = reps.withColumn("h", F.xxhash64(F.lit(13), "id"))
    chosen = hashed.join(lookup(hashed.select("h").orderBy("h").limit(sample)), "h", "left_semi").select("v").toPandas()["v"]
    trees = reps.sparkSession.sparkContext.broadcast(forest(unit(chosen), total, seed, least, leaf))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                found = [(k, len(r)) for tree in trees.value for k, r in tree.route(unit(b["v"]))]
                yield pd.DataFrame(found, columns=["leaf", "n"])

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = unit(b["v"])
            where = [(k, r) for tree in trees.value for k, r in tree.route(x)]
            row = np.concatenate([r for _, r in where])
            number = np.repeat(np.array([k for k, _ in where], dtype=np.int64), [len(r) for _, r in where])
            by_row = np.argsort(row, kind="stable")
            ends = np.cumsum(np.bincount(row, minlength=len(b)))
            sorted_numbers = number[by_row]
            members, vectors = np.empty(len(b), dtype=object), np.empty(len(b), dtype=object)
            members[:] = [sorted_numbers[s:e].tobytes() for s, e in zip(np.concatenate([[0], ends[:-1]]), ends)]
            vectors[:] = [v.tobytes() for v in x]
            ids, weights = b["id"].to_numpy(), b["weight"].to_numpy()
            for at in range(0, len(row), 20_000):
                r = row[at : at + 20_000]
                yield pd.DataFrame({"leaf": number[at : at + 20_000], "id": ids[r], "v": vectors[r], "weight": weights[r], "leaves": members[r]})

    sizes = reps.select("v").mapInPandas(counted, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n"))
    large = lookup(sizes.where(F.col("n") > SIDE).select("leaf", F.ceil(F.col("n") / SIDE).cast("int").alias("sides")))
    placed = reps.mapInPandas(routed, "leaf long, id long, v binary, weight long, leaves binary").join(large, "leaf", "left").withColumn("sides", F.coalesce("sides", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64(F.lit(3), "id"), F.col("sides")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    blocks = placed.select("leaf", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "v", "weight", "leaves")
    found = cut(blocks.groupBy("leaf", "i", "j").applyInPandas(partial(_compare, least=least), "a long, b long, n long"))
    links = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    copies = rows.where("ok").join(classes.where("weight > 1"), ["h1", "h2"]).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    components = connected_components(found.where("b is not null").select("a", "b").union(copies))
    own = classes.join(links, "rep", "left").select("h1", "h2", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = rows.join(own, ["h1", "h2"], "left").join(components, rows["id"] == components["node"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(vec_id), F.when(F.col("ok"), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))
