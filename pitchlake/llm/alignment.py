"""Alignment of two tokenizers' tokens by cutting texts, again and again, at ends that both share."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import cut, joined_by_frequency, text_of

BATCH = 1 << 20  # characters that a task works on at a time
#: Fixed value: the pattern by which the byte-level vocabulary's pre-tokenizer splits texts.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DETAILS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pairs array<long>, times array<int>"
SHIFT = 32  # a pair of ids is one number: id of A times 2^32 and id of B


def byte_level_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes for
    themselves, the others, in order, for characters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers with each token's bytes.

    A's vocabulary file is read and encoded by a library whose ranks are the ids; both libraries
    give the same ids for it (tested with every code point), this one in a quarter of the time.
    """

    def __init__(self, a: str, b: str) -> None:
        import sentencepiece
        import tiktoken

        with open(a, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"] for t in model.get("added_tokens", ())}
        alphabet = byte_level_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        self.a = tiktoken.Encoding("a", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        self.a_size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        self.a_size[list(ranks.values())] = [len(t) for t in ranks]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.b_size = np.array([len(t) for t in self.b_bytes], dtype=np.int64)
        # an id's digits with what follows it: more of its side, the other side, the next group
        self.labels = np.array([f"{i}{mark}" for i in range(max(len(self.a_size), len(self.b_size))) for mark in ",|;"], dtype="S7")

    def encode(self, texts: Sequence[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B for each text with a space in front; none where B changes its bytes."""
        a, b = [self.a.encode_ordinary(" " + t) if t else [] for t in texts], self.b.encode(list(texts), num_threads=1)
        for i, t in enumerate(texts):
            if not t or b"".join(map(self.b_bytes.__getitem__, b[i])) != f" {t}".encode() or self.a_size[a[i]].sum() != len(f" {t}".encode()):
                a[i], b[i] = [], []
        return a, b


@lru_cache(maxsize=2)
def tokenizers(a: str, b: str) -> Tokenizers:
    """The tokenizers of two vocabulary files, read once in a worker."""
    return Tokenizers(a, b)


def shared_ends(a: np.ndarray, b: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each end in ``a``, whether ``b`` (both rising) has it, by divide and conquer.

    ``first``, ``last``: indices in ``a`` of each text's first token and of its last, whose end both
    share. An interval is cut at the shared end next to its middle, which is sought outwards from
    the middle, each candidate by bisection in ``b``; both halves are cut in turn. An interval
    without a shared end inside is a leaf. All intervals of one depth are worked on together.
    """
    shared = np.zeros(len(a), dtype=bool)
    shared[last] = True
    low, high = first, last  # ends low .. high - 1 are inside an interval
    while True:
        some = low < high
        low, high = low[some], high[some]
        if not len(low):
            return shared
        middle, at = (low + high) // 2, np.full(len(low), -1, dtype=np.int64)
        seeking, step = np.arange(len(low)), 0
        while len(seeking):
            for candidate in (middle[seeking] + step, middle[seeking] - step) if step else (middle[seeking],):
                inside = (candidate >= low[seeking]) & (candidate < high[seeking]) & (at[seeking] < 0)
                ends = a[candidate[inside]]
                found = b[np.searchsorted(b, ends)] == ends
                at[seeking[inside][found]] = candidate[inside][found]
            step += 1
            open_ = (at[seeking] < 0) & ((middle[seeking] + step < high[seeking]) | (middle[seeking] - step >= low[seeking]))
            seeking = seeking[open_]
        cuts = np.flatnonzero(at >= 0)
        shared[at[cuts]] = True
        low, high = np.concatenate([low[cuts], at[cuts] + 1]), np.concatenate([at[cuts], high[cuts]])


def _sizes(lists: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter((len(x) for x in lists), dtype=np.int64, count=len(lists))
    return sizes, np.fromiter((i for x in lists for i in x), dtype=np.int64, count=int(sizes.sum()))


def details(texts: Sequence[str], both: Tokenizers, keep_groups: bool) -> list[tuple]:
    """DETAILS of each text."""
    size_a, a = _sizes((ids := both.encode(texts))[0])
    size_b, b = _sizes(ids[1])
    del ids
    out = [(0, 0, 0, 0, "", "", np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32))] * len(texts)
    live = np.flatnonzero(size_a)
    if not len(live):
        return out
    stop_a, stop_b = np.cumsum(size_a[live]), np.cumsum(size_b[live])
    end_a, end_b = np.cumsum(both.a_size[a]), np.cumsum(both.b_size[b])
    shared_a = shared_ends(end_a, end_b, stop_a - size_a[live], stop_a - 1)
    last_a = np.flatnonzero(shared_a)  # of each group
    last_b = np.searchsorted(end_b, end_a[last_a])
    groups = np.searchsorted(last_a, stop_a - 1) + 1  # so many up to each text's end
    # the listing: of each group A's tokens and then B's; a text's last mark goes
    number_a = np.cumsum(shared_a) - shared_a
    start_b = np.concatenate([[0], last_b[:-1] + 1])
    place_a = np.arange(len(a)) + start_b[number_a]
    number_b = np.repeat(np.arange(len(last_b)), np.diff(np.concatenate([[-1], last_b])))
    place_b = np.arange(len(b)) + last_a[number_b] + 1
    labels = np.empty(len(a) + len(b), dtype=np.int64)
    labels[place_a] = 3 * a + shared_a
    labels[place_b] = 3 * b
    labels[place_b[last_b]] += 2
    wide = both.labels[labels].view(np.uint8).reshape(len(labels), -1)
    filled = wide != 0
    listing = wide[filled].tobytes()
    stops = np.cumsum(filled.sum(1))[stop_a + stop_b - 1]
    # pairs of ids by text
    pair = (a[last_a] << SHIFT) | b[last_b]
    group_start = np.concatenate([[0], groups[:-1]])
    owner = np.repeat(np.arange(len(live)), groups - group_start)
    order = np.lexsort((pair, owner))
    pair, owner = pair[order], owner[order]
    new = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (owner[1:] != owner[:-1])]))
    times = np.diff(np.concatenate([new, [len(pair)]])).astype(np.int32)
    pair, bound = pair[new], np.searchsorted(owner[new], np.arange(len(live) + 1))
    begin = 0
    for k, i in enumerate(live.tolist()):
        text = listing[begin : stops[k] - 1]
        begin = int(stops[k])
        n = int(groups[k] - group_start[k])
        own = slice(bound[k], bound[k + 1])
        out[i] = (int(size_a[i]), int(size_b[i]), n, n, hashlib.sha256(text).hexdigest(), text.decode() if keep_groups else None, pair[own], times[own])
    return out


def align(docs: DataFrame, a: str, b: str, keep_groups: bool = False, doc_id: str = "doc_id", text: str = "text", most: int = 1_000_000) -> DataFrame:
    """``docs`` without their texts, with how each text's tokens of A and B correspond.

    ``a``, ``b``: files of a byte-level vocabulary (as JSON) and of a piece model, on every machine.
    Text and a space in front are encoded by both. Byte offsets where tokens of both end cut the
    tokens into groups. At each cut the two tokens that end there are a link; ``n_links`` equals
    ``n_groups``. The corpus-wide count of a pair of ids is over all links of all rows. Columns:
    ``n_a``, ``n_b``, ``n_groups``, ``n_links``; ``n_best`` (links whose count is the highest of their
    B id, ties included), ``count_sum`` (over links); ``groups_sha256`` of ``a1,a2|b1;a3|b2,b3``, which
    is itself in ``groups`` if ``keep_groups``.

    Each row is encoded once: what it needs further, its different pairs and how often it has
    them, is written to the shared folder. Pairs are counted with partial sums by task. Counts
    go back to the rows by the pairs' frequency: the frequent ones, ``most`` at the most, are
    broadcast, the others joined by a shuffle in which no pair is hot.

    Texts that are null, empty, or whose bytes B changes (it turns U+2581 to a space) have no
    tokens: zeros and an empty digest. Repeated rows and null ids are rows of their own. Columns
    of the names above are replaced, others kept. An empty table stays empty.
    """
    added = {"n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"}
    kept = [c for c in docs.columns if c.lower() not in added | {text.lower()}]

    @F.pandas_udf(DETAILS)
    def aligned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        both = tokenizers(a, b)
        names = [c.split()[0] for c in DETAILS.split(", ")]
        for texts in batches:
            number, different = pd.factorize(texts)  # equal texts of a batch are encoded once
            rows, waiting, size = [], [], 0
            for t in different:
                waiting.append(t)
                size += len(t)
                if size > BATCH:
                    rows += details(waiting, both, keep_groups)
                    waiting, size = [], 0
            rows += details(waiting, both, keep_groups)
            yield pd.DataFrame([rows[i] for i in number], columns=names)

    row = F.struct(*[docs[f"`{c}`"] for c in kept])
    found = written(docs.select(F.monotonically_increasing_id().alias("_id"), row.alias("_row"), aligned(text_of(text)).alias("d")))
    found = found.select("_id", "_row", "d.*")
    pairs = found.select("_id", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("_id", F.col("p.pairs").alias("pair"), F.col("p.times").alias("n"))
    counts = cut(pairs.groupBy("pair").agg(F.sum("n").alias("count"), F.count("*").alias("rows")))
    highest = counts.groupBy(F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1)).alias("b")).agg(F.max("count").alias("highest"))
    known = counts.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1))).join(highest, "b")
    known = cut(known.select("pair", "count", (F.col("count") == F.col("highest")).alias("best"), "rows"))
    sums = joined_by_frequency(pairs, known, "pair", "rows", most).groupBy("_id").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = found.join(sums, "_id", "left")
    more = ["groups"] if keep_groups else []
    return out.select(*[F.col("_row")[c].alias(c) for c in kept], "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256", *more)
