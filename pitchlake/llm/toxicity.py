"""Toxic spans and scores by a linear-chain conditional random field."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of

BITS = 18  # places of the feature weights
NONE = 1 << BITS  # the place of no feature, whose weight stays 0
TOKENS = re.compile(r"\S+")  # what str.split() gives, with places
_EDGES = re.compile(r"^\W+|\W+$")


def features_of(word: str) -> list[int]:
    """Places of a token's features: the word without its edges' signs, its beginnings, its end."""
    w = _EDGES.sub("", word.lower())
    named = ["w" + w, "4" + w[:4] if len(w) > 4 else "", "6" + w[:6] if len(w) > 6 else "", "8" + w[:8] if len(w) > 8 else "", "e" + w[-3:]]
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for n in named if n]


class Field:
    """A chain of the tags clean and toxic: feature weights, a bias and transition scores."""

    def __init__(self) -> None:
        self.weights = np.zeros(NONE + 2)  # the last is the bias
        self.moves = np.zeros((2, 2))
        self.scale = np.array([-2.0, 1.0, 0.0])  # of the document score

    def emissions(self, places: np.ndarray) -> np.ndarray:
        """Scores of the tag toxic against clean at tokens, by rows of the places of features."""
        return self.weights[-1] + self.weights[places].sum(axis=1)


class Tokens(dict):
    """Numbers of different tokens in order of appearance, with the places of their features."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[int]] = []

    def __missing__(self, word: str) -> int:
        places = features_of(word)
        self.rows.append(places + [NONE] * (5 - len(places)))
        self[word] = n = len(self.rows) - 1
        return n

    def of(self, split: list[list[str]]) -> np.ndarray:
        """The tokens' numbers, one text after the other."""
        return np.fromiter(map(self.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=sum(map(len, split)))

    def places(self) -> np.ndarray:
        return np.array(self.rows, dtype=np.int64).reshape(-1, 5)


class Emissions:
    """Emission scores by token, worked out once for each kept token; at most ``most`` are kept."""

    def __init__(self, field: Field, most: int = 1 << 18) -> None:
        self.field, self.most = field, most
        self.tokens, self.scores = Tokens(), np.zeros(0)

    def of(self, split: list[list[str]]) -> np.ndarray:
        """The tokens' emissions, one text after the other."""
        if len(self.tokens) > self.most:
            self.tokens, self.scores = Tokens(), np.zeros(0)
        numbers = self.tokens.of(split)
        new = self.tokens.rows[len(self.scores) :]
        if new:
            self.scores = np.concatenate([self.scores, self.field.emissions(np.array(new, dtype=np.int64))])
        return self.scores[numbers]


def _chained(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, size: int = 64) -> np.ndarray:
    """Log odds of the tag toxic at each token given the tokens up to it.

    A step multiplies the pair (toxic, clean) by a 2 x 2 matrix. Texts are cut into runs of
    ``size`` tokens whose products are worked out side by side; a text's runs are then chained,
    and a second pass fills in the tokens. So a long text takes few steps, with the same result.
    """
    out = np.empty(len(scores))
    e, m = np.exp(np.clip(scores, -60, 60)), np.exp(moves - moves.max())
    runs = -(-lengths // size)
    if not runs.sum():
        return out
    first = np.cumsum(runs) - runs
    number = np.arange(runs.sum()) - np.repeat(first, runs)  # of a run in its text
    begin = np.repeat(np.cumsum(lengths) - lengths, runs) + size * number
    length = np.minimum(size, np.repeat(np.cumsum(lengths), runs) - begin)
    order = np.argsort(-length, kind="stable")
    active = np.searchsorted(-length[order], -np.arange(size), side="left")  # runs longer than t
    head = number == 0

    def step(t: int, toxic: np.ndarray, clean: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = e[begin[at] + t]
        a, b = x * (m[0, 1] * clean + m[1, 1] * toxic), m[0, 0] * clean + m[1, 0] * toxic
        if t == 0:
            a, b = np.where(head[at], x, a), np.where(head[at], 1.0, b)
        return a, b

    columns = [(np.ones(len(begin)), np.zeros(len(begin))), (np.zeros(len(begin)), np.ones(len(begin)))]
    if runs.max() > 1:
        for t in range(int(active.astype(bool).sum())):
            at = order[: active[t]]
            got = [step(t, toxic[at], clean[at], at) for toxic, clean in columns]
            scale = sum(a + b for a, b in got)
            for (toxic, clean), (a, b) in zip(columns, got):
                toxic[at], clean[at] = a / scale, b / scale
    toxic, clean = np.full(len(begin), 0.5), np.full(len(begin), 0.5)  # before each run
    texts = np.argsort(-runs, kind="stable")
    for k in range(1, int(runs.max())):
        at = first[texts[: np.searchsorted(-runs[texts], -k, side="left")]] + k  # texts of more than k runs
        a = columns[0][0][at - 1] * toxic[at - 1] + columns[1][0][at - 1] * clean[at - 1]
        b = columns[0][1][at - 1] * toxic[at - 1] + columns[1][1][at - 1] * clean[at - 1]
        toxic[at], clean[at] = a / (a + b), b / (a + b)
    for t in range(int(active.astype(bool).sum())):
        at = order[: active[t]]
        a, b = step(t, toxic[at], clean[at], at)
        toxic[at], clean[at] = a / (a + b), b / (a + b)
        out[begin[at] + t] = np.log(a) - np.log(b)
    return out


def forward_backward(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log odds of toxic before, with and after each token of all the texts side by side.

    ``scores``: the texts' emissions one after the other. Returns the forward log odds, the
    backward ones, and the marginals of the tag toxic.
    """
    forward = _chained(scores, lengths, moves)
    backward = _chained(scores[::-1], lengths[::-1], moves.T)[::-1] - np.clip(scores, -60, 60)
    with np.errstate(over="ignore"):
        return forward, backward, 1.0 / (1.0 + np.exp(-(forward + backward)))


def summaries(marginals: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(highest marginal, log of 1 + expected toxic tokens) of each text; zeros for an empty one."""
    out = np.zeros((len(lengths), 2))
    full = lengths > 0
    if full.any():
        starts = (np.cumsum(lengths) - lengths)[full]
        out[full, 0] = np.maximum.reduceat(marginals, starts)
        out[full, 1] = np.log1p(np.add.reduceat(marginals, starts))
    return out


def _gradient(split: list[list[str]], toxic: np.ndarray, marks: np.ndarray, field: Field) -> np.ndarray:
    """Gradient of the log-likelihood of texts: weights, none's place and bias, then the four moves.

    A token's tag is toxic where its text is and ``marks`` has one of its features.
    """
    n = len(field.weights)
    out = np.zeros(n + 4)
    tokens = Tokens()
    numbers = tokens.of(split)
    places = tokens.places()
    lengths = np.array([len(w) for w in split], dtype=np.int64)
    scores = field.emissions(places)[numbers]
    tags = (marks[places].any(axis=1)[numbers] & np.repeat(toxic.astype(bool), lengths)).astype(np.float64)
    forward, backward, marginals = forward_backward(scores, lengths, field.moves)
    error = tags - marginals
    by_token = np.bincount(numbers, weights=error, minlength=len(places))
    out[:n] = np.bincount(places.reshape(-1), weights=np.repeat(by_token, 5), minlength=n)
    out[NONE], out[n - 1] = 0.0, error.sum()
    starts = np.cumsum(lengths) - lengths
    second = np.ones(len(scores), dtype=bool)
    second[starts[lengths > 0]] = False
    at = np.flatnonzero(second)  # tokens with one before
    logs = np.stack([np.zeros(len(at)), forward[at - 1]])[:, None, :] + field.moves[:, :, None] + np.stack([np.zeros(len(at)), scores[at] + backward[at]])[None, :, :]
    logs -= logs.max(axis=(0, 1))
    p = np.exp(logs)
    p /= p.sum(axis=(0, 1))
    for a in (0, 1):
        for b in (0, 1):
            out[n + 2 * a + b] = np.sum((tags[at - 1] == a) & (tags[at] == b)) - p[a, b].sum()
    return out


def train(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, toxic: str, most: int, rounds: int, seen: int = 4, parts: int = 8) -> Field:
    """A field learnt from at most ``most`` toxic and twice as many clean labelled documents.

    The sample is the first by a hash of the id; of an id's texts the first by a hash is taken.
    Only the sample's texts move. Token labels: a token is toxic where its document is and one
    of its features occurs in ``seen`` or more sampled documents, all but a tenth of them toxic.
    Each round adds up the gradients of ``parts`` parts and takes an adaptive step; at the end a
    logistic fit turns the sample's summaries into document scores.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(toxic).isin(0, 1)).groupBy(doc_id).agg(F.max(toxic).alias("_toxic"))
    order = F.xxhash64(F.lit(5), F.col(doc_id).cast("string"))
    first = lambda y, n: known.where(F.col("_toxic") == y).orderBy(order, doc_id).limit(n)
    chosen = cut(first(1, most).union(first(0, 2 * most)))  # so few that they are broadcast
    found = docs.select(doc_id, text_of(text).alias("_text")).join(F.broadcast(chosen), doc_id)
    one = found.groupBy(doc_id).agg(F.min_by(F.struct("_text", "_toxic"), F.struct(F.xxhash64("_text"), "_text")).alias("_one"))
    sample = cut(one.select("_one.*").repartition(parts))
    field = Field()

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, n, bad = Tokens(), np.zeros(NONE + 1, dtype=np.int64), np.zeros(NONE + 1, dtype=np.int64)
        for b in batches:
            for t, y in zip(b["_text"], b["_toxic"]):
                numbers = np.unique(tokens.of([t.split()]))
                own = np.unique(np.array([tokens.rows[k] for k in numbers], dtype=np.int64))
                n[own] += 1
                bad[own] += y
        at = np.flatnonzero(n[:NONE])
        yield pd.DataFrame({"f": at, "n": n[at], "y": bad[at]})

    counts = sample.mapInPandas(features, "f long, n long, y long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    marks = np.zeros(NONE + 1, dtype=bool)
    marks[[r["f"] for r in counts.where((F.col("y") >= seen) & (F.col("y") >= 0.9 * F.col("n"))).select("f").collect()]] = True  # at most 2**BITS

    def step_over(now: Field):
        def gradients(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(len(now.weights) + 4)
            for b in batches:
                for at in range(0, len(b), 500):
                    total += _gradient([t.split() for t in b["_text"].iloc[at : at + 500]], b["_toxic"].to_numpy()[at : at + 500], marks, now)
            places = np.flatnonzero(total).astype(np.int32)
            yield pd.DataFrame({"places": [places.tobytes()], "values": [total[places].tobytes()]})

        return sample.mapInPandas(gradients, "places binary, values binary")

    squares = np.full(len(field.weights) + 4, 1e-2)
    for _ in range(rounds):
        total = np.zeros(len(squares))
        for r in step_over(field).collect():  # one row of bounded size for each part
            total[np.frombuffer(r["places"], dtype=np.int32)] += np.frombuffer(r["values"])
        total[:NONE] -= 0.05 * field.weights[:NONE]
        squares += total**2
        step = 0.7 * total / np.sqrt(squares)
        field.weights += step[:-4]
        field.moves += step[-4:].reshape(2, 2)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        emissions = Emissions(field)
        for b in batches:
            split = [t.split() for t in b["_text"]]
            lengths = np.array([len(w) for w in split], dtype=np.int64)
            x = summaries(forward_backward(emissions.of(split), lengths, field.moves)[2], lengths)
            yield pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": b["_toxic"].astype("int64").to_numpy()})

    fit = sample.mapInPandas(summed, "a double, b double, y long").toPandas()  # at most 3 * most rows of three numbers
    if fit["y"].nunique() == 2:
        x, y = np.column_stack([np.ones(len(fit)), fit["a"], fit["b"]]), fit["y"].to_numpy()
        w = np.zeros(3)
        for _ in range(30):
            p = 1 / (1 + np.exp(-x @ w))
            w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(3), x.T @ (y - p) - 0.5 * w)
        field.scale = w
    return field


def tag(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", most: int = 1500, rounds: int = 10) -> DataFrame:
    """``docs`` with ``held_out``, ``score``, ``predicted`` and ``toxic_spans``.

    The field learns only from labelled rows whose crc32(doc_id as text) mod 5 is not 0, and
    from a bounded sample of them (``most``, see ``train``); ``held_out`` marks remainder 0
    (false for a null id). Scores depend on the whole text alone. ``score`` (0 to 1) is a
    logistic function of the highest marginal and the expected number of toxic tokens;
    ``predicted`` is 1 from 0.5 on. ``toxic_spans``: 'start:end' in code points of the tokens
    whose marginal is 0.5 or more, comma-joined.

    Null and empty texts score as texts without tokens. Without labels every text gets the same
    low score. Repeated rows score alike; an empty table stays empty; columns of the four names
    are replaced.
    """
    held = F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))
    field = train(docs, labels.where(~held), doc_id, text, toxic, most, rounds)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf("score double, spans string")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        field = shared.value
        emissions = Emissions(field)
        for texts in batches:
            scores_out, spans_out = [], []
            for at in range(0, len(texts), 2000):
                part = texts.iloc[at : at + 2000]
                split = [t.split() for t in part]
                lengths = np.array([len(w) for w in split], dtype=np.int64)
                marginals = forward_backward(emissions.of(split), lengths, field.moves)[2]
                z = field.scale[0] + summaries(marginals, lengths) @ field.scale[1:]
                scores_out += [1 / (1 + math.exp(-max(-60.0, min(60.0, v)))) for v in z]
                spans = [""] * len(split)
                hits = np.flatnonzero(marginals >= 0.5)
                ends = np.cumsum(lengths)
                owners = np.searchsorted(ends, hits, side="right")
                for i in np.unique(owners):
                    wanted = set((hits[owners == i] - (ends[i] - lengths[i])).tolist())
                    spans[i] = ",".join(f"{m.start()}:{m.end()}" for k, m in enumerate(TOKENS.finditer(part.iloc[i])) if k in wanted)
                spans_out += spans
            yield pd.DataFrame({"score": scores_out, "spans": spans_out})

    names = ("held_out", "score", "predicted", "toxic_spans")
    kept = [c for c in docs.columns if c.lower() not in names]
    out = docs.select(F.struct(*[docs[f"`{c}`"] for c in kept]).alias("_row"), held.alias("held_out"), scored(text_of(text)).alias("_s"))
    return out.select(*[F.col("_row")[c].alias(c) for c in kept], "held_out", "_s.score", (F.col("_s.score") >= 0.5).cast("int").alias("predicted"), F.col("_s.spans").alias("toxic_spans"))
