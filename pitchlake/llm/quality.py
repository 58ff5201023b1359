"""Quality by an interpolated modified Kneser-Ney model of characters, trained on trusted text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lookup, shard_count, text_of

ORDER = 4  # characters of the longest n-grams
MOST_BROADCAST = 2_000_000  # n-grams of a model that goes to all tasks; a larger one is joined in shards
MOST_GRAMS = 1 << 20  # different n-grams that a task counts before it passes them on
BLOCK = 1 << 18  # characters that a task works on at a time
PAD = "\x02"  # stands before each text
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _sums(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For each n from 0: a hash of the n characters that end at each place (wrapped at the start)."""
    out = [np.zeros(len(codes), dtype=np.uint64)]
    for n in range(order):
        back = np.roll(codes, n)
        out.append(out[-1] + (back + np.uint64(1)) * _FACTORS[n])
    return out


def _keys(sums: np.ndarray) -> np.ndarray:
    """The hashes spread over all 64 bits; 0 is no key."""
    h = (sums ^ (sums >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return np.where(h == 0, np.uint64(1), h)


def gram_keys(grams: pd.Series) -> np.ndarray:
    """The key of each n-gram (strings of one length)."""
    n = len(grams.iloc[0])
    if n == 0:
        return _keys(np.zeros(len(grams), dtype=np.uint64))
    codes = _codes("".join(grams)).reshape(len(grams), n)
    return _keys(sum((codes[:, n - 1 - j] + np.uint64(1)) * _FACTORS[j] for j in range(n)))


def _blocks(texts: Iterator[str], pad: int) -> Iterator[list[str]]:
    """The texts, each with ``pad`` characters in front, in lists of about BLOCK characters."""
    pieces, size = [], 0
    for t in texts:
        padded = PAD * pad + t
        for at in range(0, len(t), BLOCK):
            pieces.append(padded[at : at + BLOCK + pad])
            size += len(pieces[-1])
            if size > BLOCK:
                yield pieces
                pieces, size = [], 0
    if pieces:
        yield pieces


def count_grams(texts: DataFrame, text: str = "text", order: int = ORDER) -> DataFrame:
    """(gram, n): how often each n-gram of ``order`` characters occurs in all the texts."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, int] = {}
        for pieces in _blocks((t for b in batches for t in b[text]), order - 1):
            whole = "".join(pieces)
            inside = np.ones(len(whole), dtype=bool)
            starts = np.cumsum([0] + [len(p) for p in pieces[:-1]])
            for k in range(order - 1):
                inside[starts + k] = False
            _, first, n = np.unique(_sums(_codes(whole), order)[order][inside], return_index=True, return_counts=True)
            for i, k in zip(np.flatnonzero(inside)[first].tolist(), n.tolist()):
                g = whole[i - order + 1 : i + 1]
                total[g] = total.get(g, 0) + k
            if len(total) > MOST_GRAMS:
                yield pd.DataFrame({"gram": list(total), "n": list(total.values())})
                total.clear()
        if total:
            yield pd.DataFrame({"gram": list(total), "n": list(total.values())})

    grams = texts.select(text_of(text).alias(text)).where(F.length(text) > 0).mapInPandas(counted, "gram string, n long")
    return grams.groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> list[float]:
    """The discounts of counts 1, 2 and 3 or more by the counts of counts."""
    n1, n2, n3, n4 = (x or 0 for x in counts.agg(*[F.sum((F.col("n") == i).cast("long")) for i in (1, 2, 3, 4)]).first())
    if min(n1, n2, n3) == 0:
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.05), i) for i, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]


def kneser_ney(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(n, kind, gram, value): the parts of the interpolated probabilities.

    kind 'a' is an n-gram's own discounted share of its context, kind 'g' what a context leaves
    to the next shorter one. Lower orders count the different characters before an n-gram. The
    contexts' totals are aggregated and joined to the n-grams by context, in shards.
    """
    parts, counts = [], grams
    for n in range(order, 0, -1):
        counts = cut(counts)
        d = discounts(counts)
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        here = counts.withColumn("context", F.expr(f"substring(gram, 1, {n - 1})"))
        contexts = here.groupBy("context").agg(F.sum("n").alias("total"), F.sum(off).alias("left"))
        joined = here.join(contexts, "context") if n > 1 else here.withColumn("total", F.lit(float(contexts.first()["total"] if contexts.count() else 1)))
        parts.append(joined.select(F.lit(n).alias("n"), F.lit("a").alias("kind"), "gram", ((F.col("n") - off) / F.col("total")).alias("value")))
        parts.append(contexts.select(F.lit(n).alias("n"), F.lit("g").alias("kind"), F.col("context").alias("gram"), (F.col("left") / F.col("total")).alias("value")))
        counts = counts.select(F.expr(f"substring(gram, 2, {n - 1})").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def by_key(parts: DataFrame) -> DataFrame:
    """(length, key, own, rest) of ``kneser_ney``'s parts: an n-gram's own share, and what it
    leaves as a context to the next shorter one."""

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (kind, n), g in b.groupby(["kind", b["gram"].str.len()]):
                value, none = g["value"], pd.Series(np.nan, index=g.index)
                yield pd.DataFrame({"length": np.full(len(g), n, dtype=np.int32), "key": gram_keys(g["gram"]).view(np.int64), "own": value if kind == "a" else none, "rest": value if kind == "g" else none})

    table = parts.mapInPandas(keyed, "length int, key long, own double, rest double")
    value = lambda c, empty: F.coalesce(F.max(F.when(~F.isnan(c), F.col(c))), F.lit(empty)).alias(c)
    return table.groupBy("length", "key").agg(value("own", 0.0), value("rest", 1.0))


class Slots:
    """A hash table of n-grams' two values: open addressing, the key itself kept in each slot."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, dtype=np.uint64), np.zeros((1 << bits, 2), dtype=np.float32)
        self.values[:, 1] = 1.0
        waiting, at = np.arange(len(keys)), (keys >> self.shift).astype(np.int64)
        while len(waiting):
            free = np.flatnonzero(self.keys[at[waiting]] == 0)
            slots, first = np.unique(at[waiting[free]], return_index=True)
            placed = waiting[free[first]]
            self.keys[slots], self.values[slots] = keys[placed], values[placed]
            waiting = np.setdiff1d(waiting, placed, assume_unique=True)
            at[waiting] = (at[waiting] + 1) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        """(own, rest) of each key; (0, 1) for an unknown one."""
        at = (keys >> self.shift).astype(np.int64)
        found = self.keys[at]
        waiting = np.flatnonzero((found != keys) & (found != 0))
        while len(waiting):
            at[waiting] = (at[waiting] + 1) & self.mask
            found = self.keys[at[waiting]]
            waiting = waiting[(found != keys[waiting]) & (found != 0)]
        known = self.keys[at] == keys
        out = self.values[at]
        out[~known] = (0.0, 1.0)
        return out


class Model:
    """The values of all n-grams of a trained model, or of those that some texts need."""

    def __init__(self, order: int, length: np.ndarray, keys: np.ndarray, values: np.ndarray, alphabet: int | None = None) -> None:
        """``alphabet``: the number of different characters of the trusted text (of a whole model: counted)."""
        self.order, self.rows = order, (length, keys, values)
        if alphabet is None:
            alphabet = int(((length == 1) & (values[:, 0] > 0)).sum())
        self.floor = 1.0 / (1 + alphabet)  # of the order below single characters: alike for all of them and one never seen
        self.fill()

    def fill(self) -> None:
        length, keys, values = self.rows
        self.slots = [Slots(keys[length == n], values[length == n]) for n in range(self.order + 1)]

    def __getstate__(self) -> dict:
        return {"order": self.order, "rows": self.rows, "floor": self.floor}

    def __setstate__(self, state: dict) -> None:
        self.order, self.rows, self.floor = state["order"], state["rows"], state["floor"]
        self.fill()
        self.rows = ()  # a task needs the slots alone

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        """Natural log of each character's probability after those before it."""
        p = np.full(len(codes), self.floor, dtype=np.float32)
        rest = self.slots[0].get(_keys(np.zeros(1, dtype=np.uint64)))[0, 1]
        for n, sums in enumerate(_sums(codes, self.order)[1:], 1):
            values = self.slots[n].get(_keys(sums))
            p = values[:, 0] + rest * p
            rest = np.roll(values[:, 1], 1)
        return np.log(np.minimum(p, 1.0))

    def perplexities(self, texts: pd.Series) -> np.ndarray:
        """Perplexity per character of each whole text; not a number for an empty one."""
        pad = self.order - 1
        total, length = np.zeros(len(texts)), texts.str.len().to_numpy()
        pieces, owner, size = [], [], 0

        def flush() -> None:
            logs = self.log_probabilities(_codes("".join(pieces)))
            ends = np.cumsum([len(p) for p in pieces])
            sums = np.concatenate([[0.0], np.cumsum(logs, dtype=np.float64)])
            starts = np.concatenate([[0], ends[:-1]]) + pad
            np.add.at(total, owner, sums[ends] - sums[starts])

        for i, t in enumerate(texts):
            padded = PAD * pad + t
            for at in range(0, len(t), BLOCK):
                pieces.append(padded[at : at + BLOCK + pad])
                owner.append(i)
                size += len(pieces[-1])
                if size > BLOCK:
                    flush()
                    pieces, owner, size = [], [], 0
        if pieces:
            flush()
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(length > 0, np.exp(-total / np.maximum(length, 1)), np.nan)


def gathered(table: DataFrame, order: int) -> Model:
    """The whole model of ``by_key`` rows (of a checked number)."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({c: [b[c].to_numpy().astype(t).tobytes()] for c, t in (("length", np.int32), ("key", np.int64), ("own", np.float32), ("rest", np.float32))})

    columns: dict[str, list[np.ndarray]] = {"length": [], "key": [], "own": [], "rest": []}
    for r in table.mapInPandas(packed, "length binary, key binary, own binary, rest binary").toLocalIterator():
        for c, t in (("length", np.int32), ("key", np.uint64), ("own", np.float32), ("rest", np.float32)):
            columns[c].append(np.frombuffer(r[c], dtype=t))
    length, key, own, rest = (np.concatenate([np.zeros(0, dtype=t), *columns[c]]) for c, t in (("length", np.int32), ("key", np.uint64), ("own", np.float32), ("rest", np.float32)))
    return Model(order, length, key, np.stack([own, rest], axis=1))


def with_perplexity(docs: DataFrame, table: DataFrame, text: str, order: int = ORDER, most: int = MOST_BROADCAST) -> DataFrame:
    """``docs`` with ``_p``: perplexity per character of each whole text, null for an empty one.

    A model of at most ``most`` n-grams goes to all tasks. A larger one stays in shards: texts
    are dealt to shards too, the n-grams that a shard of texts holds are joined to the model by
    key, and each shard of texts is scored with its own part. Both give the same numbers.
    """
    if table.count() <= most:
        shared = docs.sparkSession.sparkContext.broadcast(gathered(table, order))

        @F.pandas_udf("double")
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                p = pd.Series(shared.value.perplexities(texts))
                yield p.where(p.notna(), None)

        once = scored.asNondeterministic()  # else a filter on the verdict works it out a second time
        return docs.withColumn("_p", F.when(F.length(text_of(text)) > 0, once(text_of(text))))

    def needed(key, g: pd.DataFrame) -> pd.DataFrame:
        out = [(0, _keys(np.zeros(1, dtype=np.uint64)))]
        for pieces in _blocks(iter(g["t"]), order - 1):
            out += [(n, np.unique(_keys(s))) for n, s in enumerate(_sums(_codes("".join(pieces)), order)[1:], 1)]
        return pd.DataFrame({"length": np.repeat([n for n, _ in out], [len(k) for _, k in out]).astype(np.int32), "key": np.concatenate([k for _, k in out]).view(np.int64), "shard": np.int32(key[0])}).drop_duplicates()

    def scored_shard(key, g: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        m = Model(order, part["length"].to_numpy(), part["key"].to_numpy().view(np.uint64), part[["own", "rest"]].to_numpy().astype(np.float32), alphabet)
        return pd.DataFrame({"h1": g["h1"], "h2": g["h2"], "_p": m.perplexities(g["t"])})

    alphabet = table.where("length = 1 and own > 0").count()
    hashes = [F.xxhash64(text_of(text)).alias("h1"), F.xxhash64(F.lit(2), text_of(text)).alias("h2")]
    texts = docs.select(*hashes, text_of(text).alias("t")).where(F.length("t") > 0).dropDuplicates(["h1", "h2"])
    texts = texts.withColumn("shard", F.pmod("h1", F.lit(shard_count(docs, text))).cast("int"))
    grams = texts.groupBy("shard").applyInPandas(needed, "length int, key long, shard int")
    parts = grams.join(table, ["length", "key"])
    found = texts.groupBy("shard").cogroup(parts.groupBy("shard")).applyInPandas(scored_shard, "h1 long, h2 long, _p double")
    names = docs.columns
    keyed = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("_row"), *hashes)
    return keyed.join(found, ["h1", "h2"], "left").select(*[F.col("_row")[c].alias(c) for c in names], "_p")


def train(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """The model (``by_key``) of the texts of ``docs`` whose id is in ``trusted``: all, no sample."""
    texts = docs.join(lookup(trusted.select(doc_id).distinct()), doc_id, "left_semi")
    return cut(by_key(kneser_ney(count_grams(texts, text, order), order)))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    quantile: float = 0.995,
    slack: float = 1.02,
    prior: int = 80,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    quality: str = "quality",
    most: int = MOST_BROADCAST,
) -> DataFrame:
    """``docs`` with ``perplexity``, ``limit`` and ``accepted``.

    Trusted text is all of ``docs`` labelled 1. Four fifths of it (by crc32 of the id) train the
    model; the rest is held out. As a short text's perplexity varies widely, verdicts are by a
    shrunk one: the mean loss of the text's characters and of ``prior`` more that have the median
    loss of the held-out trusted texts of the language. A language's limit is the ``quantile`` of
    the shrunk perplexities of its held-out trusted texts, times ``slack``. A document is
    accepted when its own is at most the limit (ties are accepted). Languages without held-out
    trusted text, and null ones, get median and limit over all of it; without any, everything
    with a text is accepted. Empty and null texts have no perplexity and are rejected;
    ``perplexity`` is the text's as it is. Null ids are never trusted. Repeated rows are scored
    alike; an empty table stays empty. Columns of the three names are replaced.
    """
    good = labels.where(F.col(quality) == 1).select(F.col(doc_id)).where(F.col(doc_id).isNotNull()).distinct()
    held = F.crc32(F.col(doc_id).cast("string")) % 5 == 4
    model = train(docs, good.where(~held), doc_id, text)
    kept = [c for c in docs.columns if c.lower() not in ("perplexity", "limit", "accepted")]
    check = docs.select(doc_id, F.col(lang).alias("_of"), text).join(lookup(good.where(held)), doc_id, "left_semi").where(F.length(text) > 0)
    check = cut(with_perplexity(check, model, text, most=most).select("_of", F.length(text).alias("_size"), "_p"))
    middle = F.percentile_approx(F.log("_p"), F.lit(0.5), F.lit(10000)).alias("_middle")
    all_middle = check.agg(middle).first()[0]
    middles = lookup(check.where("_of is not null").groupBy(F.col("_of").alias("_lang")).agg(middle), 10_000)

    def shrunk(rows: DataFrame, table: DataFrame) -> DataFrame:
        """``rows`` with the columns of their language and ``_j``, the shrunk perplexity."""
        loss = F.coalesce("_middle", F.lit(all_middle).cast("double"), F.log("_p"))
        joined = rows.join(table, F.col("_of") == F.col("_lang"), "left")
        return joined.withColumn("_j", F.exp((F.log("_p") * F.col("_size") + loss * prior) / (F.col("_size") + prior)))

    at = (F.percentile_approx("_j", F.lit(quantile), F.lit(10000)) * slack).alias("_limit")
    judged = cut(shrunk(check, middles))
    all_limit = judged.agg(at).first()[0]
    limits = lookup(judged.where("_lang is not null").groupBy("_lang", "_middle").agg(at), 10_000)
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in kept]).alias("_row"), F.col(lang).alias("_of"), F.length(text_of(text)).alias("_size"), text_of(text).alias("_text"))
    rows = shrunk(with_perplexity(rows, model, "_text", most=most), limits)
    limit = F.coalesce("_limit", F.lit(all_limit).cast("double"), F.lit(float("inf")))
    accepted = (F.col("_size") > 0) & (F.col("_j") <= limit)
    return rows.select(*[F.col("_row")[c].alias(c) for c in kept], F.col("_p").alias("perplexity"), limit.alias("limit"), accepted.alias("accepted"))
