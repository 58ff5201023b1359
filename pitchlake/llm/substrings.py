"""Removal of passages that repeat across or within documents, by phrase automata."""

from __future__ import annotations

import hashlib
from functools import partial

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .common import shard_count, text_of

_SIGNS = 96  # automata read a word as three characters of this alphabet
_NULLS = 1 << 62  # places of documents without an id, after all others


def _load(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[list[bytes]]]:
    """A shard's documents in order, and their words."""
    pdf = pdf.sort_values(["place", "text"], kind="stable").reset_index(drop=True)
    return pdf, [words.split(t) for t in pdf["text"]]


def _hashed(split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words one document after the other, the documents' starts and sizes."""
    known = words.WordHashes(1 << 22)
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    hashes = np.concatenate([known.of(w) for w in split]) if len(split) else np.zeros(0, dtype=np.uint64)
    return hashes, np.cumsum(sizes) - sizes, sizes


def _inside(starts: np.ndarray, sizes: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of the n places start a run of ``length`` words within one document."""
    room = np.zeros(n + 1, dtype=np.int64)
    fits = sizes >= length
    room[starts[fits]] += 1
    np.add.at(room, starts[fits] + sizes[fits] - length + 1, -1)
    return np.cumsum(room)[:n] > 0


def _anchors(hashes: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the phrase at each place, and the place of each window's least phrase."""
    values = words.runs(hashes, phrase)
    return values, words.least_places(values, window - phrase + 1)


def _phrases(key, pdf: pd.DataFrame, window: int, phrase: int) -> pd.DataFrame:
    """A shard's anchor phrases and how often each occurs in it."""
    _, split = _load(pdf)
    hashes, starts, sizes = _hashed(split)
    values, places = _anchors(hashes, window, phrase)
    ok = _inside(starts, sizes, window, len(hashes))[: len(places)]
    found, n = np.unique(values[np.unique(places[ok])], return_counts=True)
    return pd.DataFrame({"phrase": found.astype(np.int64), "shard": np.int32(key[0]), "n": n.astype(np.int32)})


def _occurrences(split: list[list[bytes]], at: np.ndarray, size: int) -> np.ndarray:
    """Places of every occurrence of the phrases that stand at places ``at``.

    The phrases are compiled into an Aho-Corasick automaton and all documents of the shard are
    streamed through it, a word being three characters.
    """
    flat = [w for part in split for w in part]
    codes: dict[bytes, str] = {}
    for w in flat:
        if w not in codes:
            i = len(codes)
            codes[w] = chr(48 + i % _SIGNS) + chr(48 + i // _SIGNS % _SIGNS) + chr(48 + i // _SIGNS**2)
    auto = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    coded = [codes[w] for w in flat]
    for p in at:
        auto.add_word("".join(coded[p : p + size]))
    auto.make_automaton()
    out, base, length = [], 0, 3 * size
    for part in split:
        if len(part) >= size:
            ends = [e for e, _ in auto.iter("".join(coded[base : base + len(part)]))]
            out += [base + (e + 1 - length) // 3 for e in ends if (e + 1) % 3 == 0]
        base += len(part)
    return np.array(out, dtype=np.int64)


def _windows(key, docs: pd.DataFrame, phrases: pd.DataFrame, window: int, phrase: int) -> pd.DataFrame:
    """A shard's windows that may recur elsewhere, the first of each (run 0); and the runs of
    windows that occur earlier in the shard itself (run: how many)."""
    names = ["w", "c", "place", "shard", "doc", "start", "run"]
    docs, split = _load(docs)
    hashes, starts, sizes = _hashed(split)
    values, places = _anchors(hashes, window, phrase)
    ok = _inside(starts, sizes, window, len(hashes))[: len(places)]
    recurring = np.isin(values, phrases["phrase"].to_numpy().astype(np.uint64)) if len(phrases) else np.zeros(len(values), dtype=bool)
    hit = places[ok & recurring[places]] if len(places) else places
    if not len(hit):
        return pd.DataFrame({n: np.zeros(0, dtype=np.int64) for n in names})
    _, first = np.unique(values[hit], return_index=True)
    located = np.zeros(len(values) + 1, dtype=bool)
    located[_occurrences(split, hit[first], phrase)] = True
    at = np.flatnonzero(ok & located[places])
    w = words.runs(hashes, window)[at].astype(np.int64)
    c = (words.runs(hashes, window, np.uint64(0xC2B2AE3D27D4EB4F))[at] >> np.uint64(33)).astype(np.int32)
    del values, hashes
    order = np.lexsort((at, c, w))
    new = np.ones(len(at), dtype=bool)
    new[1:] = (w[order][1:] != w[order][:-1]) | (c[order][1:] != c[order][:-1])
    first = np.zeros(len(at), dtype=bool)
    first[order[new]] = True
    doc = np.searchsorted(starts + sizes, at, side="right")
    start = at - starts[doc]
    rows = pd.DataFrame({"w": w[first], "c": c[first], "place": docs["place"].to_numpy()[doc[first]], "shard": np.int32(key[0]), "doc": doc[first].astype(np.int32), "start": start[first].astype(np.int32), "run": np.int32(0)})
    again = np.flatnonzero(~first)
    if len(again):
        breaks = np.flatnonzero((np.diff(at[again]) != 1) | (np.diff(doc[again]) != 0)) + 1
        heads = again[np.concatenate([[0], breaks])]
        run = np.diff(np.concatenate([[0], breaks, [len(again)]]))
        spread = np.arange(len(heads)) * np.int64(0x9E3779B97F4A7C1) + key[0]
        more = pd.DataFrame({"w": spread, "c": np.int32(-1), "place": np.int64(0), "shard": np.int32(key[0]), "doc": doc[heads].astype(np.int32), "start": start[heads].astype(np.int32), "run": run.astype(np.int32)})
        rows = pd.concat([rows, more])
    return rows


def _kept(key, docs: pd.DataFrame, gone: pd.DataFrame, window: int) -> pd.DataFrame:
    """The shard's documents without the words that the windows in ``gone`` cover."""
    docs, split = _load(docs)
    by_doc = {d: g for d, g in gone.groupby("doc")[["start", "run"]]} if len(gone) else {}
    texts, n_removed = [], []
    for i, ws in enumerate(split):
        g = by_doc.get(i)
        if g is not None:
            cover = np.zeros(len(ws) + 1, dtype=np.int64)
            np.add.at(cover, g["start"].to_numpy(), 1)
            np.add.at(cover, g["start"].to_numpy() + np.maximum(g["run"].to_numpy(), 1) + window - 1, -1)
            stays = np.cumsum(cover)[:-1] == 0
            kept = [w for w, s in zip(ws, stays) if s]
        else:
            kept = ws
        texts.append(b" ".join(kept))
        n_removed.append(len(ws) - len(kept))
    out = {"doc_id": docs["doc_id"], "n_words": [len(w) for w in split], "n_removed": n_removed}
    return pd.DataFrame(out | {"kept_text": [t.decode("utf-8", "surrogatepass") for t in texts], "kept_sha256": [hashlib.sha256(t).hexdigest() for t in texts]})


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 20, phrase: int = 10, shard_mb: int = 8) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, kept_sha256): each document without its repeats.

    Words are runs without ASCII white space. A word goes if it lies in a window of ``window``
    consecutive words whose sequence also starts earlier: in a document of smaller id, or
    earlier in the same one. Windows are judged on the input.

    How: documents are dealt to shards of about ``shard_mb`` MB by their id. Every window has
    an anchor, the least by hash of its ``phrase``-word phrases, so equal windows have equal
    anchors. Anchors that occur twice or more in the corpus are the recurring phrases. Each
    shard compiles its recurring phrases into an Aho-Corasick automaton and streams its
    documents through it to locate every occurrence; windows anchored at one are candidates.
    A shard keeps the first of equal candidates, so a passage that a third of all documents
    share leaves it once; the first over all shards is then decided by (window, check hash of
    31 more bits), with at most one row for each shard.

    Null and empty texts have no words. Null ids come after all others, in the order of a hash
    of their texts; rows of equal id are put in the order of their texts, equal rows in any
    order. Texts with fewer than ``window`` words stay. An empty table stays empty.
    """
    shards = shard_count(docs, text, shard_mb)
    t = text_of(text)
    place = F.coalesce(F.col(doc_id).cast("long"), F.lit(_NULLS) + F.pmod(F.xxhash64(t), F.lit(_NULLS)))
    dealt = docs.select(F.col(doc_id).alias("doc_id"), t.alias("text"), place.alias("place"), F.pmod(F.xxhash64(place), F.lit(shards)).cast("int").alias("shard"))
    by_shard = dealt.groupBy("shard")
    phrases = by_shard.applyInPandas(partial(_phrases, window=window, phrase=phrase), "phrase long, shard int, n int")
    phrases = phrases.withColumn("all", F.sum("n").over(Window.partitionBy("phrase"))).where("all > 1").select("shard", "phrase")
    found = by_shard.cogroup(phrases.groupBy("shard")).applyInPandas(partial(_windows, window=window, phrase=phrase), "w long, c int, place long, shard int, doc int, start int, run int")
    order = Window.partitionBy("w", "c").orderBy("place", "doc", "start")
    gone = found.withColumn("rank", F.row_number().over(order)).where("run > 0 or rank > 1").select("shard", "doc", "start", "run")
    kind = dict(dealt.dtypes)["doc_id"]
    return by_shard.cogroup(gone.groupBy("shard")).applyInPandas(partial(_kept, window=window), f"doc_id {kind}, n_words long, n_removed long, kept_text string, kept_sha256 string")
