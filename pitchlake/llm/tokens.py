"""Token counts of a unigram vocabulary by forward scores shared along a trie."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, text_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
START = "▁"  # stands before each word in the vocabulary's pieces


def pieces_of(path: str = MODEL) -> tuple[dict[str, float], float]:
    """Log-probability of each piece, and that of a byte.

    The file ranks its pieces by use; a piece of rank r gets the probability 1 / (r H) of Zipf's
    law, a byte the rank after the last one.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    ranked = sorted(normal, key=lambda i: -sp.get_score(i))
    total = math.log(sum(1 / r for r in range(1, len(ranked) + 2)))
    return {sp.id_to_piece(i): -math.log(r) - total for r, i in enumerate(ranked, 1)}, -math.log(len(ranked) + 1) - total


def forward_counts(words: Sequence[str], pieces: dict[str, float], byte: float) -> list[int]:
    """Tokens of each of the sorted distinct words in its best split into pieces.

    Going through sorted words is a depth-first walk of their trie: the scores of a prefix that
    a word shares with the one before are kept, the others are computed once and replaced. Of
    splits that score the same, the one of fewest tokens counts. A character that is no piece
    costs its UTF-8 bytes.
    """
    longest = max(map(len, pieces), default=1)
    get = pieces.get
    path, best, counts, out = "", [0.0], [0], []
    for word in words:
        shared = 0
        for a, b in zip(path, word):
            if a != b:
                break
            shared += 1
        del best[shared + 1 :], counts[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            last = word[end - 1]
            if get(last) is None:
                n = len(last.encode("utf-8", "surrogatepass"))
                top, fewest = best[end - 1] + n * byte, counts[end - 1] + n
            else:
                top, fewest = -math.inf, 0
            for begin in range(max(0, end - longest), end):
                p = get(word[begin:end])
                if p is not None:
                    s, n = best[begin] + p, counts[begin] + 1
                    if s > top or (s == top and n < fewest):
                        top, fewest = s, n
            best.append(top)
            counts.append(fewest)
        path = word
        out.append(counts[-1])
    return out


def count_tokens(docs: DataFrame, model: str = MODEL, text: str = "text", trie_words: int = 1 << 18) -> DataFrame:
    """``docs`` with ``n_words`` and ``n_tokens`` of every whole text.

    Words are the longest runs without ASCII white space, each a pre-token with a word mark in
    front. A task gathers the distinct pre-tokens of a batch that it has no count for, walks
    their trie once and keeps each terminal's count for later batches; beyond ``trie_words``
    kept counts it starts afresh, so memory is bounded, with the same results. No shuffle.

    Null and empty texts have 0 words and tokens. Rows stay as they are; columns named
    ``n_words`` or ``n_tokens`` are replaced. An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces_of(model))

    @F.pandas_udf("n_words long, n_tokens long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pieces, byte = shared.value
        find, known = re.compile(WORD).findall, {}
        for texts in batches:
            n_words, n_tokens = [], []
            step = 256  # rows at a time
            for at in range(0, len(texts), step):
                split = [find(t) for t in texts.iloc[at : at + step]]
                if len(known) > trie_words:
                    known.clear()
                new = sorted({w for words in split for w in words if w not in known})
                known.update(zip(new, (forward_counts([START + w for w in new], pieces, byte))))
                n_words += map(len, split)
                n_tokens += [sum(map(known.__getitem__, words)) for words in split]
            yield pd.DataFrame({"n_words": n_words, "n_tokens": n_tokens}, dtype="int64")

    kept = [c for c in docs.columns if c.lower() not in ("n_words", "n_tokens")]
    out = docs.select(F.struct(*[docs[f"`{c}`"] for c in kept]).alias("_row"), counted(text_of(text)).alias("_counts"))
    return out.select(*[F.col("_row")[c].alias(c) for c in kept], "_counts.n_words", "_counts.n_tokens")
