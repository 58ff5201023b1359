"""Cross-tokenizer alignment against a plain walk over both tokenizers' byte ranges."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from pitchlake.llm import alignment
from pitchlake.llm.queries import VOCABULARIES

A, B = f"{VOCABULARIES}/byte_bpe_50k.json", f"{VOCABULARIES}/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def plain():
    """Each text's tokens by the libraries that own the files, as (id, bytes)."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    stands_for = alignment.byte_level_alphabet()

    def encoded(text):
        if not text:
            return [], []
        one = [(i, bytes(stands_for[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        two = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        whole = f" {text}".encode()
        return (one, two) if b"".join(t for _, t in one) == whole == b"".join(t for _, t in two) else ([], [])

    return encoded


def walk(one, two):
    """Groups ([ids of A], [ids of B]) by walking along both at once."""
    groups, i, j, at, bt, x, y = [], 0, 0, 0, 0, [], []
    while i < len(one) or j < len(two):
        if at <= bt and i < len(one):
            x.append(one[i][0])
            at += len(one[i][1])
            i += 1
        else:
            y.append(two[j][0])
            bt += len(two[j][1])
            j += 1
        if at == bt and x and y:
            groups.append((x, y))
            x, y = [], []
    return groups


def texts():
    rng = random.Random(4)
    words = ["the", "tokenizer", "Straße", "naïve", "12345", "<|endoftext|>", "<s>", "ﬁn", "İstanbul", "😀", "don't", "x" * 40, "\n\n", "  ", "\t", "日本語", "e\u0301"]
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    return made + [None, "", " ", "a", "▁ is changed", "\x00", "a\r\nb", "x" * 30_000, "ab " * 20_000, made[0], made[0], *["the same"] * 150]


@pytest.mark.parametrize("most", [1_000_000, 20, 1])
def test_rows_are_those_of_a_plain_walk(spark, plain, most):
    rows = [(i if i % 9 else None, t, "z", i) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_A string, other long").repartition(5)
    out = alignment.align(df, A, B, keep_groups=True, most=most)
    assert out.columns == ["doc_id", "other", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    got = {r["other"]: r for r in out.collect()}
    assert len(got) == len(rows)
    every = {i: (pair := plain(t), walk(*pair)) for _, t, _, i in rows}
    count = Counter((x[-1], y[-1]) for _, groups in every.values() for x, y in groups)
    highest = Counter()
    for (_, y), n in count.items():
        highest[y] = max(highest[y], n)
    for i, ((one, two), groups) in every.items():
        r, text = got[i], ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        links = [(x[-1], y[-1]) for x, y in groups]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) == (len(one), len(two), len(groups), len(groups)), rows[i]
        assert r["groups"] == text and r["groups_sha256"] == (hashlib.sha256(text.encode()).hexdigest() if text else "")
        assert r["count_sum"] == sum(count[p] for p in links) and r["n_best"] == sum(count[p] == highest[p[1]] for p in links)
    assert got[154]["n_a"] == 0 and got[157]["n_a"] > 0


def test_an_empty_table_stays_empty(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_shared_ends_are_those_of_a_set():
    rng = np.random.default_rng(1)
    for density in (0.9, 0.5, 0.05):
        a, b, first, last, at = [], [], [], [], 0
        for _ in range(60):
            length = int(rng.integers(1, 400))
            inside = np.arange(at + 1, at + length)
            x, y = (np.append(inside[rng.random(len(inside)) < density], at + length) for _ in range(2))
            first.append(len(a))
            a += x.tolist()
            b += y.tolist()
            last.append(len(a) - 1)
            at += length
        got = alignment.shared_ends(np.array(a), np.array(b), np.array(first), np.array(last))
        assert got.tolist() == [x in set(b) for x in a]


def test_both_libraries_give_the_same_ids_of_a():
    """Of every code point, alone and beside letters, digits, spaces and itself."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(A)
    own.encode_special_tokens = True
    fast = alignment.tokenizers(A, B).a
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 50_000):
        batch = [f"a{c}b {c}{c} 1{c} {c}x{c} !{c}\n" for c in map(chr, points[k : k + 50_000])]
        for i in range(0, len(batch), 50):
            joined = "".join(batch[i : i + 50])
            assert own.encode(joined, add_special_tokens=False).ids == fast.encode_ordinary(joined)
