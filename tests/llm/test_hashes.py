"""Words that a polynomial modulo 2**64 cannot tell apart, and hashes that are forced to collide."""

from __future__ import annotations

import numpy as np
import pytest

from threadloom.llm import common, near, packing, pieces, quality, substrings, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")


def mirrored(n: int, letters: str = "ab") -> tuple[str, str]:
    """A Thue-Morse word of n letters and the one with its letters swapped."""
    one = "".join(letters[bin(i).count("1") % 2] for i in range(n))
    return one, one.translate(str.maketrans(letters, letters[::-1]))


SIZES = [1024, 2048, 65536]


@pytest.mark.parametrize("n", SIZES)
@pytest.mark.parametrize("other", [False, True])
def test_words_differ(n, other):
    one, two = mirrored(n)
    raw = np.frombuffer(f"{one} {two} {one}".encode(), np.uint8)
    h = common.Words(raw, np.asarray([0, len(raw)])).hashes(other)
    assert h[0] == h[2] != h[1]


def test_equal_words_hash_alike_wherever_they_stand():
    rng = np.random.default_rng(5)
    data = rng.choice(np.frombuffer(b"ab \n", np.uint8), 4000, p=[0.45, 0.45, 0.05, 0.05])
    w = common.Words(data, np.asarray([0, 1500, 4000]))
    for other in (False, True):
        seen: dict[bytes, int] = {}
        for a, b, h in zip(w.starts.tolist(), w.ends.tolist(), w.hashes(other).tolist(), strict=True):
            assert seen.setdefault(data[a:b].tobytes(), h) == h
        assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("n", SIZES)
def test_tokens_are_the_librarys(n):
    from tokenizers import Tokenizer

    byte, word = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
    library, counter, coder = Tokenizer.from_file(byte), token_counts.PrefixCounter(byte), packing.Encoder(word)
    for letters in ("ab", "th"):
        for text in mirrored(n, letters):
            s = pieces.Slice.of(text)
            assert counter.counts(s).tolist() == [len(library.encode(text, add_special_tokens=False).ids)]
            assert coder.ids(s)[0].tolist() == coder.model.encode(text, add_special_tokens=False).ids


def test_pieces_of_one_hash_are_told_apart(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(common, "span_hash", lambda values, starts, ends, other=False, raw=None: (ends - starts).astype(np.uint64) % np.uint64(3))
    byte, word = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
    library, counter, coder = Tokenizer.from_file(byte), token_counts.PrefixCounter(byte), packing.Encoder(word)
    for text in ("the cat sat on the mat, the dog didn't: é 😀 12 cats", "cat the tab mat", "some other words of the same sizes, the cat"):
        s = pieces.Slice.of(text)
        for _ in range(2):
            assert counter.counts(s).tolist() == [len(library.encode(text, add_special_tokens=False).ids)]
            assert coder.ids(s)[0].tolist() == coder.model.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", SIZES)
def test_documents_of_mirrored_words(spark, n):
    one, two = mirrored(n)
    filler = [f"w{i}" for i in range(19)]
    rows = [(1, " ".join([one, *filler])), (2, " ".join([two, *filler])), (3, f"{one}\n{two}\n{one}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source")
    assert {r["doc_id"]: r["n_removed"] for r in substrings.dedup_substrings(docs.filter("doc_id < 3")).collect()} == {1: 0, 2: 0}
    apart = spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id long, text string")
    assert {(r["doc_id"], r["class_id"], r["n_links"]) for r in near.near_classes(apart).collect()} == {(1, 1, 1), (2, 2, 0), (3, 1, 1)}
    assert {r["doc_id"]: r["n_dup_lines"] for r in quality.statistics(docs).collect()}[3] == 1
