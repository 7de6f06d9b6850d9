"""Alignment of two tokenizers against a brute-force version over whole texts."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest

from threadloom.llm import alignment, pieces
from threadloom.llm.token_counts import byte_alphabet

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, PIECE = "byte_bpe_50k.json", "piece_bpe_32k.model"
ODD = ["a  b", " a", "a ", "  ", "\n", "a\n b", "ﬁ é é x", "a　b  c\t d", "a▁b", "<s> x </s> <|endoftext|> z", "a \n b", "\ta b", "x \n \ny", "one one one\n \n  two", "<0x41> a", "😀 é😀  ñ", "don't  stop ' s", "", None, "w" * 5000 + " tail", "  lead", "a b", "  x  y"]


def spans(parts):
    out, at = [], 0
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def brute(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    one, two = Tokenizer.from_file(public_tokenizers.path(BYTE)), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECE))
    one.encode_special_tokens = True
    to_byte = byte_alphabet()
    docs = []
    for t in texts:
        if not t:
            docs.append(None)
            continue
        coded, b = one.encode(" " + t, add_special_tokens=False), two.encode(t)
        a, names = coded.ids, [two.id_to_piece(i) for i in b]
        a_bytes = [bytes(to_byte[c] for c in token) for token in coded.tokens]
        b_bytes = [bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, names, strict=True)]
        if not b"".join(a_bytes) == (" " + t).encode() == b"".join(b_bytes):
            docs.append(None)
            continue
        sa, sb = spans(a_bytes), spans(b_bytes)
        links, j = [], 0
        for i, (lo, hi) in enumerate(sa):
            while sb[j][1] <= lo:
                j += 1
            k = j
            while k < len(sb) and sb[k][0] < hi:
                links.append((a[i], b[k]))
                k += 1
        both, groups, ga, gb, j = {e for _, e in sa} & {e for _, e in sb}, [], [], [], 0
        for i, (_, e) in zip(a, sa, strict=True):
            ga.append(str(i))
            if e in both:
                while j < len(sb) and sb[j][1] <= e:
                    gb.append(str(b[j]))
                    j += 1
                groups.append(",".join(ga) + "|" + ",".join(gb))
                ga, gb = [], []
        docs.append((len(a), len(b), groups, links))
    count = Counter(p for d in docs if d for p in set(d[3]))
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    return [(len_a, len_b, len(groups), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()) if d else (0, 0, 0, 0, 0, 0, "") for d in docs for len_a, len_b, groups, links in [d or (0, 0, [], [])]]


def aligned(df, **more):
    return alignment.align(df, public_tokenizers.path(BYTE), public_tokenizers.path(PIECE), **more)


@pytest.mark.parametrize("known", [0, 200, alignment.KNOWN])
def test_alignment_against_brute_force(spark, known):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    texts = [r["text"] for r in rows] + ODD + [ODD[0], ODD[0]]
    table = [(i % (len(texts) - 1), t, "x", 7) for i, t in enumerate(texts)]  # one id twice
    df = spark.createDataFrame(table, "doc_id long, text string, h1 string, n int").repartition(3)
    got = sorted(tuple(r) for r in aligned(df, known=known).collect())
    assert got == sorted((i, *want) for (i, *_), want in zip(table, brute(texts), strict=True))


def test_long_texts_come_together_again(spark, monkeypatch):
    monkeypatch.setattr(alignment.pieces, "SLICE", 1 << 10)
    long = " ".join(f"word{i % 50}'s  é 12" for i in range(3000))
    bad = long + " a▁b " + long
    texts = [long, "a b", bad, "a b c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert [tuple(r)[1:] for r in aligned(df).orderBy("doc_id").collect()] == brute(texts)


def test_tables_without_tokens(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert aligned(empty).collect() == []
    none = spark.createDataFrame([(None, None), (1, ""), (None, "▁")], "doc_id long, text string")
    assert sorted((tuple(r) for r in aligned(none).collect()), key=str) == sorted([(None, 0, 0, 0, 0, 0, 0, ""), (1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")], key=str)
    kinds = {f.name: f.dataType.simpleString() for f in aligned(empty).schema}
    assert kinds == {"doc_id": "bigint", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "n_best": "bigint", "count_sum": "bigint", "groups_sha256": "string"}


def test_parts_join_to_whole_texts():
    a = alignment.Aligner(public_tokenizers.path(BYTE), public_tokenizers.path(PIECE), remember=4)  # forgets all the time
    for text in ("a  b cc'd\n \n e  ", "one two  three one two"):
        s = pieces.Slice.of(" " + text)
        rows, bounds = a.parts(s)
        assert bounds.tolist() == [0, len(rows)]
        assert int(a.facts(rows)[0].sum()) == brute([text])[0][0]
