"""Operator 11 against the libraries on whole texts, token by token."""

from __future__ import annotations

import collections
import hashlib

import public_tokenizers
import pytest

from riskloom.llm.alignment import Pair, alignment
from riskloom.llm.token_counts import _byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, pairs string, _text string, n_a int"
ODD = [
    None, "", " ", "  ", "a", "a ", " a", "a  b ", "\n", "\n a\t b \n\n  c", "x<|endoftext|> y</s><unk><0x0A>", "▁", "a▁ b", "don't stop  it's", "日本語　テスト です", "é à   b", "tab\t space   em   x\u0085 y", "\x00 z\x1c w",
    "a" * 3000, "word " * 2000, "😀 👩‍👩‍👧 ok", "1 234 567,89", "same text", "same text", "  leading and trailing  ", "　 　x", "a  b  c  d  e  f", "ﬁ ﬀ ℌ ½ Å",
]


def brute(rows):
    """Rows of the contract, and how often each pair of ids is linked."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letter = {c: i for i, c in enumerate(_byte_letters())}
    told, links = [], collections.Counter()
    for doc, text in rows:
        whole = (" " + (text or "")).encode()
        ids = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        of_a = [(i, bytes(letter[c] for c in a.id_to_token(i))) for i in ids]
        of_b = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in (b.encode(text) if text else [])]
        if not text or b"".join(t for _, t in of_a) != whole or b"".join(t for _, t in of_b) != whole:
            told.append((doc, 0, 0, [], ""))
            continue
        ends = []
        for side in (of_a, of_b):
            at, own = 0, {}
            for i, t in side:
                at += len(t)
                own[at] = i
            ends.append(own)
        cuts, groups, last = sorted(ends[0].keys() & ends[1].keys()), [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for e, i in sorted(own.items()) if last < e <= c) for own in ends))
            last = c
        own = [(ends[0][c], ends[1][c]) for c in cuts]
        links.update(own)
        told.append((doc, len(of_a), len(of_b), own, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = collections.Counter()
    for (_, y), n in links.items():
        most[y] = max(most[y], n)
    rows = [(d, n_a, n_b, len(own), len(own), sum(links[p] == most[p[1]] for p in own), sum(links[p] for p in own), sha) for d, n_a, n_b, own, sha in told]
    return collections.Counter(rows), {(x, y, n, n == most[y]) for (x, y), n in links.items()}


@pytest.mark.parametrize("limit", [2_000_000, 300])
def test_alignment(spark, sf_dir, limit):
    odd = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(ODD)] + [(None, "same text", None, None, None), (3, "a  b", "", "", 0)], SCHEMA)
    docs = odd.select("doc_id", "text").unionAll(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(30 if limit < 1000 else 60))
    rows, pairs = brute([(r.doc_id, r.text) for r in docs.collect()])
    out, counts = alignment(docs, A, B, limit)
    assert collections.Counter(map(tuple, out.collect())) == rows
    assert {tuple(r) for r in counts.collect()} == pairs
    if limit > 1000:
        assert alignment(odd, A, B)[0].count() == odd.count()  # other columns don't matter
        assert alignment(odd.limit(0), A, B)[0].count() == 0


def test_segments_give_whole_tokens():
    with open(A) as f, open(B, "rb") as g:
        assert Pair(f.read(), g.read()).cut
