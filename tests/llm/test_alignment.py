"""Alignment of two tokenizers against a plain walk over bytes."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from pathlib import Path

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from common_llm import documents
from shopledger.llm.alignment import Aligner, aligned
from shopledger.llm.common import table

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    (1, None), (1, ""), (2, "Hello world, hello  worlds"), (None, "Hello world, hello  worlds"), (3, " two  blanks \n\nand lines \t"),
    (4, "naïve café über straße 日本語 😀 é"), (5, "a▁b c"), (6, "zero\0byte here"), (7, "<|endoftext|> <s> </s> <0x41>"), (8, "don't it's 12345 3.14!"),
    (9, "x" * 5000), (10, ("the word of the day is " * 3000).strip()), (11, "   "), (12, " nbsp em \x1c."), (13, "ends in blank "), (14, "."),
]


def decoded(token):
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in visible]
    letters = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}
    return bytes(letters[c] for c in token)


def plain(texts):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    each, counts = [], Counter()
    for doc_id, text in texts:
        if not text:
            each.append((doc_id, None, []))
            continue
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        pieces = [b.id_to_piece(i) for i in ids_b]
        bytes_a = [decoded(a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes.fromhex(p[3:5]) if len(p) == 6 and p[:3] == "<0x" else p.replace("▁", " ").encode() for p in pieces]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            each.append((doc_id, None, []))
            continue
        groups, i, j, end_a, end_b, own, other = [], 0, 0, 0, 0, [], []
        while i < len(ids_a) or j < len(ids_b):
            if end_a <= end_b and i < len(ids_a):
                own.append(ids_a[i])
                end_a += len(bytes_a[i])
                i += 1
            else:
                other.append(ids_b[j])
                end_b += len(bytes_b[j])
                j += 1
            if end_a == end_b:
                groups.append((own, other))
                own, other = [], []
        links = [(x, y) for own, other in groups for x in own for y in other]
        counts.update(set(links))
        each.append((doc_id, (len(ids_a), len(ids_b), groups), links))
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for doc_id, found, links in each:
        if found is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups = found
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        best = sum(counts[link] == most[link[0]] for link in links)
        out.append((doc_id, n_a, n_b, len(groups), len(links), best, sum(counts[link] for link in links), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df, **parameters):
    names = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    return sorted((tuple(r) for r in aligned(df, A, B, **parameters).select(names).collect()), key=str)


@pytest.mark.parametrize("most", [1 << 20, 8, 0])
def test_equals_plain_walk(spark, most):
    assert found(documents(spark, TEXTS, True), most=most) == plain(TEXTS)


def test_given_documents(spark):
    df = table(spark, "/root/testdata/sf0.001", "documents")
    assert found(df, most=500) == plain([(r.doc_id, r.text) for r in df.collect()])


def test_groups_and_empty_table(spark):
    rows = aligned(documents(spark, TEXTS), A, B, groups=True).collect()
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in rows if r.n_a)
    assert found(documents(spark, [])) == []


def test_pieces_in_use_stay_known(monkeypatch):
    """Pieces that keep coming are aligned once, though others pass the bound many times over."""
    known = Aligner(Path(A).read_text("utf-8"), Path(B).read_bytes(), most=200)
    made, grouped = [], known.grouped
    monkeypatch.setattr(known, "grouped", lambda a, b, lengths: made.append(len(lengths)) or grouped(a, b, lengths))
    texts = ["of the day it's " + " ".join(f"w{i}!" for i in range(j * 20, j * 20 + 20)) for j in range(40)]
    found = [f for t in texts for f in known.of([t])]
    assert sum(made) == 4 + 40 * 20
    texts += ["x▁ and é <s> <|endoftext|> " * 3, "two  blanks", "\n"]
    found += [f for t in texts[40:] for f in known.of([t])]
    assert len(known) + len(known.before) <= 240
    fresh = Aligner(Path(A).read_text("utf-8"), Path(B).read_bytes())
    assert found == fresh.of(texts)
