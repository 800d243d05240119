"""Operator 12 against tokens and overlaps taken one at a time."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from public_tokenizers import path
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tests.llm.helpers import frame, noisy
from wardline.llm import alignment
from wardline.llm.alignment import Bits, Encoders, align
from wardline.llm.packing import byte_symbols

BYTES, PIECES = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")
ODD = [
    "", " ", "  ", "a", " lead", "trail ", "two  spaces", "a\nb", "a \n  b", "x\n\n y", "tab\tq", "it's we'll", "<|endoftext|> <s> </s> <unk> <0x41>", "日本語 😀!!", "é ü ß", "▁ block", "no break  em", "\x00\x01 \x7f",
    "1234567 8.9", "[] {} ()", "A" * 300, "́ combining", "\x1c \x1d x", "a b c", "�", "ﬁ ligature ½",
]


def tokens(text):
    a, b, byte = Tokenizer.from_file(BYTES), SentencePieceProcessor(model_file=PIECES), byte_symbols()
    a.encode_special_tokens = True
    if not text:
        return [], []
    own_a = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    own_b = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        own_b.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    want = (" " + text).encode()
    if b"".join(x for _, x in own_a) != want or b"".join(x for _, x in own_b) != want:
        return [], []
    return own_a, own_b


def placed(own):
    at, out = 0, []
    for i, x in own:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def brute(texts):
    docs = []
    for text in texts:
        a, b = map(placed, tokens(text))
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups = [(",".join(str(i) for i, _, e in a if lo < e <= hi), ",".join(str(i) for i, _, e in b if lo < e <= hi)) for lo, hi in zip([0, *cuts], cuts)]
        docs.append((a, b, links, groups))
    count = Counter(p for _, _, links, _ in docs for p in set(links))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(n, best.get(a, 0))
    for a, b, links, groups in docs:
        digest = hashlib.sha256(";".join(map("|".join, groups)).encode()).hexdigest() if a else ""
        yield len(a), len(b), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), digest


@pytest.mark.parametrize("most", [alignment.MOST_SENT, 20, 0])
def test_equals_all_overlaps(spark, most):
    texts = [None, *ODD, *[t and t[:200] for t in noisy(3, 40)], "same text"] + ["same text"] * 3
    rows = align(frame(spark, texts).repartition(5), BYTES, PIECES, most).collect()
    assert [tuple(r)[1:] for r in sorted(rows, key=lambda r: r.doc_id)] == list(brute(texts))


def test_units_give_the_ids_of_whole_texts():
    own = Encoders(BYTES, PIECES)
    assert own.by_unit
    whole_a, whole_b = Tokenizer.from_file(BYTES), SentencePieceProcessor(model_file=PIECES)
    whole_a.encode_special_tokens = True
    for text in [*ODD, *(t or "" for t in noisy(4))]:
        want = tokens(text)
        for size in (alignment.STRETCH, 5):
            (got,) = own.ids([text], size)
            assert (not got) == (not want[0])
            if got:
                assert np.concatenate([g[0] for g in got]).tolist() == whole_a.encode(" " + text, add_special_tokens=False).ids
                assert np.concatenate([g[1] for g in got]).tolist() == whole_b.encode(text)


def test_long_texts_are_aligned_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(alignment, "STRETCH", 64)
    monkeypatch.setattr(alignment, "MOST_HELD", 50)
    own = Encoders(BYTES, PIECES)
    text = " ".join(t for t in noisy(6) if t)[:3000]
    want = next(brute([text]))
    rows, texts = zip(*[(0, t) for t in own.ids([text], 64)[0]], strict=True)
    assert len(texts) > 20
    _, pair, times = alignment.document_pairs(own, list(rows), list(texts))
    a, b = map(placed, tokens(text))
    assert dict(zip(pair.tolist(), times.tolist(), strict=True)) == Counter((x[0] << 32 | y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2])
    listed = "".join(x for r, t in alignment.grouped(list(rows), list(texts), 64) for x in alignment.Aligned(own, t).listed(own))
    assert hashlib.sha256(listed[:-1].encode()).hexdigest() == want[-1]


def test_a_very_long_text_and_repeated_rows(spark):
    text = "lorem ipsum dolor sit amet " * 60_000
    rows = align(frame(spark, [text, "lorem", "lorem"], [1, 2, 2]), BYTES, PIECES, 5).collect()
    long, *short = sorted(rows, key=lambda r: r.doc_id)
    assert long.n_groups > 250_000 and short[0] == short[1] and short[0].count_sum > 0


def test_ranks_and_selection():
    r = np.random.default_rng(3)
    places = np.flatnonzero(r.random(1000) < 0.3)
    bits = Bits.of(places, 1000)
    assert (bits.select() == places).all()
    assert bits.rank(np.arange(1000)).tolist() == [int((places < i).sum()) for i in range(1000)]


def test_empty_table(spark):
    assert align(frame(spark, []), BYTES, PIECES).collect() == []
