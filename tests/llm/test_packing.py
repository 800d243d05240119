import json
import zlib
from collections import defaultdict

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from tests.llm.helpers import frame, noisy
from wardline.llm.common import NULL_KEY
from wardline.llm.packing import Tokens, bounds, curve_keys, hilbert, pack_documents, ranges, signs

FILE = path("byte_bpe_50k.json")
ODD = ["", " ", "  a  b", "a\n\nb", "a \n b", "x y z", "it's we'll DON'T", "a\tb c", "<|endoftext|> hi", "\n", "é b\x1c4 5", "日本語 😀!!", "\x00\x85"]


def test_ids_are_the_tokenizers():
    fast, whole = Tokens(FILE), Tokenizer.from_file(FILE)
    for text in [*ODD, *(t or "" for t in noisy(1)), "a" * 70000]:
        assert fast(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_long_texts_and_other_files_give_the_same_ids(tmp_path):
    short, whole = Tokens(FILE, longest=3), Tokens(FILE)
    other = json.load(open(FILE, encoding="utf-8"))
    other["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(other), encoding="utf-8")
    prefixed, library = Tokens(str(tmp_path / "other.json")), Tokenizer.from_file(str(tmp_path / "other.json"))
    for text in [*ODD, *(t or "" for t in noisy(3))]:
        assert short(text) == whole(text)
        assert prefixed(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert short.whole is not None and prefixed.fast is None


def brute_order(texts, ids):
    """Documents by (curve, doc_id, text hash), one at a time."""
    import xxhash

    def key(i, t):
        b = np.frombuffer((t or "").encode(), np.uint8)
        curve = curve_keys(b, np.array([0, len(b)]), signs())[0]
        h = 42 if t is None else xxhash.xxh64_intdigest(t.encode(), 42)
        return int(curve), NULL_KEY if i is None else i, h - 2**64 if h >= 2**63 else h

    return [i for _, i in sorted((key(i, t), i or -1) for i, t in zip(ids, texts, strict=True))]


def test_documents_lie_in_the_order_of_the_curve(spark):
    """Over several partitions, with a third of all in one place of the curve and rows that repeat."""
    texts = noisy(4, 150) + ["the same text " * 40] * 80 + [None, ""]
    ids = [*range(150), *range(1000, 1080), None, 7]
    rows = sorted(pack_documents(frame(spark, texts, ids).repartition(5), FILE).collect(), key=lambda r: (r.sequence_id, r.offset))
    assert len({r.sequence_id >> 36 for r in rows}) == 4
    assert [r.doc_id or -1 for r in rows if r.start == 0] == brute_order(texts, ids)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.sequence_id >> 36] += r.length
    assert max(sizes.values()) < 2 * sum(sizes.values()) / 4


def test_one_repeated_row_fills_several_ranges(spark):
    import pyarrow as pa

    same = np.array([[5], [6], [7]])
    cuts = bounds(pa.table({"curve": [1, 5, 5, 9], "k": [1, 6, 6, 1], "h": [1, 7, 7, 1], "bytes": [1.0, 40.0, 40.0, 1.0]}), 4)
    assert cuts.tolist() == [[5] * 3, [6] * 3, [7] * 3]
    assert sorted(set(ranges(np.repeat(same, 9, 1), cuts, 0).tolist())) == [1, 2, 3]
    assert ranges(np.array([[1, 5, 5, 9], [1, 6, 6, 1], [1, 6, 8, 1]]), cuts, 0).tolist() == [0, 0, 3, 3]
    texts = ["again and again " * 50] * 400
    rows = pack_documents(frame(spark, texts, [3] * 400).repartition(3), FILE).collect()
    assert sum(r.length for r in rows) == 400 * rows[0].doc_tokens and len({r.sequence_id >> 36 for r in rows}) >= 3


def test_hilbert_is_a_curve():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = hilbert(cells, 3)
    assert sorted(key) == list(range(512))
    path_ = cells[np.argsort(key)]
    assert (np.abs(np.diff(path_, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("texts", [ODD + [None] + noisy(2), [None], ["a b " * 3000, "x", "x"]])
def test_round_trip(spark, texts):
    whole = Tokenizer.from_file(FILE)
    rows = pack_documents(frame(spark, texts).repartition(3), FILE).collect()
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert len(r.ids) == 4 * r.length > 0
    for i, text in enumerate(texts):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [0]
        pieces = sorted(docs[i], key=lambda r: r.start)
        assert b"".join(r.ids for r in pieces) == np.array(ids, "<u4").tobytes()
        assert [r.start for r in pieces] == np.cumsum([0] + [r.length for r in pieces[:-1]]).tolist()
        assert {r.doc_tokens for r in pieces} == {len(ids)}
        assert all(zlib.crc32(r.ids) >= 0 for r in pieces)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0] + [r.length for r in pieces[:-1]]).tolist()
        n = sum(r.length for r in pieces)
        assert n <= 1024 and n & (n - 1) == 0


def test_empty_table(spark):
    assert pack_documents(frame(spark, []), FILE).collect() == []
