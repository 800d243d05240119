"""Operator 12, cross-tokenizer alignment on packed bitsets of token ends.

A text, led by a space, is encoded by a byte-level BPE file (A) and a
sentencepiece model (B). Each tokenizer's token ends are bits of a packed bitset
over the bytes of many texts.

1. AND of the two gives the shared cuts; population counts rank a cut among
   each side's ends, which maps the bytes between two cuts to token ranges: the
   groups.
2. OR gives the elementary stretches: each lies in one token of A and one of
   B, and every overlapping pair of occurrences owns exactly one. Ranks of its
   end name the two tokens: the links.
3. Texts are encoded once, their ids packed and settled; no token moves through
   a shuffle. A pass counts in how many documents each id pair is linked
   (distinct inside a document, added up inside a task first), a second one sums
   each document's links by count. The most frequent pairs (``MOST_SENT`` at most)
   and the best count of each A id (bounded by the vocabulary) go to every
   task; the links of all other pairs meet their counts in a join.

Both encoders work unit by unit: neither forms a token across a place where a
space follows a character that is no white space (tested on the files' own
vocabularies, else a text is one unit), so the ids of short units are kept.

Defined results: texts null or empty, or that one side cannot give back byte
for byte, have no tokens: zeros and an empty digest column. Every row is a
document, so rows that repeat count each; ties of counts are all best; texts
may have any length (they are read in stretches) and docs any other columns; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import arrow, pieces, scanned, settle, text_column
from wardline.llm.packing import Tokens, byte_symbols

#: Pairs whose counts go to every task: 16 bytes each.
MOST_SENT = 1 << 20
#: A task adds up its pairs whenever it holds so many.
MOST_HELD = 1 << 22
#: Units up to this length are remembered, about this many of them in each of two generations.
UNIT_CHARS, UNITS = 64, 1 << 17
#: Characters of one text that are aligned at a time.
STRETCH = 1 << 19
#: A unit begins at a space behind a character that is no white space.
CUT = re.compile(r"(?<=\S)(?= )")
SPACE = "▁"
PAIR_BITS = 32
ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.struct([("a", pa.binary()), ("b", pa.binary())])))])
COUNTS = pa.schema([("pair", pa.int64()), ("n", pa.int64())])
ROWS = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string()), ("rare", pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())])))])


def ends_blank(unit: str) -> bool:
    """Whether a place behind the unit is behind white space (a space leads it)."""
    return not unit or unit[-1].isspace()


class Encoders:
    """Both encoders of a worker: ids of a unit, and each id's bytes."""

    def __init__(self, byte_file: str, piece_file: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(byte_file), SentencePieceProcessor(model_file=piece_file)
        self.a.encode_special_tokens = True
        with open(byte_file, encoding="utf-8") as f:
            spec = json.load(f)
        byte = byte_symbols()
        names = {t["content"] for t in spec["added_tokens"]}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for t, i in self.a.get_vocab().items():
            self.a_bytes[i] = t.encode() if t in names else bytes(byte[c] for c in t)
        pieces_ = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces_)]
        self.kind = "<u2" if max(len(self.a_bytes), len(self.b_bytes)) <= 1 << 16 else "<i4"
        self.lone_space = self.b.piece_to_id(SPACE)
        splits = spec["pre_tokenizer"] or {}
        plain = spec["normalizer"] is None and {x: splits.get(x) for x in Tokens.SPLITS} == Tokens.SPLITS
        self.by_unit = plain and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces_)
        self.a_length, self.b_length = (np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b_bytes))
        sizes = len(self.a_bytes), len(self.b_bytes)
        #: Ids in decimal with what may follow: of A a comma or a bar, of B a comma or a semicolon.
        self.shown = [f"{i}{s}" for n, ends in zip(sizes, (",|", ",;"), strict=True) for s in ends for i in range(n)]
        self.kept: dict[str, tuple[bytes, bytes] | None] = {}
        self.older: dict[str, tuple[bytes, bytes] | None] = {}
        self.fast = Tokens(byte_file).fast  # the same merges, faster

    def units(self, text: str) -> list[str]:
        """The units of a text, each without the space that leads it (the first one's is not in the text)."""
        if not self.by_unit:
            return [text]
        parts = text.split(" ")
        if not any(ends_blank(p) for p in set(parts[:-1])):
            return parts
        out, open_ = [], []
        for p in parts:  # no cut behind white space
            open_.append(p)
            if not ends_blank(p):
                out.append(" ".join(open_))
                open_ = []
        return [*out, " ".join(open_)] if open_ else out

    def learn(self, units: set[str]) -> None:
        """Keep A's and B's ids of the units, as 32-bit integers; None where one side loses a byte."""
        if len(self.kept) > UNITS:  # two generations: what was met lately stays
            self.kept, self.older = {}, self.kept
        kept, older = self.kept, self.older
        new = {u for u in units if u not in kept}
        for u in [u for u in new if u in older]:
            kept[u] = older[u]
            new.remove(u)
        # a unit that ends in no white space may stand before any other: such ones are encoded end to end
        plain = sorted(u for u in new if self.by_unit and not ends_blank(u))
        self.learn_together(plain)
        for u in new.difference(plain):
            self.learn_together([u])

    def learn_together(self, units: list[str]) -> None:
        if not units:
            return
        text = " ".join(units)
        led = " " + text
        fast = self.fast if len(led) < Tokens.LONGEST else None
        a = fast.encode_ordinary(led) if fast else self.a.encode(led, add_special_tokens=False).ids
        # the model itself leads with a space; without any other character it would give nothing
        b = self.b.encode(text, num_threads=1) if text else [self.lone_space]
        if led.encode() == b"".join([self.a_bytes[i] for i in a]) == b"".join([self.b_bytes[i] for i in b]):
            ends = np.cumsum([len(u.encode()) + 1 for u in units])
            a, b = np.array(a, "<i4"), np.array(b, "<i4")
            at_a, at_b = (np.searchsorted(np.cumsum(length[x]), ends, "right").tolist() for length, x in ((self.a_length, a), (self.b_length, b)))
            for u, a0, a1, b0, b1 in zip(units, [0, *at_a], at_a, [0, *at_b], at_b, strict=False):
                self.kept[u] = a[a0:a1].tobytes(), b[b0:b1].tobytes()
        elif len(units) == 1:
            self.kept[units[0]] = None
        else:
            half = len(units) // 2
            self.learn_together(units[:half])
            self.learn_together(units[half:])

    def stretches(self, text: str, size: int = STRETCH):
        """The text cut between units into stretches of about size characters, without the spaces that lead them."""
        lo = 0
        while lo + size < len(text) and self.by_unit and (cut := CUT.search(text, lo + size)):
            yield text[lo : cut.start()]
            lo = cut.start() + 1
        yield text[lo:]

    def ids(self, texts: list[str | None], size: int = STRETCH) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        """Of each text A's and B's ids of its stretches; none where the text is empty or cannot be given back."""
        out: list[list] = [[] for _ in texts]
        lost, waiting, held = set(), [], 0

        def flush() -> None:
            every = set().union(*(units for _, units in waiting))
            self.learn(every)
            for i, units in waiting:
                got = list(map(self.kept.__getitem__, units))
                if None in got:
                    lost.add(i)
                else:
                    out[i].append(tuple(np.frombuffer(b"".join(x), "<i4").astype(self.kind) for x in zip(*got, strict=True)))
            for u in [u for u in every if len(u) > UNIT_CHARS]:
                del self.kept[u]
            waiting.clear()

        for i, text in enumerate(texts):
            for stretch in self.stretches(text, size) if text else ():
                if i not in lost:
                    waiting.append((i, self.units(stretch)))
                    held += len(stretch)
                    if held >= size:
                        flush()
                        held = 0
        flush()
        return [[] if i in lost else own for i, own in enumerate(out)]


# ---------------------------------------------------------------- bitsets


class Bits:
    """A packed bitset with ranks: how many bits are set below a place."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        ones = np.bitwise_count(words).astype(np.int64)
        self.below = np.cumsum(ones) - ones

    @classmethod
    def of(cls, places: np.ndarray, size: int) -> Bits:
        flags = np.zeros(size + 63 & ~63, np.uint8)
        flags[places] = 1
        return cls(np.packbits(flags, bitorder="little").view(np.uint64))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def __or__(self, other: Bits) -> Bits:
        return Bits(self.words | other.words)

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Set bits below each place."""
        at, bit = places >> 6, (places & 63).astype(np.uint64)
        return self.below[at] + np.bitwise_count(self.words[at] & ((np.uint64(1) << bit) - np.uint64(1)))

    def select(self) -> np.ndarray:
        """The places of all set bits."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


class Aligned:
    """Groups and links of the texts that a pass lays end to end; a text's end is a cut."""

    def __init__(self, tokens: Encoders, texts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.a, self.b = (np.concatenate([t[i] for t in texts]).astype(np.int64) for i in (0, 1))
        ends_a, ends_b = np.cumsum(tokens.a_length[self.a]), np.cumsum(tokens.b_length[self.b])
        size = int(ends_a[-1]) + 1
        of_a, of_b = Bits.of(ends_a, size), Bits.of(ends_b, size)
        self.text_ends = ends_a[np.cumsum([len(t[0]) for t in texts]) - 1]
        self.cuts = (of_a & of_b).select()
        self.group_a, self.group_b = of_a.rank(self.cuts) + 1, of_b.rank(self.cuts) + 1  # tokens up to each cut
        stretches = (of_a | of_b).select()
        self.pair = self.a[of_a.rank(stretches)] << PAIR_BITS | self.b[of_b.rank(stretches)]
        self.text = np.searchsorted(self.text_ends, stretches)  # whose link it is
        self.cut_text = np.searchsorted(self.text_ends, self.cuts)

    def listed(self, tokens: Encoders) -> list[str]:
        """Of each text ``a1,a2|b1;a3|b2,b3``, with a closing semicolon."""
        n_a, n_b = len(self.a), len(self.b)
        # A's token i stands behind the B tokens of earlier groups, B's token j behind the A tokens of its own group too
        first_a, first_b = np.append(0, self.group_a[:-1]), np.append(0, self.group_b[:-1])
        at_a = np.arange(n_a) + np.repeat(first_b, self.group_a - first_a)
        at_b = np.arange(n_b) + np.repeat(self.group_a, self.group_b - first_b)
        shown = np.empty(n_a + n_b, np.int64)
        last = np.zeros(n_a, np.int64)
        last[self.group_a - 1] = len(tokens.a_bytes)
        shown[at_a] = self.a + last
        last = np.zeros(n_b, np.int64)
        last[self.group_b - 1] = len(tokens.b_bytes)
        shown[at_b] = 2 * len(tokens.a_bytes) + self.b + last
        words = list(map(tokens.shown.__getitem__, shown.tolist()))
        ends = (self.group_a + self.group_b)[np.searchsorted(self.cuts, self.text_ends)]
        return ["".join(words[lo:hi]) for lo, hi in zip(np.append(0, ends[:-1]), ends, strict=True)]


def encode_rows(batches, byte_file: str, piece_file: str):
    """doc_id and the packed ids of each stretch of its text."""
    tokens, pack = Encoders(byte_file, piece_file), zstandard.ZstdCompressor(level=1).compress
    for batch in pieces(batches, limit=STRETCH):
        found = [[{"a": pack(a.tobytes()), "b": pack(b.tobytes())} for a, b in own] for own in tokens.ids(text_column(batch["text"]).to_pylist())]
        yield arrow(ENCODED, batch["doc_id"], found)


def passes(batches, tokens: Encoders):
    """Slices of encoded rows of some STRETCH tokens: the slice, and its stretches' rows and ids."""
    unpack, kind = zstandard.ZstdDecompressor().decompress, tokens.kind
    for batch in batches:
        lo, held, rows, texts = 0, 0, [], []
        for i, own in enumerate(batch["ids"]):
            for x in own.as_py() or ():
                texts.append(tuple(np.frombuffer(unpack(x[c]), kind) for c in "ab"))
                rows.append(i - lo)
                held += len(texts[-1][0])
            if held >= STRETCH or i + 1 == batch.num_rows:
                yield batch.slice(lo, i + 1 - lo), rows, texts
                lo, held, rows, texts = i + 1, 0, [], []


def grouped(rows: list[int], texts: list, most: int = STRETCH):
    """(rows, texts) cut to parts of about most tokens."""
    lo, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t[0])
        if held >= most or i + 1 == len(texts):
            yield rows[lo : i + 1], texts[lo : i + 1]
            lo, held = i + 1, 0


def document_pairs(tokens: Encoders, rows: list[int], texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, pair) and how many links each has."""
    row, pair, times = [], [], []
    for own_rows, own in grouped(rows, texts):
        found = Aligned(tokens, own)
        own_row = np.array(own_rows, np.int64)[found.text]
        r, p, n = distinct(own_row, found.pair, np.ones(len(own_row), np.int64))
        row.append(r), pair.append(p), times.append(n)
    if len(row) == 1:
        return row[0], pair[0], times[0]
    return distinct(*(np.concatenate(x) if x else np.empty(0, np.int64) for x in (row, pair, times)))


def distinct(row: np.ndarray, pair: np.ndarray, times: np.ndarray):
    order = np.lexsort((pair, row))
    row, pair, times = row[order], pair[order], times[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (pair[1:] != pair[:-1])
    first = np.flatnonzero(new)
    return row[first], pair[first], np.add.reduceat(times, first) if len(first) else times


def count_pairs(batches, byte_file: str, piece_file: str):
    """Per task, pairs and the number of its documents that hold each."""
    tokens = Encoders(byte_file, piece_file)
    pairs, counts, held = [], [], 0

    def added():
        pair, n = np.concatenate(pairs), np.concatenate(counts)
        _, pair, n = distinct(np.zeros(len(pair), np.int64), pair, n)
        return pair, n

    for _, rows, texts in passes(batches, tokens):
        if texts:
            _, pair, _ = document_pairs(tokens, rows, texts)
            pairs.append(pair), counts.append(np.ones(len(pair), np.int64))
            held += len(pair)
        if held > MOST_HELD:
            pair, n = added()
            if len(pair) > MOST_HELD // 2:
                yield arrow(COUNTS, pair, n)
                pair, n = pair[:0], n[:0]
            pairs, counts, held = [pair], [n], len(pair)
    if pairs:
        yield arrow(COUNTS, *added())


def align_rows(batches, byte_file: str, piece_file: str, sent):
    """A row for each document, with the sums over links of pairs that were sent, and its other pairs."""
    known, count, best = sent.value
    tokens = Encoders(byte_file, piece_file)
    for batch, rows, texts in passes(batches, tokens):
        n = batch.num_rows
        n_a, n_b, groups, links, n_best, total = (np.zeros(n, np.int64) for _ in range(6))
        digests = {}
        row_at, pair_at, times_at = [], [], []
        for own_rows, own in grouped(rows, texts):
            found, own_row = Aligned(tokens, own), np.array(own_rows, np.int64)
            np.add.at(n_a, own_row, [len(t[0]) for t in own])
            np.add.at(n_b, own_row, [len(t[1]) for t in own])
            groups += np.bincount(own_row[found.cut_text], minlength=n)
            at = own_row[found.text]
            links += np.bincount(at, minlength=n)
            for i, listed in zip(own_rows, found.listed(tokens), strict=True):
                if i in digests:
                    digests[i].update(b";")
                digests.setdefault(i, hashlib.sha256()).update(listed[:-1].encode())
            place = np.minimum(np.searchsorted(known, found.pair), max(0, len(known) - 1))
            hit = known[place] == found.pair if len(known) else np.zeros(len(at), bool)
            own_count = count[place[hit]]
            total += np.bincount(at[hit], own_count, n).astype(np.int64)
            n_best += np.bincount(at[hit], own_count == best[found.pair[hit] >> PAIR_BITS], n).astype(np.int64)
            if not hit.all():
                r, p, t = distinct(at[~hit], found.pair[~hit], np.ones((~hit).sum(), np.int64))
                row_at.append(r), pair_at.append(p), times_at.append(t)
        r, p, t = distinct(*(np.concatenate(x) if x else np.empty(0, np.int64) for x in (row_at, pair_at, times_at)))
        offsets = pa.array(np.searchsorted(r, np.arange(n + 1)).astype(np.int32))
        rare = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(p), pa.array(t)], names=["pair", "times"]))
        shown = [digests[i].hexdigest() if i in digests else "" for i in range(n)]
        yield arrow(ROWS, batch["doc_id"], n_a, n_b, groups, links, n_best, total, shown, rare)


def encoded(docs: DataFrame, byte_file: str, piece_file: str) -> DataFrame:
    """doc_id, ids: the packed ids of each row, settled."""
    texts = scanned(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return settle(texts.mapInArrow(lambda it: encode_rows(it, byte_file, piece_file), "doc_id long, ids array<struct<a:binary,b:binary>>"))


def pair_counts(rows: DataFrame, byte_file: str, piece_file: str) -> DataFrame:
    """pair (A's id above PAIR_BITS, B's below) and n: how many of the encoded rows hold it linked."""
    found = rows.select("ids").mapInArrow(lambda it: count_pairs(it, byte_file, piece_file), "pair long, n long")
    return found.groupBy("pair").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (sorted) and counts of as many of the most frequent pairs as ``most`` allows, no count cut in two."""
    # counts of one length in bits and the same first four share a class: there are a few hundred
    place = F.expr("16 * length(bin(n)) + shiftright(n, greatest(length(bin(n)) - 4, 0))").alias("class")
    classes = sorted(counts.groupBy(place).agg(F.count("*").alias("pairs"), F.min("n").alias("least")).collect(), key=lambda r: -r["least"])
    least, total = None, 0
    for c in classes:
        total += c["pairs"]
        if total > most:
            break
        least = c["least"]
    if least is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rows = counts.where(F.col("n") >= least).toArrow()
    pair, n = rows["pair"].to_numpy(), rows["n"].to_numpy()
    order = np.argsort(pair)
    return pair[order], n[order]


def align(docs: DataFrame, byte_file: str, piece_file: str, most_sent: int = MOST_SENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    docs = encoded(docs, byte_file, piece_file)
    counts = settle(pair_counts(docs, byte_file, piece_file))
    first = F.shiftright("pair", PAIR_BITS).alias("a")
    best_rows = counts.groupBy(first).agg(F.max("n").alias("best")).toArrow()  # one row per A id
    best = np.zeros(int(max(best_rows["a"].to_pylist(), default=0)) + 1, np.int64)
    best[best_rows["a"].to_numpy()] = best_rows["best"].to_numpy()
    known, n = frequent(counts, most_sent)
    sent = spark.sparkContext.broadcast((known, n, best))
    shape = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, rare array<struct<pair:long,times:long>>"
    rows = docs.mapInArrow(lambda it: align_rows(it, byte_file, piece_file, sent), shape)
    if counts.count() == len(known):
        return rows.drop("rare")
    rows = settle(rows.withColumn("row", F.monotonically_increasing_id()))
    rare = rows.select("row", F.explode("rare").alias("x")).select("row", "x.*").join(counts, "pair")
    limit = F.broadcast(spark.createDataFrame(best_rows.to_pandas(), "a long, best long"))
    rare = rare.join(limit, F.shiftright("pair", PAIR_BITS) == F.col("a"))
    sums = rare.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))
    rows = rows.join(sums, "row", "left")
    more = {"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}
    return rows.withColumns(more).select(*[c for c in ROWS.names if c != "rare"])
