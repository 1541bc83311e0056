"""Alignment of two tokenizers by the ends of their tokens.

Both encode the same bytes, so a token is its byte range and a text two ascending lists of ends. The shorter list is
walked, and each of its ends is looked up in the longer one: from the last place found, in steps that double, then by
binary search in the last step. Ends that stand in both cut the tokens into groups, and the difference of
the places of two neighbouring ends is the number of tokens of the longer list that a token of the shorter overlaps.

How often a pair of ids is linked in the whole corpus is not known before all texts are aligned. A task takes texts in
blocks of bounded bytes and writes the block's distinct pairs once, and for each text the numbers of its links'
pairs in that list. Pairs are summed over the blocks, and each block gets the counts of its own pairs back, so what is shuffled is a row
per block and pair, not per text and pair, and a very frequent pair is one row in each block.

Defined results: texts that are null or empty, or whose joined tokens are not a space and the text in either tokenizer,
have no tokens: zeros, and no groups; strings of special tokens inside a text are plain text; repeated rows and null
doc_ids are aligned each on their own; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrilake.llm import tokens, worker
from sentrilake.llm.scratch import Scratch
from sentrilake.llm.slices import text_slices
from sentrilake.llm.transducer import byte_alphabet
from sentrilake.session import cut

#: Bytes of the texts of a block. As words and links they take some fifty times as much.
BLOCK_BYTES = 2 << 20
_CACHED_PIECES, _LONGEST_PIECE = 100_000, 64
_SPACE = "▁"


def default_pieces() -> str:
    """Path of the public piece model on the machine that runs the task."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceEncoder:
    """Ids by a piece model, as bytes of 32-bit numbers. No piece has a space behind another character, so no merge
    crosses a border before a space that follows one: the words of a text are encoded once each and looked up."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(_SPACE in name.lstrip(_SPACE) for name in names):
            raise ValueError("this model has pieces with a space inside")
        #: Bytes of each id.
        self.bytes = [
            bytes([int(name[3:5], 16)]) if self.model.is_byte(i) else name.replace(_SPACE, " ").encode()
            for i, name in enumerate(names)
        ]
        self.known: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}

    def _encode(self, texts: list[str]) -> list[bytes | None]:
        """Ids of texts, or null for one whose joined tokens are not a space and the text."""
        get = self.bytes.__getitem__
        return [
            array("i", ids).tobytes() if b"".join(map(get, ids)) == b" " + text.encode() else None
            for text, ids in zip(texts, self.model.encode(texts, num_threads=1))
        ]

    def __call__(self, texts: list[str]) -> list[bytes | None]:
        """Ids of every text, before which the model puts a space, or null as above."""
        if len(self.known) > _CACHED_PIECES:
            self.known, self.older = {}, self.known
        split = [x.split(" ") for x in texts]
        new = set().union(*split) - self.known.keys()
        found = {x: self.older[x] for x in new if x in self.older}
        rest = [x for x in new if x and x not in found]
        found.update(zip(rest, self._encode(rest)))
        known = self.known
        known.update(found)
        out = []
        for text, words in zip(texts, split):
            # Several spaces in a row are merged with one another, so such a text is encoded whole.
            if all(words):
                found = list(map(known.__getitem__, words))
                out.append(None if None in found else b"".join(found))
            else:
                out.append(self._encode([text])[0] if text else None)
        for x in rest:
            if len(x) > _LONGEST_PIECE:
                del known[x]
        return out


class Tokenizers:
    """Both tokenizers of a Python worker, with the bytes of their tokens."""

    def __init__(self, units: str | None, pieces: str | None):
        import json

        path = units or tokens.default_tokenizer()
        self.units, self.pieces = tokens.encoder(path), PieceEncoder(pieces or default_pieces())
        alphabet = byte_alphabet()
        vocab = self.units.tokenizer.get_vocab(with_added_tokens=False)
        self.a_size = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.a_size[i] = sum(c in alphabet for c in token)  # a character of a token stands for a byte
        self.b_size = np.array([len(x) for x in self.pieces.bytes])
        #: Each id with what follows it inside a group and at the end of its half, A before B.
        self.names = [f"{i}{x}" for n, marks in ((len(self.a_size), ",|"), (len(self.b_size), ",;")) for i in range(n) for x in marks]

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Ids of every text and the ends of their tokens in A and in B, empty where the text has no tokens by
        definition. Byte-level tokens always join to the text; the pieces have been compared with it."""
        none = np.zeros(0, np.int64)
        for a, b in zip(self.units([f" {x}" for x in texts]), self.pieces(texts)):
            if b is None:
                yield none, none, none, none
                continue
            a, b = np.frombuffer(a, "<u2").astype(np.int64), np.frombuffer(b, "<i4").astype(np.int64)
            a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
            if a_ends[-1] != b_ends[-1]:
                raise AssertionError("byte-level tokens do not join to their text")
            yield a, b, a_ends, b_ends

    def group_text(self, a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray) -> str:
        """Groups of ids, ``a1,a2|b1;a3|b2,b3``, given the places of the groups' last tokens."""
        codes = np.empty(len(a) + len(b), np.int64)
        # Behind a token stand the tokens of its own half and, of the other, those of the groups before (and its own).
        a_group, b_group = (np.repeat(np.arange(len(x)), np.diff(x, prepend=-1)) for x in (a_last, b_last))
        a_place = np.arange(len(a)) + np.concatenate([[0], b_last[:-1] + 1])[a_group]
        b_place = np.arange(len(b)) + (a_last + 1)[b_group]
        codes[a_place] = 2 * a
        codes[b_place] = 2 * (len(self.a_size) + b)
        codes[a_place[a_last]] += 1
        codes[b_place[b_last]] += 1
        return "".join(map(self.names.__getitem__, codes.tolist()))[:-1]


_TOKENIZERS: dict[tuple, Tokenizers] = worker.keeps()


def tokenizers(units: str | None = None, pieces: str | None = None) -> Tokenizers:
    if (units, pieces) not in _TOKENIZERS:
        _TOKENIZERS[units, pieces] = Tokenizers(units, pieces)
    return _TOKENIZERS[units, pieces]


def gallop(shorter: list[int], longer: list[int]) -> list[int]:
    """For every end of ``shorter`` the place of the first end of ``longer`` that is not smaller. The last end of
    ``longer`` is not smaller than any."""
    out, at, n = [], 0, len(longer)
    for end in shorter:
        if longer[at] < end:
            at += 1
            if longer[at] < end:
                step, high = 1, at + 1
                while high < n and longer[high] < end:
                    at = high
                    step += step
                    high += step
                at = bisect_left(longer, end, at + 1, min(high, n))
        out.append(at)
    return out


def overlaps(shorter: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For two lists of ends of the same bytes: the first token of the longer list that each token of the shorter
    overlaps, the place of the last one, and whether both end there."""
    last = np.array(gallop(shorter.tolist(), longer.tolist()), np.int64)
    both = longer[last] == shorter
    first = np.zeros(len(last), np.int64)
    first[1:] = (last + both)[:-1]
    return first, last, both


def align(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links as places (a, b), and the places of the groups' last tokens in both lists."""
    swap = len(b_ends) < len(a_ends)
    first, last, both = overlaps(b_ends, a_ends) if swap else overlaps(a_ends, b_ends)
    n = last - first + 1
    short = np.repeat(np.arange(len(n)), n)
    long = np.arange(len(short)) - np.repeat(np.cumsum(n) - n - first, n)
    ends = np.flatnonzero(both), last[both]
    return (long, short, ends[1], ends[0]) if swap else (short, long, *ends)


_ROW = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
_LINKED = _ROW + "numbers binary, pairs binary"
_TYPES = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary()]


def _align_block(both: Tokenizers, texts: list[str], digest) -> tuple[list[tuple], bytes]:
    """The figures of each text with the numbers of its links' pairs in the block's list, and that list: pairs, times."""
    figures, keys = [], []
    for a, b, a_ends, b_ends in both.encode(texts):
        if not len(a):
            figures.append((0, 0, 0, 0, ""))
        else:
            at_a, at_b, a_last, b_last = align(a_ends, b_ends)
            keys.append(a[at_a] << 32 | b[at_b])
            figures.append((len(a), len(b), len(a_last), len(at_a), digest(both.group_text(a, b, a_last, b_last))))
    if not keys:
        return [(*x, b"") for x in figures], b""
    pairs, number, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    width = 2 if len(pairs) <= 1 << 16 else 4
    numbers, ends = number.astype(f"<u{width}").tobytes(), [0]
    for x in figures:
        ends.append(ends[-1] + width * x[3])
    rows = [(*x, numbers[i:j]) for x, i, j in zip(figures, ends, ends[1:])]
    return rows, np.stack([pairs, times]).astype("<i8").tobytes()


def _linked(docs: DataFrame, units: str | None, pieces: str | None) -> DataFrame:
    """A row per text, and one per block with its pairs."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        from pyspark import TaskContext

        both, block = tokenizers(units, pieces), TaskContext.get().partitionId() << 32
        digest = lambda text: sha256(text.encode()).hexdigest()
        for part, texts in text_slices(batches, size=BLOCK_BYTES, rows=10_000):
            rows, pairs = _align_block(both, texts, digest)
            out = [(block, d, *row, None) for d, row in zip(part["doc_id"].to_pylist(), rows)]
            out.append((block, *[None] * 7, pairs))
            block += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], [x.split()[0] for x in _LINKED.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(link, _LINKED)


def _listed(linked: DataFrame) -> DataFrame:
    """block, number, pair, times of the blocks' lists."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch["block"].to_pylist(), batch["pairs"].to_pylist()):
                pairs, times = np.frombuffer(data, "<i8").reshape(2, -1)
                columns = [np.full(len(pairs), block), np.arange(len(pairs)), pairs, times]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["block", "number", "pair", "times"])

    rows = linked.where("pairs IS NOT NULL").select("block", "pairs")
    return rows.mapInArrow(unpack, "block long, number long, pair long, times long")


def pair_counts(listed: DataFrame) -> DataFrame:
    """pair (a << 32 | b), links of it in the whole corpus, and whether no other pair of its b id has more."""
    sums = listed.groupBy("pair").agg(F.sum("times").alias("links"))
    most = F.max("links").over(Window.partitionBy(F.col("pair").bitwiseAND(0xFFFFFFFF)))
    return sums.select("pair", "links", (F.col("links") == most).alias("best"))


_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _summed(linked: DataFrame, counts: DataFrame) -> DataFrame:
    """The figures of every text with the sums over its links. A block's counts come before its texts, so a task
    holds the counts of one block."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, links, best = None, np.zeros(0, np.int64), np.zeros(0, bool)
        for batch in batches:
            block, kind = batch["block"].to_numpy(), batch["kind"].to_numpy()
            borders = np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for i, j in zip([0, *borders], [*borders, len(block)]):
                part = batch.slice(i, j - i)
                if block[i] != now:
                    now, links, best = block[i], links[:0], best[:0]
                if kind[i] == 0:
                    links = np.concatenate([links, part["links"].to_numpy()])
                    best = np.concatenate([best, part["best"].to_numpy(zero_copy_only=False)])
                    continue
                sums = []
                for data, n in zip(part["numbers"].to_pylist(), part["n_links"].to_pylist()):
                    number = np.frombuffer(data, f"<u{len(data) // n if n else 4}")
                    sums.append((int(best[number].sum()), int(links[number].sum())))
                n_best, total = zip(*sums)
                yield pa.RecordBatch.from_arrays(
                    [part[x] for x in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
                    + [pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), part["groups_sha256"]],
                    [x.split()[0] for x in _OUT.split(", ")],
                )

    texts = linked.where("pairs IS NULL").drop("pairs").withColumn("kind", F.lit(1))
    rows = counts.withColumn("kind", F.lit(0)).unionByName(texts, allowMissingColumns=True)
    dealt = rows.repartition("block").sortWithinPartitions("block", "kind", "number")
    return dealt.mapInArrow(add, _OUT)


def align_documents(docs: DataFrame, units: str | None = None, pieces: str | None = None) -> DataFrame:
    """``docs`` (doc_id, text) to the figures of each text's alignment: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256. ``units`` and ``pieces`` are paths of a byte-level vocabulary (A) and a piece model (B)."""
    with Scratch(docs.sparkSession) as scratch:
        linked = scratch.cut(_linked(docs, units, pieces))
        listed = _listed(linked)
        counts = pair_counts(listed).withColumnRenamed("pair", "counted")
        returned = listed.join(counts, F.col("pair") == F.col("counted")).select("block", "number", "links", "best")
        return cut(_summed(linked, returned))


def text_groups(text: str, units: str | None = None, pieces: str | None = None) -> str:
    """The groups of one text as ids."""
    both = tokenizers(units, pieces)
    a, b, a_ends, b_ends = next(both.encode([text]))
    return both.group_text(a, b, *align(a_ends, b_ends)[2:]) if len(a) else ""
