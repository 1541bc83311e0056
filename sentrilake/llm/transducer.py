"""Byte-pair encoding and decoding as streams of constant memory.

``Rules`` reads a public byte-level vocabulary and computes from its merge list how many bytes
of lookahead settle a token. ``EncodeStream`` takes a text in parts of any size and gives out ids as soon as
they are settled; ``DecodeStream`` takes ids in parts and gives out text as soon as its bytes are whole
characters. Neither keeps more than a bounded window, however long a text or a word without a border is.

The lookahead: compare the merges of some bytes with those of the same bytes and more behind them. Left of a
border all tokens agree, and the border starts at the end of the shorter text. A merge (x, y) moves it by
x to the left, and only if y begins at the border. The next move needs a later merge (x', y') whose y'
starts with x, that is, has x on its left edge. So no chain of moves is longer than the heaviest path
over such merges, weighed by the bytes of their left parts, which one pass over the list
finds. Tokens that end that many bytes before the end of what is known are final. The argument
needs every token to have one merge, made after the merges of its parts; other lists are refused.

Defined results: a null text is an empty one, without ids; the strings of special tokens inside a text are
those tokens, as in the tokenizers library; repeated rows get a row each, a null doc_id stays null; an empty
table gives no rows. Null or unknown ids are skipped in decoding, a null list is an empty one, and bytes that are
no UTF-8 become U+FFFD. ``encode_documents`` returns doc_id and ids, ``decode_documents`` doc_id, ids and text;
other columns are left out.
"""

from __future__ import annotations

import codecs
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrilake.llm import worker
from sentrilake.llm.slices import slices, text_slices
from sentrilake.llm.tokens import default_tokenizer

#: Characters of a text that a stream takes at once, and of a run from which on it is encoded while it still grows.
PART = 1 << 16
_LONG_RUN = 4096
#: Bytes of a long run encoded at once, besides the lookahead.
_WINDOW = 8192
_CACHED, _LONGEST_KEY = 150_000, 64
_SMALL = 48
_MERGED_AT_ONCE = 20_000

# The public pattern that cuts texts before the merges.
_CONTRACTION = "'s|'t|'re|'ve|'m|'ll|'d"
_SPACE = r"\p{White_Space}"


def _patterns(letter: str, number: str) -> tuple[regex.Pattern, list[regex.Pattern]]:
    """The pattern of units, and the classes of characters that a run may consist of, white space first."""
    other = rf"[^{_SPACE}{letter}{number}]"
    units = rf"(?V1){_CONTRACTION}| ?{letter}+| ?{number}+| ?{other}+|{_SPACE}+(?!\P{{White_Space}})|{_SPACE}+"
    return regex.compile(units), [regex.compile(f"(?V1){x}*") for x in (_SPACE, letter, number, other)]


_UNITS, _RUNS = _patterns(r"\p{L}", r"\p{N}")


class NewerCharacters(Exception):
    """A text has characters that came to Unicode later than this Python. The regex module may class them
    otherwise than the tokenizers library, so the exact patterns are needed."""


def _newer(text: str) -> bool:
    return not text.isascii() and max(text) >= "\u0370" and any(unicodedata.category(c) == "Cn" for c in text)


@cache
def exact_patterns(path: str) -> tuple[regex.Pattern, list[regex.Pattern]]:
    """The patterns with the library's own classes of newer characters, found by asking it."""
    from tokenizers import Tokenizer

    known = regex.compile(r"[\p{L}\p{N}]")
    newer = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn" and known.match(c)]
    probe = "".join(f"a{c}1" for c in newer)
    starts = {at for _, (at, _) in Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str(probe)}
    # A letter is one unit with the letter before it, a number with the one behind it.
    other = [c for i, c in enumerate(newer) if 3 * i + 1 in starts and 3 * i + 2 in starts]
    out = f"--[{''.join(map(regex.escape, other))}]" if other else ""
    return _patterns(rf"[\p{{L}}{out}]", rf"[\p{{N}}{out}]")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: visible Latin-1 characters for themselves,
    the others moved to U+0100 and up in their order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Cache:
    """Ids of strings as bytes, in two generations of bounded size: what was needed lately stays when the older one
    goes."""

    def __init__(self, most: int = _CACHED):
        self.most, self.known, self.older = most, {}, {}

    def get(self, key: str) -> bytes | None:
        ids = self.known.get(key)
        if ids is None and (ids := self.older.get(key)) is not None:
            self.put(key, ids)
        return ids

    def put(self, key: str, ids: bytes) -> None:
        if len(key) <= _LONGEST_KEY:
            self.update([key], [ids])

    def update(self, keys: list[str], ids: list[bytes]) -> None:
        if len(self.known) >= self.most:
            self.known, self.older = {}, self.known
        self.known.update(zip(keys, ids))

    def new(self, keys: set[str]) -> set[str]:
        """Those of ``keys`` that are not remembered; the others are kept for longer."""
        keys = keys - self.known.keys()
        again = list(keys & self.older.keys())
        self.known.update(zip(again, map(self.older.__getitem__, again)))
        return keys.difference(again)


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<i4").tobytes()


class PairTable:
    """(left id, right id) to a number, looked up for arrays of pairs: open addressing in a table of fixed size."""

    def __init__(self, pairs: dict[tuple[int, int], int], none: int):
        size = 1 << max(4, (4 * len(pairs)).bit_length())
        self.mask, self.none = size - 1, none
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, none, np.int64)
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        values = np.array(list(pairs.values()), np.int64)
        at = self._start(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of several for one place the last stays
            won = self.keys[at] == keys
            self.values[at[won]] = values[won]
            keys, values, at = keys[~won], values[~won], (at[~won] + 1) & self.mask

    def _start(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(40)).astype(np.int64) & self.mask

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at, rest = self._start(keys), np.arange(len(keys))
        out = np.full(len(keys), self.none)
        while len(rest):
            found = self.keys[at]
            hit = found == keys
            out[rest[hit]] = self.values[at[hit]]
            go = ~hit & (found >= 0)
            rest, keys, at = rest[go], keys[go], (at[go] + 1) & self.mask
        return out


class Rules:
    """Merges, bytes and special tokens of a vocabulary file."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        pre, model = data["pre_tokenizer"], data["model"]
        if (model["type"], pre["type"], pre["add_prefix_space"], data["normalizer"]) != ("BPE", "ByteLevel", False, None):
            raise ValueError(f"{path} is no plain byte-level vocabulary")
        vocab, alphabet = model["vocab"], byte_alphabet()
        self.specials = {x["content"]: x["id"] for x in data["added_tokens"]}
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in data["added_tokens"]):
            raise ValueError("special tokens that take in their surroundings are not supported")
        #: Bytes of each id.
        self.bytes = {i: bytes(alphabet[c] for c in token) for token, i in vocab.items()}
        self.bytes |= {i: token.encode() for token, i in self.specials.items()}
        # The same as one run of bytes, for whole arrays of ids.
        self._size = np.zeros(max(self.bytes) + 2, np.int64)  # the last entry is that of ids without a token
        self._size[list(self.bytes)] = [len(x) for x in self.bytes.values()]
        self._first = np.cumsum(self._size) - self._size
        self._run = np.frombuffer(b"".join(self.bytes[i] for i in sorted(self.bytes)), np.uint8)
        self.byte_ids = [0] * 256
        for c, b in alphabet.items():
            self.byte_ids[b] = vocab[c]
        #: (left id, right id) to the rank, which numbers the merged ids.
        self.merges: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        self._parts: dict[int, tuple[int, int]] = {}
        single = set(self.byte_ids)
        for rank, merge in enumerate(model["merges"]):
            x, y = merge if isinstance(merge, list) else merge.split(" ")
            x, y, whole = vocab[x], vocab[y], vocab[x + y]
            if whole in self._parts or whole in single or any(p not in self._parts and p not in single for p in (x, y)):
                raise ValueError("a token of this merge list has several merges, or one before those of its parts")
            self._parts[whole] = x, y
            self.merges[x, y] = rank
            self.merged.append(whole)
        self.lookahead = self._lookahead()
        self._pairs = PairTable(self.merges, len(self.merged))
        self._pieces = Cache()

    def _lookahead(self) -> int:
        """The heaviest chain of merges that can move the border of a change to the left."""
        best: dict[int, int] = {}  # by left part: the heaviest chain so far that ends with such a merge
        for x, y in self.merges:  # in the order of their ranks
            chain, edge = 0, y
            while True:
                chain = max(chain, best.get(edge, 0))
                if edge not in self._parts:
                    break
                edge = self._parts[edge][0]
            best[x] = max(best.get(x, 0), chain + len(self.bytes[x]))
        return max(best.values(), default=0)

    def token_bytes(self, ids: np.ndarray) -> bytes:
        """The joined bytes of ids; those without a token have none."""
        ids = np.asarray(ids, np.int64)
        ids = np.where((ids < 0) | (ids >= len(self._size)), len(self._size) - 1, ids)
        size = self._size[ids]
        place = np.repeat(self._first[ids] - (np.cumsum(size) - size), size)
        return self._run[place + np.arange(len(place))].tobytes()

    def merge(self, data: bytes) -> list[int]:
        """Ids of bytes that are known in full: merges by rank, then from left to right."""
        ids = [self.byte_ids[b] for b in data]
        return self._merge_small(ids) if len(ids) <= _SMALL else self._merge_large(ids)

    def _merge_small(self, ids: list[int]) -> list[int]:
        get, none = self.merges.get, len(self.merged)
        ranks = [get(p, none) for p in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            whole = ids[i] = self.merged[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], whole), none)
            if i < len(ranks):
                ranks[i] = get((whole, ids[i + 1]), none)
        return ids

    def _merge_large(self, ids: list[int]) -> list[int]:
        """The same by a heap of pairs over a linked list."""
        n, get = len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i) for i in range(n - 1) if (rank := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j, whole = after[i], self.merged[rank]
            if ids[i] < 0 or j >= n or (ids[i], ids[j]) != self._parts[whole]:
                continue  # one of its parts was merged otherwise
            ids[i], ids[j] = whole, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (rank := get((whole, ids[k]))) is not None:
                    heapq.heappush(heap, (rank, i))
            h = before[i]
            if h >= 0 and (rank := get((ids[h], whole))) is not None:
                heapq.heappush(heap, (rank, h))
        return [x for x in ids if x >= 0]

    def merge_many(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` of many short units at once, given as their bytes one after the other and their sizes: every step
        makes the next merge of each that has one. Returns their ids in the same way."""
        none, merged = len(self.merged), np.array(self.merged, np.int64)
        ids, owner = np.array(self.byte_ids, np.int64)[data], np.repeat(np.arange(len(size)), size)
        done_ids, done_owner = [], []
        ranks = np.full(len(ids), none)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        ranks[inner] = self._pairs(ids[inner], ids[inner + 1])
        while len(ids):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            least = np.minimum.reduceat(ranks, starts)
            counts = np.diff(np.append(starts, len(ids)))
            open_ = np.repeat(least < none, counts)
            done_ids.append(ids[~open_])
            done_owner.append(owner[~open_])
            least = np.repeat(least, counts)[open_]
            ids, owner, ranks = ids[open_], owner[open_], ranks[open_]
            at = np.flatnonzero(ranks == least)
            at = at[np.concatenate([[True], owner[at][1:] != owner[at][:-1]])] if len(at) else at
            ids[at] = merged[ranks[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))  # one entry goes behind each place
            ids, owner, ranks = ids[keep], owner[keep], ranks[keep]
            for place in (at[at > 0] - 1, at):
                ranks[place] = none
                same = place[place + 1 < len(ids)]
                same = same[owner[same] == owner[same + 1]]
                ranks[same] = self._pairs(ids[same], ids[same + 1])
        ids, owner = np.concatenate(done_ids or [ids]), np.concatenate(done_owner or [owner])
        order = np.argsort(owner, kind="stable")
        return ids[order].astype("<i4"), np.bincount(owner, minlength=len(size))

    def learn(self, texts: list[str]) -> None:
        """Remember the pieces of texts that are about to be encoded, all new units merged together."""
        new = self._pieces.new(set().union(*(x.split(" ") for x in texts)))
        pieces = [p for p in new if p and len(p) <= _LONGEST_KEY and not p[0].isspace()]
        for at in range(0, len(pieces), _MERGED_AT_ONCE):
            part = pieces[at : at + _MERGED_AT_ONCE]
            text = " " + " ".join(part)
            if _newer(text):
                part = [p for p in part if not _newer(p)]
                text = " " + " ".join(part)
            if not part:
                continue
            data = np.frombuffer(text.encode(), np.uint8)
            first = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # bytes that begin a character
            borders = first[np.cumsum([0, *map(len, _UNITS.findall(text))])]
            ids, count = self.merge_many(data, np.diff(borders))
            # A piece has no space inside, so its first unit is the one that begins with a space.
            begin = np.flatnonzero(data[borders[:-1]] == 0x20)
            ends = np.append(4 * (np.cumsum(count) - count)[begin], 4 * len(ids)).tolist()
            found = ids.tobytes()
            self._pieces.update(part, [found[a:b] for a, b in zip(ends, ends[1:])])

    def units(self, units: list[str], exact: bool, out: list[bytes]) -> None:
        """Append the ids of whole units."""
        for unit in units:
            ids = self._pieces.known.get(unit[1:]) if unit[0] == " " else None
            if ids is None:
                if not exact and _newer(unit):
                    raise NewerCharacters
                ids = packed(self.merge(unit.encode()))
            out.append(ids)

    def pieces(self, pieces: list[str], out: list[bytes]) -> bool:
        """Append the ids of pieces that stand behind a space each. False, with nothing of use in ``out``, if one is
        empty or begins with white space: then its space is part of a run."""
        found = list(map(self._pieces.known.get, pieces))
        if None in found:
            for i, piece in enumerate(pieces):
                if found[i] is None:
                    if not piece or piece[0].isspace():
                        return False
                    found[i] = self._piece(piece)
        out += found
        return True

    def _piece(self, piece: str) -> bytes:
        ids = self._pieces.get(piece)
        if ids is None:
            found: list[bytes] = []
            self.units(_UNITS.findall(" " + piece), False, found)
            ids = b"".join(found)
            self._pieces.put(piece, ids)
        return ids


class RunWindow:
    """Ids of one unit that arrives in parts: the window holds the lookahead and at most ``_WINDOW`` bytes more."""

    def __init__(self, rules: Rules, window: int = _WINDOW):
        self.rules, self.window, self.data = rules, window, bytearray()

    def push(self, data: bytes) -> list[int]:
        out, size = [], self.window + self.rules.lookahead
        for at in range(0, len(data), self.window):
            self.data += data[at : at + self.window]
            if len(self.data) >= size:
                stable, end = len(self.data) - self.rules.lookahead, 0
                for token in self.rules.merge(bytes(self.data)):
                    if end + len(self.rules.bytes[token]) > stable:
                        break
                    end += len(self.rules.bytes[token])
                    out.append(token)
                del self.data[:end]
        return out

    def finish(self) -> list[int]:
        return self.rules.merge(bytes(self.data))


class EncodeStream:
    """Encodes a text given part by part. The states are: between units, with the start of a unit held back; and
    inside a long run of one class of characters, whose bytes go through a window. Without ``exact`` a faster
    pattern is used, and ``NewerCharacters`` is raised where it may be wrong."""

    def __init__(self, rules: Rules, long_run: int = _LONG_RUN, window: int = _WINDOW, exact: bool = True):
        self.rules, self.long_run, self.window, self.exact = rules, long_run, window, exact
        self.pattern, self.runs = exact_patterns(rules.path) if exact else (_UNITS, _RUNS)
        self.held, self.run, self.open = "", None, None
        self.unread = ""
        names = sorted(rules.specials, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None

    def push(self, text: str) -> bytes:
        """The ids settled so far and not given out yet, as little-endian 32-bit numbers."""
        return self._split(text, False)

    def finish(self) -> bytes:
        return self._split("", True)

    def _split(self, text: str, last: bool) -> bytes:
        """Cuts at special tokens; an end that may begin one waits."""
        out: list[bytes] = []
        text, at = self.unread + text, 0
        self.unread = ""
        if self.special:
            for found in self.special.finditer(text):
                self._units(text[at : found.start()], True, out)
                out.append(packed([self.rules.specials[found[0]]]))
                at = found.end()
            if not last:
                rest = len(text) - at
                for size in range(min(rest, max(map(len, self.rules.specials)) - 1), 0, -1):
                    if any(x.startswith(text[len(text) - size :]) for x in self.rules.specials):
                        self.unread = text[len(text) - size :]
                        break
        self._units(text[at : len(text) - len(self.unread)], last, out)
        return b"".join(out)

    def _units(self, text: str, last: bool, out: list[bytes]) -> None:
        text = self.held + text
        self.held = ""
        if self.run:
            text = self._continue(text, last, out)
            if self.run:
                return
        if not self.exact:
            # A space before a visible character is a border that nothing behind it can move.
            first, *pieces = text.split(" ")
            if len(pieces) > 1 and pieces[-1] and not pieces[-1][0].isspace():
                found: list[bytes] = []
                self.rules.units(self.pattern.findall(first), False, found)
                if self.rules.pieces(pieces[:-1], found):
                    out += found
                    text = " " + pieces[-1]
        units = self.pattern.findall(text)
        if last or not units:
            self.rules.units(units, self.exact, out)
            return
        # The last unit may grow. An apostrophe before it may turn out to begin a contraction.
        self.held = units.pop()
        if len(self.held) > self.long_run:
            self.rules.units(units, self.exact, out)
            start, self.held = self.held, ""
            self.run = next(x for x in self.runs if x.fullmatch(start[-1]))
            self.open = RunWindow(self.rules, self.window)
            if self.run is not self.runs[0] and start[0] == " ":
                out.append(packed(self.open.push(b" ")))
                start = start[1:]
            self._continue(start, False, out)
            return
        if units and units[-1] == "'":
            self.held = units.pop() + self.held
        self.rules.units(units, self.exact, out)

    def _continue(self, text: str, last: bool, out: list[bytes]) -> str:
        """Feeds the run; returns the text behind it once it has ended. Before other characters the last white
        space of a run belongs to what follows, so it waits."""
        end = self.run.match(text).end()
        ended = end < len(text)
        if self.run is self.runs[0] and (ended or not last):
            end = max(0, end - 1)
        if not self.exact and _newer(text[:end]):
            raise NewerCharacters
        out.append(packed(self.open.push(text[:end].encode())))
        if ended or last:
            out.append(packed(self.open.finish()))
            self.run = self.open = None
            return text[end:]
        self.held = text[end:]
        return ""


class DecodeStream:
    """Text of ids given part by part. The state is the beginning of a character whose bytes are not all known."""

    def __init__(self, rules: Rules):
        self.rules = rules
        self.text = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: np.ndarray) -> str:
        return self.text.decode(self.rules.token_bytes(ids))

    def finish(self) -> str:
        return self.text.decode(b"", True)


def encode_text(rules: Rules, text: str) -> np.ndarray:
    """Ids of a text, part by part."""
    for exact in (False, True):
        stream, out = EncodeStream(rules, exact=exact), []
        try:
            out += [stream.push(text[at : at + PART]) for at in range(0, len(text), PART)]
            out.append(stream.finish())
            return np.frombuffer(b"".join(out), "<i4")
        except NewerCharacters:
            continue
    raise AssertionError("the exact patterns know every character")


def decode_ids(rules: Rules, ids: np.ndarray) -> str:
    """Text of ids, part by part."""
    stream = DecodeStream(rules)
    return "".join([*(stream.push(ids[at : at + PART]) for at in range(0, len(ids), PART)), stream.finish()])


_RULES: dict[str, Rules] = worker.keeps()


def rules(path: str | None = None) -> Rules:
    """The rules of this Python worker, by default those of the public vocabulary; they live as long as it."""
    path = path or default_tokenizer()
    if path not in _RULES:
        _RULES[path] = Rules(path)
    return _RULES[path]


def encode_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, ids. One pass, no shuffle."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = rules(tokenizer)
        for part, texts in text_slices(batches):
            known.learn(texts)
            found = [encode_text(known, x) for x in texts]
            ends = np.cumsum([0, *map(len, found)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found), pa.int32()))
            yield pa.RecordBatch.from_arrays([part["doc_id"], ids], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(encode, "doc_id long, ids array<int>")


def decode_documents(rows: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``rows`` (doc_id, ids) with their text. One pass, no shuffle."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = rules(tokenizer)
        for batch in batches:
            for part in slices(batch, "ids"):
                ids = part["ids"].flatten().fill_null(-1).to_numpy()
                ends = np.cumsum(part["ids"].value_lengths().fill_null(0).to_numpy()).tolist()
                text = pa.array([decode_ids(known, ids[a:b]) for a, b in zip([0, *ends], ends)], pa.string())
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["ids"], text], ["doc_id", "ids", "text"])

    chosen = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return chosen.mapInArrow(decode, "doc_id long, ids array<int>, text string")
