"""Token ids by a public byte-level BPE tokenizer, with a bounded cache of words.

Pre-tokens of the byte-level pattern never cross a space that stands before a
visible character, so a text is the sequence of its units between such spaces.
Units repeat often: each is encoded once by the tokenizers library and then
looked up. A slice of texts is split and its units are numbered by Arrow, so that
only distinct units become Python objects, and the ids are put together by Arrow too.
A unit that is not known is cut behind its first word, so that a word with a comma needs no
encoding of its own. Ids are kept as little-endian 16-bit numbers, which is checked
against the vocabulary size.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sentrilake.llm import worker

# A space is a border if the next character is visible in every definition of white space.
_BORDER = re.compile(" (?=[!-~¡-ᙿ])")
_VISIBLE = re.compile("[!-~¡-ᙿ]").match
# A word that the byte-level pattern ends before what follows: letters of Latin-1, then no letter. What follows is encoded on its own.
_WORD = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+(?=[\n!-@\\[-`{-~])").match
_PATTERN = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_CACHED_UNITS = 500_000
_LONGEST_UNIT = 40
_BATCH = 20_000


def default_tokenizer() -> str:
    """Path of the public vocabulary on the machine that runs the task."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes texts to bytes of 16-bit ids; equal to the library's own encoding."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary need more than 16 bits")
        vocab = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocab.values()) + 1, bool)
        self.begins[[i for token, i in vocab.items() if token[0] == "\u0120"]] = True
        pattern = self.tokenizer.pre_tokenizer and json.loads(self.tokenizer.pre_tokenizer.__getstate__())
        self.by_pattern = not self.tokenizer.normalizer and pattern and pattern.items() >= _PATTERN.items()
        # Two generations: what the last texts needed stays when the older one goes.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}  # what follows the first word of a unit

    def _encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), _BATCH):
            found = self.tokenizer.encode_batch_fast(texts[i : i + _BATCH], add_special_tokens=False)
            out += [np.array(x.ids, "<u2").tobytes() for x in found]
        return out

    def _encode_units(self, units: list[str]) -> list[bytes]:
        """Units with their space in front. Joined to longer texts the library is faster; a unit
        without a space inside begins where a token begins with a space."""
        plain = [u for u in units if " " not in u]
        found = {}
        for i in range(0, len(plain), _BATCH):
            part = plain[i : i + _BATCH]
            joined = [" " + " ".join(part[j : j + 50]) for j in range(0, len(part), 50)]
            ids = np.frombuffer(b"".join(self._encode(joined)), "<u2")
            at = np.flatnonzero(self.begins[ids])
            assert len(at) == len(part)
            ends = [*(at[1:] * 2).tolist(), ids.nbytes]
            data = ids.tobytes()
            found.update(zip(part, map(data.__getitem__, map(slice, (at * 2).tolist(), ends))))
        odd = [u for u in units if " " in u]
        found.update(zip(odd, self._encode([" " + u for u in odd])))
        return [found[u] for u in units]

    def _learn(self, units: set[str]) -> None:
        """Units that are not known."""
        again = units & self.older.keys()
        self.known.update(zip(again, map(self.older.__getitem__, again)))
        new = list(units - again)
        self.known.update(zip(new, self._encode_units(new)))

    def _lookup(self, units: list[str], found: list[bytes | None]) -> None:
        """Fills the gaps of ``found`` with the ids of units with their space in front; each begins with a visible character."""
        known = self.known
        whole, cut, words, tails = [], [], [], []
        for i in [i for i, x in enumerate(found) if x is None]:
            unit = units[i]
            word = None if unit.isalpha() or len(unit) > _LONGEST_UNIT or not self.by_pattern else _WORD(unit)
            if word:
                cut.append(i)
                words.append(word[0])
                tails.append(unit[word.end() :])
            else:
                whole.append(i)
        new = {units[i] for i in whole}
        new.update(words)
        self._learn(new - known.keys())
        if len(self.tails) > _CACHED_UNITS:
            self.tails = {}
        more = list(set(tails) - self.tails.keys())
        self.tails.update(zip(more, self._encode(more)))
        for i in whole:
            found[i] = known[units[i]]
        for i, word, tail in zip(cut, words, tails):
            found[i] = known[word] + self.tails[tail]
        for unit in new:
            if len(unit) > _LONGEST_UNIT:
                del known[unit]

    def encode(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the place where each text's ids end. ``end`` is put after each."""
        if not len(texts):
            return np.zeros(0, "<u2"), np.zeros(0, np.int64)
        if len(self.known) > _CACHED_UNITS:
            self.known, self.older = {}, self.known
        lists = pc.split_pattern(texts, " ")
        at = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.flatten()
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        # The first unit of a text has no space in front of it.
        heads = flat.take(pa.array(at[:-1])).to_pylist()
        rest = np.ones(len(codes), bool)
        rest[at[:-1]] = False
        used = np.zeros(len(coded.dictionary), bool)
        used[codes[rest]] = True
        units = coded.dictionary.filter(pa.array(used)).to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, units))
        # After such a unit's space no visible character stands: the texts are split anew.
        odd = [i for i, x in enumerate(found) if x is None and not _VISIBLE(units[i])]
        more: dict[int, list[str]] = {}
        if odd:
            is_odd = np.zeros(len(used), bool)
            is_odd[np.flatnonzero(used)[odd]] = True
            places = np.flatnonzero(rest & is_odd[codes])
            for i in np.unique(np.searchsorted(at, places, side="right") - 1).tolist():
                heads[i], *more[i] = _BORDER.split(texts[i].as_py())
                rest[at[i] : at[i + 1]] = False
            for i in odd:
                found[i] = b""
            units += {u for x in more.values() for u in x}
            found += map(self.known.get, units[len(found) :])
        self._lookup(units, found)
        first = self._encode(heads)
        if more:
            ids_of = dict(zip(units, found))
            for i, x in more.items():
                first[i] += b"".join(map(ids_of.__getitem__, x))
        if end:
            first = [*first, end]
        values = pa.array(found + first, pa.large_binary())
        codes = (np.cumsum(used) - 1)[codes]
        codes[at[:-1]] = len(units) + np.arange(len(texts))
        rest[at[:-1]] = True
        count = np.cumsum(np.concatenate([[0], rest]))[at[1:]]
        codes = codes[rest]
        if end:
            codes = np.insert(codes, count, len(values) - 1)
            count = count + np.arange(1, len(texts) + 1)
        joined = values.take(pa.array(codes))
        ends = np.frombuffer(joined.buffers()[1], np.int64, len(codes) + 1)[count]
        data = joined.buffers()[2]
        ids = np.frombuffer(data, "<u2", int(ends[-1]) // 2) if data else np.zeros(0, "<u2")
        return ids, ends // 2

    def __call__(self, texts: list[str]) -> list[bytes]:
        ids, ends = self.encode(pa.array(texts, pa.large_string()))
        data, ends = ids.tobytes(), (ends * 2).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]


_ENCODERS: dict[str, Encoder] = worker.keeps()


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker; it lives until the worker gets a task of another kind."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
