"""Token ids by the ``tokenizers`` library, with a cache of whole words.

``Encoder.ids`` gives exactly what ``Tokenizer.encode(text,
add_special_tokens=False)`` gives, as little-endian unsigned 32-bit ids in
one bytes object. The library spends most of its time on splitting texts and
on words it has merged before; so a text in which only ASCII and Latin-1
letters, digits, marks and white space occur is cut into words here, each
distinct word goes through the library's model once, and later ones are
looked up. ``Encoder.many`` does so for many texts at once: Arrow numbers
their words, and only the distinct ones are looked up. Any other text,
tokenizers of another make, and texts that spell an added token go through
the library whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from urlatlas.llm.common import kept

#: Letters of the plain texts: \p{L} in ASCII and Latin-1 beyond U+00C0. Fixed by Unicode.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN = re.compile(rf"[\t\n\r !-~{LETTERS}]*")
#: The public split patterns of the two tokenizers, restricted to plain texts (fixed values).
BYTE_LEVEL = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
LOWER_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+")
LOWER_WORDS_SOURCE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the rest follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + k) for k, b in enumerate(rest)}}


class _Words(dict):
    """Bounded cache: word -> id bytes, filled by ``make``. Words not met lately are forgotten."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.make(word)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    """Encodes texts with the tokenizer file at ``path``; ``cache`` words are kept, or twice as many."""

    def __init__(self, path: str, cache: int = 300_000):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.added = [t["content"] for t in made["added_tokens"]]
        self.kind = _kind(made)
        self.letters = "".join(c for _, c in sorted(_byte_letters().items()))
        self.raw = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.units = _Words(self._unit, cache)
        self.words = _Words(self._spaced if self.kind == "byte" else self._lower, cache)

    def _unit(self, unit: str) -> bytes:
        raw, mapped = self.raw, unit.encode("utf-8").decode("latin-1").translate(self.letters)
        return b"".join([raw[t.id] for t in self.model.tokenize(mapped)])

    def _spaced(self, word: str) -> bytes:
        if word.isalpha():  # of a plain text: letters alone
            return self._unit(" " + word)
        units = BYTE_LEVEL.findall(" " + word)
        if len(units) == 1:
            return self._unit(units[0])
        return b"".join([self.words[u[1:]] if u[0] == " " and len(u) > 1 else self.units[u] for u in units])

    def _lower(self, word: str) -> bytes:
        units = LOWER_WORDS.findall(word.lower())
        if len(units) == 1:
            return self._unit(units[0])
        return b"".join(map(self.words.__getitem__, units))

    def _plain(self, text: str) -> bool:
        return bool(self.kind) and PLAIN.fullmatch(text) is not None and not any(a in text for a in self.added)

    def many(self, texts: list[str], size: int = 1 << 22) -> Iterator[bytes]:
        """``ids`` of each text in turn, worked on in runs of about ``size`` code points."""
        run, held = [], 0
        for text in texts:
            run.append(text)
            held += len(text)
            if held >= size:
                yield from self._run(run)
                run, held = [], 0
        yield from self._run(run)

    def _run(self, texts: list[str]) -> Iterator[bytes]:
        split = [self._plain(t) and (self.kind == "lower" or "  " not in t) for t in texts]
        cut = iter(self._cut([t for t, s in zip(texts, split) if s]))
        return (next(cut) if s else self.ids(t) for t, s in zip(texts, split))

    def _cut(self, texts: list[str]) -> list[bytes]:
        """Ids of plain texts whose words stand between single spaces."""
        words = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        ends = words.offsets.to_numpy()
        flat = words.values.dictionary_encode()
        number = flat.indices.to_numpy().copy()
        found = [self.words[w] for w in flat.dictionary.to_pylist()]
        if self.kind == "byte":  # a text's first word has no space before it
            number[ends[:-1]] = np.arange(len(found), len(found) + len(texts))
            found += [b"".join(map(self.units.__getitem__, BYTE_LEVEL.findall(t.partition(" ")[0]))) for t in texts]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        start = np.cumsum(size) - size
        n = size[number]
        upto = np.concatenate([[0], np.cumsum(n)])
        place = np.repeat(start[number] - upto[:-1], n) + np.arange(upto[-1])
        ids = np.frombuffer(b"".join(found), "<u4")[place].tobytes()
        cuts = (4 * upto[ends]).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def ids(self, text: str) -> bytes:
        if not self._plain(text):
            got = self.tokenizer.encode(text, add_special_tokens=False).ids
            return b"".join([i.to_bytes(4, "little") for i in got])
        if self.kind == "lower":
            return b"".join(map(self.words.__getitem__, text.split(" ")))
        if "  " in text:  # runs of spaces are units of their own: cut at single spaces between words only
            return b"".join(map(self.units.__getitem__, BYTE_LEVEL.findall(text)))
        first, *words = text.split(" ")
        start = b"".join(map(self.units.__getitem__, BYTE_LEVEL.findall(first)))
        return start + b"".join(map(self.words.__getitem__, words))


def _kind(made: dict) -> str:
    """Which of the two known makes a tokenizer file is of, or '' for any other."""
    pre, norm, model = made["pre_tokenizer"] or {}, made["normalizer"], made["model"]
    if model["type"] != "BPE" or model.get("dropout") or made["truncation"] or made["padding"]:
        return ""
    if pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and norm is None:
        return "byte"
    steps = pre.get("pretokenizers", [])
    if ([s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": LOWER_WORDS_SOURCE}
            and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not steps[1]["use_regex"]
            and not steps[1]["add_prefix_space"]
            and [n["type"] for n in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]):
        return "lower"
    return ""


def encoder(path: str, cache: int = 300_000) -> Encoder:
    """The encoder of this Python worker for ``path``; tasks of one worker share it."""
    return kept(("encoder", path, cache), lambda: Encoder(path, cache))
