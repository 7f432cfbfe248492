"""Token ids of whole texts, by the ``tokenizers`` library and a cache of what it said.

Both kinds of tokenizer handled here split a text into pre-tokens before any
merge, and never across the borders that texts are cut at here; so the ids of a
text are the ids of its pieces in order. The library's model encodes a piece
once and the result is remembered, up to a bound in entries and in the length of
a piece, that is, in bytes. Texts of Latin letters, digits and signs are split by
the rules below; in other texts, white space parts the chunks that need the
library's whole chain from those that don't. Texts with odd white space or with
the string of an added (special) token, and tokenizers of another make, go
through the library whole.
"""

from __future__ import annotations

import functools
import gc
import json
import re
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from chronofold.llm.common import REMEMBERED

#: White space for Python but not for the tokenizers' patterns, or the other way round.
ODD_SPACE = re.compile("[\x1c-\x1f\x85᠎]")
ODD_ASCII = "\x1c\x1d\x1e\x1f"
OTHER_SPACE = re.compile(r"[^\S \n]")
SPACED = re.compile(r" ?\S+|\s+(?!\S)|\s+")
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
ODD_CHAR = re.compile(rf"[^\x00-\x7f{LETTERS}]")
#: How the two pre-tokenizers split plain text.
BYTE_SPLIT = re.compile(rf" ?[{LETTERS}]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
WORD_SPLIT = re.compile(rf"[{LETTERS}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\s{LETTERS}0-9]+")
BORDER = re.compile(r"(?<=\S) (?=\S)")
SLICE = 1 << 20  # characters that are split at once
GROUP = 4 << 20  # characters of texts whose distinct chunks are taken together
CACHE_ENTRIES, CACHE_PIECE = 800_000, 64
assert array("I").itemsize == 4 and sys.byteorder == "little"


def byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for code points from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = (b for b in range(256) if b not in plain)
    return {b: 256 + k for k, b in enumerate(other)}


class _Cache(dict):
    """Ids by piece; ``make`` encodes a piece that isn't known. Long pieces are not kept."""

    def __init__(self, make, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.entries = make, entries
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.entries // 2:  # what is still in use comes back from the older half
            self.older = dict(self)
            self.clear()
        ids = self.older.get(piece)
        if ids is None:
            ids = self.make(piece)
            if len(piece) > CACHE_PIECE:
                return ids
        self[piece] = ids
        return ids


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids as bytes."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.space = chr(self.letters[32])
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # every piece comes here once: a second cache costs time only
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        added = made.get("added_tokens") or []
        self.added = [a["content"].lower() for a in added]
        strict = any(a["content"].split() != [a["content"]] or a.get("lstrip") or a.get("rstrip") or a.get("single_word") for a in added)
        self.kind = "" if strict else self._kind(made)
        self.split = BYTE_SPLIT if self.kind == "byte" else WORD_SPLIT
        self.cache = _Cache(self._make, entries)

    @staticmethod
    def _kind(made: dict) -> str:
        """The split rule that holds for this tokenizer: "byte", "word", or "" for none of them."""
        pre, norm = made.get("pre_tokenizer") or {}, made.get("normalizer")
        if made["model"].get("type") != "BPE" or made["model"].get("dropout"):
            return ""
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
            return "byte"
        steps = pre.get("pretokenizers", [])
        wanted = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        if [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"].get("Regex") == wanted and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"] and [s["type"] for s in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            return "word"
        return ""

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _make(self, piece: str) -> bytes:
        if not piece.isascii() and ODD_CHAR.search(piece):
            return self._whole(piece)
        if piece.isascii() and piece.isprintable():  # only a space at the front has another letter
            mapped = piece if piece[0] != " " else self.space + piece[1:]
        else:
            mapped = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _slices(self, text: str) -> Iterator[str]:
        """The text cut at single spaces between words, so that memory is bounded; no pre-token goes across."""
        at = 0
        while len(text) - at > SLICE:
            border = BORDER.search(text, at + SLICE)
            if not border:
                break
            yield text[at : border.start()]
            at = border.start()
        yield text[at:] if at else text

    def _slice(self, text: str) -> bytes:
        low = text.lower()
        if ODD_SPACE.search(text) or any(a in low for a in self.added):
            return self._whole(text)
        word, known = self.kind == "word", self.cache.__getitem__
        if text.isascii() or not ODD_CHAR.search(text):
            return b"".join(map(known, self.split.findall(low if word else text)))
        return b"".join(map(self._chunk, text.split() if word else SPACED.findall(text)))

    def encode(self, text: str) -> bytes:
        if not self.kind:
            return self._whole(text)
        if len(text) <= SLICE:
            return self._slice(text)
        return b"".join(map(self._slice, self._slices(text)))

    def _plain(self, text: str) -> bool:
        """Can the text be cut at its white space, with nothing else to look at?"""
        if not self.kind or not text or len(text) > SLICE:
            return False
        if any(c in text for c in ODD_ASCII) if text.isascii() else ODD_SPACE.search(text):
            return False
        if self.kind == "byte":  # single spaces and line ends between words, and no other white space
            if text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
                return False
            if any(c in text for c in "\t\r\x0b\x0c") if text.isascii() else OTHER_SPACE.search(text):
                return False
        low = text.lower()
        return not any(a in low for a in self.added)

    def _group(self, texts: list[str]) -> list[bytes]:
        """Ids of plain texts: each distinct chunk between white space is encoded once, its ids are copied to its places."""
        given = pa.array(texts, pa.large_string())
        if self.kind == "word":
            chunks = pc.ascii_split_whitespace(given)
        else:
            chunks = pc.split_pattern(pc.replace_substring(given, "\n", " \n"), " ")
        ends = chunks.offsets.to_numpy()
        coded = chunks.values.dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.kind == "byte":  # the first chunk of a text has no space before it
            firsts = ends[:-1]
            words = [w if w[:1] == "\n" else " " + w for w in words] + [texts[k].split(" ", 1)[0].split("\n", 1)[0] for k in range(len(texts))]
            code[firsts] = len(words) - len(texts) + np.arange(len(texts))
        known, split, lower = self.cache.__getitem__, self.split.findall, self.kind == "word"
        ids = [b"".join(map(known, split(w.lower() if lower else w))) if w.isascii() else self._chunk(w) for w in words]
        placed = pa.array(ids, pa.large_binary()).take(pa.array(code))
        at, data = np.frombuffer(placed.buffers()[1], dtype=np.int64)[ends], placed.buffers()[2]
        return [data.slice(a, b - a).to_pybytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]

    def _chunk(self, chunk: str) -> bytes:
        if not chunk.isascii() and ODD_CHAR.search(chunk):
            return self.cache[chunk]
        return b"".join(map(self.cache.__getitem__, self.split.findall(chunk.lower() if self.kind == "word" else chunk)))

    def encode_all(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text; null is an empty one."""
        texts = [t or "" for t in texts]
        out, group, size = [b""] * len(texts), [], 0
        for k, t in enumerate(texts):
            if not self._plain(t):
                out[k] = self.encode(t)
                continue
            group.append(k)
            size += len(t)
            if size >= GROUP:
                for j, ids in zip(group, self._group([texts[j] for j in group])):
                    out[j] = ids
                group, size = [], 0
        if group:
            for j, ids in zip(group, self._group([texts[j] for j in group])):
                out[j] = ids
        return out


@functools.lru_cache(maxsize=1)
def encoder(path: str, entries: int = CACHE_ENTRIES) -> Encoder:
    """One encoder in a worker process at a time, with its cache of ``entries`` pieces."""
    return Encoder(path, entries)


def drop_encoder() -> None:
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        gc.collect()  # an encoder and its cache hold each other


REMEMBERED["tokens"] = drop_encoder
