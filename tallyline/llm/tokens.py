"""Token ids of texts by the ``tokenizers`` library, each distinct word encoded once per worker.

Byte-level tokenizers split a text before a single space between two other characters, whatever stands around it, so a
text's ids are those of its words, each with the space before it, one after the other. Texts with other white space next
to a space are cut only at such places. Words of ASCII characters and Latin letters are cut into pieces here, and the
pieces go to the tokenizer's model. A worker keeps the ids of recent words in two generations, each bounded by its bytes.
Texts for tokenizers of another kind are encoded whole.

Ids are little-endian unsigned 32-bit integers in bytes.
"""

from __future__ import annotations

import json
import os
import re
import struct
from functools import lru_cache

import pyarrow as pa

from tallyline.llm import words as W

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

REMEMBERED_BYTES = 96 << 20
ENTRY_BYTES = 160  # of the objects and places of one remembered word, beside its letters and ids
TEXT_BYTES = 2 << 20
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+")
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
# The tokenizer's pattern for texts of ASCII characters and Latin letters, in which single line ends may stand.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[!-/:-@\[-`{-~]+|\n(?=\S)")
SPACE = "Ġ"
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [byte for byte in range(256) if byte not in plain]
    return {byte: chr(byte) for byte in plain} | {byte: chr(256 + n) for n, byte in enumerate(others)}


LETTERS = byte_letters()


class Encoder:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        splitter = self.tokenizer.pre_tokenizer
        settings = json.loads(splitter.__getstate__()) if splitter is not None else {}
        self.model = self.tokenizer.model
        self.by_words = (
            {name: settings.get(name) for name in BYTE_LEVEL} == BYTE_LEVEL
            and self.tokenizer.normalizer is None
            and type(self.model).__name__ == "BPE"
            and not self.model.dropout
        )
        self.pieces: dict[str, bytes] = {"\n": self.direct(["\n"])[0]}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.young_bytes = self.piece_bytes = 0

    def direct(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [pack(one.ids) for one in encoded]

    def piece(self, text: str) -> bytes:
        """Ids of one piece of a text, as the tokenizer's pattern cuts it; those after a space are remembered as parts."""
        known, name = (self.young, text[1:]) if text[0] == " " else (self.pieces, text)
        found = known.get(name)
        if found is None:
            found = self.old.get(name) if known is self.young else None
            if found is None:
                letters = text.replace(" ", SPACE) if text.isascii() else text.encode().decode("latin-1").translate(LETTERS)
                found = pack([token.id for token in self.model.tokenize(letters)])
            known[name] = found
            if known is self.young:
                self.young_bytes += ENTRY_BYTES + len(name) + len(found)
            else:
                self.piece_bytes += ENTRY_BYTES + len(name) + len(found)
        return found

    def learn(self, parts: set[str]) -> set[str]:
        """Remembers the ids of the parts that stand after a space; returns the parts that mustn't be cut off."""
        young, old, tokenize = self.young, self.old, self.model.tokenize
        unsafe, whole = set(), []
        held = 0
        for part in parts:
            found = old.get(part)
            if found is None:
                if part.isascii() and part.isalpha():
                    found = pack([token.id for token in tokenize(SPACE + part)])
                elif LATIN.fullmatch(part):
                    self.piece(f" {part}")
                    continue
                elif not part or part[0].isspace() or part[-1].isspace():
                    unsafe.add(part)
                    continue
                else:
                    pieces = PIECES.findall(f" {part}")
                    if sum(map(len, pieces)) != len(part) + 1 or "<|" in part:
                        whole.append(part)
                        continue
                    found = b"".join(map(self.piece, pieces))
            young[part] = found
            held += ENTRY_BYTES + len(part) + len(found)
        for part, found in zip(whole, self.direct([f" {part}" for part in whole]), strict=True):
            young[part] = found
            held += ENTRY_BYTES + len(part) + len(found)
        self.young_bytes += held
        return unsafe

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            return self.direct(texts)
        if self.young_bytes > REMEMBERED_BYTES:
            self.old, self.young, self.young_bytes = self.young, {}, 0
        if self.piece_bytes > REMEMBERED_BYTES // 4:
            self.pieces, self.piece_bytes = {"\n": self.direct(["\n"])[0]}, 0
        cut = [text.split(" ") for text in texts]
        unsafe = self.learn(set().union(*cut).difference(self.young))
        if unsafe:
            for place, parts in enumerate(cut):
                if not unsafe.isdisjoint(parts[1:]):
                    cut[place] = SAFE_CUT.split(texts[place])
                    self.learn(set(cut[place][1:-1]).difference(self.young))
        heads = self.direct([parts[0] for parts in cut])
        known = self.young.__getitem__
        out = []
        for head, parts in zip(heads, cut, strict=True):
            try:
                out.append(head + b"".join(map(known, parts[1:])))
            except KeyError:  # a text that ends in white space, after which nothing is cut
                out.append(head + b"".join(map(known, parts[1:-1])) + self.direct([f" {parts[-1]}"])[0])
        return out


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded(path: str, batch: pa.RecordBatch, column: str = "text"):
    """Parts of the batch with the ids of their texts."""
    own = encoder(path)
    for part in W.slices(batch, column, TEXT_BYTES):
        yield part, own.encode([text or "" for text in part.column(column).to_pylist()])
