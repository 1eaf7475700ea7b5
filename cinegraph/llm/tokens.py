"""Token ids of whole texts, with what recurs kept between texts.

The tokenizer drops white space and never joins what it separates, so the ids of a text are those of its words one
after the other. The library's model sees each different piece once a worker; the rest is look-up.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from struct import pack

import numpy as np

#: The vocabulary file, by its name among the public tokenizers or as a path that every worker has.
VOCABULARY = "word_bpe_49k.json"
#: Pieces of which a worker keeps the ids; the older half goes when the table is full.
KEPT = 1_400_000

#: Latin-1 letters and, behind them, ASCII marks but apostrophes: the tokenizer cuts a word between the two.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
CUT = re.compile(f"([{LETTERS}]*)([{MARKS}]*)")
#: Of Latin-1 bytes: in lower case and with spaces for line ends; and whether a letter (1), a mark (2) or neither (0).
SMALL = bytes(32 if b == 10 else ord(chr(b).lower()) for b in range(256))
CLASS = np.array([1 if re.fullmatch(f"[{LETTERS}]", chr(b)) else 2 if re.fullmatch(f"[{MARKS}]", chr(b)) else 0 for b in range(256)], np.uint8)
#: The parts of a tokenizer of which that is true: it drops white space, ignores case and cuts letters from marks.
PARTS = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it can be seen, else the next from 256."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    unseen = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(unseen)}


class Kept(dict):
    """A look-up table of bounded size: what was used since the table last was half full stays."""

    def __init__(self, size: int, make) -> None:
        super().__init__()
        self.half, self.make, self.old = size // 2, make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        if not os.path.isabs(vocabulary):
            import public_tokenizers

            vocabulary = public_tokenizers.path(vocabulary)
        self.tokenizer = Tokenizer.from_file(vocabulary)
        told = json.loads(self.tokenizer.to_str())
        names = [[x["type"] for x in (told.get(part) or {}).get(key, [])] for part, key in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        self.by_word = tuple(names) == PARTS
        self.letters = byte_letters()
        self.pieces, self.others = Kept(KEPT, lambda b: self._piece(b.decode("latin-1"))), Kept(KEPT // 4, self._piece)

    def _model(self, text: str) -> bytes:
        """Letters in lower case, or marks: one piece for the model itself."""
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.tokenizer.model.tokenize(text)]
        return pack(f"<{len(ids)}I", *ids)

    def _piece(self, word: str) -> bytes:
        cut = CUT.fullmatch(word)
        return self._model(cut[1].lower()) + self._model(cut[2]) if cut else self.whole(word)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not self.by_word:
            return self.whole(text or "")
        text = text or ""
        try:
            raw = text.encode("latin-1") if "<|" not in text else None
        except UnicodeEncodeError:
            raw = None
        if raw is None:
            return b"".join(map(self.others.__getitem__, text.replace("\n", " ").split(" ")))
        # Case does not matter here, and no special token is cut when letters are parted from marks.
        raw = raw.translate(SMALL)
        kinds = CLASS[np.frombuffer(raw, np.uint8)]
        at = np.flatnonzero((kinds[:-1] == 1) & (kinds[1:] == 2))
        if len(at):
            at += 1
            raw = np.insert(np.frombuffer(raw, np.uint8), at, 32).tobytes()
        return b"".join(map(self.pieces.__getitem__, raw.split(b" ")))


@lru_cache(2)
def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(vocabulary)
