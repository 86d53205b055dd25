"""Token ids of whole texts by the tokenizers library, with each distinct piece of text encoded once a worker.

A text is cut only where the tokenizer always cuts, so joining the ids of the pieces gives the ids of the text:
before a punctuation mark that follows a letter, around a single line break, and at a single space. Texts with runs of
white space or zero characters, and those that hold the string of one of the tokenizer's added tokens, are encoded whole
instead. Such a string becomes that token's id, as the library does by default; specials_as_text keeps it ordinary text.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker remembers (about 200 bytes each); beyond this it starts afresh.
REMEMBERED = 600_000
_SPACE = r"[\s\x0B\x{85}\p{Z}]"
_ODD = _SPACE + _SPACE + r"|\x00"
_MARK = r"(\pL)([,.!*%&$#|])"

_encoders: dict[tuple[str, bool], "Encoder"] = {}


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """encode(texts) gives for each text its ids as little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, path: str, specials_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = specials_as_text
        added = [] if specials_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([_ODD, *(re.escape(t) for t in added)])
        # Byte-level tokenizers keep a space with the word after it; the others drop white space.
        self.keeps_space = len(self.tokenizer.encode(" a a", add_special_tokens=False).ids) != len(
            self.tokenizer.encode("aa", add_special_tokens=False).ids
        ) and self.tokenizer.encode(" a", add_special_tokens=False).ids != self.tokenizer.encode("a", add_special_tokens=False).ids
        self.known: dict[str, bytes] = {}

    def _raw(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def encode(self, texts: pa.Array) -> list[bytes]:
        odd = pc.match_substring_regex(texts, self.odd).to_pylist()
        cut = pc.replace_substring_regex(texts, _MARK, "\\1\x00\\2")
        cut = pc.replace_substring(cut, "\n", "\x00\n\x00")
        cut = pc.replace_substring(cut, " ", "\x00 " if self.keeps_space else "\x00").to_pylist()
        pieces = [None if o else c.split("\x00") for o, c in zip(odd, cut)]
        whole = [i for i, o in enumerate(odd) if o]
        ready = dict(zip(whole, self._raw([texts[i].as_py() for i in whole]))) if whole else {}
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, wanted = self.known, set()
        for p in pieces:
            if p is not None:
                wanted.update(p)
        new = [w for w in wanted if w not in known]
        known.update(zip(new, self._raw(new)))
        return [ready[i] if p is None else b"".join([known[w] for w in p]) for i, p in enumerate(pieces)]


def encoder(path: str, specials_as_text: bool = False) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    key = path, specials_as_text
    if key not in _encoders:
        _encoders[key] = Encoder(path, specials_as_text)
    return _encoders[key]


def chunks(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def crc(ids: bytes) -> int:
    return zlib.crc32(ids)
