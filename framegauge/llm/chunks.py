"""Tokenise whole texts in space-separated chunks, each distinct chunk once.

Words repeat, so a worker keeps the ids of the chunks it has met, and asks for each
distinct chunk of a few hundred texts once.  The texts are
cut only where no public pre-tokeniser joins the two sides, so the joined ids are
those of the whole text.  What the store drops is encoded again, which costs time and
never changes an id.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from framegauge.llm.workers import STORE_BYTES, Store, worker_state

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_SPACES = r"\s\x1c-\x1f᠎​﻿"
_SPACE_RUN = re.compile(f"[{_SPACES}] ")
_ASCII_RUNS = tuple(c + " " for c in "\n \t\r\x0b\x0c\x1c\x1d\x1e\x1f")
_BEFORE_SPACE = re.compile(f"(?<=[^{_SPACES}])(?= )")
_MARK_AFTER_WORD = re.compile("[.,](?<=[a-zA-Z].)")  # every vocabulary cuts between a letter and these


_LONGEST_JOINED = 1 << 20  # characters of a text that is cut together with others


def split_before_spaces(text: str) -> list[str]:
    """Chunks for byte-level vocabularies, cut before spaces and after words.

    A run of white space is never cut: the patterns of these vocabularies treat
    the last space of a run differently from the others.
    """
    marked = mark_before_spaces(text)
    return _BEFORE_SPACE.split(text) if marked is None else marked.split("\0")


def mark_before_spaces(text: str) -> str | None:
    """The text with a zero character at each cut, None if it holds one or has white space in runs."""
    if "\0" in text:
        return None
    if text.isascii():
        runs = any(run in text for run in _ASCII_RUNS)
    else:
        runs = _SPACE_RUN.search(text) is not None
    return None if runs else _MARK_AFTER_WORD.sub("\0\\g<0>", text).replace(" ", "\0 ")


def split_at_spaces(text: str) -> list[str]:
    """Chunks for vocabularies that drop white space, cut at spaces and after words."""
    return mark_at_spaces(text).split(" ")


def mark_at_spaces(text: str) -> str:
    """The text with a space at each cut."""
    return _MARK_AFTER_WORD.sub(" \\g<0>", text)


class ChunkEncoder:
    """Packed ids (little-endian unsigned 32 bit) of texts, by distinct chunk.

    Texts for which ``is_special`` holds are encoded whole by ``encode_whole``.  ``mark`` gives a
    text with a mark at each of the cuts of ``split``, or None where only ``split`` can cut it.
    """

    def __init__(
        self,
        encode: Callable[[Any], bytes],
        split: Callable[[str], list],
        most_bytes: int = STORE_BYTES,
        is_special: Callable[[str], bool] | None = None,
        encode_whole: Callable[[str], bytes] | None = None,
        mark: tuple[Callable[[str], str | None], str] | None = None,
    ) -> None:
        self._split, self._is_special, self._encode_whole = split, is_special, encode_whole
        self._mark = mark
        self.store = Store(encode, most_bytes)

    def packed(self, text: str) -> bytes:
        if self._is_special is not None and self._is_special(text):
            return self._encode_whole(text)
        return b"".join(map(self.store.__getitem__, self._split(text)))

    def packed_texts(self, texts: list[str]) -> list[bytes]:
        """``packed`` of each text; where cuts can be marked, each distinct chunk is looked up once."""
        if self._mark is None:
            return [self.packed(text) for text in texts]
        mark, sign = self._mark
        marked = [
            None if len(text) > _LONGEST_JOINED or self._is_special is not None and self._is_special(text) else mark(text)
            for text in texts
        ]
        joined = self._joined([text for text in marked if text is not None], sign)
        return [self.packed(text) if own is None else next(joined) for text, own in zip(texts, marked)]

    def _joined(self, marked: list[str], sign: str) -> Iterator[bytes]:
        pieces = pc.split_pattern(pa.array(marked, pa.large_string()), sign)
        distinct = pieces.flatten().dictionary_encode()
        found = list(map(self.store.__getitem__, distinct.dictionary.to_numpy(zero_copy_only=False).tolist()))
        ids = pa.array(found, pa.large_binary()).take(distinct.indices)
        _, offsets, content = ids.buffers()
        ends = np.frombuffer(offsets, np.int64, len(ids) + 1)[np.asarray(pieces.offsets)].tolist()
        for first, last in zip(ends, ends[1:]):
            yield content.slice(first, last - first).to_pybytes() if first < last else b""


# How the byte-level and the word vocabularies cut a text before merging.
_BYTE_LEVEL_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Characters on whose classes, case and normal form all Unicode versions agree.
_PLAIN = re.compile("[\t\n\x20-\x7e\xa1-\xac\xae-\u012f\u0131-\u01c3\u01cd-\u01f0\u01f4-\u01ff]*")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def library_encoder(path: str, drops_spaces: bool = False, most_bytes: int = STORE_BYTES) -> ChunkEncoder:
    """The encoder of a ``tokenizers`` file, kept by the worker; ids are those of the library as loaded.

    Plain chunks are cut into pieces here and each distinct piece goes to the library's
    model; all other chunks go through the library as a whole.  So does a whole text that
    holds an added token such as ``<|endoftext|>``, which the library finds before it cuts.
    """
    key = ("tokenizers", path, drops_spaces, most_bytes)
    return worker_state(key, lambda: _library_encoder(path, drops_spaces, most_bytes))


def _library_encoder(path: str, drops_spaces: bool, most_bytes: int) -> ChunkEncoder:
    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    # The store keeps what repeats; the library's own store would be searched and filled in vain.
    tokenizer.model._resize_cache(0)
    merge, letters = tokenizer.model.tokenize, _byte_letters()
    space = letters[32]
    pieces = regex.compile(_WORD_PIECES if drops_spaces else _BYTE_LEVEL_PIECES).findall
    added = [token.content.lower() for token in tokenizer.get_added_tokens_decoder().values()]
    added_firsts = {token[0] for token in added}

    def is_special(text: str) -> bool:
        if not any(first in text for first in added_firsts):
            return False
        folded = text.lower()
        return any(token in folded for token in added)

    def encode_whole(text: str) -> bytes:
        return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(chunk: str) -> bytes:
        word = chunk[1:] if chunk[:1] == " " else chunk
        plain_ascii = word.isascii()
        if not plain_ascii and not _PLAIN.fullmatch(word):
            return encode_whole(chunk)
        if drops_spaces:
            chunk = word = word.lower()
        is_word = word.isalpha()
        if not is_word:
            parts = pieces(chunk)
            if len(parts) != 1 or parts[0] != chunk:
                return b"".join(map(encoder.store.__getitem__, parts))
        # One piece, as most chunks are.
        shown = word if plain_ascii and is_word else word.encode().decode("latin-1").translate(letters)
        tokens = merge(shown if len(word) == len(chunk) else space + shown)
        return array("I", [token.id for token in tokens]).tobytes()

    split = split_at_spaces if drops_spaces else split_before_spaces
    mark = (mark_at_spaces, " ") if drops_spaces else (mark_before_spaces, "\0")
    encoder = ChunkEncoder(encode, split, most_bytes, is_special, encode_whole, mark)
    return encoder


def encode_texts(encoder: ChunkEncoder, texts: list[str | None]) -> Iterator[bytes]:
    """Packed ids of each text in order; a null text is empty."""
    return iter(encoder.packed_texts([text or "" for text in texts]))
