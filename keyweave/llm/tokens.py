"""Encoding of whole texts by a public byte-level BPE vocabulary, inside tasks.

The ids are those the tokenizer file gives for the whole text.  For speed a text is cut before
each run of white space: the vocabulary's own splitting rule never joins across the start of
such a run, so the pieces can be encoded alone, and a bounded cache holds the ids of frequent ones.
Texts that hold the vocabulary's special token are encoded whole.
"""

from __future__ import annotations

import base64
import re
import struct

from keyweave.llm.columns import travels_with_the_job

travels_with_the_job(__name__)

VOCABULARY = "byte_bpe_50k"
END_OF_DOCUMENT = 1
SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256
#: White space of the splitting rule (Unicode White_Space), fixed values.
_SPACES = (
    "\t\n\x0b\x0c\r \x85\xa0           "
    "     　"
)
_RARE_SPACES = [space for space in _SPACES if space not in " \n"]
_PIECES = re.compile(f"[{_SPACES}]*[^{_SPACES}]+|[{_SPACES}]+")


class _Pieces(dict):
    """Ids of pieces as little-endian bytes; two generations bound the memory."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most, self.older = encode, most, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            ids = self.encode(piece)
            found = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[piece] = found
        return found


class Encoder:
    """``encoded(text)`` gives the ids of a text as unsigned 32-bit little-endian bytes.

    ``vocabulary`` is the name of a public one or the path of a file of ranks.
    """

    def __init__(self, vocabulary: str = VOCABULARY, cached_pieces: int = 150_000):
        import public_tokenizers
        import tiktoken

        place = vocabulary if vocabulary.endswith(".tiktoken") else public_tokenizers.path(f"{vocabulary}.tiktoken")
        with open(place, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        whole = tiktoken.Encoding(
            vocabulary,
            pat_str=public_tokenizers.PATTERN,
            mergeable_ranks=ranks,
            special_tokens={SPECIAL: SPECIAL_ID},
        )
        self._whole = whole
        self._plain = whole._core_bpe.encode_ordinary
        self._free = _Pieces(self._plain, cached_pieces)
        self._spaced = _Pieces(lambda word: self._plain(" " + word), cached_pieces)

    def encoded(self, text: str | None) -> bytes:
        if not text:
            return b""
        if SPECIAL in text:
            ids = self._whole.encode(text, allowed_special="all")
            return struct.pack(f"<{len(ids)}I", *ids)
        try:
            text.encode("utf-8")
        except UnicodeEncodeError:  # a lone surrogate: no valid text
            text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        if self._only_single_spaces(text):
            first, *words = text.split(" ")
            return self._free[first] + b"".join(map(self._spaced.__getitem__, words))
        return b"".join(map(self._free.__getitem__, _PIECES.findall(text)))

    @staticmethod
    def _only_single_spaces(text: str) -> bool:
        """Each space stands alone between two other characters."""
        if text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text:
            return False
        return not any(space in text for space in _RARE_SPACES)


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """The encoder of this worker process."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]
