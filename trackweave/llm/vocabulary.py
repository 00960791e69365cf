"""Token ids of whole texts by a public byte-level BPE vocabulary.

A text can be cut before every space that stands before a visible character: the vocabulary's
splitting pattern never joins what such a cut parts. The pieces between cuts repeat a great deal,
so each distinct piece is encoded once and looked up afterwards. Texts in which a space stands
before white space or at the end, or that hold a special token's string, are encoded whole.
"""

from __future__ import annotations

import array
import base64
import os
import re
from collections.abc import Callable

import public_tokenizers

DEFAULT_FILE = public_tokenizers.path("byte_bpe_50k.json")
#: Distinct pieces that a worker remembers, about 150 bytes each.
CACHE_PIECES = 400_000
_UNEVEN = re.compile(r" \s| \Z")
#: Characters that every Unicode version classes alike.
_PLAIN = re.compile(r"[\n\x20-\x7eÀ-ÖØ-öø-ſ]*")


class Pieces(dict):
    """piece -> value, computed once for each distinct piece; emptied when full."""

    def __init__(self, compute: Callable[[str], object], most: int = CACHE_PIECES):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, piece: str):
        if len(self) >= self.most:
            self.clear()
        value = self[piece] = self.compute(piece)
        return value


class Vocabulary:
    """Ids as the ``tokenizers`` library gives them, without added tokens.

    ``path`` is the vocabulary's .json file. Where a .tiktoken file of the same vocabulary lies
    beside it, pieces of plain characters are merged by that library, which is faster; all others
    go through ``tokenizers`` itself.
    """

    def __init__(self, path: str = DEFAULT_FILE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.packed = Pieces(lambda piece: array.array("I", self._encode(" " + piece)).tobytes())
        self.counted = Pieces(lambda piece: len(self._encode(" " + piece)))

    def _encode(self, piece: str) -> list[int]:
        if self.fast is not None and _PLAIN.fullmatch(piece):
            return self.fast.encode_ordinary(piece)
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def _whole(self, text: str) -> bool:
        return _UNEVEN.search(text) is not None or any(s in text for s in self.specials)

    def ids_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self._whole(text):
            return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        first, *rest = text.split(" ")
        return array.array("I", self._encode(first)).tobytes() + b"".join(map(self.packed.__getitem__, rest))

    def ids(self, text: str) -> list[int]:
        return array.array("I", self.ids_bytes(text)).tolist()

    def count_batch(self, texts: list[str]) -> list[int]:
        """Tokens of each text: pieces are counted once for each distinct pre-token of the batch,
        then joined to the texts' pre-tokens and summed; no ids of a text are kept."""
        split = [None if self._whole(t) else t.split(" ") for t in texts]
        distinct = set().union(*(s[1:] for s in split if s))
        known = self.counted
        table = {piece: known[piece] for piece in distinct}
        return [
            len(self.tokenizer.encode(t, add_special_tokens=False).ids) if s is None
            else len(self._encode(s[0])) + sum(map(table.__getitem__, s[1:]))
            for t, s in zip(texts, split, strict=True)
        ]


_loaded: dict[str, Vocabulary] = {}


def load(path: str = DEFAULT_FILE) -> Vocabulary:
    """One instance for each Python worker."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]
