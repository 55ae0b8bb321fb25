"""Encoding by a table of distinct chunks.

A tokenizer whose tokens never cross the start of a white-space run, nor the change between plain letters and
plain punctuation, encodes every chunk between such places on its own. A text is then the ids of its chunks, one
after the other, and each distinct chunk has to be encoded once only. The table lives in the Python worker and is
kept between tasks of one operator.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable

from tablewise.llm.common import worker_cache

#: Chunks of a generation of the table. When it is full it becomes the old generation, and what is used again is
#: taken over from there, so that memory is bounded whatever the number of distinct chunks.
TABLE_CHUNKS = 400_000


class ChunkTable(dict):
    """Chunk -> its ids as bytes; a chunk that is not in the table is encoded when it is looked up."""

    def __init__(self, encode: Callable[[str], list[int]], most: int = TABLE_CHUNKS):
        super().__init__()
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, chunk: str) -> bytes:
        value = self.old.get(chunk)
        if value is None:
            value = packed(self.encode(chunk))
        self[chunk] = value
        return value

    def ids(self, chunks: list[str]) -> bytes:
        """The ids of a text's chunks."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, chunks))


def packed(ids: list[int]) -> bytes:
    """Unsigned 32-bit little-endian integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


#: Fixed value: the characters with the Unicode property White_Space. Python's \\s has a few more.
WHITE_SPACE = "\\t-\\r \x85\xa0  -     　"
_PUNCTUATION, _NO_APOSTROPHE = "!-/:-@\\[-`{-~", "!-&(-/:-@\\[-`{-~"
#: ASCII letters and digits, and the letters of two Latin blocks but for two that change their length
_PLAIN = "A-Za-z0-9\xc0-\xd6\xd8-\xf6\xf8-įı-ňŊ-ž"
# A run of plain letters or of punctuation ends a chunk only where the next character cannot belong to its token:
# punctuation before an apostrophe (which starts contractions) or a rare character stays with what follows.
_RUN = (f"[{_PLAIN}]++(?![^{WHITE_SPACE}{_PUNCTUATION}])|[{_NO_APOSTROPHE}]++(?![^{WHITE_SPACE}{_PLAIN}])"
        f"|[^{WHITE_SPACE}]+")
_WITH_SPACE = re.compile(f"[{WHITE_SPACE}]*(?:{_RUN})|[{WHITE_SPACE}]+")
_WITHOUT_SPACE = re.compile(_RUN)
#: A text without other characters than these two Latin blocks, less one that becomes two, may be lower-cased as a whole
_RARE = re.compile("[^\x00-įı-ž]")


def byte_letters() -> dict[int, str]:
    """The public rule of byte-level tokenizers: printable Latin-1 bytes stand for themselves, the others, in
    order, for the characters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


@worker_cache(maxsize=2)
def tokenizer_table(path: str, spaces: bool) -> ChunkTable:
    """Chunk -> ids with the byte-level BPE tokenizer in a JSON file.

    ``spaces``: white space is part of the tokens, else it only separates them and letters are lower-cased. The
    texts of special tokens are ordinary text. A chunk of letters is a single word of the model and goes to it
    directly; everything else goes through the whole tokenizer.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task for each core already
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    whole, word, letters = tokenizer.encode, tokenizer.model.tokenize, byte_letters()

    def encode(chunk: str) -> list[int]:
        lead = "Ġ" if spaces and chunk[0] == " " else ""
        body = chunk[1:] if lead else chunk
        if body.isalpha() and (body.isascii() or max(body) <= "ž"):
            lower = body if spaces else body.lower()
            if len(lower) == len(body):     # a letter that becomes two is normalised further
                if not lower.isascii():
                    lower = lower.encode().decode("latin-1").translate(letters)
                return [t.id for t in word(lead + lower)]
        return whole(chunk, add_special_tokens=False).ids

    return ChunkTable(encode)


@worker_cache(maxsize=2)
def special_tokens(path: str) -> tuple[Callable[[str], list[int]], Callable[[str], bool]]:
    """(the library's own encoding, whether a text holds an added token): such a text goes to the library as a whole.
    Tokens that the library looks for in normalised text are looked for in any case."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = tokenizer.get_added_tokens_decoder().values()
    exact = [t.content for t in added if not t.normalized]
    folded = [t.content.lower() for t in added if t.normalized]

    def holds(text: str) -> bool:
        return any(t in text for t in exact) or bool(folded) and any(t in text.lower() for t in folded)

    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids, holds


def token_bytes(texts: list[str], path: str, spaces: bool, special: bool = False) -> list[bytes]:
    """The ids of each text as unsigned 32-bit little-endian integers. ``special``: the texts of special tokens become
    their ids, as the library does by default; otherwise they are ordinary text."""
    if special:
        whole, holds = special_tokens(path)
        if held := {i for i, t in enumerate(texts) if holds(t)}:
            rest = iter(token_bytes([t for i, t in enumerate(texts) if i not in held], path, spaces))
            return [packed(whole(t)) if i in held else next(rest) for i, t in enumerate(texts)]
    table = tokenizer_table(path, spaces)
    if spaces:
        return [table.ids(_WITH_SPACE.findall(t)) for t in texts]
    lower = (t.lower() if t.isascii() or not _RARE.search(t) else t for t in texts)
    return [table.ids(_WITHOUT_SPACE.findall(t)) for t in lower]
