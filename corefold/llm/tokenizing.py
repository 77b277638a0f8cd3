"""Token ids of whole texts, chunk by chunk through a cache.

The pre-tokenizers of both vocabularies never join what stands on two sides of the chunk
borders used here, so a text's ids are its chunks' ids in a row; ``tests/llm`` holds this
against the tokenizer over whole texts. Most chunks of a corpus repeat, and a repeated
chunk costs one lookup.
"""

from __future__ import annotations

import base64
import os
import re
import struct
from collections.abc import Callable

#: White space as the pre-tokenizer knows it. Python's own ``\s`` also takes U+001C to U+001F.
_WS = "\t-\r \x85\xa0  -     　"
_CHUNKS = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: What texts have where the space between their words is not just one space or line feed.
_ODD_SPACE = ("  ", " \n", "\n ", "\n\n", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"))
_UNEVEN = re.compile(r"\s")
#: Longer chunks are not kept; when the cache is full, only chunks up to the second length stay.
LONGEST_KEPT, SHORT = 64, 8
#: Chunks kept by kind, some 150 bytes each; of words by both vocabularies, 250.
MOST_KEPT = {"words": 250_000, "bytes": 600_000, "both": 150_000}
_encoders: dict[tuple, object] = {}
_FORMATS = [struct.Struct(f"<{n}I").pack for n in range(64)]


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return _FORMATS[len(ids)](*ids) if len(ids) < 64 else struct.pack(f"<{len(ids)}I", *ids)


class Known(dict):
    """What ``make`` gave for a key, kept in bounded number."""

    def __init__(self, make: Callable, most: int):
        self.make, self.most = make, most

    def __missing__(self, key):  # noqa: ANN001, ANN204
        got = self.make(key)
        if len(key) <= LONGEST_KEPT:
            if len(self) >= self.most:
                short = {k: v for k, v in self.items() if len(k) <= SHORT}
                self.clear()
                if len(short) < self.most // 2:
                    self.update(short)
            self[key] = got
        return got


class CachedEncoder:
    """Ids of texts from ids of their chunks. ``split`` cuts a text, ``encode`` gives the packed ids of a chunk."""

    def __init__(self, split: Callable, encode: Callable, most: int):
        self.split, self.known = split, Known(encode, most)

    def ids(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; a null text counts as empty."""
        return b"".join(map(self.known.__getitem__, self.split(text or "")))


#: Printable ASCII and the accented letters of Latin-1: what pre-tokenizing does to them is plain.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(" ?[!-~À-ÖØ-öø-ÿ]+")
_SHORT_FORMS = "'s|'t|'re|'ve|'m|'ll|'d"
_TOKENS = {
    "words": re.compile(f"{_SHORT_FORMS}|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+"),
    "bytes": re.compile(f"{_SHORT_FORMS}| ?[{_LETTERS}]+| ?[0-9]+| ?[^ {_LETTERS}0-9]+"),
}


def _byte_signs() -> dict[int, str]:
    """The sign by which a byte-level vocabulary writes each byte: printable ones as they are, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class ChunkEncoder(CachedEncoder):
    """``kind`` "words": white space is dropped, chunks are ASCII words. "bytes": a chunk takes the space before it.

    Chunks of plain signs are pre-tokenized here and go to the tokenizer's model, others to
    the tokenizer whole; the tests hold both against the tokenizer.
    """

    def __init__(self, path: str, kind: str, most: int | None = None):
        most = most or MOST_KEPT[kind]
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = tokenizer = Tokenizer.from_file(path)
        # special tokens' strings in a text become their ids, as the library does by default: texts are cut around them
        self.added = {t.content: packed([i]) for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.around = re.compile(f"({'|'.join(map(re.escape, sorted(self.added, key=len, reverse=True)))})")
        model, signs, plain, pre = tokenizer.model, _byte_signs(), _PLAIN.fullmatch, _TOKENS[kind].findall
        space = signs[0x20]

        def part(x: str) -> bytes:
            x = x.replace(" ", space) if x.isascii() else x.encode().decode("latin-1").translate(signs)
            return packed([t.id for t in model.tokenize(x)])

        known = Known(part, most // 3)

        def chunk(x: str) -> bytes:
            if plain(x) and len(x) <= LONGEST_KEPT:
                parts = pre(x)
                return part(x) if len(parts) == 1 else b"".join(map(known.__getitem__, parts))
            return packed(tokenizer.encode(x, add_special_tokens=False).ids)

        def word(x: bytes) -> bytes:
            x = x.decode()
            return chunk(x.lower() if plain(x) else x)

        if kind == "words":
            super().__init__(lambda t: t.encode().lower().split(), word, most)
            return
        super().__init__(_CHUNKS.findall, chunk, most)
        line = chunk("\n")
        self.spaced = Known(lambda x: line + self.known[x[1:]] if x[0] == "\n" else chunk(" " + x), most)

    def ids(self, text: str | None) -> bytes:
        if text and any(x in text for x in self.added):
            return b"".join(self.added[x] if x in self.added else self.plain_ids(x) for x in self.around.split(text))
        return self.plain_ids(text)

    def plain_ids(self, text: str | None) -> bytes:
        """Of a text without special tokens."""
        if text and hasattr(self, "spaced") and not _UNEVEN.search(text, 0, 1) and not text[-1].isspace() and not any(x in text for x in _ODD_SPACE):
            # words with one space or line feed between them: a word stands for the space and itself
            first, *rest = text.replace("\n", " \n").split(" ")
            return self.known[first] + b"".join(map(self.spaced.__getitem__, rest))
        return super().ids(text)


class Vocabularies:
    """Two vocabularies over the same words: pieces of a sentencepiece model, and byte pairs by rank.

    Each ASCII word of a text is taken on its own, for the byte pairs with a space before it,
    so a word costs one lookup for both.
    """

    def __init__(self, pieces: str, ranks: str, pattern: str, most: int | None = None):
        from sentencepiece import SentencePieceProcessor
        from tiktoken import Encoding

        self.model = SentencePieceProcessor(model_file=pieces)
        with open(ranks, "rb") as f:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        pairs = Encoding(os.path.basename(ranks), pat_str=pattern, mergeable_ranks=table, special_tokens={})

        def both(x: bytes) -> tuple[bytes, bytes]:
            word = x.decode()
            return packed(self.model.encode(word)), packed(pairs.encode_ordinary(" " + word))

        self.known = Known(both, most or MOST_KEPT["both"])

    def ids(self, text: str) -> tuple[bytes, bytes]:
        """The ids by either vocabulary as little-endian unsigned 32-bit integers."""
        found = list(map(self.known.__getitem__, text.encode().split()))
        return b"".join([x for x, _ in found]), b"".join([x for _, x in found])


def encoder(path: str, kind: str) -> CachedEncoder:
    """One encoder for each worker process, the last one asked for."""
    return _kept((path, kind), lambda: ChunkEncoder(path, kind))


def vocabularies(pieces: str, ranks: str, pattern: str) -> Vocabularies:
    return _kept((pieces, ranks), lambda: Vocabularies(pieces, ranks, pattern))


def _kept(key: tuple, make: Callable):  # noqa: ANN202
    if key not in _encoders:
        _encoders.clear()  # a worker that goes on to another operator gives its cache back
        _encoders[key] = make()
    return _encoders[key]
