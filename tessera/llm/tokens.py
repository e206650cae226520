"""Exact, memoised use of a ``tokenizers`` file on executors.

Both public BPE files split text before merging, and no piece of that split goes
past a space (byte-level: a piece may begin with one). So a text is cut at spaces, each
distinct chunk is encoded by the library once per worker, and ids are joined as bytes.
Texts for which this could differ from encoding them whole (runs of spaces
or special-token strings, byte-level only) are encoded whole by the library.
"""

from __future__ import annotations

import os
from collections.abc import Iterable

import numpy as np

#: Chunks that one worker remembers, and places of the filter that lets a chunk in when it is met again, as half of all chunks occur once. Others are
#: encoded again in each batch that has them, which costs time, not rightness.
MEMO_CHUNKS, DOOR = 450_000, 1 << 22

#: Marks the first chunk of a text. In a text that holds the character itself, no chunk is cut.
_FIRST = "\ue000"
_MARKS = (",", ".")

#: A space or line end and further white space: the library splits the whole run together. The code points with Unicode's White_Space.
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: What str.split takes for white space and the library doesn't.
_NOT_SPACE = "\x1c\x1d\x1e\x1f"
_PLAIN_RUNS = ["  ", " \n", "\n ", "\n\n"]
_RARE = [c for c in _SPACES if c not in " \n"]
_RARE_RUNS = [a + c for a in " \n" for c in _RARE]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(path: str):
    """The library's tokenizer with truncation and padding off."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def is_byte_level(tok) -> bool:
    """Whether spaces belong to tokens: the file has no normalizer that drops them."""
    return tok.normalizer is None


def chunks_dropping_space(text: str) -> list[str]:
    """Cut where the word-level pre-tokenizer always cuts."""
    if any(c in text for c in _NOT_SPACE):
        return [x for x in text.replace("\n", " ").split(" ") if x]
    return text.split()


def marked_stem(chunk: str) -> bool:
    """Whether the chunk is a comma or full stop after a letter, which is then a piece of its own."""
    return chunk[-1:] in _MARKS and chunk[-2:-1].isalpha() and len(chunk[-2].lower()) == 1


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself, others follow U+0100 in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class ChunkEncoder:
    """Chunks to the bytes of their ids. A word of Latin letters is one piece, which the library's model takes without its splitting."""

    def __init__(self, path: str, dtype: str) -> None:
        self.tok = load_tokenizer(path)
        self.byte_level = is_byte_level(self.tok)
        self.dtype, width = dtype, np.dtype(dtype).itemsize
        self._ids = [k.to_bytes(width, "little") for k in range(self.tok.get_vocab_size())]
        self._letters = _byte_letters()

    def piece(self, chunk: str) -> str | None:
        """The chunk as the model sees it if it is one piece for certain, else None. In Latin up to U+024F only U+0130 changes under NFC and lower-casing of single letters."""
        word = chunk[1:] if self.byte_level and chunk[:1] == " " else chunk
        if not word.isalpha():
            return None
        if not word.isascii():
            if max(word) > "\u024f" or "\u0130" in word:
                return None
            word = (word if self.byte_level else word.lower()).encode().decode("latin-1").translate(self._letters)
        elif not self.byte_level:
            word = word.lower()
        return self._letters[0x20] + word if word is not chunk and self.byte_level and chunk[:1] == " " else word

    def encode(self, chunks: list[str]) -> list[bytes]:
        ids, tokenize, piece = self._ids, self.tok.model.tokenize, self.piece
        out: list[bytes | None] = []
        rest = []
        for k, chunk in enumerate(chunks):
            if (p := piece(chunk)) is None:
                rest.append(k)
                out.append(None)
            else:
                out.append(b"".join([ids[t.id] for t in tokenize(p)]))
        for k, e in zip(rest, self.tok.encode_batch_fast([chunks[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = b"".join([ids[i] for i in e.ids])
        return out


class Encoder:
    """Text to the bytes of its ids, in ``dtype`` (a little-endian numpy type)."""

    def __init__(self, path: str, dtype: str = "<u4", memo_chunks: int = MEMO_CHUNKS) -> None:
        self.chunks = ChunkEncoder(path, dtype)
        self.tok, self.byte_level = self.chunks.tok, self.chunks.byte_level
        self.whole_for = _PLAIN_RUNS + [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.door = bytearray(DOOR)
        self.dtype, self.memo_chunks = dtype, memo_chunks
        self.line_end = {"\n": self.whole("\n")}
        self.memo: dict[str, bytes] = dict(self.line_end)
        self.marks = {c: self.whole(c) for c in _MARKS}

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def cut(self, text: str) -> list[str] | None:
        """The chunks of a text, or None where only the whole text can be encoded.

        Byte-level, a chunk stands for itself after one space, and the first one of a line is marked.
        """
        if not self.byte_level:
            return chunks_dropping_space(text)
        if _FIRST in text or text.endswith(" "):
            return None
        for s in self.whole_for:
            if s in text:
                return None
        for c in _RARE:
            if c in text and any(s in text for s in _RARE_RUNS):
                return None
        chunks: list[str] = []
        for line in text.split("\n"):
            if chunks:
                chunks.append("\n")
            words = line.split(" ")
            words[0] = _FIRST + words[0]
            chunks += words
        return chunks

    def _encode_new(self, fresh: set[str]) -> dict[str, bytes]:
        """The ids of chunks that the memory lacks; those with a mark at the end share the work for their stem."""
        memo, plain, marked = self.memo, set(), []
        for c in fresh:
            if marked_stem(c):
                marked.append(c)
                if c[:-1] not in memo:
                    plain.add(c[:-1])
            else:
                plain.add(c)
        space, listed = " " if self.byte_level else "", list(plain)
        as_text = [c[1:] if c[:1] == _FIRST else space + c for c in listed]
        out = dict(zip(listed, self.chunks.encode(as_text), strict=True))
        for c in marked:
            stem = c[:-1]
            out[c] = (memo[stem] if stem in memo else out[stem]) + self.marks[c[-1]]
        return out

    def encode_many(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text; a null text counts as empty."""
        texts = [t or "" for t in texts]
        get, parts, gaps, fresh, n = self.memo.get, [], [], set(), 0
        for text in texts:
            cut = self.cut(text)
            ids = None if cut is None else list(map(get, cut))
            parts.append(ids)
            if ids and None in ids:
                n += len(ids)
                for at in [i for i, v in enumerate(ids) if v is None]:
                    fresh.add(cut[at])
                    gaps.append((ids, at, cut[at]))
        if fresh:
            new = self._encode_new(fresh)
            for ids, at, chunk in gaps:
                ids[at] = new[chunk]
            if len(self.memo) < self.memo_chunks:
                door = self.door
                for chunk, ids in new.items():
                    at = hash(chunk) & (DOOR - 1)
                    if door[at]:
                        self.memo[chunk] = ids
                    else:
                        door[at] = 1
            elif len(gaps) > n // 2:  # the texts have changed
                self.memo.clear()
                self.memo.update(self.line_end)
        return [self.whole(t) if ids is None else b"".join(ids) for t, ids in zip(texts, parts, strict=True)]


_ENCODER: dict[tuple, Encoder] = {}


def forget() -> None:
    """Give back what this worker's encoder remembers, where other work begins."""
    _ENCODER.clear()


def encoder(path: str, dtype: str = "<u4", memo_chunks: int = MEMO_CHUNKS) -> Encoder:
    """This worker's encoder: it and what it remembers outlive a task; another file's is forgotten."""
    if (path, dtype, memo_chunks) not in _ENCODER:
        _ENCODER.clear()
        _ENCODER[path, dtype, memo_chunks] = Encoder(path, dtype, memo_chunks)
    return _ENCODER[path, dtype, memo_chunks]
