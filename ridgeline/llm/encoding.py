"""Token ids of whole texts by the tokenizers library, with a memo of the chunks between ASCII white space.

The vocabulary file splits every text at white space before BPE, so the ids of a text are
the ids of its chunks in order. Only chunks not met before go through the library.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import chain

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes of chunks and ids that one worker holds before it starts afresh, by estimate; those of one slice of texts come on top.
MEMO_BYTES = 128 << 20
#: What a chunk costs besides its bytes and ids: its object, its place in the table and its offset.
CHUNK_COST = 120

#: A word of lower-case Latin-1 letters, and a full stop or comma that ends the chunk.
WORD = re.compile("([a-z\u00df-\u00f6\u00f8-\u00ff]+)([.,]?)")

_encoders: dict[str, ChunkEncoder] = {}


def vocabulary(path: str | None = None) -> str:
    """Place of the vocabulary file; each machine finds its own."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Memo(dict):
    """Chunk -> its number in the encoder's tables; a chunk not met before is encoded when looked up."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, chunk: bytes) -> int:
        return self.learn(chunk)


class ChunkEncoder:
    """Encodes batches of texts; equal to Tokenizer.encode(text, add_special_tokens=False) for each."""

    def __init__(self, path: str, memo: int = MEMO_BYTES):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.memo = Tokenizer.from_file(path), memo
        self.model = self.tokenizer.model
        bytes_as_text = ByteLevel(add_prefix_space=False, use_regex=False)
        self.byte_level = {x: bytes_as_text.pre_tokenize_str(chr(x))[0][0] for x in range(256) if WORD.fullmatch(chr(x))}
        self.marks = {m: self.tokenizer.encode(m, add_special_tokens=False).ids for m in (".", ",")}
        self.forget()

    def forget(self) -> None:
        self.slot, self.chunk_bytes = _Memo(self._learn), 0
        self.flat, self.ends = array("I"), array("Q", [0])

    def _learn(self, chunk: bytes) -> int:
        text = chunk.decode("utf-8")
        if m := WORD.fullmatch(text):  # one pre-token of letters that stay as they are: it only needs BPE
            head, tail = m.groups()
            self.flat.extend([t.id for t in self.model.tokenize(head if head.isascii() else head.translate(self.byte_level))])
            if tail:
                self.flat.extend(self.marks[tail])
        else:
            self.flat.extend(self.tokenizer.encode(text, add_special_tokens=False).ids)
        slot = self.slot[chunk] = len(self.ends) - 1
        self.chunk_bytes += len(chunk)
        self.ends.append(len(self.flat))
        return slot

    def held(self) -> int:
        """Bytes of the memo."""
        return self.chunk_bytes + 4 * len(self.flat) + CHUNK_COST * len(self.slot)

    @staticmethod
    def _chunks(text: str | None) -> list[bytes]:
        if not text:
            return []
        if "<|" not in text:
            try:  # Latin-1 characters lower-case one by one in any library; special tokens hold "<|"
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
        return text.encode("utf-8", "replace").split()

    def encode(self, texts: list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, uint32; offsets, one more than texts). end: an id after each text."""
        if self.held() > self.memo:
            self.forget()
        chunks = [self._chunks(t) for t in texts]
        at = np.array(list(map(self.slot.__getitem__, chain.from_iterable(chunks))), np.int64)
        words = np.fromiter(map(len, chunks), np.int64, len(chunks))
        # Indexing copies, so that no view is left: an array() can't grow under one.
        first = np.frombuffer(self.ends, np.uint64)[at].astype(np.int64)
        length = np.frombuffer(self.ends, np.uint64)[at + 1].astype(np.int64) - first
        ends = np.concatenate([[0], np.cumsum(length)])
        bounds = ends[np.concatenate([[0], np.cumsum(words)])]
        ids = np.frombuffer(self.flat, np.uint32)[np.repeat(first - ends[:-1], length) + np.arange(ends[-1])] if len(at) else np.empty(0, np.uint32)
        if end is not None:
            ids = np.insert(ids, bounds[1:], end).astype(np.uint32)
            bounds = bounds + np.arange(len(bounds))
        return ids, bounds


def encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]
