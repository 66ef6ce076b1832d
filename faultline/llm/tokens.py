"""Token ids of whole texts by a byte-level BPE file, as little-endian 32-bit integers."""

from __future__ import annotations

import json
import os

import numpy as np

from faultline.llm.common import per_process

#: Distinct chunks whose ids one worker remembers (about 100 MB).
REMEMBERED = 400_000

#: How GPT-2 style files cut texts, and which characters stand for themselves.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = ((33, 126), (161, 172), (174, 255))


def _byte_of_character() -> dict[str, int]:
    """Byte-level files write byte values as printable characters."""
    own = [b for first, last in PRINTABLE for b in range(first, last + 1)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Bpe:
    """Ids equal those of the file in its own library, at a multiple of the speed.

    A text whose chunks between single spaces neither start nor end with white
    space is cut there, as the file's pattern does itself; ids of chunks are
    remembered. Other texts are encoded whole, and texts that contain the string
    of a special token are left to the file's own library.
    """

    def __init__(self, path: str):
        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.chunks = path, {}
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        pre, vocabulary = model["pre_tokenizer"], model["model"]["vocab"]
        #: One more than the largest id.
        self.size = 1 + max([*vocabulary.values(), *(t["id"] for t in model["added_tokens"])])
        self.special = [t["content"] for t in model["added_tokens"]]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or model["normalizer"]:
            raise ValueError(f"{path} is no plain byte-level BPE file")
        byte = _byte_of_character()
        ranks = {
            bytes(byte[c] for c in token): rank
            for token, rank in vocabulary.items()
            if token not in self.special
        }
        self.fast = tiktoken.Encoding(
            path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary

    def _packed(self, text: str) -> bytes:
        return np.array(self.fast(text), "<u4").tobytes()

    def _exact(self, text: str) -> bytes:
        def load():
            from tokenizers import Tokenizer

            return Tokenizer.from_file(self.path)

        ids = per_process(("tokenizer", self.path), load).encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._exact(text)
        first, *rest = text.split(" ")
        if not first or first[0].isspace() or first[-1].isspace():
            return self._packed(text)
        chunks = self.chunks
        for chunk in rest:
            if chunk not in chunks:
                if not chunk or chunk[0].isspace() or chunk[-1].isspace():
                    return self._packed(text)
                chunks[chunk] = self._packed(" " + chunk)
        ids = b"".join([self._packed(first), *map(chunks.__getitem__, rest)])
        if len(chunks) > REMEMBERED:
            chunks.clear()
        return ids


def bpe(path: str) -> Bpe:
    return per_process(("bpe", path), lambda: Bpe(path))
