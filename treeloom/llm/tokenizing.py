"""Loading of public tokenizer files by path; nothing is trained or copied.

Every text is encoded whole, whatever its length.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np

DEFAULT_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splitting pattern of the byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of white space of that length are cut out by :func:`_around_spaces`, as the splitting pattern needs stack for each of their characters.
SPACES = 100_000
_SPACE = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def _around_spaces(text: str, whole: Callable[[str], list[int]], piece: Callable[[bytes], list[int]], longest: int = SPACES) -> list[int]:
    """The ids of the whole text, with long runs of white space encoded as what the pattern makes of them.

    A run is one piece but for its last character, which goes with the word after
    it; nothing before a run depends on what follows.
    """
    out: list[int] = []
    at = 0
    for run in re.finditer(f"{_SPACE}{{{longest},}}", text):
        end = run.end() - (run.end() < len(text))
        out += whole(text[at : run.start()])
        out += piece(text[run.start() : end].encode())
        at = end
    return out + whole(text[at:])


@lru_cache(maxsize=4)
def load(path: str) -> tuple[Callable[[str], list[int]], int]:
    """The encoder of a file and the size of its id space (one id free for end of text)."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        own = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        whole = lambda t: own.encode_ordinary(t) if len(t) < SPACES else _around_spaces(t, own.encode_ordinary, own._encode_single_piece)
        size = max(ranks.values()) + 2
    elif path.endswith(".json"):
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.encode_special_tokens = True
        whole = lambda t: model.encode(t, add_special_tokens=False).ids
        size = model.get_vocab_size() + 1
    else:
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        whole = lambda t: pieces.encode(t, num_threads=1)
        size = pieces.get_piece_size() + 1

    def encode(text: str) -> list[int]:
        # lone surrogates can't be encoded as UTF-8
        return whole(text.encode("utf-8", "replace").decode("utf-8"))

    return encode, size


def counts(texts: list[str | None], path: str) -> np.ndarray:
    encode, _ = load(path)
    return np.fromiter((len(encode(t)) if t else 0 for t in texts), np.int64, len(texts))
