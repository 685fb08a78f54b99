"""Byte-pair ids of whole texts.

A vocabulary file whose ids follow its merges (byte-level, without
normalisation) is loaded into the quicker of the two public tokenizer
libraries, which gives the same ids and keeps no table of words; any other
byte-level file is left to the library it was written for.  Added tokens of the
file are found in texts first, as that library does.  Nothing is kept between
texts, so a task's memory follows its longest text alone.

The quicker library's pattern gives up on very long runs of one kind of
character.  A text is therefore cut around them, where the pattern, which looks
ahead only, is bound to end a match; the run itself, one match, is merged by the
library the file was written for.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Fixed value: the split pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task has one core


def byte_of_char() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable ones stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranks_of(spec: dict) -> dict[bytes, int] | None:
    """Token bytes -> id where ids follow the merges and texts are split by PATTERN alone; else None."""
    split, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    if spec.get("normalizer") or not plain or model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout"):
        return None
    vocab, chars = model["vocab"], byte_of_char()
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if made != sorted(made) or len(made) + 256 != len(vocab):
        return None
    return {bytes(chars[c] for c in token): i for token, i in vocab.items()}


#: Fixed value: white space as the pattern knows it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of white space of at least so many characters are cut out.
LONG = 10_000
_LONG_RUN = re.compile(f"(?<![{SPACE}])[{SPACE}]{{{LONG},}}")  # tried once for each run


def added_tokens(spec: dict) -> dict[str, int] | None:
    """Added tokens -> id; None where finding them takes more than a plain search."""
    added = spec.get("added_tokens") or []
    names = [t["content"] for t in added]
    plain = all(not (t.get("single_word") or t.get("lstrip") or t.get("rstrip")) for t in added)
    apart = all(a == b or a not in b for a in names for b in names)
    return {t["content"]: t["id"] for t in added} if plain and apart and not any(re.search(f"[{SPACE}]", a) for a in names) else None


def stretches(text: str) -> list[tuple[str, bool]]:
    """The text in pieces that are encoded apart, with whether a piece is one run of white space.

    A run gives its last character to what follows, as the pattern does.
    """
    out, at = [], 0
    for run in _LONG_RUN.finditer(text) if len(text) >= LONG else ():
        end = run.end() - (run.end() < len(text))
        out += [(text[at : run.start()], False), (text[run.start() : end], True)]
        at = end
    return [*out, (text[at:], False)]


class ByteBpe:
    """Encoder of one vocabulary file; kept per worker."""

    def __init__(self, path: str):
        self.path, self.named = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ranks, added = ranks_of(spec), added_tokens(spec)
        self.quick = None
        if ranks and added is not None:
            import tiktoken

            self.quick = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.added = added
            self.mark = re.compile("|".join(map(re.escape, added))) if added else None

    def _whole(self, text: str) -> list[int]:
        if self.named is None:
            from tokenizers import Tokenizer

            self.named = Tokenizer.from_file(self.path)
        return self.named.encode(text, add_special_tokens=False).ids

    def _ordinary(self, text: str) -> list[np.ndarray]:
        return [np.asarray(self._whole(t) if run else self.quick.encode_to_numpy(t, disallowed_special=()), "<u4") for t, run in stretches(text) if t]

    def ids(self, text: str) -> np.ndarray:
        if self.quick is None:
            return np.asarray(self._whole(text), "<u4")
        parts, at = [], 0
        for found in self.mark.finditer(text) if self.mark else ():
            parts += [*self._ordinary(text[at : found.start()]), np.array([self.added[found[0]]], "<u4")]
            at = found.end()
        parts += self._ordinary(text[at:] if at else text)
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, "<u4"), *parts])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit values."""
        return [self.ids(t).tobytes() for t in texts]


_open: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    if path not in _open:
        _open[path] = ByteBpe(path)
    return _open[path]
