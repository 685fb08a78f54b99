"""SentencePiece ids and back, through a table of distinct marked words.

In a vocabulary whose pieces hold the white-space marker only at their start
(or are nothing but markers), no piece crosses the start of a marked word: a
run of markers with the characters after it.  Each distinct marked word is
segmented, and its ids are decoded, once per worker and batch; ids and decoded
words are joined back by position.  ``check_model`` refuses other vocabularies.

Defined results: null text counts as empty and has no ids; repeated rows each
get a row; extra columns are ignored; an empty table gives none.  The table
keeps words of MEMO_WORD characters at most, MEMO_ROWS of them and one batch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from netweave.llm.common import MEMO_ROWS, MEMO_WORD, arrow_map, slices

MARK = "▁"
#: A space and the library's own marker mean the same in a text.
_WORD = re.compile(f"[ {MARK}]+[^ {MARK}]*|[^ {MARK}]+")


class PieceTable:
    """Distinct marked words of a worker: the word without its first marker -> ids as text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.check_model()
        self.ids: dict[str, str] = {}
        #: what decodes to anything else than a space and the word itself
        self.odd: dict[str, str] = {}

    def check_model(self) -> None:
        """Pieces may hold the marker at their start only, and texts must be taken as they are."""
        for i in range(self.model.get_piece_size()):
            if MARK in self.model.id_to_piece(i).lstrip(MARK):
                raise ValueError("pieces of this vocabulary cross white-space markers")
        for probe in ("a  b", " a", "a ", "a\n\tb", "\u3000\ufb01"):
            if self.model.decode(self.model.encode(probe)) != probe:
                raise ValueError("this vocabulary normalises texts")

    def learn(self, words: list[str]) -> None:
        # The library puts one marker before a text: it stands for the word's first.
        ids = self.model.encode(words, num_threads=1)
        for w, i, back in zip(words, ids, self.model.decode(ids, num_threads=1)):
            if not w:  # a lone marker
                i = [self.model.piece_to_id(MARK)]
            self.ids[w] = ",".join(map(str, i))
            if back != w:
                self.odd[w] = back

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, ids joined by commas, decoded text) of each text."""
        parts = []
        for t in texts:
            p = t.split(" ")
            if MARK in t or "" in p:  # runs of markers stay with the word after them
                p = [w[1:] for w in _WORD.findall(" " + t)] if t else []
            parts.append(p)
        if len(self.ids) > MEMO_ROWS:
            self.ids.clear()
            self.odd.clear()
        new: set[str] = set()
        for p in parts:
            new.update(p)
        unknown = list(new.difference(self.ids))
        for at in range(0, len(unknown), 4096):
            self.learn(unknown[at : at + 4096])
        get, odd, out = self.ids.__getitem__, self.odd, []
        for p in parts:
            ids = ",".join(map(get, p))
            back = " ".join(p) if odd.keys().isdisjoint(p) else " ".join([odd.get(w, w) for w in p])
            out.append((ids.count(",") + 1 if ids else 0, ids, back))
        for w in unknown:
            if len(w) > MEMO_WORD:  # a text without spaces is one word: not to be kept
                del self.ids[w]
                odd.pop(w, None)
        return out


_open: dict[str, PieceTable] = {}


def piece_table(path: str) -> PieceTable:
    if path not in _open:
        _open[path] = PieceTable(path)
    return _open[path]


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """One row per document: ``id_col``, n_tokens, ids (array), decoded text.

    With ``digests`` the last two are SHA-256 digests, taken where the ids are
    made, so that neither ids nor texts are moved: ids_sha256, decoded_sha256.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(model)
        for b in slices(batches):
            got = table.encode([x or "" for x in b.column(1).to_pylist()])
            n = pa.array([g[0] for g in got], pa.int64())
            if digests:
                ids, back = pa.array([sha(g[1]) for g in got], pa.string()), pa.array([sha(g[2]) for g in got], pa.string())
            else:
                ids, back = pa.array([[int(x) for x in g[1].split(",") if x] for g in got], pa.list_(pa.int32())), pa.array([g[2] for g in got], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), n, ids, back], names=[id_col, "n_tokens", "ids_sha256" if digests else "ids", "decoded_sha256" if digests else "decoded"])

    rest = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return arrow_map(docs.select(id_col, text), run, f"`{id_col}` {kind}, n_tokens long, {rest}")
