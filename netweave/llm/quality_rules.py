"""Quality rules as a short-circuit cascade.

The verdict on a document is the conjunction of simple rules, the two of the
base among them.  A rule looks at parts of the document (its words, lines,
hashes ...) that are made when a rule first asks for them.  The cost of parts
and rules and what the rules reject are measured on a sample, where the rows
are; the cascade then takes, again and again, the rule with most rejections per
cost among the documents that the rules before it let pass, parts that they
have made being free.  The order changes the work, never the verdict.

Defined results: null text counts as empty; an empty text has no words and
fails the base; very long texts count whole; repeated rows are judged each on
its own; an empty table gives none; extra columns are ignored by ``judge`` and
passed through by ``keep_good``, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.llm.common import arrow_map, slices, windows, word_hashes

#: Fixed values of the base counts.
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
MIN_WORDS = 50

_LETTERS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ASCII = bytes(range(128))

#: Rows, about, of the sample on which cost and selectivity are measured.
SAMPLE_ROWS = 400


class Text:
    """A document and its parts, each made once."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()  # bytes: splits at the six ASCII spaces only

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def lines(self) -> list[str]:
        """Lines with a word."""
        blank = SPACES.decode()
        return [x for x in self.text.split("\n") if x.strip(blank)]

    @cached_property
    def hashes(self) -> np.ndarray:
        return word_hashes(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - (len(self.raw) - len(self.raw.translate(None, SPACES)))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in three-word windows that occur twice or more."""
        n = self.n_words
        if n < 4:
            return 0
        h = windows(self.hashes, 3)
        ordered = np.sort(h)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(twice):
            return 0
        at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
        found = twice[at] == h
        covered = np.zeros(n, bool)
        for j in range(3):
            covered[j : j + n - 2] |= found
        return int(covered.sum())

    @cached_property
    def n_letters(self) -> int:
        rest = self.raw.translate(None, _ASCII).decode()
        return len(self.raw) - len(self.raw.translate(None, _LETTERS)) + sum(map(str.isalpha, rest))


def _few_words(c: Text) -> bool:
    """Base: fewer words than MIN_WORDS."""
    return c.n_words < MIN_WORDS


def _repeats(c: Text) -> bool:
    """Base: more than 50 of 100 words in repeated three-word windows."""
    return 100 * c.n_repeat_words > 50 * c.n_words


def _symbols(c: Text) -> bool:
    """More than 30 symbols in 100 words: marked-up or table-like junk."""
    return 100 * c.n_symbols > 30 * c.n_words


def _word_length(c: Text) -> bool:
    """A mean word length under 2 or over 30 characters."""
    return c.word_chars < 2 * c.n_words or c.word_chars > 30 * c.n_words


def _dup_lines(c: Text) -> bool:
    """More than 60 of 100 lines repeat an earlier one."""
    return 100 * c.n_dup_lines > 60 * len(c.lines)


def _shouting(c: Text) -> bool:
    """More than 50 of 100 words end in an exclamation mark."""
    return 100 * c.raw.count(b"!") > 50 * c.n_words and 100 * sum(w.endswith(b"!") for w in c.words) > 50 * c.n_words


def _ellipsis(c: Text) -> bool:
    """More than 60 of 100 lines end in an ellipsis."""
    blank = SPACES.decode()
    return 100 * sum(x.rstrip(blank).endswith(("...", "…")) for x in c.lines) > 60 * len(c.lines)


def _wordless(c: Text) -> bool:
    """Letters make up under 40 of 100 characters of the words."""
    return 100 * c.n_letters < 40 * c.word_chars


def _stutter(c: Text) -> bool:
    """More than 40 of 100 words equal the word before them."""
    return 100 * int((c.hashes[1:] == c.hashes[:-1]).sum()) > 40 * c.n_words


#: What the base asks for.
BASE = {"few_words": _few_words, "repeats": _repeats}
#: A rule returns True where it rejects.
RULES = BASE | {"symbols": _symbols, "word_length": _word_length, "dup_lines": _dup_lines, "shouting": _shouting, "ellipsis": _ellipsis, "wordless": _wordless, "stutter": _stutter}
#: Parts in the order in which one may need another.
PARTS = ("raw", "words", "n_words", "lines", "hashes", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_letters")


def base_failed(c: Text) -> bool:
    return any(rule(c) for rule in BASE.values())


def measure(text: str | None, rules: dict[str, Callable] = RULES) -> tuple[list[float], list[bool], list[float], list[int]]:
    """Of one text: seconds of each part, what each rule says, its own seconds, and a bit for each part it needs."""
    c, part_cost = Text(text), []
    for part in PARTS:
        began = time.perf_counter()
        getattr(c, part)
        part_cost.append(time.perf_counter() - began)
    said, cost, needs = [], [], []
    for rule in rules.values():
        began = time.perf_counter()
        said.append(bool(rule(c)))
        cost.append(time.perf_counter() - began)
        alone = Text(text)
        rule(alone)
        needs.append(sum(1 << i for i, part in enumerate(PARTS) if part in vars(alone)))
    return part_cost, said, cost, needs


def cascade_order(measured: list, names: list[str]) -> list[str]:
    """Rules by rejections per second among what the rules before them let pass; ties by name."""
    if not measured:
        return sorted(names)
    part_cost, said, cost, needs = (np.array(x) for x in zip(*measured))
    bits = (needs[:, :, None] >> np.arange(len(PARTS))) & 1  # text, rule, part
    passed, made, left, order = np.ones(len(said), bool), np.zeros((len(said), len(PARTS)), bool), sorted(range(len(names)), key=names.__getitem__), []
    while left:
        rate = {}
        for r in left:
            rejected = said[passed, r].sum()
            seconds = cost[passed, r].sum() + (part_cost * bits[:, r] * ~made)[passed].sum()
            rate[r] = (rejected + 0.5) / (seconds + 1e-6)
        best = max(left, key=rate.__getitem__)
        left.remove(best)
        order.append(names[best])
        made |= bits[:, best].astype(bool)
        passed &= ~said[:, best]
    return order


def plan(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS, rules: dict[str, Callable] = RULES) -> list[str]:
    """Order the cascade for ``docs`` by a sample of about ``rows`` rows, chosen by a hash of their text.

    The texts are measured where they are; only figures reach the driver.
    """
    every = max(1, docs.count() // rows)
    kind = "parts array<double>, said array<boolean>, own array<double>, needs array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [measure(x, rules) for x in b.column(0).to_pylist()]
            types = (pa.list_(pa.float64()), pa.list_(pa.bool_()), pa.list_(pa.float64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*got), types)], names=["parts", "said", "own", "needs"])

    picked = docs.select(text).where(F.pmod(F.xxhash64(text), F.lit(every)) == 0)
    return cascade_order([tuple(r) for r in arrow_map(picked, run, kind).limit(4 * rows).collect()], list(rules))


def first_rejecting(c: Text, order: list[str], rules: dict[str, Callable] = RULES) -> str | None:
    return next((name for name in order if rules[name](c)), None)


_JUDGED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rule string"


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text", order: list[str] | None = None) -> DataFrame:
    """One row per document: all base counts, ``base_failed``, ``kept`` and the rule that rejected it."""
    order = order or plan(docs, text)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for value in b.column(1).to_pylist():
                c = Text(value)
                rule = first_rejecting(c, order)
                rows.append((c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words, base_failed(c), rule is None, rule))
            types = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.string()]
            columns = [pa.array(x, t) for x, t in zip(zip(*rows), types)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=[id_col, *(x.split()[0] for x in _JUDGED.split(", "))])

    return arrow_map(docs.select(id_col, text), run, f"`{id_col}` {id_type}, {_JUDGED}")


def keep_good(docs: DataFrame, text: str = "text", order: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` that every rule lets pass, with all their columns; each text is read up to its first rejection."""
    order = order or plan(docs, text)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array([first_rejecting(Text(x), order) is None for x in b.column(at).to_pylist()], pa.bool_()))

    return arrow_map(docs, run, docs.schema)
