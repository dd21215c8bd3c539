"""Token counts by a compiled finite-state transducer.

The subword vocabulary is compiled, lazily, into a deterministic transducer that reads
characters and whose transitions carry the number of tokens by which the running count
changes. No piece of the vocabulary has a space mark after another character (checked when
it is loaded), so the transducer returns to its start state at each such place: a text is a
product of *units* (space marks, then other characters).

*States.* In the encoding of a prefix, the last token ending at position ``i`` is the only
piece ``t`` that is compatible with the last token of the prefix before it (two neighbours
are compatible when the pair encodes to itself). A state holds, for every position from which
a piece can still grow, the last token there and the count relative to now; two prefixes with
the same holdings share a state. A transition adds a character, finds the new last token and
emits ``count(new prefix) - count(old prefix)``.

*Chunks.* A text is cut into chunks of fixed length; the map of a chunk on states is known
from (its part before the first reset, the tokens between, its part after the last reset), as
a reset sends every state to the start state. Maps compose associatively, so ``compose``
gives the count by a prefix scan in any bracketing, but the fold over a text's chunks is sequential.

Counts of whole units are kept in a table bounded by ``MEMO_UNITS``; states by ``MAX_STATES``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
MEMO_UNITS = 300_000
MAX_STATES = 200_000
CHUNK_CHARS = 1 << 16
_CUT = re.compile("(?<=[^ ])(?= )")


class Transducer:
    """Lazily determinised transducer of a piece vocabulary with byte fallback."""

    def __init__(self, ranks: dict[str, float]):
        if any(MARK in p.lstrip(MARK) for p in ranks):
            raise ValueError("a piece has a space mark after another character: units are not independent")
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=1)
        self.grow = {p[:k] for p in ranks for k in range(1, len(p))}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.splits: dict[str, tuple[str, str]] = {}
        self.reset()

    def reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.held: list[tuple] = []
        self.moves: list[dict[str, tuple[int, int]]] = []
        self.start = self.state((("", "", 0),))

    def merge(self, text: str, until: int = 1) -> list[str]:
        """Pieces of a short string: join the best-ranked neighbours, leftmost first, until none is left."""
        parts = list(text)
        while len(parts) > until:
            best = min(range(len(parts) - 1), key=lambda i: (self.ranks.get(parts[i] + parts[i + 1], np.inf), i))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best: best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def halves(self, token: str) -> tuple[str, str]:
        """The two tokens whose join made this one last."""
        if token not in self.splits:
            self.splits[token] = tuple(self.merge(token, until=2))
        return self.splits[token]

    def made(self, token: str) -> float:
        """When a token is made: single characters are there from the start."""
        return -math.inf if len(token) == 1 else self.ranks[token]

    def compatible(self, left: str, right: str) -> bool:
        """Whether ``left + right`` encodes to these two (no left: ``right`` to itself).

        Going back in time, the halves that touch the border must not have been joined
        across it before the outer token was made: on the left side at equal rank the
        join further left goes first, on the right side the one across the border."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MEMO_UNITS:
                self.pairs.clear()
            known = self.pairs[key] = self.stays_apart(left, right) if left else self.merge(right) == [right]
        return known

    def stays_apart(self, left: str, right: str) -> bool:
        before_left = before_right = math.inf  # when the tokens that held these halves were made
        while True:
            across = self.ranks.get(left + right)
            if across is not None and across < before_left and across <= before_right:
                return False
            if len(left) == len(right) == 1:
                return True
            if self.made(left) > self.made(right):
                before_left, left = self.made(left), self.halves(left)[1]
                before_right = min(before_right, before_left)
            else:
                before_right, right = self.made(right), self.halves(right)[0]
                before_left = min(before_left, math.nextafter(before_right, math.inf))

    def state(self, held: tuple) -> int:
        """``held``: (text from a position on, last token before the position, count relative to now)."""
        if held not in self.ids:
            self.ids[held] = len(self.held)
            self.held.append(held)
            self.moves.append({})
        return self.ids[held]

    def emitted(self, token: str) -> int:
        """Ids that a token of the encoding stands for: a character outside the vocabulary gives its bytes."""
        return 1 if token in self.ranks else len(token.encode("utf-8", "surrogatepass"))

    def step(self, at: int, char: str) -> tuple[int, int]:
        found = self.moves[at].get(char)
        if found is not None:
            return found
        held = self.held[at]
        last, delta = None, 0
        for suffix, before, rel in held:  # longest suffix first
            token = suffix + char
            if (token in self.ranks or not suffix) and self.compatible(before, token):
                last, delta = token, rel + self.emitted(token)
                break
        if last is None:
            raise RuntimeError("no compatible token: the vocabulary is not a merge vocabulary")
        kept = [(s + char, b, r - delta) for s, b, r in held if s + char in self.grow]
        move = self.moves[at][char] = (self.state((*kept, ("", last, 0))), delta)
        return move

    def count(self, unit: str) -> int:
        """Tokens of a unit (written with space marks)."""
        if unit.startswith(MARK + MARK):  # runs of spaces tie in rank; merged directly
            return sum(map(self.emitted, self.merge(unit)))
        if len(self.held) > MAX_STATES:
            self.reset()
        at, total = self.start, 0
        for char in unit:
            move = self.moves[at].get(char) or self.step(at, char)
            at = move[0]
            total += move[1]
        return total


class UnitCounts(dict):
    """Token counts of units (key: the unit with plain spaces), filled on demand, bounded."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, unit: str) -> int:
        if len(self) >= MEMO_UNITS:
            self.clear()
        n = self.transducer.count(unit.replace(" ", MARK))
        if len(unit) <= 64:
            self[unit] = n
        return n


class WordCounts(UnitCounts):
    """The same for a word after one space (key: the word alone)."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_UNITS:
            self.clear()
        n = self.transducer.count(MARK + word)
        if len(word) <= 64:
            self[word] = n
        return n


class Counter:
    def __init__(self, transducer: Transducer):
        self.units, self.words = UnitCounts(transducer), WordCounts(transducer)

    def chunk_map(self, chunk: str) -> tuple[str, int | None, str]:
        """``(part before the first reset, tokens between, part after the last)``; count None: no reset inside."""
        if "  " not in chunk and MARK not in chunk:
            head, *rest = chunk.split(" ")
            if not rest:
                return head, None, ""
            if head:
                return head, sum(map(self.words.__getitem__, rest[:-1])), " " + rest[-1]
        parts = _CUT.split(chunk.replace(MARK, " "))
        if len(parts) == 1:
            return parts[0], None, ""
        return parts[0], sum(map(self.units.__getitem__, parts[1:-1])), parts[-1]

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of two neighbouring chunks."""
        joint = _CUT.split((a[0] if a[1] is None else a[2]) + b[0])
        if a[1] is None and b[1] is None:
            return (joint[0], None, "") if len(joint) == 1 else (joint[0], 0, joint[1])
        if a[1] is None:
            return (joint[0], b[1] + sum(self.units[u] for u in joint[1:]), b[2])
        if b[1] is None:
            return (a[0], a[1] + sum(self.units[u] for u in joint[:-1]), joint[-1])
        return (a[0], a[1] + b[1] + sum(self.units[u] for u in joint), b[2])

    def tokens(self, text: str, chunk: int = CHUNK_CHARS) -> int:
        if not text:
            return 0
        text = " " + text  # the encoder's dummy prefix
        maps = [self.chunk_map(text[i: i + chunk]) for i in range(0, len(text), chunk)]
        head, inner, tail = reduce(self.compose, maps)
        return self.units[head] + (0 if inner is None else inner + self.units[tail])


_COUNTERS: dict[str, Counter] = {}


def load(model_file: str) -> Counter:
    """The counter of a sentencepiece BPE model (identity normaliser, dummy prefix, byte fallback)."""
    if model_file not in _COUNTERS:
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        plain = [i for i in range(sp.vocab_size())
                 if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        _COUNTERS[model_file] = Counter(Transducer({sp.id_to_piece(i): -sp.get_score(i) for i in plain}))
    return _COUNTERS[model_file]


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key, n_bytes, n_tokens, over_limit`` (n_tokens > limit). One pass, no shuffle.

    ``model`` is the name of a file of ``public_tokenizers``. A null or empty text has 0 bytes
    and tokens; repeated rows and null keys give a row each; other columns are not read; an
    empty table gives an empty one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        counter = load(public_tokenizers.path(model))
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            counts = np.fromiter(map(counter.tokens, texts), np.int64, len(texts))
            sizes = np.fromiter((len(t.encode("utf-8", "surrogatepass")) for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), pa.array(counts), pa.array(counts > limit)],
                                             [key, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
