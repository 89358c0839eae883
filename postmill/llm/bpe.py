"""Byte-level BPE with a finite-state transducer, and streaming decoding with a UTF-8 state machine.

A sequence of tokens is the encoding of its bytes exactly if every two neighbours fit: no merge may ever join across their border.
So encoding is a search for the one path of fitting tokens through the bytes. The transducer follows all paths at once: its state is
the set of open hypotheses, each what may still become of an unfinished token and the tokens it would emit before. Tokens are
emitted as soon as all hypotheses agree on them, at most a token's length of bytes later. Merges are compiled into arcs only when a
text first needs them (a lazy subset construction), and what is compiled is kept up to a bound.
"""

from __future__ import annotations

import base64
from array import array
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.common import text_of

RANKS = "byte_bpe_50k.tiktoken"
# Bytes a worker keeps, by estimate: of arcs and states, and of the ids of recent short pieces; and how many pairs of tokens it knows to
# fit or not. An entry of a dictionary is taken to need so many bytes besides what it holds.
COMPILED = 160 << 20
REMEMBERED = 96 << 20
MOST_PAIRS = 1 << 17
ENTRY = 250
LONGEST_PIECE = 64
# An unfinished token is resolved into the tokens it may become, which makes states equal that differ in the past only, once there
# are no more of them than this.
FEW = 16
# Tokens decoded at a time, and bytes of text after which a task hands on what it has.
CHUNK = 1 << 16
SLICE = 1 << 18


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Fit:
    """Which tokens may stand side by side.

    While its text is merged, a token's edge is first a byte and then ever longer tokens, each until the merge that makes the next
    one. A merge across the border of two tokens happens if its rank comes before the end of both edges it joins; of equal ranks the
    left one comes first.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.never = ranks, len(ranks) + max(ranks.values())
        # Parts and edges are bounded by the vocabulary.
        self.halves: dict[bytes, list[bytes]] = {}
        self.edges: dict[tuple[bytes, int], list[tuple[bytes, int]]] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}

    def split(self, token: bytes) -> list[bytes]:
        """The two parts whose merge makes the token; the token alone if merging its bytes does not lead to it."""
        parts = self.halves.get(token)
        if parts is None:
            parts = [token[i:i + 1] for i in range(len(token))]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(x + y, self.never), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
                if rank == self.never:
                    parts = [token]
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            self.halves[token] = parts
        return parts

    def edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The tokens at the left (0) or right (-1) edge, each with the rank of the merge that ends it."""
        found = self.edges.get((token, side))
        if found is None:
            found, end, part = [], self.never, token
            while True:
                found.append((part, end))
                parts = self.split(part)
                if len(part) == 1 or len(parts) == 1:
                    break
                end, part = self.ranks[part], parts[side]
            self.edges[token, side] = found
        return found

    def __call__(self, left: bytes, right: bytes) -> bool:
        """May ``right`` follow ``left``? An empty ``left`` is the start."""
        pair = (left, right)
        fits = self.pairs.get(pair)
        if fits is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            fits = self.pairs[pair] = self.judged(left, right)
        return fits

    def judged(self, left: bytes, right: bytes) -> bool:
        if len(right) > 1 and len(self.split(right)) == 1:
            return False
        if not left:
            return True
        for x, x_end in self.edge(left, -1):
            for y, y_end in self.edge(right, 0):
                rank = self.ranks.get(x + y)
                if rank is not None and rank < x_end and rank <= y_end:
                    return False
        return True


# A hypothesis is ``(last, pending, options)``: the token before, the bytes of the unfinished token, and once they are few, the tokens
# it may become; ``last`` is then empty, as it has done its work.
Hypothesis = tuple[bytes, bytes, tuple[bytes, ...]]


# Low bits of a number that holds a second one: of an arc's or a state's entry the lists of lengths, of a move the token that ends.
LOW = 24
MASK = (1 << LOW) - 1


class Transducer:
    """Bytes of one piece in, token ids out.

    Everything compiled is kept as plain numbers where it can be: an arc is ``state << LOW | lengths``, an entry of a state
    ``hypothesis << LOW | lengths``, a move ``hypothesis + 1 << LOW | rank + 1``, where lengths are numbered tuples.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.fit = ranks, Fit(ranks)
        self.tokens = sorted(ranks)
        self.token_of = {rank: token for token, rank in ranks.items()}
        self.clear()

    def clear(self) -> None:
        # States and hypotheses by number; state 0 is the start, hypothesis 0 the empty piece, lengths 0 none.
        self.lengths: list[tuple[int, ...]] = [()]
        self.lengths_of = {(): 0}
        self.hypotheses: list[Hypothesis] = [(b"", b"", ())]
        self.hypothesis_of = {self.hypotheses[0]: 0}
        self.states: list[tuple[int, ...]] = [(0,)]
        self.state_of = {self.states[0]: 0}
        self.next: dict[int, int] = {}
        self.arcs: dict[int, int] = {}
        self.held = 0
        # Sizes of all these once they hold ``COMPILED`` bytes. From then on a piece's own additions go when it ends.
        self.full: tuple[int, ...] | None = None

    def sizes(self) -> tuple[int, ...]:
        return len(self.lengths), len(self.hypotheses), len(self.states), len(self.next), len(self.arcs)

    def back(self) -> None:
        """Drop what was compiled since the table was full. Lists and dictionaries keep their order, so it is what came last."""
        n_lengths, n_hypotheses, n_states, n_next, n_arcs = self.full
        del self.lengths[n_lengths:], self.hypotheses[n_hypotheses:], self.states[n_states:]
        for table, n in (
            (self.lengths_of, n_lengths), (self.hypothesis_of, n_hypotheses), (self.state_of, n_states), (self.next, n_next), (self.arcs, n_arcs),
        ):
            while len(table) > n:
                table.popitem()
        self.held = COMPILED

    def continued(self, state: int) -> int:
        """Drop in the middle of a long piece all that it has compiled but for ``state``; its number afterwards."""
        kept = [(self.hypotheses[e >> LOW], self.lengths[e & MASK]) for e in self.states[state]]
        self.back()
        return self.state([(self.number(hypothesis), held) for hypothesis, held in kept])

    def numbered(self, lengths: tuple[int, ...]) -> int:
        at = self.lengths_of.setdefault(lengths, len(self.lengths))
        if at == len(self.lengths):
            self.lengths.append(lengths)
            self.held += ENTRY
        return at

    def state(self, entries: Sequence[tuple[int, tuple[int, ...]]]) -> int:
        target = tuple(sorted(at << LOW | self.numbered(held) for at, held in entries))
        number = self.state_of.setdefault(target, len(self.states))
        if number == len(self.states):
            self.states.append(target)
            self.held += ENTRY + 40 * len(target)
        return number

    def number(self, hypothesis: Hypothesis) -> int:
        at = self.hypothesis_of.setdefault(hypothesis, len(self.hypotheses))
        if at == len(self.hypotheses):
            self.hypotheses.append(hypothesis)
            self.held += 2 * ENTRY + 8 * len(hypothesis[2])
        return at

    def advance(self, at: int, byte: int) -> int:
        """The move of a hypothesis on a byte: the hypothesis after it, if anything is left, and the token that ends here, if any."""
        last, pending, options = self.hypotheses[at]
        pending += bytes((byte,))
        if not options:
            low = bisect_left(self.tokens, pending)
            high = bisect_left(self.tokens, True, low, key=lambda t: not t.startswith(pending))
            if high - low > FEW:
                ends = pending in self.ranks and self.fit(last, pending)
                return self.number((last, pending, ())) + 1 << LOW | (self.ranks[pending] + 1 if ends else 0)
            options = [t for t in self.tokens[low:high] if self.fit(last, t)]
        else:
            options = [t for t in options if t.startswith(pending)]
        longer = tuple(t for t in options if len(t) > len(pending))
        ended = self.ranks[pending] + 1 if len(longer) < len(options) else 0
        return (self.number((b"", pending, longer)) + 1 if longer else 0) << LOW | ended

    def step(self, state: int, byte: int) -> int:
        """Make the arc from ``state`` on ``byte``: the next state, and the lengths of the tokens all its hypotheses agree on."""
        found = []
        for entry in self.states[state]:
            at, held = entry >> LOW, self.lengths[entry & MASK]
            move = self.next.get(at << 8 | byte)
            if move is None:
                move = self.next[at << 8 | byte] = self.advance(at, byte)
                self.held += ENTRY // 2
            if move >> LOW:
                found.append(((move >> LOW) - 1, held))
            if move & MASK:
                ended = self.token_of[(move & MASK) - 1]
                found.append((self.number((ended, b"", ())), (*held, len(ended))))
        heads, agreed = [held for _, held in found], 0
        while all(len(h) > agreed and h[agreed] == heads[0][agreed] for h in heads):
            agreed += 1
        after = self.state([(at, held[agreed:]) for at, held in found])
        arc = self.arcs[state << 8 | byte] = after << LOW | self.numbered(heads[0][:agreed])
        self.held += ENTRY // 2
        return arc

    def encode(self, piece: bytes) -> array:
        known = self.ranks.get(piece)
        if known is not None:
            return array("i", (known,))
        lengths, state, arcs = [], 0, self.arcs
        for byte in piece:
            arc = arcs.get(state << 8 | byte)
            if arc is None:
                if self.held > COMPILED:
                    self.full = self.full or self.sizes()
                    if self.held > COMPILED + COMPILED // 4:
                        state = self.continued(state)
                arc = self.step(state, byte)
            state = arc >> LOW
            if arc & MASK:
                lengths += self.lengths[arc & MASK]
        # The one hypothesis without an unfinished token is the encoding.
        lengths += next(self.lengths[e & MASK] for e in self.states[state] if not self.hypotheses[e >> LOW][1])
        ids, start, ranks = array("i"), 0, self.ranks
        for length in lengths:
            ids.append(ranks[piece[start:start + length]])
            start += length
        if self.full and len(self.arcs) > self.full[-1]:
            self.back()
        return ids


class Pieces(dict):
    """The ids of recent pieces, as bytes of 32-bit numbers, in two generations: a full one becomes the older, which is then dropped
    but for the pieces that were met again."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer, self.held, self.older = transducer, 0, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.pop(piece, None)
        if ids is None:
            ids = self.transducer.encode(piece.encode()).tobytes()
        if len(piece) <= LONGEST_PIECE:
            if self.held > REMEMBERED // 2:
                self.older, self.held = dict(self), 0
                self.clear()
            self[piece] = ids
            self.held += ENTRY + len(piece) + len(ids)
        return ids


class Utf8Stream:
    """Incremental UTF-8: give it bytes cut anywhere, get the characters that are complete.

    Its state is the bytes of the character begun last, at most three.
    """

    def __init__(self) -> None:
        self.begun = b""

    def feed(self, data: bytes) -> str:
        data = self.begun + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead >= 0xC0:  # a lead byte tells how many bytes its character has
                if (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4) > back:
                    cut -= back
                break
            if lead < 0x80:
                break
        self.begun = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        """What is left of a character that never came to its end: a replacement character."""
        left, self.begun = self.begun, b""
        return left.decode("utf-8", "replace")


class Vocabulary:
    """The bytes of every id; ids outside the vocabulary become the replacement character."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        tokens = ["�".encode()] * (size + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.size = size
        self.tokens = tokens

    def decode(self, ids: np.ndarray) -> str:
        stream, out = Utf8Stream(), []
        known = np.where((ids < 0) | (ids >= self.size), self.size, ids)
        for at in range(0, len(known), CHUNK):
            out.append(stream.feed(b"".join(map(self.tokens.__getitem__, known[at:at + CHUNK].tolist()))))
        return "".join(out) + stream.end()


@lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    """One per Python worker: later tasks find the states and pieces of earlier ones."""
    return Pieces(Transducer(read_ranks(path)))


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(read_ranks(path))


def _schema(df: DataFrame, keep: Sequence[str], *more: T.StructField) -> T.StructType:
    return T.StructType([*[df.schema[c] for c in keep], *more])


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch, about ``SLICE`` bytes of ``column`` at a time and one row at least."""
    share = max(1, batch.column(column).nbytes // SLICE)
    rows = max(1, batch.num_rows // share)
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _id_lists(pieces: Pieces, cut, texts: pa.Array) -> pa.ListArray:
    lists = [b"".join(map(pieces.__getitem__, cut(text.as_py()))) for text in texts]
    ends = np.cumsum([0, *map(len, lists)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(lists), np.int32)))


def _texts(vocabulary: Vocabulary, lists: pa.ListArray) -> pa.Array:
    return pa.array([vocabulary.decode(ids.values.to_numpy(zero_copy_only=False)) for ids in lists], pa.string())


IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))
DECODED = T.StructField("decoded", T.StringType())


def encode(
    docs: DataFrame, keep: Sequence[str], path: str | None = None, pattern: str = public_tokenizers.PATTERN, proof: bool = False
) -> DataFrame:
    """The columns ``keep`` and ``ids``, the token ids of the whole ``text``. Null and empty texts have no ids.

    With ``proof``, also ``decoded``: what decoding the ids gives, done by the same task.
    """
    path = path or public_tokenizers.path(RANKS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, cut = _pieces(path), regex.compile(pattern).findall
        for part in (part for batch in batches for part in _slices(batch, "_text")):
            ids = _id_lists(pieces, cut, part.column("_text"))
            more = {"ids": ids} | ({"decoded": _texts(_vocabulary(path), ids)} if proof else {})
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *more.values()], [*keep, *more])

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], text_of("text").alias("_text"))
    return rows.mapInArrow(work, _schema(rows, keep, IDS, *[DECODED] * proof))


def decode(encoded: DataFrame, keep: Sequence[str], path: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``decoded``, the text of ``ids``. Null and empty lists give the empty text."""
    path = path or public_tokenizers.path(RANKS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in _slices(batch, "_ids")):
            texts = _texts(_vocabulary(path), part.column("_ids"))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], texts], [*keep, "decoded"])

    ids = F.coalesce(F.col("ids").cast("array<int>"), F.array().cast("array<int>"))
    known = F.transform(ids, lambda i: F.coalesce(i, F.lit(-1)))
    rows = encoded.select(*[F.col(f"`{c}`") for c in keep], known.alias("_ids"))
    return rows.mapInArrow(work, _schema(rows, keep, DECODED))


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Documents as token ids, and the proof that they decode: doc_id, n_tokens, ids_sha256, decoded_sha256, ids.

    A null text is empty: no ids, and the digests of the empty string. Null doc_ids and repeated rows stay as they are; an
    empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return encode(rows, ["doc_id"], path, proof=True).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "ids",
    )
