"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece there is exactly one token that can end a valid encoding of that
prefix, so one array of last tokens holds the encodings of all prefixes. Appending bytes only
extends the array; after an edit it is refilled until it agrees again with the old one over the
length of the longest token.

Two neighbouring tokens are valid when no merge would ever have crossed the border between
them. Both sides grow on their own in order of rank, so the test walks the right spine of the
left token and the left spine of the right token and compares the rank of the crossing pair
with the next merge of either side; of equal ranks the leftmost goes first.

A piece that is itself a token is that token, as in the tiktoken library.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from molspark.llm.common import SLICE_BYTES, forget, slices, worker_memory

#: Pieces whose tokens, and token pairs whose validity, a worker remembers. A full memory loses
#: its newer half: frequent pieces come early.
REMEMBERED_PIECES = 200_000
REMEMBERED_PAIRS = 200_000
TABLED_PAIRS = 600_000
#: Characters of a piece that is remembered, at most, and pieces that are worked out together.
SHORT, TOGETHER = 64, 1 << 14
#: Rows of a task, about, where rows are dealt to tasks.
TASK_ROWS = 10_000
#: Characters before a change whose pieces may split differently: the longest look-ahead of
#: the pattern's alternatives.
LOOK_AHEAD = 4


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file of a public tokenizer: base64 token and rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _forget(memory: dict) -> None:
    for key in list(memory)[len(memory) // 2 :]:
        del memory[key]


class Splitter:
    """findall of a pattern. Texts of low code points take the same pattern with its Unicode
    classes written out for them, which the standard library's engine matches much faster."""

    LOW = 0x250

    def __init__(self, pattern: str):
        self._any = regex.compile(pattern)
        self._beyond = re.compile(f"[^\\x00-{chr(self.LOW - 1)}]")
        self._low = None
        if set(re.findall(r"\\.", pattern)) <= {r"\p", r"\s", r"\S"} and set(re.findall(r"\\p\{\w+\}", pattern)) <= {r"\p{L}", r"\p{N}"}:
            letters, numbers, blanks = (
                "".join(re.escape(c) for c in map(chr, range(self.LOW)) if regex.match(kind, c)) for kind in (r"\p{L}", r"\p{N}", r"\s")
            )
            bare = {r"\p{L}": letters, r"\p{N}": numbers, r"\s": blanks}
            within = lambda m: re.sub(r"\\p\{\w\}|\\s", lambda c: bare[c[0]], m[0])
            parts = re.split(r"(\[[^\]]*\])", pattern)
            for i, part in enumerate(parts):
                if i % 2:
                    parts[i] = re.sub(r".+", within, part)
                else:
                    part = part.replace(r"\S", f"[^{blanks}]")
                    for name, members in bare.items():
                        part = part.replace(name, f"[{members}]")
                    parts[i] = part
            pattern = "".join(parts)
            self._low = re.compile(pattern)

    def __call__(self, text: str) -> list[str]:
        if self._low is None or self._beyond.search(text):
            return self._any.findall(text)
        return self._low.findall(text)


class Merges:
    """Vocabulary with its merge trees; every single byte must be a token."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks a single byte")
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._right: dict[int, list[int]] = {}
        self._left: dict[int, list[int]] = {}
        self._apart: dict[int, bool] = {}
        self.finder = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if self.made(rank):
                self.finder.add_word(token.decode("latin-1"), (rank, len(token)))
        self.finder.make_automaton()

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte or if no merges make it."""
        if token not in self._parts:
            whole = self.bytes_of[token]
            pieces = [whole[i : i + 1] for i in range(len(whole))]
            while len(pieces) > 2:
                found = [(self.ranks[pair], i) for i in range(len(pieces) - 1) if (pair := pieces[i] + pieces[i + 1]) in self.ranks]
                if not found:
                    break
                at = min(found)[1]
                pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
            self._parts[token] = (self.ranks[pieces[0]], self.ranks[pieces[1]]) if len(pieces) == 2 else None
        return self._parts[token]

    def made(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token."""
        return len(self.bytes_of[token]) == 1 or self.parts(token) is not None

    def _spine(self, token: int, side: int, known: dict[int, list[int]]) -> list[int]:
        if token not in known:
            spine = [token]
            while parts := self.parts(spine[-1]):
                spine.append(parts[side])
            known[token] = spine[::-1]
        return known[token]

    def apart(self, left: int, right: int) -> bool:
        """Whether the two tokens stay two when their bytes are encoded together."""
        key = left << 32 | right
        apart = self._apart.get(key)
        if apart is None:
            if len(self._apart) >= REMEMBERED_PAIRS:
                _forget(self._apart)
            apart = self._stay(self._spine(left, 1, self._right), self._spine(right, 0, self._left))
            self._apart[key] = apart
        return apart

    def _stay(self, left: list[int], right: list[int]) -> bool:
        never = 1 << 60
        i = j = 0
        while True:
            next_left = left[i + 1] if i + 1 < len(left) else never
            next_right = right[j + 1] if j + 1 < len(right) else never
            crossing = self.ranks.get(self.bytes_of[left[i]] + self.bytes_of[right[j]], never)
            if crossing < next_left and crossing <= next_right and crossing != never:
                return False
            if next_left == next_right == never:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1


class Prefixes:
    """One piece with the last token of each of its prefixes."""

    def __init__(self, merges: Merges, data: bytes = b""):
        self.merges, self.data, self.last = merges, b"", [-1]
        self.append(data)

    def copy(self) -> Prefixes:
        twin = Prefixes(self.merges)
        twin.data, twin.last = self.data, list(self.last)
        return twin

    def append(self, more: bytes) -> None:
        """Extend the piece; only tokens that end in the new bytes are looked at."""
        start = len(self.data)
        self.data += more
        last, apart, known = self.last, self.merges.apart, self.merges._apart.get
        last.extend([-1] * len(more))
        base = max(0, start - self.merges.longest)
        for stop, (token, size) in self.merges.finder.iter(self.data[base:].decode("latin-1")):
            end = base + stop + 1
            if end <= start or last[end] >= 0:
                continue
            if size < end:
                left = last[end - size]
                valid = known(left << 32 | token)
                if valid is None:
                    valid = apart(left, token)
                if not valid:
                    continue
            last[end] = token

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Change bytes ``start`` to ``stop``; the number of prefixes that were worked out again."""
        old, old_last = self.data, self.last
        self.data = old[:start] + new + old[stop:]
        shift = len(self.data) - len(old)
        last, run, worked = old_last[: start + 1], 0, 0
        same_from = start + len(new) + self.merges.longest
        for end in range(start + 1, len(self.data) + 1):
            token = self._last_token(self.data, last, end)
            last.append(token)
            worked += 1
            run = run + 1 if end > start + len(new) and token == old_last[end - shift] else 0
            if run >= self.merges.longest and end >= same_from:
                last.extend(old_last[end - shift + 1 :])
                break
        self.last = last
        return worked

    def _last_token(self, data: bytes, last: list[int], end: int) -> int:
        merges = self.merges
        ranks = merges.ranks
        for size in range(min(end, merges.longest), 0, -1):
            token = ranks.get(data[end - size : end])
            if token is None:
                continue
            if size == end:
                if merges.made(token):
                    return token
            elif merges.made(token) and merges.apart(last[end - size], token):
                return token
        raise AssertionError("no token ends this prefix")

    def tokens(self) -> list[int]:
        whole = self.merges.ranks.get(self.data)
        if whole is not None:
            return [whole]
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.merges.bytes_of[self.last[end]])
        return out[::-1]


class _Table:
    """Numbers of 31 bits by key, a whole array of them at a time; -1 is none. Open addressing."""

    def __init__(self, bits: int):
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        self.shift, self.held = np.uint64(64 - bits), 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        found, at = np.full(len(keys), -1, np.int32), self._slots(keys)
        todo = np.arange(len(keys))
        while len(todo):
            there = np.take(self.keys, at)
            hit = there == keys[todo]
            found[todo[hit]] = np.take(self.values, at[hit])
            on = np.flatnonzero(~hit & (there != -1))
            todo, at = todo[on], (at[on] + 1) & (len(self.keys) - 1)
        return found

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """``keys`` are distinct and new."""
        self.held += len(keys)
        at = self._slots(keys)
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]
            done = self.keys[at] == keys
            self.values[at[done]] = values[done]
            keys, values, at = keys[~done], values[~done], (at[~done] + 1) & (len(self.keys) - 1)


class ManyPieces:
    """Tokens of many pieces at once: their prefix arrays are filled side by side, from one length of
    prefix to the next."""

    def __init__(self, merges: Merges):
        self.merges = merges
        edges: dict[int, int] = {}
        ends = [-1]
        for token, rank in merges.ranks.items():
            if merges.made(rank):
                node = 0
                for byte in token:
                    key = node << 8 | byte
                    node = edges.get(key, -1)
                    if node < 0:
                        node = edges[key] = len(ends)
                        ends.append(-1)
                ends[node] = rank
        self.ends = np.array(ends, np.int32)
        self.edges = _Table((2 * len(edges)).bit_length())
        self.edges.put(np.fromiter(edges, np.int64, len(edges)), np.fromiter(edges.values(), np.int32, len(edges)))
        self._no_pairs()

    def _no_pairs(self) -> None:
        self.pairs = _Table((3 * TABLED_PAIRS // 2).bit_length())

    def _matches(self, data: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first byte, number of bytes, token) of all tokens in ``data`` that end before the stop of
        their first byte."""
        at, node, size, found = np.arange(len(data)), np.zeros(len(data), np.int64), 0, []
        while len(at):
            node = self.edges.get(node << 8 | data[at + size])
            on = np.flatnonzero(node >= 0)
            at, node, size = at[on], node[on].astype(np.int64), size + 1
            token = np.take(self.ends, node)
            some = np.flatnonzero(token >= 0)
            found.append((at[some], np.full(len(some), size), token[some].astype(np.int64)))
            on = np.flatnonzero(at + size < stops[at])
            at, node = at[on], node[on]
        return tuple(np.concatenate(part) for part in zip(*found, strict=True))

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        apart = self.pairs.get(keys)
        new = np.unique(keys[apart < 0])
        if len(new):
            merges = self.merges
            stay = [merges._stay(merges._spine(k >> 32, 1, merges._right), merges._spine(k & 0xFFFFFFFF, 0, merges._left)) for k in new.tolist()]
            values = np.array(stay, np.int32)
            unknown = np.flatnonzero(apart < 0)
            apart[unknown] = values[np.searchsorted(new, keys[unknown])]
            if self.pairs.held + len(new) > TABLED_PAIRS:
                self._no_pairs()
            self.pairs.put(new[:TABLED_PAIRS], values[:TABLED_PAIRS])
        return apart > 0

    def tokens(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all pieces, their number by piece), of pieces of a byte at least."""
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lengths = np.array([len(p) for p in pieces])
        stops = np.cumsum(lengths)
        starts = stops - lengths
        data = np.frombuffer(b"".join(pieces), np.uint8)
        first, size, token = self._matches(data, np.repeat(stops, lengths))
        from_start = first - np.repeat(starts, lengths)[first]
        # last token, and its size, of the prefix that ends in each byte
        last, sizes = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
        ends = from_start + size
        order = np.argsort(ends.astype(np.uint16), kind="stable")  # a few hundred bytes at most
        borders = np.searchsorted(ends[order], np.arange(1, ends.max() + 2))
        for low, high in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
            here = order[low:high]
            follows = np.flatnonzero(from_start[here] > 0)
            valid = np.ones(len(here), bool)
            valid[follows] = self._apart(last[first[here[follows]] - 1], token[here[follows]])
            here = here[valid]
            end = first[here] + size[here] - 1
            last[end], sizes[end] = token[here], size[here]
        at, piece, steps = stops - 1, np.arange(len(pieces)), []
        counts = np.zeros(len(pieces), np.int64)
        while len(piece):
            steps.append((piece, last[at]))
            counts[piece] += 1
            at = at - sizes[at]
            on = np.flatnonzero(at >= starts[piece])
            at, piece = at[on], piece[on]
        behind = np.cumsum(counts)
        flat = np.zeros(counts.sum(), np.int64)
        for step, (piece, tokens) in enumerate(steps):
            flat[behind[piece] - 1 - step] = tokens
        return flat, counts


class PieceTokens(dict):
    """Tokens by piece, worked out when first asked for."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED_PIECES:
            _forget(self)
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.merges.ranks.get(data)
        tokens = (whole,) if whole is not None else self._tokens(data)
        if len(piece) <= SHORT:
            self[piece] = tokens
        return tokens

    def _tokens(self, data: bytes) -> tuple[int, ...]:
        """As ``Prefixes`` does it for a whole piece, with the sizes of the last tokens kept beside."""
        merges = self.merges
        known, apart = merges._apart.get, merges.apart
        last, sizes = [-1] * (len(data) + 1), [0] * (len(data) + 1)
        for stop, (token, size) in merges.finder.iter(data.decode("latin-1")):
            stop += 1
            if sizes[stop]:
                continue
            if size != stop:
                left = last[stop - size]
                valid = known(left << 32 | token)
                if valid is None:
                    valid = apart(left, token)
                if not valid:
                    continue
            last[stop], sizes[stop] = token, size
        tokens, end = [], len(data)
        while end:
            tokens.append(last[end])
            end -= sizes[end]
        return tuple(tokens[::-1])


class PieceNumbers(dict):
    """A number for each piece, and the tokens of all numbers in one array. Short pieces are numbered
    from 0 on and remembered; longer ones have numbers below 0 until the next call."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges, self.one, self.many = merges, PieceTokens(merges), ManyPieces(merges)
        self.flat, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.new: list[str] = []
        self.long: list[str] = []

    def __missing__(self, piece: str) -> int:
        if len(piece) <= SHORT:
            number = len(self.counts) + len(self.new)
            self.new.append(piece)
        else:
            self.long.append(piece)
            number = -len(self.long)
        self[piece] = number
        return number

    def encode(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all texts, given by their pieces, and the borders of the texts)."""
        if len(self) >= REMEMBERED_PIECES:
            _forget(self)
            self.counts = self.counts[: len(self)]
            self.flat = self.flat[: self.counts.sum()]
        sizes = np.array([len(pieces) for pieces in texts], np.int64)
        numbers = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64, sizes.sum())
        for start in range(0, len(self.new), TOGETHER):
            self._learn(self.new[start : start + TOGETHER])
        longer = [self.one[piece] for piece in reversed(self.long)]
        flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(longer), np.int32)])
        counts = np.concatenate([self.counts, np.array([len(tokens) for tokens in longer], np.int64)])
        for piece in self.long:
            del self[piece]
        self.new, self.long = [], []
        begins, times = (np.cumsum(counts) - counts)[numbers], counts[numbers]
        behind = np.concatenate([[0], np.cumsum(times)])
        tokens = flat[np.repeat(begins - behind[:-1], times) + np.arange(behind[-1])]
        return tokens, behind[np.concatenate([[0], np.cumsum(sizes)])]

    def _learn(self, pieces: list[str]) -> None:
        data = [piece.encode("utf-8", "surrogatepass") for piece in pieces]
        whole = np.fromiter((self.merges.ranks.get(d, -1) for d in data), np.int64, len(data))
        rest = np.flatnonzero(whole < 0)
        counts = np.ones(len(data), np.int64)
        tokens, counts[rest] = self.many.tokens([data[i] for i in rest])
        at = np.repeat(whole < 0, counts)
        flat = np.zeros(len(at), np.int32)
        flat[at], flat[~at] = tokens, whole[whole >= 0]
        self.flat, self.counts = np.concatenate([self.flat, flat]), np.concatenate([self.counts, counts])


class EncodedText:
    """A text with its pieces' prefix arrays, for appends and edits without a new encoding."""

    def __init__(self, merges: Merges, pattern: str, text: str = ""):
        self.merges, self.split = merges, regex.compile(pattern)
        self.text, self.pieces = "", []
        self.replace(0, 0, text)

    def tokens(self) -> list[int]:
        return [t for piece in self.pieces for t in piece[1].tokens()]

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, stop: int, new: str) -> None:
        """Change characters ``start`` to ``stop``. Pieces well before the change and from the
        first common border after it on are kept; a piece that holds the change keeps the part
        of its prefix array that is still right."""
        old = self.text
        self.text = old[:start] + new + old[stop:]
        shift = len(self.text) - len(old)
        kept, at = [], 0
        for piece, prefixes in self.pieces:
            if at + len(piece) > start - LOOK_AHEAD:
                break
            kept.append((piece, prefixes))
            at += len(piece)
        borders, place = {}, 0
        for i, (piece, _) in enumerate(self.pieces):
            if place >= stop:
                borders[place + shift] = i
            place += len(piece)
        rest = self.pieces[len(kept) :]
        while at < len(self.text):
            if at >= start + len(new) and at in borders:
                kept.extend(self.pieces[borders[at] :])
                break
            found = self.split.match(self.text, at)
            piece = found.group()
            kept.append((piece, self._again(piece, rest)))
            at += len(piece)
        self.pieces = kept

    def _again(self, piece: str, rest: list) -> Prefixes:
        """The prefix array of a piece, from that of the next old one where it shares a prefix."""
        if rest:
            old, prefixes = rest.pop(0)
            if old == piece:
                return prefixes
            if piece.startswith(old):
                prefixes = prefixes.copy()
                prefixes.append(piece[len(old) :].encode("utf-8", "surrogatepass"))
                return prefixes
        return Prefixes(self.merges, piece.encode("utf-8", "surrogatepass"))


def _remembered(ranks: dict[bytes, int]) -> PieceNumbers:
    """The memory of this Python worker, which serves one task after another."""
    known = worker_memory("bpe", lambda: PieceNumbers(Merges(ranks)))
    if known.merges.ranks != ranks:
        forget()
    return worker_memory("bpe", lambda: PieceNumbers(Merges(ranks)))


class _ByteTable:
    """The bytes of all tokens in one buffer, from which whole batches of ids are gathered."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        self.lengths, self.starts = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        at = 0
        for token, rank in ranks.items():
            self.lengths[rank], self.starts[rank] = len(token), at
            at += len(token)
        self.bytes = np.frombuffer(b"".join(ranks), np.uint8)

    def join(self, lists: pa.ListArray) -> pa.Array:
        ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths) or (self.lengths[ids] < 0).any()):
            raise ValueError("an id is not in the vocabulary")
        lengths = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        source = np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends[:-1], lengths)
        counts = np.array([0 if c is None else c for c in pc.list_value_length(lists).to_pylist()], np.int64)
        borders = ends[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(borders), pa.py_buffer(self.bytes[source])])


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Append ``out`` (array of int) with the ids of the whole text, without special tokens.

    A null or empty text has no ids. All columns are kept; a column already called ``out`` is
    replaced. Rows are neither shuffled nor dropped, so repeated rows give repeated results and
    an empty table an empty one. The vocabulary, a file of fixed size, is broadcast.
    """
    rows = df.drop(out) if out != text else df.withColumnRenamed(text, f"{text}__in")
    source = text if out != text else f"{text}__in"
    vocabulary = df.sparkSession.sparkContext.broadcast(ranks)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])
    at = rows.columns.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, split = _remembered(vocabulary.value), Splitter(pattern)
        for batch in slices(batches, SLICE_BYTES // 2):
            tokens, borders = known.encode([split(text) if text else [] for text in batch.column(at).to_pylist()])
            ids = pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pa.array(tokens, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, out])

    return rows.mapInArrow(run, schema)


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Append ``out`` (binary) with the bytes that the ids stand for; null ids give no bytes.

    An id outside the vocabulary fails the job. Other columns and rows are kept as they are.
    """
    rows = df.drop(out)
    vocabulary = df.sparkSession.sparkContext.broadcast(ranks)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.BinaryType(), False)])
    at = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _ByteTable(vocabulary.value)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, table.join(batch.column(at))], [*batch.schema.names, out])

    return rows.mapInArrow(run, schema)


def digests(ids: str = "ids", decoded: str = "decoded") -> list[Column]:
    """Columns n_tokens, ids_sha256 and decoded_sha256 of an encoded and decoded table."""
    written = F.array_join(F.col(ids).cast("array<string>"), " ")
    return [
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(written.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    ]
