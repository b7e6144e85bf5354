"""Byte-level BPE by a lazily determinised transducer, and its streaming decoder.

A token sequence is the BPE encoding of its bytes exactly if each neighbouring
pair is: re-encoding the two tokens' bytes must give the two tokens back. So each
prefix of a pretoken has one last token. The transducer's state is the longest
suffix with which a token may still begin; an arc names the tokens that may end
with its byte, and the one that fits the token before it is put on the tape.
Where the paths from all places that are still open meet, tokens are emitted, so
the lookahead is bounded by the longest token. States and arcs are made when
first reached; a byte mostly costs one lookup and one or two pair checks.

A text is cut at blanks that begin a word where that is known to be a pretoken
border (`BLANKS`; under other patterns the text itself is cut), each piece is cut by the given pattern, new pretokens of a batch run
through the transducer together, and the ids of recent pieces are kept in a
table of bounded size.

Rows: a null text counts as empty and has no ids; texts of any length are taken
whole; equal texts give equal ids; ids outside the vocabulary raise KeyError in
decoding; bytes that are not UTF-8 decode to U+FFFD as a whole decode would.
Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.kernels import slices

#: Most pieces and token pairs a worker keeps; beyond, it starts anew.
PIECES, PAIRS = 300_000, 500_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks in a file of base64 tokens and numbers, a pair in each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class _State:
    """The longest read suffix with which a token may begin, and the arcs known from here."""

    __slots__ = ("arcs", "begun")

    def __init__(self, begun: bytes):
        self.begun, self.arcs = begun, {}


class MergeTransducer:
    """Ranks compiled for reading; encode() gives a pretoken's ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.prefixes = {token[:n] for token in ranks for n in range(1, len(token))}
        self.length = {rank: len(token) for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[tuple[int, int], int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1 and (halves := self._halves(token, rank)):
                self.parts[rank] = halves
                self.made.setdefault(halves, rank)
        self._fits: dict[int, bool] = {}
        self.states: dict[bytes, _State] = {}
        self.start = self._state(b"")

    def _halves(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one, by merging with lower ranks only."""
        ids = [self.ranks[token[i : i + 1]] for i in range(len(token))]
        while len(ids) > 2:
            best = min((self.made.get(pair, rank) for pair in zip(ids, ids[1:])), default=rank)
            if best >= rank:
                return None
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and self.made.get((ids[i], ids[i + 1])) == best:
                    out.append(best)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return (ids[0], ids[1]) if len(ids) == 2 else None

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens' bytes, encoded together, give these two tokens."""
        if len(self._fits) > PAIRS:
            self._fits.clear()
        found = self._fits[left << 32 | right] = self._apart(left, right)
        return found

    def _apart(self, left: int, right: int) -> bool:
        # Undo merges at the border, latest first. A merge across the border that
        # would have come before the merge undone last would have been taken.
        done = 1 << 62
        after_left = False  # whether the undone merge lies left of the border: a tie then went to the left
        while True:
            across = self.made.get((left, right))
            if across is not None and (across < done or across == done and not after_left):
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and left > right:
                done, left, after_left = left, a[1], True
            else:
                done, right, after_left = right, b[0], False

    def _state(self, begun: bytes) -> _State:
        found = self.states.get(begun)
        if found is None:
            found = self.states[begun] = _State(begun)
        return found

    def _arc(self, state: _State, byte: int):
        """The next state, and the tokens that may end with this byte, longest first, with their lengths."""
        read = state.begun + bytes((byte,))
        ends = [read[i:] for i in range(len(read))]
        next_ = self._state(next((x for x in ends if x in self.prefixes), b""))
        found = state.arcs[byte] = (next_, tuple((self.ranks[x], len(x)) for x in ends if x in self.ranks))
        return found

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        state, ends, out, known, most = self.start, [], [], self._fits, 8 * self.longest
        emitted = None
        for byte in piece:
            state, tokens = state.arcs.get(byte) or self._arc(state, byte)
            n = len(ends) + 1
            for token, length in tokens:
                if length < n:
                    before = ends[n - length - 1]
                elif length > n:
                    continue
                else:
                    before = emitted
                if before is None:
                    break
                fits = known.get(before << 32 | token)
                if fits if fits is not None else self.fits(before, token):
                    break
            else:
                raise ValueError(f"ranks are not a merge order: no token ends at byte {n} of {piece[:80]!r}")
            ends.append(token)
            if n >= most:
                self._emit(state, ends, out)
                emitted = out[-1] if out else None
        self._back(ends, len(ends), out)
        return out

    def _back(self, ends: list[int], n: int, out: list[int]) -> None:
        """Append the tokens that lead to place n."""
        path = []
        while n:
            token = ends[n - 1]
            path.append(token)
            n -= self.length[token]
        path.reverse()
        out += path

    def _emit(self, state: _State, ends: list[int], out: list[int]) -> None:
        """Emit the tokens on which all open places agree, and forget their bytes."""
        at = {len(ends) - n for n in range(len(state.begun) + 1)}
        while len(at) > 1:  # the furthest place steps back to where its last token begins
            far = max(at)
            at.remove(far)
            at.add(far - self.length[ends[far - 1]])
        (n,) = at
        self._back(ends, n, out)
        del ends[:n]


class Tape:
    """The transducer run over many pretokens at once: arcs and pair checks are table lookups."""

    LONG, SLOTS = 48, 1 << 20

    def __init__(self, machine: MergeTransducer):
        self.machine = machine
        self.length = np.zeros(max(machine.ranks.values(), default=0) + 1, np.int32)
        for rank, n in machine.length.items():
            self.length[rank] = n
        self.index: dict[bytes, int] = {b"": 1}
        self.names = [b"", b""]
        self.arc = np.zeros((len(machine.prefixes) + 2) * 256, np.int32)  # 0: not made yet; pages are touched as states appear
        self.next, self.tokens = np.zeros(1 << 14, np.int32), np.full((1 << 14, 2), -1, np.int32)
        self.arcs = 1
        self.pair, self.fits = np.full(self.SLOTS, -1, np.int64), np.zeros(self.SLOTS, bool)

    def _make(self, key: int) -> None:
        """One arc, from state key >> 8 by byte key & 255."""
        read = self.names[key >> 8] + bytes((key & 255,))
        ends = [read[i:] for i in range(len(read))]
        to = next((x for x in ends if x in self.machine.prefixes), b"")
        if to not in self.index:
            self.index[to] = len(self.names)
            self.names.append(to)
        tokens = [self.machine.ranks[x] for x in ends if x in self.machine.ranks]
        if self.arcs == len(self.next):
            self.next = np.concatenate([self.next, np.zeros_like(self.next)])
            self.tokens = np.concatenate([self.tokens, np.full_like(self.tokens, -1)])
        if len(tokens) > self.tokens.shape[1]:
            self.tokens = np.pad(self.tokens, ((0, 0), (0, len(tokens) - self.tokens.shape[1])), constant_values=-1)
        self.next[self.arcs] = self.index[to]
        self.tokens[self.arcs, : len(tokens)] = tokens
        self.arc[key] = self.arcs
        self.arcs += 1

    def _fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        slot = (key * 0x9E3779B97F4A7C1 >> 33) & (self.SLOTS - 1)
        miss = np.flatnonzero(self.pair[slot] != key)
        out = self.fits[slot]
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            known, check = self.machine._fits, self.machine.fits
            found = np.array([known[k] if k in known else check(k >> 32, k & 0xFFFFFFFF) for k in new.tolist()], bool)
            out[miss] = found[back]
            self.pair[slot[miss]], self.fits[slot[miss]] = key[miss], found[back]
        return out

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, as little-endian 32-bit bytes."""
        out = [b""] * len(pieces)
        sizes = np.array([len(x) for x in pieces], np.int32)
        for i in np.flatnonzero(sizes > self.LONG).tolist():
            ids = self.machine.encode(pieces[i])
            out[i] = struct.pack(f"<{len(ids)}I", *ids)
        order = np.flatnonzero((sizes > 0) & (sizes <= self.LONG))
        order = order[np.argsort(-sizes[order], kind="stable")]
        if not len(order):
            return out
        sizes, width = sizes[order], int(sizes[order[0]])
        data = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in order.tolist()), np.uint8).reshape(-1, width)
        ends, state = np.zeros(data.shape, np.int32), np.ones(len(order), np.int32)
        for at in range(width):
            n = int(np.searchsorted(-sizes, -at, "left"))  # rows longer than this place come first
            key = state[:n] * 256 + data[:n, at]
            arc = self.arc[key]
            if not arc.all():
                for k in np.unique(key[arc == 0]).tolist():
                    self._make(k)
                arc = self.arc[key]
            state = self.next[arc]
            open_ = np.arange(n)
            for c in range(self.tokens.shape[1]):
                token = self.tokens[arc[open_], c]
                first = at + 1 - self.length[token]  # where the token begins
                good = (token >= 0) & (first <= 0)
                good &= first == 0
                ask = np.flatnonzero((token >= 0) & (first > 0))
                good[ask] = self._fit(ends[open_[ask], first[ask] - 1], token[ask])
                ends[open_[good], at] = token[good]
                open_ = open_[~good]
                if not len(open_):
                    break
            else:
                raise ValueError(f"ranks are not a merge order: no token ends at byte {at} of {pieces[order[open_[0]]]!r}")
        ids, left, count = np.zeros(data.shape, np.int32), sizes.copy(), np.zeros(len(order), np.int32)
        rows = np.arange(len(order))
        while len(rows):
            token = ends[rows, left[rows] - 1]
            count[rows] += 1
            ids[rows, width - count[rows]] = token
            left[rows] -= self.length[token]
            rows = rows[left[rows] > 0]
        for i, row, n in zip(order.tolist(), ids, count.tolist(), strict=True):
            out[i] = row[width - n :].tobytes()
        return out


#: Fixed value: the pattern under which a blank between two other characters begins a pretoken, and a word of letters behind it is one.
BLANKS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Codec:
    """Encoder and decoder for one vocabulary and pretoken pattern; texts are cut at blanks first only under the pattern known to allow that."""

    _twice = re.compile(r"\s\s").search

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.machine = MergeTransducer(ranks)
        self.tape = Tape(self.machine)
        self.at_blanks = pattern == BLANKS
        found = regex.compile(pattern).finditer
        self.cut = regex.compile(pattern).findall if self.at_blanks else lambda text: [m[0] for m in found(text) if m[0]]
        self.first: dict[str, bytes] = {}  # ids of pieces
        self.later: dict[str, bytes] = {}  # ids of a blank and the piece
        self.token = {rank: token for token, rank in ranks.items()}

    def _learn(self, known: dict[str, bytes], pieces: set[str], blank: str) -> None:
        new = list(pieces - known.keys())
        if not new:
            return
        if len(known) > PIECES:
            known.clear()
            new = list(pieces)
        parts = [[x] for x in new] if not self.at_blanks else [[blank + x] if x.isalpha() and (x.isascii() or max(x) < "\u0530") else self.cut(blank + x) for x in new]
        distinct = list({y for x in parts for y in x})
        ids = dict(zip(distinct, self.whole([x.encode() for x in distinct]), strict=True))
        for piece, cut in zip(new, parts, strict=True):
            known[piece] = ids[cut[0]] if len(cut) == 1 else b"".join(map(ids.__getitem__, cut))

    def whole(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pretokens; one that is a token is that token."""
        out = [None if (rank := self.machine.ranks.get(x)) is None else struct.pack("<I", rank) for x in pieces]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self.tape.encode([pieces[i] for i in rest]), strict=True):
            out[i] = x
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit bytes."""
        heads, tails, plain = set(), set(), []
        for text in texts:
            if not self.at_blanks or self._twice(text):  # a blank may belong to a run of white space
                parts = self.cut(text)
                heads.update(parts)
                plain.append((parts, []))
            else:
                first, *rest = text.split(" ")
                if first:
                    heads.add(first)
                tails.update(rest)
                plain.append(([first] if first else [], rest))
        self._learn(self.first, heads, "")
        self._learn(self.later, tails, " ")
        head, tail = self.first.__getitem__, self.later.__getitem__
        return [b"".join(map(head, a)) + b"".join(map(tail, b)) for a, b in plain]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        try:
            return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        except KeyError as e:
            raise ValueError(f"no token has the id {e.args[0]}") from None


# Which bytes may follow a lead byte of UTF-8, and how many more then.
_LEADS = (
    (0xC2, 0xDF, 0x80, 0xBF, 0), (0xE0, 0xE0, 0xA0, 0xBF, 1), (0xE1, 0xEC, 0x80, 0xBF, 1), (0xED, 0xED, 0x80, 0x9F, 1),
    (0xEE, 0xEF, 0x80, 0xBF, 1), (0xF0, 0xF0, 0x90, 0xBF, 2), (0xF1, 0xF3, 0x80, 0xBF, 2), (0xF4, 0xF4, 0x80, 0x8F, 2),
)


class Utf8Stream:
    """Bytes in, text out, by a state machine: a character cut by the end of an input waits for the next.

    A state is what is due: how many bytes of the character are to come and between
    which values the next one must lie; None is the state between characters.
    """

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def step(state: tuple[int, int, int] | None, byte: int) -> tuple[int, int, int] | None:
        """The next state; a byte that can't follow ends the character, and begins another if it can lead one."""
        if state is not None:
            due, least, most = state
            if least <= byte <= most:
                return (due - 1, 0x80, 0xBF) if due > 1 else None
        return next(((more + 1, least, most) for low, high, least, most, more in _LEADS if low <= byte <= high), None)

    def feed(self, data: bytes, last: bool = False) -> str:
        data, self.held = self.held + data, b""
        # The state at the end depends on no more than the last three bytes, from the last one that can lead a character.
        begin = next((len(data) - n for n in range(1, min(3, len(data)) + 1) if data[-n] >= 0xC0), len(data))
        state = None
        for byte in data[begin:]:
            state = self.step(state, byte)
        if state is not None and not last:
            data, self.held = data[:begin], data[begin:]
        return data.decode("utf-8", "replace")


def decode_stream(codec: Codec, parts: Iterable[bytes]) -> Iterable[str]:
    """Texts of id parts as they come; joined, the text of all ids."""
    stream = Utf8Stream()
    for part in parts:
        yield stream.feed(codec.decode(part))
    yield stream.feed(b"", last=True)


_codecs: dict[tuple[str, str], Codec] = {}


def _codec(data: bytes, pattern: str) -> Codec:
    key = (hashlib.sha256(data).hexdigest(), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(read_ranks(data), pattern)
    return _codecs[key]


def _file(docs: DataFrame, path: str):
    """A vocabulary file, of about 1 MB, for all executors; a path with a scheme is read by Spark."""
    spark = docs.sparkSession
    if "://" in path:
        data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    else:
        with open(path, "rb") as f:
            data = f.read()
    return spark.sparkContext.broadcast(data)


def encode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), check: bool = False) -> DataFrame:
    """The columns to keep, n_tokens and ids (array<int>) of every text; check: decoded, whether the ids give the text back."""
    data, schema = _file(docs, path), docs.select(*keep).schema

    def run(batches):
        codec = _codec(data.value, pattern)
        for batch in slices(batches):
            texts = [text or "" for text in batch.column("text").to_pylist()]
            ids = codec.encode_all(texts)
            at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            out = {c: batch.column(c) for c in keep} | {"n_tokens": pa.array(np.diff(at).astype(np.int64)), "ids": pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(ids), np.int32)))}
            if check:
                out["decoded"] = pa.array(["".join(decode_stream(codec, _blocks(x))) == text for x, text in zip(ids, texts, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_pydict(out)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, f"{fields}, n_tokens long, ids array<int>" + ", decoded boolean" * check)


def _blocks(ids: bytes, block: int = 1 << 14) -> Iterable[bytes]:
    """Parts of `block` ids each."""
    return (ids[i : i + 4 * block] for i in range(0, len(ids), 4 * block))


def decode(encoded: DataFrame, path: str, pattern: str, block: int = 1 << 14) -> DataFrame:
    """doc_id and text of rows with ids; a null row of ids is an empty text."""
    data = _file(encoded, path)

    def run(batches):
        codec = _codec(data.value, pattern)
        for batch in batches:
            texts = []
            for ids in batch.column("ids"):
                raw = np.asarray(ids.as_py() or [], "<u4").tobytes()
                texts.append("".join(decode_stream(codec, _blocks(raw, block))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, pattern: str, block: int = 1 << 14) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: every text encoded, and its ids decoded as a stream."""
    data = _file(docs, path)

    def run(batches):
        codec = _codec(data.value, pattern)
        for batch in slices(batches):
            rows = []
            for ids in codec.encode_all([text or "" for text in batch.column("text").to_pylist()]):
                back = hashlib.sha256()
                for part in decode_stream(codec, _blocks(ids, block)):
                    back.update(part.encode())
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), back.hexdigest()))
            n, a, b = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
