"""Byte-level BPE encoding by a lazily determinised transducer, decoding by an incremental UTF-8 state machine.

Encoding. The merge rules become, for each token, the pair that its last merge joined. Two adjacent tokens are
*compatible* if no merge across their border would come before the merges that built either of them. A sequence is
what the merges give exactly if its adjacent tokens are compatible, so reading bytes from left to right, each prefix
has one last token: the one that ends there and is compatible with the last token of the prefix before it.

A state of the transducer holds, for each place where a token might still be open, the trie node reached from that
place and the token that ends at it. Each byte moves to the next state and names the token that ends there; from any
place the tokens before it follow by their lengths. Tokens on the way back from all open places are certain: what has
been read is emitted up to there, so only open bytes are looked ahead. States and transitions are made when first met
and kept in a bounded table; when it is full it is emptied, which costs time only.

Decoding. An automaton over bytes (eight states: between characters, and what may follow in each kind of unfinished
one) gives the bytes of finished characters and keeps the pending ones. Tokens that begin and end between characters
pass it as a whole; others are fed byte by byte. What it gives is what is hashed and counted.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame

from weftline.llm.common import map_batches

_MAX_STATES = 300_000
_MAX_PIECES = 800_000
_MAX_PAIRS = 500_000
#: Bytes between two looks for certain tokens.
_LOOK = 4_096


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ranks from a rank file (base64 and a number on each line)."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class Merges:
    """What the ranks say about pairs: how a token was joined, and whether two tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.spines: dict[tuple[int, bool], tuple] = {}
        self.known: dict[int, bool] = {}

    def parts(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge gives ``token``."""
        if len(token) < 2:
            return None
        own, pieces = self.ranks[token], [token[i : i + 1] for i in range(len(token))]
        while len(pieces) > 2:
            best, at = own, -1
            for i in range(len(pieces) - 1):
                rank = self.ranks.get(pieces[i] + pieces[i + 1], own)
                if rank < best:
                    best, at = rank, i
            if at < 0:
                raise ValueError(f"token {token!r} is not reached by merges")
            pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
        return pieces[0], pieces[1]

    def spine(self, rank: int, right: bool) -> tuple:
        """The tokens along one side of how a token was joined, each with the rank of the merge that ended it."""
        key = (rank, right)
        if key not in self.spines:
            found, end, at = [], float("inf"), self.tokens[rank]
            while True:
                found.append((at, end))
                pair = self.parts(at)
                if pair is None:
                    break
                end, at = self.ranks[at], pair[1 if right else 0]
            self.spines[key] = tuple(found)
        return self.spines[key]

    def compatible(self, left: int, right: int) -> bool:
        key = left << 20 | right
        answer = self.known.get(key)
        if answer is None:
            if len(self.known) > _MAX_PAIRS:
                self.known.clear()
            self.known[key] = answer = self.border(left, right)
        return answer

    def border(self, left: int, right: int) -> bool:
        get = self.ranks.get
        for x, x_end in self.spine(left, True):
            for y, y_end in self.spine(right, False):
                rank = get(x + y)
                # of equal ranks the merge further left comes first
                if rank is not None and rank < x_end and rank <= y_end:
                    return False
        return True


class Transducer:
    """Encodes byte strings to ranks, byte by byte."""

    def __init__(self, ranks: dict[bytes, int]):
        self.merges = Merges(ranks)
        self.children: dict[int, int] = {}
        self.token_at, self.depth = [-1], [0]
        self.sizes = [0] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            node, self.sizes[rank] = 0, len(token)
            for depth, byte in enumerate(token):
                key = node << 8 | byte
                node = self.children.get(key, 0)
                if not node:
                    node = self.children[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.depth.append(depth + 1)
            self.token_at[node] = rank
        self.reset()

    def reset(self) -> None:
        #: state: (trie node of an open place, token that ends there or -1), ..., oldest place first
        self.states = [((0, -1),)]
        self.names = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}

    def name(self, state: tuple) -> int:
        found = self.names.setdefault(state, len(self.states))
        if found == len(self.states):
            self.states.append(state)
        return found

    def move(self, state: int, byte: int) -> tuple[int, int]:
        """The next state, and the token that ends with this byte."""
        child, token_at, compatible = self.children.get, self.token_at, self.merges.compatible
        grown, ended = [], -1
        for node, last in self.states[state]:
            node = child(node << 8 | byte)
            if node is not None:
                grown.append((node, last))
                if ended < 0 and (token := token_at[node]) >= 0 and (last < 0 or compatible(last, token)):
                    ended = token
        if ended < 0:
            raise ValueError(f"byte {byte} has no token")
        grown.append((0, ended))
        found = self.moves[state << 8 | byte] = self.name(tuple(grown)), ended
        return found

    def back(self, ended: list[int], end: int) -> list[int]:
        """The tokens up to ``end``, from the token that ends at each place."""
        out = []
        while end:
            token = ended[end - 1]
            out.append(token)
            end -= self.sizes[token]
        out.reverse()
        return out

    def certain(self, state: int, ended: list[int]) -> int:
        """The last place that lies on the ways back from all open places."""
        ways = []
        for node, _ in self.states[state]:
            end = len(ended) - self.depth[node]
            way = {end}
            while end:
                end -= self.sizes[ended[end - 1]]
                way.add(end)
            ways.append(way)
        return max(set.intersection(*ways))

    def stream(self, data: bytes, step: int = _LOOK):
        """Lists of tokens as they become certain, looked for every ``step`` bytes."""
        if len(self.states) > _MAX_STATES:
            self.reset()
        state, ended = 0, []
        for start in range(0, len(data), step):
            if len(self.states) > 2 * _MAX_STATES:  # within one very long piece: go on from the state reached
                here = self.states[state]
                self.reset()
                state = self.name(here)
            get, add = self.moves.get, ended.append
            for byte in data[start : start + step]:
                found = get(state << 8 | byte)
                if found is None:
                    found = self.move(state, byte)
                state = found[0]
                add(found[1])
            if start + step < len(data) and (cut := self.certain(state, ended)):
                yield self.back(ended, cut)
                del ended[:cut]
        yield self.back(ended, len(ended))

    def encode(self, data: bytes) -> list[int]:
        return list(chain.from_iterable(self.stream(data)))


class Encoder:
    """Splits text by a pattern and encodes each match separately; results of pieces are kept in a bounded table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.transducer = Transducer(ranks)
        self.pieces: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> list[int]:
        found, pieces = self.pattern.findall(text), self.pieces
        if len(pieces) > _MAX_PIECES:
            pieces.clear()
        for piece in set(found).difference(pieces):
            pieces[piece] = tuple(self.transducer.encode(piece.encode("utf-8", "surrogatepass")))
        return list(chain.from_iterable(map(pieces.__getitem__, found)))


def _automaton() -> list[list[int]]:
    """For each state and byte the next state, or -1. 0: between characters. 1, 2, 3: so many bytes of any kind follow.
    4 to 7: what follows E0, ED, F0 and F4, whose next byte has a narrower range."""
    after = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}
    table = [[-1] * 256 for _ in range(8)]
    for state, (low, high, then) in after.items():
        table[state][low : high + 1] = [then] * (high + 1 - low)
    for low, high, then in ((0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)):
        table[0][low : high + 1] = [then] * (high + 1 - low)
    return table


class Utf8Machine:
    """An incremental decoder: ``feed`` gives the bytes of all finished characters, ``finish`` what is left.

    What is no UTF-8 is given as ``broken`` (U+FFFD) for each longest beginning of a character, or as it is if that is
    None. ``chars`` counts characters, and one for each such beginning.
    """

    TABLE = _automaton()

    def __init__(self, broken: bytes | None = "\ufffd".encode()):
        self.broken, self.state, self.pending, self.chars = broken, 0, bytearray(), 0

    def give_up(self, out: bytearray) -> None:
        out += self.pending if self.broken is None else self.broken
        self.pending.clear()
        self.state, self.chars = 0, self.chars + 1

    def feed(self, chunk: bytes) -> bytes:
        out, table = bytearray(), self.TABLE
        for byte in chunk:
            state = table[self.state][byte]
            if state < 0 and self.pending:
                self.give_up(out)
                state = table[0][byte]
            self.pending.append(byte)
            if state < 0:
                self.give_up(out)
                continue
            self.state = state
            if not state:
                out += self.pending
                self.pending.clear()
                self.chars += 1
        return bytes(out)

    def finish(self) -> bytes:
        out = bytearray()
        if self.pending:
            self.give_up(out)
        return bytes(out)


class Decoder:
    """Ids to bytes, in chunks of ids, through the state machine."""

    def __init__(self, ranks: dict[bytes, int], chunk: int = 65_536):
        self.chunk = chunk
        size = max(ranks.values()) + 1
        self.tokens = [b""] * size
        #: tokens that lead the machine from between characters to between characters, and how many characters they have
        self.whole, self.chars = np.zeros(size, dtype=bool), np.zeros(size, dtype=np.int64)
        for token, rank in ranks.items():
            machine = Utf8Machine(b"")
            self.tokens[rank] = token
            self.whole[rank] = machine.feed(token) == token
            self.chars[rank] = machine.chars

    def stream(self, ids: list[int], machine: Utf8Machine):
        """The machine's output, chunk by chunk."""
        get = self.tokens.__getitem__
        for start in range(0, len(ids), self.chunk):
            part = ids[start : start + self.chunk]
            numbers = np.array(part, dtype=np.int64)
            before = np.concatenate([[0], np.cumsum(self.chars[numbers])])
            out, at = [], 0
            for i in [*([0] if machine.state else []), *np.flatnonzero(~self.whole[numbers]).tolist()]:
                if i < at:
                    continue
                out += map(get, part[at:i])
                machine.chars += int(before[i] - before[at])
                at = i
                while at < len(part) and (at == i or machine.state):
                    out.append(machine.feed(get(part[at])))
                    at += 1
            out += map(get, part[at:])
            machine.chars += int(before[-1] - before[at])
            yield b"".join(out)
        yield machine.finish()


#: A worker process keeps its coders from task to task: what they have learned serves the next one.
_CODERS: dict[tuple[str, str], tuple[Encoder, Decoder]] = {}


def coders(path: str, pattern: str) -> tuple[Encoder, Decoder]:
    if (path, pattern) not in _CODERS:
        ranks = read_ranks(path)
        _CODERS[path, pattern] = Encoder(ranks, pattern), Decoder(ranks)
    return _CODERS[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and n_chars_decoded for every row of ``docs`` (doc_id, text).

    A null text is empty: no ids, and the digests of the empty string. Rows are independent of each other, so repeated
    rows give repeated results; no shuffle, and a lost executor costs its tasks only. Special tokens' strings are
    ordinary text.
    """

    def make():
        encoder, decoder = coders(path, pattern)
        names = [str(i) for i in range(len(decoder.tokens))]

        def step(columns):
            if columns is None:
                return
            out = {"doc_id": columns["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "n_chars_decoded": []}
            for text in columns["text"]:
                ids = encoder(text or "")
                data, machine = hashlib.sha256(), Utf8Machine(broken=None)
                for part in decoder.stream(ids, machine):
                    data.update(part)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                out["decoded_sha256"].append(data.hexdigest())
                out["n_chars_decoded"].append(machine.chars)
            yield out

        return step

    return map_batches(docs.select("doc_id", "text"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chars_decoded long", make)
