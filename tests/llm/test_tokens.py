"""Encoding, counting and packing against the libraries themselves."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

P = pytest.importorskip("public_tokenizers")

from weftline.llm import byte_bpe, packing, token_counts  # noqa: E402

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.Encoder(byte_bpe.read_ranks(RANKS), P.PATTERN)


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=200), st.text(alphabet="ab \n'st1é", max_size=400)))
def test_transducer(encoder, reference, text):
    text = text.encode("utf-8", "ignore").decode()
    assert encoder(text) == reference.encode_ordinary(text)


def test_transducer_forgets(reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "_MAX_STATES", 50)
    monkeypatch.setattr(byte_bpe, "_MAX_PIECES", 5)
    small = byte_bpe.Encoder(byte_bpe.read_ranks(RANKS), P.PATTERN)
    for text in ("a" * 4000, "unbelievably long-winded sentences everywhere " * 20, "é" * 500, " " * 3000 + "x"):
        assert small(text) == reference.encode_ordinary(text)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60), st.integers(1, 9))
def test_certain_tokens(encoder, text, step):
    """Tokens emitted as soon as they are certain are those of the whole piece."""
    data, transducer = text.encode("utf-8", "ignore") * 3, encoder.transducer
    parts = list(transducer.stream(data, step))
    assert [t for part in parts for t in part] == transducer.encode(data)
    assert b"".join(transducer.merges.tokens[t] for part in parts for t in part) == data


def test_looks_ahead_little(encoder):
    """What is emitted lies only some tokens behind what has been read."""
    data, transducer, read, done = b"the quick brown fox jumps over the lazy dog " * 40, encoder.transducer, 0, 0
    for part in transducer.stream(data, 16):
        read += 16
        done += sum(transducer.sizes[t] for t in part)
        assert read - done <= 2 * max(transducer.sizes)
    assert done == len(data)


@given(st.binary(max_size=60), st.lists(st.integers(1, 7), max_size=20))
def test_utf8_machine(data, cuts):
    for broken in ("�".encode(), None):
        machine, out, at = byte_bpe.Utf8Machine(broken), b"", 0
        for n in [*cuts, 1000]:
            out += machine.feed(data[at : at + n])
            at += n
        whole = out + machine.finish()
        assert whole == (data if broken is None else data.decode("utf-8", "replace").encode())
        assert machine.chars == len(data.decode("utf-8", "replace"))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 255), st.integers(0, 50_000)), max_size=60), st.integers(1, 9))
def test_decoder(ids, chunk):
    """Any ids, in chunks of any size: characters that lie across tokens and chunks, and bytes that are no UTF-8."""
    ranks = byte_bpe.read_ranks(RANKS)
    tokens = {rank: token for token, rank in ranks.items()}
    ids = [i for i in ids if i in tokens]
    decoder = byte_bpe.Decoder({tokens[i]: i for i in {*ids, 0}}, chunk)
    machine, data = byte_bpe.Utf8Machine(), b"".join(tokens[i] for i in ids)
    assert b"".join(decoder.stream(ids, machine)) == data.decode("utf-8", "replace").encode()
    assert machine.chars == len(data.decode("utf-8", "replace"))


def test_encode_documents(docs, clashing, empty, rows, reference):
    want = Counter()
    for doc, text, *_ in rows:
        ids = reference.encode_ordinary(text or "")
        want[doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), len(text or "")] += 1
    for df in (docs, clashing):
        assert Counter(map(tuple, byte_bpe.encode_documents(df, RANKS, P.PATTERN).collect())) == want
    assert byte_bpe.encode_documents(empty, RANKS, P.PATTERN).collect() == []


@pytest.mark.parametrize("head", [250_000, 3])
def test_token_counts(docs, clashing, empty, rows, library, monkeypatch, head):
    monkeypatch.setattr(token_counts, "HEAD_TOKENS", head)  # with few frequent pre-tokens nearly all go through the join
    want = Counter((d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for d, t, *_ in rows)
    for df in (docs, clashing):
        assert Counter(map(tuple, token_counts.token_counts(df, JSON, P.PATTERN).collect())) == want
    assert token_counts.token_counts(empty, JSON, P.PATTERN).collect() == []


def test_packing(docs, clashing, empty, rows, library):
    want = Counter()
    for doc, text, *_ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        starts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024)]
        for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want[doc, i, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))] += 1
    for df in (docs, clashing):
        found = packing.pack_documents(df, JSON, P.PATTERN).collect()
        assert Counter(tuple(r)[:5] for r in found) == want
        by: dict = {}
        for r in found:
            by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in by.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 1024
        total = sum(r["length"] for r in found)
        assert len(by) <= -(-total // 1024) + 2
    assert packing.pack_documents(empty, JSON, P.PATTERN).collect() == []


def best(items: tuple, capacity: int) -> int:
    """The least number of bins, by search."""
    items = tuple(sorted(items, reverse=True))
    limit = len(items)

    def place(i, rooms):
        nonlocal limit
        if len(rooms) >= limit:
            return
        if i == len(items):
            limit = len(rooms)
            return
        for k in {r: j for j, r in enumerate(rooms) if r >= items[i]}.values():
            place(i + 1, [*rooms[:k], rooms[k] - items[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return limit


def test_reduction_is_safe():
    """Fixing what dominates never costs a bin: the fixed sets and the best packing of the rest are a best packing."""
    r = random.Random(5)
    for _ in range(120):
        capacity = r.choice([10, 13, 20])
        items = [r.randint(1, capacity) for _ in range(r.randint(1, 8))]
        left = packing.Lengths(dict(Counter(items)))
        fixed = 0
        for length in sorted(set(items), reverse=True):
            while length in left.counts and (found := packing.dominating(left, capacity, length)):
                for x in found:
                    left.take(x, 1)
                fixed += 1
        rest = [x for x, n in left.counts.items() for _ in range(n)]
        assert fixed + best(tuple(rest), capacity) == best(tuple(items), capacity)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_pack_holds_all(items):
    got = Counter()
    for pattern, n in packing.pack(dict(Counter(items)), 30):
        assert sum(pattern) <= 30 and n > 0
        for x in pattern:
            got[x] += n
    assert got == Counter(items)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=5))
def test_dominance_loses_no_sequence(counts):
    """With lengths that occur several times, no more sequences than the best packing needs, as far as the reduction goes."""
    from functools import lru_cache

    items = tuple(sorted((x for x, n in counts.items() for _ in range(n)), reverse=True))[:9]

    @lru_cache(None)
    def fewest(left):
        if not left:
            return 0
        first, rest, best = left[0], left[1:], len(left)
        for mask in range(1 << len(rest)):
            some = [x for i, x in enumerate(rest) if mask >> i & 1]
            if first + sum(some) <= 12:
                best = min(best, 1 + fewest(tuple(x for i, x in enumerate(rest) if not mask >> i & 1)))
        return best

    left = packing.Lengths(Counter(items))
    fixed = 0
    for length in reversed(list(left.order)):
        while length in left.counts and (found := packing.dominating(left, 12, length)):
            for x in found:
                left.take(x, 1)
            fixed += 1
    rest = tuple(sorted((x for x, n in left.counts.items() for _ in range(n)), reverse=True))
    assert fixed + fewest(rest) == fewest(items)
    patterns = packing.pack(dict(Counter(items)), 12)
    assert Counter(x for p, n in patterns for _ in range(n) for x in p) == Counter(items) and all(sum(p) <= 12 for p, _ in patterns)
    assert sum(n for _, n in patterns) <= fewest(items) + 1
