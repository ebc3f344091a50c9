"""Byte-pair encoding by per-prefix dynamic programming, and decoding.

Texts are cut into pre-tokens over whole slices of code points at once. For every prefix of a pre-token exactly one token
can be the last one of its encoding: of the vocabulary's tokens that are suffixes of the prefix (found by an automaton
over all tokens), the one that is compatible with the last token of the prefix before it. Back-pointers then give the ids.
Two tokens are compatible if undoing their merges never shows a merge across the seam that would have come first.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm import store, textcore

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SLICE = 1 << 19
#: A worker forgets its encoded pre-tokens when it has this many of them (or eight times as many ids).
MAX_CACHED = 600_000
#: Pre-tokens of more bytes go prefix by prefix on their own.
SHORT = 48
_MEMO = 18
_SEPARATOR = "Ā"
_CUT = re.compile(r"(?<=[^\s])[ \n]")
_LETTER, _NUMBER, _SPACE, _OTHER, _END = 1, 2, 3, 0, 4


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Tokens by id: lines of a base64 token and its rank, which is its id."""
    pairs = [line.split() for line in open(path, "rb") if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def _merged(token: bytes, ranks: dict[bytes, int], below: int) -> list[int]:
    """What plain merging makes of ``token`` with merges of rank under ``below`` only."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 1:
        best, at = below, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1], below)
            if r < best:
                best, at = r, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


@lru_cache(2)
def split_table(path: str = VOCABULARY) -> tuple[list[bytes], list[int], list[int]]:
    """Tokens, and the two tokens that each was merged from; -1 for tokens that merging never makes, itself for bytes."""
    tokens = read_vocabulary(path)
    ranks = {t: i for i, t in enumerate(tokens)}
    left, right = [-1] * len(tokens), [-1] * len(tokens)
    for i, t in enumerate(tokens):
        if len(t) == 1:
            left[i] = right[i] = i
        elif len(parts := _merged(t, ranks, i)) == 2:
            left[i], right[i] = parts
    return tokens, left, right


class Codec:
    """Encodes and decodes texts; one for each worker process."""

    def __init__(self, tokens: list[bytes], left: list[int], right: list[int]):
        import ahocorasick

        self.tokens, self.left, self.right = tokens, left, right
        self.merge = {(left[i], right[i]): i for i, t in enumerate(tokens) if len(t) > 1 and left[i] >= 0}
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.size_list = self.sizes.tolist()
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            if left[i] >= 0:
                self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.memo_key, self.memo_ok = np.full(1 << _MEMO, -1, np.int64), np.zeros(1 << _MEMO, bool)
        self.forget()

    def forget(self) -> None:
        self.slot: dict[int, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.at, self.count, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def compatible(self, a: int, b: int) -> bool:
        """Whether plain merging leaves the seam between ``a`` and ``b`` as it is."""
        if len(self.pairs) > 2_000_000:
            self.pairs.clear()
        left, right, merge = self.left, self.right, self.merge
        key, limit = a << 32 | b, 1 << 62
        while True:
            over = merge.get((a, b))
            if over is not None and over < limit:
                self.pairs[key] = False
                return False
            whole_a, whole_b = right[a] == a, left[b] == b
            if whole_a and whole_b:
                self.pairs[key] = True
                return True
            # undo the later merge of the two; on the right, one of the same rank would still come after
            if not whole_a and (a > b or whole_b):
                limit, a = a, right[a]
            else:
                limit, b = b + 1, left[b]

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token."""
        out = []
        pairs, sizes, compatible = self.pairs, self.size_list, self.compatible
        joined = _SEPARATOR.join(p.decode("latin-1") for p in pieces)
        found = self.automaton.iter(joined)
        end, token = next(found, (len(joined), -1))
        base = 0
        for p in pieces:
            n = len(p)
            last = [-1] * n
            stop = base + n
            done = -1
            while end < stop:
                at = end - base
                if at != done:
                    start = at - sizes[token]
                    if start < 0:
                        last[at], done = token, at
                    else:
                        before = last[start]
                        ok = pairs.get(before << 32 | token)
                        if ok is None:
                            ok = compatible(before, token)
                        if ok:
                            last[at], done = token, at
                end, token = next(found, (len(joined), -1))
            ids, i = [], n - 1
            while i >= 0:
                ids.append(last[i])
                i -= sizes[last[i]]
            ids.reverse()
            out.append(ids)
            base = stop + 1
        return out

    def compatible_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``compatible`` for many pairs; a direct-mapped table remembers earlier answers."""
        key = a << 32 | b
        place = (textcore.mix(key.view(np.uint64)) >> np.uint64(64 - _MEMO)).astype(np.int64)
        ok = self.memo_ok[place]
        miss = np.flatnonzero(self.memo_key[place] != key)
        if len(miss):
            pairs, compatible = self.pairs, self.compatible
            found = [pairs[k] if k in pairs else compatible(x, y) for k, x, y in zip(key[miss].tolist(), a[miss].tolist(), b[miss].tolist())]
            ok[miss] = found
            self.memo_key[place[miss]], self.memo_ok[place[miss]] = key[miss], ok[miss]
        return ok

    def encode_short(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode_pieces``, for all pre-tokens at once: prefix by prefix, and of each its matches by length."""
        joined = _SEPARATOR.join(p.decode("latin-1") for p in pieces)
        size = np.array([len(p) for p in pieces], np.int64)
        base = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        match = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), np.int64).reshape(-1, 2)
        end, token = match[:, 0], match[:, 1]
        begin = base[np.searchsorted(base, end, "right") - 1]
        # which of the matches that end here this is, longest first
        new = np.concatenate([[True], end[1:] != end[:-1]])
        first = np.flatnonzero(new)
        turn = np.arange(len(end)) - np.repeat(first, np.diff(np.concatenate([first, [len(end)]])))
        before = end - self.sizes[token]
        last = np.full(len(joined) + 1, -1, np.int64)
        at_start = before < begin
        whole = np.flatnonzero(at_start)
        order = np.lexsort((turn, end - begin))
        step = (end - begin)[order] << 16 | turn[order]
        edge = np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1], [True]]))
        last[end[whole]] = token[whole]  # a token that is the whole prefix is its encoding
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
            m = order[lo:hi]
            m = m[last[end[m]] < 0]
            if len(m):
                m = m[self.compatible_all(last[before[m]], token[m])]
                last[end[m]] = token[m]
        # back-pointers from the ends of all pre-tokens at once
        at, who, tokens, owner = base + size - 1, np.arange(len(pieces)), [], []
        while len(at):
            t = last[at]
            tokens.append(t)
            owner.append(who)
            at = at - self.sizes[t]
            go = at >= base[who]
            at, who = at[go], who[go]
        tokens, owner = np.concatenate(tokens)[::-1], np.concatenate(owner)[::-1]
        return tokens[np.argsort(owner, kind="stable")].astype(np.int32), np.bincount(owner, minlength=len(pieces))

    def _slots(self, keys: np.ndarray, first: np.ndarray, end: np.ndarray, text: str) -> np.ndarray:
        """Where in the cache the pre-tokens text[first:end] are; new ones are encoded."""
        slot = self.slot
        got = [slot.get(k, -1) for k in keys.tolist()]
        new = [i for i, s in enumerate(got) if s < 0]
        if new:
            raw = [text[first[i] : end[i]].encode() for i in new]
            short = [j for j, r in enumerate(raw) if len(r) <= SHORT]
            long = [j for j, r in enumerate(raw) if len(r) > SHORT]
            ids, counts = self.encode_short([raw[j] for j in short]) if short else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            for x in self.encode_pieces([raw[j] for j in long]):
                ids, counts = np.concatenate([ids, np.array(x, np.int32)]), np.append(counts, len(x))
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.int32)])
            while self.n + len(new) > len(self.at):
                self.at, self.count = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self.at, self.count))
            self.flat[self.used : self.used + len(ids)] = ids
            self.at[self.n : self.n + len(new)] = self.used + np.cumsum(counts) - counts
            self.count[self.n : self.n + len(new)] = counts
            for slot_at, j in enumerate(short + long, self.n):
                got[new[j]] = slot_at
                slot[int(keys[new[j]])] = slot_at
            self.used += len(ids)
            self.n += len(new)
        return np.array(got, np.int64)

    def encode_slice(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts together, and how many each has."""
        if self.n > MAX_CACHED or self.used > 8 * MAX_CACHED:
            self.forget()
        joined, start, end, doc, keys = pretokens(texts)
        uniq, first, back = np.unique(keys, return_index=True, return_inverse=True)
        slots = self._slots(uniq, start[first], end[first], joined)[back]
        n = self.count[slots]
        ids = self.flat[ragged(self.at[slots], n)]
        return ids, np.bincount(doc, weights=n, minlength=len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of ids."""
        return self.bytes[ragged(self.starts[ids], self.sizes[ids])].tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text of any length."""
        return np.concatenate([self.encode_slice([p])[0] for p in pieces(text)])

    def encode_plain(self, text: str) -> np.ndarray:
        """As ``encode``, with every pre-token looked at by itself: hashes that collide can't matter."""
        joined, start, end, _, _ = pretokens([text])
        ids = self.encode_pieces([joined[a:b].encode() for a, b in zip(start.tolist(), end.tolist())])
        return np.array([i for x in ids for i in x], np.int32)

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, how many by text, and whether decoding them gave the text again."""
        ids, counts, same = [], [], []
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= SLICE):
                size += len(texts[hi]) + 1
                hi += 1
            part = texts[lo:hi]
            if size > SLICE + 1 and len(part) == 1:
                i = self.encode(part[0])
                n = np.array([len(i)])
            else:
                i, n = self.encode_slice(part)
            ok = np.ones(len(part), bool)
            if self.decode(i) != "".join(part).encode():
                own = np.split(i, np.cumsum(n)[:-1])
                own = [x if self.decode(x) == t.encode() else self.encode_plain(t) for x, t in zip(own, part)]
                i, n = np.concatenate(own), np.array([len(x) for x in own])
                ok = np.array([self.decode(x) == t.encode() for x, t in zip(own, part)])
            ids.append(i)
            counts.append(n)
            same.append(ok)
            lo = hi
        if not ids:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)
        return np.concatenate(ids), np.concatenate(counts), np.concatenate(same)


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), then the same for the next."""
    total = int(count.sum())
    step = np.repeat(start - (np.cumsum(count) - count), count)
    return step + np.arange(total)


def pieces(text: str, most: int = SLICE) -> list[str]:
    """Parts of a long text, cut where white space follows something else: a pre-token always ends there."""
    out, at = [], 0
    while len(text) - at > most:
        m = _CUT.search(text, at + most)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


@lru_cache(1)
def classes() -> np.ndarray:
    import unicodedata

    table = np.zeros(0x110000, np.int8)
    for i in range(0x110000):
        k = unicodedata.category(chr(i))[0]
        if k == "L":
            table[i] = _LETTER
        elif k == "N":
            table[i] = _NUMBER
    table[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
    return table


def pretokens(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined, and for each pre-token where it starts and ends there, its text's number and its hash.

    Runs of letters, of numbers and of other signs, each with one space before it; 's 't 'm 'd 're 've 'll; and white
    space, of which the last sign stands alone if something else follows.
    """
    joined = "\n".join(texts) + "\n"
    codes = textcore.codes_of(joined)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    kind = classes()[codes]
    kind[ends] = _END
    starts = np.ones(len(codes) + 1, bool)
    starts[1:-1] = kind[1:] != kind[:-1]
    starts[ends] = True
    starts[ends + 1] = True
    # white space before something else
    edge = np.flatnonzero(starts)
    run, stop = edge[:-1], edge[1:]
    space = (kind[run] == _SPACE) & (stop < len(codes))
    space[space] = kind[stop[space]] != _END
    stop = stop[space]
    starts[stop - 1] = True
    starts[stop[codes[stop - 1] == 32]] = False
    # contractions: an apostrophe by itself, with nothing taken before it
    mark = np.flatnonzero((codes[:-1] == 39) & starts[:-2] & starts[1:-1] & (kind[1:] == _LETTER))
    if len(mark):
        c1 = codes[mark + 1]
        c2 = codes[np.minimum(mark + 2, len(codes) - 1)]
        one = np.isin(c1, [115, 116, 109, 100])
        two = ((c1 == 114) | (c1 == 118)) & (c2 == 101) | (c1 == 108) & (c2 == 108)
        short, long = mark[one], mark[two]
        starts[short + 1] = starts[long + 1] = False
        starts[short + 2] = starts[long + 3] = True
    edge = np.flatnonzero(starts)
    start, end = edge[:-1], edge[1:]
    real = kind[start] != _END
    start, end = start[real], end[real]
    power, inverse = textcore.powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[: len(codes)], out=total[1:])
    keys = textcore.mix((total[end] - total[start]) * inverse[start])
    return joined, start, end, np.searchsorted(ends, start), keys


_codecs: dict[int, Codec] = {}


def codec_of(table) -> Codec:
    """The worker's codec for a broadcast split table."""
    if table.id not in _codecs:
        _codecs.clear()
        _codecs[table.id] = Codec(*table.value)
    return _codecs[table.id]


class _Table:
    """A broadcast table that also knows its number."""

    def __init__(self, broadcast, number: int):
        self.broadcast, self.id = broadcast, number

    @property
    def value(self):
        return self.broadcast.value


def _table(df: DataFrame, path: str) -> _Table:
    b = df.sparkSession.sparkContext.broadcast(split_table(path))
    return _Table(b, b._jbroadcast.id())


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip): the ids of every row's whole text.

    ``round_trip`` tells whether decoding the ids gave the text again. A null text has null ids, count and round trip;
    an empty one has no ids. Every row gives one row, also where ids repeat or are null; extra columns are left out; an empty
    table gives an empty result.
    What is broadcast is the vocabulary, whose size doesn't depend on the data.
    """
    table = _table(docs, vocabulary)

    def run(batches):
        codec = codec_of(table)
        for b in batches:
            text = b.column("text")
            ids, counts, same = codec.batch([t or "" for t in text.to_pylist()])
            null = text.is_null().to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids), mask=pa.array(null)) if null.any() else pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists, pa.array(counts.astype(np.int32), mask=null), pa.array(same, mask=null)], ["doc_id", "ids", "n_tokens", "round_trip"])

    return store.id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, n_tokens int, round_trip boolean")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of rows with ids. Null ids give a null text; null or unknown ids inside a list are an error."""
    table = _table(encoded, vocabulary)

    def run(batches):
        codec = codec_of(table)
        for b in batches:
            texts = [None if x is None else codec.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col].cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
