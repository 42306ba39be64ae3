"""Token ids as files of arithmetic-coded blocks.

Three predictions of the coming id are mixed: the id that last followed the last two ids (order 2), the one that last followed the last id
(order 1), each with a count of how well it has held, and the block's own distribution of ids (order 0). Their weights are learnt for every
pair of counts. An id is coded as the order-2 candidate, the order-1 candidate, an id of the distribution, or as new to it, and is then put
down as it is after the coded words. A range coder takes these choices, others the ids of the distribution: these need no context until the
distribution is made anew, so that two coders a block take them in turn, and they are read ahead of the choices. What a block learns takes effect
at its next place (every `STRIDE` ids, more often at first), so that between two places the encoder has all choices of all blocks as arrays, and
the decoder only reads tables. All starts anew in each block, and each has checksums of its bytes and ids, so that a block is read, or found
broken, alone. Many blocks are coded in step: a step is a few numpy operations for one id of each.

A file is a Parquet part of block records. A long document has several blocks; a block may have many documents.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import bounded, small_batches, stored

#: Ids in a block at least and at most, blocks coded in step, and ids between places.
SHORTEST, LONGEST, TOGETHER, STRIDE = 1 << 12, 1 << 14, 1024, 64
#: Bits of a candidate's weight and of the slots of an order-0 distribution.
_WEIGHT, _SLOTS = 12, 13
#: Streams of a block for the ids of its distributions, and blocks whose distributions are made at once.
_SIDES, _BESIDE = 2, 64
_TOP, _LOW, _NEW = 1 << 62, 1 << 30, 1 << 16
#: Slots of the tables of order 1 and 2, and what the distribution and a candidate weigh at least.
_ROWS, _LEAST_REST, _LEAST = (1 << 12, 1 << 13), 96, 8
#: Numbers that meet arrays at every id: numpy takes arrays without axes faster than Python's.
_BY_WEIGHT, _BY_SLOTS, _NARROW, _BY_FIVE, _COUNTS, *_IN_ROWS = (np.array(x, np.int64) for x in (_WEIGHT, _SLOTS, _LOW, 5, 15, *(r - 1 for r in _ROWS)))
#: By the counts of order 2 and 1: outcomes as if seen before for order 2, order 1 and neither.
_PRIOR = np.array([[1 + 3 * two, 1 + 2 * one, 8] for two in range(4) for one in range(4)], np.int64).T
BLOCKS = "part int, block long, doc_ids array<long>, pieces array<int>, lengths array<int>, n_ids int, ids_crc long, payload binary, payload_crc long"


class _Model:
    """Candidates and weights of some blocks side by side."""

    def __init__(self, n: int) -> None:
        self.tables = [np.zeros(n * rows, np.int32) for rows in _ROWS]
        self.base = [np.arange(n, dtype=np.int64) * rows for rows in _ROWS]
        self.lane = np.arange(n, dtype=np.int64) * 16
        self.seen = np.tile(_PRIOR, (1, n))
        self._weigh()

    def _weigh(self) -> None:
        """What both candidates and the rest weigh for each pair of counts, in 1 << _WEIGHT."""
        two, one, neither = self.seen
        total = two + one + neither
        self.two = np.minimum(np.maximum((two << _WEIGHT) // total, _LEAST), (1 << _WEIGHT) - _LEAST_REST - _LEAST)
        upto = np.minimum(self.two + np.maximum((one << _WEIGHT) // total, _LEAST), (1 << _WEIGHT) - _LEAST_REST)
        self.one, self.rest = upto - self.two, (1 << _WEIGHT) - upto

    def predict(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, ...]:
        """After the ids one and, before it, two: the entries of order 2 (candidate << 4 | count << 2) and 1 (candidate << 4 | count), their slots, and the
        row of weights."""
        k = one.shape[-1]
        at_one = (one & _IN_ROWS[0]) + self.base[0][:k]
        at_two = ((one ^ (two << _BY_FIVE)) & _IN_ROWS[1]) + self.base[1][:k]
        held_one, held_two = self.tables[0].take(at_one), self.tables[1].take(at_two)
        return held_two, held_one, at_two, at_one, ((held_one | held_two) & _COUNTS) + self.lane[:k]

    def learn(self, ids: np.ndarray, two: np.ndarray, one: np.ndarray, at_two: np.ndarray, at_one: np.ndarray, row: np.ndarray) -> None:
        """Takes in the ids, place by place in one array, for which predict() gave the rest."""
        ids = ids.astype(np.int32)
        by_two, by_one = (two >> 4) == ids, (one >> 4) == ids
        n = self.seen.shape[1]
        outcome = row + 2 * n
        outcome -= by_one * np.int64(n)
        np.copyto(outcome, row, where=by_two)
        self.seen += np.bincount(outcome, minlength=3 * n).reshape(3, n) * 4
        old = self.seen.sum(0) > 4000
        if old.any():
            self.seen[:, old] = (self.seen[:, old] + 1) >> 1
        self._weigh()
        fresh = ids << 4
        for table, at, held, good, unit in ((self.tables[0], at_one, one, by_one, 1), (self.tables[1], at_two, two, by_two, 4)):
            count = held & 3 * unit
            new = held - np.int32(unit)
            np.copyto(new, fresh, where=count == 0)
            np.copyto(new, held + (count < 3 * unit) * np.int32(unit), where=good)
            table[at] = new


class _Writer:
    """Range coders side by side, each with a stream of words of its own."""

    def __init__(self, n: int) -> None:
        self.low, self.width = np.zeros(n, np.int64), np.full(n, _TOP - 1, np.int64)
        self.gone: list[tuple[np.ndarray, np.ndarray]] = []  # streams and their words, carries on top

    def put(self, low: np.ndarray, width: np.ndarray, stream: np.ndarray | None = None) -> None:
        """32 bits of those that have become narrow go out; what is left is always enough."""
        small = (width < _NARROW).nonzero()[0]
        if len(small):
            top = low.take(small)
            self.gone.append((small if stream is None else stream.take(small), top >> 30))
            low[small] = (top & (_LOW - 1)) << 32
            width[small] = width.take(small) << 32

    def words(self) -> list[np.ndarray]:
        """Of each stream, which zeros follow."""
        n = len(self.low)
        self.put(self.low, self.width)
        rest = (self.low + _LOW - 1) >> 30
        end = rest.nonzero()[0]
        stream, words = (np.concatenate(x) for x in zip(*self.gone, (end, rest.take(end)), strict=True))
        words = words.take(np.argsort(stream.astype(np.min_scalar_type(n)), kind="stable"))
        while len(over := (words >> 32).nonzero()[0]):  # carries go to the word before
            words[over] &= 0xFFFFFFFF
            words[over - 1] += 1
        return np.split(words.astype("<u4"), np.cumsum(np.bincount(stream, minlength=n))[:-1])


class _Reader:
    """What _Writer has written."""

    def __init__(self, streams: list[np.ndarray]) -> None:
        words, self.at, self.last = _joined(streams)
        self.code, self.width = words[self.at] << 30 | words[self.at + 1] >> 2, np.full(len(streams), _TOP - 1, np.int64)
        words[:-1] = (words[:-1] & 3) << 30 | words[1:] >> 2  # as they follow on 62 bits
        self.words = words
        self.at += 1

    def get(self, code: np.ndarray, width: np.ndarray, stream: np.ndarray | None = None) -> None:
        small = (width < _NARROW).nonzero()[0]
        if len(small):
            own = small if stream is None else stream.take(small)
            place = self.at.take(own)
            code[small] = code.take(small) << 32 | self.words.take(place)
            width[small] = width.take(small) << 32
            self.at[own] = np.minimum(place + 1, self.last.take(own))


def _places(most: int) -> list[tuple[int, int, bool]]:
    """Begin and end of each stretch, and whether the distribution is made anew before it."""
    at = [x for x in [0, *(1 << i for i in range(4, STRIDE.bit_length() - 1)), *range(STRIDE, max(most, STRIDE + 1), STRIDE)] if x < most]
    made, out = 0, []
    for s, e in zip(at, [*at[1:], most], strict=True):
        anew = s == 0 or s >= made + max(32, made // 2)
        made = s if anew else made
        out.append((s, e, anew))
    return out


def _distributions(past: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From the ids so far, a row for each block: the symbols, their slots (1 << _SLOTS in all for each block), where these begin, and the bounds of each
    block's symbols. A block's last symbol, _NEW, is any other id: so are the seldom ones of more than half as many symbols as slots."""
    whole, (k, m) = 1 << _SLOTS, past.shape
    ids = np.sort(past.astype(np.int32), axis=1)  # much faster than of 16 bits
    edge = np.ones((k, m), bool)
    np.not_equal(ids[:, 1:], ids[:, :-1], out=edge[:, 1:])
    at = edge.ravel().nonzero()[0]
    symbols, count = ids.ravel().take(at).astype(np.int64), np.diff(at, append=k * m)
    n = np.count_nonzero(edge, axis=1)
    lane = np.repeat(np.arange(k), n)
    new = whole * (np.bincount(lane[count == 1], minlength=k) + 1) // (m + 2)  # an id is new as often as those seen once are
    if n.max(initial=0) > whole // 2:
        keep, ends = np.ones(len(at), bool), np.cumsum(n)
        for j in (n > whole // 2).nonzero()[0].tolist():
            own = slice(ends[j] - n[j], ends[j])
            keep[own][np.argsort(-count[own], kind="stable")[whole // 2 :]] = False
        symbols, count, lane = symbols[keep], count[keep], lane[keep]
        n = np.minimum(n, whole // 2)
    total = np.bincount(lane, count, k).astype(np.int64)
    room = whole - n - np.minimum(whole // 2, np.maximum(16, new))
    count *= room.take(lane)
    count //= total.take(lane)
    count += 1
    bounds = np.concatenate([[0], np.cumsum(n + 1)])
    some, size = np.full(bounds[-1], _NEW, np.int64), np.empty(bounds[-1], np.int64)
    to = np.arange(len(lane)) + lane
    some[to], size[to] = symbols, count
    size[bounds[1:] - 1] = whole - np.bincount(lane, count, k).astype(np.int64)
    return some, size, np.cumsum(size) - size & whole - 1, bounds


def _lanes(sizes: list[int]) -> tuple[list[int], np.ndarray, int, np.ndarray]:
    """Blocks by falling size, these sizes, the greatest, and how many blocks have an id at each place."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    size = np.array([sizes[i] for i in order], np.int64)
    most = int(size[0]) if len(size) else 0
    return order, size, most, np.searchsorted(-size, -np.arange(most), "left")


def _dealt(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """So many symbols of each block, one block after the other, are dealt to its _SIDES streams in turn: the streams by falling number, the place of each
    one's first, and how many streams have a further one each time."""
    side = np.arange(_SIDES)
    count, first = ((n[:, None] + (_SIDES - 1 - side)) // _SIDES).ravel(), ((np.cumsum(n) - n)[:, None] + side).ravel()
    order = np.argsort(-count, kind="stable")
    count = count.take(order)
    return order, first.take(order), np.searchsorted(-count, -np.arange(count[0]), "left").tolist()


def _head(size: int) -> str:
    """The kind of the numbers before a payload's words."""
    return "<u2" if size <= 1 << 16 else "<u4"


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """One payload for each block of ids below 2**16, none empty: the numbers of words of its streams, those of ids that are of the distribution, for
    each time it was made; the words of the choices and of the distribution's ids; the new ids."""
    order, size, most, active = _lanes([len(b) for b in blocks])
    n = len(blocks)
    own = np.zeros((n, most), np.uint16)
    for j, i in enumerate(order):
        own[j, : size[j]] = blocks[i]
    ids = np.zeros((most + 2, n), np.uint16)  # two zeros come before
    ids[2:] = own.T
    model, choices, slots = _Model(n), _Writer(n), _Writer(n * _SIDES)
    table, plain, numbers = np.full(1 << 16, -1, np.int32), [], []
    places = _places(most)
    for i, (begin, end, anew) in enumerate(places):
        some = int(active[begin])
        if anew:
            made, until = begin, next((p for p, _, again in places[i + 1 :] if again), most)
            rest = np.arange(until - begin) < size[:some, None] - begin  # whose ids are of the distribution, blocks by places
        now, one, two = (ids[begin + d : end + d, :some].astype(np.int64) for d in (2, 1, 0))
        told = model.predict(one, two)
        is_two = (told[0] >> 4) == now
        is_one = ((told[1] >> 4) == now) & ~is_two
        rest[:some, begin - made : end - made] &= ~(is_two | is_one).T
        start, part = np.zeros(now.shape, np.int64), model.rest.take(told[-1])
        by_two = model.two.take(told[-1])
        np.copyto(start, part, where=is_two)
        np.copyto(start, part + by_two, where=is_one)
        np.copyto(part, by_two, where=is_two)
        np.copyto(part, model.one.take(told[-1]), where=is_one)
        for t in range(begin, end):
            k = int(active[t])
            low, width = choices.low[:k], choices.width[:k]
            step = width >> _BY_WEIGHT
            low += step * start[t - begin, :k]
            np.multiply(step, part[t - begin, :k], out=width)
            if t & 1:  # two choices take 18 bits at most
                choices.put(low, width)
        if active[end - 1] == some:
            model.learn(now.ravel(), *(x.ravel() for x in told))
        else:
            real = np.arange(some) < active[begin:end, None]
            model.learn(now[real], *(x[real] for x in told))
        if end == until:
            numbers.append(_put_slots(slots, own[: len(rest)], made, rest, table, plain))
    lane, fresh = (np.concatenate([p[j] for p in plain] or [np.zeros(0, np.int64)]) for j in (0, 1))
    fresh = np.split(fresh[np.argsort(lane, kind="stable")], np.cumsum(np.bincount(lane, minlength=n))[:-1]) if n else []
    out: list[bytes] = [b""] * n
    chosen, dealt = (choices.words(), slots.words()) if n else ([], [])
    for j, i in enumerate(order):
        streams = [chosen[j], *dealt[j * _SIDES : (j + 1) * _SIDES]]
        head = np.array([*map(len, streams), *(x[j] for x in numbers if j < len(x))], _head(int(size[j])))
        out[i] = b"".join(x.tobytes() for x in (head, *streams, fresh[j].astype("<u2")))
    return out


def _put_slots(slots: _Writer, own: np.ndarray, made: int, rest: np.ndarray, table: np.ndarray, plain: list) -> np.ndarray:
    """Codes those of the ids from `made` on that are of the distribution made there, and puts down the new ones with their blocks. Gives how many they are of each block."""
    values, new = [], []
    for s in range(0, len(own), _BESIDE):
        symbols, size, first, bounds = _distributions(own[s : s + _BESIDE, :made])
        both = (first << 14 | size).astype(np.int32)
        for j, (b, e) in enumerate(zip(bounds.tolist(), bounds[1:].tolist(), strict=False), s):
            known = symbols[b : e - 1]
            table[known] = both[b : e - 1]
            ids = own[j, made : made + rest.shape[1]][rest[j]]
            got = table.take(ids)
            table[known] = -1
            fresh = (got < 0).nonzero()[0]
            got[fresh] = both[e - 1]
            values.append(got)
            new.append(ids.take(fresh))
    n = np.array([len(v) for v in values], np.int64)
    value = np.concatenate(values).astype(np.int64)
    plain.append((np.repeat(np.arange(len(n)), [len(x) for x in new]), np.concatenate(new)))
    stream, first, with_more = _dealt(n)
    lows, widths = slots.low.take(stream), slots.width.take(stream)
    for t, k in enumerate(with_more):
        now, low, width = value.take(first[:k] + t * _SIDES), lows[:k], widths[:k]
        step = width >> _BY_SLOTS
        low += step * (now >> 14)
        np.multiply(step, now & 0x3FFF, out=width)
        slots.put(low, width, stream)
    slots.low[stream], slots.width[stream] = lows, widths
    return n


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arrays one after the other with room after each, and the first and last place of each."""
    begins = np.cumsum([0, *(len(p) + 4 for p in parts)])
    out = np.zeros(int(begins[-1]) + 4, np.int64)
    for p, s in zip(parts, begins, strict=False):
        out[s : s + len(p)] = p
    return out, begins[:-1].copy(), begins[1:] - 1


def decode_blocks(payloads: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    order, size, most, active = _lanes(sizes)
    n = len(payloads)
    places = _places(most)
    made = np.array([p for p, _, anew in places if anew], np.int64)
    numbers, chosen, dealt, new = np.zeros((len(made), n), np.int64), [], [], []
    for j, i in enumerate(order):
        times = int(np.searchsorted(made, size[j]))
        head = np.frombuffer(payloads[i], _head(int(size[j])), 1 + _SIDES + times)
        numbers[:times, j] = head[1 + _SIDES :]
        at, streams = head.nbytes, []
        for words in head[: 1 + _SIDES].tolist():
            streams.append(np.frombuffer(payloads[i], "<u4", words, at))
            at += 4 * words
        chosen.append(streams[0])
        dealt += streams[1:]
        new.append(np.frombuffer(payloads[i], "<u2", offset=at))
    model, choices, slots = _Model(n), _Reader(chosen), _Reader(dealt)
    plain, fresh_at, _ = _joined(new)
    past, numbered = np.zeros((n, most), np.uint16), np.empty(n << _SLOTS, np.uint16)
    ids = np.zeros((STRIDE + 2, n), np.int64)  # of the stretch and the two before
    times = iter(numbers)
    for begin, end, anew in places:
        some = int(active[begin])
        if anew:
            rest, at = _get_slots(slots, past[:some, :begin], next(times)[:some], numbered, plain, fresh_at)
        told = []
        for t in range(begin, end):
            k, i = int(active[t]), t - begin
            guess = model.predict(ids[i + 1, :k], ids[i, :k])
            two, one, _, _, row = guess
            told.append(guess)
            code, width, place = choices.code[:k], choices.width[:k], at[:k]
            step = width >> _BY_WEIGHT
            np.multiply(step, model.rest.take(row), out=width)
            now = rest.take(place)  # as if none were a candidate
            place += 1
            hit = (code >= width).nonzero()[0]
            if len(hit):
                step, row = step.take(hit), row.take(hit)
                over, upto = code.take(hit) - width.take(hit), step * model.two.take(row)
                is_two = over < upto
                now[hit] = np.where(is_two, two.take(hit), one.take(hit)) >> 4
                code[hit] = np.where(is_two, over, over - upto)
                width[hit] = np.where(is_two, upto, step * model.one.take(row))
                place[hit] -= 1
            if t & 1:
                choices.get(code, width)
            ids[i + 2, :k] = now
        got = ids[2 : end - begin + 2, :some]
        past[:some, begin:end] = got.T
        model.learn(got.ravel() if active[end - 1] == some else got[np.arange(some) < active[begin:end, None]], *(np.concatenate(x) for x in zip(*told, strict=True)))
        ids[:2] = ids[end - begin : end - begin + 2].copy()
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * n
    for j, i in enumerate(order):
        out[i] = past[j, : size[j]].astype(np.int64)
    return out


def _get_slots(slots: _Reader, past: np.ndarray, n: np.ndarray, numbered: np.ndarray, plain: np.ndarray, fresh_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The coming n ids of each block that are of the distribution after the ids so far, one block after the other, and where each block's begin. numbered: room for the number of each slot's symbol."""
    all_of, begins, upto = [], [], 0
    for s in range(0, len(past), _BESIDE):
        symbols, size, first, bounds = _distributions(past[s : s + _BESIDE])
        own = np.arange(len(size)) - np.repeat(bounds[:-1], np.diff(bounds))
        numbered[s << _SLOTS : s + len(bounds) - 1 << _SLOTS] = np.repeat(own.astype(np.uint16), size)
        all_of.append(symbols << 32 | first << 16 | size)
        begins.append(bounds[:-1] + upto)
        upto += len(size)
    symbols = np.concatenate(all_of)
    stream, first, with_more = _dealt(n)
    codes, widths, base = slots.code.take(stream), slots.width.take(stream), (stream // _SIDES) << _SLOTS
    own = np.concatenate(begins).take(stream // _SIDES)
    out = np.zeros(int(n.sum()) + 1, np.int64)
    for t, k in enumerate(with_more):
        code, width = codes[:k], widths[:k]
        step = width >> _BY_SLOTS
        at = (code.view(np.uint64) // step.view(np.uint64)).view(np.int64)  # quicker without signs
        at += base[:k]
        now = symbols.take(numbered.take(at) + own[:k])
        code -= step * ((now >> 16) & 0xFFFF)
        np.multiply(step, now & 0xFFFF, out=width)
        out[first[:k] + t * _SIDES] = now >> 32
        slots.get(code, width, stream)
    slots.code[stream], slots.width[stream] = codes, widths
    fresh = (out == _NEW).nonzero()[0]
    begins = np.cumsum(n) - n
    lane = np.searchsorted(begins + n, fresh, "right")
    many = np.bincount(lane, minlength=len(n))
    out[fresh] = plain.take(fresh_at.take(lane) + np.arange(len(fresh)) - (np.cumsum(many) - many).take(lane))
    fresh_at[: len(n)] += many
    return out, begins


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _shifts() -> list[list[int]]:
    """For each k the CRC-32 images of the 32 register bits under 2**k zero bytes."""
    one = [0xEDB88320, *(1 << i for i in range(31))]
    apply = lambda m, v: _apply(m, v)
    squares = [one]
    for _ in range(34):
        squares.append([apply(squares[-1], x) for x in squares[-1]])
    return squares[3:]


def _apply(matrix: list[int], v: int) -> int:
    out = i = 0
    while v:
        if v & 1:
            out ^= matrix[i]
        v >>= 1
        i += 1
    return out


_SHIFTS = _shifts()


def joined_crc(a: int, b: int, n: int) -> int:
    """CRC-32 of two byte strings in a row from that of each and the second's length."""
    k = 0
    while n:
        if n & 1:
            a = _apply(_SHIFTS[k], a)
        n >>= 1
        k += 1
    return a ^ b


class Tokenizer:
    """The library's ids. Texts of ASCII and Latin letters without an added token are cut as the byte-level pattern cuts them and each distinct
    cut is encoded once; all others are encoded whole. Cuts are known by their 64-bit hashes, in a table with open places; at most `cached` are kept,
    but those of one call."""

    def __init__(self, path: str, cached: int = 1_500_000) -> None:
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.cuts = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and not any("\n" in t for t in self.added)
        (self.line_break,) = self.library.encode("\n", add_special_tokens=False).ids
        #: Bytes of each id, a character of a byte-level token being one; whether words may follow one another without a break.
        self.lengths, self.joins = np.zeros(1 << 16, np.int64), not any(" " in t for t in self.added)
        for t, i in self.library.get_vocab(with_added_tokens=False).items():
            self.lengths[i & 0xFFFF] = len(t)
        self.cached = cached
        self._forget()

    def _forget(self) -> None:
        """span: where the ids of the cut whose hash is in that place of keys, 0 being free, are in store: first << 32 | how many."""
        self.known, self.bits, self.stored = 0, 16, 0
        self.keys, self.span = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int64)
        self.store = np.zeros(1 << 16, np.uint16)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, or the free place where it would be."""
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        held = self.keys.take(at)
        on = np.flatnonzero((held != keys) & (held != 0))
        while len(on):
            at[on] = (at[on] + 1) & (len(self.keys) - 1)
            held = self.keys.take(at[on])
            on = on[(held != keys[on]) & (held != 0)]
        return at

    def _put(self, keys: np.ndarray, span: np.ndarray) -> None:
        """New and distinct keys."""
        while len(keys):
            at = self._place(keys)
            self.keys[at] = keys  # of those that share a free place one gets it
            won = self.keys[at] == keys
            self.span[at[won]] = span[won]
            keys, span = keys[~won], span[~won]

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, np.int64)

    def _learn(self, keys: np.ndarray, cuts: list[bytes]) -> None:
        """Encodes new cuts: those that begin with a space as one text, which is cut there again, and parted by how many bytes each id has; others, if not
        white space, as the lines of one text, whose breaks are cuts, and so ids, of their own."""
        size = np.array([len(c) for c in cuts], np.int64)
        kind = np.array([2 if c.isspace() else int(c[0] != 32 or not self.joins) for c in cuts], np.int8)
        order = np.argsort(kind, kind="stable")
        n, m, _ = np.bincount(kind, minlength=3).tolist()
        keys, size, cuts = keys[order], size[order], [cuts[i] for i in order.tolist()]
        ids, sizes = [], []
        if n:
            ids.append(self._whole(b"".join(cuts[:n])))
            upto, ends = np.cumsum(self.lengths[ids[0]]), np.cumsum(size[:n])
            last = np.searchsorted(upto, ends)
            if not np.array_equal(upto[np.minimum(last, len(upto) - 1)], ends):
                raise ValueError("the library cuts words together")
            sizes.append(np.diff(last, prepend=-1))
        if m:
            lines = self._whole(b"\n".join(cuts[n : n + m]))
            breaks = np.flatnonzero(lines == self.line_break)
            ids.append(np.delete(lines, breaks))
            sizes.append(np.diff(np.concatenate([[-1], breaks, [len(lines)]])) - 1)
        alone = [self._whole(c) for c in cuts[n + m :]]
        ids, size = np.concatenate([*ids, *alone]), np.concatenate([*sizes, np.array([len(x) for x in alone], np.int64)])
        span = self.stored + np.cumsum(size) - size << 32 | size
        self.known += len(keys)
        self.store = _roomy(self.store, self.stored + len(ids))
        self.store[self.stored : self.stored + len(ids)] = ids
        self.stored += len(ids)
        if 2 * self.known > len(self.keys):
            old = self.keys != 0
            held, spans = self.keys[old], self.span[old]
            self.bits = max(self.bits + 1, (2 * self.known).bit_length())
            self.keys, self.span = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int64)
            self._put(held, spans)
        self._put(keys, span)

    def encode(self, texts: list[str | None], end: int = 0) -> list[np.ndarray]:
        """The ids of each text with the end id."""
        ids, n = self.flat(texts, end)
        return np.split(ids, np.cumsum(n)[:-1]) if len(n) else []

    def flat(self, texts: list[str | None], end: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, one after the other, and their numbers."""
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        whole = np.array([not self.cuts or any(a in (t or "") for a in self.added) for t in texts], bool) | ~latin(raw)
        buf, start, stop, last = cut([b"" if w else r for r, w in zip(raw, whole, strict=True)])
        keys = textvec.span_hash(textvec.prefix_sums(buf), start, stop) | np.uint64(1)
        place = self._place(keys)
        new = np.flatnonzero(self.keys.take(place) == 0)
        if len(new):
            fresh, one = np.unique(keys[new], return_index=True)
            if self.known + len(fresh) > self.cached:
                self._forget()
                new = np.arange(len(keys))
                fresh, one = np.unique(keys, return_index=True)
            said, bits = buf.tobytes(), self.bits
            self._learn(fresh, [said[s:e] for s, e in zip(start[new[one]].tolist(), stop[new[one]].tolist(), strict=True)])
            if self.bits == bits and len(new) < len(keys):
                place[new] = self._place(keys[new])
            else:
                place = self._place(keys)
        span = self.span.take(place)
        size = span & 0xFFFFFFFF
        upto = np.concatenate([[0], np.cumsum(size)])
        n = np.diff(upto[last], prepend=0)
        ids = self.store.take(np.repeat((span >> 32) - upto[:-1], size) + np.arange(upto[-1]))
        others = iter(self.library.encode_batch([t or "" for t, w in zip(texts, whole, strict=True) if w], add_special_tokens=False))
        if whole.any():
            parts = np.split(ids, np.cumsum(n)[:-1])
            parts = [np.array(next(others).ids, np.uint16) if w else p for p, w in zip(parts, whole, strict=True)]
            ids, n = np.concatenate([*parts, np.zeros(0, np.uint16)]), np.array([len(p) for p in parts], np.int64)
        return np.insert(ids, np.cumsum(n), end), n + 1


def _roomy(a: np.ndarray, n: int) -> np.ndarray:
    """a, or a longer array that begins with it and has room for n."""
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


def latin(raw: list[bytes]) -> np.ndarray:
    """Whether each text has only ASCII that is printed or space, and the letters from U+00C0 to U+017F."""
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    odd = np.flatnonzero(_ODD[buf])
    now, before = buf[odd], buf[odd - 1]
    bad = (now < 0x80) | (now >= 0xC0) & ((now < 0xC3) | (now > 0xC5))
    later = (now >= 0x80) & (now < 0xC0)
    bad |= later & ((before < 0xC3) | (before > 0xC5))  # a letter of another lead byte
    bad |= later & (before == 0xC3) & ((now == 0x97) | (now == 0xB7))  # the signs of multiplication and division
    out = np.ones(len(raw), bool)
    out[np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), odd[bad], "right")] = False
    return out


def cut(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cuts texts as the byte-level pattern does: 's 't 're 've 'm 'll 'd, runs of letters, digits or other signs with a space before them, white space
    but its last character before something else. Texts must be latin(). Gives all bytes, where cuts begin and end, and how many come up to each text's end."""
    buf = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
    kind = _KIND[buf]
    edge = np.ones(len(buf) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    after = np.append(kind[1:], 0)
    # the last white space before something else stands alone, and a space goes with what follows
    tail = (kind == _SPACE) & (after != _SPACE) & (after != 0)
    edge[:-1] |= tail
    spaced = np.flatnonzero(tail & (buf == 32))
    edge[spaced + 1] = False
    # contractions, where a cut begins with the apostrophe
    for p in np.flatnonzero((buf == 39) & edge[:-1] & (after == _LETTER)).tolist():
        long = buf[p + 1 : p + 3].tobytes()
        n = 1 if long[:1] in (b"s", b"t", b"m", b"d") else 2 if long in (b"re", b"ve", b"ll") else 0
        if n:
            edge[p + 1], edge[p + 1 + n] = False, True
    at = np.flatnonzero(edge)
    real = kind[at[:-1]] != 0
    ends = np.cumsum([len(r) + 1 for r in raw]) - 1
    return buf, at[:-1][real], at[1:][real], np.searchsorted(at[:-1][real], ends)


_SPACE, _LETTER = 1, 2
#: Bytes that are not ASCII that is printed or space.
_ODD = np.array([not (9 <= b <= 13 or 32 <= b < 127) for b in range(256)])
#: 0 ends a text; bytes over 127 are of letters here.
_KIND = np.array([0 if b == 0 else _SPACE if b == 32 or 9 <= b <= 13 else _LETTER if b > 127 or chr(b).isalpha() else 3 if chr(b).isdigit() else 4 for b in range(256)], np.uint8)


@lru_cache(maxsize=1)
def tokenizer_of(path: str) -> Tokenizer:
    """One for each worker, so that what one task has learnt serves the next."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer(path)


def _write(rows: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, part) of one part in order: its block records in order."""
    tokenizer, number, part = tokenizer_of(path), 0, 0
    ids: list[np.ndarray] = []  # not yet coded
    docs: list[tuple[int | None, int, int]] = []  # their documents: id, pieces before, ids left
    held = 0

    def records(length: int, most: int) -> pa.RecordBatch:
        """The next blocks, at most so many."""
        nonlocal ids, docs, number, held
        flat = np.concatenate(ids)
        blocks = [flat[s : s + length] for s in range(0, min(len(flat), length * most), length)]
        ids = [flat[sum(map(len, blocks)) :].copy()]
        held = len(ids[0])
        of, at = [], 0
        for b in blocks:
            room, own = len(b), []
            while room:
                doc, piece, left = docs[at]
                n = min(room, left)
                own.append((doc, piece, n))
                room -= n
                docs[at] = (doc, piece + 1, left - n)
                at += left == n
            of.append(own)
        del docs[:at]
        payloads = encode_blocks(blocks)
        column = lambda i, kind: pa.array([[d[i] for d in own] for own in of], pa.list_(kind))
        batch = pa.RecordBatch.from_arrays([
            pa.array([part] * len(of), pa.int32()), pa.array(range(number, number + len(of)), pa.int64()), column(0, pa.int64()), column(1, pa.int32()), column(2, pa.int32()),
            pa.array([len(b) for b in blocks], pa.int32()), pa.array([crc(b) for b in blocks], pa.int64()),
            pa.array(payloads, pa.binary()), pa.array([zlib.crc32(p) for p in payloads], pa.int64()),
        ], names=[x.split()[0] for x in BLOCKS.split(", ")])
        number += len(of)
        return batch

    for batch in bounded(rows):
        if not batch.num_rows:
            continue
        part = batch.column("part")[0].as_py()
        coded, sizes = tokenizer.flat(batch.column("text").to_pylist())
        ids.append(coded)
        held += len(coded)
        docs.extend((d, 0, n) for d, n in zip(batch.column("doc_id").to_pylist(), sizes.tolist(), strict=True))
        while held >= LONGEST * TOGETHER:
            yield records(LONGEST, TOGETHER)
    if held:
        yield records(min(LONGEST, max(SHORTEST, -(-held // TOGETHER))), 2 * TOGETHER * LONGEST)


def write(docs: DataFrame, path: str, name: str = "ids") -> DataFrame:
    """Encodes docs (doc_id, text) with the tokenizer of that file, an id 0 after each, writes the block files in ascending doc_id order into the
    shared folder, and gives the table of block records that reads them.

    Null and empty texts are the end id alone; null ids come first; rows of one id stay together in no set order. Texts are taken whole. Other
    columns are ignored; no rows give no blocks. Parts are ranges of doc_id, as many as Spark deems right for their size.
    """
    small_batches(docs.sparkSession)
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    parts = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("doc_id", "text", F.spark_partition_id().alias("part"))
    return stored(parts.mapInArrow(lambda it: _write(it, path), BLOCKS), name)


def read(blocks: DataFrame) -> DataFrame:
    """Decodes and checks block records: doc_id, part, block, piece, seq (place in the block), ids. A wrong checksum raises; no blocks give no rows. A
    document's pieces in the order of part, block and seq are its ids; documents of equal or null ids follow one another, each from its piece 0 on."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _decoded(rows):
            for t, ids in some:
                n = len(t["lengths"])
                cuts = np.cumsum([0, *t["lengths"]])
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(t["doc_ids"], pa.int64()), "part": [t["part"]] * n, "block": [t["block"]] * n, "piece": t["pieces"], "seq": list(range(n)), "ids": pa.array([ids[s:e].tolist() for s, e in zip(cuts[:-1], cuts[1:], strict=True)], pa.list_(pa.int32()))}, schema=pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("block", pa.int64()), ("piece", pa.int32()), ("seq", pa.int32()), ("ids", pa.list_(pa.int32()))]))

    return blocks.mapInArrow(run, "doc_id long, part int, block long, piece int, seq int, ids array<int>")


def _decoded(rows: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[dict, np.ndarray]]]:
    """Records and their ids, as many together as are coded in step, whatever the batches."""
    records: list[dict] = []

    def out(some: list[dict]) -> list[tuple[dict, np.ndarray]]:
        for t in some:
            if zlib.crc32(t["payload"]) != t["payload_crc"]:
                raise ValueError(f"block {t['block']} of part {t['part']} is broken")
        told = list(zip(some, decode_blocks([t["payload"] for t in some], [t["n_ids"] for t in some]), strict=True))
        for t, ids in told:
            if crc(ids) != t["ids_crc"]:
                raise ValueError(f"the ids of block {t['block']} of part {t['part']} are wrong")
        return told

    for batch in rows:
        records += batch.to_pylist()
        while len(records) >= TOGETHER:
            yield out(records[:TOGETHER])
            del records[:TOGETHER]
    if records:
        yield out(records)


def digests(blocks: DataFrame) -> DataFrame:
    """From the files, per document: doc_id, start (ids of all documents before it), n_tokens and ids_crc32. Repeated rows and null ids have a row each; no
    blocks give no rows; a wrong checksum raises."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _decoded(rows):
            out = []
            for t, ids in some:
                cuts = np.cumsum([0, *t["lengths"]]).tolist()
                for seq, (d, p, s, e) in enumerate(zip(t["doc_ids"], t["pieces"], cuts[:-1], cuts[1:], strict=True)):
                    out.append((d, t["part"], t["block"], seq, p, e - s, crc(ids[s:e])))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 7, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "part", "block", "seq", "piece", "n", "crc"])

    pieces = stored(blocks.mapInArrow(run, "doc_id long, part int, block long, seq int, piece int, n long, crc long"), "pieces")
    sizes = {r["part"]: r["n"] for r in pieces.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    if not sizes:
        return blocks.sparkSession.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")

    def join(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of whole parts in order: documents."""
        part, at, doc = None, 0, None
        for b in rows:
            out = []
            for r in b.to_pylist():
                if r["part"] != part:
                    part, at = r["part"], before[r["part"]]
                if r["piece"] == 0:
                    if doc:
                        out.append(doc)
                    doc = (r["doc_id"], at, r["n"], r["crc"])
                else:
                    doc = (doc[0], doc[1], doc[2] + r["n"], joined_crc(doc[3], r["crc"], 4 * r["n"]))
                at += r["n"]
            yield _documents(out)
        if doc:
            yield _documents([doc])

    return pieces.repartition("part").sortWithinPartitions("part", "block", "seq").mapInArrow(join, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _documents(rows: list[tuple[int | None, int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
