"""Phrase collocation mining with weighted acyclic automata.

Texts are split into pieces at punctuation and line ends, pieces into words. A shard (about SHARD_BYTES of texts in a
task) counts its phrases of one length, sorts them and builds a count transducer of each language: an acyclic automaton
over words whose arcs carry the count of the phrase that ends there; as soon as a state can get no more arcs it is looked
up in a register, so equal states are stored once. Transducers are cut at prefix ranges, bounds of about RANGE_WORDS
words of text that are known from the counts of words, and shuffled by range; a task unites those of its range, sums
their weights and drops what is too rare. Lengths come one after another: a phrase can only be frequent if what it
begins and ends with is, so words, then pairs that are rare break pieces for the longer ones. Which are frequent is told
by a bitmap of fixed size, where rare ones may pass, for they are dropped when counts are complete; nothing frequent is
ever lost, and no count is an estimate.

Parts are looked up by composition: the phrases of a range are cut, the parts of each range of targets become an
acceptor, which is walked in step with that range's transducer; the counts go back to the range that asked. So no part,
however common, is a key that rows are dealt by.

Null texts count as empty, a null language as `und`; repeated rows count again. An empty table gives no rows. Other
columns are left out. Words are compared as bytes of UTF-8, A-Z as a-z. What the driver holds: the bounds (one for about
RANGE_WORDS words of text) and two bitmaps of 2**BITMAP_BITS bits.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convolytics.llm.common import give_back, materialize, release

MOST, LEAST = 4, 30
SHARD_BYTES, SLICE_BYTES, RANGE_WORDS = 24 << 20, 1 << 20, 4 << 20
BITMAP_BITS, PAGE_BITS = 27, 16
_TABLE = bytes(10 if i in b".,;:!?\n\x0b\x0c\r" else 32 if i == 9 else i + 32 if 65 <= i <= 90 else i for i in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CODEC = pa.Codec("zstd", 1)


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lists, with a line end where a piece ends; long texts are cut between words."""
    text = text.translate(_TABLE)
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > SLICE_BYTES:
            cut = re.compile(rb"[ \n]").search(text, at + SLICE_BYTES)
            end = cut.start() if cut else end
        yield [w for w in text[at:end].replace(b"\n", b" \n ").split(b" ") if w]
        at = end


class Words(dict):
    """Numbers of words from 1; 0 is a break."""

    def __init__(self):
        super().__init__({b"\n": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def word_hash(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ (b * _MIX + (b >> np.uint64(29)))) * _MIX
    return h ^ (h >> np.uint64(32))


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def _has(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    s = _slots(h)
    return (bitmap[s >> 3] >> (s & 7).astype(np.uint8)) & 1 > 0


class Automaton:
    """A count transducer over words. State 0 has no arcs; the arcs of state s are first[s] to first[s + 1], sorted by
    label; the last state is the start. label: a place in `words`, which are sorted; weight: the count of the phrase that
    ends with the arc, 0 if it isn't counted."""

    def __init__(self, words: list[bytes], first: np.ndarray, label: np.ndarray, target: np.ndarray, weight: np.ndarray):
        self.words, self.first, self.label, self.target, self.weight = words, first, label, target, weight

    @classmethod
    def build(cls, words: list[bytes], rows: np.ndarray, counts: np.ndarray) -> Automaton:
        """From distinct phrases in order: rows of places in words, -1 after the end. Only words in use are kept."""
        used = np.zeros(len(words) + 1, bool)
        used[rows.ravel()] = True
        place = np.cumsum(used[:-1]) - 1
        words = [w for w, u in zip(words, used[:-1].tolist(), strict=True) if u]
        rows = np.where(rows < 0, -1, place[rows])
        n, width = rows.shape
        register: dict[bytes, int] = {b"": 0}
        arcs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        below: np.ndarray | None = None  # the state after each prefix of one word more, by first row
        new = np.zeros((width + 1, n), bool)
        new[0, :1] = True
        for d in range(1, width + 1):
            new[d] = new[d - 1]
            new[d, 1:] |= rows[1:, d - 1] != rows[:-1, d - 1]
        for d in range(width, 0, -1):
            at = np.flatnonzero(new[d] & (rows[:, d - 1] >= 0))  # the first row of each prefix of d words
            ends = rows[at, d] < 0 if d < width else np.ones(len(at), bool)
            label, weight = rows[at, d - 1].astype(np.int32), np.where(ends, counts[at], 0).astype(np.int64)
            target = below[at].astype(np.int32) if below is not None else np.zeros(len(at), np.int32)
            parents = np.flatnonzero(new[d - 1])
            bounds = np.searchsorted(at, np.r_[parents, n])
            table = np.rec.fromarrays([label, target, weight]).tobytes()
            size, states = 16, np.zeros(n, np.int32)
            for parent, lo, hi in zip(parents.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if lo < hi:  # no more arcs can come: the state is the registered one, or a new one
                    key = table[lo * size : hi * size]
                    state = register.get(key)
                    if state is None:
                        state = register[key] = len(arcs) + 1
                        arcs.append((label[lo:hi], target[lo:hi], weight[lo:hi]))
                    states[parent] = state
            below = states
        if not arcs:
            none = np.zeros(0, np.int32)
            return cls([], np.zeros(3, np.int64), none, none, none.astype(np.int64))
        first = np.r_[0, 0, np.cumsum([len(a[0]) for a in arcs])]
        return cls(words, first, *(np.concatenate([a[i] for a in arcs]) for i in range(3)))

    def walk(self) -> tuple[np.ndarray, np.ndarray]:
        """All counted phrases (rows as of build, not sorted) and their counts."""
        state, path = np.array([len(self.first) - 2]), np.zeros((1, 0), np.int64)
        rows, counts = [], []
        while len(state):
            n = self.first[state + 1] - self.first[state]
            parent = np.repeat(np.arange(len(state)), n)
            arc = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[state], n)
            path = np.c_[path[parent], self.label[arc]]
            state = self.target[arc]
            at = self.weight[arc] > 0
            rows.append(path[at])
            counts.append(self.weight[arc][at])
            keep = self.first[state + 1] > self.first[state]
            path, state = path[keep], state[keep]
        width = max((r.shape[1] for r in rows), default=1)
        padded = [np.pad(r, ((0, 0), (0, width - r.shape[1])), constant_values=-1) for r in rows]
        return np.concatenate(padded) if padded else np.zeros((0, 1), np.int64), np.concatenate(counts) if counts else np.zeros(0, np.int64)

    def compose(self, acceptor: Automaton) -> tuple[np.ndarray, np.ndarray]:
        """The acceptor's phrases (rows as of its walk) and the counts that this transducer gives them: both are walked
        in step, from pairs of states along arcs of one word; where this one has no arc the count is 0."""
        place = {w: i for i, w in enumerate(self.words)}
        mine = np.fromiter((place.get(w, -1) for w in acceptor.words), np.int64, len(acceptor.words))
        key = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first)) << 32 | self.label
        p, q, path = np.array([len(acceptor.first) - 2]), np.array([len(self.first) - 2]), np.zeros((1, 0), np.int64)
        rows, counts = [], []
        while len(p):
            n = acceptor.first[p + 1] - acceptor.first[p]
            parent = np.repeat(np.arange(len(p)), n)
            arc = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(acceptor.first[p], n)
            path = np.c_[path[parent], acceptor.label[arc]]
            want = np.where(mine[acceptor.label[arc]] >= 0, q[parent] << 32 | mine[acceptor.label[arc]], -1)
            at = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
            found = key[at] == want if len(key) else np.zeros(len(want), bool)
            weight, target = (np.where(found, x[at] if len(key) else 0, 0) for x in (self.weight, self.target))
            asked = acceptor.weight[arc] > 0
            rows.append(path[asked])
            counts.append(weight[asked])
            p, q = acceptor.target[arc], target
            keep = acceptor.first[p + 1] > acceptor.first[p]
            p, q, path = p[keep], q[keep], path[keep]
        width = max((r.shape[1] for r in rows), default=1)
        padded = [np.pad(r, ((0, 0), (0, width - r.shape[1])), constant_values=-1) for r in rows]
        return np.concatenate(padded) if padded else np.zeros((0, 1), np.int64), np.concatenate(counts) if counts else np.zeros(0, np.int64)

    def dump(self) -> bytes:
        text = b" ".join(self.words)
        label, target, weight = (x.astype(np.min_scalar_type(int(x.max(initial=0)))) for x in (self.label, self.target, self.weight))
        head = np.array([len(text), len(self.first), len(label), label.itemsize, target.itemsize, weight.itemsize], np.int64)
        body = b"".join((head.tobytes(), self.first.astype(np.int64).tobytes(), label.tobytes(), target.tobytes(), weight.tobytes(), text))
        return len(body).to_bytes(8, "little") + _CODEC.compress(body, asbytes=True)

    @classmethod
    def load(cls, data: bytes) -> Automaton:
        body = _CODEC.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
        size, states, arcs, *widths = np.frombuffer(body, np.int64, 6).tolist()
        at, parts = 48 + 8 * states, []
        for w in widths:
            parts.append(np.frombuffer(body, f"u{w}", arcs, at).astype(np.int64))
            at += w * arcs
        text = body[at : at + size]
        return cls(text.split(b" ") if text else [], np.frombuffer(body, np.int64, states, 48), *parts)


def ordered(rows: np.ndarray, counts: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order with their counts summed, those of at least `least`."""
    if not len(rows):
        return rows, counts
    keys = [(rows[:, d] + 1) << 32 | (rows[:, d + 1] + 1 if d + 1 < rows.shape[1] else 0) for d in range(0, rows.shape[1], 2)]
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.r_[True, np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)]
    at = np.flatnonzero(new)
    sums = np.add.reduceat(counts[order], at)
    kept = sums >= least
    return rows[order[at[kept]]], sums[kept]


def unite(parts: list[Automaton], least: int = 1) -> Automaton:
    """The union of transducers, weights summed; phrases of less than `least` in all are dropped."""
    words = sorted(set().union(*(a.words for a in parts)))
    place = {w: i for i, w in enumerate(words)}
    rows, counts = [], []
    for a in parts:
        r, c = a.walk()
        to = np.fromiter((*(place[w] for w in a.words), -1), np.int64, len(a.words) + 1)
        rows.append(to[r])
        counts.append(c)
    width = max(r.shape[1] for r in rows)
    rows = [np.pad(r, ((0, 0), (0, width - r.shape[1])), constant_values=-1) for r in rows]
    return Automaton.build(words, *ordered(np.concatenate(rows), np.concatenate(counts), least))


def by_range(lang: str, words: list[bytes], rows: np.ndarray, counts: np.ndarray, bounds: list[tuple]) -> Iterator[tuple[int, Automaton]]:
    """(range, transducer) of sorted phrases, cut where a bound (lang, words) falls. Range i ends before bounds[i]."""
    low = bisect_left(bounds, (lang,))
    high = bisect_right(bounds, (lang + "\0",))
    at, phrase = 0, lambda i: (lang, *(words[x] for x in rows[i].tolist() if x >= 0))
    for i in range(low, high + 1):
        end = bisect_left(range(len(rows)), bounds[i], lo=at, key=phrase) if i < high else len(rows)
        if end > at:
            yield i, Automaton.build(words, rows[at:end], counts[at:end])
        at = end


_BLOB = pa.schema([("range", pa.int32()), ("lang", pa.string()), ("blob", pa.binary())])


def _emit(rows: Iterable[tuple], schema: pa.Schema, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += sum(len(x) for x in row if isinstance(x, (bytes, str))) + 64
        if total > size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[dict[str, tuple[Words, np.ndarray]]]:
    """For each shard and language its words and the stream of their numbers, texts apart by breaks. Nothing of a shard is
    held here once it is given; who takes it empties it, so that two shards are never in memory at a time."""
    held: dict[str, tuple[Words, list[np.ndarray]]] = {}
    size = 0

    def closed() -> dict[str, tuple[Words, np.ndarray]]:
        out = {}
        while held:
            lang, (words, stream) = held.popitem()
            out[lang] = words, np.concatenate(stream)
        return out

    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
            data = text.as_py()
            words, stream = held.setdefault(lang.as_py(), (Words(), []))
            for part in tokens(data):
                stream.append(np.fromiter(map(words.__getitem__, part), np.int32, len(part)))
            stream.append(np.zeros(1, np.int32))
            size += len(data)
            if size >= most:
                words = stream = None
                yield closed()
                size = 0
    words = stream = None
    if held:
        yield closed()


_COUNT = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("f", pa.int64())])


def _word_counts(shard_bytes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for shard in _shards(batches, shard_bytes):
            while shard:
                lang, (words, stream) = shard.popitem()
                counts = np.bincount(stream, minlength=len(words))[1:]
                if len(counts):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(list(words)[1:], pa.binary()), pa.array(counts, pa.int64())], schema=_COUNT)
                del words, stream, counts
        give_back()

    return run


def _phrase_counts(length: int, shard_bytes: int, bounds, bitmaps) -> Callable:
    """Transducers by shard and range of the pairs (length 2) or of all longer phrases up to `length`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        maps = [np.frombuffer(m, np.uint8) for m in bitmaps.value]
        yield from _emit(rows(batches, maps), _BLOB)
        give_back()

    def rows(batches: Iterator[pa.RecordBatch], maps: list[np.ndarray]) -> Iterator[tuple]:
        for shard in _shards(batches, shard_bytes):
            while shard:
                lang, one = shard.popitem()
                for i, a in count(lang, *one, maps):
                    yield i, lang, a.dump()
                del one

    def count(lang: str, numbers: Words, stream: np.ndarray, maps: list[np.ndarray]) -> Iterator[tuple[int, Automaton]]:
        words = list(numbers)
        hashes = word_hash(lang, words)
        frequent = _has(maps[0], hashes)
        frequent[0] = False
        at = np.flatnonzero(frequent)
        own = sorted(words[i] for i in at.tolist())
        place = {w: i for i, w in enumerate(own)}
        to = np.full(len(words), -1, np.int64)
        to[at] = [place[words[i]] for i in at.tolist()]
        hashes = word_hash(lang, own)
        w = to[stream]
        pair = (w[:-1] >= 0) & (w[1:] >= 0)
        if length == 2:
            keys, counts = np.unique(w[:-1][pair] << 32 | w[1:][pair], return_counts=True)
            rows = np.c_[keys >> 32, keys & 0xFFFFFFFF]
        else:
            start = np.flatnonzero(pair)
            keys, back = np.unique(w[start] << 32 | w[start + 1], return_inverse=True)
            pair[start] = _has(maps[1], pair_hash(hashes[keys >> 32], hashes[keys & 0xFFFFFFFF]))[back] if len(keys) else False
            both = pair[:-1] & pair[1:]
            start = np.flatnonzero(both)
            cols = [w[start], w[start + 1], w[start + 2]]
            reach = both[start]
            for d in range(3, length):
                reach = reach & (start + d - 1 < len(pair)) & pair[np.minimum(start + d - 1, len(pair) - 1)]
                cols.append(np.where(reach, w[np.minimum(start + d, len(w) - 1)], -1))
            # A run of words counts for all that it begins with: each is a phrase of its own.
            whole, n = ordered(np.stack(cols, axis=1), np.ones(len(start), np.int64))
            parts = [np.where(np.arange(length) < d, whole, -1)[whole[:, d - 1] >= 0] for d in range(3, length + 1)]
            rows, counts = ordered(np.concatenate(parts), np.concatenate([n[whole[:, d - 1] >= 0] for d in range(3, length + 1)]))
        if len(rows):
            yield from by_range(lang, own, rows, counts, bounds.value)

    return run


def _united(least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held, key = [], None
            for batch in batches:
                for i, lang, blob in zip(*(batch.column(c).to_pylist() for c in _BLOB.names), strict=True):
                    if key != (i, lang) and held:
                        yield *key, unite(held, least)
                        held = []
                    key = i, lang
                    held.append(Automaton.load(blob))
            if held:
                yield *key, unite(held, least)

        yield from _emit(((i, lang, a.dump()) for i, lang, a in rows() if len(a.label)), _BLOB)
        give_back()

    return run


def united(parts: DataFrame, least: int, n: int) -> DataFrame:
    """One transducer for each range and language."""
    return parts.repartition(n, "range").sortWithinPartitions("range", "lang").mapInArrow(_united(least), "range int, lang string, blob binary")


_PAGE = pa.schema([("page", pa.int32()), ("bits", pa.binary())])


def _pages(slots: Iterable[np.ndarray]) -> Iterator[pa.RecordBatch]:
    pages: dict[int, np.ndarray] = {}
    for s in slots:
        for page in np.unique(s >> PAGE_BITS).tolist():
            bits = pages.setdefault(page, np.zeros(1 << (PAGE_BITS - 3), np.uint8))
            own = s[s >> PAGE_BITS == page] & ((1 << PAGE_BITS) - 1)
            np.bitwise_or.at(bits, own >> 3, (1 << (own & 7)).astype(np.uint8))
    yield from _emit(((p, b.tobytes()) for p, b in sorted(pages.items())), _PAGE)


def _word_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def slots() -> Iterator[np.ndarray]:
        for batch in batches:
            langs, words = np.array(batch.column("lang").to_pylist(), object), batch.column("word").to_pylist()
            for lang in sorted(set(langs.tolist())):
                yield np.sort(_slots(word_hash(lang, [words[i] for i in np.flatnonzero(langs == lang).tolist()])))

    return _pages(slots())


def _pair_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def slots() -> Iterator[np.ndarray]:
        for batch in batches:
            for lang, blob in zip(batch.column("lang").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                a = Automaton.load(blob)
                rows, h = a.walk()[0], word_hash(lang, a.words)
                yield np.sort(_slots(pair_hash(h[rows[:, 0]], h[rows[:, 1]])))

    return _pages(slots())


def _merged_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pages: dict[int, np.ndarray] = {}
    for batch in batches:
        for page, bits in zip(batch.column("page").to_pylist(), batch.column("bits").to_pylist(), strict=True):
            pages[page] = pages.get(page, 0) | np.frombuffer(bits, np.uint8)
    yield from _emit(((p, b.tobytes()) for p, b in sorted(pages.items())), _PAGE)


def bitmap(rows: DataFrame, pages: Callable) -> bytes:
    """2**BITMAP_BITS bits, set for all rows; each page of it is put together by one task."""
    merged = rows.mapInArrow(pages, "page int, bits binary").repartition("page").mapInArrow(_merged_pages, "page int, bits binary")
    out, size = bytearray(1 << (BITMAP_BITS - 3)), 1 << (PAGE_BITS - 3)
    for page, bits in merged.toLocalIterator():
        out[page * size : (page + 1) * size] = bits
    return bytes(out)


def prefix_bounds(counts: DataFrame, size: int = RANGE_WORDS) -> list[tuple]:
    """Sorted bounds (lang, word) or (lang, word, word) of ranges that hold about `size` words of text each. A word that
    holds more is cut again by the word that follows, at the bounds of its language."""
    ranged = materialize(counts.repartitionByRange("lang", "word").withColumn("part", F.spark_partition_id()), "phrase-words")
    before, offsets = 0, []
    for part, n in sorted(ranged.groupBy("part").agg(F.sum("f")).collect()):
        offsets.append((part, before))
        before += n
    if not offsets:
        return []
    starts = ranged.sparkSession.createDataFrame(offsets, "part int, before long")
    until = F.col("before") + F.sum("f").over(Window.partitionBy("part").orderBy("lang", "word"))
    cut = ranged.join(starts, "part").withColumn("until", until).where(F.floor(F.col("until") / size) > F.floor((F.col("until") - F.col("f")) / size))
    rows = sorted((r[0], bytes(r[1]), r[2]) for r in cut.select("lang", "word", "f").collect())
    plain = sorted({(lang, word) for lang, word, _ in rows})
    out = set(plain)
    for lang, word, f in rows:
        inner = [w for own, w in plain if own == lang]
        pieces = min(len(inner), f // size)
        out |= {(lang, word, inner[i * len(inner) // (pieces + 1)]) for i in range(1, pieces + 1)}
    return sorted(out)


def _word_ranges(bounds) -> Callable:
    """The counted words as transducers, by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                own: dict[str, list[tuple[bytes, int]]] = {}
                for lang, word, f in zip(*(batch.column(c).to_pylist() for c in _COUNT.names), strict=True):
                    own.setdefault(lang, []).append((word, f))
                for lang, pairs in own.items():
                    pairs.sort()
                    words, counts = [w for w, _ in pairs], np.array([f for _, f in pairs], np.int64)
                    for i, a in by_range(lang, words, np.arange(len(words))[:, None], counts, bounds.value):
                        yield i, lang, a.dump()

        yield from _emit(rows(), _BLOB)

    return run


def _cuts(phrase: tuple[bytes, ...]) -> list[tuple[tuple, tuple]]:
    return [(phrase[:k], phrase[k:]) for k in range(1, len(phrase))]


def _inside(phrase: tuple[bytes, ...]) -> list[tuple]:
    """The shorter phrases of two words or more in a phrase."""
    return [phrase[i : i + k] for k in range(2, len(phrase)) for i in range(len(phrase) - k + 1)]


def _phrases(a: Automaton) -> list[tuple[tuple[bytes, ...], int]]:
    rows, counts = ordered(*a.walk())
    return [(tuple(a.words[x] for x in r if x >= 0), c) for r, c in zip(rows.tolist(), counts.tolist(), strict=True)]


_ASK = pa.schema([("range", pa.int32()), ("lang", pa.string()), ("asker", pa.int32()), ("blob", pa.binary())])


def _asked(bounds) -> Callable:
    """Acceptors of the parts of each range's phrases, by the range where the parts are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for i, lang, blob in zip(*(batch.column(c).to_pylist() for c in _BLOB.names), strict=True):
                    parts = {x for phrase, _ in _phrases(Automaton.load(blob)) if len(phrase) > 1 for x in (*(y for cut in _cuts(phrase) for y in cut), *_inside(phrase))}
                    if not parts:
                        continue
                    words = sorted({w for x in parts for w in x})
                    place, width = {w: n for n, w in enumerate(words)}, max(map(len, parts))
                    table = np.array([[place[x[d]] if d < len(x) else -1 for d in range(width)] for x in sorted(parts)], np.int64)
                    for j, a in by_range(lang, words, table, np.ones(len(table), np.int64), bounds.value):
                        yield j, lang, i, a.dump()

        yield from _emit(rows(), _ASK)

    return run


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each acceptor composed with its range's transducer, which comes first: again a transducer, of parts with counts."""

    def rows() -> Iterator[tuple]:
        transducer = None
        for batch in batches:
            for lang, i, blob in zip(*(batch.column(c).to_pylist() for c in ("lang", "asker", "blob")), strict=True):
                own = Automaton.load(blob)
                if i < 0:
                    transducer = own
                else:
                    yield i, lang, Automaton.build(own.words, *ordered(*transducer.compose(own))).dump()

    yield from _emit(rows(), _BLOB)


_FOUND = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64()), ("l", pa.int64()), ("r", pa.int64()), ("score", pa.int64()), ("within", pa.bool_())])


def _scored(scale: int, share: tuple[int, int]) -> Callable:
    """Rows of candidates with their scores, and rows (within) of phrases that a longer one makes superfluous."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            key, own, counts = None, None, {}
            for batch in batches:
                for i, lang, kind, blob in zip(*(batch.column(c).to_pylist() for c in ("range", "lang", "kind", "blob")), strict=True):
                    if key != (i, lang):
                        if key:
                            yield from judged(key[1], own, counts)
                        key, own, counts = (i, lang), None, {}
                    if kind == 0:
                        own = Automaton.load(blob)
                    else:
                        counts.update(_phrases(Automaton.load(blob)))
            if key:
                yield from judged(key[1], own, counts)

        yield from _emit(rows(), _FOUND)

    def judged(lang: str, own: Automaton, counts: dict) -> Iterator[tuple]:
        for phrase, a in _phrases(own):
            if len(phrase) < 2:
                continue
            score, _, left, right = min((scale * a // (counts[x] + counts[y]), k, counts[x], counts[y]) for k, (x, y) in enumerate(_cuts(phrase)))
            yield lang, b" ".join(phrase).decode("utf-8", "replace"), a, left, right, score, False
            for x in _inside(phrase):
                if share[1] * a >= share[0] * counts[x]:
                    yield lang, b" ".join(x).decode("utf-8", "replace"), None, None, None, None, True

    return run


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = 2000, most: int = MOST, scale: int = 2_000_000, share: tuple[int, int] = (80, 100), shard_bytes: int = SHARD_BYTES, range_words: int = RANGE_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of 2 to `most` words that occur at least
    `least` times. a, l, r: counts of the phrase and of the parts of its weakest cut; n: of all words; score: floor of
    scale * a / (l + r). Phrases inside a longer one that has share of their count are left out."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    counted = texts.mapInArrow(_word_counts(shard_bytes), "lang string, word binary, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    counted = materialize(counted, "phrase-counts")
    sizes = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = materialize(counted.where(F.col("f") >= least), "phrase-frequent")
    found = prefix_bounds(counted, range_words)
    bounds = spark.sparkContext.broadcast(found)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    blob = "range int, lang string, blob binary"
    maps = [bitmap(frequent, _word_pages)]
    pairs = materialize(united(texts.mapInArrow(_phrase_counts(2, shard_bytes, bounds, spark.sparkContext.broadcast(maps)), blob), least, n), "phrase-pairs")
    maps = [*maps, bitmap(pairs, _pair_pages)]
    longer = united(texts.mapInArrow(_phrase_counts(most, shard_bytes, bounds, spark.sparkContext.broadcast(maps)), blob), least, n) if most > 2 else pairs.limit(0)
    single = frequent.select("lang", "word", "f").mapInArrow(_word_ranges(bounds), blob)
    every = materialize(united(single.unionByName(pairs).unionByName(longer), 1, n), "phrase-transducers")
    asked = every.mapInArrow(_asked(bounds), "range int, lang string, asker int, blob binary")
    both = every.withColumn("asker", F.lit(-1)).unionByName(asked).repartition(n, "range").sortWithinPartitions("range", "lang", "asker")
    answers = both.mapInArrow(_answered, blob)
    told = every.withColumn("kind", F.lit(0)).unionByName(answers.withColumn("kind", F.lit(1)))
    judged = told.repartition(n, "range").sortWithinPartitions("range", "lang", "kind").mapInArrow(_scored(scale, share), "lang string, phrase string, a long, l long, r long, score long, within boolean")
    judged = materialize(judged, "phrase-scores")
    within = judged.where("within").select("lang", "phrase").distinct()
    kept = judged.where("not within").drop("within").join(within, ["lang", "phrase"], "left_anti")
    order: list[Column] = [F.desc("score"), F.desc("a"), F.col("phrase")]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(256))).orderBy(*order)
    first = kept.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
