"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed against it from left to right into
longest matches: the fewer such phrases a text needs, the more it is like that language. Phrases are normalised as
bits a character: phrases * log2(length of the labelled text) / length of the text. The lowest wins. Every letter of
the labelled text counts as itself; a letter that isn't in it is a phrase of its own. All that is no letter counts as
one blank.

A parse is a walk of a finite automaton, so a block of texts is walked in lockstep with numpy. Texts are cut into
segments of SEGMENT letters for that, all walked from the start state at first; then each segment whose true entry state
(the end of the one before it) is another is walked again until it meets its first walk, and so on until no entry
changes. The counts are those of one walk over the whole text, wherever the cuts are.

The labelled text is a bounded sample: at most rows_per_language rows of a language or so, drawn by a hash of their ids,
of each a slice of at most slice_chars characters (the whole text if it is shorter), as many as fit in
chars_per_language. Only that sample reaches the driver and is sent to the tasks. A text that is null or has no letter
is `und` with score 0. Ties go to the smaller language name. Repeated rows are predicted alike; rows of one id are drawn
together. Empty tables give empty results; without labelled rows all is `und`.
"""

from __future__ import annotations

import math
import random
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolytics.llm.common import byte_blocks, give_back, held_out, resident

UNDETERMINED = "und"
SEGMENT, BLOCK_BYTES, LANGUAGES_AT_ONCE = 256, 1 << 20, 8
#: Letter classes: letters that no sample has, and what is no letter. The letters of the samples follow.
UNKNOWN, BLANK, FIRST = 0, 1, 2
_SAMPLE_SPACE = 1 << 20


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Letters:
    """Maps texts to letter classes, one for each letter of the samples."""

    def __init__(self, samples: list[str]):
        known = sorted({x for t in samples for x in t.lower() if x.isalpha()})
        self.classes = FIRST + len(known)
        self.table = np.where(_is_letter(), UNKNOWN, BLANK).astype(np.int32)
        self.table[[ord(x) for x in known]] = np.arange(FIRST, self.classes)

    def codes(self, text: str) -> np.ndarray:
        codes = self.table[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        blank = codes == BLANK
        return codes[~(blank & np.r_[True, blank[:-1]])] if len(codes) else codes


def automaton(codes: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton (online construction); state 0 is the start."""
    move, link, length, last = [{}], [-1], [0], 0
    for c in codes.tolist():
        new, p = len(move), last
        move.append({})
        link.append(0)
        length.append(length[last] + 1)
        while p >= 0 and c not in move[p]:
            move[p][c] = new
            p = link[p]
        if p >= 0:
            q = move[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(move)
                move.append(dict(move[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and move[p].get(c) == q:
                    move[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return move


def displaced(move: list[dict[int, int]], classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, owner, target): state s, known by its place, goes on with letter c to target[place + c] if
    owner[place + c] is its place.

    The rows of all states but the start are laid over each other so that no two entries fall together: first those with
    several entries, the longest first, at pseudo-random places of a table twice as large; the others go into the gaps.
    Places are distinct.
    """
    rows = range(1, len(move))
    several = sorted((s for s in rows if len(move[s]) > 1), key=lambda s: (-len(move[s]), s))
    span = 2 * sum(len(move[s]) for s in several) + sum(len(move[s]) == 1 for s in rows) + len(move) + 64
    owner, target, taken, used = [-1] * (span + classes), [0] * (span + classes), bytearray(span + classes), set()
    place, rng = [0] * len(move), random.Random(1)
    draw = lambda: int(rng.random() * span)
    for s in several:
        letters, spot = list(move[s]), draw()
        while spot in used or any(taken[spot + c] for c in letters):
            spot = draw()
        place[s] = spot
        used.add(spot)
        for c in letters:
            taken[spot + c], owner[spot + c], target[spot + c] = 1, spot, move[s][c]
    gap = classes
    for s in rows:
        if len(move[s]) == 1:
            [(c, t)] = move[s].items()
            while taken[gap] or gap - c in used:
                gap += 1
            place[s] = gap - c
            used.add(gap - c)
            taken[gap], owner[gap], target[gap] = 1, gap - c, t
    spot = 0
    for s in [0, *rows]:
        if s == 0 or not move[s]:  # nothing is looked up with success here
            while spot in used:
                spot += 1
            place[s] = spot
            used.add(spot)
    place = np.array(place)
    return place, np.array(owner), place[np.array(target)]


class Parser:
    """Walks texts through the automata of all languages."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        self.letters = Letters(list(samples.values()))
        k = self.letters.classes
        parts, roots, self.start, self.bits, slots = [], [], [], [], 0
        for lang in self.languages:
            codes = self.letters.codes(samples[lang])
            move = automaton(codes)
            place, owner, target = displaced(move, k)
            root = np.full(k, slots + place[0], np.int64)
            for c, t in move[0].items():
                root[c] = slots + place[t]
            parts.append((np.where(owner < 0, -1, owner + slots), target + slots))
            roots.append(root)
            self.start.append(slots + int(place[0]))
            self.bits.append(math.log2(max(2, len(codes))))
            slots += len(owner)
        if slots >= 1 << 31:
            raise ValueError(f"{len(self.languages)} languages need {slots} entries: take fewer characters a language")
        join = lambda i: np.concatenate([p[i] for p in parts]).astype(np.int32) if parts else np.zeros(0, np.int32)
        self.owner, self.target = join(0), join(1)
        self.root = np.concatenate(roots).astype(np.int32) if roots else np.zeros(0, np.int32)

    def _walk(self, steps: np.ndarray, state: np.ndarray, offset: np.ndarray, states: np.ndarray, begun: np.ndarray) -> None:
        """Fill states (after each step) and begun (where a phrase begins) of all lanes, from the entry states."""
        at = np.empty_like(state)
        for i, c in enumerate(steps):
            np.add(state, c, out=at)
            np.not_equal(self.owner.take(at), state, out=begun[i])
            np.add(offset, c, out=states[i])
            state = np.where(begun[i], self.root.take(states[i]), self.target.take(at))
            states[i] = state

    def _mend(self, steps: np.ndarray, live: np.ndarray, state: np.ndarray, offset: np.ndarray, states: np.ndarray, begun: np.ndarray) -> None:
        """Walk the lanes in live again from other entry states, each until it comes to what states holds already."""
        for i, c in enumerate(steps):
            letter = c[live]
            at = state + letter
            miss = self.owner.take(at) != state
            state = np.where(miss, self.root.take(offset[live] + letter), self.target.take(at))
            new = states[i, live] != state
            begun[i, live], states[i, live] = miss, state
            if not new.all():
                live, state = live[new], state[new]
                if not len(live):
                    return

    def rates(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a letter by (language, text), and the number of letters of each text."""
        codes = [self.letters.codes(t) for t in texts]
        sizes = np.array([len(c) for c in codes])
        letters = np.array([int((c != BLANK).sum()) for c in codes])
        n_seg = -(-sizes // SEGMENT)
        padded = np.zeros(int(n_seg.sum()) * SEGMENT, np.int32)
        inside = np.zeros(len(padded), bool)
        first_of = np.cumsum(n_seg) - n_seg
        for first, c in zip(first_of.tolist(), codes, strict=True):
            padded[first * SEGMENT : first * SEGMENT + len(c)] = c
            inside[first * SEGMENT : first * SEGMENT + len(c)] = True
        steps = np.ascontiguousarray(padded.reshape(-1, SEGMENT).T)
        inside = np.ascontiguousarray(inside.reshape(-1, SEGMENT).T)
        owner = np.repeat(np.arange(len(texts)), n_seg)
        goes_on = np.ones(len(owner), bool)  # segments that follow another one of their text
        goes_on[first_of[n_seg > 0]] = False
        out = []
        for i in range(0, len(self.languages), LANGUAGES_AT_ONCE):
            out.append(self._counts(steps, inside, owner, goes_on, range(i, min(i + LANGUAGES_AT_ONCE, len(self.languages))), len(texts)))
        return np.concatenate(out) * np.array(self.bits)[:, None] / np.maximum(sizes, 1), letters

    def _counts(self, steps: np.ndarray, inside: np.ndarray, owner: np.ndarray, goes_on: np.ndarray, langs: range, n_texts: int) -> np.ndarray:
        n = steps.shape[1]
        if not n:
            return np.zeros((len(langs), n_texts))
        lanes = np.tile(steps, len(langs))
        start = np.repeat(np.array([self.start[i] for i in langs], np.int32), n)
        offset = np.repeat(np.array(langs, np.int32) * self.letters.classes, n)
        states, begun = np.empty(lanes.shape, np.int32), np.empty(lanes.shape, bool)
        self._walk(lanes, start, offset, states, begun)
        entry, follows = start.copy(), np.flatnonzero(np.tile(goes_on, len(langs)))
        while True:
            now = states[-1, follows - 1]
            changed = follows[now != entry[follows]]
            if not len(changed):
                break
            entry[changed] = states[-1, changed - 1]
            self._mend(lanes, changed, entry[changed], offset, states, begun)
        phrases = (begun & np.tile(inside, len(langs))).sum(axis=0).reshape(len(langs), n)
        return np.array([np.bincount(owner, p, n_texts) for p in phrases])

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        rates, letters = self.rates(texts)
        order = np.sort(rates, axis=0)
        score = order[1] / np.maximum(order[0] + order[1], 1e-12) if len(order) > 1 else np.ones(len(texts))
        best = rates.argmin(axis=0)
        langs = [self.languages[b] if n else UNDETERMINED for b, n in zip(best.tolist(), letters.tolist(), strict=True)]
        return langs, np.where(letters > 0, np.clip(score, 0, 1), 0.0).tolist()


def learn_samples(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    chars_per_language: int = 24_000, rows_per_language: int = 96, slice_chars: int = 6_000,
) -> dict[str, str]:
    """Labelled text by language: slices of texts in order of a hash of the id, at most chars_per_language characters.

    About rows_per_language rows of each language are drawn by a threshold on that hash. Of a text longer than
    slice_chars a slice is taken at a place that the hash names, so that languages with long texts alone are learned too.
    Rows with a null text or language aren't used.
    """
    slice_chars = min(slice_chars, chars_per_language)
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not known:
        return {}
    shares = [F.lit(x) for k, n in known.items() for x in (k, math.ceil(_SAMPLE_SPACE * min(1.0, rows_per_language / n)))]
    hashed = F.xxhash64(F.col(id_col))
    drawn = F.pmod(hashed, F.lit(_SAMPLE_SPACE))
    room = F.greatest(F.length(text_col) - slice_chars, F.lit(0)) + 1
    part = F.substring(F.col(text_col), (F.pmod(hashed, room) + 1).cast("int"), F.lit(slice_chars))
    sample = rows.where(drawn < F.element_at(F.create_map(*shares), F.col(lang_col))).select(lang_col, drawn, id_col, part).collect()
    out: dict[str, str] = {}
    for lang, _, _, text in sorted(sample, key=lambda r: (r[0], r[1], str(r[2]), r[3])):
        have = out.get(lang, "")
        if len(have) + len(text) < chars_per_language or not have:
            out[lang] = f"{have} {text}" if have else text
    return out


def language(text: Column, samples: dict[str, str]) -> Column:
    """Column of struct(lang, score) by the automata of these samples, which executors build once."""
    key = uuid.uuid4().hex

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        parser = resident(("language", key), lambda: Parser(samples))
        for texts in batches:
            found = [parser.predict(block) for block in byte_blocks(texts.to_pylist(), BLOCK_BYTES)]
            langs, scores = (pa.array([x for f in found for x in f[i]], kind) for i, kind in enumerate((pa.string(), pa.float64())))
            yield pa.StructArray.from_arrays([langs, scores], ["lang", "score"])
        give_back()

    return predict(text)


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", chars_per_language: int = 24_000
) -> DataFrame:
    """docs with held_out, lang_pred and score, which replace columns of these names.

    Learns from rows of docs that aren't held out and have a language. score is the runner-up's rate over the sum of
    the two lowest: 0.5 is a tie, 1 where only one language is known.
    """
    samples = learn_samples(docs.where(~held_out(id_col)), id_col, text_col, lang_col, chars_per_language)
    found = docs.withColumn("_found", language(F.col(text_col), samples))
    return found.withColumns({"held_out": held_out(id_col), "lang_pred": F.col("_found.lang"), "score": F.col("_found.score")}).drop("_found")
