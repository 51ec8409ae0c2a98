"""SentencePiece BPE encoding and decoding by a prefix table.

The last token of the encoding of each prefix of a word is unique. It is found from left to right: an Aho-Corasick
automaton gives the pieces that end at a position, and the one that is compatible with the last token of the prefix
before it is stored; two tokens are compatible if merging their joined text gives just these two. Going backwards
through the table then gives the tokens, in time linear in the length.

The library's own normalizer is applied first. No piece has the space mark after another character, so texts are
encoded word by word, with a memo for short words. Runs of space marks merge last (their scores are lowest and equal)
and are encoded apart. Characters without a piece become byte pieces. Decoding maps ids to bytes, turns space marks
into blanks and takes the one added in front away. Null and empty texts have no ids.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolytics.llm.common import Memo, byte_blocks, give_back, put, resident

SPACE = "▁"
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_SHORT, MEMO_WORDS, BLOCK_CHARS = 48, 400_000, 1 << 20


class PieceCodec:
    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        self.library = lib = SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        special = {i for i in range(n) if lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)}
        self.id = {lib.id_to_piece(i): i for i in range(n) if i not in special}
        self.rank = {p: -lib.get_score(i) for p, i in self.id.items()}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) or re.match(f"{SPACE}{SPACE}+[^{SPACE}]", p) for p in self.id):
            raise ValueError("a piece crosses the beginning of a word")
        self.byte_id = {int(lib.id_to_piece(i)[3:5], 16): i for i in range(n) if lib.is_byte(i)}
        self.unknown = lib.unk_id()
        self.bytes = [b"" if lib.is_control(i) else lib.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        self.bytes[self.unknown] = " ⁇ ".encode()
        for b, i in self.byte_id.items():
            self.bytes[i] = bytes([b])
        self.halves: dict[str, tuple[str, str]] = {}
        self.matches = ahocorasick.Automaton()
        for p in sorted(self.id, key=len):
            parts = self.merged(p, 2)
            if len(parts) < 3 and p.strip(SPACE) and self.merged(p) == [p]:
                self.halves[p] = tuple(parts)
                self.matches.add_word(p, (len(p), p))
        self.matches.add_word(SPACE, (1, SPACE))
        self.matches.make_automaton()
        self.compatible = Memo(lambda pair: self.stay_apart(*pair))
        self.words = Memo(self.word, MEMO_WORDS)
        self.runs = Memo(self.run)

    def merged(self, text: str, until: int = 1) -> list[str]:
        """Merges by rank, then leftmost, until so many parts are left: for short texts."""
        parts, rank = list(text), self.rank
        while len(parts) > until:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stay_apart(self, a: str, b: str) -> bool:
        """If merging the text of tokens a and b gives a and b.

        Goes back in time: the later of the two merges that made a and b is undone at the side of the boundary. The
        tokens stay apart if, at no time, a merge across the boundary would have come before the one undone.
        """
        rank, halves, before = self.rank, self.halves, float("inf")
        while True:
            across = rank.get(a + b)
            if across is not None and across < before:
                return False
            of_a, of_b = (rank[x] if len(x) > 1 else -1 for x in (a, b))
            if of_a < 0 and of_b < 0:
                return True
            if of_a > of_b:
                before, a = of_a, halves[a][1]
            else:
                before, b = of_b + 0.5, halves[b][0]  # on equal ranks the left merge comes first

    def run(self, n: int) -> list[int]:
        """Ids of n space marks. Pairs merge from the left until none is a piece: equal scores."""
        if n <= 64:
            return [self.id[p] for p in self.merged(SPACE * n)]
        longest = max(len(p) for p in self.id if not p.strip(SPACE))
        whole = self.merged(SPACE * (2 * longest))
        if whole == [SPACE * longest] * 2:  # long runs begin with pieces of the greatest length
            head = (n - longest) // longest
            return [self.id[SPACE * longest]] * head + self.runs[n - head * longest]
        return [self.id[p] for p in self.merged(SPACE * n)]

    def pieces(self, word: str) -> list[str]:
        """The prefix table of a word with one space mark at most, and the way back through it."""
        last: list[str | None] = [None] * len(word)
        compatible = self.compatible
        for end, (size, piece) in self.matches.iter(word):
            if last[end] is None:
                start = end - size
                if start < 0 or compatible[last[start] or word[start], piece]:
                    last[end] = piece
        out, at = [], len(word) - 1
        while at >= 0:
            out.append(last[at] or word[at])
            at -= len(out[-1])
        return out[::-1]

    def encode_word(self, word: str) -> list[int]:
        marks = len(word) - len(word.lstrip(SPACE))
        rest = self.pieces(word[marks - 1 :] if marks else word)
        ids: list[int] = []
        if marks > 1:
            alone = rest[0] == SPACE
            ids, rest = list(self.runs[marks - 1 + alone]), rest[alone:]
        for p in rest:
            i = self.id.get(p)
            ids += [i] if i is not None else [self.byte_id[b] for b in p.encode()] if self.byte_id else [self.unknown]
        return ids

    def decode_ids(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def word(self, word: str) -> tuple[int, str, str]:
        """Number of ids, the ids with commas, the text they decode to."""
        ids = self.encode_word(word)
        return len(ids), ",".join(map(str, ids)), self.decode_ids(ids)

    def split(self, text: str) -> list[str]:
        return _WORD.findall(self.library.normalize(text)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for w in self.split(text) for i in self.encode_word(w)]

    def decode(self, ids: list[int]) -> str:
        return self.decode_ids(ids).removeprefix(" ")

    def digests(self, text: str) -> tuple[int, str, str]:
        words = [self.words[w] if len(w) <= _SHORT else self.word(w) for w in self.split(text)]
        counts, ids, texts = zip(*words, strict=True) if words else ((), (), ())
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return sum(counts), sha(",".join(ids)), sha("".join(texts).removeprefix(" "))


def codec(path: str) -> PieceCodec:
    return resident(("pieces", path), lambda: PieceCodec(path))


def encode(text: Column, path: str) -> Column:
    """array<int> of the ids of each text."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = codec(path)
        for texts in batches:
            yield pa.array([pieces.encode(t) for block in byte_blocks(texts.to_pylist(), BLOCK_CHARS) for t in block], pa.list_(pa.int32()))

    return ids(text)


def decode(ids: Column, path: str) -> Column:
    """Text of each array<int>; null is empty."""

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = codec(path)
        for rows in batches:
            yield pa.array([pieces.decode(r or []) for r in rows.to_pylist()], pa.string())

    return text(ids)


def round_trip(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """df with n_tokens, ids_sha256 and decoded_sha256, which replace columns of these names: digests of encode() and
    of decode() of its ids, without moving the ids themselves between Python and Spark."""

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = codec(path)
        for texts in batches:
            rows = [pieces.digests(t) for block in byte_blocks(texts.to_pylist(), BLOCK_CHARS) for t in block]
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.string(), pa.string()))], ["n_tokens", "ids_sha256", "decoded_sha256"])
        give_back()

    out = df.withColumn("_digests", digests(F.col(text_col)))
    return put(out, **{c: F.col(f"_digests.{c}") for c in ("n_tokens", "ids_sha256", "decoded_sha256")}).drop("_digests")
