"""Token counts of whole texts, as a public tokenizer's library gives them.

The Arrow function returns lengths only. Texts are cut at blanks, tabs and line ends, where no token of this tokenizer
can cross (its normalizer turns white space into one blank and its pre-tokenizer drops it), so a long text never goes
to the library in one piece, and the count of a text is the sum over its words. A memo keeps the counts of words seen
before; unseen ones go to the library in batches of about equal bytes.

Null and empty texts have 0 tokens. Special strings inside a word stay in one piece, so that the library finds them; a
word without any blank stays whole, however long it is (the library's merging takes n log n time), and only short words
are remembered. Repeated rows count alike, columns of the results' names are replaced, empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolytics.llm.common import byte_blocks, put, resident

BATCH_BYTES, MEMO_WORDS, LONG_WORD = 1 << 20, 600_000, 256
#: Letters, then perhaps ASCII punctuation but the apostrophe: the pre-tokenizer always cuts between the two.
_CUT = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_BLANK = str.maketrans("\n\t\r", "   ")


class WordCounter:
    """Counts tokens of single words; knows those it has seen."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.encode = library.encode_batch_fast
        self.ends_word = np.array([(library.id_to_token(i) or "").endswith("</w>") for i in range(library.get_vocab_size())])
        self.known: dict[str, int] = {"": 0}

    def learn(self, words: set[str]) -> None:
        """Words of letters only go to the library joined by blanks: the last token of each one is marked as such."""
        if len(self.known) > MEMO_WORDS:
            self.known = {"": 0}
        known, cut = self.known, {w: m.groups() for w in words if (m := _CUT.fullmatch(w))}
        letters = list({a.lower() for a, _ in cut.values()} - known.keys())
        others = list(({b for _, b in cut.values()} | (words - cut.keys())) - known.keys())
        for block in byte_blocks(letters, BATCH_BYTES // 16):
            ids = np.array(self.encode([" ".join(block)], add_special_tokens=False)[0].ids)
            known.update(zip(block, np.diff(np.flatnonzero(self.ends_word[ids]), prepend=-1).tolist(), strict=True))
        for block in byte_blocks(others, BATCH_BYTES // 16):
            known.update(zip(block, (len(e.ids) for e in self.encode(block, add_special_tokens=False)), strict=True))
        known.update({w: known[a.lower()] + (known[b] if b else 0) for w, (a, b) in cut.items()})

    def count(self, texts: list[str]) -> list[int]:
        split = [t.translate(_BLANK).split(" ") if len(t) < 64 else t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        seen = set().union(*split)
        if new := seen - self.known.keys():
            self.learn(new)
            if missing := seen - self.known.keys():  # the memo has started again
                self.learn(missing)
        get = self.known.__getitem__
        counts = [sum(map(get, words)) for words in split]
        for w in new:
            if len(w) > LONG_WORD:
                self.forget(w)
        return counts

    def forget(self, word: str) -> None:
        """Long words aren't remembered, so that the memo's bytes are bounded."""
        cut = _CUT.fullmatch(word)
        for w in (word, *((cut[1].lower(), cut[2]) if cut else ())):
            if len(w) > LONG_WORD:
                self.known.pop(w, None)


def _counter(path: str) -> WordCounter:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return resident(("counts", path), lambda: WordCounter(path))


def n_tokens(text: Column, path: str) -> Column:
    """Column of the number of tokens of each text."""

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _counter(path)
        for texts in batches:
            yield pa.array([n for block in byte_blocks(texts.to_pylist(), BATCH_BYTES) for n in counter.count(block)], pa.int64())

    return count(text)


def count_tokens(df: DataFrame, path: str, text_col: str = "text", limit: int = 2048) -> DataFrame:
    """df with n_bytes, n_tokens and over_limit (more than limit tokens); columns of these names are replaced."""
    text = F.col(text_col)
    out = put(df, n_bytes=F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), n_tokens=n_tokens(text, path))
    return put(out, over_limit=F.col("n_tokens") > limit)
