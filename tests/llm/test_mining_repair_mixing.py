"""op11, op12 and op13 against brute force, and their edge cases."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from convolytics.llm import mixing, phrases, repair

DOCS = "doc_id long, text string, lang string, source string, n long, size string"


# Phrases


def mined(rows, least, top, most=4):
    """(lang, rank, phrase, a, l, r, n, score) in plain Python."""
    counts, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        within = {p[i : i + k] for p, b in candidates.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * b >= 80 * f[p[i : i + k]]}
        found = []
        for p, a in candidates.items():
            if p not in within:
                score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("shard_bytes", "range_words", "least", "most"), [(1 << 20, 1 << 20, 3, 4), (200, 40, 2, 4), (50, 7, 2, 3), (300, 25, 2, 2), (400, 3, 1, 4)])
def test_phrases_equal_brute_force(spark, shard_bytes, range_words, least, most):
    rng = random.Random(range_words)
    words = ["a", "b", "the", "The", "é", "\U0001f600", "zz", "ab", "b\x01"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ""]) for _ in range(rng.randrange(60))) for _ in range(60)]
    rows = [(i, t, rng.choice(["en", "fr", None, "und", ""]), "s", 0, "x") for i, t in enumerate(texts)] + [(None, None, "en", None, 0, "x"), (7, "", "de", "", 0, "x"), (8, "the the " * 40, "en", "s", 0, "x")]
    docs = spark.createDataFrame(rows + rows[:5], DOCS).repartition(3)
    got = phrases.collocations(docs, least=least, top=15, most=most, shard_bytes=shard_bytes, range_words=range_words).collect()
    assert sorted(map(tuple, got)) == mined([(r[1], r[2]) for r in rows + rows[:5]], least, 15, most)


def test_phrases_of_an_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).count() == 0


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(phrases, "SLICE_BYTES", 7)
    assert [w for part in phrases.tokens(b"aa bb.cc dddddddddddddd  e,f") for w in part] == [b"aa", b"bb", b"\n", b"cc", b"dddddddddddddd", b"e", b"\n", b"f"]


def test_automata_share_states_and_compose():
    rng = random.Random(5)
    words = [b"a", b"b", b"c", b"d"]
    for _ in range(30):
        made = {tuple(rng.randrange(4) for _ in range(rng.randrange(1, 5))): rng.randrange(1, 4) for _ in range(rng.randrange(1, 40))}
        rows = np.array([[*p, *[-1] * (4 - len(p))] for p in sorted(made)])
        a = phrases.Automaton.load(phrases.Automaton.build(words, rows, np.array([made[p] for p in sorted(made)])).dump())
        states = [tuple(zip(*(x[a.first[s] : a.first[s + 1]].tolist() for x in (a.label, a.target, a.weight)), strict=True)) for s in range(len(a.first) - 1)]
        assert len(set(states)) == len(states)
        assert {k: v for k, v in phrases._phrases(a)} == {tuple(words[x] for x in p): c for p, c in made.items()}
        asked = sorted({tuple(rng.randrange(4) for _ in range(rng.randrange(1, 5))) for _ in range(20)})
        b = phrases.Automaton.build([b"a", b"bb", b"c", b"d"], np.array([[*p, *[-1] * (4 - len(p))] for p in asked]), np.ones(len(asked), np.int64))
        found, counts = a.compose(b)
        name = [b"a", b"bb", b"c", b"d"]
        got = {tuple(b.words[x] for x in r if x >= 0): c for r, c in zip(found.tolist(), counts.tolist(), strict=True)}
        assert got == {tuple(name[x] for x in p): 0 if 1 in p else made.get(p, 0) for p in asked}


def test_bounds_divide_common_words(spark):
    counts = spark.createDataFrame([("en", b"a", 100), ("en", b"b", 10), ("en", b"c", 10), ("fr", b"a", 10)], "lang string, word binary, f long")
    bounds = phrases.prefix_bounds(counts, 10)
    assert bounds == sorted(bounds) and ("en", b"a", b"b") in bounds and ("fr", b"a") in bounds


# Repair


def shortest(rows):
    """(cost, audit) of the best edits of [(letter, fault)] by a plain table over rows and states."""
    best = {0: (0, "")}

    def closed(now):
        now = dict(now)
        for _ in range(3):
            for q, (c, a) in list(now.items()):
                to = 3 if q == 2 else 2
                now[to] = min(now.get(to, (1 << 60, "")), (c + 5, a + "I"))
        return now

    for letter, fault in rows:
        new = {}
        more = 5 if fault == "truncated" else 0
        for q, (c, a) in closed(best).items():
            steps = [(q, c + 2, a + "D")]
            if fault not in ("blank", "duplicate"):
                steps += [(repair.NEXT[q, letter], c + more, a + "K")] if (q, letter) in repair.NEXT else []
                steps += [(repair.NEXT[q, x], c + 1 + more, a + "R") for x in "ua" if (q, x) in repair.NEXT]
            for to, cost, audit in steps:
                new[to] = min(new.get(to, (1 << 60, "")), (cost, audit))
        best = new
    return min(v for q, v in closed(best).items() if q in (0, 3))


def test_edits_equal_a_plain_table():
    rng = random.Random(1)
    cases = [list(c) for n in range(1, 4) for c in itertools.product(itertools.product("sua-", ("", "blank", "truncated")), repeat=n)]
    cases += [[(rng.choice("ssuuaa-"), rng.choice(["", "", "", "blank", "truncated"])) for _ in range(rng.randrange(4, 60))] for _ in range(200)]
    for rows in cases:
        got = repair.edits([x + f[:1] for x, f in rows], 0, -1)
        cost = sum(repair._COSTS[e] for edit in got for e in edit) + sum(5 for (_, f), edit in zip(rows, got, strict=True) if f == "truncated" and edit.strip("I") != "D")
        assert (cost, "".join(got)) == shortest(rows), rows


CONV = "conv_id long, turn long, role string, text string, extra string"


def _conversations(rng, n=40):
    out = []
    for c in range(n):
        for t in range(rng.randrange(12)):
            out.append((rng.choice([c, c, None]), rng.choice([t, None, t // 2]), rng.choice(["user", "assistant", "system", None, "", "tool"]), rng.choice(["Hi.", "No", "", " ", None, "So?\n", "é!", "a.b"]), "x"))
    return out


def test_blocks_do_not_change_a_repair(spark):
    rows = spark.createDataFrame(_conversations(random.Random(3)), CONV).repartition(5)
    whole = {r.conv_id: r for r in repair.report(rows).collect()}
    for bits in (0, 1, 3):
        assert {r.conv_id: r for r in repair.report(rows, bits).collect()} == whole
    assert len(whole) > 20


def test_repaired_rows_are_the_hashed_ones(spark):
    rows = spark.createDataFrame(_conversations(random.Random(4)), CONV)
    said = {}
    for r in repair.repaired(rows).orderBy("conv_id", "place").collect():
        said.setdefault(r.conv_id, []).append((r.role, r.text))
    for r in repair.report(rows).collect():
        own = said.get(r.conv_id, [])
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in own).encode()).hexdigest() == r.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(a[:1] for a, _ in own))


def test_repair_of_nulls_and_nothing(spark):
    rows = spark.createDataFrame([(None, None, None, None, "x"), (None, None, "user", "a.", "x"), (None, 4, "assistant", "b", "x")], CONV)
    (r,) = repair.report(rows).collect()
    assert (r.conv_id, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == (None, 0, 1, 0, 1, 1, 6, "DDD")
    assert repair.report(rows.limit(0)).count() == 0 and repair.report_damaged(rows.limit(0)).count() == 0


def test_conversations_without_rows_keep_a_line(spark):
    at = next(i for i in range(100) if spark.range(1).select(F.crc32(F.lit(f"{i}:0").cast("binary"))).first()[0] % 20 == 0)
    (r,) = repair.report_damaged(spark.createDataFrame([(at, 0, "user", "a.", "x")], CONV)).collect()
    assert tuple(r) == (at, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# Mixing


def filled(sizes):
    """Targets by raising one level until all is shared."""
    total = sum(sizes.values())
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    low, high = 0.0, 3.0 * total + 1
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(2 * sizes[s], weight[s] * mid) for s in sizes) < 1.5 * total:
            low = mid
        else:
            high = mid
    return {s: min(2 * sizes[s], weight[s] * high) for s in sizes}


@pytest.mark.parametrize("seed", range(4))
def test_mix_meets_its_targets(spark, seed):
    rng = random.Random(seed)
    sources = ["a", "b", "B", "", None, "é", "\U0001f600", "z"][: 3 + 2 * seed]
    weights = [rng.choice([1, 5, 30]) for _ in sources]
    rows = [(rng.choice([i, i, None]), "w " * rng.choice([0, 1, 3, 40]), "en", rng.choices(sources, weights)[0], 1, "x") for i in range(300)] + [(5, None, "en", "a", 1, "x")]
    rows += rows[:20]
    got = mixing.mix(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "lang", "source", "n", "size", "source_size", "target", "taken"}
    sizes, taken = Counter(), Counter()
    for r in got:
        assert r["size"] == len((r.text or "").split()) and 0 <= r.taken <= 2 * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
    want = filled(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-6)
    ties = Counter((r.doc_id, r.text) for r in got)
    for s in sizes:
        assert want[s] - 1 - max(ties.values()) <= taken[s] <= want[s] + 1e-6
    again = mixing.mix(spark.createDataFrame(rows[::-1], DOCS).repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_larger_budgets_keep_what_smaller_ones_take(spark):
    docs = spark.range(2000).select("id", F.lit("s").alias("source"), F.repeat(F.lit("w "), (F.col("id") % 7).cast("int")).alias("text"))
    small, large = ({r.id: r.taken for r in mixing.mix(docs, "id", budget=b).collect()} for b in ((1, 3), (1, 2)))
    assert all(small[i] <= large[i] for i in small) and sum(large.values()) == sum(i % 7 for i in range(2000)) // 2


def test_mixes_without_words_or_rows(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    rows = mixing.mix(spark.createDataFrame([(1, "", "en", "a", 1, "x"), (2, None, "en", None, 1, "x")], DOCS)).collect()
    assert [(r["size"], r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 2
