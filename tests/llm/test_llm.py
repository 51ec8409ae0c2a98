"""Edge cases and brute-force comparisons of the training-data operators, on small literal tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from convolytics.llm import ann, chat, components, decontam, html_text, jaccard, langid, piece_bpe, shingles, token_count, toxicity, warc

ODD = [None, "", " ", "   a  b", "\n", "don't 'sab x's !'s", "<|endoftext|> x<|startoftext|>y", "▁x▁▁y", "日本語 𝒳 é", "ﬁ ²³ ½ 12", "\x00a\x1cb", "word" * 3000, " " * 500 + "x", "ΑΣ İi", "</s> <0x0A> <s>", "é" * 70]


def docs(spark, texts, extra="lang string, n_tokens string, score string"):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(texts)], f"doc_id long, text string, {extra}")


def test_token_counts_are_the_librarys(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = token_count.count_tokens(docs(spark, ODD * 2), path).orderBy("doc_id").collect()
    assert [r.n_tokens for r in rows] == [len(t.encode(x or "", add_special_tokens=False)) for x in ODD * 2]
    assert rows[0].n_bytes == 0 and rows[11].over_limit and rows[0].lang == "x"
    assert token_count.count_tokens(docs(spark, []), path).count() == 0


def test_pieces_are_the_librarys(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    df = docs(spark, ODD)
    ids = df.select("doc_id", piece_bpe.encode(F.col("text"), path).alias("ids"))
    back = ids.select("ids", piece_bpe.decode(F.col("ids"), path).alias("text"), "doc_id").orderBy("doc_id").collect()
    want = [lib.encode(x or "") for x in ODD]
    assert [r.ids for r in back] == want and [r.text for r in back] == [lib.decode(x) for x in want]
    out = piece_bpe.round_trip(df, path).orderBy("doc_id").collect()
    assert [r.ids_sha256 for r in out] == [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in want]


def test_pairs_stay_apart_as_merging_says():
    k = piece_bpe.PieceCodec(public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(0)
    tokens = [p for p in k.halves if len(p) < 8]
    for a, b in (rng.choice(tokens, 2) for _ in range(3000)):
        assert k.stay_apart(a, b) == (k.merged(a + b) == [a, b]), (a, b)


def test_languages(spark):
    said = {"a": "the cat and the dog were there", "b": "der hund und die katze sind da"}
    rows = [(i, " ".join([said["ab"[i % 2]]] * (3 + i % 4)), "ab"[i % 2]) for i in range(40)] + [(90, None, "a"), (91, "12 !?", "a"), (92, "und die katze", None)]
    out = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(out[i].lang_pred == "ab"[i % 2] and 0.5 <= out[i].score <= 1 for i in range(40))
    assert out[90].lang_pred == out[91].lang_pred == "und" and out[90].score == 0 and out[92].lang_pred == "b"
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(40))
    empty = spark.createDataFrame([(1, "x", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.identify(empty).collect()] == ["und"]


def test_longest_matches_are_those_of_a_direct_parse():
    ref, text = "abracadabra banana", "cadabrana zzz banabra"
    p = langid.Parser({"x": ref})
    codes, known = p.letters.codes(text).tolist(), p.letters.codes(ref).tolist()
    at = lambda sub: any(known[i : i + len(sub)] == sub for i in range(len(known)))
    n, i = 0, 0
    while i < len(codes):
        m = 1
        while i + m < len(codes) and at(codes[i : i + m + 1]):
            m += 1
        i, n = i + m, n + 1
    rates, _ = p.rates([text])
    assert math.isclose(rates[0][0] * len(codes) / p.bits[0], n)


def test_toxicity_learns_from_document_labels(spark):
    rng = np.random.default_rng(1)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows = []
    for i in range(600):
        sentences = [" ".join(rng.choice(words, 8)) for _ in range(rng.integers(1, 9))]
        if i % 5 == 0:
            sentences[0] += " vilestuff"
        rows.append((i, ". ".join(sentences), int(i % 5 == 0)))
    d = spark.createDataFrame([r[:2] for r in rows] + [(9001, None), (9002, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.score(d, labels).collect()}
    assert all(out[i].predicted == y for i, _, y in rows) and out[9001].score == out[9002].score == 0
    model = toxicity.fit([r[1] for r in rows], [r[2] for r in rows])
    spans = spark.createDataFrame([("all fine. a vilestuff here! ok",)], "t string").select(toxicity.offending(F.col("t"), model)).first()[0]
    assert [(s.start, s.end) for s in spans] == [(9, 27)]
    assert toxicity.score(d, labels.limit(0)).where("predicted = 1").count() == 0


def test_chat_events_fold_into_messages(spark):
    events = [(1, 0, "message", "u", "user", "hi <|end|> [INST] \\ x"), (1, 1, "message", "a", "assistant", ""), (1, 2, "delta", "a", "assistant", "wrong"), (1, 3, "regenerate", "a", "assistant", None), (1, 4, "delta", "a", "assistant", "ri"), (1, 5, "delta", "a", "assistant", "ght"), (1, 6, "edit", "u", "user", "hello\n</s>"), (1, 7, "message", "gone", "user", "x"), (1, 8, "delete", "gone", "user", None), (2, 0, "message", None, None, None)]
    e = spark.createDataFrame(events, "conv_id long, seq long, kind string, ref string, role string, text string")
    parts = chat.format_chats(e)
    text = {r.conv_id: r.formatted for r in parts.collect()}
    assert "</s>" not in text[1] and "[INST]" not in text[1] and text[1].count(chat.END) == 2
    out = {r.conv_id: r for r in chat.read_back(parts).collect()}
    assert out[1].turns_sha256 == hashlib.sha256(b"user\nhello\n</s>\nassistant\nright\n").hexdigest()
    assert out[1].loss_sha256 == hashlib.sha256(b"right").hexdigest() and out[1].loss_chars == 5
    assert out[2].n_turns == 1 and out[2].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest() and out[1].formatted_chars == len(text[1])
    assert chat.format_chats(e.limit(0)).count() == 0


def test_chat_query_goes_through_the_fold(spark, monkeypatch):
    from convolytics.llm import queries

    seen, real = [], chat.format_chats
    monkeypatch.setattr(chat, "format_chats", lambda events: seen.append(events) or real(events))
    out = queries.op3_chat_formatting(spark, "/root/testdata/sf0.001")
    assert {r.kind for r in seen[0].select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"} and seen[0].where("ref is null").count() == 0
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    said = collections.defaultdict(list)
    for r in sorted([tuple(r) for r in rows] + [(-1, i, x, "</s>[INST] ok [/INST]") for i, x in enumerate(("user", "assistant"))]):
        said[r[0]].append(f"{r[2]}\n{r[3]}\n")
    assert {r.conv_id: (r.n_turns, r.turns_sha256) for r in out.collect()} == {c: (len(x), hashlib.sha256("".join(x).encode()).hexdigest()) for c, x in said.items()}
    odd = spark.createDataFrame([(1, 0, None, None), (1, 1, "user", ""), (1, 1, "user", ""), (1, 2, "user", "é𝒳x"), (2, None, "user", "z")], "conv_id long, turn long, role string, text string")
    got = chat.messages(queries.chat_log(odd)).collect()
    assert sorted((r.conv_id, r.role or "", r.text) for r in got) == [(1, "", ""), (1, "user", ""), (1, "user", ""), (1, "user", "é𝒳x"), (2, "user", "z")]


@pytest.mark.parametrize("text", ["", "\\<[", "<\\|", "[INST]</s><|turn|>", "a\\\\b<[\\"])
def test_escapes_are_reversible(text):
    assert chat.unescape(chat.escape(text)) == text


def test_long_conversations_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_CHARS", 50)
    e = spark.createDataFrame([(1, i, "message", None, "assistant", f"text {i}") for i in range(20)], "conv_id long, seq long, kind string, ref string, role string, text string")
    out = chat.read_back(chat.format_chats(e)).first()
    assert out.n_turns == 20 and out.loss_sha256 == hashlib.sha256("".join(f"text {i}" for i in range(20)).encode()).hexdigest()


def test_main_text(spark):
    page = """<html><head><title>T</title></head><body class="has-sidebar"><header>Site</header><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies, really</div>
    <div class=wrap><article><h1>Head &amp; more</h1><p>First,   one<br>two <b>bold</b><p>Second&nbsp;x <script>var a="</p>";</script></p><ul><li>Item</ul><div class="ad">Buy, now, please</div><section id="comments"><p>Nice, very nice, I think, yes</p></section></article></div>
    <aside>Side</aside><form>f</form><footer>&copy; x</footer>"""
    assert html_text.main_text(page) == "Head & more\nFirst, one two bold\nSecond x\nItem"
    assert html_text.main_text("<div><p>Some text, long enough to count, and more of it.</p><p>Second paragraph, also here.</p></div><div class=menu><a href=x>a</a></div>") == "Some text, long enough to count, and more of it.\nSecond paragraph, also here."
    df = spark.createDataFrame([(1, None, "old"), (2, "", "old"), (3, "<p>a<b>b</b> c", "old")], "page_id long, html string, text string")
    assert [(r.text, r.n_chars) for r in html_text.extract_text(df).orderBy("page_id").collect()] == [("", 0), ("", 0), ("ab c", 4)]


def test_nearest_neighbours_with_copies_and_unusable_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    x[50:90] = x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [1.0] * 7 + [float("nan")]), (903, [1.0, None] * 4), (904, [1.0] * 3)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = ann.knn(v, v.where("vec_id % 20 = 0"), leaf_rows=32, sample_rows=100).collect()
    got = collections.defaultdict(list)
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
    found = 0
    for q in range(0, 300, 20):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(300), d)).tolist() if i != q][:10]
        assert len(got[q]) == 10 and all(abs(s - d[i]) < 1e-12 for i, s in got[q])
        found += len({i for i, _ in got[q]} & set(best))
    assert found >= 0.9 * 150 and set(got) == set(range(0, 300, 20))
    assert [i for i, _ in got[60]] == [5, *range(50, 59)]
    few = spark.createDataFrame(rows[:3], v.schema)
    assert ann.knn(few, few.where("vec_id = 0")).count() == 2 and ann.knn(v.limit(0), v.limit(0)).count() == 0


def test_nearest_neighbours_scan_few_rows_of_structured_vectors(spark):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(400, 32)), 50, 0) + 0.15 * rng.normal(size=(20_000, 32))
    ids = range(len(x))
    v = spark.createDataFrame([(i, r) for i, r in zip(ids, x.tolist(), strict=True)], "vec_id long, embedding array<double>").repartition(4).cache()
    q = v.where("vec_id % 200 = 0")
    distinct, points = v.select(F.col("vec_id").alias("rep"), F.col("embedding").alias("v")), q.select(F.col("vec_id").alias("point"), F.col("embedding").alias("v"))
    forest = ann.grow_forest(distinct, points, len(x), 10, 12, 65_536, 64, 64, 0.95)
    leaves = forest.leaf_of(x)
    assert max(np.bincount(leaves[:, t]).max() for t in range(12)) <= 72
    scanned = [sum((leaves[:, c >> 32] == (c & 0xFFFFFFFF)).sum() for c in ann.search(forest.trees, x[i], forest.threshold).tolist()) for i in range(0, len(x), 200)]
    assert np.mean(scanned) < 0.05 * len(x)
    out, found = ann.knn(v, q).collect(), 0
    for i in range(0, len(x), 200):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        got = {r.vec_id: r.score for r in out if r.query_id == i}
        assert all(abs(s - d[j]) < 1e-9 for j, s in got.items())
        found += len(set(np.argsort(d, kind="stable")[1:11].tolist()) & set(got))
    assert found >= 0.9 * 1000


def test_nearest_neighbours_with_repeated_ids_ties_and_clashing_names(spark):
    rows = [(0, [0.0, 1.0], 9, 9.0), (1, [1.0, 0.0], 9, 9.0), (1, [0.0, 1.0], 9, 9.0), (1, [0.0, 1.0], 9, 9.0), (5, [0.0, 2.0], 9, 9.0), (4, [0.0, 0.5], 9, 9.0), (3, [0.0, 1.5], 9, 9.0), (None, [0.0, 1.0], 9, 9.0)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score double")
    out = [(r["rank"], r.vec_id, round(r.score, 6)) for r in ann.knn(v, v.where("vec_id = 0"), k=5).orderBy("rank").collect()]
    assert out == [(1, 1, 0.0), (2, 1, 0.0), (3, 3, 0.5), (4, 4, 0.5), (5, 5, 1.0)]


def test_decontamination_against_all_windows(spark):
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(30)] + ["É", "é"]
    items = [" ".join(rng.choice(vocab, n)) for n in (13, 20, 40, 5, 1, 12)] + ["the " * 30, None, "!!"]
    texts = [None, "", "a b", items[0], f"x {items[1].upper()}, y", items[2][:60], f"{items[3]}. {items[3]}", items[4], "the " * 50] + [" ".join(rng.choice(vocab, 60)) + " " + items[i % 6] for i in range(20)]
    b = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_hit string")
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    out = {r.doc_id: r for r in decontam.decontaminate(d, b).collect()}
    for i, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for j, item in enumerate(items):
            x = words(item)
            n = min(13, len(x))
            for a in range(len(x) - n + 1) if n else ():
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == x[a : a + n]:
                        hit.update(range(at, at + n))
                        found.add(str(j))
        r = out[i]
        assert (r.n_words, r.n_hit, r.item_ids) == (len(w), len(hit), sorted(found)), i
        assert r.contaminated == (bool(hit) and 20 * len(hit) >= len(w))
    assert decontam.decontaminate(d, b.limit(0)).where("contaminated").count() == 0


def test_decontamination_of_capital_sigmas(spark):
    item = " ".join(f"ΛΟΓΟΣ{i}.ΣΟΣ.Α" for i in range(12))
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    d = spark.createDataFrame([(1, item), (2, f"x {item} y")], "doc_id long, text string")
    assert {r.doc_id: r.contaminated for r in decontam.decontaminate(d, b).collect()} == {1: True, 2: True}


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u1", "same"), (2, None, "same"), (3, "u3", None), (4, "u4", ""), (5, "u5\r\nX: y", "a\r\n\r\nWARC/1.1 b é")], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"))
    archive = warc.read(spark, str(tmp_path / "w"))
    out = {r.page_id: r for r in archive.collect()}
    assert [(out[i].record_type, out[i].refers_to) for i in range(1, 6)] == [("response", None), ("revisit", 1), ("response", None), ("revisit", 3), ("response", None)]
    assert out[5].payload.decode() == "a\r\n\r\nWARC/1.1 b é" and out[2].payload is None and out[2].payload_bytes == 4
    assert {r.page_id: r.payload for r in warc.restore(archive).collect()}[2] == b"same"
    warc.write(pages.limit(0), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


def test_warc_of_a_recrawled_page(spark, tmp_path):
    rows = [(1, "a"), (2, "b"), (3, "a"), (3, "b"), (3, "own"), (4, "own"), (1, "other")]
    warc.write(spark.createDataFrame([(i, f"u{i}", h) for i, h in rows], "page_id long, url string, html string"), str(tmp_path / "w"))
    archive = warc.read(spark, str(tmp_path / "w"))
    kinds = {(1, "a", None), (2, "b", None), (3, "a", 1), (3, "b", 2), (3, "own", None), (4, "own", 3), (1, "other", None)}
    out = warc.restore(archive).collect()
    assert len(out) == len(rows) and {(r.page_id, r.payload.decode(), r.refers_to) for r in out} == kinds
    assert archive.where("record_type = 'response'").count() == 4


def brute_components(texts, k=5, percent=75):
    """Components and set sizes by the contract's words, without the operator's code."""
    lower, sets = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)}), []
    for t in texts:
        w = re.findall("[^\\x20\\x09-\\x0d]+", (t or "").translate(lower))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()})
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def near_copies(seed, groups, size, words=40, changes=3):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        base = [f"g{g}w{x}" for x in rng.integers(0, 500, words)]
        for _ in range(size):
            w = list(base)
            for p in rng.integers(0, words, rng.integers(0, changes)):
                w[p] = f"e{rng.integers(0, 9)}"
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize("how", [{}, {"max_sets": 5, "region_sets": 5, "n_pivots": 3}, {"max_sets": 6, "depth": 0}, {"cell_shingles": 300, "n_pivots": 4, "depth": 1}])
def test_jaccard_join_is_exact(spark, how):
    texts = [None, "", "a b", "A  b", "a", *near_copies(1, 3, 14), *near_copies(2, 2, 14, changes=9), "x y z " * 30, "x y z " * 31, "q " * 20_000, "a\x0bb\x1cc d e f"]
    want, sizes = brute_components(texts)
    d = spark.createDataFrame([(i, t, 1, 7) for i, t in enumerate(texts)], "doc_id long, text string, component_id int, id int")
    out = {r.doc_id: r for r in jaccard.near_duplicates(d, **how).collect()}
    assert [out[i].component_id for i in range(len(texts))] == want and [out[i].n_shingles for i in range(len(texts))] == sizes
    assert out[3].id == 7 and len(set(want)) > 8


def test_voronoi_regions_divide_large_cells(spark, monkeypatch):
    seen, real = [], jaccard.regions
    monkeypatch.setattr(jaccard, "regions", lambda s, *how: seen.append((s.count(), s.where("done").count())) or real(s, *how))
    texts = near_copies(3, 1, 150, words=60, changes=2) + near_copies(4, 1, 80, words=60, changes=5)
    want, _ = brute_components(texts)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(d, region_sets=20).collect()} == dict(enumerate(want))
    assert len(seen) > 1 and seen[0][1] > 0.4 * seen[0][0]


def test_jaccard_join_of_repeated_and_null_ids(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(12)) for x in "ab")
    rows = [(4, a), (4, b), (4, b), (2, b), (9, a), (None, a), (None, None), (7, None), (7, None), (7, a), (1, "other words")]
    d = spark.createDataFrame([(*r, "s") for r in rows], "id long, text string, n string")
    out = jaccard.near_duplicates(d, id_col="id")
    got = collections.Counter((r.id, r.text, r.component_id) for r in out.collect())
    assert got == collections.Counter([(4, a, 4), (4, b, 2), (4, b, 2), (2, b, 2), (9, a, 4), (None, a, None), (None, None, None), (7, None, 7), (7, None, 7), (7, a, 4), (1, "other words", 1)])
    left = collections.Counter((r.id, r.text) for r in jaccard.survivors(d, id_col="id").collect())
    assert left == collections.Counter([(4, a), (2, b), (None, a), (None, None), (7, None), (7, None), (1, "other words")])
    assert jaccard.near_duplicates(d.limit(0), id_col="id").count() == 0 and out.columns == ["id", "text", "n", "n_shingles", "component_id"]


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    out = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert out == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_components_plan_what_made_the_links_once(spark, monkeypatch):
    """A round's plan reads its links several times, which have to be written by then."""
    planned, write = [], components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, name: planned.append(df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")) or write(df, name))
    links = spark.range(1, 6).selectExpr("id a", "id - 1 b").mapInArrow(lambda batches: batches, "a long, b long")
    assert {r.component for r in components.components(links, "a", "b").collect()} == {0} and max(planned) == 1


def test_components_of_a_hub_that_is_no_least_node(spark):
    links = [(500, i) for i in range(1, 1000) if i != 500] + [(5000, 999)]
    out = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert out == {**{i: 1 for i in range(1, 1000)}, 5000: 1}


def test_cell_components_match_brute_force():
    import numpy as np

    from convolytics.llm.jaccard import Cell

    rng = np.random.default_rng(1)
    for _ in range(60):
        base, sets = [set(rng.choice(200, 40, replace=False).tolist()) for _ in range(4)], []
        for _ in range(25):
            s = set(base[rng.integers(4)])
            for _ in range(rng.integers(0, 9)):
                s.discard(int(rng.choice(sorted(s))))
                s.add(int(rng.integers(200, 400)))
            sets.append(s)
        ids = rng.permutation(25) + 7
        cell = Cell(ids, [np.array(sorted(s), np.int64) for s in sets], 75)
        root, changed = {int(i): int(i) for i in ids}, True
        while changed:
            changed = False
            for a in range(25):
                for b in range(a):
                    x, y = int(ids[a]), int(ids[b])
                    if root[x] != root[y] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                        root[x] = root[y] = min(root[x], root[y])
                        changed = True
        assert dict(zip(cell.ids.tolist(), cell.components().tolist(), strict=True)) == root
