"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns of the operators."""

import collections
import hashlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from convolytics.llm import chat, decontam, html_text, langid, piece_bpe, queries, token_count, toxicity, warc

SMALL = "/root/testdata/sf0.001"


def test_language_of_long_texts_ties_repeats_and_clashes(spark):
    parser = langid.Parser({"a": "abc" * 2000, "b": "xyz"})
    rates, _ = parser.rates([("abc" * 2000)[:4096], "ab" + "語" * 3])
    assert round(rates[0][0] * 4096 / parser.bits[0]) == 1 and round(rates[0][1] * 5 / parser.bits[0]) == 4
    cjk = "".join(chr(0x4E00 + i) for i in range(3000))
    parser = langid.Parser({"zh": cjk, "en": "the cat sat"})
    assert round(parser.rates([cjk])[0][1][0] * 3000 / parser.bits[1]) == 1
    rows = [(i, "bonjour le monde entier " * 1500, "fr", "x") for i in range(8)] + [(i, "good morning whole world", "en", "x") for i in range(8, 40)]
    rows += [(50, "bonjour monde", None, "x"), (50, "bonjour monde", None, "x"), (51, "qqq", None, "x"), (52, None, "fr", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    out = langid.identify(d)
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append((r.lang_pred, r.score))
    assert all(got[i][0][0] == "fr" for i in range(8)) and [p for p, _ in got[50]] == ["fr", "fr"] and got[52][0] == ("und", 0.0)
    tie = langid.Parser({"b": "abab", "a": "abab"}).predict(["ab"])
    assert tie == (["a"], [0.5]) and langid.identify(d.limit(0)).count() == 0 and sorted(out.columns) == sorted([*d.columns, "held_out", "lang_pred"])


def test_toxicity_of_long_repeated_and_empty_rows(spark):
    rows = [(i, f"fine words {i}. " + ("vilestuff here. " if i % 3 == 0 else "more words. "), "old", "old") for i in range(300)]
    rows += [(0, "vilestuff. ", "old", "old"), (900, "fine words. " * 30_000 + "vilestuff here.", "old", "old"), (901, "", "old", "old"), (901, "", "old", "old")]
    d = spark.createDataFrame(rows, "doc_id long, text string, score string, predicted string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(5, None), (6, 7)], "doc_id long, toxic int")
    out = toxicity.score(d, labels, max_text_chars=1000)
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append(r.predicted)
    assert got[900] == [1] and got[901] == [0, 0] and sum(got[i][0] for i in range(300) if i % 3) == 0 and len(got[0]) == 2
    assert toxicity.score(d.limit(0), labels).count() == 0


def test_counts_and_pieces_of_long_words_and_empty_tables(spark):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    words, pieces = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
    lib, sp = Tokenizer.from_file(words), SentencePieceProcessor(model_file=pieces)
    texts = ["ab1" * 40_000, "longword" * 100 + "!!", "longword" * 100, None, "x y", "x y", "é語 " * 3000]
    d = spark.createDataFrame([(i, t, "c", "c") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes string, ids_sha256 string")
    counted = {r.doc_id: r for r in token_count.count_tokens(d, words).collect()}
    assert [counted[i].n_tokens for i in range(len(texts))] == [len(lib.encode(t or "", add_special_tokens=False)) for t in texts]
    assert [counted[i].n_bytes for i in range(len(texts))] == [len((t or "").encode()) for t in texts]
    counter = token_count.WordCounter(words)
    counter.count(texts[:1])
    assert max(map(len, counter.known)) <= token_count.LONG_WORD
    tripped = {r.doc_id: r for r in piece_bpe.round_trip(d, pieces).collect()}
    for i, t in enumerate(texts):
        ids = sp.encode(t or "")
        sha = hashlib.sha256(sp.decode(ids).encode()).hexdigest()
        assert (tripped[i].n_tokens, tripped[i].ids_sha256, tripped[i].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), sha)
    assert piece_bpe.round_trip(d.limit(0), pieces).count() == token_count.count_tokens(d.limit(0), words).count() == 0


def test_chat_events_without_references_ties_and_clashes(spark):
    events = [(1, 0, "delta", None, "user", "a"), (1, 1, "message", None, "user", "b"), (1, 2, "edit", None, "user", "c"), (1, 3, "message", None, "assistant", ""), (1, 4, "regenerate", None, "assistant", None)]
    events += [(1, 5, "delta", None, "assistant", "d"), (1, 6, "message", None, "user", "gone"), (1, 7, "delete", None, "user", None), (2, 0, "message", "r", "user", "x"), (2, 0, "message", "r", "user", "x"), (2, 1, "message", "s", "user", "x")]
    log = spark.createDataFrame([(*e, "p", "f") for e in events], "conv_id long, seq long, kind string, ref string, role string, text string, part string, formatted string")
    got = sorted((r.conv_id, r.seq, r.role, r.text) for r in chat.messages(log).collect())
    assert got == [(1, 0, "user", "a"), (1, 1, "user", "c"), (1, 3, "assistant", "d"), (2, 0, "user", "x"), (2, 1, "user", "x")]
    assert {r.conv_id: r.n_turns for r in chat.read_back(chat.format_chats(log)).collect()} == {1: 3, 2: 2}


def test_pages_by_classes_references_depth_and_repeats(spark):
    text = html_text.main_text
    assert text('<div class="content has-sidebar">article, text</div>') == "article, text"
    assert text('<div class="article-header"><h1>Title</h1></div><p>One, two, three.</p>') == "Title\nOne, two, three."
    assert text("<p>AT&<b>amp;</b> and &lt<i>;</i> x &amp; &#x41;</p>") == "AT&amp; and <; x & A"
    assert text('<div class="post-comments"><p>Nice, very nice, so nice, really</p></div><div class="post"><p>The text, as it is.</p></div>') == "The text, as it is."
    assert text("<div><p>aa, bb" * 20_000).count("aa, bb") == 20_000 and text("<div></b>" * 20_000) == ""
    long = "<article>" + "<p>word, word</p>" * 50_000 + "</article>"
    d = spark.createDataFrame([(1, long, 0, "u"), (2, "<p>x</p>", 0, "u"), (2, "<p>x</p>", 0, "u"), (None, None, 0, None)], "page_id long, html string, n_chars int, url string")
    out = html_text.extract_text(d)
    assert sorted((r.page_id or 0, r.n_chars) for r in out.collect()) == [(0, 0), (1, 50_000 * 11 - 1), (2, 1), (2, 1)]
    assert html_text.extract_text(d.limit(0)).count() == 0


def test_decontamination_of_empty_and_repeated_documents(spark):
    b = spark.createDataFrame([(7, "one two three"), (8, "Q")], "item_id long, text string")
    d = spark.createDataFrame([(1, "x one two three y", "a"), (1, "x one two three y", "a"), (1, "other", "a"), (None, "q", "a"), (None, "z", "a")], "doc_id long, text string, item_id string")
    got = collections.Counter((r.doc_id, r.text, r.n_hit, r.contaminated) for r in decontam.decontaminate(d, b).collect())
    assert got == collections.Counter([(1, "x one two three y", 3, True)] * 2 + [(1, "other", 0, False), (None, "q", 1, True), (None, "z", 0, False)])
    assert decontam.decontaminate(d.limit(0), b).count() == 0


def test_archives_are_rolled_by_bytes(spark, tmp_path):
    big = "b" * 3_000_000
    rows = [(1, "u", "small", "x"), (2, "u", big, "x"), (3, "u", big, "x"), (None, "u", "small", "x"), (4, None, "m" * 40_000, "x"), (5, "u", big + "c", "x")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string").coalesce(1)
    warc.write(d, str(tmp_path / "w"))
    files = [p.stat().st_size for p in (tmp_path / "w").rglob("part-*")]
    out = warc.restore(warc.read(spark, str(tmp_path / "w"))).collect()
    assert max(files) < 3_010_000 and sorted((r.page_id or 0, len(r.payload), r.record_type) for r in out) == [(0, 5, "response"), (1, 5, "response"), (2, len(big), "response"), (3, len(big), "revisit"), (4, 40_000, "response"), (5, len(big) + 1, "response")]


def test_registered_queries_give_the_contracts_columns(spark):
    wanted = {
        "op1_token_counts": "doc_id n_bytes n_tokens over_limit", "op2_language_id": "doc_id held_out lang_pred score", "op4_toxicity": "doc_id held_out score predicted",
        "op5_html_extraction": "page_id url text n_chars", "op6_sentencepiece": "doc_id n_tokens ids_sha256 decoded_sha256", "op7_nearest_neighbours": "query_id rank vec_id score",
    }
    for name, columns in wanted.items():
        out = queries.QUERIES[name](spark, SMALL)
        assert out.columns == columns.split() and out.count() > 0
    embeddings = spark.read.parquet(f"{SMALL}/embeddings.parquet").where(F.col("embedding").isNotNull()).orderBy("vec_id").collect()
    x, found, out = np.array([r.embedding for r in embeddings]), 0, queries.QUERIES["op7_nearest_neighbours"](spark, SMALL).collect()
    at = {r.vec_id: i for i, r in enumerate(embeddings)}
    for q in {r.query_id for r in out}:
        d = np.sqrt(((x - x[at[q]]) ** 2).sum(1))
        best = [embeddings[i].vec_id for i in np.argsort(d, kind="stable") if embeddings[i].vec_id != q][:10]
        found += len(set(best) & {r.vec_id for r in out if r.query_id == q})
    assert found >= 0.9 * len(out)


def test_queries_match_their_sql(spark):
    import oracle

    con = oracle.connect(SMALL)
    for name, sql in queries.ORACLE_SQL.items():
        assert oracle.compare(con, queries.QUERIES[name](spark, SMALL), sql) == "", name
