"""Operators on one text at a time: URL filters, rules, extraction, packing, codecs, classifiers."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash

from netweave.llm import html_extract, packing, quality_model, quality_rules, sentencepiece_codec, toxicity, url_filter
from netweave.llm.common import mix64
from netweave.llm.tokens import byte_bpe
from tests.llm import brute
from tests.llm.tables import PAGES, corpus, documents

URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "https://A.Example.NET/en/x?q=/de/", "http://example.net/en", "http://xexample.net/en/", "http://example.com/de/",
    "http://sub.example.com/de/a#b", "http://example.com/dex", "http://org/fr/", "http://a.b.org/fr/z", "http://a.b.org?/fr/", "http://ORG/fr/x://y", "http://net.org/", "x://y..net/", "http://.net/", "http://É.NET/",
]


def test_url_filter(spark):
    rows = [(i, u, "") for i, u in enumerate(URLS * 2)] + [(None, "http://net/", "")]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS host", "'x' AS key", "2 AS kind")
    found = url_filter.filter_urls(pages, url_filter.rule_table(spark), parts=3).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.page_id is not None:
            assert (r.host, r.path, r.rule, r.verdict) == brute.judge_url(rows[r.page_id][1])


def test_url_filter_random_rules(spark):
    rng = random.Random(1)
    host = lambda: ".".join(rng.choice("ab") for _ in range(rng.randint(1, 4)))
    rules = list({(h, p): (rng.choice(["block", "allow"]), h, p) for h, p in ((host(), rng.choice(["/", "/a", "/a/b"])) for _ in range(25))}.values())
    urls = [f"http://{host()}{rng.choice(['', '/', '/a', '/a/b/c', '/b'])}" for _ in range(300)]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], PAGES)
    for r in url_filter.filter_urls(pages, url_filter.rule_table(spark, rules), parts=5).collect():
        want = brute.judge_url(urls[r.page_id], rules)
        assert (r.host, r.path) == want[:2] and len(r.rule or "") == len(want[2] or "")


def test_url_filter_with_many_rules_on_one_host(spark):
    rng = random.Random(8)
    paths = {"/" + "/".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(1, 6))) for _ in range(12_000)}
    rules = [(rng.choice(["block", "allow"]), rng.choice(["hot.net", "a.hot.net", "net"]), p) for p in sorted(paths)][:10_000]
    urls = [f"http://{rng.choice(['hot.net', 'a.hot.net', 'b.a.hot.net', 'net'])}{rng.choice(rules)[2]}{rng.choice(['', '/x', 'zz'])}" for _ in range(150)]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], PAGES)
    stacks = url_filter.rule_stacks(url_filter.rule_table(spark, rules))
    assert stacks.selectExpr("max(size(stack))").first()[0] < 30  # nested rules only, not all rules of the host
    for r in url_filter.filter_urls(pages, url_filter.rule_table(spark, rules), parts=6).collect():
        assert (r.host, r.path, r.rule, r.verdict) == brute.judge_url(urls[r.page_id], rules), urls[r.page_id]


def test_operators_on_empty_tables(spark):
    docs, pages = documents(spark, []), spark.createDataFrame([], PAGES)
    assert url_filter.filter_urls(pages, url_filter.rule_table(spark)).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/", "")], PAGES)
    assert [r.verdict for r in url_filter.filter_urls(one, url_filter.rule_table(spark).limit(0)).collect()] == ["allow"]
    assert html_extract.extract(pages).count() == 0
    assert quality_rules.judge(docs).count() == 0 and quality_rules.keep_good(docs).count() == 0
    assert packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert sentencepiece_codec.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_base_counts(spark):
    rows = corpus()
    found = {r.doc_id: r for r in quality_rules.judge(documents(spark, rows)).collect()}
    for i, t in rows:
        want = brute.base_counts(t)
        assert {k: found[i][k] for k in want} == want
        assert not (found[i].base_failed and found[i].kept)


def test_cascade_order_changes_no_verdict(spark):
    texts = [t or "" for _, t in corpus()]
    order = quality_rules.cascade_order([quality_rules.measure(t) for t in texts], list(quality_rules.RULES))
    assert sorted(order) == sorted(quality_rules.RULES)
    junk = ["! ".join(f"w{i}" for i in range(90)) + "!", "#$% " * 60 + "a b", "\n".join(f"cut off {i}..." for i in range(40)), "1234567 " * 60 + " ".join(f"{i}x" for i in range(70)), " ".join(f"w{i} w{i}" for i in range(60))]
    for t in texts + junk:
        verdicts = {quality_rules.first_rejecting(quality_rules.Text(t), o) is None for o in (order, order[::-1])}
        assert verdicts == {brute.kept(t)}, t[:60]


def test_cascade_reads_no_further_than_it_must():
    c = quality_rules.Text("a few words only")
    assert quality_rules.first_rejecting(c, ["few_words", "repeats", "wordless"]) == "few_words"
    assert "hashes" not in vars(c) and "n_letters" not in vars(c)


def test_cascade_order_is_conditional():
    """A rule that rejects nothing beyond an earlier one comes after one that does, whatever it rejects alone."""
    one = ([1e-6] * len(quality_rules.PARTS), [True, True, False], [1e-6, 1e-6, 1e-6], [0, 0, 0])
    two = ([1e-6] * len(quality_rules.PARTS), [False, False, True], [1e-6, 1e-6, 1e-6], [0, 0, 0])
    assert quality_rules.cascade_order([one] * 10 + [two], ["a", "b", "c"]) == ["a", "c", "b"]


def test_judge_matches_brute(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.kept for r in quality_rules.judge(docs).collect()} == {i: brute.kept(t) for i, t in texts.items()}


def test_rules_reject_junk_and_keep_prose(spark):
    rng = random.Random(2)
    prose = " ".join(rng.choice(["river", "stone", "walks", "house", "green", "often", "under", "light"]) + rng.choice("abcdefgh") for _ in range(200))
    junk = " ".join(f"#{rng.randint(0, 999)}$%" for _ in range(200))
    kept = quality_rules.keep_good(documents(spark, [(1, prose), (2, junk), (3, None)]))
    assert [r.doc_id for r in kept.collect()] == [1]


PAGE = """<!DOCTYPE html><html><head><title>Site &amp; title</title><style>p{}</style></head><body>
<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav><div class="cookie-banner">We use cookies on this site. <button>Accept</button></div>
<article><h1>A  long
 headline</h1><p>First paragraph with <b>bold</b> words &amp; a <a href="x">link</a> inside, long enough to count as text of an article.</p>
<script>var x = "<p>not text</p>";</script><p>Second paragraph &#8211; it also has more than a few words, so that nothing is in doubt.</p></article>
<aside class="sidebar"><a href="1">Related one</a> <a href="2">Related two</a></aside>
<div id="comments"><p>Nice post, thank you so much for writing it down for all of us!</p></div><footer>Copyright 2020 Example</footer></body></html>"""


def test_html_extract(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>unclosed <b>text &lt;ok&gt;"), (5, "u", PAGE), (None, "u", "<<<>>>")], PAGES).selectExpr("*", "'z' AS text")
    found = {r.page_id: r for r in html_extract.extract(pages).collect()}
    want = "A long headline\nFirst paragraph with bold words & a link inside, long enough to count as text of an article.\nSecond paragraph – it also has more than a few words, so that nothing is in doubt."
    assert found[1].text == found[5].text == want
    assert found[2].text == found[3].text == ""
    assert len(found) == 6


def test_html_tree_fits_its_table():
    x, y = html_extract.labelled_table()
    assert (html_extract.predict(html_extract.grow(x, y), x) == (y == 1)).mean() > 0.97


LONG = " ".join(f"<p>{' '.join(f'word{i}x{j}' for j in range(n))}</p>" for i, n in enumerate((90, 70, 15, 120, 80)))


@pytest.mark.parametrize(
    "around",
    [
        "<body class='has-sidebar'><div class='article'>{}</div></body>",
        "<body class='no-sidebar'>{}</body>",
        "<body><div class='layout header-fixed'><div class='article'>{}</div></div></body>",
        "<body><div class='related'><div class='article'>{}</div></div></body>",
        "<body><aside>{}</aside></body>",
        "<body><form id='aspnetForm'>{}</form></body>",
        "<body><div class='popular'>{}</div></body>",
    ],
)
def test_html_text_in_misnamed_containers(around):
    tree = html_extract.grow(*html_extract.labelled_table())
    found = html_extract.main_text(tree, f"<html>{around.format(LONG)}</html>")
    assert [len(x.split()) for x in found.split("\n")] == [90, 70, 15, 120, 80]


def test_html_words_and_links_decide_in_every_container():
    links = "".join(f"<li><a href='{i}'>See also the other story {i}</a></li>" for i in range(4))
    tree = html_extract.grow(*html_extract.labelled_table())
    assert "See also" not in html_extract.main_text(tree, f"<body><article>{LONG}<ul>{links}</ul></article></body>")
    comments = "<div id='comments'><article><p>Thank you, nice to read</p></article><article><p>I agree with that</p></article></div>"
    assert html_extract.main_text(tree, f"<body><article><h1>A title of words</h1>{LONG}</article><p><a href='x'>More</a></p>{comments}</body>").startswith("A title of words\n")
    assert "Thank you" not in html_extract.main_text(tree, f"<body><p><a href='x'>More</a></p>{comments}</body>")


OUTER = ["<nav>{}</nav>", "<div class='menu'>{}</div>", "<header>{}</header>", "<footer>{}</footer>", "<aside>{}</aside>", "<div class='sidebar'>{}</div>", "<div class='cookie-notice'>{}</div>", "<div class='advert'>{}</div>", "<div class='ad'>{}</div>", "<form>{}</form>", "<div id='comments'>{}</div>", "<section class='reader-comments'><article>{}</article></section>"]


@pytest.mark.parametrize("outer", OUTER)
def test_html_named_containers_are_out_whatever_their_length(outer):
    tree = html_extract.grow(*html_extract.labelled_table())
    for n in (1, 10, 20, 45, 60, 100, 150, 400):
        inner = "".join(f"<p>{' '.join(f'out{i}x{j}' for j in range(n))}</p>" for i in range(3))
        for main in (f"<article><h1>A title</h1>{LONG}</article>", f"<div>{LONG}</div>", "<article><p>Short article of six words only</p></article>"):
            for page in (f"<body>{main}{outer.format(inner)}</body>", f"<body>{outer.format(inner)}{main}</body>"):
                found = html_extract.main_text(tree, page)
                assert "out" not in found and ("word0x0" in found or "Short article of six words only" == found), (n, page[:60])


def test_html_links_in_an_article_stay():
    tree = html_extract.grow(*html_extract.labelled_table())
    for n in (1, 3, 8, 20, 60, 150):
        words = " ".join(f"link{j}" for j in range(n))
        link = f"<p><a href='x'>{words}</a></p>"
        for inside in (LONG + link + LONG, link + LONG, LONG + link + link):
            assert words in html_extract.main_text(tree, f"<body><article>{inside}</article></body>").split("\n")


def test_html_on_every_page_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        assert found[r.page_id] == brute.article_text(r.html), r.page_id


M = 1_000_000
BROKEN = ["<a " * (M // 3), "<div>" * (M // 9) + "</p>" * (M // 9), "<div>" * (M // 5), "<nav>" + "<div class='article'>" * (M // 21), "<a '>'" * (M // 6), '<a "' * (M // 4), "<a<a" * (M // 4), "<script>" + "</script " * (M // 9), "<" * M, "</" * (M // 2), "<span class=ad>" * (M // 15)]


@pytest.mark.parametrize("page", BROKEN, ids=[x[:12] for x in BROKEN])
def test_html_broken_markup_takes_linear_time(page):
    import time

    began = time.process_time()
    html_extract.blocks(page[: M // 4])
    quarter = time.process_time() - began
    html_extract.blocks(page)
    assert time.process_time() - began - quarter < max(1.0, 12 * quarter) and quarter < 3


def test_html_short_blocks_of_plain_pages_stay():
    tree = html_extract.grow(*html_extract.labelled_table())
    page = f"<html><body><h1>Four words of title</h1><p>Short one.</p>{LONG}<h2>Next part</h2><p>Also short here.</p>{LONG}</body></html>"
    found = html_extract.main_text(tree, page).split("\n")
    assert {"Four words of title", "Short one.", "Next part", "Also short here."} <= set(found)


def _tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


TEXTS = ["", " ", "  a", "a ", "a  b", "\n a\tb ", "tab\t word", "<|endoftext|> x", "don't  stop", "ein Wort\u00a0hier", "▁ x▁y", "日本 語", "a\u2003b c", "🙂 x  🙂", "1 234 5,6", "'s 's", " leading", "x" * 5000, "ﬁ \u3000 ２", "a\r\nb", "\x00 b", "é e\u0301"]


def test_byte_bpe_is_exact():
    plain = _tokenizer()
    texts = TEXTS + ["end.\nStart\n\n\n x\n", "a\n\n" * 500, "語" * 3000, "x\ty\t" * 200, "\u0085\u00a0\u3000 \u2028z"] + [t or "" for _, t in corpus()]
    for t, ids in zip(texts, byte_bpe(public_tokenizers.path("byte_bpe_50k.json")).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t[:40])


def test_added_tokens_and_long_runs_are_exact():
    plain, own = _tokenizer(), byte_bpe(public_tokenizers.path("byte_bpe_50k.json"))
    assert np.frombuffer(own.encode(["a<|endoftext|>b"])[0], "<u4").tolist() == [64, 50256, 65]
    for n in (9_999, 10_000, 10_001):
        for c in (" ", "\n", "\t", "\u3000", "\xa0", "\x1c", " \n"):
            run = (c * n)[:n]
            for t in (run, f"a{run}", f"a{run}b", f"a{run}.", f"{run} b{run}'s", f"a{run}<|endoftext|>{run}'s", f"<|endoftext|>{run}<|endoftext|<|endoftext|>"):
                assert np.frombuffer(own.encode([t])[0], "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, (n, c, t[:3])


LONG_TEXTS = [" " * 3_000_000, "x" + "\n" * 3_000_000 + "y", "a\t" + "\t" * 3_000_000, "abcdefghij" * 300_000, "1" * 3_000_000, "." * 3_000_000, ("a" + " " * 9_999) * 300]


def test_very_long_runs_are_packed(spark):
    rows = list(enumerate(LONG_TEXTS))
    got = packing.pack(documents(spark, rows), public_tokenizers.path("byte_bpe_50k.json")).collect()
    plain = _tokenizer()
    for i, t in rows:
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist() == [*plain.encode(t, add_special_tokens=False).ids, 0]


def test_other_vocabularies_are_left_to_their_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    for t in ("A word, and another", "", "x\ny"):
        assert np.frombuffer(byte_bpe(path).encode([t])[0], "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_tables_keep_no_long_words():
    table = sentencepiece_codec.piece_table(public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["q" * 5000 + str(i) for i in range(20)] + ["short words"]
    assert table.encode(texts) == table.encode(texts)
    assert max(map(len, table.ids)) <= 64
    scorer = quality_model.Scorer(np.ones(quality_model.BUCKETS, np.float32), 0.0)
    assert scorer.scores(texts) == scorer.scores(texts) and max(map(len, scorer.words)) <= 64


def test_packing_of_a_very_long_text_takes_linear_time():
    import time

    packer = packing.Packer(0, 1024, 32, False)
    began = time.process_time()
    packer.add(1, 0, bytes(4 * 20_000_000), 20_000_000)
    packer.close(True)
    assert time.process_time() - began < 10 and sum(r[2] for r in packer.rows) == 20_000_000


def test_packing(spark):
    rows = [*corpus(), (None, "x y"), (6, "one two three four")]
    got = packing.pack(documents(spark, rows).repartition(5), public_tokenizers.path("byte_bpe_50k.json")).collect()
    plain = _tokenizer()
    pieces = {}
    for r in got:
        pieces.setdefault(r.sequence_id, []).append(r)
    for part in pieces.values():
        at = 0
        for r in sorted(part, key=lambda r: r.offset):
            assert r.offset == at and r.length == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
            at += r.length
        assert at <= 1024
    assert sum(sum(r.length for r in p) < 1024 for p in pieces.values()) <= 1
    for i, t in rows:
        want = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        own = sorted((r for r in got if r.doc_id == i and r.doc_tokens == len(want) // 4), key=lambda r: r.start)
        copies = sum(x == i and (y or "") == (t or "") for x, y in rows)
        assert sum(r.length for r in own) == copies * len(want) // 4
        if copies == 1:
            assert b"".join(r.ids for r in own) == want


def test_packing_merges_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 3)
    rows = [(i, f"word {i} " * (i % 7 + 1)) for i in range(300)]
    got = packing.pack(documents(spark, rows).repartition(20), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False).collect()
    total = {}
    for r in got:
        total[r.sequence_id] = total.get(r.sequence_id, 0) + r.length
    assert sum(n < 1024 for n in total.values()) <= 1 and {r.doc_id for r in got} == set(range(300))


def test_sentencepiece_is_exact(spark):
    import sentencepiece

    plain = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = [(1000 + i, t) for i, t in enumerate(TEXTS)] + corpus()
    path = public_tokenizers.path("piece_bpe_32k.model")
    found = {r.doc_id: r for r in sentencepiece_codec.encode_decode(documents(spark, rows), path).collect()}
    digests = {r.doc_id: r for r in sentencepiece_codec.encode_decode(documents(spark, rows), path, digests=True).collect()}
    for i, t in rows:
        ids = plain.encode(t or "")
        assert list(found[i].ids) == ids and found[i].decoded == plain.decode(ids) and found[i].n_tokens == len(ids), repr(t)
        assert digests[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def _held_out(spark, name, label, sf="sf0.01"):
    import pyarrow.parquet as pq

    from netweave.llm.queries import QUERIES

    d = f"/root/testdata/{sf}"
    labels = {r["doc_id"]: r[label] for r in pq.read_table(f"{d}/labels.parquet").to_pylist()}
    found = {r.doc_id: r for r in QUERIES[name](spark, d).collect()}
    for i, r in found.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1
    return [(labels[i], r.score, r.predicted) for i, r in found.items() if r.held_out and labels.get(i) is not None]


def _auc(rows):
    good, bad = [s for y, s, _ in rows if y], [s for y, s, _ in rows if not y]
    return np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])


def test_quality_on_held_out_rows(spark):
    rows = _held_out(spark, "op8_quality_classifier", "quality")
    assert _auc(rows) > 0.97 and np.mean([y == p for y, _, p in rows]) > 0.95


def test_toxicity_on_held_out_rows(spark):
    rows = _held_out(spark, "op9_toxicity", "toxic", "sf0.1")
    assert np.mean([p for y, _, p in rows if y]) >= 0.9
    assert sum(p and not y for y, _, p in rows) <= 0.01 * len(rows)


def plain_grams(word, least, most):
    """The hash of each n-gram of bytes of ``<word>``, one at a time."""
    data = b"<" + word + b">"
    return [int(mix64(np.array([int.from_bytes(data[i : i + n], "little") + (n << 58)], np.uint64))[0]) for n in range(least, most + 1) for i in range(len(data) - n + 1)]


def test_grams_in_stretches(monkeypatch):
    from netweave.llm import common

    words = [b"a", b"", b"abc" * 50, "wörter".encode(), b"x" * 7, b"abcabc"]
    for stretch in (1, 2, 5, 16, 40, 1000):
        got = [(int(h), int(o)) for hs, os in common.gram_stretches(words, 2, 5, stretch) for h, o in zip(hs, os)]
        assert sorted(got) == sorted((h, i) for i, w in enumerate(words) for h in plain_grams(w, 2, 5)), stretch
    monkeypatch.setattr(common, "GRAM_BYTES", 8)
    owner, bucket, times = common.gram_counts(words, 2, 5, 97)
    want = Counter((i, h % 97) for i, w in enumerate(words) for h in plain_grams(w, 2, 5))
    got = Counter()
    for o, b, n in zip(owner, bucket, times):
        got[int(o), int(b)] += int(n)
    assert got == want and (np.diff(owner) >= 0).all()


@pytest.mark.parametrize("scorer", [quality_model.Scorer(np.ones(quality_model.BUCKETS, np.float32), 0.0), toxicity.Scorer(np.arange(5000), np.ones(5000), 0.0)], ids=["quality", "toxicity"])
def test_a_very_long_word_takes_bounded_memory(scorer):
    import tracemalloc

    text = "".join(random.Random(4).choices("abcdefghijklmnopqrstuvwxyz", k=30_000_000))
    scorer.scores(["warm up"])
    tracemalloc.start()
    assert 0 <= scorer.scores([text])[0] <= 1
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 400e6, most


def test_scorers_match_a_plain_forward_pass():
    """Tables of words against every feature of every word, one at a time."""
    rng = np.random.default_rng(1)
    texts = [t or "" for _, t in corpus(size=40)][:40] + ["same same same word", "Ärger UND Ärger"]
    table = rng.normal(size=quality_model.BUCKETS).astype(np.float32)
    got = quality_model.Scorer(table, 0.25).scores(texts)
    for t, score in zip(texts, got):
        words = t.encode().split()
        values = [float(table[h % (quality_model.BUCKETS - 1) + 1]) for w in words for h in [xxhash.xxh3_64_intdigest(w), *plain_grams(w, quality_model.MIN_GRAM, quality_model.MAX_GRAM)]]
        values += [float(table[quality_model.AGAIN])] * sum(a == b for a, b in zip(words, words[1:]))
        z = 0.25 + (sum(values) / len(values) if values else 0.0)
        assert score == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-6)
    weights = rng.normal(size=toxicity.BUCKETS)
    got = toxicity.Scorer(np.arange(toxicity.BUCKETS), weights, -0.5).scores(texts)
    for t, score in zip(texts, got):
        words = t.encode().translate(toxicity._LETTERS).split()
        total = sum(weights[h % toxicity.BUCKETS] for w in words for h in plain_grams(w, toxicity.MIN_GRAM, toxicity.MAX_GRAM))
        z = -0.5 + toxicity.SCALE * total / max(1, len(words))
        assert score == pytest.approx(1 / (1 + np.exp(-np.clip(z, -500, 500))), rel=1e-6, abs=1e-12)


@pytest.mark.parametrize("model", [quality_model, toxicity])
def test_classifiers_on_awkward_tables(spark, model):
    texts = [(i, ("good " if i % 2 else "bad ") * 5 + f"w{i}") for i in range(60)] + [(100, None), (101, ""), (None, "x"), (102, "w " * 50_000)]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)] + [(None, 1, 1), (3, None, None), (777, 1, 1)], "doc_id long, quality int, toxic int")
    docs = documents(spark, texts).drop("score")
    scored = {r.doc_id: r.score for r in model.score(docs, model.fit(docs, labels)).collect()}
    assert len(scored) == len(texts) and scored[100] == scored[101]
    none = {r.score for r in model.score(docs, model.fit(docs, labels.limit(0))).collect()}
    assert none == {0.5}
    assert model.score(docs.limit(0), model.fit(docs, labels)).count() == 0


def test_one_labelled_id_with_very_many_texts(spark):
    from netweave.llm.labelled import training_rows

    many = spark.range(100_000).selectExpr("0L AS doc_id", "concat('text ', lpad(id, 9, '0')) AS text").unionByName(spark.createDataFrame([(7, "b" * 900), (8, None), (9, "c")], "doc_id long, text string"))
    labels = spark.createDataFrame([(0, 1), (7, 1), (8, 0), (9, 1)], "doc_id long, toxic int")
    texts, y = training_rows(many, labels, "toxic")
    assert sorted(zip(texts, y)) == [("", 0), ("b" * 900, 1), ("c", 1), ("text 000000000", 1)]
    texts, _ = training_rows(many, labels, "toxic", most=500)
    assert sorted(texts) == ["", "c", "text 000000000"]


def test_training_rows_are_bounded_and_leave_the_fold_out(spark):
    from netweave.llm.labelled import training_rows

    docs = documents(spark, [(i, f"t{i}") for i in range(50)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(50)], "doc_id long, quality int, toxic int")
    texts, y = training_rows(docs, labels, "toxic", rows=10)
    assert len(texts) == len(y) == 10 and all(zlib.crc32(t[1:].encode()) % 3 != 1 for t in texts)
