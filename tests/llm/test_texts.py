"""HTML, chat, language, quality, decontamination and licences: brute force, round trips and held-out accuracy."""

import itertools
import os
import re
import string
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracelight.llm import chat, decontaminate, html, langid, licenses, quality, registry

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
PROSE = (
    "This is the main text of the page and it has a lot of the words that we know to be on the list, as it is the way to see that the "
    "article is good and that it will be kept by the rules of the method, which is what we want it to be for this test."
)

# HTML


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("plain &lt;text&gt; &amp more", "plain <text> & more"),
        ("<title>t</title><script>if (a<b) '</p>'</script><style>x</style><p>only\n  this&nbsp;one</p>", "only this one"),
        ("<nav><a>m</a></nav><article><h1>T</h1><p>One<br>two <b>three</b></p><p>Four</article><footer>f</footer>", "T\n\nOne two three\n\nFour"),
        ("<article><p><b>open<p>next</article>", "open\n\nnext"),
        ("<article><p>a</p><!-- <p>x</p> --><div class='ad'>buy</div><aside>s</aside><form>f<input></form><p>b</p></article>", "a\n\nb"),
        ("<article><p>a</p><section id=comments><p>I like it</p></section></article><div class='cookie-notice'>ok?</div>", "a"),
        ("<main><p>a <a href=x>link</a> in the text</p><ul><li><a>one</a><li><a>two</a></ul></main>", "a link in the text"),
        ("<article><p style='display: none'>x</p><p hidden>y</p><p aria-hidden=true>z</p><p>w</p></article>", "w"),
        ("<article><p>x</p></article><p>after</p>", "x"),
        (f"<div><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p></div><div class='sidebar'><p>{PROSE}</p></div>", f"{PROSE}\n\nShort.\n\n{PROSE}"),
        (f"<div><p><a>Home</a> <a>About us</a></p><p>Menu line</p><p>x</p><p>{PROSE}</p><p>© 2020 by us</p></div>", f"x\n\n{PROSE}"),
        # a long block without stop words goes with its neighbours
        (f"<p>{PROSE}</p><p>{string.ascii_letters * 8}</p>", f"{PROSE}\n\n{string.ascii_letters * 8}"),
        (f"<p>{PROSE}</p><p><a>m</a></p><p>{string.ascii_letters * 3}</p><p><a>m</a></p>", PROSE),
        ("<p><a>m</a></p><p>It is the only text that there is on the page, and it is not that long.</p><p><a>m</a></p>", "It is the only text that there is on the page, and it is not that long."),
        ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1\n\n2\n\n3"),
        ("<article><p>a</p></div></section><p>b</p>", "a\n\nb"),
        ("<article><p title='>'>a</p><p title=\"<p>\">b</p><img alt=x/><p>c &#8364; &#x20AC; &bogus;", "a\n\nb\n\nc € € &bogus;"),
        ("<article><p>a<br><br>b</p>", "a\n\nb"),
        (f"<p>x</p><div><a>m</a></div><h2>Head</h2><h3>Sub</h3><p>{PROSE}</p><h2>Next</h2><div><a>Menu</a></div>", f"Head\n\nSub\n\n{PROSE}"),
        (f"<div class=header>Site</div><div id='post-12' class='entry-content'><p>Short.</p><div class=share>Tweet</div><p>a b</p></div><p>{PROSE}</p>", "Short.\n\na b"),
        ("<article><p>cut off <b", "cut off <b"),
        ("<article><script>never closed <p>x", ""),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<h1 class='entry-title'>T</h1><div><p>{PROSE}</p></div>", f"T\n\n{PROSE}"),
        (f"<div class='has-sidebar'><main><p>{PROSE}</p><p>x</p></main><div class='sidebar'><p>buy</p></div></div>", f"{PROSE}\n\nx"),
        (f"<div class='with-header'><p>{PROSE}</p></div>", PROSE),
        (f"<div><p>{PROSE}</p></div><article><h2><a>One</a></h2><p><a>More</a></p></article><article><p><a>Two</a> it is</p></article>", PROSE),
    ],
)
def test_names_do_not_outweigh_the_text(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        ('<article><p>aaa</p><svg class="i"/><p>bbb stays</p><math/><p>c</p></article>', "aaa\n\nbbb stays\n\nc"),
        ("<article><p>a</p><svg><path d='M0'/><title>t</title></svg><p>b</p></article>", "a\n\nb"),
        (f'<div class="content has-sidebar"><p>{PROSE}</p></div>', PROSE),
        (f'<div class="page no-header"><article><p>{PROSE}</p></article></div>', PROSE),
        ('<article><p class="search-term">hello there</p><p>x</p></article>', "hello there\n\nx"),
        ('<article><div class="entry-header"><h1>T</h1></div><p>x</p><div class="ad-slot-2">buy</div><div id="sidebarLeft">s</div></article>', "T\n\nx"),
        ("<article><p>Press <button>OK</button> now</p><p><button>Share</button></p></article>", "Press OK now"),
        (f"<div><p>{PROSE} © of this</p><p>© 2020</p></div>", f"{PROSE} © of this"),
        ("<article><h2>A <b>bold</b> head</h2><p>x</p></article>", "A bold head\n\nx"),
    ],
)
def test_no_article_text_is_lost(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize(
    "unit", ['<a "', "<a '\"", "<div>x", "<b>", "</p>", "<b><i></b>", "<!--", "<a", "<div class=sidebar>x", "<hr><b>", "<p><a href='>", "<svg", "&amp", "<", "<script>"]
)
def test_hostile_pages_take_linear_time(unit):
    import time

    began = time.perf_counter()
    html.main_text(unit * 20_000)
    html.main_text(unit * 20_000 + "'>\"")
    assert time.perf_counter() - began < 20


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["good", "bad", "near", "short"]), max_size=12))
def test_neighbours_against_brute_force(labels):
    decided = [i for i, x in enumerate(labels) if x in ("good", "bad")]

    def stays(i):
        if labels[i] in ("good", "bad"):
            return labels[i] == "good"
        near = [j for j in decided if abs(j - i) == min(abs(k - i) for k in decided)]
        found = {labels[j] for j in near}
        return labels[i] == "near" if len(found) > 1 else found != {"bad"}

    assert html.second_pass(labels) == [stays(i) for i in range(len(labels))]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["word ", "the of and to in a ", "Xyz © ", "it is not by us "]), st.integers(1, 40), st.integers(0, 10)), max_size=6))
def test_block_rules_against_brute_force(rows):
    """Blocks of a page that says nothing about places, by the rules written out again."""
    page = "".join(f"<p>{w * n}<a>{'link ' * k}</a></p>" for w, n, k in rows)

    def label(w, n, k):
        text = (w * n + "link " * k).strip()
        linked = len(("link " * k).strip())
        words = [x for x in text.lower().replace("©", " ").split()]
        stops = sum(x in html.STOP_WORDS for x in words) / len(words)
        if linked / len(text) > 0.2 or len(text) < 70 and ("©" in text or linked):
            return "bad"
        if len(text) < 70:
            return "short"
        if stops >= 0.12:
            return "good" if len(text) > 200 else "near"
        return "near" if stops >= 0.06 or len(text) > 200 else "short"

    labels = [label(*r) for r in rows]
    if "good" not in labels:
        labels = ["good" if x == "near" else x for x in labels]
    keep = html.second_pass(labels)
    assert html.main_text(page) == "\n\n".join((w * n + "link " * k).strip() for (w, n, k), x in zip(rows, keep) if x)


def test_ambiguous_blocks_follow_their_neighbours():
    assert html.second_pass(["short", "good", "short", "short", "bad", "short"]) == [True, True, True, False, False, False]
    assert html.second_pass(["good", "short", "bad", "near", "good"]) == [True, False, False, True, True]
    assert html.second_pass(["short", "near"]) == [True, True] and html.second_pass([]) == []
    assert html.second_pass(["head", "head", "good", "head", "bad", "head"]) == [True, True, True, False, False, False]
    assert html.second_pass(["head", "head"]) == [True, True]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<article>", "</article>", "<a href='x'>", "</a>", "<br>", "<nav>", "</nav>", "text ", "&amp;", "<", ">", "'", '"', "<!--", "-->", "<script>", "</script>"]), max_size=30))
def test_any_markup_is_read(parts):
    found = html.blocks("".join(parts))
    assert all(b.text and 0 <= b.linked for b in found)


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<article>é€😀</article>", "x"), (1, "u", "<article>é€😀</article>", "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    assert sorted(map(str, (tuple(r) for r in html.extract(pages).collect()))) == ["(1, 'u', 'é€😀', 3)"] * 2 + ["(None, None, '', 0)"]
    assert html.extract(pages.limit(0)).count() == 0
    long = "<article>" + "<p>word </p>" * 50000
    assert html.main_text(long).count("word") == 50000


@tables
def test_articles_of_the_test_pages(spark):
    import html as unescaping

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = {r.page_id: r.text for r in registry.QUERIES["op8_html_extraction"](spark, SF).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        parts = [" ".join(unescaping.unescape(re.sub("<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split("</?(?:p|h1)>", article)]
        assert found[r.page_id] == "\n\n".join(p for p in parts if p)


# chat

PIECES = ["</turn>\n", "### ", "assistant: ", "\\\\", *"\\#<>/:tur \nnabé😀"]
TEXT = st.lists(st.sampled_from(PIECES), max_size=12).map("".join) | st.text(max_size=8)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "a: b", "\\", "### x:"]) | TEXT, TEXT), min_size=1, max_size=6))
def test_round_trip_and_loss(turns):
    shown = chat.render(turns)
    assert chat.read_back(shown.text) == turns and shown.rewrites_at == -1
    assert [shown.text[a:b] for a, b in shown.spans] == [chat.marked_turns([t]) for t in turns]
    assert [chat.unescape(shown.text[a:b]) for a, b in shown.loss] == [t for r, t in turns if r == "assistant"]
    assert shown.text.count("</turn>\n") == len(turns)


def test_templates_that_rewrite_history():
    turns = [("user", "a"), ("assistant", "b"), ("user", "c")]
    counted = lambda m: f"[{len(m)}]" + chat.marked_turns(m)
    assert chat.render(turns, counted).rewrites_at == 1 and not chat.render(turns, counted).spans
    # drops what assistants said before the last turn
    forgets = lambda m: "".join(f"<{r}>{'' if r == 'assistant' and i + 1 < len(m) else t}" for i, (r, t) in enumerate(m))
    assert chat.render(turns, forgets).rewrites_at == 2
    trimmed = lambda m: "".join(f"{r.upper()}\n{t.strip()}\n" for r, t in m)
    shown = chat.render([("user", " x "), ("assistant", "  y\n")], trimmed)
    assert [shown.text[a:b] for a, b in shown.loss] == ["y"]


def test_conversations(spark):
    rows = [
        (1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, None, None, None), (2, 0, "assistant", ""), (3, 0, "user", "x"), (3, 0, "user", "x"), (3, 0, "assistant", "a"),
        (None, 5, "user", "q"), (4, 0, "assistant", "long " * 200000),
    ]
    found = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, row int")).collect()}
    assert chat.read_back(found[1].formatted) == [("user", "a"), ("assistant", "b")]
    assert chat.read_back(found[2].formatted) == [("", ""), ("assistant", "")]
    assert chat.read_back(found[3].formatted) == [("assistant", "a"), ("user", "x"), ("user", "x")]
    assert found[None].n_turns == 1 and found[4].loss_chars == 1000000 and len(found) == 5
    assert found[1].turn_spans[0] == 0 and found[1].turn_spans[-1] == len(found[1].formatted) == found[1].formatted_chars
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# language


def test_normalised_text():
    assert langid.normalised("Ab,é1 c!").tolist() == [0, ord("a"), ord("b"), 0, ord("é"), 0, ord("c"), 0]
    assert not len(langid.normalised("12 !?")) and not len(langid.normalised(None)) and not len(langid.normalised(""))


def test_the_languages_with_the_most_rows_are_learnt(spark):
    docs = spark.createDataFrame([(i, "some words", f"l{i % 40}") for i in range(100)] + [(100, "x", "z"), (101, "x", None)], "doc_id long, text string, lang string")
    assert {r.lang for r in langid.sample(docs, max_languages=3).collect()} == {"l0", "l1", "l10"}
    assert {r.lang for r in langid.sample(docs).collect()} == {f"l{i}" for i in range(40)} | {"z"}


def test_buckets_are_the_same_in_pieces():
    codes = langid.normalised("a long enough text to be cut into several pieces, ßé漢")
    whole = np.sort(np.concatenate(list(langid.buckets(codes))))
    for chunk in (1, 3, 7, 50):
        assert (np.sort(np.concatenate(list(langid.buckets(codes, chunk=chunk)))) == whole).all()
    assert len(whole) == sum(max(0, len(codes) - n + 1) for n in langid.ORDERS)


def words_of(alphabet, n, seed):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list(alphabet), int(r.integers(2, 8)))) for _ in range(n))


def test_a_model_tells_alphabets_apart(spark):
    texts = [(words_of(a, 12, 10 * i + k), g) for i in range(40) for k, (g, a) in enumerate({"x": "abcde", "y": "fghij", "z": "defgh"}.items())]
    model = langid.train([t for t, _ in texts], [g for _, g in texts], epochs=6)
    for g, a in {"x": "abcde", "y": "fghij", "z": "defgh"}.items():
        assert all(model.predict(words_of(a, 8, 999 + i))[0] == g for i in range(5))
    assert model.predict("123")[0] == langid.UNKNOWN and model.rejects(model.predict(None))
    assert not any(model.rejects(model.predict(t)) for t, _ in texts)
    docs = spark.createDataFrame([(1, texts[0][0], 0.5), (1, texts[0][0], 0.5), (None, None, None), (2, "", 1.0), (3, "a" * 600000, 1.0)], "doc_id long, text string, score double")
    found = langid.identify(docs, model).collect()
    assert sorted(str(r.lang_pred) for r in found) == ["und", "und", "x", "x", "x"]
    kept = langid.identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == 3 and langid.identify(docs.limit(0), model).count() == 0


def test_models_of_little():
    assert langid.train([], []).predict("abc") == (langid.UNKNOWN, 0.0)
    assert langid.train(["abc def"], ["q"]).predict("xyz")[0] == "q"
    assert langid.train(["1", "2"], ["q", "r"]).predict("xyz")[0] in ("q", "r")


@tables
def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    found = registry.QUERIES["op3_language_id"](spark, SF).join(docs, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert np.mean([r.lang_pred == r.lang for r in found]) > 0.98


# quality


def test_marginals_are_those_of_all_labellings():
    r = np.random.default_rng(0)
    lines = np.array([3, 1, 5, 2])
    emit, links = r.normal(size=11), r.normal(size=(2, 2))
    good, pairs = quality.marginals(emit, lines, links)
    expected, both, at = [], np.zeros((2, 2)), 0
    for n in lines:
        e = emit[at : at + n]
        at += n
        total, ones, two = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(e[i] for i in range(n) if y[i]) + sum(links[y[i - 1], y[i]] for i in range(1, n)))
            total += w
            ones += w * np.array(y)
            for i in range(1, n):
                two[y[i - 1], y[i]] += w
        expected += list(ones / total)
        both += two / total
    assert np.allclose(good, expected) and np.allclose(pairs, both)


def test_long_texts_are_counted_in_parts(monkeypatch):
    text = "One two two!! three|\n\nÉ 12 ### a\n" * 30
    whole, _ = next(iter(quality.document_lines([text])))
    monkeypatch.setattr(quality, "PIECE", 41)
    parts = quality.long_counts(text)
    # a cut may divide a word, which then counts as two
    assert (parts[:, : quality.CLASSES] == whole[:, : quality.CLASSES]).all()
    counts, lines = zip(*quality.document_lines([text, "a", None, text + "x"]))
    assert [int(n) for group in lines for n in group] == [91, 1, 1, 91] and sum(len(c) for c in counts) == 184


def test_counts_of_a_line():
    counts, lines = next(iter(quality.document_lines(["ab ab Cd!! 1|é,#$ x\n", ""])))
    assert lines.tolist() == [2, 1] and counts.shape == (3, quality.CLASSES + 3)
    line = dict(zip(["other", "lower", "upper", "letter", "digit", "space", "point", "bang", "pipe", "symbol", "words", "again", "marked"], counts[0].tolist()))
    assert line == {"other": 0, "lower": 7, "upper": 1, "letter": 0, "digit": 1, "space": 4, "point": 1, "bang": 2, "pipe": 1, "symbol": 2, "words": 5, "again": 1, "marked": 2}
    assert not counts[1].any()


GOOD, BAD = "The cat sat on the mat, and it was glad of it.", "BUY!! NOW!! $$$ ### | | |"


def test_a_model_tells_good_from_bad(spark):
    texts = [("\n".join([GOOD] * (1 + i % 5)), 1) for i in range(60)] + [("\n".join([GOOD, *[BAD] * (2 + i % 5)]), 0) for i in range(30)]
    model = quality.train([t for t, _ in texts], [y for _, y in texts], steps=60)
    p = quality.scores(model, [t for t, _ in texts])
    assert ((p >= 0.3) == np.array([y for _, y in texts])).all() and ((0 <= p) & (p <= 1)).all()
    alone = np.concatenate([quality.scores(model, [t]) for t, _ in texts])
    assert np.allclose(alone, p)
    docs = spark.createDataFrame([(1, GOOD, "s", 0.0), (1, GOOD, "s", 0.0), (2, BAD, "s", 0.0), (3, None, None, None), (None, "", None, None)], "doc_id long, text string, source string, score double")
    found = quality.score(docs, model).collect()
    assert len(found) == 5 and all(0 <= r.score <= 1 for r in found)
    kept = quality.good_documents(docs, model)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()][:2] == [1, 1] and quality.score(docs.limit(0), model).count() == 0


def test_labels_of_one_kind_and_none(spark):
    assert quality.scores(quality.train([], []), ["a", None]) == pytest.approx([0.5, 0.5])
    assert quality.scores(quality.train(["a"] * 9, [1] * 9), ["b"]) == pytest.approx([0.95])
    docs = spark.createDataFrame([(1, GOOD), (1, GOOD), (2, BAD), (3, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 0), (2, 1, 0), (3, 0, 1), (9, 1, 1), (None, 1, 1), (4, None, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    assert quality.scores(model, [GOOD])[0] > quality.scores(model, [BAD])[0]
    assert quality.scores(quality.fit(docs, labels.limit(0)), [GOOD]) == pytest.approx([0.5])


@tables
def test_quality_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = registry.QUERIES["op1_quality_classifier"](spark, SF).join(labels, "doc_id").where("held_out").collect()
    assert all(r.predicted == (r.score >= 0.3) for r in found)
    assert np.mean([r.predicted == r.quality for r in found]) > 0.95


# decontamination


def vocabulary(n):
    return [f"w{i}" for i in range(n)]


def made_items(r, n):
    common, rare = vocabulary(20), [f"r{i}" for i in range(3000)]
    texts = []
    for _ in range(n):
        size = int(r.integers(5, 70))
        ws = [str(r.choice(common)) if r.random() < 0.5 else str(r.choice(rare)) for _ in range(size)]
        cut = int(r.integers(1, size + 1))
        texts.append((" ".join(ws[:cut]) + ". " + " ".join(ws[cut:])).strip())
    return texts


def plain_leak(item, doc, index):
    """What leaks of an item's text into a document, by the rule written out again."""
    there = decontaminate.words(doc)
    runs = lambda ws, n=5: [tuple(ws[i : i + min(n, len(ws))]) for i in range(len(ws) - min(n, len(ws)) + 1)] if ws else []
    own = decontaminate.words(item)
    seen = set(runs(there))
    if len(own) < 5:
        return "question and answer" if tuple(own) in set(runs(there, len(own))) else None
    wanted = set(runs(own))
    at = [i for i, w in enumerate(runs(there)) if w in wanted]
    if not at:
        return None
    near = there[max(0, at[0] - len(own)) : at[-1] + 5 + len(own)]

    def share(part):
        wanted = runs(part)
        if not wanted:
            return 1.0
        n = len(wanted[0])
        return sum(w in (seen if n == 5 else set(runs(near, n))) for w in wanted) / len(wanted)

    q, a = (decontaminate.words(x) for x in decontaminate.question_and_answer(item))
    if share(own) >= 0.8 - 1e-9 and share(q) >= 0.5 and share(a) >= 0.5:
        return "question and answer"
    return "question" if len(q) >= 8 and share(q) >= 0.8 - 1e-9 else None


def test_leaks_are_those_of_brute_force():
    r = np.random.default_rng(4)
    items = list(enumerate(made_items(r, 60)))
    items += [(100, items[3][1]), (101, "too short a"), (102, None), (103, ""), (None, items[5][1] + " and more of it here")]
    index = decontaminate.Index(items)
    docs = []
    for i in range(120):
        noise = lambda: " ".join(made_items(r, 3))
        item = decontaminate.words(items[int(r.integers(0, 60))][1])
        k = int(r.integers(0, 4))
        if k:
            drop = int(len(item) * float(r.choice([0.0, 0.05, 0.15, 0.3])))
            item = item[drop:] if k == 1 else item[: len(item) - drop] if k == 2 else [w if r.random() > 0.04 else "new" for w in item]
            docs.append(f"{noise()} {' '.join(item).upper()}, {noise()}")
        else:
            docs.append(noise())
    hits = {}
    for d in docs:
        expected = [(str(i), k) for i, t in items if t and (k := plain_leak(t, d, index))]
        found = index.leaks(d)
        assert sorted((str(x[0]), x[5]) for x in found) == sorted(expected)
        assert all(x[1] >= 1 for x in found)
        for x in found:
            hits[x[5]] = hits.get(x[5], 0) + 1
    assert hits["question and answer"] > 30 and hits["question"] > 3
    assert index.leaks(None) == index.leaks("") == index.leaks("!!") == [] and decontaminate.Index([]).leaks("a b c d e f") == []


def test_leaks_with_inserted_runs_are_found():
    r = np.random.default_rng(6)
    items = list(enumerate(made_items(r, 40)))
    index = decontaminate.Index(items)
    hits = 0
    for i, text in items:
        item = decontaminate.words(text)
        for n in (1, 40, 3000):
            cut = int(r.integers(0, len(item) + 1))
            doc = " ".join([*item[:cut], *(f"n{j}" for j in range(n)), *item[cut:]])
            expected = plain_leak(text, doc, index)
            assert {x[0]: x[5] for x in index.leaks(doc)}.get(i) == expected
            hits += expected is not None
    assert hits > 60


def test_questions_answers_short_items_and_repeated_words():
    question = "Question: which of the cities in the north of the country is its capital? Answer: "
    filler = " ".join(f"u{i}" for i in range(50))
    items = [(1, question + "Paris"), (2, "a " * 20 + "b c d"), (3, "only three words"), (4, "你好世界今天天气很好"), (5, "one two three four five six seven eight. Answer: " + " ".join(f"v{i}" for i in range(30)))]
    items += list(enumerate(made_items(np.random.default_rng(1), 54), 100))
    index = decontaminate.Index(items)
    found = lambda doc: {x[0]: x[5] for x in index.leaks(f"{filler} {doc} {filler}")}
    assert found(question + "Paris") == {1: "question and answer"}
    assert found(question + "London") == {1: "question"}
    assert found(question.replace("Answer:", "")) == {1: "question"}
    assert found("Paris") == found("Answer: Paris") == {}
    assert found("one two three four five six seven eight answer nothing") == {5: "question"}
    assert found(" ".join(f"v{i}" for i in range(30))) == {}
    assert found("Only, three WORDS") == {3: "question and answer"} and found("only three") == {}
    assert found("他说你好世界今天天气很好啊") == {4: "question and answer"} and found("今天") == {}
    for doc in (question, "a " * 20, "a " * 7, "a a a a b c d", question + "Rome", "v1 v2 v3 v4 v5 v6"):
        expected = {i: k for i, t in items if (k := plain_leak(t, f"{filler} {doc} {filler}", index))}
        assert found(doc) == expected


def test_wand_finds_what_scoring_everything_finds():
    r = np.random.default_rng(9)
    index = decontaminate.Index(list(enumerate(made_items(r, 80))))
    for _ in range(200):
        x = index.items[int(r.integers(0, len(index.items)))]
        terms = sorted(set(x.ids[: int(r.integers(1, len(x.ids) + 1))]) | {int(t) for t in r.integers(0, len(index.vocabulary), 40)})
        scores = {}
        for t in terms:
            for k, v in zip(*index.postings[t]):
                scores[k] = scores.get(k, 0.0) + v
        expected = {k: s for k, s in scores.items() if s >= 1}
        found = dict(index.wand(terms, set(range(len(index.items)))))
        assert found.keys() == expected.keys() and all(found[k] == pytest.approx(expected[k]) for k in found)


def test_long_documents_are_bounded_in_pieces(monkeypatch):
    r = np.random.default_rng(2)
    items = list(enumerate(made_items(r, 20)))
    index = decontaminate.Index(items)
    text = " ".join(made_items(r, 30)) + " " + items[7][1] + " " + " ".join(made_items(r, 30))
    whole = index.leaks(text)
    monkeypatch.setattr(decontaminate, "PIECE", 64)
    assert [x[0] for x in whole] == [7] and index.leaks(text) == whole


def test_questions_and_answers():
    assert decontaminate.question_and_answer("What is it? It is this. So there.") == ("What is it? It is this. ", "So there.")
    assert decontaminate.question_and_answer("Q: what? Answer: this. And that.") == ("Q: what? Answer: ", "this. And that.")
    assert decontaminate.question_and_answer("one sentence.") == ("one sentence.", "")


def test_leaking_rows(spark):
    item = "the quick brown fox jumps over the lazy dog. it was seen by nobody at all"
    docs = spark.createDataFrame([(1, f"x {item} y", "s", 1.0), (1, f"x {item} y", "s", 1.0), (2, "clean text", "s", 1.0), (3, None, None, None), (None, item, "s", 0.0), (4, "z " * 400000 + item, "s", 0.0)], "doc_id long, text string, item_id string, score double")
    bench = spark.createDataFrame([(7, item, 1), (8, item, 1), (9, None, 1), (None, "other things that are not in there at all", 1)], "item_id long, text string, score int")
    found = sorted((str(r.doc_id), r.item_id) for r in decontaminate.find_leaks(docs, bench).collect())
    assert found == [("1", 7), ("1", 7), ("1", 8), ("1", 8), ("4", 7), ("4", 8), ("None", 7), ("None", 8)]
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns and sorted(str(r.doc_id) for r in clean.collect()) == ["2", "3"]
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0 and decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    # many items are indexed in turns
    parts = list(decontaminate.indexes(bench.union(spark.range(40).selectExpr("id + 100", "concat('item number ', id, ' of a long list of them')", "1")), at_a_time=10))
    assert len(parts) > 3 and sum(len(p.items) for p in parts) == 43


# licences


def best_dice(text, template, threshold=0.8):
    """The best Dice coefficient of any run of words with a template."""
    ws, t = licenses.words(text), licenses.words(template)
    grams = list(zip(t, t[1:]))
    best = 0.0
    for i in range(len(ws)):
        for j in range(i + 2, len(ws) + 1):
            run = list(zip(ws[i:j], ws[i + 1 : j]))
            left, shared = list(grams), 0
            for g in run:
                if g in left:
                    left.remove(g)
                    shared += 1
            best = max(best, 2 * shared / (len(run) + len(grams)))
    return best


def test_matches_against_brute_force():
    r = np.random.default_rng(6)
    ws = vocabulary(14)
    for _ in range(150):
        template = " ".join(r.choice(ws, int(r.integers(2, 9))))
        text = " ".join(r.choice(ws, int(r.integers(0, 12))))
        if r.random() < 0.6:
            parts = template.split()
            parts[int(r.integers(0, len(parts)))] = "new"
            text += " " + (template if r.random() < 0.5 else " ".join(parts)) + " " + " ".join(r.choice(ws, 3))
        best = best_dice(text, template)
        found = licenses.Scanner([("t", template)], 0.7).matches(text)
        assert bool(found) == (best >= 0.7)
        if found:
            assert max(d for _, _, d, _ in found) <= best + 1e-9
            own = licenses.words(text)
            for a, n, d, _ in found:
                assert best_dice(" ".join(own[a : a + n]), template) >= d - 1e-9


def test_templates_are_found(spark):
    scanner = licenses.Scanner()
    for i, (name, text) in enumerate(licenses.TEMPLATES):
        [(first, n, d, t)] = scanner.matches(f"one two three {text.upper()} and four\nfive")
        assert (first, t.name, t.number, d) == (3, name, i, 1.0) and n == len(licenses.words(text))
        worn = licenses.words(text)
        if len(worn) > 30:
            worn[10], worn[20] = "changed", "words"
            [(_, _, d, t)] = scanner.matches(" ".join(worn))
            assert t.number == i and 0.8 < d < 1
    docs = spark.createDataFrame([(1, licenses.TEMPLATES[0][1], "l"), (1, licenses.TEMPLATES[0][1], "l"), (2, "nothing of the kind", "l"), (3, None, "l"), (None, f"{licenses.TEMPLATES[2][1]}\n{licenses.TEMPLATES[1][1]}", "l")], "doc_id long, text string, license string")
    found = sorted((str(r.doc_id), r.license, r.first_word) for r in licenses.scan(docs).collect())
    assert found == [("1", "Apache-2.0", 0), ("1", "Apache-2.0", 0), ("None", "GPL-3.0", 5), ("None", "MIT", 0)]
    assert licenses.scan(docs.limit(0)).count() == 0
    assert len(scanner.matches(f"{licenses.TEMPLATES[4][1]}\n" * 300)) == 300
    with pytest.raises(ValueError):
        licenses.Scanner(threshold=0)


@pytest.mark.parametrize(
    "text, name",
    [
        ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
        ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"),
        ("Licensed under CC BY-NC 3.0.", "CC-BY-NC-3.0"),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
        ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
        ("Licensed under the Apache License, Version 1.1.", "Apache-1.1"),
        ("Released under the BSD 2-Clause License.", "BSD-2-Clause"),
        (licenses.TEMPLATES[7][1].split("Neither")[0], "BSD-2-Clause"),
    ],
)
def test_siblings_have_their_own_names(text, name):
    assert [m[3].name for m in licenses.Scanner().matches(f"some words {text} and more")] == [name]


@tables
def test_licence_lines_of_the_test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    expected = {r.doc_id for r in docs.where(F.lower("text").rlike("licen")).collect()}
    assert {r.doc_id for r in registry.QUERIES["op9_license_scan"](spark, SF).collect()} == expected


@tables
def test_other_scripts_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    assert all(model.rejects(model.predict(t)) for t in ("Привет мир это русский текст о погоде и природе", "这是一个中文句子，用来测试语言识别。", "αβγδε ζηθικ λμνξο"))
    assert langid.identified(docs, model).count() >= 0.999 * docs.count()


def test_samples_take_one_row_of_an_id(spark):
    docs = spark.createDataFrame([(1, "b", "x"), *[(1, "a", "x")] * 50, (None, "c", "y"), (2, None, "x"), (3, "d", None)], "doc_id long, text string, lang string")
    assert sorted(map(str, (tuple(r) for r in langid.sample(docs, 1000).collect()))) == ["(1, 'a', 'x')", "(None, 'c', 'y')"]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    seen = []
    keep = quality.train
    try:
        quality.train = lambda texts, good: seen.append((texts, good)) or keep(texts, good)
        quality.fit(docs, labels)
    finally:
        quality.train = keep
    assert seen == [(["a", ""], [1, 0])]
