"""Quality rules, URL filter, language identification, quality classifier, HTML extraction."""

import re
from collections import Counter

import numpy as np
from samples import ODD_TEXTS, running_text

from breathline.llm.html_text import BoostedTrees, Page, extract_main_text, train_node_model
from breathline.llm.language_id import ByteGru, identify_languages, keep_identified, train_language_model
from breathline.llm.quality_model import fit_additive_model, keep_good, score_quality, text_features, train_quality_model
from breathline.llm.quality_rules import quality_rules, text_measures
from breathline.llm.queries import URL_RULES
from breathline.llm.shared import Workspace
from breathline.llm.url_filter import url_filter


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(words, words[1:], words[2:], strict=False))
    often = Counter(windows)
    covered = {p + k for p, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_text_measures_against_brute_force(spark):
    texts = [*ODD_TEXTS, "a b c a b c", "x x x x x", "q\nq\n \nq", running_text(1, 400) + "\n" + running_text(2, 50) * 2]
    rows = text_measures(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(texts[r.i])


def test_quality_rules_keep_plain_text_and_drop_outliers(spark, odd_documents, no_documents):
    rows = [(i, running_text(i, 80), "en", f"s{i % 2}") for i in range(300)]
    rows += [(1000 + i, " ".join(w + "###" for w in running_text(i, 80).split()), "en", "s0") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_rules(df, Workspace(spark, "t"), min_group=50).collect()}
    assert all(got[i].kept for i in range(300)) and not any(got[1000 + i].kept or got[1000 + i].base_failed for i in range(5))
    odd = quality_rules(odd_documents, Workspace(spark, "t")).collect()
    assert len(odd) == odd_documents.count() and all(r.base_failed and not r.kept for r in odd if r.n_words < 50)
    assert quality_rules(no_documents, Workspace(spark, "t")).count() == 0


def test_url_filter(spark):
    urls = [f"http://a{i}.example.com/en/{i}" for i in range(40)] + [f"https://b.x.net/fr/{i}" for i in range(40)] + [f"http://c.com/de/{i}" for i in range(40)]
    odd = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1?q#f", "http://x.org", "ftp://badexample.com/en/", "http://q.example.org/fr/5", urls[0]]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls + odd)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter(df, URL_RULES, Workspace(spark, "t"), min_support=0.05).collect()}
    assert len(got) == len(urls + odd)
    assert (got[0].rule, got[0].verdict) == ("example.com/en/", "block") and got[41].rule == "net/fr/" and got[90].rule == "com/"
    o = [got[len(urls) + k] for k in range(len(odd))]
    assert all(x.host == "" and x.path == "" and x.rule is None and x.verdict == "allow" for x in o[:4])
    assert (o[4].host, o[4].path, o[4].rule, o[4].verdict) == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert (o[5].path, o[5].rule) == ("", None) and o[6].rule == "com/"
    assert o[7].rule is None and o[7].verdict == "block"  # the mined rules: path part fr goes with block
    assert url_filter(df.where("false"), URL_RULES, Workspace(spark, "t")).count() == 0


def test_gru_gradients():
    model = ByteGru(["a", "b", "c"], hidden=5)
    for k in model.p:
        model.p[k] = model.p[k].astype(np.float64)
    x = np.frombuffer(b"abcxyzhey", np.uint8).reshape(3, 3).T
    y, weight = np.array([0, 1, 2]), np.array([1.0, 2.0, 0.5])

    def loss():
        return -(np.log(model.positions(x)[:, np.arange(3), y]) * weight).sum() / x.size

    grads = model.step(x, y, weight)
    for name in ("xf", "hf", "cb", "hb", "out", "bias"):
        at = (ord("b"), 3) if name == "xf" else tuple(s // 2 for s in model.p[name].shape)
        old = model.p[name][at]
        model.p[name][at] = old + 1e-5
        up = loss()
        model.p[name][at] = old - 1e-5
        down = loss()
        model.p[name][at] = old
        assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-4


def test_languages_are_told_apart(spark, odd_documents, no_documents):
    import random

    rng = random.Random(4)
    other = "der schnelle fuchs springt über faule hunde während sieben zauberer tränke mischen".split()
    rows = [(i, running_text(i, 40), "en") for i in range(80)] + [(100 + i, " ".join(rng.choice(other) for _ in range(40)), "de") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train_language_model(df.where("doc_id % 3 <> 1"), "text", "lang", "doc_id", steps=150)
    got = {r.doc_id: r for r in identify_languages(df, model).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows if i % 3 == 1]) > 0.95
    odd = identify_languages(odd_documents, model).collect()
    assert len(odd) == odd_documents.count() and all(0 <= r.score <= 1 for r in odd)
    assert {r.doc_id for r in odd if r.lang_pred == "und"} == {0, 1, 2} and len(keep_identified(odd_documents, model).collect()) == len(odd) - 3
    assert train_language_model(no_documents, "text", "lang", "doc_id") is None
    assert {r.lang_pred for r in identify_languages(odd_documents, None).collect()} == {"und"}
    assert identify_languages(no_documents, model).count() == 0 and keep_identified(no_documents, model).count() == 0


def test_rare_languages_and_late_words_are_learnt(spark):
    import random

    from breathline.llm.language_id import least_score, sample_words

    rng = random.Random(5)
    rare = "kxqz wvvx qqzk zxkw vqkz".split()
    rows = [(i, running_text(i, 60), "en") for i in range(3000)] + [(5000 + i, " ".join(rng.choices(rare, k=40)), "xx") for i in range(4)]
    rows += [(6000, "1 " * 4000 + " ".join(rare * 30), "yy"), (6001, None, "xx"), (6002, "text", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    drawn = sample_words(df, "text", "lang", "doc_id", 300, 3000).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in drawn} == {"en": 1000, "xx": 160, "yy": 150}
    model = train_language_model(df.where("lang <> 'yy'"), "text", "lang", "doc_id", max_docs=300, steps=150)
    asked = spark.createDataFrame([(1, " ".join(rare)), (2, running_text(9999, 30)), (3, "kxqzwvvxqqzk" * 30)], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in identify_languages(asked, model).collect()} == {1: "xx", 2: "en", 3: "xx"}
    assert least_score(1) <= 1 and all(1 / n < least_score(n) < 1.2 / n for n in (2, 4, 50))
    one = train_language_model(df.where("lang = 'xx'"), "text", "lang", "doc_id", steps=5)
    assert keep_identified(asked, one).count() == 3


def test_training_samples_reach_the_driver_as_arrow(spark, monkeypatch):
    texts = [running_text(i, 40) for i in range(60)]
    df = spark.createDataFrame([(i, t, "en" if i % 2 else "de") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    collect, held = type(df).collect, []

    def noted(frame):
        found = collect(frame)
        held.append(len(found))
        return found

    monkeypatch.setattr(type(df), "collect", noted)
    assert train_language_model(df, "text", "lang", "doc_id", steps=2).labels == ["de", "en"]
    train_quality_model(df, labels, "doc_id", "text", "quality")
    assert max(held, default=0) <= 2  # a count of each language, never the words


def test_quality_model_learns_and_interacts(spark, odd_documents, no_documents):
    rng = np.random.default_rng(0)
    x = rng.random((3000, 13)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # only a pair can say it
    model = fit_additive_model(x[:2000], y[:2000])
    assert (0, 1) in model.pairs and np.mean((model.score(x[2000:]) > 0.5) == y[2000:]) > 0.9
    rows = [(i, running_text(i, 60) if i % 2 else running_text(i, 60).upper().replace(" ", "!! ")) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200) if i % 5] + [(5, None), (None, 1), (9999, 0)], "doc_id long, quality int")
    model = train_quality_model(df, labels, "doc_id", "text", "quality")
    scores = {r.doc_id: r.score for r in score_quality(df, model).collect()}
    assert all((scores[i] > 0.5) == bool(i % 2) for i in range(200)) and keep_good(df, model).count() == 100
    odd = score_quality(odd_documents, model).collect()
    assert len(odd) == odd_documents.count() and all(0 <= r.score <= 1 for r in odd)
    empty = train_quality_model(no_documents, labels, "doc_id", "text", "quality")
    assert score_quality(no_documents, empty).count() == 0 and score_quality(odd_documents, empty).first().score == 0.5


def test_text_features_of_empty_texts():
    import pyarrow as pa

    found = text_features(pa.array([None, "", "One two. One two.\nOne two."]))
    assert not found[0].any() and not found[1].any() and found[2].any() and np.isfinite(found).all()


PAGE = (
    "<!DOCTYPE html><html><head><title>T {i}</title><script>var x='</p>';</script></head><body><nav><ul><li><a href='/a'>Home</a><li><a href='/b'>More</a></ul></nav>"
    "<div class='ad'>Buy {i} now.</div><article><h1>Head {i}</h1><p>{a} &amp; so on.<p><b>Bold</b> {b}<br>end</article><footer>&copy; {i}</footer></body></html>"
)


def test_main_text(spark):
    rows = [(i, f"u{i}", PAGE.format(i=i, a=running_text(i, 30), b=running_text(-i, 20)), "x") for i in range(60)]
    odd = [(100, None, None, "x"), (101, "u", "", "x"), (102, "u", "<" * 500, "x"), (103, "u", "<div>" * 300 + "</p>" * 300, "x"), (0, "u0", rows[0][2], "x")]
    df = spark.createDataFrame(rows + odd, "page_id long, url string, html string, text string")
    got = extract_main_text(df, train_node_model(df, "html")).collect()
    assert len(got) == 65 and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    for r in got:
        if r.page_id < 60:
            expected = f"Head {r.page_id}\n\n{running_text(r.page_id, 30)} & so on.\n\nBold {running_text(-r.page_id, 20)} end"
            assert r.text == expected and r.n_chars == len(expected)
        elif r.page_id != 102:  # a page of mere "<" is text, if any
            assert r.text == "" and r.n_chars == 0
    assert extract_main_text(df.where("false"), (BoostedTrees(), {})).count() == 0


def test_main_text_inside_wrappers_whose_classes_name_other_parts(spark):
    plain = [(i, f"u{i}", PAGE.format(i=i, a=running_text(i, 30), b=running_text(-i, 20))) for i in range(40)]
    body, article = "<body class='has-sidebar nav'>", "<article class='post comments-open share'>"
    page = plain[0][2]
    wrapped = [
        page.replace("<body>", body), page.replace("<article>", article), page.replace("<body>", body).replace("<article>", article),
        page.replace("<article>", "<main class='with-nav'><article>").replace("end</article>", "end</article></main>"),
        page.replace("<article>", "<div class='content no-sidebar'><article>").replace("end</article>", "end</article></div>"),
    ]
    for source in wrapped:
        parsed = Page(source)
        label = parsed.teacher()
        assert label[parsed.tag.index("article")] == 1 and label[parsed.tag.index("p")] == 1
        assert label[parsed.tag.index("nav")] == 0 and label[parsed.tag.index("footer")] == 0
    assert [Page(f"<div class='{c}'>x</div>").teacher()[1] for c in ("sidebar", "site-footer", "main-nav", "post")] == [0, 0, 0, 1]
    columns = "page_id long, url string, html string"
    odd = spark.createDataFrame([(100 + k, "u", x) for k, x in enumerate(wrapped)], columns)
    got = extract_main_text(odd, train_node_model(spark.createDataFrame(plain, columns), "html")).collect()
    expected = f"Head 0\n\n{running_text(0, 30)} & so on.\n\nBold {running_text(0, 20)} end"
    assert [r.text == expected for r in got] == [True] * len(wrapped)


def test_pages_for_training_are_distinct(spark):
    from breathline.llm.html_text import _distinct_sample

    pages = spark.createDataFrame([(f"<p>{i}</p>",) for i in range(40)] + [(f"<p>copy {i % 3}</p>",) for i in range(120)], "html string")
    got = [r.html for r in _distinct_sample(pages, 30).collect()]
    assert len(got) == 30 and len(set(got)) == 30
    assert {r.html for r in _distinct_sample(pages, 100).collect()} == {r.html for r in pages.distinct().collect()}


def test_tree_labels_never_contradict():
    page = Page("<body><nav><div><article><p>deep</p></article></div></nav><main><p>text</p><aside><p>side</p></aside></main></body>")
    kept = page.decode(np.random.default_rng(1).normal(0, 5, len(page.tag)))
    states = page.decode(np.array([-9.0 if t in ("nav", "aside") else 2.0 for t in page.tag]))
    assert page.text(states) == "text"
    assert len(kept) == len(page.tag)
    assert all(not states[n] for n in range(1, len(page.tag)) if page.tag[page.parent[n]] in ("nav", "aside"))


def test_names_inside_an_article_do_not_drop_its_text(spark):
    plain = [(i, f"u{i}", PAGE.format(i=i, a=running_text(i, 30), b=running_text(-i, 20))) for i in range(40)]
    model = train_node_model(spark.createDataFrame(plain, "page_id long, url string, html string"), "html")
    words = running_text(99, 12)
    inside = {
        f"<p>See <a href=\"/page?id=comments\">{words}</a> there.</p>": f"See {words} there.",
        f"<p data-id=\"sidebar\">{words}</p>": words,
        f"<p class=\"market share\">{words}</p>": words,
        "<h2 id=\"legal-history\">Legal history</h2>": "Legal history",
        f"<p id='x' title=\"a > b id='menu'\">{words}</p>": words,
    }
    pages = [(k, "u", plain[0][2].replace("end</article>", f"end{part}</article>")) for k, part in enumerate(inside)]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()}
    before = f"Head 0\n\n{running_text(0, 30)} & so on.\n\nBold {running_text(0, 20)} end"
    assert got == {k: f"{before}\n\n{text}" for k, text in enumerate(inside.values())}


def test_parts_beside_an_article_go_by_their_names():
    for part in ("<p class='ad'>x</p>", "<div id='comments'>x</div>", "<p class='cookie'>x</p>", "<div class='share social'>x</div>", "<div role=navigation>x</div>"):
        assert Page(part).teacher()[1] == 0
    for part in ("<h2 id='share'>x</h2>", "<p class='market share'>x</p>", "<div data-role='menu'>x</div>", "<a href='?class=ad'>x</a>"):
        assert Page(part).teacher()[1] == -1


def test_many_unknown_end_tags_take_linear_time():
    import time

    began = time.time()
    Page("<p>x</p>" * 20_000 + "</unknown>" * 40_000)
    assert time.time() - began < 10
