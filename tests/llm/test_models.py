"""Language, quality and page extraction: hard rows, held-out accuracy, and exact page texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelworks.llm import language, quality, wrapper
from panelworks.llm.queries import QUERIES
from tests.llm.conftest import prose


def test_language_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op1_language_id"](spark, sf).where("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.98 * len(got)


def test_language_on_hard_rows(hard, none):
    got = language.identify(hard).collect()
    assert len(got) == hard.count() and all(0 <= r.score <= 1 for r in got)
    unclear = {r.doc_id for r in got if r.lang_pred == "und"}
    assert {6, 7, 8, 16} <= unclear and {r.lang_pred for r in got} <= {"xx", "yy", "und"}
    kept = language.keep_identified(hard)
    assert kept.columns == hard.columns and not {6, 7, 8, 16} & {r.doc_id for r in kept.collect()}
    assert language.identify(none).count() == language.keep_identified(none).count() == 0
    assert {r.lang_pred for r in language.identify(hard.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_held_out_rows_and_labels_do_not_enter(hard):
    learned = language.learn_dictionaries(hard)
    changed = hard.withColumn("lang", F.when(language.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    assert language.learn_dictionaries(changed) == learned


LANGUAGES = "doc_id long, text string, lang string"


def vocabulary_text(lang, words, seed):
    rng = np.random.default_rng(seed)
    return " ".join(np.array([f"{lang}{w}" for w in prose(5 if lang == "xx" else 6, 100).split()])[rng.integers(0, 100, words)])


def test_long_texts_keep_their_margin(spark):
    rows = [(i, vocabulary_text("xx" if i % 2 else "yy", 200, i), "xx" if i % 2 else "yy") for i in range(40)]
    rows += [(100 + i, vocabulary_text("xx", n, 100), None) for i, n in enumerate((100, 10_000, 1_000_000))]
    docs = spark.createDataFrame(rows, LANGUAGES)
    assert {100, 101, 102} <= {r.doc_id for r in language.keep_identified(docs).collect()}
    margins = {r.doc_id: r.margin for r in language.identify(docs).collect()}
    assert margins[102] > 0.5 * margins[101]


def test_languages_of_only_long_or_only_short_texts(spark):
    rows = [(i, vocabulary_text("xx", 4000, i), "xx") for i in range(3)] + [(i, vocabulary_text("yy", 4, i), "yy") for i in range(3, 6000)]
    rows += [(7000, "ab", "zz"), (7001, "ab", "zz")]
    docs = spark.createDataFrame(rows, LANGUAGES)
    learned = language.learn_dictionaries(docs)
    assert len(learned["xx"]) > 0.5 * language.DICTIONARY and len(learned["yy"]) == language.DICTIONARY and len(learned["zz"]) >= 8
    assert {r.lang_pred for r in language.identify(docs).where("doc_id < 3").collect()} == {"xx"}


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = QUERIES["op5_quality"](spark, sf).where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)


def test_quality_on_hard_rows(spark, hard, none):
    rows = [(1, 1, 0), (4, 1, 0), (15, 0, 0), (5, 0, 1), (99, 1, 1), (None, 0, 0), (9, None, None), (11, 3, 0), (1, 1, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    got = quality.score_quality(hard, labels).collect()
    assert len(got) == hard.count() and all(0 <= r.score <= 1 and (r.predicted == 1) == (round(r.score, 12) >= 0.7) for r in got)
    assert quality.score_quality(none, labels).count() == 0
    one = quality.score_quality(hard, labels.where("quality = 1")).collect()
    assert {(round(r.score, 9), r.predicted) for r in one} == {(0.7, 1)}


def test_ranking_learns_from_every_row_and_pair(spark):
    rng = np.random.default_rng(2)
    features, labels = rng.normal(size=(300, quality.FEATURES)), rng.integers(0, 2, 300)
    features[:, 3] += labels
    data = [(x.tolist(), int(y)) for x, y in zip(features, labels)]
    one, other = (quality.fit_rows(spark.createDataFrame(data, "features array<double>, label int").repartition(k)) for k in (1, 5))
    assert (one[0] == other[0]).all() and one[1] == other[1]
    assert np.isclose(one[1], np.quantile(features @ one[0], (labels == 0).mean(), method="midpoint"), rtol=1e-12)
    scale = features.std(axis=0)
    apart = ((features[labels == 1][:, None] - features[labels == 0][None]) / scale).reshape(-1, quality.FEATURES)
    w = one[0] * scale
    slope = apart.T @ (1 / (1 + np.exp(apart @ w))) / len(apart) - quality.RIDGE * w
    assert np.abs(slope).max() < 2e-5


def test_score_of_a_rank_is_exact(spark, monkeypatch):
    monkeypatch.setattr(quality, "PICKED", 3)
    values = np.concatenate((np.random.default_rng(4).normal(size=500) ** 5, np.full(40, 0.25)))
    scores = spark.createDataFrame([(float(v),) for v in values], "score double").repartition(3)
    assert [quality._ranked(scores, k) for k in (0, 270, 539)] == np.sort(values)[[0, 270, 539]].tolist()


def test_ranking_orders_a_separable_sample():
    rng = np.random.default_rng(1)
    features = rng.normal(size=(400, 5))
    labels = (features[:, 2] > -1).astype(int)
    weights, threshold = quality.fit(features, labels)
    assert ((features @ weights >= threshold) == (labels == 1)).mean() > 0.97


TEMPLATE = """<!DOCTYPE html><html><head><title>T</title><script>var x = "<p>no</p>";</script><style>p{{}}</style></head>
<body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home<li>News</ul></nav>
<div class="cookie-notice">We use cookies</div><div id="sidebar"><p>Links</p></div>{body}
<div class="comments"><p>First!</p></div><form><p>Mail</p><input value="x"></form><footer>&copy; Site</footer></body></html>"""
ARTICLE = "<article><h1>A &amp; B {i}</h1><p><b>Lead  {i}<br>\n more <p>Body &lt;{i}&gt;<!-- no --><div class='ad'>Buy</div><ul><li>x{i}<li>y</ul></article>"
DIVS = "<div><div class=box>Follow us</div><div class=text><p>Para {i} one two three<p>Other {i} four five</div></div>"


def page_rows():
    rows = [(i, f"http://a.example/{i}", TEMPLATE.format(body=ARTICLE.format(i=i))) for i in range(8)]
    rows += [(20 + i, f"https://u@B.example:80/{i}", TEMPLATE.format(body=DIVS.format(i=i))) for i in range(8)]
    rows += [(40, None, None), (41, "x", ""), (None, "http://c.example", "<p>alone<p>page"), (42, "http://d.example/", "plain &eacute; text")]
    rows += [(43, "http://d.example/", "<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>end"), (0, "http://a.example/0", rows[0][2])]
    rows += [(44, "http://a.example/44", "<div"), (45, "http://a.example/45", "<article><p>" + "long " * 50_000 + "</article>")]
    return [(*r, "x", "y") for r in rows]


def test_page_texts(spark):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string, host string, id string")
    got = wrapper.main_text(pages.repartition(3)).collect()
    assert len(got) == len(page_rows())
    text = {r.page_id: r.text for r in got}
    for i in range(8):
        assert text[i] == f"A & B {i}\nLead {i} more\nBody <{i}>\nx{i}\ny"
        assert text[20 + i] == f"Para {i} one two three\nOther {i} four five"
    assert (text[40], text[41], text[None], text[42]) == ("", "", "alone\npage", "plain é text")
    assert text[43] == "deep\nend" and text[44] == "" and text[45] == " ".join(["long"] * 50_000)
    assert wrapper.main_text(pages.limit(0)).count() == 0


def extracted(spark, pages):
    rows = [(i, f"http://{host}/{i}", html) for i, (host, html) in enumerate(pages)]
    got = wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    return [r.text for r in sorted(got, key=lambda r: r.page_id)]


def test_names_are_only_a_hint(spark):
    def page(i):
        return (
            f'<body><div id="page" class="no-sidebar"><div class="sidebar">Links</div><div class="content has-sidebar">'
            f'<div class="entry-header"><h1>Title {i}</h1></div><p class="notice">Mind {i}</p><h2 id="related-work">Related {i}</h2>'
            f'<section id="search-algorithms"><p>Search {i} {"long text " * i}</p></section><p>Body {i} of the page</p></div></div></body>'
        )

    expected = [f"Title {i}\nMind {i}\nRelated {i}\nSearch {i} {'long text ' * i}".strip() + f"\nBody {i} of the page" for i in range(8)]
    assert extracted(spark, [("a.example", page(i)) for i in range(8)]) == expected
    assert extracted(spark, [(f"{i}.example", page(i)) for i in range(8)]) == expected
    marked = [("m.example", f'<body><div class="sidebar"><p>All {i} of it</p></div><div class="ad">Ad {i}</div></body>') for i in range(3)]
    assert extracted(spark, marked) == [f"All {i} of it" for i in range(3)]


@pytest.mark.parametrize("first", [None, "", "<p>404", "<body><div class=list><ul><li>One<li>Two</ul></div></body>"])
@pytest.mark.parametrize("n", [2, 8])
def test_an_odd_first_page_is_not_the_template(spark, first, n):
    boxes = "<div class=box>Follow us</div><div class=legal><span>All rights</span></div>"
    pages = [("a.example", f"<body>{boxes}<div class=text><p>Para {i} one two<p>Other {i} three</div></body>") for i in range(n)]
    got = extracted(spark, [("a.example", first), *pages])
    assert got[1:] == [f"Para {i} one two\nOther {i} three" for i in range(n)]
    assert got[0] == {None: "", "": "", "<p>404": "404"}.get(first, "One\nTwo")


def test_repeated_pages_are_no_template(spark):
    assert extracted(spark, [("a.example", "<body><div><p>Same text</div></body>")] * 6) == ["Same text"] * 6


def test_content_beside_the_slot(spark):
    body = "<div class=body><p>{0}</p></div>"
    pages = [f"<body><div class=box>Follow us</div><div class=page><h1>Title {i}</h1><p>Lead {i}</p>{body.format(f'Body {i} ' * 40)}</div></body>" for i in range(6)]
    assert extracted(spark, [("a.example", p) for p in pages]) == [f"Title {i}\nLead {i}\n{(f'Body {i} ' * 40).strip()}" for i in range(6)]
    two = [f"<body><article class=a><p>First {i} text</p></article><article class=b><p>Second {i} text text</p></article></body>" for i in range(6)]
    assert extracted(spark, [("a.example", p) for p in two]) == [f"First {i} text\nSecond {i} text text" for i in range(6)]


def test_given_pages_give_their_articles(spark, sf_dir):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in QUERIES["op4_html_extraction"](spark, sf_dir).collect():
        article = re.search("<article>(.*)</article>", pages[r.page_id], re.S)[1]
        lines = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n".join(x for x in lines if x) and r.n_chars == len(r.text)


@pytest.mark.parametrize("url, host", [("HTTP://A.b:8/x", "a.b"), ("https://u:p@c.d", "c.d"), ("/x", ""), (None, "")])
def test_host(spark, url, host):
    frame = spark.createDataFrame([(url,)], "url string")
    assert frame.select(wrapper.host_of(F.col("url"))).first()[0] == host
