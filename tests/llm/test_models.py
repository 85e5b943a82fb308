"""Trained operators: held-out rows, invariants and defined results."""

import numpy as np
import pytest
from llm_cases import ODD, SF, collected, documents

from tessera.llm import extract, langid, pii, queries, toxicity


def held_out_toxicity(spark, sf):
    got = collected(queries.op1_toxicity(spark, sf))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(got[i], y) for i, y in labels.items() if i in got and got[i]["held_out"]]
    hits = sum(r["predicted"] == 1 == y for r, y in held)
    return hits / max(1, sum(r["predicted"] for r, _ in held)), hits / max(1, sum(y for _, y in held))


@pytest.mark.xfail(reason="1.00 and 0.64 (9 of 14 rows) with the labels of 1,000 documents (37 toxic ones to learn from)", strict=True)
def test_toxicity_on_held_out_rows(spark):
    precision, recall = held_out_toxicity(spark, SF.replace("0.001", "0.01"))
    assert precision > 0.8 and recall > 0.8


def test_toxicity_on_held_out_rows_of_more_documents(spark):
    precision, recall = held_out_toxicity(spark, SF.replace("0.001", "0.1"))
    print(precision, recall)
    assert precision > 0.8 and recall > 0.8


def test_toxicity_of_odd_texts_and_without_labels(spark):
    rows = list(enumerate(ODD)) + [(100, None), (None, "x"), (3, "again")]
    docs = documents(spark, rows)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, none)
    scored = toxicity.score(docs, model).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    some = spark.createDataFrame([(0, None), (1, 1), (2, 0), (None, 1), (1, 0), (77, 1)], "doc_id bigint, toxic int")
    assert toxicity.score(documents(spark, []), toxicity.fit(docs, some)).count() == 0


def test_toxicity_thresholds_fit_all_rows_not_the_sample(spark):
    kinds = ["vile"] * 140 + ["maybe"] * 60 + ["maybe"] * 320 + ["fine"] * 1280  # the first 200 are toxic
    docs = documents(spark, [(i, f"some {k} words") for i, k in enumerate(kinds)])
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(len(kinds))], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels, sample=200)  # where maybe is toxic more often than not
    vile, maybe, fine = model.score(["some vile words", "some maybe words", "some fine words"])
    assert fine <= maybe < toxicity.CUT <= vile


def test_the_same_rows_train_the_same_model():
    texts = [f"good word{i} here" for i in range(40)] + [f"vile slur{i % 3} here" for i in range(40)]
    a, b = (toxicity.train(texts, [0] * 40 + [1] * 40, ["en"] * 80, rounds=3) for _ in range(2))
    assert np.array_equal(a.score(texts), b.score(texts))
    assert a.score(["a vile thing"])[0] > a.score(["a good thing"])[0]


def test_language_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.01")
    got = collected(queries.op6_language_id(spark, sf))
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.lang and got[r.doc_id]["held_out"]]
    assert np.mean([got[r.doc_id]["lang_pred"] == r.lang for r in docs]) > 0.9


def test_a_mixture_of_two_languages(spark):
    en, de = "the house and the garden with all of them there", "das haus und der garten mit allen von ihnen dort"
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate([(en, "en"), (de, "de")] * 20)], "doc_id bigint, text string, lang string")
    profile = langid.fit(docs)
    mixed = spark.createDataFrame([(1, " ".join([en] * 6 + [de] * 5)), (2, " ".join([en] * 9)), (3, "123 !"), (4, None), (5, ""), (6, "\u00bd \u00b2 \u2167 _ 7")], "doc_id bigint, text string")
    got = collected(langid.identify(mixed, profile))
    assert got[1]["lang_pred"] == "en" and "de:" in got[1]["mixture"] and "en:" in got[1]["mixture"]
    assert got[2]["mixture"] == "en:1.000" and [got[i]["lang_pred"] for i in (3, 4, 5, 6)] == ["und"] * 4


def test_languages_of_odd_texts_and_of_nothing(spark):
    rows = list(enumerate(ODD)) + [(100, None), (None, "x"), (3, "again")]
    docs = documents(spark, rows)
    assert langid.identify(docs, langid.fit(docs)).count() == len(rows)
    empty = documents(spark, [])
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(empty)).collect()} == {"und"}
    assert langid.identify(empty, langid.fit(docs)).count() == 0


def test_personal_data(spark):
    lines = {
        1: "write to ann.lee@mail.example.com or +1 (415) 555-2671 today",
        2: "card 4111 1111 1111 1111 from 10.20.30.40, not 999.1.1.1",
        3: "reach jo.smith (at) acme.example.org now",
        4: "nothing of the kind, 2026-03-01, $120.50, v1.2.3",
        5: None,
    }
    got = collected(pii.detect(documents(spark, list(lines.items())), pii.trained(), redacted=True))
    kinds = lambda i: {s["kind"] for s in got[i]["spans"]}
    assert kinds(1) == {"email", "phone"} and kinds(2) == {"card", "ip"} and not kinds(4) and not kinds(5)
    assert "[EMAIL]" in got[1]["redacted"] and "ann.lee" not in got[1]["redacted"] and got[4]["redacted"] == lines[4] and got[5]["redacted"] == ""
    assert kinds(3) == {"email"}  # by the network alone
    for i, t in lines.items():
        base = sorted((pii.KINDS.index(s["kind"]), s["start"], s["stop"]) for s in got[i]["spans"] if s["base"])
        assert base == sorted(pii.base_spans(t or ""))


def test_a_short_address_spelt_out():
    text = "mail bob [at] corp [dot] com please"
    assert [pii.KINDS[k] for k, *_ in pii.find([text], pii.trained())[0]] == ["email"]


def test_the_network_decodes_by_its_transitions():
    model = pii.trained()
    rng = np.random.default_rng(1)
    e = rng.normal(size=(3, 6, len(model.b))).astype(np.float32)
    from itertools import product

    def score(row, labels):
        return sum(row[s, y] for s, y in enumerate(labels)) + sum(model.t[a, b] for a, b in zip(labels, labels[1:])) - 1e4 * (labels[0] >= 2 and labels[0] % 2 == 0)

    for row, got in zip(e[:1, :4], model.decode(e[:1, :4])):
        best = max(product(range(len(model.b)), repeat=4), key=lambda ls: score(row, ls))
        assert tuple(got) == best


def test_gradients_are_the_slopes_of_the_loss():
    rng = np.random.default_rng(2)
    n = len(pii.trained().b)
    m = pii.Tagger(*(rng.normal(0, 0.3, s).astype(np.float64) for s in ((2, 132, 12), (2, 3, 12), (2, 3, n), (n,), (n, n))))
    codes, gold = rng.integers(0, 132, (2, 7)).astype(np.int16), rng.integers(0, n, (2, 7))
    loss, grads = m.gradients(codes, gold)
    for p, g in zip((m.u, m.o, m.b, m.t), grads[1:]):
        at = tuple(rng.integers(0, s) for s in p.shape)
        p[at] += 1e-3
        slope = (m.gradients(codes, gold)[0] - loss) / 1e-3
        p[at] -= 1e-3
        assert abs(slope - g[at]) < 2e-2 * max(1, abs(slope))


def test_personal_data_in_odd_texts(spark):
    rows = list(enumerate(ODD)) + [(100, None), (None, "a@b.co"), (3, "a@b.co"), (3, "a@b.co")]
    got = pii.digest(pii.detect(documents(spark, rows), pii.trained())).collect()
    assert len(got) == len(rows) and sum(r.n_email for r in got) == 3
    assert pii.detect(documents(spark, []), pii.trained(), redacted=True).count() == 0


def test_counts_and_hash_are_of_the_rules_spans_alone(spark):
    text = "write to anna.bell [at] mailhost [dot] org or zoe@b.co, at " + "0" * 5000 + "1.2.3.4"
    assert any(not base for *_, base in pii.find([text], pii.trained())[0])  # the network adds one
    (r,) = pii.digest(pii.detect(documents(spark, [(1, text)]), pii.trained())).collect()
    found = pii.base_spans(text)
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for k, *_ in found) for i in range(4)) == (1, 1, 0, 0)


PAGE = """<html><head><title>T</title><script>var x = "<p>no</p>";</script><style>p{{}}</style></head><body>
<header class="site-header"><a href="/">Home</a></header><nav><ul><li><a>One</a></li><li><a>Two</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site to improve everything.</p></div>
<article><h1>The  title</h1><p>First &amp; foremost, {long}.</p><div class="ad"><p>Buy now cheap stuff</p></div><p>Caf&eacute; <b>bold</b>text &lt;tag&gt;.</p></article>
<section class="comments"><h3>Comments</h3><div class="comment"><p>I disagree with this whole article a lot.</p></div></section>
<aside class="sidebar"><p>Related things to read now</p></aside><footer><p>Copyright nobody</p></footer></body></html>"""


def test_pages(spark):
    long = " ".join(f"word{i}" for i in range(120))
    rows = [(1, "u", PAGE.format(long=long)), (2, None, None), (3, "u", ""), (None, "u", "<nav>only a menu</nav>"), (4, "u", "<p>unclosed <b>and <i>odd"), (5, "u", "<" * 3000), (6, "u", "plain " * 50_000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = {r.page_id: r.text for r in extract.extract(df).collect()}
    assert got[1] == f"The title First & foremost, {long}. Café boldtext <tag>."
    assert got[2] == got[3] == "" and got[4] == "unclosed and odd" and len(got[6]) == 300_000 - 1
    assert extract.extract(df.limit(0)).count() == 0


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.op8_html_extraction(spark, SF).collect()}
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got.values())
    assert np.mean([bool(r.text) for r in got.values()]) > 0.9
    assert not any("<p" in r.text or "</" in r.text for r in got.values())


def test_the_role_of_an_element_after_many_words():
    long = " ".join(f"word{i}" for i in range(60))
    utility = " ".join(f"u{a}" for a in "abcdefghijklmnopqrst")
    page = f"<article><p>{long}</p></article><div class='{utility} comments comment discussion'><p>{long} no</p></div>"
    assert extract.main_text(page, extract.trained()) == long


@pytest.mark.parametrize("name", ["svg", "select", "object", "canvas", "audio", "video", "noscript", "template"])
def test_unclosed_elements_do_not_end_the_page(name):
    long = " ".join(f"word{i}" for i in range(60))
    weights = extract.trained()
    for after in ("", f"<{name}>no</{name}>"):
        assert extract.main_text(f"<div><{name}></div><article><p>{long}</p>{after}</article>", weights) == long
    assert extract.main_text(f"<article><p>{long}</p><script>let x</article>", weights) == long
    assert extract.main_text(f"<article><p>{long} <math><mi>x</mi></math></p></article>", weights) == f"{long} x"
