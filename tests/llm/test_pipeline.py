"""The stages on small tables against the same decisions made plainly."""

import os
import unicodedata

import corpus_pipeline
from llm_cases import SF, documents, texts
from test_exact import _reference, brute_classes, brute_hits, brute_print

from tessera.llm import decontaminate, langid, pii


def tables(spark, path, rows, items):
    documents(spark, rows).drop("__text").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_all_stages(spark, tmp_path):
    passage = " ".join(f"item{i}" for i in range(20))
    rows = [(i, t) for i, t in enumerate(texts(9, 40))] + [(100, f"start {passage} end"), (99, f"{'long before ' * 400} {passage} {'and after ' * 400}"), (98, "\u00bd \u00b2 \u2167"), (101, None), (102, "123 456"), (103, "mail me at a.b@c.org now"), (104, "mail me at a.b@c.org now"), (105, ""), (None, "no id here at all")]
    items = [(1, passage), (2, None)]
    sf = tables(spark, tmp_path, rows, items)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    langs = {(r.doc_id): r.lang_pred for r in langid.identify(docs, langid.fit(docs)).collect()}
    left = [(i, t) for i, t in rows if t and any(unicodedata.category(c)[0] == "L" for c in t)]
    assert all((langs[i] == "und") == ((i, t) not in left) for i, t in rows)
    of = brute_classes([(i, brute_print(t)) for i, t in left if i is not None], 3)
    left = [(i, t) for i, t in left if i is None or of[i] == i]
    hits = {i: brute_hits(t, items) for i, t in left}
    left = [(i, t) for i, t in left if not hits[i][1]]
    clean = [(i, pii._redact(t, found)) for (i, t), found in zip(left, pii.find([t for _, t in left], pii.trained()))]
    reference = _reference()
    assert set(got) == {i for i, _ in clean} and not {98, 99, 100} & set(got) and 103 in got and 104 not in got and None in got
    for i, t in clean:
        assert list(got[i].ids) == reference.encode_ordinary(t) and got[i].n_chars == len(t) and got[i].round_trip and got[i].lang == langs[i]


def test_stages_keep_columns_whatever_their_names(spark, tmp_path):
    sf = tables(spark, tmp_path, [], [])
    docs = documents(spark, [(1, "w1 w2 w3"), (1, "w1 w2 w3"), (2, None), (None, "w5")]).selectExpr("*", "'a' as lang_pred", "'b' as mixture", "'c' as redacted", "4 as `__d0x`", "'d' as decoded", "5 as items")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() <= docs.count(), name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    assert corpus_pipeline.tokens(spark, docs, sf).count() == 4


def test_texts_of_one_id_are_judged_apart(spark, tmp_path):
    one, two, near = ("w1 " * 30, "quite another text about other things " * 6, "w1 " * 31)
    docs = documents(spark, [(1, one), (5, near), (5, two), (5, two), (6, two)]).drop("__text")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, one), (5, two)]


def test_a_large_benchmark_is_joined(spark, tmp_path, monkeypatch):
    passage = " ".join(f"item{i}" for i in range(20))
    sf = tables(spark, tmp_path, [], [(1, passage), (None, "two words"), (3, "été")])
    docs = documents(spark, [(1, f"a {passage} b"), (1, "clean"), (2, None), (3, "has two words"), (3, "clean"), (4, "Été, été")])
    docs = docs.selectExpr("*", "map('a', 1) as m")
    scan = decontaminate.scan
    got = [sorted((r.doc_id, r.text or "") for r in corpus_pipeline.contamination(spark, docs, sf).collect())]
    monkeypatch.setattr(decontaminate, "scan", lambda *a, **k: scan(*a, **k, block_bytes=0))
    got.append(sorted((r.doc_id, r.text or "") for r in corpus_pipeline.contamination(spark, docs, sf).collect()))
    assert got == [[(1, "clean"), (2, ""), (3, "clean")]] * 2


def test_nothing_goes_in(spark, tmp_path):
    sf = tables(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_a_table_of_ids_and_texts_alone(spark, tmp_path):
    sf = tables(spark, tmp_path, [], [])
    docs = spark.createDataFrame([(1, "mail a.b@c.org now"), (2, None)], "doc_id bigint, text string")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() == 2, name
    assert corpus_pipeline.tokens(spark, docs, sf).count() == 2


def test_stages_are_listed():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "pii", "byte_bpe"]
    assert os.path.isdir(SF)
