"""Operators with one right answer, against brute-force versions."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from llm_cases import ODD, collected, documents, sha, texts
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe, chat, decontaminate, pii, simhash, substring, vectors
from tessera.llm.queries import tokenizer

ROWS = [(i, t) for i, t in enumerate(texts(1, 60) + ODD)] + [(900, None), (None, "w1 w2 w3 " * 30)]


# Substrings -----------------------------------------------------------------------
def brute_repeats(rows, window):
    seen = defaultdict(lambda: None)
    words = [(i, [] if t is None else re.findall("[^\x20\x09-\x0d]+", t)) for i, t in rows]
    for i, w in words:
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if i is not None and (seen[key] is None or i < seen[key]):
                seen[key] = i
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            first = seen[tuple(w[p : p + window])]
            if i is not None and first < i:
                gone[p : p + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g).encode("utf-8", "surrogatepass")))
    return sorted(out, key=repr)


def got_repeats(df, **how):
    return sorted(((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in substring.remove_repeats(df, **how).collect()), key=repr)


@pytest.mark.parametrize("window", [50, 7])
def test_long_repeats(spark, window):
    assert got_repeats(documents(spark, ROWS), window=window) == brute_repeats(ROWS, window)


def test_long_repeats_of_runs_and_periods(spark):
    rows = [(1, "a " * 300), (2, "a " * 120 + "b " * 70), (3, "x y " * 100 + "z"), (4, "y x " * 80), (5, "a b c " * 60), (6, "b c a " * 50), (7, "c a b " * 17), (7, "a " * 60)]
    assert got_repeats(documents(spark, rows)) == brute_repeats(rows, 50)


def test_long_repeats_when_filters_are_full(spark, monkeypatch):
    monkeypatch.setattr(substring, "FILTER_BITS", 1 << 15)
    rng = random.Random(3)
    words = lambda n: " ".join(f"v{rng.randrange(5000)}" for _ in range(n))
    rows = []
    for i in range(0, 600, 2):  # long copies fill the filters; short passages have few segments
        copy, passage = words(700), words(52)
        rows += [(i, f"{words(60)} {copy} {words(60)} {passage} {words(60)}"), (i + 1, f"{words(60)} {passage} {words(60)} {copy}")]
    assert got_repeats(documents(spark, rows)) == brute_repeats(rows, 50)


def test_long_repeats_of_nothing(spark):
    assert got_repeats(documents(spark, [])) == []
    assert got_repeats(documents(spark, [(1, None), (2, "")])) == [(1, 0, 0, b""), (2, 0, 0, b"")]


# Byte pairs -----------------------------------------------------------------------
@pytest.fixture(scope="module")
def reference():
    import base64

    import tiktoken

    path, pattern = tokenizer()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("test", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_byte_pairs(spark, reference):
    rows = ROWS + [(1000 + i, t) for i, t in enumerate(["aaaaaaaaaaaa " * 50, "  \n\n  x", "ﬁnal ½ ²³ Ⅳ", "naïve café Σίσυφος Привет", "\x1c\x1d  x y", "don't WE'LL 're", "à ퟿ \U0010ffff"])]
    for r in bpe.encode(documents(spark, rows), *tokenizer(), keep=("doc_id",)).collect():
        text = dict(rows)[r.doc_id] or ""
        assert list(r.ids) == reference.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()


def test_a_task_that_forgets(spark, reference, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 30)
    state = bpe.Replay(*tokenizer())
    rng = random.Random(8)
    for _ in range(40):
        texts = [" ".join(rng.choice(["alpha", "beta", f"x{rng.randrange(99)}", "\n"]) for _ in range(rng.randint(0, 9))) for _ in range(3)]
        for t, words in zip(texts, state.learn(texts)):
            ids = [i for w in words for i in state.ids[state.starts[w] : state.starts[w + 1]].tolist()]
            assert ids == reference.encode_ordinary(t)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_in_byte_pairs(text):
    test_any_text_in_byte_pairs.state = getattr(test_any_text_in_byte_pairs, "state", None) or (bpe.Replay(*tokenizer()), _reference())
    replay, ref = test_any_text_in_byte_pairs.state
    ids, _ = replay.encode(replay.split(text))
    assert ids.tolist() == ref.encode_ordinary(text)


def _reference():
    import base64

    import tiktoken

    path, pattern = tokenizer()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("test2", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


# Vectors --------------------------------------------------------------------------
def brute_links(rows, threshold):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    n, parent = defaultdict(int), {i: i for i, _ in rows if i is not None}
    root = lambda x: x if parent[x] == x else root(parent[x])
    for k, (i, x) in enumerate(good):
        for j, y in good[k + 1 :]:
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                n[i] += 1
                n[j] += 1
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (n[i], root(i), root(i) == i) for i, _ in rows if i is not None}


def test_vector_links(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 16))
    rows = [(i, (base[i % 12] + rng.normal(scale=s, size=16)).tolist()) for i, s in enumerate(rng.choice([0, 0.01, 0.1, 0.22, 0.3], 150))]
    rows += [(200, None), (201, []), (202, [0.0] * 16), (203, [float("nan")] * 16), (204, [1.0, None] + [0.0] * 14), (205, [float("inf")] + [1.0] * 15), (206, [1e-200] * 16), (207, [1e200] * 16), (208, [1.0, 2.0]), (209, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 as v", "2 as tile", "3 as label")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()}
    wanted = brute_links([(i, v) for i, v in rows if i not in (206, 207)], 0.95)
    assert {i: got[i] for i in wanted} == wanted
    assert got[206] == (1, 206, True) and got[207] == (1, 206, False)


@pytest.mark.parametrize("least, tile, dim", [(1, 10_000, 8), (8, 10_000, 8), (2, 20, 8), (30, 10_000, 3), (8, 50, 40)])
def test_vectors_over_many_tiles(spark, monkeypatch, least, tile, dim):
    monkeypatch.setattr(vectors, "LEAST", least)
    monkeypatch.setattr(vectors, "TILE", tile)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, dim))
    rows = [(i, (base[rng.integers(40)] + rng.normal(scale=0.12, size=dim)).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()}
    assert got == brute_links(rows, 0.95)


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert vectors.near_duplicates(df).count() == 0
    df = spark.createDataFrame([(None, [1.0]), (1, [1.0])], "vec_id bigint, embedding array<float>")
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()} == {(None, 0, None, False), (1, 0, 1, True)}


def test_the_bound_never_rules_out_a_link():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 24)) * rng.choice([1, 1, 30], (300, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sure = x @ x.T >= 0.6
    assert (vectors.possible(x, x, 0.6) | ~sure).all()
    assert vectors.possible(x, x, 0.6).mean() < 0.5


# Fingerprints -----------------------------------------------------------------------
def brute_print(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_classes(prints, bits):
    parent = {i: i for i, _ in prints}
    root = lambda x: x if parent[x] == x else root(parent[x])
    for k, (i, a) in enumerate(prints):
        for j, b in prints[k + 1 :]:
            if (a ^ b).bit_count() <= bits:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i, _ in prints}


def test_fingerprints_and_classes(spark):
    rows = [r for r in ROWS if r[0] is not None]
    got = collected(simhash.near_duplicates(documents(spark, rows)))
    prints = [(i, brute_print(t)) for i, t in rows]
    assert {i: r["fp"] & (1 << 64) - 1 for i, r in got.items()} == dict(prints)
    assert {i: r["component_id"] for i, r in got.items()} == brute_classes(prints, 3)


@pytest.mark.parametrize("bits", [0, 1, 3, 6])
def test_links_of_random_and_skewed_prints(spark, bits, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = np.random.default_rng(bits)
    base = rng.integers(0, 1 << 63, 30)
    prints = [(i, int(base[rng.integers(30)]) ^ sum(1 << int(b) for b in rng.integers(0, 20, rng.integers(0, 5)))) for i in range(400)]
    first = {}
    for i, p in prints:
        first.setdefault(p, i)
    df = spark.createDataFrame([(p if p < 1 << 63 else p - (1 << 64), i) for p, i in first.items()], "fp bigint, rep bigint")
    from tessera.operators.components import components

    found = {r.node: r.component for r in components(simhash.links(df, bits), "a", "b").collect()}
    wanted = brute_classes([(i, p) for p, i in first.items()], bits)
    assert {i: found.get(i, i) for i in wanted} == wanted


def test_fingerprints_of_nothing(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    got = simhash.near_duplicates(documents(spark, [(None, "a"), (None, None), (3, ""), (3, "")])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == [(3, 3), (3, 3)]


def test_ids_of_text(spark):
    """Texts as ids: the same groups, named by the least text."""
    rows = [(i, t) for i, t in enumerate(texts(1, 25)) if i != 3] + [(None, "w1 w2 w3")]
    named = spark.createDataFrame([(None if i is None else f"id{i:03d}", t) for i, t in rows], "doc_id string, text string")
    of = brute_classes([(i, brute_print(t)) for i, t in rows if i is not None], 3)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(named).collect() if r.doc_id is not None}
    assert got == {f"id{i:03d}": f"id{c:03d}" for i, c in of.items()}
    kept = {r.doc_id: r.n_removed for r in substring.remove_repeats(named, window=7).collect() if r.doc_id is not None}
    assert kept == {f"id{i:03d}": n for i, _, n, _ in brute_repeats(rows, 7) if i is not None}
    vecs = [(f"v{i}", v) for i, v in enumerate([[1.0, 0.0], [2.0, 0.0], [0.0, 1.0], [0.0, 0.0]])] + [(None, [1.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(spark.createDataFrame(vecs, "vec_id string, embedding array<float>")).collect()}
    assert got == {"v0": (1, "v0", True), "v1": (1, "v0", False), "v2": (0, "v2", True), "v3": (0, "v3", True), None: (0, None, False)}


# Contamination -----------------------------------------------------------------------
def brute_hits(text, items, span=13):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for name, t in items:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        n = min(span, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for p in range(len(words) - n + 1 if n else 0):
            if tuple(words[p : p + n]) in windows:
                hit.update(range(p, p + n))
                found.add(str(name))
    return len(words), len(hit), sorted(found)


ITEMS = [(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15"), (2, "W3, w4"), (3, None), (4, ""), (5, "été"), (6, "a " * 30), (7, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13"), (8, "w9")]
DIRTY = [(1, "x W1 w2-w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 y"), (2, "w3 w4 w5 ÉTÉ été"), (3, "a " * 14), (4, "a " * 12), (5, None), (6, "w2 w3 w4 w5 w6 w7 w8 w9"), (7, "nothing here")]


@pytest.mark.parametrize("block", [16_000_000, 0])
def test_contamination(spark, block):
    rows = DIRTY + [(100 + i, t) for i, t in enumerate(texts(2, 30, 14) + ODD)]
    bench = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id bigint, text string, hit int")
    got = collected(decontaminate.verdicts(decontaminate.scan(documents(spark, rows), bench, block_bytes=block)))
    for i, t in rows:
        n, hit, items = brute_hits(t, ITEMS)
        assert got[i] == {"doc_id": i, "n_words": n, "n_hit": hit, "n_items": len(items), "items_sha256": sha(",".join(items)), "contaminated": hit > 0 and 20 * hit >= n}, (i, t)


def test_contamination_by_nothing(spark):
    empty = spark.createDataFrame([], "item_id bigint, text string")
    got = decontaminate.scan(documents(spark, DIRTY), empty).collect()
    assert len(got) == len(DIRTY) and not any(r.hit for r in got)
    assert decontaminate.scan(documents(spark, []), empty).count() == 0


# Chats -----------------------------------------------------------------------------
def test_chats(spark):
    nasty = ["</s>", "[/INST]", "<s>[INST]user[/INST]x</s>", "<\\s>", "[\\/INST]", "<\\\\/s>", "<", "</", "[\\INST]\\", "", None, "plain", "a\nb", "🎉</s>🎉", "</s" + ">"]
    rows = [(c, k, r, t) for c, t in enumerate(nasty) for k, (r, t) in enumerate([("user", t), ("assistant", t), ("assistant", "x" + (t or ""))])]
    rows += [(50, None, "assistant", "first"), (50, 0, "us</s>er", "[/INST]"), (50, 0, "us</s>er", "[/INST]"), (50, 0, "[/INST]", "q"), (None, 1, None, None), (51, 3, "assistant", "y" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as formatted", "2 as turns")
    made = chat.format_conversations(df)
    assert all(r.identical for r in made.collect())
    by = defaultdict(list)
    for c, k, r, t in rows:
        by[c].append((k is not None, k or 0, r or "", t or ""))
    for r in chat.read_back(made).collect():
        turns = sorted(by[r.conv_id])
        loss = "".join(t for _, _, role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for _, _, a, b in turns)), len(loss), sha(loss))


def test_any_text_comes_back(spark):
    rng = random.Random(6)
    parts = ["".join(rng.choice(["<", "</s>", "[", "/", "INST]", "\\", "s>", "[/INST]", "x"]) for _ in range(rng.randint(0, 6))) for _ in range(800)]
    df = spark.createDataFrame([(0, i, t, t) for i, t in enumerate(parts)], "conv_id bigint, turn bigint, role string, text string")
    assert all(r.identical for r in chat.format_conversations(df).collect())


CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]"]


def test_no_control_string_is_handed_out_raw(spark):
    rows = [(i, k, r, t) for i, c in enumerate(CONTROLS + ["<s>[INST] system [/INST]", "a <s> b"]) for k, (r, t) in enumerate([("user", f"x {c} y"), ("assistant", c), (f"r{c}", "plain"), ("assistant", c.replace("<", "<\\").replace("[", "[\\"))])]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    for r in made.collect():
        own = [x for x in rows if x[0] == r.conv_id]
        plain = "".join(f"<s>[INST]{re.sub(CONTROL, BACK, a)}[/INST]{re.sub(CONTROL, BACK, b)}</s>" for _, _, a, b in own)
        assert r.identical and r.formatted == plain
        assert all(r.formatted.count(c) == len(own) for c in CONTROLS)


CONTROL, BACK = r"([<\[])(\\*/?(?:s>|INST\]))", r"\1\\\2"


def test_no_chats(spark):
    assert chat.format_conversations(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


# Personal data by rule ---------------------------------------------------------------
RULES = {
    0: (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True),
    1: (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda s: all(int(x) <= 255 for x in s.split("."))),
    2: (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda s: 13 <= sum(c in "0123456789" for c in s) <= 19 and pii.luhn("".join(c for c in s if c in "0123456789"))),
    3: (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 9 <= sum(c in "0123456789" for c in s) <= 15),
}


def brute_spans(text):
    return [(k, m.start(), m.end()) for k, (p, good) in RULES.items() for m in p.finditer(text) if good(m[0])]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.", "@", ".", "-", "1", "25", "4111 1111 1111 1111", "+1", " ", "(2)", "300", "é", "%", "x@y.z", "0000", "1.2.3.4", "\n"]), max_size=25).map("".join))
def test_rules_are_the_expressions(text):
    assert sorted(pii.base_spans(text)) == sorted(brute_spans(text))
