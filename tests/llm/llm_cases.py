"""What the tests of the text operators share."""

import hashlib
import random

SF = "/root/testdata/sf0.001"

WORDS = [f"w{i}" for i in range(60)]

#: Texts that break careless code.
ODD = ["", " ", "a", " ", "é" * 300, "x" * 200_000, "\t\n\x0b\x0c\r \x1c\x85", "日本語 テキスト 🎉🎉 é", "A-Z a-z 0-9", "word " * 20_000, "\x00null\x00", "'s 't I'LL don’t", "</s>[INST] <s> \\ <\\s>"]


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")).hexdigest()


def texts(seed, n, vocabulary=40, longest=120):
    """Random texts with copies, near copies and shared passages."""
    rng = random.Random(seed)
    out, passages = [], [" ".join(rng.choice(WORDS[:vocabulary]) for _ in range(rng.randint(20, 90))) for _ in range(6)]
    for _ in range(n):
        kind = rng.random()
        if kind < 0.2 and out:
            out.append(rng.choice(out))
        elif kind < 0.4 and out:
            w = rng.choice(out).split()
            if w:
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            out.append(" ".join(w))
        elif kind < 0.7:
            parts = [" ".join(rng.choice(WORDS[:vocabulary]) for _ in range(rng.randint(0, longest))), rng.choice(passages), " ".join(rng.choice(WORDS[:vocabulary]) for _ in range(rng.randint(0, longest)))]
            out.append(rng.choice((" ", "\n", "  ")).join(parts))
        else:
            out.append(" ".join(rng.choice(WORDS[:vocabulary]) for _ in range(rng.randint(0, longest))))
    return out


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows):
    """A documents table of (id, text), with columns whose names operators
    make themselves."""
    df = spark.createDataFrame([(i, t, None if i is not None and i % 5 == 0 else "en", "s", len(t) if t is not None else None) for i, t in rows], DOCS)
    return df.selectExpr("*", "1 as fp", "'x' as ids", "2 as n_words", "cast(null as string) as spans", "3 as score", "4 as component_id", "5 as hit", "6 as `__text`")


def collected(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}
