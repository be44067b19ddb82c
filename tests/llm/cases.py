"""Small documents with the cases that every operator has to take, and plain models to hold results against."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def vocabulary(r, n=300):
    return ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 7))) for _ in range(n)]


def corpus(seed=5):
    """(doc_id, text): prose, exact and near copies, shared passages, short, empty, null and very long texts, a null and a repeated id."""
    r = random.Random(seed)
    v = vocabulary(r)
    line = lambda lo=4, hi=14: " ".join(r.choices(v, k=r.randint(lo, hi)))
    passage = " ".join(r.choices(v, k=60))
    texts = ["\n".join(line() for _ in range(r.randint(3, 12))) for _ in range(30)]
    texts += [texts[0], texts[0], texts[3], texts[3].upper()]
    for i in range(8):
        w = texts[5].split(" ")
        w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [f"{line()}\n{passage}\n{line()}" for _ in range(5)]
    texts += [None, "", "   \n\t ", "one", "one", "two words", "Three little words", "a\x1cb c d e", "été ÉTÉ   x"]
    texts += ["\n".join(line(20, 40) for _ in range(400))]
    rows = list(enumerate(texts))
    return [*rows, (None, texts[7]), (2, texts[2]), (2, line())]


def frame(spark, rows):
    """Documents with extra columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    full = [(i, t, "en", "src", len(t) if t is not None else None) for i, t in rows]
    df = spark.createDataFrame(full, SCHEMA)
    return df.withColumns({"h": F.lit(1), "n": F.lit("x"), "sid": F.lit(2), "key": F.lit(None).cast("string"), "_block": F.lit("z"), "_bucket": F.lit(0)})
