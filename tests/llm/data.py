"""Small documents with copies, near copies, shared passages, nulls and odd texts."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, h1 string, __x int"


def words(r, n, vocabulary=400):
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def rows(seed=1, n=60):
    r = random.Random(seed)
    base, passage = words(r, 90), words(r, 55)
    out = []
    for i in range(n):
        k = i % 10
        if k == 0:
            w = list(base)
        elif k in (1, 2, 3):
            w = list(base)
            for _ in range(r.randrange(1, 4)):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        elif k == 4:
            w = words(r, 20) + passage + words(r, 20)
        elif k == 5:
            w = words(r, r.randrange(0, 8))
        else:
            w = words(r, r.randrange(60, 160))
        text = "".join(x + ("\n" if r.random() < 0.12 else " ") for x in w)
        if k in (6, 7):
            text = "  The very same line HERE \n" + text + "\nthe very same line here"
        out.append([i * 3, text, "en", f"src{r.choice([0, 0, 0, 1, 2])}", len(text)])
    out += [[1000, None, None, None, None], [1001, "", "en", "src0", 0], [1002, " \n\t ", "en", None, 3], [1003, "ÀÉ Straße 𝒳   x", "de", "src1", 9]]
    out += [[1004, "lone " * 3000, "en", "src2", 15000], [1005, " ".join(words(r, 20000, 5000)), "en", "src1", 0]]
    return [(*x, 7, "clash", 1) for x in out]


def frame(spark, seed=1, n=60, more=()):
    return spark.createDataFrame([*rows(seed, n), *more], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
