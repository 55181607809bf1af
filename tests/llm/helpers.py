"""Small tables with every awkward case, and brute-force versions of the operators."""

import random
import re

SF = "/root/testdata/sf0.001"
CLASH = ("n_words", "score", "start", "kept", "hash", "sid", "digest", "slot", "spans", "token", "part")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words_of(text, pattern):
    return re.findall(pattern, (text or "").translate(LOWER))


def awkward_rows(seed=3):
    """``(doc_id, text, source)``: nulls, empty and white texts, copies, near copies, ties, a long text."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, passage = say(150), say(40)
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "ONE"), (5, "two words"), (6, base), (7, base),
            (8, base.upper()), (9, base.replace(" ", "  ")), (10, base + " tail end"), (11, "x " + base),
            (12, say(60) + "\n" + passage + "\n" + say(50)), (13, passage), (14, say(30) + " " + passage),
            (15, "a" * 300), (16, "b" + "a" * 200), (17, say(9000)), (18, "😀 ünï — 中文 " + say(20)),
            (19, "'s it's don't 'll!!  12 3\r\n\r\n x")]
    for k in range(20, 60):
        words = base.split()
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((k, " ".join(words)))
    rows += [(k, say(rng.randint(1, 80))) for k in range(60, 90)]
    return [(d, t, f"src{d % 5}" if d % 7 else None) for d, t in rows]


def frame(spark, rows, extra=True):
    """Rows as documents, with columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASH}) if extra else df


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}
