import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratingkit.llm import toxicity

from .helpers import SF, awkward_rows, frame

BAD = ("vileword", "nastyish")


def labelled(n=500, seed=2):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeilmnorstuvw") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for d in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(10, 80))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(rng.randint(1, 3)):
                w.insert(rng.randint(0, len(w)), rng.choice(BAD))
        rows.append((d, " ".join(w), "s"))
        labels.append((d, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def trained(spark):
    rows, labels = labelled()
    lab = spark.createDataFrame([*labels, (900, None), (901, 1), (3, labels[3][1])], "doc_id long, toxic int")
    docs = frame(spark, rows)
    return rows, dict(labels), docs, toxicity.fit(docs, lab.where(~toxicity.held_out(F.col("doc_id"))))


def test_held_out_accuracy(spark, trained):
    rows, labels, docs, model = trained
    got = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).join(
        model.score(docs), "doc_id").where("h").collect()
    right = sum((r["score"] >= toxicity.THRESHOLD) == bool(labels[r["doc_id"]]) for r in got)
    assert len(got) > 100 and right >= 0.95 * len(got)


def test_scores_depend_on_text_alone(spark, trained):
    *_, model = trained
    rows = [(d, t, s) for d, t, s in awkward_rows()] + [(None, "vileword here", "s"), (7, "", "s"), (8, None, "s")]
    got = model.score(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    texts = [t or "" for _, t, _ in rows]
    margin = model.margins(texts, model.weights != 0)
    assert np.allclose(sorted(r["score"] for r in got), sorted(1 / (1 + np.exp(-margin))))


def test_removal_keeps_columns(spark, trained):
    rows, labels, docs, model = trained
    kept = toxicity.remove_toxic(docs, model)
    assert kept.columns == docs.columns
    bad = {r["doc_id"] for r in model.score(docs).where("score >= 0.7").collect()}
    assert {r["doc_id"] for r in kept.collect()} == {d for d, *_ in rows} - bad


def test_removal_is_by_row(spark, trained):
    *_, model = trained
    bad = "vileword nastyish vileword nastyish"
    assert model.margins([bad, "lemon tree"], model.weights != 0).tolist()[0] > 1
    rows = [(None, bad, "s"), (None, "lemon tree", "s"), (4, bad, "s"), (4, "lemon tree", "s"), (None, None, "s")]
    kept = toxicity.remove_toxic(frame(spark, rows), model).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept) == [
        ("4", "lemon tree"), ("None", "None"), ("None", "lemon tree")]


def test_counts_against_brute_force(spark):
    rows, labels = labelled(40)
    table = dict(labels)
    df = spark.createDataFrame([(t, table[d]) for d, t, _ in rows], "text string, toxic int").repartition(5)
    toxicity.prepare(spark)
    counts = toxicity.bucket_counts(df)
    want = np.zeros((2, 1 << toxicity.BITS), np.int64)
    for d, t, _ in rows:
        _, bucket = toxicity.present([t])
        want[1 - table[d], bucket] += 1
    assert (counts == want).all()


def test_ngrams_do_not_cross_texts():
    doc, bucket = toxicity.present(["ab, Cd", "", "x"])
    alone = [set(toxicity.present([t])[1].tolist()) for t in ("ab, Cd", "", "x")]
    assert [set(bucket[doc == k].tolist()) for k in range(3)] == alone
    assert set(toxicity.present(["AB  cd!"])[1].tolist()) == set(toxicity.present(["ab cd "])[1].tolist())


def test_training_without_both_labels(spark):
    rows, _ = labelled(20)
    docs = frame(spark, rows)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    scores = {r["score"] for r in toxicity.fit(docs, none).score(docs).collect()}
    assert scores == {0.5}
    one = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert toxicity.fit(docs, one).score(docs).first()["score"] == pytest.approx(0.25)
    assert toxicity.fit(frame(spark, []), one).score(frame(spark, [])).collect() == []


def test_pipeline_stages(spark):
    """Every stage against its brute-force version, each on what the one before kept."""
    import corpus_pipeline as P

    from .test_decontaminate import brute
    from .test_duplicates import brute_components, brute_lines
    from .test_tokens import check_pack
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = lambda df: [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
    stages = dict(P.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "packing"]
    clean = P.staged(stages["toxicity"](spark, docs, SF), "t")
    assert clean.columns == columns and 0 < clean.count() <= docs.count()
    lines = P.staged(stages["line_dedup"](spark, clean, SF), "t")
    assert sorted(((str(d), t) for d, t, _ in rows(lines)), key=str) == brute_lines(rows(clean), 8, 10)
    single = P.staged(stages["near_duplicates"](spark, lines, SF), "t")
    found = brute_components(rows(lines), 5, 80, 100)
    assert {d for d, *_ in rows(single)} == {d for d, (_, root) in found.items() if d == root}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = P.staged(stages["decontamination"](spark, single, SF), "t")
    bad = {d for d, n, h, _ in brute(rows(single), items, 13) if h and 20 * h >= n}
    assert {str(d) for d, *_ in rows(kept)} == {str(d) for d, *_ in rows(single)} - bad
    assert all(x.columns == columns for x in (lines, single, kept))
    check_pack(stages["packing"](spark, kept, SF).collect(), rows(kept), 1024)


def test_queries_are_registered():
    import __spark_entry__ as entry
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
