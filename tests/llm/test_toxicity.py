import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paperledger.llm import toxicity as t

SYLLABLES = ["ka", "ro", "mi", "tel", "sun", "der", "pla", "ne", "go", "vis"]


def prose(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(6), []
    for k in range(900):
        words = prose(rng, rng.randint(15, 200)).split()
        bad = k % 6 == 0
        for _ in range(max(2, len(words) // 30) if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(["blockhead", "Fiend!", "wretched", "numskull"])
        out.append((k, " ".join(words), int(bad)))
    return out


def tables(spark, rows):
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")


def reference(rows, order):
    """Kneser and Ney by dictionaries: a function from a window to its log-ratio."""
    seen = [[Counter() for _ in range(order + 1)] for _ in range(2)]
    for _, text, toxic in rows:
        for word in t.words_of(text):
            marked = f"<{word}>"
            for i in range(1, len(marked)):
                for n in range(1, min(order, i + 1) + 1):
                    seen[toxic][n][marked[i - n + 1 : i + 1]] += 1
    before = Counter(gram[1] for gram in set(seen[0][2]) | set(seen[1][2]))

    def probability(toxic, window, n):
        if n == 0:
            return (before[window[-1]] + 1) / (sum(before.values()) + len(before) + 1)
        below = probability(toxic, window, n - 1)
        follow = {g: k for g, k in seen[toxic][n].items() if g[:-1] == window[-n:-1]} if n <= len(window) else {}
        if not follow:
            return below
        ones, twos = (sum(k == x for k in seen[toxic][n].values()) for x in (1, 2))
        off = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
        return (max(follow.get(window[-n:], 0) - off, 0) + off * len(follow) * below) / sum(follow.values())

    return lambda window: math.log(probability(1, window, order) / probability(0, window, order))


def test_log_ratios_equal_the_formula(spark, rows):
    few = rows[:40]
    docs, labels = tables(spark, few)
    model, exact = t.fit(docs, labels, order=3), reference(few, 3)
    asked = ["<", "<k", "<ka", "oro", "zzz", "k", "xk", "hea", "lo>", "é", "<z", "ne>"]
    found = {r["window"]: r["ratio"] for r in t.log_ratios(spark.createDataFrame([(w,) for w in asked], "window string"), model).collect()}
    assert found == {w: pytest.approx(exact(w), abs=1e-9) for w in asked}


@pytest.mark.parametrize("common", [1, 50, 400_000])
def test_what_is_joined_and_what_every_task_has_add_up(spark, rows, common):
    few = rows[:60]
    docs, labels = tables(spark, few)
    model, exact = t.fit(docs, labels, order=3, common=common), reference(few, 3)
    assert len(model.common) <= common
    found = {r["doc_id"]: (r["n"], r["ratio"]) for r in t.likelihoods(docs, model).collect()}
    memo = {}
    for doc_id, text, _ in few:
        words = t.words_of(text)
        windows = [w for word in words for w in t.windows_of(word, 3)]
        assert found[doc_id] == (len(words), pytest.approx(sum(memo.setdefault(w, exact(w)) for w in windows), abs=1e-6))


def test_held_out_texts_are_told_apart(spark, rows):
    docs, labels = tables(spark, rows)
    found = t.toxicity(docs, labels.where(~t.held_out()), calibration=10_000).join(labels, "doc_id").where(t.held_out()).collect()
    bad, clean = [r for r in found if r["toxic"]], [r for r in found if not r["toxic"]]
    assert len(bad) > 15 and sum(r["predicted"] for r in bad) >= 0.9 * len(bad)
    assert sum(r["predicted"] for r in clean) <= 0.02 * len(clean)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)


def test_odd_rows(spark, rows, odd, nothing):
    labels = odd.select("doc_id").withColumn("toxic", F.when(F.col("doc_id") % 3 == 0, 1).when(F.col("doc_id") % 3 == 1, 0)).unionByName(odd.select("doc_id", F.lit(7).alias("toxic")))
    clash = odd.withColumns({name: F.lit("clash") for name in ["n", "ratio", "rare", "times", "row", "window", "toxic", "score"]})
    found = t.toxicity(clash, labels)
    assert found.columns == ["doc_id", "score", "predicted"]
    got = found.collect()
    assert len(got) == odd.count() and all(r["score"] is not None and 0 <= r["score"] <= 1 for r in got)
    assert t.toxicity(nothing, labels).collect() == []
    for toxic, score in ((0, 0.0), (1, 1.0)):
        one = t.toxicity(odd, odd.select("doc_id", F.lit(toxic).alias("toxic"))).collect()
        assert {(r["score"], r["predicted"]) for r in one} == {(score, toxic)}
    assert {r["score"] for r in t.toxicity(odd, labels.limit(0)).collect()} == {0.0}


def test_equal_texts_score_alike(spark, rows):
    docs, labels = tables(spark, rows[:200])
    twins = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000)).repartition(7)
    found = {r["doc_id"]: r["score"] for r in t.toxicity(twins, labels).collect()}
    assert all(found[k] == pytest.approx(found[k + 1000], abs=1e-12) for k in range(200))
