import functools
import itertools
import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from paperledger.llm import near
from paperledger.llm.components import components
from paperledger.llm.simhash import near_links, print_of
from tests.llm.conftest import clashing


@functools.cache
def cut(text, n=5):
    words = (text or "").encode().lower().split()
    width = min(n, len(words))
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if words else {()}


def brute_likeness(a, b):
    both = len(cut(a) & cut(b))
    return both / (len(cut(a)) + len(cut(b)) - both)


def brute_kept(rows, least=0.8):
    """The ids that no near link, over any number of steps, joins to a smaller one."""
    root = {d: d for d, _ in rows}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for (a, x), (b, y) in itertools.combinations(rows, 2):
        if brute_likeness(x, y) >= least:
            low, high = sorted((top(a), top(b)))
            root[high] = low
    return sorted(d for d in root if root[d] == d)


@pytest.fixture(scope="module")
def edited():
    """Families of a text with one to seven of its words replaced: likenesses around and above 0.8."""
    rng, rows = random.Random(8), []
    for family in range(70):
        words = [f"w{family}x{k}" for k in range(rng.randint(60, 200))]
        for _ in range(4):
            copy = list(words)
            for at in rng.sample(range(len(copy)), rng.randint(1, 7)):
                copy[at] = f"e{rng.random()}"
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    return rows


def test_stage_drops_all_near_copies(spark, edited, sf_dir):
    pairs = [j for (_, x), (_, y) in itertools.combinations(edited, 2) if (j := brute_likeness(x, y)) > 0.6]
    assert sum(0.8 <= j < 0.9 for j in pairs) > 20 and sum(j < 0.8 for j in pairs) > 20
    docs = spark.createDataFrame(edited, "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, sf_dir).collect()) == brute_kept(edited)


def test_a_pair_met_only_beside_its_bucket_s_first_is_linked(spark):
    words = [f"w{k}" for k in range(100)]
    put = lambda *places: " ".join(f"e{places}" if k in places else word for k, word in enumerate(words))
    rows = [(0, put(10, 60, 90)), (1, put(20)), (2, put(20, 50)), (3, put(20, 50, 80)), (4, put(20, 30, 50, 80, 95))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near.near_dedup(docs).collect()) == brute_kept(rows)


def test_near_copies_of_odd_rows(odd, plain, plain_rows, nothing):
    assert sorted(r["doc_id"] for r in near.near_dedup(plain).collect()) == brute_kept([r[:2] for r in plain_rows])
    kept = near.near_dedup(clashing(odd))
    assert "clash" in {r["tag"] for r in kept.collect()} and kept.where("doc_id IS NULL").count() == 2
    assert near.near_dedup(nothing).collect() == []


def test_a_family_below_the_threshold_isn_t_paired(spark):
    """A template whose copies have words of their own: alike, in one bucket, and not near, but for some planted pairs."""
    rng, rows = random.Random(3), []
    words = [f"w{k}" for k in range(120)]
    for k in range(150):
        copy = list(words)
        for at in rng.sample(range(len(copy)), 7):
            copy[at] = f"e{rng.random()}"
        rows.append((k, " ".join(copy)))
    for k in range(6):
        rows.append((200 + k, rows[k * 20 + 1][1] + " and some more"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.col("text").cast("binary").alias("text"))
    sets = docs.select(F.col("doc_id").alias("node"), near._shingle_column("text").alias("set"))
    pairs = {tuple(r) for r in near._by_rarest(sets, docs.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("root")), 0.8).collect()}
    close = {(b, a) for (a, x), (b, y) in itertools.combinations(rows, 2) if brute_likeness(x, y) >= 0.8}
    assert len(close) >= 6 and close <= pairs and len(pairs) < 1000
    assert sorted(r["doc_id"] for r in near.near_dedup(docs).collect()) == brute_kept(rows)


def test_exact_thresholds_meet(spark):
    """Sets of every small size with a partner of exactly the least likeness, or just below."""
    rows = []
    for n in range(5, 60):
        words = [f"n{n}w{k}" for k in range(n)]
        rows.append((2 * n, " ".join(words)))
        width = n - 4
        rows.append((2 * n + 1, " ".join(words + [f"x{n}y{k}" for k in range(width // 4)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.col("text").cast("binary").alias("text"))
    sets = docs.select(F.col("doc_id").alias("node"), near._shingle_column("text").alias("set"))
    found = {tuple(r) for r in near._by_rarest(sets, docs.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("root")), 0.8).collect()}
    close = {(b, a) for (a, x), (b, y) in itertools.combinations(rows, 2) if brute_likeness(x, y) >= 0.8}
    assert len(close) > 40 and close <= found


def test_small_tables_of_the_steps_are_read_by_few_tasks(spark):
    """A round over few links must not cost as many files as there are shuffle partitions."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        roots = components(spark.createDataFrame([(k + 1, k) for k in range(40)], "u long, v long"))
        assert sorted(map(tuple, roots.collect())) == [(k, 0) for k in range(1, 41)]
        assert roots.rdd.getNumPartitions() <= 40
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def joined(links, nodes):
    """The smallest node that each node reaches."""
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for u, v in links:
        low, high = sorted((top(u), top(v)))
        root[high] = low
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("node_rows", [8, 1 << 15])
def test_tries_of_blocks_join_all_prints_within_a_wide_budget(spark, node_rows):
    rng, prints = random.Random(5), []
    for _ in range(60):
        prints.append(rng.getrandbits(64))
        for bits in (3, 8, 11, 12, 14):
            prints.append(prints[-1] ^ sum(1 << b for b in rng.sample(range(64), bits)))
    rows = [(p - (1 << 64) if p >> 63 else p, k) for k, p in enumerate(prints)]
    found = [tuple(r) for r in near_links(spark.createDataFrame(rows, "fingerprint long, rep long"), 11, node_rows, 4).collect()]
    near_pairs = [(a, b) for a, b in itertools.combinations(range(len(prints)), 2) if (prints[a] ^ prints[b]).bit_count() <= 11]
    assert all((prints[u] ^ prints[v]).bit_count() <= 11 for u, v in found)
    assert joined(found, range(len(prints))) == joined(near_pairs, range(len(prints)))


def test_near_copies_meet_in_the_tries(spark, edited):
    """The stage's candidates are those of the tries of operator 6: near texts whose prints differ in 3 to 11 bits too."""
    prints = {d: print_of(near.shingles(near.words_of(x.encode()))) for d, x in edited}
    texts = dict(edited)
    rows = [(d, int(np.uint64(p).astype(np.int64))) for d, p in prints.items()]
    tried = [tuple(r) for r in near.by_tries(spark.createDataFrame(rows, "rep long, print long"), node_rows=64).collect()]
    root = joined(tried, prints)
    pairs = [(a, b, (prints[a] ^ prints[b]).bit_count()) for a, b in itertools.combinations(sorted(texts), 2) if brute_likeness(texts[a], texts[b]) >= 0.8]
    within = [(a, b) for a, b, bits in pairs if bits <= 11]
    assert all(root[a] == root[b] for a, b in within) and len(within) > 0.7 * len(pairs)
    assert sum(2 < bits <= 11 for _, _, bits in pairs) > 20
