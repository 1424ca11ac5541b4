import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from paperledger.llm.components import components
from paperledger.llm.exact import exact_dedup
from paperledger.llm.lines import LineRuns, judged_lines, line_dedup
from paperledger.llm.simhash import near_components, near_dedup, simhash, trie_join
from paperledger.llm.substrings import substring_dedup, subtree
from tests.llm.conftest import clashing

WHITE = "[\x20\x09-\x0d]+"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_id(df):
    return {row["doc_id"]: row.asDict() for row in df.collect()}


def brute_exact(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[re.sub(WHITE, " ", text or "")].append(doc_id)
    return {d: (min(ids), len(ids), d == min(ids), sha(text)) for text, ids in groups.items() for d in ids}


@pytest.mark.parametrize("prefix,bits", [(128, 1 << 12), (1, 64)])
def test_exact_equals_brute_force(plain, plain_rows, prefix, bits):
    found = by_id(exact_dedup(plain, prefix=prefix, map_bits=bits, digests=True))
    assert {d: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for d, r in found.items()} == brute_exact(plain_rows)


def test_exact_on_odd_rows(odd, odd_rows, nothing):
    rows = exact_dedup(clashing(odd)).collect()
    assert len(rows) == len(odd_rows)
    empty = [r for r in rows if r["keep_id"] == 25]
    assert {r["doc_id"] for r in empty} == {25, 26, 45, None} and {r["group_size"] for r in empty} == {4}
    first = [r for r in rows if r["doc_id"] == 0]
    assert len(first) == 2 and all(r["kept"] and r["group_size"] == 4 for r in first)
    assert exact_dedup(nothing).collect() == []


def test_exact_hashes_only_survivors(plain):
    rows = exact_dedup(plain).collect()
    assert any(r["text_sha256"] is None for r in rows) and all(r["text_sha256"] for r in rows if r["group_size"] > 1)


def brute_lines(rows):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(fold)
    owner = {}
    for doc_id, text, *_ in sorted(rows, key=lambda r: r[0]):
        for line in (text or "").split("\n"):
            owner.setdefault(key(line), doc_id)
    out = {}
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or owner[key(x)] == doc_id]
        out[doc_id] = "\n".join(kept), len(lines), len(lines) - len(kept)
    return out


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2), (4, 3)])
def test_lines_equal_brute_force(plain, plain_rows, batches, fanout):
    found = by_id(line_dedup(plain, batches=batches, fanout=fanout, buckets=2))
    assert {d: (r["text"], r["n_lines"], r["n_dropped"]) for d, r in found.items()} == brute_lines(plain_rows)


def test_lines_on_odd_rows(odd, odd_rows, nothing):
    rows = line_dedup(clashing(odd), carry=["lang", "tag"], batches=2).collect()
    assert len(rows) == len(odd_rows) and {r["rest"]["tag"] for r in rows} == {"clash"}
    assert len([r for r in rows if r["doc_id"] is None]) == 2
    assert line_dedup(nothing).collect() == []


def test_runs_are_compacted_and_hold_each_line_once(spark, plain):
    store = LineRuns(spark, fanout=2, buckets=2)
    rows = plain.selectExpr("doc_id", "coalesce(text, '') AS text")
    for k in range(4):
        store.add(judged_lines(rows.where(f"doc_id % 4 = {k}")))
        store.compact()
    assert [len(level) for level in store.levels] == [0, 0, 1]
    held = store.runs()[0]
    assert held.count() == held.distinct().count() == judged_lines(rows).select("h1", "h2").distinct().count()


def test_simhash_of_words():
    text = "One two  THREE\nfour"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(2)]
    assert simhash(text.encode()) == sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 2)
    assert simhash(b"Ab cD") == xxhash.xxh64_intdigest(b"ab cd", 42)
    assert simhash(None) == simhash(b" \n") == 0


@pytest.mark.parametrize("top", [0, 3])
def test_trie_join_finds_all_near_pairs(top):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300, np.uint64)
    near = base[:150] ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))
    prints = np.unique(np.concatenate((base, near)))
    side = prints >> np.uint64(64 - top) if top else np.zeros(len(prints), np.uint64)
    found = set()
    for a in range(1 << top):
        for b in range(a, 1 << top):
            left, right = np.flatnonzero(side == a), np.flatnonzero(side == b)
            for i, j in trie_join(prints[left], prints[right], top, 2, a == b):
                found |= set(zip(left[i].tolist(), right[j].tolist()))
    d = np.bitwise_count(prints[:, None] ^ prints[None, :])
    assert found == {(i, j) for i, j in zip(*np.nonzero(d <= 2)) if i < j}


def brute_components(ids, prints):
    label = dict(zip(ids, ids))
    near = [(a, b) for a, x in zip(ids, prints) for b, y in zip(ids, prints) if a < b and (x ^ y).bit_count() <= 2]
    changed = True
    while changed:
        changed = False
        for a, b in near:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


@pytest.mark.parametrize("node_rows", [4096, 4])
def test_near_components_equal_brute_force(plain, plain_rows, node_rows):
    found = by_id(near_components(plain, node_rows=node_rows))
    prints = [simhash((text or "").encode()) for _, text, *_ in plain_rows]
    ids = [r[0] for r in plain_rows]
    assert {d: r["component_id"] for d, r in found.items()} == brute_components(ids, prints)
    assert {d: r["fingerprint"] % 2**64 for d, r in found.items()} == dict(zip(ids, prints))


def test_near_on_odd_rows(odd, odd_rows, nothing):
    rows = near_components(clashing(odd)).collect()
    assert len(rows) == len(odd_rows)
    assert {r["component_id"] for r in rows if r["doc_id"] is None} == {None}
    kept = near_dedup(clashing(odd))
    assert "clash" in {r["tag"] for r in kept.collect()} and kept.where("doc_id IS NULL").count() == 2
    assert near_components(nothing).collect() == [] and near_dedup(nothing).collect() == []


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100)], "u long, v long")
    assert {r["node"]: r["root"] for r in components(links).collect()} == {**{k: 0 for k in range(1, 41)}, 101: 100}


def brute_substrings(rows, n):
    words = {doc_id: [w for w in re.split(WHITE, text or "") if w] for doc_id, text, *_ in rows}
    least = {}
    for doc_id in sorted(words):
        for k in range(len(words[doc_id]) - n + 1):
            least.setdefault(tuple(words[doc_id][k : k + n]), doc_id)
    out = {}
    for doc_id, own in words.items():
        gone = set()
        for k in range(len(own) - n + 1):
            if least[tuple(own[k : k + n])] < doc_id:
                gone |= set(range(k, k + n))
        out[doc_id] = " ".join(w for k, w in enumerate(own) if k not in gone), len(own), len(gone)
    return out


@pytest.mark.parametrize("tree_words", [1 << 20, 60])
def test_substrings_equal_brute_force(plain, plain_rows, tree_words):
    found = by_id(substring_dedup(plain, map_bits=1 << 12, tree_words=tree_words))
    expected = brute_substrings(plain_rows, 50)
    assert {d: (r["text"], r["n_words"], r["n_removed"]) for d, r in found.items()} == expected
    assert sum(n > 0 for _, _, n in expected.values()) >= 4


def test_substrings_with_short_windows(sample):
    rows = [(r["doc_id"], r["text"]) for r in sample.limit(60).collect()]
    small = sample.where(sample["doc_id"].isin([d for d, _ in rows]))
    found = by_id(substring_dedup(small, window=6, prefix=3, map_bits=1 << 16))
    assert {d: (r["text"], r["n_words"], r["n_removed"]) for d, r in found.items()} == brute_substrings(rows, 6)


def test_substrings_on_odd_rows(odd, odd_rows, nothing):
    rows = substring_dedup(clashing(odd), map_bits=1 << 12).collect()
    assert len(rows) == len(odd_rows)
    assert [r["n_words"] for r in rows if r["doc_id"] == 25] == [0]
    assert substring_dedup(nothing, map_bits=1 << 12).collect() == []


def test_subtree_names_equal_runs():
    words = np.array([1, 2, 3, 1, 2, 3, 1, 2, 4], np.uint64)
    assert subtree(words, np.arange(7), 3).tolist() == [0, 2, 3, 0, 2, 3, 1]
