import hashlib

import corpus_pipeline
import pytest

from paperledger.llm import langid, pii
from paperledger.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import clashing
from tests.llm.test_dedup import brute_lines
from tests.llm.test_models import check_pieces
from tests.llm.test_near import brute_kept


@pytest.fixture(scope="module")
def stages(spark, sample, sf_dir, tmp_path_factory):
    """What each stage returned, as rows."""
    out, docs = [sorted(sample.collect())], sample
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "packed":
            assert docs.columns == sample.columns
        out.append(sorted(docs.collect()))
    return out


def test_each_stage_against_brute_force(stages, sample):
    given, spoken, lines, near, masked, packed = stages
    assert [r["doc_id"] for r in spoken] == [r["doc_id"] for r in given if langid.has_letter(r["text"])]
    texts = brute_lines([(r["doc_id"], r["text"]) for r in spoken])
    assert {r["doc_id"]: r["text"] for r in lines} == {d: text for d, (text, _, _) in texts.items()}
    assert all(r["n_chars"] == len(r["text"]) and (r["lang"], r["source"]) == (s["lang"], s["source"]) for r, s in zip(lines, spoken))
    kept = brute_kept([(r["doc_id"], r["text"]) for r in lines])
    assert near == [r for r in lines if r["doc_id"] in kept] and len(near) < len(lines)
    for before, after in zip(near, masked, strict=True):
        base = pii.base_spans(before["text"])
        assert not pii.base_spans(after["text"]) and (base or before == after)
    padding, sequences = check_pieces(packed, {r["doc_id"]: r["text"] for r in masked})
    assert padding <= 1024 * 8


def test_run_is_the_stages_in_a_row(spark, sf_dir, stages):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    digest = lambda found: hashlib.sha256(repr(sorted((r["doc_id"], r["start"], bytes(r["ids"])) for r in found if r["start"] == 0 and r["length"] == r["doc_tokens"])).encode()).hexdigest()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in stages[-1]} and digest(rows)


def test_stages_on_odd_rows(spark, odd, nothing, sf_dir, tmp_path):
    for name, table in (("odd", clashing(odd)), ("nothing", nothing)):
        docs = table
        for step, stage in corpus_pipeline.STAGES:
            stage(spark, docs, sf_dir).write.parquet(path := str(tmp_path / name / step))
            docs = spark.read.parquet(path)
        assert (docs.count() > 0) == (name == "odd")


def test_registered_queries():
    assert {q.split("_")[0] for q in QUERIES} == {*(f"op{n}" for n in range(1, 14)), "pipeline"}
    assert set(ORACLES) <= set(QUERIES)
