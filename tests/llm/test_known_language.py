import corpus_pipeline

from paperledger.llm import langid

SCHEMA = "doc_id long, text string, lang string"


def kept(spark, rows):
    return sorted(r["doc_id"] for r in corpus_pipeline.language(spark, spark.createDataFrame(rows, SCHEMA), "").collect())


def test_without_a_label_only_letterless_texts_go(spark):
    rows = [(k, f"some clean text number {k}", None) for k in range(12)]
    assert kept(spark, [*rows, (20, None, None), (21, "12 !", None)]) == list(range(12))


def test_labels_in_the_held_out_quarter_only(spark):
    ids = spark.range(40).withColumnRenamed("id", "doc_id").where(langid.held_out()).collect()
    held = {r["doc_id"] for r in ids}
    assert held and kept(spark, [(k, f"some clean text number {k}", "en" if k in held else None) for k in range(40)]) == list(range(40))


def test_texts_without_any_evidence_go(spark):
    rows = [(k, f"some clean text number {k}", "en") for k in range(12)] + [(100 + k, f"ein sauberer Text Nummer {k}", "de") for k in range(12)]
    odd = [(200, "漢字 かな", None), (201, "漢字 text", None), (202, "zzz", None)]
    assert kept(spark, rows + odd) == [*range(12), *range(100, 112), 201]


def found(spark, rows):
    return {r["doc_id"]: r["lang"] for r in corpus_pipeline.language(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}


def test_every_text_gets_the_language_of_its_whole_text(spark):
    rows = [(k, f"some clean text number {k}", "en") for k in range(12)] + [(100 + k, f"ein sauberer Absatz mit der Nummer {k}", "de") for k in range(12)]
    odd = [(200, "some clean text", None), (201, "text: ein sauberer Absatz mit der Nummer", None), (202, "ein sauberer Absatz", "en"), (203, "clean number, ein text", "de")]
    assert found(spark, rows + odd) == {d: lang for d, _, lang in rows} | {200: "en", 201: "de", 202: "de", 203: "en"}
    assert found(spark, [(1, "some text", None), (2, "ein Absatz", None)]) == {1: None, 2: None}


def test_labels_of_the_held_out_quarter_are_learned(spark):
    held = [r["id"] for r in spark.range(1000, 1040).where(langid.held_out("id")).collect()]
    rows = [(k, f"some clean text number {k}", "en") for k in range(12)] + [(k, "漢字 かな 漢字", "ja") for k in held]
    assert len(held) > 2 and found(spark, [*rows, (2000, "漢字", None)]) == {d: lang for d, _, lang in rows} | {2000: "ja"}


def test_a_rare_language_is_learned_whole(spark):
    rows = [(k, f"some clean text number {k}", "en") for k in range(400)] + [(1000 + k, f"漢字 かな {k}", "ja") for k in range(3)]
    table = spark.createDataFrame(rows, SCHEMA)
    model = langid.fit(table, train_docs=8, least_docs=4)
    assert model.langs == ["en", "ja"] and "漢字" in model.tables[0]
    kept = langid.known_language(table, model).collect()
    assert {r["doc_id"]: r["lang"] for r in kept} == {d: lang for d, _, lang in rows}
