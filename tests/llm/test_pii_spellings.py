import numpy as np

from paperledger.llm import pii

FRAMES = ("please use {} soon", "see {}, thanks", "so {} it is", "({})", "{}")
#: Found of held-out spellings by kind at least; of what is added to clean text, at most this many in a thousand texts.
RECALL, FALSE = 0.9, 10


def _trained(spark):
    docs = [(k, f"note {k}: {text} and {other}") for k, ((_, text), other) in enumerate(zip(pii.composed(11, 10), pii.ordinary(12, 10)))]
    return pii.train(spark.createDataFrame(docs, "doc_id long, text string"))


def test_held_out_spellings_are_found_and_clean_numbers_left(spark):
    weights = _trained(spark)
    rng, wanted, found = np.random.default_rng(5), np.zeros(4), np.zeros(4)
    for kind, text in pii.composed(77, 60):
        for other in pii.spellings(kind, text):
            frame = FRAMES[rng.integers(len(FRAMES))]
            at, whole = frame.index("{}"), frame.format(other)
            wanted[kind] += 1
            found[kind] += any((k, a, b) == (pii.KINDS[kind], at, at + len(other)) for k, a, b, _ in pii.spans_of(whole, weights))
    assert (found / wanted >= RECALL).all(), dict(zip(pii.KINDS, found / wanted))
    clean = [frame.format(text) for text in pii.ordinary(78, 20) for frame in FRAMES[:3]]
    added = [(text, spans) for text in clean if (spans := [x for x in pii.spans_of(text, weights) if not x[3]])]
    assert len(added) * 1000 <= FALSE * len(clean), added[:10]


def test_prose_with_at_and_dot_is_no_address(spark):
    weights = _trained(spark)
    clean = ["look at example.org", "we met at noon. Dot was late", "at the dot", " at ", "a at ", "stay at home dot"]
    assert [pii.spans_of(text, weights) for text in clean] == [[]] * len(clean)
    assert list(pii.regions("write to jo.li [at] mail [dot] org or 5")) == [(9, 34), (38, 39)]


def test_regions_that_overlap_are_one():
    assert list(pii.regions("a1 b2[at]c3[dot]d4 e5")) == [(0, 21)]
    assert list(pii.regions("")) == [] and list(pii.regions("no such thing")) == []
