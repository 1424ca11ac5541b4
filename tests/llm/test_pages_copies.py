from paperledger.llm import pages


def test_copies_that_differ_in_a_small_branch_keep_their_text(spark):
    article = "One long story that many pages of this host hold word by word, with more than a few words"
    page = lambda k, text, place: f"<{place}><div class=content>{text}</div><div class=date>day {k}</div><div class=box>All rights</div></{place}>"
    rows = []
    for h, place in enumerate(("body", "article", "main")):
        for k in range(200):
            text = article if k < 195 else f"Another story, number {k}, which no other page of this host holds, also with some words"
            rows.append((h * 1000 + k, f"http://h{h}.example/{k}", page(k, text, place), text))
    df = spark.createDataFrame(rows, "page_id long, url string, html string, given string")
    tree = pages.style_tree(df.select(pages.host_of("url").alias("host"), "html")).where("host = 'h0.example'").collect()
    assert sorted(r["importance"] < pages.LEAST for r in tree) == [False, True, True]
    found = {r["page_id"]: r["text"] for r in pages.extract(df).collect()}
    assert all(found[d] == f"{text}\nday {d % 1000}" for d, _, _, text in rows)


def test_nested_branches_count_their_words_once():
    page = pages.Page("<div class=a><div class=b>one two three</div><div class=c>four</div></div><div class=d>five six seven</div>")
    keys = {texts[0]: key for key, (_, texts) in page.branches.items()}
    assert page.spare(frozenset(page.branches)) != frozenset(page.branches)
    assert page.spare(frozenset([keys["four"], keys["five six seven"]])) == frozenset([keys["four"], keys["five six seven"]])
    assert page.spare(frozenset()) == frozenset()
