from textloom.operators import mining


def test_random_negatives_come_from_all_documents(spark):
    docs = spark.range(3000).selectExpr("cast(id as string) as doc_id")
    queries = spark.createDataFrame([(str(i),) for i in range(600)] + [("hot",)], "qid string")
    hot = docs.where("cast(doc_id as int) >= 4").selectExpr("'hot' as qid", "doc_id")
    got = mining.random_negatives(queries, docs, hot).collect()
    order = [r.doc_id for r in docs.orderBy(mining.hash_order(docs.doc_id, 42), "doc_id").collect()]
    assert {r.doc_id for r in got if r.qid == "hot"} == {"0", "1", "2", "3"}
    assert {r.doc_id for r in got} & set(order[2000:]) and len(got) == 3004 == len({(r.qid, r.doc_id) for r in got})


def test_texts_are_cut_into_words_once(spark):
    """The length filter counts words once a text, not once for each bound and once for the result."""
    from textloom.operators import ingest

    docs = spark.range(9).selectExpr("cast(id as string) as doc_id", "repeat('word ', int(id)) as text")
    got = ingest.length_filter(docs, 3, 5)
    assert sorted((r.doc_id, r.n_words) for r in got.collect()) == [("3", 3), ("4", 4), ("5", 5)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
