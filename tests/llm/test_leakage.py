from tessellar.llm.leakage import leaks


def test_edits_that_hit_every_gram_of_a_short_window(spark):
    docs = spark.createDataFrame([(1, "a b x d e y g h z j k l"), (2, "b c d e f g h i j k l"), (3, "a x c d y f g z i j w l"), (4, "m n o p q r s t u v w x")], "doc_id bigint, text string")
    items = spark.createDataFrame([(10, "a b c d e f g h i j k l"), (11, "recover the lost file at revision seven then place everything under the old folder")], "item_id bigint, text string")
    got = leaks(docs, "doc_id", "text", items, "item_id", "text", words=12, edits=3).collect()
    assert sorted(tuple(r) for r in got) == [(1, 10, 1), (2, 10, 1)]
