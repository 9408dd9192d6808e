"""Words of a lexicon table in texts."""

from veilspark.operators.tables import censor_by_lexicon


def test_lexicon_words_are_folded_once_as_they_are_written(spark):
    rows = [(1, "Foo fOo bar f00 ｆｏｏ"), (1, "FOO baz"), (None, "foo"), (2, None), (3, "")]
    lexicon = spark.createDataFrame([("foo",), (None,)], "term string")
    df = censor_by_lexicon(spark.createDataFrame(rows, "id int, text string"), ["id"], lexicon)
    got = sorted(((r.id, r.text) for r in df.collect()), key=repr)
    assert got == sorted([(1, "F** f** bar f** ｆ**"), (1, "F** baz"), (None, "f**"), (2, None), (3, "")], key=repr)
    # The second pass over a text folds no word again.
    top = df._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "array_intersect" in top and "translate" not in top
