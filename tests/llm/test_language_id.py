import zlib

from wavelake.llm import language_id, queries


def test_query_on_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in queries.documents(spark, sf).collect()}
    got = queries.op10_language_id(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in out) >= 0.97 * len(out)
    assert sum(r.rejected for r in got) <= 0.03 * len(got)


def test_odd_rows(spark):
    lines = {"en": "the and with from this that", "fr": "une les dans pour avec est", "de": "der die und nicht auch eine"}
    train = spark.createDataFrame([(f"{line} {w} x{i}", lang) for lang, line in lines.items() for i in range(30) for w in line.split()[i % 6 : i % 6 + 2]], "text string, lang string")
    model = language_id.fit(train, buckets=4096)
    rows = [(1, None, "a"), (2, "", "a"), (3, "123 ,.!", "b"), (4, "the and with " * 20000, "b"), (4, "the and with " * 20000, "b"), (None, "der und nicht", "c")]
    out = language_id.predict(spark.createDataFrame(rows, "doc_id long, text string, score string"), model)
    got = out.collect()
    assert len(got) == 6 and out.columns == ["doc_id", "text", "lang_pred", "score", "rejected"]
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (1, 2, 3, 4, None)] == ["und", "und", "und", "en", "de"]
    assert all(by[k].rejected and by[k].score == 0 for k in (1, 2, 3))
    assert language_id.fit(train.limit(0)) is None
    assert {r.lang_pred for r in language_id.predict(train, None).collect()} == {"und"}
    assert language_id.predict(train.limit(0), model).count() == 0
