"""The copy at a source's cut is a beginning of its text as it stands."""

from pyspark.sql import functions as F

from kindling.llm import mixing


def test_first_words_keep_blanks(spark):
    text = " \n one  two\n\tthree\r\n four  "
    rows = spark.createDataFrame([(text, 1), (text, 2), (text, 3), (text.strip(), 2), ("é中 😀\nb c", 2)], "t string, n int")
    want = [" \n one", " \n one  two", " \n one  two\n\tthree", "one  two", "é中 😀"]
    assert [r[0] for r in rows.select(mixing.first_words(F.col("t"), F.col("n"))).collect()] == want


def test_mixed_texts_are_beginnings(spark):
    texts = {i: "\n".join(f"  w{j}\tx{j}" for j in range(40 + i)) for i in range(30)}
    docs = spark.createDataFrame([(i, t, f"s{i % 3}") for i, t in texts.items()], "doc_id long, text string, source string")
    got = mixing.mixed(docs).collect()
    assert all(texts[r.doc_id].startswith(r.text) for r in got) and any(r.text != texts[r.doc_id] for r in got)
