"""NFKC: equal to Python's, and ASCII texts do not pass through Python."""
import unicodedata

from pyspark.sql import functions as F

from lodestone.functions import text as tx


def test_nfkc(spark, monkeypatch):
    given = ["plain", "été ¿no?", "été", "ﬁ ① ½ ª", "가", "ạ́", "Ａ　Ｂ", "ẹ́", "😀", "", None, *[f"ﬁ{i}" for i in range(200)]]
    df = spark.createDataFrame(list(enumerate(given)), "i int, t string").coalesce(1)
    got = [r.n for r in df.select("i", tx.nfkc(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [x if x is None else unicodedata.normalize("NFKC", x) for x in given]
    sent = spark.sparkContext.accumulator(0)

    @F.arrow_udf("string")
    def counted(c):
        sent.add(len(c) - c.null_count)
        return c

    monkeypatch.setattr(tx, "_nfkc", counted)
    df.where("i < 4").select(tx.nfkc(F.col("t")).alias("n")).collect()
    assert sent.value == 3
