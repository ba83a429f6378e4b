"""A small documents table with every awkward case."""

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark, more=()):
    long = " ".join(f"word{i % 977} line{i % 31}" + ("\n" if i % 13 == 0 else "") for i in range(20_000))
    rows = [
        (1, None, "en", "src0", None),
        (2, "", None, None, 0),
        (3, " \n\t ", "en", "src1", 4),
        (None, "a text whose id is null and which has some words", "en", "src0", 10),
        (4, "one", "en", None, 3),
        (5, "1234 ### %% 99", "de", "src1", 14),
        (6, long, "en", "src2", len(long)),
        (7, "the same row twice " * 30, "en", "src1", 1),
        (7, "the same row twice " * 30, "en", "src1", 1),
        (8, "an id that two texts share, first " + " ".join(f"alpha{i}" for i in range(60)), "en", "src1", 1),
        (8, "an id that two texts share, second " + " ".join(f"beta{i}" for i in range(60)), "en", "src1", 1),
        *more,
    ]
    return spark.createDataFrame(rows, DDL)


def clashing(df):
    """df with columns whose names operators use inside."""
    from pyspark.sql import functions as F

    out = df
    for c in ("doc", "th", "gone", "node", "size", "class", "kept", "score", "quarry_doc", "quarry_th", "quarry_text", "QUARRY_gone", "quarry_removed", "quarry_q_", "h", "t", "start", "end", "words", "n"):
        out = out.withColumn(c, F.lit("x"))
    return out


def empty(spark):
    return spark.createDataFrame([], DDL)
