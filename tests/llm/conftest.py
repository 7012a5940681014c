from __future__ import annotations

import os

import pytest

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("test tables not present")
    return SF


@pytest.fixture(scope="session")
def texts(spark, sf):
    """Documents of the test table with every awkward case added: ``(doc_id, text, lang, source)`` as plain rows."""
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(90).collect()]
    near = rows[0][1].split(" ")
    rows += [(None, "a row without id, mail x@y.org", None, None), (1_001, None, "en", "s"), (1_002, "", "en", "s"), (1_003, "  \n\t ", None, "s"),
             (1_004, "Two words", "en", None), (1_005, "two WORDS", "en", "s"), (1_006, "one", "en", "s"), (1_007, "one", "en", "s"), (1_007, "one", "en", "s"),
             (1_008, "w" * 300_000, "en", "s"), (1_009, "the of and to in is it " * 20_000, "en", "s"), (1_010, "12345 !!! 678", None, "s"),
             (1_011, " ".join(near[:-1] + ["changed"]), "fr", "s"), (1_012, " ".join(["changed", *near[1:]]), "fr", "s"),
             (1_013, "é" * 10 + " İstanbul ﬁ 日本語 👍🏽 a b \x85 c", "de", "s"),
             (1_014, "write a.b@c.de or a.b@c.de@d.fr, 1.2.3.4.5.6.7.8 and 999.1.1.1; 4111 1111 1111 1111 +1 (743) 555-3824 + 12", "en", "s"),
             (1_015, "me[at]site[dot]org, 0049 30 1234567, 4111.1111.1111.1111, at home. Then 3.14.15.92", "en", "s"),
             (1_016, "9" * 5_000 + " " + "7-" * 3_000 + " " + "1." * 3_000 + "+" + "1 " * 3_000, "en", "s")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The same as a DataFrame, with columns whose names the operators use inside."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").repartition(5)
    for name in ("node", "keys", "draw", "cell", "x", "shard", "start", "length", "_salt", "_marks", "pii", "ids", "n", "at", "score", "lang_pred", "n_lines"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
