"""Issues with odd texts, against the SQL."""

import duckdb

from mnemosail.plans import QUERIES, SQL

LONG = "a comment of more than twenty letters"
DOCS = [
    (1, "plain text of a document", "en", "web"), (2, "", "en", "web"), (3, " \n\t ", "en", "web"), (4, None, "en", "web"), (5, "\xa0kept ", "en", "web"),
    (6, "no language", None, "web"), (7, "no source", "en", None), (8, "\v bell \x1c", "de", "b"), (9, "ü" * 1300 + "\n" + "x" * 700 + " \n", "de", "b"), (10, "last\n\x85", "en", "web"),
]
TALK = [
    (1, 0, LONG), (1, None, LONG + " without a place"), (1, 1, None), (1, 2, "short"), (1, 5, "\xa0" + LONG + "　"), (1, 6, " " * 30), (2, 0, LONG + "\n\n"), (4, 0, LONG), (9, 1, "y" * 2500 + " "), (9, 2, "\v" + LONG),
    *((10, k, f"{LONG} {k}") for k in range(40)),
]


def test_issues_are_cut_as_in_the_sql(spark, tmp_path):
    spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(c, t, "user", x) for c, t, x in TALK], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    for name in ("documents", "conversations"):
        db.sql(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = sorted(db.sql(SQL["process_issue"]).fetchall())
    assert sorted(map(tuple, QUERIES["process_issue"](spark, str(tmp_path)).collect())) == want and len(want) > 20
