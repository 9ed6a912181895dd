"""The text that the quality rules leave, against a plain version."""

import re
from collections import Counter

import corpus_pipeline
from tidemark.llm import quality


def norm(line):
    return re.sub(r"[\x20\t\x0b\f\r]+", " ", line).strip(" ").lower()


def test_frequent_lines_leave_the_text(spark, small):
    lines = ["Subscribe  to OUR letter", " subscribe to\tour letter\r", "SUBSCRIBE TO OUR LETTER"]
    data = []
    for i in range(60):
        own = " ".join(f"w{i}x{j}" for j in range(40))
        host = None if i < 30 else "b"
        top = lines[i % 3] if i < 25 or i >= 45 else "nothing of the kind"
        data.append((i, f"{top}\n\n{own}\n{lines[i % 3] if i < 25 else 'end of ' + str(i)}\n", "en", host, 0))
    data += [data[0], (60, None, "en", "b", 0), (61, lines[0], "en", None, 0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")

    texts = {(r[3], r[1] or "") for r in data}
    seen, size = Counter(), Counter(s for s, _ in texts)
    for s, t in texts:
        seen.update({(s, norm(x)) for x in t.split("\n") if norm(x)})
    frequent = {k for k, n in seen.items() if n > 20 or n >= 5 and n * 100 > size[k[0]] * 10}
    assert (None, "subscribe to our letter") in frequent and ("b", "subscribe to our letter") in frequent
    kept = {r.doc_id for r in quality.verdicts(docs).where("kept").collect()}
    want = Counter((r[0], "\n".join(x for x in r[1].split("\n") if (r[3], norm(x)) not in frequent))
                   for r in data if r[0] in kept)
    out = corpus_pipeline.quality_rules(spark, docs, small)
    assert out.columns == docs.columns
    got = out.collect()
    assert Counter((r.doc_id, r.text) for r in got) == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_query_where_lines_are_frequent(spark, tmp_path):
    """The query and its SQL over hosts of every size, copies, nulls, blanks, repeated lines and clashing columns."""
    import duckdb
    import pandas as pd

    from tests.llm.test_sql import rows

    own = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    data = []
    for i in range(90):
        host = None if i < 30 else "big" if i < 75 else "small" if i < 83 else "tiny"
        data.append((i, f"Home |  About\n{own(i, 25 + i % 40)}\n home | about \nCookies\t{'x' if i % 3 else 'y'}\n" * (1 + i % 2), host))
    data += [(100 + i, f"copied line of text {own(7, 30)}\nand another {own(8, 3)}", "big") for i in range(40)]
    data += [(200, None, "big"), (201, "", None), (202, " \n\t\n", "tiny"), (203, "home | about\n" * 30, "big"), (None, own(3, 30), "big"),
             data[0], data[0], (204, "home | about\n" * 5 + own(9, 8), "big")]
    docs = spark.createDataFrame([(a, b, "en", c, 0, "k") for a, b, c in data],
                                 "doc_id long, text string, lang string, source string, n_chars long, __key string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = quality.op9_quality_rules(spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(con.sql(quality.OP9_SQL).df())
    gone = got.set_index("doc_id").n_removed_words
    assert gone[203] == 90 and gone[1] == 16 and gone[100] == 0 and gone[83] == 16
    assert not got[got.doc_id == 203].kept.any() and pd.isna(got.doc_id).sum() == 1
    left = quality.keep_good(docs)
    assert left.columns == docs.columns and left.where("text LIKE '%About%'").count() == 0
    assert quality.keep_good(docs.limit(0)).count() == 0
