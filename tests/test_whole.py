"""Queries that must take in whole tables, on tables whose sizes differ."""

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import registry
from tests.test_registry_rows import norm

WORDS = ["exit", "load", "fund", "units", "tax", "index", "folio", "manager", "growth", "plan", "ratio"]


def matches_sql(rows, name, at):
    columns = sorted(rows[0].asDict())
    con = duckdb.connect()
    for f in at.iterdir():
        if f.suffix == ".parquet":
            con.execute(f"create view {f.stem} as select * from '{f}/*.parquet'")
    con.execute(registry.oracle_sql()[name])
    found = [x[0] for x in con.description]
    want = sorted(tuple(norm(r[found.index(c)]) for c in columns) for r in con.fetchall())
    return sorted(found) == columns and want == sorted(tuple(norm(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize(("n_vectors", "n_docs"), [(7, 40), (40, 7)])
def test_all_documents_and_questions_are_retrieved(spark, tmp_path, n_vectors, n_docs):
    text = lambda i: " ".join(WORDS[(i * k) % 11] for k in range(1, 9)) + f" w{i}"
    vectors = [(i, f"l{i % 3}", [float((i * k) % 13) - 6 for k in range(1, 6)]) for i in range(n_vectors)]
    spark.createDataFrame(vectors, "vec_id long, label string, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i + 1, text(i)) for i in range(n_docs)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i + 1, text(i)) for i in range(n_docs)], "id int, question string").write.parquet(f"{tmp_path}/in_scope.parquet")
    rows = registry.queries()["hybrid_retrieve"](spark, str(tmp_path)).collect()
    assert {r.qid for r in rows} == {f"{i + 1}-{kind}" for i in range(n_docs) for kind in ("plain", "pinned", "turned")}
    assert matches_sql(rows, "hybrid_retrieve", tmp_path)
    floors = registry.queries()["floor_rescue"](spark, str(tmp_path)).collect()
    assert len(floors) == 3 * n_docs and matches_sql(floors, "floor_rescue", tmp_path)
    chunks, _ = registry._paired(spark, str(tmp_path))
    assert chunks.agg(F.count("text"), F.count_distinct("chunk_index")).first()[:] == (n_docs, max(n_docs, n_vectors))


def test_review_dump_has_whole_texts(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(60)) + "\nlast line"
    schema = "chunk_index int, doc_id string, scheme string, title string, section string, text string, warnings array<string>, n_words int, n_chars int"
    spark.createDataFrame([(7, "2", "s", "T", "S", long, ["over budget"], 62, 1460), (1000, "10", None, "T", "", "short", [], None, 5)], schema).write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([("2", 0, "Kept", True, None), ("2", 1, "Share", False, "dropped section"), ("2", 1, "Share", False, "dropped section")], "doc_id string, sec_ord int, heading string, kept boolean, reason string").write.parquet(f"{tmp_path}/sections.parquet")
    spark.createDataFrame([("2", "s", "T", "u"), ("10", None, None, None)], "doc_id string, scheme string, title string, url string").write.parquet(f"{tmp_path}/sources.parquet")
    rows = registry.queries()["review_dump"](spark, str(tmp_path)).collect()
    assert [(r.part, r.doc_id, r.chunk_index) for r in rows] == [(0, None, None), (1, "2", None), (2, "2", None), (2, "2", 7), (2, "10", None), (2, "10", 1000)]
    assert rows[3].entry == "[007]  S\n        chars=1,460  words=62  source=2  scheme=s  warnings=[over budget]\n\n    " + long.replace("\n", "\n    ")
    assert rows[1].entry == "  [2] Share  -> dropped section" and "2 found, 1 kept, 1 dropped" in rows[0].entry
    assert matches_sql(rows, "review_dump", tmp_path)
