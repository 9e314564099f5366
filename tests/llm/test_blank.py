"""Texts of white space alone."""

from ledgerloom.llm import queries, splitting
from ledgerloom.llm.splitting import Budget, cut


def test_long_white_space_is_cut(spark, tmp_path):
    blank = " \n\t" * 1400
    assert [(a, b, n) for a, b, n, _ in cut(blank, Budget())] == [(0, 2000, 0), (2000, 4000, 0), (4000, 4200, 0)] and cut("", Budget()) == []
    spark.createDataFrame([("a", 1, blank), ("b", 1, " " * 2000), ("c", 1, None)], "doc_id string, sec_ord int, text string").write.parquet(f"{tmp_path}/sections.parquet")
    spark.createDataFrame([(5, "d", chr(160) * 2001, "short")], "chunk_index int, doc_id string, text string, body string").write.parquet(f"{tmp_path}/chunks.parquet")
    assert {r[:] for r in queries.p3_found(spark, str(tmp_path)).collect()} == {("section.text", "a", 1), ("chunk.text", "d", 5)}
    pieces = splitting.split_oversized(spark.createDataFrame([("a", blank)], "k string, body string"), ["k"], "body").collect()
    assert "".join(r.text for r in sorted(pieces, key=lambda r: r.piece)) == blank
