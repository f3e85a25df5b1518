"""The stored index: what its upkeep shuffles, and rows that repeat."""

from collections import Counter

from tillbook.operators import search as s

SCHEMA = "doc_id long, text string, source string"
ROWS = [(1, "the one the other", "src a"), (1, "the one the other", "src a"), (2, None, "b"), (3, "", None), (None, "no key", "c"), (4, "Ünder the tree", "src")]


def _shuffles(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("hashpartitioning(")[1].split("#")[0] for line in plan.splitlines() if "hashpartitioning(" in line]


def test_words_are_counted_where_their_texts_lie(spark):
    """Every word of every row used to be shuffled by (term, key, len); now its text is, by key."""
    found = s._postings(spark.createDataFrame(ROWS, SCHEMA), "doc_id", ["text", "source"])
    assert _shuffles(found) == ["key"]
    got = {(r["key"], r["term"]): (r["tf"], r["len"]) for r in found.collect()}
    assert got[1, "the"] == (4, 6) and got[1, "src"] == (2, 6) and got[2, "b"] == (1, 1) and got[None, "no"] == (1, 3) and got[4, "under"] == (1, 4)
    assert len(got) == 5 + 1 + 3 + 4
    lengths = Counter((r["key"], r["len"]) for r in s._lengths(spark.createDataFrame(ROWS, SCHEMA), "doc_id", ["text", "source"]).collect())
    assert lengths == Counter({(1, 6): 2, (2, 1): 1, (3, 0): 1, (None, 3): 1, (4, 4): 1})


def test_audit_shuffles_each_side_once(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    path = str(tmp_path / "index")
    s.write_index(docs, "doc_id", ["text", "source"], path)
    assert s.index_audit(docs, "doc_id", ["text", "source"], path).count() == 0
    s.update_index(spark.createDataFrame([(2, "ghost", None)], SCHEMA), "doc_id", ["text", "source"], path, 1, docs.filter("doc_id = 4"))
    found = s.index_audit(docs, "doc_id", ["text", "source"], path)
    assert {c for c in _shuffles(found)} == {"key"}
    rows = {(r["term"], r["key"], r["problem"]) for r in found.collect()}
    assert rows == {("ghost", 2, "extra"), ("b", 2, "missing"), *((t, 4, "missing") for t in ("under", "the", "tree", "src"))}
    s.compact_index(spark, path, f"{path}-compact")
    assert {(r["term"], r["key"], r["problem"]) for r in s.index_audit(docs, "doc_id", ["text", "source"], f"{path}-compact").collect()} == rows
