"""Line dedup of rows without an id and of rows that share one."""
from __future__ import annotations

from plumbline.llm import hyperminhash, licenses, line_dedup, pii, queries


def test_rows_lose_only_their_own_lines(spark, tmp_path):
    same = "a line that comes in three of the rows of this table"
    rows = [(None, f"alpha has a first line of its own here\n{same}"), (None, f"{same}\nbeta has a second line of its own here"), (None, "gamma is the only line of its row, and there is no other"),
            (7, f"{same}\nseven has a line of its own that nobody else has"), (7, "the other seven has two lines of its own, and\nboth of them stay"), (7, "the other seven has two lines of its own, and\nboth of them stay")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted((r["doc_id"] or 0, r["text"]) for r in line_dedup.deduplicate(docs).collect())
    assert left == sorted([(0, "alpha has a first line of its own here"), (0, rows[1][1]), (0, rows[2][1]), (7, "seven has a line of its own that nobody else has"), (7, rows[4][1]), (7, rows[5][1])])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"] or 0, r["n_lines"], r["n_equal"], r["n_near"], len(r["removed"] or ())) for r in queries.op8_line_dedup(spark, str(tmp_path)).collect())
    assert got == [(0, 1, 0, 0, 0), (0, 2, 0, 0, 0), (0, 2, 1, 0, 1), (7, 2, 0, 0, 0), (7, 2, 0, 0, 0), (7, 2, 1, 0, 1)]


def test_licences_of_rows_that_share_an_id(spark):
    notice = " ".join(licenses.TEMPLATES["MIT"][0].split())
    plain = "a report of the house by the river, which nobody has read for a year"
    rows = [(1, f"{plain}\n{notice}"), (1, plain), (None, plain), (None, notice), (None, None), (2, f"{plain} 2"), (2, f"{plain} 2"), (3, notice), (3, notice)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"] or 0, r["families"], len(r["findings"] or ())) for r in licenses.licences(docs).collect())
    assert got == [(0, [], 0), (0, [], 0), (0, ["MIT"], 1), (1, [], 0), (1, ["MIT"], 1), (2, [], 0), (2, [], 0), (3, ["MIT"], 1), (3, ["MIT"], 1)]


def test_near_duplicates_of_rows_without_an_id(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(None, text), (None, text), (4, text), (5, text), (None, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in hyperminhash.near_duplicates(docs).collect())
    assert got == [(0, 0, True), (0, 0, True), (0, 0, True), (4, 4, True), (5, 4, False), (6, 6, True)]
    assert sorted(r["doc_id"] or 0 for r in hyperminhash.deduplicate(docs).collect()) == [0, 0, 0, 4, 6]


def test_columns_with_clashing_names_pass_through(spark):
    same = "a line that comes in all of the rows of this table"
    own = ["write to {} about the house", "the boat that {} has sold in spring", "nobody but {} was at the river"]
    rows = [(k, f"{same}\n{own[k].format(f'a{k}@example.org')}", f"x{k}", f"y{k}", f"z{k}", f"w{k}") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __gone string, __S string, __id string, __copy string")
    others = sorted((r[0], *r[2:]) for r in rows)
    kept = line_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and sorted((r[0], *r[2:]) for r in kept.collect()) == others
    clean = pii.sanitised(docs)
    assert clean.columns == docs.columns
    got = clean.collect()
    assert sorted((r[0], *r[2:]) for r in got) == others and all(r["text"] == f"{same}\n{own[r['doc_id']].format('[email]')}" for r in got)
