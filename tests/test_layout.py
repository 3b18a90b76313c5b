from quantafold.functions.clauses import join_clauses, longest_matches, parse_clauses
from quantafold.operators.layout import clauses, grid_cells, segment_blocks, transfer_labels, words_in_boxes

BOX = "struct<x0: double, y0: double, x1: double, y1: double>"


def test_clauses_and_back(spark):
    text = "Terms: (a) first item as in (c) above; (b) second: (i) one (ii) two; (c) third"
    got = parse_clauses(text)
    assert [(label, level) for label, _, level in got] == [("", 0), ("(a)", 1), ("(b)", 1), ("(i)", 2), ("(ii)", 2), ("(c)", 1)]
    assert join_clauses(got) == text
    assert parse_clauses(None) == parse_clauses(" ") == [] and parse_clauses("plain") == [("", "plain", 0)]
    df = spark.createDataFrame([(1, text), (2, None)], "k int, t string")
    assert [r.label for r in clauses(df, "k", "t").orderBy("pos").collect()] == [label for label, _, _ in got]


def test_longest_matches():
    assert longest_matches([("kg", 2, 3), ("kg CO2", 2, 7), ("CO2", 5, 7), ("t", 9, 9)]) == [("kg CO2", 2, 7), ("t", 9, 9)]


def test_words_blocks_labels(spark):
    words = spark.createDataFrame([(1, 0, (0.0, 0.0, 1.0, 1.0), "a"), (1, 1, (2.0, 0.0, 3.0, 1.0), "b"), (1, 2, (50.0, 0.0, 51.0, 1.0), "c")], f"page int, pos int, box {BOX}, word string")
    areas = spark.createDataFrame([(1, 7, (0.0, 0.0, 10.0, 10.0)), (1, 8, (90.0, 90.0, 99.0, 99.0))], f"page int, obj_id int, box {BOX}")
    assert {r.obj_id: r.text for r in words_in_boxes(words, areas, ["page"]).collect()} == {7: "a b", 8: ""}
    items = spark.createDataFrame([("d", 1, "title"), ("d", 2, "text"), ("d", 3, "text"), ("d", 4, "title"), ("d", 5, None)], "doc string, pos int, tag string")
    assert [r.block for r in segment_blocks(items, "doc", "pos", "tag", {"title": ["text"], "text": ["text"]}).orderBy("pos").collect()] == [1, 1, 1, 2, 3]
    tokens = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "v string, pos int")
    truth = spark.createDataFrame([("x", 5, "B"), ("z", 6, "I")], "v string, pos int, tag string")
    assert [r.tag for r in transfer_labels(tokens, truth, ["v"], "pos", "tag").orderBy("pos").collect()] == ["B", None, None]


def test_grid_with_a_spanning_cell(spark):
    schema = f"t string, obj_id int, box {BOX}"
    rows = spark.createDataFrame([("t", i, (0.0, 10.0 * i, 20.0, 10.0 * i + 10)) for i in (0, 1)], schema)
    columns = spark.createDataFrame([("t", i, (10.0 * i, 0.0, 10.0 * i + 10, 20.0)) for i in (0, 1)], schema)
    spans = spark.createDataFrame([("t", 5, (0.0, 0.0, 20.0, 10.0))], schema)
    got = sorted((r.rows, r.columns, r.span_id) for r in grid_cells(rows, columns, spans, "t").collect())
    assert got == [([0], [0, 1], 5), ([1], [0], None), ([1], [1], None)]
