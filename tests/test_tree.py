from pyspark.sql import functions as F

from lodestone import render
from lodestone.operators.tree import common_directory, natural_key, ordered_nodes, tree_nodes

SHAPE = (
    "qid int, display_path string, heading array<string>, start_line int, end_line int, score double"
)
PEAK = [
    ("man/wide.md", ["Wide", "Lots"], 2, 3, 0.6),
    ("man/wide.md", ["Wide", "Lots"], 5, 6, 0.6),
    ("man/best.md", ["Best", "Inner", "Result"], 11, 13, 0.95),
    ("man/best.md", ["Best", "Rest"], 21, 25, 0.25),
    ("man/deep/solo.md", ["Solo", "Mid", "End"], 31, 31, 0.5),
]


def as_dicts(rows):
    names = ("path", "heading", "start_line", "end_line", "score")
    return [dict(zip(names, row, strict=True)) for row in rows]


def test_tree_groups_files_headings_and_lines():
    rows = [
        ("kb/net/dns.md", ["DNS", "2. Cache", "2.1 TTL"], 40, 44, 0.75),
        ("kb/net/dns.md", ["DNS", "2. Cache", "2.2 Flush"], 50, 50, 0.5),
        ("kb/net/tls.md", ["TLS", "Setup"], 7, 9, 0.65),
    ]
    assert render.tree(as_dicts(rows)).splitlines() == [
        "kb/net/",
        "├─ dns.md › 2. Cache ×2 .625",
        "│  ├─ 2.1 TTL L40-44 .750",
        "│  └─ 2.2 Flush L50 .500",
        "└─ tls.md › Setup L7-9 .650",
    ]


def test_tree_collapses_and_orders_by_best_match():
    wanted = [
        "man/",
        "├─ best.md ×2 .600",
        "│  ├─ Inner › Result L11-13 .950",
        "│  └─ Rest L21-25 .250",
        "├─ wide.md › Lots ×2 .600",
        "│  ├─ L2-3 .600",
        "│  └─ L5-6 .600",
        "└─ deep/solo.md › Mid › End L31 .500",
    ]
    assert render.tree(as_dicts(PEAK)).splitlines() == wanted
    assert render.tree(as_dicts(PEAK[::-1])).splitlines() == wanted


def test_tree_without_a_shared_folder():
    rows = [("NOTES.md", ["NOTES"], 2, 4, 0.7), ("kb/z.md", ["Z", "More"], 5, 9, 0.8)]
    assert render.tree(as_dicts(rows)).startswith("./\n")
    assert render.tree([]) == "No matching documentation found.\n"


def test_node_statistics_come_from_leaves(spark):
    frame = spark.createDataFrame([(0, *row) for row in PEAK + PEAK[:1]], SHAPE)
    nodes = {
        "/".join(n.label for n in r.node): r for r in ordered_nodes(tree_nodes(frame)).collect()
    }
    peak = nodes["best.md"]
    assert (peak.leaves, round(peak.average, 6), peak.maximum, peak.place) == (2, 0.6, 0.95, 1)
    assert nodes["wide.md"].leaves == 2 and nodes["wide.md/Lots"].place == 1
    assert nodes["deep"].place == 3 and nodes["best.md/Rest"].place == 2


def test_common_directory(spark):
    rows = [(0, "a/b/c.md"), (0, "a/b/d/e.md"), (1, "x.md"), (1, "a/y.md"), (2, "a/b/c.md")]
    frame = spark.createDataFrame(rows, "qid int, display_path string")
    found = {r.qid: list(r.common) for r in common_directory(frame).collect()}
    assert found == {0: ["a", "b"], 1: [], 2: ["a", "b"]}


def test_numbers_of_any_length_sort_by_value(spark):
    labels = ["n2", "n10", "n12345678901234567890", "n0003", "n", "m9"]
    frame = spark.createDataFrame([(x,) for x in labels], "label string")
    rows = frame.orderBy(natural_key(F.col("label"))).collect()
    assert [r.label for r in rows] == ["m9", "n", "n2", "n0003", "n10", "n12345678901234567890"]
