"""Tree rules on hand-written rows, and properties of paths."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cargohold.operators import tree

ITEM = "container_id string, item_index long, path string, is_dir boolean, size long, packed_size long"


def items(spark, *paths, dirs=()):
    return tree.placed(spark.createDataFrame([("c", i, p, i in dirs, 1, 1) for i, p in enumerate(paths)], ITEM))


def names(spark, *paths):
    return [r.new_name for r in tree.unique_names(items(spark, *paths)).orderBy("item_index").collect()]


def test_collisions(spark):
    assert names(spark, "x.txt", "x.txt", "x.txt") == ["x.txt", "x,2.txt", "x,3.txt"]
    assert names(spark, "x,2.txt", "x.txt", "x.txt") == ["x,2.txt", "x.txt", "x,3.txt"]
    assert names(spark, "README", "README") == ["README", "README,2"]
    assert names(spark, "X.txt", "x.txt") == ["X.txt", "x.txt"]
    assert names(spark, "x.txt", "x.txt", "x,2.txt") == ["x.txt", "x,2.txt", "x,2,2.txt"]


def test_dotted_names_collide(spark):
    assert names(spark, ".x", ".x", "a.", "a.") == [".x", ",2.x", "a.", "a,2."]
    assert names(spark, *["x,2.t"] * 3, "x.t", "x.t") == ["x,2.t", "x,2,2.t", "x,2,3.t", "x.t", "x,3.t"]


def test_lookups(spark):
    """The empty path and a separator are the container; a leading or doubled one is nothing; a trailing one a directory."""
    nodes = items(spark, "d", r"d\f", "f", dirs=(0,))
    found = {p: [(r.item_index, r.is_dir) for r in tree.found_at(nodes, p).collect()] for p in ("", "\\", "d", "d\\", "f", "f\\", r"\d", r"d\f", r"d\\f", "D")}
    assert found == {"": [(-1, True)], "\\": [(-1, True)], "d": [(0, True)], "d\\": [(0, True)], "f": [(2, False)], "f\\": [], r"\d": [], r"d\f": [(1, False)], r"d\\f": [], "D": []}


def test_moves(spark):
    nodes = items(spark, "d", r"d\f", r"d\e", dirs=(0, 2)).select("container_id", "path")
    cases = {("d", "e"): r"d\e", ("d", ".."): "", ("", ".."): None, ("d", "/d/f"): r"d\f", ("d", "gone"): None, ("d", "gone/.."): None, ("d", "e/../f/"): r"d\f", ("d", ""): None, ("d", "f/.."): "d", (r"d\e", "/"): ""}
    moves = spark.createDataFrame([("c", *k) for k in cases], "container_id string, current string, to string")
    assert {(r.current, r.to): r.target for r in tree.entered(moves, nodes).collect()} == cases


def test_listing_order(spark):
    nodes = items(spark, "b", "a", "Z", "z", "c", dirs=(3, 4))
    assert [(r.name, r.is_dir) for r in tree.listed(nodes, "").collect()] == [("c", True), ("z", True), ("Z", False), ("a", False), ("b", False)]


def test_dirs_are_counted_if_none_is_reported(spark):
    assert tree.dir_counts(items(spark, r"a\b\c", r"a\d")).first().n_dirs == 2
    assert tree.dir_counts(items(spark, r"a\b\c", "x", dirs=(1,))).first().n_dirs == 1
    # a second row for a directory is no second directory, but is reported
    twice = items(spark, "d", "d", dirs=(0, 1))
    assert tree.all_dirs(twice).count() == 1 and tree.totals(twice).first().n_dirs_reported == 2


def test_resolve(spark):
    cases = {r"a\b\c.txt": r"a\b\c.txt", r".\a.txt": "a.txt", r"a\..\b.txt": "b.txt", r"..\a.txt": None, r"a\\b.txt": r"a\b.txt", r"a\..\..\b": None, r"a\..\..\b\c\d": None, "": ""}
    df = spark.createDataFrame(list(cases.items()), "p string, want string").withColumn("got", tree.resolved(F.col("p")))
    assert [(r.got, r.p) for r in df.collect()] == [(want, p) for p, want in cases.items()]


def test_dirs_are_synthesized_once(spark):
    found = tree.all_dirs(items(spark, r"a\b\c.txt", "d", "d", r"d\e\f", dirs=(1, 2)))
    assert {(r.path, r.item_index) for r in found.collect()} == {("a", -1), (r"a\b", -1), ("d", 1), (r"d\e", -1)}


def test_lookup_prefers_dirs(spark):
    assert tree.found_at(items(spark, "d", "d", dirs=(1,)), "d").first().is_dir


def test_bad_item_drops_its_container(spark):
    assert tree.whole_containers(items(spark, "ok", r"..\bad")).count() == 0
    assert tree.whole_containers(items(spark).limit(0)).count() == 0


def test_subtree_keeps_empty_dirs(spark):
    found = tree.subtree(items(spark, r"a\x", r"a\empty", r"a\full", r"a\full\y", dirs=(1, 2)), "a")
    assert {r.path for r in found.collect()} == {r"a\x", r"a\empty", r"a\full\y"}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", ".", "..", ""]), min_size=1, max_size=6), min_size=1, max_size=20))
def test_resolved_paths_are_fixed_points(spark, parts):
    df = spark.createDataFrame([("\\".join(p),) for p in parts], "p string").select(tree.resolved(F.col("p")).alias("p")).filter("p IS NOT NULL")
    for r in df.withColumn("again", tree.resolved(F.col("p"))).collect():
        stack = []
        for x in r.p.split("\\"):
            assert x not in (".", "..")
            stack.append(x)
        assert r.again == r.p or r.p.startswith("\\") or r.p == ""


def test_rollup_adds_up(spark):
    files = items(spark, "a", r"b\c", r"b\d\e")
    found = {r.path: r.total_size for r in tree.rollup(files).collect()}
    assert found == {"": 3, "b": 2, r"b\d": 1}
