"""The graph as a whole and around some nodes."""

from factweave.operators import graph


def test_view(spark):
    nodes = spark.createDataFrame([("a", False), ("b", True), ("c", None), ("d", False), ("e", False)], "id string, archived boolean")
    edges = spark.createDataFrame([("a", "b"), ("c", "a"), ("b", "c"), ("d", "e"), ("a", "gone")], "source string, target string")
    ids = spark.createDataFrame([("a",)], "id string")

    def told(pair):
        return [r.id for r in pair[0].collect()], sorted(map(tuple, pair[1].collect()))

    assert told(graph.view(nodes, edges, most=2)) == (["a", "b"], [("a", "b"), ("a", "gone"), ("b", "c"), ("c", "a"), ("d", "e")])
    assert told(graph.view(nodes, edges, ids)) == (["a", "b", "c"], [("a", "b"), ("b", "c"), ("c", "a")])
    assert told(graph.view(nodes, edges, ids, archived=False, most=1)) == (["a"], [("c", "a")])
    assert told(graph.view(nodes, edges, ids.limit(0))) == ([], [])
