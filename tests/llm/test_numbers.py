"""Components are numbered by first appearance."""

from lodestone.llm.components import connected_components, numbered_components


def test_numbers_by_first_appearance(spark):
    links = connected_components(spark.createDataFrame([(9, 4), (20, 9), (7, 30)], "a bigint, b bigint"))
    nodes = spark.createDataFrame([(30,), (20,), (9,), (None,), (8,), (7,), (4,), (2,), (8,)], "node bigint")
    got = {r.node: (r.component, r.number, r.name) for r in numbered_components(nodes, links).collect()}
    first, second, third, fourth = (2, 0, "g00000"), (4, 1, "g00001"), (7, 2, "g00002"), (8, 3, "g00003")
    assert got == {2: first, 4: second, 9: second, 20: second, 7: third, 30: third, 8: fourth}
