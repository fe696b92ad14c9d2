"""Nested template specs: leaves in depth-first order, at any depth."""

from fieldloom.operators import templates as G


def nest(depth: int) -> str:
    inner = "struct<label: string>"
    for _ in range(depth - 1):
        inner = f"struct<label: string, nested_fields: array<{inner}>>"
    return inner


def walk(fields, path=()):
    for i, (label, *rest) in enumerate(fields):
        below = rest[0] if rest else None
        if below:
            yield from walk(below, (*path, i))
        else:
            yield len(path) + 1, [*path, i], label


def chain(depth: int, level: int = 1):
    if level == depth:
        return [(f"end {i}",) for i in range(2)]
    return [(f"leaf {level}", None), (f"node {level}", chain(depth, level + 1)), (f"bare {level}", [])]


def test_twelve_levels_in_order(spark):
    specs = spark.createDataFrame([(1, chain(12)), (2, []), (3, None), (4, [("only", None)])], f"doc_id int, fields array<{nest(12)}>")
    got = G.flatten_spec(specs, ["doc_id"]).collect()
    assert [(r.depth, r.path, r.label) for r in got if r.doc_id == 1] == list(walk(chain(12)))
    assert max(r.depth for r in got) == 12
    assert [(r.doc_id, r.depth, r.path, r.label) for r in got if r.doc_id != 1] == [(4, 1, [0], "only")]


def test_flat_specs_and_an_empty_table(spark):
    flat = spark.createDataFrame([(1, [("a",), ("b",)])], "doc_id int, fields array<struct<label: string>>")
    assert [(r.depth, r.path, r.label) for r in G.flatten_spec(flat, ["doc_id"]).collect()] == [(1, [0], "a"), (1, [1], "b")]
    assert G.flatten_spec(flat.limit(0), ["doc_id"]).count() == 0
