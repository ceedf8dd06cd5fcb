"""Paths through links against a walk in Python; long chains; loops."""

import random

import pytest

from millrace.operators import paths as P

NODES = "parent string, name string, kind string, target string"


def walk(path, nodes, fuel=5000):
    """(canonical, found) by following one link at a time."""
    kinds = {(f"{p}/{n}" if p else n): (k, p, t) for p, n, k, t in reversed(nodes)}
    todo, at = [s for s in path.strip("/").split("/") if s], ""
    while todo:
        fuel -= 1
        if fuel < 0:
            return None, "loop"
        name = todo.pop(0)
        here = f"{at}/{name}" if at else name
        k = kinds.get(here)
        if k and k[0] == "l":
            target = k[2].strip("/") if k[2].startswith("/") or not k[1] else f"{k[1]}/{k[2]}".strip("/")
            todo = target.split("/") + todo if target else todo
            at = ""
            continue
        at = here
    kind = kinds.get(at, ("",))[0]
    if at == "":
        return "", "folder"
    return (at, "folder") if kind == "d" else (at, "file") if kind == "f" else (None, "missing")


def made(spark, nodes, asked):
    df = spark.createDataFrame([(i, p, 9) for i, p in enumerate(asked)], "i long, p string, canonical_of int")
    rows = P.resolved(df, "p", spark.createDataFrame(nodes, NODES)).collect()
    return [(r.canonical, r.found) for r in sorted(rows, key=lambda r: r.i)]


def test_small_tree(spark):
    nodes = [("", "src", "d", None), ("src", "v9", "d", None), ("src", "latest", "l", "v9"), ("", "dev", "l", "src/latest"), ("src/v9", "a.tar", "f", None), ("src/v9", "up", "l", "/src"), ("", "gone", "l", "nowhere"), ("", "x", "l", "y"), ("", "y", "l", "x"), ("", "self", "l", "self/self"), ("", "in", "l", "x/deep")]
    asked = ["", "/", "src", "src/latest/", "dev", "dev/a.tar", "dev/up/latest/up/v9", "gone", "gone/more", "x", "y/z", "self", "in", "src/none", "src/v9/a.tar/more", None, "dev"]
    want = [("", "folder"), ("", "folder"), ("src", "folder"), ("src/v9", "folder"), ("src/v9", "folder"), ("src/v9/a.tar", "file"), ("src/v9", "folder"), (None, "missing"), (None, "missing"), (None, "loop"), (None, "loop"), (None, "loop"), (None, "loop"), (None, "missing"), (None, "missing"), (None, "missing"), ("src/v9", "folder")]
    assert made(spark, nodes, asked) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_random_trees_equal_a_walk(spark, seed):
    rng = random.Random(seed)
    folders = ["", "a", "b", "a/a", "a/b", "b/a"]
    nodes = [(f.rpartition("/")[0], f.rpartition("/")[2], "d", None) for f in folders[1:]]
    names = ["a", "b", "l", "m", "n", "f"]
    for f in folders:
        for n in ("l", "m", "n"):
            if rng.random() < 0.7:
                nodes.append((f, n, "l", ("/" if rng.random() < 0.4 else "") + "/".join(rng.choice(names) for _ in range(rng.randint(1, 3)))))
        nodes.append((f, "f", "f", None))
    asked = ["/".join(rng.choice(names) for _ in range(rng.randint(1, 4))) for _ in range(120)]
    assert made(spark, nodes, asked) == [walk(p, nodes) for p in asked]


def test_a_chain_of_1000_links_takes_about_ten_rounds(spark):
    nodes = [("", f"n{i}", "l", f"n{i + 1}") for i in range(1000)] + [("", "n1000", "d", None)]
    df = spark.createDataFrame(nodes, NODES).repartition(4)
    targets, rounds = P.link_targets(df)
    assert rounds <= 12
    assert {(r.pointer, r.state) for r in targets.collect()} == {("n1000", "free")}


def test_loops_of_any_length_end(spark):
    nodes = [("", f"c{n}-{i}", "l", f"c{n}-{(i + 1) % n}") for n in (1, 2, 3, 5, 7) for i in range(n)] + [("", "into", "l", "c3-1/x")]
    targets, _ = P.link_targets(spark.createDataFrame(nodes, NODES))
    assert {r.state for r in targets.collect()} == {"loop"} and targets.count() == 19


def test_no_nodes_and_no_paths(spark):
    none = spark.createDataFrame([], NODES)
    df = spark.createDataFrame([("a",), ("",)], "p string")
    assert {(r.p, r.found) for r in P.resolved(df, "p", none).collect()} == {("a", "missing"), ("", "folder")}
    assert P.resolved(df.limit(0), "p", none).count() == 0
