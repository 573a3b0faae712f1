"""Tables kept with a tree of digests, against a comparison of whole tables."""

import os
import random
import shutil
from collections import Counter, defaultdict

import pytest

from assetloom.plans import hashtree as H
from assetloom.sources import snapshots

SCHEMA = "k string, v string, level int, node long, `Leaf x` string"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, 1, 2, "x") for k, v in rows], SCHEMA)


def expected(old, new):
    """Status by key, of tables as multisets of rows."""
    a, b = defaultdict(Counter), defaultdict(Counter)
    for rows, into in ((old, a), (new, b)):
        for k, v in rows:
            into[k][v] += 1
    return {k: "add" if k not in a else "remove" if k not in b else "change" for k in a.keys() | b.keys() if a.get(k) != b.get(k)}


def got(rows):
    out = [tuple(r) for r in rows.collect()]
    assert len(out) == len(dict(out))
    return dict(out)


def kept(spark, root):
    out = H.read_entries(spark, root)
    return Counter() if out is None else Counter((r.k, r.v) for r in out.collect())


def test_random_tables_in_turn(spark, tmp_path):
    rng = random.Random(5)
    key = lambda: rng.choice([None, "", *map(str, range(60))])
    root, old = str(tmp_path / "t"), []
    for turn in range(4):
        new = [] if turn == 2 else [x for x in old if rng.random() < 0.8] + [(key(), rng.choice([None, "a", "b"])) for _ in range(20)]
        assert got(H.commit(frame(spark, new), root, "k", ["v"], depth=1).rows) == expected(old, new)
        assert kept(spark, root) == Counter(new)
        old = new


def test_only_differing_leaves_are_read_and_written(spark, tmp_path):
    root = str(tmp_path / "t")
    rows = [(str(i), "a") for i in range(200)]
    first = H.commit(frame(spark, rows), root, "k", ["v"], depth=2)
    assert len(first.leaves) > 100
    (run,) = os.listdir(f"{root}/entries")
    new = [(k, "b" if k == "7" else v) for k, v in rows if k != "11"] + [("new", None)]
    leaves = H.diff(frame(spark, new), root, "k", ["v"]).leaves
    assert 1 <= len(leaves) <= 3
    for name in os.listdir(f"{root}/entries/{run}"):  # the others can't be read
        if name.startswith("__leaf") and int(name.split("=")[1]) not in leaves:
            shutil.move(f"{root}/entries/{run}/{name}", f"{root}/entries/{run}/_gone-{name.split('=')[1]}")
    done = H.commit(frame(spark, new), root, "k", ["v"])
    assert got(done.rows) == {"7": "change", "11": "remove", "new": "add"} and done.leaves == leaves
    (added,) = set(os.listdir(f"{root}/entries")) - {run}
    assert {int(n.split("=")[1]) for n in os.listdir(f"{root}/entries/{added}") if "=" in n} <= set(leaves)
    for name in os.listdir(f"{root}/entries/{run}"):
        if name.startswith("_gone"):
            shutil.move(f"{root}/entries/{run}/{name}", f"{root}/entries/{run}/__leaf={name.split('-')[1]}")
    assert kept(spark, root) == Counter(new)
    # nothing changed: no entry is looked at, nothing is written
    at = snapshots.current(spark, root)
    shutil.move(f"{root}/entries", f"{root}/_entries")
    again = H.commit(frame(spark, list(reversed(new))), root, "k", ["v"])
    assert again.leaves == [] and again.rows.isEmpty() and snapshots.current(spark, root) == at


def test_folders_that_no_tree_names_go(spark, tmp_path):
    root = str(tmp_path / "t")
    for v in "abc":
        H.commit(frame(spark, [(str(i), v) for i in range(30)]), root, "k", ["v"], depth=1)
    assert len(os.listdir(f"{root}/entries")) == 2  # what is current and the state before, which readers may still hold
    assert kept(spark, root) == Counter((str(i), "c") for i in range(30))


def test_failed_commit_leaves_the_table(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    H.commit(frame(spark, [("a", "1")]), root, "k", ["v"], depth=1)

    def fails(*_, **__):
        raise RuntimeError("killed")

    monkeypatch.setattr(snapshots, "publish", fails)
    with pytest.raises(RuntimeError):
        H.commit(frame(spark, [("a", "2"), ("b", "2")]), root, "k", ["v"])
    monkeypatch.undo()
    assert kept(spark, root) == Counter([("a", "1")])


def test_depths_and_empty_tables(spark, tmp_path):
    rows = [("a", "1"), ("b", None), (None, "x")]
    for depth in (0, 1, 3):
        root = str(tmp_path / f"t{depth}")
        empty = H.commit(frame(spark, []), root, "k", ["v"], depth=depth)
        assert empty.rows.isEmpty() and H.read_entries(spark, root) is None
        assert got(H.commit(frame(spark, rows), root, "k", ["v"]).rows) == dict.fromkeys(["a", "b", None], "add")
        tree = H.read_tree(spark, root)
        assert H.depth_of(tree) == depth and tree.filter("level = 0").head().n == 3
    with pytest.raises(ValueError):
        H.tree_of(frame(spark, rows), "k", ["v"], 5)
