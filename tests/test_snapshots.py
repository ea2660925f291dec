"""Snapshot joins, diff lines and bundles on small literal states."""

from textloom.operators.snapshots import commit_bundle, diff_lines, line_diff, review_bundle, snapshot_join

OLD = [("a", "1\n2\n3"), ("b", "x\nx"), ("c", "x"), ("gone", None), ("null", None), ("same", "s")]
NEW = [("a", "1\n3"), ("b", "x\nx\nx"), ("c", "y"), ("new", None), ("null", None), ("same", "s")]


def _states(spark):
    return (spark.createDataFrame(rows, "path string, content string") for rows in (OLD, NEW))


def test_status_is_presence_not_content(spark):
    old, new = _states(spark)
    got = {r.path: r.status for r in snapshot_join(old, new).collect()}
    assert got == {"a": "modified", "b": "modified", "c": "modified", "gone": "removed", "new": "added", "null": "same", "same": "same"}


def test_diff_lines_hold_removals_and_repeats(spark):
    old, new = _states(spark)
    got = sorted(tuple(r) for r in diff_lines(old, new).collect())
    assert got == [("a", "-", 1, "2"), ("b", "+", 2, "x"), ("c", "+", 0, "y"), ("c", "-", 0, "x")]
    assert {tuple(r) for r in line_diff(old, new).collect()} == {("a", 0, 1), ("b", 1, 0), ("c", 1, 1)}


def _plain_diff(old, new):
    """The rule in plain loops: anchors, a longest run of them (latest of each length), multisets in each gap."""
    a, b = old.split("\n"), new.split("\n")
    anchors = [(i, b.index(x)) for i, x in enumerate(a) if a.count(x) == 1 and b.count(x) == 1]
    length = []
    for k, (_, y) in enumerate(anchors):
        length.append(1 + max((length[j] for j in range(k) if anchors[j][1] < y), default=0))
    kept, want, end = [], max(length, default=0), len(anchors)
    while want:
        end = max(k for k in range(end) if length[k] == want)
        kept, want = [anchors[end], *kept], want - 1
    out = set()
    cuts = [(0, 0), *kept, (len(a), len(b))]
    for (i, j), (i2, j2) in zip(cuts, cuts[1:]):
        left, right = a[i:i2], b[j:j2]
        for sign, mine, other, at in (("-", left, right, i), ("+", right, left, j)):
            for x in set(mine):
                spots = [k for k, y in enumerate(mine) if y == x]
                out |= {(sign, at + k, x) for k in spots[min(len(spots), other.count(x)):]}
    return out


def test_ordered_difference_of_random_states(spark):
    """Moved, reversed, repeated and edited lines, and files of one state only, against plain loops."""
    import random

    rnd, old, new = random.Random(9), {}, {}
    for k in range(150):
        a = [rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(1, 14))]
        b = list(a)
        for _ in range(rnd.randint(0, 5)):
            move = rnd.choice(["move", "drop", "add", "reverse", "rotate"])
            at = rnd.randrange(len(b) or 1)
            if move == "move" and b:
                b.insert(rnd.randrange(len(b)), b.pop(at))
            elif move == "drop" and b:
                b.pop(at)
            elif move == "add":
                b.insert(at, rnd.choice("abcxyz"))
            elif move == "reverse":
                b = b[::-1]
            else:
                b = b[at:] + b[:at]
        old[f"f{k}"], new[f"f{k}"] = "\n".join(a), "\n".join(b)
    frame = lambda d: spark.createDataFrame(list(d.items()), "path string, content string")
    got = {}
    for r in diff_lines(frame(old | {"gone": "1\n2"}), frame(new | {"new": "3\n3"})).collect():
        got.setdefault(r.path, set()).add((r.sign, r.pos, r.line))
    want = {p: d for p in old if old[p] != new[p] and (d := _plain_diff(old[p], new[p]))}
    assert got == want | {"gone": {("-", 0, "1"), ("-", 1, "2")}, "new": {("+", 0, "3"), ("+", 1, "3")}}
    assert all(p in got for p in old if old[p] != new[p])  # also lines that only moved give a difference


def test_three_lines_reversed(spark):
    states = [spark.createDataFrame([("r", t)], "path string, content string") for t in ("1\n2\n3", "3\n2\n1")]
    got = sorted((r.sign, r.pos, r.line) for r in diff_lines(*states).collect())
    assert got == [("+", 1, "2"), ("+", 2, "1"), ("-", 0, "1"), ("-", 1, "2")]


def test_context_is_the_closure_of_each_changed_file(spark):
    from textloom.plans.code_jobs import closure_context

    files = spark.createDataFrame(
        [("a.py", "from b import x\nfrom c import y\n"), ("b.py", "from d import z\n"), ("c.py", ""), ("d.py", ""), ("c.pyi", "")], "path string, content string"
    )
    changed = spark.createDataFrame([("a.py",), ("b.py",)], "path string")
    got = lambda depth: {p: [n for _, n in sorted((r.ord, r.node) for r in rows)] for p in ("a.py", "b.py") if (rows := [r for r in closure_context(files, changed, depth).collect() if r.path == p])}
    assert got(1) == {"a.py": ["c.py", "b.py"], "b.py": ["d.py"]}
    assert got(None) == {"a.py": ["c.pyi", "d.py", "c.py", "b.py"], "b.py": ["d.py"]}


def test_bundles_keep_every_file(spark):
    old, new = _states(spark)
    related = spark.createDataFrame([("a", 1, "same"), ("a", 2, "missing"), ("a", 3, "c"), ("same", 1, "a")], "path string, ord int, node string")
    got = {r.path: r.prompt for r in review_bundle(old, new, related).collect()}
    assert got["a"] == "Review the change to a.\nDiff:\n-2\n\nFile a:\n1\n3\n\nFile same:\ns\n\nFile c:\ny\n"
    assert got["c"].startswith("Review the change to c.\nDiff:\n-x\n+y\n") and got.keys() == {"a", "b", "c"}
    from pyspark.sql import functions as F

    rows = {r.path: (r.status, r["diff"], r.content) for r in commit_bundle(old, new, lambda p: F.lit("r")).collect()}
    assert rows["a"] == ("modified", "-2", "1\n3") and rows["gone"] == ("removed", "", None) and rows["new"][0] == "added" and len(rows) == 5
