import json
import random

from penduline.operators import drift

LINES = "row_no bigint, stream_id string, kind string, file_no int, line_no int, body string, path string"


def _lines(spark, rows):
    return spark.createDataFrame([(n, s, "view_a", f, n, b if b is None or isinstance(b, str) else json.dumps(b), None) for n, (s, f, b) in enumerate(rows)], LINES)


def _flat(value, at=""):
    for k, v in value.items():
        path = f"{at}.{k}" if at else k
        if isinstance(v, dict):
            yield from _flat(v, path)
        else:
            yield path, v


def _brute(rows):
    kind = lambda v: "boolean" if isinstance(v, bool) else "number" if isinstance(v, int | float) else "string" if isinstance(v, str) else "array"
    files = {}
    for s, f, b in rows:
        held = files.setdefault((s, f), [])
        try:
            b = json.loads(b) if isinstance(b, str) else b
        except ValueError:
            b = None
        if isinstance(b, dict):
            held.append(b)
    out = set()
    for s, f in files:
        before = [g for t, g in files if t == s and g < f]
        if not before:
            continue
        said = []
        for lines in (files[s, max(before)], files[s, f]):
            paths, values = {}, {}
            for b in lines:
                for p, v in _flat({k: x for k, x in b.items() if k != "site"}):
                    paths.setdefault(p, set())
                    if v is not None:
                        paths[p].add(kind(v))
                        values.setdefault((b.get("site"), p), set()).add(json.dumps(v, sort_keys=True))
            said.append((paths, values))
        (a, va), (b, vb) = said
        gone, come, pairs = set(a) - set(b), set(b) - set(a), set()
        for p in gone:
            for q in come:
                sites = [x for x in {x for x, y in va if y == p} & {x for x, y in vb if y == q} if isinstance(x, str)]
                if sites and all(va[x, p] == vb[x, q] for x in sites):
                    pairs.add((p, q))
        out |= {(s, f, "renamed", p, q) for p, q in pairs}
        out |= {(s, f, "removed", p, "") for p in gone - {p for p, _ in pairs}} | {(s, f, "added", "", q) for q in come - {q for _, q in pairs}}
        out |= {(s, f, "type_changed", p, p) for p in set(a) & set(b) if a[p] and b[p] and a[p] != b[p]}
    return out


def test_against_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for s in ("u", "v"):
        names = [f"f{k}" for k in range(6)]
        for f in (1, 2, 3, 5, 8):
            names = [n if rng.random() < 0.7 else f"{n}x{f}" for n in names]
            made = {n: rng.choice([str, int, bool, list, lambda x: None]) for n in names}
            for site in rng.sample(range(6), 4):
                body = {"site": f"s{site}"}
                for k, n in enumerate(names):
                    v = made[n](site * 10 + k) if made[n] is not list else [site, k]
                    target = body.setdefault("meta", {}) if k % 2 else body
                    if rng.random() < 0.9:
                        target[n] = v
                rows.append((s, f, body))
        rows += [(s, 3, rows[-1][2]), (s, 2, "{broken"), (s, 2, None), (s, 2, ""), (s, 2, "[1]"), (s, 9, "gone"), (s, 10, {"site": None, "a": 1}), (s, 11, {"b": 1, "site": 5})]
    assert {tuple(r) for r in drift.changes(_lines(spark, rows)).collect()} == _brute(rows)


def test_rename_needs_equal_values_at_every_shared_site(spark):
    rows = [("s", 1, {"site": "a", "x": 1.0, "y": "p"}), ("s", 1, {"site": "b", "x": 2, "y": None}), ("s", 2, {"site": "a", "z": 1, "w": "p"}), ("s", 2, {"site": "b", "z": 3, "w": "q"})]
    assert {tuple(r)[2:] for r in drift.changes(_lines(spark, rows)).collect()} == {("removed", "x", ""), ("added", "", "z"), ("renamed", "y", "w")}


def test_projection_reports_failed_casts(spark):
    rows = [("s", 1, {"seed": "7", "deep": {"name": "n"}, "tags": ["a"]}), ("s", 2, {"seed": "seven", "tags": "none", "more": None})]
    table = drift.project(drift.path_values(_lines(spark, rows)), {"seed": ("seed", "bigint"), "name": ("deep.name", "string"), "tags": ("tags", "array<string>")})
    a, b = sorted(table.collect(), key=lambda r: r.row_no)
    assert (a.seed, a.name, a.tags, a.bad_casts) == (7, "n", ["a"], [])
    assert (b.seed, b.name, b.tags) == (None, None, None) and {tuple(x) for x in b.bad_casts} == {("seed", "seven"), ("tags", "none")} and b.rest == {"more": None}
    assert drift.cast_report(table).count() == 2


def test_consistent_table_types_every_field_and_follows_renamings(spark):
    rows = [
        ("s", 1, {"site": "a", "v": "1", "n": 7, "deep": {"tags": ["x", 2]}, "on": True, "void": None}), ("s", 1, {"site": "b", "v": "2", "n": 2.5}),
        ("s", 2, {"site": "a", "meta": {"v": "1"}, "n": "7", "deep": {"tags": "x"}}), ("s", 2, {"site": "b", "meta": {"v": "2"}, "n": 8}),
        ("s", 3, {"site": "a", "meta": {"v": 3}, "v": "another", "N": 4}), ("t", 1, {"site": "a", "v": None, "n": 1, "kind": "k"}), (None, 1, {"v": "lone"}), ("s", 4, "{broken"),
    ]
    df = drift.consistent(_lines(spark, rows))
    assert dict(df.dtypes) | {"v": "string", "n_2": "double", "n": "bigint", "deep_tags": "array<string>", "on": "boolean", "void": "string", "kind_2": "string", "v_2": "string"} == dict(df.dtypes)
    got = sorted(df.collect(), key=lambda r: r.row_no)
    assert [r.v for r in got] == ["1", "2", "1", "2", None, None, "lone"]
    assert [r.v_2 for r in got] == [None, None, None, None, "another", None, None]
    assert [r.n_2 for r in got] == [7, 2.5, None, 8, None, 1, None] and got[4].n == 4
    assert got[0].deep_tags == ["x", "2"] and got[0].on is True and got[0].nulls == ["void"] and got[5].kind_2 == "k" and got[5].nulls == ["v"]
    assert [[tuple(x)[:3] for x in r.bad_casts] for r in got] == [[], [], [("deep.tags", "x", "string"), ("n", "7", "string")], [], [("meta.v", "3", "number")], [], []]
    assert {tuple(r) for r in drift.cast_report(df).collect()} == {("s", 2, "deep.tags", 1), ("s", 2, "n", 1), ("s", 3, "meta.v", 1)}


def test_consistent_table_keeps_every_value(spark):
    rng = random.Random(3)
    rows, names = [], [f"f{k}" for k in range(5)]
    for f in range(1, 7):
        names = [n if rng.random() < 0.6 else f"{n[:2]}_{f}" for n in names]
        rows += [("s", f, {"site": f"s{x}", **{n: rng.choice([x, True, "w", [x], None]) if k == 4 else x // 2 + k // 2 for k, n in enumerate(names)}}) for x in range(4)]
    for r in drift.consistent(_lines(spark, rows)).collect():
        said = [v for k, v in rows[r.row_no][2].items() if k != "site"]
        held = r.asDict()
        bad, nulls = held.pop("bad_casts"), held.pop("nulls")
        cells = [v for k, v in held.items() if k not in ("row_no", "stream_id", "kind", "file_no", "line_no", "site") and v is not None]
        assert len(cells) + len(bad) + len(nulls) == len(said)


def test_empty(spark):
    assert drift.changes(_lines(spark, [])).count() == 0


def test_consistent_of_nothing(spark):
    assert drift.consistent(_lines(spark, [])).count() == 0
