import json

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.operators import shredding
from tallyforge.operators.shredding import record_elements, record_table, record_values, shred_record
from tests.oracle import DATA

ONE, PACKED = frozenset(["labels", "runs"]), frozenset(["runs", "validation"])


def brute(value, single=ONE, packed=PACKED):
    """Every object in an array, found by plain recursion."""
    out = []

    def walk(v, path, at):
        if isinstance(v, dict):
            for name, x in v.items():
                if name in packed and isinstance(x, str):
                    try:
                        inner = json.loads(x, parse_constant=lambda c: 1 / 0)
                        x = inner if isinstance(inner, dict | list) else x
                    except (ValueError, ZeroDivisionError):
                        pass
                if name in single and isinstance(x, dict):
                    x = [x]
                walk(x, [*path, name], at)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                if isinstance(x, dict):
                    out.append((".".join(path), "/".join(map(str, [*at, i]))))
                walk(x, path, [*at, i])

    walk(value, [], [])
    return sorted(out)


def columns_of(text):
    return [dict(zip(shredding._FIELDS, c, strict=True)) for c in shred_record(text, ONE, PACKED)]


names = st.sampled_from(["labels", "runs", "validation", "a", "b"])
scalars = st.none() | st.booleans() | st.integers(-5, 5) | st.sampled_from(["x", '[{"a": 1}]', "{", '{"b": [{}]}'])
values = st.recursive(scalars, lambda v: st.lists(v, max_size=4) | st.dictionaries(names, v, max_size=4), max_leaves=25)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(names, values, max_size=4))
def test_levels_give_back_every_element(record):
    found = record_elements(columns_of(json.dumps(record)))
    assert sorted(x[:2] for x in found) == brute(record)
    # the parent is the element around it
    known = {x[:2] for x in found} | {("", "")}
    assert all(x[2:] in known or not x[3] or "/" in x[1] for x in found)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(names, values, max_size=4))
def test_levels_give_back_every_value(record):
    want = []

    def walk(v, path, at, owner, field):
        if isinstance(v, dict):
            for name, x in v.items():
                walk(shredding._unpack(x, name, ONE, PACKED), [*path, name], at, owner, [*field, name])
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, path, [*at, i], (len(path), len(at) + 1) if isinstance(x, dict) else owner, [] if isinstance(x, dict) else field)
        elif v is not None and owner and field:
            n, m = owner
            want.append((".".join(path[:n]), "/".join(map(str, at[:m])), ".".join(field), "/".join(map(str, at[m:])), v if isinstance(v, str) else json.dumps(v)))

    walk(record, [], [], None, [])
    got = record_values(columns_of(json.dumps(record)))
    assert sorted((p, i, f, q, v) for p, i, _, _, f, q, v in got) == sorted(want)


def test_objects_without_a_value_are_leaves():
    assert [(c["path"], c["defs"]) for c in columns_of('{"a": [{}, 1, {"b": null}]}')] == [("a[]", [2, 2, 2]), ("a[]{}", [3, 2, 3])]
    assert [c["path"] for c in columns_of('{"a": [{}, {"b": 1}]}')] == ["a[].b"]
    assert record_table(columns_of('{"a": [{}, {"b": [1, 2]}]}'), "a[]", ["b"]) == [("0", "", [None]), ("1", "", ['["1", "2"]'])]


def test_broken_texts():
    for text in (None, "", "null", "[1]", "3", '{"a": NaN}', '{"a": 1} x', '{"a": [', "<html>"):
        assert shred_record(text, ONE, PACKED) == []


def test_half_surrogate():
    assert shred_record('{"a": "\\ud83d"}', ONE, PACKED)[0][4] == ["�"]


def test_values_line_up(spark):
    rows = [
        (1, '{"files": [{"path": "a", "findings": [{"id": 1}, {"line": 2}, 5, null]}, {"findings": []}, {"path": null, "findings": [{"id": 3, "line": 4}]}]}'),
        (2, "{}"), (3, None),
    ]
    columns = shredding.shred(spark.createDataFrame(rows, "k bigint, j string"), ["k"], "j")
    got = {tuple(r) for r in shredding.child_table(columns, ["k"], "files[].findings[]", ["id", "line"]).collect()}
    assert got == {(1, "0/0", "0", "1", None), (1, "0/1", "0", None, "2"), (1, "2/0", "2", "3", "4")}
    links = {(r.path, r.idx, r.parent_path, r.parent_idx) for r in shredding.elements(columns, ["k"]).collect()}
    assert ("files.findings", "2/0", "files", "2") in links and ("files", "1", "", "") in links and len(links) == 6


def test_empty_table(spark):
    empty = spark.createDataFrame([], "k bigint, j string")
    assert shredding.elements(shredding.shred(empty, ["k"], "j"), ["k"]).count() == 0


def test_children_keep_all_values(spark):
    """Every element of both tables with every value below it, against plain recursion."""
    from tallyforge.plans import problems

    one, packed = frozenset(problems.ARRAYS), frozenset(problems.PACKED)
    want = set()

    def walk(v, src, k, path, at, owner, field):
        # owner: number of names and of positions of the element around v, or None
        if isinstance(v, dict):
            for name, x in v.items():
                x = shredding._unpack(x, name, one, packed)
                walk(x, src, k, [*path, name], at, owner, [*field, name])
        elif isinstance(v, list):
            for i, x in enumerate(v):
                if isinstance(x, dict):
                    want.add((src, k, ".".join(path), "/".join(map(str, [*at, i])), None, None, None))
                    walk(x, src, k, path, [*at, i], (len(path), len(at) + 1), [])
                else:
                    walk(x, src, k, path, [*at, i], owner, field)
        elif v is not None and owner:
            n, m = owner
            text = v if isinstance(v, str) else json.dumps(v)
            want.add((src, k, ".".join(path[:n]), "/".join(map(str, at[:m])), ".".join(field), "/".join(map(str, at[m:])), text))

    for r in problems._records(spark, DATA).collect():
        try:
            record = json.loads(r.raw_json, parse_constant=lambda c: 1 / 0)
        except (ValueError, ZeroDivisionError):
            continue
        if isinstance(record, dict):
            walk(record, r.src, r.row_id, [], [], None, [])
    got = problems.p4_children(spark, DATA)
    assert {tuple(x) for x in got.select("src", "row_id", "path", "idx", "field", "pos", "value").collect()} == want
    paths = {(r.src, r.path, r.field) for r in got.select("src", "path", "field").distinct().collect()}
    assert {("comments", "edits.changes", "size.after"), ("comments", "reactions.nodes", "user.login"), ("issues", "validation.runs.result.files.findings", "notes")} <= paths
    links = got.where("field is null").select("src", "row_id", "path", "idx", "parent_path", "parent_idx")
    assert links.exceptAll(problems.p4_links(spark, DATA)).count() == 0


def test_flat_tables_hold_what_the_records_hold(spark):
    """Every flat table against a direct walk over the records of the tables."""
    from tallyforge.plans import problems

    one, packed = frozenset(problems.ARRAYS), frozenset(problems.PACKED)
    want = {k: set() for k in problems.KINDS}

    def value(v, field):
        for name in field.split("."):
            v = v.get(name) if isinstance(v, dict) else None
        if isinstance(v, list):
            return json.dumps([x if isinstance(x, str) else json.dumps(x) for x in v if x is not None], ensure_ascii=False) if v else None
        return None if v is None or isinstance(v, dict) else v if isinstance(v, str) else json.dumps(v)

    def walk(v, src, k, path, at):
        if isinstance(v, dict):
            for name, x in v.items():
                walk(shredding._unpack(x, name, one, packed), src, k, f"{path}.{name}" if path else name, at)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                here = [*at, str(i)]
                if isinstance(x, dict):
                    for kind, (s, p, fields) in problems.KINDS.items():
                        if s == src and p == path + "[]":
                            want[kind].add((src, k, "/".join(here), "/".join(at), *[value(x, f) for f in fields]))
                walk(x, src, k, path + "[]", here)

    for r in problems._records(spark, DATA).collect():
        try:
            record = json.loads(r.raw_json, parse_constant=lambda c: 1 / 0)
        except (ValueError, ZeroDivisionError):
            continue
        if isinstance(record, dict):
            walk(record, r.src, r.row_id, "", [])
    for kind in problems.KINDS:
        got = {tuple(r) for r in problems.R.queries[f"p4_{kind}"](spark, DATA).collect()}
        assert got == want[kind] and got, kind
