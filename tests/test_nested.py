"""Problem 2 against a plain walk over parsed JSON."""

import json
import random
from collections import Counter

import pyarrow as pa
import pytest

from proseframe.operators import nested


def walk(body):
    """(p_no, r_no, holder) of each run, by recursion."""
    try:
        d = json.loads(body)
        while isinstance(d, str):
            d = json.loads(d)
    except (TypeError, ValueError):
        return []
    out, n = [], [0]

    def element(tag, v, p, holder):
        if tag == "w:p":
            p, n[0] = [n[0], 0, holder], n[0] + 1
        elif tag == "w:r" and p is not None:
            out.append((p[0], p[1], p[2]))
            p[1] += 1
        elif tag == "w:tc":
            holder = "cell"
        elif tag == "w:txbxContent":
            holder = "box"
        elif tag == "w:footnote":
            holder = "note:" + (str(v.get("@w:id", "")).strip() if isinstance(v, dict) else "")
        inside(v, p, holder)

    def inside(v, p, holder):
        if isinstance(v, dict):
            for k, x in v.items():
                if k == "children":
                    inside(x, p, holder)
                elif not k.startswith("@"):
                    for y in x if isinstance(x, list) else [x]:
                        element(k, y, p, holder)
        elif isinstance(v, list):
            for y in v:
                inside(y, p, holder)

    inside(d, None, "body")
    return out


def flat(bodies):
    b = nested.flatten_batch(pa.array(range(len(bodies)), pa.int64()), pa.array(bodies, pa.string()))
    return b.to_pylist()


def runs(bodies):
    got = {}
    for r in flat(bodies):
        if r["kind"] == "r" and r["p_no"] is not None:
            got.setdefault(r["rec_id"], []).append((r["p_no"], r["r_no"], r["holder"]))
    return [sorted(got.get(i, [])) for i in range(len(bodies))]


def make(rng, depth=0):
    text = rng.choice(["plain", 'quo"te', "back\\slash\\", "brace } ] , :", "é☃😀", "", "\n\t", "w:p"])
    t = rng.choice([text, {"#text": text, "@xml:space": "preserve"}, [text, " "], None])
    run = {"w:rPr": rng.choice([None, {}, {"w:b": {"@w:val": "0"}}, {"w:b": True}]), "w:t": t}
    if depth < 4 and rng.random() < 0.3:
        run["w:pict"] = {"w:txbxContent": {"children": [make_p(rng, depth + 1) for _ in range(2)]}}
    return {"w:r": rng.choice([run, run, [run, run], None, {}])}


def make_p(rng, depth=0):
    kids = [make(rng, depth) for _ in range(rng.randint(0, 3))]
    if rng.random() < 0.3:
        kids.append({"w:hyperlink": {"@r:id": "r", "children": make(rng, depth)}})
    return {"w:p": rng.choice([{"children": kids}, {"children": kids[0] if kids else None}, {"w:pPr": {"w:pStyle": {"@w:val": "T"}}, "children": kids}, None, {}])}


def make_body(rng):
    out = []
    for _ in range(rng.randint(0, 4)):
        x = rng.random()
        if x < 0.5:
            out.append(make_p(rng))
        elif x < 0.75:
            out.append({"w:tbl": {"children": {"w:tr": {"w:tc": [{"children": [make_p(rng)]}, {"children": make_p(rng)}]}}}})
        else:
            out.append({"w:footnote": {"@w:id": rng.choice([1, "2", " 3 "]), "children": [make_p(rng), make_p(rng)]}})
    d = {"w:document": {"w:body": {"children": out}}}
    s = json.dumps(rng.choice([d, d, [d]]), indent=rng.choice([None, None, 1]), ensure_ascii=rng.random() < 0.5)
    return json.dumps(s) if rng.random() < 0.2 else s


def test_against_walk():
    rng = random.Random(5)
    bodies = [make_body(rng) for _ in range(400)]
    bodies += [b[: rng.randint(0, len(b))] for b in bodies[:200]]
    assert runs(bodies) == [sorted(walk(b)) for b in bodies]


BAD = ["}}}}", "]]]{{{", '}}{"w:p":{"w:r":{}}}', "", " ", "{", "}", '{"w:p": }', '{"w:p" {}}', '{"a": tru}', '{"a": 01}', '{"a": "\\x"}', '{"a": "\\u12g4"}', '{"a": "b\nc"}', '{"a": [1,]}', '{"a": 1,}', "{,}", '{"a": 1} {}', "[1}", '{"a" "b"}', '{"w:p": {"w:r": {}}', '"{"', '{"a": "x', "nul", "1 2", "{'a': 1}", '["a":1]', "[,1]", "{1: 2}", "\\", '{"a"}']
GOOD = ['{"w:p": {"w:r": {}}}', '[{"w:p": {"w:r": null}}]', ' {"x": -1.5e3, "w:p": [{"w:r": [{}, {}]}, null]} ', "null", "1", '"text"', '{"w:p":{"w:r":{"w:t":"\\u00e9 \\\\ \\" }"}}}', "[]", "{}", "[[]]"]


@pytest.mark.parametrize("body", BAD + GOOD)
def test_validity(body):
    if body in GOOD:
        json.loads(body)
    assert runs([GOOD[0], body, GOOD[0]]) == [sorted(walk(x)) for x in (GOOD[0], body, GOOD[0])]


def test_parents_and_texts():
    body = json.dumps({"w:body": {"children": [{"w:p": {"w:pPr": {"w:pStyle": {"@w:val": "Title"}}, "children": [{"w:r": {"w:rPr": {"w:b": {}}, "w:t": ["A é", {"#text": "b\\"}], "w:pict": {"w:txbxContent": {"w:p": {"w:r": {"w:t": "in"}}}}}}]}}]}})
    rows = {r["node_no"]: r for r in flat([body])}
    kinds = [rows[i]["kind"] for i in sorted(rows)]
    assert kinds == ["p", "r", "box", "p", "r"]
    assert rows[0]["style"] == "Title" and rows[1]["text"] == "A éb\\" and rows[1]["bold"] is True and rows[4]["text"] == "in" and rows[3]["holder"] == "box"
    assert [rows[i]["parent_no"] for i in range(5)] == [None, 0, 1, 2, 3]


def test_deep_and_long():
    deep = '{"w:p":{"w:r":{"x":' * 300 + "1" + "}}}" * 300
    assert len(runs([deep])[0]) == 300
    long = json.dumps({"w:p": {"w:r": [{"w:t": "x" * 50}] * 20000}})
    assert len(runs([long])[0]) == 20000


def test_table(spark):
    rows = [(1, GOOD[0], "a"), (1, GOOD[0], "b"), (2, None, "c"), (None, GOOD[0], "d"), (3, "{", "e")]
    d = spark.createDataFrame(rows, "rec_id long, body_json string, p_no string")
    assert Counter(map(tuple, nested.runs_of_records(d).collect())) == Counter([(1, 0, 0, "body")])
    t = nested.flat_tables(nested.nested_nodes(d))
    assert t["paragraphs"].count() == 1 and t["footnotes"].count() == 0
    assert nested.runs_of_records(d.limit(0)).count() == 0


@pytest.mark.parametrize("lists", [1, 64, 65, 500])
def test_lists_in_lists(lists):
    body = json.dumps({"w:p": {"w:r": 0}}).replace("0", "[" * lists + '{"w:t": "x"}, {}' + "]" * lists)
    rows = [r for r in flat([body]) if r["kind"] == "r"]
    assert [(r["p_no"], r["r_no"], r["text"]) for r in rows] == [(0, 0, "x"), (0, 1, None)]


def test_tags_styles_and_bold():
    body = json.dumps({"children": [
        {"w:endnote": {"@w:id": 7, "w:p": {"w:r": [{"w:rPr": {"w:b": False}}, {"w:rPr": {"w:b": {"@w:val": "off"}}}, {"w:rPr": {"w:b": {"@w:val": 1}}}]}}},
        {"w:footnote": {"w:p": {"w:pPr": {"w:pStyle": {"@w:val": "First"}}, "w:r": {"w:t": ["a", {"#text": "\\u00e9"}, None, "b"]}}}},
        {"w:p": {"w:pPr": [{"w:pStyle": {"@w:val": "One"}}, {"w:pStyle": {"@w:val": "Two"}}]}},
    ]}).replace("\\\\u", "\\u")
    rows = flat([body])
    assert [(r["tag"], r["attr_id"]) for r in rows if r["kind"] == "note"] == [("w:endnote", "7"), ("w:footnote", None)]
    assert [r["bold"] for r in rows if r["kind"] == "r"] == [False, False, True, None]
    assert [r["text"] for r in rows if r["kind"] == "r"] == [None, None, None, "aéb"]
    assert [(r["holder"], r["style"]) for r in rows if r["kind"] == "p"] == [("note:7", None), ("note:", "First"), ("body", "Two")]


def test_slices_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(nested, "SLICE_BYTES", 50)
    d = spark.createDataFrame([(i, GOOD[0] if i % 3 else None) for i in range(40)], "rec_id long, body_json string")
    assert nested.runs_of_records(d).count() == 26
