"""Where declarations end, and the index in segments."""

import os
from collections import Counter
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from project import FILES
from tessera.engine import Engine
from tessera.functions.code import declarations, tokens
from tessera.operators import chunks
from tessera.queries import QUERIES
from tessera.sources import config

CODE = r'''import React, { useState } from 'react';
import './side.css'
import {
  a,
  b as c
} from "../x";

// function commented() { }
/* const no = () => {} */
export const Login = ({ a, b }) => {
  const re = /[}/{]'"/g, s = 'it\'s } {', t = `x ${ fn({ a: `}` }) } }`;
  return <form onSubmit={(e) => { e.preventDefault(); }}>Don't {email ? <b>{"}"}</b> : null} <input value={email} /></form>;
};

export default async function load(id) {
  function inner() { return { a: 1 } }
  if (a < b && c > d) { return a / b / c; }
  return inner();
}
let count = 0
const plain = 5, other = [1, 2,
  3]
class Store extends Base {
  state = { a: 1 };
  method(x) {
    const y = x * 2;
    return y;
  }
  onClick = async (e) => { this.x(e) }
}
useEffect(() => {
  fetch('/api')
}, []);
for (const x of list) { run(x) }
for (let i = 0; i < 3; i++) { run(i) }
var old = function named(a) { return a };
type Fn = (a: string) => void;
interface Foo { bar: () => void }
export const gen = <T,>(x: T): T => x
const typed = (x: number): { a: number } => ({ a: x });
function sig(a: string): void;
function typedBody(a: string): { b: string } { return { b: a } }
const last = x => x.map(y => y + 1)
  .filter(Boolean)
export const useAuth = () => useContext(Ctx)
'''


def test_outermost_declarations():
    got = [CODE[a:z] for _, a, z in declarations(CODE)]
    begin = ["import React", "import './side.css'", "import {\n", "const Login", "async function load", "let count = 0", "const plain", "const y = x * 2;", "async (e) =>", "() => {\n  fetch", "let i = 0;", "function named", "const gen", "const typed", "function typedBody", "const last", "const useAuth"]
    assert len(got) == len(begin) and all(g.startswith(b) for g, b in zip(got, begin, strict=True))
    end = ["'react';", "css'", '"../x";', "</form>;\n};", "return inner();\n}", "= 0", "3]", "* 2;", "this.x(e) }", "'/api')\n}", "0;", "return a }", "=> x", "({ a: x });", "{ return { b: a } }", ".filter(Boolean)", "useContext(Ctx)"]
    assert all(g.endswith(e) for g, e in zip(got, end, strict=True))
    assert [i for i, _, _ in declarations(CODE)] == [True] * 3 + [False] * 14


@settings(max_examples=150, deadline=None)
@given(st.integers(0, len(CODE)), st.integers(0, 60), st.text("{}()[]`'\"</>$=;\n \\abc", max_size=20))
def test_broken_code_never_fails(at, gone, more):
    text = CODE[:at] + more + CODE[at + gone :]
    found = declarations(text)
    assert all(0 <= a < z <= len(text) for _, a, z in found) and all(x[2] <= y[1] for x, y in zip(found, found[1:], strict=False))
    at = 0
    for _, a, z, _ in tokens(text):
        assert at <= a < z <= len(text)
        at = z


def test_declared_chunks(spark):
    rows = [("f", CODE), ("empty", ""), ("null", None), ("prose", "!! not code"), ("open", "export function half(a) {\n  return `${a"), ("wide", "const é = '😀';\nconst After = () => <b/>;")]
    got = chunks.declared(spark.createDataFrame(rows, "id string, text string")).collect()
    assert Counter(r.file_id for r in got) == {"f": 17, "open": 1, "wide": 2}
    by = {(r.file_id, r["name"]): r for r in got}
    assert (by["f", "Login"].chunk_type, by["f", "useAuth"].chunk_type, by["f", "load"].chunk_type) == ("COMPONENT", "HOOK", "FUNCTION")
    assert (by["f", "Login"].start_line, by["f", "Login"].end_line) == (10, 13) and by["wide", "After"].text == "const After = () => <b/>;" and by["wide", "After"].start_line == 2
    assert [r.symbols for r in got if r.chunk_type == "IMPORT_BLOCK"][0] == ["useState", "react"]
    assert by["open", "half"].end_line == 2


def test_scanned_chunks_join_nothing(spark, tmp_path):
    """Paths go along with chunks: a join with the files again was sent through the driver, as the table of parts looks small."""
    spark.range(60).withColumnRenamed("id", "p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    found = QUERIES["scanned_chunks"](spark, str(tmp_path))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.path for r in found.collect()} == {f"src/h{k}.tsx" for k in range(60)}


def test_very_long_code_in_one_pass():
    text = "const x = [" + "{ a: (1), b: '}' },\n" * 100_000 + "];\n" + "f(a)(b);\n" * 50_000
    assert [text[a:z][:9] for _, a, z in declarations(text)] == ["const x ="]


@pytest.fixture
def project(tmp_path):
    for name, text in FILES.items():
        (tmp_path / "p" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "p" / name).write_text(text)
    return tmp_path / "p"


def test_index_by_the_scanner(spark, tmp_path, project):
    e = Engine(spark, str(tmp_path / "t"), config.load(env={"TESSERA_INDEXER_PARSER": "scanner"}))
    e.index(str(project))
    rows = {r["name"]: r for r in e.registry.store(str(project)).read("chunks").collect() if r["name"]}
    assert rows["usePantry"].text.endswith("return { stock, refill };\n}") and "refill" not in rows
    assert "usePantry" in [h["name"] for h in e.ask(str(project), "where is usePantry defined?", 3)]


def test_a_changed_file_writes_its_own_rows(spark, tmp_path, project):
    for i in range(30):
        (project / f"src/many{i}.ts").write_text(f"export function manyThings{i}(a) {{\n  return {{ a, {', '.join(f'b{i}x{j}' for j in range(40))} }};\n}}\n")
    e = Engine(spark, str(tmp_path / "t"))
    e.index(str(project))
    store = e.registry.store(str(project))
    files = lambda: {str(p): p.stat().st_size for n in ("chunks", "postings", "embeddings", "symbols") for p in Path(store.folder, n).rglob("*.parquet")}
    first = files()
    (project / "src/many3.ts").write_text("export function manyThings3(only) {\n  return { only, theChangedOne: only, another: only, more: only };\n}\n")
    os.remove(project / "src/many4.ts")
    assert e.index(str(project))["files_indexed"] == 1
    later = files()
    assert all(later[p] == n for p, n in first.items()) and sum(n for p, n in later.items() if p not in first) < sum(first.values()) / 2
    names = {r["name"] for r in store.read("chunks").collect()}
    assert "manyThings3" in names and "manyThings4" not in names and len(store.read("chunks").where("name = 'manyThings3'").collect()) == 1
    assert {r.term for r in store.read("postings").where("term IN ('b3x1', 'b4x1', 'b5x1')").collect()} == {"b5x1"}
    # a table of the same rows in one segment
    before = {n: sorted(map(str, store.read(n).collect())) for n in ("chunks", "postings", "embeddings", "symbols", "api_calls")}
    assert store.merge(2) in (0, 2)
    (project / "src/many5.ts").write_text("export function manyThings5(x) {\n  return { x, once: x, twice: x, again: x, more: x };\n}\n")
    e.index(str(project))
    store.merge(2)
    store.sweep()
    assert {p.name for p in Path(store.folder, "chunks").iterdir() if p.name.startswith("segment=")} == {f"segment={r.segment}" for r in store.read("files").select("segment").distinct().collect()}
    fresh = Engine(spark, str(tmp_path / "u"))
    fresh.index(str(project))
    again = fresh.registry.store(str(project))
    for n in before:
        kept = [c for c in store.read(n).columns if c != "created_at"]
        assert sorted(map(str, store.read(n).select(kept).collect())) == sorted(map(str, again.read(n).select(kept).collect()))
