import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docmill.operators.chunking import apidoc, pycode, sections, webcode
from docmill.operators.chunking.sections import front_matter, promoted
from docmill.sources import store

KIND = "source_id string, path string, content string, modified timestamp_ntz, is_entrypoint boolean"


def files(spark, **contents):
    return spark.createDataFrame([("src", p, c, None, p == "entry.md") for p, c in contents.items()], KIND)


def split(text, opening="Introduction"):
    """Sections by a plain loop."""
    out = [[opening, None, 1, []]]
    for line in text.split("\n"):
        m = re.match(r"(#{1,6})\s+(.+)$", line)
        if m:
            title = m[2].strip()
            out.append([title, re.sub(r"\s+", "-", re.sub(r"[^\w\s-]", "", title.lower())), len(m[1]), []])
        out[-1][3].append(line)
    return [(t, a, d, "\n".join(ls)) for t, a, d, ls in out if ls]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="#ab \n`|-é!", max_size=60), min_size=1, max_size=10))
def test_sections_against_brute_force(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", sections.sections(F.col("t"), "Introduction").alias("s")).collect()
    for r in rows:
        assert [(s["title"], s["anchor"], s["depth"], s["content"]) for s in r["s"]] == split(texts[r["i"]])
        assert "\n".join(s["content"] for s in r["s"]) == texts[r["i"]]


DOC = "intro\n# Start here\ntext\n```python\n# not code\n```\n```ts\n```\n## Table\n| a | b |\n## Table\n"


def test_markdown(spark):
    rows = sections.chunk_markdown(files(spark, **{"entry.md": DOC, "api/x.md": "", "README.md": "# R"})).collect()
    entry = [r for r in rows if r["path"] == "entry.md"]
    assert [r["title"] for r in entry] == ["Introduction", "Start here", "not code", "Table", "Table"]
    assert [r["code_blocks"] for r in entry][1:3] == [["python"], ["ts"]] and entry[3]["has_table"] and not entry[4]["has_table"]
    assert entry[3]["id"] == entry[4]["id"] != entry[1]["id"] and all(r["is_entrypoint"] for r in entry)
    assert {(r["path"], r["kind"]) for r in rows} == {("entry.md", "reference"), ("api/x.md", "api"), ("README.md", "readme")}


MDX = """---
component: IconButton
category: Forms
extends: Button
uses:
  - Spinner
variants: [Large]
related:
  - Button
---
import { Icon, helper as H } from './icon'
import Box from "box"
# IconButton
<IconButton><Fragment/></IconButton>
## Props
interface P {
  size?: string
  _private: x
}
## Primary Example
demo
## Accessibility
keyboard
"""


def test_component_documents(spark):
    rows = sections.chunk_component(files(spark, **{"a/icon-button.mdx": MDX, "plain-name.md": "# T\n", "bad.md": "---\na: [\n---\nx"}), "None").collect()
    icon = {r["title"]: r for r in rows if r["path"] == "a/icon-button.mdx"}
    first = icon["IconButton"]
    assert (first["component_name"], first["component_category"], first["extends"], first["variants"], first["related_to"]) == ("IconButton", "Forms", "Button", ["Large"], ["Button"])
    assert first["uses"] == ["Box", "Icon", "IconButton", "Spinner"]
    assert {t: r["chunk_type"] for t, r in icon.items()} == {"Overview": "overview", "IconButton": "overview", "Props": "props", "Primary Example": "example", "Accessibility": "accessibility"}
    assert icon["Props"]["props_mentioned"] == ["size"] and icon["Primary Example"]["example_variant"] == "Primary"
    assert {r["component_name"] for r in rows} == {"IconButton", "PlainName", "bad"} and {r["component_category"] for r in rows if r["path"] == "bad.md"} == {"None"}


def test_section_types_are_tried_in_order(spark):
    rows = spark.createDataFrame([("Rapid start", ""), ("Colors", "the theme"), ("Notes", "x" * 501 + "props"), ("Guide", "see the usage and props")], "t string, c string")
    assert [r[0] for r in rows.select(sections.section_type(F.col("t"), F.col("c"))).collect()] == ["props", "variant", "overview", "props"]


def test_front_matter_of_odd_documents(spark):
    rows = spark.createDataFrame([("---\n- list\n---\n",), (None,), ("---\ncomponent: 5\nuses: One\n---\n",)], "c string").select(front_matter("c").alias("f")).collect()
    assert [(r["f"]["component"], r["f"]["uses"]) for r in rows] == [(None, []), (None, []), ("5", ["One"])]


API = {
    "components": [{
        "name": "TdsButton", "file": "src/forms/button.component.ts", "selector": "tds-button", "description": "<p>A  button</p>", "extends": "Base", "imports": ["IconModule", "SpinnerComponent", "X", ""], "standalone": True,
        "inputsClass": [{"name": "size", "type": "string", "defaultValue": "", "description": "<b>Size</b>", "deprecated": True}, {"name": "on"}], "outputsClass": [{"name": "done"}],
        "methodsClass": [{"name": "ngOnInit"}, {"name": "go", "args": [{"name": "a", "type": "number"}, {}], "returnType": "boolean", "rawdescription": "Goes"}],
    }],
    "directives": [{"name": "Tip", "file": "lib/tip/tip.directive.ts", "selector": "[tip]"}],
    "injectables": [{"name": "Log", "methodsClass": [{"name": "say"}]}],
}


def test_api_documents(spark):
    rows = {r["title"]: r for r in apidoc.chunk_apidoc(files(spark, **{"docs/documentation.json": json.dumps(API), "other.json": "{}"})).collect()}
    assert list(sorted(rows)) == ["Log (Service)", "TdsButton", "TdsButton Inputs", "TdsButton Methods", "TdsButton Outputs", "Tip (Directive)"]
    assert rows["TdsButton"]["content"] == "# TdsButton\n\nA button\n\n**Selector:** `tds-button`\n\n**Category:** Forms\n\n**Standalone:** Yes\n\n**Extends:** Base"
    assert rows["TdsButton"]["uses"] == ["Icon", "Spinner", "X"] and rows["TdsButton"]["is_entrypoint"]
    assert rows["TdsButton Inputs"]["content"].split("\n")[4:] == ["| `size` | `string` | `-` | **DEPRECATED** Size |", "| `on` | `any` | `-` | - |"] and rows["TdsButton Inputs"]["props_mentioned"] == ["size", "on"]
    assert rows["TdsButton Outputs"]["content"].endswith("| `done` | `EventEmitter` | - |") and rows["TdsButton Outputs"]["has_table"]
    assert rows["TdsButton Methods"]["content"] == "# TdsButton Methods\n\n## `go(a: number, arg: any): boolean`\n\nGoes\n"
    assert rows["Tip (Directive)"]["component_category"] == "Tip" and rows["Tip (Directive)"]["content"] == "# Tip (Directive)\n\n**Selector:** `[tip]`\n"
    assert rows["Log (Service)"]["content"] == "# Log (Service)\n\n## Methods\n\n- `say(): void`\n"
    assert apidoc.chunk_apidoc(files(spark, **{"documentation.json": "not json"})).count() == 0


TS = """import { A } from '@x/a';
@Component({ selector: 'app-panel', templateUrl: './panel.component.html', styleUrls: ['./a.scss', "./b.scss"] })
export class PanelComponent { run() {} }
export abstract class Other {}
export async function load() {}
interface Shape {}
"""


def test_source_files(spark):
    given = files(spark, **{"p/panel.component.ts": TS, "p/panel.component.html": "<app-side-bar></app-side-bar><tds-x>", "p/panel.component.scss": "a{}", "p/panel.component.spec.ts": "", "q/log.service.ts": "", "z.txt": "no", "m.js": "class X {}"})
    rows = {r["path"]: r for r in webcode.chunk_source(given).collect()}
    ts = rows["p/panel.component.ts"]
    assert (ts["title"], ts["language"], ts["file_type"], ts["class_name"], ts["selector"], ts["template_url"], ts["style_urls"]) == ("Panel (component)", "typescript", "component", "PanelComponent", "app-panel", "./panel.component.html", ["./a.scss", "./b.scss"])
    assert ts["exports"] == ["PanelComponent", "Other", "load"] and ts["imports"] == ["@x/a"] and ts["decorators"] == ["Component"]
    assert ts["related_files"] == ["p/panel.component.html", "p/panel.component.scss", "p/panel.component.spec.ts"]
    assert rows["p/panel.component.html"]["component_refs"] == ["AppSideBar", "TdsX"] and rows["p/panel.component.html"]["kind"] == "template"
    assert rows["p/panel.component.spec.ts"]["file_type"] == "test" and rows["q/log.service.ts"]["component_name"] == "Log" and rows["m.js"]["exports"] == [] and "z.txt" not in rows
    symbols = {(r["path"], r["title"]): r for r in webcode.chunk_source(given, "symbol").collect()}
    assert symbols["p/panel.component.ts", "PanelComponent"]["content"].startswith("export class PanelComponent") and symbols["p/panel.component.ts", "Other"]["depth"] == 2
    assert ("q/log.service.ts", "Log (service)") in symbols


PY = '''"""Module doc.

More."""
import os
from a.b import c

class Box(Base, metaclass=M):
    """A box."""
    def __init__(self, a, b: int = 2, *args, key=None, **rest) -> None: ...
    def size(self) -> int:
        """Its size."""
    async def go(self, *, fast: bool): ...
    def _hidden(self): ...

class _Private:
    def x(self): ...

@wraps
def run(x=1): return x
'''


def test_python_modules(spark):
    given = files(spark, **{"pkg/box.py": PY, "pkg/test_box.py": "x = 1", "bad.py": "def (", "empty.py": "", "plain.py": "X = 1\n"})
    rows = {(r["path"], r["title"]): r for r in pycode.chunk_python(given).collect()}
    assert sorted(rows) == [("empty.py", "empty"), ("pkg/box.py", "Box.go()"), ("pkg/box.py", "Box.size()"), ("pkg/box.py", "box (module)"), ("pkg/box.py", "class Box"), ("pkg/box.py", "def run()"), ("plain.py", "plain")]
    size = rows["pkg/box.py", "Box.size()"]
    assert (size["content"], size["kind"], size["depth"], size["anchor"], size["class_name"]) == ("def size(self) -> int\n\nIts size.", "api", 2, "box-size", "Box")
    assert rows["pkg/box.py", "Box.go()"]["content"] == "async def go(self, *, fast: bool)" and rows["pkg/box.py", "def run()"]["decorators"] == ["wraps"]
    assert rows["pkg/box.py", "box (module)"]["imports"] == ["os", "a.b.c"] and rows["pkg/box.py", "class Box"]["content"] == "class Box(Base):\n\nA box."
    whole = {r["path"]: r for r in pycode.chunk_python(given, "file", include_tests=True).collect()}
    assert whole["pkg/box.py"]["title"] == "box - Module doc." and whole["pkg/box.py"]["exports"] == ["Box", "size", "go", "run"] and "pkg/test_box.py" in whole
    module = {r["title"]: r for r in pycode.chunk_python(given, "module").where("path = 'pkg/box.py'").collect()}
    assert sorted(module) == ["box (module overview)", "class Box", "def run()"]
    assert module["box (module overview)"]["content"] == 'Module doc.\n\nMore.\n\n## Classes\n\n- `Box`: A box.\n\n## Functions\n\n- `run()`: No description'


@pytest.mark.parametrize("private, dunder, want", [(False, False, ["C", "C.a"]), (True, False, ["C", "C.__init__", "C._p", "C.a", "_f"]), (True, True, ["C", "C.__init__", "C._p", "C.a", "__g__", "_f"])])
def test_python_visibility(private, dunder, want):
    text = "class C:\n    def __init__(self): ...\n    def a(self): ...\n    def _p(self): ...\ndef _f(): ...\ndef __g__(): ...\n"
    assert sorted(s["name"] for s in pycode.parse_module(text, private, dunder)["symbols"]) == sorted(want)


def test_python_signatures():
    s = pycode.parse_module("def f(a, b: int = 2, *args: str, k, m=3, **kw) -> int: ...\nasync def g(*, x): ...")["symbols"]
    assert [x["signature"] for x in s] == ["def f(a, b: int = 2, *args: str, k, m = 3, **kw) -> int", "async def g(*, x)"]
    assert [(p["name"], p["annotation"], p["default"], p["kind"]) for p in s[0]["parameters"]] == [("a", None, None, "positional_or_keyword"), ("b", "int", "2", "positional_or_keyword"), ("args", "str", None, "var_positional"), ("k", None, None, "keyword_only"), ("m", None, "3", "keyword_only"), ("kw", None, None, "var_keyword")]


def test_docstring_styles(spark):
    rows = spark.createDataFrame([("Sum.\n\nArgs:\n    x: n",), ("Sum.\n\nParameters\n----------\nx",), ("Sum.\n\n:returns: n",), ("Sum.",), (None,)], "d string")
    assert [r[0] for r in rows.select(pycode.docstring_style(F.col("d"))).collect()] == ["google", "numpy", "sphinx", "google", "google"]


def test_chunks_survive_json(spark):
    rows = sections.chunk_component(files(spark, **{"a.mdx": MDX})).unionByName(webcode.chunk_source(files(spark, **{"p.component.ts": TS})))
    again = store.chunks_from_json(store.chunks_to_json(rows))
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.collect()))
    odd = store.chunks_from_json(spark.createDataFrame([('{"id": "1", "chunk_type": "nope"}',)], "json string")).first()
    assert (odd["chunk_type"], odd["kind"], odd["uses"], odd["depth"]) == ("overview", "reference", [], 1)


def test_promotion(spark):
    r = promoted(sections.chunk_markdown(files(spark, **{"a.md": "x"})), "Button", "Forms").first()
    assert (r["chunk_class"], r["component_name"], r["component_category"], r["chunk_type"]) == ("component", "Button", "Forms", "overview")
