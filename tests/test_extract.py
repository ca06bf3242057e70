"""What each language's reader finds in source with strings, comments, generics and nesting in its way."""

import pytest

from graphloom.sources.extract import parse_file
from graphloom.sources.languages import literal
from graphloom.sources.lexer import Syntax, Tokens


def found(lang, text):
    nodes, pending, _ = parse_file("t", "a", lang, text.encode())
    defs = {n["id"].split("::")[-1]: (n["kind"], n["signature"], n["start_line"], n["end_line"], n["docstring"]) for n in nodes if n["kind"] != "module"}
    return defs, sorted((p["type"].split("_")[0], p["src_scope"], p["target"]) for p in pending)


JAVA = r'''package a.b;
import java.util.List;
import static java.lang.Math.*;
/** Doc. */
@Service("x{y")
public final class Outer<T extends Comparable<T>> extends Base<T> implements Runnable, Api<String> {
    private static final Map<String, List<Integer>> M = new HashMap<>();
    // comment doc
    @Override
    public <R> List<R> run(int a, Map<String, R> b) throws IOException, Bad {
        if (a > 1) { helper(b); this.other.call(x -> x.go(1)); }
        return new ArrayList<R>();
    }
    Outer(int x) { super(x); init(); }
    abstract int size();
    enum Kind { A(1), B; int v() { return 2; } }
    interface In extends Other, More<T> { void act(); default int z() { return act2(); } }
    static class Nest { int[] arr(String... s) { return null; } }
    record Point(int x, int y) {}
}
'''


def test_java():
    defs, refs = found("java", JAVA)
    assert defs == {
        'Outer': ('class', 'Outer', 5, 20, '** Doc. */'),
        'Outer.run': ('method', 'run(int a, Map<String, R> b)', 9, 13, 'comment doc'),
        'Outer.Outer': ('method', 'Outer(int x)', 14, 14, None),
        'Outer.size': ('method', 'size()', 15, 15, None),
        'Outer.Kind': ('class', 'Kind', 16, 16, None),
        'Outer.Kind.v': ('method', 'v()', 16, 16, None),
        'Outer.In': ('class', 'In', 17, 17, None),
        'Outer.In.act': ('method', 'act()', 17, 17, None),
        'Outer.In.z': ('method', 'z()', 17, 17, None),
        'Outer.Nest': ('class', 'Nest', 18, 18, None),
        'Outer.Nest.arr': ('method', 'arr(String... s)', 18, 18, None),
    }
    assert refs == [
        ('CALLS', 'Outer.In.z', 'act2'),
        ('CALLS', 'Outer.Outer', 'init'),
        ('CALLS', 'Outer.run', 'call'),
        ('CALLS', 'Outer.run', 'go'),
        ('CALLS', 'Outer.run', 'helper'),
        ('IMPORTS', '', 'java.lang.Math'),
        ('IMPORTS', '', 'java.util.List'),
        ('INHERITS', 'Outer', 'Runnable'),
        ('INHERITS', 'Outer.In', 'Other'),
    ]


SCALA = r'''package a
import a.b.{C, D => E}
import x._
// doc line
class Runner[T](x: Int, y: String = "a(") extends Base[T](x) with Mix {
  def start(n: Int)(implicit e: E): Unit = { helper(n); obj.call(2).more(3) }
  def plain = 3
  def typed[A](a: A): A = a
  val f = (z: Int) => z + 1
}
object Main extends App { spark.read.parquet("in/p"); df.write.mode("o").saveAsTable("t.x"); spark.table("q") ; df.write.parquet("out") }
trait Tr extends Super { def abs(x: Int): Int }
case class Cc(a: Int)
'''


def test_scala():
    defs, refs = found("scala", SCALA)
    assert defs == {
        'Runner': ('class', 'Runner', 5, 10, 'doc line'),
        'Runner.start': ('method', 'start(n: Int)', 6, 6, None),
        'Runner.plain': ('method', 'plain', 7, 7, None),
        'Runner.typed': ('method', 'typed(a: A)', 8, 8, None),
        'Main': ('class', 'Main', 11, 11, None),
        'Tr': ('class', 'Tr', 12, 12, None),
        'Cc': ('class', 'Cc', 13, 13, None),
    }
    assert refs == [
        ('CALLS', 'Main', 'df.write.mode'),
        ('CALLS', 'Main', 'df.write.mode("o").saveAsTable'),
        ('CALLS', 'Main', 'df.write.parquet'),
        ('CALLS', 'Main', 'spark.read.parquet'),
        ('CALLS', 'Main', 'spark.table'),
        ('CALLS', 'Runner.start', 'helper'),
        ('CALLS', 'Runner.start', 'obj.call'),
        ('CALLS', 'Runner.start', 'obj.call(2).more'),
        ('CONSUMES', 'Main', 'in/p'),
        ('CONSUMES', 'Main', 'q'),
        ('IMPORTS', '', 'a.b.{C, D => E}'),
        ('IMPORTS', '', 'x._'),
        ('INHERITS', 'Main', 'App'),
        ('INHERITS', 'Runner', 'Base'),
        ('INHERITS', 'Tr', 'Super'),
        ('PRODUCES', 'Main', 'o'),
        ('PRODUCES', 'Main', 'out'),
        ('PRODUCES', 'Main', 't.x'),
    ]


GO = r'''package main
import (
  f "fmt"
  "github.com/x/y"
)
// Doc of Runner.
type Runner struct { x int }
type Doer interface { Do(a int) error }
type (
  A struct { b int }
  B interface { M() }
)
type Alias = int
func Map[T any, U any](xs []T, f func(T) U) []U { return append(nil, f(xs[0])) }
func (r *Runner) Start(ctx context.Context) (int, error) {
	go func() { r.run() }()
	defer y.Close()
	s := `raw { string`
	c := '{'
	return pkg.Load(s).Next(), nil
}
func main() { var x = Runner{1}; x.Start(nil) }
'''


def test_go():
    defs, refs = found("go", GO)
    assert defs == {
        'Runner': ('class', 'Runner', 7, 7, 'Doc of Runner.'),
        'Doer': ('class', 'Doer', 8, 8, None),
        'A': ('class', 'A', 9, 12, None),
        'Map': ('function', 'Map(xs []T, f func(T) U)', 14, 14, None),
        'Start': ('method', 'Start(ctx context.Context)', 15, 21, None),
        'main': ('function', 'main()', 22, 22, None),
    }
    assert refs == [
        ('CALLS', 'Map', 'append'),
        ('CALLS', 'Map', 'f'),
        ('CALLS', 'Start', 'pkg.Load'),
        ('CALLS', 'Start', 'pkg.Load(s).Next'),
        ('CALLS', 'Start', 'r.run'),
        ('CALLS', 'Start', 'y.Close'),
        ('CALLS', 'main', 'x.Start'),
        ('IMPORTS', '', 'fmt'),
        ('IMPORTS', '', 'github.com/x/y'),
    ]


BASH = r'''#!/bin/bash
# does setup
setup() {
  echo "hi $(date +%s)" | grep hi && run_it --x
}
function other { setup; if [ -f x ]; then ./script.sh a; fi; }
function third() { cd /tmp || exit 1; }
VAR=1 cmd arg
x=$(inner_cmd)
for i in 1 2; do step "$i"; done
cat <<EOF2
not_a_command here
EOF2
setup
'''


def test_bash():
    defs, refs = found("bash", BASH)
    assert defs == {
        'setup': ('function', 'setup', 3, 5, 'does setup'),
        'other': ('function', 'other', 6, 6, None),
        'third': ('function', 'third', 7, 7, None),
    }
    assert refs == [
        ('CALLS', '', 'cat'),
        ('CALLS', '', 'cmd'),
        ('CALLS', '', 'inner_cmd'),
        ('CALLS', '', 'setup'),
        ('CALLS', '', 'step'),
        ('CALLS', 'other', './script.sh'),
        ('CALLS', 'other', 'setup'),
        ('CALLS', 'setup', 'date'),
        ('CALLS', 'setup', 'echo'),
        ('CALLS', 'setup', 'grep'),
        ('CALLS', 'setup', 'run_it'),
        ('CALLS', 'third', 'cd'),
        ('CALLS', 'third', 'exit'),
    ]


TYPESCRIPT = r'''import { helper, type X } from './util';
import def from "pkg";
const fs = require('fs');
// doc of main
export async function main<T>(x: T, y: Map<string, number>): Promise<void> { await helper(x); obj.a.b(1); new Foo(2); }
export default class Runner extends Base<Opt> implements I, J {
  private x = () => { inner(); };
  constructor(private a: number) { super(a); this.init(); }
  get value(): number { return calc(); }
  static async load(id: string): Promise<Runner> { return fetchIt(`/x/${enc(id)}`); }
  #priv() {}
}
interface Shape extends Other { area(): number; }
export const add = (a: number, b: number): number => a + b;
export const f2 = async function (z) { return z.map(q => q.x()); };
const one = x => x + 1;
abstract class Abs { abstract go(): void; }
function over(a: string): void;
function over(a: any) { return a; }
const re = /[{]/g;
'''


def test_typescript():
    defs, refs = found("typescript", TYPESCRIPT)
    assert defs == {
        'main': ('function', 'main(x: T, y: Map<string, number>)', 5, 5, None),
        'Runner': ('class', 'Runner', 6, 12, None),
        'Runner.constructor': ('method', 'constructor(private a: number)', 8, 8, None),
        'Runner.value': ('method', 'value()', 9, 9, None),
        'Runner.load': ('method', 'load(id: string)', 10, 10, None),
        'Shape': ('class', 'Shape', 13, 13, None),
        'add': ('function', 'add(a: number, b: number)', 14, 14, None),
        'f2': ('function', 'f2(z)', 15, 15, None),
        'over': ('function', 'over(a: any)', 19, 19, None),
    }
    assert refs == [
        ('CALLS', '', 'require'),
        ('CALLS', 'Runner', 'inner'),
        ('CALLS', 'Runner.constructor', 'this.init'),
        ('CALLS', 'Runner.load', 'enc'),
        ('CALLS', 'Runner.load', 'fetchIt'),
        ('CALLS', 'Runner.value', 'calc'),
        ('CALLS', 'f2', 'q.x'),
        ('CALLS', 'f2', 'z.map'),
        ('CALLS', 'main', 'helper'),
        ('CALLS', 'main', 'obj.a.b'),
        ('IMPORTS', '', './util'),
        ('IMPORTS', '', 'fs'),
        ('IMPORTS', '', 'pkg'),
        ('INHERITS', 'Runner', 'Base'),
    ]


JAVASCRIPT = r'''/* block doc */
class A extends B.C { m(x) { return this.n(x); } static s() {} 'quoted'() {} async *gen() {} }
const g = function named(a) { if (a) { h(); } };
let k = async (a, {b, c} = {}) => { return k2(a); };
export const z = { meth(x) { return q(x); }, arrow: () => w() };
'''


def test_javascript():
    defs, refs = found("javascript", JAVASCRIPT)
    assert defs == {
        'A': ('class', 'A', 2, 2, '* block doc */'),
        'A.m': ('method', 'm(x)', 2, 2, None),
        'A.s': ('method', 's()', 2, 2, None),
        'A.gen': ('method', 'gen()', 2, 2, None),
        'g': ('function', 'g(a)', 3, 3, None),
        'k': ('function', 'k(a, {b, c} = {})', 4, 4, None),
        'meth': ('method', 'meth(x)', 5, 5, None),
    }
    assert refs == [
        ('CALLS', '', 'w'),
        ('CALLS', 'A.m', 'this.n'),
        ('CALLS', 'g', 'h'),
        ('CALLS', 'k', 'k2'),
        ('CALLS', 'meth', 'q'),
    ]


PYTHON = r'''import os
def good(a):
    "Doc."
    return os.path.join(a)
class K(Base):
    def m(self):
        return self.n(
def after(x):
    return good(x)
'''


def test_python():
    defs, refs = found("python", PYTHON)
    assert defs == {
        'good': ('function', 'good(a)', 2, 4, 'Doc.'),
        'K': ('class', 'K', 5, 7, None),
        'K.m': ('method', 'm(self)', 6, 7, None),
        'after': ('function', 'after(x)', 8, 9, None),
    }
    assert refs == [
        ('CALLS', 'after', 'good'),
        ('CALLS', 'good', 'os.path.join'),
        ('IMPORTS', '', 'os'),
        ('INHERITS', 'K', 'Base'),
    ]


BASH_MORE = r'''case "$1" in
  start) run_start ;;
  stop|halt) run_stop "$(who am)" ;;
esac
if ! check_it; then echo no; fi
arr=(one $(two) three)
echo $((a + b)) > out.txt 2>&1
while read -r line; do use "$line"; done < <(list_all)
cat <<-'END' | filter_it
	ignored_here
	END
last_one && (in_group; `ticked`)
'''


def test_bash_more():
    called = {t for _, _, t in found("bash", BASH_MORE)[1]}
    assert called == {"run_start", "run_stop", "who", "check_it", "echo", "two", "read", "use", "list_all", "cat", "filter_it", "last_one", "in_group", "ticked"}


def test_broken_python():
    """What is whole is read, wherever a file is broken."""
    text = "def one(a, b=(1, 2)):\n    return f(a)\n\n\nx = = 3\n\n\n# of two\ndef two(\n    c,  # why\n    d='(',\n):\n    return one(c\n\n\n@wrap\nclass K:\n    y = [1, 2\n    def m(self):\n        return two(1)\n"
    defs, refs = found("python", text)
    assert {k: v[1] for k, v in defs.items()} == {"one": "one(a, b=(1, 2))", "two": "two(\n    c,  # why\n    d='(',\n)", "K": "K", "K.m": "m(self)"} and defs["two"][4] == "of two"
    assert {("CALLS", "one", "f"), ("CALLS", "K.m", "two")} <= set(refs)
    assert found("python", "def (:\n  ((((\n")[0] == {} and found("python", "\0")[0] == {}


def test_python_literals_and_imports():
    text = 'from a.b import c, d as e\nfrom . import f\nimport g.h\n\n\ndef k():\n    read_parquet(f"s3://x/{day}.parquet")\n    df.write.mode("x").parquet("""out""")\n    spark.read.csv(r"in")\n'
    _, refs = found("python", text)
    assert [r for r in refs if r[0] != "CALLS"] == sorted([("IMPORTS", "", "a.b"), ("IMPORTS", "", "a.b"), ("IMPORTS", "", "a.b"), ("IMPORTS", "", "."), ("IMPORTS", "", "g.h"), ("CONSUMES", "k", "s3://x/{day}.parquet"), ("CONSUMES", "k", "in"), ("PRODUCES", "k", "x")])
    names = [p["names"] for p in parse_file("t", "a", "python", text.encode())[1] if p["target"] == "a.b"]
    assert names == [[], ["c"], ["d"]]


@pytest.mark.parametrize("text,value", [('"a"', "a"), ("'''a'''", "a"), ('f"a{b}"', "a{b}"), ("rb'x'", "x"), ("plain", "plain"), ('""', ""), ('"""a"b"""', 'a"b'), ("abcd'x'", "abcd'x'")])
def test_literal(text, value):
    assert literal(text) == value


def test_tokens():
    t = Tokens("a(`x${b({c: `${d}`})}y`) / 2 /* [ */ ] }", Syntax(templates=True, regexes=True))
    assert [x.text for x in t.all] == ["a", "(", "`x${", "${", "b", "(", "{", "c", ":", "`${", "${", "d", "}", "`", "}", ")", "}", "y`", ")", "/", "2", "]", "}"]
    assert t.close(1) == 18 and 21 not in t.match and t.comment[21].text == "/* [ */"
