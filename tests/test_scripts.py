"""The lexer of JavaScript and TypeScript, and what the miner makes of its tokens."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pactlens.functions import script
from pactlens.operators import mining

SOUND = (
    "", "return;", "f('(')", "// it's :(", "/* multi ' \n line */ f()", "const greet = (name) => `hi ${name}`;", "fetch(`/a/${f({x:`q`})}/b`)", "x = a / b / c;",
    "s.replace(/['\"(]/g, '')", "const r = /[/]/;", "if (a) { b() }\n/x'/.test(y)", "const a = <div className=\"x\">it's {f('(')} <b/> ok</div>;",
    "import axios from 'axios';\nexport default class A extends B { async get(x) { return await this.y?.z } }", "for (const x of xs) console.log(x)",
    "const {a, b: c, ...d} = e", "x = cond ? 1 : 2", "a = [1,,2]", "label: for(;;){break label}", "const fn = async function* () { yield* other() }", "x = y\n++z",
    "a ||= 3; b ??= c", "export * from 'x'", "abstract class X { private readonly y = 1; static #z = 2; get q() { return 1 } }", "x = 0xFFn", "@Injectable() export class S {}",
    "switch (x) { case 'a': return 1; default: break }", "throw new Error(`a`)", "tag`x ${1}`", "function f(a, b,) {}", "x = a ? b : c ? d : e;", "const y = x!", "1..toString()",
)
TYPED = (
    "let x: Map<string, Array<number>> = new Map<string, Array<number>>();", "type A = {a?: number; b: string | null}", "function f<T extends object>(x: T): x is T { return !!x as any }",
    "let v = <string>foo;", "declare module 'x' { export const y: number; }", "interface A extends B, C { (x: number): string; [k: string]: any }", "import type {A} from './a'",
    "export const api = (id: string) => client.get<User[]>(`/u/${id}`);", "let u = undefined as unknown as T;", "enum E { A = 1, B }",
)
BROKEN = (
    "function f(): { return", "f((1)", "x = 'abc", "`abc ${x", "const x 5", "a +", "f(a +)", "x = ;", "/* never", "f(]", "x = {a: 1", "<div>", "let a = 'x' 'y'", "foo bar", "`a ${b c} d`", ")",
)


@pytest.mark.parametrize(("codes", "language"), [(SOUND, "tsx"), (SOUND[:11], "javascript"), (TYPED, "typescript")])
def test_sound_code_is_sound(codes, language):
    assert [(c, p) for c in codes if (p := script.unsound(c, language))] == []


def test_broken_code_is_not():
    assert [c for c in BROKEN if script.unsound(c, "javascript") is None] == []
    assert script.unsound("a\nb\nf((", "javascript") == "line 3: a bracket is not closed"
    assert script.unsound("`${" * 5000, "javascript") == "nested too deeply"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1 \n'\"`${}()[]</>*\\=+,;.", max_size=60))
def test_any_text_is_read_to_its_end(text):
    for language in ("javascript", "typescript"):
        tokens, _ = script.lex(text, language)
        assert all(tokens[t.partner].partner == n for n, t in enumerate(tokens) if t.partner is not None)
        mining.javascript_facts(text, language)


def sites(text, language="javascript"):
    return [(c["owner"], c["attr"], [a["pieces"] and [p["text"] for p in a["pieces"]] for a in c["args"]]) for c in mining.javascript_facts(text, language)["calls"]]


def test_calls_are_read_wherever_they_stand():
    assert sites("fetch(`/a/${f({x:`q`})}/b`)") == [(None, "fetch", [["/a/", "f", "/b"]]), (None, "f", [None])]
    assert sites("const x = <A b={() => axios.get('/jsx')}>it's</A>") == [("axios", "get", [["/jsx"]])]
    assert sites("// fetch('/no')\nconst s = \"fetch('/no')\", r = /fetch('.no')/;") == []
    assert sites("function fetch(url) {}; a.b.get('/x'); new Foo('/y')") == [(None, "Foo", [["/y"]])]


def test_constants_and_imports():
    facts = mining.javascript_facts("import axios, {AxiosError} from 'axios'; import * as http from \"axios\"\nconst A = 'a', B: string = `b`, C = `c${A}`\nfunction f() { const D = 'd' }\nvar E = require('axios')", "typescript")
    assert {n["name"] for n in facts["names"]} == {"axios", "http", "E"}
    assert {c["name"]: c["value"] for c in facts["constants"]} == {"A": "a", "B": "b"}
