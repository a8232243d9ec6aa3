import itertools
import random

import pytest

from lodewright.llm import syntax
from lodewright.llm.gll import Grammar

PYTHON = [
    "x = 1\n", "", "# only a comment", "def f(a, *, b=1, **k) -> int:\n    return a\n", "if x:\n    pass\nelif y: z = 1\nelse:\n    w = 2\n", "try:\n    a()\nexcept (A, B) as e:\n    raise X from e\nelse:\n    b()\nfinally:\n    c()\n",
    "with a as b, c as (d, e):\n    pass\n", "with (a as b, c):\n    pass\n", "@dec(1)\n@x.y\nasync def f():\n    async for i in z:\n        await i\n    return [j async for j in k if j]\n", "class A(B, metaclass=C):\n    x: int = 1\n",
    "lambda x, *y, z=1: (x, y)\n", "a = b = c, *d = e\n", "x[1:2, ::3, ...] += 1\n", "print(f'{x!r:>{w}} {{}} {a[\"k\"]}')\n", "f\"{x['a']}\"\n", "s = '''a\nb'''\n", "r'\\d' b'x' u'y'\n", "x = (yield)\n", "match p:\n    case [1, *_] | {'k': v, **r} if v:\n        pass\n    case A.B(x, y=1):\n        pass\n    case _: pass\n",
    "match = 1\nmatch(x)\n", "type X = int\n", "global x, y\n", "del a[0], b.c\n", "from . import a as b, c\nfrom .x.y import (d, e as f,)\nimport os.path as p, sys\n", "if (n := 10) > 5: print(n)\n", "x = a if b else c\nnot a in b is not c\n", "def f(a, /, b, *, c): ...\n",
    "{**a, 'b': 1}\n{*a, b}\n{k: v for k, v in x}\n", "1_000 + 0xFF + 1e5j + .5 + 1.\n", "for x, in y:\n    break\nelse:\n    continue\n", "a\\\n  + b\n", "x = [\n  1,\n\n  # c\n  2]\n", "if x:\n\tif y:\n\t\tz\n", "async with a: pass\n", "assert x, 'm'\n", "try:\n    pass\nexcept* E:\n    pass\n", "def g[T: int](x: T) -> T: return x\n",
    "x = 1;\ny = 2; z = 3\n", "print x\n", "exec 'x'\n", "def f(:\n    pass\n", "x = = 1\n", "if x\n    pass\n", "  x = 1\n", "if x:\npass\n", "if x:\n    a\n  b\n", "x = (1,\n", "x = ]\n", "'abc\n", "'''abc\n", "def f():\n", "class A:\n\nx = 1\n", "else:\n    pass\n", "try:\n    pass\n", "x = 1abc\n", "x = 08\n", "a b\n", "f(a b)\n", "f'{x'\n", "f'}'\n", "f'{}'\n",
    "<<<<<<< HEAD\nx = 1\n=======\nx = 2\n>>>>>>> b\n", "x = \u201ca\u201d\n", "\x00", "return = 1\n", "import\n", "from x import\n", "@dec\nx = 1\n", "lambda: (yield)\n", "raise E, 'x'\n", "except E, e:\n    pass\n", "x <> y\n", "`x`\n", "int main() { return 0; }\n", "<!doctype html>\n<p>no</p>\n", "The quick brown fox.\n", "if True:\n        x\n\ty\n", "f(**a, *b)\n", "f(a=1, b)\n", "x++\n", "a = 1 +\n", "$x = 1\n", "x = 1 if 2\n", "for x in y\n    pass\n", "while:\n    pass\n",
]


@pytest.mark.parametrize("code", PYTHON)
def test_python_agrees_with_its_parser(code):
    if "python" not in syntax._READY:
        syntax._READY["python"] = syntax._Python()
    assert syntax._READY["python"].accepts(code) == syntax.python_parses(code)


GOOD = {
    "java": [
        "package a.b;\nimport java.util.*;\nimport static x.Y.z;\npublic final class A<T extends B & C> extends D implements E, F {\n  private static final int[] x = {1, 2, 3}, y[] = new int[3][];\n  @Override public <U> Map<String, List<U>> f(final int a, String... b) throws G { for (int i = 0, j = 1; i < 3; i++, j--) { if (a >> 1 > 2) continue; else break; } return null; }\n  A() { this(1); }\n  static { z(); }\n}\n",
        "enum E { A(1) { void f() {} }, B; int x; E() {} }\ninterface I { default int f() { return 1; } int g(); }\n@interface N { int v() default 1; }\nrecord P(int x, int y) { P { } }\n",
        'class A { void f() { Runnable r = () -> {}; F<A> g = x -> x + 1; list.stream().map(A::new).filter(s -> !s.isEmpty()).toArray(String[]::new); try (R a = b(); c) { } catch (X | Y e) { throw e; } finally { } switch (x) { case 1: case 2: y(); break; default: } int k = switch (x) { case 1, 2 -> 3; default -> { yield 4; } }; Object o = (String) p; var q = (a) + b; do { x--; } while (x > 0); synchronized (this) { } char c = \'\\\'\'; String t = """\n"hi" """; label: for (var i : is) { } assert a : "b"; if (o instanceof String s && s.length() > 1) {} int[] z = new int[]{1}; Map<K, ? super V> m; } }',
        "void main() { System.out.println(1); }",
    ],
    "go": [
        'package main\n\nimport (\n\t"fmt"\n\tm "math"\n)\n\ntype T[K comparable, V any] struct {\n\tA, B int `json:"a"`\n\t*X\n}\n\ntype I interface {\n\tF(a int, b ...string) (int, error)\n\t~int | string\n}\n\nconst (\n\tA = iota\n\tB\n)\n\nvar x, y = 1, []int{1, 2}\n\nfunc (t *T[K, V]) f(a, b int) (c int, err error) {\n\tdefer func() { recover() }()\n\tfor i := range x {\n\t\tfmt.Println(i)\n\t}\n\tfor {\n\t\tbreak\n\t}\n\tif v, ok := m[k]; ok && v > 1 {\n\t\treturn 1, nil\n\t} else if z {\n\t}\n\tswitch t := v.(type) {\n\tcase int, string:\n\t\tf(t)\n\tdefault:\n\t}\n\tselect {\n\tcase c <- 1:\n\tcase v := <-d:\n\t}\n\tgo f(a...)\n\tp := &T{A: 1, B: 2}\n\tq := map[string][]int{"a": {1, 2}}\n\ts := a[1:2:3]\n\ti++\nL:\n\tgoto L\n\treturn\n}\n',
        "package a\n",
    ],
    "javascript": [
        "'use strict'\nconst f = (a, b = 1, ...c) => a + b\nlet {x, y: [z], ...w} = o, g = async x => await x\nfunction* h() { yield* k; }\nclass A extends B { static #p = 1; constructor() { super(); } get x() { return this.#p } async *m() {} static { q() } }\nfor (const [a, b] of c) continue\nfor (let i = 0; i < 3; i++) { }\nfor (const k in o) {}\nif (a) b(); else c()\ndo { x-- } while (x)\nswitch (x) { case 1: f(); break\n default: g() }\ntry { a() } catch { b() } finally { c() }\nvar r = /a[/]b\\/c/gi.test(s), t = `a ${b + `c ${d}`} e`\nx = a ? b : c, y ??= z?.q?.[1]?.(2)\nlabel: while (true) break label\nnew Foo\nnew a.b.C(1)\ndelete o[k]\nreturn1 = typeof x === 'a'\n!function () {}()\n",
        "import a, {b as c, default as d} from 'e'\nimport * as f from 'g'\nexport default class {}\nexport const h = 1\nexport {h as i}\n", "var a = 1 // no semicolon\nvar b = 2\n;[1, 2].forEach(x => x)\n", "let v = {a, 'b': 1, [c]: 2, d() {}, get e() { return 1 }, ...f}\n",
    ],
    "cpp": [
        '#include <vector>\n#define F(x) \\\n  x\nusing namespace std;\ntemplate <typename T, int N = 3> struct A : public B<T>, private C { T x[N] = {1, 2}; explicit A(int a) : x{a}, y(2) {} virtual ~A() = default; A& operator=(const A&) = delete; bool operator<(const A& o) const { return x < o.x; } friend ostream& operator<<(ostream& s, const A& a); };\nenum class E : int { A = 1, B };\nnamespace n { typedef unsigned long long ull; using vi = std::vector<std::vector<int>>; }\nint main(int argc, char** argv) { vector<pair<int, int>> v(n); for (auto& [a, b] : v) a += b; for (size_t i = 0; i < v.size(); ++i) { if (v[i].first >> 1 > 2) continue; } auto f = [&, x = 1](int a) mutable -> int { return a * x; }; cout << "a" "b" << f(1) << \'\\n\'; int* p = new int[3]{1}; delete[] p; switch (x) { case 1: break; default: return 0; } do { x--; } while (x); try { throw runtime_error("x"); } catch (const exception& e) { } catch (...) { } const char* s = R"(a"b)"; double d = 1e-9, e = 0x1Fp3; x = a < b ? c : (int) d; sort(v.begin(), v.end(), greater<int>()); static_cast<int>(x); ull y = 1\'000\'000ULL; if (int q = g(); q) return q; return {}; }\n',
        "struct S { int a; char *b; } s = {1, 0};\nstatic int f(void) { return sizeof(struct S) + sizeof s; }\nint (*fp)(int, char *);\n",
    ],
}


@pytest.mark.parametrize("language,code", [(k, c) for k, v in GOOD.items() for c in v])
def test_good_files_parse(language, code):
    assert syntax.parses(language, code)


@pytest.mark.parametrize("language,code", [(k, c) for k, v in GOOD.items() for c in v if len(c) > 150])
def test_damaged_files_do_not_parse(language, code):
    rng = random.Random(language)
    for cut in (0.3, 0.5, 0.8):
        at = int(len(code) * cut)
        while code[:at].count("{") <= code[:at].count("}"):
            at -= 1
        assert not syntax.parses(language, code[:at])
    i = rng.randrange(len(code) // 2, len(code))
    at = code.rfind("\n", 0, i) + 1 if "\n" in code[:i] and '"""' not in code else 0  # within a text block the mark would be text
    assert not syntax.parses(language, code[:at] + "<<<<<<< HEAD\n" + code[at:])
    assert not syntax.parses(language, "```\n" + code)
    assert not syntax.parses(language, "The quick brown fox jumps over the lazy dog and runs.")
    assert not syntax.parses(language, code + "\n}\n")


INVALID = {
    "javascript": [
        'let a = 1 let b = 2',
        'foo bar baz',
        'console.log("x") console.log("y")',
        'const x;',
        'break;',
        '1 = 2;',
        'retrun n',
        'int main() {}',
        'if (a) b() else c()',
        'let {a};',
        'function f() { return 1',
        'x = {a: 1 b: 2}',
        'class A { foo bar() {} }',
        'for (x off y) {}',
        'if (a) continue;',
    ],
    "java": [
        'foo bar class A {}',
        'class A { void f() { x y + 1; } }',
        'class A { void f() { 1 + 2; } }',
        'class A { void f() { x; } }',
        'class A { void f() { int x } }',
        'class A { foo {} }',
    ],
    "cpp": [
        'int int x;',
        'x;',
        'public: int x;',
        'foo bar {}',
        'int f() { return 1 }',
        'int class = 1;',
        'int main() { int x = 1 int y = 2; }',
        'int f(a) int a; { return a; }',
        'int f() { L x y; }',
    ],
    "c": [
        'int int x;',
        'x;',
        'public: int x;',
        'int f() { return 1 }',
        'class A {};',
        'using namespace std;',
    ],
    "go": [
        'package a\nfunc f(a int, string) {}\n',
        'package a\nfunc f() { x y }\n',
        'package a\nx := 1\n',
    ],
}
VALID = {
    "javascript": [
        '#!/usr/bin/env node\nlet a = 1',
        '<!-- x\nlet a = 1',
        'var let = 1',
        'if (a) b()\nelse c()',
        'if (a) { b() } else { c() }',
        'let of = 1, get = 2, set = 3, from = of; of(get)',
        'let f = function() { return 1 }',
        'const o = { get a() { return 1 }, set a(v) {}, get: 1, set }',
        'x => x\n',
        'for (const x of xs) { if (x) break; else continue }',
        'do x++; while (x < 3) y()',
        'a = b\n++c',
        "import a, { b as c } from 'd'\nexport * as e from 'f'",
        'let x = a ? b : c\nlet y = `${x} ${`a${b}`}`',
        'switch (a) { case 1: break; default: f() }',
        'for (;;) {}',
        'var a\nvar b = 1\nlet c, d',
        'while (1) if (x) break',
        '({}).x = 1',
        '[a, b] = [b, a]',
        'new Foo;new a.b.C(1).d()',
        'label:\nfor (;;) { continue label }',
        'async function f() { for await (const x of y) await z }',
        'a?.b?.[c]?.(d)',
        'if (a)\n  b()\nelse if (c)\n  d()\nelse\n  e()',
        'return 1',
        'const f = async () => { await g() }\nf()',
        'class A { static x = 1; y; get z() { return 1 } static { f() } #p = 2; m() { return #p in this } }',
        'let x = 1; { let y = 2 } f()',
        'try { a() } catch { b() }\nc()',
        '(function () { a() })()',
        'export default function () {}\n',
        "let r = /ab+c/.test(s)\nthrow new Error('x')",
    ],
    "java": [
        'class A { void f(Object o) { if (o instanceof Point(int x, int y) && x > 0) {} } }',
        'module m { requires transitive java.base; exports a.b to c, d; }',
        'open module a.b { uses c.D; provides e.F with g.H, i.J; }',
        'sealed interface S permits A, B {}\nnon-sealed class A implements S {}\nfinal class B implements S {}',
        'class A { int f(Object o) { return switch (o) { case P(int x, var y) when x > 0 -> 1; case String s when s.isEmpty() -> 2; case null, default -> { yield 3; } }; } int record, yield_, when; void g() { record = 1; when(x).then(y); var module = 2; module.f(); } }',
        'class A { void f() { i++; ++i; a.b().c(); new X(); new X().y(); x[1] += 2; this.z = (a) -> b; a.new B(); f(x -> x); label: for (;;) break label; int a = 1, b[]; final var q = 2; List<String> l = new ArrayList<>(); String[] s = {"a"}; } }',
        'record P(int x) { P { } static int y; }\n',
        '@interface A { int v() default 1; }\n@A class B {}',
    ],
    "cpp": [
        '#ifdef A\nint f(int x) {\n#else\nint f(long x) {\n#endif\n return 1; }\n',
        'template <typename T> concept C = requires(T a) { a + a; { a.x() } -> std::same_as<int>; typename T::type; };\ntemplate <C T> requires C<T> || true T f(T x) requires C<T> { return x; }',
        'BEGIN_NS\nint x;\nREGISTER(foo)\nDEFINE(a, 1);\nclass A { Q_OBJECT\npublic: int y; };\nEND_NS',
        'std::size_t f(size_t n) { return n; }',
        "unsigned long long x; long int y; const unsigned char z = 'a'; int unsigned w;",
        'struct A { int x : 3; unsigned : 2; A(); ~A(); explicit A(int); operator bool() const; virtual void f() = 0; A& operator=(const A&) = default; private: int y; };',
        'int main() { int a[3] = {1,2,3}; for (int i : a) std::cout << i; L: goto L; auto [x, y] = p; if (auto q = f(); q) return 0; a[0] = b ? c : d; std::vector<std::pair<int,int>> v{{1,2},{3,4}}; auto f = [&](auto x) -> int { return x; }; switch (x) { case 1: case 2: f(); break; default: ; } throw std::runtime_error("x"); int *p = new int; delete p; (void) x; const auto& r = *this; }',
        'template <typename... Ts> auto sum(Ts... ts) { return (ts + ...); }',
        'enum class E : int { A, B = 2, };\nusing namespace std;\nextern "C" { int f(); }\nstatic int g(void (*cb)(int), int (*)[3]);',
        'int f() try { return 1; } catch (...) { return 2; }',
        'template <> struct std::hash<A> { size_t operator()(const A& a) const noexcept { return 1; } };',
        "int x = 1'000, *y = &x, **z; inline constexpr double pi = 3.14;",
    ],
    "c": [
        'int class = 1;',
        'int new = 3;',
        'int f(a, b) int a; char *b; { return a; }',
        '#include <stdio.h>\ntypedef struct node { int x; struct node *next; } node_t;\nstatic int (*fp)(int, char *);\nint main(void) { struct node n = { .x = 1, .next = NULL }; for (int i = 0; i < 3; i++) printf("%d\\n", i); int *restrict p = (int *) malloc(sizeof(int) * 3); unsigned long long q = 1ULL; goto end; switch (q) { case 1: case 2: break; default: break; } end: return 0; }',
        'main() { return 0; }',
        'enum { A, B = 2 };\nextern const char *names[];\nint a[2][3] = {{1,2,3},{4,5,6}}, b;',
        'int f(int (*cmp)(const void *, const void *), ...);\nvoid g() { do { x--; } while (x); if (a) b(); else c(); (*p)->x[1]++; y = z ? 1 : 2; }',
    ],
    "go": [
        'package a\nfunc f(int, a string) {}\n',
        'package a\nfunc f(int, ...string) (x, y int, err error) { return }\n',
        'package a\nfunc (t *T) g() func(int) string { return func(i int) string { if x := h(); x > 1 { return `a` }; for i := 0; i < 3; i++ { }; var a, b = 1, 2; L: for { continue L }; switch { case x: fallthrough; default: }; m[k]++; go f(); c <- 1; p := []T{{1, 2}, {A: 3}}; return "" } }\n',
    ],
}


@pytest.mark.parametrize("language,code", [(k, c) for k, v in VALID.items() for c in v])
def test_valid_constructs(language, code):
    assert syntax.parses(language, code)


@pytest.mark.parametrize("language,code", [(k, c) for k, v in INVALID.items() for c in v])
def test_invalid_constructs(language, code):
    assert not syntax.parses(language, code)


@pytest.mark.parametrize("language", sorted(VALID))
def test_islands_change_no_verdict(language):
    """Recognising statements and blocks by themselves accepts what the whole grammar accepts."""
    made = syntax._MAKERS[language]()
    plain = syntax._MAKERS[language]()
    plain.grammar.islands = {}
    plain.grammar.kinds = [0] * len(plain.grammar.kinds)
    for code in [*VALID[language], *INVALID[language], *GOOD.get(language, [])]:
        for text in (code, code[: len(code) * 2 // 3]):
            assert made.accepts(text) == plain.accepts(text), text


def test_deep_nesting_needs_no_stack():
    assert syntax.parses("go", "package a\nfunc f() " + "{" * 3_000 + "}" * 3_000 + "\n")
    assert not syntax.parses("go", "package a\nfunc f() " + "{" * 3_000 + "}" * 2_999 + "\n")


def generate(rules, symbol, depth):
    """All texts of a symbol up to a depth."""
    if symbol not in rules:
        return {symbol}
    if not depth:
        return set()
    out = set()
    for alt in rules[symbol]:
        parts = [generate(rules, s, depth - 1) for s in alt]
        out |= {"".join(p) for p in itertools.product(*parts)}
    return {x for x in out if len(x) <= 6}


@pytest.mark.parametrize(
    "text,rules",
    [
        ("s : 'a' s 'b' | s s |", {"s": ["asb", "ss", ""]}), ("s : s 'a' | 'b'", {"s": ["sa", "b"]}), ("s : 'a' s 'a' | 'b' s 'b' | 'a' | 'b' |", {"s": ["asa", "bsb", "a", "b", ""]}),
        ("s : t t\nt : 'a' | 'a' 'b' | 'b' t", {"s": ["tt"], "t": ["a", "ab", "bt"]}),
    ],
)
def test_recogniser_equals_generation(text, rules):
    g = Grammar(text, ("s",))
    known = generate({k: [list(a) for a in v] for k, v in rules.items()}, "s", 7)
    for n in range(5):
        for w in map("".join, itertools.product("ab", repeat=n)):
            assert g.recognise([g.terminals[c] for c in w]) == (w in known), w


def test_dialects_run_together():
    g = Grammar("one : 'a' 'b'\ntwo : 'a' 'a'", ("one", "two"))
    t = g.terminals
    assert g.recognise([t["a"], t["b"]]) and g.recognise([t["a"], t["a"]]) and not g.recognise([t["b"]]) and not g.recognise([-1])


def test_table(frame):
    rows = [
        ("corpus", 1, "r", "Python 3", "x = 1"), ("corpus", 2, "r", "PY", "x ="), ("corpus", 3, None, "c++17", "int main() {"), ("corpus", 4, "r", None, "x ="), ("corpus", 5, "r", "python", None), ("corpus", 6, "r", "python", ""),
        ("corpus", 7, "r", "cobol", "MOVE"), ("documents", None, "q", "golang", "package main"), ("documents", 9, "q", "go", "package main\nfunc {"), ("documents", 9, "q", "go", "package main\nfunc {"), ("documents", 10, "q", "python", "x = [" + "1, " * 30_000 + "]"),
    ]
    df = frame(rows, "tbl string, rec_id bigint, repo string, tag string, file string")
    got = [(r.rec_id, r.parses) for r in syntax.checked(df).collect()]
    assert sorted(got, key=repr) == sorted([(1, True), (2, False), (3, False), (7, None), (None, True), (9, False), (9, False), (10, True)], key=repr)
    rates = {(r.repo, r.language): (r.n_files, r.n_checked, r.n_invalid, r.invalid_rate) for r in syntax.rates(df).collect()}
    assert rates == {("r", "python"): (2, 2, 1, 0.5), ("r", "cobol"): (1, 0, 0, None), (None, "cpp"): (1, 1, 1, 1.0), ("q", "go"): (3, 3, 2, 0.666667), ("q", "python"): (1, 1, 0, 0.0)}
    assert syntax.checked(df.limit(0)).count() == 0
