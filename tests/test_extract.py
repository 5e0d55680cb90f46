import numpy as np
import pytest

from echofold.extract.units import analyse, class_shapes

BODY = {  # a function in the language's own form; {n} its name, {a} {b} {c} identifiers, {k} a number
    "typescript": "export function {n}({a}: number[], {b}: string): number {{\n  let {c} = 0;\n  for (const x of {a}) {{\n    if (x > {k} && {b}.length > 2) {{\n      {c} += x * {k};\n    }} else {{\n      {c} -= x;\n    }}\n  }}\n  return {c};\n}}\n",
    "javascript": "const {n} = ({a}, {b}) => {{\n  let {c} = 0;\n  for (const x of {a}) {{\n    if (x > {k} && {b}.length > 2) {{\n      {c} += x * {k};\n    }} else {{\n      {c} -= x;\n    }}\n  }}\n  return {c};\n}};\n",
    "python": "def {n}({a}, {b}):\n    {c} = 0\n    for x in {a}:\n        if x > {k} and len({b}) > 2:\n            {c} += x * {k}\n        elif x < 1:\n            {c} -= x\n        else:\n            {c} = {c} + 1\n    # done\n    return {c} if {b} else None\n",
    "rust": "fn {n}({a}: &[i64], {b}: &str) -> i64 {{\n    let mut {c} = 0;\n    for x in {a}.iter() {{\n        if *x > {k} && {b}.len() > 2 {{\n            {c} += x * {k};\n        }} else {{\n            {c} -= x;\n        }}\n    }}\n    {c}\n}}\n",
    "go": "func {n}({a} []int, {b} string) int {{\n\t{c} := 0\n\tfor _, x := range {a} {{\n\t\tif x > {k} && len({b}) > 2 {{\n\t\t\t{c} += x * {k}\n\t\t}} else {{\n\t\t\t{c} -= x\n\t\t}}\n\t}}\n\treturn {c}\n}}\n",
    "java": "class A {{\n  public int {n}(int[] {a}, String {b}) throws Exception {{\n    int {c} = 0;\n    for (int x : {a}) {{\n      if (x > {k} && {b}.length() > 2) {{\n        {c} += x * {k};\n      }} else {{\n        {c} -= x;\n      }}\n    }}\n    return {c};\n  }}\n}}\n",
    "ruby": "def {n}({a}, {b})\n  {c} = 0\n  {a}.each do |x|\n    if x > {k} && {b}.size > 2\n      {c} += x * {k}\n    else\n      {c} -= x\n    end\n  end\n  return {c} unless {b}.nil? || {c} == {k}\nend\n",
    "swift": "func {n}(_ {a}: [Int], {b}: String) -> Int {{\n  var {c} = 0\n  for x in {a} {{\n    if x > {k} && {b}.count > 2 {{\n      {c} += x * {k}\n    }} else {{\n      {c} -= x\n    }}\n  }}\n  return {c}\n}}\n",
    "c": "static int *{n}(int *{a}, const char *{b}) {{\n  int {c} = 0;\n  for (int i = 0; i < {k}; i++) {{\n    if ({a}[i] > {k} && {b}[0] != 0) {{\n      {c} += {a}[i] * {k};\n    }} else {{\n      {c} -= {a}[i];\n    }}\n  }}\n  return {c};\n}}\n",
    "cpp": "int Foo::{n}(const std::vector<int>& {a}, const char* {b}) const {{\n  int {c} = 0;\n  for (int x : {a}) {{\n    if (x > {k} && {b}[0] != 0) {{\n      {c} += x * {k};\n    }} else {{\n      {c} -= x;\n    }}\n  }}\n  return {c};\n}}\n",
    "php": "<?php\nfunction {n}(array ${a}, string ${b}): int {{\n  ${c} = 0;\n  foreach (${a} as $x) {{\n    if ($x > {k} && strlen(${b}) > 2) {{\n      ${c} += $x * {k};\n    }} else {{\n      ${c} -= $x;\n    }}\n  }}\n  return ${c};\n}}\n",
    "csharp": "class A {{\n  public static int {n}(int[] {a}, string {b}) {{\n    var {c} = 0;\n    foreach (var x in {a}) {{\n      if (x > {k} && {b}.Length > 2) {{\n        {c} += x * {k};\n      }} else {{\n        {c} -= x;\n      }}\n    }}\n    return {c};\n  }}\n}}\n",
    "kotlin": "fun {n}({a}: List<Int>, {b}: String): Int {{\n  var {c} = 0\n  for (x in {a}) {{\n    if (x > {k} && {b}.length > 2) {{\n      {c} += x * {k}\n    }} else {{\n      {c} -= x\n    }}\n  }}\n  return {c}\n}}\n",
    "scala": "def {n}({a}: Seq[Int], {b}: String): Int = {{\n  var {c} = 0\n  for (x <- {a}) {{\n    if (x > {k} && {b}.length > 2) {{\n      {c} += x * {k}\n    }} else {{\n      {c} -= x\n    }}\n  }}\n  {c}\n}}\n",
    "clojure": "(defn {n} [{a} {b}]\n  (let [{c} (reduce + (map inc {a}))\n        size (count {b})]\n    (if (> {c} {k})\n      (do (println {c} size) (* {c} {k}))\n      (- {c} (max size 1 {c})))))\n",
}
BODY["tsx"] = BODY["typescript"]
A = {"n": "sum_all", "a": "items", "b": "label", "c": "total", "k": 10}
B = {"n": "addUp", "a": "values", "b": "title", "c": "acc", "k": 77}


def jaccard(x, y):
    return len(set(x) & set(y)) / len(set(x) | set(y))


@pytest.mark.parametrize("lang", sorted(BODY))
def test_renamed_copy_is_the_same(lang):
    one, two = (analyse(lang, BODY[lang].format(**v), 30)[0] for v in (A, B))
    assert len(one) == 1 and len(two) == 1, (one, two)
    assert one[0]["name"].split("::")[-1] == "sum_all" and two[0]["name"].split("::")[-1] == "addUp"
    assert jaccard(one[0]["fps"], two[0]["fps"]) >= 0.95
    assert one[0]["sig_lines"] >= 6


def test_lines_and_comments():
    src = "// first\n" + BODY["typescript"].format(**A)
    unit, sig, total = analyse("typescript", src, 30)
    assert unit[0]["start_line"] == 2 and unit[0]["end_line"] == 12 and total == 12 and sig == 11
    plain = analyse("typescript", BODY["typescript"].format(**A), 5)[0][0]
    noted = analyse("typescript", BODY["typescript"].format(**A).replace("let total = 0;", "/* a b c */ let total = 0; // why\n"), 5)[0][0]
    assert plain["fps"] == noted["fps"]


def test_unrelated_differ():
    other = "function z(q) {\n  while (q.next()) {\n    switch (q.kind) {\n      case 1: return [q.a, q.b];\n      case 2: throw new Error('x' + q.c);\n    }\n    const r = { a: q.x ? 1 : 2, b: [...q.items] };\n    q.push(r);\n  }\n  try { q.close(); } catch (e) { log(e); }\n}\n"
    x, y = analyse("typescript", BODY["typescript"].format(**A), 30)[0], analyse("typescript", other, 30)[0]
    assert jaccard(x[0]["fps"], y[0]["fps"]) < 0.3


def test_javascript_forms():
    src = """
class A { async load(x) { return x.map(v => v + 1).filter(v => v); } get size() { return 1 + 2 * this.x; } }
const f = async (a) => { return a + 1; };
obj.handler = function (e) { return e + 2; };
const o = { key: (a) => { return a; }, other() { return 3; } };
function* gen(a) { yield a; }
items.forEach((x) => { console.log(x); });
if (a) { b(); }
const g = (x) => x + 1;
"""
    names = [u["name"] for u in analyse("javascript", src, 1)[0]]
    # bodies without a window's worth of tokens have no fingerprints; those that have are named
    assert "load" in names and "size" in names
    from echofold.extract.scanners import scan
    assert [f.name for f in scan("javascript", src)[1]] == ["load", "size", "f", "obj.handler", "key", "other", "gen"]


def test_flags():
    rust = "impl Display for A {\n" + BODY["rust"].format(**A) + "}\nimpl A {\n" + BODY["rust"].format(**B) + "}\n#[cfg(test)]\nmod tests {\n" + BODY["rust"].format(**{**A, "n": "t"}) + "}\n"
    units = {u["name"]: u for u in analyse("rust", rust, 30)[0]}
    assert [units[n]["is_trait_impl_method"] for n in ("sum_all", "addUp")] == [True, False]
    assert [units[n]["is_test"] for n in ("sum_all", "t")] == [False, True]
    assert not any(u["is_test"] for u in analyse("rust", "#[cfg(test)]\nuse x;\n" + BODY["rust"].format(**A), 30)[0])
    java = BODY["java"].format(**A).replace("  public", "  @Override\n  public")
    assert analyse("java", java, 30)[0][0]["is_trait_impl_method"] and not analyse("java", BODY["java"].format(**A), 30)[0][0]["is_trait_impl_method"]


def test_clojure_forms():
    from echofold.extract.scanners import scan

    src = "(def add (fn [a b] (+ a b)))\n(def inc2 #(+ % 2))\n(letfn [(twice [x] (* 2 x))] (twice 3))\n(defmethod area :sq [s] (* s s))\n(defrecord P [a] Shape (draw [this] (line a)))\n(map #(inc %) xs)\n(def x 5)\n(f (g [1 2]))"
    found = scan("clojure", src)[1]
    assert [(f.name, f.required_name) for f in found] == [("add", False), ("inc2", False), ("twice", False), ("area", True), ("draw", True), ("<anonymous>", False)]


def test_python_nesting_and_one_liners():
    from echofold.extract.scanners import scan

    src = "class A:\n    def f(self,\n          x=(1,\n2)):\n        def g():\n            return 1\n        return g\n\n    async def h(self): return 2\n\nx = 1\n"
    tokens, found = scan("python", src)
    assert [(f.name, tokens[f.first].row, tokens[f.last - 1].row) for f in found] == [("f", 1, 6), ("g", 4, 5), ("h", 8, 8)]


def test_shapes():
    classic = "public class Graph {\n  public int Id { get; set; }\n  private readonly string _name;\n  public Graph(Node root, int depth = 3) { _root = root; }\n  public void Walk(int x) => Go(x);\n  class Inner { int A; }\n}\n"
    primary = "public class Net(Node start, int max) {\n  public int Id { get; init; } = 4;\n  private readonly string _name;\n  public void Walk(int x) { Go(x); }\n}\n"
    one, two = class_shapes(classic), class_shapes(primary)
    assert [u["name"] for u in one] == ["Graph"] and one[0]["sig_lines"] == 4
    assert one[0]["fps"] == two[0]["fps"]
    assert class_shapes("class Tiny { int A; int B; }") == []


def test_odd_text():
    for lang in BODY:
        for text in ("", "{", "}}}}(((", '"', "def", "fn x(", "\x00\x01", "é" * 100, "function f() {" * 50):
            assert analyse(lang, text, 1)[0] == [] or lang
    assert analyse("cobol", "x\ny", 1) == ([], 0, 2)


def test_winnowing_properties():
    from echofold.operators.fingerprints import fingerprint, kgram_hashes, winnow_hashes

    rng = np.random.default_rng(7)
    stream = rng.integers(0, 97, 20_000)
    fps = winnow_hashes(kgram_hashes(stream))
    assert abs(len(fps) / (len(stream) - 9) - 2 / 9) < 0.05
    assert np.array_equal(fps, winnow_hashes(kgram_hashes(stream)))
    planted = rng.integers(200, 900, 17)
    for shift in range(16):
        a = np.concatenate((rng.integers(0, 97, 50 + shift), planted, rng.integers(0, 97, 40)))
        b = np.concatenate((rng.integers(100, 197, 31), planted, rng.integers(100, 197, 60)))
        assert set(fingerprint(a)) & set(fingerprint(b))
    assert len(fingerprint(np.arange(9))) == 0 and len(fingerprint(np.arange(12))) == 1


def test_codes_of_words_and_signs_differ():
    """Every reserved word and operator of a language has a code of its own."""
    from echofold.extract.lexer import KEYWORDS, code_of

    signs = "=> -> :: ++ -- && || ?? ?. <= >= == != += -= *= /= %= &= ^= ** .. ... ".split() + list("<>=!+-*/%&|^~?:;,.(){}[]@#$\\`'\"")
    for lang, words in KEYWORDS.items():
        codes = [code_of(x) for x in {*words, *signs}]
        assert len(codes) == len(set(codes)), lang
