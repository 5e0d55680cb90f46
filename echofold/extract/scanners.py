"""Functions of source text, by language: a registry of scanners, without grammars.

A scanner takes text and yields ``Found``: the name, the span of the whole function and of its body, and flags. Languages with
braces share one scanner that reads the header before every opening brace; Python and Scala bodies go by indentation,
Ruby's by ``end``, Clojure's by parentheses. ``register`` adds a language.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

from .lexer import Token, tokenize

ANONYMOUS = "<anonymous>"


class Found(NamedTuple):
    name: str
    first: int  # tokens [first, last) are the function, [body, last) its body
    body: int
    last: int
    required_name: bool = False
    operators: frozenset[int] = frozenset()


Scanner = Callable[[list[Token], str], Iterator[Found]]
SCANNERS: dict[str, Scanner] = {}


def register(*langs: str) -> Callable[[Scanner], Scanner]:
    def add(f: Scanner) -> Scanner:
        SCANNERS.update(dict.fromkeys(langs, f))
        return f

    return add


OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


def matches(tokens: list[Token]) -> dict[int, int]:
    """Partner of every bracket, both ways; what isn't balanced is left out."""
    stack: list[int] = []
    pair: dict[int, int] = {}
    for i, t in enumerate(tokens):
        if t.kind != "op":
            continue
        if t.text in OPEN:
            stack.append(i)
        elif t.text in CLOSE:
            while stack and OPEN[tokens[stack[-1]].text] != t.text:
                stack.pop()
            if stack:
                pair[i] = stack.pop()
                pair[pair[i]] = i
    return pair


def header(tokens: list[Token], pair: dict[int, int], brace: int) -> tuple[str, int]:
    """What stands before a brace back to the last statement, with bracketed groups as ``()`` and ``[]``; and where it begins."""
    words: list[str] = []
    i = brace - 1
    while i >= 0:
        t = tokens[i]
        if t.kind == "op" and t.text in (")", "]", "}"):
            if t.text == "}" or i not in pair:
                break
            words.append("()" if t.text == ")" else "[]")
            i = pair[i] - 1
            continue
        if t.kind == "op" and t.text in (";", "{", "(", "[", ","):
            break
        words.append('""' if t.kind == "str" else t.text)
        i -= 1
    return " ".join(reversed(words)), i + 1


_CONTROL = r"(?!(?:if|for|foreach|while|switch|catch|else|try|do|match|using|lock|synchronized|with|return|when|guard|loop|unsafe|select|defer|go|new|throw|in|fixed|checked|finally|repeat|elseif|elif|case|default)\b)"
_NAME = r"(?P<name>[^\W\d][\w$]*)"
_GENERIC = r"(?: <[^=]*>)?"
_JS = (
    rf"(?:^|\s)function(?: \*)? {_NAME}{_GENERIC} \(\)(?: : .+)?$",
    rf"(?:^|\s)(?P<name>[\w$#.]+(?: \. [\w$#]+)*)(?: : [^=]+)? = (?:async )?function(?: \*)?(?: \w+)?{_GENERIC} \(\)(?: : .+)?$",
    rf"(?:^|\s)(?P<name>[\w$#]+(?: \. [\w$#]+)*)(?: : [^=]+)? = (?:async )?(?:<[^=]*> )?(?:\(\)|\w+)(?: : .+)? =>$",
    rf"^(?P<name>[\w$]+|\"\") : (?:async )?(?:function(?: \*)?(?: \w+)?{_GENERIC} \(\)|(?:<[^=]*> )?(?:\(\)|\w+)(?: : .+)? =>)$",
    rf"^(?:@ \w+ (?:\(\) )?)*(?:(?:public|private|protected|static|async|override|readonly|get|set|export|default|declare|\*) )*{_CONTROL}(?P<name>(?!function\b)[\w$#]+){_GENERIC} \(\)(?: : .+)?$",
)
_TYPED = rf"(?:^|\s){_CONTROL}(?P<name>[^\W\d]\w*) "
HEADERS: dict[str, tuple[str, ...]] = {
    **dict.fromkeys(("typescript", "tsx", "javascript"), _JS),
    "rust": (rf"(?:^|\s)fn {_NAME}{_GENERIC} \(\)(?: -> .+?)?(?: where .+)?$",),
    "go": (rf"^func (?:\(\) )?{_NAME}(?: \[\])? \(\)(?: .+)?$",),
    "java": (rf"^(?!.*\b(?:new|class|interface|enum|record)\b)(?:.*\s)?{_CONTROL}{_NAME} \(\)(?: throws .+)?$",),
    "csharp": (rf"^(?!.*(?:\bnew \w+ \(\)$|\b(?:class|interface|enum|struct|namespace)\b|=))(?:.*\s)?{_CONTROL}{_NAME}{_GENERIC} \(\)(?: : (?:base|this) \(\))?(?: where .+)?$",),
    "kotlin": (rf"(?:^|\s)fun (?:<.*> )?(?:[\w<> ?]+ \. )*{_NAME} \(\)(?: : .+)?$",),
    "swift": (rf"(?:^|\s)func {_NAME}{_GENERIC} \(\)(?: \w+)*(?: -> .+)?$", r"(?:^|\s)(?P<init>init|deinit)(?: [?!])?(?: <.*>)?(?: \(\))?(?: throws)?$"),
    **dict.fromkeys(("c", "cpp"), (rf"^(?!.*(?:=|\b(?:struct|class|enum|union|namespace)\b.*\{{))(?:.*[\s*&])?{_CONTROL}(?P<name>(?:\w+ :: )*~?(?: ?)\w+) \(\)(?: (?:const|noexcept|override|final|&|&&))*(?: -> .+)?(?: : .+)?$",)),
    "php": (rf"(?:^|\s)function (?:& )?{_NAME} \(\)(?: : .+)?$",),
    "scala": (rf"(?:^|\s)def {_NAME}(?: \[\])?(?: \(\))*(?: : [^=]+)? =$", rf"(?:^|\s)def {_NAME}(?: \[\])?(?: \(\))+$"),
}
_COMPILED = {lang: tuple(re.compile(h) for h in hs) for lang, hs in HEADERS.items()}


@register(*HEADERS)
def braces(tokens: list[Token], lang: str) -> Iterator[Found]:
    pair = matches(tokens)
    enclosing: list[tuple[int, str]] = []
    for i, t in enumerate(tokens):
        while enclosing and enclosing[-1][0] <= i:
            enclosing.pop()
        if t.text != "{" or t.kind != "op" or i not in pair:
            continue
        head, first = header(tokens, pair, i)
        for form in _COMPILED[lang]:
            m = form.search(head)
            if m:
                name = (m.groupdict().get("name") or "").replace(" ", "")
                required = (lang == "rust" and bool(enclosing) and re.search(r"(?:^|\s)impl\b.* for ", enclosing[-1][1]) is not None) or (lang == "java" and re.search(r"@ Override\b|@Override\b", head) is not None)
                yield Found(name if name and name != '""' else ANONYMOUS, first, i, pair[i] + 1, required)
                break
        enclosing.append((pair[i], head))
    if lang == "scala":
        yield from _scala_expressions(tokens, pair)


def _scala_expressions(tokens: list[Token], pair: dict[int, int]) -> Iterator[Found]:
    """``def name(...) = expression`` without a brace: up to the next line that isn't indented further."""
    for i, t in enumerate(tokens[:-2]):
        if t.text != "def" or tokens[i + 1].kind not in ("id", "kw"):
            continue
        j = i + 2
        while j < len(tokens) and tokens[j].text not in ("=", "{", "}", ";", "def"):
            j = pair[j] + 1 if tokens[j].text in ("(", "[") and j in pair else j + 1
        if j + 1 >= len(tokens) or tokens[j].text != "=" or tokens[j + 1].text == "{":
            continue
        k = _until_dedent(tokens, j + 1, i, pair)
        yield Found(tokens[i + 1].text, i, j + 1, k)


def _column(tokens: list[Token], i: int) -> int:
    """Offset of the first token on this token's row, from that row's first token's own line start (by the row's first token)."""
    j = i
    while j and tokens[j - 1].row == tokens[i].row:
        j -= 1
    return j


def _until_dedent(tokens: list[Token], start: int, head: int, pair: dict[int, int], columns: dict[int, int] | None = None) -> int:
    cols = columns if columns is not None else _Columns(tokens)
    base = cols[_column(tokens, head)]
    k = start
    while k < len(tokens):
        if k > start and tokens[k].row != tokens[k - 1].row and tokens[k].row > tokens[start].row and cols[k] <= base:
            break
        if tokens[k].text in CLOSE and pair.get(k, k) < head:
            break
        k = pair[k] + 1 if tokens[k].text in OPEN and k in pair else k + 1
    return k


class _Columns(dict):
    """Column of a token that begins its row; needs the source's line starts, kept on the token list."""

    def __init__(self, tokens: list[Token]):
        super().__init__()
        self.tokens = tokens

    def __missing__(self, i: int) -> int:
        starts = getattr(self.tokens, "line_starts", None)
        return self.tokens[i].start - starts[self.tokens[i].row]


class Tokens(list):
    """A token list that knows where its lines begin."""

    line_starts: list[int]


@register("python")
def python(tokens: list[Token], lang: str) -> Iterator[Found]:
    pair, cols = matches(tokens), _Columns(tokens)
    for i, t in enumerate(tokens[:-3]):
        if t.text != "def" or tokens[i + 1].kind not in ("id", "kw"):
            continue
        j = i + 2
        while j < len(tokens) and tokens[j].text != ":":
            j = pair[j] + 1 if tokens[j].text in OPEN and j in pair else j + 1
        if j + 1 >= len(tokens):
            continue
        if tokens[j + 1].row == tokens[j].row:  # the body stands on the header's line
            k = j + 1
            while k < len(tokens) and tokens[k].row == tokens[j].row:
                k += 1
        else:
            base = cols[_column(tokens, i)]
            k = j + 1
            while k < len(tokens):
                if tokens[k].row != tokens[k - 1].row and cols[k] <= base:
                    break
                k = pair[k] + 1 if tokens[k].text in OPEN and k in pair else k + 1
        if k > j + 1:
            yield Found(tokens[i + 1].text, i, j + 1, k)


@register("ruby")
def ruby(tokens: list[Token], lang: str) -> Iterator[Found]:
    pair, cols = matches(tokens), _Columns(tokens)
    for i, t in enumerate(tokens[:-2]):
        if t.text != "def" or (i and tokens[i - 1].row == t.row and tokens[i - 1].text not in ("private", "public", "protected", "module_function", ";")):
            continue
        j = i + 1
        while j + 2 < len(tokens) and tokens[j + 1].text in (".", "::") and tokens[j + 1].row == t.row:
            j += 2
        name, j = tokens[j].text, j + 1
        if j < len(tokens) and tokens[j].text == "(" and j in pair:
            j = pair[j] + 1
        else:
            while j < len(tokens) and tokens[j].row == t.row:
                j += 1
        base = cols[_column(tokens, i)]
        k = j
        while k < len(tokens) and not (tokens[k].text == "end" and tokens[k].row != tokens[k - 1].row and cols[k] <= base):
            k += 1
        if k < len(tokens) and k > j:
            yield Found(name, i, j, k + 1)


_DEFINERS = frozenset(("defn", "defn-", "defmacro", "deftest", "defmulti", "defmethod"))
_HOSTS = frozenset(("defrecord", "deftype", "extend-type", "extend-protocol", "reify"))


@register("clojure")
def clojure(tokens: list[Token], lang: str) -> Iterator[Found]:
    pair = matches(tokens)
    heads = {tokens[i + 1].start for i, t in enumerate(tokens[:-1]) if t.text == "(" and tokens[i + 1].kind in ("id", "kw")}
    word = lambda i: tokens[i].text if i < len(tokens) and tokens[i].kind in ("id", "kw") else None
    stack: list[int] = []

    def found(name: str, first: int, body: int, required: bool = False) -> Found:
        last = pair[body] + 1
        # the head of the form itself names or defines; a reader function has no name of its own, its head is called
        own = tokens[body + 1].start if tokens[body].text == "(" and not (body and tokens[body - 1].text == "#") else -1
        return Found(name, first, body, last, required, frozenset(heads - {own}))

    for i, t in enumerate(tokens):
        if t.kind == "op" and t.text in CLOSE and stack:
            stack.pop()
        if t.kind != "op" or t.text not in OPEN:
            continue
        parent = stack[-1] if stack else None
        stack.append(i)
        if t.text != "(" or i not in pair or i + 1 >= len(tokens):
            continue
        head = word(i + 1)
        if i and tokens[i - 1].text == "#":
            bound = parent is not None and word(parent + 1) == "def" and parent + 3 == i - 1
            yield found(tokens[parent + 2].text if bound else ANONYMOUS, parent if bound else i - 1, i)
        elif head in _DEFINERS and word(i + 2):
            yield found(word(i + 2), i, i, head == "defmethod")
        elif head == "fn":
            bound = parent is not None and word(parent + 1) == "def" and parent + 3 == i
            yield found(tokens[parent + 2].text if bound else ANONYMOUS, parent if bound else i, i)
        elif head and i + 2 < len(tokens) and tokens[i + 2].text == "[" and parent is not None:
            if tokens[parent].text == "(" and word(parent + 1) in _HOSTS:
                yield found(head, i, i, True)
            elif tokens[parent].text == "[" and parent and word(parent - 1) == "letfn":
                yield found(head, i, i)


def scan(lang: str, text: str) -> tuple[Tokens, list[Found]]:
    """Tokens and functions in order of body; of two with one body span the named one stays."""
    from .lexer import rows_of

    tokens = Tokens(tokenize(lang, text))
    tokens.line_starts = rows_of(text)
    best: dict[tuple[int, int], Found] = {}
    for f in SCANNERS[lang](tokens, lang):
        key = (f.body, f.last)
        if key not in best or best[key].name == ANONYMOUS:
            best[key] = f
    return tokens, [best[k] for k in sorted(best)]
