"""Tokens of source text, one regular expression a family of languages, and their normalised codes."""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from typing import NamedTuple

from .. import constants as K


class Token(NamedTuple):
    kind: str  # id, kw, str, num, op
    text: str
    start: int
    end: int
    row: int


# Words that stay as they stand in the normalised stream: those that most languages reserve, and what a language adds.
_COMMON = "break case catch class const continue default do else false for if import in new null return static switch this throw true try var void while"
_ADDED = {
    "typescript": "abstract as async await constructor debugger declare delete enum export extends finally from function get implements instanceof interface let namespace of private protected public readonly set super typeof undefined yield",
    "python": "and as assert async await def del elif except False finally from global is lambda None nonlocal not or pass raise True with yield",
    "rust": "as async await crate dyn enum extern fn impl let loop match mod move mut pub ref self Self struct super trait type unsafe use where",
    "go": "chan defer fallthrough func go goto interface map nil package range select struct type",
    "java": "abstract assert enum extends final finally implements instanceof interface native package private protected public record sealed super synchronized throws transient volatile yield",
    "ruby": "alias and begin def defined? elsif end ensure module next nil not or redo rescue retry self super then undef unless until when yield",
    "swift": "as associatedtype defer deinit enum extension fallthrough fileprivate func guard init inout internal is let nil operator private protocol public repeat rethrows self Self some struct subscript super throws typealias where",
    "c": "auto enum extern goto inline register restrict signed sizeof struct typedef union unsigned volatile",
    "cpp": "auto constexpr delete enum explicit extern friend goto inline mutable namespace noexcept nullptr operator override private protected public sizeof struct template typedef typename union unsigned using virtual volatile",
    "php": "abstract and array as clone declare echo elseif empty extends final finally fn foreach function global goto implements include instanceof insteadof interface isset list match namespace or print private protected public readonly require trait unset use yield",
    "csharp": "abstract as async await base checked delegate enum event explicit extern finally fixed foreach get goto implicit init interface internal is lock namespace operator out override params private protected public readonly record ref sealed set sizeof stackalloc struct typeof unchecked unsafe using value virtual volatile where yield",
    "kotlin": "as by companion data fun init interface internal is lateinit object open operator override package private protected public sealed super suspend val when where",
    "scala": "abstract def extends final finally forSome given implicit lazy match object override package private protected sealed super trait type using val with yield",
    "clojure": "nil",
}
KEYWORDS = {lang: frozenset((("" if lang == "clojure" else _COMMON + " ") + words).split()) for lang, words in _ADDED.items()}
KEYWORDS |= dict.fromkeys(("tsx", "javascript"), KEYWORDS["typescript"])

_NUM = r"(?P<num>(?<![\w.])(?:0[xXbBoO][\da-fA-F_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?)\w*)"
_ID = r"(?P<id>[^\W\d][\w$]*|[$@][^\W\d]\w*)"
_OP = r"(?P<op>=>|->|::|\+\+|--|&&|\|\||\?\?|\?\.|[<>=!+\-*/%&|^]=|\*\*|\.\.\.?|[^\s\w])"
_DQ = r'"(?:[^"\\\n]|\\.)*"'
_SQ = r"'(?:[^'\\\n]|\\.)*'"
_CHAR = r"'(?:[^'\\\n]|\\[^\n]{1,8}?)'"
_TPL = r"`(?:[^`\\]|\\.)*`"
_C_COM = r"//[^\n]*|/\*.*?(?:\*/|\Z)"


def _lexer(comment: str, *strings: str, ident: str = _ID) -> re.Pattern:
    return re.compile(rf"(?P<com>{comment})|(?P<str>{'|'.join(strings)})|{_NUM}|{ident}|{_OP}", re.S)


_BRACES = _lexer(_C_COM, r'"""(?:.*?)"""', r'@"(?:[^"]|"")*"', _DQ, _SQ, _TPL)
LEXERS = {
    **dict.fromkeys(("typescript", "tsx", "javascript", "java", "csharp", "kotlin", "scala", "swift", "c", "cpp"), _BRACES),
    "go": _lexer(_C_COM, _DQ, r"`[^`]*`", _CHAR),
    "rust": _lexer(_C_COM, r'b?r"[^"]*"|b?r#".*?"#', 'b?' + r'"(?:[^"\\]|\\.)*"', "b?" + _CHAR, ident=r"(?P<id>'?[^\W\d]\w*!?)"),
    "php": _lexer(_C_COM + r"|#(?!\[)[^\n]*", r'"(?:[^"\\]|\\.)*"', r"'(?:[^'\\]|\\.)*'"),
    "python": _lexer(r"#[^\n]*", r'[rRbBuUfF]{0,2}"""(?:[^\\]|\\.)*?"""', r"[rRbBuUfF]{0,2}'''(?:[^\\]|\\.)*?'''", "[rRbBuUfF]{0,2}" + _DQ, "[rRbBuUfF]{0,2}" + _SQ),
    "ruby": _lexer(r"#[^\n{]*(?:\n|\Z)|^=begin.*?^=end", _DQ, _SQ, r":[^\W\d]\w*[?!]?", ident=r"(?P<id>[@$]{0,2}[^\W\d]\w*[?!]?)"),
    "clojure": _lexer(r";[^\n]*|#_", r'#?"(?:[^"\\]|\\.)*"', r"::?[^\s()\[\]{}\"';,]+", r"\\(?:[a-z]+|.)", ident=r"(?P<id>[^\s()\[\]{}\"'`~@^#;,\d:\\][^\s()\[\]{}\"`~@^;,\\]*)"),
}


def rows_of(text: str) -> list[int]:
    """Offsets at which lines begin."""
    starts, at = [0], text.find("\n")
    while at >= 0:
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    return starts


def tokenize(lang: str, text: str) -> list[Token]:
    """All tokens but comments."""
    out, keywords, new = [], KEYWORDS[lang], tuple.__new__
    row, counted = 0, 0
    for m in LEXERS[lang].finditer(text):
        kind = m.lastgroup
        if kind == "com":
            continue
        a, b = m.span()
        word = text[a:b]
        if kind == "id" and word in keywords:
            kind = "kw"
        row += text.count("\n", counted, a)
        counted = a
        out.append(new(Token, (kind, word, a, b, row)))
    return out


@lru_cache(maxsize=1 << 14)
def code_of(text: str) -> int:
    """Stable code of a token that stays as it stands, below the band of operator symbols."""
    return zlib.crc32(text.encode()) % K.OP_BASE


def operator_code(text: str) -> int:
    return K.OP_BASE + zlib.crc32(text.encode()) % K.OP_BAND


def normalise(tokens: list[Token], operators: frozenset[int] = frozenset()) -> tuple[list[int], int]:
    """Codes and significant lines of tokens: names, texts and numbers are one code each, runs of texts or of numbers count
    once. Tokens that begin at an offset in ``operators`` keep their name although they are identifiers."""
    codes: list[int] = []
    for t in tokens:
        if t.kind == "id":
            codes.append(operator_code(t.text) if t.start in operators else K.IDENT_CODE)
            continue
        code = K.STR_CODE if t.kind == "str" else K.NUM_CODE if t.kind == "num" else code_of(t.text)
        if code in (K.STR_CODE, K.NUM_CODE) and codes and codes[-1] == code:
            continue
        codes.append(code)
    return codes, len({t.row for t in tokens})
