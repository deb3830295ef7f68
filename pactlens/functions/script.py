"""JavaScript and TypeScript as tokens: what the miner reads call sites from and the check of snippets looks at.

A lexer with a stack of modes (code, template, tag, the text between tags), no parser: strings, nested
templates, regular expressions, comments and JSX are told apart, and every bracket knows its partner.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Words after which an operand comes, so that a slash begins a regular expression.
BEFORE_OPERAND = frozenset("return typeof case in of delete void instanceof new throw else do yield await default extends".split())
#: Words that may stand beside a name or a literal without an operator between.
BESIDE = BEFORE_OPERAND | frozenset(
    "abstract accessor as assert asserts async break class const continue debugger declare enum export finally for from function get global if "
    "implements import infer interface is keyof let module namespace out override private protected public readonly require satisfies set "
    "static super switch target try catch type unique using var while with".split()
)
_PAIRS = {")": "(", "]": "[", "}": "{"}
_BLANK = re.compile(r"(?:\s|//[^\n]*|/\*.*?\*/|\A#![^\n]*)+", re.S)
_WORD = re.compile(r"[#@]?[\w$]+")
_NUMBER = re.compile(r"(?:0[xX][\da-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)n?")
_STRING = re.compile(r"""'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*\"""", re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_OPERATOR = re.compile(r"=>|\.\.\.|\?\.(?!\d)|[*]{2}=?|&&=?|\|\|=?|\?\?=?|[=!]==?|[-+*/%&|^]=|\+\+|--|.", re.S)
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
_PLAIN = re.compile(r"""(?P<word>[A-Za-z_$][\w$]*)|(?P<string>'[^'\\\n]*'|"[^"\\\n]*")|(?P<sign>[,;:])""")
_TAG_NAME = re.compile(r"[A-Za-z_$][\w$.:-]*")
#: After one of these an operand must still come.
_HANGING = frozenset("= == === != !== + - * / % ** && || ?? | & ^ => ? : . ?. , < += -= *= /= %= &&= ||= ??= &= |= ^=".split())


@dataclass(slots=True)
class Token:
    """kind: word, number, string, regex, template, markup or sign; `partner` is the place of a bracket's other half."""

    kind: str
    text: str
    line: int
    fresh: bool  # the first of its line
    partner: int | None = None
    #: Of a template or an element: texts, and lists of tokens for what is inserted.
    parts: list = field(default_factory=list)


class Lexer:
    def __init__(self, text: str, jsx: bool = True):
        self.text, self.jsx, self.at, self.line, self.problem = text, jsx, 0, 1, None

    def fail(self, problem: str) -> None:
        self.problem = self.problem or f"line {self.line}: {problem}"

    def take(self, pattern: re.Pattern) -> str | None:
        m = pattern.match(self.text, self.at)
        if m is None:
            return None
        self.at = m.end()
        self.line += m[0].count("\n")
        return m[0]

    def code(self, until: str | None = None) -> list[Token]:
        """Tokens up to the end, or to the bracket `until` that closes what the caller opened."""
        out: list[Token] = []
        opened: list[int] = []
        while True:
            before = self.line
            c = self.text[self.at : self.at + 1]
            if c.isspace() or c in "/#":
                self.take(_BLANK)
            plain = _PLAIN.match(self.text, self.at)
            if plain is not None:  # most tokens: no newline, no bracket, nothing to tell apart
                self.at = plain.end()
                out.append(Token(plain.lastgroup, plain[0], self.line, self.line > before or not out))
                continue
            if self.at >= len(self.text):
                if opened or until:
                    self.fail("a bracket is not closed")
                return out
            c, fresh = self.text[self.at], self.line > before or not out
            if c == until and not opened:
                self.at += 1
                return out
            token = Token("sign", c, self.line, fresh)
            if c in "'\"":
                token.kind, token.text = "string", self.take(_STRING)
                if token.text is None:
                    self.fail("a string is not closed")
                    token.text = self.take(re.compile(r"[^\n]*"))
            elif c == "`":
                self.at += 1
                token.kind, token.parts = "template", self.template()
            elif c.isdigit() or c == "." and self.text[self.at + 1 : self.at + 2].isdigit():
                token.kind, token.text = "number", self.take(_NUMBER)
            elif (word := self.take(_WORD)) is not None:
                token.kind, token.text = "word", word
            elif c == "/" and operand_next(out) and (regex := self.take(_REGEX)) is not None:
                token.kind, token.text = "regex", regex
            elif c == "<" and self.jsx and operand_next(out) and re.match(r"<(?:[A-Za-z_$]|>)", self.text[self.at : self.at + 2]):
                token.kind, token.text = "markup", ""
                token.parts = [x for code in self.markup() for x in ("", code)]
            else:
                if self.text.startswith("/*", self.at):
                    self.fail("a comment is not closed")
                    self.at = len(self.text)
                    continue
                token.text = self.take(_OPERATOR)
                if token.text in ("(", "[", "{"):
                    opened.append(len(out))
                elif token.text in _PAIRS:
                    if opened and out[opened[-1]].text == _PAIRS[token.text]:
                        token.partner = opened.pop()
                        out[token.partner].partner = len(out)
                    else:
                        self.fail(f"{token.text} closes nothing")
            out.append(token)

    def template(self) -> list:
        parts: list = []
        while True:
            parts.append(self.take(_TEMPLATE))
            rest = self.text[self.at : self.at + 2]
            if not rest:
                self.fail("a template is not closed")
                return parts
            self.at += 1 if rest[0] == "`" else 2
            if rest[0] == "`":
                return parts
            parts.append(self.code("}"))

    def markup(self) -> list[list[Token]]:
        """One element with all that is in it; the code that its braces hold is given."""
        depth, held = 0, []
        while True:
            closing = self.text.startswith("</", self.at)
            self.at += 2 if closing else 1
            self.take(_TAG_NAME)
            alone = False
            while True:  # inside the tag
                self.take(_BLANK)
                c = self.text[self.at : self.at + 1]
                if c == "{":
                    self.at += 1
                    held.append(self.code("}"))
                elif c in ("'", '"') and self.take(re.compile(rf"{c}[^{c}]*{c}")) is not None:
                    pass
                elif c == "/" and self.text.startswith("/>", self.at):
                    self.at, alone = self.at + 2, True
                    break
                elif c == ">":
                    self.at += 1
                    break
                elif not c:
                    self.fail("a tag is not closed")
                    return held
                elif self.take(_TAG_NAME) is None:
                    self.at += 1
            depth += 0 if alone else -1 if closing else 1
            if depth <= 0:
                return held
            while True:  # between tags
                self.take(re.compile(r"[^<{]*"))
                c = self.text[self.at : self.at + 1]
                if c == "{":
                    self.at += 1
                    held.append(self.code("}"))
                elif c == "<":
                    break
                else:
                    self.fail("a tag is not closed")
                    return held


def operand_next(before: list[Token]) -> bool:
    """Whether an operand is due after these tokens, not an operator."""
    if not before:
        return True
    last = before[-1]
    if last.kind == "word":
        return last.text in BEFORE_OPERAND and not (len(before) > 1 and before[-2].text == ".")
    if last.kind != "sign" or last.text in (")", "]", "++", "--"):
        return False
    # After a block a statement begins, after an object an operator follows.
    return last.text != "}" or last.partner is not None and block(before, last.partner)


def block(tokens: list[Token], opened: int) -> bool:
    """Whether the brace at `opened` begins a block rather than an object."""
    before = tokens[opened - 1] if opened else None
    return before is None or before.text in (")", ";", "{", "}", "=>") or before.text in ("else", "do", "try", "finally")


def lex(text: str, language: str = "javascript") -> tuple[list[Token], str | None]:
    """All tokens that can be read, and what is wrong with the text, if anything is.

    In `typescript` an angle bracket never begins an element; in `javascript` and `tsx` it can.
    """
    lexer = Lexer(text, language != "typescript")
    try:
        tokens = lexer.code()
    except RecursionError:
        return [], "nested too deeply"
    return tokens, lexer.problem


def unsound(text: str, language: str) -> str | None:
    """What keeps a snippet from being sound, or null: open strings, templates, comments or brackets, an
    operator without its operand, or two operands of one line without an operator between them."""
    tokens, problem = lex(text, language)
    return problem or _missing(tokens)


def _missing(tokens: list[Token]) -> str | None:
    for n, t in enumerate(tokens):
        for part in t.parts[1::2]:
            if wrong := _missing(part):
                return wrong
        before = tokens[n - 1] if n else None
        if before is None:
            continue
        hanging = before.kind == "sign" and before.text in _HANGING
        allowed = before.text in (",", ":", "?", "*", "<", "=>", ".") and t.text in ("]", ")", "}", ">", ",", "=")
        if hanging and t.kind == "sign" and t.text in (")", "]", "}", ";", ",") and not allowed:
            return f"line {t.line}: an operand is missing before {t.text}"
        accessed = n > 1 and tokens[n - 2].text in ((".", "?.") if before.kind != "word" else ("@", "type"))
        if _plain(before) and _plain(t) and not t.fresh and not accessed:
            return f"line {t.line}: an operator is missing before {t.text}"
    last = tokens[-1] if tokens else None
    if last is not None and last.kind == "sign" and last.text in _HANGING - {",", "?", ":"}:
        return f"line {last.line}: an operand is missing at the end"
    return None


def _plain(t: Token) -> bool:
    """A literal, or a word that may not stand beside another."""
    return t.kind in ("number", "string") or t.kind == "word" and t.text not in BESIDE and t.text[0] != "@"


# What the miner asks of tokens --------------------------------------------------------------------


def parts(tokens: list[Token], opened: int, separator: str = ",") -> list[list[Token]]:
    """The pieces between a bracket and its partner, cut at top-level separators; empty ones are left out."""
    end = tokens[opened].partner
    return [] if end is None else cut(tokens, opened + 1, end, separator)


def cut(tokens: list[Token], start: int, end: int, separator: str) -> list[list[Token]]:
    out, at, n = [], start, start
    while n < end:
        t = tokens[n]
        if t.kind == "sign" and t.text == separator:
            out.append(moved(tokens, at, n))
            at = n + 1
        n = t.partner + 1 if t.kind == "sign" and t.text in ("(", "[", "{") and t.partner is not None else n + 1
    out.append(moved(tokens, at, end))
    return [p for p in out if p]


def moved(tokens: list[Token], start: int, end: int) -> list[Token]:
    """A range of tokens whose partners are places in the range."""
    return [Token(t.kind, t.text, t.line, t.fresh, None if t.partner is None else t.partner - start, t.parts) for t in tokens[start:end]]


def after_generics(tokens: list[Token], at: int) -> int | None:
    """The place after type arguments that begin at `at`; `at` itself without any, null if what follows are none."""
    if at >= len(tokens) or tokens[at].text != "<" or tokens[at].kind != "sign":
        return at
    depth, n = 0, at
    while n < len(tokens):
        t = tokens[n]
        if t.kind == "sign":
            if t.text in ("<", ">"):
                depth += 1 if t.text == "<" else -1
                if not depth:
                    return n + 1
            elif t.text in ("{", "[", "(") and t.partner is not None:
                n = t.partner
            elif t.text not in (".", ",", "|", "&", ":", "?", "=>", "[", "]"):
                return None
        n += 1
    return None
