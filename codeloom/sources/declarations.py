"""Declarations of brace languages: a tokeniser and a stack of open blocks, whatever lines a declaration is spread over.

Tokens between two boundaries (``;``, ``{``, ``}``, in Go a new line) are a head. A head says what the block or statement declares, by its
language's keywords and by the blocks around it; brackets nest, so what they hold never counts as the head's own words.
"""

from __future__ import annotations

import re
from bisect import bisect_right

_STRINGS = r'"(?:\\.|[^"\\])*"|{}'
_QUOTES = {
    "rust": r"""'(?:\\[^\n]{1,9}?|[^'\\\n])'|'[A-Za-z_]\w*""",
    "javascript": r"'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`",
    "go": r"'(?:\\.|[^'\\\n])*'|`[^`]*`",
}
_QUOTES["typescript"] = _QUOTES["javascript"]
_MODIFIERS = set("public protected private internal static final abstract readonly async export default declare override virtual inline explicit constexpr consteval friend extern const volatile unsafe pub mut get set".split())
_NO_NAMES = set("if for while switch catch return else do try new delete throw sizeof match foreach elseif function with using case typeof await yield super".split())
#: The kind of symbol that a keyword declares, by language.
KEYWORDS = {
    "php": {"class": "class", "interface": "interface", "trait": "trait", "enum": "enum", "function": "function"},
    "rust": {"struct": "struct", "enum": "enum", "trait": "trait", "type": "constant", "const": "constant", "static": "constant", "mod": "module", "fn": "function"},
    "javascript": {"class": "class", "function": "function"},
    "typescript": {"class": "class", "function": "function", "interface": "interface", "type": "constant", "enum": "enum"},
    "c": {"struct": "struct", "enum": "enum"},
    "cpp": {"class": "class", "struct": "struct", "union": "struct", "enum": "enum"},
}
CLASSES = {"class", "interface", "trait", "enum", "struct", "impl"}
#: In languages where a new line may end a statement: what goes on with the one before.
GOES_ON = set("= => export default async return abstract declare , : | & ? < + - * / . ( [ && || extends implements static private public protected readonly override get set new typeof".split())
JOINS_ON = set("extends implements from of in as else instanceof is".split())
#: Words that other words may stand before in a declaration, but that begin one themselves here.
OWN = {"rust": {"const", "static"}, "php": {"const"}, "javascript": {"const"}, "typescript": {"const"}}


def _pattern(lang: str) -> re.Pattern:
    strings = _STRINGS.format(_QUOTES.get(lang, r"'(?:\\.|[^'\\])*'"))
    raw = r'b?r(?P<h>#*)"(?s:.*?)"(?P=h)|' if lang == "rust" else ""
    directive = r"(?P<p>^[ \t]*#(?:\\\r?\n|[^\n])*)|" if lang in ("c", "cpp") else r"(?P<p>(?!))|"
    comment = r"/\*(?s:.*?)\*/|//[^\n]*" + (r"|#(?!\[)[^\n]*|<\?(?:php\b|=)?|\?>" if lang == "php" else "")
    return re.compile(rf"(?P<c>{comment})|{directive}(?P<s>{raw}{strings})|(?P<w>[$A-Za-z_][$\w]*)|(?P<n>\d[\w.]*)|(?P<o>::|=>|->|[^\s\w])", re.M)


PATTERNS = {g: _pattern(g) for g in ("php", "rust", "go", "javascript", "typescript", "c", "cpp")}
_CLOSE = {"(": ")", "[": "]", "{": "}"}


class _Head(list):
    """Words of a head: (text, start, end), brackets as one word with what they hold."""

    def texts(self) -> list[str]:
        return [w[0] for w in self]


def _angled(words: list[str], k: int) -> int:
    """The word after the angle brackets that open at k."""
    depth = 0
    while k < len(words):
        depth += (words[k] == "<") - (words[k] == ">")
        k += 1
        if not depth:
            break
    return k


class _Scan:
    def __init__(self, path: str, lang: str, text: str):
        self.path, self.lang, self.text = path, lang, text
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.found: list[tuple] = []
        self.space = ""  # PHP's namespace of the file

    def place(self, at: int) -> tuple[int, int]:
        line = bisect_right(self.lines, at)
        return line, at - self.lines[line - 1]

    def emit(self, kind: str, name: str, full: str, start: int, end: int) -> None:
        (a, c), (b, d) = self.place(start), self.place(end)
        self.found.append((name, full, kind, self.path, a, b, c, d))

    # names
    def full(self, name: str, kind: str, stack: list[dict], written: str | None = None) -> str:
        owner = next((s["name"] for s in reversed(stack) if s["kind"] in CLASSES and s["name"]), None)
        member = owner if kind in ("method", "constant") else None
        if self.lang == "php":
            space = next((s["name"] for s in reversed(stack) if s["kind"] == "namespace"), self.space)
            return "\\".join(x for x in (space, member, name) if x)
        if self.lang == "cpp":
            spaces = [s["name"] for s in stack if s["kind"] == "namespace" and s["name"]]
            return "::".join([*spaces, written] if written and "::" in written else [x for x in (*spaces, member, name) if x])
        join = {"rust": "::"}.get(self.lang, ".")
        return f"{owner}{join}{name}" if kind == "method" and owner and self.lang != "c" else name

    def function_name(self, head: _Head) -> tuple[str, int] | None:
        """(name as written, index of its first word) of a C or C++ function: what stands before the first round brackets."""
        words = head.texts()
        k = 0
        while k < len(words) and words[k] == "template":
            k = _angled(words, k + 1)
        if "operator" in words[k:]:
            at = words.index("operator", k)
            end = next((j for j in range(at + 1, len(words)) if words[j].startswith("(") and not (j == at + 1 and words[j] == "()" and j + 1 < len(words) and words[j + 1].startswith("("))), None)
            if end is None:
                return None
            first, name = at, "operator" + (" " if words[at + 1][0].isalpha() else "") + "".join(words[at + 1 : end])
        else:
            end = next((j for j in range(k, len(words)) if words[j].startswith("(")), None)
            if end is None or "=" in words[k:end] or end == k:
                return None
            first = end - 1
            if not re.match(r"[A-Za-z_]", words[first]) or words[first] in _NO_NAMES:
                return None
            if first > k and words[first - 1] == "~":
                first -= 1
            name = "".join(words[first:end])
        while first > k and words[first - 1] == "::":
            j = first - 2
            if j > k and words[j] == ">":
                depth = 0
                while j > k:
                    depth += (words[j] == ">") - (words[j] == "<")
                    if not depth:
                        break
                    j -= 1
                j -= 1
            name = "".join(words[j : first - 1]) + "::" + name
            first = j
        # a lone macro around a name: NAME(function) {
        if first == k and end == k + 1 and "::" not in name and self.lang == "c" and re.fullmatch(r"\(\s*[A-Za-z_]\w*\s*\)", words[end]):
            return words[end][1:-1].strip(), first
        return name, first

    def declared(self, head: _Head, stack: list[dict], ender: str) -> tuple[str, str, list[tuple[str, str, str]]]:
        """Of a head: kind and name of the block that it opens, and the symbols (kind, name, full name) that it declares."""
        lang, words = self.lang, head.texts()
        inside = stack[-1]["kind"] if stack else "file"
        out: list[tuple[str, str, str]] = []

        def say(kind: str, name: str, written: str | None = None) -> None:
            out.append((kind, name, self.full(name, kind, stack, written)))

        if lang == "go":
            return self.declared_go(words, inside, ender)
        k = 0
        while k < len(words):
            called = k + 1 < len(words) and words[k + 1].startswith("(") and lang != "rust"
            if words[k] == "template":
                k = _angled(words, k + 1)
            elif words[k] in _MODIFIERS and words[k] not in OWN.get(lang, ()) and not called or words[k].startswith(("(", "[", '"')) or words[k] in "#@" or k and words[k - 1] == "@":
                k += 1
            else:
                break
        rest = words[k:]
        first = rest[0] if rest else ""
        after = rest[1] if len(rest) > 1 else ""
        if first == "namespace" and lang in ("php", "cpp"):
            name = "".join(rest[1:])
            if lang == "php" and ender == ";":
                self.space = name
            return "namespace", name, []
        if lang == "rust" and first == "impl":
            told = _angled(rest, 1) if after == "<" else 1
            typed = rest[told:][rest[told:].index("for") + 1 :] if "for" in rest[told:] else rest[told:]
            typed = typed[: typed.index("where")] if "where" in typed else typed
            return "impl", "".join(typed), []
        if lang == "rust" and first == "macro_rules":
            say("macro", rest[2] if len(rest) > 2 else "")
            return "block", "", out
        if lang == "rust" and first == "const" and after in ("fn", "unsafe", "async", "extern"):
            return self.declared(_Head(w for w in head if w[0] != "const"), stack, ender)
        if lang == "typescript" and first == "const" and after == "enum":
            rest = rest[1:]
            first, after = rest[0], rest[1] if len(rest) > 1 else ""
        kind = KEYWORDS.get(lang, {}).get(first)
        if lang in ("c", "cpp") and first == "typedef":
            if ender == ";" and re.match(r"[A-Za-z_]", words[-1]):
                say("constant", words[-1])
            body = next((w for w in rest[1:3] if w in KEYWORDS[lang]), None)
            name = rest[2] if len(rest) > 2 and body and re.match(r"[A-Za-z_]", rest[2]) else ""
            if ender == "{" and body and name:
                say(KEYWORDS[lang][body], name)
            return ("struct" if body else "block"), name, out
        if lang == "cpp" and first in ("using", "concept") and "=" in rest:
            say("constant", after)
            return "block", "", out
        if kind and lang in ("c", "cpp"):
            names = [w for w in rest[1:] if w not in ("class", "struct", "alignas", "final") and not w.startswith(("(", "["))]
            name = names[0] if names and re.match(r"[A-Za-z_]", names[0]) else ""
            if ender == "{" and not any(w.startswith("(") for w in rest) and "=" not in rest:
                if name:
                    say(kind, name)
                return kind, name, out
        elif kind and re.match(r"[A-Za-z_$&]", after):
            name = rest[2] if after == "&" and len(rest) > 2 else after
            if lang == "rust" and first == "static" and name == "mut":
                name = rest[2]
            if kind == "function":
                ok = ender == "{" or lang == "php"
                kind = "method" if lang == "php" and inside in CLASSES or lang == "rust" and any(s["kind"] == "impl" for s in stack) else "function"
                if ok:
                    say(kind, name)
                return "function", name, out
            if name != "=" and not (lang in ("javascript", "typescript") and first == "type" and "=" not in rest):
                say(kind, name)
            return kind if kind in CLASSES else "module" if kind == "module" else "block", name if kind in CLASSES else "", out
        elif kind == "function" and after == "*" and len(rest) > 2:  # a generator
            say("function", rest[2])
            return "function", rest[2], out
        if lang in ("php", "javascript", "typescript") and first in ("const", "let"):
            at_top = lang == "php" or not stack or stack[-1]["kind"] == "module"
            if lang == "php" and rest[2:3] and rest[2] not in ("=", ","):  # a typed constant
                rest = [first, *rest[2:]]
            wanted, depth = True, 0
            for j, w in enumerate(rest[1:], 1):
                if wanted and re.match(r"[A-Za-z_$]", w) and at_top:
                    say("constant", w)
                depth += (w == "<") - (w == ">")
                wanted = w == "," and not depth
                if j > 1 and rest[j - 1] == "=>":
                    break
            return "value", "", out
        if lang == "javascript" and rest[:2] == ["exports", "."] and len(rest) > 3 and rest[3] == "=" and not stack:
            say("constant", rest[2])
            return "value", "", out
        if lang in ("javascript", "typescript") and ender == "{" and inside in ("class", "value"):
            at = next((j for j, w in enumerate(rest) if w.startswith("(")), None)
            if at and re.match(r"[A-Za-z_$#]", rest[at - 1]) and rest[at - 1] not in ("if", "for", "while", "switch", "catch", "function") and "=" not in rest[:at] and "=>" not in rest:
                say("method", rest[at - 1])
                return "function", rest[at - 1], out
        if lang in ("c", "cpp") and inside in ("file", "namespace", "block", *CLASSES) and not any(s["kind"] == "function" for s in stack):
            owner = inside in CLASSES
            defined = ender == "{" or words[-2:] in (["=", "default"], ["=", "delete"])
            if (defined or owner and lang == "cpp") and (named := self.function_name(head)):
                written, at = named
                name = written if written.startswith("operator") else written.rsplit("::", 1)[-1]
                typed = [w for w in words[k:at] if w not in _MODIFIERS]
                if defined or typed and "~" not in name and words[k] not in ("friend", "using", "return"):
                    say("method" if owner or "::" in written else "function", name, written)
                if ender == "{":
                    return "function", name, out
        last = words[-1] if words else ""
        return ("lambda" if last == "=>" else "value" if last in ("=", "return", ":", ",", "?") else "block"), "", out

    def declared_go(self, words: list[str], inside: str, ender: str) -> tuple[str, str, list]:
        out: list[tuple[str, str, str]] = []
        group = inside.removeprefix("group ") if inside.startswith("group ") else ""
        if group:
            words = [group, *words]
        if not words:
            return "block", "", out
        if words[0] == "func" and inside == "file" and ender == "{":
            if words[1].startswith("("):
                held = re.findall(r"[A-Za-z_]\w*", re.sub(r"\[.*", "", words[1]))
                out.append(("method", words[2], f"{held[-1]}.{words[2]}" if held else words[2]))
                return "function", words[2], out
            out.append(("function", words[1], words[1]))
            return "function", words[1], out
        if words[0] == "type" and len(words) > 2 and (inside == "file" or group):
            told = [w for w in words[2:] if not w.startswith("[")]
            kind = {"struct": "struct", "interface": "interface"}.get(told[0] if told else "", "constant")
            out.append((kind, words[1], words[1]))
            return "block", "", out
        if words[0] == "const" and len(words) > 1 and (inside == "file" or group):
            names = words[1 : words.index("=")] if "=" in words else words[1:2]
            out += [("constant", w, w) for k, w in enumerate(names) if re.match(r"[A-Za-z_]", w) and (k == 0 or names[k - 1] == ",")]
        return "block", "", out

    def run(self) -> list[tuple]:
        lang, stack, head = self.lang, [], _Head()
        brackets: list[tuple[str, int]] = []  # open round and square brackets: what closes them, and where they begin
        line_at = -1

        def statement(end: int) -> None:
            if head:
                for kind, name, full in self.declared(head, stack, ";")[2]:
                    self.emit(kind, name, full, head[0][1], end)
            head.clear()

        last_end = 0
        for m in PATTERNS[lang].finditer(self.text):
            if m.lastgroup == "c":
                continue
            t, start, end = m[0], m.start(), m.end()
            if m.lastgroup == "p":
                if d := re.match(r"[ \t]*#[ \t]*define[ \t]+([A-Za-z_]\w*)(?![\w(])", t):
                    self.emit("macro", d[1], self.full(d[1], "macro", stack), start + len(t) - len(t.lstrip()), start + len(t.rstrip()))
                continue
            new_line = self.place(start)[0] != line_at
            line_at = self.place(end - 1)[0]
            if new_line and head and not brackets:
                go_end = lang == "go" and head[-1][0] not in (",", "=", "+", "|", "&", "-", "*", ".")
                ends = lang in ("javascript", "typescript") and (m.lastgroup == "w" and t not in JOINS_ON or t == "@") and head[-1][0] not in GOES_ON
                if go_end or ends:
                    statement(last_end)
            last_end = end
            if t in ("(", "["):
                if lang == "go" and t == "(" and not brackets and head.texts() in (["const"], ["type"], ["import"], ["var"]):
                    stack.append({"kind": f"group {head[0][0]}", "name": "", "close": ")", "open": [], "head": None, "brackets": []})
                    head = _Head()
                    continue
                brackets.append((_CLOSE[t], start))
            elif brackets and t == brackets[-1][0]:
                _, began = brackets.pop()
                if not brackets:
                    head.append((self.text[began:end], began, end))
            elif t == "{":
                kind, name, symbols = self.declared(head, stack, "{") if not brackets else ("value", "", [])
                keeps = brackets or kind in ("value", "lambda") or kind in ("struct", "enum", "class") and lang in ("c", "cpp") or any(w[0] == "typedef" for w in head)
                stack.append({"kind": kind, "name": name, "close": "}", "open": [(*s, head[0][1] if head else start) for s in symbols], "head": head if keeps else None, "brackets": brackets})
                head, brackets = _Head(), []
            elif t in ("}", ")") and stack and t == stack[-1]["close"]:
                statement(last_end if t == ")" else start)
                closed = stack.pop()
                for kind, name, full, began in closed["open"]:
                    self.emit(kind, name, full, began, end)
                head, brackets = closed["head"] if closed["head"] is not None else _Head(), closed["brackets"]
                if closed["head"] is not None and not brackets:
                    head.append(("{}", start, end))
            elif t == ";" and not brackets:
                statement(end)
            elif lang == "cpp" and t == ":" and not brackets and head.texts() in (["public"], ["private"], ["protected"]):
                head.clear()
            elif not brackets:
                head.append((t, start, end))
        statement(len(self.text))
        return sorted(self.found, key=lambda s: (s[4], s[6], s[5]))


def symbols_of(path: str, lang: str, text: str) -> list[tuple]:
    """(name, qualified_name, kind, file_path, line_start, line_end, col_start, col_end); lines from 1, columns from 0. No namespaces are listed."""
    return _Scan(path, lang, text).run()
