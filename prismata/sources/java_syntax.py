"""The outline of one Java file: declarations, supertypes, imports and member accesses.

The text becomes tokens, and a stack pairs its brackets; declarations are then read by
their grammar and bodies by one walk with a stack of scopes. A member access is a node:
its receiver is the enclosing type, this, super, a named type, or another node, so that a
chain `a.b().c()` is three nodes deep. Which type a name means and which member an access
means needs other files, and is left to joins (java.py).

Accesses anywhere in a method or constructor, in lambdas, anonymous and local classes,
belong to that callable. Initialisers, enum constants and compact constructors are no
callables and have none. Unpaired brackets or a missing name are an error of the file.
"""

from __future__ import annotations

import re
from bisect import bisect_right

TOKEN = re.compile(
    r"(?P<doc>/\*\*(?!/).*?\*/)|(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<s>\"\"\"(?:\\.|[^\\])*?\"\"\"|\"(?:\\.|[^\"\\\n])*\")|(?P<c>'(?:\\.|[^'\\\n])+')"
    r"|(?P<n>\.?\d(?:[eEpP][+-]|[\w.])*)|(?P<w>[^\W\d]\w*(?:\$\w*)*)|(?P<m>->|::|\.\.\.|.)",
    re.S,
)
#: The language's words that name neither a type nor a member.
PRIMITIVE = frozenset("boolean byte char short int long float double void".split())
KEYWORD = frozenset("abstract assert break case catch class const continue default do else enum extends final finally for goto if implements import instanceof interface native new package private protected public return static strictfp super switch synchronized this throw throws transient try volatile while yield true false null".split())
MODIFIER = frozenset("public protected private static final abstract synchronized native default strictfp transient volatile sealed non".split())
TYPES = {"class": "CLASS", "interface": "INTERFACE", "enum": "ENUM", "record": "RECORD"}
OPEN = {"(": ")", "[": "]", "{": "}"}
JAVADOC = 500


def clip(text: str, most: int) -> str:
    return text if len(text) <= most else text[: most - 3] + "..."


class Outline:
    """symbols, supers, imports, nodes, and implied members (enum constants, record components) of one compilation unit."""

    def __init__(self, source: str):
        self.kind, self.text, self.place, self.docs = [], [], [], {}
        for m in TOKEN.finditer(source):
            if m.lastgroup == "doc":
                self.docs[len(self.text)] = m[0][3:-2]
            elif m.lastgroup != "skip":
                self.kind.append(m.lastgroup)
                self.text.append(m[0])
                self.place.append(m.start())
        self.end = len(self.text)
        self.kind += ["m"] * 4
        self.text += [""] * 4
        self.breaks = [m.start() for m in re.finditer("\n", source)]
        self.pair = self._pairs()
        self.symbols, self.supers, self.imports, self.nodes, self.implied = [], [], [], [], []
        self.package = ""
        self._unit()

    def _pairs(self) -> dict[int, int]:
        pair, stack = {}, []
        for i in range(self.end):
            t = self.text[i]
            if self.kind[i] != "m":
                continue
            if t in OPEN:
                stack.append(i)
            elif t in ")]}" and t:
                if not stack or OPEN[self.text[stack[-1]]] != t:
                    raise SyntaxError(f"unpaired {t} in line {self.line(i)}")
                pair[i] = stack.pop()
                pair[pair[i]] = i
            elif t == "<" and i and (self.text[i - 1][:1].isupper() or self.text[i - 1] == ".") and (close := self._angle(i)) is not None:
                pair[i], pair[close] = close, i
        if stack:
            raise SyntaxError(f"unpaired {self.text[stack[-1]]} in line {self.line(stack[-1])}")
        return pair

    def _angle(self, i: int) -> int | None:
        """The > of the type arguments that open at i."""
        depth = 0
        for j in range(i, min(self.end, i + 400)):
            t = self.text[j]
            depth += (t == "<") - (t == ">")
            if not depth:
                return j
            if not (self.kind[j] == "w" or t in "<>,.?[]@" or (t == "&" and self.text[j + 1] != "&" != self.text[j - 1])):
                return None
        return None

    def line(self, i: int) -> int:
        return bisect_right(self.breaks, self.place[i]) + 1

    def name(self, i: int) -> bool:
        return self.kind[i] == "w" and self.text[i] not in KEYWORD and self.text[i] not in PRIMITIVE

    def show(self, i: int, j: int) -> str:
        """Tokens as they are usually written."""
        out = ""
        for k in range(i, j):
            t = self.text[k]
            spaced = out and (self.kind[k] == "w" and (out[-1].isalnum() or out[-1] in "_?") or out[-1] in ",&" or t in "&" and t)
            out += (" " if spaced else "") + t
        return out

    # declarations

    def _unit(self) -> None:
        i = 0
        while i < self.end:
            mods, first, i = self._modifiers(i)
            if self.text[i] in ("package", "import"):
                stop = self.text.index(";", i)
                static = self.text[i + 1] == "static"
                path = "".join(self.text[i + 1 + static : stop])
                if self.text[i] == "package":
                    self.package = path
                else:
                    self.imports.append({"name": path.removesuffix(".*"), "wildcard": path.endswith(".*"), "static": static})
                i = stop + 1
            elif self._type_word(i):
                i = self._type(i, first, mods, None)
            else:
                i += 1

    def _modifiers(self, i: int) -> tuple[list[str], int, int]:
        """(modifiers, first token, token after them); annotations are passed over."""
        first, mods = i, []
        while i < self.end:
            t = self.text[i]
            if t == "@" and self.text[i + 1] != "interface":
                i += 2
                while self.text[i] == ".":
                    i += 2
                i = self.pair[i] + 1 if self.text[i] == "(" else i
            elif t in MODIFIER and not (t == "non" and self.text[i + 1] != "-") and not (t == "sealed" and self.text[i + 1] == "("):
                if t == "non":
                    t, i = "non-sealed", i + 2
                mods.append(t)
                i += 1
            else:
                break
        return mods, first, i

    def _type_word(self, i: int) -> bool:
        t = self.text[i]
        if t == "@":
            return self.text[i + 1] == "interface"
        return t in TYPES and self.name(i + 1) and (t != "record" or self.text[i + 2] in ("(", "<"))

    def _symbol(self, kind: str, name: str, key: str, parent: str | None, first: int, last: int, mods: list[str], signature: str, returns: str | None, doc: int) -> None:
        text = self.docs.get(doc)
        if text is not None:
            text = "\n".join(re.sub(r"^\s*\*? ?", "", x) for x in text.split("\n")).strip()
            text = text if len(text) <= JAVADOC else text[:JAVADOC] + "..."
        self.symbols.append({"kind": kind, "name": name, "qualified_name": key, "parent_key": parent, "start_line": self.line(first), "end_line": self.line(last), "modifiers": " ".join(mods), "signature": clip(signature, 1000), "return_type": returns, "javadoc": text})

    def _type(self, i: int, first: int, mods: list[str], outer: str | None) -> int:
        kind = "ANNOTATION" if self.text[i] == "@" else TYPES[self.text[i]]
        i += 2 if kind == "ANNOTATION" else 1
        name = self.text[i]
        key = f"{outer}.{name}" if outer else f"{self.package}.{name}" if self.package else name
        body = i + 1
        variables: set[str] = set()
        headers = []
        while self.text[body] != "{":
            if body >= self.end:
                raise SyntaxError(f"no body of {name}")
            t = self.text[body]
            if t == "<":
                close = self.pair.get(body) or self._angle(body)
                variables = self._variables(body, close)
                body = close
            elif t == "(":  # a record's components are fields and accessors
                at = body + 1
                while found := self._read_type(at):
                    kinds = None if found[1] or found[0] in variables else found[0]
                    self.implied += [{"owner": key, "name": self.text[found[2]], "arity": n, "type_name": kinds} for n in (-1, 0)]
                    at = found[2] + 2
                body = self.pair[body]
            elif t in ("extends", "implements", "permits"):
                headers.append((t, body + 1))
            body += 1
        close = self.pair[body]
        self._symbol(kind, name, key, outer, first, close, mods, f"{' '.join(mods)} {kind.lower()} {name}", None, first)
        for word, at in headers:
            while word != "permits" and (found := self._read_type(at)):
                raw, _, after = found
                shown = self.show(at, after)
                self.supers.append({"sub_key": key, "super_raw": clip(shown, 480), "super_name": raw, "kind": word.upper()})
                at = after + 1
                if self.text[after] != ",":
                    break
        self._members(body + 1, close, key, name, kind, variables)
        return close + 1

    def _variables(self, i: int, close: int) -> set[str]:
        return {self.text[k] for k in range(i + 1, close) if self.text[k - 1] in "<," and self.kind[k] == "w"}

    def _read_type(self, i: int) -> tuple[str, int, int] | None:
        """(name without arguments, dimensions, token after it) of a type at i."""
        _, _, i = self._modifiers(i)
        if not (self.name(i) or self.text[i] in PRIMITIVE):
            return None
        raw, i = self.text[i], i + 1
        while True:
            if self.text[i] == "<" and (close := self.pair.get(i) or self._angle(i)):
                i = close + 1
            elif self.text[i] == "." and self.name(i + 1):
                raw, i = f"{raw}.{self.text[i + 1]}", i + 2
            else:
                break
        dims = 0
        while self.text[i] == "[" and self.text[i + 1] == "]":
            dims, i = dims + 1, i + 2
        if self.text[i] == "...":
            dims, i = dims + 1, i + 1
        return raw, dims, i

    def _members(self, i: int, end: int, owner: str, simple: str, kind: str, variables: set[str]) -> None:
        if kind == "ENUM":
            while i < end and self.text[i] != ";":
                _, _, i = self._modifiers(i)
                if self.name(i):
                    self.implied.append({"owner": owner, "name": self.text[i], "arity": -1, "type_name": simple})
                i = self.pair[i] + 1 if self.text[i] in OPEN else i + 1
        fields: dict[str, tuple[str, int]] = {}
        bodies = []
        while i < end:
            if self.text[i] == ";":
                i += 1
                continue
            mods, first, i = self._modifiers(i)
            if self._type_word(i):
                i = self._type(i, first, mods, owner)
                continue
            if self.text[i] == "{":
                i = self.pair[i] + 1
                continue
            own = set(variables)
            if self.text[i] == "<":
                close = self.pair.get(i) or self._angle(i)
                own |= self._variables(i, close)
                i = close + 1
            if self.text[i] == simple and self.text[i + 1] == "{":  # a compact constructor
                i = self.pair[i + 1] + 1
            elif self.text[i] == simple and self.text[i + 1] == "(":
                i = self._callable(i, first, mods, owner, None, own, bodies, kind)
            elif (found := self._read_type(i)) and self.name(found[2]):
                at = found[2]
                returns = (self.show(i, at), *found[:2])
                if self.text[at + 1] == "(":
                    i = self._callable(at, first, mods, owner, returns, own, bodies, kind)
                else:
                    i = self._fields(at, i, first, mods, owner, returns, own, fields)
            else:
                i += 1
        for args in bodies:
            Body(self, owner, fields, *args)

    def _fields(self, i: int, kind_at: int, first: int, mods: list[str], owner: str, returns: tuple, own: set[str], fields: dict) -> int:
        shown = returns[0].split("[")[0]
        while True:
            name, at = self.text[i], i
            while self.text[i] not in (",", ";", ""):
                i = self.pair[i] + 1 if self.text[i] in OPEN or (self.text[i] == "<" and i in self.pair) else i + 1
            fields[name] = (None if returns[1] in own else returns[1], returns[2] + (self.text[at + 1] == "["))
            self._symbol("FIELD", name, f"{owner}.{name}", owner, at, i - 1, mods, f"{' '.join(mods)} {shown} {name}", shown, first)
            self.symbols[-1]["type_name"] = fields[name][0] if not fields[name][1] else None
            if self.text[i] != "," or not self.name(i + 1):
                return i + 1
            i += 1

    def _callable(self, i: int, first: int, mods: list[str], owner: str, returns: tuple | None, own: set[str], bodies: list, kind: str) -> int:
        """A method or constructor named at i; its body is kept for later, when all fields are known."""
        close = self.pair[i + 1]
        shown, raw, params, at = [], [], {}, i + 2
        while at < close:
            _, _, start = self._modifiers(at)
            name, dims, after = self._read_type(at)
            if self.text[after] != "this":  # a receiver parameter is none
                shown.append(self.show(start, after))
                raw.append(None if name in own else name + "[]" * dims)
                params[self.text[after]] = (None if name in own else name, dims)
            while after < close and self.text[after] != ",":
                after += 1
            at = after + 1
        body = close + 1
        while self.text[body] not in ("{", ";"):
            if body >= self.end:
                raise SyntaxError(f"no body of {self.text[i]}")
            body = self.pair[body] + 1 if self.text[body] in ("(", "[") or self.text[body - 1] == "default" and self.text[body] == "{" else body + 1
        last = self.pair[body] if self.text[body] == "{" else body
        if kind == "ANNOTATION":
            return last + 1
        name = self.text[i] if returns else "<init>"
        key = f"{owner}#{name}/{len(shown)}"
        self._symbol("METHOD" if returns else "CONSTRUCTOR", self.text[i], key, owner, first, last, mods, f"{' '.join(mods)} {returns[0] + ' ' if returns else ''}{name}({', '.join(shown)})", returns and returns[0], first)
        plain = returns and not returns[2] and returns[1] not in own
        self.symbols[-1] |= {"type_name": returns[1] if plain else None, "params": raw, "varargs": any(x.endswith("...") for x in shown[-1:])}
        if self.text[body] == "{":
            bodies.append((body, last, key, params, own))
        return last + 1


#: A value's type as far as one file shows it: ("type", name, dimensions), ("node", number), ("this",), ("super",) or None.
Value = tuple | None


class Body:
    """One walk over a callable's body, with a stack of scopes; its accesses become nodes of the outline."""

    def __init__(self, unit: Outline, owner: str, fields: dict, start: int, stop: int, key: str, params: dict, variables: set[str]):
        self.u, self.owner, self.key, self.fields, self.variables = unit, owner, key, fields, variables
        self.at: dict[int, int] = {}  # ( of an access -> its node
        self.begun: dict[int, int] = {}  # ( of an access -> first token of its expression
        self.made: dict[int, str] = {}  # ( of a creation -> the type
        #: (last token, names, enclosing types innermost first, methods of an anonymous class)
        self.scopes = [(stop, {n: ("type", t, d) if t else None for n, (t, d) in params.items()}, [f"={owner}"], frozenset())]
        self.local: set[str] = set()
        self.opening: dict[int, str] = {}  # { of a class body in here -> its supertype
        k = start
        while k <= stop:
            k = self._token(k)

    def _token(self, k: int) -> int:
        u, t = self.u, self.u.text[k]
        while k > self.scopes[-1][0]:
            self.scopes.pop()
        if t == "{" and u.kind[k] == "m":
            levels, own = self.scopes[-1][2], self.scopes[-1][3]
            if k in self.opening:
                levels, own = [f"~{self.opening[k]}", *levels], own | self._declared(k)
            self.scopes.append((u.pair[k], {}, levels, own))
        elif t == "@" and u.kind[k] == "m" and u.text[k + 1] != "interface":
            return max(k + 1, u._modifiers(k)[2])
        elif t in ("case", "instanceof") and u.kind[k] == "w":
            return self._pattern(k + 1)
        elif t == "new":
            self._creation(k)
        elif t == ")" and u.text[k + 1] == "->":
            for j in range(u.pair[k] + 1, k):
                if u.name(j) and u.text[j + 1] in (",", ")") and u.text[j - 1] in (",", "("):
                    self.scopes[-1][1][u.text[j]] = None
        elif t in TYPES and u._type_word(k) and u.text[k - 1] != ".":
            self._local_type(k)
            return k + 2
        elif u.name(k) or t in PRIMITIVE:
            if u.text[k + 1] == "->":
                self.scopes[-1][1][t] = None
            elif u.text[k + 1] == "(" and u.name(k):
                self._call(k)
            elif u.text[k - 1] not in (".", "::", "new"):
                self._variable(k)
        return k + 1

    def _pattern(self, k: int) -> int:
        """A type pattern declares a name; of a record pattern only the names inside are read."""
        found = self.u._read_type(k)
        if not found:
            return k
        raw, dims, after = found
        if self.u.text[after] == "(":
            if self.u.text[k - 1] == "case" or self.u.text[k - 1] == "instanceof":
                inner, close = after + 1, self.u.pair[after]
                while inner < close:
                    inner = max(inner + 1, self._pattern(inner))
                return close + 1
        elif self.u.name(after) and self.u.text[after] != "when":
            self.scopes[-1][1][self.u.text[after]] = ("type", raw, dims)
            return after + 1
        return after

    def _declared(self, k: int) -> frozenset:
        """name/arity of the methods of the class body at k."""
        u, out, j = self.u, set(), k + 1
        while j < u.pair[k]:
            if u.name(j) and u.text[j + 1] == "(" and u.text[u.pair[j + 1] + 1] in ("{", "throws"):
                out.add(f"{u.text[j]}/{self._arity(j + 1)}")
            j = u.pair[j] + 1 if u.text[j] in OPEN else j + 1
        return frozenset(out)

    def _local_type(self, k: int) -> None:
        u, parent = self.u, "Object"
        self.local.add(u.text[k + 1])
        j = k + 2
        while u.text[j] != "{" and j < u.end:
            if u.text[j] in ("extends", "implements") and (found := u._read_type(j + 1)):
                parent = found[0]
            j += 1
        self.opening[j] = parent

    def _variable(self, k: int) -> None:
        u = self.u
        found = u._read_type(k)
        if not found or not u.name(found[2]) or u.text[found[2] + 1] not in ("=", ";", ":", ",", ")", "[", "&", "|", "?"):
            return
        raw, dims, at = found
        value: Value = ("type", raw, dims) if raw not in self.variables | self.local else None
        if raw == "var":
            value = ("later", at + 2) if u.text[at + 1] == "=" else None
        self.scopes[-1][1][u.text[at]] = value
        while u.text[at + 1] in ("=", ",") and raw != "var" and u.text[k - 1] not in ("(", ","):  # further names of the statement
            at += 1
            while u.text[at] not in (",", ";", ""):
                at = u.pair[at] + 1 if u.text[at] in OPEN or (u.text[at] == "<" and at in u.pair) else at + 1
            if u.text[at] != "," or not u.name(at + 1):
                return
            at += 1
            self.scopes[-1][1][u.text[at]] = value

    def _arguments(self, k: int) -> list[tuple[int, int]]:
        u, close, out, start = self.u, self.u.pair[k], [], k + 1
        j = start
        while j < close:
            if u.text[j] == "," and u.kind[j] == "m":
                out.append((start, j))
                start = j + 1
            j = u.pair[j] + 1 if u.kind[j] == "m" and (u.text[j] in OPEN or u.text[j] == "<" and j in u.pair) else j + 1
        return [*out, (start, close)] if start < close else out

    def _arity(self, k: int) -> int:
        return len(self._arguments(k))

    def _node(self, k: int, base: Value, name: str, kind: str, args: list, raw: str) -> int:
        nodes = self.u.nodes
        levels = self.scopes[-1][2]
        how = {"type": "TYPE", "node": "NODE", "this": "THIS", "super": "SUPER", "lexical": "LEXICAL"}[base[0]] if base else ""
        if base and base[0] == "type" and base[2]:
            how, base = "ARRAY", None
        on = base[1] if how == "NODE" else None
        ref = base[1] if how == "TYPE" else None
        if ref in self.local or ref in self.variables:
            how, ref = "", None
        node = {"id": len(nodes), "caller_key": self.key, "owner": self.owner, "levels": levels, "base": how, "ref": ref, "on_node": on, "name": name, "arity": -1 if kind == "FIELD" else len(args), "args": args, "call_line": self.u.line(k), "call_kind": kind, "raw": clip(raw, 480), "depth": 0 if on is None else nodes[on]["depth"] + 1}
        nodes.append(node)
        return node["id"]

    def _kinds(self, k: int) -> list[str | None]:
        """The arguments' types where literals, names or creations show them."""
        out = []
        for i, j in self._arguments(k):
            t, kind = self.u.text[i], self.u.kind[i]
            value = self._receiver(j) if j - i == 1 and self.u.name(i) else None
            made = self.u._read_type(i + 1) if t == "new" else None
            if j - i == 1 and kind in "scn":
                out.append({"s": "String", "c": "char"}.get(kind) or ("long" if t[-1] in "lL" else "int" if re.fullmatch(r"0[xX]\w+|0[bB]\w+|\d[\d_]*", t) else "float" if t[-1] in "fF" else "double"))
            elif t in ("true", "false") and j - i == 1:
                out.append("boolean")
            elif made and self.u.text[made[2]] == "(" and (self.u.pair[made[2]] == j - 1 or self.u.text[self.u.pair[made[2]] + 1] == "{"):
                out.append(made[0])
            elif value and value[0] and value[0][0] == "type":
                out.append(value[0][1] + "[]" * value[0][2])
            else:
                out.append(None)
        return out

    def _creation(self, k: int) -> None:
        u = self.u
        found = u._read_type(k + 1)
        if not found or u.text[found[2]] != "(":
            return
        raw, _, at = found
        args = [None] * self._arity(at)  # what a constructor's key needs is their number
        self.made[at], self.begun[at] = raw, k
        self.at[at] = self._node(k, ("type", raw, 0), "<init>", "CONSTRUCTOR", args, f"{raw.rsplit('.', 1)[-1]}/{len(args)}")
        after = u.pair[at] + 1
        if u.text[after] == "{":
            self.opening[after] = raw

    def _call(self, k: int) -> None:
        u, before = self.u, self.u.text[k - 1]
        close = u.pair[k + 1]
        if k + 1 in self.at:
            return
        back = k - 1
        if before == ">" and back in u.pair:  # type arguments of the call
            back = u.pair[back] - 1
            before = u.text[back]
        if before != "." and (u.text[close + 1] in ("{", "throws") or back < k - 1 or u.name(k - 1) and before != "when" or before in PRIMITIVE or before == "]"):
            return self._parameters(k + 1)
        if u.text[k - 1] == "new" or (before == "." and self._created(k)):
            return None
        base: Value = ("lexical",)
        start, scope = k, ""
        if before == ".":
            base, start = self._receiver(back) or (None, back)
            scope = u.show(start, back)
        name, args = u.text[k], self._kinds(k + 1)
        if base == ("lexical",) and f"{name}/{len(args)}" in self.scopes[-1][3]:
            base = None  # a method of the anonymous class itself
        kind = "SUPER" if base == ("super",) else "METHOD"
        self.begun[k + 1] = start
        self.at[k + 1] = self._node(k, base, name, kind, args, f"{scope}#{name}/{len(args)}" if scope else f"{name}/{len(args)}")
        return None

    def _created(self, k: int) -> bool:
        """Whether the dotted name that ends at k is what `new` makes."""
        while self.u.text[k - 1] == "." and self.u.kind[k - 2] == "w":
            k -= 2
        return self.u.text[k - 1] == "new"

    def _parameters(self, k: int) -> None:
        """The parameters of a method that is declared in this body."""
        at, close = k + 1, self.u.pair[k]
        while at < close and (found := self.u._read_type(at)):
            if self.u.name(found[2]):
                self.scopes[-1][1][self.u.text[found[2]]] = ("type", *found[:2])
            at = found[2] + 2

    def _named(self, path: list[str], k: int) -> Value:
        """What a dotted name means: a variable, a field of an enclosing type, a type; else an inherited field."""
        value: Value = None
        for _, names, _, _ in reversed(self.scopes):
            if path[0] in names:
                value = names[path[0]]
                if value is None:
                    return None
                if value[0] == "later":
                    value = self._value(value[1])
                return self._along(value, path[1:], k)
        if path[0] in self.fields and len(self.scopes[-1][2]) == 1:
            kind, dims = self.fields[path[0]]
            return self._along(("type", kind, dims) if kind else None, path[1:], k)
        upper = [i for i, p in enumerate(path) if p[:1].isupper()]
        if upper and all(p.islower() for p in path[: upper[0]]) and (not upper[0] or path[0] not in self.fields):
            last = upper[0]
            while last + 1 < len(path) and path[last + 1][:1].isupper() and not path[last + 1].isupper():
                last += 1
            return self._along(("type", ".".join(path[: last + 1]), 0), path[last + 1 :], k)
        return self._along(("lexical",), path, k)

    def _along(self, value: Value, path: list[str], k: int) -> Value:
        for name in path:
            if value is None or value[0] == "type" and value[2]:
                return None
            value = ("node", self._node(k, value, name, "FIELD", [], name))
        return value

    def _value(self, start: int) -> Value:
        """The value of the expression that starts at a token, up to its semicolon."""
        u, j = self.u, start
        while j < u.end and u.text[j] not in (";", ","):
            j = u.pair[j] + 1 if u.kind[j] == "m" and (u.text[j] in OPEN or u.text[j] == "<" and j in u.pair) else j + 1
        found = self._receiver(j)
        return found[0] if found and found[1] == start else None

    def _receiver(self, end: int) -> tuple[Value, int] | None:
        """(value, first token) of the primary expression that ends before `end`."""
        u, t, k = self.u, self.u.text[end - 1], end - 1
        if u.kind[k] == "s":
            return ("type", "String", 0), k
        if t in (")", "}") and u.kind[k] == "m":
            m = u.pair[k]
            if t == "}":
                if u.text[m - 1] != ")":
                    return None
                m = u.pair[m - 1]
            if m in self.made:
                return ("type", self.made[m], 0), self.begun[m]
            if m in self.at:
                return ("node", self.at[m]), self.begun[m]
            if t == "}" or u.kind[m - 1] == "w" and u.text[m - 1] not in ("return", "case", "throw", "else", "assert", "yield"):
                return None
            if u.text[m + 1] == "(" and (cast := u._read_type(m + 2)) and cast[2] == u.pair[m + 1] and (u.kind[cast[2] + 1] != "m" or u.text[cast[2] + 1] == "("):
                return ("type", *cast[:2]), m
            inner = self._receiver(k)
            return (inner[0], m) if inner and inner[1] == m + 1 else (None, m)
        if t == "]" and u.kind[k] == "m":
            base = self._receiver(u.pair[k])
            if base and base[0] and base[0][0] == "type" and base[0][2]:
                return ("type", base[0][1], base[0][2] - 1), base[1]
            return (None, base[1]) if base else None
        if u.kind[k] != "w" or (t in KEYWORD and t not in ("this", "super", "class")):
            return None
        path = [t]
        while u.text[k - 1] == "." and u.kind[k - 2] == "w" and (u.text[k - 2] not in KEYWORD or u.text[k - 2] in ("this", "super")):
            k -= 2
            path.insert(0, u.text[k])
        if path[-1] in ("this", "super"):  # this, super, or Outer.this
            return (path[-1],) if len(path) == 1 else ("type", ".".join(path[:-1]), 0) if path[-1] == "this" else None, k
        if path[-1] == "class":
            return ("type", "Class", 0), k
        if path[0] in ("this", "super"):
            value = self._named(path[1:], k) if path[0] == "this" and path[1] in self.fields and len(self.scopes[-1][2]) == 1 and not any(path[1] in s[1] for s in self.scopes) else self._along((path[0],), path[1:], k)
            return value, k
        if u.text[k - 1] == ".":  # fields of an expression
            base = self._receiver(k - 1)
            return (self._along(base[0], path, k), base[1]) if base else None
        return self._named(path, k), k
