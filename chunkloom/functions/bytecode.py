"""Scripts: their records, instructions, a listing, and text again.

``text_of`` reads a handler's instructions as a stack machine and recovers blocks from jumps: a conditional jump whose
block ends in a jump back is a loop, one whose block ends in a jump forward has an else part.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from chunkloom.functions import properties
from chunkloom.functions.bytes import Truncated, mac_roman
from chunkloom.functions.records import float80

#: Fixed values of the format: names of operations by code. From 0x40 on a code stands for itself plus any multiple of 0x40, which widens its argument.
OPERATIONS = {
    0x01: "ret", 0x02: "retFactory", 0x03: "pushZero", 0x04: "mul", 0x05: "add", 0x06: "sub", 0x07: "div", 0x08: "mod",
    0x09: "inv", 0x0A: "joinStr", 0x0B: "joinPadStr", 0x0C: "lt", 0x0D: "ltEq", 0x0E: "ntEq", 0x0F: "eq", 0x10: "gt",
    0x11: "gtEq", 0x12: "and", 0x13: "or", 0x14: "not", 0x15: "containsStr", 0x16: "contains0Str", 0x17: "getChunk",
    0x18: "hiliteChunk", 0x19: "ontoSpr", 0x1A: "intoSpr", 0x1B: "getField", 0x1C: "startTell", 0x1D: "endTell",
    0x1E: "pushList", 0x1F: "pushPropList", 0x21: "swap", 0x26: "callJavaScript", 0x41: "pushInt8",
    0x42: "pushArgListNoRet", 0x43: "pushArgList", 0x44: "pushCons", 0x45: "pushSymb", 0x46: "pushVarRef",
    0x48: "getGlobal2", 0x49: "getGlobal", 0x4A: "getProp", 0x4B: "getParam", 0x4C: "getLocal", 0x4E: "setGlobal2",
    0x4F: "setGlobal", 0x50: "setProp", 0x51: "setParam", 0x52: "setLocal", 0x53: "jmp", 0x54: "endRepeat",
    0x55: "jmpIfZ", 0x56: "localCall", 0x57: "extCall", 0x58: "objCallV4", 0x59: "put", 0x5A: "putChunk",
    0x5B: "deleteChunk", 0x5C: "get", 0x5D: "set", 0x5F: "getMovieProp", 0x60: "setMovieProp", 0x61: "getObjProp",
    0x62: "setObjProp", 0x63: "tellCall", 0x64: "peek", 0x65: "pop", 0x66: "theBuiltin", 0x67: "objCall",
    0x6D: "pushChunkVarRef", 0x6E: "pushInt16", 0x6F: "pushInt32", 0x70: "getChainedProp", 0x71: "pushFloat32",
    0x72: "getTopLevelProp", 0x73: "newObj",
}
BINARY = {"mul": "*", "add": "+", "sub": "-", "div": "/", "mod": "mod", "joinStr": "&", "joinPadStr": "&&", "lt": "<", "ltEq": "<=", "ntEq": "<>", "eq": "=", "gt": ">", "gtEq": ">=", "and": "and", "or": "or", "containsStr": "contains", "contains0Str": "starts"}
LEVELS = {"*": 1, "/": 1, "mod": 1, "+": 2, "-": 2, "<": 3, "<=": 3, "<>": 3, "=": 3, ">": 3, ">=": 3, "and": 4, "or": 5}
TYPES = {1: "Score", 2: "Behavior", 3: "Movie Script", 7: "Parent"}
CHUNKS = ("char", "word", "item", "line")
PUTS = {1: "into", 2: "after", 3: "before"}
CONSTANTS = {"\x03": "ENTER", "\x08": "BACKSPACE", "\t": "TAB", "\r": "RETURN", '"': "QUOTE", "": "EMPTY"}


@dataclass
class Instruction:
    at: int
    op: str
    raw: int
    arg: int


@dataclass
class Handler:
    name_id: int
    start: int
    size: int
    args: list[int]
    locals: list[int]
    globals: list[int]
    lines: int
    code: list[Instruction] = field(default_factory=list)


@dataclass
class Script:
    number: int
    parent: int
    flags: int
    kind: str
    properties: list[int]
    globals: list[int]
    handlers: list[Handler]
    literals: list[tuple[int, object]]


def operation(raw: int) -> str:
    return OPERATIONS.get(0x40 + raw % 0x40 if raw >= 0x40 else raw, "invalid")


def instructions(code: bytes) -> list[Instruction]:
    """Decodes bytecode; an argument that isn't all there ends it."""
    out, at = [], 0
    while at < len(code):
        raw, op = code[at], operation(code[at])
        width = 0 if raw < 0x40 else 1 if raw < 0x80 else 2 if raw < 0xC0 else 4
        if at + 1 + width > len(code):
            break
        negative = width == 4 or op == "pushInt8" or width == 2 and op == "pushInt16"
        out.append(Instruction(at, op, raw, int.from_bytes(code[at + 1 : at + 1 + width], "big", signed=negative)))
        at += 1 + width
    return out


def script(data: bytes, wide: bool = True) -> Script:
    """A script chunk. Handler rows have 46 bytes, or 42 if not ``wide``."""
    if len(data) < 92:
        raise Truncated("a script of under 92 bytes")
    number, parent = struct.unpack_from(">H2xh", data, 18)
    (flags,) = struct.unpack_from(">I", data, 38)
    tables = [struct.unpack_from(">HI", data, 60 + 6 * i) for i in range(4)]
    (base,) = struct.unpack_from(">I", data, 88)

    def ids(count: int, at: int) -> list[int]:
        n = max(0, min(count, (len(data) - at) // 2))
        return list(struct.unpack_from(f">{n}h", data, at)) if n else []

    stride, handlers = (46 if wide else 42), []
    count, first = tables[2]
    for i in range(count if count < 10_000 else 0):
        at = first + stride * i
        if at + stride > len(data):
            break
        name, size, start = struct.unpack_from(">h2xII", data, at)
        parts = [ids(*struct.unpack_from(">HI", data, at + 12 + 6 * k)) for k in range(3)]
        (lines,) = struct.unpack_from(">H", data, at + 36)
        handlers.append(Handler(name, start, size, *parts, lines, instructions(data[start : start + size])))
    literals = []
    count, first = tables[3]
    for i in range(count if count < 100_000 else 0):
        if first + 8 * i + 8 > len(data):
            break
        literals.append(_literal(data, base, *struct.unpack_from(">iI", data, first + 8 * i)))
    return Script(number, parent, flags, TYPES.get(flags & 15 or number, "Unknown"), ids(*tables[0]), ids(*tables[1]), handlers, literals)


def _literal(data: bytes, base: int, kind: int, offset: int) -> tuple[int, object]:
    """(kind, value): 1 is text, 4 a number that is the offset itself, 9 a float; others are bytes."""
    if kind == 4:
        return kind, offset - (1 << 32) if offset >= 1 << 31 else offset
    at = base + offset
    if at + 4 > len(data):
        return kind, None
    size = int.from_bytes(data[at : at + 4], "big")
    body = data[at + 4 : at + 4 + size]
    if len(body) < size or size > 0x100000:
        return kind, None
    if kind == 1:
        return kind, mac_roman(body.removesuffix(b"\0"))
    if kind == 9:
        return kind, {4: lambda: struct.unpack(">f", body)[0], 8: lambda: struct.unpack(">d", body)[0], 10: lambda: float80(body)}.get(size, lambda: 0.0)()
    return kind, body


def number_text(value: float) -> str:
    """15 digits, with a point or an exponent."""
    out = f"{value:.15g}"
    return out if any(c in out for c in ".en") else f"{out}.0"


def listing(s: Script, names: list[str]) -> str:
    """Instructions by handler."""
    name = lambda i: names[i] if 0 <= i < len(names) else f"handler_{i}"
    out = []
    for h in s.handlers:
        out.append(f"on {name(h.name_id)}")
        out += [f"  {x.at:5d}: {x.op}" + (f" {x.arg}" if x.raw >= 0x40 else "") for x in h.code]
        out += ["end", ""]
    return "\n".join(out) + "\n" * bool(out)


# --- text -----------------------------------------------------------------------------------------------------------


@dataclass
class Expr:
    text: str
    level: int = 0  # of its outermost operator; 0 binds closest
    items: list | None = None  # of an argument list
    silent: bool = False  # a call of these arguments is a statement
    value: object = None  # of a literal


class Writer:
    """Text of one script's handlers."""

    def __init__(self, s: Script, names: list[str], version: int = 1000, wide: bool = True):
        self.script, self.names, self.version, self.dots = s, names, version, version >= 700
        # variables and literals are counted in bytes where handler rows are narrow
        self.step = 1 if wide else 8 if version >= 500 else 6

    def name(self, i: int) -> str:
        return self.names[i] if 0 <= i < len(self.names) else f"#{i}"

    def all(self) -> str:
        head = [f"property {', '.join(map(self.name, self.script.properties))}"] if self.script.properties else []
        head += [f"global {', '.join(map(self.name, self.script.globals))}"] if self.script.globals else []
        parts = ["\n".join(head)] * bool(head) + ["\n".join(self.handler(h)) for h in self.script.handlers]
        return "\n\n".join(parts) + "\n" * bool(parts)

    def handler(self, h: Handler) -> list[str]:
        self.own, self.code = h, h.code
        self.index = {x.at: i for i, x in enumerate(h.code)}
        end = len(h.code)
        if end and h.code[-1].op in ("ret", "retFactory"):
            end -= 1
        args = ", ".join(map(self.name, h.args))
        body = [f"  {x}" for x in self.block(0, end, [], None)]
        shared = [f"  global {', '.join(map(self.name, h.globals))}"] if h.globals else []
        return [f"on {self.name(h.name_id)}{' ' * bool(args)}{args}", *shared, *body, "end"]

    def at(self, address: int) -> int:
        """Index of the instruction at an address, or past the last."""
        return self.index.get(address, len(self.code))

    def block(self, low: int, high: int, stack: list[Expr], loop: tuple[int, int] | None) -> list[str]:
        """Statements of a range of instructions. ``loop``: where the loop around it goes on, and where it ends."""
        out: list[str] = []
        i = low
        while i < high:
            x = self.code[i]
            if x.op == "jmpIfZ":
                i = self.branch(i, high, stack, loop, out)
            elif x.op == "jmp":
                target = self.at(x.at + x.arg)
                if loop and target == loop[1]:
                    out.append("exit repeat")
                elif loop and target == loop[0]:
                    out.append("next repeat")
                i += 1
            elif x.op == "peek" and (n := self.cases(i, high, stack, loop, out)):
                i = n
            else:
                self.step_of(x, stack, out)
                i += 1
        return out

    def branch(self, i: int, high: int, stack: list[Expr], loop, out: list[str]) -> int:
        """A loop or an if; returns where to go on."""
        x = self.code[i]
        end = min(self.at(x.at + x.arg), high)
        test = self.pop(stack)
        last = self.code[end - 1] if end - 1 > i else None
        if last and last.op == "endRepeat" and self.at(last.at - last.arg) <= i:
            out += self.loop(i, end, test, stack, out)
            return end
        other, stop = [], end
        if last and last.op == "jmp" and (goal := self.at(last.at + last.arg)) > end - 1 and not (loop and goal in loop) and goal <= high:
            yes, stop = self.block(i + 1, end - 1, stack, loop), goal
            other = self.block(end, goal, stack, loop)
        else:
            yes = self.block(i + 1, end, stack, loop)
        out.append(f"if {test.text} then")
        out += [f"  {s}" for s in yes]
        if other:
            out += ["else", *(f"  {s}" for s in other)]
        out.append("end if")
        return stop

    def loop(self, i: int, end: int, test: Expr, stack: list[Expr], before: list[str]) -> list[str]:
        """Of a loop that tests at i and ends before ``end``. Counting ones are told by what surrounds them."""
        start = self.at(self.code[end - 1].at - self.code[end - 1].arg)
        counts = self._counts(i, end, start)
        if counts:
            name, down, first_body, again = counts
            limit = test.value[1] if isinstance(test.value, tuple) else test.text
            from_ = before.pop().split(" = ", 1)[1] if before and before[-1].startswith(f"{name} = ") else "?"
            body = self.block(first_body, again, stack, (again, end))
            return [f"repeat with {name} = {from_}{' down' * down} to {limit}", *(f"  {s}" for s in body), "end repeat"]
        each = self._each(i, end, stack)
        if each:
            name, whole = each
            body = self.block(i + 7, end - 3, stack, (end - 3, end))
            return [f"repeat with {name} in {whole.text}", *(f"  {s}" for s in body), "end repeat"]
        body = self.block(i + 1, end - 1, stack, (start, end))
        return [f"repeat while {test.text}", *(f"  {s}" for s in body), "end repeat"]

    GETS = {"setLocal": "getLocal", "setParam": "getParam", "setGlobal": "getGlobal", "setGlobal2": "getGlobal2", "setProp": "getProp"}

    def _counts(self, i: int, end: int, start: int):
        """(variable, whether down, body, step) of a counting loop."""
        again = end - 5  # push step, get, add, set, back
        if again <= i or self.code[i - 1].op not in ("ltEq", "gtEq"):
            return None
        step, get, add, put = self.code[again : again + 4]
        down = self.code[i - 1].op == "gtEq"
        if step.op != "pushInt8" or step.arg != (-1 if down else 1) or add.op != "add" or self.GETS.get(put.op) != get.op or get.arg != put.arg:
            return None
        if start < 1 or (self.code[start].op, self.code[start].arg) != (get.op, get.arg) or (self.code[start - 1].op, self.code[start - 1].arg) != (put.op, put.arg):
            return None
        return self.variable(get), down, i + 1, again

    def _each(self, i: int, end: int, stack: list[Expr]):
        """(variable, list) of a loop over a list, whose list, length and place stay on the stack."""
        ops = [x.op for x in self.code[i + 1 : i + 6]]
        if ops != ["peek", "peek", "pushArgList", "extCall", ops[-1] if ops else ""] or not ops or ops[-1] not in self.GETS or len(stack) < 3:
            return None
        put = self.code[i + 5]
        whole = stack[-3]
        return self.variable(Instruction(0, self.GETS[put.op], 0, put.arg)), whole

    def cases(self, i: int, high: int, stack: list[Expr], loop, out: list[str]) -> int | None:
        """A chain of tests of one value; returns where it ends, or None if this isn't one."""
        if not stack or self.code[i].arg != 0:
            return None
        lines, at, finish = [], i, None
        subject = stack[-1].text
        while at < high and self.code[at].op == "peek":
            test = next((k for k in range(at + 1, high) if self.code[k].op in ("eq", "ntEq")), None)
            if test is None or test + 1 >= high or self.code[test + 1].op != "jmpIfZ":
                return None
            inner: list[Expr] = []
            for x in self.code[at + 1 : test]:
                self.step_of(x, inner, [])
            jump = self.code[test + 1]
            following = self.at(jump.at + jump.arg)
            body_end = following
            if following - 1 > test + 1 and self.code[following - 1].op == "jmp":
                finish = max(finish or 0, self.at(self.code[following - 1].at + self.code[following - 1].arg))
                body_end -= 1
            first = test + 2 + (self.code[test + 2].op == "pop" if test + 2 < high else 0)
            body = self.block(first, body_end, stack[:-1], loop)
            lines += [f"  {inner[-1].text if inner else '?'}:", *(f"    {s}" for s in body)]
            at = following
        finish = min(finish or at, high)
        rest = at + (at < finish and self.code[at].op == "pop")
        other = self.block(rest, finish, stack[:-1], loop)
        if other:
            lines += ["  otherwise:", *(f"    {s}" for s in other)]
        stack.pop()
        out += [f"case {subject} of", *lines, "end case"]
        return max(finish, rest)

    # --- one instruction ---

    @staticmethod
    def pop(stack: list[Expr]) -> Expr:
        return stack.pop() if stack else Expr("VOID")

    def variable(self, x: Instruction) -> str:
        if x.op in ("getParam", "getLocal"):
            table, at = (self.own.args if x.op == "getParam" else self.own.locals), x.arg // self.step
            return self.name(table[at]) if at < len(table) else f"{'arg' if x.op == 'getParam' else 'local'}_{at}"
        return self.name(x.arg)

    def literal(self, at: int) -> Expr:
        kind, value = self.script.literals[at] if 0 <= at < len(self.script.literals) else (0, None)
        if kind == 1:
            text = CONSTANTS.get(value) or f'"{value}"'
            return Expr(text, 0, None, False, value)
        if kind == 9:
            return Expr(number_text(value), 0, None, False, value)
        return Expr(str(value) if kind == 4 else "VOID", 0, None, False, value)

    @staticmethod
    def within(e: Expr, level: int, right: bool = False) -> str:
        return f"({e.text})" if e.level > level or right and e.level == level and level else e.text

    def step_of(self, x: Instruction, stack: list[Expr], out: list[str]) -> None:
        act = getattr(self, f"do_{x.op}", None)
        if x.op in BINARY:
            right, left = self.pop(stack), self.pop(stack)
            sign = BINARY[x.op]
            level = LEVELS.get(sign, 3)
            stack.append(Expr(f"{self.within(left, level)} {sign} {self.within(right, level, True)}", level, None, False, (left.text, right.text)))
        elif act:
            act(x, stack, out)
        elif x.op in ("getGlobal", "getGlobal2", "getProp", "getParam", "getLocal"):
            stack.append(Expr(self.variable(x)))
        elif x.op in self.GETS:
            out.append(self._assigned(self.variable(Instruction(0, self.GETS[x.op], 0, x.arg)), self.pop(stack).text))
        elif x.op in ("pushInt8", "pushInt16", "pushInt32"):
            stack.append(Expr(str(x.arg), 0, None, False, x.arg))
        else:
            out.append(f"-- {x.op}{f' {x.arg}' if x.raw >= 0x40 else ''}")
            stack.clear()

    def do_pushZero(self, x, stack, out):
        stack.append(Expr("0", 0, None, False, 0))

    def do_pushFloat32(self, x, stack, out):
        stack.append(Expr(number_text(struct.unpack(">f", struct.pack(">I", x.arg & 0xFFFFFFFF))[0])))

    def do_pushCons(self, x, stack, out):
        stack.append(self.literal(x.arg // self.step))

    def do_pushSymb(self, x, stack, out):
        stack.append(Expr(f"#{self.name(x.arg)}"))

    def do_pushVarRef(self, x, stack, out):
        stack.append(Expr(self.name(x.arg)))

    def do_inv(self, x, stack, out):
        stack.append(Expr(f"-{self.within(self.pop(stack), 0)}", 1))

    def do_not(self, x, stack, out):
        stack.append(Expr(f"not {self.within(self.pop(stack), 0)}", 4))

    def do_ret(self, x, stack, out):
        out.append("exit")

    do_retFactory = do_ret

    def _list(self, x, stack, silent):
        n = max(0, min(x.arg, len(stack)))
        items = stack[len(stack) - n :]
        del stack[len(stack) - n :]
        stack.append(Expr(", ".join(e.text for e in items), 0, items, silent))

    def do_pushArgList(self, x, stack, out):
        self._list(x, stack, False)

    def do_pushArgListNoRet(self, x, stack, out):
        self._list(x, stack, True)

    def do_pushList(self, x, stack, out):
        stack.append(Expr(f"[{self.pop(stack).text}]"))

    def do_pushPropList(self, x, stack, out):
        items = self.pop(stack).items or []
        pairs = [f"{k.text}: {v.text}" for k, v in zip(items[::2], items[1::2], strict=False)]
        stack.append(Expr(f"[{', '.join(pairs) or ':'}]"))

    def _call(self, name: str, args: Expr, stack, out):
        if name == "return" and args.items is not None:
            out.append(f"return {args.items[-1].text}" if args.items else "return")
        elif args.silent:
            out.append(f"{name} {args.text}".rstrip() if name in ("put", "return", "go", "pass", "nothing", "updateStage") else f"{name}({args.text})")
        else:
            stack.append(Expr(f"{name}({args.text})"))

    def do_extCall(self, x, stack, out):
        self._call(self.name(x.arg), self.pop(stack), stack, out)

    do_tellCall = do_extCall

    def do_localCall(self, x, stack, out):
        own = self.script.handlers
        self._call(self.name(own[x.arg].name_id) if x.arg < len(own) else f"handler_{x.arg}", self.pop(stack), stack, out)

    def do_objCall(self, x, stack, out):
        args, name = self.pop(stack), self.name(x.arg)
        items = args.items or []
        rest = ", ".join(e.text for e in items[1:])
        of = self.within(items[0], 0) if items else "VOID"
        known = {
            ("getAt", 2): f"{of}[{rest}]",
            ("getProp", 2): f"{of}.{items[1].text.lstrip('#')}" if len(items) > 1 else "",
            ("getPropRef", 2): f"{of}.{items[1].text.lstrip('#')}" if len(items) > 1 else "",
            ("setAt", 3): f"{of}[{items[1].text}] = {items[2].text}" if len(items) > 2 else "",
            ("setProp", 3): f"{of}.{items[1].text.lstrip('#')} = {items[2].text}" if len(items) > 2 else "",
            ("count", 2): f"{of}.{items[1].text.lstrip('#')}.count" if len(items) > 1 else "",
        }.get((name, len(items)))
        if known and not (args.silent and name not in ("setAt", "setProp")):
            (out.append if name in ("setAt", "setProp") else lambda t: stack.append(Expr(t)))(known)
        elif args.silent:
            out.append(f"{of}.{name}({rest})")
        else:
            stack.append(Expr(f"{of}.{name}({rest})"))

    def do_objCallV4(self, x, stack, out):
        of, args = self.pop(stack), self.pop(stack)
        self._call(of.text, args, stack, out)

    def do_newObj(self, x, stack, out):
        stack.append(Expr(f"new {self.name(x.arg)}({self.pop(stack).text})"))

    def do_getMovieProp(self, x, stack, out):
        stack.append(Expr(f"the {self.name(x.arg)}"))

    def do_setMovieProp(self, x, stack, out):
        out.append(self._assigned(f"the {self.name(x.arg)}", self.pop(stack).text))

    def do_theBuiltin(self, x, stack, out):
        self.pop(stack)
        stack.append(Expr(f"the {self.name(x.arg)}"))

    def _of(self, of: Expr, name: str) -> str:
        return f"{self.within(of, 0)}.{name}" if self.dots else f"the {name} of {self.within(of, 0)}"

    def do_getObjProp(self, x, stack, out):
        stack.append(Expr(self._of(self.pop(stack), self.name(x.arg))))

    do_getChainedProp = do_getObjProp

    def do_setObjProp(self, x, stack, out):
        value, of = self.pop(stack), self.pop(stack)
        out.append(self._assigned(self._of(of, self.name(x.arg)), value.text))

    def do_getTopLevelProp(self, x, stack, out):
        stack.append(Expr(self.name(x.arg)))

    def do_getField(self, x, stack, out):
        stack.append(Expr(f"field {self.pop(stack).text}"))

    def do_ontoSpr(self, x, stack, out):
        b, a = self.pop(stack), self.pop(stack)
        stack.append(Expr(f"sprite {a.text} intersects {b.text}", 3))

    def do_intoSpr(self, x, stack, out):
        b, a = self.pop(stack), self.pop(stack)
        stack.append(Expr(f"sprite {a.text} within {b.text}", 3))

    def _chunk(self, stack, of: str) -> str:
        """References to parts of a text: first and last line, item, word and char, where first isn't 0."""
        bounds = [self.pop(stack) for _ in range(8)][::-1]
        for kind, (a, b) in zip(reversed(CHUNKS), [(bounds[6 - 2 * k], bounds[7 - 2 * k]) for k in range(4)], strict=True):
            if a.text != "0":
                of = f"{kind} {a.text}{'' if b.text == '0' else f' to {b.text}'} of {of}"
        return of

    def do_getChunk(self, x, stack, out):
        of = self.pop(stack).text
        stack.append(Expr(self._chunk(stack, of)))

    def _assigned(self, target: str, value: str, old: bool = False) -> str:
        return f"set {target} to {value}" if old or not self.dots else f"{target} = {value}"

    def _member(self, kind: str, number: Expr, library: Expr | None, dots: bool) -> str:
        if library is not None and library.value != 0:
            return f"{kind}({number.text}, {library.text})"
        return f"{kind}({number.text})" if dots else f"{kind} {self.within(number, 0)}"

    def _target(self, kind: int, stack) -> str:
        """What a text is put into: a variable by name or by its place, or a field."""
        library = self.pop(stack) if kind == 6 and self.version >= 500 else None
        at = self.pop(stack)
        if kind in (4, 5):
            place = at.value if isinstance(at.value, int) else 0
            return self.variable(Instruction(0, "getParam" if kind == 4 else "getLocal", 0, place))
        return self._member("field", at, library, False) if kind == 6 else at.text

    def do_pushChunkVarRef(self, x, stack, out):
        stack.append(Expr(self._target(x.arg, stack)))

    def do_hiliteChunk(self, x, stack, out):
        library = self.pop(stack) if self.version >= 500 else None
        out.append(f"hilite {self._chunk(stack, self._member('field', self.pop(stack), library, False))}")

    def do_put(self, x, stack, out):
        target = self._target(x.arg & 15, stack)
        out.append(f"put {self.pop(stack).text} {PUTS.get(x.arg >> 4 & 15, 'into')} {target}")

    def do_putChunk(self, x, stack, out):
        target = self._chunk(stack, self._target(x.arg & 15, stack))
        out.append(f"put {self.pop(stack).text} {PUTS.get(x.arg >> 4 & 15, 'into')} {target}")

    def do_deleteChunk(self, x, stack, out):
        out.append(f"delete {self._chunk(stack, self._target(x.arg, stack))}")

    def _numbered(self, kind: int, number: int, stack) -> str | None:
        """The property that old versions name by two numbers; None if there is no such kind."""
        part = lambda i: CHUNKS[i - 1] if 0 < i <= len(CHUNKS) else "ERROR"
        named, of = properties.named, lambda: self.pop(stack).text
        if kind == 0:
            return f"the {named(properties.MOVIE, number)}" if number < 12 else f"the last {part(number - 11)} in {of()}"
        if kind == 1:
            return f"the number of {part(number)}s in {of()}"
        if kind == 3:
            menu = of()
            return f"the {named(properties.MENU_ITEM, number)} of menuItem {of()} of menu {menu}"
        if kind in (2, 4, 6):
            table, what = {2: (properties.MENU, "menu"), 4: (properties.SOUND, "sound"), 6: (properties.SPRITE, "sprite")}[kind]
            return f"the {named(table, number)} of {what} {of()}"
        if kind == 7:
            return f"the {named(properties.ANIMATION, number)}"
        if kind == 8:
            name = named(properties.COUNTS, number)
            library = self.pop(stack) if number == 2 and self.version >= 500 else None
            return f"the {name}" if library is None or library.value == 0 else f"the {name} of {self._member('castLib', library, None, False)}"
        if 9 <= kind <= 0x15:
            library = self.pop(stack) if self.version >= 500 else None
            what = {0x0B: "field", 0x0C: "field", 0x14: "script", 0x15: "script"}.get(kind, "member" if library is not None else "cast")
            target = self._member(what, self.pop(stack), library, False)
            if kind in (0x0A, 0x0C, 0x15):
                target = self._chunk(stack, target)
            return f"the {named(properties.MEMBER, number)} of {target}"
        return None

    @staticmethod
    def _number(e: Expr) -> int:
        return e.value if isinstance(e.value, int) else 0

    def do_get(self, x, stack, out):
        found = self._numbered(x.arg, self._number(self.pop(stack)), stack)
        if found is None:
            out.append(f"-- ERROR: {'Resource property' if x.arg == 5 else f'Unknown property type {x.arg}'}")
        else:
            stack.append(Expr(found))

    def do_set(self, x, stack, out):
        number, value = self._number(self.pop(stack)), self.pop(stack)
        said = value.value if isinstance(value.value, str) else ""
        if x.arg == 0 and 1 <= number <= 5 and (said.startswith(" ") or "\r" in said):
            lines = [line.lstrip() for line in said.split("\r")]
            while lines and not lines[-1]:
                lines.pop()
            out.append(f"when {properties.named(properties.EVENTS, number)} then " + "\n  ".join(lines))
            return
        found = self._numbered(x.arg, number, stack)
        if found is None:
            out.append(f"-- ERROR: {'Resource property' if x.arg == 5 else f'Unknown property type {x.arg}'}")
        else:
            out.append(self._assigned(found, value.text, True))

    def do_startTell(self, x, stack, out):
        out.append(f"tell {self.pop(stack).text}")

    def do_endTell(self, x, stack, out):
        out.append("end tell")

    def do_swap(self, x, stack, out):
        if len(stack) > 1:
            stack[-1], stack[-2] = stack[-2], stack[-1]

    def do_peek(self, x, stack, out):
        stack.append(stack[-1 - x.arg] if x.arg < len(stack) else Expr("VOID"))

    def do_pop(self, x, stack, out):
        del stack[max(0, len(stack) - x.arg) :]

    def do_endRepeat(self, x, stack, out):
        pass

    def do_callJavaScript(self, x, stack, out):
        first = next((v for k, v in self.script.literals if k == 1), "")
        out.append(f"-- JavaScript: {first}")


def text_of(s: Script, names: list[str], version: int = 1000, wide: bool = True) -> str:
    return Writer(s, names, version, wide).all()
