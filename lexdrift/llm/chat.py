"""Chat formatting with a small template language.

A template is text with ``{{ expression }}``, ``{% for x in expression %}``, ``{% if expression %}`` /
``{% elif %}`` / ``{% else %}``, and ``{% generation %}`` around what a model is to learn; ``for``, ``if`` and
``generation`` end with ``{% end... %}``; a ``-`` next to a mark trims white space there. Expressions have literals, names, ``x.key``, ``x[...]``, comparisons,
``and or not``, ``+`` and filters ``| name``. Nothing else can be reached from a template: names are looked
up in the given values, keys in dictionaries and lists, filters in a fixed table.

``compile_template`` parses it into a syntax tree, folds what is constant and makes a closure of each
node; rendering gives the text and the spans under the generation marks. Whatever is wrong with a template, or with
what it makes of its values, is a :class:`TemplateError`, and so is nesting beyond ``NESTED`` levels (a sum or comparison
of n terms has n).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks that open control strings; each is followed by the escape mark inside texts.
ESCAPED = "\\<["


def escape(text: Any) -> str:
    """Reversible; the result holds no control string that begins with ``<`` or ``[``."""
    return re.sub(r"([\\<\[])", r"\1\\", str(text))


def unescape(text: str) -> str:
    return re.sub(r"([\\<\[])\\", r"\1", text)


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": escape,
    "trim": lambda x: str(x).strip(),
    "upper": lambda x: str(x).upper(),
    "lower": lambda x: str(x).lower(),
    "length": len,
}


#: Levels of brackets, of blocks, and of the syntax tree of one expression, at most.
NESTED = 60


class TemplateError(ValueError):
    pass


def nested(level: int) -> int:
    """The next level, if there may be one."""
    if level >= NESTED:
        raise TemplateError("nested too deeply")
    return level + 1


# --- parsing: nodes are tuples (kind, ...) ---------------------------------------------------------

# What is between the marks ends at the first end mark outside of quotes; a ``-`` at a mark trims the text on that side.
_BODY = r"""((?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|(?!-?%s).)*)"""
_PART = re.compile(r"\{\{(-?)" + _BODY % r"\}\}" + r"(-?)\}\}|\{%(-?)" + _BODY % r"%\}" + r"(-?)%\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(\d+)|("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+<>|.()\[\]]))""")
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}


class Expression:
    """Recursive descent over one expression."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append(("number", m[1]) if m[1] else ("text", m[2]) if m[2] else ("name", m[3]) if m[3] else ("mark", m[4]))
            at = m.end()
        self.at, self.level = 0, 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "text" else None

    def accept(self, *marks: str) -> str | None:
        if (mark := self.peek()) in marks and mark is not None:
            self.at += 1
            return mark
        return None

    def expect(self, mark: str) -> None:
        if not self.accept(mark):
            raise TemplateError(f"{mark} expected")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name expected")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> tuple:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]}")
        held = [(node, 0)]
        while held:
            part, level = held.pop()
            held += [(x, nested(level)) for x in part if isinstance(x, tuple)]
        return node

    def either(self) -> tuple:
        self.level = nested(self.level)
        node = self.both()
        while self.accept("or"):
            node = ("or", node, self.both())
        self.level -= 1
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.accept("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        times = 0
        while self.accept("not"):
            times += 1
        node = self.compared()
        for _ in range(times):
            node = ("not", node)
        return node

    def compared(self) -> tuple:
        node = self.added()
        while mark := self.accept("==", "!=", "<=", ">=", "<", ">", "in"):
            node = ("compare", mark, node, self.added())
        return node

    def added(self) -> tuple:
        node = self.filtered()
        while self.accept("+"):
            node = ("add", node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.primary()
        while self.accept("|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name}")
            node = ("filter", name, node)
        return node

    def primary(self) -> tuple:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression expected")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            if len(value) > 1000:
                raise TemplateError("a number is too long")
            node: tuple = ("const", int(value))
        elif kind == "text":
            node = ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), value[1:-1]))
        elif value == "(":
            node = self.either()
            self.expect(")")
        elif value in ("true", "false", "none"):
            node = ("const", {"true": True, "false": False, "none": None}[value])
        elif kind == "name":
            node = ("name", value)
        else:
            raise TemplateError(f"unexpected {value}")
        while mark := self.accept(".", "["):
            if mark == ".":
                node = ("item", node, ("const", self.name()))
            else:
                node = ("item", node, self.either())
                self.expect("]")
        return node


def parse(source: str) -> tuple:
    """The syntax tree of a template: ("block", nodes)."""
    parts: list[tuple[str, str]] = []
    at, trim = 0, False

    def text(until: int, cut: bool) -> None:
        found = source[at:until]
        found = found.lstrip() if trim else found
        found = found.rstrip() if cut else found
        if "{{" in found or "{%" in found:
            raise TemplateError(f"a mark isn't closed in {found[:40]!r}")
        if found:
            parts.append(("text", found))

    for m in _PART.finditer(source):
        before, show, after = m.group(1, 2, 3) if m[2] is not None else (m[4], None, m[6])
        text(m.start(), bool(before))
        parts.append(("show", show) if show is not None else ("tag", m[5].strip()))
        at, trim = m.end(), bool(after)
    text(len(source), False)
    parts.reverse()

    def block(level: int, *ends: str) -> tuple[tuple, str]:
        nodes: list[tuple] = []
        while parts:
            kind, body = parts.pop()
            if kind == "text":
                nodes.append(("const", body))
            elif kind == "show":
                nodes.append(("show", Expression(body).whole()))
            else:
                word, _, rest = body.partition(" ")
                if word in ends:
                    return ("block", nodes), body
                if word == "for":
                    m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.*)", rest, re.S)
                    if not m:
                        raise TemplateError(f"can't read {body!r}")
                    inner, _ = block(nested(level), "endfor")
                    nodes.append(("for", m[1], Expression(m[2]).whole(), inner))
                elif word == "if":
                    nodes.append(branch(nested(level), rest))
                elif word == "generation":
                    inner, _ = block(nested(level), "endgeneration")
                    nodes.append(("generation", inner))
                else:
                    raise TemplateError(f"unexpected tag {body!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return ("block", nodes), ""

    def branch(level: int, condition: str) -> tuple:
        yes, tag = block(level, "elif", "else", "endif")
        no: tuple = ("block", [])
        if tag.startswith("elif"):
            no = branch(nested(level), tag[4:])
        elif tag == "else":
            no, _ = block(level, "endif")
        return ("if", Expression(condition).whole(), yes, no)

    return block(0)[0]


# --- folding -----------------------------------------------------------------------------------------


def fold(node: tuple) -> tuple:
    """The tree with constant parts computed, constant branches taken and neighbouring texts joined."""
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind == "block":
        nodes: list[tuple] = []
        for x in map(fold, node[1]):
            for y in x[1] if x[0] == "block" else [x]:
                if y[0] == "const" and nodes and nodes[-1][0] == "const":
                    nodes[-1] = ("const", nodes[-1][1] + y[1])
                elif y != ("const", ""):
                    nodes.append(y)
        return ("block", nodes)
    if kind == "for":
        return ("for", node[1], fold(node[2]), fold(node[3]))
    folded = tuple(fold(x) if isinstance(x, tuple) else x for x in node)
    if kind == "show":
        return ("const", shown(folded[1][1])) if folded[1][0] == "const" else folded
    if kind == "if":
        return (folded[2] if folded[1][1] else folded[3]) if folded[1][0] == "const" else folded
    if kind == "generation":
        return folded
    if all(x[0] == "const" for x in folded[1:] if isinstance(x, tuple)):
        try:
            return ("const", evaluator(folded)({}))
        except TypeError as e:
            raise TemplateError(f"not valid: {e}") from e
    return folded


# --- closures ----------------------------------------------------------------------------------------

_COMPARE: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b,
}


def shown(value: Any) -> str:
    return "" if value is None else str(value)


def item(value: Any, key: Any) -> Any:
    if isinstance(value, dict):
        return value.get(key)
    if isinstance(value, list) and isinstance(key, int):
        return value[key] if -len(value) <= key < len(value) else None
    return None


def evaluator(node: tuple) -> Callable[[dict], Any]:
    kind = node[0]
    if kind == "const":
        return lambda env, value=node[1]: value
    if kind == "name":
        return lambda env, name=node[1]: env.get(name)
    if kind == "compare":
        return lambda env, f=_COMPARE[node[1]], a=evaluator(node[2]), b=evaluator(node[3]): f(a(env), b(env))
    if kind == "filter":
        return lambda env, f=FILTERS[node[1]], a=evaluator(node[2]): f(a(env))
    if kind == "not":
        return lambda env, a=evaluator(node[1]): not a(env)
    a, b = evaluator(node[1]), evaluator(node[2])
    if kind == "item":
        return lambda env: item(a(env), b(env))
    if kind == "add":
        return lambda env: a(env) + b(env)
    if kind == "and":
        return lambda env: a(env) and b(env)
    return lambda env: a(env) or b(env)


class Output:
    """Text in parts, and the spans of code points under generation marks."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.at = 0
        self.spans: list[tuple[int, int]] = []

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.at += len(text)


def writer(node: tuple) -> Callable[[dict, Output], None]:
    kind = node[0]
    if kind == "block":
        steps = [writer(x) for x in node[1]]

        def several(env: dict, out: Output) -> None:
            for step in steps:
                step(env, out)

        return several
    if kind == "const":
        return lambda env, out, text=node[1]: out.add(text)
    if kind == "show":
        return lambda env, out, value=evaluator(node[1]): out.add(shown(value(env)))
    if kind == "if":
        test, yes, no = evaluator(node[1]), writer(node[2]), writer(node[3])
        return lambda env, out: (yes if test(env) else no)(env, out)
    if kind == "generation":
        inner = writer(node[1])

        def marked(env: dict, out: Output) -> None:
            start = out.at
            inner(env, out)
            out.spans.append((start, out.at))

        return marked
    _, name, items, body = node
    values, step = evaluator(items), writer(body)

    def loop(env: dict, out: Output) -> None:
        held = list(values(env) or [])
        for i, value in enumerate(held):
            step(env | {name: value, "loop": {"index0": i, "index": i + 1, "first": i == 0, "last": i == len(held) - 1}}, out)

    return loop


def compile_template(source: str) -> Callable[..., tuple[str, list[tuple[int, int]]]]:
    """A function of the template's values that gives the text and the generation spans.

    Names and keys without a value are none, which shows as nothing and has no items. Values that an operation isn't
    defined for (a text and a number added, the length of none) are a :class:`TemplateError` when rendered.
    """
    write = writer(fold(parse(source)))

    def render(**values: Any) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        try:
            write(values, out)
        except TypeError as e:
            raise TemplateError(f"not valid: {e}") from e
        return "".join(out.parts), out.spans

    return render


# --- conversations -----------------------------------------------------------------------------------

#: Control strings of this template begin with ``<`` or ``[``, which texts hold in escaped form only.
TEMPLATE = (
    "<s>{% for m in messages %}<|turn|>{{ m.role | escape }}<|text|>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}<|end|>{% endfor %}</s>"
)
_TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a conversation from its formatted text."""
    if not (formatted.startswith("<s>") and formatted.endswith("</s>")):
        raise ValueError("not a formatted conversation")
    return [(unescape(a), unescape(b)) for a, b in _TURN.findall(formatted)]


def format_conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """A row for each conversation of ``turns`` (conv_id, turn, role, text): conv_id, formatted, spans.

    Turns are in order of turn (null first), then role and text; equal rows stay. Null role and text are empty; turns
    without conv_id are one conversation. spans are the code points of ``formatted`` under the
    generation marks. No turns give no rows; other columns are ignored. Turns are sorted within
    partitions and read as a stream; a task holds one conversation at a time, which is one value.
    """
    compile_template(template)  # an error shows on the driver
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", empty("role"), empty("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        done: list[dict] = []
        size = 0
        current: Any = work  # no conversation yet
        messages: list[dict] = []

        def close() -> None:
            nonlocal size
            text, spans = render(messages=messages)
            done.append({"conv_id": current, "formatted": text, "spans": [{"start": a, "end": b} for a, b in spans]})
            size += len(text)

        for batch in batches:
            for name, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if name != current:
                    if messages:
                        close()
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(done, schema=kinds)
                            done, size = [], 0
                    current, messages = name, []
                messages.append({"role": role, "text": text})
        if messages:
            close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=kinds)

    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    kinds = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(span))])
    return (
        rows.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .mapInArrow(work, "conv_id long, formatted string, spans array<struct<start: long, end: long>>")
    )


def digests(formatted: DataFrame) -> DataFrame:
    """What formatted conversations say when read back: turns, their digest, and all text under the loss mask.

    ``formatted`` (conv_id, formatted, spans) is what :func:`format_conversations` gives, where nothing but conv_id is null; a
    text that isn't of its form is an error. No conversations give no rows; other columns are ignored.
    """
    import hashlib

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.select(["conv_id", "formatted", "spans"]).to_pylist():
                turns = read_turns(row["formatted"])
                loss = "".join(unescape(row["formatted"][s["start"] : s["end"]]) for s in row["spans"])
                out.append(
                    {
                        "conv_id": row["conv_id"],
                        "n_turns": len(turns),
                        "turns_sha256": hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest(),
                        "loss_chars": len(loss),
                        "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(),
                        "formatted_chars": len(row["formatted"]),
                    }
                )
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    kinds = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    return formatted.mapInArrow(work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
