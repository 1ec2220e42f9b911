"""Chat formatting by a small template compiler.

A template is text with {{ expression }} and {% statement %} tags. It is parsed into a syntax tree, constants are
folded (literal pieces are joined, constant conditions are decided, filters of literals are applied), and the tree
is compiled to Python closures. Statements: for NAME in EXPR, if / elif / else, generation (the text inside is what
a model is trained on), and their end tags. Expressions: names, NAME.key, string and integer literals, + == != and
or not, and the filters trim, upper, lower, default, escape, escape_label. There are no calls, no subscripts, no
attribute access other than dictionary keys and no imports, so a template cannot reach Python objects.

Control strings inside texts are escaped by a backslash and read back exactly. Conversations are collected per
conv_id (rows by turn, then role, then text) and rendered in Arrow batches; one conversation is one row of output
and has to fit into a task, as its formatted text does.

Edge cases: a null text or role counts as empty; a null turn sorts first; rows with a null conv_id form one
conversation; repeated rows are repeated turns; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm._spark import read

#: Marks a turn as "### role: text </turn>"; only the text of assistant turns is generated.
TEMPLATE = (
    "{% for turn in turns %}### {{ turn.role | escape_label }}: "
    "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}{% else %}{{ turn.text | escape }}{% endif %}"
    "</turn>\n{% endfor %}"
)
_ESCAPE = re.compile(r"\\|###|</turn>")
_ESCAPE_LABEL = re.compile(r"\\|###|</turn>|:")
_TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|(?!</turn>)[^\\])*)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m.group(), text)


def escape_label(text: str) -> str:
    return _ESCAPE_LABEL.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


FILTERS: dict[str, Callable[[Any], Any]] = {"trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(), "default": lambda x: "" if x is None else x, "escape": escape, "escape_label": escape_label}


class TemplateError(ValueError):
    """The template does not follow the grammar."""


_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)|(==|!=|[+|()]))")


def _tokens(source: str) -> list[tuple[str, Any]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at : at + 10]!r}")
        at = m.end()
        if m[1] is not None:
            out.append(("const", re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t"}.get(e[1], e[1]), m[1][1:-1])))
        elif m[2] is not None:
            out.append(("const", int(m[2])))
        else:
            out.append(("name", m[3]) if m[3] else ("op", m[4]))
    return out


class _Expression:
    """Recursive descent over tokens; nodes are tuples (kind, ...) and constants are folded as they arise."""

    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0

    def peek(self) -> tuple[str, Any]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", None)

    def take(self, *wanted: tuple[str, Any]) -> Any:
        if self.peek() in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def whole(self) -> tuple:
        node = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.take(("name", "or")):
            node = fold(("or", node, self.both()))
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.take(("name", "and")):
            node = fold(("and", node, self.negated()))
        return node

    def negated(self) -> tuple:
        return fold(("not", self.negated())) if self.take(("name", "not")) else self.compared()

    def compared(self) -> tuple:
        node = self.added()
        while op := self.take(("op", "=="), ("op", "!=")):
            node = fold((op, node, self.added()))
        return node

    def added(self) -> tuple:
        node = self.filtered()
        while self.take(("op", "+")):
            node = fold(("+", node, self.filtered()))
        return node

    def filtered(self) -> tuple:
        node = self.atom()
        while self.take(("op", "|")):
            kind, name = self.peek()
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            node = fold(("filter", name, node))
        return node

    def atom(self) -> tuple:
        kind, value = self.peek()
        self.at += 1
        if kind == "const":
            return ("const", value)
        if kind == "name" and value not in ("and", "or", "not"):
            if any(part.startswith("_") for part in value.split(".")):
                raise TemplateError(f"name {value!r} is not allowed")
            return ("name", tuple(value.split(".")))
        if (kind, value) == ("op", "("):
            node = self.either()
            if self.take(("op", ")")) is None:
                raise TemplateError("missing )")
            return node
        raise TemplateError(f"unexpected {value!r}")


_BINARY: dict[str, Callable] = {"+": lambda a, b: f"{a}{b}" if isinstance(a, str) or isinstance(b, str) else a + b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "and": lambda a, b: a and b, "or": lambda a, b: a or b}


def fold(node: tuple) -> tuple:
    """Replaces an operation on constants by its value."""
    if node[0] in _BINARY and node[1][0] == node[2][0] == "const":
        return ("const", _BINARY[node[0]](node[1][1], node[2][1]))
    if node[0] == "not" and node[1][0] == "const":
        return ("const", not node[1][1])
    if node[0] == "filter" and node[2][0] == "const":
        return ("const", FILTERS[node[1]](node[2][1]))
    return node


def parse(template: str) -> list[tuple]:
    """Syntax tree: ("text", s), ("out", expr), ("for", name, expr, body), ("if", [(cond, body)...]), ("generation", body)."""
    root: list[tuple] = []
    stack: list[tuple[str, Any, list[tuple]]] = [("", None, root)]
    at = 0
    for tag in _TAG.finditer(template):
        if tag.start() > at:
            stack[-1][2].append(("text", template[at : tag.start()]))
        at = tag.end()
        if tag[1] is not None:
            stack[-1][2].append(("out", _Expression(tag[1]).whole()))
            continue
        word, _, rest = tag[2].strip().partition(" ")
        kind, data, body = stack[-1]
        if word == "for":
            m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest.strip(), re.DOTALL)
            if not m:
                raise TemplateError(f"for {rest}")
            stack.append(("for", (m[1], _Expression(m[2]).whole()), []))
        elif word == "if":
            stack.append(("if", [[_Expression(rest).whole(), None]], []))
        elif word in ("elif", "else") and kind == "if":
            data[-1][1] = body
            stack[-1] = ("if", [*data, [_Expression(rest).whole() if word == "elif" else ("const", True), None]], [])
        elif word == "generation":
            stack.append(("generation", None, []))
        elif word == f"end{kind}" and kind:
            stack.pop()
            if kind == "for":
                node = ("for", *data, body)
            elif kind == "if":
                data[-1][1] = body
                node = ("if", [tuple(x) for x in data])
            else:
                node = ("generation", body)
            stack[-1][2].append(node)
        else:
            raise TemplateError(f"unexpected {tag.group()!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not ended")
    if at < len(template):
        root.append(("text", template[at:]))
    return simplify(root)


def simplify(body: list[tuple]) -> list[tuple]:
    """Joins neighbouring literals and decides constant conditions."""
    out: list[tuple] = []
    for node in body:
        if node[0] == "out" and node[1][0] == "const":
            node = ("text", str(node[1][1]))
        elif node[0] == "for":
            node = ("for", node[1], node[2], simplify(node[3]))
        elif node[0] == "generation":
            node = ("generation", simplify(node[1]))
        elif node[0] == "if":
            arms = []
            for condition, inner in node[1]:
                if condition == ("const", False) or condition[0] == "const" and not condition[1]:
                    continue
                arms.append((condition, simplify(inner)))
                if condition[0] == "const":
                    break
            if arms and arms[0][0][0] == "const":
                for inner in arms[0][1]:
                    _append(out, inner)
                continue
            if not arms:
                continue
            node = ("if", arms)
        _append(out, node)
    return out


def _append(out: list[tuple], node: tuple) -> None:
    if node[0] == "text" and out and out[-1][0] == "text":
        out[-1] = ("text", out[-1][1] + node[1])
    elif node != ("text", ""):
        out.append(node)


def _value(node: tuple) -> Callable[[dict], Any]:
    kind = node[0]
    if kind == "const":
        constant = node[1]
        return lambda scope: constant
    if kind == "name":
        first, *rest = node[1]

        def look(scope: dict) -> Any:
            value = scope.get(first)
            for key in rest:
                value = value.get(key) if isinstance(value, dict) else None
            return value

        return look
    if kind == "filter":
        apply, inner = FILTERS[node[1]], _value(node[2])
        return lambda scope: apply(inner(scope))
    if kind == "not":
        inner = _value(node[1])
        return lambda scope: not inner(scope)
    combine, left, right = _BINARY[kind], _value(node[1]), _value(node[2])
    if kind == "and":
        return lambda scope: left(scope) and right(scope)
    if kind == "or":
        return lambda scope: left(scope) or right(scope)
    return lambda scope: combine(left(scope), right(scope))


class _Output:
    def __init__(self) -> None:
        self.parts: list[str] = []
        self.length = 0
        self.generated: list[tuple[int, int]] = []

    def put(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def _block(body: list[tuple]) -> Callable[[dict, _Output], None]:
    steps = [_step(node) for node in body]

    def run(scope: dict, out: _Output) -> None:
        for step in steps:
            step(scope, out)

    return run


def _step(node: tuple) -> Callable[[dict, _Output], None]:
    if node[0] == "text":
        literal = node[1]
        return lambda scope, out: out.put(literal)
    if node[0] == "out":
        value = _value(node[1])

        def show(scope: dict, out: _Output) -> None:
            shown = value(scope)
            out.put("" if shown is None else str(shown))

        return show
    if node[0] == "for":
        name, items, inner = node[1], _value(node[2]), _block(node[3])

        def loop(scope: dict, out: _Output) -> None:
            each = items(scope) or []
            own = dict(scope)
            for i, item in enumerate(each):
                own[name] = item
                own["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(each) - 1}
                inner(own, out)

        return loop
    if node[0] == "if":
        arms = [(_value(condition), _block(inner)) for condition, inner in node[1]]

        def choose(scope: dict, out: _Output) -> None:
            for condition, inner in arms:
                if condition(scope):
                    inner(scope, out)
                    return

        return choose
    inner = _block(node[1])

    def generation(scope: dict, out: _Output) -> None:
        start = out.length
        inner(scope, out)
        out.generated.append((start, out.length))

    return generation


def compile_template(template: str) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from variables to (text, [(start, end) code points of generated stretches])."""
    body = _block(parse(template))

    def render(variables: dict) -> tuple[str, list[tuple[int, int]]]:
        out = _Output()
        body(variables, out)
        return "".join(out.parts), out.generated

    return render


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a text rendered by TEMPLATE."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def _render(template: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        for batch in batches:
            texts, spans = [], []
            for turns in batch.column(1).to_pylist():
                text, generated = render({"turns": [{"role": t["role"] or "", "text": t["text"] or ""} for t in turns]})
                texts.append(text)
                spans.append([{"start": a, "end": b} for a, b in generated])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(spans, kind)], names=["conv_id", "formatted", "generated"])

    return run


def format_conversations(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, formatted, generated): one row per conversation of (conv_id, turn, role, text)."""
    turns = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))
    return turns.mapInArrow(_render(template), "conv_id long, formatted string, generated array<struct<start: long, end: long>>")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for batch in batches:
        columns: list[list] = [[] for _ in names]
        for conv, text, generated in zip(*(batch.column(i).to_pylist() for i in range(3))):
            turns = read_turns(text)
            loss = "".join(unescape(text[g["start"] : g["end"]]) for g in generated)
            every = "".join(f"{role}\n{said}\n" for role, said in turns)
            row = (conv, len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text))
            for column, value in zip(columns, row):
                column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe conversation -7, formatted and read back."""
    said = r"\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return format_conversations(rows).mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


ORACLE = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(length('### : </turn>' || chr(10))
           + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g'))
           + length(regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g')))::bigint as formatted_chars
from c group by conv_id
"""


def queries() -> dict:
    return {"op3_chat": op3_chat}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat": ORACLE}
