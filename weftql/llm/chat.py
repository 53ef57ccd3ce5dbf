"""Chat formatting with a compiled, sandboxed template language.

A template is parsed into a syntax tree, constants are folded, and every node becomes a Python closure. The language:

    {{ expression }}   {% for x in list %}...{% endfor %}   {% if a %}...{% elif b %}...{% else %}...{% endif %}
    {% generation %}...{% endgeneration %}   {# comment #}

Expressions: strings, integers, true, false, none, names, x.field, loop.first / loop.last / loop.index, ==, !=, in, and, or,
not, + and ~ (joining texts), and the filters escape, upper, lower, trim and length. There is nothing to call and no way to reach a Python
attribute: a field is looked up in mappings alone, and templates are bounded in size and depth.

Conversations are rendered turn by turn from sorted rows, so a task never holds more than one part of a conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A turn is `### role: text</turn>` and a newline.
TEMPLATE = (
    "{% for turn in messages %}{{ '### ' + turn.role|escape + ': ' }}"
    "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text|escape }}{% endgeneration %}{% else %}{{ turn.text|escape }}{% endif %}"
    "{{ '</turn>\\n' }}{% endfor %}"
)
#: In texts a backslash goes before each of these, and nowhere else: every backslash in the output quotes what follows.
CONTROL = re.compile(r"\\|###|</turn>|:")
#: A part of a formatted conversation ends after the turn with which it reaches this many characters.
PART_CHARS = 1 << 20
MAX_TEMPLATE, MAX_DEPTH = 65_536, 40


class TemplateError(ValueError):
    pass


def escape(text: str) -> str:
    return CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


FILTERS: dict[str, Callable] = {"escape": escape, "upper": str.upper, "lower": str.lower, "trim": str.strip, "length": len}

TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<op>==|!=|[+~|.()])|(?P<name>[A-Za-z_]\w*))", re.S)
PIECE = re.compile(r"\{#.*?#\}|\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
ESCAPES = {"n": "\n", "t": "\t"}


# Syntax tree: tuples whose first member is the kind of node.


def parse(source: str) -> tuple:
    """('seq', nodes) of a template."""
    if len(source) > MAX_TEMPLATE:
        raise TemplateError("the template is too long")
    pieces, at = [], 0
    for m in PIECE.finditer(source):
        if m.start() > at:
            pieces.append(("text", source[at : m.start()]))
        if m[1] is not None:
            pieces.append(("expr", m[1]))
        elif m[2] is not None:
            pieces.append(("tag", m[2].strip()))
        at = m.end()
    if at < len(source):
        pieces.append(("text", source[at:]))
    nodes, stop, rest = _sequence(pieces, 0, (), 0)
    return ("seq", nodes)


def _sequence(pieces: list, at: int, ends: tuple[str, ...], depth: int) -> tuple[list, str, int]:
    """Nodes up to a tag whose first word is in ends; that tag; the place after it."""
    if depth > MAX_DEPTH:
        raise TemplateError("the template is too deep")
    nodes = []
    while at < len(pieces):
        kind, text = pieces[at]
        at += 1
        if kind == "text":
            nodes.append(("const", text))
        elif kind == "expr":
            nodes.append(("out", expression(text)))
        else:
            word, _, rest = text.partition(" ")
            if word in ends:
                return nodes, text, at
            if word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
                if not m:
                    raise TemplateError(f"not a loop: {text}")
                body, _, at = _sequence(pieces, at, ("endfor",), depth + 1)
                nodes.append(("for", m[1], expression(m[2]), ("seq", body)))
            elif word == "if":
                branches, other, test = [], ("seq", []), expression(rest)
                while True:
                    body, end, at = _sequence(pieces, at, ("elif", "else", "endif"), depth + 1)
                    branches.append((test, ("seq", body)))
                    if end.startswith("elif "):
                        test = expression(end[5:])
                        continue
                    if end == "else":
                        body, _, at = _sequence(pieces, at, ("endif",), depth + 1)
                        other = ("seq", body)
                    break
                nodes.append(("if", branches, other))
            elif word == "generation":
                body, _, at = _sequence(pieces, at, ("endgeneration",), depth + 1)
                nodes.append(("generation", ("seq", body)))
            else:
                raise TemplateError(f"unknown tag: {text}")
    if ends:
        raise TemplateError(f"{ends[-1]} is missing")
    return nodes, "", at


def expression(text: str) -> tuple:
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise TemplateError(f"not an expression: {text}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    reader = _Reader(tokens)
    out = reader.either(0)
    if reader.tokens:
        raise TemplateError(f"unexpected {reader.tokens[0][1]} in: {text}")
    return out


class _Reader:
    def __init__(self, tokens: list[tuple[str, str]]):
        self.tokens = tokens

    def take(self, *values: str) -> str | None:
        return self.tokens.pop(0)[1] if self.tokens and self.tokens[0][0] in ("op", "name") and self.tokens[0][1] in values else None

    def either(self, depth: int) -> tuple:
        if depth > MAX_DEPTH:
            raise TemplateError("the expression is too deep")
        out = self.both(depth)
        while self.take("or"):
            out = ("or", out, self.both(depth))
        return out

    def both(self, depth: int) -> tuple:
        out = self.negated(depth)
        while self.take("and"):
            out = ("and", out, self.negated(depth))
        return out

    def negated(self, depth: int) -> tuple:
        return ("not", self.negated(depth)) if self.take("not") else self.compared(depth)

    def compared(self, depth: int) -> tuple:
        out = self.joined(depth)
        while op := self.take("==", "!=", "in"):
            out = (op, out, self.joined(depth))
        return out

    def joined(self, depth: int) -> tuple:
        out = self.filtered(depth)
        while self.take("+", "~"):
            out = ("+", out, self.filtered(depth))
        return out

    def filtered(self, depth: int) -> tuple:
        out = self.atom(depth)
        while True:
            if self.take("|"):
                name = self.tokens.pop(0)[1] if self.tokens else ""
                if name not in FILTERS:
                    raise TemplateError(f"unknown filter: {name}")
                out = ("filter", name, out)
            elif self.take("."):
                out = ("field", out, self.tokens.pop(0)[1] if self.tokens else "")
            else:
                return out

    def atom(self, depth: int) -> tuple:
        if self.take("("):
            out = self.either(depth + 1)
            if not self.take(")"):
                raise TemplateError("a bracket is not closed")
            return out
        if not self.tokens:
            raise TemplateError("an expression ends early")
        kind, text = self.tokens.pop(0)
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "int":
            return ("const", int(text))
        if kind == "name":
            return ("const", {"true": True, "false": False, "none": None}[text]) if text in ("true", "false", "none") else ("name", text)
        raise TemplateError(f"unexpected {text}")


def fold(node: tuple) -> tuple:
    """The tree with what is constant worked out: operators on constants, decided branches, neighbouring texts."""
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind in ("or", "and", "==", "!=", "in", "+"):
        left, right = fold(node[1]), fold(node[2])
        if left[0] == right[0] == "const":
            return ("const", OPERATORS[kind](left[1], right[1]))
        return (kind, left, right)
    if kind == "not":
        inner = fold(node[1])
        return ("const", not inner[1]) if inner[0] == "const" else ("not", inner)
    if kind == "filter":
        inner = fold(node[2])
        return ("const", FILTERS[node[1]](_text(inner[1]))) if inner[0] == "const" else ("filter", node[1], inner)
    if kind == "field":
        return ("field", fold(node[1]), node[2])
    if kind == "out":
        inner = fold(node[1])
        if inner[0] == "const":
            return ("const", _text(inner[1]))
        if inner[0] == "+":  # texts of a sum are put out one by one
            return fold(("seq", [("out", inner[1]), ("out", inner[2])]))
        return ("out", inner)
    if kind == "for":
        return ("for", node[1], fold(node[2]), fold(node[3]))
    if kind == "generation":
        return ("generation", fold(node[1]))
    if kind == "if":
        branches, other = [], fold(node[2])
        for test, body in ((fold(t), fold(b)) for t, b in node[1]):
            if test[0] == "const":
                if test[1]:
                    other = body
                    break
                continue
            branches.append((test, body))
        return ("if", branches, other) if branches else other
    out: list[tuple] = []
    for part in map(fold, node[1]):
        for x in part[1] if part[0] == "seq" else [part]:
            if x[0] == "const" and out and out[-1][0] == "const":
                out[-1] = ("const", out[-1][1] + _text(x[1]))
            elif x != ("const", ""):
                out.append(x)
    return out[0] if len(out) == 1 else ("seq", out)


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


OPERATORS: dict[str, Callable] = {
    "or": lambda a, b: a or b, "and": lambda a, b: a and b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
    "in": lambda a, b: a in b if isinstance(b, (str, list, tuple)) else False, "+": lambda a, b: _text(a) + _text(b),
}


def _value(node: tuple) -> Callable[[dict], object]:
    """A closure that works out an expression in a scope."""
    kind = node[0]
    if kind == "const":
        return lambda scope, v=node[1]: v
    if kind == "name":
        return lambda scope, n=node[1]: scope.get(n)
    if kind == "field":
        of, name = _value(node[1]), node[2]
        return lambda scope: x.get(name) if isinstance(x := of(scope), dict) else None
    if kind == "filter":
        of, apply = _value(node[2]), FILTERS[node[1]]
        return lambda scope: apply(_text(of(scope)))
    if kind == "not":
        of = _value(node[1])
        return lambda scope: not of(scope)
    left, right, apply = _value(node[1]), _value(node[2]), OPERATORS[kind]
    if kind == "or":
        return lambda scope: left(scope) or right(scope)
    if kind == "and":
        return lambda scope: left(scope) and right(scope)
    return lambda scope: apply(left(scope), right(scope))


Piece = tuple[str, bool]


def _writer(node: tuple, marked: bool = False) -> Callable[[dict], Iterator[Piece]]:
    """A closure that yields (text, inside a generation) pieces in a scope."""
    kind = node[0]
    if kind == "const":
        return lambda scope, p=(_text(node[1]), marked): iter((p,))
    if kind == "out":
        value = _value(node[1])
        return lambda scope: iter(((_text(value(scope)), marked),))
    if kind == "generation":
        return _writer(node[1], True)
    if kind == "if":
        branches, other = [(_value(t), _writer(b, marked)) for t, b in node[1]], _writer(node[2], marked)
        return lambda scope: next((b(scope) for t, b in branches if t(scope)), None) or other(scope)
    if kind == "for":
        name, items, body = node[1], _value(node[2]), _writer(node[3], marked)

        def loop(scope: dict) -> Iterator[Piece]:
            source = iter(items(scope) or ())
            now, index = next(source, loop), 1
            while now is not loop:  # one item ahead, so that loop.last is known
                ahead = next(source, loop)
                yield from body({**scope, name: now, "loop": {"index": index, "first": index == 1, "last": ahead is loop}})
                now, index = ahead, index + 1

        return loop
    parts = [_writer(x, marked) for x in node[1]]

    def sequence(scope: dict) -> Iterator[Piece]:
        for part in parts:
            yield from part(scope)

    return sequence


def compile_template(source: str) -> Callable[[Iterable[dict]], Iterator[Piece]]:
    """messages -> pieces of the rendered conversation, one after another; messages may be any iterable of {role, text}."""
    write = _writer(fold(parse(source)))
    return lambda messages: write({"messages": messages})


def turns_of(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, begin, end) of the turns of a formatted part: unescaped, and where the text stands."""
    at = 0
    while at < len(formatted):
        role_end = _unquoted(formatted, ": ", at + 4)
        text_end = _unquoted(formatted, "</turn>\n", role_end + 2)
        if not formatted.startswith("### ", at) or text_end < 0:
            raise ValueError("not a formatted conversation")
        yield unescape(formatted[at + 4 : role_end]), unescape(formatted[role_end + 2 : text_end]), role_end + 2, text_end
        at = text_end + 8


def _unquoted(text: str, what: str, at: int) -> int:
    """The first place of what that no backslash quotes."""
    while (found := text.find(what, at)) >= 0:
        slashes = found
        while slashes and text[slashes - 1] == "\\":
            slashes -= 1
        if (found - slashes) % 2 == 0:
            return found
        at = found + 1
    return -1


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)


def _format(source: str, part_chars: int):
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("formatted", pa.string()), ("generations", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, rows, held, size = compile_template(source), _rows(batches), [], 0
        now = next(rows, None)
        while now is not None:
            conv, taken = now[0], 0

            def messages(conv=conv) -> Iterator[dict]:
                nonlocal now, taken
                while now is not None and now[0] == conv:
                    _, role, text = now
                    now, taken = next(rows, None), taken + 1
                    yield {"role": role or "", "text": text or ""}

            pieces, spans, length, part, ended = [], [], 0, 0, 0
            for text, marked in render(messages()):
                if length >= part_chars and taken > ended and pieces and pieces[-1].endswith("</turn>\n") and text:
                    held.append({"conv_id": conv, "part": part, "formatted": "".join(pieces), "generations": spans})
                    size += length
                    pieces, spans, length, part, ended = [], [], 0, part + 1, taken
                if marked and text:
                    spans.append({"begin": length, "end": length + len(text)})
                pieces.append(text)
                length += len(text)
            held.append({"conv_id": conv, "part": part, "formatted": "".join(pieces), "generations": spans})
            size += length
            if size > 4 << 20:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held, size = [], 0
        yield pa.RecordBatch.from_pylist(held, schema=schema)

    return run, "conv_id long, part int, formatted string, generations array<struct<begin: long, end: long>>"


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, *, part_chars: int = PART_CHARS) -> DataFrame:
    """conv_id, part, formatted, generations (character spans under the loss mask) for conversations(conv_id, turn, role, text).

    Turns are in the order of turn (null first), then role and text; repeated rows are turns of their own. A null role or text
    is empty; a null conv_id is a conversation of its own. A long conversation comes in parts, cut between turns, whose
    formatted texts follow each other; the parts of a conversation are neighbours in one partition, in order. Extra columns
    are ignored; an empty table gives no rows.
    """
    compile_template(template)  # a bad template fails here, not in a task
    turns = conversations.select("conv_id", "turn", "role", "text")
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(*_format(template, part_chars))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from nothing but the formatted conversations."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, state = [], None

        def close() -> None:
            if state:
                done.append({"conv_id": state[0], "n_turns": state[1], "turns_sha256": state[2].hexdigest(), "loss_chars": state[3], "loss_sha256": state[4].hexdigest(), "formatted_chars": state[5]})

        for batch in batches:
            for conv, part, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "formatted", "generations")), strict=True):
                if part == 0:
                    close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said, _, _ in turns_of(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                for s in spans:
                    loss = unescape(text[s["begin"] : s["end"]])
                    state[3] += len(loss)
                    state[4].update(loss.encode())
                state[5] += len(text)
            if len(done) > 5000:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
                done = []
        close()
        yield pa.RecordBatch.from_pylist(done, schema=schema)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def with_probe(conversations: DataFrame) -> DataFrame:
    """conversations and conversation -7, whose two texts hold an escape and both control strings."""
    said = r"\### Assistant: </turn> ok"
    probe = conversations.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), quoted AS (
  SELECT *, length(regexp_replace(coalesce(role, ''), '(\\|###|</turn>|:)', '\\\1', 'g')) AS role_chars, length(regexp_replace(text, '(\\|###|</turn>|:)', '\\\1', 'g')) AS text_chars FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(role_chars + text_chars + 14) AS BIGINT) AS formatted_chars
FROM quoted GROUP BY conv_id
"""
