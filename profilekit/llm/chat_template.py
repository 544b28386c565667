"""Chat formatting: a compiler for a small sandboxed template language.

A template is text with ``{{ expression }}``, ``{% if/elif/else/endif %}``, ``{% for x in y %}``, ``{% set x = y %}``,
``{% generation %} ... {% endgeneration %}`` and ``{# comments #}``. It is parsed into a syntax tree,
constant parts are folded, and every node becomes a Python closure. Values are texts, numbers, truth values,
None, mappings and the message stream; a dot reads a key of a mapping and nothing else, there are no calls besides the
listed filters, so a template cannot reach Python objects.

Rendering streams: closures are generators, ``for`` reads messages one by one (with one message of lookahead for
``loop.last``), and a conversation leaves the task as one piece per message. Memory follows a message, not a conversation.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilekit.llm.common import arrow_schema

#: Strings with a meaning in the formatted text; inside texts they are escaped.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<|role|>", "<|text|>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """Double every backslash, then put one after the first character of each control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """The inverse of :func:`escape`."""
    return _ESCAPED.sub(r"\1", text)


#: The default template: turns end with </s>, users are wrapped in [INST], assistant texts are what is learned.
TEMPLATE = (
    "{{ '<s>' }}{% for message in messages %}"
    "{% if message.role == 'user' %}[INST]{% endif %}"
    "<|role|>{{ message.role | escape }}<|text|>"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}"
    "{% if message.role == 'user' %}[/INST]{% endif %}</s>{% endfor %}"
)
_TURN = re.compile(r"(?:<s>)?(?:\[INST\])?<\|role\|>(.*?)<\|text\|>(.*?)(?:\[/INST\])?</s>", re.DOTALL)


class TemplateError(ValueError):
    """The template does not follow the language, or a value has a kind it may not have."""


# --- syntax tree ----------------------------------------------------------------------------------------

_TAG = re.compile(r"""(\{\{(?:'[^']*'|"[^"]*"|[^'"}]|\}(?!\}))*\}\}|\{%(?:'[^']*'|"[^"]*"|[^'"%]|%(?!\}))*%\}|\{#.*?#\})""", re.DOTALL)
_WORD = re.compile(r"""\s*(?:('[^']*'|"[^"]*")|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+~<>.|()\[\]%*]))""")
_KEYWORDS = {"and", "or", "not", "in", "if", "else"}
_NAMED = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
_MAX_DEPTH = 64


def _words(source: str) -> list[tuple[str, object]]:
    out, at = [], 0
    while source[at:].strip():
        found = _WORD.match(source, at)
        if not found:
            raise TemplateError(f"cannot read {source[at:at + 20]!r}")
        text, number, name, sign = found.groups()
        if text is not None:
            out.append(("const", text[1:-1]))
        elif number is not None:
            out.append(("const", int(number)))
        elif name in _NAMED:
            out.append(("const", _NAMED[name]))
        else:
            out.append(("sign" if sign or name in _KEYWORDS else "name", sign or name))
        at = found.end()
    return out


def _plain(value):
    """The text of a value in the output."""
    if value is None:
        return ""
    if isinstance(value, (str, int)):
        return str(value)
    raise TemplateError(f"{type(value).__name__} cannot be written")


FILTERS: dict[str, Callable] = {
    "escape": lambda v: escape(_plain(v)), "trim": lambda v: _plain(v).strip(), "upper": lambda v: _plain(v).upper(),
    "lower": lambda v: _plain(v).lower(), "length": lambda v: len(_plain(v)),
}


def _add(a, b):
    if isinstance(a, str) != isinstance(b, str) or not isinstance(a, (str, int)) or not isinstance(b, (str, int)):
        raise TemplateError("+ needs two texts or two numbers")
    return a + b


BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "+": _add, "-": lambda a, b: a - b, "%": lambda a, b: int(a) % int(b),
    "~": lambda a, b: _plain(a) + _plain(b), "in": lambda a, b: a in b if isinstance(b, (str, dict)) else False,
}
_RANK = {"or": 1, "and": 2, "in": 4, "==": 4, "!=": 4, "<": 4, ">": 4, "<=": 4, ">=": 4, "~": 5, "+": 6, "-": 6, "%": 7}


class _Expression:
    """Precedence climbing over the words of one expression; constant operands fold at once."""

    def __init__(self, source: str):
        self.words, self.at, self.depth = _words(source), 0, 0

    def peek(self):
        return self.words[self.at] if self.at < len(self.words) else ("end", "")

    def take(self, sign: str | None = None):
        word = self.peek()
        if sign is not None and word != ("sign", sign):
            raise TemplateError(f"expected {sign!r}, found {word[1]!r}")
        self.at += 1
        return word

    def whole(self):
        tree = self.binary(0)
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return tree

    def binary(self, least: int):
        self.depth += 1
        if self.depth > _MAX_DEPTH:
            raise TemplateError("expression is nested too deeply")
        if self.peek() == ("sign", "not"):
            self.take()
            inner = self.binary(3)
            left = ("const", not inner[1]) if inner[0] == "const" else ("not", inner)
        else:
            left = self.postfix()
        while self.peek()[0] == "sign" and _RANK.get(self.peek()[1], -1) > least:
            op = self.take()[1]
            right = self.binary(_RANK[op])
            left = self.joined(op, left, right)
        self.depth -= 1
        return left

    @staticmethod
    def joined(op, left, right):
        if op in ("and", "or"):
            if left[0] == "const":
                return right if bool(left[1]) == (op == "and") else left
            return (op, left, right)
        if left[0] == right[0] == "const":
            return ("const", BINARY[op](left[1], right[1]))
        return ("binary", op, left, right)

    def postfix(self):
        kind, value = self.take()
        if (kind, value) == ("sign", "("):
            tree = self.binary(0)
            self.take(")")
        elif kind == "const":
            tree = (kind, value)
        elif kind == "name":
            tree = (kind, value)
        else:
            raise TemplateError(f"unexpected {value!r}")
        while self.peek()[0] == "sign" and self.peek()[1] in (".", "[", "|"):
            sign = self.take()[1]
            if sign == "[":
                key = self.binary(0)
                self.take("]")
                tree = ("get", tree, key)
            else:
                kind, name = self.take()
                if kind != "name":
                    raise TemplateError(f"expected a name after {sign!r}")
                if sign == ".":
                    tree = ("get", tree, ("const", name))
                elif name not in FILTERS:
                    raise TemplateError(f"unknown filter {name!r}")
                else:
                    tree = ("const", FILTERS[name](tree[1])) if tree[0] == "const" else ("filter", name, tree)
        return tree


def _folded(nodes: list) -> list:
    """Constants become text, neighbouring texts one text, decided branches their branch."""
    out: list = []
    for node in nodes:
        if node[0] == "out" and node[1][0] == "const":
            node = ("text", _plain(node[1][1]))
        if node[0] == "if" and node[1][0] == "const":
            chosen = node[2] if node[1][1] else node[3]
        else:
            chosen = [node]
        for item in chosen:
            if item[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + item[1])
            elif item != ("text", "") and not (item[0] == "generation" and not item[1]):
                out.append(item)
    return out


def parse(template: str) -> list:
    """The folded syntax tree of a template."""
    parts = _TAG.split(template)
    at = 0

    def tag(part: str) -> str | None:
        return part[2:-2].strip().strip("-").strip() if part.startswith("{%") and part.endswith("%}") else None

    def block(ends: tuple[str, ...], depth: int) -> tuple[list, str]:
        nonlocal at
        if depth > _MAX_DEPTH:
            raise TemplateError("blocks are nested too deeply")
        nodes: list = []
        while at < len(parts):
            part = parts[at]
            at += 1
            inner = tag(part)
            if inner is None:
                if part.startswith("{{") and part.endswith("}}"):
                    nodes.append(("out", _Expression(part[2:-2]).whole()))
                elif not (part.startswith("{#") and part.endswith("#}")):
                    if "{{" in part or "{%" in part:
                        raise TemplateError(f"unfinished tag in {part[:40]!r}")
                    nodes.append(("text", part))
                continue
            word, _, rest = inner.partition(" ")
            if word in ends:
                return _folded(nodes), inner
            if word == "if":
                nodes.append(branch(rest, depth))
            elif word == "for":
                name, found, source = rest.partition(" in ")
                if not found or not name.strip().isidentifier():
                    raise TemplateError(f"cannot read for {rest!r}")
                body, _ = block(("endfor",), depth + 1)
                nodes.append(("for", name.strip(), _Expression(source).whole(), body))
            elif word == "set":
                name, found, source = rest.partition("=")
                if not found or not name.strip().isidentifier():
                    raise TemplateError(f"cannot read set {rest!r}")
                nodes.append(("set", name.strip(), _Expression(source).whole()))
            elif word == "generation":
                body, _ = block(("endgeneration",), depth + 1)
                nodes.append(("generation", body))
            else:
                raise TemplateError(f"unknown tag {word!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return _folded(nodes), ""

    def branch(condition: str, depth: int):
        test = _Expression(condition).whole()
        body, end = block(("elif", "else", "endif"), depth + 1)
        other: list = []
        if end.startswith("elif"):
            other = [branch(end[4:], depth + 1)]
        elif end == "else":
            other, _ = block(("endif",), depth + 1)
        return ("if", test, body, other)

    return block((), 0)[0]


# --- closures -------------------------------------------------------------------------------------------

def _value(tree) -> Callable[[dict], object]:
    kind = tree[0]
    if kind == "const":
        return lambda env, value=tree[1]: value
    if kind == "name":
        return lambda env, name=tree[1]: env.get(name)
    if kind == "get":
        source, key = _value(tree[1]), _value(tree[2])

        def get(env):
            found = source(env)
            return found.get(key(env)) if isinstance(found, dict) else None

        return get
    if kind == "not":
        inner = _value(tree[1])
        return lambda env: not inner(env)
    if kind == "filter":
        apply, inner = FILTERS[tree[1]], _value(tree[2])
        return lambda env: apply(inner(env))
    left, right = _value(tree[-2]), _value(tree[-1])
    if kind == "and":
        return lambda env: left(env) and right(env)
    if kind == "or":
        return lambda env: left(env) or right(env)
    apply = BINARY[tree[1]]
    return lambda env: apply(left(env), right(env))


def _sequence(nodes: list) -> Callable[[dict, bool], Iterator[tuple[str, bool]]]:
    steps = [_statement(node) for node in nodes]

    def run(env, learned):
        for step in steps:
            yield from step(env, learned)

    return run


def _statement(node) -> Callable[[dict, bool], Iterator[tuple[str, bool]]]:
    """A generator function of (environment, learned) that yields (text, learned)."""
    kind = node[0]
    if kind == "text":
        def text(env, learned, value=node[1]):
            yield value, learned
        return text
    if kind == "out":
        source = _value(node[1])

        def out(env, learned):
            yield _plain(source(env)), learned
        return out
    if kind == "set":
        name, value = node[1], _value(node[2])

        def assign(env, learned):
            env[name] = value(env)
            return iter(())
        return assign
    if kind == "generation":
        body = _sequence(node[1])
        return lambda env, learned: body(env, True)
    if kind == "if":
        test, then, other = _value(node[1]), _sequence(node[2]), _sequence(node[3])
        return lambda env, learned: (then if test(env) else other)(env, learned)
    name, source, body = node[1], _value(node[2]), _sequence(node[3])

    def loop(env, learned):
        items = source(env)
        if items is None or isinstance(items, (str, int, dict)):
            raise TemplateError("for needs messages")
        nothing = object()
        items = iter(items)
        item, index = next(items, nothing), 0
        while item is not nothing:
            following = next(items, nothing)
            inner = env | {name: item, "loop": {"index0": index, "index": index + 1, "first": index == 0, "last": following is nothing}}
            yield from body(inner, learned)
            item, index = following, index + 1

    return loop


def compile_template(template: str) -> Callable[[Iterable[dict]], Iterator[tuple[str, bool]]]:
    """A function from messages to (text, learned) parts in order."""
    run = _sequence(parse(template))
    return lambda messages, **names: run({**names, "messages": messages}, False)


# --- over tables ----------------------------------------------------------------------------------------

_PIECES = "conv_id long, piece_no long, piece string, learned array<int>"
_PIECE_CHARS = 1 << 16


def _pieces(parts: Iterator[tuple[str, bool]]) -> Iterator[tuple[str, list[int]]]:
    """Gather parts into pieces; ``learned`` holds start, end, start, end ... in code points of the piece."""
    texts, spans, length = [], [], 0
    for text, learned in parts:
        if learned and text:
            if spans and spans[-1] == length:
                spans[-1] += len(text)
            else:
                spans += [length, length + len(text)]
        texts.append(text)
        length += len(text)
        if length >= _PIECE_CHARS:
            yield "".join(texts), spans
            texts, spans, length = [], [], 0
    if texts:
        yield "".join(texts), spans


def format_conversations(df: DataFrame, template: str = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, piece_no, piece, learned): the formatted conversations; pieces of one follow each other in one partition.

    ``learned`` lists starts and ends, in the piece, of what stands under generation markers.

    Defined cases: rows go by turn, then role, then text, null turns first; null roles and texts are empty; null
    conversation ids are one conversation; repeated rows are repeated turns; other columns are ignored; an empty table
    gives an empty table.
    """
    rows = df.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
                     F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, schema = compile_template(template), arrow_schema(_PIECES)

        def messages():
            for batch in batches:
                yield from zip(*[c.to_pylist() for c in batch.columns])

        held, size = [], 0
        for conv_id, group in itertools.groupby(messages(), key=lambda row: row[0]):
            parts = render({"role": role, "text": text} for _, role, text in group)
            for number, (piece, learned) in enumerate(_pieces(parts)):
                held.append((conv_id, number, piece, learned))
                size += len(piece)
                if size >= 1 << 22 or len(held) >= 4096:
                    yield _batch(held, schema)
                    held, size = [], 0
        if held:
            yield _batch(held, schema)

    return rows.mapInArrow(run, _PIECES)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Reader:
    """Reads turns and learned text back from the pieces of one conversation."""

    def __init__(self):
        self.rest, self.pending, self.turns, self.chars, self.loss_chars = "", "", 0, 0, 0
        self.turn_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def feed(self, piece: str, learned: list[int]) -> None:
        self.chars += len(piece)
        ended = 0
        self.rest += piece
        for found in _TURN.finditer(self.rest):
            role, text = unescape(found[1]), unescape(found[2])
            self.turn_hash.update(f"{role}\n{text}\n".encode())
            self.turns += 1
            ended = found.end()
        self.rest = self.rest[ended:]
        for start, end in zip(learned[::2], learned[1::2]):
            # A span is unescaped in whole pairs; an odd run of backslashes at its end waits for what follows.
            span = self.pending + piece[start:end]
            odd = (len(span) - len(span.rstrip("\\"))) % 2
            self.pending, span = (span[-1:], span[:-1]) if odd else ("", span)
            plain = unescape(span)
            self.loss_chars += len(plain)
            self.loss_hash.update(plain.encode())

    def row(self, conv_id):
        if self.rest or self.pending:
            raise ValueError(f"conversation {conv_id} does not end with a whole turn")
        return (conv_id, self.turns, self.turn_hash.hexdigest(), self.loss_chars, self.loss_hash.hexdigest(), self.chars)


def read_back(pieces: DataFrame) -> DataFrame:
    """One row per conversation, from :func:`format_conversations` with the default template alone."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(_DIGESTS)

        def rows():
            for batch in batches:
                yield from zip(*[c.to_pylist() for c in batch.columns])

        held = []
        for conv_id, group in itertools.groupby(rows(), key=lambda row: row[0]):
            reader = _Reader()
            for _, _, piece, learned in group:
                reader.feed(piece, learned)
            held.append(reader.row(conv_id))
            if len(held) >= 4096:
                yield _batch(held, schema)
                held = []
        if held:
            yield _batch(held, schema)

    return pieces.mapInArrow(run, _DIGESTS)
