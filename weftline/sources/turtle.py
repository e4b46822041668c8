"""A reader of the Turtle subset that knowledge bases are exchanged in, and of TriG, whose graphs are read as one."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin


#: Fixed value: the predicate that ``a`` stands for.
RDF_TYPE_URI = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^<>\s]*>)|(?P<long>\"\"\"(?:[^\\]|\\.)*?\"\"\")|(?P<text>"(?:[^"\\\n]|\\.)*")|(?P<at>@[A-Za-z][A-Za-z0-9-]*)|(?P<kind>\^\^)|(?P<brace>[{}])|(?P<punct>[.;,](?=\s|$|[<\#}])|[;,.])|(?P<bnode>_:[\w-]+)|(?P<number>[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<name>[\w-]*:[\w%-]*(?:\.[\w%-]+)*|a\b|true|false|PREFIX\b|BASE\b|GRAPH\b)""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\"}


def unescape(text: str) -> str:
    text = re.sub(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})", lambda m: chr(int(m[1] or m[2], 16)), text)
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text)


def tokens(text: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            at += 1  # lenient: skip what is not Turtle
            continue
        at = m.end()
        if m.lastgroup:
            yield m.lastgroup, m[0]


def read_turtle(text: str, base: str = "") -> Iterator[tuple[str, str, str, str]]:
    """(s, p, o, kind) of the statements; kind is uri, literal or bnode (by the object)."""
    prefixes: dict[str, str] = {}
    subject = predicate = None
    queue = list(tokens(text))
    at = 0

    def term(kind: str, value: str) -> tuple[str, str]:
        if kind == "iri":
            return urljoin(base, value[1:-1]) if base else value[1:-1], "uri"
        if kind == "bnode":
            return value, "bnode"
        if kind == "long":
            return unescape(value[3:-3]), "literal"
        if kind == "text":
            return unescape(value[1:-1]), "literal"
        if kind == "number" or value in ("true", "false"):
            return value, "literal"
        if value == "a":
            return RDF_TYPE_URI, "uri"
        prefix, _, local = value.partition(":")
        return prefixes.get(prefix, prefix + ":") + local, "uri"

    while at < len(queue):
        kind, value = queue[at]
        if value in ("@prefix", "PREFIX") and at + 2 < len(queue):
            prefixes[queue[at + 1][1].rstrip(":")] = term(*queue[at + 2])[0]
            at += 3 + (at + 3 < len(queue) and queue[at + 3][1] == ".")
        elif value in ("@base", "BASE") and at + 1 < len(queue):
            base = queue[at + 1][1][1:-1]
            at += 2 + (at + 2 < len(queue) and queue[at + 2][1] == ".")
        elif kind == "brace" or value == "GRAPH":
            subject = predicate = None  # what stood before is the graph's name
            at += 1
        elif kind == "punct":
            if value == ".":
                subject = predicate = None
            elif value == ";":
                predicate = None
            at += 1
        elif kind == "at":
            at += 1  # a language tag counts for nothing
        elif kind == "kind":
            at += 2  # nor does a datatype
        elif subject is None:
            subject = term(kind, value)[0]
            at += 1
        elif predicate is None:
            predicate = term(kind, value)[0]
            at += 1
        else:
            o, what = term(kind, value)
            yield subject, predicate, o, what
            at += 1
