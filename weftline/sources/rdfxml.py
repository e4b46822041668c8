"""Readers of the two XML forms of RDF."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from itertools import count
from urllib.parse import urljoin

RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
XML = "{http://www.w3.org/XML/1998/namespace}"
_OWN = {RDF + x for x in ("about", "ID", "nodeID", "resource", "parseType", "datatype", "bagID")}

Triple = tuple[str, str, str, str]


def uri(tag: str) -> str:
    return tag[1:].replace("}", "", 1) if tag[0] == "{" else tag


class _Reader:
    def __init__(self, base: str):
        self.base, self.numbers = base, count(1)

    def fresh(self) -> str:
        return f"_:b{next(self.numbers)}"

    def name(self, element: ET.Element) -> str:
        about, own, node = (element.get(RDF + x) for x in ("about", "ID", "nodeID"))
        if about is not None:
            return urljoin(self.base, about)
        if own is not None:
            return f"{self.base}#{own}"
        return f"_:{node}" if node is not None else self.fresh()

    def attributes(self, subject: str, element: ET.Element) -> Iterator[Triple]:
        for key, value in element.attrib.items():
            if key not in _OWN and not key.startswith(XML):
                yield (subject, uri(key), urljoin(self.base, value), "uri") if key == RDF + "type" else (subject, uri(key), value, "literal")

    def node(self, element: ET.Element, subject: str) -> Iterator[Triple]:
        if element.tag != RDF + "Description":
            yield subject, uri(RDF + "type"), uri(element.tag), "uri"
        yield from self.attributes(subject, element)
        yield from self.properties(subject, element)

    def properties(self, subject: str, element: ET.Element) -> Iterator[Triple]:
        items = count(1)
        for child in element:
            tag = f"{RDF}_{next(items)}" if child.tag == RDF + "li" else child.tag
            yield from self.property(subject, uri(tag), child)

    def property(self, subject: str, predicate: str, element: ET.Element) -> Iterator[Triple]:
        kind = lambda name: "bnode" if name.startswith("_:") else "uri"
        resource, node, parse = (element.get(RDF + x) for x in ("resource", "nodeID", "parseType"))
        if resource is not None or node is not None:
            name = urljoin(self.base, resource) if resource is not None else f"_:{node}"
            yield subject, predicate, name, kind(name)
            yield from self.attributes(name, element)
        elif parse == "Resource":
            name = self.fresh()
            yield subject, predicate, name, "bnode"
            yield from self.properties(name, element)
        elif parse == "Collection":
            rest = (subject, predicate)
            for child in element:
                cell, name = self.fresh(), self.name(child)
                yield *rest, cell, "bnode"
                yield cell, uri(RDF + "first"), name, kind(name)
                yield from self.node(child, name)
                rest = (cell, uri(RDF + "rest"))
            yield *rest, uri(RDF + "nil"), "uri"
        elif parse == "Literal":
            yield subject, predicate, (element.text or "") + "".join(ET.tostring(child, encoding="unicode") for child in element), "literal"
        elif len(element):
            for child in element:
                name = self.name(child)
                yield subject, predicate, name, kind(name)
                yield from self.node(child, name)
        elif any(self.attributes("", element)):
            name = self.fresh()
            yield subject, predicate, name, "bnode"
            yield from self.attributes(name, element)
        else:
            yield subject, predicate, element.text or "", "literal"


def _root(text: str) -> ET.Element | None:
    try:
        return ET.fromstring(text)
    except ET.ParseError:  # lenient: a broken document has no triples
        return None


def read_rdfxml(text: str, base: str = "") -> Iterator[Triple]:
    """(s, p, o, kind) of an RDF/XML document: typed nodes, property elements and attributes, nesting, collections."""
    root = _root(text)
    if root is None:
        return
    reader = _Reader(root.get(XML + "base", base))
    for element in root if root.tag == RDF + "RDF" else [root]:
        yield from reader.node(element, reader.name(element))


def read_trix(text: str, base: str = "") -> Iterator[Triple]:
    """(s, p, o, kind) of all graphs of a TriX document."""
    root = _root(text)
    for triple in root.iter() if root is not None else ():
        if triple.tag.rpartition("}")[2] == "triple" and len(triple) == 3:
            (s, _), (p, _), (o, kind) = ((x.text or "", x.tag.rpartition("}")[2]) for x in triple)
            subject = f"_:{s}" if triple[0].tag.endswith("id") else s.strip()
            yield subject, p.strip(), f"_:{o}" if kind == "id" else o.strip() if kind == "uri" else o, {"uri": "uri", "id": "bnode"}.get(kind, "literal")
