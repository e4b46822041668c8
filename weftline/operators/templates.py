"""Query templates: a SPARQL subset whose patterns become filters on the knowledge base."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from weftline.operators.kb import KnowledgeBase
from weftline.sources.triples import RDF_TYPE

RECOGNIZED = "#recognized"
_TOKEN = re.compile(r"""<[^<>\s]*>|"(?:[^"\\]|\\.)*"|[?$]\w+|[{}.;,*]|[A-Za-z][\w-]*:[\w%-]*|:[\w%-]+|\w+""")


@dataclass
class Template:
    """What a template names: graphs, and patterns (graph or None, s, p, o); variables are None, literals keep their quotes."""

    default_graphs: list[str] = field(default_factory=list)
    named_graphs: list[str] = field(default_factory=list)
    patterns: list[tuple] = field(default_factory=list)


def parse(text: str | None) -> Template:
    """PREFIX, SELECT, FROM [NAMED], WHERE with GRAPH groups and triple patterns (; and , too)."""
    found, prefixes = Template(), {}
    tokens = _TOKEN.findall(text or "")
    at = 0

    def term(token: str):
        if token[0] in "?$":
            return None
        if token[0] == "<":
            inner = token[1:-1]
            prefix, _, local = inner.partition(":")
            return prefixes[prefix] + local if prefix in prefixes and not local.startswith("//") else inner
        if token[0] == '"':
            return token
        if token == "a":
            return RDF_TYPE
        prefix, _, local = token.partition(":")
        return prefixes.get(prefix, prefix + ":") + local

    graph, subject, predicate = None, (), ()
    depth = graph_depth = 0
    while at < len(tokens):
        token = tokens[at]
        word = token.upper()
        if word == "PREFIX":
            prefixes[tokens[at + 1].rstrip(":").split(":")[0]] = tokens[at + 2][1:-1]
            at += 3
            continue
        if word == "FROM":
            named = tokens[at + 1].upper() == "NAMED"
            (found.named_graphs if named else found.default_graphs).append(term(tokens[at + 1 + named]))
            at += 2 + named
            continue
        if word == "GRAPH" and depth:
            graph, graph_depth = term(tokens[at + 1]) or "?", depth + 1
            at += 2
            continue
        if token == "{":
            depth += 1
            subject, predicate = (), ()
        elif token == "}":
            if depth == graph_depth:
                graph = None
            depth -= 1
            subject, predicate = (), ()
        elif depth and token == ".":
            subject, predicate = (), ()
        elif depth and token == ";":
            predicate = ()
        elif depth and token == ",":
            pass
        elif depth:
            if subject == ():
                subject = (term(token),)
            elif predicate == ():
                predicate = (term(token),)
            else:
                found.patterns.append((graph, subject[0], predicate[0], term(token)))
        at += 1
    return found


class Filters:
    """The ids that a template's patterns in its recognised graph name, as one DataFrame (role, id)."""

    SCHEMA = "role string, id int"

    def __init__(self, template: Template, kb: KnowledgeBase):
        self.kb = kb
        self.graphs = list(dict.fromkeys([*template.default_graphs, *template.named_graphs, *(g for g, *_ in template.patterns if g and g != "?")]))
        wanted = []
        for graph, s, p, o in template.patterns:
            if not graph or not graph.endswith(RECOGNIZED):
                continue
            if p is not None and p != RDF_TYPE:
                wanted.append(("property", p))
            if s is not None:
                wanted.append(("subject", s))
            if o is not None:
                wanted.append(("literal", o[1:-1]) if o.startswith('"') else ("type", o) if p == RDF_TYPE else ("subject", o))
        spark = kb.spark
        table = spark.createDataFrame(wanted, "role string, name string") if wanted else spark.createDataFrame([], "role string, name string")
        uris = F.broadcast(table.where("role <> 'literal'")).join(kb.resources, F.col("name") == F.col("uri")).select("role", F.col("index").alias("id"))
        texts = F.broadcast(table.where("role = 'literal'")).join(kb.literals, F.col("name") == F.col("literal")).select("role", F.col("index").alias("id"))
        kinds = uris.join(kb.property_types, F.col("id") == F.col("predicate"), "left")
        role = F.when((F.col("role") == "property") & (F.col("kind") == 1), "datatype property").when((F.col("role") == "property") & (F.col("kind") == 2), "object property").otherwise(F.col("role"))
        self.ids = kinds.select(role.alias("role"), "id").unionAll(texts).distinct()

    def of(self, role: str) -> DataFrame:
        return self.ids.where(F.col("role") == role).select(F.col("id").alias("index"))

    def infer(self, probability: float, rating: float, chain: DataFrame, ratings: DataFrame) -> DataFrame:
        """(role, id) with what follows: clusters that object properties connect, and datatype properties of the types' cluster."""
        links = chain.where(F.col("probability") > probability).join(self.of("object property"), F.col("predicate") == F.col("index"), "left_semi")
        ends = links.select(F.col("subject").alias("id")).union(links.select("object")).distinct().select(F.lit("type").alias("role"), "id")
        types = self.ids.where("role = 'type'").unionAll(ends).distinct()
        votes = types.join(F.broadcast(self.kb.type_clusters), F.col("id") == F.col("type")).groupBy("cluster").agg(F.count_distinct("type").alias("n"))
        cluster = votes.agg(F.min(F.struct((-F.col("n")).alias("n"), "cluster")).alias("c")).select(F.col("c.cluster").alias("cluster"))
        more = ratings.where(F.col("rating") > rating).join(F.broadcast(cluster), "cluster").select(F.lit("datatype property").alias("role"), F.col("property").alias("id"))
        return self.ids.unionAll(ends).unionAll(more).distinct()

    def names(self, ids: DataFrame | None = None) -> DataFrame:
        """role, name: ids resolved to URIs and literals."""
        ids = self.ids if ids is None else ids
        uris = ids.where("role <> 'literal'").join(self.kb.resources, F.col("id") == F.col("index")).select("role", F.col("uri").alias("name"))
        texts = ids.where("role = 'literal'").join(self.kb.literals, F.col("id") == F.col("index")).select("role", F.col("literal").alias("name"))
        return uris.unionAll(texts)


def graph_uri(domain: str, kb_name: str, doc_uri, graph: str):
    """domain?graph=<kb>&doc=<doc>#<graph>, with both parts encoded."""
    return F.concat(F.lit(domain + "?graph="), F.url_encode(F.lit(kb_name)), F.lit("&doc="), F.url_encode(doc_uri), F.lit("#" + graph))
