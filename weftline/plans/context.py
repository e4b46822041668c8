"""What the corpus queries of a data folder share, made once for each session and written to the shared folder."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.functions import text
from weftline.operators import linking, rating, spotting
from weftline.operators.kb import KB_SQL, KnowledgeBase
from weftline.session import materialize, table


class Context:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.docs = table(spark, folder, "documents").select("doc_id", "text")
        self._rated: dict[str, DataFrame] = {}

    @classmethod
    def of(cls, spark: SparkSession, folder: str) -> Context:
        made = getattr(spark, "_weftline_contexts", None)
        if made is None:
            made = spark._weftline_contexts = {}
        if folder not in made:
            made[folder] = cls(spark, folder)
        return made[folder]

    @cached_property
    def kb(self) -> KnowledgeBase:
        return KnowledgeBase.of_folder(self.spark, self.folder)

    @cached_property
    def tokens(self) -> DataFrame:
        return materialize(text.tokens(self.docs))

    @cached_property
    def chunked(self) -> DataFrame:
        """Not written: a pass over the texts, as many as a query needs."""
        return text.annotated(self.docs)

    @cached_property
    def spans(self) -> DataFrame:
        return materialize(spotting.spot(self.docs, self.kb.literals, self.kb.symbols))

    @cached_property
    def kept(self) -> DataFrame:
        return materialize(spotting.exact_case(spotting.longest(self.spans)))

    @cached_property
    def instances(self) -> DataFrame:
        return materialize(linking.instances(self.kept, self.kb))

    @cached_property
    def candidates(self) -> DataFrame:
        return materialize(linking.components(linking.bipartite(self.instances)))

    @cached_property
    def edges(self) -> DataFrame:
        return materialize(linking.staged_expansion(self.candidates, self.kb))

    @cached_property
    def links(self) -> DataFrame:
        return materialize(linking.link_scores(self.edges))

    @cached_property
    def winners(self) -> DataFrame:
        votes = linking.resolve(linking.scores(self.candidates, self.edges, "degree"))
        return materialize(linking.winners(self.candidates, votes))

    @cached_property
    def resolved(self) -> DataFrame:
        """Instances of the winners only."""
        return materialize(self.instances.join(self.winners.select("doc_id", "subject"), ["doc_id", "subject"], "left_semi"))

    @cached_property
    def facts(self) -> DataFrame:
        return materialize(linking.known_facts(self.resolved, self.kb))

    def rated(self, metric: str) -> DataFrame:
        """doc_id, subject, value by one metric; the others are not made for it."""
        if metric not in self._rated:
            found, docs = self.instances, self.docs
            made = rating.by_degree(found, self.edges) if metric == "degree" else {"position": rating.by_position, "frequency": rating.by_frequency, "rarity": rating.by_rarity}[metric](found, docs)
            self._rated[metric] = materialize(made)
        return self._rated[metric]

    @cached_property
    def ratings(self) -> DataFrame:
        return rating.long_form({m: self.rated(m) for m in ("position", "frequency", "rarity", "degree")})

    @cached_property
    def normal(self) -> DataFrame:
        return materialize(rating.normalise(self.ratings))


_PIECE = text.PIECE.replace("'", "''")
TOKENS_CTE = f"""pieces AS (SELECT doc_id, regexp_extract_all(text, '{_PIECE}') AS p FROM documents),
flat AS (SELECT doc_id, unnest(p) AS token, generate_subscripts(p, 1) AS i FROM pieces),
placed AS (SELECT doc_id, i, token, (sum(length(token)) OVER (PARTITION BY doc_id ORDER BY i))::INTEGER AS e FROM flat),
tokens AS (SELECT doc_id, i, e - length(token)::INTEGER AS start, e AS "end", token FROM placed WHERE NOT regexp_matches(token, '^\\s'))"""
TEXT_SQL = f"WITH {TOKENS_CTE}"

SPOT_SQL = f"""{KB_SQL},
{TOKENS_CTE},
lits AS (SELECT DISTINCT s.object AS literal_index, s.predicate AS property, s.belief, l.literal, lower(l.literal) AS low, len(regexp_extract_all(l.literal, '{_PIECE}')) AS n FROM symbols s JOIN lit_dict l ON l.index = s.object),
suf AS (SELECT t.doc_id, t.start, array_to_string(p[t.i:t.i + (SELECT max(n) FROM lits) - 1], '') AS surface FROM tokens t JOIN pieces USING (doc_id) WHERE regexp_matches(t.token, '^[\\p{{L}}\\p{{N}}]')),
hits AS (SELECT doc_id, start AS a, (start + length(literal))::INTEGER AS b, literal_index, property, belief, literal, substr(surface, 1, length(literal)) AS surface, substr(surface, length(literal) + 1, 2) AS rest
 FROM (SELECT *, substr(lower(surface), 1, k) AS head FROM suf, (SELECT DISTINCT least(length(low), 8) AS k FROM lits) WHERE length(surface) >= k) JOIN (SELECT *, substr(low, 1, 8) AS head FROM lits) USING (head) WHERE starts_with(lower(substr(surface, 1, 100)), low)),
spans AS (SELECT doc_id, a, b, literal_index, property, belief, literal, surface FROM hits WHERE NOT (regexp_matches(rest, '^[\\p{{L}}\\p{{N}}_]|^[''’.][\\p{{L}}\\p{{N}}_]') AND regexp_matches(literal, '[\\p{{L}}\\p{{N}}_]$'))),
distinct_spans AS (SELECT DISTINCT doc_id, a, b FROM spans),
longest AS (SELECT s.* FROM spans s WHERE NOT EXISTS (SELECT 1 FROM distinct_spans o WHERE o.doc_id = s.doc_id AND o.a <= s.a AND o.b >= s.b AND o.b - o.a > s.b - s.a)),
kept AS (SELECT * FROM longest QUALIFY literal = surface OR NOT bool_or(literal = surface) OVER (PARTITION BY doc_id, surface)),
inst AS (SELECT DISTINCT k.doc_id, k.a, k.b, k.property, k.literal_index, k.surface, s.subject, r.uri FROM kept k JOIN symbols s ON s.predicate = k.property AND s.object = k.literal_index JOIN res_dict r ON r.index = s.subject)"""

LINK_SQL = f"""{SPOT_SQL},
bip AS (SELECT DISTINCT doc_id, literal_index, subject FROM inst),
reach(doc_id, literal_index, component) AS (SELECT DISTINCT doc_id, literal_index, literal_index FROM bip UNION SELECT b2.doc_id, b2.literal_index, r.component FROM reach r JOIN bip b1 ON b1.doc_id = r.doc_id AND b1.literal_index = r.literal_index JOIN bip b2 ON b2.doc_id = b1.doc_id AND b2.subject = b1.subject),
labels AS (SELECT doc_id, literal_index, min(component) AS component FROM reach GROUP BY 1, 2),
candidates AS (SELECT doc_id, subject, min(component) AS component FROM bip JOIN labels USING (doc_id, literal_index) GROUP BY 1, 2),
forward AS (SELECT DISTINCT c.doc_id, c.subject AS src, r.object AS dst, r.predicate FROM candidates c JOIN relations r USING (subject) WHERE r.predicate <> (SELECT index FROM rdf_type)),
sized AS (SELECT *, count(*) OVER (PARTITION BY doc_id, component) AS size FROM candidates),
staged AS (SELECT f.*, s.size FROM forward f JOIN sized s ON s.doc_id = f.doc_id AND s.subject = f.src),
stage_ends AS (SELECT doc_id, src AS subject, size AS stage FROM staged UNION SELECT doc_id, dst, size FROM staged),
conn AS (SELECT c.doc_id, c.component, min(stage) AS stage FROM candidates c LEFT JOIN stage_ends e ON e.doc_id = c.doc_id AND e.subject = c.subject GROUP BY 1, 2),
stops AS (SELECT doc_id, max(stage) AS last, count(*) FILTER (stage IS NULL) AS open FROM conn GROUP BY 1),
lonely AS (SELECT c.* FROM candidates c JOIN conn n ON n.doc_id = c.doc_id AND n.component = c.component WHERE n.stage IS NULL),
edges AS (SELECT doc_id, src, dst, predicate FROM staged JOIN stops USING (doc_id) WHERE open > 0 OR size <= last UNION SELECT l.doc_id, r.subject, r.object, r.predicate FROM lonely l JOIN relations r ON r.object = l.subject),
simple AS (SELECT doc_id, src, dst, min(predicate) AS predicate FROM edges GROUP BY 1, 2, 3),
degrees AS (SELECT doc_id, node, sum(i)::BIGINT AS indegree, sum(o)::BIGINT AS outdegree FROM (SELECT doc_id, src AS node, 0 AS i, 1 AS o FROM simple UNION ALL SELECT doc_id, dst, 1, 0 FROM simple) GROUP BY 1, 2),
scored AS (SELECT c.doc_id, c.component, c.subject, coalesce(indegree + outdegree, 0)::DOUBLE AS degree, coalesce(least(indegree, outdegree), 0)::DOUBLE AS flow FROM candidates c LEFT JOIN degrees d ON d.doc_id = c.doc_id AND d.node = c.subject),
votes AS (SELECT doc_id, component, subject, CASE WHEN degree = max(degree) OVER w THEN 1 ELSE -1 END AS vote, count(*) OVER w AS n FROM scored WINDOW w AS (PARTITION BY doc_id, component)),
winners AS (SELECT c.doc_id, c.component, c.subject FROM candidates c LEFT JOIN (SELECT * FROM votes WHERE n > 1) v USING (doc_id, subject) QUALIFY row_number() OVER (PARTITION BY c.doc_id, c.component ORDER BY coalesce(vote, 0) DESC, c.subject) = 1),
resolved AS (SELECT i.* FROM inst i JOIN winners w USING (doc_id, subject)),
facts AS (SELECT DISTINCT r.doc_id, r.subject, e.predicate, e.object FROM (SELECT DISTINCT doc_id, subject FROM resolved) r JOIN relations e USING (subject)),
markov_top AS (SELECT subject, object, predicate, round(probability, 5) AS weight FROM markov_chain QUALIFY row_number() OVER (PARTITION BY subject, object ORDER BY probability DESC, predicate) <= 1),
predicted AS (SELECT a.doc_id, a.subject, t.predicate, b.subject AS object, t.weight FROM (SELECT DISTINCT doc_id, subject, cluster FROM resolved JOIN instance_clusters USING (subject)) a JOIN (SELECT DISTINCT doc_id, subject, cluster FROM resolved JOIN instance_clusters USING (subject)) b ON a.doc_id = b.doc_id AND a.subject <> b.subject JOIN markov_top t ON t.subject = a.cluster AND t.object = b.cluster)"""

RATE_SQL = f"""{LINK_SQL},
words AS (SELECT doc_id, lower(token) AS w FROM tokens),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY 1),
counts AS (SELECT doc_id, w, count(*) AS k FROM words GROUP BY 1, 2),
mention AS (SELECT doc_id, subject, a, lower(unnest(list_filter(regexp_extract_all(surface, '{_PIECE}'), lambda x: NOT regexp_matches(x, '^\\s')))) AS w FROM (SELECT DISTINCT doc_id, subject, a, surface FROM inst)),
r_frequency AS (SELECT doc_id, subject, max(tf) AS value FROM (SELECT doc_id, subject, a, avg(k / n) AS tf FROM mention JOIN counts USING (doc_id, w) JOIN sizes USING (doc_id) GROUP BY 1, 2, 3) GROUP BY 1, 2),
r_position AS (SELECT i.doc_id, subject, max(length(text) - a)::DOUBLE AS value FROM inst i JOIN documents d USING (doc_id) GROUP BY 1, 2 HAVING max(length(text) - a) > 0),
terms AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\S+')) AS term FROM documents),
dfs AS (SELECT term, count(DISTINCT doc_id) AS df FROM terms GROUP BY 1),
r_rarity AS (SELECT doc_id, subject, max(ln((SELECT count(*) FROM documents) / (coalesce(df, 0) + 1))) AS value FROM (SELECT DISTINCT doc_id, subject, surface FROM inst) LEFT JOIN dfs ON term = surface GROUP BY 1, 2),
r_degree AS (SELECT i.doc_id, i.subject, (indegree + outdegree)::DOUBLE AS value, least(indegree, outdegree)::DOUBLE AS capacity FROM (SELECT DISTINCT doc_id, subject FROM inst) i JOIN degrees d ON d.doc_id = i.doc_id AND d.node = i.subject),
ratings AS (SELECT doc_id, 'position' AS metric, subject, value FROM r_position UNION ALL SELECT doc_id, 'frequency', subject, value FROM r_frequency UNION ALL SELECT doc_id, 'rarity', subject, value FROM r_rarity UNION ALL SELECT doc_id, 'degree', subject, value FROM r_degree),
rowcount AS (SELECT doc_id, count(DISTINCT subject) AS n FROM ratings GROUP BY 1),
stats AS (SELECT doc_id, metric, sum(value) / any_value(n) AS mean, greatest((sum(value * value) - any_value(n) * (sum(value) / any_value(n)) * (sum(value) / any_value(n))) / nullif(any_value(n) - 1, 0), 0) AS var FROM ratings JOIN rowcount USING (doc_id) GROUP BY 1, 2),
normal AS (SELECT doc_id, metric, subject, CASE WHEN v <= 0 THEN 1e-5 ELSE v END AS value FROM (SELECT r.doc_id, r.metric, r.subject, (value - mean) / (CASE WHEN coalesce(var, 0) < 1e-18 THEN 1.0 ELSE sqrt(var) END) / 2 + 1 AS v FROM ratings r JOIN stats USING (doc_id, metric)))"""

#: PageRank and HITS of each document's graph: ``linking.ROUNDS`` rounds as recursion.
RANK_SQL = f"""{RATE_SQL},
nodes AS (SELECT doc_id, node, outdegree AS outs, count(*) OVER (PARTITION BY doc_id) AS n FROM degrees),
pr(doc_id, node, i, rank) AS (SELECT doc_id, node, 0, 1.0::DOUBLE / n FROM nodes UNION ALL
 SELECT t.doc_id, t.node, t.i + 1, 0.1 / t.n + 0.9 * (coalesce(g.given, 0) + t.lost / t.n) FROM (SELECT p.doc_id, p.node, p.i, k.n, sum(CASE WHEN k.outs = 0 THEN p.rank ELSE 0 END) OVER (PARTITION BY p.doc_id) AS lost FROM pr p JOIN nodes k ON k.doc_id = p.doc_id AND k.node = p.node WHERE p.i < {linking.ROUNDS}) t
 LEFT JOIN (SELECT e.doc_id, e.dst AS node, sum(p.rank / k.outs) AS given FROM pr p JOIN nodes k ON k.doc_id = p.doc_id AND k.node = p.node JOIN simple e ON e.doc_id = p.doc_id AND e.src = p.node GROUP BY 1, 2) g ON g.doc_id = t.doc_id AND g.node = t.node),
hubs(doc_id, node, i, hub, authority) AS (SELECT doc_id, node, 0, 1.0::DOUBLE, 1.0::DOUBLE FROM nodes UNION ALL
 SELECT doc_id, node, i + 1, h / greatest(sqrt(sum(h * h) OVER (PARTITION BY doc_id)), 1e-300), authority FROM (
 SELECT a.doc_id, a.node, a.i, a.authority, coalesce(sum(b.authority), 0) AS h FROM (SELECT *, a / greatest(sqrt(sum(a * a) OVER (PARTITION BY doc_id)), 1e-300) AS authority FROM (SELECT k.doc_id, k.node, k.i, coalesce(sum(s.hub), 0) AS a FROM hubs k LEFT JOIN simple e ON e.doc_id = k.doc_id AND e.dst = k.node LEFT JOIN hubs s ON s.doc_id = k.doc_id AND s.node = e.src WHERE k.i < {linking.ROUNDS} GROUP BY 1, 2, 3)) a
 LEFT JOIN simple e ON e.doc_id = a.doc_id AND e.src = a.node LEFT JOIN (SELECT doc_id, node, a / greatest(sqrt(sum(a * a) OVER (PARTITION BY doc_id)), 1e-300) AS authority FROM (SELECT k.doc_id, k.node, coalesce(sum(s.hub), 0) AS a FROM hubs k LEFT JOIN simple e ON e.doc_id = k.doc_id AND e.dst = k.node LEFT JOIN hubs s ON s.doc_id = k.doc_id AND s.node = e.src GROUP BY 1, 2)) b ON b.doc_id = a.doc_id AND b.node = e.dst GROUP BY 1, 2, 3, 4)),
links AS (SELECT p.doc_id, p.node, round(p.rank, 9) AS pagerank, round(h.hub, 9) AS hub, round(h.authority, 9) AS authority FROM pr p JOIN hubs h ON h.doc_id = p.doc_id AND h.node = p.node WHERE p.i = {linking.ROUNDS} AND h.i = {linking.ROUNDS})"""
