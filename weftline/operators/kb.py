"""The knowledge base: dictionaries, encoded triples, lookups and statistics, all as DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from weftline.functions.filters import likely
from weftline.session import materialize
from weftline.sources.triples import BASE, RDF_TYPE, TRIPLES_SQL, ingest, literal_hash, literal_hash_sql, star_triples

#: Characters of the prefix hash.
PREFIX = 4


def numbered(df: DataFrame, key: str, name: str = "index") -> DataFrame:
    """Consecutive numbers from 1 in the order of distinct ``key`` values, without bringing all rows to one task.

    Rows are dealt by ranges and sorted, numbered within their partition, and shifted by the sizes of the partitions
    before; those sizes are one row for each partition. Rows are dealt once.
    """
    # the number of the partition in the upper bits, the place in it in the lower 33
    placed = materialize(df.repartitionByRange(key).sortWithinPartitions(key).withColumn("_id", F.monotonically_increasing_id()))
    part, rank = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, (rank + F.col("_before") + 1).cast("int")).drop("_part", "_id", "_before")


def table_of_type(uri: Column) -> Column:
    """The cluster of a type of the relational tables: sub-types (names with a hyphen) belong to their table's type."""
    base = F.regexp_extract(uri, r"/type/([a-z]+)", 1)
    base = F.when(base == "segment", "customer").when(base == "priority", "order").otherwise(base)
    return F.concat(F.lit(f"{BASE}type/"), base)


class KnowledgeBase:
    """Everything derived from ingested triples (s, p, o, kind). Attributes are DataFrames; shared ones are written once.

    ``cluster_uri`` gives the URI of a type's cluster from the URI of the type, where the naming of types is known; without
    it types are clustered by how their instances coincide. ``keep`` writes the triples; without it they are read from
    their source each time, which is less work where that is a table: only the columns and tables that a step asks for
    are read.
    """

    def __init__(self, triples: DataFrame, cluster_uri: Callable[[Column], Column] | None = None, keep: bool = True):
        self.triples = materialize(triples) if keep else triples
        self.spark = triples.sparkSession
        self.cluster_uri = cluster_uri

    @classmethod
    def of_folder(cls, spark: SparkSession, folder: str) -> KnowledgeBase:
        """The knowledge base of a data folder, made once for each session."""
        made = getattr(spark, "_weftline_kb", None)
        if made is None:
            made = spark._weftline_kb = {}
        if folder not in made:
            made[folder] = cls(ingest(star_triples(spark, folder)), table_of_type, keep=False)
        return made[folder]

    # dictionaries and encoding

    @cached_property
    def resources(self) -> DataFrame:
        t = self.triples
        uris = t.select(F.col("s").alias("uri")).unionAll(t.select("p")).unionAll(t.where("kind = 'uri'").select("o")).distinct()
        return materialize(numbered(uris, "uri").select("index", "uri"))

    @cached_property
    def literals(self) -> DataFrame:
        texts = self.triples.where("kind = 'literal'").select(F.col("o").alias("literal")).distinct()
        return materialize(numbered(texts, "literal").select("index", "literal", literal_hash(F.lower("literal"), PREFIX).alias("prefix")))

    @cached_property
    def predicates(self) -> DataFrame:
        """uri, predicate, kind: the properties of the schema with the kinds of their objects."""
        found = self.triples.where("kind in ('uri', 'literal')").select(F.col("p").alias("uri"), "kind").distinct()
        return materialize(F.broadcast(found).join(self.resources, "uri").select("uri", F.col("index").alias("predicate"), "kind"))

    def _properties(self, kind: str) -> DataFrame:
        """p, predicate: one row for each property of the schema with objects of that kind."""
        return self.predicates.where(F.col("kind") == kind).select(F.col("uri").alias("p"), "predicate")

    @cached_property
    def property_names(self) -> DataFrame:
        """predicate, uri: one row for each property of the schema."""
        return F.broadcast(self.predicates.select("predicate", "uri").distinct())

    def named(self, ids: DataFrame) -> DataFrame:
        """index, uri of ``ids`` (index). The dictionary is read, not dealt."""
        ids = ids.select("index").distinct()
        return likely(self.resources, ["index"], ids).join(ids, "index").select("index", "uri")

    def _edges(self, side: str, own: DataFrame, triples: DataFrame | None = None) -> DataFrame:
        """subject, predicate, object: the relations with ``own`` (index, uri) as ``side``. Only their triples are dealt
        and encoded, so the work grows with what is asked for and not with the knowledge base."""
        near, far, other = ("s", "o", "object") if side == "subject" else ("o", "s", "subject")
        found = likely((self.triples if triples is None else triples).where("kind = 'uri'"), [near], own.select("uri"))
        coded = found.join(F.broadcast(self._properties("uri")), "p").join(own.select(F.col("uri").alias(near), F.col("index").alias(side)), near)
        coded = materialize(coded.select(side, "predicate", far))
        ends = likely(self.resources, ["uri"], coded.select(far)).select(F.col("uri").alias(far), F.col("index").alias(other))
        return coded.join(ends, far).select("subject", "predicate", "object")

    def _coded(self, kind: str, objects: DataFrame, text: str, triples: DataFrame | None = None) -> DataFrame:
        found = (self.triples if triples is None else triples).where(F.col("kind") == kind)
        # subjects of all relations are nearly all resources, those of literals are few
        ids = likely(self.resources, ["uri"], found.select("s")) if kind == "literal" else self.resources
        coded = found.join(F.broadcast(self._properties(kind)), "p")
        coded = coded.join(ids.select(F.col("uri").alias("s"), F.col("index").alias("subject")), "s")
        return coded.join(objects.select(F.col(text).alias("o"), F.col("index").alias("object")), "o").select("subject", "predicate", "object")

    @cached_property
    def relations(self) -> DataFrame:
        """Object properties, a bag."""
        return materialize(self._coded("uri", self.resources, "uri"))

    @cached_property
    def symbols(self) -> DataFrame:
        """Datatype properties, a set; belief is 1, type unknown."""
        coded = self._coded("literal", self.literals, "literal").distinct()
        return materialize(coded.withColumn("belief", F.lit(1.0)).withColumn("type", F.lit(None).cast("int")))

    def uri_index(self, uri: str) -> int | None:
        found = self.resources.where(F.col("uri") == uri).select("index").head()
        return found["index"] if found else None

    def property_ids(self, *names: str) -> DataFrame:
        return self.resources.where(F.col("uri").isin(*[BASE + n for n in names]))

    @cached_property
    def rdf_type(self) -> Column:
        found = self.uri_index(RDF_TYPE)
        return F.lit(-1 if found is None else found)  # ids start at 1: without types no predicate is the type

    # lookups

    @cached_property
    def types(self) -> DataFrame:
        """subject, type: a bag. Only the triples of types are encoded, their objects by the few types of the schema."""
        return materialize(self._type_triples().join(self.resources.select(F.col("uri").alias("s"), F.col("index").alias("subject")), "s").select("subject", "type"))

    @cached_property
    def type_names(self) -> DataFrame:
        """type, uri: the types of the schema."""
        found = self.triples.where((F.col("kind") == "uri") & (F.col("p") == RDF_TYPE)).select(F.col("o").alias("uri")).distinct()
        return materialize(F.broadcast(found).join(self.resources, "uri").select(F.col("index").alias("type"), "uri"))

    def outgoing(self, ids: DataFrame) -> DataFrame:
        """subject, predicate, object, a bag: the relations of the subjects ``ids`` (index)."""
        return self._edges("subject", materialize(self.named(ids)))

    def incoming(self, ids: DataFrame) -> DataFrame:
        """subject, predicate, object, a bag: the relations with the objects ``ids`` (index)."""
        return self._edges("object", materialize(self.named(ids)))

    def _type_triples(self) -> DataFrame:
        """s, type: the triples of types, only their objects encoded."""
        found = self.triples.where((F.col("kind") == "uri") & (F.col("p") == RDF_TYPE)).select("s", "o")
        return found.join(F.broadcast(self.type_names.select(F.col("uri").alias("o"), "type")), "o").select("s", "type")

    def types_of(self, ids: DataFrame) -> DataFrame:
        """subject, type of ``ids`` (index), a bag. Only their triples are dealt."""
        own = materialize(self.named(ids))
        found = likely(self._type_triples(), ["s"], own.select("uri"))
        return found.join(own.select(F.col("uri").alias("s"), F.col("index").alias("subject")), "s").select("subject", "type")

    def clusters_of(self, ids: DataFrame) -> DataFrame:
        """subject, cluster: ``classifications`` of ``ids`` (index) alone."""
        return self.types_of(ids).join(F.broadcast(self.type_clusters), "type").select("subject", "cluster").distinct()

    def best_cluster_of(self, ids: DataFrame) -> DataFrame:
        """subject, cluster: ``instance_clusters`` of ``ids`` (index) alone."""
        return self._best_clusters(self.types_of(ids))

    def sample_instances(self, n: int) -> DataFrame:
        """type, subject: the n first subjects of each type."""
        rank = F.row_number().over(W.partitionBy("type").orderBy("subject"))
        return self.types.distinct().withColumn("rank", rank).where(F.col("rank") <= n).select("type", "subject")

    @cached_property
    def property_types(self) -> DataFrame:
        """predicate, kind: 1 for a datatype, 2 for an object property; datatype wins."""
        kind = F.when(F.col("kind") == "literal", 1).otherwise(2)
        return self.predicates.groupBy("predicate").agg(F.min(kind).alias("kind"))

    def literal_candidates(self, hashes: DataFrame, predicates: DataFrame | None = None) -> DataFrame:
        """Distinct literals with a prefix hash among ``hashes`` (prefix), of the given predicates only if there are any."""
        found = self.literals.join(hashes.select("prefix").distinct(), "prefix", "left_semi")
        rows = self.symbols if predicates is None else self.symbols.join(predicates.select(F.col("index").alias("predicate")), "predicate", "left_semi")
        return found.join(rows, found["index"] == rows["object"]).select(F.lower("literal").alias("lower_literal"), found["index"].alias("literal_index"), "predicate", "belief", "literal").distinct()

    def instance_candidates(self, pairs: DataFrame) -> DataFrame:
        """Distinct (subject, predicate, object, uri) for ``pairs`` of (predicate, object)."""
        found = self.symbols.join(pairs.select("predicate", "object").distinct(), ["predicate", "object"])
        return found.join(self.resources, found["subject"] == self.resources["index"]).select("subject", "predicate", "object", "uri").distinct()

    # statistics

    @cached_property
    def histogram_literals(self) -> DataFrame:
        return self.symbols.groupBy(F.col("object").alias("literal")).agg(F.count_distinct("subject").alias("count"))

    @cached_property
    def ambiguity(self) -> DataFrame:
        joined = self.symbols.join(self.histogram_literals, F.col("object") == F.col("literal"))
        return joined.groupBy(F.col("predicate").alias("attribute")).agg(F.avg("count").alias("avg_references"))

    @cached_property
    def histogram_types(self) -> DataFrame:
        return self.types.groupBy("type").agg(F.count_distinct("subject").alias("count"))

    @cached_property
    def histogram_symbols(self) -> DataFrame:
        return self.symbols.groupBy("predicate").agg(F.count_distinct("object").alias("count"))

    def subject_ratio(self, predicates: DataFrame) -> DataFrame:
        """predicate, ratio: triples for each distinct subject, of ``predicates`` (predicate) alone; no triple is encoded."""
        known = self._properties("uri").join(predicates.select("predicate").distinct(), "predicate", "left_semi")
        found = self.triples.where("kind = 'uri'").join(F.broadcast(known), "p")  # one row for each property of the schema
        return found.groupBy("predicate", "s").agg(F.count("*").alias("n")).groupBy("predicate").agg((F.sum("n") / F.count("*")).alias("ratio"))

    def cardinality(self, side: str) -> DataFrame:
        """For each predicate: distinct subjects or objects, triples, and triples for each of them."""
        # two levels: partial sums by (predicate, side) come first, so a hot predicate's rows never meet in one task
        each = self.relations.groupBy("predicate", side).agg(F.count("*").alias("n"))
        return each.groupBy("predicate").agg(F.count("*").alias("count"), F.sum("n").alias("sum"), (F.sum("n") / F.count("*")).alias("ratio"))

    @cached_property
    def type_clusters(self) -> DataFrame:
        """type, cluster."""
        if self.cluster_uri is None:
            return self.correlated_clusters()
        named = self.type_names.select("type", self.cluster_uri(F.col("uri")).alias("uri"))
        return materialize(F.broadcast(named).join(self.resources, "uri").select("type", F.col("index").alias("cluster")))

    def correlated_clusters(self, n: int = 50, threshold: float = 0.5) -> DataFrame:
        """type, cluster: types whose instances coincide, each cluster named by its label; a type left alone is its own cluster.

        Over n sampled instances of each type: Pearson correlations of the types' co-occurrences, average linkage, and as
        label the type that says most about the members.
        """
        from weftline.operators import matrix

        together = materialize(self.type_cooccurrence(n).select(F.col("t1").alias("row"), F.col("t2").alias("col"), F.col("count").cast("double").alias("value")))
        found = materialize(matrix.hierarchical(matrix.pearson(together), threshold))
        labels = matrix.label_clusters(found, matrix.conditional(together).select("a", "b", "probability"))
        named = found.join(labels, "cluster").select(F.col("item").alias("type"), F.col("label").alias("cluster"))
        alone = self.types.select("type").distinct().join(named, "type", "left_anti").select("type", F.col("type").alias("cluster"))
        return materialize(named.unionAll(alone))

    @cached_property
    def classifications(self) -> DataFrame:
        """instance, type: the clusters of each instance."""
        small = F.broadcast(self.type_clusters)  # one row for each type of the schema
        return materialize(self.types.join(small, "type").select(F.col("subject").alias("instance"), F.col("cluster").alias("type")).distinct())

    @cached_property
    def instance_clusters(self) -> DataFrame:
        """subject, cluster: the cluster that covers most of a subject's types; of equals the least id."""
        return self._best_clusters(self.types)

    def _best_clusters(self, types: DataFrame) -> DataFrame:
        counted = types.distinct().join(F.broadcast(self.type_clusters), "type").groupBy("subject", "cluster").agg(F.count_distinct("type").alias("n"))
        return counted.groupBy("subject").agg(F.min(F.struct((-F.col("n")).alias("n"), "cluster")).alias("best")).select("subject", F.col("best.cluster").alias("cluster"))

    def markov_chain(self, n: int, blacklist: tuple[str, ...] = ()) -> DataFrame:
        """subject, predicate, object (clusters), probability: over the out-edges of n instances of each cluster."""
        # ids have the order of URIs, so the first instances are known before any is encoded; a task keeps n of each cluster
        rank = F.dense_rank().over(W.partitionBy("cluster").orderBy("s"))
        members = self._type_triples().join(F.broadcast(self.type_clusters), "type").select("cluster", "s")
        sample = materialize(members.withColumn("rank", rank).where(F.col("rank") <= n).select("cluster", F.col("s").alias("uri")).distinct())
        own = materialize(likely(self.resources, ["uri"], sample.select("uri")).join(F.broadcast(sample.select("uri").distinct()), "uri", "left_semi").select("index", "uri"))
        triples = self.triples if not blacklist else self.triples.where(~F.col("p").isin(*blacklist))
        edges = materialize(self._edges("subject", own, triples))
        of_cluster = sample.join(own, "uri").select("cluster", F.col("index").alias("subject"))
        steps = F.broadcast(of_cluster).join(edges, "subject").select("cluster", "predicate", "object")
        ends = self.clusters_of(edges.select(F.col("object").alias("index"))).select(F.col("subject").alias("object"), F.col("cluster").alias("type"))
        counted = steps.join(ends, "object").groupBy("cluster", "predicate", "type").agg(F.count("*").alias("n"))
        total = F.sum("n").over(W.partitionBy("cluster"))
        return counted.select(F.col("cluster").alias("subject"), "predicate", F.col("type").alias("object"), (F.col("n") / total).alias("probability"))

    def markov_top(self, chain: DataFrame, k: int) -> DataFrame:
        """The k most probable predicates of each pair of clusters; weights have five decimals."""
        rank = F.row_number().over(W.partitionBy("subject", "object").orderBy(F.desc("probability"), "predicate"))
        return chain.withColumn("rank", rank).where(F.col("rank") <= k).select("subject", "object", "predicate", F.round("probability", 5).alias("weight"))

    @cached_property
    def coverage_ambiguity(self) -> DataFrame:
        """cluster, property, coverage, ambiguity for all clusters at once."""
        clusters = F.broadcast(self.type_clusters.select(F.col("cluster").alias("object")).distinct())
        # only the triples whose object is a cluster are encoded
        named = materialize(clusters.join(self.resources, F.col("object") == F.col("index")).select("uri"))
        pointing = self.triples.where(F.col("kind") == "uri").join(F.broadcast(named), F.col("o") == F.col("uri"), "left_semi")
        members = self._coded("uri", F.broadcast(self.resources.join(F.broadcast(named), "uri", "left_semi")), "uri", pointing)
        members = members.join(F.broadcast(self.histogram_types.withColumnRenamed("type", "object")), "object")
        rows = members.select("subject", F.col("object").alias("cluster"), "count").join(self.symbols.select("subject", F.col("predicate").alias("property")), "subject")
        covered = rows.groupBy("cluster", "property").agg((F.count_distinct("subject") / F.avg("count")).alias("coverage"))
        return covered.join(self.ambiguity, F.col("property") == F.col("attribute")).select("cluster", "property", "coverage", F.col("avg_references").alias("ambiguity"))

    def proper_noun_rating(self, idf: DataFrame) -> DataFrame:
        """cluster, property, rating, coverage, ambiguity, idf; ``idf``: property, score (0 where unseen)."""
        joined = self.coverage_ambiguity.join(idf, "property", "left").withColumn("idf", F.coalesce("score", F.lit(0.0)))
        return joined.select("cluster", "property", (F.col("coverage") / F.col("ambiguity") * F.col("idf")).alias("rating"), "coverage", "ambiguity", "idf")

    def regex_distribution(self, patterns: dict[str, str], least: float = 0.9) -> DataFrame:
        """regex, property, ratio: the share of a property's distinct literals that match, where it exceeds ``least``."""
        rows = self.symbols.join(self.literals, F.col("object") == F.col("index")).groupBy("predicate", "object").agg(F.first("literal").alias("literal"))
        found = rows.groupBy("predicate").agg(F.count("*").alias("n"), *[F.sum(F.col("literal").rlike(p).cast("long")).alias(name) for name, p in patterns.items()])
        long = found.unpivot(["predicate", "n"], list(patterns), "regex", "hits")
        return long.select("regex", F.col("predicate").alias("property"), (F.col("hits") / F.col("n")).alias("ratio")).where(F.col("ratio") > least)

    def type_cooccurrence(self, n: int) -> DataFrame:
        """t1, t2, count: over n sampled instances of each type, how often both types occur together (with themselves too)."""
        sets = self.sample_instances(n).select("subject").distinct().join(self.types.distinct(), "subject")
        a, b = sets.select("subject", F.col("type").alias("t1")), sets.select("subject", F.col("type").alias("t2"))
        return a.join(b, "subject").groupBy("t1", "t2").agg(F.count("*").alias("count"))

    @cached_property
    def literal_lengths(self) -> DataFrame:
        return self.literals.groupBy(F.length("literal").alias("length")).agg(F.count("*").alias("count"))


KB_SQL = f"""WITH RECURSIVE {TRIPLES_SQL.strip()},
res_dict AS (SELECT row_number() OVER (ORDER BY uri)::INTEGER AS index, uri FROM (SELECT s AS uri FROM ingested UNION SELECT p FROM ingested UNION SELECT o FROM ingested WHERE kind = 'uri')),
lit_dict AS (SELECT row_number() OVER (ORDER BY literal)::INTEGER AS index, literal, {literal_hash_sql('lower(literal)', PREFIX)} AS prefix FROM (SELECT DISTINCT o AS literal FROM ingested WHERE kind = 'literal')),
relations AS (SELECT a.index AS subject, b.index AS predicate, c.index AS object FROM ingested t JOIN res_dict a ON a.uri = t.s JOIN res_dict b ON b.uri = t.p JOIN res_dict c ON c.uri = t.o WHERE kind = 'uri'),
symbols AS (SELECT DISTINCT a.index AS subject, b.index AS predicate, c.index AS object, 1.0::DOUBLE AS belief, NULL::INTEGER AS type FROM ingested t JOIN res_dict a ON a.uri = t.s JOIN res_dict b ON b.uri = t.p JOIN lit_dict c ON c.literal = t.o WHERE kind = 'literal'),
rdf_type AS (SELECT index FROM res_dict WHERE uri = '{RDF_TYPE}'),
types AS (SELECT subject, object AS type FROM relations WHERE predicate = (SELECT index FROM rdf_type)),
histogram_literals AS (SELECT object AS literal, count(DISTINCT subject) AS count FROM symbols GROUP BY 1),
ambiguity_symbols AS (SELECT predicate AS attribute, avg(h.count) AS avg_references FROM symbols s JOIN histogram_literals h ON h.literal = s.object GROUP BY 1),
histogram_types AS (SELECT type, count(DISTINCT subject) AS count FROM types GROUP BY 1),
type_clusters AS (SELECT t.type, r.index AS cluster FROM (SELECT DISTINCT type, regexp_extract(uri, '/type/([a-z]+)', 1) AS base FROM types JOIN res_dict ON index = type) t JOIN res_dict r ON r.uri = '{BASE}type/' || CASE base WHEN 'segment' THEN 'customer' WHEN 'priority' THEN 'order' ELSE base END),
classifications AS (SELECT DISTINCT subject AS instance, cluster AS type FROM types JOIN type_clusters USING (type)),
cluster_votes AS (SELECT subject, cluster, count(DISTINCT type) AS n FROM types JOIN type_clusters USING (type) GROUP BY 1, 2),
instance_clusters AS (SELECT subject, cluster FROM cluster_votes QUALIFY row_number() OVER (PARTITION BY subject ORDER BY n DESC, cluster) = 1),
markov_sample AS (SELECT type AS cluster, instance AS subject FROM classifications QUALIFY row_number() OVER (PARTITION BY type ORDER BY instance) <= 100),
markov_counts AS (SELECT m.cluster AS subject, r.predicate, c.type AS object, count(*) AS n FROM markov_sample m JOIN relations r USING (subject) JOIN classifications c ON c.instance = r.object GROUP BY 1, 2, 3),
markov_chain AS (SELECT subject, predicate, object, n / sum(n) OVER (PARTITION BY subject) AS probability FROM markov_counts)"""
