"""Features and classification of entities in labelled text. Rows: doc_id, sent, i (place in the sentence), word, pos, label."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weftline.functions.text import grams_of, ngrams, per_text, shape_of, word_features
from weftline.session import materialize

#: First two letters of the tags whose words count as context.
CONTENT_TAGS = ("NN", "VB", "JJ", "CD", "RB")


def content_features(label_share: float = 1.0) -> Column:
    """What a context word says: its label if it has one (with that probability, by a hash of its place), else itself if its tag counts."""
    labelled = F.col("w.label") != "O"
    drawn = F.pmod(F.xxhash64("doc_id", "sent", "w.i"), F.lit(1000)) < int(1000 * label_share)
    plain = word_features(F.col("w.word"), suffix=False)
    return F.when(labelled & drawn, F.array(F.col("w.label"))).when(labelled | F.left(F.col("w.pos"), F.lit(2)).isin(*CONTENT_TAGS), plain).otherwise(F.array().cast("array<string>"))


def examples(words: DataFrame) -> DataFrame:
    """doc_id, sent, lower, upper, label: runs of words with one label other than O."""
    w = W.partitionBy("doc_id", "sent").orderBy("i")
    starts = F.coalesce(F.lag("label").over(w) != F.col("label"), F.lit(True))
    runs = words.withColumn("run", F.sum(starts.cast("int")).over(w)).where("label <> 'O'")
    return runs.groupBy("doc_id", "sent", "run", "label").agg(F.min("i").alias("lower"), F.max("i").alias("upper")).drop("run")


def context_features(words: DataFrame, spans: DataFrame, sizes: tuple[int, ...] = (1, 2, 3), window: int = 4, label_share: float = 1.0) -> DataFrame:
    """doc_id, sent, lower, upper, label, features: n-grams of the context before (a:) and after (p:), and the words inside (i:).

    A context word counts if it is nearer than ``window``. Sentences are short, so each is one array.
    """
    sentence = words.groupBy("doc_id", "sent").agg(F.array_sort(F.collect_list(F.struct("i", "word", "pos", "label"))).alias("words"))
    rows = spans.join(sentence, ["doc_id", "sent"]).select("doc_id", "sent", "lower", "upper", "label", F.explode("words").alias("w"))
    side = F.when((F.col("w.i") < F.col("lower")) & (F.col("lower") - F.col("w.i") < window), "a").when((F.col("w.i") > F.col("upper")) & (F.col("w.i") - F.col("upper") < window), "p").when(F.col("w.i").between(F.col("lower"), F.col("upper")), "i")
    said = F.when(side == "i", word_features(F.col("w.word"))).otherwise(content_features(label_share))
    grouped = rows.withColumn("side", side).where("side is not null").withColumn("said", said).groupBy("doc_id", "sent", "lower", "upper", "label").agg(*[F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct(F.col("w.i").alias("i"), "said")))), lambda x: x["said"])).alias(s) for s in "api"])
    made = [ngrams(F.col(s), n, f"{s}:") for n in sizes for s in "ap"]
    return grouped.select("doc_id", "sent", "lower", "upper", "label", F.concat(*made, ngrams(F.col("i"), 1, "i:")).alias("features"))


def text_examples(docs: DataFrame, label_of: Callable[[str, int], str], sizes: tuple[int, ...] = (1, 2, 3), window: int = 4) -> DataFrame:
    """What ``context_features`` makes of ``examples`` of the words of ``docs``: one pass over each text, nothing is dealt.

    ``label_of`` gives the label of a word from its tag and its place in the sentence.
    """
    made = []

    def sentence(words, shape, found):
        labels = [label_of(pos, i) for _, pos, i in words]
        said = [[label] if label != "O" else [shape(word)] if pos[:2] in CONTENT_TAGS else [] for label, (word, pos, _) in zip(labels, words)]
        lower = 0
        while lower < len(words):
            label, upper = labels[lower], lower
            while upper + 1 < len(words) and labels[upper + 1] == label:
                upper += 1
            if label != "O":
                inside = []
                for word, _, _ in words[lower : upper + 1]:
                    kind = shape(word)
                    inside += [f"s:{word[-3:]}", word] if kind == word and len(word) > 3 else [kind]
                sides = {"a": sum(said[max(0, lower - window + 1) : lower], []), "p": sum(said[upper + 1 : upper + window], [])}
                features = [g for n in sizes for s in "ap" for g in grams_of(sides[s], n, f"{s}:")] + grams_of(inside, 1, "i:")
                found.append((lower, upper, label, features))
            lower = upper + 1

    def emit(rows):
        if not made:
            made.append(shape_of())
        found, words, at = [], [], 0
        for _, _, word, sent, pos, _, i in rows + [[0, 0, "", -1, "", "", 0]]:
            if sent != at:
                one = []
                sentence(words, made[0], one)
                found += [(at, *example) for example in one]
                words, at = [], sent
            words.append((word, pos, i))
        return found

    return per_text(docs, emit, "sent int, lower int, upper int, label string, features array<string>")


def coreference(words: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, sent, lower, upper, label: a pronoun that starts the sentence after one with a labelled run stands for that run's label."""
    pronouns = words.where("i = 0 and pos like 'PRP%'").select("doc_id", F.col("sent"))
    last = spans.groupBy("doc_id", "sent").agg(F.max(F.struct("upper", "label")).alias("l")).select("doc_id", (F.col("sent") + 1).alias("sent"), F.col("l.label").alias("label"))
    return pronouns.join(last, ["doc_id", "sent"]).select("doc_id", "sent", F.lit(0).alias("lower"), F.lit(0).alias("upper"), "label")


def serialize(rows: DataFrame) -> DataFrame:
    """line: name, label and features between spaces."""
    return rows.select(F.concat_ws(" ", F.concat_ws("-", "doc_id", "sent", "lower"), "label", "features").alias("line"))


def stop_features(rows: DataFrame, top: int, least: int) -> DataFrame:
    """feature, n, list: the ``top`` most frequent features (stop) and those seen fewer than ``least`` times (pruned)."""
    counts = rows.select(F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("n"))
    stop = counts.orderBy(F.desc("n"), "feature").limit(top).withColumn("list", F.lit("stop"))
    return stop.unionAll(counts.where(F.col("n") < least).withColumn("list", F.lit("pruned")))


def train_weights(rows: DataFrame) -> DataFrame:
    """label, feature, weight: add-one log P(feature | label), naive Bayes, the quick model; with the prior as feature ``*``."""
    counts = rows.select("label", F.explode("features").alias("feature")).groupBy("label", "feature").agg(F.count("*").alias("n"))
    size = counts.agg(F.count_distinct("feature").alias("v"))
    totals = counts.groupBy("label").agg(F.sum("n").alias("t")).crossJoin(F.broadcast(size))  # one row
    weights = counts.join(totals, "label").select("label", "feature", F.log((F.col("n") + 1) / (F.col("t") + F.col("v"))).alias("weight"))
    docs = rows.groupBy("label").agg(F.count("*").alias("n"))
    prior = docs.crossJoin(F.broadcast(docs.agg(F.sum("n").alias("all")))).select("label", F.lit("*").alias("feature"), F.log(F.col("n") / F.col("all")).alias("weight"))  # one row
    unseen = totals.select("label", F.lit("?").alias("feature"), F.log(1 / (F.col("t") + F.col("v"))).alias("weight"))
    return weights.unionAll(prior).unionAll(unseen)


def top_features(weights: DataFrame, k: int) -> DataFrame:
    """label, rank, feature: the k largest weights of each label."""
    rank = F.row_number().over(W.partitionBy("label").orderBy(F.desc("weight"), "feature"))
    return weights.where("feature not in ('*', '?')").withColumn("rank", rank).where(F.col("rank") <= k).select("label", "rank", "feature")


def classify(rows: DataFrame, weights: DataFrame, margin: float = 0.6) -> DataFrame:
    """doc_id, sent, lower, best, p1, p2, accepted: the likeliest label of each example, if it leads the next by more than ``margin``."""
    special = weights.where("feature in ('*', '?')").groupBy("label").agg(F.max(F.when(F.col("feature") == "*", F.col("weight"))).alias("prior"), F.max(F.when(F.col("feature") == "?", F.col("weight"))).alias("unseen"))
    keyed = rows.select("doc_id", "sent", "lower", F.explode_outer("features").alias("feature"))
    every = keyed.crossJoin(F.broadcast(special))  # as many rows as there are labels
    joined = every.join(weights.where("feature not in ('*', '?')"), ["label", "feature"], "left")
    summed = joined.groupBy("doc_id", "sent", "lower", "label").agg((F.first("prior") + F.sum(F.coalesce("weight", "unseen"))).alias("s"))
    w = W.partitionBy("doc_id", "sent", "lower")
    soft = summed.withColumn("e", F.exp(F.col("s") - F.max("s").over(w))).withColumn("p", F.col("e") / F.sum("e").over(w))
    order = F.row_number().over(w.orderBy(F.desc("p"), "label"))
    best = soft.withColumn("rank", order).where("rank <= 2").groupBy("doc_id", "sent", "lower").agg(F.max(F.when(F.col("rank") == 1, F.col("label"))).alias("best"), F.max(F.when(F.col("rank") == 1, F.col("p"))).alias("p1"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("p"))), F.lit(0.0)).alias("p2"))
    return best.withColumn("accepted", F.col("p1") - F.col("p2") > margin)


def judge(rows: DataFrame, folds: int = 1, margin: float = 0.6) -> DataFrame:
    """What ``classify`` finds with ``train_weights``: of all rows with weights of all rows (one fold), or of each fold of
    documents with weights of the others. doc_id, sent, lower, best, p1, p2, accepted.

    A feature is one row with its counts by label and fold, so a feature of an example is dealt once, and its sums once,
    whatever the number of labels and folds.
    """
    labels = [r["label"] for r in rows.groupBy("label").count().orderBy("label").collect()]  # of the schema's size
    if not labels:
        return classify(rows, train_weights(rows), margin)
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(folds)).cast("int") if folds > 1 else F.lit(0)
    cells = [(i, k) for i in range(len(labels)) for k in range(folds)]
    is_cell = lambda i, k: (F.col("label") == labels[i]) & (F.col("fold") == k)
    numbered = rows.withColumn("fold", fold)
    tally = lambda df, *by: df.groupBy(*by).agg(*[F.count(F.when(is_cell(i, k), 1)).alias(f"n{i}_{k}") for i, k in cells])
    counts = materialize(tally(numbered.select("label", "fold", F.explode("features").alias("feature")), "feature"))
    # the counts that a fold's weights come from: all without its own
    trained = lambda i, k: sum((F.col(f"n{i}_{j}") for j in range(folds) if folds == 1 or j != k), F.lit(0))
    vocabulary = lambda k: F.count(F.when(sum((trained(i, k) for i in range(len(labels))), F.lit(0)) > 0, 1))
    totals = counts.agg(*[F.coalesce(F.sum(trained(i, k)), F.lit(0)).alias(f"t{i}_{k}") for i, k in cells], *[vocabulary(k).alias(f"v_{k}") for k in range(folds)]).head()
    seen = tally(numbered).select(*[trained(i, k).alias(f"d{i}_{k}") for i, k in cells]).head()
    by_fold = lambda pick: F.element_at(F.array(*[pick(k) for k in range(folds)]), F.col("fold") + 1)

    def weight(i):
        # of a feature that training has not seen, the count is 0
        return by_fold(lambda k: F.log((F.coalesce(trained(i, k), F.lit(0)) + 1) / (totals[f"t{i}_{k}"] + totals[f"v_{k}"] or 1)))

    def prior(i):
        """Null where training has no example of the label: it is none to choose."""
        return by_fold(lambda k: F.log(F.lit(float(seen[f"d{i}_{k}"])) / sum(seen[f"d{j}_{k}"] for j in range(len(labels)))) if seen[f"d{i}_{k}"] else F.lit(None).cast("double"))

    keyed = rows.select("doc_id", "sent", "lower", F.explode_outer("features").alias("feature"))
    joined = keyed.join(counts, "feature", "left").withColumn("fold", fold)
    summed = joined.groupBy("doc_id", "sent", "lower").agg(*[F.sum(weight(i)).alias(f"s{i}") for i in range(len(labels))]).withColumn("fold", fold)
    scored = F.filter(F.array(*[F.struct((prior(i) + F.col(f"s{i}")).alias("s"), F.lit(label).alias("label")) for i, label in enumerate(labels)]), lambda x: x["s"].isNotNull())
    most = F.array_max(F.transform("scored", lambda x: x["s"]))
    soft = F.transform("scored", lambda x: F.struct(F.exp(x["s"] - F.col("most")).alias("e"), x["label"].alias("label")))
    total = F.aggregate("soft", F.lit(0.0), lambda a, x: a + x["e"])
    ranked = F.array_sort(F.transform("soft", lambda x: F.struct((-(x["e"] / F.col("total"))).alias("p"), x["label"].alias("label"))))
    # each a column of its own: inside a lambda it would be made again for each label
    found = summed.withColumn("scored", scored).withColumn("most", most).withColumn("soft", soft).withColumn("total", total).withColumn("r", ranked)
    first, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    best = found.select("doc_id", "sent", "lower", first["label"].alias("best"), (-first["p"]).alias("p1"), F.coalesce(-second["p"], F.lit(0.0)).alias("p2")).where("best is not null")
    return best.withColumn("accepted", F.col("p1") - F.col("p2") > margin)


def fold_scores(rows: DataFrame, folds: int = 10, margin: float = 0.0) -> DataFrame:
    """label, precision, recall, f1 over folds by document: each fold is classified with weights from the others."""
    from weftline.operators.evaluation import precision_recall

    found = judge(rows, folds, margin).where("accepted").select("doc_id", "sent", "lower", F.col("best").alias("label"))
    scores = precision_recall(found, rows, ["doc_id", "sent", "lower"], ["label"])
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return scores.select("label", "precision", "recall", f1.alias("f1"))


def train_maxent(rows: DataFrame, strength: float = 0.01, rounds: int = 50):
    """A maximum-entropy model (multinomial logistic regression over counts of features) of rows with label and features."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer, StringIndexer

    return Pipeline(stages=[
        StringIndexer(inputCol="label", outputCol="label_number", stringOrderType="alphabetAsc", handleInvalid="keep"),
        CountVectorizer(inputCol="features", outputCol="counts"),
        LogisticRegression(featuresCol="counts", labelCol="label_number", family="multinomial", regParam=strength, maxIter=rounds),
    ]).fit(rows)


def apply_maxent(model, rows: DataFrame, keys: list[str], margin: float = 0.6) -> DataFrame:
    """keys, best, p1, p2, accepted: the likeliest label of each row, if it leads the next by more than ``margin``."""
    from pyspark.ml.functions import vector_to_array

    names = F.array(*[F.lit(x) for x in model.stages[0].labels])
    plain = rows.withColumn("label", F.lit(model.stages[0].labels[0]))  # the indexer asks for a label, the model does not
    scored = model.transform(plain).withColumn("p", F.slice(vector_to_array("probability"), 1, F.size(names)))
    ranked = F.reverse(F.array_sort(F.transform(F.arrays_zip("p", names.alias("label")), lambda x: F.struct(x["p"].alias("p"), x["label"].alias("label")))))
    best = scored.select(*keys, ranked.alias("r"))
    first, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    return best.select(*keys, first["label"].alias("best"), first["p"].alias("p1"), F.coalesce(second["p"], F.lit(0.0)).alias("p2")).withColumn("accepted", F.col("p1") - F.col("p2") > margin)


def window_features(words: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, sent, i, label (np), features: the words (W=) and tags (T=) at each distance up to ``width``."""
    w = W.partitionBy("doc_id", "sent").orderBy("i")
    said = []
    for k in range(-width, width + 1):
        for name, column in (("W", "word"), ("T", "pos")):
            said.append(F.concat(F.lit(f"{name}{k}="), F.lag(F.lower(column), -k).over(w)))
    return words.select("doc_id", "sent", "i", F.col("np").alias("label"), F.filter(F.array(*said), lambda x: x.isNotNull()).alias("features"))


def evaluate_chunker(words: DataFrame, share: float = 0.8) -> DataFrame:
    """label, precision, recall, f1 of noun-phrase tags by a maximum-entropy tagger trained on ``share`` of the documents and
    tested on the others."""
    from weftline.operators.evaluation import precision_recall

    rows = window_features(words).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(100)))
    model = train_maxent(rows.where(F.col("part") < int(100 * share)))
    test = rows.where(F.col("part") >= int(100 * share))
    found = apply_maxent(model, test, ["doc_id", "sent", "i"], margin=0.0).select("doc_id", "sent", "i", F.col("best").alias("label"))
    scores = precision_recall(found, test, ["doc_id", "sent", "i"], ["label"])
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return scores.select("label", "precision", "recall", f1.alias("f1"))
