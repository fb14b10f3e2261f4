"""Secret scan: a random forest over candidate strings removes false positives. DataFrame and SQL functions only.

Candidates are the values and other runs of 16 or more key characters of every word, and values of eight or more that a
name of credentials stands before. Features: length, transitions
between character classes, spread of characters, coverage by a dictionary of frequent words, the
document's path or source, and the words, or text of the same word, before and after. The forest is trained on labelled
findings, a bounded sample of `max_labelled` rows by hash (documented parameter).
"""

from __future__ import annotations

import re

from pyspark.ml import Model, Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .idfilter import split_by_ids

RUN = "[A-Za-z0-9+/_=-]{16,}"
#: Of "name=value" the value.
VALUE = "([=:]\"?'?)([A-Za-z0-9+/_-]{16,}={0,2})"
#: Of "password=value", and other names of credentials, the value from eight characters on.
NAMED = "(?i)((?:token|secret|passw|pwd|api_?key|credential)[A-Za-z_]*[\"']?[=:][\"']?)([A-Za-z0-9+/_-]{8,}={0,2})"
MARK = "\x01"
FEATURES = (
    "length digits uppers lowers hexes distinct dashes lower_digit digit_lower upper_digit digit_upper lower_upper upper_lower turns vowels "
    "covered path_length path_test before_credential before_sign inside_credential inside_sign before_digest after_digest quoted"
).split()
CREDENTIAL = "(?i)(token|secret|passw|passwd|pwd|api|key|auth|bearer|credential)"
DIGEST = "(?i)(sha|md5|commit|uuid|checksum|digest|hash|revision|etag)"


def dictionary(texts: DataFrame, size: int = 300) -> list[str]:
    """The `size` most frequent words of three letters or more in texts(text), of equal ones the first by name: a bounded list."""
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}]{3,}"), 0)).alias("w")
    return [r[0] for r in texts.select(word).groupBy("w").count().orderBy(F.desc("count"), "w").limit(size).collect()]


def _cut(word: Column) -> Column:
    """Text, candidate, text, candidate, ..., text: all values of a word and all runs of what is left, in their order."""
    parts = F.split(F.regexp_replace(F.translate(word, MARK, "\x02"), NAMED, f"$1{MARK}$2{MARK}"), MARK)
    for pattern, put in ((VALUE, f"$1{MARK}$2{MARK}"), (f"({RUN})", f"{MARK}$1{MARK}")):
        each = F.transform(parts, lambda p, k: F.when(k % 2 == 1, F.concat(F.lit(MARK), p, F.lit(MARK))).otherwise(F.regexp_replace(p, pattern, put)))  # noqa: B023
        parts = F.split(F.array_join(each, ""), MARK)
    return parts


def _may_hold(word: Column) -> Column:
    """Whether a word has a candidate; the names are looked for only where a value can follow."""
    return (F.length(word) >= 12) & (word.rlike(RUN) | (word.rlike("[=:]") & word.rlike(NAMED)))


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """A row for every candidate of docs(doc_id, text, source): doc_id, path, word_index, match_index, candidate, lead, trail, before2, before, after.

    match_index counts the candidates of a word; lead and trail are the word's text up to the
    candidates beside it. Two words before and one after are its neighbours; between two candidates
    of a word the text there takes their place. Null, empty and blank texts have none; a repeated
    document repeats its rows. Whole texts are read, at any length.
    """
    source = F.coalesce(F.col(path).cast("string"), F.lit("")) if path in docs.columns else F.lit("")
    rows = docs.select("doc_id", source.alias("path"), F.split(F.col("text").cast("string"), "[ \\t\\n\\x0B\\f\\r]+").alias("ws")).filter(F.exists("ws", _may_hold))
    at = F.filter(F.sequence(F.lit(0), F.size("ws") - 1), lambda i: _may_hold(F.get("ws", i)))
    word = lambda d: F.coalesce(F.get("ws", F.col("i") + d), F.lit(""))
    out = rows.select("doc_id", "path", "ws", F.explode(at).alias("i"))
    out = out.select("doc_id", "path", F.col("i").cast("long").alias("word_index"), _cut(word(0)).alias("ms"), word(-2).alias("w2"), word(-1).alias("w1"), word(1).alias("w3"))
    # the cut word is not carried on: a long one would be copied to every match
    match = lambda m: F.struct(m.cast("long").alias("match_index"), F.get("ms", 2 * m + 1).alias("candidate"), F.get("ms", 2 * m).alias("lead"), F.get("ms", 2 * m + 2).alias("trail"), (2 * m + 3 == F.size("ms")).alias("last"))
    ms = F.transform(F.sequence(F.lit(0), F.floor((F.size("ms") - 3) / 2).cast("int")), match)
    out = out.select("doc_id", "path", "word_index", F.explode(ms).alias("m"), "w2", "w1", "w3").select("doc_id", "path", "word_index", "m.*", "w2", "w1", "w3")
    first = F.col("match_index") == 0
    near = {"before2": F.when(first, F.col("w2")).otherwise(""), "before": F.when(first, F.col("w1")).otherwise(F.col("lead")), "after": F.when(F.col("last"), F.col("w3")).otherwise(F.col("trail"))}
    return out.withColumns(near).drop("last", "w2", "w1", "w3")


def _share(pattern: str) -> Column:
    return F.regexp_count("candidate", F.lit(pattern)) / F.col("length")


def features(found: DataFrame, known: list[str]) -> DataFrame:
    """`found` of candidates() plus the columns FEATURES."""
    any_known = "|".join(re.escape(w) for w in sorted(known, key=len, reverse=True)) or "(?!)"
    near = F.concat_ws(" ", "before2", "before")
    out = found.withColumn("length", F.length("candidate").cast("double"))
    out = out.withColumns({n: _share(p) for n, p in {"digits": "[0-9]", "uppers": "[A-Z]", "lowers": "[a-z]", "hexes": "[0-9a-fA-F]", "dashes": "[-_+/=]", "vowels": "(?i)[aeiou]"}.items()})
    steps = {"lower_digit": ("a-z", "0-9"), "digit_lower": ("0-9", "a-z"), "upper_digit": ("A-Z", "0-9"), "digit_upper": ("0-9", "A-Z"), "lower_upper": ("a-z", "A-Z"), "upper_lower": ("A-Z", "a-z")}
    out = out.withColumns({n: _share(f"(?<=[{a}])[{b}]") for n, (a, b) in steps.items()})
    flags = {
        "path_test": F.col("path").rlike("(?i)(test|example|sample|fixture|mock|docs?/)"),
        "before_credential": near.rlike(CREDENTIAL),
        "before_sign": F.col("before").rlike("[=:]$"),
        "inside_credential": F.col("lead").rlike(CREDENTIAL),
        "inside_sign": F.col("lead").rlike("[=:]"),
        "before_digest": near.rlike(DIGEST),
        "after_digest": F.col("after").rlike(DIGEST),
        "quoted": F.concat("lead", "trail").rlike("[\"'`]"),
    }
    return out.withColumns(
        {"turns": sum((F.col(n) for n in steps), F.lit(0.0)), "distinct": F.size(F.array_distinct(F.split("candidate", ""))) / F.col("length"), "covered": 1 - F.length(F.regexp_replace(F.lower("candidate"), any_known, "")) / F.col("length"), "path_length": F.length("path").cast("double")}
        | {n: F.coalesce(c, F.lit(False)).cast("double") for n, c in flags.items()}
    )


def weak_labels(found: DataFrame) -> DataFrame:
    """Findings labelled where the form alone decides: issued key formats and quoted assignments are secrets (1), plain words and plain numbers are not (0)."""
    whole = F.col("candidate")
    hexes = whole.rlike("^[0-9a-fA-F]{16,}$") & whole.rlike("[0-9]") & whole.rlike("[A-Fa-f]")
    secret = whole.rlike("^(AKIA|ASIA)[0-9A-Z]{16}$") | (hexes & F.col("lead").rlike("(?i)(password|secret|token)=")) | (hexes & F.concat_ws(" ", "before2", "before").rlike("(?i)(password|secret|token) =$"))
    plain = whole.rlike("^[A-Za-z]+$") & ~whole.rlike("^[A-Z]+$") | whole.rlike("^[0-9]+$")
    return found.withColumn("label", F.when(secret, 1.0).when(plain, 0.0)).filter("label is not null")


def train(labelled: DataFrame, max_labelled: int = 20_000, trees: int = 20, depth: int = 6, seed: int = 7) -> Model | float:
    """A forest from labelled(FEATURES, label): half of max_labelled rows of either label at most, least hash first. Where only one label occurs, that label; without labels 1."""
    order = F.xxhash64("doc_id", "word_index", "match_index", "candidate")
    sample = stored(labelled.filter("label = 1").orderBy(order).limit(max_labelled // 2).union(labelled.filter("label = 0").orderBy(order).limit(max_labelled // 2)).select("label", *FEATURES))
    kinds = [r[0] for r in sample.select("label").distinct().collect()]  # two at most
    if len(kinds) < 2:
        return kinds[0] if kinds else 1.0
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="__features", labelCol="label", probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__label")
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="__features"), forest]).fit(sample)


def score(found: DataFrame, model: Model | float, threshold: float = 0.5) -> DataFrame:
    """`found` with FEATURES -> plus probability and is_secret. A number in the place of a forest is every candidate's probability."""
    if isinstance(model, float):
        return found.withColumn("probability", F.lit(model)).withColumn("is_secret", F.lit(model >= threshold))
    out = model.transform(found).withColumn("probability", vector_to_array("__p")[1])
    return out.drop("__features", "__p", "__raw", "__label").withColumn("is_secret", F.col("probability") >= threshold)


def scan(docs: DataFrame, words_from: DataFrame | None = None, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Every candidate of docs with its probability and verdict: doc_id, word_index, match_index, candidate, before, after, probability, is_secret.

    words_from: texts whose frequent words are the dictionary; by default docs, all of them.
    labelled: findings with a label column besides those of candidates(); by default weak_labels() of the candidates themselves.
    A candidate exactly at the threshold is a secret. Null, empty and blank texts have no candidate and a null source is an empty
    path; rows that repeat a doc_id, or have none, are scanned each for itself. Texts of any length are read whole, other columns
    are ignored, whatever their names, and an empty table gives no rows.
    """
    known = dictionary(docs if words_from is None else words_from)
    found = stored(features(candidates(docs), known))
    model = train(features(labelled, known) if labelled is not None else weak_labels(found))
    return score(found, model, threshold).select("doc_id", "word_index", "match_index", "candidate", "before", "after", "probability", "is_secret")


def redact(docs: DataFrame, findings: DataFrame, mask: str = "<secret>") -> DataFrame:
    """docs with the secrets of findings(doc_id, candidate, is_secret) masked in text and n_chars counted anew; all rows and columns stay.

    A null text stays null; of rows that repeat a doc_id, or have none, each is masked with the secrets found in any of them. Texts of any length are read whole.
    Only rows that may have a secret are joined; the others pass through without a shuffle.
    """
    held = stored(findings.filter("is_secret").groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("candidate").alias("__secrets")))
    maybe, rest = split_by_ids(docs, held.select(F.col("__id").alias("doc_id")))
    out = maybe.join(held, maybe["doc_id"].eqNullSafe(held["__id"]), "left")
    clean = F.aggregate(F.reverse(F.array_sort("__secrets")), F.col("text"), lambda t, s: F.replace(t, s, F.lit(mask)))
    out = out.withColumn("text", F.when(F.col("__secrets").isNull(), F.col("text")).otherwise(clean))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__secrets").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return rest.union(out.select(*docs.columns))
