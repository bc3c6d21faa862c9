"""Operator 4: SpotSigs fingerprints, native: DataFrame functions alone.

A signature is an anchor with the two content words that follow it. Anchors are common words, the beginning of the text, and a quarter of all other words, chosen
by their hashes, so that texts in any language, tables and lists have signatures in proportion to their words, by one rule for all. Common words between an anchor
and its content words are left out; of common words in a row the last one counts, and at the text's end there may be one content word alone. Scripts
that put no spaces between words are taken character by character. A text of common words alone has these as signatures, a text with no word is its own signature, the empty
text has none. The fingerprint is the sorted set of the signatures' hashes. Sets are compared by Jaccard similarity; two empty sets are equal (1.0).

Equal texts have equal fingerprints. A null text is an empty one. Rows with a null doc_id come last in descending order, rows that repeat a doc_id are
ordered by their text's hash. One document is its own next document; no documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.llm.wordlists import COMMON_WORDS

#: Scripts without spaces between words, as classes of a regular expression.
UNSPACED = "".join(f"\\p{{Is{name}}}" for name in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar"))
#: One in so many words is an anchor by its hash.
SAMPLED = 4


def _words(text: Column) -> Column:
    """Runs of other than white space and punctuation; where a text may hold unspaced scripts, which all lie above U+0E00, their characters one by one."""
    single = F.regexp_extract_all(F.lower(text), F.lit(rf"[{UNSPACED}]|[^\s\p{{Punct}}{UNSPACED}]+"), F.lit(0))
    return F.when(F.rlike(text, F.lit("[\\x{0E00}-\\x{10FFFF}]")), single).otherwise(F.filter(F.split(F.lower(text), r"[\s\p{Punct}]+"), lambda w: w != ""))


def _is_common(word: Column) -> Column:
    return word.isin(*COMMON_WORDS)


def _is_anchor(word: Column) -> Column:
    return _is_common(word) | (F.pmod(F.xxhash64(word), F.lit(SAMPLED)) == 0)


def with_signatures(frame: DataFrame, text: str, name: str) -> DataFrame:
    """frame with the signature set of a text column (not null) as sorted hashes."""
    w, at, spots = f"_{name}_words", f"_{name}_at", f"_{name}_spots"
    frame = frame.withColumn(w, _words(F.col(text)))
    frame = frame.withColumn(at, F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i >= 0) & (i < F.size(w)) & ~_is_common(F.get(F.col(w), i))))
    word = lambda i: F.get(F.col(w), i)
    place = lambda j: F.get(F.col(at), j)
    chains = F.transform(
        F.filter(F.sequence(F.lit(0), F.greatest(F.size(at) - 1, F.lit(0))), lambda j: (j < F.size(at)) & ((place(j) == 0) | F.coalesce(_is_anchor(word(place(j) - 1)), F.lit(False)))),
        lambda j: F.xxhash64(F.when(place(j) > 0, word(place(j) - 1)).otherwise(""), word(place(j)), F.coalesce(word(place(j + 1)), F.lit(""))),
    )
    frame = frame.withColumn(spots, F.array_distinct(chains))
    single = F.when(F.size(w) > 0, F.transform(F.col(w), lambda x: F.xxhash64(x))).when(F.col(text) != "", F.array(F.xxhash64(F.lit("text"), F.col(text)))).otherwise(F.array().cast("array<bigint>"))
    all_ = F.when(F.size(spots) > 0, F.col(spots)).otherwise(F.array_distinct(single))
    return frame.withColumn(name, F.array_sort(all_)).drop(w, at, spots)


def fingerprint(signatures: Column) -> Column:
    return F.array_join(F.transform(signatures, lambda x: F.lower(F.hex(x))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, 1.0).otherwise(both / every)


def length_partition(n: Column, threshold: float) -> Column:
    """Sets of this similarity or more are of one partition or of neighbours: the bounds grow by 1 / threshold."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(1 / threshold)) + 1e-9)


def search(queries: DataFrame, everything: DataFrame, name: str, threshold: float = 0.8) -> DataFrame:
    """(query_id, doc_id, likeness) of all rows whose signature set (column name) is as like a stated query's as the threshold asks, itself left out.

    Sets are partitioned by length; a query looks into its partition and the neighbours. There, sets that are alike share one of their smallest
    n - ceil(threshold * n) + 1 hashes at least, and their lengths bound their similarity, so most pairs are pruned before sets are intersected.
    """
    size = F.size(name)
    first = F.slice(F.col(name), F.lit(1), size - F.ceil(size * threshold - 1e-9).cast("int") + 1)
    usable = lambda frame, id_: frame.where(size > 0).select(F.col("doc_id").alias(id_), F.col(name).alias(f"{id_}_set"), size.alias(f"{id_}_n"), length_partition(size, threshold).alias("part"), first.alias("first"))
    asked = usable(queries, "query_id").withColumn("part", F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1))).withColumn("token", F.explode("first"))
    there = usable(everything, "doc_id").withColumn("token", F.explode("first"))
    fits = F.least("query_id_n", "doc_id_n") >= threshold * F.greatest("query_id_n", "doc_id_n") - 1e-9
    pairs = asked.select("query_id", "query_id_n", "part", "token").join(there.select("doc_id", "doc_id_n", "part", "token"), ["part", "token"]).where(fits & (F.col("query_id") != F.col("doc_id"))).select("query_id", "doc_id").distinct()
    sets = pairs.join(queries.select(F.col("doc_id").alias("query_id"), F.col(name).alias("a")), "query_id").join(everything.select("doc_id", F.col(name).alias("b")), "doc_id")
    return sets.select("query_id", "doc_id", likeness(F.col("a"), F.col("b")).alias("likeness")).where(F.col("likeness") >= threshold)


def edit(text: Column, next_text: Column) -> Column:
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(next_text, F.lit(1), half))


def with_next(docs: DataFrame, per_bucket: int = 2000, max_bounds: int = 1024) -> DataFrame:
    """docs (doc_id, text) with next_text: the text of the row after it in descending doc_id, of the first row after the last.

    Rows are dealt to buckets by ranges of doc_id (quantiles, subdivided evenly where there are very many rows), so a bucket is bounded and is
    ordered in a task of its own; the first row of the following bucket is replicated to each bucket's end.
    """
    n = docs.count()
    buckets = max(1, -(-n // per_bucket))
    bounds = min(buckets, max_bounds)
    steps = -(-buckets // bounds)
    cuts = docs.agg(F.percentile_approx("doc_id", [k / bounds for k in range(1, bounds)] or [0.5], 10_000).alias("c"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    edges = sorted({cuts["lo"], *(cuts["c"] if bounds > 1 else [])}) if cuts["lo"] is not None else [0]
    upper = [*edges[1:], (cuts["hi"] if cuts["hi"] is not None else 0) + 1]
    array = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    which = F.greatest(F.lit(1), F.size(F.filter(array(edges), lambda e: e <= F.col("doc_id"))))
    low, high = F.element_at(array(edges), which), F.element_at(array(upper), which)
    sub = F.floor((F.col("doc_id") - low) * steps / F.greatest(F.lit(1), high - low))
    null_buckets = max(1, -(-cuts["nulls"] // per_bucket))  # ranges of hashes, which order these rows
    hashed = F.floor((F.shiftright(F.col("_hash"), 32) + F.lit(1 << 31)) * null_buckets / F.lit(1 << 32))
    bucket = F.when(F.col("doc_id").isNull(), -1 - hashed).otherwise(which.cast("long") * steps + sub)
    order = [F.desc_nulls_last("doc_id"), F.col("_hash")]
    ready = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_hash", F.xxhash64("text")).withColumn("_bucket", bucket)
    firsts = ready.groupBy("_bucket").agg(F.min(F.struct((-F.col("doc_id")).alias("d"), F.col("_hash").alias("h"))).alias("f")).select("_bucket", "f")
    line = Window.orderBy(F.desc("_bucket"))  # one row per bucket
    ahead = firsts.select("_bucket", F.lead("f").over(line).alias("g"), F.first("f").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all")).select(F.col("_bucket").alias("_to"), F.coalesce("g", "all").alias("g"))
    targets = ahead.select("_to", (-F.col("g.d")).alias("_id"), F.col("g.h").alias("_h"))
    edge = ready.join(targets, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h"))).select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("_to").alias("_bucket"), "_hash", F.lit(1).alias("_edge")).dropDuplicates(["_bucket"])
    all_rows = ready.select("doc_id", "text", "_bucket", "_hash", F.lit(0).alias("_edge")).unionByName(edge)
    window = Window.partitionBy("_bucket").orderBy("_edge", *order)
    return all_rows.withColumn("next_text", F.lead("text").over(window)).where("_edge = 0").select("doc_id", "text", "next_text")


def compare_edits(docs: DataFrame) -> DataFrame:
    rows = with_next(docs.select("doc_id", "text")).withColumn("edited", edit(F.col("text"), F.col("next_text")))
    for text, name in (("text", "own_s"), ("edited", "edited_s"), ("next_text", "next_s")):
        rows = with_signatures(rows, text, name)
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("own_s")).alias("fingerprint"), fingerprint(F.col("edited_s")).alias("edited_fingerprint"),
        likeness(F.col("own_s"), F.col("edited_s")).alias("near_edited"), likeness(F.col("own_s"), F.col("next_s")).alias("near_next"),
    )


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edits(table(spark, sf_dir, "documents"))
