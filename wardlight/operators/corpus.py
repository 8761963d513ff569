"""Operators over a note corpus: entities, code mapping, bags of concepts, selection scores, TF-IDF."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, notes
from ..functions.spans import word_rows
from .aggregates import concept_frequency, majority_value, pivot_counts

# explode() makes the optimizer test the array for emptiness first, which works a costly array out
# again; explode_outer() does not, and the joins or filters behind it drop its null rows.


def keyword_summary(df: DataFrame, key: str, text: str, patterns: Mapping[str, str], polarity: Column) -> DataFrame:
    """Per key: max of every pattern flag, mean polarity, sum of note lengths."""
    rows = df.select(key, polarity.alias("__p"), F.length(notes.text_of(text)).alias("__n"), *notes.pattern_flags(text, patterns))
    return rows.groupBy(key).agg(
        *[F.max(n).alias(n) for n in patterns], F.avg("__p").alias("nlp_sentiment_score"), F.sum("__n").alias("nlp_note_length")
    )


def dictionary_entities(df: DataFrame, id_col: str, text: str, terms: DataFrame, term: str, label: str, max_words: int = 5) -> DataFrame:
    """Mentions of the listed terms (any case): longest first, no overlaps, with positions and sentence.

    Word n-grams meet the term table in an equi join; only hits travel further.
    """
    every = word_rows(df, id_col, text, r"\w+", max_words)
    table = terms.select(
        F.array_join(F.regexp_extract_all(F.lower(F.col(term)), F.lit(r"(?U)(\w+)"), F.lit(1)), " ").alias("gram"), F.col(label).alias("entity_label")
    ).where("gram <> ''").groupBy("gram").agg(F.min("entity_label").alias("entity_label"))
    hits = every.join(table, "gram").groupBy(id_col).agg(
        F.array_sort(
            F.collect_list(F.struct((-F.col("n")).alias("k"), F.col("first"), F.col("n"), F.col("gram"), F.col("entity_label"), F.col("start_char"), F.col("end_char")))
        ).alias("__h")
    )
    kept_type = "array<struct<k:int,first:int,n:int,gram:string,entity_label:string,start_char:int,end_char:int>>"

    def add(acc: Column, h: Column) -> Column:
        clash = F.exists(acc, lambda a: (a["first"] < h["first"] + h["n"]) & (h["first"] < a["first"] + a["n"]))
        return F.when(clash, acc).otherwise(F.concat(acc, F.array(h)))

    # Only one text's own mentions are folded here.
    kept = hits.select(id_col, F.explode_outer(F.aggregate("__h", F.array().cast(kept_type), add)).alias("h")).where("h IS NOT NULL")
    return kept.select(
        id_col, F.col("h.gram").alias("entity_norm"), "h.entity_label", "h.start_char", "h.end_char"
    ).join(df.select(id_col, text), id_col).select(
        id_col, F.substring(F.col(text), F.col("start_char") + 1, F.col("end_char") - F.col("start_char")).alias("entity_text"),
        "entity_norm", "entity_label", "start_char", "end_char",
        notes.context_window(text, "start_char", "end_char").alias("context"),
    )


def mentions_in_context(mentions: DataFrame, name: str, context: str = "context", triggers: Mapping[str, Sequence[str]] = fixed.CONTEXT_TRIGGERS) -> DataFrame:
    """Every mention with the flags of its own surroundings, its name with the strongest of them, and whether it is kept.

    ``mentions`` has one row per mention, as ``dictionary_entities`` gives them.
    """
    flagged = mentions.select("*", *notes.context_flags(context, triggers))
    holds = [F.col(f"is_{n}") == 1 for n in ("negated", "hypothetical", "historical", "family")]
    return flagged.select("*", notes.modified_name(name, *holds).alias("name"), notes.keep_entity(name, holds[0]).alias("keep"))


def map_codes(
    rows: DataFrame, text: str, dictionary: DataFrame, abbreviations: DataFrame | None = None, code: str = "code", name: str = "name", score: str = "score"
) -> DataFrame:
    """Codes for entity texts: dictionary, then abbreviations, then the corpus' own majority code.

    ``rows`` may already carry a code for some rows (column ``code``). Every distinct text is looked
    up once and the answer joined back.
    """
    norm = F.lower(F.trim(F.col(text)))
    base = rows.withColumn("__t", norm)
    distinct = base.select("__t").distinct()
    # One row per text on the lookup side keeps the row count of the entities.
    first = dictionary.groupBy(F.lower(F.trim("text")).alias("__t")).agg(F.min(F.struct(F.col(code), F.col(name), F.col(score))).alias("__d"))
    found = distinct.join(first, "__t", "left")
    if abbreviations is not None:
        short = abbreviations.groupBy(F.lower(F.trim("text")).alias("__t")).agg(F.min(F.struct(F.col(code), F.col(name))).alias("__a"))
        found = found.join(short, "__t", "left")
    else:
        found = found.withColumn("__a", F.lit(None).cast(f"struct<{code}:string,{name}:string>"))
    own = base.join(found, "__t", "left").select(
        *[c for c in base.columns if c not in (code, name, score)],
        "__a",
        F.coalesce(F.col(code), F.col(f"__d.{code}")).alias(code), F.coalesce(F.col(name), F.col(f"__d.{name}")).alias(name),
        F.coalesce(F.col(score), F.col(f"__d.{score}")).alias(score),
    )
    major = majority_value(own, "__t", code, name, score).select("__t", F.struct(F.col(code), F.col(name), F.col("mean_score")).alias("__m"))
    full = own.join(major, "__t", "left")
    missing, has_short = F.col(code).isNull(), F.col("__a").isNotNull()
    pick = lambda field, short, mean: F.when(~missing, F.col(field)).when(has_short, short).otherwise(mean).alias(field)
    keep = [c for c in rows.columns if c not in (code, name, score)]
    return full.select(
        *keep, pick(code, F.col(f"__a.{code}"), F.col(f"__m.{code}")), pick(name, F.col(f"__a.{name}"), F.col(f"__m.{name}")),
        pick(score, F.lit(1.0), F.col("__m.mean_score")),
    )


def bag_of_concepts(rows: DataFrame, labels: DataFrame, patient: str, concept: str, min_share: float = 0.01) -> DataFrame:
    """Long (patient, concept) of the concepts that at least ``min_share`` of the patients have.

    Every labelled patient occurs; one without a frequent concept has a single row with concept null.
    """
    frequent = concept_frequency(rows, patient, concept, min_share).select(concept)
    own = rows.select(patient, concept).distinct().join(frequent, concept, "left_semi")
    return labels.select(patient).distinct().join(own, patient, "left").select(patient, concept)


def concept_matrix(bag: DataFrame, patient: str, concept: str, names: Sequence[str]) -> DataFrame:
    """0/1 columns of the listed concepts, one row per patient of the bag."""
    from .cohort import add_absent

    matrix = pivot_counts(bag.where(F.col(concept).isin(list(names))), patient, concept, list(names), binary=True)
    return add_absent(bag.select(patient).distinct(), matrix, patient)


def entity_counts(rows: DataFrame, key: str, entity: str, negated: str, min_count: int = 10, include_negated: bool = False) -> DataFrame:
    """Long (key, entity, n) of the entities mentioned at least ``min_count`` times."""
    used = rows if include_negated else rows.where(~F.col(negated))
    n = used.groupBy(key, entity).agg(F.count("*").alias("n"))
    common = n.groupBy(entity).agg(F.sum("n").alias("t")).where(F.col("t") >= min_count).select(entity)
    return n.join(common, entity, "left_semi")


def erfc_half(x: Column) -> Column:
    """P(chi-square with one degree of freedom > x), by a Chebyshev fit good to 1e-7."""
    z = F.sqrt(x / 2)
    t = 1 / (1 + z / 2)
    coef = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly = F.lit(coef[-1])
    for c in reversed(coef[:-1]):
        poly = poly * t + F.lit(c)
    return t * F.exp(-z * z + poly)


def class_sums(features: DataFrame, labels: DataFrame, on: str, feature: str, value: str, label: str) -> DataFrame:
    """Per feature: value sums over all rows and over the positive ones, rows with a value, from sparse input."""
    y = F.col(label).cast("double")
    return features.join(labels.select(on, label), on).groupBy(feature).agg(
        F.sum(value).alias("sx"), F.sum(F.col(value) * y).alias("sx1"),
        F.count_if(F.col(value) != 0).alias("n_x"), F.count_if((F.col(value) != 0) & (y == 1)).alias("n_x1"),
    )


def label_totals(labels: DataFrame, label: str) -> tuple[int, int]:
    r = labels.agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("p")).first()
    return r["n"], r["p"] or 0


def chi2_scores(features: DataFrame, labels: DataFrame, on: str, feature: str, value: str, label: str) -> DataFrame:
    """Observed class sums of each non-negative feature against class share times feature total."""
    n, p = label_totals(labels, label)
    s = class_sums(features, labels, on, feature, value, label)
    e1 = F.col("sx") * F.lit(p / n)
    e0 = F.col("sx") * F.lit((n - p) / n)
    chi2 = F.try_divide((F.col("sx1") - e1) * (F.col("sx1") - e1), e1) + F.try_divide((F.col("sx") - F.col("sx1") - e0) * (F.col("sx") - F.col("sx1") - e0), e0)
    return s.select(feature, chi2.alias("chi2_score"), (F.col("n_x") / F.lit(float(n))).alias("frequency")).withColumn("pvalue", erfc_half(F.col("chi2_score")))


def mutual_info(features: DataFrame, labels: DataFrame, on: str, feature: str, value: str, label: str) -> DataFrame:
    """Mutual information in nats between a 0/1 feature and a 0/1 label."""
    n, p = label_totals(labels, label)
    s = class_sums(features, labels, on, feature, value, label)
    n1, n11 = F.col("n_x").cast("double"), F.col("n_x1").cast("double")
    total = F.lit(float(n))

    def cell(c: Column, a: Column, b: Column) -> Column:
        return F.when(c > 0, c / total * F.ln(c * total / (a * b))).otherwise(0.0)

    y1, y0, n0 = F.lit(float(p)), F.lit(float(n - p)), total - n1
    mi = cell(n11, n1, y1) + cell(n1 - n11, n1, y0) + cell(y1 - n11, n0, y1) + cell(y0 - (n1 - n11), n0, y0)
    return s.select(feature, mi.alias("mi_score"), (n1 / total).alias("frequency"))


def select_features(
    features: DataFrame, labels: DataFrame, on: str, feature: str, value: str, label: str, method: str = "chi2", top_k: int = 200, min_freq: float = 0.01
) -> DataFrame:
    """Best features by chi-square or mutual information among the frequent ones."""
    if method == "chi2":
        scored, score = chi2_scores(features, labels, on, feature, value, label), "chi2_score"
    else:
        scored, score = mutual_info(features, labels, on, feature, value, label), "mi_score"
    return scored.where(F.col("frequency") >= min_freq).orderBy(F.desc(score), feature).limit(top_k)


def with_terms(df: DataFrame, text: str, out: str, ngrams: tuple[int, int] = (1, 2), stop: Sequence[str] = fixed.STOPWORDS_EN) -> DataFrame:
    """Lower-cased words of two or more characters without stop words, and their pairs, as an array."""
    if ngrams not in ((1, 1), (1, 2), (2, 2)):
        raise ValueError("n-grams of one or two words")
    words = F.regexp_extract_all(F.lower(notes.text_of(text)), F.lit(r"(?U)\w{2,}"), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(list(stop))) if stop else words
    rest = F.greatest(F.size("__kept") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("__kept", 1, rest), F.slice("__kept", 2, rest), lambda a, b: F.concat(a, F.lit(" "), b))
    parts = ([F.col("__kept")] if ngrams[0] == 1 else []) + ([pairs] if ngrams[1] == 2 else [])
    # The words are their own projection: used three times, they must be found only once.
    return df.withColumn("__kept", kept).withColumn(out, F.concat(*parts)).drop("__kept")


#: hash values of terms that are counted before the terms themselves
TERM_BUCKETS = 1 << 20
#: up to so many hash values, texts are cut down in their rows; more are joined
BUCKETS_IN_ROW = 10_000


def term_bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def tfidf_fit(
    train: DataFrame, text: str, max_features: int = 100, ngrams: tuple[int, int] = (1, 2), min_df: float = 0.01, max_df: float = 0.9,
    stop: Sequence[str] = fixed.STOPWORDS_EN,
) -> DataFrame:
    """(term, df, total, idf): the most used terms within the document-frequency bounds.

    Most terms are rare, so documents are first counted by hash value of their terms, which takes bounded memory at any size: no term is in more
    documents than its hash value, and terms of rare ones are not counted. Each text's other terms are sorted in its row, so the first of equal
    neighbours counts the document: one shuffle on the term, map-side combined, gives both totals.
    """
    n = train.count()
    terms = with_terms(train, text, "__t", ngrams, stop)
    frequent = None
    if min_df * n > 1:  # else no term is too rare
        buckets = terms.select(F.explode_outer(F.array_distinct(F.transform("__t", term_bucket))).alias("__b")).groupBy("__b").agg(F.count("*").alias("c"))
        found = buckets.where((F.col("c") >= min_df * n) & F.col("__b").isNotNull()).select("__b").collect()  # at most TERM_BUCKETS numbers
        if len(found) <= BUCKETS_IN_ROW:
            terms = terms.select(F.filter("__t", lambda x: term_bucket(x).isin([r["__b"] for r in found])).alias("__t"))
        else:
            frequent = train.sparkSession.createDataFrame(found, "__b int")
    srt = F.col("__s")
    marked = terms.select(F.sort_array("__t").alias("__s")).select(
        F.explode_outer(
            F.transform(srt, lambda x, i: F.struct(x.alias("term"), F.when((i > 0) & (F.get(srt, i - 1) == x), 0).otherwise(1).alias("new")))
        ).alias("e")
    ).where("e IS NOT NULL")
    if frequent is not None:
        marked = marked.withColumn("__b", term_bucket(F.col("e.term"))).join(F.broadcast(frequent), "__b", "left_semi")
    counts = marked.groupBy(F.col("e.term").alias("term")).agg(F.sum("e.new").alias("df"), F.count("*").alias("total"))
    inside = counts.where((F.col("df") >= min_df * n) & (F.col("df") <= max_df * n))
    top = inside.orderBy(F.desc("total"), "term").limit(max_features)
    return top.withColumn("idf", F.ln(F.lit(1.0 + n) / (1 + F.col("df"))) + 1)


def tfidf_transform(
    df: DataFrame, id_col: str, text: str, vocabulary: DataFrame, ngrams: tuple[int, int] = (1, 2), stop: Sequence[str] = fixed.STOPWORDS_EN
) -> DataFrame:
    """Long (id, term, tfidf) with unit length per text.

    The fitted terms (a fixed number) come to the driver once; texts keep only these before they are
    exploded.
    """
    fitted = vocabulary.select("term", "idf").collect()
    known = df.sparkSession.createDataFrame(fitted, "term string, idf double")
    hits = F.filter("__t", lambda x: x.isin([r["term"] for r in fitted]))
    rows = with_terms(df, text, "__t", ngrams, stop).select(id_col, hits.alias("__t")).select(id_col, F.explode_outer("__t").alias("term"))
    tf = rows.groupBy(id_col, "term").agg(F.count("*").alias("tf")).join(F.broadcast(known), "term")
    raw = tf.withColumn("__w", F.col("tf") * F.col("idf"))
    w = Window.partitionBy(id_col)  # at most as many rows per text as the vocabulary has terms
    return raw.select(id_col, "term", (F.col("__w") / F.sqrt(F.sum(F.col("__w") * F.col("__w")).over(w))).alias("tfidf"))


def vocabulary_spans(df: DataFrame, id_col: str, text: str, vocabulary: DataFrame, term: str = "term") -> DataFrame:
    """Positions of vocabulary words, one row per occurrence."""
    spans = word_rows(df, id_col, text).select(id_col, F.col("gram").alias(term), F.col("start_char").alias("start"), F.col("end_char").alias("end"))
    return spans.join(vocabulary.select(term).distinct(), term, "left_semi")
