"""Corpus operators: entities, code mapping, bags of concepts, selection, TF-IDF, highlights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, notes
from ..operators import aggregates, corpus
from .registry import Tables, query
from .text_sql import MASK, boundary

DOC = ("doc_id", "text")

_WORDS = "[\\pL\\pM\\pN\\p{Pc}]+"
# Terms: the first one and the first two words of every benchmark item.
TERMS_SQL = f"""b AS (SELECT item_id, regexp_extract_all(lower(text), '{_WORDS}') AS w FROM benchmark),
terms AS (SELECT gram, min(label) AS label FROM (SELECT w[1] AS gram, 'PROBLEM' AS label FROM b UNION ALL SELECT w[1] || ' ' || w[2], 'TEST' FROM b
  UNION ALL SELECT w[2] || ' ' || w[3] || ' ' || w[4], 'TREATMENT' FROM b) WHERE gram IS NOT NULL GROUP BY 1)"""


def terms(t: Tables):
    w = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)([\w]+)"), F.lit(1))
    b = t("benchmark", "text").select(w.alias("w"))
    make = lambda lo, n, label: b.where(F.size("w") >= lo + n - 1).select(F.array_join(F.slice("w", lo, n), " ").alias("term"), F.lit(label).alias("label"))
    return make(1, 1, "PROBLEM").unionByName(make(1, 2, "TEST")).unionByName(make(2, 3, "TREATMENT"))


def mentions_sql(text: str) -> str:
    """CTEs up to ``found``: one row per mention (id, s, e, gram, label) of the terms in the turns of the conversations."""
    return f"""{TERMS_SQL},
d AS (SELECT id, text, lower(text) AS x FROM (SELECT conv_id * 1000 + turn AS id, {text} AS text FROM conversations)),
u AS (SELECT id, text, regexp_extract_all(x, '{_WORDS}') AS w, string_split_regex(x, '{_WORDS}') AS g FROM d),
tk AS (SELECT id, unnest(w) AS word, unnest(g[1:len(w)]) AS gap, generate_subscripts(w, 1) AS i FROM u),
pos AS (SELECT id, word, i, sum(length(gap) + length(word)) OVER (PARTITION BY id ORDER BY i) AS e FROM tk),
grams AS (SELECT a.id, a.i AS first, n.n, a.e - length(a.word) AS s, c.e AS e,
   CASE n.n WHEN 1 THEN a.word WHEN 2 THEN a.word || ' ' || c.word ELSE a.word || ' ' || m.word || ' ' || c.word END AS gram
  FROM pos a CROSS JOIN (SELECT unnest([1, 2, 3]) AS n) n JOIN pos c ON c.id = a.id AND c.i = a.i + n.n - 1 JOIN pos m ON m.id = a.id AND m.i = a.i + n.n // 2),
hits AS (SELECT id, first, n, s, e, gram, label, row_number() OVER (PARTITION BY id ORDER BY n DESC, first) AS r FROM grams JOIN terms USING (gram)),
walk(id, r, taken, kept) AS (
  SELECT DISTINCT id, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM hits
  UNION ALL
  SELECT k.id, h.r, CASE WHEN list_has_any(k.taken, range(h.first, h.first + h.n)) THEN k.taken ELSE k.taken || range(h.first, h.first + h.n) END,
    CASE WHEN list_has_any(k.taken, range(h.first, h.first + h.n)) THEN k.kept ELSE list_append(k.kept, h.r) END
  FROM walk k JOIN hits h ON h.id = k.id AND h.r = k.r + 1),
fin AS (SELECT id, unnest(kept) AS r FROM walk QUALIFY row_number() OVER (PARTITION BY id ORDER BY r DESC) = 1),
found AS (SELECT id, s::INTEGER AS s, e::INTEGER AS e, gram, label FROM fin JOIN hits USING (id, r))"""


@query("I13_dictionary_entities", f"WITH RECURSIVE {mentions_sql('text')} SELECT id, gram AS entity_norm, label AS entity_label, s AS start_char, e AS end_char FROM found")
def _(t):
    c = t.heavy("conversations", "conv_id", "turn", "text").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    out = corpus.dictionary_entities(c, "id", "text", terms(t), "term", "label", 3)
    return out.select("id", "entity_norm", "entity_label", "start_char", "end_char")


_AROUND = "lower(substring(text, greatest(s - 50, 0) + 1, e + 50 - greatest(s - 50, 0)))"
_IS = {n: f"regexp_matches(x, '{boundary('|'.join(ps))}')" for n, ps in fixed.CONTEXT_TRIGGERS.items()}


# A denial stands before and a word on the family behind every turn: mentions of one turn differ in their flags.
@query("I14_context_flags", f"""WITH RECURSIVE {mentions_sql("'She denies ' || text || ' Mother may have had it'")},
c AS (SELECT id, s, e, gram, {MASK(_AROUND)} AS x FROM found JOIN d USING (id)),
f AS (SELECT id, s AS start_char, e AS end_char, gram AS entity_norm, {', '.join(f'{r}::INTEGER AS is_{n}' for n, r in _IS.items())} FROM c)
SELECT *, CASE WHEN is_negated = 1 THEN 'Absent_' WHEN is_hypothetical = 1 THEN 'Possible_' WHEN is_historical = 1 THEN 'History_' WHEN is_family = 1 THEN 'Family_' ELSE '' END || replace(entity_norm, ' ', '_') AS name,
  length(entity_norm) >= 2 AND NOT regexp_matches(entity_norm, '^[0-9 .,]+$') AND is_negated = 0 AS keep FROM f""")
def _(t):
    said = F.concat(F.lit("She denies "), "text", F.lit(" Mother may have had it")).alias("text")
    c = t.heavy("conversations", "conv_id", "turn", "text").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), said)
    found = corpus.mentions_in_context(corpus.dictionary_entities(c, "id", "text", terms(t), "term", "label", 3), "entity_norm")
    return found.select("id", "start_char", "end_char", "entity_norm", *[f"is_{n}" for n in fixed.CONTEXT_TRIGGERS], "name", "keep")


MAP_SQL = """ent AS (SELECT o_orderkey AS id, lower(trim(o_orderpriority)) AS x, CASE WHEN o_orderkey % 3 = 0 THEN 'C' || o_custkey % 4 END AS code,
  CASE WHEN o_orderkey % 3 = 0 THEN 'N' || o_custkey % 4 END AS name, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 100) / 100.0 END AS score FROM orders),
own AS (SELECT id, x, coalesce(code, CASE WHEN x = '1-urgent' AND TRUE THEN 'C9' END) AS code, coalesce(name, CASE WHEN x = '1-urgent' THEN 'dict' END) AS name,
  coalesce(score, CASE WHEN x = '1-urgent' THEN 0.75 END)::DOUBLE AS score FROM ent),
n AS (SELECT x, code, name, count(*) AS c FROM own WHERE code IS NOT NULL GROUP BY 1, 2, 3),
b AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY c DESC, code, name) AS r FROM n),
m AS (SELECT b.x, b.code, b.name, (SELECT avg(score) FROM own WHERE own.x = b.x AND own.code = b.code) AS score FROM b WHERE r = 1)"""


@query("I17_map_codes", f"""WITH {MAP_SQL}
SELECT own.id, CASE WHEN own.code IS NOT NULL THEN own.code WHEN own.x = '5-low' THEN 'C8' ELSE m.code END AS code,
CASE WHEN own.code IS NOT NULL THEN own.name WHEN own.x = '5-low' THEN 'abbr' ELSE m.name END AS name,
round(CASE WHEN own.code IS NOT NULL THEN own.score WHEN own.x = '5-low' THEN 1.0 ELSE m.score END, 6) AS score FROM own LEFT JOIN m USING (x)""")
def _(t):
    known = F.col("o_orderkey") % 3 == 0
    rows = t("orders", "o_orderkey", "o_custkey", "o_orderpriority").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("text"),
        F.when(known, F.concat(F.lit("C"), (F.col("o_custkey") % 4).cast("string"))).alias("code"),
        F.when(known, F.concat(F.lit("N"), (F.col("o_custkey") % 4).cast("string"))).alias("name"),
        F.when(known, (F.col("o_orderkey") % 100) / 100.0).alias("score"),
    )
    # Dictionary and abbreviations hold one text of the table each.
    texts = t("orders", "o_orderpriority").distinct()
    dictionary = texts.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderpriority").alias("text"), F.lit("C9").alias("code"), F.lit("dict").alias("name"), F.lit(0.75).alias("score"))
    short = texts.where("o_orderpriority = '5-LOW'").select(F.col("o_orderpriority").alias("text"), F.lit("C8").alias("code"), F.lit("abbr").alias("name"))
    return corpus.map_codes(rows, "text", dictionary, short).select("id", "code", "name", F.round("score", 6).alias("score"))


# Long concept rows: document x risk-word group, from the words of the text.
STEMS = {"tion": "tion", "ment": "ment", "sch": "sch", "the": "the", "eau": "eau", "ere": "ere", "ung": "ung", "ado": "ado"}
CONCEPT_SQL = "c AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS concept FROM documents WHERE contains(lower(text), ' {v}')" for k, v in STEMS.items()) + ")"


def concepts(t: Tables):
    low = F.lower("text")
    found = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(" " + v)), F.lit(k)) for k, v in STEMS.items()]))
    return t.heavy("documents", *DOC).select("doc_id", F.explode(found).alias("concept"))


#: columns a caller asks for; the long form has all concepts
BAG_NAMES = ("the", "tion", "ere", "ung")


@query("I19_bag_of_concepts", f"""WITH {CONCEPT_SQL}, f AS (SELECT concept FROM c GROUP BY 1 HAVING count(DISTINCT doc_id) >= 0.2 * (SELECT count(DISTINCT doc_id) FROM c))
SELECT DISTINCT l.doc_id, f.concept FROM labels l LEFT JOIN (SELECT c.* FROM c SEMI JOIN f USING (concept)) f USING (doc_id)""")
def _(t):
    return corpus.bag_of_concepts(concepts(t), t("labels", "doc_id"), "doc_id", "concept", 0.2)


@query("I19_concept_matrix", f"""WITH {CONCEPT_SQL} SELECT l.doc_id, {", ".join(f"coalesce(max((concept = '{k}')::INTEGER), 0)::BIGINT AS {k}" for k in BAG_NAMES)}
FROM labels l LEFT JOIN (SELECT c.* FROM c SEMI JOIN (SELECT concept FROM c GROUP BY 1 HAVING count(DISTINCT doc_id) >= 0.05 * (SELECT count(DISTINCT doc_id) FROM c)) USING (concept)) f USING (doc_id) GROUP BY 1""")
def _(t):
    bag = corpus.bag_of_concepts(concepts(t), t("labels", "doc_id"), "doc_id", "concept", 0.05)
    return corpus.concept_matrix(bag, "doc_id", "concept", BAG_NAMES)


@query("I20_entity_count_matrix", """WITH e AS (SELECT user_id, json_extract_string(props, '$.k') AS k FROM events WHERE event_type <> 'error'),
n AS (SELECT user_id, k, count(*) AS n FROM e GROUP BY 1, 2), c AS (SELECT k FROM n GROUP BY 1 HAVING sum(n) >= 70)
SELECT user_id, k, n::BIGINT AS n FROM n SEMI JOIN c USING (k)""")
def _(t):
    e = t("events", "user_id", "event_type", "props").select("user_id", F.get_json_object("props", "$.k").alias("k"), (F.col("event_type") == "error").alias("neg"))
    return corpus.entity_counts(e, "user_id", "k", "neg", 70)


SCORE_SQL = f"""{CONCEPT_SQL}, n AS (SELECT count(*)::DOUBLE AS n, sum(toxic)::DOUBLE AS p FROM labels),
s AS (SELECT concept, count(*)::DOUBLE AS sx, sum(toxic)::DOUBLE AS sx1 FROM c JOIN labels USING (doc_id) GROUP BY 1),
chi AS (SELECT concept, (sx1 - sx * p / n) ** 2 / (sx * p / n) + (sx - sx1 - sx * (n - p) / n) ** 2 / (sx * (n - p) / n) AS chi2, sx / n AS freq FROM s, n)"""
_T = "(1 / (1 + sqrt(chi2 / 2) / 2))"
_POLY = "-1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277))))))))".replace("t *", f"{_T} *")


def features(t):
    return concepts(t).withColumn("x", F.lit(1.0))


@query("I21_chi2_scores", f"WITH {SCORE_SQL} SELECT concept, round(chi2, 6) AS chi2_score, round(freq, 6) AS frequency, round({_T} * exp(-chi2 / 2 + ({_POLY})), 6) AS pvalue FROM chi")
def _(t):
    s = corpus.chi2_scores(features(t), t("labels"), "doc_id", "concept", "x", "toxic")
    return s.select("concept", *[F.round(c, 6).alias(c) for c in ("chi2_score", "frequency", "pvalue")])


MI_SQL = f"""{SCORE_SQL}, cells AS (SELECT concept, n, unnest([sx1, sx - sx1, p - sx1, (n - p) - (sx - sx1)]) AS c, unnest([sx, sx, n - sx, n - sx]) AS a, unnest([p, n - p, p, n - p]) AS b FROM s, n),
mi AS (SELECT concept, sum(CASE WHEN c > 0 THEN c / n * ln(c * n / (a * b)) ELSE 0 END) AS mi FROM cells GROUP BY 1)"""


@query("I22_mutual_info", f"WITH {MI_SQL} SELECT concept, round(mi, 9) AS mi_score FROM mi")
def _(t):
    return corpus.mutual_info(features(t), t("labels"), "doc_id", "concept", "x", "toxic").select("concept", F.round("mi_score", 9).alias("mi_score"))


@query("I23_select_features", f"""WITH {MI_SQL}, a AS (SELECT 'chi2' AS method, concept, round(chi2, 6) AS score FROM chi WHERE freq >= 0.1 ORDER BY chi2 DESC, concept LIMIT 3),
b AS (SELECT 'mi' AS method, concept, round(mi * 1000, 6) AS score FROM mi JOIN chi USING (concept) WHERE freq >= 0.1 ORDER BY mi DESC, concept LIMIT 3) FROM a UNION ALL FROM b""")
def _(t):
    pick = lambda m: corpus.select_features(features(t), t("labels"), "doc_id", "concept", "x", "toxic", m, 3, 0.1)
    a = pick("chi2").select(F.lit("chi2").alias("method"), "concept", F.round("chi2_score", 6).alias("score"))
    return a.unionByName(pick("mi").select(F.lit("mi").alias("method"), "concept", F.round(F.col("mi_score") * 1000, 6).alias("score")))


_STOP = "[" + ", ".join(f"'{w}'" for w in fixed.STOPWORDS_EN) + "]"
_TERM = "[\\pL\\pM\\pN\\p{Pc}]{2,}"
TFIDF_SQL = f"""w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '{_TERM}'), lambda x: NOT list_contains({_STOP}, x)) AS w FROM documents),
tk AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
term AS (SELECT doc_id, word AS term FROM tk UNION ALL SELECT doc_id, word || ' ' || lead(word) OVER (PARTITION BY doc_id ORDER BY i) FROM tk),
cnt AS (SELECT doc_id, term, count(*) AS tf FROM term WHERE term IS NOT NULL GROUP BY 1, 2),
n AS (SELECT count(*) AS n FROM documents WHERE lang = 'en' OR lang = 'fr'),
voc AS (SELECT term, count(*) AS df, sum(tf) AS total, ln((1.0 + any_value(n.n)) / (1 + count(*))) + 1 AS idf FROM cnt JOIN documents USING (doc_id), n WHERE lang IN ('en', 'fr')
  GROUP BY 1 HAVING count(*) >= 0.01 * any_value(n.n) AND count(*) <= 0.9 * any_value(n.n) ORDER BY total DESC, term LIMIT 100)"""


@query("I24_tfidf", f"""WITH {TFIDF_SQL}, r AS (SELECT doc_id, term, tf * idf AS w FROM cnt JOIN voc USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS tfidf FROM r""")
def _(t):
    d = t.heavy("documents", "doc_id", "text", "lang")
    voc = corpus.tfidf_fit(d.where("lang IN ('en', 'fr')"), "text")
    out = corpus.tfidf_transform(d, "doc_id", "text", voc)
    return out.select("doc_id", "term", F.round("tfidf", 6).alias("tfidf"))


@query("I25_vocabulary_highlight", f"""WITH vb AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{_TERM}')) AS term FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '{_TERM}') AS w, string_split_regex(lower(text), '{_TERM}') AS g FROM documents),
u AS (SELECT doc_id, unnest(w) AS term, unnest(g[1:len(w)]) AS gap, generate_subscripts(w, 1) AS i FROM d),
p AS (SELECT doc_id, term, sum(length(gap) + length(term)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM u)
SELECT doc_id, term, (e - length(term))::INTEGER AS start, e::INTEGER AS "end" FROM p SEMI JOIN vb USING (term)""")
def _(t):
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w{2,}"), F.lit(0))
    vocabulary = t("benchmark", "text").select(F.explode_outer(words).alias("term")).where("term IS NOT NULL").distinct()
    return corpus.vocabulary_spans(t.heavy("documents", *DOC), "doc_id", "text", vocabulary).select("doc_id", "term", "start", "end")


@query("I25_vocabulary_mark", f"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '([\\pL\\pM\\pN\\p{{Pc}}]+)', chr(57344) || '\\1' || chr(57344), 'g'),
chr(57344) || '((?i)the|der|les|tion|and)' || chr(57344), chr(57345) || '\\1</mark>', 'g'), chr(57344), '', 'g').replace(chr(57345), '<mark class="term">')) AS m FROM documents""")
def _(t):
    return t.heavy("documents", *DOC).select("doc_id", F.md5(notes.mark_words("text", ["the", "der", "les", "tion", "and"])).alias("m"))
