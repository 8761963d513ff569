"""Row-local text operators on documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, notes, spans
from ..operators import corpus, documents
from .registry import query
from .text_sql import CLEAN_TEXT, MASK, WS, squeeze

DOC = ("doc_id", "text")
# A few marks of clinical notes are put around the documents so that every rule has work to do.
RAW = "('Admission Date: [**2101-01-01**] x' || chr(10) || text || ' [**Name' || chr(10) || 'B**] pt w/ hx.. <b>c/o</b>' || chr(9) || chr(9) || 'pain;; H/O mi')"


def raw():
    return F.concat(F.lit("Admission Date: [**2101-01-01**] x\n"), "text", F.lit(" [**Name\nB**] pt w/ hx.. <b>c/o</b>\t\tpain;; H/O mi"))


def md5(c):
    return F.md5(c)


@query("I1_clean_text", f"""SELECT doc_id, md5({CLEAN_TEXT(RAW)}) AS m, 'd' AS kind FROM documents
UNION ALL SELECT page_id, md5({CLEAN_TEXT('html')}), 'p' FROM pages""")
def _(t):
    d = t.heavy("documents", *DOC).select("doc_id", md5(notes.clean_text(raw())).alias("m"), F.lit("d").alias("kind"))
    p = t.heavy("pages", "page_id", "html").select(F.col("page_id").alias("doc_id"), md5(notes.clean_text("html")).alias("m"), F.lit("p").alias("kind"))
    return d.unionByName(p)


@query("I2_clean_for_model", f"""SELECT doc_id, md5({squeeze(f"lower(regexp_replace(regexp_replace({RAW}, '\\[\\*\\*.*?\\*\\*\\]', ' ', 'g'), '[^a-zA-Z0-9.,;:%\\-()\\t-\\r \\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]', '', 'g'))")}) AS m FROM documents""")
def _(t):
    return t.heavy("documents", *DOC).select("doc_id", md5(notes.clean_for_model(raw())).alias("m"))


_TOK = f"""tok AS (SELECT doc_id, list_filter(string_split({squeeze("regexp_replace(" + squeeze("lower(text)") + ", '[^\\pL\\pM\\pN\\p{Pc}\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]', ' ', 'g')")}, ' '), lambda x: x <> '') AS w FROM documents)"""
_STOP = "[" + ", ".join(f"'{w}'" for w in fixed.STOPWORDS_EN) + ", 'tion']"


@query("I3_preprocess", f"""WITH {_TOK} SELECT doc_id, len(w)::INTEGER AS n_tokens, len(list_filter(w, lambda x: NOT list_contains({_STOP}, x)))::INTEGER AS n_kept,
md5(array_to_string(list_filter(w, lambda x: NOT list_contains({_STOP}, x)), ' ')) AS m FROM tok""")
def _(t):
    d = t.heavy("documents", *DOC).select("doc_id", notes.preprocess("text", stopwords=False).alias("w"))
    kept = notes.remove_stopwords(F.col("w"), "en", ["tion"])
    return d.select("doc_id", F.size("w").alias("n_tokens"), F.size(kept).alias("n_kept"), md5(F.array_join(kept, " ")).alias("m"))


def abbr_sql(x: str) -> str:
    # Unicode word boundaries by hand: mark them with a private character around every word run.
    s = f"regexp_replace({x}, '([\\pL\\pM\\pN\\p{{Pc}}]+)', chr(57344) || '\\1' || chr(57344), 'g')"
    for a, full in fixed.ABBREVIATIONS_SHORT.items():
        head = "".join(chr(57344) + ch + chr(57344) if ch.isalpha() and len(a) > 1 and "/" in a else ch for ch in a)
        if "/" not in a:
            head = chr(57344) + a + chr(57344)
        if a == "w/":
            continue
        marked = "".join(chr(57344) + p + chr(57344) if p.isalpha() else p for p in full.split(" ")) if " " not in full else (
            " ".join(chr(57344) + p + chr(57344) for p in full.split(" ")))
        s = f"regexp_replace({s}, '(?i){head}', '{marked}', 'g')"
    return f"replace({s}, chr(57344), '')"


@query("I5_strip_headers", "SELECT doc_id, md5(" + squeeze("regexp_replace(regexp_replace('Sex: M' || chr(10) || 'Service: ' || text || chr(10) || 'x', '(?i)sex:.*?\\n', ' ', 'g'), '(?i)service:.*?\\n', ' ', 'g')") + """) AS m,
md5(""" + squeeze("regexp_replace(regexp_replace('Name: X' || chr(10) || 'CHIEF COMPLAINT:' || chr(10) || text, '(?m)^Name:.*$', '', 'g'), '(?m)^[A-Z][A-Z\\t-\\r ]+:[\\t-\\r ]*$', '', 'g')") + ") AS m_lines FROM documents")
def _(t):
    a = F.concat(F.lit("Sex: M\nService: "), "text", F.lit("\nx"))
    b = F.concat(F.lit("Name: X\nCHIEF COMPLAINT:\n"), "text")
    return t.heavy("documents", *DOC).select("doc_id", md5(notes.strip_headers(a)).alias("m"), md5(notes.strip_line_headers(b)).alias("m_lines"))


@query("I4_clean_note", f"""WITH c AS (SELECT doc_id, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace({RAW}, '(?s)\\[\\*\\*.*?\\*\\*\\]', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g')), '^{WS}+|{WS}+$', '', 'g') AS x FROM documents)
SELECT doc_id, md5(x) AS m, md5({abbr_sql('x')}) AS m_expanded FROM c""")
def _(t):
    d = t.heavy("documents", *DOC).select("doc_id", raw().alias("x"))
    return d.select("doc_id", md5(notes.clean_note("x")).alias("m"), md5(notes.clean_note("x", fixed.ABBREVIATIONS_SHORT)).alias("m_expanded"))


@query("I6_letters_only", """SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^a-z\\t-\\r ]', ' ', 'g'), '[\\t-\\r ]+', ' ', 'g'))) AS m FROM documents""")
def _(t):
    return t.heavy("documents", *DOC).select("doc_id", md5(notes.letters_only("text")).alias("m"))


@query("I7_text_stats", f"""WITH s AS (SELECT doc_id, text, list_filter(string_split({squeeze('text')}, ' '), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, length(text)::INTEGER AS n_chars, len(w)::INTEGER AS n_words, len(list_distinct(w))::INTEGER AS n_unique FROM s""")
def _(t):
    return t.heavy("documents", *DOC).select(
        "doc_id", F.length("text").alias("n_chars"), notes.word_count("text").alias("n_words"), notes.unique_words("text").alias("n_unique")
    )


def flags_sql(patterns) -> str:
    return ", ".join(f"regexp_matches(x, '{p}')::INTEGER AS {n}" for n, p in patterns.items())


@query("I8_concept_flags", f"WITH d AS (SELECT doc_id, {MASK('text')} AS x FROM documents) SELECT doc_id, {flags_sql(fixed.CONCEPT_PATTERNS)} FROM d")
def _(t):
    return t.heavy("documents", *DOC).select("doc_id", *notes.pattern_flags("text", fixed.CONCEPT_PATTERNS))


@query("I9_risk_keyword_flags", f"WITH d AS (SELECT doc_id, {MASK('text')} AS x, length(lower(text)) AS n FROM documents) SELECT doc_id, n::INTEGER AS nlp_note_length, {flags_sql(fixed.RISK_PATTERNS)} FROM d")
def _(t):
    return t.heavy("documents", *DOC).select("doc_id", F.length(F.lower("text")).alias("nlp_note_length"), *notes.pattern_flags("text", fixed.RISK_PATTERNS))


_PICK = fixed.CONCEPT_PATTERNS | {"word_the": r"\bthe\b|\bder\b|\bles?\b"}
POSITIONS_SQL = "WITH d AS (SELECT doc_id, text, " + MASK("text") + " AS x FROM documents), p AS (" + " UNION ALL ".join(
    f"SELECT doc_id, text, '{n}' AS feature, regexp_extract_all(x, '{p}') AS hits, string_split_regex(x, '{p}') AS gaps FROM d" for n, p in _PICK.items()
) + """), u AS (SELECT doc_id, text, feature, unnest(hits[1:5]) AS hit, unnest(gaps[1:len(hits[1:5])]) AS gap, generate_subscripts(hits[1:5], 1) AS i FROM p),
s AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, feature ORDER BY i) AS e FROM u)"""


@query("I10_concept_positions", POSITIONS_SQL + "SELECT doc_id, feature, (e - length(hit))::INTEGER AS start, e::INTEGER AS \"end\", substring(text, (e - length(hit) + 1)::BIGINT, length(hit)) AS hit FROM s")
def _(t):
    d = t.heavy("documents", *DOC).select("doc_id", F.explode_outer(spans.concept_positions("text", _PICK, 5)).alias("s")).where("s IS NOT NULL")
    return d.select("doc_id", "s.feature", "s.start", "s.end", F.col("s.text").alias("hit"))


@query("I11_concept_matches", "WITH d AS (SELECT doc_id, " + MASK("text") + " AS x FROM documents) SELECT doc_id, " + ", ".join(
    f"array_to_string(regexp_extract_all(x, '{p}')[1:3], '|') AS {n}" for n, p in _PICK.items()) + " FROM d")
def _(t):
    return t.heavy("documents", *DOC).select("doc_id", *[F.array_join(notes.first_matches("text", p, 3), "|").alias(n) for n, p in _PICK.items()])


_SENT = """string_split_regex(regexp_replace(text, '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), '[\\r\\n]+')"""
_NEG = "(?s)(" + "|".join(fixed.SENTENCE_NEGATIONS).replace("\\s", "[\\t-\\r ]") + ")"


@query("I12_concept_groups_negated", f"""WITH s AS (SELECT doc_id, lower(unnest({_SENT})) AS s FROM documents)
SELECT doc_id, """ + ", ".join(
    f"max(CASE WHEN regexp_matches(s, '{notes.any_of(w)}') AND NOT regexp_matches(regexp_extract(s, '(?s)^(.*?)(?:{notes.any_of(w)})', 1), '{_NEG}') THEN 1 ELSE 0 END)::INTEGER AS {n}"
    for n, w in fixed.CONCEPT_GROUPS.items()) + " FROM s GROUP BY 1")
def _(t):
    d = t.heavy("documents", *DOC).select("doc_id", notes.sentences("text").alias("s"))
    return d.select("doc_id", *notes.concept_flags_negated("s"))


@query("I15_modified_name", """SELECT doc_id, CASE WHEN toxic = 1 THEN 'Absent_' WHEN quality = 0 THEN 'Possible_' WHEN doc_id % 3 = 0 THEN 'History_' WHEN doc_id % 5 = 0 THEN 'Family_' ELSE '' END
|| replace('heart failure ' || doc_id, ' ', '_') AS name FROM labels""")
def _(t):
    d = F.col("doc_id")
    name = notes.modified_name(F.concat(F.lit("heart failure "), d.cast("string")), F.col("toxic") == 1, F.col("quality") == 0, d % 3 == 0, d % 5 == 0)
    return t("labels").select("doc_id", name.alias("name"))


@query("I16_entity_filters", """WITH w AS (SELECT conv_id, turn, string_split(text || ' ' || conv_id * 7 || ',5', ' ') AS w FROM conversations),
e AS (SELECT conv_id, turn, generate_subscripts(w, 1) AS place, trim(lower(unnest(w))) AS x FROM w)
SELECT conv_id, turn, place::INTEGER AS place, x FROM e WHERE length(x) BETWEEN 2 AND 100 AND NOT regexp_matches(x, '^[0-9 .,]+$') AND (turn + place) % 4 <> 1""")
def _(t):
    c = t("conversations", "conv_id", "turn", "text")
    said = F.concat("text", F.lit(" "), (F.col("conv_id") * 7).cast("string"), F.lit(",5"))
    words = c.select("conv_id", "turn", F.posexplode(F.split(said, " ")).alias("place", "x")).withColumn("place", F.col("place") + 1)
    return words.where(notes.keep_entity("x", (F.col("turn") + F.col("place")) % 4 == 1)).select("conv_id", "turn", "place", F.trim(F.lower("x")).alias("x"))


@query("I18_concept_id", """SELECT p_partkey, p_type || '_C' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '_NEG' ELSE '' END AS full_id, 'C' || p_size AS plain FROM part""")
def _(t):
    code = F.concat(F.lit("C"), F.col("p_size").cast("string"))
    neg = F.col("p_partkey") % 2 == 0
    return t("part").select("p_partkey", notes.concept_id("p_type", code, neg).alias("full_id"), notes.concept_id("p_type", code, neg, False, False).alias("plain"))


@query("I26_sentiment_polarity", """WITH w AS (SELECT doc_id, source, unnest(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z\\t-\\r ]', ' ', 'g'), '[\\t-\\r ]+', ' ', 'g')), ' ')) AS w FROM documents),
l AS (SELECT doc_id, CASE w WHEN 'the' THEN 0.5 WHEN 'and' THEN 0.2 WHEN 'of' THEN -0.4 WHEN 'der' THEN -0.1 WHEN 'les' THEN 0.3 END AS s FROM w),
d AS (SELECT doc_id, coalesce(avg(s), 0) AS s FROM l GROUP BY 1)
SELECT source, round(avg(s), 6) AS polarity FROM documents JOIN d USING (doc_id) GROUP BY 1""")
def _(t):
    s = notes.lexicon_mean(notes.tokens(notes.letters_only("text")), LEXICON)
    return t.heavy("documents", "source", "text").select("source", s.alias("s")).groupBy("source").agg(F.round(F.avg("s"), 6).alias("polarity"))


LEXICON = {"the": 0.5, "and": 0.2, "of": -0.4, "der": -0.1, "les": 0.3}
_D22 = tuple(fixed.RISK_PATTERNS)


@query("D22_keyword_agg", f"WITH d AS (SELECT source, {MASK('text')} AS x, length(text) AS n, doc_id % 3 - 1 AS s FROM documents) SELECT source, " + ", ".join(
    f"max(regexp_matches(x, '{fixed.RISK_PATTERNS[n]}')::INTEGER) AS {n}" for n in _D22) + ", round(avg(s), 6) AS nlp_sentiment_score, sum(n)::BIGINT AS nlp_note_length FROM d GROUP BY 1")
def _(t):
    d = t.heavy("documents", "doc_id", "source", "text")
    out = corpus.keyword_summary(d, "source", "text", {n: fixed.RISK_PATTERNS[n] for n in _D22}, F.col("doc_id") % 3 - 1)
    return out.withColumn("nlp_sentiment_score", F.round("nlp_sentiment_score", 6))


@query("I28_merge_text_to_cohort", "SELECT l.doc_id, md5(coalesce(d.text, '')) AS m FROM labels l LEFT JOIN (SELECT * FROM documents WHERE lang <> 'de') d USING (doc_id)")
def _(t):
    out = documents.merge_to_cohort(t("labels", "doc_id"), t("documents", "doc_id", "text", "lang").where("lang <> 'de'").drop("lang"), "doc_id", "text")
    return out.select("doc_id", md5(F.col("text")).alias("m"))
