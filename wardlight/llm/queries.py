"""The queries opN_<name>: each applies its operator to its whole table. ``SQL`` holds the twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, codes, decontam, jaccard, licenses, neardup, packing, pii, quality, repair, sharding, substrings, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op1_best_fit_packing")
def op1(spark, sf_dir):
    import public_tokenizers

    packed = packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"))
    return packed.withColumnRenamed("id", "doc_id")


OP2_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
),
l AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93
),
reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach AS r JOIN l ON l.a = r.b)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links,
    least(e.vec_id, coalesce(c.c, e.vec_id)) AS component_id, e.vec_id <= coalesce(c.c, e.vec_id) AS kept
FROM embeddings AS e LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) AS c ON c.a = e.vec_id
"""


@query("op2_embedding_near_dedup", OP2_SQL)
def op2(spark, sf_dir):
    found = neardup.near_duplicates(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


@query("op3_license_scans")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = licenses.scan(docs, "doc_id", "text", licenses.fit(docs, "doc_id", "text"))
    return licenses.per_document(docs, "doc_id", found).withColumnRenamed("id", "doc_id")


#: lower-cases A-Z only, as the operators do
LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
    SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id
    GROUP BY 1, 2
),
l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (
    SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM reach AS r JOIN l ON l.a = r.b
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id
FROM documents AS d LEFT JOIN n ON n.doc_id = d.doc_id
LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) AS c ON c.a = d.doc_id
"""


@query("op4_ngram_jaccard_join", OP4_SQL)
def op4(spark, sf_dir):
    found = jaccard.similar(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


@query("op5_sharding")
def op5(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def held_out(modulus: int, remainder: int):
    """Whether a row's label is never learnt from: crc32 of its id as text, modulo ``modulus``."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def scored(found: DataFrame, modulus: int, remainder: int) -> DataFrame:
    found = found.withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held_out(modulus, remainder).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def quality_model(docs: DataFrame, labels: DataFrame):
    return quality.fit(docs, "doc_id", "text", labels.where(~held_out(4, 2)), "doc_id", "quality")


@query("op6_quality_classifier")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return scored(quality.score(docs, "doc_id", "text", quality_model(docs, table(spark, sf_dir, "labels"))), 4, 2)


OP7_SQL = """
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(regexp_replace(role, '(\\\\|###|</turn>|:)', '#\\1', 'g')) + length(regexp_replace(text, '(\\\\|###|</turn>)', '#\\1', 'g')) + 14) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


@query("op7_chat_formatting", OP7_SQL)
def op7(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    turns = turns.unionByName(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"))
    # fields that are null stay in the record, so every row has the layout of a turn
    record = F.to_json(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    records = turns.select("conv_id", "turn", record.alias("record"))
    return chat.read_back(chat.format_chats(chat.canonical(records, "conv_id", "turn", "record"))).withColumnRenamed("id", "conv_id")


@query("op8_pii")
def op8(spark, sf_dir):
    return pii.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


@query("op9_toxicity")
def op9(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, "doc_id", "text", labels.where(~held_out(3, 1)), "doc_id", "toxic")
    return scored(toxicity.score(docs, "doc_id", "text", model), 3, 1)


OP10_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
    SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g
    FROM (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
),
dw AS (
    SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
    FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)
),
hit AS (SELECT doc_id, item_id, i, dw.m FROM dw JOIN bw ON dw.g = bw.g AND dw.m = bw.m),
n AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items,
    sha256(coalesce(t.items, '')) AS items_sha256, coalesce(n.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""


@query("op10_benchmark_decontamination", OP10_SQL)
def op10(spark, sf_dir):
    found = decontam.spans(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    hits = F.expr("aggregate(zip_with(starts, stops, (a, z) -> z - a), 0L, (x, y) -> x + y)")
    names = F.array_distinct(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", hits.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(names)), 256).alias("items_sha256"), (hits > 0).alias("contaminated"),
    )


#: crc32 of a string's bytes
CRC_SQL = (
    "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(octet_length({0}::BLOB)), lambda i: ('0x' || substr(hex({0}::BLOB), 2 * i::INT + 1, 2))::BIGINT)), "
    "lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"
)

OP11_SQL = f"""
WITH RECURSIVE d AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
    FROM conversations
),
h AS (SELECT *, {CRC_SQL.format("k")} % 20 AS h FROM d),
r AS (
    SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM h, (SELECT 0 AS copy UNION ALL SELECT 1) WHERE h <> 0 AND (copy = 0 OR h = 3)
),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 32), md5(text)) AS i FROM r),
f AS (
    SELECT *, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS body, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS copy,
        left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o
),
g AS (SELECT *, CASE WHEN body = '' THEN 1 WHEN copy > 1 THEN 2 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM f),
dp AS (
    SELECT conv_id, 0::BIGINT AS i, 0 AS state, 0::BIGINT AS cost, '' AS audit, '' AS made FROM (SELECT DISTINCT conv_id FROM g)
    UNION ALL
    SELECT conv_id, i, goal, (min(b)).cost, (min(b)).audit, (min(b)).made FROM (
        SELECT g.conv_id, g.i, e.goal, {{'cost': dp.cost + e.cost + CASE WHEN e.edit <> 'D' AND g.fault = 3 THEN 3 ELSE 0 END, 'audit': dp.audit || e.edit,
            'made': dp.made || CASE WHEN e.edit LIKE 'I%' THEN CASE WHEN dp.state = 2 THEN 'assistant:' ELSE 'user:' END || chr(10) ELSE '' END
                || CASE WHEN e.edit LIKE '%K' THEN g.role || ':' || g.text || chr(10) WHEN e.edit LIKE '%R' THEN CASE WHEN e.goal = 2 THEN 'user:' ELSE 'assistant:' END || g.text || chr(10) ELSE '' END}} AS b
        FROM dp JOIN g ON g.conv_id IS NOT DISTINCT FROM dp.conv_id AND g.i = dp.i + 1
        JOIN (VALUES (0, 0, 'D', 4, ''), (1, 1, 'D', 4, ''), (2, 2, 'D', 4, ''), (3, 3, 'D', 4, ''), (0, 1, 'K', 0, 's'),
            (0, 2, 'K', 0, 'u'), (1, 2, 'K', 0, 'u'), (3, 2, 'K', 0, 'u'), (2, 3, 'K', 0, 'a'), (0, 2, 'R', 3, ''), (1, 2, 'R', 3, ''), (3, 2, 'R', 3, ''), (2, 3, 'R', 3, ''),
            (0, 3, 'IK', 3, 'a'), (1, 3, 'IK', 3, 'a'), (3, 3, 'IK', 3, 'a'), (2, 2, 'IK', 3, 'u'), (0, 3, 'IR', 6, ''), (1, 3, 'IR', 6, ''), (3, 3, 'IR', 6, ''), (2, 2, 'IR', 6, '')
        ) AS e(state, goal, edit, cost, ini) ON e.state = dp.state AND (e.edit = 'D' OR g.fault NOT IN (1, 2)) AND (e.edit NOT LIKE '%K' OR e.ini = g.ini)
    ) GROUP BY conv_id, i, goal
),
n AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
        count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (i > 1 AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id
),
best AS (
    SELECT conv_id, min({{'cost': cost + t.price, 'audit': audit || t.edit, 'made': made || t.more}}) AS b
    FROM (SELECT dp.* FROM dp JOIN n ON n.conv_id IS NOT DISTINCT FROM dp.conv_id AND n.n = dp.i)
    JOIN (VALUES (0, 0, '', ''), (1, 6, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (2, 3, 'I', 'assistant:' || chr(10)), (3, 0, '', '')) AS t(state, price, edit, more) USING (state)
    GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    coalesce(b.cost, 0) AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(left(b.made, length(b.made) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def damaged(turns: DataFrame) -> DataFrame:
    """The conversations with the faults that the query plants by crc32 of ``conv_id:turn``."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    turns = turns.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), lot.alias("lot")).where("lot <> 0")
    text = F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("lot") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


@query("op11_conversation_repair", OP11_SQL)
def op11(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    plan = repair.plan(damaged(turns), "conv_id", "turn", "role", "text")
    found = plan.report.join(repair.digests(plan).withColumnRenamed("id", "_id"), F.col("id").eqNullSafe(F.col("_id"))).drop("_id")
    out = turns.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))



OP12_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, row_number() OVER () AS r FROM documents),
g AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT g, min(doc_id) AS least FROM g GROUP BY g),
c AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (g) WHERE least < doc_id),
k AS (SELECT r, list(p) AS gone FROM c GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
    sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE coalesce(t.body, '') END) AS kept_sha256
FROM d LEFT JOIN k USING (r) LEFT JOIN (
    SELECT r, string_agg(x, ' ' ORDER BY p) AS body FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d SEMI JOIN k USING (r)) ANTI JOIN c USING (r, p) GROUP BY r
) AS t USING (r)
"""


@query("op12_substring_dedup", OP12_SQL)
def op12(spark, sf_dir):
    found = substrings.repeated(table(spark, sf_dir, "documents"), "doc_id", "text")
    gone = F.expr("aggregate(zip_with(starts, stops, (a, z) -> z - a), 0L, (x, y) -> x + y)")
    return found.select(F.col("id").alias("doc_id"), "n_words", gone.alias("n_removed"), "kept_sha256")


#: every part assigned to the nearest entry of the codebook before, then the codebook after
OP13_ASSIGN = """
a{n} AS MATERIALIZED (
    SELECT v.j, v.r, min({{'d': list_sum(list_transform(list_zip(v.p, c.p), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT, 'e': c.e}}) AS b
    FROM parts AS v JOIN c{n} AS c ON c.j = v.j GROUP BY v.j, v.r
)"""
OP13_UPDATE = """
s{n} AS (SELECT j, (b).e AS e, i, sum(p[i])::BIGINT AS s, count(*) AS n FROM (SELECT a.b, v.* FROM a{n} AS a JOIN parts AS v ON v.j = a.j AND v.r = a.r) AS x, (SELECT unnest(range(1, 17)) AS i) GROUP BY 1, 2, 3),
c{m} AS MATERIALIZED (
    SELECT c.j, c.e, coalesce(n.p, c.p) AS p FROM c{n} AS c
    LEFT JOIN (SELECT j, e, list((s - (s % n + n) % n) // n ORDER BY i) AS p FROM s{n} GROUP BY j, e) AS n ON n.j = c.j AND n.e = c.e
)"""
OP13_SQL = (
    """
WITH k AS (
    SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) AS r, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
parts AS MATERIALIZED (SELECT r, j, v[16 * j + 1:16 * j + 16] AS p FROM k, (SELECT unnest(range(0, 4)) AS j)),
c0 AS (SELECT j, r - 1 AS e, p FROM parts WHERE r <= 256),"""
    + ",".join(OP13_ASSIGN.format(n=n) + "," + OP13_UPDATE.format(n=n, m=n + 1) for n in range(4))
    + ","
    + OP13_ASSIGN.format(n=4)
    + """,
o AS (SELECT r, string_agg(lower(lpad(to_hex((b).e), 2, '0')), '' ORDER BY j) AS code, sum((b).d)::BIGINT AS error FROM a4 GROUP BY r),
g AS (SELECT label, sum(error)::BIGINT AS label_error FROM o JOIN k USING (r) GROUP BY label)
SELECT k.vec_id, o.code, o.error, g.label_error, (SELECT sha256(string_agg(array_to_string(p, ','), ',' ORDER BY j, e)) FROM c4) AS codebooks_sha256
FROM k JOIN o USING (r) JOIN g ON g.label IS NOT DISTINCT FROM k.label
"""
)


@query("op13_vector_codes", OP13_SQL)
def op13(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = codes.fit(vectors, "vec_id", "embedding")
    coded = codes.error_by(codes.encode(vectors, "embedding", books).drop("embedding"), "label", out_col="label_error")
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))
