"""The queries of this subpackage: name -> (function, SQL twin or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchframe.llm import chat
from matchframe.llm.centroid_clustering import centroid_clusters
from matchframe.llm.decontamination import contamination
from matchframe.llm.exact_dedup import exact_dedup
from matchframe.llm.importance_resampling import importance_resample
from matchframe.llm.jaccard_join import jaccard_components
from matchframe.llm.language_id import identify
from matchframe.llm.line_dedup import line_dedup
from matchframe.llm.quality_classifier import quality_scores
from matchframe.llm.sentencepiece_sampling import sample_segmentations
from matchframe.llm.substring_dedup import substring_dedup
from matchframe.llm.token_counts import token_counts
from matchframe.llm.url_filter import url_filter

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Run, str | None]] = {}


def register(name: str, sql: str | None = None):
    def add(run: Run) -> Run:
        QUERIES[name] = (run, sql)
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register(
    "op4_chat_format",
    r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(role) + length(text)
    + length(regexp_replace(concat(role, text), '[^<\[\\]', '', 'g')) + 10 + 9 + 5 AS chars FROM c
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    CAST(sum(chars) AS BIGINT) AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  formatted_chars FROM g""",
)
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.sql(
        "SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '</s>[INST] ok [/INST]' AS text "
        "FROM VALUES (-1, 0, 'user'), (-1, 1, 'assistant') AS t(conv_id, turn, role)"
    )
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = given.unionByName(planted).withColumn("parts", chat.text_parts(F.col("text")))
    out = chat.format_chat(turns).select(
        "conv_id",
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        chat.read_chat(F.col("formatted")).alias("turns"),
        F.array_join(chat.read_loss(F.col("formatted"), F.col("loss")), "").alias("learned"),
    )
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )


@register(
    "op5_exact_dedup",
    """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
)
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


@register(
    "op7_line_dedup",
    """
WITH l AS (
  SELECT doc_id, source, pos, line, trim(line) AS t FROM (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
      unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents WHERE text IS NOT NULL)
), pages AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
n AS (SELECT source, t, count(DISTINCT doc_id) AS n FROM l WHERE t <> '' GROUP BY source, t),
bad AS (SELECT n.source, n.t FROM n JOIN pages p ON n.source IS NOT DISTINCT FROM p.source
  WHERE n.n >= 5 AND n.n > 0.1 * p.pages),
j AS (SELECT l.*, bad.t IS NOT NULL AS dropped FROM l
  LEFT JOIN bad ON bad.source IS NOT DISTINCT FROM l.source AND bad.t = l.t),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '') AS kept FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  CASE WHEN d.text IS NOT NULL THEN sha256(kept) END AS kept_sha256
FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id""",
)
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@register(
    "op6_substring_dedup",
    r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13),
g AS (SELECT doc_id, i, sha256(array_to_string(words[i:i + 12], ' ')) AS gram FROM s),
f AS (SELECT gram, min(doc_id) AS first FROM g GROUP BY gram),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM g JOIN f USING (gram) WHERE doc_id > first),
gone AS (SELECT doc_id, list(i) AS i FROM hit GROUP BY doc_id),
k AS (SELECT w.doc_id, words, coalesce(gone.i, []) AS gone FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id),
p AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
kept AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) AS text FROM p LEFT JOIN hit USING (doc_id, i)
  WHERE hit.doc_id IS NULL GROUP BY p.doc_id)
SELECT k.doc_id, len(words) AS n_words, len(gone) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM k LEFT JOIN kept ON kept.doc_id = k.doc_id""",
)
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@register(
    "op9_jaccard_join",
    r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, gram FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))) AS gram
    FROM w WHERE len(words) >= 3
    UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM w WHERE len(words) BETWEEN 1 AND 2)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM o JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * o >= 90 * (nx.n + ny.n - o)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS root FROM w UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id AND r.root < e.y)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id
JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) c ON c.doc_id = w.doc_id""",
)
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


@register("op3_url_filter")
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


@register("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text", "lang"), fold != 2)
    return out.select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score", "phrase_rate")


@register("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@register("op10_sentencepiece")
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sample_segmentations(table(spark, sf_dir, "documents").select("doc_id", "text"))
    part = lambda f: F.transform("segmentations", f)
    return out.select(
        "doc_id",
        F.size("segmentations").cast("long").alias("n_samples"),
        part(lambda s: s["n_pieces"]).alias("n_pieces"),
        part(lambda s: F.sha2(s["ids"], 256)).alias("ids_sha256"),
        part(lambda s: s["log_prob"]).alias("log_prob"),
        part(lambda s: s["inclusion"]).alias("inclusion"),
        "round_trip",
    )


@register("op8_decontamination")
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = contamination(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "lcs")


@register(
    "op11_importance_resampling",
    r"""
WITH b AS (SELECT range AS b FROM range(256)), t1 AS (SELECT b, CASE WHEN b % 2 = 1 THEN xor(b // 2, 3988292384) ELSE b // 2 END AS c FROM b),
t2 AS (SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END AS c FROM t1),
t3 AS (SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END AS c FROM t2),
t4 AS (SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END AS c FROM t3),
t5 AS (SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END AS c FROM t4),
t6 AS (SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END AS c FROM t5),
t7 AS (SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END AS c FROM t6),
t8 AS (SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END AS c FROM t7),
crc AS (SELECT list(c ORDER BY b) AS t FROM t8),
w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents),
q AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
v AS (SELECT DISTINCT word, hex(encode(word)) AS x FROM (SELECT word FROM w UNION ALL SELECT word FROM q)),
y AS (SELECT word, [4294967295] || list_transform(range(1, length(x), 2), lambda i: CAST('0x' || x[i:i + 1] AS BIGINT)) AS y FROM v),
h AS (SELECT word, xor(list_reduce(y, lambda c, d: xor(c // 256, t[xor(c, d) % 256 + 1])), 4294967295) % 10000 AS bucket FROM y, crc),
s AS (SELECT bucket, count(*) AS s FROM w JOIN h USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM q JOIN h USING (word) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE
  / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
d AS (SELECT doc_id, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight
  FROM w JOIN h USING (word) JOIN g USING (bucket) GROUP BY doc_id),
e AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  CAST('0x' || sha256('2024:' || doc_id)[1:8] AS BIGINT) AS u FROM documents LEFT JOIN d USING (doc_id)),
f AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((u + 0.5) / 4294967296))) AS BIGINT) AS score FROM e),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM f WHERE n_features >= 20)
SELECT f.*, r.rank FROM f LEFT JOIN r ON r.doc_id = f.doc_id AND r.rank <= (SELECT 10 * count(*) // 100 FROM r)""",
)
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def _clustering_sql(k: int = 16, rounds: int = 3, seed: int = 1) -> str:
    """The rounds one after another: every vector beside every centroid, the least (distance, number), floored means."""
    distance = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - u[i]) * (v[i] - u[i])))"
    steps = [
        f"""v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"""c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c, v AS u FROM v
  ORDER BY sha256('{seed}:' || vec_id) LIMIT {k})""",
    ]
    for n in range(rounds + 1):
        steps.append(
            f"""a{n} AS (SELECT vec_id, any_value(v) AS v, min_by(c, [d, c]) AS c, min(d) AS d
  FROM (SELECT vec_id, v, c, CAST({distance} AS BIGINT) AS d FROM v, c{n}) GROUP BY vec_id)"""
        )
        if n < rounds:
            steps.append(
                f"""m{n} AS (SELECT c, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS u FROM (
  SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{n}, (SELECT unnest(range(1, 65)) AS i) GROUP BY c, i) GROUP BY c),
c{n + 1} AS (SELECT c{n}.c, coalesce(m{n}.u, c{n}.u) AS u FROM c{n} LEFT JOIN m{n} ON m{n}.c = c{n}.c)"""
            )
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(u, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.c"""


@register("op12_centroid_clustering", _clustering_sql())
def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


@register("op13_quality_classifier")
def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_scores(docs, table(spark, sf_dir, "labels"), fold != 0)
    return out.select("doc_id", (fold == 0).alias("held_out"), "score", "predicted")
