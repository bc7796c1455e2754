"""Answer scoring, text functions and agent logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairlead.functions import metrics as mt
from fairlead.functions import stems
from fairlead.functions import text as tx
from fairlead.operators import scoring, warehouse, windows
from fairlead.plans import bindings as b
from fairlead.plans.registry import query
from fairlead.session import scratch
from fairlead.sources import sinks, store as st

W = f"WITH {b.ANSWERS_SQL}"
FOUND = r"TRY_CAST(nullif(regexp_extract({0}, '-?\d+(?:\.\d+)?'), '') AS DOUBLE)"
STRIP = r"regexp_replace({0}, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')"


@query("J-9", f"""{W} SELECT query_result_id, true_value FROM answers LEFT JOIN keys ON k = {STRIP.format("reference")}""")
def with_true_value(spark, d):
    return scoring.with_true_value(b.answers(spark, d), b.cases(spark, d)).select("query_result_id", "true_value")


@query("M-1", f"""{W}, x AS (SELECT query_result_id, {FOUND.format("response")} AS f, true_value AS t
    FROM answers LEFT JOIN keys ON k = {STRIP.format("reference")})
  SELECT query_result_id, round(CASE WHEN f IS NULL OR t IS NULL THEN 0 WHEN f = t THEN 1
    ELSE greatest(0, 1 - abs(f - t) / greatest(abs(t), 1e-10)) END, 6) AS factual_correctness FROM x""")
def factual(spark, d):
    rows = scoring.score(b.answers(spark, d), b.cases(spark, d), ["factual_correctness"])
    return rows.select("query_result_id", "factual_correctness")


# Words by plain string functions: other characters become blanks, and the pieces between blanks are kept.
_BLANKS = "translate({0}, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ')"
_SPLIT = "list_filter(string_split({0}, ' '), lambda x: x <> '')"
_BY_SPACE = _SPLIT.format(_BLANKS)
_ALNUM = _SPLIT.format("regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')")


def _grams(source, key):
    """Word n-grams of orders 1 to 4 by position, from rows (key, item_id, t)."""
    lead = ", ".join(f"lead(w, {k}) OVER o AS w{k}" for k in (1, 2, 3))
    parts, text = [], "w"
    for n in (1, 2, 3, 4):
        parts.append(f"SELECT {key}, item_id, {n} AS n, {text} AS g FROM {source}_p WHERE {text} IS NOT NULL")
        text += f" || ' ' || w{n}"
    return f"""{source}_w AS (SELECT {key}, item_id, unnest(t) AS w, unnest(range(len(t))) AS i FROM {source}),
  {source}_p AS (SELECT {key}, item_id, w, {lead} FROM {source}_w WINDOW o AS (PARTITION BY {key} ORDER BY i)),
  {source}_g AS (SELECT {key}, item_id, n, g, count(*) AS c FROM ({" UNION ALL ".join(parts)}) GROUP BY ALL)"""


def _bleu_ctes(smooth):
    zero = "0.1 / size" if smooth else "2.2250738585072014e-308"
    return f"""said AS (SELECT query_result_id AS id, item_id, {_BY_SPACE.format("response")} AS t FROM answers),
  truth AS (SELECT item_id AS truth_id, item_id, {_BY_SPACE.format("text")} AS t FROM benchmark),
  {_grams("said", "id")}, {_grams("truth", "truth_id")},
  orders AS (SELECT unnest([1, 2, 3, 4]) AS n),
  hits AS (SELECT id, n, sum(least(s.c, r.c)) AS h FROM said_g s JOIN truth_g r USING (item_id, n, g) GROUP BY 1, 2),
  p AS (SELECT s.id, n, coalesce(h, 0) AS h, greatest(1, len(t) - n + 1) AS size
    FROM said s CROSS JOIN orders LEFT JOIN hits USING (id, n)),
  score AS (SELECT id, bool_or(n = 1 AND h = 0) AS none, sum(ln(CASE WHEN h = 0 THEN {zero} ELSE h / size END)) / 4 AS lp
    FROM p GROUP BY 1),
  bleu AS (SELECT id AS query_result_id, round(CASE WHEN none OR len(s.t) = 0 THEN 0
      ELSE exp(lp + least(0, 1 - len(r.t) / len(s.t))) END, 6) AS bleu_score
    FROM score JOIN said s USING (id) JOIN truth r ON r.item_id = s.item_id)"""


def _bleu_sql(smooth):
    return f"{W}, {_bleu_ctes(smooth)} SELECT * FROM bleu"


# The check engine measures edits in bytes. Each other letter of the texts becomes a control character, one byte.
_LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
_BYTES = " || ".join(f"chr({c})" for c in [*range(1, 9), *range(14, 32)][:len(_LETTERS)])
_ONE_BYTE = f"translate({{0}}, '{_LETTERS}', {_BYTES})"
SIMILAR_CTES = rf"""plain AS (SELECT query_result_id, {_ONE_BYTE.format("response")} AS a, {_ONE_BYTE.format("reference")} AS b FROM answers),
  alike AS (SELECT query_result_id, CASE WHEN strlen(a) <> length(a) OR strlen(b) <> length(b) THEN error('a letter is missing')::DOUBLE
      WHEN a = '' AND b = '' THEN 1.0
      ELSE round(1 - levenshtein(a, b) / greatest(strlen(a), strlen(b)), 6) END AS non_llm_string_similarity FROM plain)"""

# A row of the common-subsequence table is one number, a bit per reference word.
def _rouge_ctes(said="", truth=""):
    """``said`` and ``truth`` are joins that put another word ``w`` in place of a row's."""
    return f"""rt AS (SELECT item_id, {_ALNUM.format("text")} AS t FROM benchmark),
  rw AS (SELECT item_id, unnest(t) AS w, unnest(range(len(t))) AS i FROM rt),
  st AS (SELECT query_result_id AS id, item_id, {_ALNUM.format("response")} AS t FROM answers),
  sw AS (SELECT id, item_id, unnest(t) AS w, unnest(range(len(t))) AS i FROM st),
  {said}{truth}
  bits AS (SELECT item_id, w, sum(CASE WHEN i > 120 THEN error('too many words')::HUGEINT ELSE 1::HUGEINT << i::INT END)::HUGEINT AS m
    FROM {"rw" if not truth else "rws"} GROUP BY ALL),
  met AS (SELECT id, list(m ORDER BY i) AS ms FROM {"sw" if not said else "sws"} JOIN bits USING (item_id, w) GROUP BY id),
  filled AS (SELECT st.id, len(st.t) AS said, len(rt.t) AS truth, (1::HUGEINT << len(rt.t)::INT) - 1 AS everything, coalesce(ms, []) AS ms
    FROM st JOIN rt USING (item_id) LEFT JOIN met ON met.id = st.id),
  rows AS (SELECT id, said, truth, truth - bit_count(list_reduce(list_prepend(everything, ms),
      lambda r, m: ((r + (r & m)) | (r - (r & m))) & everything)) AS common FROM filled),
  rouge AS (SELECT id AS query_result_id, round(CASE WHEN common = 0 OR said = 0 OR truth = 0 THEN 0
      ELSE 2 * (common / said) * (common / truth) / (common / said + common / truth) END, 6) AS rogue_score FROM rows)"""


ROUGE_CTES = _rouge_ctes()

# Stems in SQL: a consonant y is marked, so that vowels are one class of letters; each step is one column.
_V, _C = "[aeiouy]", "[^aeiouy]"


def _marked(w):
    return rf"regexp_replace(regexp_replace({w}, '^y', 'Y'), '([aeiou])y', '\1Y', 'g')"


def _times(w, n):
    """At least n vowels followed by a consonant."""
    return f"regexp_matches({_marked(w)}, '^{_C}*({_V}+{_C}+){{{n - 1}}}{_V}+{_C}')"


def _ends_short(w):
    return f"regexp_matches({_marked(w)}, '^{_V}{_C}$|{_C}{_V}[^aeiouywxY]$')"


def _rest(w, n):
    return f"left({w}, length({w})::INT - {n})"


def _step(w, rules, n):
    """The first suffix that fits is replaced where enough stands before it."""
    cases = []
    for suffix, instead in rules:
        rest = _rest(w, len(suffix))
        also = f" AND right({rest}, 1) IN ('s', 't')" if suffix == "ion" else ""
        cases.append(f"WHEN ends_with({w}, '{suffix}') THEN CASE WHEN {_times(rest, n)}{also} THEN {rest} || '{instead}' ELSE {w} END")
    return f"CASE {' '.join(cases)} ELSE {w} END"


def _stem_ctes():
    odd = " ".join(f"WHEN '{a}' THEN '{z}'" for a, z in stems.IRREGULAR.items())
    ied = lambda tail: f"WHEN ends_with(w1, '{tail}') THEN CASE WHEN length(w1) = 4 THEN {_rest('w1', 1)} ELSE {_rest('w1', 2)} END"
    bare = lambda tail: f"WHEN ends_with(w2, '{tail}') AND regexp_matches({_marked(_rest('w2', len(tail)))}, '{_V}') THEN {_rest('w2', len(tail))}"
    logi = f"WHEN ends_with(w5, 'logi') THEN CASE WHEN {_times(_rest('w5', 3), 1)} THEN {_rest('w5', 1)} ELSE w5 END"
    step_2 = _step("w5", stems.STEP_2, 1).replace("CASE ", f"CASE {logi} ", 1)
    e = _rest("w8", 1)
    return f"""s1 AS (SELECT DISTINCT w AS w0, w AS w1 FROM (SELECT w FROM rw UNION ALL SELECT w FROM sw) WHERE length(w) > 3),
  s2 AS (SELECT w0, CASE {ied('ies')} WHEN ends_with(w1, 'sses') THEN {_rest('w1', 2)}
    WHEN ends_with(w1, 's') AND NOT ends_with(w1, 'ss') THEN {_rest('w1', 1)} ELSE w1 END AS w2 FROM s1),
  s3 AS (SELECT w0, w2, CASE WHEN ends_with(w2, 'ied') OR ends_with(w2, 'eed') THEN NULL {bare('ed')} {bare('ing')} END AS b FROM s2),
  s4 AS (SELECT w0, CASE WHEN ends_with(w2, 'ied') THEN CASE WHEN length(w2) = 4 THEN {_rest('w2', 1)} ELSE {_rest('w2', 2)} END
    WHEN ends_with(w2, 'eed') THEN CASE WHEN {_times(_rest('w2', 3), 1)} THEN {_rest('w2', 1)} ELSE w2 END
    WHEN b IS NULL THEN w2 WHEN right(b, 2) IN ('at', 'bl', 'iz') THEN b || 'e'
    WHEN length(b) > 1 AND right(b, 1) = left(right(b, 2), 1) AND regexp_matches({_marked('b')}, '{_C}$')
      THEN CASE WHEN right(b, 1) IN ('l', 's', 'z') THEN b ELSE {_rest('b', 1)} END
    WHEN {_times('b', 1)} AND NOT {_times('b', 2)} AND {_ends_short('b')} THEN b || 'e' ELSE b END AS w4 FROM s3),
  s5 AS (SELECT w0, CASE WHEN length(w4) > 2 AND ends_with(w4, 'y') AND regexp_matches({_marked(_rest('w4', 1))}, '{_C}$')
    THEN {_rest('w4', 1)} || 'i' ELSE w4 END AS w5a FROM s4),
  s5b AS (SELECT w0, CASE WHEN ends_with(w5a, 'alli') AND {_times(_rest('w5a', 4), 1)} THEN {_rest('w5a', 2)} ELSE w5a END AS w5 FROM s5),
  s6 AS (SELECT w0, {step_2} AS w6 FROM s5b),
  s7 AS (SELECT w0, {_step("w6", stems.STEP_3, 1)} AS w7 FROM s6),
  s8 AS (SELECT w0, {_step("w7", [(s, "") for s in stems.STEP_4], 2)} AS w8 FROM s7),
  s9 AS (SELECT w0, CASE WHEN ends_with(w8, 'e') AND ({_times(e, 2)} OR ({_times(e, 1)} AND NOT {_ends_short(e)})) THEN {e} ELSE w8 END AS w9
    FROM s8),
  stem AS (SELECT w0, CASE w0 {odd} ELSE CASE WHEN ends_with(w9, 'll') AND {_times(_rest('w9', 1), 2)} THEN {_rest('w9', 1)}
    ELSE w9 END END AS w FROM s9),
  sws AS (SELECT id, item_id, i, coalesce(stem.w, sw.w) AS w FROM sw LEFT JOIN stem ON w0 = sw.w),
  """, """rws AS (SELECT item_id, i, coalesce(stem.w, rw.w) AS w FROM rw LEFT JOIN stem ON w0 = rw.w),"""


@query("M-2", _bleu_sql(True))
def bleu(spark, d):
    score = mt.bleu_score(F.col("response"), F.col("reference")).alias("bleu_score")
    return b.answers(spark, d).select("query_result_id", score)


@query("M-3", _bleu_sql(False))
def bleu_plain(spark, d):
    score = mt.bleu_score(F.col("response"), F.col("reference"), smooth=False).alias("bleu_score")
    return b.answers(spark, d).select("query_result_id", score)


@query("M-4", f"{W}, {SIMILAR_CTES} SELECT * FROM alike")
def string_similarity(spark, d):
    score = mt.string_similarity(F.col("response"), F.col("reference")).alias("non_llm_string_similarity")
    return b.answers(spark, d).select("query_result_id", score)


@query("M-5", f"{W}, {ROUGE_CTES} SELECT * FROM rouge")
def rouge(spark, d):
    score = mt.rouge_score(F.col("response"), F.col("reference")).alias("rogue_score")
    return b.answers(spark, d).select("query_result_id", score)


@query("M-5-stems", f"{W}, {_rouge_ctes(*_stem_ctes())} SELECT * FROM rouge")
def rouge_of_stems(spark, d):
    score = mt.rouge_score(F.col("response"), F.col("reference"), stems=True).alias("rogue_score")
    return b.answers(spark, d).select("query_result_id", score)


@query("M-6", f"""{W} SELECT query_result_id, CASE WHEN contains(response, reference) THEN 1.0 ELSE 0.0 END AS string_present
  FROM answers""")
def string_presence(spark, d):
    score = mt.string_presence(F.col("response"), F.col("reference")).alias("string_present")
    return b.answers(spark, d).select("query_result_id", score)


@query("M-7", """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS semantic_similarity
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def semantic(spark, d):
    vectors = b.table(spark, d, "embeddings")
    left = vectors.select("vec_id", F.col("embedding").alias("response_embedding"))
    right = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("reference_embedding"))
    return scoring.add_scores(left.join(right, "vec_id"), ["semantic_similarity"]).select("vec_id", "semantic_similarity")


@query("M-8", """SELECT l_orderkey, round(avg(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END), 6) AS faithfulness,
  count(*) AS n_claims FROM lineitem GROUP BY 1""")
def verdict_ratio(spark, d):
    verdicts = b.table(spark, d, "lineitem").select("l_orderkey", (F.col("l_returnflag") == "A").alias("supported"))
    return scoring.verdict_ratio(verdicts, "l_orderkey")


@query("M-9", f"""{W} SELECT query_result_id, CASE WHEN contains(response, reference) THEN 1.0 ELSE 0.0 END AS string_present,
    true AS call_ok, true AS scored_ok, n_chars AS prompt_tokens, 'run_query' AS tools
  FROM answers JOIN documents ON doc_id = query_result_id""")
def run_record(spark, d):
    scored = scoring.score(b.answers(spark, d), b.cases(spark, d), ["string_present"])
    tokens = b.table(spark, d, "documents").select(F.col("doc_id").alias("query_result_id"), F.col("n_chars").alias("prompt_tokens"))
    rows = scoring.run_record(scored, scores=["string_present"]).join(tokens, "query_result_id")
    return rows.select("query_result_id", "string_present", "call_ok", "scored_ok", "prompt_tokens", F.lit("run_query").alias("tools"))


@query("M-10", f"""{W}, {_bleu_ctes(True)}, {SIMILAR_CTES}, {ROUGE_CTES},
  x AS (SELECT query_result_id, {FOUND.format("response")} AS f, true_value AS t, response, reference
    FROM answers LEFT JOIN keys ON k = {STRIP.format("reference")})
  SELECT query_result_id, source, round(CASE WHEN f IS NULL OR t IS NULL THEN 0 WHEN f = t THEN 1
      ELSE greatest(0, 1 - abs(f - t) / greatest(abs(t), 1e-10)) END, 6) AS factual_correctness, bleu_score,
    non_llm_string_similarity, rogue_score, CASE WHEN contains(response, reference) THEN 1.0 ELSE 0.0 END AS string_present
  FROM x JOIN bleu USING (query_result_id) JOIN alike USING (query_result_id) JOIN rouge USING (query_result_id)
  JOIN documents ON doc_id = query_result_id""")
def score_all(spark, d):
    rows = scoring.score(b.answers(spark, d), b.cases(spark, d))
    return rows.select("query_result_id", "source", *scoring.TEXT_METRICS)


@query("U-2", """SELECT doc_id, round(least(1.0, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) / 100), 6) AS length_score
  FROM documents""")
def custom_metric(spark, d):
    from fairlead.functions.surface import length_score
    scoring.register("length_score", ("response",), length_score)
    rows = b.table(spark, d, "documents").withColumnRenamed("text", "response")
    return scoring.add_scores(rows, ["length_score"]).select("doc_id", "length_score")


@query("U-3", """SELECT user_id, i AS point_no, event_id FROM (
    SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts) - 1 AS i FROM events)""")
def table_function(spark, d):
    from fairlead.functions.surface import register_functions
    register_functions(spark)
    # A path is one user's day of points.
    paths = b.table(spark, d, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(
        F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("p"))
    keyed = paths.select("user_id", F.transform("p", lambda x: x["event_id"].cast("double")).alias("lat"),
                         F.transform("p", lambda x: x["event_id"].cast("double")).alias("lon"))
    return spark.sql(
        "SELECT user_id, e.point_no, CAST(e.lat AS BIGINT) AS event_id FROM {paths}, LATERAL explode_path(lat, lon) e", paths=keyed)


# Text functions


@query("F-1", r"""WITH r AS (SELECT doc_id, text, lang FROM documents)
  SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang || ' answer ' || doc_id
    ELSE regexp_replace(regexp_replace(text, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g'), '(?m)^###[ \t\n\r\f\v]*.*?\n', '', 'g') END AS answer
  FROM r""")
def extract_answer(spark, d):
    answer = F.concat(F.lit("\n\n## Answer\n"), "lang", F.lit(" answer "), F.col("doc_id").cast("string"), F.lit("\n"))
    tail = F.when(F.col("doc_id") % 2 == 0, answer).otherwise(F.lit(""))
    response = F.concat(F.lit("# Report\n## Analysis\n"), "text", tail)
    return b.table(spark, d, "documents").select("doc_id", tx.extract_answer(response).alias("answer"))


@query("F-2", f"""SELECT doc_id, {FOUND.format("text")} AS first_number, len(regexp_extract_all(text, '-?\\d+(?:\\.\\d+)?')) AS n_numbers
  FROM documents""")
def numbers(spark, d):
    text = F.col("text")
    return b.table(spark, d, "documents").select(
        "doc_id", tx.first_number(text).alias("first_number"), F.size(tx.all_numbers(text)).alias("n_numbers"))


@query("F-3", r"""SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0
    THEN TRY_CAST(regexp_replace('**-' || o_custkey || '.5 SEK', '[^\d.]', '', 'g') AS DOUBLE) END AS number FROM orders""")
def clean_number(spark, d):
    reply = F.when(F.col("o_orderkey") % 3 == 0, F.lit(" None ")).otherwise(
        F.concat(F.lit("**-"), F.col("o_custkey").cast("string"), F.lit(".5 SEK")))
    return b.table(spark, d, "orders").select("o_orderkey", tx.clean_number(reply).alias("number"))


@query("F-4", """SELECT doc_id, '# Query Results' || chr(10) || chr(10) || '## Question' || chr(10) || lang || chr(10) || chr(10)
    || '## SQL Queries' || chr(10) || '```sql' || chr(10) || 'SELECT ' || doc_id || chr(10) || '```' || chr(10) || chr(10)
    || '## Response' || chr(10) || text || chr(10) || chr(10) AS markdown FROM documents""")
def markdown(spark, d):
    statements = F.array(F.concat(F.lit("SELECT "), F.col("doc_id").cast("string")))
    return b.table(spark, d, "documents").select(
        "doc_id", tx.response_markdown(F.col("lang"), statements, F.col("text")).alias("markdown"))


@query("F-5", """SELECT doc_id, 'SQL Query: SELECT ' || doc_id AS first, 'Agent Reasoning and Response: ' || text AS last FROM documents""")
def contexts(spark, d):
    statements = F.array(F.concat(F.lit("SELECT "), F.col("doc_id").cast("string")))
    found = tx.contexts(statements, F.col("text"))
    return b.table(spark, d, "documents").select("doc_id", F.get(found, F.lit(0)).alias("first"), F.get(found, F.lit(1)).alias("last"))


@query("F-6", """SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN 1 ELSE 2 END AS n, 'SELECT ' || doc_id AS first FROM documents""")
def parse_statements(spark, d):
    one = F.concat(F.lit("SELECT "), F.col("doc_id").cast("string"))
    kind = F.col("doc_id") % 3
    stored = F.when(kind == 0, F.concat(F.lit('{"'), one, F.lit('","SELECT 2"}'))).when(
        kind == 1, F.concat(F.lit('["'), one, F.lit('", "SELECT 2"]'))).otherwise(one)
    found = tx.parse_statements(stored)
    return b.table(spark, d, "documents").select("doc_id", F.size(found).alias("n"), F.get(found, F.lit(0)).alias("first"))


@query("F-7", "SELECT role AS tool, count(*) AS n FROM conversations GROUP BY 1")
def tool_names(spark, d):
    calls = b.table(spark, d, "conversations").select(F.array(F.struct(F.col("role").alias("tool_name"))).alias("calls"))
    return calls.select(F.explode(tx.tool_names(F.col("calls"))).alias("tool")).groupBy("tool").agg(F.count(F.lit(1)).alias("n"))


@query("F-8", """SELECT doc_id, TRY_CAST(CASE WHEN doc_id % 2 = 0 THEN '0.' || quality ELSE 'n/a' END AS DOUBLE) AS factual_correctness,
  CAST(toxic AS DOUBLE) AS string_present FROM labels""")
def coerce(spark, d):
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("0."), F.col("quality").cast("string"))).otherwise("n/a")
    rows = b.table(spark, d, "labels").select("doc_id", text.alias("factual_correctness"), F.col("toxic").alias("string_present"))
    return scoring.coerce_scores(rows, ["factual_correctness", "string_present"])


@query("F-9", """SELECT doc_id, CAST(CASE WHEN quality <> 0 THEN quality ELSE CASE WHEN toxic = 1 THEN 0.5 ELSE quality END END AS DOUBLE) AS score
  FROM labels""")
def or_else(spark, d):
    second = F.when(F.col("toxic") == 1, 0.5)
    return b.table(spark, d, "labels").select("doc_id", tx.or_else(F.col("quality").cast("double"), second).alias("score"))


@query("F-13", """SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_quantity = l_linenumber THEN 1
    ELSE greatest(0, 1 - abs(l_quantity - l_linenumber) / greatest(abs(l_linenumber), 1e-10)) END, 6) AS score FROM lineitem""")
def relative_score(spark, d):
    score = tx.relative_score(F.col("l_quantity"), F.col("l_linenumber"))
    return b.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", score.alias("score"))


@query("F-14", """SELECT source, CASE WHEN stddev_samp(quality) IS NULL THEN 'N/A' ELSE printf('%.3f', stddev_samp(quality)) END AS deviation
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def format_deviation(spark, d):
    rows = b.table(spark, d, "documents").select("doc_id", "source").join(b.table(spark, d, "labels"), "doc_id", "left")
    return rows.groupBy("source").agg(F.stddev_samp("quality").alias("s")).select(
        "source", tx.format_deviation(F.col("s")).alias("deviation"))


# Agent logs


LINES = f"""lines AS (SELECT conv_id, turn, role = 'user' AS opens, {STRIP.format("text")} AS t,
    sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS statement_no FROM conversations)"""


@query("W-8", f"""WITH {LINES} SELECT conv_id AS session_id, CAST(statement_no AS BIGINT) AS statement_no, min(turn) AS first_line,
    string_agg(t, ' ' ORDER BY turn) AS sql FROM lines
  WHERE statement_no > 0 AND (opens OR (t <> '' AND NOT starts_with(t, 'INFO')))
  GROUP BY 1, 2 HAVING max(t) FILTER (opens) <> ''""")
def extract_sql(spark, d):
    return windows.extract_sql(b.dialogue(spark, d))


@query("W-6", """SELECT conv_id, role, first_at, row_number() OVER (PARTITION BY conv_id ORDER BY first_at) AS position
  FROM (SELECT conv_id, role, min(turn) AS first_at FROM conversations GROUP BY 1, 2)""")
def distinct_ordered(spark, d):
    return windows.distinct_ordered(b.table(spark, d, "conversations"), ["conv_id"], "role", "turn")


# Store sinks


def _scored_rows(spark, d):
    docs, labels = b.table(spark, d, "documents"), b.table(spark, d, "labels")
    score = F.col("quality").cast("string")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("result_key"), F.col("lang").alias("query"), F.col("text").alias("direct_response"),
        F.col("text").alias("full_response"), F.regexp_extract("source", r"\d+", 0).cast("int").alias("llm_model_id"),
        F.lit("[]").alias("sql_queries"), (F.col("doc_id") % 20).cast("int").alias("test_no"), F.lit("[]").alias("tool_calls"),
        F.lit(None).cast("timestamp_ntz").alias("timestamp"), F.when(F.col("doc_id") % 5 == 0, F.col("doc_id")).cast("long").alias("existing_query_result_id"),
        F.lit("[]").alias("retrieved_contexts"), F.lit("t").alias("ground_truth"),
        *[(score if s == "factual_correctness" else F.lit("bad")).alias(s) for s in warehouse.SCORES],
        F.when(F.col("doc_id") % 2 == 0, F.struct(
            F.col("n_chars").cast("double").alias("prompt_tokens"), F.lit(1.0).alias("completion_tokens"),
            (F.col("n_chars") + 1).cast("double").alias("total_tokens"))).alias("token_usage"))


_ID = "md5('{}/' || doc_id)"
_RESULT_ID = f"CASE WHEN doc_id % 5 = 0 THEN CAST(doc_id AS VARCHAR) ELSE {_ID.format('query_result')} END AS query_result_id"
_ANSWERS = f"""SELECT 'query_result' AS name, {_ID.format('query_result')} AS id, CAST(regexp_extract(source, '[0-9]+') AS INTEGER) AS llm_model_id,
    lang AS query, text AS direct_response, text AS full_response, '[]' AS sql_queries, CAST(doc_id % 20 AS INTEGER) AS test_no,
    '[]' AS tool_calls FROM documents WHERE doc_id % 5 <> 0
  UNION ALL BY NAME SELECT 'token_usage' AS name, {_ID.format('token_usage')} AS id, {_RESULT_ID}, CAST(n_chars AS DOUBLE) AS prompt_tokens,
    1.0::DOUBLE AS completion_tokens, CAST(n_chars + 1 AS DOUBLE) AS total_tokens FROM documents WHERE doc_id % 2 = 0"""
_ROWS = ("name", "id", "query_result_id", "llm_model_id", "query", "direct_response", "full_response", "sql_queries", "test_no", "tool_calls",
         "prompt_tokens", "completion_tokens", "total_tokens")


def _all_rows(tables, names):
    """The rows of all tables under each other, each with the name of its table."""
    return warehouse.union_outcomes(*[df.withColumn("name", F.lit(n)) for n, df in tables.items() if n in names])


@query("S-14", f"""{_ANSWERS}
  UNION ALL BY NAME SELECT 'evaluation_metrics' AS name, {_ID.format('evaluation_metrics')} AS id, CAST(quality AS DOUBLE) AS factual_correctness
    FROM documents LEFT JOIN labels USING (doc_id)
  UNION ALL BY NAME SELECT 'query_evaluation' AS name, {_ID.format('query_evaluation')} AS id, {_RESULT_ID},
    {_ID.format('evaluation_metrics')} AS evaluation_metrics_id, '[]' AS retrieved_contexts, 't' AS ground_truth FROM documents""")
def fan_out(spark, d):
    parts = st.fan_out(_scored_rows(spark, d), "result_key")
    return _all_rows(parts, parts).select(*_ROWS, "evaluation_metrics_id", "retrieved_contexts", "ground_truth", "factual_correctness")


# Appended as a batch and again as the same one, and read back from the store.
@query("S-15", _ANSWERS)
def fan_out_plain(spark, d):
    parts, folder = st.fan_out(_scored_rows(spark, d), "result_key", evaluated=False), scratch(spark, "store")
    for _ in range(2):
        st.append(parts, folder)
    return _all_rows(st.read_store(spark, folder), ("query_result", "token_usage")).select(*_ROWS)


@query("S-13", """SELECT DISTINCT CAST(regexp_extract(source, '[0-9]+') AS INTEGER) AS id, source AS name FROM documents
  WHERE source NOT IN ('src0', 'src1')""")
def seed_models(spark, d):
    seed = b.store(spark, d)["llm_models"]
    held = seed.filter(F.col("name").isin("src0", "src1"))
    return st.seed_models(held, seed).select("id", "name")


@query("S-20", """SELECT doc_id, 'QUERY:' || chr(10) || lang || chr(10) || chr(10) || 'RESPONSE:' || chr(10) || text || chr(10) || chr(10)
    || 'SQL QUERIES:' || chr(10) || chr(10) || '--- Query 1 ---' || chr(10) || 'SELECT ' || doc_id || chr(10)
    || chr(10) || '--- Query 2 ---' || chr(10) || 'SELECT 2' || chr(10) AS value FROM documents""")
def archive(spark, d):
    rows = b.table(spark, d, "documents").select(
        "doc_id", F.col("lang").alias("query"), F.col("text").alias("response"),
        F.array(F.concat(F.lit("SELECT "), F.col("doc_id").cast("string")), F.lit("SELECT 2")).alias("sql_queries"))
    folder = scratch(spark, "archive")
    sinks.write_archive(rows, folder, "doc_id")
    return sinks.read_archive(spark, folder, "long", "doc_id")
