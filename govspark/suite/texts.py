"""Chunking, sampling, classification, history and search on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from govspark.functions import classify
from govspark.operators import chunk, combined_chunks, history, search, text_index
from govspark.operators.spread import spread_scan
from govspark.operators.vector import hash_embeddings
from govspark.scratch import run_dir
from govspark.sources.tables import table
from govspark.suite.registry import query

B = "' ' || chr(9) || chr(10) || chr(13)"


def words(column: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({column}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_contains_any(text: str, values: list[str]) -> str:
    return f"len(list_filter({sql_list(values)}, lambda w: contains({text}, w))) > 0"


def docs(spark, sf):
    return spread_scan(table(spark, sf, "documents"))


@query("chunk_recursive")
def chunk_recursive(spark, sf):
    return chunk.chunk_recursive(docs(spark, sf), size=200, overlap=40)


# A chunker is no SQL, but whole texts without overlap must come out letter by letter.
LETTERS = "length(regexp_replace(text, '\\s', '', 'g'))"


def whole_chunks(spark, sf, size=200):
    chunks = chunk.chunk_recursive(docs(spark, sf), size=size, overlap=0)
    return chunks.withColumn("letters", F.length(F.regexp_replace("content", r"\s", "")).cast("bigint"))


@query("chunk_cover", f"""
SELECT doc_id, md5(regexp_replace(text, '\\s', '', 'g')) AS digest, TRUE AS numbered FROM documents WHERE {LETTERS} > 0""")
def chunk_cover(spark, sf):
    """All chunks of a document, put together again, are its text."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    joined = whole_chunks(spark, sf).groupBy("doc_id").agg(parts.alias("parts"), F.max("total_chunks").alias("n"))
    text = F.regexp_replace(F.array_join(F.col("parts.content"), ""), r"\s", "")
    numbered = F.col("parts.chunk_index") == F.sequence(F.lit(0), F.col("n") - 1)
    return joined.select("doc_id", F.md5(text).alias("digest"), numbered.alias("numbered"))


# Without white space a text has no separator, and the chunker becomes a window over its characters, which SQL can say.
DENSE = "regexp_replace(text, '\\s', '', 'g')"


def dense_sql(size: int, overlap: int) -> str:
    width, step = 4 * size, 4 * (size - overlap)
    return f"""
texts AS (SELECT doc_id, source, t, CASE WHEN length(t) <= {width} THEN 1 ELSE 1 + CAST(ceil((length(t) - {width}) / {step}.0) AS BIGINT) END AS n
          FROM (SELECT doc_id, source, {DENSE} AS t FROM documents) WHERE length(t) > 0),
chunks AS (SELECT doc_id, source, CAST(i AS INTEGER) AS chunk_index, CAST(n AS INTEGER) AS total_chunks, substr(t, i * {step} + 1, {width}) AS content
           FROM (SELECT *, unnest(range(n)) AS i FROM texts)),
sized AS (SELECT *, CAST(length(content) AS INTEGER) AS chunk_size, CAST(length(content) // 4 AS INTEGER) AS chunk_tokens FROM chunks)"""


def dense_chunks(spark, sf, size=200, overlap=40):
    dense = docs(spark, sf).withColumn("text", F.regexp_replace("text", r"\s", ""))
    return chunk.chunk_recursive(dense, size=size, overlap=overlap)


@query("chunk_overlap", f"""
WITH {dense_sql(chunk.CHUNK_SIZE, chunk.CHUNK_OVERLAP)}
SELECT doc_id, source, chunk_index, total_chunks, chunk_size, chunk_tokens, content FROM sized""")
def chunk_overlap(spark, sf):
    return dense_chunks(spark, sf, chunk.CHUNK_SIZE, chunk.CHUNK_OVERLAP)


@query("filter_chunk_tokens", f"""
WITH {dense_sql(200, 40)} SELECT doc_id, chunk_index, chunk_size, chunk_tokens, content FROM sized WHERE chunk_tokens BETWEEN 50 AND 199""")
def filter_chunk_tokens(spark, sf):
    kept = chunk.filter_by_tokens(dense_chunks(spark, sf), 50, 199)
    return kept.select("doc_id", "chunk_index", "chunk_size", "chunk_tokens", "content")


@query("chunk_fixed", f"""
WITH cut AS (SELECT doc_id, source, length(text) // 4 AS step, text, unnest([0, 1, 2]) AS i FROM documents),
kept AS (SELECT doc_id, source, i, trim(substr(text, i * step + 1, 3000), {B}) AS content FROM cut)
SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_index, content
FROM kept WHERE length(content) > 200""")
def chunk_fixed(spark, sf):
    return chunk.chunk_fixed(docs(spark, sf))


STATS_SQL = """COUNT(*) AS total_chunks, ROUND(AVG(chunk_size), 6) AS average_chunk_size, MIN(chunk_size) AS min_chunk_size, MAX(chunk_size) AS max_chunk_size,
  ROUND(AVG(chunk_tokens), 6) AS average_tokens, MIN(chunk_tokens) AS min_tokens, MAX(chunk_tokens) AS max_tokens, CAST(SUM(chunk_tokens) AS BIGINT) AS total_tokens"""


@query("chunk_stats", f"WITH {dense_sql(200, 40)} SELECT {STATS_SQL} FROM sized")
def chunk_stats(spark, sf):
    return chunk.chunk_stats(dense_chunks(spark, sf))


@query("chunk_stats_by_source", f"WITH {dense_sql(200, 40)} SELECT source, {STATS_SQL} FROM sized GROUP BY source")
def chunk_stats_by_source(spark, sf):
    return chunk.chunk_stats(dense_chunks(spark, sf), "source")


def combined_files(spark, sf):
    return table(spark, sf, "documents").withColumn("title", F.concat(F.lit("doc"), F.col("doc_id").cast("string")))


@query("chunk_combined")
def chunk_combined(spark, sf):
    """Chunks of each source's combined document; tests hold them against the chunker on the joined text."""
    return combined_chunks.chunk_combined(combined_files(spark, sf), "doc_id", "title", "text", "source")


WIDE_SIZE, WIDE_OVERLAP = 64_000, 8_000
WIDE_CHARS, WIDE_BACK = 4 * WIDE_SIZE, 4 * WIDE_OVERLAP


# No file is longer than such a chunk, so only blank lines are cut at: SQL follows the chunks from one to the next.
@query("chunk_combined_wide", f"""
WITH RECURSIVE joined AS (
  SELECT lang, string_agg(chr(10) || chr(10) || '--- FILE: doc' || doc_id || ' ---' || chr(10) || text, chr(10) ORDER BY doc_id) AS t
  FROM documents WHERE trim(text, {B}) <> '' GROUP BY lang),
cut AS (SELECT lang, unnest(string_split(t, chr(10) || chr(10))) AS p, generate_subscripts(string_split(t, chr(10) || chr(10)), 1) AS i FROM joined),
segment AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY i) AS i, p FROM
  (SELECT lang, i, CASE WHEN i = 1 THEN p ELSE chr(10) || chr(10) || p END AS p FROM cut) WHERE p <> ''),
placed AS (SELECT *, SUM(length(p)) OVER (PARTITION BY lang ORDER BY i) AS e, e - length(p) AS s, COUNT(*) OVER (PARTITION BY lang) AS n FROM segment),
begun AS (SELECT x.lang, x.i, min(y.i) AS j, min(y.s) AS js, any_value(x.n) AS n FROM placed x JOIN placed y ON y.lang = x.lang AND y.i <= x.i
  AND x.s - y.s <= {WIDE_BACK} AND x.e - y.s <= {WIDE_CHARS} GROUP BY 1, 2),
steps AS (SELECT b.lang, b.i, any_value(b.j) AS j, coalesce(min(y.i), any_value(b.n) + 1) AS upto FROM
  (SELECT lang, i, j, js, n FROM begun UNION ALL SELECT lang, 0, 1, 0, n FROM placed WHERE i = 1) b
  LEFT JOIN placed y ON y.lang = b.lang AND y.i > b.i AND y.e - b.js > {WIDE_CHARS} GROUP BY 1, 2),
path AS (SELECT lang, i, j, upto FROM steps WHERE i = 0
  UNION ALL SELECT s.lang, s.i, s.j, s.upto FROM path JOIN steps s ON s.lang = path.lang AND s.i = path.upto),
chunk AS (SELECT path.lang, path.i, trim(string_agg(p, '' ORDER BY placed.i), {B}) AS content
  FROM path JOIN placed ON placed.lang = path.lang AND placed.i >= path.j AND placed.i < path.upto GROUP BY 1, 2)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY i) - 1 AS INTEGER) AS chunk_index, CAST(COUNT(*) OVER (PARTITION BY lang) AS INTEGER) AS total_chunks,
  CAST(length(content) AS INTEGER) AS chunk_size, CAST(length(content) // 4 AS INTEGER) AS chunk_tokens, content FROM chunk WHERE content <> ''""")
def chunk_combined_wide(spark, sf):
    """Chunks for a model that reads much at once, of one combined document per language."""
    return combined_chunks.chunk_combined(combined_files(spark, sf), "doc_id", "title", "text", "lang", WIDE_SIZE, WIDE_OVERLAP)


DELIMITERS = [*chunk.PARAGRAPH_DELIMITERS, "\n"]


def _paragraph_sql() -> str:
    steps, pieces = [], "[text]"
    for i, mark in enumerate(DELIMITERS):
        literal = " || ".join("chr(10)" if c == "\n" else f"'{c}'" for c in mark)
        steps.append(f"p{i + 1} AS (SELECT doc_id, CASE WHEN length(p[1]) > 2000 THEN list_filter(list_transform(flatten("
                     f"list_transform(p, lambda c: string_split(c, {literal}))), lambda c: trim(c, {B})), lambda c: length(c) > 100)"
                     f" ELSE p END AS p FROM p{i})")
    return f"WITH p0 AS (SELECT doc_id, {pieces} AS p FROM documents), " + ", ".join(steps)


@query("paragraphs", f"""
{_paragraph_sql()}
SELECT doc_id, content FROM (SELECT doc_id, unnest(p) AS content FROM p{len(DELIMITERS)}) WHERE length(content) BETWEEN 200 AND 2000""")
def paragraphs(spark, sf):
    return docs(spark, sf).select("doc_id", F.explode(chunk.paragraphs(F.col("text"), 1000, DELIMITERS)).alias("content"))


@query("section_sample", """
WITH numbered AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, COUNT(*) OVER (PARTITION BY source) AS n
                  FROM documents),
sectioned AS (SELECT source, doc_id, ['beginning', 'early_middle', 'late_middle', 'end'][least((rn - 1) // greatest(1, n // 4), 3) + 1] AS section
              FROM numbered)
SELECT source, doc_id, section, CAST(row_number() OVER (PARTITION BY source, section ORDER BY md5(doc_id || ':seed'), doc_id) AS INTEGER) AS pick
FROM sectioned QUALIFY pick <= 3""")
def section_sample(spark, sf):
    return chunk.section_sample(table(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id")


@query("text_section_samples", f"""
WITH cuts AS (SELECT doc_id, text, length(text) AS n, unnest([0, 1, 2, 3]) AS s FROM documents),
sections AS (SELECT doc_id, s, substr(text, CAST(floor(n * s / 4) AS BIGINT) + 1, CAST(floor(n * (s + 1) / 4) AS BIGINT) - CAST(floor(n * s / 4) AS BIGINT)) AS text FROM cuts),
pieces AS (SELECT *, CASE WHEN length(text) BETWEEN 200 AND 6000 THEN [text] ELSE [] END AS whole FROM sections),
windows AS (SELECT doc_id, s, unnest(list_distinct(list_filter(list_transform([0, 1, 2], lambda i: trim(substr(text, i * (length(text) // 4) + 1, 3000), {B})),
            lambda c: length(c) > 200))) AS c FROM pieces)
SELECT doc_id, ['beginning', 'early_middle', 'late_middle', 'end'][s + 1] AS section, c AS sample FROM windows""")
def text_section_samples(spark, sf):
    sections = chunk.text_sections(docs(spark, sf))
    samples = chunk.meaningful_samples(F.col("content"))
    return sections.select("doc_id", "section", F.explode(samples).alias("sample")).distinct()


@query("embed_chunks", f"""
WITH {dense_sql(200, 40)}
SELECT doc_id, chunk_index, 256 AS dim, CASE WHEN regexp_matches(content, '[A-Za-z0-9_]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM sized""")
def embed_chunks(spark, sf):
    """Width and length of every chunk's vector."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x * x))
    return hash_embeddings(dense_chunks(spark, sf)).select("doc_id", "chunk_index", F.size("embedding").alias("dim"), F.round(norm, 4).alias("norm"))


@query("embed_chunk_vectors")
def embed_chunk_vectors(spark, sf):
    """Vectors of the chunks of whole texts; tests hold them against word counts."""
    chunks = chunk.chunk_recursive(docs(spark, sf), size=200, overlap=40)
    return hash_embeddings(chunks).select("doc_id", "chunk_index", "content", "embedding")


@query("topic_terms", f"""
WITH found AS (SELECT doc_id, source || ' - ' || lang AS title, list_filter({sql_list(['tion', 'the', 'UND', 'que', 'ing', 'council'])},
  lambda t: contains(lower(text), lower(t)) AND NOT contains('what is the proposal', lower(t))) AS f FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat([split_part(title, ' - ', 1)], f)))[1:5], ', ') AS topics FROM found""")
def topic_terms(spark, sf):
    terms = ["tion", "the", "UND", "que", "ing", "council"]
    title = F.concat_ws(" - ", "source", "lang")
    found = classify.topic_terms(F.col("text"), F.lit("what is the proposal"), title, terms)
    return docs(spark, sf).select("doc_id", F.array_join(found, ", ").alias("topics"))


def talk(spark, sf):
    return table(spark, sf, "conversations")


@query("classify_greeting", f"""
WITH said AS (SELECT conv_id, turn, lower(trim(text, {B})) AS s FROM conversations)
SELECT conv_id, turn, list_contains({sql_list(classify.GREETINGS)}, s) OR (len(regexp_extract_all(s, '\\S+')) <= 3
  AND {sql_contains_any('s', classify.GREETINGS)} AND NOT {sql_contains_any('s', classify.DATA_WORDS)}) AS is_greeting FROM said""")
def classify_greeting(spark, sf):
    return talk(spark, sf).select("conv_id", "turn", classify.is_greeting(F.col("text")).alias("is_greeting"))


# Questions made of the role and the text, so that every rule is met.
QUESTION_SQL = """
asked AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'How many voters? ' WHEN turn = 1 THEN 'Treasury proposal ' WHEN turn = 2 THEN 'Staking: '
          WHEN turn = 3 THEN 'Slot AUCTION ' WHEN turn = 4 THEN 'Token ' ELSE '' END || text AS q FROM conversations)"""


def asked(spark, sf):
    turn = F.col("turn")
    lead = (
        F.when(turn == 0, "How many voters? ").when(turn == 1, "Treasury proposal ").when(turn == 2, "Staking: ")
        .when(turn == 3, "Slot AUCTION ").when(turn == 4, "Token ").otherwise("")
    )
    return talk(spark, sf).select("conv_id", "turn", F.concat(lead, "text").alias("q"))


@query("route_question", f"""
WITH {QUESTION_SQL}
SELECT conv_id, turn, CASE WHEN {sql_contains_any('lower(q)', classify.VOTING_WORDS + classify.PROPOSAL_WORDS)} THEN 'ONCHAIN' ELSE 'STATIC' END AS data_source,
  CASE WHEN {sql_contains_any('lower(q)', classify.VOTING_WORDS)} THEN 'voting_data'
       WHEN {sql_contains_any('lower(q)', classify.PROPOSAL_WORDS)} THEN 'governance_data' END AS "table" FROM asked""")
def route_question(spark, sf):
    return asked(spark, sf).select("conv_id", "turn", classify.route(F.col("q")).alias("r")).select("conv_id", "turn", "r.*")


@query("topic_bucket", f"WITH {QUESTION_SQL} SELECT conv_id, turn, CASE " + " ".join(
    f"WHEN {sql_contains_any('lower(q)', w)} THEN '{n}'" for n, w in classify.TOPICS) + " ELSE 'general' END AS topic FROM asked")
def topic_bucket(spark, sf):
    return asked(spark, sf).select("conv_id", "turn", classify.topic(F.col("q")).alias("topic"))


LAST_SQL = "(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations)"


@query("history_window", f"SELECT conv_id, turn, role, text FROM {LAST_SQL} WHERE age <= 5")
def history_window(spark, sf):
    return history.last_messages(talk(spark, sf))


TRANSCRIPT_SQL = f"""
WITH kept AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM {LAST_SQL} WHERE age <= 5)
SELECT conv_id, string_agg(i || '. ' || upper(left(role, 1)) || substr(role, 2) || ': ' ||
  CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END, chr(10) ORDER BY turn) AS transcript FROM kept GROUP BY conv_id"""


@query("history_transcript", TRANSCRIPT_SQL)
def history_transcript(spark, sf):
    return history.history_transcript(talk(spark, sf))


@query("recent_user_topics", f"""
SELECT conv_id, string_agg(left(text, 100), '; ' ORDER BY turn) AS topics FROM {LAST_SQL}
WHERE age <= 3 AND role = 'user' AND length(text) > 10 GROUP BY conv_id""")
def recent_user_topics(spark, sf):
    return history.recent_user_topics(talk(spark, sf))


RECALL_SQL = f"""
WITH asked AS (SELECT conv_id, max(turn) AS asked_at, arg_max(text, turn) AS q FROM conversations WHERE role = 'user' GROUP BY conv_id),
scored AS (SELECT c.conv_id, turn, text, len(list_intersect({words('text')}, {words('q')})) AS overlap
           FROM conversations c JOIN asked a ON c.conv_id = a.conv_id WHERE turn < asked_at AND trim(text, {B}) <> ''),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY overlap DESC, turn DESC) AS r FROM scored WHERE overlap > 0)
SELECT conv_id, 'Previous relevant interactions:' || chr(10) || string_agg('- ' || text, chr(10) ORDER BY r) || chr(10) || chr(10) AS memory
FROM ranked WHERE r <= 5 GROUP BY conv_id"""


@query("memory_recall", RECALL_SQL)
def memory_recall(spark, sf):
    return history.memory_recall(talk(spark, sf))


MARKERS = ["Than", "Der "]


@query("trim_to_budget", f"""
WITH RECURSIVE rows AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
marked AS (SELECT *, max(CASE WHEN {sql_contains_any('line', MARKERS)} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS 9 PRECEDING) = 1 AS first FROM rows),
wanted AS (SELECT doc_id, line, min((CASE WHEN first THEN 0 ELSE 1000000 END) + n) AS place FROM marked WHERE first OR length(line) < 200 GROUP BY doc_id, line),
cand AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS i FROM wanted),
walk AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS used, CAST('' AS VARCHAR) AS line, FALSE AS kept FROM documents
  UNION ALL SELECT w.doc_id, c.i, w.used + CASE WHEN w.used + length(c.line) + 1 < 1500 THEN length(c.line) + 1 ELSE 0 END, c.line,
            w.used + length(c.line) + 1 < 1500 FROM walk w JOIN cand c ON c.doc_id = w.doc_id AND c.i = w.i + 1)
SELECT doc_id, COALESCE(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE kept), '') AS trimmed FROM walk GROUP BY doc_id""")
def trim_to_budget(spark, sf):
    return docs(spark, sf).select("doc_id", history.trim_to_budget(F.col("text"), MARKERS, 1500).alias("trimmed"))


SCORE_SQL = f"3 * len(list_intersect({words('source')}, q)) + 2 * len(list_intersect({words('lang')}, q)) + len(list_intersect({words('text')}, q))"
SEARCH_SQL = f"""
scored AS (SELECT doc_id, source, lang, n_chars, CAST({SCORE_SQL} AS INTEGER) AS match_score
           FROM documents, (SELECT ['src3', 'en', 'the', 'tion', 'and'] AS q))"""
QUESTION = "src3 en the tion and"
ATTRIBUTES = ["source", "lang", "text"]


@query("keyword_search", f"""
WITH {SEARCH_SQL} SELECT doc_id, source, lang, match_score FROM scored WHERE match_score > 0 ORDER BY match_score DESC, doc_id LIMIT 5""")
def keyword_search(spark, sf):
    return search.keyword_search(docs(spark, sf), QUESTION, ATTRIBUTES).select("doc_id", "source", "lang", "match_score")


@query("search_by_tags", f"""
WITH {SEARCH_SQL} SELECT doc_id, source, match_score FROM scored WHERE match_score > 0 AND source IN ('src1', 'src2') AND lang = 'en'
ORDER BY match_score DESC, doc_id LIMIT 5""")
def search_by_tags(spark, sf):
    tagged = docs(spark, sf).withColumn("tags", F.array("source"))
    wanted = search.search_filter({"lang": "en"}, "tags", ["src1", "src2"])
    return search.keyword_search(tagged, QUESTION, ATTRIBUTES, wanted).select("doc_id", "source", "match_score")


@query("search_recent", f"""
WITH {SEARCH_SQL} SELECT * FROM (SELECT doc_id, n_chars, match_score FROM scored WHERE match_score > 0 ORDER BY match_score DESC, doc_id LIMIT 5)
ORDER BY n_chars DESC, doc_id""")
def search_recent(spark, sf):
    return search.search_recent(docs(spark, sf), QUESTION, ATTRIBUTES, "n_chars").select("doc_id", "n_chars", "match_score")


# Two words of every fiftieth text, the first without its second letter, as a hurried user types them.
def typed_queries(spark, sf):
    some = table(spark, sf, "documents").where("doc_id % 50 = 0").select("doc_id", F.filter(text_index.words(F.col("text")), lambda w: F.length(w) >= 6).alias("w"))
    typed = F.concat(F.substr(F.get("w", F.lit(0)), F.lit(1), F.lit(1)), F.substr(F.get("w", F.lit(0)), F.lit(3)), F.lit(" "), F.get("w", F.lit(1)))
    return some.where(F.size("w") >= 2).select(F.col("doc_id").alias("query_id"), typed.alias("query"))


# SQL's distance counts bytes, so letters of two bytes are written as capitals, which no word has.
ACCENTS = "ßäçèéêíñóöü"


def one_byte(column: str) -> str:
    return f"translate({column}, '{ACCENTS}', 'ABCDEFGHIJK')"


def index_search_sql(where: str = "TRUE") -> str:
    """By brute force: the distance of every query word to every word of every text."""
    cut = "list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    return f"""
WITH long AS (SELECT doc_id, list_filter({cut.format('text')}, lambda x: length(x) >= 6) AS w FROM documents WHERE doc_id % 50 = 0),
asked AS (SELECT doc_id AS query_id, i, CASE WHEN i = 0 THEN substr(w[1], 1, 1) || substr(w[1], 3) ELSE w[2] END AS word
          FROM (SELECT *, unnest([0, 1]) AS i FROM long WHERE len(w) >= 2)),
token AS (SELECT key, attribute, unnest(w) AS term, unnest(range(len(w))) AS p FROM (
  SELECT doc_id AS key, 0 AS attribute, {cut.format('source')} AS w FROM documents WHERE {where}
  UNION ALL SELECT doc_id, 1, {cut.format('text')} FROM documents WHERE {where})),
term AS (SELECT DISTINCT term FROM token),
near AS (SELECT DISTINCT word, term, levenshtein({one_byte('word')}, {one_byte('term')}) AS typos FROM (SELECT DISTINCT word FROM asked), term
  WHERE abs(length(word) - length(term)) <= 2 AND levenshtein({one_byte('word')}, {one_byte('term')}) <= CASE WHEN length(word) >= 8 THEN 2 WHEN length(word) >= 4 THEN 1 ELSE 0 END),
hit AS (SELECT query_id, i, key, attribute, p, typos, min(typos) OVER (PARTITION BY query_id, i, key) AS least FROM asked JOIN near USING (word) JOIN token USING (term)),
best AS (SELECT * FROM hit WHERE typos = least),
per_word AS (SELECT query_id, key, i, min(typos) AS typos, min(attribute) AS attribute FROM best GROUP BY ALL),
per_post AS (SELECT query_id, key, SUM(typos) AS typos, SUM(attribute) AS attribute FROM per_word GROUP BY ALL HAVING COUNT(*) = 2),
close AS (SELECT x.query_id, x.key, min(greatest(1, abs(x.p - y.p))) AS d FROM best x JOIN best y USING (query_id, key, attribute) WHERE x.i = 0 AND y.i = 1 GROUP BY 1, 2)
SELECT query_id, key, CAST(typos AS INTEGER) AS typos, CAST(least(coalesce(d, 8), 8) AS INTEGER) AS proximity, CAST(attribute AS INTEGER) AS attribute,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY typos, least(coalesce(d, 8), 8), attribute, key) AS INTEGER) AS rank
FROM per_post LEFT JOIN close USING (query_id, key) QUALIFY rank <= 5"""


def text_search(spark, sf, where="TRUE"):
    path = run_dir(spark, "text-index")
    posts = table(spark, sf, "documents")
    text_index.build(posts, path, "doc_id", ["source", "text"])
    among = None if where == "TRUE" else posts.where(where).select(F.col("doc_id").alias("key"))
    return text_index.search(spark, path, typed_queries(spark, sf), among=among)


@query("typo_search", index_search_sql())
def typo_search(spark, sf):
    return text_search(spark, sf)


@query("typo_search_filtered", index_search_sql("lang = 'en'"))
def typo_search_filtered(spark, sf):
    return text_search(spark, sf, "lang = 'en'")
