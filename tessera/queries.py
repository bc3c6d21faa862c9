"""Queries over the driver's tables, one for each capability, with the SQL that gives the same rows.

documents stand for Markdown files at source/doc_id.md, conversations for generated items (a user's turn and the assistant's next one), labels for
check results (quality: grounded, toxic: not relevant).
"""

from __future__ import annotations

import shutil
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import BuildConfig, CacheConfig, DiscoveryConfig, ExportConfig, GenerationConfig, VerificationConfig, VerifierConfig
from tessera.functions import text as T
from tessera.functions import variants
from tessera.operators import completions, judging, prompts, qa
from tessera.operators.cache import cache_directory, generation_key, verification_key
from tessera.operators.chunking import chunk_documents, chunks_per_file, unique_chunks
from tessera.operators.order import numbered
from tessera.plans.build import build_dataset
from tessera.plans.files import Written, write_lines
from tessera.plans.model_stage import Call, ask, typed
from tessera.plans.verify import verify_dataset
from tessera.sources.dataset import numbered_records, read_dataset
from tessera.sources.repository import scan, select_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

PATH_SQL = "source || '/' || doc_id || '.md'"
WS_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: The key of a question in SQL, for text with ASCII white space.
NORM_SQL = r"lower(regexp_replace(trim(regexp_replace({}, '\s+', ' ', 'g')), '[?.!:;]+$', ''))"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".md"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(path.alias("path"), "text", "doc_id")


def chunks(spark: SparkSession, sf_dir: str, most: int = 4_000) -> DataFrame:
    return chunk_documents(files(spark, sf_dir), most)


def chunk_sql(most: int, select: str = "SELECT path, start_line, end_line, content_hash, chunk_id FROM ids", source: str = f"SELECT {PATH_SQL} AS path, text FROM documents") -> str:
    """Chunks of text without headings: cuts after the last line end that fits, else anywhere; then trimmed, numbered, hashed."""
    cut = f"CASE WHEN strpos(substr(rest, 1, {most}), chr(10)) = 0 THEN {most} ELSE {most} - strpos(reverse(substr(rest, 1, {most})), chr(10)) + 1 END"
    return f"""
WITH RECURSIVE input AS ({source}), walk AS (
  SELECT path, text, 0::BIGINT AS place, text AS rest FROM input
  UNION ALL
  SELECT path, text, place + k, substr(rest, k + 1) FROM (SELECT *, ({cut})::BIGINT AS k FROM walk WHERE length(rest) > {most})
), pieces AS (
  SELECT path, text, place, CASE WHEN length(rest) <= {most} THEN rest ELSE substr(rest, 1, ({cut})::BIGINT) END AS piece FROM walk
), trimmed AS (
  SELECT path, text, place + length(piece) - length(ltrim(piece, {WS_SQL})) AS place, trim(piece, {WS_SQL}) AS body FROM pieces
), placed AS (
  SELECT path, body, 1 + place - length(replace(substr(text, 1, place), chr(10), '')) AS start_line FROM trimmed WHERE body <> ''
), hashed AS (
  SELECT path, body, start_line::BIGINT AS start_line, (start_line + length(body) - length(replace(body, chr(10), '')))::BIGINT AS end_line, sha256(body) AS content_hash FROM placed
), ids AS (
  SELECT *, sha256(path || chr(0) || start_line || chr(0) || end_line || chr(0) || content_hash) AS chunk_id FROM hashed
)
{select}"""


# scans

LIMITS = DiscoveryConfig(max_files=700, max_bytes_per_file=4_000)


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_files(files(spark, sf_dir).select("path", F.octet_length("text").cast("long").alias("bytes")), LIMITS, keep=Written(spark))


_SELECTED_SQL = f"""
SELECT path, bytes, CASE WHEN n > {LIMITS.max_files} THEN 'file_limit' WHEN bytes > {LIMITS.max_bytes_per_file} THEN 'too_large' END AS reason
FROM (SELECT {PATH_SQL} AS path, strlen(text)::BIGINT AS bytes, row_number() OVER (ORDER BY source, doc_id || '.md') AS n FROM documents)"""


@query(f"SELECT path, bytes FROM ({_SELECTED_SQL}) WHERE reason IS NULL")
def discover_select(spark, sf_dir):
    return _selected(spark, sf_dir).where("reason IS NULL").select("path", "bytes")


@query(f"SELECT path, reason, CASE WHEN reason = 'too_large' THEN bytes END AS bytes FROM ({_SELECTED_SQL}) WHERE reason IS NOT NULL")
def discover_skip_reason(spark, sf_dir):
    return _selected(spark, sf_dir).where("reason IS NOT NULL").select("path", "reason", F.when(F.col("reason") == "too_large", F.col("bytes")).alias("bytes"))


@query("SELECT doc_id, sha256(replace(replace(replace(replace(text, ' the ', chr(13) || chr(10)), ' of ', chr(13)), chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS text_sha256 FROM documents")
def newline_normalize(spark, sf_dir):
    mixed = F.replace(F.replace(F.col("text"), F.lit(" the "), F.lit("\r\n")), F.lit(" of "), F.lit("\r"))
    return files(spark, sf_dir).select("doc_id", F.sha2(T.normalize_newlines(mixed), 256).alias("text_sha256"))


# chunks

@query(chunk_sql(4_000))
def chunk_oversized(spark, sf_dir):
    return chunks(spark, sf_dir).select("path", "start_line", "end_line", "content_hash", "chunk_id")


@query(chunk_sql(400))
def chunk_small_400(spark, sf_dir):
    return chunks(spark, sf_dir, 400).select("path", "start_line", "end_line", "content_hash", "chunk_id")


def _headed(text: Column) -> Column:
    return F.concat(F.lit("# One\n\n"), F.regexp_replace(text, "[#=~`>*+<|_-]", ""), F.lit("\n\n## Two\n\n"), F.regexp_replace(text, "[#=~`>*+<|_\n-]", ""))


_HEADED_SQL = f"""
SELECT {PATH_SQL} AS path, part, lead AS start_line, (lead + length(body) - length(replace(body, chr(10), '')))::BIGINT AS end_line, sha256(body) AS content_hash FROM (
  SELECT source, doc_id, 0 AS part, 1::BIGINT AS lead, rtrim('# One' || chr(10) || chr(10) || clean, {WS_SQL}) AS body FROM (SELECT *, regexp_replace(text, '[#=~`>*+<|_-]', '', 'g') AS clean FROM documents)
  UNION ALL
  SELECT source, doc_id, 1, (5 + length(clean) - length(replace(clean, chr(10), '')))::BIGINT, rtrim('## Two' || chr(10) || chr(10) || replace(clean, chr(10), ''), {WS_SQL}) FROM (SELECT *, regexp_replace(text, '[#=~`>*+<|_-]', '', 'g') AS clean FROM documents)
)"""


@query(_HEADED_SQL)
def chunk_sections(spark, sf_dir):
    headed = files(spark, sf_dir).select("path", _headed(F.col("text")).alias("text"))
    return chunk_documents(headed, 10_000_000).select("path", F.col("chunk_ord").alias("part"), "start_line", "end_line", "content_hash")


@query(chunk_sql(1_000, "SELECT path, min(start_line) AS first_line, max(end_line) AS last_line, sum(end_line - start_line + 1)::BIGINT AS lines, sum(length(body))::BIGINT AS characters FROM ids GROUP BY path"))
def chunk_line_ranges(spark, sf_dir):
    return chunks(spark, sf_dir, 1_000).groupBy("path").agg(F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"), F.sum(F.col("end_line") - F.col("start_line") + 1).alias("lines"), F.sum(F.length("text")).alias("characters"))


@query(chunk_sql(400, "SELECT chunk_id, count(*)::BIGINT AS copies FROM ids GROUP BY chunk_id HAVING count(*) > 1"))
def chunk_ids(spark, sf_dir):
    return chunks(spark, sf_dir, 400).groupBy("chunk_id").agg(F.count("*").alias("copies")).where("copies > 1")


@query(chunk_sql(4_000, "SELECT input.path, count(ids.path)::BIGINT AS chunks FROM input LEFT JOIN ids ON input.path = ids.path GROUP BY input.path"))
def chunks_by_file(spark, sf_dir):
    docs = files(spark, sf_dir)
    return chunks_per_file(docs, chunk_documents(docs))


# prompts and completions

@query(chunk_sql(4_000, "SELECT chunk_id, sha256('Q3 ' || path || ':' || start_line || '-' || end_line || chr(10) || body || chr(10) || path) AS prompt_sha256 FROM ids"))
def prompt_render(spark, sf_dir):
    template = "Q{{questions_per_chunk}} {{path}}:{{start_line}}-{{end_line}}\n{{chunk_text}}\n{{path}}"
    return chunks(spark, sf_dir).select("chunk_id", F.sha2(prompts.qa_prompt(template, 3), 256).alias("prompt_sha256"))


@query(f"SELECT doc_id, sha256('{{{{path}}}} ' || text || '|' || '{{{{chunk_text}}}}' || '|' || {PATH_SQL}) AS prompt_sha256 FROM documents")
def prompt_no_rescan(spark, sf_dir):
    values = {"chunk_text": F.concat(F.lit("{{path}} "), F.col("text")), "answer": F.lit("{{chunk_text}}"), "path": F.col("path")}
    return files(spark, sf_dir).select("doc_id", F.sha2(T.render_template("{{chunk_text}}|{{answer}}|{{path}}", values), 256).alias("prompt_sha256"))


def _completion() -> Column:
    """A whole text as a completion, bare, in a fence with words around it, or in white space; every fourth is cut before its last two characters, so that it is no JSON."""
    body = F.to_json(F.struct(F.array(F.struct(F.substring("text", 1, 40).alias("question"), F.substring(F.col("text"), F.lit(41), F.length("text")).alias("answer"))).alias("items")))
    k = F.col("doc_id") % 4
    return F.when(k == 0, body).when(k == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone."))).when(k == 2, F.concat(F.lit(" \n"), body, F.lit("\n"))).otherwise(F.concat(F.lit("```"), F.substring(body, F.lit(1), F.length(body) - 2)))


_BODY = "'{\"items\":[{\"question\":' || to_json(substr(text, 1, 40)) || ',\"answer\":' || to_json(substr(text, 41)) || '}]}'"


@query(f"SELECT doc_id, sha256(CASE WHEN doc_id % 4 = 3 THEN trim(substr(body, 1, length(body) - 2), {WS_SQL}) ELSE body END) AS candidate_sha256 FROM (SELECT doc_id, {_BODY} AS body FROM documents)")
def json_candidate(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", F.sha2(T.json_candidate(_completion()), 256).alias("candidate_sha256"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 <> 3 THEN sha256(substr(text, 1, 40) || chr(0) || substr(text, 41)) END AS items_sha256 FROM documents")
def completion_parse(spark, sf_dir):
    item = lambda name: F.variant_get("v", f"$.items[0].{name}", "string")
    return files(spark, sf_dir).withColumn("v", T.parsed_json(_completion())).select("doc_id", F.sha2(F.concat(item("question"), F.lit("\0"), item("answer")), 256).alias("items_sha256"))


@query("SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS excerpt FROM documents")
def excerpt_500(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


# items

def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant's next turn as the answer, or an empty one; places and confidences cover what validation looks at."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    told = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    rows = asked.join(told, ["conv_id", "turn"], "left")
    source = F.struct(F.when(F.col("conv_id") % 11 == 3, " ").otherwise(F.concat(F.lit("talk/"), "conv_id", F.lit(".md"))).alias("path"), (F.col("turn") + F.when(F.col("conv_id") % 13 == 5, -1000).otherwise(1)).alias("start_line"), (F.col("turn") + 1).alias("end_line"))
    source = F.struct(source["path"].alias("path"), F.greatest(F.lit(0), source["start_line"]).cast("long").alias("start_line"), source["end_line"].cast("long").alias("end_line"))
    confidence = F.when(F.col("conv_id") % 17 == 1, F.lit(float("nan"))).when(F.col("conv_id") % 17 == 2, F.lit(1.5)).when(F.col("conv_id") % 17 == 3, F.lit(None)).otherwise(F.lit(0.5)).cast("float")
    return rows.select("conv_id", "turn", "question", F.coalesce("answer", F.lit("")).alias("answer"), source.alias("source"), F.concat(F.lit("c"), "conv_id").alias("chunk_id"), confidence.alias("confidence"))


_TURNS_SQL = """
SELECT u.conv_id, u.turn, u.text AS question, coalesce(a.text, '') AS answer, CASE WHEN u.conv_id % 11 = 3 THEN ' ' ELSE 'talk/' || u.conv_id || '.md' END AS path,
       greatest(0, u.turn + CASE WHEN u.conv_id % 13 = 5 THEN -1000 ELSE 1 END) AS start_line, u.turn + 1 AS end_line, 'c' || u.conv_id AS chunk_id,
       CASE WHEN u.conv_id % 17 = 1 THEN 'nan'::FLOAT WHEN u.conv_id % 17 = 2 THEN 1.5::FLOAT WHEN u.conv_id % 17 = 3 THEN NULL ELSE 0.5::FLOAT END AS confidence
FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'"""
_REASON_SQL = f"""
SELECT *, CASE WHEN trim(question, {WS_SQL}) = '' THEN 'empty_question' WHEN trim(answer, {WS_SQL}) = '' THEN 'empty_answer' WHEN trim(path, {WS_SQL}) = '' THEN 'empty_source_path'
  WHEN start_line = 0 OR end_line < start_line THEN 'invalid_source_range' WHEN confidence IS NOT NULL AND NOT coalesce(confidence BETWEEN 0 AND 1, FALSE) THEN 'invalid_confidence' END AS reject_reason FROM ({_TURNS_SQL})"""


@query(f"SELECT conv_id, turn, reject_reason FROM ({_REASON_SQL})")
def qa_validate_reasons(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", qa.reject_reason().alias("reject_reason"))


@query(f"SELECT conv_id, turn, {NORM_SQL.format('question')} AS question_key, sha256(chunk_id || chr(0) || {NORM_SQL.format('question')}) AS id FROM ({_TURNS_SQL})")
def qa_ids(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", T.normalize_question(F.col("question")).alias("question_key"), qa.qa_id(F.col("chunk_id"), F.col("question")).alias("id"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document as a question, in document and line order."""
    exploded = files(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "question"))
    return exploded.where(~T.is_blank(F.col("question")))


_LINES_SQL = f"SELECT doc_id, i - 1 AS line, list_extract(parts, i) AS question FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS u(i) WHERE trim(list_extract(parts, i), {WS_SQL}) <> ''"


@query(f"SELECT {NORM_SQL.format('question')} AS question_key, count(*)::BIGINT AS n FROM ({_LINES_SQL}) GROUP BY 1")
def qa_normalize(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy(T.normalize_question(F.col("question")).alias("question_key")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, line::INT AS line, question FROM (SELECT *, row_number() OVER (PARTITION BY {NORM_SQL.format('question')} ORDER BY doc_id, line) AS n FROM ({_LINES_SQL})) WHERE n = 1")
def qa_dedup_first(spark, sf_dir):
    return qa.first_per_question(_lines(spark, sf_dir), ["doc_id", "line"])


@query(f"SELECT count(*)::BIGINT AS valid, count(DISTINCT {NORM_SQL.format('question')})::BIGINT AS accepted, (count(*) - count(DISTINCT {NORM_SQL.format('question')}))::BIGINT AS duplicates FROM ({_LINES_SQL})")
def qa_duplicate_count(spark, sf_dir):
    keyed = _lines(spark, sf_dir).select(T.normalize_question(F.col("question")).alias("k"))
    return keyed.groupBy("k").agg(F.count("*").alias("n")).agg(F.sum("n").alias("valid"), F.count("*").alias("accepted"), (F.sum("n") - F.count("*")).alias("duplicates"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two items from each chunk, made without a model: its first characters as a question and the rest as the answer, and a question that all chunks of a file
    share with the whole chunk as the answer."""
    return _items_of(chunks(spark, sf_dir))


def _items_of(chunked: DataFrame) -> DataFrame:
    item = lambda q, a, tags, c: F.struct(q.alias("question"), a.alias("answer"), tags.alias("tags"), c.cast("float").alias("confidence"))
    head, rest = F.substring("text", 1, 30), F.substring(F.col("text"), F.lit(31), F.length("text"))
    items = F.array(item(F.concat(F.lit(" "), head, F.lit(" ?")), rest, F.array(F.lit(" a "), F.lit("  "), F.lit("b")), F.lit(0.5)), item(F.concat(F.lit("About "), "path", F.lit("?")), F.col("text"), F.array().cast("array<string>"), F.lit(None)))
    made = chunked.select("chunk_id", "path", "start_line", "end_line", F.lit("2024-01-01T00:00:00Z").alias("generated_at"), items.alias("items"))
    return qa.explode_batches(made, "stub")


_ITEMS_SELECT = f"""
SELECT path, start_line, end_line, chunk_id, k AS item_ord, trim(CASE k WHEN 0 THEN ' ' || substr(body, 1, 30) || ' ?' ELSE 'About ' || path || '?' END, {WS_SQL}) AS question,
       trim(CASE k WHEN 0 THEN substr(body, 31) ELSE body END, {WS_SQL}) AS answer, CASE k WHEN 0 THEN 2 ELSE 0 END AS n_tags, CASE k WHEN 0 THEN 0.5::FLOAT END AS confidence FROM ids, (VALUES (0), (1)) AS v(k)"""



@query(chunk_sql(4_000, f"SELECT sha256(chunk_id || chr(0) || {NORM_SQL.format('question')}) AS id, question, answer, path, start_line, end_line, item_ord, n_tags, confidence FROM ({_ITEMS_SELECT})"))
def qa_explode(spark, sf_dir):
    return _items(spark, sf_dir).select("id", "question", "answer", "source.path", "source.start_line", "source.end_line", "item_ord", F.size("tags").alias("n_tags"), "confidence")


_ACCEPTED_SQL = f"count(DISTINCT CASE WHEN answer <> '' AND question <> '' THEN {NORM_SQL.format('question')} END)"


@query(chunk_sql(4_000, f"""SELECT (SELECT count(*) FROM documents)::BIGINT AS discovered_files, (SELECT count(text) FROM documents)::BIGINT AS processed_files, (SELECT count(*) - count(text) FROM documents)::BIGINT AS skipped_files, (SELECT count(*) FROM ids)::BIGINT AS chunks,
  {_ACCEPTED_SQL}::BIGINT AS generated_items, count(*) FILTER (WHERE answer = '' OR question = '')::BIGINT AS rejected_items, (count(*) FILTER (WHERE answer <> '' AND question <> '') - {_ACCEPTED_SQL})::BIGINT AS duplicate_items FROM ({_ITEMS_SELECT})"""))
def build_stats(spark, sf_dir):
    seen = files(spark, sf_dir).agg(F.count("*").alias("n"), F.count("text").alias("read")).first()
    stats = qa.build_stats(_items(spark, sf_dir), chunks(spark, sf_dir).count(), seen["n"], seen["read"], seen["n"] - seen["read"])
    return spark.createDataFrame([stats], ", ".join(f"{name} long" for name in stats))


_JSON_SQL = """'{"instruction":' || to_json(question) || ',"input":"","output":' || to_json(answer) || ',"metadata":{"id":"' || sha256(chunk_id || chr(0) || """ + NORM_SQL.format("question") + """) || '","source":{"path":"' || path || '","start_line":' || start_line || ',"end_line":' || end_line
  || '},"chunk_id":"' || chunk_id || '","model":"stub","generated_at":"2024-01-01T00:00:00Z"' || CASE WHEN n_tags > 0 THEN ',"tags":["a","b"],"confidence":0.5' ELSE '' END || '}}'"""


@query(chunk_sql(4_000, f"SELECT sha256({_JSON_SQL}) AS line_sha256 FROM ({_ITEMS_SELECT})"))
def alpaca_export(spark, sf_dir):
    return qa.json_lines(qa.alpaca(_items(spark, sf_dir)), ["instruction", "input", "output", "metadata"]).select(F.sha2("value", 256).alias("line_sha256"))


@query(chunk_sql(4_000, f"SELECT sha256(chunk_id || chr(0) || {NORM_SQL.format('question')}) AS id, question, answer, path, n_tags, confidence FROM ({_ITEMS_SELECT})"))
def dataset_roundtrip(spark, sf_dir):
    from tessera import schemas

    lines = qa.json_lines(qa.alpaca(_items(spark, sf_dir)), ["instruction", "input", "output", "metadata"])
    read = qa.from_alpaca(lines.select(F.from_json("value", schemas.ALPACA).alias("r")).select("r.*"))
    return read.select("id", "question", "answer", "source.path", F.size("tags").alias("n_tags"), "confidence")


# caches

@query(chunk_sql(4_000, "SELECT count(*)::BIGINT AS chunks, count(DISTINCT chunk_id)::BIGINT AS keys, count(DISTINCT chunk_id) FILTER (WHERE ascii(chunk_id) < 56)::BIGINT AS hits, count(DISTINCT chunk_id) FILTER (WHERE ascii(chunk_id) >= 56)::BIGINT AS misses FROM ids"))
def cache_hits_misses(spark, sf_dir):
    keyed = chunks(spark, sf_dir).withColumn("key", generation_key(GenerationConfig(), prompts.QA_TEMPLATE))
    cached = keyed.where("ascii(chunk_id) < 56").select("key").distinct().withColumn("cached", F.lit(True))
    found = keyed.join(cached, "key", "left")
    return found.agg(F.count("*").alias("chunks"), F.countDistinct("key").alias("keys"), F.countDistinct(F.when(F.col("cached"), F.col("key"))).alias("hits"), F.countDistinct(F.when(F.col("cached").isNull(), F.col("key"))).alias("misses"))


class Echo:
    """A stand-in model: it answers each prompt with an item that holds it."""

    def complete(self, prompt: str, model: str, temperature: float, schema: dict) -> str:
        import hashlib
        import json

        return "Here it is:\n```json\n" + json.dumps({"items": [{"question": "q " + hashlib.sha256(prompt.encode()).hexdigest(), "answer": prompt, "tags": ["t"]}]}) + "\n```"


@query(chunk_sql(4_000, "SELECT chunk_id, ascii(chunk_id) < 56 AS cached, 'q ' || content_hash AS question, content_hash AS answer_hash, 1::BIGINT AS n_items FROM ids"))
def answers_cold_and_warm(spark, sf_dir):
    """Asks for some chunks, then for all: the first answers come out of the cache, the others from the model, all through strict parsing."""
    keyed = chunks(spark, sf_dir).withColumn("key", generation_key(GenerationConfig(), "{{chunk_text}}")).withColumn("prompt", prompts.qa_prompt("{{chunk_text}}", 1))
    keep, cold = Written(spark), Written(spark)
    folder = keep.folder("cache")
    keyed = numbered(keyed.select("chunk_id", "key", "prompt", "path", "chunk_ord"), [F.split("path", "/"), F.col("chunk_ord")], "ord", keep)
    call = Call(Echo, "echo", 0.0, completions.questions_schema(1), completions.parse_questions, 8, 0)
    ask(keyed.where("ascii(chunk_id) < 56"), call, folder, cold)
    cold.close()  # its answers are in the cache
    found = typed(ask(keyed, call, folder, keep).rows, "array<struct<question: string, answer: string, tags: array<string>, confidence: float>>")
    item = F.get("answer", F.lit(0))
    told = found.select("key", "cached", item["question"].alias("question"), F.sha2(item["answer"], 256).alias("answer_hash"), F.size("answer").cast("long").alias("n_items"))
    return keyed.select("chunk_id", "key").join(told, "key").drop("key")


@query(chunk_sql(4_000, "SELECT chunk_id, sha256('is ' || 'about ' || path || ' answered by ' || content_hash || ' in ' || path || ':' || start_line || '-' || end_line || ': ' || body || '?') AS prompt_hash FROM ids"))
def verification_prompts(spark, sf_dir):
    pairs = chunks(spark, sf_dir).withColumns({"question": F.concat(F.lit("about "), F.col("path")), "answer": F.col("content_hash")})
    prompt = prompts.verification_prompt("is {{question}} answered by {{answer}} in {{path}}:{{start_line}}-{{end_line}}: {{chunk_text}}?", "")
    return pairs.select("chunk_id", F.sha2(prompt, 256).alias("prompt_hash"))


class Judge:
    """A stand-in model for verification: whether an item is grounded hangs on the prompt's hash."""

    def complete(self, prompt: str, model: str, temperature: float, schema: dict) -> str:
        import hashlib
        import json

        check = lambda passed: {"passed": passed, "reason": "by its hash"}
        return json.dumps({"grounded": check(hashlib.sha256(prompt.encode()).hexdigest() < "8"), "self_contained": check(True), "answer_relevant": check(True), "evidence": None})


@query(chunk_sql(4_000, f"""SELECT sha256(chunk_id || chr(0) || {NORM_SQL.format('question')}) AS qa_id, item_ord, ascii(chunk_id) < 56 AS cached, CASE WHEN sha256(question || '|' || answer || '|' || body) < '8' THEN 'accepted' ELSE 'rejected' END AS verdict
  FROM (SELECT DISTINCT i.chunk_id, i.item_ord, i.question, i.answer, ids.body FROM ({_ITEMS_SELECT}) i JOIN ids ON i.chunk_id = ids.chunk_id)"""))
def verify_cold_and_warm(spark, sf_dir):
    """Judges some items, then all: the first decisions come out of the verification's cache, which is apart from that of a build, the others from the model."""
    keep, cold = Written(spark), Written(spark)
    own = unique_chunks(chunks(spark, sf_dir))  # so that items are unique too
    items = _items_of(own).join(own.select("chunk_id", F.col("text").alias("body")), "chunk_id")
    template = "{{question}}|{{answer}}|{{chunk_text}}"
    prompt = T.render_template(template, {"question": F.col("question"), "answer": F.col("answer"), "chunk_text": F.col("body")})
    keyed = numbered(items.select("id", "item_ord", "chunk_id", verification_key(VerifierConfig(), template).alias("key"), prompt.alias("prompt")), [F.col("id"), F.col("item_ord")], "ord", keep)
    call, folder = Call(Judge, "judge", 0.0, completions.decision_schema(), completions.parse_decision, 8, 0, "item"), cache_directory(keep.folder("repository"), "cache", verify=True)
    ask(keyed.where("ascii(chunk_id) < 56"), call, folder, cold)
    cold.close()  # its decisions are in the cache
    check = "struct<passed: boolean>"
    found = typed(ask(keyed, call, folder, keep).rows, f"struct<checks: struct<grounded: {check}, self_contained: {check}, answer_relevant: {check}>>")
    told = found.select("key", "cached", judging.verdict(F.col("answer.checks")).alias("verdict"))
    return keyed.select(F.col("id").alias("qa_id"), "item_ord", "key").join(told, "key").drop("key")


@query(chunk_sql(4_000, """SELECT chunk_id, sha256('{"chunk_id":"' || chunk_id || '","prompt_hash":"' || sha256('t {{chunk_text}}') || '","provider":"ollama","model":"llama3.2","endpoint":null,"questions_per_chunk":3,"temperature":0.2}') AS key FROM ids"""))
def cache_key(spark, sf_dir):
    return chunks(spark, sf_dir).select("chunk_id", generation_key(GenerationConfig(), "t {{chunk_text}}").alias("key"))


@query("SELECT conv_id, turn, (500 * pow(2, greatest(0, least(turn - 1, 6))))::BIGINT AS delay_ms FROM conversations")
def retry_schedule(spark, sf_dir):
    """The delay before each turn of a conversation, were it a retry of that number."""
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", T.retry_delay_ms(F.col("turn")).alias("delay_ms"))


# verification

def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the documents, and chunks of documents of which some have changed or moved since."""
    items = _items(spark, sf_dir).withColumn("source", F.struct(F.col("source.path"), F.col("source.start_line"), (F.col("source.end_line") + F.when((F.length("source.path") + F.col("item_ord")) % 5 == 0, 1).otherwise(0)).alias("end_line")))
    docs = files(spark, sf_dir)
    now = docs.where("doc_id % 7 <> 0").select("path", F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("new\n"), "text")).otherwise(F.col("text")).alias("text"))
    return judging.reconstruct(items, chunk_documents(now))


_CHANGED_SQL = f"SELECT {PATH_SQL} AS path, text, doc_id FROM documents"
_CHANGED_SELECT = f"""SELECT chunk_id, path, k AS item_ord, (length(path) + k) % 5 = 0 AS moved, regexp_extract(path, '([0-9]+)\\.md$', 1)::BIGINT AS doc_id FROM ids, (VALUES (0), (1)) AS v(k)"""
_REASONED = f"SELECT *, CASE WHEN doc_id % 7 = 0 OR doc_id % 10 = 3 THEN '{judging.NO_CHUNK}' WHEN moved THEN '{judging.OTHER_PLACE}' END AS reason FROM ({_CHANGED_SELECT})"


@query(chunk_sql(4_000, f"SELECT chunk_id, path, item_ord, reason IS NULL OR reason <> '{judging.NO_CHUNK}' AS reconstructed FROM ({_REASONED})"))
def verify_reconstruct(spark, sf_dir):
    return _changed(spark, sf_dir).select("chunk_id", "source.path", "item_ord", F.col("chunk").isNotNull().alias("reconstructed"))


@query(chunk_sql(4_000, f"SELECT reason, count(*)::BIGINT AS n FROM ({_REASONED}) GROUP BY reason"))
def verify_provenance(spark, sf_dir):
    return _changed(spark, sf_dir).groupBy(F.col("unverifiable_reason").alias("reason")).agg(F.count("*").alias("n"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item for each document, judged by its label; documents without one cannot be verified."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    check = lambda passed: F.struct(passed.alias("passed"), F.lit("label").alias("reason"))
    checks = F.struct(check(F.col("quality") == 1).alias("grounded"), check(F.lit(True)).alias("self_contained"), check(F.col("toxic") == 0).alias("answer_relevant"))
    decision = F.when(F.col("quality").isNotNull(), F.struct(checks.alias("checks"), F.when(F.col("quality") == 1, F.lit("seen")).alias("evidence"), F.lit("2024-01-01T00:00:00Z").alias("verified_at")))
    rows = files(spark, sf_dir).join(labels, "doc_id", "left")
    return rows.select(
        F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("Q"), "doc_id").alias("question"), F.lit("A").alias("answer"), F.struct("path", F.lit(1).cast("long").alias("start_line"), F.lit(1).cast("long").alias("end_line")).alias("source"),
        decision.alias("decision"), F.when(F.col("quality").isNull(), judging.NO_CHUNK).alias("unverifiable_reason"),
    )


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.records(_judged(spark, sf_dir), "ollama", "stub")


_VERDICT_SQL = "CASE WHEN l.quality IS NULL THEN 'unverifiable' WHEN l.quality = 1 AND l.toxic = 0 THEN 'accepted' ELSE 'rejected' END"
_LABELLED = "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


@query(f"SELECT d.doc_id::VARCHAR AS qa_id, {_VERDICT_SQL} AS verdict {_LABELLED}")
def verify_verdict(spark, sf_dir):
    return _records(spark, sf_dir).select("qa_id", "verdict")


_CHECK = "'{{\"passed\":' || {} || ',\"reason\":\"label\"}}'"


@query(f"""SELECT d.doc_id::VARCHAR AS qa_id, sha256('{{"qa_id":"' || d.doc_id || '","question":"Q' || d.doc_id || '","answer":"A","source":{{"path":"' || d.source || '/' || d.doc_id || '.md","start_line":1,"end_line":1}},"verdict":"' || {_VERDICT_SQL} || '",' ||
  CASE WHEN l.quality IS NULL THEN '"reason":"{judging.NO_CHUNK}"' ELSE '"checks":{{"grounded":' || {_CHECK.format("(l.quality = 1)")} || ',"self_contained":' || {_CHECK.format("TRUE")} || ',"answer_relevant":' || {_CHECK.format("(l.toxic = 0)")} || '}},'
  || CASE WHEN l.quality = 1 THEN '"evidence":"seen",' ELSE '' END || '"verifier":{{"provider":"ollama","model":"stub","verified_at":"2024-01-01T00:00:00Z"}}' END || '}}') AS line_sha256 {_LABELLED}""")
def verification_report(spark, sf_dir):
    return qa.json_lines(_records(spark, sf_dir), judging.RECORD_COLUMNS, "qa_id").select("qa_id", F.sha2("value", 256).alias("line_sha256"))


_STATS_SQL = f"SELECT count(*)::BIGINT AS total_items, count(*) FILTER (WHERE v = 'accepted')::BIGINT AS accepted_items, count(*) FILTER (WHERE v = 'rejected')::BIGINT AS rejected_items, count(*) FILTER (WHERE v = 'unverifiable')::BIGINT AS unverifiable_items FROM (SELECT {_VERDICT_SQL} AS v {_LABELLED})"


@query(_STATS_SQL)
def verification_stats(spark, sf_dir):
    return judging.stats(_records(spark, sf_dir))


@query(f"SELECT FALSE AS never_fails, rejected_items > 0 AS rejected_fails, rejected_items + unverifiable_items > 0 AS any_fails FROM ({_STATS_SQL})")
def quality_gate(spark, sf_dir):
    return judging.stats(_records(spark, sf_dir)).select(*[judging.gate_fails(g).alias(f"{g}_fails") for g in ("never", "rejected", "any")])


@query(chunk_sql(400, "SELECT count(*)::BIGINT AS items, (SELECT count(*) FROM ids)::BIGINT AS chunks FROM ids JOIN (SELECT DISTINCT chunk_id AS c FROM ids) ON c = chunk_id"))
def verify_no_fanout(spark, sf_dir):
    """A join of items with chunks gives one row per item, though ids repeat."""
    own = chunks(spark, sf_dir, 400)
    joined = own.select("chunk_id").join(unique_chunks(own).select("chunk_id"), "chunk_id").agg(F.count("*").alias("items"))
    return joined.withColumn("chunks", own.agg(F.count("*").alias("chunks")).scalar())


# whole dataflows over files

def _tree(spark: SparkSession, root: str, rows: DataFrame) -> str:
    """Writes rows (path, content) as files below root, each by the task that holds it; root must be a folder that all machines mount."""

    def write(batches):
        import os

        import pandas as pd

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                full = os.path.join(root, path)
                os.makedirs(os.path.dirname(full), exist_ok=True)
                with open(full, "wb") as f:
                    f.write(content)
            yield pd.DataFrame({"n": [len(batch)]})

    rows.select("path", "content").mapInPandas(write, "n long").agg(F.sum("n")).first()
    return root


def _mixed_tree(spark: SparkSession, sf_dir: str, root: str) -> str:
    """Documents as Markdown and other files, some with CR LF, some that are not UTF-8, with ignore rules."""
    docs = files(spark, sf_dir).where("text IS NOT NULL")
    k = F.col("doc_id") % 10
    path = F.when(k == 9, F.replace("path", F.lit(".md"), F.lit(".txt"))).when(k == 2, F.replace("path", F.lit(".md"), F.lit(".MD"))).otherwise(F.col("path"))
    text = F.when(k == 1, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text"))
    content = F.when(k == 4, F.concat(F.unhex(F.lit("FF")), F.encode(text, "UTF-8"))).otherwise(F.encode(text, "UTF-8"))
    rules = spark.createDataFrame([(".gitignore", b"*7.md\n!*77.md\nsrc3/\n"), ("src5/.gitignore", b"*0.md\n"), (".git/info/exclude", b"src7/**\n"), (".git/x.md", b"x"), ("own-rules", b"src1/**6.md\n"), ("ask.md", b"a prompt, which is no document")], "path string, content binary")
    return _tree(spark, root, docs.select(path.alias("path"), content.alias("content")).unionByName(rules))


SCAN_LIMITS = DiscoveryConfig(max_files=400, max_bytes_per_file=4_000)
_SCAN_SQL = f"""
SELECT path, n - 1 AS file_ord, reason, CASE WHEN reason = 'too_large' THEN bytes END AS bytes, CASE WHEN reason IS NULL THEN sha256(text) END AS text_sha256 FROM (
  SELECT *, CASE WHEN n > {SCAN_LIMITS.max_files} THEN 'file_limit' WHEN bytes > {SCAN_LIMITS.max_bytes_per_file} THEN 'too_large' WHEN doc_id % 10 = 4 THEN 'invalid_utf8' END AS reason FROM (
    SELECT doc_id, text, source || '/' || name AS path, row_number() OVER (ORDER BY source, name) AS n,
           (strlen(text) + CASE doc_id % 10 WHEN 4 THEN 1 WHEN 1 THEN length(text) - length(replace(text, chr(10), '')) ELSE 0 END)::BIGINT AS bytes
    FROM (SELECT *, doc_id || CASE doc_id % 10 WHEN 2 THEN '.MD' ELSE '.md' END AS name FROM documents WHERE text IS NOT NULL AND doc_id % 10 <> 9)
    WHERE (doc_id % 10 <> 7 OR doc_id % 100 = 77) AND source NOT IN ('src3', 'src7') AND NOT (source = 'src5' AND doc_id % 10 = 0) AND NOT (source = 'src1' AND doc_id % 10 = 6)))"""


@query(_SCAN_SQL)
def scan_repository(spark, sf_dir):
    """The scan over files of every kind: extensions, ignore rules of all sorts, an excluded path, order, limits, encoding, line ends."""
    keep = Written(spark)
    root = _mixed_tree(spark, sf_dir, keep.folder("tree"))
    settings = DiscoveryConfig(SCAN_LIMITS.respect_gitignore, (f"{root}/own-rules",), SCAN_LIMITS.max_files, SCAN_LIMITS.max_bytes_per_file)
    found = keep(scan(spark, root, settings, (f"{root}/ask.md",), keep))
    shutil.rmtree(root)
    return found.select("path", "file_ord", "reason", "bytes", F.sha2("text", 256).alias("text_sha256"))


def _built(spark: SparkSession, sf_dir: str, keep: Written, folder: str) -> str:
    """A dataset of all documents below folder, built with Echo; the manifest lies beside it."""
    root = _tree(spark, f"{folder}/tree", files(spark, sf_dir).where("text IS NOT NULL").select("path", F.encode("text", "UTF-8").alias("content")))
    with open(f"{folder}/ask", "w", encoding="utf-8") as f:
        f.write("{{path}}:{{start_line}} {{chunk_text}}")
    settings = BuildConfig(root, prompt_file=f"{folder}/ask", export=ExportConfig(output=f"{folder}/dataset", parts=True), generation=GenerationConfig(model="echo", questions_per_chunk=1, concurrency=8), cache=CacheConfig(False))
    output = build_dataset(spark, settings, Echo).output
    shutil.rmtree(root)
    return output


_BUILT = "SELECT DISTINCT chunk_id, path, start_line, end_line, body, path || ':' || start_line || ' ' || body AS answer FROM ids"


@query(chunk_sql(4_000, f"SELECT sha256(chunk_id || chr(0) || 'q ' || sha256(answer)) AS id, 'q ' || sha256(answer) AS question, sha256(answer) AS answer_sha256, path, start_line, end_line, 1 AS n_tags FROM ({_BUILT})"))
def build_whole(spark, sf_dir):
    """A whole build over files, from scan to export, and the strict reader over what it wrote."""
    keep = Written(spark)
    folder = keep.folder("build")
    items = keep(read_dataset(spark, f"file://{_built(spark, sf_dir, keep, folder)}", keep))
    shutil.rmtree(folder)
    return items.select("id", "question", F.sha2("answer", 256).alias("answer_sha256"), "source.path", "source.start_line", "source.end_line", F.size("tags").alias("n_tags"))


_VERIFIED = f"""
SELECT sha256(chunk_id || chr(0) || question) AS qa_id, CASE WHEN gone THEN 'unverifiable' WHEN sha256(question || '|' || answer || '|' || body) < '8' THEN 'accepted' ELSE 'rejected' END AS verdict,
       CASE WHEN gone THEN '{judging.NO_CHUNK}' END AS reason
FROM (SELECT *, 'q ' || sha256(answer) AS question, doc_id % 7 = 0 OR doc_id % 10 = 3 AS gone FROM (SELECT *, regexp_extract(path, '([0-9]+)\\.md$', 1)::BIGINT AS doc_id FROM ({_BUILT})))"""


@query(chunk_sql(4_000, _VERIFIED))
def verify_whole(spark, sf_dir):
    """A whole verification of such a dataset, after some files have gone and some have changed."""
    keep = Written(spark)
    folder = keep.folder("verify")
    dataset = _built(spark, sf_dir, keep, folder)
    now = files(spark, sf_dir).where("text IS NOT NULL AND doc_id % 7 <> 0").select("path", F.encode(F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("new\n"), "text")).otherwise(F.col("text")), "UTF-8").alias("content"))
    root = _tree(spark, f"{folder}/now", now)
    with open(f"{folder}/judge", "w", encoding="utf-8") as f:
        f.write("{{question}}|{{answer}}|{{chunk_text}}")
    settings = VerificationConfig(f"file://{dataset}", f"{folder}/manifest.json", root, f"{folder}/report", f"{folder}/judge", VerifierConfig(model="judge", concurrency=8), CacheConfig(False), parts=True)
    output = verify_dataset(spark, settings, Judge).output
    found = keep(spark.read.schema("qa_id string, verdict string, reason string").json(f"file://{output}"))
    shutil.rmtree(folder)
    return found


# strict parsing

def _parsed(docs: DataFrame, parse: Callable[[str], object]) -> DataFrame:
    """docs (doc_id, completion) parsed in tasks: outcome, and the parsed value as JSON where it is ok."""

    def run(batches):
        import json

        import pandas as pd

        from tessera.errors import InvalidJson, UnexpectedSchema

        for batch in batches:
            rows = []
            for doc_id, completion in zip(batch["doc_id"], batch["completion"]):
                try:
                    rows.append((doc_id, "ok", json.dumps(parse(completion), ensure_ascii=False)))
                except InvalidJson:
                    rows.append((doc_id, "invalid_json", None))
                except UnexpectedSchema:
                    rows.append((doc_id, "unexpected_schema", None))
            yield pd.DataFrame(rows, columns=["doc_id", "outcome", "value"])

    return docs.mapInPandas(run, "doc_id long, outcome string, value string")


_QUESTIONS_SQL = """SELECT doc_id, CASE WHEN doc_id % 8 < 4 THEN 'ok' WHEN doc_id % 8 < 6 THEN 'invalid_json' ELSE 'unexpected_schema' END AS outcome,
  CASE WHEN doc_id % 8 < 4 THEN sha256(substr(text, 1, 40) || chr(0) || substr(text, 41)) END AS items_sha256 FROM documents"""


def _question_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions of all shapes: items, questions in a fence, a bare list, white space around; cut short, NaN; a number for text, an object for a list."""
    pair = F.to_json(F.struct(F.substring("text", 1, 40).alias("question"), F.substring(F.col("text"), F.lit(41), F.length("text")).alias("answer")))
    wrap = lambda before, after: F.concat(F.lit(before), pair, F.lit(after))
    shapes = [wrap('{"items":[', "]}"), wrap('Here:\n```json\n{"questions":[', "]}\n```\nDone."), wrap("[", "]"), wrap(' \n{"n":1,"items":[', "]}\n"), wrap('{"items":[', "]"), wrap('{"items":[{"confidence":NaN},', "]}"), wrap('[{"question":1,"answer":"a"},', "]"), wrap('{"items":', "}")]
    k, completion = F.col("doc_id") % len(shapes), F.lit(None).cast("string")
    for i, shape in enumerate(shapes):
        completion = F.when(k == i, shape).otherwise(completion)
    return files(spark, sf_dir).select("doc_id", completion.alias("completion"))


@query(_QUESTIONS_SQL)
def strict_questions(spark, sf_dir):
    found = _parsed(_question_completions(spark, sf_dir), completions.parse_questions)
    item = F.from_json("value", "array<struct<question: string, answer: string>>")[0]
    return found.select("doc_id", "outcome", F.sha2(F.concat(item["question"], F.lit("\0"), item["answer"]), 256).alias("items_sha256"))


@query(_QUESTIONS_SQL)
def strict_questions_jvm(spark, sf_dir):
    """The same without Python workers."""
    found = _question_completions(spark, sf_dir).select("doc_id", variants.questions(F.col("completion")).alias("r"))
    item = F.get("r.value", F.lit(0))
    return found.select("doc_id", "r.outcome", F.sha2(F.concat(item["question"], F.lit("\0"), item["answer"]), 256).alias("items_sha256"))


_DECISIONS_SQL = """SELECT doc_id, CASE WHEN doc_id % 6 < 2 THEN 'ok' WHEN doc_id % 6 = 2 THEN 'invalid_json' ELSE 'unexpected_schema' END AS outcome,
  CASE WHEN doc_id % 6 < 2 THEN sha256('r ' || text || chr(0) || CASE doc_id % 6 WHEN 1 THEN 'e ' || text ELSE '' END) END AS decision_sha256 FROM documents"""


def _decision_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions: evidence null, evidence given; no JSON; passed as text, a blank reason, blank evidence."""
    k = F.col("doc_id") % 6
    quoted = lambda prefix: F.expr(f"substring(to_json(array(concat('{prefix} ', text))), 2, length(to_json(array(concat('{prefix} ', text)))) - 2)")
    check = lambda passed, reason: F.concat(F.lit('{"passed":'), passed, F.lit(',"reason":'), reason, F.lit("}"))
    first = check(F.when(k == 3, '"true"').otherwise("true"), quoted("r"))
    second = check(F.lit("false"), F.when(k == 4, '" \\n"').otherwise('"so"'))
    evidence = F.when(k == 1, quoted("e")).when(k == 5, '" "').otherwise("null")
    completion = F.concat(F.lit('{"grounded":'), first, F.lit(',"self_contained":'), second, F.lit(',"answer_relevant":'), second, F.lit(',"evidence":'), evidence, F.when(k == 2, "").otherwise("}"))
    return files(spark, sf_dir).select("doc_id", completion.alias("completion"))


def _decision_digest(decision: Column) -> Column:
    return F.sha2(F.when(decision.isNotNull(), F.concat(decision["checks"]["grounded"]["reason"], F.lit("\0"), F.coalesce(decision["evidence"], F.lit("")))), 256).alias("decision_sha256")


@query(_DECISIONS_SQL)
def strict_decisions(spark, sf_dir):
    found = _parsed(_decision_completions(spark, sf_dir), completions.parse_decision)
    return found.select("doc_id", "outcome", _decision_digest(F.from_json("value", "struct<checks: struct<grounded: struct<reason: string>>, evidence: string>")))


@query(_DECISIONS_SQL)
def strict_decisions_jvm(spark, sf_dir):
    """The same without Python workers."""
    return _decision_completions(spark, sf_dir).select("doc_id", variants.decision(F.col("completion")).alias("r")).select("doc_id", "r.outcome", _decision_digest(F.col("r.value")))


@query(chunk_sql(4_000, f"""SELECT row_number() OVER (ORDER BY chunk_id, item_ord) - 1 AS item_ord, sha256(chunk_id || chr(0) || {NORM_SQL.format('question')}) AS id, sha256(question) AS question_sha256, sha256(answer) AS answer_sha256, path, n_tags, confidence
  FROM ({_ITEMS_SELECT})"""))
def dataset_strict_read(spark, sf_dir):
    """A dataset written as a folder of parts in order, and read strictly: numbers of lines across files."""
    keep = Written(spark)
    lines = qa.json_lines(qa.alpaca(_items(spark, sf_dir), "chunk_id", "item_ord"), ["instruction", "input", "output", "metadata"], "chunk_id", "item_ord")
    folder = keep.folder("lines")
    write_lines(lines, [F.col("chunk_id"), F.col("item_ord")], folder, parts=True)
    return read_dataset(spark, f"file://{folder}", keep).select("item_ord", "id", F.sha2("question", 256).alias("question_sha256"), F.sha2("answer", 256).alias("answer_sha256"), "source.path", F.size("tags").alias("n_tags"), "confidence")


@query(chunk_sql(4_000, """SELECT n AS line, CASE WHEN n % 7 = 0 THEN 'blank line' WHEN n % 11 = 0 THEN 'metadata with its source is missing' ELSE 'malformed JSON' END AS error
  FROM (SELECT row_number() OVER (ORDER BY chunk_id, path, start_line) AS n FROM ids) WHERE n % 7 = 0 OR n % 11 = 0 OR n % 13 = 0"""))
def dataset_bad_lines(spark, sf_dir):
    """Every line of a damaged dataset that the strict reader cannot take, with its number and what is wrong."""
    keep = Written(spark)
    lines = numbered(chunks(spark, sf_dir).select("chunk_id", "path", "start_line", "text"), [F.col("chunk_id"), F.col("path"), F.col("start_line")], "n", keep).withColumn("n", F.col("n") + 1)
    meta = F.struct(F.col("chunk_id").alias("id"), F.struct("path", "start_line", F.col("start_line").alias("end_line")).alias("source"), "chunk_id", F.lit("stub").alias("model"), F.lit("t").alias("generated_at"))
    record = lambda meta: F.to_json(F.struct(F.col("text").alias("instruction"), F.lit("").alias("input"), F.col("text").alias("output"), meta.alias("metadata")))
    value = F.when(F.col("n") % 7 == 0, " \t").when(F.col("n") % 11 == 0, record(F.struct("chunk_id"))).when(F.col("n") % 13 == 0, F.concat(record(meta), F.lit("}"))).otherwise(record(meta))
    folder = keep.folder("lines")
    write_lines(lines.select(value.alias("value"), "n"), [F.col("n")], folder, parts=True)
    found = numbered_records(spark, f"file://{folder}", keep).where("error IS NOT NULL")
    return found.select("line", F.when(F.col("error").isin("blank line", "metadata with its source is missing"), F.col("error")).otherwise("malformed JSON").alias("error"))
