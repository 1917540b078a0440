"""The driver's queries over the test tables, each with its equivalent in DuckDB's SQL.

A document's source stands for a file and its id for a page. Invoices are made from orders; what SQL says of them
is taken from the orders, so that the two ways share nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import BILL_PROMPT, CATEGORIES, STOPWORDS
from ..functions import text as T
from ..functions.candidates import AMOUNT, BILL_WORDS, DOTTED_DATE, amount_candidates, date_candidates, day_first, looks_like_bill
from ..functions.once import once, spread
from ..operators import bills, chatlog, chunking, corpus, entities, retrieval, stitch, structure
from ..sources import files, models, pdf
from ..sources.invoices import invoices

AS_OF = "1998-10-03"
SHIFT = 1_000_000_000
WINDOW, STEP = 1000, 800

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("page"), F.lit(0).alias("chunk_index"), F.col("text").alias("page_content"))


def _invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invoices(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"))


def _bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bills.extract(_invoices(spark, sf_dir))


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, text) of documents and invoices."""
    documents = spread(table(spark, sf_dir, "documents")).select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("source"), "text")
    return documents.unionByName(_invoices(spark, sf_dir))


def _structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): documents, and a text of each customer with headings, lists and blank lines."""
    name = F.col("c_name")
    text = F.concat(
        F.upper(name), F.lit("\nSegment of "), name, F.lit(":\n- "), "c_mktsegment", F.lit("\n• balance "), F.col("c_acctbal").cast("decimal(18,2)").cast("string"), F.lit("\n \n1. Nation\n2) number "), F.col("c_nationkey").cast("string"),
        F.lit("\nIV. Part, two\nA. Appendix\n"), F.repeat(F.lit("7. long line "), F.pmod("c_custkey", F.lit(12)).cast("int")), F.lit("\n\n\n  plain text\nmore,plain,text\n* last "), "c_mktsegment",
    )
    return spread(table(spark, sf_dir, "documents")).select("doc_id", "text").unionByName(spread(table(spark, sf_dir, "customer")).select((F.col("c_custkey") + SHIFT).alias("doc_id"), text.alias("text")))


_WS = "'" + T.SPACES + "'"
_STRUCTURED = f"""texts AS (
  SELECT doc_id, text FROM documents UNION ALL
  SELECT c_custkey + {SHIFT}, upper(c_name) || chr(10) || 'Segment of ' || c_name || ':' || chr(10) || '- ' || c_mktsegment || chr(10) || '• balance ' || CAST(c_acctbal AS DECIMAL(18,2)) || chr(10) || ' ' || chr(10)
    || '1. Nation' || chr(10) || '2) number ' || c_nationkey || chr(10) || 'IV. Part, two' || chr(10) || 'A. Appendix' || chr(10) || repeat('7. long line ', (c_custkey % 12)::INT) || chr(10) || chr(10) || chr(10)
    || '  plain text' || chr(10) || 'more,plain,text' || chr(10) || '* last ' || c_mktsegment FROM customer
)"""
_BLOCKS = f"""{_STRUCTURED}, lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM texts WHERE trim(text, {_WS}) <> ''
), typed AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank'
    WHEN length(bare) < 100 AND ((upper(bare) = bare AND lower(bare) <> bare) OR suffix(bare, ':') OR regexp_matches(bare, '^(?:[IVXLC]+\\.|\\p{{Nd}}+\\.|[A-Z]\\.){T.SPACE}')) THEN 'heading'
    WHEN regexp_matches(bare, '^(?:[*\\-•+]|\\p{{Nd}}+[.)])') THEN 'list_item' ELSE 'paragraph' END AS kind
  FROM (SELECT *, trim(line, {_WS}) AS bare FROM lines)
), marked AS (
  SELECT *, CASE WHEN kind <> 'blank' AND lag(kind) OVER w IS DISTINCT FROM kind THEN 1 ELSE 0 END AS new FROM typed WINDOW w AS (PARTITION BY doc_id ORDER BY p)
), grouped AS (
  SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS block FROM marked WHERE kind <> 'blank'
), blocks AS (
  SELECT doc_id, CAST(block - 1 AS INT) AS block_no, min(kind) AS content_type, string_agg(line, chr(10) ORDER BY p) AS block_text FROM grouped GROUP BY doc_id, block
)"""
_MONTHS = "CASE o_orderkey % 4 WHEN 0 THEN strftime({0}, '%Y-%m-%d') WHEN 1 THEN strftime({0}, '%B %-d, %Y') WHEN 2 THEN strftime({0}, '%-d %B %Y') ELSE strftime({0}, '%m/%d/%Y') END"
_ORDERS = f"""o AS (
  SELECT 'invoices/' || o_orderkey || '.txt' AS source, o_orderkey, o_custkey, c_name, o_totalprice, CAST(o_orderdate AS DATE) AS issued, CAST(o_orderdate AS DATE) + 30 AS due,
         list_extract({CATEGORIES}, CAST(o_custkey % {len(CATEGORIES)} AS INT) + 1) AS category
  FROM orders JOIN customer ON o_custkey = c_custkey
), named AS (
  SELECT *, sha1(source)[1:12] AS id, {_MONTHS.format("issued")} AS issued_raw, {_MONTHS.format("due")} AS due_raw, '$' || format('{{:,.2f}}', o_totalprice) AS raw FROM o
)"""
_INVOICES = f"""{_ORDERS}, invoices AS (
  SELECT source, 'Invoice ' || o_orderkey || chr(10) || 'From: ' || c_name || chr(10) || 'Category: ' || category || chr(10) || 'Invoice date: ' || issued_raw || chr(10)
    || 'Payment due date: ' || due_raw || chr(10) || 'Amount due: ' || raw || chr(10) || 'Thank you.' || chr(10) AS text FROM named
), sources AS (SELECT 'doc/' || doc_id AS source, text FROM documents UNION ALL SELECT source, text FROM invoices)"""
_AMOUNTS = f"""{_INVOICES}, found AS (
  SELECT source, unnest(m) AS m, generate_subscripts(m, 1) AS i FROM (SELECT source, regexp_extract_all(text, '{AMOUNT}') AS m FROM sources)
), parts AS (
  SELECT source, i, trim(m, {_WS}) AS raw, regexp_extract(m, '{AMOUNT}', 5) AS n,
         regexp_extract(m, '{AMOUNT}', 3) || regexp_extract(m, '{AMOUNT}', 4) || regexp_extract(m, '{AMOUNT}', 6) || regexp_extract(m, '{AMOUNT}', 7) AS mark,
         regexp_extract(m, '{AMOUNT}', 1) || regexp_extract(m, '{AMOUNT}', 2) || regexp_extract(m, '{AMOUNT}', 8) AS minus FROM found
), plain AS (
  SELECT *, CASE WHEN contains(n, ',') AND contains(n, '.') THEN
      CASE WHEN regexp_matches(n, ',[0-9]*$') THEN replace(replace(n, '.', ''), ',', '.') ELSE replace(n, ',', '') END
    WHEN regexp_matches(n, '[,.][0-9]{{1,2}}$') THEN replace(n, ',', '.') ELSE replace(replace(n, ',', ''), '.', '') END AS digits FROM parts
  WHERE mark <> '' OR regexp_matches(n, '[,.][0-9]{{1,2}}$')
), valued AS (
  SELECT source, i, raw, CASE WHEN minus <> '' THEN -abs(TRY_CAST(digits AS DOUBLE)) ELSE TRY_CAST(digits AS DOUBLE) END AS value FROM plain WHERE TRY_CAST(digits AS DOUBLE) IS NOT NULL
), amounts AS (
  SELECT source, raw, min(i) AS i, any_value(value) AS value FROM valued GROUP BY source, raw QUALIFY row_number() OVER (PARTITION BY source ORDER BY min(i)) <= 20
)"""


@query("""
WITH t AS (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS round FROM documents WHERE text <> ''),
p AS (SELECT CAST(round AS INT) AS round, source, CASE WHEN round = 1 THEN '--- ' || source || ' ---' || chr(10) ELSE '' END || text || chr(10) AS piece FROM t),
s AS (SELECT *, coalesce(sum(length(piece)) OVER (ORDER BY round, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
SELECT round, source, piece FROM s WHERE before < 6000
""")
def corpus_sample(spark, sf_dir):
    return corpus.sample(_chunks(spark, sf_dir))


@query("""
SELECT source, string_agg(CAST(doc_id AS VARCHAR), ', ' ORDER BY doc_id) AS pages, count(*) AS chunk_count, source AS full_path, count(*) AS shown_pages FROM documents GROUP BY source ORDER BY source
""")
def doc_catalog(spark, sf_dir):
    rows = corpus.catalog(_chunks(spark, sf_dir))
    return rows.withColumn("shown_pages", corpus.page_count(F.col("pages"), F.col("chunk_count")).cast("bigint")).orderBy("source")


@query("SELECT DISTINCT source FROM documents WHERE source <> '' ORDER BY source")
def distinct_sources(spark, sf_dir):
    return corpus.sources(_chunks(spark, sf_dir)).orderBy("source")


@query(f"WITH {_BLOCKS} SELECT doc_id, block_no, content_type, block_text FROM blocks")
def content_blocks(spark, sf_dir):
    return structure.content_blocks(_structured(spark, sf_dir))


@query(f"""
WITH {_BLOCKS}, h AS (SELECT doc_id, block_text, block_no, row_number() OVER (PARTITION BY doc_id ORDER BY block_no DESC) AS back FROM blocks WHERE content_type = 'heading')
SELECT t.doc_id, coalesce((SELECT string_agg(DISTINCT content_type, ', ' ORDER BY content_type) FROM blocks b WHERE b.doc_id = t.doc_id), 'unknown') AS content_types,
       (SELECT string_agg(block_text, ' > ' ORDER BY block_no) FROM h WHERE h.doc_id = t.doc_id AND back <= 3) AS context_headings
FROM texts t
""")
def block_types(spark, sf_dir):
    rows = structure.with_blocks(_structured(spark, sf_dir))
    return rows.select("doc_id", structure.content_types(F.col("blocks")).alias("content_types"), structure.last_headings(F.col("blocks")).alias("context_headings"))


@query(f"""
WITH {_STRUCTURED}, l AS (SELECT doc_id, string_split(trim(text, {_WS}), chr(10)) AS lines FROM texts),
c AS (SELECT doc_id, len(lines) AS n, least(len(lines), 20) AS size, list_transform([',', chr(9), ';', '|'], lambda d: len(list_filter(list_slice(lines, 1, 20), lambda x: contains(x, d)))) AS counts FROM l),
b AS (SELECT doc_id, CASE WHEN n > 5 AND list_max(counts) >= greatest(1, size // 2) THEN list_extract([',', chr(9), ';', '|'], list_position(counts, list_max(counts))) END AS likely_delimiter FROM c)
SELECT doc_id, likely_delimiter, CASE WHEN likely_delimiter IS NOT NULL THEN 'tabular_text' END AS content_format FROM b
""")
def tabular_detect(spark, sf_dir):
    rows = _structured(spark, sf_dir).select("doc_id", structure.likely_delimiter(F.col("text")).alias("likely_delimiter"))
    return rows.withColumn("content_format", F.when(F.col("likely_delimiter").isNotNull(), "tabular_text"))


@query(f"""
WITH {_STRUCTURED}, p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n{T.SPACE}*\\n'), lambda x: trim(x, {_WS})), lambda x: x <> '') AS ps FROM texts)
SELECT doc_id, CAST(generate_subscripts(ps, 1) - 1 AS INT) AS pos, unnest(ps) AS paragraph FROM p
""")
def paragraph_split(spark, sf_dir):
    return _structured(spark, sf_dir).select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("pos", "paragraph"))


@query(f"WITH {_AMOUNTS} SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY i) - 1 AS INT) AS pos, raw, value FROM amounts")
def amount_scan(spark, sf_dir):
    rows = _both(spark, sf_dir).select("source", F.posexplode(amount_candidates(F.col("text"))).alias("pos", "c"))
    return rows.select("source", "pos", "c.raw", "c.value")


@query(f"""
WITH {_ORDERS} SELECT source, 0 AS pos, issued_raw AS raw, CAST(issued AS VARCHAR) AS iso FROM named UNION ALL SELECT source, 1, due_raw, CAST(due AS VARCHAR) FROM named
""")
def date_scan(spark, sf_dir):
    # The documents have no dates, only addresses that begin like one; all that is found is from invoices.
    rows = _both(spark, sf_dir).select("source", F.posexplode(date_candidates(F.col("text"))).alias("pos", "c"))
    return rows.select("source", "pos", "c.raw", "c.iso")


@query(f"""
WITH {_AMOUNTS}
SELECT source, regexp_matches(text, '[€£]') OR regexp_matches(text, '{DOTTED_DATE}') AS dayfirst,
       regexp_matches(text, '{BILL_WORDS}') AND EXISTS (SELECT 1 FROM amounts a WHERE a.source = s.source) AS bill_like FROM sources s
""")
def bill_pretest(spark, sf_dir):
    text = F.col("text")
    return _both(spark, sf_dir).select("source", day_first(text).alias("dayfirst"), looks_like_bill(text).alias("bill_like"))


_RECORDS = f"""{_ORDERS}, bills AS (
  SELECT id, source, true AS is_bill, c_name AS vendor, category, o_totalprice AS amount, raw AS amount_raw, true AS amount_confident, CAST(due AS VARCHAR) AS due_date, due_raw AS due_date_raw, true AS due_date_confident,
         CAST(issued AS VARCHAR) AS issue_date, issued_raw AS issue_date_raw, true AS issue_date_confident, o_orderkey FROM named
)"""


@query(f"WITH {_RECORDS} SELECT * EXCLUDE (o_orderkey) FROM bills")
def bill_records(spark, sf_dir):
    return _bills(spark, sf_dir)


@query(f"WITH {_RECORDS} SELECT category, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total FROM bills GROUP BY category")
def category_totals(spark, sf_dir):
    return bills.category_totals(_bills(spark, sf_dir))


@query(f"WITH {_RECORDS} SELECT id, due_date, amount, vendor FROM bills WHERE due_date BETWEEN '{AS_OF}' AND CAST(DATE '{AS_OF}' + 30 AS VARCHAR)")
def bills_upcoming(spark, sf_dir):
    return bills.upcoming(_bills(spark, sf_dir), AS_OF).select("id", "due_date", "amount", "vendor")


@query(f"WITH {_RECORDS} SELECT id, due_date, amount, vendor FROM bills WHERE due_date < '{AS_OF}'")
def bills_past_due(spark, sf_dir):
    return bills.past_due(_bills(spark, sf_dir), AS_OF).select("id", "due_date", "amount", "vendor")


@query(f"""
WITH {_RECORDS}, d AS (SELECT CASE WHEN due_date < '{AS_OF}' THEN 'past_due' WHEN due_date <= CAST(DATE '{AS_OF}' + 30 AS VARCHAR) THEN 'upcoming' END AS state, amount FROM bills)
SELECT state, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS bills FROM d WHERE state IS NOT NULL GROUP BY state
""")
def due_totals(spark, sf_dir):
    return bills.due_totals(_bills(spark, sf_dir), AS_OF)


@query(f"WITH {_RECORDS} SELECT id, vendor, category, amount, due_date FROM bills ORDER BY due_date, id")
def bills_by_due_date(spark, sf_dir):
    return bills.by_due_date(_bills(spark, sf_dir)).select("id", "vendor", "category", "amount", "due_date")


_CASE = "CAST(o_orderkey % 8 AS INT)"


@query(f"""
WITH {_RECORDS}
SELECT id, CASE {_CASE} WHEN 0 THEN 12.5 ELSE amount END AS amount, CASE {_CASE} WHEN 1 THEN 'Loan' ELSE category END AS category,
       CASE {_CASE} WHEN 2 THEN '2001-02-03' WHEN 3 THEN NULL ELSE due_date END AS due_date, {_CASE} <> 3 AS due_date_confident,
       CASE {_CASE} WHEN 5 THEN 'Unknown' WHEN 6 THEN 'New name' ELSE vendor END AS vendor, issue_date, amount_raw FROM bills
""")
def bill_patch(spark, sf_dir):
    # The fourth edit has a wrong category and the seventh a wrong date: neither changes anything.
    edits = ['{"amount": 12.5}', '{"category": "Loan"}', '{"due_date": "2001-02-03"}', '{"due_date": ""}', '{"vendor": "X", "category": "None"}', '{"vendor": "  "}', '{"vendor": " New name "}', '{"amount": 1, "issue_date": "2001-02-30"}']
    orders = table(spark, sf_dir, "orders")
    changes = F.get(F.array(*map(F.lit, edits)), F.pmod("o_orderkey", F.lit(8)).cast("int"))
    patches = orders.select(T.stable_id(F.concat(F.lit("invoices/"), F.col("o_orderkey").cast("string"), F.lit(".txt"))).alias("id"), changes.alias("changes"))
    return bills.patch(_bills(spark, sf_dir), patches).select("id", "amount", "category", "due_date", "due_date_confident", "vendor", "issue_date", "amount_raw")


def _some_ids(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return orders.select(T.stable_id(F.concat(F.lit("invoices/"), F.col("o_orderkey").cast("string"), F.lit(".txt"))).alias("id"))


@query(f"WITH {_RECORDS} SELECT id, vendor FROM bills WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def bill_delete(spark, sf_dir):
    return bills.delete(_bills(spark, sf_dir), _some_ids(spark, sf_dir)).select("id", "vendor")


@query(f"WITH {_RECORDS} SELECT id, vendor FROM bills WHERE o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def bill_by_id(spark, sf_dir):
    return bills.by_id(_bills(spark, sf_dir), _some_ids(spark, sf_dir)).select("id", "vendor")


_PROMPT = "'" + BILL_PROMPT.replace("'", "''") + "'"


@query(f"""
WITH {_INVOICES}, p AS (
  SELECT i.source, replace(replace(replace({_PROMPT}, '{{document_text}}', text[1:3000]), '{{amount_candidates}}', '- ' || raw), '{{date_candidates}}', '- ' || issued_raw || chr(10) || '- ' || due_raw) AS prompt,
         to_json({{'type': 'object', 'properties': {{'is_bill': {{'type': 'boolean'}}, 'vendor': {{'type': 'string'}}, 'category': {{'type': 'string', 'enum': {CATEGORIES}}}, 'total_due': {{'type': 'string', 'enum': [raw, '']}},
           'due_date': {{'type': 'string', 'enum': [issued_raw, due_raw, '']}}, 'issue_date': {{'type': 'string', 'enum': [issued_raw, due_raw, '']}}}}, 'required': ['is_bill', 'vendor', 'category', 'total_due', 'due_date', 'issue_date']}})::VARCHAR AS schema
  FROM invoices i JOIN named n ON i.source = n.source
)
SELECT source, prompt, schema FROM p
""")
def bill_prompts(spark, sf_dir):
    rows = bills.with_candidates(_invoices(spark, sf_dir))
    return rows.select("source", bills.prompt(F.col("text"), F.col("amounts"), F.col("dates")).alias("prompt"), bills.choice_schema(F.col("amounts"), F.col("dates")).alias("schema"))


_ENTITY_TEXT = "regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g')"
_ENTITY_PARTS = " UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS type, {n} AS n, unnest(m) AS m, generate_subscripts(m, 1) AS i FROM (SELECT doc_id, regexp_extract_all({_ENTITY_TEXT}, '{pattern}') AS m FROM documents)"
    for n, (kind, pattern) in enumerate(entities.PATTERNS.items())
)


@query(f"""
WITH found AS ({_ENTITY_PARTS}), orgs AS (SELECT doc_id, list(DISTINCT lower(trim(trim(m, {_WS}), '.,;:'))) AS o FROM found WHERE type = 'organization' GROUP BY doc_id),
kept AS (
  SELECT f.doc_id, type, n, i, trim(trim(m, {_WS}), '.,;:') AS entity FROM found f LEFT JOIN orgs ON f.doc_id = orgs.doc_id
  WHERE type <> 'person' OR (split_part(trim(m, {_WS}), ' ', 1) NOT IN {tuple(STOPWORDS)}
    AND len(list_filter(coalesce(o, []), lambda x: contains(x, lower(trim(m, {_WS}))) OR contains(lower(trim(m, {_WS})), x))) = 0)
), c AS (
  SELECT doc_id, type, count(*) AS mentions, min({{'n': n, 'i': i}}) AS place, arg_min(entity, {{'n': n, 'i': i}}) AS text FROM kept WHERE entity <> '' AND entity NOT IN {tuple(STOPWORDS)} GROUP BY doc_id, lower(entity), type
), r AS (SELECT doc_id, text, type, mentions, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY mentions DESC, place) AS INT) AS rank FROM c WHERE type <> 'person' OR mentions >= 2)
SELECT doc_id, rank, text, type, mentions FROM r WHERE rank <= 25
""")
def entity_heuristic(spark, sf_dir):
    return entities.heuristic(table(spark, sf_dir, "documents"))


_W = "coalesce(nullif(regexp_extract(text, '^[A-Za-z]+'), ''), 'x')"


@query(f"""
WITH c AS (SELECT conv_id, turn, {_W} AS w, CAST(turn % 5 AS INT) AS k FROM conversations),
e AS (
  SELECT conv_id, turn, CASE k WHEN 0 THEN [{{'t': w, 'y': 'person'}}, {{'t': 'Acme', 'y': 'other'}}] WHEN 1 THEN [{{'t': w, 'y': 'location'}}, {{'t': 'None', 'y': 'date'}}] WHEN 2 THEN [{{'t': w, 'y': 'other'}}] ELSE [] END AS e FROM c
)
SELECT conv_id, turn, CAST(generate_subscripts(e, 1) - 1 AS INT) AS pos, unnest(e).t AS text, unnest(e).y AS type FROM e
""")
def entity_json(spark, sf_dir):
    w = F.coalesce(F.nullif(F.regexp_extract("text", "^[A-Za-z]+", 0), F.lit("")), F.lit("x"))
    answers = [
        F.concat(F.lit('```json\n[{"text": "'), w, F.lit('", "type": "PERSON"}, {"text": "'), F.upper(w), F.lit('", "type": "date"}, {"text": " Acme ", "type": "company"}]\n```')),
        F.concat(F.lit('Here they are: [{"text": "'), w, F.lit('", "type": " location"}, 7, "x", {"type": "date"}, {"text": null, "type": "date"}] as asked.')),
        F.concat(F.lit('[{"text": "'), w, F.lit('"}]')), F.lit("[]"), F.lit("no list at all"),
    ]
    answer = F.get(F.array(*answers), F.pmod("turn", F.lit(5)).cast("int"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(entities.parsed(answer)).alias("pos", "e"))
    return rows.select("conv_id", "turn", "pos", "e.text", "e.type")


_SCORE = "round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)"


def _vector(spark, sf_dir) -> list[float]:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]


@query(f"SELECT a.vec_id, a.label, {_SCORE} AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0 ORDER BY score DESC, a.vec_id LIMIT 5")
def vector_topk(spark, sf_dir):
    return retrieval.top_k(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir)).select("vec_id", "label", F.round("score", 6).alias("score"))


_EACH = f"""
WITH s AS (SELECT b.vec_id AS query_id, a.vec_id, {_SCORE} AS score, row_number() OVER (PARTITION BY b.vec_id ORDER BY list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, a.vec_id) AS rank
  FROM embeddings a, embeddings b WHERE b.vec_id % 100 = 0)
SELECT query_id, vec_id, score, CAST(rank AS INT) AS rank FROM s WHERE rank <= 5
"""


def _each(spark, sf_dir, cells: int | None) -> DataFrame:
    chunks = table(spark, sf_dir, "embeddings")
    queries = chunks.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    return retrieval.top_k_each(chunks, queries, cells=cells).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(_EACH)
def vector_topk_each(spark, sf_dir):
    return _each(spark, sf_dir, 1)


@query(_EACH)
def vector_topk_pruned(spark, sf_dir):
    """The same rows by cells, of which those that can't hold one are left out."""
    return _each(spark, sf_dir, None)


@query(f"""
WITH top AS (SELECT a.vec_id, list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0 ORDER BY score DESC, a.vec_id LIMIT 5)
SELECT replace(replace('{retrieval.ANSWER_PROMPT.replace("'", "''")}', '{{context}}', (SELECT string_agg(text, chr(10) || chr(10) ORDER BY score DESC, vec_id) FROM top JOIN documents ON doc_id = vec_id)), '{{question}}', 'What is said?') AS prompt
""")
def rag_prompt(spark, sf_dir):
    top = retrieval.top_k(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir)).select(F.col("vec_id").alias("doc_id"), (-F.col("score")).alias("s"))
    # The passages are five rows by the search's limit.
    found = table(spark, sf_dir, "documents").join(F.broadcast(top), "doc_id").select(F.struct("s", "doc_id").alias("rank"), "text")
    return retrieval.answer_prompt(found, "What is said?")


def _windows(spark, sf_dir, source: str, page: str) -> DataFrame:
    """Documents cut into windows that overlap by 200 characters."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - (WINDOW - STEP) - 1, F.lit(0)), F.lit(STEP))
    rows = table(spark, sf_dir, "documents").select(F.expr(source).alias("source"), F.expr(page).alias("page"), "text", F.posexplode(starts).alias("chunk_index", "at"))
    return rows.select("source", "page", "chunk_index", F.expr(f"substr(text, at + 1, {WINDOW})").alias("page_content"))


_FOLD = f"""windows AS (
  SELECT doc_id, source, list_transform(range(0, greatest(length(text) - {WINDOW - STEP} - 1, 0) + 1, {STEP}), lambda a: text[a + 1:a + {WINDOW}]) AS w FROM documents WHERE text <> ''
), stitched AS (
  SELECT doc_id, source, list_reduce(w, lambda done, chunk: done || coalesce(
    nullif(chunk[coalesce(list_max(list_filter(range(1, least(length(done), length(chunk), 200) + 1), lambda k: done[-k:] = chunk[1:k])), 0) + 1:], CASE WHEN len(list_filter(range(1, least(length(done), length(chunk), 200) + 1), lambda k: done[-k:] = chunk[1:k])) = 0 THEN chunk ELSE '' END),
    CASE WHEN len(list_filter(range(1, least(length(done), length(chunk), 200) + 1), lambda k: done[-k:] = chunk[1:k])) = 0 THEN chr(10) || chr(10) || chunk ELSE '' END)) AS text FROM windows
)"""


@query(f"WITH {_FOLD} SELECT CAST(doc_id AS VARCHAR) AS source, text FROM stitched")
def stitch_overlap(spark, sf_dir):
    return stitch.reassemble(_windows(spark, sf_dir, "cast(doc_id as string)", "0"))


@query(f"WITH {_FOLD} SELECT source, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS text FROM stitched GROUP BY source")
def reassemble(spark, sf_dir):
    return stitch.reassemble(_windows(spark, sf_dir, "source", "doc_id"))


@query()
def recursive_chunks(spark, sf_dir):
    return chunking.recursive_chunks(_structured(spark, sf_dir))


@query()
def semantic_chunks(spark, sf_dir):
    import public_tokenizers

    from .providers import HashedEmbedder

    return chunking.semantic_chunks(_structured(spark, sf_dir), HashedEmbedder().embed, public_tokenizers.path("byte_bpe_50k.json"))


def _properties(chunks: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """(doc_id, chunks, in_text, in_order, small, whole): of each text that isn't blank whether it has chunks, whether all chunks are found in it, one
    after the other, of at most so many characters, and whether every word of the text is in a chunk."""
    squeezed = lambda c: F.regexp_replace(c, "[^0-9A-Za-z]+", " ")
    gathered = chunks.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "page_content"))), lambda c: c["page_content"]).alias("c"))
    rows = texts.where(F.col("text").rlike(f"[^{T.SPACES}]")).join(gathered, "doc_id", "left").withColumn("c", F.coalesce("c", F.array().cast("array<string>")))
    # Inside a line a text may repeat itself: each chunk is looked for from where the one before it begins.
    last = F.aggregate("c", F.lit(1), lambda at, x: F.call_function("locate", x, F.col("text"), at))
    rows = once(rows, at=F.transform("c", lambda x: F.call_function("locate", x, F.col("text"))), last=last, words=F.array_distinct(F.split(squeezed(F.col("text")), " ")))
    held = F.array_distinct(F.split(squeezed(F.array_join("c", "\n")), " "))
    return rows.select(
        "doc_id", (F.size("c") > 0).alias("chunks"), F.forall("at", lambda a: a > 0).alias("in_text"), (F.col("last") > 0).alias("in_order"),
        F.forall("c", lambda x: F.length(x) <= most).alias("small"), (F.size(F.array_except("words", held)) == 0).alias("whole"),
    )


def _plain(spark, sf_dir) -> DataFrame:
    """Texts whose lines are all different, so that a chunk's place in them is known."""
    numbered = F.array_join(F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(F.lit("line "), i.cast("string"), F.lit(" of "), F.col("doc_id").cast("string"), F.lit("\n"), x)), "\n\n")
    return spread(table(spark, sf_dir, "documents")).select("doc_id", numbered.alias("text"))


@query(f"SELECT doc_id, true AS chunks, true AS in_text, true AS in_order, true AS small, true AS whole FROM documents WHERE trim(text, {_WS}) <> ''")
def recursive_properties(spark, sf_dir):
    texts = _plain(spark, sf_dir)
    return _properties(chunking.recursive_chunks(texts), texts, 1000).join(table(spark, sf_dir, "documents").where(F.col("text").rlike(f"[^{T.SPACES}]")).select("doc_id"), "doc_id", "left_semi")


@query(f"SELECT doc_id, true AS chunks, true AS whole FROM documents WHERE trim(text, {_WS}) <> ''")
def semantic_properties(spark, sf_dir):
    import public_tokenizers

    from .providers import HashedEmbedder

    texts = spread(table(spark, sf_dir, "documents")).select("doc_id", "text")
    chunks = chunking.semantic_chunks(texts, HashedEmbedder().embed, public_tokenizers.path("byte_bpe_50k.json"))
    # A word may be cut between two chunks; joined by nothing, the chunks of a text of one paragraph are the text but for their overlap.
    return _properties(chunks, texts, 1 << 30).select("doc_id", "chunks", "whole")


#: Lines of a hundred characters: of a chunk of 1000 the first nine, of each further one the last line before and eight more.
_LINES = "CAST(1 + n_chars % 60 AS INT)"


@query(f"""
WITH d AS (SELECT doc_id, {_LINES} AS n FROM documents), c AS (SELECT doc_id, n, unnest(range(0, CASE WHEN n <= 9 THEN 1 ELSE 1 + CAST(ceil((n - 9) / 8) AS INT) END)) AS k FROM d),
l AS (SELECT doc_id, k, unnest(range(8 * k, least(8 * k + 9, n))) AS i FROM c)
SELECT doc_id, CAST(k AS INT) AS chunk_index, string_agg(rpad(doc_id || ' ' || i, 100, 'x'), chr(10) ORDER BY i) AS page_content FROM l GROUP BY doc_id, k
""")
def recursive_lines(spark, sf_dir):
    """Texts whose chunks follow from a sum: which lines are in which chunk, and what two chunks share."""
    line = lambda i: F.rpad(F.concat(F.col("doc_id").cast("string"), F.lit(" "), i.cast("string")), 100, "x")
    texts = spread(table(spark, sf_dir, "documents")).select("doc_id", F.array_join(F.transform(F.sequence(F.lit(0), F.expr(_LINES) - 1), line), "\n").alias("text"))
    return chunking.recursive_chunks(texts).select("doc_id", "chunk_index", "page_content")


#: A word that is one token, so many times; windows of 1000 tokens begin every 800.
_WORDS = "CAST(1 + n_chars % 5000 AS INT)"
_WINDOWS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS n FROM documents), c AS (SELECT doc_id, n, unnest(range(0, CASE WHEN n <= 1000 THEN 1 ELSE CAST(ceil((n - 200) / 800) AS INT) END)) AS k FROM d)
SELECT doc_id, CAST(k AS INT) AS chunk_index, CASE WHEN k = 0 THEN 'the' || repeat(' the', least(n, 1000) - 1) ELSE repeat(' the', least(n - 800 * k, 1000)) END AS page_content FROM c
"""


def _counted(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.concat(F.lit("the"), F.expr(f"repeat(' the', {_WORDS} - 1)")).alias("text"))


@query(_WINDOWS)
def token_windows(spark, sf_dir):
    import public_tokenizers

    return chunking.token_chunks(_counted(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "chunk_index", "page_content")


@query(_WINDOWS)
def semantic_windows(spark, sf_dir):
    """A text of one paragraph has one topic, which is cut by tokens."""
    import public_tokenizers

    from .providers import HashedEmbedder

    return chunking.semantic_chunks(_counted(spark, sf_dir), HashedEmbedder().embed, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "chunk_index", "page_content")


#: Amounts and dates of all kinds, by the order's key; what they mean is said apart, in the query's SQL.
_EDGES = ["$%s", "€%s", "($%s)", "-%s USD", "$99999999999999999999.50", "1.2.3", "GBP %s", "%s"]


_EDGE_ROWS = """o AS (SELECT o_orderkey, CAST(o_orderkey % 8 AS INT) AS k, CAST(o_totalprice AS DECIMAL(18,2)) AS p, CAST(o_orderdate AS DATE) AS d FROM orders),
v AS (SELECT *, CASE k WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 2 THEN -CAST(p AS DOUBLE) WHEN 3 THEN -CAST(p AS DOUBLE) ELSE CAST(p AS DOUBLE) END AS amount,
  -- Beside a euro sign the day comes first, in dates that begin with the year too.
  CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN day(d) <= 12 AND (k = 1) = (o_orderkey % 3 = 1) THEN strftime(d, '%Y-%d-%m') ELSE CAST(d AS VARCHAR) END AS due FROM o)"""


@query(f"WITH {_EDGE_ROWS} SELECT o_orderkey, amount, due FROM v")
def bill_edges(spark, sf_dir):
    """Amounts of both notations, negative, too long and unreadable ones; dates day first, month first, and none that can be read."""
    orders = spread(table(spark, sf_dir, "orders"))
    kind = F.pmod("o_orderkey", F.lit(8)).cast("int")
    plain = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    shown = F.when(kind == 1, F.translate(plain, ",.", ".,")).otherwise(plain)
    amount = F.replace(F.get(F.array(*map(F.lit, _EDGES)), kind), F.lit("%s"), shown)
    # 99/99/9999 is no date; 03/04/2025 is day first beside a euro sign.
    day = F.to_date("o_orderdate")
    date = F.get(F.array(F.lit("99/99/9999"), F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "dd/MM/yyyy")), F.pmod("o_orderkey", F.lit(3)).cast("int"))
    text = F.concat(F.lit("Invoice\ndate "), date, F.lit("\nsum "), amount, F.lit(" end"))
    rows = once(orders.select("o_orderkey", text.alias("text")), amounts=amount_candidates(F.col("text")), dates=date_candidates(F.col("text")))
    last = lambda c: F.try_element_at(F.col(c), F.lit(-1))
    # Of a number too long for its pattern only pieces are found.
    found = F.when(kind.isin(4, 5), None).otherwise(last("amounts")["value"])
    return rows.select("o_orderkey", found.alias("amount"), last("dates")["iso"].alias("due"))


@query(f"""
WITH {_EDGE_ROWS}, c AS (SELECT 'kind ' || k AS name, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(NULL AS BIGINT) AS bills FROM v WHERE amount IS NOT NULL GROUP BY k),
d AS (SELECT CASE WHEN due < '{AS_OF}' THEN 'past_due' WHEN due <= CAST(DATE '{AS_OF}' + 30 AS VARCHAR) THEN 'upcoming' END AS name, amount FROM v)
SELECT * FROM c UNION ALL SELECT name, CAST(sum(CAST(coalesce(amount, 0) AS DECIMAL(18,2))) AS DOUBLE), count(*) FROM d WHERE name IS NOT NULL GROUP BY name
""")
def edge_totals(spark, sf_dir):
    """Totals over bills without an amount, with negative ones, and without a date that can be read."""
    rows = bill_edges(spark, sf_dir).select(F.lit(True).alias("is_bill"), F.concat(F.lit("kind "), F.pmod("o_orderkey", F.lit(8)).cast("string")).alias("category"), "amount", F.col("due").alias("due_date"))
    totals = bills.category_totals(rows).select(F.col("category").alias("name"), "total", F.lit(None).cast("bigint").alias("bills"))
    return totals.unionByName(bills.due_totals(rows, AS_OF).select(F.col("state").alias("name"), "total", "bills"))


@query(f"""
WITH first AS (SELECT source, doc_id, text FROM documents ORDER BY source, doc_id, text LIMIT 200), t AS (SELECT string_agg(text, chr(10) ORDER BY source, doc_id) AS text FROM first)
SELECT text, regexp_matches(text, '{BILL_WORDS}') AS has_words FROM t
""")
def first_chunks(spark, sf_dir):
    return corpus.first_chunks(_chunks(spark, sf_dir)).select("text", F.col("text").rlike("(?U)" + BILL_WORDS).alias("has_words"))


@query(f"""
SELECT conv_id, 'Chat History' || chr(10) || repeat('=', 50) || chr(10) || chr(10) || string_agg(CASE WHEN role = 'user' THEN 'User: ' || text || chr(10)
  ELSE 'Assistant: ' || text || chr(10) || 'Citations:' || chr(10) || '  - ' || role || '.md' || CASE WHEN turn <> 0 THEN ' · p.' || turn ELSE '' END || ': "' || trim(text[1:20], {_WS}) || '"' || chr(10) || repeat('-', 50) || chr(10) || chr(10) END, '' ORDER BY turn, role) AS text
FROM conversations GROUP BY conv_id
""")
def chat_export(spark, sf_dir):
    cite = F.struct(F.concat(F.lit("docs\\"), "role", F.lit(".md")).alias("source"), F.col("turn").alias("page"), F.substring("text", 1, 20).alias("quote"))
    return chatlog.export(table(spark, sf_dir, "conversations").withColumn("cites", F.array(cite)))


_EXT = "list_extract(['.PDF', '.docx', '.md', '.txt', '.csv', ''], CAST(doc_id % 6 AS INT) + 1)"


@query(f"""
SELECT source || '_' || doc_id || {_EXT} AS name, CASE doc_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'doc' WHEN 2 THEN 'md' ELSE 'txt' END AS type FROM documents WHERE doc_id % 6 < 4 ORDER BY lower(name)
""")
def file_listing(spark, sf_dir):
    ending = F.get(F.array(*map(F.lit, [".PDF", ".docx", ".md", ".txt", ".csv", ""])), F.pmod("doc_id", F.lit(6)).cast("int"))
    return files.listing(table(spark, sf_dir, "documents").select(F.concat(F.lit("C:\\docs.d/"), "source", F.lit("_"), F.col("doc_id").cast("string"), ending).alias("path")))


@query("""
WITH o AS (SELECT *, CAST(o_totalprice AS DECIMAL(18,2)) - 150000 AS signed FROM orders)
SELECT o_orderkey, CASE WHEN signed < 0 THEN '-' ELSE '' END || '$' || CAST(abs(signed) AS VARCHAR) AS money, strftime(o_orderdate, '%b %-d, %Y') AS day, 'a' || o_orderkey || '.pdf' || CASE WHEN o_orderkey % 3 > 0 THEN ' · p.' || (o_orderkey % 3) ELSE '' END AS cite,
       greatest(least(CAST(signed AS DOUBLE) / 1000, 100), 0) AS percent, sha1('x/a' || o_orderkey || '.pdf')[1:12] AS id FROM o
""")
def display_values(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("path", F.concat(F.lit("x/a"), F.col("o_orderkey").cast("string"), F.lit(".pdf")))
    signed = (F.col("o_totalprice").cast("decimal(18,2)") - 150000).cast("decimal(18,2)")
    return orders.select(
        "o_orderkey", T.money(signed).alias("money"), T.short_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"), T.cite_label(F.col("path"), F.pmod("o_orderkey", F.lit(3))).alias("cite"),
        T.percent(signed.cast("double") / 1000).alias("percent"), T.stable_id(F.col("path")).alias("id"),
    )


@query("SELECT 'm' || (p_partkey // 2 * 2) || ':latest' AS name, max(CASE WHEN p_size % 2 = 0 THEN p_size || ' GB' ELSE '' END) FILTER (p_partkey = last) AS size FROM (SELECT *, max(p_partkey) OVER (PARTITION BY p_partkey // 2) AS last FROM part) GROUP BY p_partkey // 2 ORDER BY name")
def model_list(spark, sf_dir):
    even = (F.floor(F.col("p_partkey") / 2) * 2).cast("string")
    line = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("m"), even, F.lit(":latest  id"), F.col("p_partkey").cast("string"), F.lit("   "), F.col("p_size").cast("string"), F.lit(" GB   2 days ago"))).otherwise(F.concat(F.lit("m"), even, F.lit(":latest  id  -")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line")))), lambda x: x["line"])
    # A hundred lines a host: no row holds a table.
    hosts = table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 100).alias("host"))
    output = hosts.agg(F.concat(F.lit("NAME  ID  SIZE  MODIFIED\n"), F.array_join(lines, "\n"), F.lit("\nno colon here at all\n")).alias("output"))
    return models.model_list(output, by=("host",)).select("name", "size")


@query("""
WITH f AS (SELECT l_orderkey, l_linenumber, list_extract(['Tx', 'Btn', 'Ch', 'Sig', 'Zz'], l_linenumber % 5 + 1) AS kind, CAST(l_partkey % 4 AS INT) AS b, l_returnflag AS v FROM lineitem),
t AS (SELECT *, CASE kind WHEN 'Tx' THEN 'Text' WHEN 'Ch' THEN 'Choice' WHEN 'Sig' THEN 'Signature' WHEN 'Btn' THEN CASE WHEN b IN (1, 3) THEN 'Radio' WHEN b = 2 THEN 'Pushbutton' ELSE 'Checkbox' END ELSE kind END AS type,
  CASE v WHEN 'R' THEN 'True' WHEN 'A' THEN 'False' ELSE 'None' END AS value FROM f)
SELECT l_orderkey, 'Document Form Fields:' || chr(10) || string_agg('- Field ''f' || l_linenumber || ''' (Type: ' || type || ', Page: N/A): ''' || value || '''', chr(10) ORDER BY l_linenumber, type, value) AS summary,
       '--- Table 3.1 ---' || chr(10) || string_agg(v || chr(9) || 'a b' || chr(9), chr(10) ORDER BY l_linenumber, type, value) || chr(10) || '---' || chr(10) || chr(10) AS grid
FROM t GROUP BY l_orderkey
""")
def pdf_parts(spark, sf_dir):
    kind = F.get(F.array(*map(F.lit, ["Tx", "Btn", "Ch", "Sig", "Zz"])), F.col("l_linenumber") % 5)
    flags = (F.pmod("l_partkey", F.lit(4)) * 32768).cast("int")
    value = F.when(F.col("l_returnflag") == "R", "Yes").when(F.col("l_returnflag") == "A", "Off")
    field = F.struct("l_linenumber", pdf.field_type(kind, flags).alias("type"), pdf.field_value(value).alias("value"), "l_returnflag")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(field)).alias("f"))
    fields = F.transform("f", lambda x: F.struct(F.concat(F.lit("f"), x["l_linenumber"].cast("string")).alias("name"), x["type"].alias("type"), F.lit("N/A").alias("page"), x["value"].alias("value")))
    cells = F.transform("f", lambda x: F.array(x["l_returnflag"], F.lit(" a\nb "), F.lit(None).cast("string")))
    return rows.select("l_orderkey", pdf.form_summary(fields).alias("summary"), pdf.table_text(F.lit(3), F.lit(1), cells).alias("grid"))


@query(f"""
WITH v AS (SELECT label, abs(degrees(atan2(CAST(embedding[2] AS DOUBLE), CAST(embedding[1] AS DOUBLE)))) AS angle FROM embeddings),
c AS (SELECT label, count(*) FILTER (angle < 10 OR angle > 170) AS horizontal, count(*) FILTER (angle > 80 AND angle < 100) AS vertical FROM v GROUP BY label)
SELECT label, horizontal, vertical, CASE WHEN vertical > 1.5 * horizontal THEN 90 ELSE 0 END AS rotation, (SELECT count(*) FILTER (length(trim(text, {_WS})) < 20) FROM documents) AS ocr_pages FROM c
""")
def page_images(spark, sf_dir):
    across, up = pdf.line_votes(F.get("embedding", F.lit(0)), F.get("embedding", F.lit(1)))
    votes = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count_if(across).alias("horizontal"), F.count_if(up).alias("vertical"))
    pages = table(spark, sf_dir, "documents").agg(F.count_if(pdf.needs_ocr(F.col("text"))).alias("n")).first()["n"]
    return votes.withColumn("rotation", pdf.rotation(F.col("horizontal"), F.col("vertical"))).withColumn("ocr_pages", F.lit(pages).cast("bigint"))


@query("""
WITH n AS (SELECT s_suppkey AS mark, c_custkey AS label, abs(s_acctbal - c_acctbal) AS gap, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(s_acctbal - c_acctbal), c_custkey) AS r
  FROM supplier JOIN customer ON s_nationkey = c_nationkey AND abs(s_acctbal - c_acctbal) <= 300)
SELECT mark, label, round(gap, 4) AS gap FROM n WHERE r = 1
""")
def nearest_label(spark, sf_dir):
    marks = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("page"), F.col("s_suppkey").alias("mark"), F.col("s_acctbal").alias("x"))
    labels = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("page"), F.col("c_custkey").alias("label"), F.col("c_acctbal").alias("x"))
    return pdf.nearest_labels(marks, labels, 300.0).select("mark", "label", F.round("gap", 4).alias("gap"))


@query("SELECT event_id, 'k=' || json_extract_string(props, '$.k') AS entries, CASE WHEN event_id % 3 = 0 THEN event_id // 3 ELSE 0 END AS page FROM events")
def metadata_clean(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    entries = F.transform(F.array_sort(F.map_entries(T.clean_metadata(F.col("props")))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    page = F.get(F.array(F.floor(F.col("event_id") / 3).cast("string"), F.lit("iv"), F.lit(None).cast("string")), F.pmod("event_id", F.lit(3)).cast("int"))
    return events.select("event_id", F.array_join(entries, ",").alias("entries"), T.page_number(page).cast("bigint").alias("page"))


@query("SELECT source, CAST(sum(n) AS BIGINT) AS n FROM (SELECT source, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY source UNION ALL SELECT source, count(*) FROM documents WHERE lang <> 'en' GROUP BY source) GROUP BY source")
def chunk_union(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    parts = [documents.where("lang = 'en'").select("source", "text"), documents.where("lang <> 'en'").select("source", "lang")]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).groupBy("source").agg(F.count("*").alias("n"))
