"""Text search, JSON decode and row nesting on the free-text tables
(F4 / E20 on ``documents``, S4 on ``events.props``, J11 on ``conversations``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.functions.text import inverted_index, lexemes, matches, search_index
from tillage.operators.joins import child_array
from tillage.operators.search import Postings, TrigramIndex, is_stored, stemmed_lexemes, stored_folder
from tillage.plans.catalog import sql_lexemes
from tillage.plans.common import Registered
from tillage.plans.stem_sql import stem_sql
from tillage.sources.json_io import decode_json
from tillage.sources.schemas import misfit_report, reconciled

SEARCH_QUERY = "Ertion rely"
CONTAINS_QUERY = "tion_th%ing"


def document_lexemes(documents: DataFrame) -> DataFrame:
    """Distinct lexemes of every whole document."""
    return documents.select("doc_id", "lang", lexemes("text").alias("lexemes"))


def document_search(documents: DataFrame, query: str) -> DataFrame:
    """documents containing every lexeme of ``query``."""
    lx = document_lexemes(documents)
    return lx.where(matches("lexemes", query))


def document_index_search(documents: DataFrame, query: str) -> DataFrame:
    """F4 through the token -> doc_id index built from every whole document."""
    index = inverted_index(document_lexemes(documents), "doc_id", "lexemes")
    ids = search_index(index, "doc_id", query)
    return documents.select("doc_id", "lang").join(ids, "doc_id", "left_semi")


def document_stems(documents: DataFrame) -> DataFrame:
    """E20 as the reference's English configuration gives it: sorted distinct stems of every whole document."""
    found = stemmed_lexemes(documents, "doc_id", F.col("text")).withColumnRenamed("id", "doc_id")
    return documents.select("doc_id", "lang").join(found, "doc_id")


def stored_postings(documents: DataFrame) -> Postings:
    """The documents' postings; written if there are none of these files yet."""
    postings = Postings(stored_folder(documents, "postings"))
    return postings if is_stored(documents.sparkSession, postings.path, "terms") else postings.write(documents, "doc_id", F.col("text"))


def stored_trigrams(documents: DataFrame) -> TrigramIndex:
    """The trigram index of the documents' texts and sources; written if there is none of these files yet."""
    index = TrigramIndex(stored_folder(documents, "trigrams"), ("text", "source"))
    return index if is_stored(documents.sparkSession, index.path, "terms") else index.write(documents, "doc_id")


def event_props(events: DataFrame) -> DataFrame:
    """``props`` JSON text decoded into typed columns."""
    return decode_json(events, "props", "k int").select("event_id", "event_type", "props.k")


def conversation_threads(conversations: DataFrame) -> DataFrame:
    """One row per conversation with its turns as an ordered array."""
    convs = conversations.select("conv_id").distinct()
    return child_array(convs, conversations, "conv_id", "conv_id", ["turn", "role", "text"], "turns",
                       sort_by=["turn"])


def line_versions(lines: DataFrame) -> list[DataFrame]:
    """Order lines as three versions of an export hold them (stand-in, by return flag): text quantities of which some carry a
    unit, then the declared types, then wider ones and a column that the schema doesn't name."""
    first = lines.where(F.col("l_returnflag") == "A").select(
        F.col("l_orderkey").cast("int").alias("ORDER_ID"), F.col("l_partkey").alias("product_id"), F.col("l_linenumber").alias("line_no"),
        F.concat(F.col("l_quantity").cast("int").cast("string"), F.when(F.col("l_linenumber") > 5, " pcs").otherwise("")).alias("quantity"),
        F.col("l_extendedprice").cast("decimal(10,1)").cast("string").alias("total"))
    second = lines.where(F.col("l_returnflag") == "N").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"), F.col("l_linenumber").alias("line_no"),
        F.col("l_quantity").cast("int").alias("quantity"), F.col("l_extendedprice").cast("decimal(12,2)").alias("total"))
    rest = F.coalesce(~F.col("l_returnflag").isin("A", "N"), F.lit(True))
    third = lines.where(rest).select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").cast("string").alias("product_id"), F.col("l_linenumber").alias("line_no"),
        F.col("l_quantity").cast("bigint").alias("quantity"), F.col("l_extendedprice").cast("decimal(16,4)").alias("total"),
        F.col("l_linestatus").alias("line_status"))
    return [first, second, third]


def _reconciled_lines(c) -> DataFrame:
    df = reconciled(line_versions(c.base("lineitem")), "order_items", "misfits")
    return df.select("order_id", "product_id", "line_no", "quantity", "total", "product_name", "line_status",
                     F.array_join("misfits", ",").alias("misfits"))


def _threads(c) -> DataFrame:
    df = conversation_threads(c.base("conversations"))
    roles = F.array_join(F.transform("turns", lambda t: F.concat(t["turn"].cast("string"), F.lit(":"), t["role"])), ",")
    chars = F.aggregate("turns", F.lit(0).cast("bigint"), lambda acc, t: acc + F.length(t["text"]))
    return df.select("conv_id", F.size("turns").cast("bigint").alias("turn_count"), roles.alias("roles"),
                     chars.alias("total_chars"))


REGISTRY = [
    Registered(
        "e20_document_lexemes",
        lambda c: document_lexemes(c.base("documents")).select(
            "doc_id", "lang", F.size("lexemes").cast("bigint").alias("lexeme_count")),
        f"""SELECT doc_id, lang, CAST(len({sql_lexemes('text')}) AS BIGINT) AS lexeme_count FROM documents"""),
    Registered(
        "f4_document_search",
        lambda c: document_search(c.base("documents"), SEARCH_QUERY).select(
            "doc_id", "lang", F.size("lexemes").cast("bigint").alias("lexeme_count")),
        f"""SELECT doc_id, lang, CAST(len(lx) AS BIGINT) AS lexeme_count
FROM (SELECT doc_id, lang, {sql_lexemes('text')} AS lx FROM documents)
WHERE list_contains(lx, 'ertion') AND list_contains(lx, 'rely')"""),
    Registered(
        "f4_document_index_search",
        lambda c: document_index_search(c.base("documents"), SEARCH_QUERY),
        f"""SELECT doc_id, lang FROM (SELECT doc_id, lang, {sql_lexemes('text')} AS lx FROM documents)
WHERE list_contains(lx, 'ertion') AND list_contains(lx, 'rely')"""),
    Registered(
        "e20_document_stems",
        lambda c: document_stems(c.base("documents")).select(
            "doc_id", "lang", F.size("lexemes").cast("bigint").alias("stem_count"), F.md5(F.array_join("lexemes", " ")).alias("stems_md5")),
        f"""WITH t AS (SELECT doc_id, unnest({sql_lexemes('text')}) AS word FROM documents),
v AS MATERIALIZED (SELECT * FROM {stem_sql("SELECT word FROM t")}),
s AS (SELECT doc_id, list_sort(list(DISTINCT stem)) AS stems FROM t JOIN v USING (word) GROUP BY doc_id)
SELECT d.doc_id, d.lang, CAST(coalesce(len(s.stems), 0) AS BIGINT) AS stem_count,
  md5(coalesce(array_to_string(s.stems, ' '), '')) AS stems_md5 FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id"""),
    Registered(
        "f4_stored_postings_search",
        lambda c: stored_postings(c.base("documents")).search(c.spark, SEARCH_QUERY).withColumnRenamed("id", "doc_id"),
        f"""WITH t AS (SELECT doc_id, unnest({sql_lexemes('text')}) AS word FROM documents),
v AS MATERIALIZED (SELECT * FROM {stem_sql("SELECT word FROM t")})
SELECT doc_id FROM t JOIN v USING (word) WHERE stem IN ('ertion', 'reli') GROUP BY doc_id HAVING count(DISTINCT stem) = 2"""),
    Registered(
        "f3_trigram_search",
        lambda c: stored_trigrams(c.base("documents")).search(c.spark, CONTAINS_QUERY).select(F.col("id").alias("doc_id"), "source"),
        f"""SELECT doc_id, source FROM documents WHERE text ILIKE '%{CONTAINS_QUERY}%' OR source ILIKE '%{CONTAINS_QUERY}%'"""),
    Registered(
        "s2_reconciled_lines",
        _reconciled_lines,
        """SELECT l_orderkey AS order_id, CAST(l_partkey AS VARCHAR) AS product_id, l_linenumber AS line_no,
  CASE WHEN l_returnflag = 'A' AND l_linenumber > 5 THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS quantity,
  CAST(CASE WHEN l_returnflag = 'A' THEN CAST(CAST(l_extendedprice AS DECIMAL(10,1)) AS DECIMAL(16,4))
            WHEN l_returnflag = 'N' THEN CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DECIMAL(16,4))
            ELSE CAST(l_extendedprice AS DECIMAL(16,4)) END AS DECIMAL(16,4)) AS total,
  CAST(NULL AS VARCHAR) AS product_name,
  CASE WHEN l_returnflag IN ('A', 'N') THEN NULL ELSE l_linestatus END AS line_status,
  CASE WHEN l_returnflag = 'A' AND l_linenumber > 5 THEN 'quantity' ELSE '' END AS misfits FROM lineitem"""),
    Registered(
        "s2_misfit_report",
        lambda c: misfit_report(reconciled(line_versions(c.base("lineitem")), "order_items", "misfits"), "misfits"),
        """SELECT 'quantity' AS column_name, count(*) AS n_rows FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber > 5 HAVING count(*) > 0"""),
    Registered(
        "s4_event_props",
        lambda c: event_props(c.base("events")),
        """SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events"""),
    Registered(
        "j11_conversation_threads",
        _threads,
        """SELECT conv_id, count(*) AS turn_count,
  string_agg(CAST(turn AS VARCHAR) || ':' || role, ',' ORDER BY turn) AS roles,
  CAST(sum(length(text)) AS BIGINT) AS total_chars FROM conversations GROUP BY conv_id"""),
]
