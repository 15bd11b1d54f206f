"""E20 tokenising and F4 full-text match, as array expressions.

A document's lexemes are the distinct lower-cased runs of letters and digits
that are not stop words (no stemming: Spark SQL has no Snowball stemmer, and
the same rule is what the oracle computes). A query matches when every one of
its lexemes is in the document (``plainto_tsquery`` ANDs its words); a query
with no lexemes matches nothing.

The token column is derived once per row and stays JVM-side (``split``,
``filter``, ``array_distinct``, ``forall`` / ``array_contains``); for a large
corpus :func:`inverted_index` gives the token -> id table a GIN index holds.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# PostgreSQL's English stop-word list (english.stop), in its order.
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves "
    "he him his himself she her hers herself it its itself they them their theirs "
    "themselves what which who whom this that these those am is are was were be "
    "been being have has had having do does did doing a an the and but if or "
    "because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few "
    "more most other some such no nor not only own same so than too very s t can "
    "will just don should now"
).split()

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
_PY_TOKEN = re.compile(r"[^\w]+|_+", re.UNICODE)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lexemes(text: Column | str) -> Column:
    """array<string> of distinct lexemes of ``text`` (NULL text -> empty array).

    ``array_except`` de-duplicates and drops stop words with one hash set per
    row, so the cost is linear in the number of words.
    """
    drop = F.array(F.lit(""), *[F.lit(w) for w in ENGLISH_STOP_WORDS])
    words = F.split(F.lower(F.coalesce(_c(text), F.lit(""))), TOKEN_SPLIT)
    return F.array_except(words, drop)


def product_lexemes(name: Column | str, description: Column | str | None = None) -> Column:
    """``to_tsvector(name || ' ' || coalesce(description, ''))``."""
    desc = F.coalesce(_c(description), F.lit("")) if description is not None else F.lit("")
    return lexemes(F.concat(_c(name), F.lit(" "), desc))


def query_lexemes(query: str) -> list[str]:
    """Lexemes of a search parameter (a short driver-side string, not data)."""
    words = [w for w in _PY_TOKEN.split(query.lower()) if w]
    out: list[str] = []
    for w in words:
        if w not in ENGLISH_STOP_WORDS and w not in out:
            out.append(w)
    return out


def matches(tokens: Column | str, query: str) -> Column:
    """every query lexeme is in ``tokens``; no lexemes -> FALSE."""
    q = query_lexemes(query)
    if not q:
        return F.lit(False)
    t = _c(tokens)
    pred = F.array_contains(t, F.lit(q[0]))
    for w in q[1:]:
        pred = pred & F.array_contains(t, F.lit(w))
    return pred


def inverted_index(df: DataFrame, id_col: str, tokens: Column | str) -> DataFrame:
    """(token, id) pairs: one row per distinct lexeme of each row.

    Written once (e.g. partitioned or bucketed by ``token``), it turns a
    search into a read of the query's token partitions instead of a scan and
    re-tokenisation of the whole corpus.
    """
    return df.select(F.explode(_c(tokens)).alias("token"), F.col(id_col))


def search_index(index: DataFrame, id_col: str, query: str) -> DataFrame:
    """F4 over an inverted index: ids that have every lexeme of ``query``.

    The index rows of the query's lexemes are counted per id (a partial
    aggregate, so a very common token is combined map-side); an id matches
    when it has all of them. A query without lexemes matches nothing.
    """
    q = query_lexemes(query)
    hits = index.where(F.col("token").isin(q) if q else F.lit(False))
    per = hits.groupBy(id_col).agg(F.count_distinct("token").alias("__n"))
    return per.where(F.col("__n") == F.lit(len(q))).select(id_col)
