"""Stored search structures: F4 postings of stemmed lexemes and F3 trigram lists.

Both are written once, by a job of their own, into a folder of Parquet tables
and answer searches lazily. Posting lists are dealt to a fixed number of
buckets by a hash of the term, and a bucket is a partition folder, so a search
reads the folders of its own terms only (``PartitionFilters`` in the plan). A
term that a third of all rows hold is cut into slices by a hash of the row's
id, and the list of how many rows hold each term lets a search start from its
rarest term: the other lists are semi-joined to that one's rows, which adaptive
execution broadcasts where it is small.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.functions.stemming import with_stems
from tillage.functions.text import lexemes, query_lexemes
from tillage.operators.filters import contains_ci
from tillage.operators.joins import even_join
from tillage.session import cut_lineage, ensure_checkpoint_dir
from tillage.sources.tables import write_folders

BUCKETS = 64
ROWS_A_SLICE = 1_000_000
CHARS_A_SLICE = 5_000_000
FORMAT = 2  # of the stored tables and the rules that fill them; part of the folder's name


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _write(df: DataFrame, path: str, bucket: str, slices: int, buckets: int, slice_by: str, *sort: str, distinct: bool = False) -> None:
    """Partition folders by ``bucket``; a bucket's rows are dealt to ``slices`` tasks, so that no task writes a hot list alone."""
    dealt = df.withColumn("__slice", F.pmod(F.xxhash64(slice_by, F.lit(1)), F.lit(slices))).repartition(min(buckets * slices, 20_000), bucket, "__slice")
    dealt = dealt.distinct() if distinct else dealt
    write_folders(dealt.drop("__slice").sortWithinPartitions(bucket, *sort), path, bucket)


def _write_terms(spark: SparkSession, path: str, buckets: int) -> None:
    """``terms`` (term, n) of the stored lists: counted from their files, the texts are not cut again."""
    terms = spark.read.parquet(f"{path}/lists").groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("n"))
    _write(terms, f"{path}/terms", "bucket", 1, buckets, "term", "term")


def stored_folder(df: DataFrame, kind: str) -> str:
    """A folder in ``spark.checkpoint.dir`` named by ``kind`` and the files under ``df`` (paths, sizes, times): changed files name another one."""
    files = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    mark = files.agg(F.bit_xor(F.xxhash64("file_path", "file_size", "file_modification_time")).alias("x"), F.count(F.lit(1)).alias("n")).first()
    return f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{kind}-{FORMAT}-{mark.n}-{(mark.x or 0) & (2 ** 64 - 1):016x}"


def is_stored(spark: SparkSession, path: str, last: str) -> bool:
    """Whether the table written last is there, whole."""
    try:
        spark.read.parquet(f"{path}/{last}")
        return True
    except AnalysisException:
        return False


# E20 -----------------------------------------------------------------------------------
def _word_stems(df: DataFrame, id_col: str, text: Column) -> tuple[DataFrame, int]:
    """(id, stem) for every distinct word of a row's ``text`` that is no stop word, and their number.

    Words are cut once and stored; the distinct ones are stemmed and joined
    back, the words of more than a 10,000th of the rows by broadcast."""
    words = cut_lineage(df.select(F.col(id_col).alias("id"), F.explode(lexemes(text)).alias("word")))
    vocabulary = cut_lineage(with_stems(words.groupBy("word").agg(F.count(F.lit(1)).alias("n_rows")), "word"))
    total = vocabulary.agg(F.sum("n_rows")).first()[0] or 0
    return even_join(words, vocabulary, "word", total).select("id", "stem"), total


def stemmed_tokens(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, stem): the distinct stems of the words of ``text`` that are no stop words, per id."""
    return _word_stems(df, id_col, text)[0].distinct()


def stemmed_lexemes(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, lexemes): ``to_tsvector('english', text)`` as a sorted array, one row per id; without words an empty one."""
    per = stemmed_tokens(df, id_col, text).groupBy("id").agg(F.sort_array(F.collect_list("stem")).alias("lexemes"))
    ids = df.select(F.col(id_col).alias("id")).distinct()
    return ids.join(per, "id", "left").select("id", F.coalesce("lexemes", F.array().cast("array<string>")).alias("lexemes"))


def query_stems(spark: SparkSession, query: str) -> list[str]:
    """The distinct stems of a search parameter (a short driver-side text)."""
    words = query_lexemes(query)
    if not words:
        return []
    values = ", ".join(f"('{w}')" for w in words)  # letters and digits only; a literal relation is folded without a job
    rows = with_stems(spark.sql(f"SELECT * FROM VALUES {values} AS t(word)"), "word", fenced=False).collect()
    return sorted({r.stem for r in rows})


def stem_matches(df: DataFrame, id_col: str, text: Column, query: str) -> DataFrame:
    """F4 without a stored index, lazily: the ids whose text has a word of every stem of ``query``.

    Only distinct words are stemmed; the forms of the query's stems are joined to the texts' words."""
    asked = query_stems(df.sparkSession, query)
    words = df.select(F.col(id_col).alias(id_col), F.explode(lexemes(text)).alias("word"))
    if not asked:
        return words.where(F.lit(False)).select(id_col)
    forms = with_stems(words.select("word").distinct(), "word").where(F.col("stem").isin(*asked))
    hits = words.join(forms, "word").groupBy(id_col).agg(F.count_distinct("stem").alias("n"))
    return hits.where(F.col("n") == len(asked)).select(id_col)


# F4 ------------------------------------------------------------------------------------
def _rows_with_all(lists: DataFrame, terms: DataFrame, wanted: list[str], keys: list[str], buckets: int) -> DataFrame:
    """The rows (``keys``) that hold every wanted term, starting from the rarest one's list."""
    spark = lists.sparkSession
    # The folders of the wanted terms, by the same hash.
    folders = spark.range(1).select(F.array_distinct(F.array(*[_bucket(F.lit(w), buckets) for w in wanted])).alias("all")).first().all
    at = F.col("bucket").isin(*folders) & F.col("term").isin(*wanted)
    rarest = terms.where(at).agg(F.min_by("term", F.struct("n", "term")).alias("term"))
    first = lists.where(at & (F.col("term") == rarest.scalar())).select(*keys)
    return lists.where(at).join(first, keys, "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select(*keys)


@dataclass(frozen=True)
class Postings:
    """Stored token postings of a text column: ``lists`` (term, id) and ``terms`` (term, n), in folders by bucket of the term."""

    path: str
    buckets: int = BUCKETS

    def write(self, df: DataFrame, id_col: str, text: Column) -> "Postings":
        """Cut, stem, deal and write: the only job that reads the texts."""
        found, n = _word_stems(df, id_col, text)
        tokens = found.select(F.col("stem").alias("term"), "id").withColumn("bucket", _bucket(F.col("term"), self.buckets))
        # Two words of a row may have one stem: equal rows go to one task, which drops them as it writes.
        _write(tokens, f"{self.path}/lists", "bucket", n // (self.buckets * ROWS_A_SLICE) + 1, self.buckets, "id", "term", "id", distinct=True)
        _write_terms(df.sparkSession, self.path, self.buckets)
        return self

    def search(self, spark: SparkSession, query: str) -> DataFrame:
        """ids whose text has every stem of ``query``; a query without lexemes matches nothing."""
        lists, terms = spark.read.parquet(f"{self.path}/lists"), spark.read.parquet(f"{self.path}/terms")
        wanted = query_stems(spark, query)
        if not wanted:
            return lists.select("id").limit(0)
        return _rows_with_all(lists, terms, wanted, ["id"], self.buckets)


# F3 ------------------------------------------------------------------------------------
def pattern_grams(text: str) -> list[str]:
    """The lower-case trigrams that every value matching ``contains_ci(text)`` holds.

    ``%`` and ``_`` cut the pattern into runs, a backslash before one of them or itself makes it text; runs under
    three characters give none. Characters whose lower case depends on the language are left out."""
    runs, at = [""], 0
    while at < len(text):
        if text[at] == "\\" and at + 1 < len(text) and text[at + 1] in "%_\\":
            runs[-1] += text[at + 1]
            at += 2
            continue
        if text[at] in "%_":
            runs.append("")
        else:
            runs[-1] += text[at]
        at += 1
    out = {run[i:i + 3] for run in runs for i in range(len(run) - 2)}
    return sorted({g.lower() for g in out if all(c.isascii() or c.lower() == c == c.upper().lower() for c in g)})


@dataclass(frozen=True)
class TrigramIndex:
    """Stored trigram lists of some text columns and a copy of their rows in folders by bucket of the id."""

    path: str
    cols: tuple[str, ...]
    buckets: int = BUCKETS

    def write(self, df: DataFrame, id_col: str) -> "TrigramIndex":
        """``lists``: (column, trigram, id); ``terms``: how many hold each; ``rows``: id and columns."""
        base = df.select(F.col(id_col).alias("id"), *self.cols)
        _write(base.withColumn("bucket", _bucket(F.col("id"), self.buckets)), f"{self.path}/rows", "bucket", 1, self.buckets, "id", "id")
        # A lookahead finds the overlapping trigrams in one pass over the text.
        grams = [F.struct(F.lit(i).alias("col"), F.array_distinct(F.regexp_extract_all(F.lower(F.col(c).cast("string")), F.lit("(?s)(?=(...))"), F.lit(1))).alias("grams"))
                 for i, c in enumerate(self.cols)]
        lists = (base.select("id", F.inline(F.array(*grams))).select("id", "col", F.explode("grams").alias("term"))
                 .withColumn("bucket", _bucket(F.col("term"), self.buckets)))
        # A value has fewer trigrams than characters: enough to deal by, without cutting the texts twice.
        chars = base.agg(sum((F.coalesce(F.sum(F.length(F.col(c).cast("string"))), F.lit(0)) for c in self.cols), F.lit(0))).first()[0]
        _write(lists, f"{self.path}/lists", "bucket", chars // (self.buckets * CHARS_A_SLICE) + 1, self.buckets, "id", "term", "col", "id")
        _write_terms(df.sparkSession, self.path, self.buckets)
        return self

    def search(self, spark: SparkSession, text: str) -> DataFrame:
        """The stored rows (id and columns) that ``contains_ci(cols, text)`` keeps.

        Rows that hold all trigrams of the pattern in one column are candidates; only the folders of their ids are
        read, and the pattern is tested on them. A pattern without a run of three characters tests all rows."""
        rows = spark.read.parquet(f"{self.path}/rows")
        hit, wanted = contains_ci(self.cols, text), pattern_grams(text)
        if not wanted:
            return rows.where(hit).drop("bucket")
        lists, terms = spark.read.parquet(f"{self.path}/lists"), spark.read.parquet(f"{self.path}/terms")
        found = cut_lineage(_rows_with_all(lists, terms, wanted, ["id", "col"], self.buckets).select("id").distinct()
                            .withColumn("bucket", _bucket(F.col("id"), self.buckets)))
        folders = [r.bucket for r in found.select("bucket").distinct().collect()]  # at most ``buckets``
        return rows.where(F.col("bucket").isin(*folders) if folders else F.lit(False)).join(found, ["bucket", "id"], "left_semi").where(hit).drop("bucket")
