"""Full-text index and TF-IDF search over documents(id, content)."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.errors import InvalidQueryError
from tessella.functions.tokenizers import SIMPLE, Tokenizer
from tessella.scratch import stored


@dataclass(frozen=True)
class SearchOptions:
    threshold: float = 0.1
    limit: int = 10
    offset: int = 0
    ascending: bool = False
    idf: str = "log2"  # or "constant": 1 + log2 taken as 2
    fuzzy: float | None = None  # least similarity 1 - levenshtein / length of terms that count as the query's


class FullTextIndex:
    """Postings are derived, not stored: term, id, tf, positions and the documents' lengths. save() writes them."""

    def __init__(self, docs: DataFrame, tokenizer: Tokenizer = SIMPLE, postings: DataFrame | None = None) -> None:
        self.docs, self.tokenizer = docs, tokenizer
        self._postings = postings

    def tokens(self) -> DataFrame:
        return self.docs.select("id", F.explode(self.tokenizer.tokens(F.col("content"))).alias("t")).select("id", "t.term", "t.pos")

    def _runs(self, docs: DataFrame, run) -> DataFrame:
        """id, length and the columns of run(start, end) for each term of each row of docs; in ``s``, the row's (term, pos)
        sorted once, a term's own are those from start up to end. No shuffle, and no filter on the tokens, which Spark
        would push below them and so tokenize each text twice."""
        ordered = docs.select("id", F.sort_array(self.tokenizer.tokens(F.col("content"))).alias("s"))
        first = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | (F.get("s", i)["term"] != F.get("s", i - 1)["term"]))
        marked = ordered.select("id", "s", F.when(F.size("s") > 0, first).alias("starts"))
        ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("s")))
        return marked.select("id", F.size("s").alias("length"), F.explode(F.zip_with("starts", ends, run)).alias("p")).select("id", "length", "p.*")

    def _by_id(self) -> tuple[DataFrame, DataFrame | None]:
        """The rows whose id no other row has, and the others if there are any. What is counted within a row needs no
        shuffle of postings for the former; only ids are read to find out."""
        again = stored(self.docs.groupBy("id").count().where("count > 1").select(F.col("id").alias("again")), "again")
        if again.isEmpty():
            return self.docs, None
        same = F.col("id").eqNullSafe(F.col("again"))
        return self.docs.join(again, same, "left_anti"), self.docs.join(again, same, "left_semi")

    def postings(self) -> DataFrame:
        """term, id, tf, positions, length. Counted within the row of a document: no shuffle."""
        if self._postings is not None:
            return self._postings
        positions = lambda a, b: F.struct(F.get("s", a)["term"].alias("term"), (b - a).alias("tf"), F.slice("s", a + 1, b - a)["pos"].alias("positions"))
        return self._runs(self.docs, positions).select("term", "id", "tf", "positions", "length")

    def spans(self) -> DataFrame:
        """term, id, tf, first_pos, last_pos; one row for each term and id."""
        span = lambda a, b: F.struct(F.get("s", a)["term"].alias("term"), (b - a).cast("long").alias("tf"), F.get("s", a)["pos"].alias("first_pos"), F.get("s", b - 1)["pos"].alias("last_pos"))
        once, again = self._by_id()
        found = self._runs(once, span).drop("length")
        if again is not None:
            of_rows = self._runs(again, span).groupBy("id", "term")
            found = found.unionByName(of_rows.agg(F.sum("tf").alias("tf"), F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos")))
        return found.select("term", "id", "tf", "first_pos", "last_pos")

    def term_frequency(self) -> DataFrame:
        return self.spans().select("id", "term", "tf")

    def document_frequency(self) -> DataFrame:
        """A document's own terms are told apart within its row, so only sums by term are shuffled."""
        own = lambda docs: docs.select("id", F.explode(F.array_distinct(self.tokenizer.terms(F.col("content")))).alias("term"))
        once, again = self._by_id()
        found = own(once).groupBy("term").agg(F.count("id").alias("df"))
        if again is None:
            return found
        return found.unionByName(own(again).groupBy("term").agg(F.count_distinct("id").alias("df"))).groupBy("term").agg(F.sum("df").alias("df"))

    def term_statistics(self) -> DataFrame:
        """term, tf, df: how often it stands, and in how many documents."""
        return self.term_frequency().groupBy("term").agg(F.sum("tf").alias("tf"), F.count("id").alias("df"))

    def statistics(self) -> DataFrame:
        terms = self.docs.select("id", self.tokenizer.terms(F.col("content")).alias("t"))
        sizes = terms.agg(F.count("*").alias("docs"), F.sum(F.size("t")).alias("tokens"), F.avg(F.size("t")).alias("avg_length"))
        kinds = terms.select(F.explode("t").alias("term")).agg(F.count_distinct("term").alias("terms"))
        return sizes.withColumn("terms", kinds.scalar()).select("docs", "terms", "tokens", "avg_length")

    def query_terms(self, text: str) -> list[tuple[str, int]]:
        """The query's terms and how often each stands in it."""
        spark = self.docs.sparkSession
        row = spark.range(1).select(self.tokenizer.terms(F.lit(text)).alias("t")).first()
        counts: dict[str, int] = {}
        for term in row["t"]:
            if any(c.isalnum() for c in term):
                counts[term] = counts.get(term, 0) + 1
        return sorted(counts.items())

    def scores(self, text: str, options: SearchOptions = SearchOptions()) -> DataFrame:
        """id, score of documents with any of the query's terms, at or above the threshold; not ordered, not paged.
        tf / length * (1 + log2(N / df)), summed over the query's terms, repeated ones counting again."""
        terms = self.query_terms(text)
        if not terms:
            raise InvalidQueryError("the search has no terms")
        times = F.create_map(*[F.lit(x) for pair in terms for x in pair])
        wanted = [t for t, _ in terms]
        if self._postings is None:
            # one pass: texts without any term of the query aren't tokenized, and only tokens of the query leave the scan
            # (an inner explode of a column is filtered by its size below the tokenizer, which would then run twice)
            tokens = self._holding(wanted, options).select("id", self.tokenizer.terms(F.col("content")).alias("t"))
            found = F.filter(F.transform("t", lambda t: self._match(t, wanted, options)), lambda q: q.isNotNull())
            hits = tokens.select("id", F.size("t").alias("length"), F.explode(found).alias("query")).groupBy("id", "length", "query").agg(F.count("*").alias("tf"))
        else:
            kept = self._postings if options.fuzzy is not None else self._postings.where(F.col("term").isin(*wanted))  # reaches the scan
            hits = kept.withColumn("query", self._match(F.col("term"), wanted, options)).where("query is not null").groupBy("id", "length", "query").agg(F.sum("tf").alias("tf"))
        if options.idf == "constant":
            weighted = hits.withColumn("idf", F.lit(2.0))
        else:
            n = self.docs.agg(F.count("*").alias("n"))
            df = hits.groupBy("query").agg(F.count("*").alias("df"))  # at most one row a term of the query
            weighted = hits.join(F.broadcast(df), "query").withColumn("idf", 1 + F.log2(n.scalar() / F.col("df")))
        part = F.col("tf") / F.col("length") * F.col("idf") * F.element_at(times, F.col("query"))
        return weighted.groupBy("id").agg(F.sum(part).alias("score")).where(F.col("score") >= options.threshold)

    def _holding(self, wanted: list[str], options: SearchOptions) -> DataFrame:
        """Documents that may hold a term: a term is a contiguous piece of the lower-cased text (a capital sigma at a
        word's end may lower-case otherwise, so terms with sigmas are not looked for)."""
        if options.fuzzy is not None or any(c in t for t in wanted for c in "σς"):
            return self.docs
        text = F.col("content") if self.tokenizer.case_sensitive else F.lower("content")
        return self.docs.where(functools.reduce(lambda a, b: a | b, [text.contains(w) for w in wanted]))

    @staticmethod
    def _match(term: Column, wanted: list[str], options: SearchOptions) -> Column:
        if options.fuzzy is None:
            return F.when(term.isin(*wanted), term)
        near = [F.when(1 - F.levenshtein(term, F.lit(w)) / F.greatest(F.length(term), F.lit(len(w))) >= options.fuzzy, w) for w in wanted]
        return F.coalesce(F.when(term.isin(*wanted), term), *near)

    def search(self, text: str, options: SearchOptions = SearchOptions()) -> DataFrame:
        """id, score: a page by relevance, ties by id."""
        order = [F.asc("score") if options.ascending else F.desc("score"), F.asc("id")]
        page = self.scores(text, options).orderBy(*order)
        page = page.offset(options.offset) if options.offset > 0 else page
        return page.limit(options.limit) if options.limit > 0 else page

    def ranked(self, text: str, options: SearchOptions = SearchOptions()) -> DataFrame:
        return self.scores(text, options).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))

    def highlight(self, text: str, mark: tuple[str, str] = ("<em>", "</em>")) -> DataFrame:
        """id, content with the query's terms marked."""
        terms = "|".join(t for t, _ in self.query_terms(text))
        return self.docs.select("id", F.regexp_replace("content", rf"(?iu)(?<![\p{{L}}\p{{N}}])({terms})(?![\p{{L}}\p{{N}}])", f"{mark[0]}$1{mark[1]}").alias("content"))

    def upsert(self, docs: DataFrame) -> FullTextIndex:
        kept = self.docs.join(docs.select("id"), "id", "left_anti")
        return FullTextIndex(kept.unionByName(docs.select(self.docs.columns)), self.tokenizer)

    def remove(self, ids: DataFrame) -> FullTextIndex:
        return FullTextIndex(self.docs.join(ids.select("id"), "id", "left_anti"), self.tokenizer)

    def save(self, path: str) -> None:
        """Postings in segments, one a partition of the documents and each sorted by term: a search reads of each segment
        the pages whose statistics admit its terms, and no posting is shuffled."""
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        self.postings().sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")

    @classmethod
    def load(cls, spark, path: str, tokenizer: Tokenizer = SIMPLE) -> FullTextIndex:
        return cls(spark.read.parquet(f"{path}/docs"), tokenizer, spark.read.parquet(f"{path}/postings"))
