"""One session's view of an index: each method is a query of the reference's interface and returns a DataFrame.

Arguments are checked as they are there: at most 200 results, depth 20, queries of 1 to 10 000 characters,
paths inside the repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import code
from quillspan.operators import context as C
from quillspan.operators import graph as G
from quillspan.operators import history as H
from quillspan.operators import relational as R
from quillspan.operators import retrieval as T
from quillspan.sources import model as M
from quillspan.sources import parse
from quillspan.sources.tables import table

MOST_RESULTS, MOST_DEPTH, LONGEST_QUERY = 200, 20, 10_000
FIELDS = {"content": 1.0, "doc_comment": 0.5, "symbol_path": 2.0}


def checked_query(q: str) -> str:
    if not q.strip() or len(q) > LONGEST_QUERY:
        raise ValueError(f"a query has 1 to {LONGEST_QUERY} characters")
    return q.strip()


def checked_path(p: str) -> str:
    if p.startswith(("/", "\\")) or ".." in p.replace("\\", "/").split("/") or (len(p) > 1 and p[1] == ":"):
        raise ValueError("a path is relative and stays inside the repository")
    return p.replace("\\", "/").removeprefix("./")


def clamp(n: int | None, default: int, most: int) -> int:
    return max(1, min(most, default if n is None else n))


class Engine:
    def __init__(self, spark: SparkSession, data_dir: str) -> None:
        self.spark, self.d = spark, data_dir

    # ------------------------------------------------------------ search
    def _terms(self, query: str) -> DataFrame:
        one = self.spark.createDataFrame([(checked_query(query),)], "q string")
        return one.select(F.lit("q").alias("query"), F.explode(code.keyword_tokens(F.col("q"))).alias("term"))

    def search(self, query: str, limit: int | None = None, token_budget: int = 8000) -> DataFrame:
        """(position, id, path, symbol_path, score): keyword and symbol lists fused by rank, boosted by kind,
        visibility and freshness, cut at the budget, overlaps left out."""
        n = clamp(limit, 10, MOST_RESULTS)
        terms = self._terms(query)
        kw = T.bm25(M.chunks(self.spark, self.d, "content", "doc_comment", "symbol_path"), "id", FIELDS, terms, 5 * n).select("query", "id", "rank")
        y = M.symbols(self.spark, self.d)
        hit = y.join(F.broadcast(terms.filter("length(term) >= 3")), F.lower("name").contains(F.lower("term"))).groupBy("query", F.col("chunk_id").alias("id"), F.length("fqn").alias("len")).agg(F.count(F.lit(1)).alias("hits"))
        from pyspark.sql import Window

        sym = hit.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("hits").desc(), "len", "id"))).filter(F.col("rank") <= 5 * n)
        kind = self.spark.createDataFrame([(query,)], "q string").select(code.query_type(F.col("q")), code.intent(F.col("q"))).first()
        w_kw, _, w_sym, _ = T.list_weights(kind[0], kind[1])
        fused = T.fuse([(kw, w_kw), (sym.select("query", "id", "rank"), w_sym)])
        top = fused.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "id"))).filter(F.col("rank") <= 2 * n)
        c = M.chunks(self.spark, self.d, "file_id", "kind", "visibility", "line_start", "line_end", "token_count", "symbol_path")
        f = T.freshness(M.files(self.spark, self.d).filter("indexed_at is not null"), "indexed_at").select(F.col("id").alias("file_id"), "path", "freshness")
        r = top.join(c, "id").join(f, "file_id", "left")
        boost = F.lit(1.0) + F.lit(0.15) * F.coalesce("freshness", F.lit(0.0))
        r = C.budget_prefix(r.withColumn("score", code.structural_boost(F.col("score"), F.col("kind"), F.col("visibility"), boost)), token_budget)
        r = r.select("query", "id", F.coalesce("file_id", F.lit(-1)).alias("file_id"), "path", "symbol_path", F.coalesce(F.least("line_start", "line_end"), F.lit(1)).alias("line_start"), F.coalesce(F.greatest("line_start", "line_end"), F.lit(1)).alias("line_end"), "token_count", "score")
        r = C.overlap_dedup(r)
        return r.withColumn("position", F.row_number().over(Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "id"))).filter(F.col("position") <= n)

    def search_with_filter(self, query: str, language: str | None = None, path_glob: str | None = None, kind: str | None = None, modified_after: str | None = None, limit: int | None = None) -> DataFrame:
        """The ranked list first, the filters after it: what they drop makes no room for others further down
        than max(5 * limit, 50)."""
        n = clamp(limit, 10, MOST_RESULTS)
        r = self.search(query, min(MOST_RESULTS, max(5 * n, 50)), 10**9)
        f = M.files(self.spark, self.d).select(F.col("id").alias("file_id"), "language", "indexed_at")
        r = r.join(f, "file_id", "left").join(M.chunks(self.spark, self.d, "kind"), "id")
        if language:
            r = r.filter(F.col("language") == language.lower())
        if path_glob:
            import fnmatch

            r = r.filter(F.lower("path").rlike("^(?:" + fnmatch.translate(path_glob.lower()).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z") + ")$"))
        if kind:
            r = r.filter(F.col("kind") == kind)
        if modified_after:
            r = r.filter(F.col("indexed_at") >= F.lit(modified_after).cast("timestamp_ntz"))
        return r.orderBy("position").limit(n)

    def context_window(self, query: str, limit: int | None = None, token_budget: int = 4000) -> DataFrame:
        """(query, text): the results as one text under the budget."""
        hits = self.search(query, limit, token_budget)
        body = M.chunks(self.spark, self.d, "content").join(hits.select("id"), "id", "left_semi")
        return C.render(hits.join(body, "id"))

    def context_window_pack(self, query: str, limit: int | None = None, token_budget: int = 4000) -> DataFrame:
        """The results with ranges that touch joined, best first while they fit."""
        hits = self.search(query, limit, 10**9)
        rows = hits.join(M.chunks(self.spark, self.d, "content").join(hits.select("id"), "id", "left_semi"), "id")
        m = C.merge_adjacent(rows.select("query", "file_id", "path", "id", "line_start", "line_end", "score", "token_count", "content"), ["query", "file_id", "path"])
        return C.greedy_pack(m.withColumn("id", F.xxhash64("file_id", "line_start")), token_budget)

    def search_by_intent(self, query: str, limit: int | None = None) -> DataFrame:
        """The search with the strategy of the query's intent beside each result."""
        i = self.spark.createDataFrame([(checked_query(query),)], "q string").select(code.intent(F.col("q"))).first()[0]
        arch, impl, tests, docs, recent, depth, high = code.STRATEGY[i]
        return self.search(query, limit).withColumns({"intent": F.lit(i), "graph_depth": F.lit(depth), "include_tests": F.lit(tests), "include_docs": F.lit(docs)})

    def multi_repo_search(self, query: str, priorities: dict[str, float] | None = None, limit: int | None = None) -> DataFrame:
        """Results of all repositories, scores times the priority of the repository (1 if none is given)."""
        n = clamp(limit, 10, MOST_RESULTS)
        r = self.search(query, min(MOST_RESULTS, 2 * n), 10**9).withColumn("repository", F.substring_index("path", "/", 1))
        weight = code.lookup(F.col("repository"), priorities, 1.0) if priorities else F.lit(1.0)
        return r.withColumn("score", F.col("score") * weight).orderBy(F.round("score", 9).desc(), "id").limit(n)

    def audit_plan(self, plan: str, depth: int | None = None) -> DataFrame:
        """(query, text, files, symbols, affected, risk) per step of a plan."""
        steps = parse.plan_steps(self.spark.createDataFrame([(1, checked_query(plan))], "id long, t string"), "id", "t").select(F.concat(F.lit("s"), F.col("step").cast("string")).alias("query"), "text")
        terms = steps.select("query", F.explode(code.keyword_tokens(F.col("text"))).alias("term"))
        hits = T.bm25(M.chunks(self.spark, self.d, "content", "doc_comment", "symbol_path"), "id", FIELDS, terms, 10).select("query", "id")
        hits = hits.join(M.chunks(self.spark, self.d, "file_id", "symbol_path"), "id")
        e = M.dependencies(self.spark, self.d)
        n = G.blast_radius(e, hits.select(F.col("id").alias("node")).distinct(), clamp(depth, 3, MOST_DEPTH)).groupBy(F.col("start").alias("id")).agg(F.count(F.lit(1)).alias("n"))
        g = hits.join(n, "id", "left").groupBy("query").agg(F.countDistinct("file_id").alias("files"), F.countDistinct("symbol_path").alias("symbols"), F.coalesce(F.sum("n"), F.lit(0)).alias("affected"))
        return steps.join(g, "query", "left").withColumn("risk", code.risk_level(F.coalesce("affected", F.lit(0))))

    # ------------------------------------------------------------ symbols, files
    def get_symbol(self, name: str, limit: int | None = None) -> DataFrame:
        y = M.symbols(self.spark, self.d)
        exact = y.filter(F.col("fqn") == name)
        return exact.unionByName(R.symbols_by_prefix(y, name, clamp(limit, 10, MOST_RESULTS)).join(exact.select("id"), "id", "left_anti"))

    def file_summary(self, path: str) -> DataFrame:
        f = M.files(self.spark, self.d).filter(F.col("path") == checked_path(path)).select(F.col("id").alias("file_id"))
        return M.chunks(self.spark, self.d, "file_id", "symbol_path", "kind", "visibility", "line_start", "line_end").join(f, "file_id").orderBy("line_start", "id")

    def explain_symbol(self, fqn: str) -> DataFrame:
        """One card: file, documentation, numbers of edges in and out."""
        y = M.symbols(self.spark, self.d).filter(F.col("fqn") == fqn)
        e = M.dependencies(self.spark, self.d)
        up, down = e.groupBy(F.col("source_id").alias("id")).agg(F.slice(F.collect_list("target_id"), 1, 10).alias("upstream")), e.groupBy(F.col("target_id").alias("id")).agg(F.slice(F.collect_list("source_id"), 1, 10).alias("downstream"))
        doc = M.chunks(self.spark, self.d, "doc_comment").select(F.col("id").alias("chunk_id"), "doc_comment")
        return y.join(M.files(self.spark, self.d).select(F.col("id").alias("file_id"), "path"), "file_id", "left").join(doc, "chunk_id", "left").join(up, "id", "left").join(down, "id", "left")

    def module_map(self, depth: int | None = None) -> DataFrame:
        y = M.symbols(self.spark, self.d).join(M.files(self.spark, self.d).select(F.col("id").alias("file_id"), "path"), "file_id")
        y = y.filter(F.size(F.split("path", "/")) <= clamp(depth, MOST_DEPTH, MOST_DEPTH) + 1)
        return y.groupBy(F.regexp_replace("path", r"/[^/]*$", "").alias("directory")).agg(F.countDistinct("path").alias("files"), F.count(F.lit(1)).alias("symbols"))

    def status(self) -> DataFrame:
        one = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))
        s, d = self.spark, self.d
        return one(M.files(s, d), "files").join(one(M.chunks(s, d), "chunks"), how="cross").join(one(M.symbols(s, d), "symbols"), how="cross").join(one(M.dependencies(s, d), "dependencies"), how="cross")

    def languages(self) -> DataFrame:
        return M.files(self.spark, self.d).groupBy("language").agg(F.count(F.lit(1)).alias("files")).orderBy(F.col("files").desc(), "language")

    # ------------------------------------------------------------ graph
    def _start(self, symbol: int) -> DataFrame:
        return self.spark.createDataFrame([(symbol,)], "node long")

    def dependencies(self, symbol: int, depth: int | None = None) -> DataFrame:
        e, n = M.dependencies(self.spark, self.d), clamp(depth, 2, MOST_DEPTH)
        up = G.upstream(e, self._start(symbol), n).withColumn("direction", F.lit("upstream"))
        return up.unionByName(G.downstream(e, self._start(symbol), n).withColumn("direction", F.lit("downstream")))

    def blast_radius(self, symbol: int, depth: int | None = None) -> DataFrame:
        return G.blast_radius(M.dependencies(self.spark, self.d), self._start(symbol), clamp(depth, 5, MOST_DEPTH)).orderBy("distance", "node")

    def call_graph(self, symbol: int, depth: int | None = None) -> DataFrame:
        return G.upstream(M.dependencies(self.spark, self.d).filter("kind = 'calls'"), self._start(symbol), clamp(depth, 2, MOST_DEPTH))

    def cycles(self) -> DataFrame:
        return G.strong_components(M.dependencies(self.spark, self.d))

    # ------------------------------------------------------------ history
    def recent_changes(self, limit: int | None = None) -> DataFrame:
        return M.commits(self.spark, self.d).orderBy(F.col("ts").desc_nulls_last(), "hash").limit(clamp(limit, 20, MOST_RESULTS))

    def co_changes(self, path: str, least: int = 2, limit: int | None = None) -> DataFrame:
        return H.co_changed_with(M.commits(self.spark, self.d), M.commit_files(self.spark, self.d), checked_path(path), 500, least, clamp(limit, 20, MOST_RESULTS))

    def commit_summary(self, path: str, limit: int | None = None) -> DataFrame:
        cf = M.commit_files(self.spark, self.d).filter(F.col("path") == checked_path(path))
        return M.commits(self.spark, self.d).join(cf.select("hash"), "hash").orderBy(F.col("ts").desc_nulls_last(), "hash").limit(clamp(limit, 10, MOST_RESULTS))

    def search_commits(self, query: str, limit: int | None = None) -> DataFrame:
        docs = M.commits(self.spark, self.d).select(F.col("hash").alias("id"), "message", "summary", "author")
        hits = T.bm25(docs, "id", {"message": 1.0, "summary": 1.0, "author": 1.0}, self._terms(query), clamp(limit, 10, MOST_RESULTS))
        return hits.join(docs, "id").orderBy("rank")

    def bug_prone_files(self, least: int = 2) -> DataFrame:
        return H.bug_fixes(M.commits(self.spark, self.d), M.commit_files(self.spark, self.d)).filter(F.col("bugs") >= least).orderBy(F.col("bugs").desc(), "path")

    def external_docs(self) -> DataFrame:
        return table(self.spark, self.d, "external_docs").select("id", "source_url", "title", "ingested_at").distinct().orderBy(F.col("ingested_at").desc(), "id")
