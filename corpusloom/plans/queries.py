"""The queries of the registry, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog, crawl, graph, heavy, hierarchy, html, linkpred, mentions, ngrams, rankings, search
from ..session import stored
from .tables import docs, edges_only, supplier_graph, supplier_nodes, supplier_orders, supplier_pairs, supplier_sets, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

NAMES = ("apache", "clown", "copyright", "die", "example", "idiot", "les", "license", "los", "password", "que", "the", "und")

_D = r"""d AS (SELECT doc_id, source AS author, lang AS volume, coalesce(text, '') AS text, split_part(coalesce(text, ''), chr(10), 1) AS title,
  regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g') AS c FROM documents)"""
_CO = """os AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem),
co AS (SELECT a.s AS p1, b.s AS p2, count(*) AS weight FROM os a JOIN os b ON a.o = b.o AND a.s < b.s GROUP BY 1, 2),
men AS (SELECT s AS person, count(*) AS mentions FROM os GROUP BY s)"""
_G = f"""{_CO},
g AS (SELECT p1 AS src, p2 AS dst, weight FROM co WHERE weight > (SELECT avg(weight) + stddev_pop(weight) FROM co)),
v AS (SELECT s_suppkey AS id FROM supplier),
s AS (SELECT src, dst FROM g UNION ALL SELECT dst, src FROM g),
deg AS (SELECT v.id, count(s.dst) AS degree FROM v LEFT JOIN s ON s.src = v.id GROUP BY v.id),
nn AS (SELECT count(*) AS n FROM v)"""
_PATHS = f"""WITH RECURSIVE {_G},
r(src, dst, d) AS (SELECT src, dst, 1 FROM s UNION SELECT r.src, s.dst, r.d + 1 FROM r JOIN s ON r.dst = s.src WHERE r.d < 8 AND s.dst <> r.src),
sp AS (SELECT src, dst, min(d) AS dist FROM r WHERE src <> dst GROUP BY 1, 2)"""
_TRI = """t AS (SELECT a.src AS a, a.dst AS b, b.dst AS c FROM g a JOIN g b ON a.dst = b.src JOIN g x ON x.src = a.src AND x.dst = b.dst),
tn AS (SELECT id, count(*) AS triangles FROM (SELECT unnest([a, b, c]) AS id FROM t) GROUP BY id),
cl AS (SELECT deg.id, degree, coalesce(triangles, 0) AS triangles, CASE WHEN degree < 2 THEN 0.0 ELSE 2 * coalesce(triangles, 0) / (degree * (degree - 1)) END AS clustering
       FROM deg LEFT JOIN tn USING (id))"""
_NAMES = ", ".join(f"'{n}'" for n in NAMES)
_M = f"""{_D},
m AS (SELECT doc_id, person FROM d, (SELECT unnest([{_NAMES}]) AS person) WHERE contains(text, person)),
mc AS (SELECT person, count(*) AS mentions FROM m GROUP BY person),
mp AS (SELECT a.person AS p1, b.person AS p2, count(*) AS weight FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.person < b.person GROUP BY 1, 2)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _grams_sql(n: int, source: str = "d", by: str = "") -> str:
    return f"SELECT {by}{n} AS n, unnest(list_transform(range(1, length(c) - {n} + 2), lambda i: substring(c, i, {n}))) AS gram FROM {source}"


# --- characters and n-grams ------------------------------------------------------------------------------------------


@query("char_freq", rf"""WITH {_D}, x AS (SELECT unnest(string_split(regexp_replace(text, '\s', '', 'g'), '')) AS ch FROM d)
SELECT ch, count(*) AS n FROM x WHERE ch <> '' GROUP BY ch ORDER BY n DESC, ch LIMIT 50""")
def char_freq(spark: SparkSession, folder: str) -> DataFrame:
    return ngrams.top(ngrams.char_frequency(docs(spark, folder), "text"), 50, "ch", by="n")


def _ngram_query(n: int) -> None:
    @query(f"ngram_counts_{n}", f"WITH {_D}, g AS ({_grams_sql(n)}) SELECT n, gram, count(*) AS cnt FROM g GROUP BY n, gram ORDER BY cnt DESC, gram LIMIT 100")
    def ngram_counts(spark: SparkSession, folder: str) -> DataFrame:
        return ngrams.top(ngrams.ngram_counts(docs(spark, folder), "c", (n,)), 100, "gram")


for _n in (1, 2, 3, 4):
    _ngram_query(_n)


@query("ngram_top_bounded", SQL["ngram_counts_3"])
def ngram_top_bounded(spark: SparkSession, folder: str) -> DataFrame:
    return heavy.top_ngrams(docs(spark, folder), "c", 3, 100)


#: Characters that stand for the letters, so that the tables' texts have some within the default character set.
_HAN = "".join(chr(0x4E00 + i) for i in range(26))


@query("ngram_counts_han", f"""WITH d AS (SELECT doc_id, regexp_replace(translate(lower(coalesce(text, '')), 'abcdefghijklmnopqrstuvwxyz', '{_HAN}'), '[^一-鿿]', '', 'g') AS c FROM documents),
g AS ({_grams_sql(2)}) SELECT n, gram, count(*) AS cnt FROM g GROUP BY n, gram ORDER BY cnt DESC, gram LIMIT 100""")
def ngram_counts_han(spark: SparkSession, folder: str) -> DataFrame:
    """Texts in the default character set."""
    han = F.translate(F.lower("text"), "abcdefghijklmnopqrstuvwxyz", _HAN)
    return ngrams.top(ngrams.ngram_counts(table(spark, folder, "documents").select(T.clean(han).alias("c")), "c", (2,)), 100, "gram")


@query("ngram_totals", f"WITH {_D}, g AS ({' UNION ALL '.join(_grams_sql(n) for n in (1, 2, 3, 4))}), k AS (SELECT n, gram, count(*) AS cnt FROM g GROUP BY n, gram) SELECT n, count(*) AS unique_grams, sum(cnt)::BIGINT AS total_grams FROM k GROUP BY n")
def ngram_totals(spark: SparkSession, folder: str) -> DataFrame:
    return ngrams.ngram_totals(ngrams.ngram_counts(docs(spark, folder), "c"))


@query("ngram_top_char_weights", f"""WITH {_D}, g AS ({_grams_sql(2)}), k AS (SELECT gram, count(*) AS cnt FROM g GROUP BY gram ORDER BY cnt DESC, gram LIMIT 50),
x AS (SELECT unnest(string_split(gram, '')) AS ch, cnt FROM k) SELECT ch, sum(cnt)::BIGINT AS weight FROM x GROUP BY ch ORDER BY weight DESC, ch LIMIT 20""")
def ngram_top_char_weights(spark: SparkSession, folder: str) -> DataFrame:
    return ngrams.char_weights(ngrams.ngram_counts(docs(spark, folder), "c", (2,)))


@query("author_ngrams_per_doc_topk", f"""WITH {_D}, g AS ({_grams_sql(2, by='author, ')}), k AS (SELECT author, n, gram, count(*) AS cnt FROM g GROUP BY ALL)
SELECT author, n, gram, cnt, row_number() OVER (PARTITION BY author ORDER BY cnt DESC, gram) AS rank FROM k QUALIFY rank <= 50""")
def author_ngrams_per_doc_topk(spark: SparkSession, folder: str) -> DataFrame:
    return ngrams.top_each(ngrams.ngram_counts(docs(spark, folder), "c", (2,), ("author",)), 50, ("author",), "gram")


_JOINED = """jc AS (SELECT author, doc_id, unnest(range(1, length(c) + 1)) AS i, unnest(string_split(c, '')) AS ch FROM d WHERE length(c) > 0),
jl AS (SELECT author, ch, lead(ch, 1) OVER w AS b, lead(ch, 2) OVER w AS e, lead(ch, 3) OVER w AS f FROM jc WINDOW w AS (PARTITION BY author ORDER BY doc_id, i)),
jg AS (SELECT author, 1 AS n, ch AS gram FROM jl UNION ALL SELECT author, 2, ch || b FROM jl WHERE b IS NOT NULL UNION ALL SELECT author, 4, ch || b || e || f FROM jl WHERE f IS NOT NULL),
jk AS (SELECT author, n, gram, count(*) AS cnt FROM jg GROUP BY ALL)"""


@query("author_ngrams_topk", f"WITH {_D}, {_JOINED} SELECT author, n, gram, cnt, row_number() OVER (PARTITION BY author, n ORDER BY cnt DESC, gram) AS rank FROM jk QUALIFY rank <= 50")
def author_ngrams_topk(spark: SparkSession, folder: str) -> DataFrame:
    return ngrams.top_each(ngrams.joined_ngram_counts(docs(spark, folder), "author", "doc_id", "c"), 50, ("author", "n"), "gram")


@query("author_summary", f"""WITH {_D}, {_JOINED}, w AS (SELECT author, count(*) FILTER (n = 1) AS unique_1gram, count(*) FILTER (n = 2) AS unique_2gram, count(*) FILTER (n = 4) AS unique_4gram,
  coalesce(sum(cnt) FILTER (n = 1), 0)::BIGINT AS total_1gram, coalesce(sum(cnt) FILTER (n = 2), 0)::BIGINT AS total_2gram, coalesce(sum(cnt) FILTER (n = 4), 0)::BIGINT AS total_4gram FROM jk GROUP BY author)
SELECT d.author, count(*) AS docs, sum(length(c))::BIGINT AS chars, round(sum(length(c)) / count(*), 6) AS mean_chars, any_value(unique_1gram) AS unique_1gram, any_value(unique_2gram) AS unique_2gram,
  any_value(unique_4gram) AS unique_4gram, any_value(total_1gram) AS total_1gram, any_value(total_2gram) AS total_2gram, any_value(total_4gram) AS total_4gram FROM d LEFT JOIN w ON w.author = d.author GROUP BY d.author""")
def author_summary(spark: SparkSession, folder: str) -> DataFrame:
    d = docs(spark, folder)
    return rankings.author_summary(d, "author", "c", ngrams.joined_ngram_counts(d, "author", "doc_id", "c"))


@query("author_unique_sum", f"WITH {_D}, {_JOINED} SELECT n, count(*) AS sum_unique, sum(cnt)::BIGINT AS sum_total FROM jk GROUP BY n")
def author_unique_sum(spark: SparkSession, folder: str) -> DataFrame:
    grams = ngrams.joined_ngram_counts(docs(spark, folder), "author", "doc_id", "c")
    return grams.groupBy("n").agg(F.count("*").alias("sum_unique"), F.sum("cnt").alias("sum_total"))


# --- rankings and statistics -----------------------------------------------------------------------------------------


@query("author_ranking", "SELECT source AS author, count(*) AS docs, row_number() OVER (ORDER BY count(*) DESC, source) AS rank FROM documents GROUP BY source")
def author_ranking(spark: SparkSession, folder: str) -> DataFrame:
    return rankings.ranked(rankings.author_counts(docs(spark, folder), "author"), "docs", "author")


@query("author_ranking_clean", """WITH a AS (SELECT CASE WHEN source LIKE '%0' THEN left(source, length(source) - 1) ELSE source END AS author FROM documents)
SELECT author, count(*) AS docs, row_number() OVER (ORDER BY count(*) DESC, author) AS rank FROM a GROUP BY author""")
def author_ranking_clean(spark: SparkSession, folder: str) -> DataFrame:
    return rankings.ranked(rankings.author_counts(docs(spark, folder), T.clean_author(F.col("author"), "0")), "docs", "author")


@query("author_overview", """WITH a AS (SELECT source, count(*) AS docs FROM documents GROUP BY source)
SELECT sum(docs)::BIGINT AS docs, count(*) AS authors, round(sum(docs) / count(*), 6) AS mean_docs, count(*) FILTER (docs = 1) AS singletons FROM a""")
def author_overview(spark: SparkSession, folder: str) -> DataFrame:
    return rankings.author_overview(rankings.author_counts(docs(spark, folder), "author"))


@query("topk_share", """WITH a AS (SELECT source, count(*) AS docs, row_number() OVER (ORDER BY count(*) DESC, source) AS rk FROM documents GROUP BY source)
SELECT k, sum(docs) FILTER (rk <= k)::BIGINT AS docs, round(100 * sum(docs) FILTER (rk <= k) / sum(docs), 6) AS share FROM a, (SELECT unnest([3, 10, 50]) AS k) GROUP BY k""")
def topk_share(spark: SparkSession, folder: str) -> DataFrame:
    return rankings.top_shares(rankings.author_counts(docs(spark, folder), "author"), (3, 10, 50))


@query("singletons", f"WITH {_D}, a AS (SELECT title, count(*) AS docs FROM d GROUP BY title) SELECT sum(docs)::BIGINT AS docs, count(*) AS authors, round(sum(docs) / count(*), 6) AS mean_docs, count(*) FILTER (docs = 1) AS singletons FROM a")
def singletons(spark: SparkSession, folder: str) -> DataFrame:
    return rankings.author_overview(rankings.author_counts(docs(spark, folder), "title"))


@query("author_char_ranking", f"""WITH {_D} SELECT author, count(*) AS docs, sum(length(c))::BIGINT AS chars, round(avg(length(c)), 6) AS mean_chars, row_number() OVER (ORDER BY sum(length(c)) DESC, author) AS rank
FROM d WHERE length(c) > 0 GROUP BY author""")
def author_char_ranking(spark: SparkSession, folder: str) -> DataFrame:
    return rankings.author_chars(docs(spark, folder), "author", "c")


@query("author_top_chars", f"""WITH {_D}, g AS ({_grams_sql(1, by='author, ')}), k AS (SELECT author, gram, count(*) AS cnt FROM g GROUP BY ALL)
SELECT author, 1 AS n, gram, cnt, row_number() OVER (PARTITION BY author ORDER BY cnt DESC, gram) AS rank FROM k QUALIFY rank <= 50""")
def author_top_chars(spark: SparkSession, folder: str) -> DataFrame:
    return ngrams.top_each(ngrams.ngram_counts(docs(spark, folder), "c", (1,), ("author",)), 50, ("author",), "gram")


@query("volume_stats", "SELECT lang AS volume, count(*) AS docs, round(count(*) * 1.0 / (SELECT avg(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang)), 6) AS of_mean FROM documents GROUP BY lang")
def volume_stats(spark: SparkSession, folder: str) -> DataFrame:
    counts = rankings.volume_counts(docs(spark, folder), "volume")
    return counts.join(counts.agg(F.avg("docs").alias("mean"))).select("volume", "docs", F.round(F.col("docs") / F.col("mean"), 6).alias("of_mean"))  # one row of means


@query("length_stats", """WITH l AS (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents)
SELECT sum(n)::BIGINT AS total_chars, round(avg(n), 6) AS mean_chars, max(n) AS max_chars, (SELECT doc_id FROM l ORDER BY n DESC, doc_id DESC LIMIT 1) AS longest,
min(n) AS min_chars, (SELECT doc_id FROM l ORDER BY n, doc_id DESC LIMIT 1) AS shortest FROM l""")
def length_stats(spark: SparkSession, folder: str) -> DataFrame:
    return rankings.length_stats(table(spark, folder, "documents"), "doc_id", "text")


@query("length_histogram", """WITH b AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM documents)
SELECT least(floor((n_chars - lo) * 50 / greatest(hi - lo, 1)), 49)::INTEGER AS bin, count(*) AS n FROM documents, b WHERE n_chars IS NOT NULL GROUP BY 1""")
def length_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return rankings.histogram(table(spark, folder, "documents"), "n_chars", 50)


@query("title_comparison", rf"""WITH {_D}, e AS (SELECT author, length(c) AS n, length(regexp_replace(lower(title), '[^a-z]', '', 'g')) AS t FROM d),
a AS (SELECT author, sum(n)::BIGINT AS without_title, sum(n + t)::BIGINT AS with_title, sum(t)::BIGINT AS title_chars FROM e GROUP BY author),
r AS (SELECT *, row_number() OVER (ORDER BY without_title DESC, author) AS rank_without, row_number() OVER (ORDER BY with_title DESC, author) AS rank_with FROM a)
SELECT *, CASE WHEN with_title > 0 THEN round(100 * title_chars / with_title, 6) END AS title_share,
CASE WHEN rank_with > rank_without THEN '+' || (rank_with - rank_without) ELSE CAST(rank_with - rank_without AS VARCHAR) END AS change FROM r""")
def title_comparison(spark: SparkSession, folder: str) -> DataFrame:
    d = docs(spark, folder).withColumn("title", T.clean(F.lower("title"), "[^a-z]"))
    return rankings.title_comparison(d, "author", "title", "c")


# --- look-ups --------------------------------------------------------------------------------------------------------


@query("search", f"WITH {_D} SELECT doc_id, author, title FROM d WHERE contains(lower(title), 'license') OR contains(lower(author), 'license') OR contains(lower(text), 'license') ORDER BY doc_id LIMIT 10")
def search_(spark: SparkSession, folder: str) -> DataFrame:
    return search.search(docs(spark, folder), "License", ("title", "author", "text")).select("doc_id", "author", "title")


@query("by_author", "SELECT doc_id, source AS author FROM documents WHERE lower(source) = 'src3' ORDER BY doc_id LIMIT 10")
def by_author(spark: SparkSession, folder: str) -> DataFrame:
    return search.by_author(docs(spark, folder), "SRC3").select("doc_id", "author")


@query("by_volume", "SELECT doc_id, lang AS volume FROM documents WHERE lang = 'de' ORDER BY doc_id LIMIT 10")
def by_volume(spark: SparkSession, folder: str) -> DataFrame:
    return search.by_volume(docs(spark, folder), "de").select("doc_id", "volume")


@query("authors_list", "SELECT DISTINCT source AS author FROM documents ORDER BY author LIMIT 50")
def authors_list(spark: SparkSession, folder: str) -> DataFrame:
    return search.authors(docs(spark, folder))


@query("corpus_stats", "SELECT count(*) AS docs, count(DISTINCT source) AS authors, count(DISTINCT lang) AS volumes, round(count(*) / count(DISTINCT source), 6) AS mean_docs FROM documents")
def corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    return search.corpus_stats(docs(spark, folder))


@query("random_doc", "SELECT doc_id, source AS author FROM documents ORDER BY md5(doc_id || '_7'), doc_id LIMIT 1")
def random_doc(spark: SparkSession, folder: str) -> DataFrame:
    return search.random_row(docs(spark, folder), "doc_id", 7).select("doc_id", "author")


@query("set_difference", "SELECT count(DISTINCT source) AS before, count(DISTINCT CASE WHEN source LIKE '%0' THEN left(source, length(source) - 1) ELSE source END) AS after FROM documents")
def set_difference(spark: SparkSession, folder: str) -> DataFrame:
    return docs(spark, folder).agg(F.count_distinct("author").alias("before"), F.count_distinct(T.clean_author(F.col("author"), "0")).alias("after"))


# --- mentions and networks -------------------------------------------------------------------------------------------


@query("mentions", f"WITH {_M} SELECT person, mentions, row_number() OVER (ORDER BY mentions DESC, person) AS rank FROM mc")
def mentions_(spark: SparkSession, folder: str) -> DataFrame:
    return rankings.ranked(mentions.mention_counts(mentions.mentions(docs(spark, folder), "doc_id", "text", NAMES)), "mentions", "person")


@query("mentions_automaton", f"WITH {_M} SELECT doc_id, person FROM m")
def mentions_automaton(spark: SparkSession, folder: str) -> DataFrame:
    return mentions.mentions(docs(spark, folder), "doc_id", "text", NAMES, automaton=True)


@query("mention_rows", f"WITH {_M} SELECT m.doc_id, m.person, d.author, mc.mentions FROM m JOIN d USING (doc_id) JOIN mc ON mc.person = m.person")
def mention_rows(spark: SparkSession, folder: str) -> DataFrame:
    d = docs(spark, folder)
    return mentions.mention_rows(mentions.mentions(d, "doc_id", "text", NAMES), d, "doc_id", "author").select("doc_id", "person", "author", "mentions")


@query("mention_stats", f"""WITH {_M}, dg AS (SELECT p, count(*) AS degree FROM (SELECT p1 AS p FROM mp UNION ALL SELECT p2 FROM mp) GROUP BY p)
SELECT person, mentions, coalesce(degree, 0) AS degree, row_number() OVER (ORDER BY mentions DESC, person) AS rank FROM mc LEFT JOIN dg ON dg.p = mc.person""")
def mention_stats(spark: SparkSession, folder: str) -> DataFrame:
    return mentions.mention_stats(mentions.mentions(docs(spark, folder), "doc_id", "text", NAMES), "doc_id")


@query("mention_report", f"WITH {_M} SELECT count(DISTINCT author || '_' || title) AS named_texts, count(DISTINCT m.doc_id) AS texts, count(DISTINCT person) AS persons, count(*) AS mentions FROM m JOIN d USING (doc_id)")
def mention_report(spark: SparkSession, folder: str) -> DataFrame:
    d = docs(spark, folder).withColumn("name", F.concat("author", F.lit("_"), "title"))
    return mentions.mention_report(mentions.mentions(d, "doc_id", "text", NAMES), d, "doc_id", "name")


@query("mention_cooccurrence", f"WITH {_M} SELECT * FROM mp")
def mention_cooccurrence(spark: SparkSession, folder: str) -> DataFrame:
    return mentions.cooccurrence(mentions.mentions(docs(spark, folder), "doc_id", "text", NAMES), "doc_id")


@query("title_mentions", rf"""WITH {_D}, x AS (SELECT doc_id, unnest(list_distinct(list_concat(regexp_extract_all(text, '[TADE][hneil]'), regexp_extract_all(text, '(?:the|and) [a-e]')))) AS person FROM d)
SELECT person, count(*) AS mentions FROM x GROUP BY person""")
def title_mentions(spark: SparkSession, folder: str) -> DataFrame:
    found = mentions.title_mentions(docs(spark, folder), "doc_id", "text", (), "TADE", "hneil", ()).where("length(person) = 2")
    titled = mentions.title_mentions(docs(spark, folder), "doc_id", "text", (), "abcde", "\x00", ("the ", "and "))
    return mentions.mention_counts(found.unionByName(titled))


@query("cooccurrence", f"WITH {_CO} SELECT p1, p2, weight FROM co")
def cooccurrence(spark: SparkSession, folder: str) -> DataFrame:
    return supplier_pairs(spark, folder)


def _network(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    _, edges = supplier_graph(spark, folder)
    pairs = edges.select(F.col("src").alias("p1"), F.col("dst").alias("p2"), "weight")
    return mentions.network(mentions.mention_counts(supplier_orders(spark, folder)), pairs, 5, 2)


_IMP = "imp AS (SELECT id, mentions AS weight, degree, least(mentions / 5 + 5, 30.0) AS size FROM deg JOIN men ON men.person = deg.id WHERE mentions >= 5 AND degree >= 2)"


@query("network_nodes", f"WITH {_G}, {_IMP} SELECT id, weight, degree, round(size, 6) AS size FROM imp")
def network_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return _network(spark, folder)[0].withColumn("size", F.round("size", 6))


@query("network_edges", f"WITH {_G}, {_IMP} SELECT src AS source, dst AS target, weight FROM g WHERE src IN (SELECT id FROM imp) AND dst IN (SELECT id FROM imp)")
def network_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _network(spark, folder)[1]


# --- graph measures --------------------------------------------------------------------------------------------------


@query("graph_summary", f"""WITH {_G} SELECT n AS nodes, (SELECT count(*) FROM g) AS edges, round(2 * (SELECT count(*) FROM g) / n, 6) AS mean_degree,
round(2 * (SELECT count(*) FROM g) / (n * (n - 1)), 6) AS density FROM nn""")
def graph_summary(spark: SparkSession, folder: str) -> DataFrame:
    return graph.summary(*edges_only(spark, folder))


@query("degree_centrality", f"WITH {_G} SELECT id, degree, round(degree / (n - 1), 9) AS centrality FROM deg, nn ORDER BY degree DESC, id LIMIT 10")
def degree_centrality(spark: SparkSession, folder: str) -> DataFrame:
    found = graph.degree_centrality(*edges_only(spark, folder)).withColumn("centrality", F.round("centrality", 9))
    return ngrams.top(found, 10, "id", by="degree")


@query("clustering", f"WITH {_G}, {_TRI} SELECT id, degree, triangles, round(clustering, 9) AS clustering FROM cl")
def clustering(spark: SparkSession, folder: str) -> DataFrame:
    return graph.clustering(*edges_only(spark, folder)).withColumn("clustering", F.round("clustering", 9))


@query("average_clustering", f"WITH {_G}, {_TRI} SELECT round(avg(clustering), 9) AS average, (sum(triangles) / 3)::BIGINT AS triangles FROM cl")
def average_clustering(spark: SparkSession, folder: str) -> DataFrame:
    found = graph.clustering(*edges_only(spark, folder))
    return found.agg(F.round(F.avg("clustering"), 9).alias("average"), (F.sum("triangles") / 3).cast("long").alias("triangles"))


@query("shortest_paths", f"{_PATHS} SELECT src, dst, dist FROM sp")
def shortest_paths(spark: SparkSession, folder: str) -> DataFrame:
    return graph.shortest_paths(edges_only(spark, folder)[1])


@query("path_lengths", f"{_PATHS} SELECT dist, count(*) AS pairs FROM sp WHERE src < dst GROUP BY dist")
def path_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return graph.path_lengths(edges_only(spark, folder)[1])


@query("components", f"{_PATHS}, c AS (SELECT v.id, least(v.id, coalesce(min(sp.dst), v.id)) AS component FROM v LEFT JOIN sp ON sp.src = v.id GROUP BY v.id) SELECT id, component FROM c")
def components(spark: SparkSession, folder: str) -> DataFrame:
    return graph.components(*edges_only(spark, folder))


@query("pair_features", f"""{_PATHS}, {_TRI} SELECT g.src, g.dst, round(abs(a.degree - b.degree) / greatest(a.degree + b.degree, 1), 9) AS degree_diff, round((a.clustering + b.clustering) / 2, 9) AS clustering,
round(least(coalesce(dist, 10), 10) / 10, 9) AS path_length, round(abs(a.degree - b.degree) / (n - 1), 9) AS centrality_diff
FROM g JOIN cl a ON a.id = g.src JOIN cl b ON b.id = g.dst LEFT JOIN sp ON sp.src = g.src AND sp.dst = g.dst, nn""")
def pair_features(spark: SparkSession, folder: str) -> DataFrame:
    vertices, edges = edges_only(spark, folder)
    out = graph.pair_features(vertices, edges, edges)
    return out.select("src", "dst", *(F.round(c, 9).alias(c) for c in ("degree_diff", "clustering", "path_length", "centrality_diff")))


@query("pair_distance", f"{_PATHS} SELECT v.id AS src, 1 AS dst, CASE WHEN v.id = 1 THEN 0 ELSE coalesce(sp.dist, 10) END AS dist FROM v LEFT JOIN sp ON sp.src = v.id AND sp.dst = 1")
def pair_distance(spark: SparkSession, folder: str) -> DataFrame:
    vertices, edges = edges_only(spark, folder)
    return graph.pair_distance(edges, vertices.select(F.col("id").alias("src"), F.lit(1).cast(dict(vertices.dtypes)["id"]).alias("dst")))


_COUNTED = ["c1 AS (SELECT src, dst, 1.0::DOUBLE AS k FROM s)", *(f"c{i} AS (SELECT c.src, s.dst, sum(c.k) AS k FROM c{i - 1} c JOIN s ON c.dst = s.src JOIN sp ON sp.src = c.src AND sp.dst = s.dst AND sp.dist = {i} GROUP BY ALL)" for i in range(2, 9))]


@query("betweenness", f"""{_PATHS}, {", ".join(_COUNTED)}, ct AS ({" UNION ALL ".join(f"SELECT src, dst, k, {i} AS dist FROM c{i}" for i in range(1, 9))}),
b AS (SELECT x.dst AS id, sum(x.k * y.k / z.k) AS b FROM ct x JOIN ct y ON x.dst = y.src JOIN ct z ON z.src = x.src AND z.dst = y.dst AND z.dist = x.dist + y.dist GROUP BY x.dst)
SELECT v.id, round(coalesce(b, 0) / ((n - 1) * (n - 2)), 9) AS betweenness FROM v LEFT JOIN b USING (id), nn""")
def betweenness(spark: SparkSession, folder: str) -> DataFrame:
    return graph.betweenness(*edges_only(spark, folder)).withColumn("betweenness", F.round("betweenness", 9))


# --- pages and crawls ------------------------------------------------------------------------------------------------

_BARE = r"""regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<script[^>]*>.*?</script>', '', 'g'), '(?s)<style[^>]*>.*?</style>', '', 'g')"""


def _skip_sql(words: tuple[str, ...]) -> str:
    return " AND ".join(f"NOT contains(s, '{w}')" for w in words)


@query("page_text", rf"""WITH x AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace({_BARE}, '<[^>]+>', '', 'g'), '&[^;]+;', '', 'g'), '[ \t\x0B\f\r]+', ' ', 'g') AS t FROM pages),
l AS (SELECT page_id, list_filter(list_transform(string_split(t, chr(10)), lambda s: trim(s)), lambda s: s <> '' AND {_skip_sql(T.PLAIN_SKIP)}) AS ls FROM x)
SELECT page_id, trim(array_to_string(ls, chr(10))) AS content FROM l""")
def page_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", T.page_text(F.coalesce("html", F.lit("")), collapse=False).alias("content"))


@query("page_text_collapsed", rf"""WITH x AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace({_BARE}, '<[^>]+>', '', 'g'), '&[^;]+;', '', 'g'), '\s+', ' ', 'g')) AS s FROM pages)
SELECT page_id, CASE WHEN {_skip_sql(T.PLAIN_SKIP)} THEN s ELSE '' END AS content FROM x""")
def page_text_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", T.page_text(F.coalesce("html", F.lit(""))).alias("content"))


_BLOCK = r'(?s)<div[^>]*class="[^"]*text[^"]*"[^>]*>(.*?)</div>'


@query("page_rich_text", rf"""WITH b AS (SELECT page_id, {_BARE} AS b FROM pages), m AS (SELECT page_id, CASE WHEN regexp_matches(b, '{_BLOCK}') THEN regexp_extract(b, '{_BLOCK}', 1) ELSE b END AS b FROM b),
x AS (SELECT page_id, regexp_replace(regexp_replace(b, '<br\s*/?>|<p[^>]*>|</p>', chr(10), 'g'), '<[^>]+>', '', 'g') AS t FROM m),
e AS (SELECT page_id, regexp_replace(replace(replace(replace(t, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g') AS t FROM x),
l AS (SELECT page_id, list_filter(list_transform(string_split(regexp_replace(t, '[ \t\x0B\f\r]+', ' ', 'g'), chr(10)), lambda s: trim(s)), lambda s: s <> '' AND {_skip_sql(T.RICH_SKIP)}
  AND NOT regexp_matches(s, '^[\d\s\-_]+$') AND (length(s) >= 3 OR regexp_matches(s, '[一-鿿]'))) AS ls FROM e)
SELECT page_id, trim(array_to_string(ls, chr(10))) AS content FROM l""")
def page_rich_text(spark: SparkSession, folder: str) -> DataFrame:
    from ..session import ship

    ship(spark)
    return table(spark, folder, "pages").select("page_id", T.rich_page_text(F.coalesce("html", F.lit("")), collapse=False).alias("content"))


@query("page_status", r"""SELECT page_id, CASE WHEN page_id % 50 = 0 THEN 'timeout' WHEN page_id % 20 = 0 THEN 'http_error_403' WHEN contains(lower(html), 'spam') THEN 'blocked' WHEN contains(lower(html), 'pills') THEN 'captcha'
WHEN NOT contains(html, '<article>') THEN 'invalid_page' WHEN len(regexp_extract_all(html, '<p>')) > 1 THEN 'success' ELSE 'no_poems_found' END AS status FROM pages""")
def page_status(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    http = F.when(F.col("page_id") % 20 == 0, 403).otherwise(200)
    error = F.when(F.col("page_id") % 50 == 0, "timeout")
    found = F.regexp_count("html", F.lit("<p>")) - 1
    return pages.select("page_id", html.page_status(F.col("html"), found, http, error, ("pills",), ("<article>",), ("spam",)).alias("status"))


@query("page_positional_zip", rf"""WITH x AS (SELECT page_id, regexp_extract_all({_BARE}, '<a[^>]*>([^<]+)</a>', 1) AS a, regexp_extract_all({_BARE}, '<p>(?:<b>)?([^<]+)', 1) AS b FROM pages),
i AS (SELECT page_id, a, b, unnest(range(1, least(len(a), len(b)) + 1)) AS i FROM x) SELECT page_id, (i - 1)::INTEGER AS pos, a[i] AS a, b[i] AS b FROM i""")
def page_positional_zip(spark: SparkSession, folder: str) -> DataFrame:
    return html.zip_matches(table(spark, folder, "pages"), "page_id", "html", "<a[^>]*>([^<]+)</a>", "<p>(?:<b>)?([^<]+)")


_PLAIN = r"trim(regexp_replace(regexp_replace({0}, '[<>&]', '', 'g'), '\s+', ' ', 'g'))"


@query("page_dom_extract", f"""WITH {_D}, x AS (SELECT doc_id, {_PLAIN.format('title')} AS title, author, {_PLAIN.format('text')} AS content FROM d) SELECT doc_id, 0 AS pos, title, author, content FROM x WHERE title <> '' AND content <> ''""")
def page_dom_extract(spark: SparkSession, folder: str) -> DataFrame:
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "[<>&]", ""), r"\s+", " "))
    page = F.concat(
        F.lit("<html><body><table width='100%'><tr><td><h2>《<a>"), plain("title"), F.lit('</a>》</h2><span class="etext opt"><b> '), F.col("author"),
        F.lit('</b></span></td></tr></table><table border="0"><tr><td class="ctext">'), plain("text"), F.lit("</td></tr></table></body></html>"),
    )
    return html.extract(docs(spark, folder).select("doc_id", page.alias("page")), "doc_id", "page")


@query("page_without_author", f"""WITH {_D}, x AS (SELECT doc_id, {_PLAIN.format('title')} AS title, {_PLAIN.format('text')} AS content FROM d) SELECT doc_id, 0 AS pos, title, '佚名' AS author, content FROM x WHERE title <> '' AND content <> ''""")
def page_without_author(spark: SparkSession, folder: str) -> DataFrame:
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "[<>&]", ""), r"\s+", " "))
    page = F.concat(F.lit("<html><body><table><tr><td><h2>《<a>"), plain("title"), F.lit("</a>》</h2></td></tr></table><table border='0'><tr><td class='ctext'>"), plain("text"), F.lit("</td></tr></table></body></html>"))
    return html.extract(docs(spark, folder).select("doc_id", page.alias("page")), "doc_id", "page")


def _poem_page(d: DataFrame) -> DataFrame:
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "[<>&]", ""), r"\s+", " "))
    page = F.concat(
        F.lit("<script>var t='</table>';</script><table width='100%'><tr><td><h2>《<a href='x'>"), plain("title"), F.lit("</a>》</h2><span class='x'><b> "), F.col("author"),
        F.lit('著</b></span></td></tr></table><table border="0"><tr><td><div id="comm1"></div>'), plain("text"), F.lit('<p class="ctext"></p></td></tr></table>'),
    )
    return d.select("doc_id", page.alias("page"))


_POEMS = f"""WITH {_D}, x AS (SELECT doc_id, {_PLAIN.format('title')} AS title, author, {_PLAIN.format('text')} AS content FROM d)
SELECT doc_id, 0 AS pos, title, author, content FROM x WHERE title <> '' AND content <> ''"""


@query("page_positional_poems", _POEMS)
def page_positional_poems(spark: SparkSession, folder: str) -> DataFrame:
    return html.positional(_poem_page(docs(spark, folder)), "doc_id", "page")


@query("page_row_poems", _POEMS)
def page_row_poems(spark: SparkSession, folder: str) -> DataFrame:
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "[<>&]", ""), r"\s+", " "))
    page = F.concat(F.lit("<table><tr><td><a>"), plain("title"), F.lit("</a><a>"), F.col("author"), F.lit("</a></td><td>"), plain("text"), F.lit("</td></tr></table>"))
    return html.extract(docs(spark, folder).select("doc_id", page.alias("page")), "doc_id", "page", "rows")


_STATUS = "CASE event_type WHEN 'view' THEN 'success' WHEN 'click' THEN 'success' WHEN 'signup' THEN 'captcha' WHEN 'error' THEN 'http_error_403' ELSE 'timeout' END"
_LOG = f"log AS (SELECT event_id, user_id, {_STATUS} AS status FROM events), k AS (SELECT *, CASE WHEN status = 'success' THEN 'success' WHEN status = 'captcha' THEN 'captcha' WHEN contains(status, '403') THEN '403' ELSE 'other' END AS kind FROM log)"


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", "user_id", F.expr(_STATUS).alias("status"))


@query("status_summary", f"WITH {_LOG} SELECT kind AS outcome, count(*) AS n FROM k GROUP BY kind")
def status_summary(spark: SparkSession, folder: str) -> DataFrame:
    return crawl.status_summary(_log(spark, folder), "status")


@query("retry_order", f"WITH {_LOG} SELECT event_id, status, kind, CASE kind WHEN 'other' THEN 0 WHEN '403' THEN 1 ELSE 2 END AS priority FROM k WHERE kind <> 'success'")
def retry_order(spark: SparkSession, folder: str) -> DataFrame:
    return crawl.retry_order(_log(spark, folder), "event_id", "status").select("event_id", "status", "kind", "priority")


@query("unprocessed", "SELECT DISTINCT e.user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'purchase' AND x.value > 50)")
def unprocessed(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return crawl.unprocessed(events.select("user_id").distinct(), events.where("event_type = 'purchase' AND value > 50"), "user_id")


# --- link prediction -------------------------------------------------------------------------------------------------

_NEG = """ec AS (SELECT count(*) AS e FROM g),
rd AS (SELECT id, unnest(range(1, (SELECT greatest(2, (6 * e + n * 7 - 1) // (n * 7)) FROM ec, nn) + 1)) AS round FROM v),
bk AS (SELECT id, round, ('0x' || left(md5(concat_ws('_', id, round, 42)), 8))::BIGINT % (SELECT greatest(1, n // 8) FROM nn) AS bucket FROM rd),
neg AS (SELECT * FROM (SELECT DISTINCT a.id AS src, b.id AS dst FROM bk a JOIN bk b ON a.round = b.round AND a.bucket = b.bucket AND a.id < b.id) p
  WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.src = p.src AND g.dst = p.dst) ORDER BY md5(concat_ws('_', src, dst, 42)) LIMIT (SELECT e FROM ec)),
lp AS (SELECT src, dst, 1 AS label FROM g UNION ALL SELECT src, dst, 0 FROM neg)"""


@query("negative_samples", f"WITH {_G}, {_NEG} SELECT src, dst FROM neg")
def negative_samples(spark: SparkSession, folder: str) -> DataFrame:
    vertices, edges = edges_only(spark, folder)
    return linkpred.negative_samples(vertices, edges, edges.count())


def _pairs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The labelled pairs with their features, and the suppliers that these are of."""
    sets = supplier_sets(spark, folder)
    nodes, _ = stored(supplier_nodes(spark, folder, sets))  # read several times
    vertices, edges = edges_only(spark, folder, sets)
    return linkpred.node_features(linkpred.labelled_pairs(vertices, edges), nodes), nodes


_NODES = "nd AS (SELECT person AS id, mentions AS weight, least(mentions / 5 + 5, 30.0) AS size FROM men)"


@query("linkpred_features", f"WITH {_G}, {_NEG}, {_NODES} SELECT lp.src, lp.dst, label, a.weight AS w1, round(a.size, 6) AS s1, b.weight AS w2, round(b.size, 6) AS s2 FROM lp JOIN nd a ON a.id = lp.src JOIN nd b ON b.id = lp.dst")
def linkpred_features(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder)[0].withColumns({"s1": F.round("s1", 6), "s2": F.round("s2", 6)})


@query("split", f"""WITH {_G}, {_NEG}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('_', src, dst, 42))) AS rn, count(*) OVER (PARTITION BY label) AS n FROM lp)
SELECT src, dst, label, CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS part FROM r""")
def split(spark: SparkSession, folder: str) -> DataFrame:
    vertices, edges = edges_only(spark, folder)
    return linkpred.split(linkpred.labelled_pairs(vertices, edges))


@query("linkpred_metrics")
def linkpred_metrics(spark: SparkSession, folder: str) -> DataFrame:
    pairs, _ = stored(_pairs(spark, folder)[0])  # read twice
    return linkpred.baselines(linkpred.split(pairs), ("w1", "s1", "w2", "s2"))


@query("circuit_scores")
def circuit_scores(spark: SparkSession, folder: str) -> DataFrame:
    return linkpred.circuit_scores(_pairs(spark, folder)[0], ("w1", "s1", "w2", "s2"))


@query("hybrid_scores")
def hybrid_scores(spark: SparkSession, folder: str) -> DataFrame:
    return linkpred.hybrid_scores(_pairs(spark, folder)[0], ("w1", "s1", "w2", "s2"))


@query("score_metrics", f"""WITH {_G}, {_NEG}, {_NODES}, x AS (SELECT label, (a.weight + b.weight) / (SELECT 2.0 * max(weight) FROM nd) AS score FROM lp JOIN nd a ON a.id = lp.src JOIN nd b ON b.id = lp.dst),
c AS (SELECT count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score < 0.5 AND label = 0) AS tn FROM x),
m AS (SELECT (tp + tn) / (tp + fp + fn + tn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM c),
u AS (SELECT avg(CASE WHEN p.score > q.score THEN 1.0 WHEN p.score = q.score THEN 0.5 ELSE 0.0 END) AS auc FROM x p, x q WHERE p.label = 1 AND q.label = 0)
SELECT round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1, round(auc, 6) AS auc FROM m, u""")
def score_metrics(spark: SparkSession, folder: str) -> DataFrame:
    pairs, nodes = _pairs(spark, folder)
    most = nodes.agg(F.max("weight")).first()[0]
    scored = pairs.withColumn("score", (F.col("w1") + F.col("w2")) / F.lit(2.0 * (most or 1)))
    return linkpred.metrics(scored).select(*(F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1", "auc")))


# --- hierarchies, catalogs, names ------------------------------------------------------------------------------------


@query("section_text", "SELECT conv_id, count(*) AS sections, string_agg(coalesce(text, ''), chr(10) ORDER BY turn, text) AS content FROM conversations GROUP BY conv_id")
def section_text(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.section_text(table(spark, folder, "conversations"), "conv_id", "turn", "text")


_TREE = "tr AS (SELECT event_id AS node, CASE WHEN event_id > 0 THEN (event_id - 1) // 10 END AS parent, (event_id - 1) % 10 AS ord FROM events)"


@query("tree_walk", f"""WITH RECURSIVE {_TREE}, w(node, depth, path) AS (SELECT node, 0, [0] FROM tr WHERE node = 1 UNION ALL SELECT t.node, w.depth + 1, list_append(w.path, t.ord::INTEGER) FROM w JOIN tr t ON t.parent = w.node)
SELECT node, depth, array_to_string(path, '.') AS path FROM w""")
def tree_walk(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("event_id")
    tree = table(spark, folder, "events").select(n.alias("node"), F.when(n > 0, F.floor((n - 1) / 10)).cast("long").alias("parent"), ((n - 1) % 10).alias("ord"))
    return hierarchy.walk(tree, 1).select("node", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("path"))


@query("subtree_text", f"""WITH RECURSIVE {_TREE}, w(node, path) AS (SELECT node, [0::BIGINT] FROM tr WHERE node = 3 UNION ALL SELECT t.node, list_append(w.path, t.ord::BIGINT) FROM w JOIN tr t ON t.parent = w.node)
SELECT count(*) AS nodes, string_agg(event_type, chr(10) ORDER BY path) AS content FROM w JOIN events ON event_id = node""")
def subtree_text(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("event_id")
    tree = table(spark, folder, "events").select(n.alias("node"), F.when(n > 0, F.floor((n - 1) / 10)).cast("long").alias("parent"), ((n - 1) % 10).alias("ord"), "event_type")
    return hierarchy.subtree_text(tree, 3, "event_type")


@query("subtree_lines", f"""WITH RECURSIVE {_TREE}, w(node, depth, path) AS (SELECT node, 0, [0::BIGINT] FROM tr WHERE node = 3 UNION ALL SELECT t.node, w.depth + 1, list_append(w.path, t.ord::BIGINT) FROM w JOIN tr t ON t.parent = w.node)
SELECT row_number() OVER (ORDER BY path) AS number, depth, event_type AS value FROM w JOIN events ON event_id = node WHERE event_type <> ''""")
def subtree_lines(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("event_id")
    tree = table(spark, folder, "events").select(n.alias("node"), F.when(n > 0, F.floor((n - 1) / 10)).cast("long").alias("parent"), ((n - 1) % 10).alias("ord"), "event_type")
    return hierarchy.subtree_lines(tree, 3, "event_type")


@query("simplify_chars", f"WITH {_D} SELECT doc_id, translate('學而時習之 ' || title, '{T.TRADITIONAL}', '{T.SIMPLIFIED}') AS title FROM d")
def simplify_chars(spark: SparkSession, folder: str) -> DataFrame:
    return docs(spark, folder).select("doc_id", T.simplify(F.concat(F.lit("學而時習之 "), "title")).alias("title"))


@query("sanitize_names", rf"WITH {_D} SELECT doc_id, trim(regexp_replace(title, '[^\p{{L}}\p{{N}} _-]', '', 'g')) AS name FROM d")
def sanitize_names(spark: SparkSession, folder: str) -> DataFrame:
    return docs(spark, folder).select("doc_id", T.sanitize(F.col("title")).alias("name"))


@query("book_lookup", """WITH t AS (SELECT p_partkey, p_name, CASE WHEN p_name = 'Ring' THEN 1 WHEN contains(lower(p_name), 'ring') THEN 3 END AS tier FROM part)
SELECT p_partkey, p_name, tier FROM t WHERE tier = (SELECT min(tier) FROM t)""")
def book_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.lookup(table(spark, folder, "part").select("p_partkey", "p_name"), "Ring", "p_name")


def _catalog(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    told = F.when(F.col("p_size") % 3 != 0, F.struct(F.struct(F.col("p_brand").alias("name")).alias("from"), F.struct(F.col("p_type").alias("name")).alias("to")))
    details = part.where("p_size % 2 = 0").select(F.col("p_partkey").cast("string").alias("urn"), F.to_json(F.struct(told.alias("dynasty"), F.array("p_type", "p_brand").alias("tags"))).alias("json"))
    return catalog.rows(part.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("title"), F.col("p_partkey").cast("string").alias("urn")), details)


@query("catalog_rows", """SELECT p_partkey AS ord, p_name AS title, CASE WHEN p_size % 2 = 0 AND p_size % 3 <> 0 THEN p_brand ELSE '' END AS dynasty_from,
CASE WHEN p_size % 2 = 0 AND p_size % 3 <> 0 THEN p_type ELSE '' END AS dynasty_to, CASE WHEN p_size % 2 = 0 THEN p_type || ', ' || p_brand ELSE '' END AS tags, '' AS edition FROM part""")
def catalog_rows(spark: SparkSession, folder: str) -> DataFrame:
    c = catalog.COLUMNS
    return _catalog(spark, folder).select(F.col(c[0]).alias("ord"), F.col(c[1]).alias("title"), F.col(c[4]).alias("dynasty_from"), F.col(c[5]).alias("dynasty_to"), F.col(c[9]).alias("tags"), F.col(c[8]).alias("edition"))


@query("catalog_distribution", "SELECT p_brand AS value, count(*) AS n FROM part WHERE p_size % 2 = 0 AND p_size % 3 <> 0 GROUP BY p_brand")
def catalog_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.distribution(_catalog(spark, folder), catalog.COLUMNS[4])
