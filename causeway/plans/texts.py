"""Queries on texts: extraction, tokens, keywords, likeness, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions import text_features as tx
from causeway.functions.text import strip
from causeway.operators.learning import hashed
from causeway.session import materialize
from causeway.tables import load

Q: dict = {}
O: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


def _docs(spark, d) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", "text").where("text is not null")


_D = "(select doc_id, text from documents where text is not null)"
_TOK = "list_filter(string_split(lower(regexp_replace(text, '[^A-Za-z0-9_]+', ' ', 'g')), ' '), lambda w: len(w) > 2)"
_STOP = "[" + ", ".join(f"'{w}'" for w in tx.STOPWORDS) + "]"
_KEYW = f"list_filter({_TOK}, lambda w: not list_contains({_STOP}, w))"


@query(f"select doc_id, len({_TOK}) n, len(list_distinct({_TOK})) n_distinct from {_D}")
def txt_tokenize(spark, d):
    t = _docs(spark, d).select("doc_id", tx.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


def _words(spark, d) -> DataFrame:
    """(doc_id, pos, word): the keywords of each document in order."""
    return _docs(spark, d).select("doc_id", F.posexplode(tx.keywords(F.col("text"))).alias("pos", "word"))


_W = f"(select doc_id, unnest(k) word, generate_subscripts(k, 1) pos from (select doc_id, {_KEYW} k from {_D}))"


@query(f"select doc_id, word, n, rank from (select doc_id, word, n, row_number() over (partition by doc_id order by n desc, pos) rank from (select doc_id, word, count(*) n, min(pos) pos from {_W} group by 1, 2)) where rank <= 20")
def txt_keywords(spark, d):
    """The 20 most frequent keywords of each document, ties by first occurrence."""
    c = _words(spark, d).groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "pos"))
    return c.withColumn("rank", rank.cast("long")).where("rank <= 20").select("doc_id", "word", "n", "rank")


@query(f"select word, count(distinct doc_id) df, round(ln((select count(*) from {_D}) / count(distinct doc_id)), 9) idf from {_W} group by 1")
def agg_idf(spark, d):
    n = _docs(spark, d).count()
    return _words(spark, d).select("doc_id", "word").distinct().groupBy("word").agg(F.count("*").alias("df")).select("word", "df", F.round(F.log(F.lit(n) / F.col("df")), 9).alias("idf"))


@query(f"select doc_id, max(n) / any_value(t) top_tf, any_value(t) total from (select doc_id, word, count(*) n from {_W} group by 1, 2) join (select doc_id, count(*) t from {_W} group by 1) using (doc_id) group by 1")
def agg_tf(spark, d):
    c = _words(spark, d).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    return c.groupBy("doc_id").agg((F.max("n") / F.sum("n")).alias("top_tf"), F.sum("n").alias("total"))


_TFIDF = f"""with w as (select doc_id, word, count(*) n from {_W} group by 1, 2), t as (select doc_id, sum(n) t from w group by 1), i as (select word, ln((select count(*) from {_D}) / count(*)) idf from w group by 1),
s as (select doc_id, word, round(n / t * idf, 9) tfidf from w join t using (doc_id) join i using (word))"""


def _tfidf(spark, d) -> DataFrame:
    """(doc_id, word, tfidf)."""
    n = _docs(spark, d).count()
    c = _words(spark, d).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    total = c.groupBy("doc_id").agg(F.sum("n").alias("t"))
    idf = c.groupBy("word").agg(F.log(F.lit(n) / F.count("*")).alias("idf"))
    return c.join(total, "doc_id").join(idf, "word").select("doc_id", "word", F.round(F.col("n") / F.col("t") * F.col("idf"), 9).alias("tfidf"))


@query(_TFIDF + " select doc_id, word, tfidf from (select *, row_number() over (partition by doc_id order by tfidf desc, word) rn from s) where rn <= 10")
def txt_tfidf(spark, d):
    """The ten keywords of each document that tell most."""
    rn = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("tfidf"), "word"))
    return _tfidf(spark, d).withColumn("rn", rn).where("rn <= 10").select("doc_id", "word", "tfidf")


_SIM = _TFIDF + """, top as (select doc_id, word, tfidf from (select *, row_number() over (partition by doc_id order by tfidf desc, word) rn from s) where rn <= 10 and tfidf > 0), nrm as (select doc_id, sqrt(sum(tfidf * tfidf)) n from top group by 1),
q as (select doc_id from documents where doc_id % 50 = 0)
select a.doc_id, b.doc_id other, round(sum(a.tfidf * b.tfidf) / (max(na.n) * max(nb.n)), 6) cosine from top a join q on q.doc_id = a.doc_id join top b on a.word = b.word and a.doc_id <> b.doc_id join nrm na on na.doc_id = a.doc_id join nrm nb on nb.doc_id = b.doc_id group by 1, 2 having round(sum(a.tfidf * b.tfidf) / (max(na.n) * max(nb.n)), 6) >= 0.3"""


@query(_SIM)
def txt_keyword_similarity(spark, d):
    """Documents whose leading keywords are like those of a query document; queries are the ids divisible by 50, against all."""
    top = materialize(txt_tfidf(spark, d).where("tfidf > 0"), "keywords")
    norm = top.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("tfidf") * F.col("tfidf"))).alias("norm"))
    unit = top.join(norm, "doc_id").select("doc_id", "word", (F.col("tfidf") / F.col("norm")).alias("w"))
    q = unit.where("doc_id % 50 = 0")
    b = unit.select(F.col("doc_id").alias("other"), "word", F.col("w").alias("v"))
    return q.join(b, "word").where("doc_id <> other").groupBy("doc_id", "other").agg(F.round(F.sum(F.col("w") * F.col("v")), 6).alias("cosine")).where("cosine >= 0.3")


# -- extraction


@query(f"select doc_id, len(regexp_extract_all(text, 'v?([0-9]+\\.[0-9]+(?:\\.[0-9]+)?)', 1)) versions, len(regexp_extract_all(text, '[A-Za-z0-9_/]+\\.(?:py|js|ts|java|cpp|c|h|go|rs)')) files, coalesce(nullif(regexp_extract(text, '([A-Za-z0-9_]+Error):', 1), ''), 'none') error_type from {_D}")
def txt_error_facts(spark, d):
    t = F.col("text")
    error = F.regexp_extract(t, "([A-Za-z0-9_]+Error):", 1)
    return _docs(spark, d).select(
        "doc_id", F.size(F.regexp_extract_all(t, F.lit(tx.VERSION), F.lit(1))).cast("long").alias("versions"), F.size(F.regexp_extract_all(t, F.lit(tx.FILE), F.lit(0))).cast("long").alias("files"), F.when(error != "", error).otherwise("none").alias("error_type")
    )


_ISSUES = " union all ".join(f"select doc_id, '{k}' issue_type from {_D} where " + " or ".join(f"contains(lower(text), '{w}')" for w in ws) for k, ws in tx.ISSUE_WORDS.items())


@query(_ISSUES)
def txt_issue_types(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(tx.issue_types(F.col("text"))).alias("issue_type"))


_PATTERNS = " union all ".join(
    [f"select doc_id, 'error_type:{t}' pattern from {_D} where contains(text, '{t}')" for t in tx.ERROR_TYPES]
    + [f"select distinct doc_id, 'file_ext:' || e from (select doc_id, unnest(regexp_extract_all(text, '\\.(py|js|ts|java|cpp|go|rs|rb)\\b', 1)) e from {_D})"]
    + [f"select doc_id, 'has_test' from {_D} where regexp_matches(lower(text), '\\btest[_\\s]')", f"select doc_id, 'has_failure' from {_D} where regexp_matches(lower(text), '\\bfail(ed|ing)?\\b')"]
)


@query(_PATTERNS)
def txt_error_patterns(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(tx.error_patterns(F.col("text"))).alias("pattern"))


_TAGS = " union all ".join(f"select doc_id, '{k}' tag from {_D} where regexp_matches(lower(text), '{p}')" for k, p in tx.TAG_PATTERNS.items())


@query(_TAGS)
def txt_semantic_tags(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(tx.matching(F.col("text"), tx.TAG_PATTERNS)).alias("tag"))


_DIR = "case " + " ".join(f"when regexp_matches(lower(text), '{p}') then '{k}'" for k, p in tx.DIRECTIONS.items()) + " else 'unknown' end"


@query(f"select {_DIR} direction, count(*) n from {_D} group by 1")
def txt_directions(spark, d):
    return _docs(spark, d).groupBy(tx.first_matching(F.col("text"), tx.DIRECTIONS, "unknown").alias("direction")).agg(F.count("*").alias("n"))


@query("select id, array_to_string(list_sort(list_filter(string_split(regexp_replace(lower(raw_input), '[^a-z0-9_一-龥]+', ' ', 'g'), ' '), lambda w: len(w) > 0)), ' ') canonical from (select distinct id, raw_input from stories where raw_input is not null and id is not null)")
def txt_canonicalize(spark, d):
    return load(spark, d, "stories").where("raw_input is not null and id is not null").select("id", tx.canonical(F.col("raw_input")).alias("canonical")).distinct()


@query(f"select doc_id, nullif(regexp_extract(text, '[A-Za-z0-9_]*(?:ERROR|Error)[^\\n]{{0,200}}', 0), '') snippet from {_D}")
def txt_error_snippets(spark, d):
    s = F.regexp_extract("text", r"[A-Za-z0-9_]*(?:ERROR|Error)[^\n]{0,200}", 0)
    return _docs(spark, d).select("doc_id", F.when(s != "", s).alias("snippet"))


# -- likeness

_QUERIES = ["kiln slow after step", "route planner fell behind the writer", "merge worker went silent", "drain time settled"]
_QV = "(values " + ", ".join(f"({i}, '{q}')" for i, q in enumerate(_QUERIES)) + ") q(qid, q)"
_QTOK = "list_filter(string_split(regexp_replace(lower(q), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda w: len(w) > 2)"


@query(f"select qid, doc_id, round(len(list_intersect({_QTOK}, {_TOK})) / len(list_distinct(list_concat({_QTOK}, {_TOK}))) * 100) score from {_D} join {_QV} on len(list_intersect({_QTOK}, {_TOK})) >= 3")
def txt_token_jaccard(spark, d):
    """Token likeness of each document to a fixed list of queries, from three common tokens on; one scan for all queries."""
    docs = _docs(spark, d).withColumn("t", F.array_distinct(tx.tokens(F.col("text"))))
    scored = F.array(*[_jaccard_row(i, q) for i, q in enumerate(_QUERIES)])
    return docs.select("doc_id", F.explode(scored).alias("r")).where("r.common >= 3").select(F.col("r.qid").alias("qid"), "doc_id", "r.score")


def _jaccard_row(i: int, q: str) -> Column:
    words = sorted({w for w in q.split() if len(w) > 2})
    common = F.size(F.array_intersect("t", F.array(*[F.lit(w) for w in words])))
    return F.struct(F.lit(i).alias("qid"), common.alias("common"), F.round(common / (F.size("t") + len(words) - common) * 100).alias("score"))


@query("select a.pred, b.id, b.w word, least(100, round((1 - levenshtein(a.pred, b.w) / greatest(len(a.pred), len(b.w))) * 100)) ratio from (select distinct split_part(lower(trim(pred)), '.', 1) pred from predicates) a join (select distinct id, unnest(string_split(raw_input, ' ')) w from stories where raw_input is not null and id is not null) b on levenshtein(a.pred, b.w) <= 2 and len(a.pred) > 0 and len(b.w) > 0")
def txt_edit_matches(spark, d):
    """The words of stories within two edits of a device name: compared per distinct word only."""
    s = load(spark, d, "stories").where("raw_input is not null and id is not null").select("id", F.explode(F.split("raw_input", " ")).alias("w")).distinct()
    p = load(spark, d, "predicates").select(F.split(F.lower(F.trim("pred")), "[.]")[0].alias("pred")).distinct()
    # at most two edits leave one of three parts whole, which stands within two places
    words = s.select("w").where(F.length("w") > 0).distinct()
    a, b = _parts(p.where(F.length("pred") > 0), "pred"), _parts(words, "w", 2)
    hits = a.join(b, ["size", "part", "at"]).select("pred", "w").distinct().where(F.levenshtein("pred", "w") <= 2)
    return hits.join(s, "w").select("pred", "id", F.col("w").alias("word"), tx.edit_ratio(F.col("pred"), F.col("w")).alias("ratio"))


def _parts(df: DataFrame, col: str, slack: int = 0, edits: int = 2) -> DataFrame:
    """One part more of each word than edits, cut by its length, with their places; with slack, also for lengths and places off by so much. One of them is left whole by so many edits."""
    n = F.length(col)
    sizes = F.explode(F.sequence(n - slack, n + slack)) if slack else F.explode(F.array(n))
    k = df.select(col, sizes.alias("size")).where("size > 0").select(col, "size", F.explode(F.sequence(F.lit(0), F.lit(edits))).alias("i"))
    lo, hi = F.floor(F.col("i") * F.col("size") / (edits + 1)), F.floor((F.col("i") + 1) * F.col("size") / (edits + 1))
    k = k.select(col, "size", lo.cast("int").alias("at"), (hi - lo).cast("int").alias("len"))
    off = F.explode(F.sequence(F.lit(-slack), F.lit(slack))) if slack else F.explode(F.array(F.lit(0)))
    return k.select(col, "size", "at", "len", off.alias("off")).select(col, "size", "at", F.substring(F.col(col), F.col("at") + F.col("off") + 1, F.col("len")).alias("part")).distinct()


_NAMES = "(select distinct lower(trim(f.pred)) p from (select unnest(facts) f from observations) where f.pred is not null and len(trim(f.pred)) > 0 union select distinct lower(trim(pred)) from predicates where len(trim(pred)) > 0)"


@query(f"select a.p a, b.p b, round((1 - levenshtein(a.p, b.p) / greatest(len(a.p), len(b.p))) * 100) ratio from {_NAMES} a join {_NAMES} b on a.p < b.p and levenshtein(a.p, b.p) <= 3")
def txt_similar_predicates(spark, d):
    """Pairs of predicate names, listed or observed, within three edits: those that share one of four parts near its place are compared."""
    seen = load(spark, d, "observations").select(F.explode("facts").alias("f")).select(F.lower(F.trim("f.pred")).alias("p"))
    names = materialize(seen.unionByName(load(spark, d, "predicates").select(F.lower(F.trim("pred")).alias("p"))).where(F.length("p") > 0).distinct(), "names")
    a, b = _parts(names.withColumnRenamed("p", "a"), "a", edits=3), _parts(names.withColumnRenamed("p", "b"), "b", 3, edits=3)
    hits = a.join(b, ["size", "part", "at"]).where("a < b").select("a", "b").distinct().where(F.levenshtein("a", "b") <= 3)
    return hits.select("a", "b", tx.edit_ratio(F.col("a"), F.col("b")).alias("ratio"))


@query("select * from (select 'kiln slow' query, id, least(100, 80.0 * (case when contains(t, 'kiln') then 1 else 0 end + case when contains(t, 'slow') then 1 else 0 end) / 2 + case when contains(t, 'kiln slow') then 20 else 0 end) score from (select distinct id, lower(raw_input) t from stories where raw_input is not null and id is not null)) where score >= 30")
def txt_inline_match(spark, d):
    """Share of the query's tokens that occur in a text, and a bonus if it occurs whole."""
    words, q = ["kiln", "slow"], "kiln slow"
    t = F.lower("raw_input")
    hits = sum((F.when(t.contains(w), 1).otherwise(0) for w in words), F.lit(0))
    score = F.least(F.lit(100.0), 80.0 * hits / len(words) + F.when(t.contains(q), 20).otherwise(0))
    return load(spark, d, "stories").where("raw_input is not null and id is not null").select(F.lit(q).alias("query"), "id", score.alias("score")).distinct().where("score >= 30")


# -- windows and samples


@query(f"select doc_id, at_ start, len(list_intersect(list_filter(string_split(lower(regexp_replace(w, '[^A-Za-z0-9_]+', ' ', 'g')), ' '), lambda x: len(x) > 2), ['rule', 'explains', 'writer'])) hits from (select doc_id, s at_, substr(text, s + 1, 500) w from {_D}, unnest(range(0, greatest(length(text) - 499, 1), 250)) r(s)) where hits > 0")
def txt_window_anchors(spark, d):
    """Sliding windows of 500 characters, 250 apart, with how many query words they have."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 500, F.lit(0)), F.lit(250))
    w = _docs(spark, d).select("doc_id", "text", F.explode(starts).alias("start")).select("doc_id", "start", F.substring("text", F.col("start") + 1, F.lit(500)).alias("w"))
    hits = F.size(F.array_intersect(tx.tokens(F.col("w")), F.array(*[F.lit(x) for x in ("rule", "explains", "writer")])))
    return w.select("doc_id", F.col("start").cast("long").alias("start"), hits.cast("long").alias("hits")).where("hits > 0")


@query(f"select doc_id, i - 1 chunk, len(p) size from (select doc_id, unnest(ps) p, generate_subscripts(ps, 1) i from (select doc_id, list_filter(string_split(text, chr(10) || chr(10)), lambda p: len(trim(p)) > 10) ps from {_D}))")
def txt_chunks(spark, d):
    """Paragraphs of more than ten characters, in order."""
    ps = F.filter(F.split("text", "\n\n"), lambda p: F.length(F.trim(p)) > 10)
    return _docs(spark, d).select("doc_id", F.posexplode(ps).alias("chunk", "p")).select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.length("p").cast("long").alias("size"))


_SAMPLE = f"""with p as (select doc_id, unnest(ps) p, generate_subscripts(ps, 1) i from (select doc_id, list_filter(string_split(text, chr(10) || chr(10)), lambda p: len(trim(p)) > 10) ps from {_D})),
s as (select doc_id, i, len(list_filter(string_split(lower(regexp_replace(p, '[^A-Za-z0-9_]+', ' ', 'g')), ' '), lambda w: list_contains(['rule', 'support', 'observations'], w))) c from p),
b as (select doc_id, i, round(c + 0.1 * coalesce(lag(c) over w, 0) + 0.1 * coalesce(lead(c) over w, 0), 9) score from s window w as (partition by doc_id order by i))
select doc_id, i - 1 chunk, score from (select *, row_number() over (partition by doc_id order by score desc, i) rn from b where score > 0) where rn <= 3"""


@query(_SAMPLE)
def txt_evidence_sample(spark, d):
    """The three best paragraphs of each document for a query, a tenth of the neighbours' scores added."""
    ps = F.filter(F.split("text", "\n\n"), lambda p: F.length(F.trim(p)) > 10)
    words = F.array(*[F.lit(x) for x in ("rule", "support", "observations")])
    count = lambda p: F.size(F.filter(tx.tokens(p), lambda w: F.array_contains(words, w)))
    counts = _docs(spark, d).select("doc_id", F.transform(ps, count).alias("c"))
    at = lambda i: F.coalesce(F.get("c", i), F.lit(0))
    scored = F.transform("c", lambda x, i: F.struct((-F.round(x + 0.1 * at(i - 1) + 0.1 * at(i + 1), 9)).alias("neg"), i.alias("i")))
    best = F.slice(F.array_sort(F.filter(scored, lambda s: s["neg"] < 0)), 1, 3)
    return counts.select("doc_id", F.explode(best).alias("b")).select("doc_id", F.col("b.i").cast("long").alias("chunk"), (-F.col("b.neg")).alias("score"))


@query()
def txt_markdown_tables(spark, d):
    """Rows of Markdown tables in texts, with their cells."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"^\s*\|.*\|\s*$") & ~x.rlike(r"^[\s|:-]+$"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    return _docs(spark, d).select("doc_id", F.posexplode(lines).alias("row", "line")).select("doc_id", F.col("row").cast("long").alias("row"), F.array_join(cells, " ; ").alias("cells"))


@query("select id, raw_input, case when contains(lower(raw_input), 'slow') then 'performance' when contains(lower(raw_input), 'silent') or contains(lower(raw_input), 'stuck') then 'hang' when contains(lower(raw_input), 'noisy') then 'noise' else 'other' end category from (select distinct id, raw_input from stories where raw_input is not null and id is not null)")
def src_labelled_issues(spark, d):
    t = F.lower("raw_input")
    c = F.when(t.contains("slow"), "performance").when(t.contains("silent") | t.contains("stuck"), "hang").when(t.contains("noisy"), "noise").otherwise("other")
    return load(spark, d, "stories").where("raw_input is not null and id is not null").select("id", "raw_input", c.alias("category")).distinct()


@query("select id, key pred, val from (select distinct id, status, outcome, operator from stories where id is not null) unpivot (val for key in (status, outcome, operator)) where val not in ('unknown', 'none', 'other', 'medium')")
def src_wide_to_facts(spark, d):
    """A wide record as long facts, without empty and placeholder values."""
    t = load(spark, d, "stories").where("id is not null").select("id", "status", "outcome", "operator").distinct()
    return t.unpivot("id", ["status", "outcome", "operator"], "pred", "val").where("val is not null and val not in ('unknown', 'none', 'other', 'medium')")


# -- features, clusters, facts of lines, windows


@query(_TFIDF + f""", src as (select doc_id, lower(trim(source)) source from documents where source is not null), n as (select source, count(distinct doc_id) docs from src join (select distinct doc_id from w) using (doc_id) group by 1),
c as (select source, word, count(*) k, avg(tfidf) m from s join src using (doc_id) group by 1, 2)
select source, word, round(k / docs, 9) coverage, round(k / docs * m, 6) score from (select *, row_number() over (partition by source order by round(k / docs * m, 6) desc, word) rn from c join n using (source) where k / docs >= 0.5) where rn <= 5""")
def txt_cluster_predicates(spark, d):
    """The five terms of each source that at least half of its documents have, by coverage times mean weight."""
    s = load(spark, d, "documents").where("source is not null").select("doc_id", F.lower(strip(F.col("source"))).alias("source"))
    t = materialize(_tfidf(spark, d).join(s, "doc_id"), "weighted-words")
    n = t.groupBy("source").agg(F.count_distinct("doc_id").alias("docs"))
    c = t.groupBy("source", "word").agg(F.count("*").alias("k"), F.avg("tfidf").alias("m")).join(n, "source").withColumn("coverage", F.col("k") / F.col("docs")).where("coverage >= 0.5")
    c = c.withColumn("score", F.round(F.col("coverage") * F.col("m"), 6))
    rn = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "word"))  # two terms per keyword of a document at most
    return c.withColumn("rn", rn).where("rn <= 5").select("source", "word", F.round("coverage", 9).alias("coverage"), "score")


@query(f"""with p as ({_PATTERNS}), k as (select doc_id, word, row_number() over (partition by doc_id order by n desc, pos) rank from (select doc_id, word, count(*) n, min(pos) pos from {_W} group by 1, 2)),
pn as (select doc_id, count(*) n from p group by 1)
select d.doc_id, coalesce(pn.n, 0) patterns, least(15 - least(15, coalesce(pn.n, 0)), coalesce(kn.n, 0)) keywords from {_D} d left join pn using (doc_id) left join (select doc_id, count(*) n from k where rank <= 15 group by 1) kn using (doc_id)""")
def txt_hybrid_features(spark, d):
    """How many of the fifteen features of a text, patterns first and then its most frequent keywords, are of either kind."""
    patterns = _docs(spark, d).select("doc_id", F.size(tx.error_patterns(F.col("text"))).cast("long").alias("patterns"))
    words = _words(spark, d).select("doc_id", "word").distinct().groupBy("doc_id").agg(F.count("*").alias("words"))
    room = F.lit(15) - F.least(F.lit(15), F.col("patterns"))
    return patterns.join(words, "doc_id", "left").select("doc_id", "patterns", F.least(room, F.coalesce("words", F.lit(0))).cast("long").alias("keywords"))


_LINES = "(select doc_id, i - 1 line, trim(l) l from (select doc_id, unnest(string_split(text, chr(10))) l, generate_subscripts(string_split(text, chr(10)), 1) i from (select doc_id, text from documents where text is not null)) where len(trim(l)) > 0)"


def _lines(spark, d) -> DataFrame:
    """(doc_id, line, l): the lines of each text that are not blank."""
    return _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "l")).select("doc_id", F.col("line").cast("long").alias("line"), F.trim("l").alias("l")).where(F.length("l") > 0)


_CE = tx.CAUSE_EFFECT.replace("'", "''")


@query(rf"""select doc_id, line, case when len(a) >= 2 then trim(a[1]) when len(b) >= 2 then trim(b[1]) else l end cause, case when len(a) >= 2 then trim(array_to_string(a[2:], '，')) when len(b) >= 2 then trim(array_to_string(b[2:], '，')) else l end effect
from (select *, regexp_split_to_array(l, '{_CE}') a, list_filter(regexp_split_to_array(l, '[，,；;]\s*'), lambda x: len(trim(x)) > 0) b from {_LINES})""")
def txt_split_cause_effect(spark, d):
    """Each line at its connectives, else at its commas, into what comes first and what follows; a line without either is both."""
    cause, effect = tx.cause_and_effect(F.col("l"))
    return _lines(spark, d).select("doc_id", "line", cause.alias("cause"), effect.alias("effect"))


@query(rf"""select doc_id, line, case when len(u) >= 2 then try_cast(u[1] as double) when len(u) = 0 and len(n) >= 2 then try_cast(n[1] as double) end from_, case when len(u) >= 2 then try_cast(u[2] as double) when len(u) = 1 then try_cast(u[1] as double) when len(n) >= 2 then try_cast(n[2] as double) else try_cast(n[1] as double) end to_, case when len(u) >= 2 then k[2] when len(u) = 1 then k[1] end unit
from (select *, list_transform(regexp_extract_all(l, '{tx.NUMBER_UNIT}', 1), lambda x: regexp_extract(x, '[0-9]*\.?[0-9]*')) u, regexp_extract_all(l, '{tx.NUMBER_UNIT}', 2) k, list_transform(regexp_extract_all(l, '[0-9.]+'), lambda x: regexp_extract(x, '[0-9]*\.?[0-9]*')) n from {_LINES}) where len(n) > 0""")
def txt_magnitudes(spark, d):
    """The first two numbers with a unit of each line, or without where none has one: from what, to what, in which unit."""
    m = tx.magnitude(F.col("l"))
    return _lines(spark, d).where(F.col("l").rlike("[0-9.]")).select("doc_id", "line", m["from_"].alias("from_"), m["to_"].alias("to_"), m["unit"].alias("unit"))


@query(f"select doc_id, line, list_filter(regexp_extract_all(l, '{tx.MODULE}'), lambda m: len(m) > 3 and not regexp_full_match(m, '[0-9]+\\.[0-9]+'))[1] module from {_LINES} where len(list_filter(regexp_extract_all(l, '{tx.MODULE}'), lambda m: len(m) > 3 and not regexp_full_match(m, '[0-9]+\\.[0-9]+'))) > 0")
def txt_modules(spark, d):
    """The first path or dotted name of each line that is longer than three characters and no number."""
    return _lines(spark, d).withColumn("module", tx.module(F.col("l"))).where("module is not null").select("doc_id", "line", "module")


@query(rf"""with t as (select doc_id, line, cause, effect, l from (select *, case when len(a) >= 2 then trim(a[1]) when len(b) >= 2 then trim(b[1]) else l end cause, case when len(a) >= 2 then trim(array_to_string(a[2:], '，')) when len(b) >= 2 then trim(array_to_string(b[2:], '，')) else l end effect
  from (select *, regexp_split_to_array(l, '{_CE}') a, list_filter(regexp_split_to_array(l, '[，,；;]\s*'), lambda x: len(trim(x)) > 0) b from {_LINES})))
select doc_id, line, 'cause' pred, left(cause, 200) val from t union all select doc_id, line, 'effect', left(effect, 200) from t union all select doc_id, line, 'direction', {_DIR.replace("lower(text)", "lower(l)")} from t where {_DIR.replace("lower(text)", "lower(l)")} <> 'unknown'""")
def txt_line_facts(spark, d):
    """The facts of each line: its cause, its effect and, where it shows one, its direction."""
    cause, effect = tx.cause_and_effect(F.col("l"))
    way = tx.first_matching(F.col("l"), tx.DIRECTIONS, "unknown")
    facts = F.array(F.struct(F.lit("cause").alias("pred"), F.substring(cause, 1, 200).alias("val")), F.struct(F.lit("effect").alias("pred"), F.substring(effect, 1, 200).alias("val")), F.struct(F.lit("direction").alias("pred"), F.when(way != "unknown", way).alias("val")))
    return _lines(spark, d).select("doc_id", "line", F.inline(facts)).where("val is not null")


_FUZZ_TOK = lambda c: f"list_sort(list_distinct(list_filter(string_split(lower(regexp_replace({c}, '[^A-Za-z0-9_]+', ' ', 'g')), ' '), lambda w: len(w) > 2)))"
_RATIO = lambda a, b: f"case when greatest(len({a}), len({b})) > 0 then round((1 - levenshtein({a}, {b}) / greatest(len({a}), len({b}))) * 100) else 100 end"
# DuckDB measures edits in bytes: characters beyond ASCII, of which the queries have none, stand as one byte
_FUZZ = rf"""with x as (select q.qid, lower(q.q) q, s.id, s.t from (select distinct id, regexp_replace(lower(raw_input), '[^\x00-\x7F]', '~', 'g') t from stories where raw_input is not null and id is not null) s, {_QV}),
y as (select *, {_FUZZ_TOK('q')} tq, {_FUZZ_TOK('t')} tt from x), z as (select *, array_to_string(list_sort(list_intersect(tq, tt)), ' ') both_ from y),
v as (select *, trim(both_ || ' ' || array_to_string(list_sort(list_filter(tq, lambda w: not list_contains(tt, w))), ' ')) wq, trim(both_ || ' ' || array_to_string(list_sort(list_filter(tt, lambda w: not list_contains(tq, w))), ' ')) wt, case when len(q) <= len(t) then q else t end sh, case when len(q) <= len(t) then t else q end lg from z),
r as (select *, greatest({_RATIO('both_', 'wq')}, {_RATIO('both_', 'wt')}, {_RATIO('wq', 'wt')}) ts, case when len(sh) = 0 then case when len(lg) = 0 then 100 else 0 end else list_max(list_transform(range(1, len(lg) - len(sh) + 2), lambda i: round((1 - levenshtein(sh, substr(lg, i, len(sh))) / len(sh)) * 100))) end pr from v),
sc as (select qid, id, case when t = q then 100.0 when contains(t, q) then 90.0 else round(least(100.0, greatest(1.5 * ts, pr) / 1.5)) end score from r)"""


def _fuzzy(spark, d) -> DataFrame:
    s = load(spark, d, "stories").where("raw_input is not null and id is not null").select("id", F.lower("raw_input").alias("t")).distinct()
    rows = F.array(*[F.struct(F.lit(i).alias("qid"), tx.fuzzy_score(F.lit(q), F.col("t")).alias("score")) for i, q in enumerate(_QUERIES)])
    return s.select("id", F.explode(rows).alias("r")).select("r.qid", "id", "r.score")


@query(_FUZZ + " select qid, id, score from (select *, row_number() over (partition by qid order by score desc, id) rn from sc where score >= 30) where rn <= 10")
def txt_fuzzy_search(spark, d):
    """The ten stories most like each query of the query set: contained, alike in tokens, or alike in a piece; from 30 on."""
    rn = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return _fuzzy(spark, d).where("score >= 30").withColumn("rn", rn).where("rn <= 10").select("qid", "id", "score")


@query(_FUZZ + " select qid, id, score from sc")
def txt_similarity_matrix(spark, d):
    """The score of every story for each query of the query set."""
    return _fuzzy(spark, d)


_HASH = "cast('0x' || substr(md5({0}), 1, 8) as bigint)".format
_STRAT = f"""with t as (select doc_id, text, length(text) n, unnest(case when length(text) >= 1000 then range(0, 5) else range(0, 1) end) seg from {_D} where length(text) > 0),
st as (select doc_id, seg, cast(case when n >= 1000 then seg * floor(n / 5) + {_HASH("doc_id || '|' || seg || '|stratum'")} % greatest(cast(floor(n / 5) as bigint) - 199, 1) else 0 end as bigint) start, case when n >= 1000 then 200 else n end size from t)"""


def _strata(spark, d) -> DataFrame:
    """(doc_id, segment, start, size): a window per fifth of each text; a text of less than 1,000 characters is one window."""
    n = F.length("text")
    long = n >= 1000
    t = _docs(spark, d).where(n > 0).select("doc_id", n.cast("long").alias("n"), F.explode(F.when(long, F.sequence(F.lit(0), F.lit(4))).otherwise(F.array(F.lit(0)))).alias("segment"))
    width = F.floor(F.col("n") / 5).cast("long")
    start = F.when(F.col("n") >= 1000, F.col("segment") * width + hashed(F.col("doc_id"), F.col("segment"), F.lit("stratum")) % F.greatest(width - 199, F.lit(1))).otherwise(F.lit(0))
    return t.select("doc_id", "n", F.col("segment").cast("long").alias("segment"), start.cast("long").alias("start"), F.when(F.col("n") >= 1000, F.lit(200)).otherwise(F.col("n")).cast("long").alias("size"))


@query(_STRAT + " select doc_id, seg segment, start, size from st")
def txt_stratified_sample(spark, d):
    """One window of 200 characters per fifth of each text, at a place drawn from the document's id; a short text is its own window."""
    return _strata(spark, d).select("doc_id", "segment", "start", "size")


_GAUSS = _STRAT + f""", seed as (select doc_id, start from st where seg < 2 and size = 200), n as (select doc_id, length(text) n from {_D}), r as (select unnest(range(1, 3)) r), k as (select unnest(range(0, 3)) k),
g as (select doc_id, start seed, r, k, n, ({_HASH("doc_id || '|' || start || '|' || r || '|' || k || '|u'")} + 1) / 4294967297.0 u, {_HASH("doc_id || '|' || start || '|' || r || '|' || k || '|v'")} / 4294967296.0 v from seed join n using (doc_id), r, k)
select doc_id, seed, r "round", k draw, cast(least(greatest(floor(seed + 100 + n / 20.0 / pow(2, r - 1) * sqrt(-2 * ln(u)) * cos(2 * pi() * v)) - 100, 0), n - 200) as bigint) start from g"""


@query(_GAUSS)
def txt_gaussian_sample(spark, d):
    """Two rounds of three windows around the first two strata of each long text, at distances from a bell curve that halves its width each round."""
    seed = _strata(spark, d).where("size = 200 and segment < 2")
    t = seed.select("doc_id", "n", F.col("start").alias("seed"), F.explode(F.sequence(F.lit(1), F.lit(2))).alias("round")).select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("draw"))
    part = lambda x: hashed(F.col("doc_id"), F.col("seed"), F.col("round"), F.col("draw"), F.lit(x))
    u, v = (part("u") + 1) / 4294967297.0, part("v") / 4294967296.0
    center = F.floor(F.col("seed") + 100 + F.col("n") / 20.0 / F.pow(F.lit(2.0), F.col("round") - 1) * F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)) - 100
    return t.select("doc_id", "seed", F.col("round").cast("long").alias("round"), F.col("draw").cast("long").alias("draw"), F.least(F.greatest(center, F.lit(0)), F.col("n") - 200).cast("long").alias("start"))


@query()
def txt_packed_chunks(spark, d):
    """Each text in chunks of whole sentences, 200 characters or more where the paragraph has them; chunks of up to ten characters are left out."""
    return _docs(spark, d).mapInPandas(tx.packed_rows, "doc_id long, chunk long, start long, size long, text_md5 string")


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(O)
