"""Catalogue: text, search, ranking and path queries over the code view, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeweave.functions import scopes, text
from edgeweave.functions.question import Question, Term, parse, topics
from edgeweave.operators import rank, search
from edgeweave.plans import star_sql as sql
from edgeweave.schema import KINDS, qualified, symbol_key
from edgeweave.sources import views

QUERIES, SQL = {}, {}


def query(sql_text: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql_text is not None:
            SQL[f.__name__] = sql_text
        return f

    return add


PAGES = "SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS file FROM pages"


def page_files(spark: SparkSession, d: str) -> DataFrame:
    """Page addresses without their scheme as paths; some get the shapes that scopes are known by."""
    return views.table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("file"))


MARKED = "SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'vendor/' || file WHEN 1 THEN 'docs/' || file WHEN 2 THEN file || '/x_test.go' WHEN 3 THEN 'a/fixtures/' || file WHEN 4 THEN 'demo/' || file WHEN 5 THEN file || '.pb.go' WHEN 6 THEN 'src/contest.rs' WHEN 7 THEN 'dep:' || file ELSE file END AS file FROM (" + PAGES + ")"


def marked(spark: SparkSession, d: str) -> DataFrame:
    f = F.col("file")
    shapes = [F.concat(F.lit("vendor/"), f), F.concat(F.lit("docs/"), f), F.concat(f, F.lit("/x_test.go")), F.concat(F.lit("a/fixtures/"), f), F.concat(F.lit("demo/"), f), F.concat(f, F.lit(".pb.go")), F.lit("src/contest.rs"), F.concat(F.lit("dep:"), f), f]
    return page_files(spark, d).select("page_id", F.get(F.array(*shapes), (F.col("page_id") % 9).cast("int")).alias("file"))


@query(f"SELECT page_id, file, scope FROM {sql.scoped(MARKED)}")
def path_scope_classify(spark: SparkSession, d: str) -> DataFrame:
    return marked(spark, d).withColumn("scope", scopes.scope_of(F.col("file")))


RULES = (("*.html", "docs"), ("docs/**", "generated"), ("spam-*/**", "vendor"))


@query(f"SELECT page_id, CASE WHEN regexp_matches(file, '^spam-[^/]*/') THEN 'vendor' WHEN starts_with(file, 'docs/') THEN 'generated' WHEN regexp_matches(file, '(^|/)[^/]*\\.html(/|$)') THEN 'docs' ELSE scope END AS scope FROM {sql.scoped(MARKED)}")
def scope_override_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return marked(spark, d).select("page_id", scopes.scope_with_rules(F.col("file"), RULES).alias("scope"))


@query(f"SELECT page_id, array_to_string(list_filter(string_split_regex(file, '[:./?=&#]+'), lambda s: s <> ''), '|') AS parts FROM ({PAGES})")
def path_segments(spark: SparkSession, d: str) -> DataFrame:
    return page_files(spark, d).select("page_id", F.array_join(text.segments(F.col("file"), ":./?=&#"), "|").alias("parts"))


@query(f"SELECT page_id, string_split_regex(string_split(file, '::')[-1], '[/.]')[-1] AS tail FROM ({PAGES})")
def name_tail(spark: SparkSession, d: str) -> DataFrame:
    return page_files(spark, d).select("page_id", text.name_tail(F.col("file")).alias("tail"))


@query("SELECT page_id, CAST(length(html) - length(replace(html, chr(10), '')) + 1 AS INTEGER) AS line FROM pages")
def line_of_offset(spark: SparkSession, d: str) -> DataFrame:
    """The line of each page's end."""
    pages = views.table(spark, d, "pages").withColumn("byte", F.octet_length("html"))
    return pages.select("page_id", text.line_of(F.col("html"), F.col("byte")).cast("int").alias("line"))


GRAMS = "CASE WHEN length(name) < 3 THEN [lower(name)] ELSE list_sort(list_distinct(list_transform(range(1, length(name) - 1), lambda i: substr(lower(name), i, 3)))) END"


@query(f"WITH {sql.CODE_NODES} SELECT id, unnest({GRAMS}) AS gram FROM code_nodes")
def trigram_index(spark: SparkSession, d: str) -> DataFrame:
    return search.trigram_index(views.code_nodes(spark, d))


def grams_of(word: str) -> str:
    return GRAMS.replace("name", f"'{word}'")


def fuzzy_sql(words: list[str], limit: int) -> str:
    asked = " UNION ALL ".join(f"SELECT '{w}' AS query, {grams_of(w)} AS grams" for w in words)
    return f"""WITH {sql.CODE_NODES}, asked AS ({asked}), g AS (SELECT id, unnest({GRAMS}) AS gram FROM code_nodes),
s AS (SELECT query, len(grams) AS wanted, id, count(*) AS shared FROM (SELECT query, grams, unnest(grams) AS gram FROM asked) JOIN g USING (gram) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY shared DESC, id) AS rank FROM s)
SELECT query, id, shared, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {limit} AND 2 * shared >= wanted"""


@query(fuzzy_sql(["SmallRing", "redwidgt", "bolt", "xy"], 25))
def trigram_search_topk(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame([("SmallRing",), ("redwidgt",), ("bolt",), ("xy",)], "query string")
    return search.fuzzy(search.trigram_index(views.code_nodes(spark, d)), asked, 25)


CAMEL = "list_filter(string_split(lower(regexp_replace(regexp_replace({0}, '(\\P{{Lu}})(\\p{{Lu}})', '\\1 \\2', 'g'), '(\\p{{Lu}})(\\p{{Lu}}\\p{{Ll}})', '\\1 \\2', 'g')), ' '), lambda w: w <> '')"
IDENT = "list_filter(string_split_regex(lower(regexp_replace(regexp_replace({0}, '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g'), '(\\p{{Lu}})(\\p{{Lu}}\\p{{Ll}})', '\\1 \\2', 'g')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
TOKENS = f"""SELECT DISTINCT id, word FROM (SELECT id, unnest(list_concat({CAMEL.format('w')}, [lower(w)])) AS word FROM (
  SELECT id, unnest(string_split_regex(concat_ws(' ', name, signature, file, doc), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM code_nodes) WHERE w <> '') WHERE length(word) >= 2"""


@query(f"WITH {sql.CODE_NODES} {TOKENS}")
def token_index(spark: SparkSession, d: str) -> DataFrame:
    return search.token_index(views.code_nodes(spark, d))


@query(f"WITH {sql.CODE_NODES} SELECT DISTINCT id FROM ({TOKENS}) WHERE word IN ('rings', 'ring', 'promo')")
def token_recall(spark: SparkSession, d: str) -> DataFrame:
    return search.with_terms(search.token_index(views.code_nodes(spark, d)), ["rings", "promo"])


@query(f"SELECT doc_id, array_to_string({CAMEL.format('text')}, '|') AS camel, array_to_string({IDENT.format('text')}, '|') AS ident FROM documents")
def word_splits(spark: SparkSession, d: str) -> DataFrame:
    rows = views.table(spark, d, "documents")
    return rows.select("doc_id", F.array_join(text.camel_words(F.col("text")), "|").alias("camel"), F.array_join(text.identifier_words(F.col("text")), "|").alias("ident"))


@query(f"WITH {sql.CODE_NODES} SELECT id, regexp_extract(id, '^[^#]*#(.*)@[^@]*$', 1) AS qualified, 'symbol:' || kind || ':' || strlen(file) || ':' || file || '#' || regexp_extract(id, '^[^#]*#(.*)@[^@]*$', 1) AS key FROM code_nodes")
def symbol_keys(spark: SparkSession, d: str) -> DataFrame:
    nodes = views.code_nodes(spark, d)
    return nodes.select("id", qualified(F.col("id")).alias("qualified"), symbol_key(F.col("kind"), F.col("file"), F.col("id")).alias("key"))


@query(f"WITH {sql.CODE_NODES} SELECT id, 'exact' AS resolution FROM code_nodes WHERE name = 'SmallRing' AND suffix(file, '.py') AND (SELECT count(*) FROM code_nodes WHERE regexp_extract(id, '^[^#]*#(.*)@[^@]*$', 1) = 'SmallRing') = 0")
def symbol_lookup(spark: SparkSession, d: str) -> DataFrame:
    return search.find_symbol(views.code_nodes(spark, d), "SmallRing@.py").select("id", "resolution")


@query(f"WITH {sql.CODE_NODES} SELECT id FROM code_nodes WHERE name = 'RedWidget'")
def exact_name(spark: SparkSession, d: str) -> DataFrame:
    return search.named(views.code_nodes(spark, d), "RedWidget").select("id")


# Ranking -------------------------------------------------------------------------------------------------------

NOUNS, VERBS, MIXED = "small ring promo", "find parse of steel bolts or red widget", "small ring, red widget; promo bolt"


def ors(xs: list[str]) -> str:
    return "(" + (" OR ".join(xs) or "false") + ")"


def match_sql(t: Term, w: str) -> str:
    same = [f"{w} = '{v}'" for v in t.variants] + [f"starts_with({w}, '{v}')" for v in t.variants if len(v.encode()) >= 4]
    short = [f"starts_with('{c}', {w})" for c in t.core if len(c.encode()) >= 6]
    return ors([*same, f"(strlen({w}) >= 3 AND {ors(short)})"])


def occurs_sql(t: Term, x: str) -> str:
    return ors([f"contains({x}, '{v}')" for v in t.variants])


def any_sql(items: str, test: str) -> str:
    return f"len(list_filter({items}, lambda w: {test})) > 0"


def score_sql(q: Question) -> str:
    """CTEs up to hits: every candidate with its points, before reranking."""
    words = sorted({v for t in q.terms for v in t.variants})
    recall = sorted({*words, *(w[:-1] for w in words if w.endswith("s") and len(w) > 1)})
    inlist = lambda xs: ", ".join(f"'{x}'" for x in xs)
    asked = " UNION ALL ".join(f"SELECT '{w}' AS query, {grams_of(w)} AS grams" for w in words)
    owners = " UNION ALL ".join(f"SELECT '{v}' AS query, {i} AS term" for i, t in enumerate(q.terms) for v in t.variants)
    flags, points = [], []
    for i, t in enumerate(q.terms):
        exact, close = f"(name_l IN ({inlist(t.variants)}))", f"({any_sql('toks', match_sql(t, 'w'))} OR {occurs_sql(t, 'name_l')} OR list_contains(close, {i}))"
        own, doc, sig = f"(owner <> '' AND {occurs_sql(t, 'owner')})", occurs_sql(t, "doc_l"), occurs_sql(t, "sig_l")
        path = f"({any_sql('path_l', occurs_sql(t, 'w'))})"
        points.append(f"CASE WHEN {exact} THEN 100 WHEN {close} THEN 60 WHEN {own} THEN 45 ELSE 0 END + CASE WHEN {doc} THEN 40 ELSE 0 END + CASE WHEN {sig} THEN 30 ELSE 0 END + CASE WHEN {path} THEN 25 ELSE 0 END")
        if t.action:
            whole = any_sql("toks", f"w IN ({inlist(t.core)})")
            points.append(f"CASE WHEN {whole} THEN 70 WHEN {exact} OR {close} THEN 25 ELSE 0 END")
        flags.append(f"CASE WHEN {ors([exact, close, own, doc, sig, path])} THEN '{t.surface}' END")
    hit = f"len(list_filter(toks, lambda w: {ors([match_sql(t, 'w') for t in q.terms])}))"
    points.append(f"CASE WHEN {hit} > 0 THEN 40 * (2 * {hit} - len(toks)) // len(toks) ELSE 0 END")
    for a, b in q.phrases:
        x, y = q.terms[a], q.terms[b]
        points.append(f"CASE WHEN len(list_filter(range(1, len(toks)), lambda i: {match_sql(x, 'toks[i]')} AND {match_sql(y, 'toks[i + 1]')})) > 0 THEN 20 ELSE 0 END")
        both = ors([f"contains(doc_l, '{u} {v}')" for u in x.variants for v in y.variants])
        points.append(f"CASE WHEN {both} THEN 10 ELSE 0 END")
    if q.action:
        kn, kd = "CASE WHEN kind IN ('function', 'method', 'macro') THEN 3 WHEN kind IN ('struct', 'class', 'enum', 'interface', 'trait', 'typealias', 'module', 'file') THEN 1 WHEN kind = 'section' THEN 1 ELSE 7 END", "CASE WHEN kind IN ('function', 'method', 'macro') THEN 2 WHEN kind IN ('struct', 'class', 'enum', 'interface', 'trait', 'typealias', 'module', 'file') THEN 1 WHEN kind = 'section' THEN 2 ELSE 10 END"
    else:
        kn, kd = "CASE WHEN kind IN ('struct', 'class', 'enum', 'interface', 'trait', 'typealias') THEN 3 WHEN kind IN ('function', 'method', 'macro') THEN 6 WHEN kind IN ('module', 'file') THEN 1 ELSE 7 END", "CASE WHEN kind IN ('struct', 'class', 'enum', 'interface', 'trait', 'typealias') THEN 2 WHEN kind IN ('function', 'method', 'macro') THEN 5 WHEN kind IN ('module', 'file') THEN 1 ELSE 10 END"
    return f"""WITH {sql.CODE_NODES}, {sql.CODE_EDGES}, asked AS ({asked}), owners AS ({owners}), g AS (SELECT id, unnest({GRAMS}) AS gram FROM code_nodes),
s AS (SELECT query, len(grams) AS wanted, id, count(*) AS shared FROM (SELECT query, grams, unnest(grams) AS gram FROM asked) JOIN g USING (gram) GROUP BY ALL),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY shared DESC, id) AS rank FROM s) WHERE rank <= 25 AND 2 * shared >= wanted),
cl AS (SELECT id, list_distinct(list(term)) AS close FROM near JOIN owners USING (query) GROUP BY id),
cand AS (SELECT id, coalesce(close, []) AS close FROM (SELECT DISTINCT id FROM ({TOKENS}) WHERE word IN ({inlist(recall)})) FULL JOIN cl USING (id)),
inn AS (SELECT dst AS id, count(*) AS n_in, min(src) FILTER (relation = 'contains') AS parent FROM code_edges GROUP BY dst),
f AS (SELECT n.*, close, coalesce(n_in, 0) AS n_in, parent, lower(name) AS name_l, coalesce(string_split(regexp_extract(lower(regexp_extract(n.id, '^[^#]*#(.*)@[^@]*$', 1)), '^(.*)::', 1), '::')[-1], '') AS owner,
  {IDENT.format('name')} AS toks, substr(lower(coalesce(doc, '')), 1, 400) AS doc_l, lower(signature) AS sig_l, string_split_regex(lower(file), '[/.]') AS path_l FROM code_nodes n JOIN cand USING (id) LEFT JOIN inn USING (id)),
p AS (SELECT *, {' + '.join(points)} AS evidence, list_filter([{', '.join(flags)}], lambda x: x IS NOT NULL) AS matched, {kn} AS kn, {kd} AS kd FROM f),
hits0 AS (SELECT *, evidence * len(matched) * kn // ({len(q.terms)} * kd) + least(n_in, 20) AS score0 FROM p WHERE evidence <> 0),
par AS (SELECT up, count(*) AS n, max(score0) AS best FROM (
  SELECT parent AS up, score0 FROM hits0 WHERE parent IS NOT NULL
  UNION ALL SELECT u.up, h.score0 FROM hits0 h JOIN (SELECT name AS o, min(id) AS up FROM hits0 WHERE kind IN ('class', 'struct', 'interface', 'trait', 'enum') GROUP BY name HAVING count(*) = 1) u
    ON u.o = string_split(regexp_extract(regexp_extract(h.id, '^[^#]*#(.*)@[^@]*$', 1), '^(.*)::', 1), '::')[-1] AND u.up <> h.id) GROUP BY up HAVING count(*) >= 2),
hits AS (SELECT h.*, {'score0' if q.action else "CASE WHEN kind NOT IN ('file', 'module') AND best IS NOT NULL AND best + 1 > score0 THEN best + 1 ELSE score0 END"} AS score FROM hits0 h LEFT JOIN par ON up = h.id)"""


KIND_LIST = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
ORDER = f"score DESC, list_position({KIND_LIST}, kind), file, start, id"


def rerank_sql(q: Question) -> str:
    """CTEs up to final: score and matched after the callees of the leading rows."""
    gain = ", ".join(f"CASE WHEN NOT list_contains(matched, '{t.surface}') AND {any_sql('called', match_sql(t, 'w'))} THEN '{t.surface}' END" for t in q.terms)
    return f"""{score_sql(q)}, led AS (SELECT *, row_number() OVER (ORDER BY {ORDER}) AS pos FROM hits),
called AS (SELECT src AS id, list_distinct(flatten(list({IDENT.format("string_split(regexp_extract(dst, '^[^#]*#(.*)@[^@]*$', 1), '::')[-1]")}))) AS called FROM code_edges WHERE relation = 'calls' GROUP BY src),
gained AS (SELECT l.*, list_filter([{gain}], lambda x: x IS NOT NULL) AS gained FROM (SELECT led.*, coalesce(called, []) AS called FROM led LEFT JOIN called USING (id)) l),
final AS (SELECT * EXCLUDE (score, matched), CASE WHEN pos <= 30 THEN list_concat(matched, gained) ELSE matched END AS matched,
  CASE WHEN pos <= 30 AND len(gained) > 0 THEN (evidence + 30 * len(gained)) * (len(matched) + len(gained)) * kn // ({len(q.terms)} * kd) + least(n_in, 20) ELSE score END AS score FROM gained)"""


@query(score_sql(parse(NOUNS)) + " SELECT id, evidence, len(matched) AS matched_terms, score FROM hits")
def ask_family_boost(spark: SparkSession, d: str) -> DataFrame:
    q = parse(NOUNS)
    return rank.score(views.code_nodes(spark, d), views.code_edges(spark, d), q).select("id", "evidence", "matched_terms", "score")


@query(score_sql(parse("parse the small bolt")) + " SELECT id, evidence, len(matched) AS matched_terms, score FROM hits")
def ask_score(spark: SparkSession, d: str) -> DataFrame:
    q = parse("parse the small bolt")
    return rank.score(views.code_nodes(spark, d), views.code_edges(spark, d), q).select("id", "evidence", "matched_terms", "score")


RERANK_Q = parse("green gear promo")


@query(rerank_sql(RERANK_Q) + " SELECT id, len(matched) AS matched_terms, score FROM final")
def ask_callee_rerank(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = views.code_nodes(spark, d), views.code_edges(spark, d)
    return rank.rerank(rank.score(nodes, edges, RERANK_Q), edges, RERANK_Q).select("id", "matched_terms", "score")


@query(
    rerank_sql(RERANK_Q) + f""", two AS (SELECT list(score ORDER BY {ORDER}) AS s, first(len(matched) ORDER BY {ORDER}) AS m FROM (SELECT * FROM final ORDER BY {ORDER} LIMIT 2)),
m AS (SELECT s[1] - s[2] AS margin, (s[1] - s[2]) * 1000 // s[1] AS permille, m * 1000 // {len(RERANK_Q.terms)} AS coverage FROM two),
l AS (SELECT *, CASE WHEN permille >= 200 THEN 'high' WHEN permille >= 50 THEN 'medium' ELSE 'low' END AS level FROM m)
SELECT level, margin, permille, coverage, coverage < 500 OR level = 'low' AS abstain, CASE WHEN coverage < 500 THEN 'weak_term_coverage' WHEN level = 'low' THEN 'insufficient_calibration_sample' ELSE 'calibrated_ranking' END AS reason,
CASE WHEN coverage < 500 OR level = 'low' THEN 'abstain' ELSE 'verify' END AS decision FROM l"""
)
def ask_confidence(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = views.code_nodes(spark, d), views.code_edges(spark, d)
    return rank.assess(rank.rerank(rank.score(nodes, edges, RERANK_Q), edges, RERANK_Q), len(RERANK_Q.terms))


def merge_sql(question: str) -> str:
    parts = [f"SELECT '{q.label}' AS topic, {i} AS topic_no, id, kind, file, start, score FROM ({rerank_sql(q)} SELECT * FROM final)" for i, q in enumerate(topics(question))]
    return f"""WITH h AS ({' UNION ALL '.join(parts)}), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, topic_no) AS k FROM h)
SELECT topic, id, score, CAST(row_number() OVER (PARTITION BY topic_no ORDER BY {ORDER}) AS INTEGER) AS rank FROM b WHERE k = 1"""


@query(merge_sql(MIXED))
def ask_topic_merge(spark: SparkSession, d: str) -> DataFrame:
    return rank.ask(views.code_nodes(spark, d), views.code_edges(spark, d), MIXED).select("topic", "id", "score", "rank")
