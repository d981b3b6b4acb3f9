"""Concept graph and router. Nodes are regions, nations, suppliers and customers; edges say "is part of"."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import graph as G
from quarry.operators import router as R
from quarry.plans import base as X

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


GRAPH_CTE = """
nodes AS (SELECT 'region:' || r_regionkey AS id, r_name AS label, r_name AS section_id FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, NULL FROM supplier UNION ALL SELECT 'customer:' || c_custkey, c_name, NULL FROM customer),
edges AS (SELECT n_nationkey::BIGINT AS edge_idx, 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'is part of' AS relation FROM nation
  UNION ALL SELECT 1000000000 + s_suppkey, 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'supplies from' FROM supplier
  UNION ALL SELECT 2000000000 + c_custkey, 'customer:' || c_custkey, 'nation:' || c_nationkey, 'lives in' FROM customer),
adj AS (SELECT src AS node, dst AS other, edge_idx, relation, true AS forward FROM edges UNION ALL SELECT dst, src, edge_idx, relation, false FROM edges)
"""


def nodes(spark: SparkSession, d: str) -> DataFrame:
    name = lambda kind, key: F.concat(F.lit(kind + ":"), F.col(key).cast("string")).alias("id")
    region = X.table(spark, d, "region")
    none = F.lit(None).cast("string").alias("section_id")
    out = region.select(name("region", "r_regionkey"), F.col("r_name").alias("label"), F.col("r_name").alias("section_id"))
    nation = X.table(spark, d, "nation").join(F.broadcast(region), F.col("r_regionkey") == F.col("n_regionkey"))
    out = out.unionByName(nation.select(name("nation", "n_nationkey"), F.col("n_name").alias("label"), F.col("r_name").alias("section_id")))
    out = out.unionByName(X.table(spark, d, "supplier").select(name("supplier", "s_suppkey"), F.col("s_name").alias("label"), none))
    return out.unionByName(X.table(spark, d, "customer").select(name("customer", "c_custkey"), F.col("c_name").alias("label"), none))


def edges(spark: SparkSession, d: str) -> DataFrame:
    def part(table: str, base: int, key: str, kind: str, to: str, to_kind: str, relation: str) -> DataFrame:
        return X.table(spark, d, table).select(
            (F.col(key).cast("long") + base).alias("edge_idx"),
            F.concat(F.lit(kind + ":"), F.col(key).cast("string")).alias("src"),
            F.concat(F.lit(to_kind + ":"), F.col(to).cast("string")).alias("dst"),
            F.lit(relation).alias("relation"),
        )

    return (
        part("nation", 0, "n_nationkey", "nation", "n_regionkey", "region", "is part of")
        .unionByName(part("supplier", 1_000_000_000, "s_suppkey", "supplier", "s_nationkey", "nation", "supplies from"))
        .unionByName(part("customer", 2_000_000_000, "c_custkey", "customer", "c_nationkey", "nation", "lives in"))
    )


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier with the customer of the same number."""
    key = F.col("s_suppkey").cast("string")
    return X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("pair"), F.concat(F.lit("supplier:"), key).alias("a"), F.concat(F.lit("customer:"), key).alias("b"))


@query(f"WITH {GRAPH_CTE} SELECT edge_idx, src, dst, relation FROM edges")
def scan_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d)


@query(f"WITH {GRAPH_CTE} SELECT node, other, edge_idx, relation, forward FROM adj")
def graph_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return G.adjacency(edges(spark, d))


@query(f"WITH {GRAPH_CTE} SELECT node, other, edge_idx, relation, forward FROM adj WHERE node LIKE 'nation:%' AND (forward OR node <> other)")
def graph_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return G.neighbors(edges(spark, d), nodes(spark, d).where(F.col("id").startswith("nation:")).select(F.col("id").alias("node")))


@query(f"WITH {GRAPH_CTE} SELECT DISTINCT section_id, edge_idx, src, dst, relation FROM edges JOIN nodes ON section_id IS NOT NULL AND id IN (src, dst)")
def graph_section_map(spark: SparkSession, d: str) -> DataFrame:
    return G.section_map(nodes(spark, d), edges(spark, d))


PATH_CTE = f"""{GRAPH_CTE},
pairs AS (SELECT s_suppkey AS pair, 'supplier:' || s_suppkey AS a, 'customer:' || s_suppkey AS b FROM supplier JOIN customer ON c_custkey = s_suppkey),
deg AS (SELECT node FROM adj GROUP BY node HAVING count(DISTINCT other) > 1),
walk AS (SELECT pair, b, a AS here, []::BIGINT[] AS path, [a] AS seen FROM pairs
  UNION ALL SELECT w.pair, w.b, e.other, list_append(w.path, e.edge_idx), list_append(w.seen, e.other) FROM walk w JOIN adj e ON e.node = w.here
  WHERE w.here <> w.b AND len(w.path) < 6 AND NOT list_contains(w.seen, e.other) AND (e.other = w.b OR e.other IN (SELECT node FROM deg))),
paths AS (SELECT pair, arg_min(path, (len(path), path)) AS path FROM walk WHERE here = b GROUP BY pair)
"""


@query(f"WITH RECURSIVE {PATH_CTE} SELECT pair, len(path)::BIGINT AS steps, array_to_string(list_transform(path, lambda e: e::VARCHAR), ',') AS path FROM paths")
def graph_shortest_path(spark: SparkSession, d: str) -> DataFrame:
    found = G.shortest_paths(edges(spark, d), pairs(spark, d))
    return found.select("pair", F.size("path").cast("long").alias("steps"), F.array_join(F.transform("path", lambda e: e.cast("string")), ",").alias("path"))


@query(
    f"WITH RECURSIVE {PATH_CTE}, e AS (SELECT pair, generate_subscripts(path, 1) - 1 AS step, unnest(path) AS edge_idx FROM paths) "
    "SELECT pair, step::BIGINT AS step, CASE WHEN up THEN src ELSE dst END AS src, CASE WHEN up THEN dst ELSE src END AS dst, relation, up AS forward "
    "FROM (SELECT e.pair, e.step, x.*, x.src = p.a OR x.src LIKE 'nation:%' AND e.step = 1 AND len(q.path) > 2 AS up FROM e JOIN edges x USING (edge_idx) JOIN pairs p ON p.pair = e.pair JOIN paths q ON q.pair = e.pair)"
)
def graph_path_steps(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    p = pairs(spark, d)
    return G.path_steps(G.shortest_paths(e, p), p, e).withColumn("step", F.col("step").cast("long"))


# --- router ---------------------------------------------------------------------------------------------------------

#: Questions by rule: a template per supplier, filled with its nation and region.
TEMPLATES = (
    "How is {n} related to {r}?", "Summarize the whole document", "Quiz me on {r}", "Where is {n} discussed?", "What is {n}?", "Explain this simply",
    "Key points of {r}", "What are the main concepts of {r}?", "Which topics are related to {n}?", "Give me the gist of this section", "Find {n} and {r} here", "Why does {n} depend on everything?",
)
QUESTIONS_SQL = "questions AS (SELECT s_suppkey AS query, CASE s_suppkey % 12 " + " ".join(
    f"WHEN {i} THEN replace(replace('{t}', '{{n}}', n_name), '{{r}}', r_name)" for i, t in enumerate(TEMPLATES)
) + " END AS text, CASE WHEN s_suppkey % 2 = 1 THEN r_name END AS current_section FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)"


def questions(spark: SparkSession, d: str) -> DataFrame:
    region = F.broadcast(X.table(spark, d, "region"))
    nation = F.broadcast(X.table(spark, d, "nation").join(region, F.col("r_regionkey") == F.col("n_regionkey")))
    s = X.table(spark, d, "supplier").join(nation, F.col("n_nationkey") == F.col("s_nationkey"))
    text = F.lit(None).cast("string")
    for i, t in enumerate(TEMPLATES):
        filled = F.replace(F.replace(F.lit(t), F.lit("{n}"), F.col("n_name")), F.lit("{r}"), F.col("r_name"))
        text = F.when(F.col("s_suppkey") % 12 == i, filled).otherwise(text)
    return s.select(F.col("s_suppkey").alias("query"), text.alias("text"), F.lit("en").alias("lang"), F.when(F.col("s_suppkey") % 2 == 1, F.col("r_name")).alias("current_section"))


def names(spark: SparkSession, d: str) -> DataFrame:
    """Names of regions and nations (concepts), then of sections; regions are sections."""
    found = nodes(spark, d).where(F.col("id").rlike("^(region|nation):"))
    number = F.element_at(F.split("id", ":"), 2).cast("int")
    concept = found.select(
        (F.when(F.col("id").startswith("region"), 0).otherwise(1000) + number).alias("name_id"), T.analyze(F.col("label")).alias("terms"), F.col("id").alias("node"), "section_id"
    )
    section = X.table(spark, d, "region").select((F.col("r_regionkey").cast("int") + 100_000).alias("name_id"), T.analyze(F.col("r_name")).alias("terms"), F.lit(None).cast("string").alias("node"), F.col("r_name").alias("section_id"))
    return concept.unionByName(section)


NAMES_CTE = f"""{GRAPH_CTE}, {QUESTIONS_SQL},
names AS (SELECT CASE WHEN id LIKE 'region%' THEN 0 ELSE 1000 END + string_split(id, ':')[2]::INT AS name_id, {X.analyze_sql('label')} AS terms, id AS node, section_id FROM nodes WHERE regexp_matches(id, '^(region|nation):')
  UNION ALL SELECT r_regionkey::INT + 100000, {X.analyze_sql('r_name')}, NULL, r_name FROM region),
asked AS (SELECT query, {X.analyze_sql('text')} AS q FROM questions),
spots AS (SELECT query, q, generate_subscripts(q, 1) - 1 AS pos FROM asked),
cands AS (SELECT query, pos, name_id, node, section_id, len(terms) AS n FROM spots JOIN names ON q[pos + 1 : pos + len(terms)] = terms AND len(terms) > 0),
hits AS (SELECT * FROM cands c WHERE NOT EXISTS (SELECT 1 FROM cands o WHERE o.query = c.query AND o.pos < c.pos + c.n AND c.pos < o.pos + o.n AND (o.n > c.n OR (o.n = c.n AND (o.name_id < c.name_id)))))
"""


@query(f"WITH {NAMES_CTE} SELECT query, pos::BIGINT AS pos, name_id::BIGINT AS name_id, node, section_id FROM hits")
def match_names(spark: SparkSession, d: str) -> DataFrame:
    found = R.match_names(questions(spark, d), names(spark, d))
    return found.select("query", F.col("pos").cast("long").alias("pos"), F.col("name_id").cast("long").alias("name_id"), "node", "section_id")


def _like(name: str) -> str:
    return "regexp_matches(t, '" + R.PATTERNS[name].replace("'", "''") + "')"


ROUTE_CTE = f"""{NAMES_CTE},
per AS (SELECT query, arg_min(section_id, pos) FILTER (section_id IS NOT NULL) AS named, count(DISTINCT node) AS n_concepts FROM hits GROUP BY query),
looked AS (SELECT q.query, trim(lower(left(text, 1000))) AS t, current_section, named, coalesce(n_concepts, 0) AS n_concepts FROM questions q LEFT JOIN per USING (query)),
routed AS (SELECT query, n_concepts, CASE WHEN {_like('quiz')} THEN 'quiz' WHEN {_like('simple')} THEN 'simple' WHEN {_like('keyPoints')} THEN 'keyPoints' WHEN {_like('summary')} THEN 'summary'
  WHEN {_like('relation')} AND n_concepts >= 2 THEN 'relation' WHEN {_like('concepts')} OR ({_like('relation')} AND n_concepts = 1 AND {_like('related')}) THEN 'concepts' WHEN {_like('find')} THEN 'find' ELSE 'question' END AS intent,
  CASE WHEN {_like('wholeDoc')} THEN 'document' WHEN {_like('thisSection')} OR named IS NULL THEN 'current' ELSE 'named' END AS scope, named, current_section FROM looked)
"""


@query(f"WITH {ROUTE_CTE} SELECT query, intent, n_concepts FROM routed")
def route_intent(spark: SparkSession, d: str) -> DataFrame:
    return R.route(questions(spark, d), names(spark, d)).select("query", "intent", F.size("concepts").cast("long").alias("n_concepts"))


@query(f"WITH {ROUTE_CTE} SELECT query, scope, CASE scope WHEN 'named' THEN named WHEN 'current' THEN current_section END AS section_id FROM routed")
def route_scope(spark: SparkSession, d: str) -> DataFrame:
    return R.route(questions(spark, d), names(spark, d)).select("query", "scope", "section_id")


@query(
    f"WITH {GRAPH_CTE}, {QUESTIONS_SQL}, p AS (SELECT id, ' ' || array_to_string({X.analyze_sql('label')}, ' ') || ' ' AS p FROM nodes WHERE id LIKE 'nation:%'), "
    f"s AS (SELECT query, ' ' || array_to_string({X.analyze_sql('text')}, ' ') || ' ' AS s FROM questions) SELECT query, id AS node FROM s JOIN p ON contains(s, p)"
)
def mentions_phrase(spark: SparkSession, d: str) -> DataFrame:
    """Which nations a question mentions: candidates by first term, then the phrase test."""
    phrase = nodes(spark, d).where(F.col("id").startswith("nation:")).select(F.col("id").alias("node"), T.analyze(F.col("label")).alias("p"))
    asked = questions(spark, d).select("query", T.analyze(F.col("text")).alias("t"))
    first = asked.select("query", "t", F.explode(F.array_distinct("t")).alias("term"))
    return first.join(phrase.withColumn("term", F.col("p")[0]), "term").where(T.contains_phrase(F.col("t"), F.col("p"))).select("query", "node")
