"""Every relational operator applied to the star-schema, event and text tables, with the SQL that each query equals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import graph as G
from ..operators import ledger as L
from ..operators import relational as R
from ..operators.intervals import contained
from ..session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[run.__name__], ORACLE_SQL[run.__name__] = run, sql
        return run

    return add


# Kinds that the corpus holds, beside the fixed ones; patterns stay in what RE2 and Java's regular expressions share.
SECRETS = (*S.SECRET_PATTERNS, ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), ("ipv4", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"), ("hex40", r"\b[0-9a-f]{40}\b"))
SIGNALS = (("license", r"[Ll]icense"), ("address", r"https?://"), ("email", SECRETS[4][1]), ("table", r" \| "), ("shouting", r"[A-Z]{6,}"))


def _kinds(patterns) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{k}'" for k, p in patterns) + " END"


@query(
    "WITH s AS (" + " UNION ALL ".join(f"SELECT '{k}' AS signal, doc_id FROM documents WHERE regexp_matches(text, '{p}')" for k, p in SIGNALS) + """)
SELECT signal, doc_id, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY doc_id) AS rank FROM s) WHERE rank <= 10"""
)
def triage_signals(spark, sf_dir):
    """The first ten documents with each sign; no sign at all would end a scan."""
    docs = table(spark, sf_dir, "documents")
    hits = F.filter(F.array(*[F.when(F.col("text").rlike(p), F.lit(k)) for k, p in SIGNALS]), lambda x: x.isNotNull())
    return R.top_per_key(docs.select("doc_id", F.explode(hits).alias("signal")), ["signal"], [F.col("doc_id")], 10).select("signal", "doc_id", "rank")


@query("SELECT lang, count(*) AS n_files, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY lang")
def language_census(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n_files"), F.sum("n_chars").alias("n_chars"))


@query(f"SELECT doc_id, {_kinds(SECRETS)} AS kind FROM documents WHERE {_kinds(SECRETS)} IS NOT NULL")
def secret_scan(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.first_kind(F.col("text"), SECRETS).alias("kind")).where(F.col("kind").isNotNull())


_REDACTED = "text"
for _kind, _pattern in SECRETS:
    _REDACTED = f"regexp_replace({_REDACTED}, '{_pattern}', '<redacted:{_kind}>', 'g')"


@query(f"SELECT doc_id, sha256({_REDACTED}) AS redacted_sha256 FROM documents WHERE {_kinds(SECRETS)} IS NOT NULL")
def secret_redaction(spark, sf_dir):
    """All seven kinds, in texts that hold any of them."""
    docs = table(spark, sf_dir, "documents").where(S.first_kind(F.col("text"), SECRETS).isNotNull())
    return docs.select("doc_id", F.sha2(S.redact(F.col("text"), SECRETS), 256).alias("redacted_sha256"))


_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1))"


@query(f"""
WITH h AS (SELECT {_HOST} AS host FROM pages)
SELECT host, CASE WHEN host = '' THEN 'unknown' WHEN host IN ('www.example.com', 'm.example.com') THEN 'internal_gateway'
  WHEN host LIKE '%.example.org' OR host = 'example.org' THEN 'vendor_external' ELSE 'unknown' END AS provider_class, count(*) AS n_pages
FROM h GROUP BY ALL""")
def provider_class(spark, sf_dir):
    """Hosts of pages against a registry of exact hosts, wild cards and gateways."""
    url = F.col("url")
    found = S.provider_class(url, ("www.example.com", "m.example.com"), {"example.org": "org"}, {"*.example.org": "org"})
    return table(spark, sf_dir, "pages").groupBy(S.host_of(url).alias("host"), found.alias("provider_class")).agg(F.count("*").alias("n_pages"))


@query(r"""
WITH i AS (SELECT doc_id, regexp_extract(text, '\b((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3})\b', 1) AS ip FROM documents)
SELECT doc_id, ip, ip LIKE '10.%' OR ip LIKE '127.%' OR ip LIKE '0.%' OR ip LIKE '192.168.%' OR ip LIKE '169.254.%'
  OR (split_part(ip, '.', 1) = '172' AND CAST(split_part(ip, '.', 2) AS INT) BETWEEN 16 AND 31) AS is_private FROM i WHERE ip <> ''""")
def private_hosts(spark, sf_dir):
    ip = F.regexp_extract("text", r"\b((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3})\b", 1)
    return table(spark, sf_dir, "documents").select("doc_id", ip.alias("ip")).where(F.col("ip") != "").withColumn("is_private", S.is_private_host(F.col("ip")))


@query("""
SELECT conv_id, arg_min(text, turn) AS prompt, left(sha256(arg_min(text, turn)), 12) AS prompt_id FROM conversations WHERE role = 'system' AND text IS NOT NULL GROUP BY conv_id""")
def system_prompt(spark, sf_dir):
    """The first system message of every conversation, with a short content id."""
    turns = table(spark, sf_dir, "conversations").where(F.col("role") == "system")
    first = R.first_by(turns, ["conv_id"], F.col("turn"), {"prompt": F.col("text")})
    return first.withColumn("prompt_id", F.left(F.sha2("prompt", 256), F.lit(12)))


_SHAPE = """
WITH c AS (SELECT conv_id, bool_or(role = 'system') AS sys, bool_or(role = 'user') AS usr, bool_or(role = 'assistant') AS ast, count(*) AS n, max(length(text)) AS longest FROM conversations GROUP BY conv_id),
s AS (SELECT conv_id, CAST((CASE WHEN sys THEN 3 ELSE 0 END) + (CASE WHEN usr AND ast THEN 3 WHEN usr THEN 2 ELSE 0 END) + (CASE WHEN ast THEN 2 ELSE 0 END) + (CASE WHEN longest > 1000 THEN 1 ELSE 0 END)
   + least((CASE WHEN n > 4 THEN 1 ELSE 0 END) + (CASE WHEN n > 6 THEN 1 ELSE 0 END), 2) AS INT) AS score FROM c)"""


def _shape(spark, sf_dir):
    """Signs of a model call in the shape of a conversation: roles stand for payload keys and response fields."""
    has = lambda r: F.bool_or(F.col("role") == r)
    found = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(has("system").alias("sys"), has("user").alias("usr"), has("assistant").alias("ast"), F.count("*").alias("n"), F.max(F.length("text")).alias("longest"))
    keys = F.array_compact(F.array(F.when(F.col("usr"), "messages"), F.when(F.col("usr") & F.col("ast"), "model"), F.when(F.col("n") > 4, "temperature"), F.when(F.col("n") > 6, "top_p")))
    score = S.shape_score(path=F.col("sys"), chain=F.lit(False), keys=keys, response=F.col("ast"), auth=F.col("longest") > 1000, stream=F.lit(False))
    return found.select("conv_id", score.alias("score"))


@query(_SHAPE + " SELECT conv_id, score FROM s")
def shape_score(spark, sf_dir):
    return _shape(spark, sf_dir)


@query(_SHAPE + " SELECT CASE WHEN score >= 7 THEN 'high' WHEN score >= 5 THEN 'medium' WHEN score >= 3 THEN 'suspect' ELSE 'none' END AS tier, count(*) AS n FROM s GROUP BY 1")
def shape_tier(spark, sf_dir):
    return _shape(spark, sf_dir).groupBy(S.shape_tier(F.col("score")).alias("tier")).agg(F.count("*").alias("n"))


_FACTS = """
WITH f AS (SELECT left(sha256(text), 12) AS id, CAST(d.doc_id AS VARCHAR) AS evidence, CASE quality WHEN 1 THEN 2 WHEN 0 THEN 0 ELSE 1 END AS rank
           FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE text IS NOT NULL)"""


def _facts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", F.left(F.sha2("text", 256), F.lit(12)).alias("id"))
    rows = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    confidence = F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").otherwise("medium")
    return G.merge_facts(rows, "id", F.col("doc_id").cast("string"), confidence)


@query(_FACTS + """ SELECT id, count(DISTINCT evidence) AS n_evidence, min(evidence) AS first_evidence,
 CASE max(rank) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence FROM f GROUP BY id""")
def merge_facts(spark, sf_dir):
    return _facts(spark, sf_dir)[0]


@query(_FACTS + " SELECT DISTINCT id, evidence FROM f")
def fact_evidence(spark, sf_dir):
    return _facts(spark, sf_dir)[1]


_EDGES = """
WITH e AS (SELECT 'acdg' AS family, 'lives_in' AS type, 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer
  UNION ALL SELECT 'acdg', 'part_of', 'n' || n_nationkey, 'r' || n_regionkey FROM nation
  UNION ALL SELECT 'acfg', 'orders', 'c' || o_custkey, 'n' || c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'
  UNION ALL SELECT 'acfg', 'ships', 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
n AS (SELECT 'c' || c_custkey AS id FROM customer UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 'r' || r_regionkey FROM region),
k AS (SELECT family, type, src, dst, count(*) AS seen FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n) GROUP BY ALL)"""


def _graph(spark, sf_dir):
    """Suppliers are no nodes here, so their edges are dropped."""
    t = lambda n: table(spark, sf_dir, n)
    tag = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    edge = lambda df, family, kind, src, dst: df.select(F.lit(family).alias("family"), F.lit(kind).alias("type"), src.alias("src"), dst.alias("dst"))
    c, n, r, s = t("customer"), t("nation"), t("region"), t("supplier")
    ordered = t("orders").where(F.col("o_orderstatus") == "F").join(c, F.col("o_custkey") == F.col("c_custkey"))
    parts = [edge(c, "acdg", "lives_in", tag("c", "c_custkey"), tag("n", "c_nationkey")), edge(n, "acdg", "part_of", tag("n", "n_nationkey"), tag("r", "n_regionkey")), edge(ordered, "acfg", "orders", tag("c", "o_custkey"), tag("n", "c_nationkey")), edge(s, "acfg", "ships", tag("s", "s_suppkey"), tag("n", "s_nationkey"))]
    nodes = c.select(tag("c", "c_custkey").alias("id")).unionByName(n.select(tag("n", "n_nationkey").alias("id"))).unionByName(r.select(tag("r", "r_regionkey").alias("id")))
    return G.edges(parts, nodes)


@query(_EDGES + " SELECT * FROM k")
def graph_edges(spark, sf_dir):
    return _graph(spark, sf_dir).select("family", "type", "src", "dst", "seen")


@query(_EDGES + " SELECT node, count(*) AS n_neighbours FROM (SELECT DISTINCT src AS node, dst AS other FROM k UNION SELECT DISTINCT dst, src FROM k) GROUP BY node")
def graph_neighbours(spark, sf_dir):
    return G.neighbours(_graph(spark, sf_dir), direction="both").groupBy("node").agg(F.count("*").alias("n_neighbours"))


@query("""
SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) AS parts, count(DISTINCT l_suppkey) AS n_suppliers, bool_or(l_returnflag = 'R') AS returned
FROM lineitem GROUP BY l_orderkey""")
def entity_bom(spark, sf_dir):
    """Bill of materials of every order; an order has a handful of lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").cast("string").alias("p")))).alias("e"), F.countDistinct("l_suppkey").alias("n_suppliers"), F.bool_or(F.col("l_returnflag") == "R").alias("returned"))
    return lines.select("l_orderkey", F.array_join(F.col("e.p"), ",").alias("parts"), "n_suppliers", "returned")


@query("""
SELECT 'part' AS kind, p_partkey AS id FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48)
UNION ALL SELECT 'customer', c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""")
def unbound_artefacts(spark, sf_dir):
    parts = G.unbound(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), table(spark, sf_dir, "lineitem").where(F.col("l_quantity") > 48).select(F.col("l_partkey").alias("id")), "id")
    people = G.unbound(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), table(spark, sf_dir, "orders").where(F.col("o_totalprice") > 400000).select(F.col("o_custkey").alias("id")), "id")
    return parts.select(F.lit("part").alias("kind"), "id").unionByName(people.select(F.lit("customer").alias("kind"), "id"))


def _tree(spark, sf_dir):
    """Customers hand off to the customer of half their number; the first hands off to the third, which closes a cycle."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src"))
    return c.select("src", F.when(F.col("src") == 1, F.lit(3)).otherwise(F.floor(F.col("src") / 2)).cast("long").alias("dst")).where((F.col("dst") > 0) & (F.col("src") > 0))


_TREE = "e AS (SELECT c_custkey AS src, CASE WHEN c_custkey = 1 THEN 3 ELSE c_custkey // 2 END AS dst FROM customer WHERE c_custkey > 0)"


@query(f"""
WITH RECURSIVE {_TREE}, r AS (SELECT src AS root, src AS node FROM e WHERE dst > 0 UNION SELECT r.root, e.dst FROM r JOIN e ON r.node = e.src WHERE e.dst > 0)
SELECT root, count(*) AS n_reached, min(node) AS least FROM r GROUP BY root""")
def reachable_set(spark, sf_dir):
    found = G.closure(e := _tree(spark, sf_dir), e.select(F.col("src").alias("root")))
    return found.groupBy("root").agg(F.count("*").alias("n_reached"), F.min("node").alias("least"))


_FLOW = """
WITH RECURSIVE flow AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
entry AS (SELECT DISTINCT l_partkey AS node FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1 AND o_orderpriority = '1-URGENT' AND l_quantity >= 49),
live AS (SELECT node FROM entry UNION SELECT dst FROM live JOIN flow ON node = src)"""


def _flow(spark, sf_dir):
    """Parts on consecutive lines of an order are edges; first lines of urgent orders are entry points."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    edges = lines.join(after, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("src"), "dst").distinct()
    urgent = table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_orderkey").alias("l_orderkey"))
    entry = lines.where((F.col("l_linenumber") == 1) & (F.col("l_quantity") >= 49)).join(urgent, "l_orderkey", "left_semi").select(F.col("l_partkey").alias("node"))
    return edges, entry


@query(_FLOW + " SELECT p_partkey AS node, CASE WHEN p_partkey IN (SELECT node FROM entry) THEN 'invoked' WHEN p_partkey IN (SELECT node FROM live) THEN 'reachable' ELSE 'defined' END AS liveness FROM part")
def liveness_tier(spark, sf_dir):
    edges, entry = _flow(spark, sf_dir)
    return G.liveness(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")), entry, edges)


@query("""
SELECT s_suppkey, bool_or(p_type LIKE '%PROMO%') AS moves_money, bool_or(p_size > 45) AS executes_code, bool_or(l_returnflag = 'R' AND l_quantity > 45) AS mutates_identities
FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY s_suppkey""")
def capability_flags(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return lines.groupBy("s_suppkey").agg(F.bool_or(F.col("p_type").like("%PROMO%")).alias("moves_money"), F.bool_or(F.col("p_size") > 45).alias("executes_code"), F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).alias("mutates_identities"))


@query("""
SELECT user_id, CASE min(CASE event_type WHEN 'error' THEN CASE WHEN value > 90 THEN 0 ELSE 1 END WHEN 'purchase' THEN 2 ELSE 3 END) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'info' END AS worst
FROM events GROUP BY user_id""")
def worst_severity(spark, sf_dir):
    graded = F.when((F.col("event_type") == "error") & (F.col("value") > 90), "high").when(F.col("event_type") == "error", "medium").when(F.col("event_type") == "purchase", "low").otherwise("info")
    worst = F.get(F.array(*map(F.lit, S.SEVERITY_ORDER)), F.min(S.severity_rank(graded)))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(worst.alias("worst"))


@query("SELECT DISTINCT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL OR l.quality <> 1")
def unattested(spark, sf_dir):
    return R.unattested(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id", "quality", 1)


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE o_orderpriority = '1-URGENT' AND NOT EXISTS (SELECT 1 FROM orders a WHERE a.o_custkey = o.o_custkey AND a.o_orderstatus = 'F' AND a.o_totalprice > 100000)")
def no_approval_exists(spark, sf_dir):
    """Urgent orders of customers without any large finished order, as tools with admin rights in systems without an approval gate."""
    orders = table(spark, sf_dir, "orders")
    gated = orders.where((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000))
    return R.without_any(orders.where(F.col("o_orderpriority") == "1-URGENT"), gated, ["o_custkey"]).select("o_orderkey", "o_custkey")


@query("SELECT p_brand, p_type, count(*) AS uses FROM part GROUP BY p_brand, p_type")
def models_by_class(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("uses"))


@query("""
SELECT o_custkey, CAST(sum(CASE WHEN o_orderpriority ILIKE '%urgent%' THEN 1 ELSE 0 END) AS BIGINT) AS bespoke,
 CAST(sum(CASE WHEN o_orderpriority NOT ILIKE '%urgent%' THEN 1 ELSE 0 END) AS BIGINT) AS framework FROM orders GROUP BY o_custkey""")
def kinds_by_repo(spark, sf_dir):
    """A null method counts in neither column."""
    urgent = F.col("o_orderpriority").ilike("%urgent%")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(urgent).alias("bespoke"), F.count_if(~urgent).alias("framework"))


@query("""
WITH b AS (SELECT DISTINCT l_partkey FROM lineitem WHERE year(l_shipdate) = 1995), h AS (SELECT DISTINCT l_partkey FROM lineitem WHERE year(l_shipdate) = 1996)
SELECT l_partkey, 'added' AS change FROM (SELECT * FROM h EXCEPT SELECT * FROM b) UNION ALL SELECT l_partkey, 'removed' FROM (SELECT * FROM b EXCEPT SELECT * FROM h)""")
def bom_diff(spark, sf_dir):
    of = lambda y: table(spark, sf_dir, "lineitem").where((F.col("l_shipdate") >= F.lit(f"{y}-01-01").cast("timestamp")) & (F.col("l_shipdate") < F.lit(f"{y + 1}-01-01").cast("timestamp"))).select("l_partkey")
    return R.set_diff(of(1995), of(1996))


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def upsert_replace(spark, sf_dir):
    """Open orders come in again as finished ones and replace their older rows."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return R.upsert(orders, orders.where(F.col("o_orderstatus") == "P").withColumn("o_orderstatus", F.lit("F")), ["o_orderkey"])


_LEDGER = f"""
WITH RECURSIVE e AS (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS seq, o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority AS f FROM orders),
c AS (SELECT o_custkey, o_orderkey, seq, '{L.GENESIS}' AS prev_hash, sha256(seq || '|' || f || '|{L.GENESIS}') AS entry_hash FROM e WHERE seq = 1
  UNION ALL SELECT e.o_custkey, e.o_orderkey, e.seq, c.entry_hash, sha256(e.seq || '|' || e.f || '|' || c.entry_hash) FROM c JOIN e ON e.o_custkey = c.o_custkey AND e.seq = c.seq + 1)"""
LEDGER_FIELDS = ["o_orderkey", "o_orderstatus", "o_orderpriority"]


def chained_orders(spark, sf_dir):
    return L.hash_chain(table(spark, sf_dir, "orders").select("o_custkey", *LEDGER_FIELDS), "o_custkey", ["o_orderkey"], LEDGER_FIELDS)


@query(_LEDGER + " SELECT * FROM c")
def hash_chain(spark, sf_dir):
    return chained_orders(spark, sf_dir).select("o_custkey", "o_orderkey", "seq", "prev_hash", "entry_hash")


@query(_LEDGER + """, b AS (SELECT c.o_custkey, min(c.seq) AS bad FROM c JOIN orders o USING (o_orderkey) WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW' GROUP BY c.o_custkey)
SELECT c.o_custkey, count(*) AS entries, any_value(b.bad) IS NULL AS ok, any_value(b.bad) AS first_bad_seq,
 CASE WHEN any_value(b.bad) IS NULL THEN arg_max(c.entry_hash, c.seq) ELSE max(CASE WHEN c.seq = b.bad THEN c.prev_hash END) END AS tip_hash
FROM c LEFT JOIN b ON c.o_custkey = b.o_custkey GROUP BY c.o_custkey""")
def verify_chain(spark, sf_dir):
    """The ledger with some entries edited after they were chained."""
    edited = F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW"), "F").otherwise(F.col("o_orderstatus"))
    return L.verify(chained_orders(spark, sf_dir).withColumn("o_orderstatus", edited), "o_custkey", LEDGER_FIELDS)


@query("""
WITH c AS (SELECT doc_id, 0 AS i, 'quality' AS field, '1' AS old_value, CAST(quality AS VARCHAR) AS new_value FROM labels UNION ALL SELECT doc_id, 1, 'toxic', '0', CAST(toxic AS VARCHAR) FROM labels)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INT) AS seq, field, old_value, new_value FROM c WHERE new_value IS NOT NULL AND new_value <> old_value""")
def governance_audit(spark, sf_dir):
    """Every change of a field against the default of good and harmless."""
    labels = table(spark, sf_dir, "labels")
    return R.changes(labels.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")), labels, "doc_id", ["quality", "toxic"])


@query("""
SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem) WHERE src <> dst""")
def pairwise_transfers(spark, sf_dir):
    return R.transfers(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey"], "l_partkey").drop("l_partkey")


@query("""
WITH s AS (SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part)
SELECT p_partkey, CASE WHEN row_number() OVER (PARTITION BY slug ORDER BY p_partkey) = 1 THEN slug ELSE slug || '@' || p_partkey END AS unique_id FROM s""")
def id_disambiguation(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", S.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))
    return R.disambiguated(parts, F.col("slug"), ["p_partkey"], F.col("p_partkey").cast("string")).select("p_partkey", "unique_id")


@query("""
SELECT p_brand, p_type, arg_min(p_name, p_partkey) AS name, arg_min(p_size, p_partkey) FILTER (WHERE p_size > 10) AS size, count(*) AS n FROM part GROUP BY p_brand, p_type""")
def models_dedupe(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    key, order = ["p_brand", "p_type"], F.col("p_partkey")
    first = R.first_by(parts, key, order, {"name": F.col("p_name"), "size": F.when(F.col("p_size") > 10, F.col("p_size"))})
    return first.join(parts.groupBy(*key).agg(F.count("*").alias("n")), key)


@query("SELECT l_suppkey, l_linestatus, count(*) AS n, bool_or(l_quantity > 49) AS large FROM lineitem GROUP BY l_suppkey, l_linestatus")
def usage_groups(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linestatus").agg(F.count("*").alias("n"), F.bool_or(F.col("l_quantity") > 49).alias("large"))


@query("SELECT o_orderkey, o_custkey, l_linenumber, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def flatten_roundtrip(spark, sf_dir):
    """Orders with their lines as nested records, flattened again."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct("l_linenumber", "l_partkey")).alias("lines"))
    nested = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey")
    return nested.select("o_orderkey", "o_custkey", F.inline("lines"))


@query("""
SELECT doc_id, location FROM (SELECT doc_id, CASE lang WHEN 'en' THEN 'production' WHEN 'de' THEN 'example' ELSE 'test' END AS location FROM documents)
ORDER BY CASE location WHEN 'production' THEN 0 WHEN 'example' THEN 1 ELSE 2 END, doc_id LIMIT 200""")
def node_budget(spark, sf_dir):
    """The node budget of an enrichment run: production first, 200 nodes."""
    location = F.when(F.col("lang") == "en", "production").when(F.col("lang") == "de", "example").otherwise("test")
    rank = F.when(F.col("location") == "production", 0).when(F.col("location") == "example", 1).otherwise(2)
    return table(spark, sf_dir, "documents").select("doc_id", location.alias("location")).orderBy(rank, "doc_id").limit(200)


@query(f"""
WITH RECURSIVE {_TREE}, a AS (SELECT c_custkey AS node FROM customer WHERE c_acctbal < -900 UNION SELECT e.src FROM a JOIN e ON a.node = e.dst) SELECT node FROM a""")
def affected_modules(spark, sf_dir):
    """Customers whose chain of hand-offs leads to an overdrawn one."""
    changed = table(spark, sf_dir, "customer").where(F.col("c_acctbal") < -900).select(F.col("c_custkey").alias("node"))
    return G.affected(changed, _tree(spark, sf_dir))


@query("""
SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)
AND NOT EXISTS (SELECT 1 FROM (SELECT source FROM documents GROUP BY source HAVING min(n_chars) < 20) s WHERE s.source = d.source)""")
def carry_forward(spark, sf_dir):
    """Facts neither of an affected module nor of a changed file."""
    docs = table(spark, sf_dir, "documents")
    changed = docs.groupBy("source").agg(F.min("n_chars").alias("m")).where(F.col("m") < 20)
    kept = R.without_any(docs.select("doc_id", "source"), table(spark, sf_dir, "labels").where(F.col("toxic") == 1), ["doc_id"])
    return R.without_any(kept, changed, ["source"]).select("doc_id")


@query("""
SELECT coalesce(p_partkey, l_partkey) AS partkey, p_partkey IS NOT NULL AS declared, l_partkey IS NOT NULL AS used, coalesce(n, 0) AS n_uses
FROM part FULL JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40 GROUP BY l_partkey) ON p_partkey = l_partkey""")
def dependency_bom(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40)).groupBy(F.col("l_partkey").alias("partkey")).agg(F.count("*").alias("n"))
    both = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("partkey"), F.lit(True).alias("d")).join(used, "partkey", "full_outer")
    return both.select("partkey", F.col("d").isNotNull().alias("declared"), F.col("n").isNotNull().alias("used"), F.coalesce("n", F.lit(0)).alias("n_uses"))


@query(r"""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '(\.git)?/*$', '') AS u FROM pages)
SELECT page_id, regexp_replace(u || ':' || page_id || '-' || (page_id + 3), ':[0-9]+(-[0-9]+)?$', '') AS path,
 CASE WHEN regexp_extract(u, '([^/:]+)/[^/]+$', 1) <> '' THEN regexp_extract(u, '([^/:]+)/[^/]+$', 1) || '__' || regexp_extract(u, '([^/]+)$', 1) ELSE regexp_extract(u, '([^/]+)$', 1) END AS bundle FROM p""")
def evidence_path(spark, sf_dir):
    url = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"(\.git)?/*$", "")
    evidence = F.concat(url, F.lit(":"), F.col("page_id").cast("string"), F.lit("-"), (F.col("page_id") + 3).cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", S.evidence_path(evidence).alias("path"), S.bundle_name(F.col("url")).alias("bundle"))


@query("""
WITH p AS (SELECT doc_id, source FROM documents WHERE n_chars > 500), a AS (SELECT d.doc_id, d.source FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 1)
SELECT coalesce(p.source, a.source) AS source, count(*) FILTER (WHERE p.doc_id IS NOT NULL AND a.doc_id IS NOT NULL) AS tp, count(*) FILTER (WHERE a.doc_id IS NULL) AS fp, count(*) FILTER (WHERE p.doc_id IS NULL) AS fn
FROM p FULL JOIN a ON p.doc_id = a.doc_id GROUP BY 1""")
def precision_recall(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    good = docs.join(table(spark, sf_dir, "labels").where(F.col("quality") == 1).select("doc_id"), "doc_id")
    return R.counts_of(docs.where(F.col("n_chars") > 500), good, ["doc_id", "source"], ["source"])


@query(f"""
WITH l AS (SELECT doc_id, list_slice(string_split(text, chr(10)), 1, 40) AS lines FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(len(lines) AS INT) AS n_lines, sha256(regexp_replace(array_to_string(lines, chr(10)), '{SECRETS[4][1]}', '<redacted:email>', 'g')) AS slice_sha256 FROM l""")
def code_slice(spark, sf_dir):
    """The first forty lines of each text with e-mail addresses redacted, as a slice to adjudicate."""
    lines = F.slice(F.split("text", "\n"), 1, 40)
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", lines.alias("l"))
    return docs.select("doc_id", F.size("l").alias("n_lines"), F.sha2(S.redact(F.array_join("l", "\n"), SECRETS[4:5]), 256).alias("slice_sha256"))


@query("""
WITH s AS (SELECT user_id, event_type, min(ts) AS a, max(ts) AS b FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY ALL)
SELECT e.event_id, s.event_type AS span FROM events e JOIN s ON e.user_id = s.user_id AND e.ts BETWEEN s.a AND s.b WHERE e.event_type = 'error'""")
def span_containment(spark, sf_dir):
    """Errors inside a user's span of purchases or signups; a user has two spans at most."""
    events = table(spark, sf_dir, "events")
    spans = events.where(F.col("event_type").isin("purchase", "signup")).groupBy("user_id", F.col("event_type").alias("span")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return contained(events.where(F.col("event_type") == "error").select("event_id", "user_id", "ts"), spans, ["user_id"], "ts", "a", "b").select("event_id", "span")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.unresolved') IS NOT NULL AS is_unresolved FROM events")
def json_slot(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"), F.get_json_object("props", "$.unresolved").isNotNull().alias("is_unresolved"))


@query("""
SELECT source, CASE WHEN sum(CASE WHEN regexp_matches(text, '[Ll]icense') THEN 1 ELSE 0 END) > 2 THEN 'ai_detected' WHEN max(n_chars) > 20000 THEN 'ai_signals_only' ELSE 'no_ai' END AS verdict, count(*) AS n_files
FROM documents GROUP BY source""")
def verdict(spark, sf_dir):
    """The three-way verdict of a bundle from its signs."""
    hits = F.count_if(F.col("text").rlike("[Ll]icense"))
    found = F.when(hits > 2, "ai_detected").when(F.max("n_chars") > 20000, "ai_signals_only").otherwise("no_ai")
    return table(spark, sf_dir, "documents").groupBy("source").agg(found.alias("verdict"), F.count("*").alias("n_files"))


@query("""
WITH h AS (SELECT src, bool_or(type = 'handoff') AS hands, bool_or(type = 'route') AS routes FROM (
  SELECT o_custkey AS src, CASE WHEN o_orderstatus = 'F' THEN 'handoff' ELSE 'route' END AS type FROM orders WHERE o_totalprice > 300000) GROUP BY src),
t AS (SELECT DISTINCT CASE WHEN o_custkey = 1 THEN 3 ELSE o_custkey // 2 END AS dst FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'F')
SELECT c_custkey AS node, CASE WHEN hands THEN 'supervisor' WHEN routes THEN 'router' WHEN c_custkey IN (SELECT dst FROM t) THEN 'worker' ELSE 'solo' END AS role FROM customer LEFT JOIN h ON c_custkey = src""")
def role_class(spark, sf_dir):
    large = table(spark, sf_dir, "orders").where(F.col("o_totalprice") > 300000)
    dst = F.when(F.col("o_custkey") == 1, F.lit(3)).otherwise(F.floor(F.col("o_custkey") / 2)).cast("long")
    edges = large.select(F.when(F.col("o_orderstatus") == "F", "handoff").otherwise("route").alias("type"), F.col("o_custkey").alias("src"), dst.alias("dst"))
    return G.roles(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node")), edges)


@query("SELECT contributor, n FROM (SELECT o_custkey AS contributor, count(*) AS n FROM orders GROUP BY 1) ORDER BY n DESC, contributor LIMIT 5")
def top_contributors(spark, sf_dir):
    """The five most frequent authors, ties by name."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("contributor")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "contributor").limit(5)


@query("""
SELECT l_orderkey, CASE WHEN n > 1 THEN 'line:' || l_partkey || '@' || l_linenumber ELSE 'line:' || l_partkey END AS tool_id
FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_partkey) AS n FROM lineitem)""")
def tool_ids(spark, sf_dir):
    """Short names unless they collide within an order."""
    n = F.count("*").over(Window.partitionBy("l_orderkey", "l_partkey"))
    short = F.concat(F.lit("line:"), F.col("l_partkey").cast("string"))
    return table(spark, sf_dir, "lineitem").withColumn("n", n).select("l_orderkey", F.when(F.col("n") > 1, F.concat_ws("@", short, F.col("l_linenumber").cast("string"))).otherwise(short).alias("tool_id"))
