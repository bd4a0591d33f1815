"""Registered queries over the driver's tables, each with its DuckDB SQL.

The tables hold no files, so paths are rendered from their columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import checksums, paths, values
from .operators import detect, diff, frame, manifest, match, select
from .plans.spec import FormatSpec, leak_score

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- paths rendered from lineitem

SHIPMENT = "{returnflag}/{linestatus}/ship_{date}_{line:03d}.dat"
SHIPMENT_SQL = "l_returnflag || '/' || l_linestatus || '/ship_' || strftime(l_shipdate, '%Y%m%d') || '_' || printf('%03d', l_linenumber) || '.dat'"


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as rows of the format's fields."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"), F.date_format("l_shipdate", "yyyyMMdd").alias("date"), F.col("l_linenumber").alias("line"))


def shipment_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shipments(spark, sf_dir).select(FormatSpec.compile(SHIPMENT).render().alias("path"))


@query(f"""
SELECT returnflag, date, count(*) AS files, min(sha1(path)) AS first_sha1 FROM (
  SELECT {SHIPMENT_SQL} AS path, l_returnflag AS returnflag, CAST(strftime(l_shipdate, '%Y%m%d') AS BIGINT) AS date, l_linestatus, printf('%03d', l_linenumber) AS line FROM lineitem)
WHERE (returnflag = 'R' OR line IN ('001', '002')) AND l_linestatus = 'O' GROUP BY returnflag, date""")
def files_by_parameter(spark, sf_dir):
    """Render, decode, infer types, filter by OR then AND, aggregate."""
    found = frame.ParamFrame(frame.decoded(shipment_paths(spark, sf_dir), SHIPMENT))
    kept = found(returnflag="R", line=["001", "002"])(linestatus="O").df
    return kept.groupBy("returnflag", "date").agg(F.count("*").alias("files"), F.min(F.sha1("path")).alias("first_sha1"))


@query(f"SELECT DISTINCT {SHIPMENT_SQL} AS path FROM lineitem")
def render_path(spark, sf_dir):
    return shipment_paths(spark, sf_dir).distinct()


@query(r"""
SELECT page_id, regexp_extract(url, '^https?://(.+?)/(.+?)$', 1) AS host, regexp_extract(url, '^https?://(.+?)/(.+?)$', 2) AS rest
FROM pages WHERE regexp_full_match(url, 'https?://.+?/.+?')""")
def path_parse(spark, sf_dir):
    spec = FormatSpec.compile("{scheme}://{host}/{rest}")
    fields = spec.decode(F.col("url"))
    return table(spark, sf_dir, "pages").filter(spec.matches(F.col("url")) & fields["scheme"].isin("http", "https")).select("page_id", fields["host"].alias("host"), fields["rest"].alias("rest"))


@query("SELECT c_custkey, regexp_extract(c_name, '^Customer#(.+?)$', 1) AS n FROM customer WHERE regexp_full_match(c_name, 'Customer#.+?')")
def path_parse_text(spark, sf_dir):
    """Zero-padded numbers are not their own shortest form, so the column stays text."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.regexp_extract("c_name", FormatSpec.compile("Customer#{n}").regex, 1).alias("n"))
    return values.infer_numeric(rows, ["n"])


@query("SELECT p_partkey, CAST(regexp_extract(p_brand, '^Brand#(.+?)$', 1) AS BIGINT) AS n FROM part")
def infer_numeric(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.regexp_extract("p_brand", FormatSpec.compile("Brand#{n}").regex, 1).alias("n"))
    return values.infer_numeric(rows, ["n"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE coalesce(l_returnflag = 'R', false) OR coalesce(l_linenumber IN (1, 2), false)")
def filter_or(spark, sf_dir):
    return values.any_filter(table(spark, sf_dir, "lineitem"), l_returnflag="R", l_linenumber=[1, 2]).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber IN (1, 2)")
def filter_and(spark, sf_dir):
    found = frame.ParamFrame(table(spark, sf_dir, "lineitem"))
    return found(l_returnflag="R")(l_linenumber=[1, 2]).df.select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 12")
def filter_range(spark, sf_dir):
    found = frame.ParamFrame(table(spark, sf_dir, "lineitem"))
    return found[(F.col("l_quantity") >= 10) & (F.col("l_quantity") <= 12)].df.select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 3 OR c_name = 'Customer#000000007' OR c_acctbal = 0")
def filter_strict_types(spark, sf_dir):
    """A text is never equal to a number, as in the decoded tables: only the values of a column's own type find rows."""
    rows = table(spark, sf_dir, "customer")
    found = values.any_filter(rows, c_custkey=["1", "2"], c_nationkey=[3, "4"], c_name=["Customer#000000007", 1], c_acctbal=[0, "0.0"])
    return found.select("c_custkey")


@query(f"SELECT DISTINCT sha1({SHIPMENT_SQL}) AS sha1, l_returnflag AS returnflag, l_linestatus AS linestatus, strftime(l_shipdate, '%Y%m%d') AS date, CAST(l_linenumber AS VARCHAR) AS line FROM lineitem")
def manifest_rows(spark, sf_dir):
    rows = shipments(spark, sf_dir)
    return manifest.manifest(rows.withColumn("sha1", F.sha1(FormatSpec.compile(SHIPMENT).render())), SHIPMENT).distinct()


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS k, CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) ELSE CAST(o_totalprice AS VARCHAR) END AS price
FROM orders""")
def safe_text(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return rows.select(values.safe_text(F.col("o_orderkey"), rows.schema["o_orderkey"].dataType).alias("k"), values.safe_text(F.col("o_totalprice"), rows.schema["o_totalprice"].dataType).alias("price"))


@query("SELECT CAST(user_id AS VARCHAR) AS user_id, event_type, sha1(event_type || CAST(max(event_id) AS VARCHAR)) AS sha1, max(event_id) AS seq FROM events GROUP BY user_id, event_type")
def keep_last(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.sha1(F.concat("event_type", F.col("event_id").cast("string"))).alias("sha1"), F.col("user_id").cast("string").alias("user_id"), "event_type")
    return manifest.keep_last(rows, ["user_id", "event_type"], "seq").select("user_id", "event_type", "sha1", "seq")


@query("""
WITH u AS (
  SELECT o_orderkey AS seq, sha1(o_orderstatus) AS sha1, CAST(o_custkey AS VARCHAR) AS cust, '' AS priority FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT o_orderkey + 1 + (SELECT max(o_orderkey) FROM orders WHERE o_orderkey % 2 = 0), sha1(o_orderpriority), CAST(o_custkey AS VARCHAR), o_orderpriority FROM orders WHERE o_orderkey % 2 = 1)
SELECT cust, priority, arg_max(sha1, seq) AS sha1, max(seq) AS seq FROM u GROUP BY cust, priority""")
def state_update(spark, sf_dir):
    """Upsert where the incoming rows have a column more."""
    rows = table(spark, sf_dir, "orders")
    old = rows.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("seq"), F.sha1("o_orderstatus").alias("sha1"), F.col("o_custkey").cast("string").alias("cust"))
    new = rows.filter("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("seq"), F.sha1("o_orderpriority").alias("sha1"), F.col("o_custkey").cast("string").alias("cust"), F.col("o_orderpriority").alias("priority"))
    return manifest.upsert(old, new).select("cust", "priority", "sha1", "seq")


@query("SELECT sha1(o_orderstatus) AS sha1, coalesce(CAST(o_custkey AS VARCHAR), '') AS o_custkey, coalesce(o_orderpriority, '') AS o_orderpriority FROM orders")
def state_replace(spark, sf_dir):
    return manifest.normalised(table(spark, sf_dir, "orders").select(F.sha1("o_orderstatus").alias("sha1"), "o_custkey", "o_orderpriority", F.lit("x").alias("path")))


@query("SELECT o_orderkey, o_custkey, NULL::VARCHAR AS o_orderpriority FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, NULL, o_orderpriority FROM orders WHERE o_orderkey % 2 = 1")
def union_evolve(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return rows.filter("o_orderkey % 2 = 0").select("o_orderkey", "o_custkey").unionByName(rows.filter("o_orderkey % 2 = 1").select("o_orderkey", "o_orderpriority"), allowMissingColumns=True)


# --- snapshots of orders: head lacks each seventh order, staged rewrites some statuses and lacks each eleventh

HEAD = "SELECT CAST(o_orderkey AS VARCHAR) || '.dat' AS path, sha1(o_orderstatus) AS sha1 FROM orders WHERE o_orderkey % 7 <> 0"
STAGED = "SELECT CAST(o_orderkey AS VARCHAR) || '.dat' AS path, sha1(CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END) AS sha1 FROM orders WHERE o_orderkey % 11 <> 0"


def snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "orders")
    path = F.concat(F.col("o_orderkey").cast("string"), F.lit(".dat")).alias("path")
    head = rows.filter("o_orderkey % 7 != 0").select(path, F.sha1("o_orderstatus").alias("sha1"))
    staged = rows.filter("o_orderkey % 11 != 0").select(path, F.sha1(F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus"))).alias("sha1"))
    return head, staged


@query(f"""
SELECT * FROM (SELECT CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' WHEN a.sha1 <> b.sha1 THEN 'modified' END AS label, coalesce(a.path, b.path) AS path
FROM ({HEAD}) a FULL JOIN ({STAGED}) b ON a.path = b.path) WHERE label IS NOT NULL""")
def status_diff(spark, sf_dir):
    return diff.staged_changes(*snapshots(spark, sf_dir))


@query("SELECT CAST(c_custkey AS VARCHAR) AS path FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def untracked(spark, sf_dir):
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("path"))
    return diff.untracked(files, table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").cast("string").alias("path")))


@query("SELECT DISTINCT sha1(CAST(l_partkey AS VARCHAR)) AS sha1 FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def missing_objects(spark, sf_dir):
    needed = table(spark, sf_dir, "lineitem").select(F.sha1(F.col("l_partkey").cast("string")).alias("sha1"))
    return diff.missing_objects(needed, table(spark, sf_dir, "part").filter("p_size > 10").select(F.sha1(F.col("p_partkey").cast("string")).alias("sha1")))


@query("""
WITH e AS (SELECT CAST(doc_id AS VARCHAR) AS path, sha1(coalesce(text, '')) AS sha1 FROM documents),
a AS (SELECT CAST(doc_id AS VARCHAR) AS path, sha1(CASE WHEN n_chars % 4 = 0 THEN upper(coalesce(text, '')) ELSE coalesce(text, '') END) AS sha1 FROM documents WHERE n_chars % 9 <> 0)
SELECT CASE WHEN a.path IS NULL THEN 'deleted' ELSE 'modified' END AS label, e.path FROM e LEFT JOIN a USING (path) WHERE a.path IS NULL OR a.sha1 <> e.sha1""")
def worktree_changes(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("n_chars", text.alias("text"), F.col("doc_id").cast("string").alias("path"))
    actual = rows.filter("n_chars % 9 != 0").select("path", F.sha1(F.when(F.col("n_chars") % 4 == 0, F.upper("text")).otherwise(F.col("text"))).alias("sha1"))
    return diff.worktree_changes(rows.select("path", F.upper(F.sha1("text")).alias("sha1")), actual)


@query(f"SELECT s.path, s.sha1 FROM ({STAGED}) s WHERE NOT EXISTS (SELECT 1 FROM ({HEAD}) h WHERE h.path = s.path AND h.sha1 = s.sha1) OR s.sha1 NOT IN (sha1('F'), sha1('X'))")
def files_to_store(spark, sf_dir):
    head, staged = snapshots(spark, sf_dir)
    stored = spark.createDataFrame([("F",), ("X",)], "v string").select(F.sha1("v").alias("sha1"))
    return diff.files_to_store(staged, head, stored)


@query(f"""
SELECT * FROM (SELECT CASE WHEN t.path IS NULL THEN 'remove' WHEN c.path IS NULL AND p.path IS NOT NULL AND p.sha1 <> t.sha1 THEN 'conflict' WHEN c.path IS NULL OR c.sha1 <> t.sha1 THEN 'install' END AS action,
  coalesce(c.path, t.path) AS path, coalesce(t.sha1, c.sha1) AS sha1
FROM ({HEAD}) c FULL JOIN ({STAGED}) t ON c.path = t.path
LEFT JOIN (SELECT CAST(o_orderkey AS VARCHAR) || '.dat' AS path, sha1('other') AS sha1 FROM orders WHERE o_orderkey % 21 = 0) p ON p.path = coalesce(c.path, t.path)) WHERE action IS NOT NULL""")
def incremental_checkout(spark, sf_dir):
    head, staged = snapshots(spark, sf_dir)
    present = table(spark, sf_dir, "orders").filter("o_orderkey % 21 = 0").select(F.concat(F.col("o_orderkey").cast("string"), F.lit(".dat")).alias("path"), F.sha1(F.lit("other")).alias("sha1"))
    return diff.checkout_plan(head, staged, present)


# --- tokens and formats over page addresses

@query(r"SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, t[i] AS token, CASE WHEN i < len(t) THEN t[i + 1] END AS next_token FROM (SELECT page_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT page_id, regexp_split_to_array(url, '[_\-./]') AS t FROM pages))")
def path_tokens(spark, sf_dir):
    toks = table(spark, sf_dir, "pages").select("page_id", paths.tokens(F.col("url")).alias("t"))
    return toks.select("page_id", "t", F.posexplode("t").alias("pos", "token")).select("page_id", "pos", "token", F.get("t", F.col("pos") + 1).alias("next_token"))


@query(r"""
SELECT CAST(len(t) AS INTEGER) AS n, CAST(i - 1 AS INTEGER) AS pos, count(DISTINCT t[i]) AS variants, count(*) AS paths
FROM (SELECT t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT regexp_split_to_array(url, '[_\-./]') AS t FROM pages)) GROUP BY len(t), i""")
def position_variability(spark, sf_dir):
    toks = table(spark, sf_dir, "pages").select(paths.tokens(F.col("url")).alias("t"))
    return toks.select(F.size("t").alias("n"), F.posexplode("t").alias("pos", "token")).groupBy("n", "pos").agg(F.count_distinct("token").alias("variants"), F.count("*").alias("paths"))


@query(r"""
SELECT lang, token, n FROM (
  SELECT lang, token, count(*) AS n FROM (SELECT DISTINCT doc_id, lang, unnest(regexp_split_to_array(text, '[ \n]+')) AS token FROM documents) GROUP BY lang, token)
JOIN (SELECT lang, count(*) AS docs FROM documents GROUP BY lang) USING (lang) WHERE token <> '' AND n > docs / 2.0""")
def majority_tokens(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    toks = docs.select("lang", F.explode(F.array_distinct(F.split("text", "[ \n]+"))).alias("token")).filter("token != ''")
    sizes = docs.groupBy("lang").agg(F.count("*").alias("docs"))
    return toks.groupBy("lang", "token").agg(F.count("*").alias("n")).join(F.broadcast(sizes), "lang").filter("n > docs / 2").select("lang", "token", "n")


def _dependency(rows: DataFrame, a: str, b: str) -> DataFrame:
    facts = rows.agg(F.count_distinct(a).alias("values_a"), F.count_distinct(b).alias("values_b"), F.count_distinct(a, b).alias("pairs"))
    return facts.withColumns({"a_gives_b": F.expr("pairs = values_a"), "b_gives_a": F.expr("pairs = values_b")})


@query("""
SELECT *, pairs = values_a AS a_gives_b, pairs = values_b AS b_gives_a FROM (
SELECT count(DISTINCT n_nationkey) AS values_a, count(DISTINCT n_regionkey) AS values_b, count(DISTINCT (n_nationkey, n_regionkey)) AS pairs FROM nation)
UNION ALL SELECT *, pairs = values_a, pairs = values_b FROM (SELECT count(DISTINCT p_brand), count(DISTINCT p_type), count(DISTINCT (p_brand, p_type)) FROM part) t(values_a, values_b, pairs)""")
def functional_dependency(spark, sf_dir):
    return _dependency(table(spark, sf_dir, "nation"), "n_nationkey", "n_regionkey").union(_dependency(table(spark, sf_dir, "part"), "p_brand", "p_type"))


@query(r"""
SELECT 'shipdate' AS col, CASE WHEN bool_and(regexp_full_match(v, '\d{8}')) THEN 'date' ELSE 'p0' END AS name FROM (SELECT strftime(l_shipdate, '%Y%m%d') AS v FROM lineitem)
UNION ALL SELECT 'linenumber', CASE WHEN bool_and(regexp_full_match(v, '\d')) THEN 'pass' ELSE 'p0' END FROM (SELECT CAST(l_linenumber AS VARCHAR) AS v FROM lineitem)
UNION ALL SELECT 'event_type', CASE WHEN bool_and(regexp_full_match(event_type, '\d{3}')) THEN 'scan' ELSE 'p0' END FROM events""")
def infer_param_name(spark, sf_dir):
    columns = [("shipdate", "lineitem", F.date_format("l_shipdate", "yyyyMMdd")), ("linenumber", "lineitem", F.col("l_linenumber").cast("string")), ("event_type", "events", F.col("event_type"))]
    out = None
    for name, source, value in columns:
        tests = table(spark, sf_dir, source).agg(*detect.name_tests(value))
        first = F.coalesce(*[F.when(F.col(c), c.split("_", 1)[1]) for c in tests.columns], F.lit("p0"))
        row = tests.select(F.lit(name).alias("col"), first.alias("name"))
        out = row if out is None else out.union(row)
    return out


FORMATS = ["https://{host}/{rest}", "https://{host}.example.com/{section}/{page}", "http{rest}", "https://{host}/{a}/{b}/{c}"]
MATCH_SQL = (
    "SELECT url, f, lit, values_chars FROM ("
    + " UNION ALL ".join(
        f"SELECT url, {n} AS f, {FormatSpec.compile(fmt).literal_chars} AS lit, length(url) - {FormatSpec.compile(fmt).literal_chars} AS values_chars FROM (SELECT DISTINCT url FROM pages) WHERE regexp_full_match(url, '{rx}')"
        for n, (fmt, rx) in enumerate(zip(FORMATS, ("(?is)https://.+?/.+?", r"(?is)https://.+?\.example\.com/.+?/.+?", "(?is)http.+?", "(?is)https://.+?/.+?/.+?/.+?")))
    )
    + ")"
)


def _format_hits(spark, sf_dir) -> DataFrame:
    specs = [FormatSpec.compile(f) for f in FORMATS]
    hits = F.array_compact(F.array(*[F.when(s.matches(F.col("url")), F.struct(F.lit(n).alias("f"), F.lit(s.literal_chars).alias("lit"))) for n, s in enumerate(specs)]))
    urls = table(spark, sf_dir, "pages").select("url").distinct()
    return urls.select("url", F.explode(hits).alias("h")).select("url", "h.f", "h.lit", (F.length("url") - F.col("h.lit")).alias("values_chars"))


@query(MATCH_SQL)
def match_formats_theta(spark, sf_dir):
    """Every format against every path: one projection, no pairs shuffled."""
    return _format_hits(spark, sf_dir)


PLAIN = ["https://{host}.example.net/{section}/{page}", "http://{host}.example.{top}/{section}/{page}"]


@query(r"""
SELECT DISTINCT url AS path, CASE WHEN regexp_full_match(url, '(?is)https://[^/.]+\.example\.net/[^/]+/[^/]+') THEN 0 WHEN regexp_full_match(url, '(?is)http://[^/.]+\.example\.[^/.]+/[^/]+/[^/]+') THEN 1 END AS format
FROM pages WHERE regexp_full_match(url, 'https?://[a-z]+\.example\.(net|com|org)/[a-z]+/[0-9]+') AND (url LIKE 'http:%' OR url LIKE '%.net/%')""".replace("\\\\", "\\"))
def best_format(spark, sf_dir):
    """The best of competing formats, by the library's matcher."""
    urls = table(spark, sf_dir, "pages").select(F.col("url").alias("path")).filter(F.col("path").rlike(r"^https?://[a-z]+\.example\.(net|com|org)/[a-z]+/[0-9]+$"))
    return match.match_formats(urls.filter(F.col("path").startswith("http:") | F.col("path").contains(".net/")), PLAIN).select("path", "format")


@query("SELECT page_id, CAST(length(r) - length(replace(r, '/', '')) AS INTEGER) AS leaks FROM (SELECT page_id, regexp_extract(url, '(?s)^https://(.+?)/(.+?)$', 2) AS r FROM pages WHERE url LIKE 'https://%/%')")
def leak_scores(spark, sf_dir):
    spec = FormatSpec.compile("https://{host}/{rest}")
    text = {"host": F.lit(""), "rest": F.regexp_extract("url", spec.regex, 2)}
    return table(spark, sf_dir, "pages").filter(spec.matches(F.col("url"))).select("page_id", leak_score(spec, text).alias("leaks"))


# --- selections and checksums

SELECTION = f"""
SELECT 1 + (l_orderkey * 10 + l_linenumber) * 2 AS ord, {SHIPMENT_SQL} AS path, CASE WHEN l_linenumber = 1 THEN NULL ELSE 'sha1' END AS algorithm, CASE WHEN l_linenumber = 1 THEN NULL ELSE sha1({SHIPMENT_SQL}) END AS checksum FROM lineitem
UNION ALL SELECT (l_orderkey * 10 + l_linenumber) * 2, {SHIPMENT_SQL}, 'sha1', upper(sha1({SHIPMENT_SQL} || CASE WHEN l_orderkey % 50 = 0 THEN 'x' ELSE '' END)) FROM lineitem WHERE l_linenumber <> 3"""


def _selection(spark, sf_dir) -> DataFrame:
    spec = FormatSpec.compile(SHIPMENT)
    rows = table(spark, sf_dir, "lineitem")
    fields = {"returnflag": F.col("l_returnflag"), "linestatus": F.col("l_linestatus"), "date": F.date_format("l_shipdate", "yyyyMMdd"), "line": F.col("l_linenumber")}
    rows = rows.select("l_orderkey", "l_linenumber", spec.render(fields).alias("path"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 2).alias("at"))
    first = rows.select((F.col("at") + 1).alias("ord"), "path", F.when(F.col("l_linenumber") == 1, "unknown").otherwise(F.sha1("path")).alias("sha1"))
    changed = F.concat("path", F.when(F.col("l_orderkey") % 50 == 0, "x").otherwise(""))
    second = rows.filter("l_linenumber != 3").select(F.col("at").alias("ord"), "path", F.upper(F.sha1(changed)).alias("checksum"), F.lit("SHA1").alias("checksum_algorithm"))
    return select.identified(first).unionByName(select.identified(second))


@query(f"""
SELECT min(ord) AS ord, path, min(CASE WHEN checksum IS NOT NULL THEN algorithm END) AS algorithm, min(lower(checksum)) AS checksum, count(DISTINCT lower(checksum)) > 1 AS conflict FROM ({SELECTION}) GROUP BY path""")
def selection_merge(spark, sf_dir):
    return select.merged(_selection(spark, sf_dir))


@query(f"SELECT path FROM ({SELECTION}) GROUP BY path HAVING count(DISTINCT lower(checksum)) > 1")
def selection_conflicts(spark, sf_dir):
    return select.conflicts(_selection(spark, sf_dir))


@query("SELECT doc_id, sha1(text) AS sha1, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def digests(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[checksums.digest(F.col("text").cast("binary"), a).alias(a) for a in ("sha1", "md5", "sha256")])


@query()
def digest_sha512(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", checksums.digest(F.col("text").cast("binary"), "sha512").alias("sha512"))


CHECKSUMS = "SELECT doc_id, CASE WHEN n_chars % 3 = 1 THEN 'sha1' WHEN n_chars % 7 = 0 THEN 'SHA256' ELSE 'md5' END AS algorithm, CASE n_chars % 5 WHEN 0 THEN md5(text) WHEN 1 THEN sha1(text) WHEN 2 THEN upper(md5(text)) WHEN 3 THEN md5(text) || 'g' ELSE substr(text, 1, 32) END AS value FROM documents"


@query(f"SELECT doc_id, coalesce(regexp_full_match(value, '[0-9a-fA-F]+') AND length(value) = CASE lower(algorithm) WHEN 'md5' THEN 32 WHEN 'sha1' THEN 40 WHEN 'sha256' THEN 64 END, false) AS valid FROM ({CHECKSUMS})")
def valid_checksum(spark, sf_dir):
    k = F.col("n_chars") % 5
    value = F.when(k == 0, F.md5("text")).when(k == 1, F.sha1("text")).when(k == 2, F.upper(F.md5("text"))).when(k == 3, F.concat(F.md5("text"), F.lit("g"))).otherwise(F.substring("text", 1, 32))
    algorithm = F.when(F.col("n_chars") % 3 == 1, "sha1").when(F.col("n_chars") % 7 == 0, "SHA256").otherwise("md5")
    return table(spark, sf_dir, "documents").select("doc_id", checksums.is_valid(algorithm, value).alias("valid"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'sha256' WHEN doc_id % 4 = 1 THEN 'sha1' WHEN doc_id % 4 = 2 THEN 'md5' END AS algorithm,
CASE WHEN doc_id % 4 = 0 THEN sha256(text) WHEN doc_id % 4 = 1 THEN sha1(text) WHEN doc_id % 4 = 2 THEN md5(text) END AS checksum FROM documents""")
def strongest_checksum(spark, sf_dir):
    k = F.col("doc_id") % 4
    columns = {"sha256": F.when(k == 0, F.sha2("text", 256)).otherwise("None"), "sha1": F.when(k <= 1, F.sha1("text")), "md5": F.when(k <= 2, F.md5("text")).otherwise(" unknown ")}
    best = checksums.strongest(columns)
    return table(spark, sf_dir, "documents").select("doc_id", best.alias("b")).select("doc_id", "b.algorithm", "b.checksum")


LINES = "SELECT source, doc_id, CASE n_chars % 5 WHEN 0 THEN 'not a checksum line ' || doc_id WHEN 1 THEN md5(text) || '  *doc_' || doc_id WHEN 2 THEN upper(md5(text)) || ' doc ' || doc_id || '  ' WHEN 3 THEN sha1(text) || '  doc_' || doc_id ELSE substr(md5(text), 1, 8) || ' short_' || doc_id END AS line FROM documents"


@query(f"""
SELECT source, regexp_extract(line, '^([0-9a-fA-F]{{8,}})\\s+\\*?(.+?)\\s*$', 2) AS name, regexp_extract(line, '^([0-9a-fA-F]{{8,}})\\s+\\*?(.+?)\\s*$', 1) AS checksum
FROM ({LINES}) WHERE regexp_matches(line, '^[0-9a-fA-F]{{8,}}\\s+\\*?.+') AND length(regexp_extract(line, '^[0-9a-fA-F]+')) = 32""")
def manifest_text_scan(spark, sf_dir):
    """Checksum manifests written as texts, one a source, scanned line by line: only lines with a digest as long as the algorithm's count."""
    from .sources.remote import manifest_lines

    table(spark, sf_dir, "documents").createOrReplaceTempView("paramscan_documents")
    lines = spark.sql(LINES.replace("FROM documents", "FROM paramscan_documents"))
    texts = lines.groupBy("source").agg(F.array_join(F.collect_list("line"), "\n").alias("text"))
    return manifest_lines(texts.withColumn("algorithm", F.lit("md5"))).select("source", "name", "checksum")


@query("""
WITH p AS (SELECT regexp_replace(url, '^https?://', '') AS p FROM pages UNION ALL SELECT unnest(['', '.', '../x', 'a/../b', '/abs', 'C:/x', 'a\\b', '.hm/x', '.GIT/y', 'a/.git/z', './.hm/q', 'ok/file.dat', '..dots/x']))
SELECT p AS path, NOT (trim(p) = '' OR p = '.' OR p LIKE '/%' OR contains(p, chr(92)) OR regexp_matches(p, '^[A-Za-z]:') OR regexp_matches(p, '(^|/)\\.\\.(/|$)')
  OR lower(split_part(regexp_replace(p, '^(\\./)+', ''), '/', 1)) IN ('.hm', '.git')) AS safe FROM p""".replace("\\\\", "\\"))
def relative_path_safety(spark, sf_dir):
    cases = ["", ".", "../x", "a/../b", "/abs", "C:/x", "a\\b", ".hm/x", ".GIT/y", "a/.git/z", "./.hm/q", "ok/file.dat", "..dots/x"]
    urls = table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path"))
    return urls.union(spark.createDataFrame([(c,) for c in cases], "path string")).select("path", paths.is_safe_relative(F.col("path")).alias("safe"))


@query(f"SELECT path FROM (SELECT DISTINCT {SHIPMENT_SQL} AS path FROM lineitem) ORDER BY length(path) - length(replace(path, '/', '')) DESC, path DESC LIMIT 20")
def topk_preview(spark, sf_dir):
    return diff.deepest_first(shipment_paths(spark, sf_dir).distinct()).limit(20)


@query(r"SELECT l_orderkey, l_linenumber, regexp_replace('am' || CAST(l_discount AS VARCHAR) || '_i' || CAST(l_linenumber AS VARCHAR), 'm([0-9]+(\.[0-9]+)?|\.[0-9]+)', '-\1', 'g') AS path FROM lineitem")
def encoding_rewrite(spark, sf_dir):
    path = F.concat(F.lit("am"), F.col("l_discount").cast("string"), F.lit("_i"), F.col("l_linenumber").cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", frame.rewritten(path, {"aspin": r"m([0-9]+(\.[0-9]+)?|\.[0-9]+)"}).alias("path"))


@query("SELECT count(*) FILTER (o_orderstatus <> 'F') AS succeeded, count(*) FILTER (o_orderstatus = 'F') AS failed, CAST(coalesce(sum(o_custkey) FILTER (o_orderstatus <> 'F'), 0) AS BIGINT) AS total_bytes, (SELECT string_agg(o_orderkey || ': ' || o_orderpriority, chr(10) ORDER BY o_orderkey) FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 10)) AS errors FROM orders")
def download_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    outcomes = rows.select(F.col("o_orderkey").alias("ord"), F.col("o_orderkey").cast("string").alias("path"), (F.col("o_orderstatus") != "F").alias("ok"), F.col("o_custkey").alias("bytes"), F.col("o_orderpriority").alias("error"))
    return select.outcome_summary(outcomes)


@query("SELECT page_id, 'https://host/data/' || replace(replace(url_encode(url), '%2F', '/'), '+', '%20') AS url FROM pages")
def remote_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", paths.url_of("https://host/data", F.col("url")).alias("url"))


@query()
def detect_formats(spark, sf_dir):
    urls = table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path"))
    return spark.createDataFrame([(f,) for f in detect.detect_formats(urls)], "fmt string")


@query()
def tolerant_match(spark, sf_dir):
    urls = table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path"))
    found = match.match_formats(urls, ["{host}.example.org/{a}-{b}/{page}.html", "{host}/{rest}", "{host}/{a}/{b}_{c}"])
    return found.select("path", "format", F.array_join(F.array_sort(F.transform(F.map_entries("values"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("fields"))


# --- what a parameter table can do because it is a DataFrame

@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 200000")
def join_inner(spark, sf_dir):
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return orders.filter("o_totalprice > 200000").join(customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY c_custkey")
def join_left(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    return table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))


@query("SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def join_semi(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").filter("lang = 'en'"), "doc_id", "left_semi").select("doc_id", "quality")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark, sf_dir):
    return table(spark, sf_dir, "region").select("r_name").crossJoin(table(spark, sf_dir, "nation").select("n_name"))


@query("""
SELECT o_orderkey, (SELECT max(ts) FROM events e WHERE e.user_id = o.o_custkey % 100 AND e.ts <= o.o_orderdate) AS last_ts FROM orders o""")
def join_asof(spark, sf_dir):
    """The last event of a user at or before each order: a union ordered by time, no range join."""
    orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("k"), F.col("o_orderdate").alias("at"), F.lit(1).alias("side"), "o_orderkey", F.lit(None).cast("timestamp_ntz").alias("ts"))
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("ts").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("o_orderkey"), "ts")
    order = Window.partitionBy("k").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return orders.union(events).withColumn("last_ts", F.last("ts", ignorenulls=True).over(order)).filter("side = 1").select("o_orderkey", "last_ts")


@query("SELECT o_orderkey, rank() OVER w AS rank, dense_rank() OVER w AS dense, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous, CAST(count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate)")
def window_ranks(spark, sf_dir):
    by = Window.partitionBy("o_custkey")
    total = by.orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.rank().over(by.orderBy("o_orderdate")).alias("rank"), F.dense_rank().over(by.orderBy("o_orderdate")).alias("dense"), F.lag("o_totalprice").over(total).alias("previous"), F.count("*").over(total.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("running"))


@query("SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rolling FROM events")
def window_rolling(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)
    return table(spark, sf_dir, "events").select("event_id", F.max("value").over(w).alias("rolling"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_shipdate) AS first, max(l_discount) AS most FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.min("l_shipdate").alias("first"), F.max("l_discount").alias("most"))


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS F, count(*) FILTER (l_linestatus = 'O') AS O FROM lineitem GROUP BY l_returnflag")
def pivot(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).na.fill(0)


@query("SELECT p_partkey, 'size' AS measure, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")
def unpivot(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return rows.unpivot("p_partkey", ["size", "price"], "measure", "value")


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT p_partkey AS k FROM part EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_linenumber = 1")
def except_all(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).exceptAll(table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select("l_partkey"))


@query("SELECT source, lang, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most, count(DISTINCT lang) AS langs FROM documents GROUP BY source, lang")
def group_aggregate(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.count_distinct("lang").alias("langs"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def nlargest(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, upper(o_orderpriority) AS u, contains(o_orderpriority, 'HIGH') AS high, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, abs(o_totalprice - 100000) AS off FROM orders")
def scalar_surface(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.upper("o_orderpriority").alias("u"), F.col("o_orderpriority").contains("HIGH").alias("high"), F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.abs(F.col("o_totalprice") - 100000).alias("off"))


# the modules of further queries register them here
from . import scenarios, surface  # noqa: E402, F401
