"""Registered queries that run the operators over files, servers and stores made from the driver's tables.

Their results are known from the tables by rule, which their SQL states. Files
go below the session's checkpoint folder, which all workers see.
"""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import build
from . import config as configuration
from .functions import registry
from .operators import detect, gather, match
from .queries import query, table
from .sources import inventory, remote, tables
from .store import Dataset, branch_name
from .streaming import upsert


def workspace(spark: SparkSession) -> str:
    """A new folder that the driver and all workers see, removed when the driver ends."""
    shared = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://").removeprefix("file:")
    if not shared.startswith("/"):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a mounted folder that the driver and all executors share")
        shared = ""
    if shared:
        os.makedirs(shared, exist_ok=True)
    folder = tempfile.mkdtemp(prefix="paramscan-", dir=shared or None)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def nation_files(spark: SparkSession, sf_dir: str, root: str) -> list:
    """One file a nation, its name the content, below a folder a region."""
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    for r in rows:
        folder = os.path.join(root, f"r{r.n_regionkey}")
        os.makedirs(folder, exist_ok=True)
        with open(os.path.join(folder, f"n_{r.n_nationkey}.dat"), "w") as f:
            f.write(r.n_name)
    return rows


PATH = "'r' || n_regionkey || '/n_' || n_nationkey || '.dat'"
FORMAT = "r{region}/n_{nation}.dat"

# --- scans and sinks


@query(f"SELECT {PATH} AS path, CAST(length(n_name) AS BIGINT) AS size, sha1(n_name) AS sha1, sha256(n_name) AS sha256 FROM nation")
def inventory_scan(spark, sf_dir):
    """Files listed, without store directories and links, and hashed where they lie."""
    root = workspace(spark)
    nation_files(spark, sf_dir, root)
    os.makedirs(os.path.join(root, ".hm"))
    open(os.path.join(root, ".hm", "hidden.dat"), "w").close()
    os.symlink(os.path.join(root, "r0"), os.path.join(root, "link"))
    files = inventory.inventory(spark, root).select("path", "size")
    return inventory.with_checksum(inventory.with_checksum(files, root), root, "sha256", out="sha256")


@query("SELECT c_name AS name, CAST(c_custkey AS VARCHAR) AS key, CASE c_custkey % 4 WHEN 0 THEN 'tab' || chr(9) || 'and \"quote\"' WHEN 1 THEN 'line' || chr(10) || 'break' WHEN 2 THEN '' ELSE 'back\\slash NA' END AS odd FROM customer".replace("\\\\", "\\"))
def tsv_round_trip(spark, sf_dir):
    path = os.path.join(workspace(spark), "data.tsv")
    odd = F.expr("CASE c_custkey % 4 WHEN 0 THEN 'tab\\tand \"quote\"' WHEN 1 THEN 'line\\nbreak' WHEN 2 THEN NULL ELSE 'back\\\\slash NA' END")
    tables.write_tsv(table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("key"), odd.alias("odd")), path)
    return tables.read_tsv(spark, "file://" + path)


# --- servers


def site(spark: SparkSession, sf_dir: str) -> dict[str, bytes]:
    """Index pages and files of a server: a directory a region, with a manifest of checksums, and one file a nation."""
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    entry = lambda kind, name: f'<tr class="object {kind}"><td class="name"><a href="{name}">{name}</a></td></tr>'
    regions = sorted({r.n_regionkey for r in rows})
    out = {"http://host/": "".join(entry("collection", f"r{k}/") for k in regions) + entry("data-object x", "README.md"), "http://host/README.md": "read me"}
    for k in regions:
        mine = [r for r in rows if r.n_regionkey == k]
        out[f"http://host/r{k}/"] = "".join(entry("data-object x", f"n_{r.n_nationkey}.dat") for r in mine) + entry("data-object x", "md5sums.txt")
        # odd nations are in the manifest, and one line is none
        out[f"http://host/r{k}/md5sums.txt"] = "# not a checksum\n" + "".join(f"{hashlib.md5(r.n_name.encode()).hexdigest()}  n_{r.n_nationkey}.dat\n" for r in mine if r.n_nationkey % 2)
        out.update({f"http://host/r{k}/n_{r.n_nationkey}.dat": r.n_name for r in mine})
    return {url: body.encode() for url, body in out.items()}


@query(f"""
SELECT {PATH} AS path, CASE WHEN n_nationkey % 2 = 1 THEN 'md5' END AS algorithm, CASE WHEN n_nationkey % 2 = 1 THEN md5(n_name) END AS checksum FROM nation
UNION ALL SELECT 'r' || r_regionkey || '/md5sums.txt', NULL, NULL FROM region UNION ALL SELECT 'README.md', NULL, NULL""")
def remote_crawl(spark, sf_dir):
    """An index crawled level by level, with its checksum manifests."""
    return remote.crawl(spark, "http://host", site(spark, sf_dir).get)


@query(f"SELECT {PATH} AS path, CASE WHEN n_nationkey % 3 = 0 THEN 'unknown' ELSE 'md5' END AS algorithm, CASE WHEN n_nationkey % 3 = 0 THEN 'unknown' ELSE md5(n_name) END AS checksum FROM nation")
def remote_small_digests(spark, sf_dir):
    """Sizes are asked first; a third of the files are said to be too large."""
    bodies = site(spark, sf_dir)
    limit = remote.SMALL
    size = lambda url: limit + 1 if int(url.rsplit("_", 1)[1].split(".")[0]) % 3 == 0 else len(bodies[url])
    paths = table(spark, sf_dir, "nation").select(F.format_string("r%d/n_%d.dat", "n_regionkey", "n_nationkey").alias("path"))
    return remote.small_digests(paths, "http://host", size=size, chunks=remote.chunks_by(bodies.get))


@query(f"""
SELECT CAST(n_nationkey AS BIGINT) AS ord, {PATH} AS path, n_nationkey % 5 <> 2 AS ok, CAST(CASE WHEN n_nationkey % 5 <> 2 THEN length(n_name) ELSE 0 END AS BIGINT) AS bytes,
  CASE WHEN n_nationkey % 5 = 2 THEN 'sha1 differs' END AS error, CASE WHEN n_nationkey % 5 <> 2 THEN sha1(n_name) END AS sha1 FROM nation""")
def remote_download(spark, sf_dir):
    """Files fetched in pieces and verified; a wrong checksum leaves no file. The digest is of what is on disk afterwards."""
    folder = workspace(spark)
    rows = table(spark, sf_dir, "nation")
    wrong = F.when(F.col("n_nationkey") % 5 == 2, F.sha1(F.lit("x"))).otherwise(F.sha1("n_name"))
    chosen = rows.select(F.col("n_nationkey").cast("long").alias("ord"), F.format_string("r%d/n_%d.dat", "n_regionkey", "n_nationkey").alias("path"), F.lit("sha1").alias("algorithm"), wrong.alias("checksum"))
    done = spark.createDataFrame(remote.download(chosen, "http://host", folder, fetch=site(spark, sf_dir).get).collect(), "ord long, path string, ok boolean, bytes long, error string")
    return inventory.with_checksum(done, folder)


@query(f"""
SELECT path, algorithm, checksum FROM (SELECT 'extra/named.txt' AS path, NULL AS algorithm, NULL AS checksum UNION ALL SELECT {PATH}, 'sha1', sha1(n_name) FROM nation UNION ALL SELECT 'static.txt', 'md5', md5('static'))""")
def gather_selection(spark, sf_dir):
    """What to download: a named path, the rows of a configured table rendered to paths, a listed file."""
    folder = workspace(spark)
    rows = table(spark, sf_dir, "nation").select(F.sha1("n_name").alias("sha1"), F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation"))
    tables.write_tsv(rows, os.path.join(folder, "nations.tsv"))
    config = {"data": [{"fmt": FORMAT, "db": "nations.tsv"}, {"file": "static.txt", "md5": hashlib.md5(b"static").hexdigest()}]}
    return gather.gather(spark, folder, config, ["extra/named.txt"], everything=True).select("path", "algorithm", "checksum")


# --- formats detected and matched

DETECTED = ("SED_{source}_{p0}.dat", "run-{scan}-{date}.fits", "x-{p0}.log", "y/{p0}_{band}.txt")


def made_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of four formats, and files that are no data."""
    orders, nations, lines = (table(spark, sf_dir, t) for t in ("orders", "nation", "lineitem"))
    parts = [
        orders.select(F.concat(F.lit("SED_"), F.when(F.col("o_orderkey") % 2 == 0, "M87").otherwise("SGRA"), F.lit("_"), F.year("o_orderdate"), F.lit(".dat"))),
        lines.select(F.concat(F.lit("run-"), F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), F.lit("-"), F.date_format("l_shipdate", "yyyyMMdd"), F.lit(".fits"))),
        nations.select(F.concat(F.lit("x-N"), F.col("n_nationkey").cast("string"), F.lit("N.log"))),
        nations.select(F.concat(F.lit("y/N"), F.col("n_nationkey").cast("string"), F.when(F.col("n_regionkey") > 1, "_hi").otherwise("_lo"), F.lit(".txt"))),
        spark.createDataFrame([("README.md",), ("bundle.tar",), ("plot.py",)], "p string"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.toDF("path")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{f}')" for f in DETECTED) + ") t(fmt)")
def detect_known_formats(spark, sf_dir):
    """The formats by which the paths were made are found again."""
    return spark.createDataFrame([(f,) for f in detect.detect_formats(made_paths(spark, sf_dir))], "fmt string")


MATCHED = ("a{a}_i{i}.h5", "{track}-{band}-{kind}.{format}", "prefix_long_literal_{opt}_suffix.txt")
NAMES = """SELECT CASE l_linenumber % 6
  WHEN 0 THEN 'a' || l_quantity || '_i' || l_linenumber || '.h5' WHEN 1 THEN 'a' || l_quantity || '.h5' WHEN 2 THEN 'e' || l_suppkey || '-b1-4fit.tar'
  WHEN 3 THEN 'e' || l_suppkey || '-4fit.tar' WHEN 4 THEN 'other' || l_suppkey || 'name' ELSE 'prefix_long_literal_' || l_suppkey || '_suffix.txt' END AS path, l_linenumber % 6 AS kind, l_quantity AS q, l_suppkey AS s, l_linenumber AS n FROM lineitem"""


def made_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("paramscan_lineitem")
    return spark.sql(NAMES.replace("FROM lineitem", "FROM paramscan_lineitem")).select("path")


@query(f"""
SELECT DISTINCT path, CASE kind WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 5 THEN 2 END AS format,
  CASE kind WHEN 0 THEN 'a=' || q || ';i=' || n WHEN 1 THEN 'a=' || q WHEN 2 THEN 'band=b1;format=tar;kind=4fit;track=e' || s WHEN 3 THEN 'format=tar;kind=4fit;track=e' || s WHEN 5 THEN 'opt=' || s END AS fields
FROM ({NAMES})""")
def tolerant_names(spark, sf_dir):
    """Names that fit a format, names that lack a field of one, and names that fit none."""
    found = match.match_formats(made_names(spark, sf_dir), list(MATCHED))
    return found.select("path", "format", F.array_join(F.array_sort(F.transform(F.map_entries("values"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("fields"))


@query(f"""
SELECT format, count(*) AS paths FROM (SELECT DISTINCT path, CASE kind WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 5 THEN 2 END AS format FROM ({NAMES})) GROUP BY format""")
def best_format_counts(spark, sf_dir):
    return match.match_formats(made_names(spark, sf_dir), list(MATCHED)).groupBy("format").agg(F.count("*").alias("paths"))


STRUCTURES = """
SELECT CAST(len(t) AS INTEGER) AS n, CAST(i - 1 AS INTEGER) AS pos, t[i] AS tok, t[i + 1] AS nxt FROM (
  SELECT t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT DISTINCT url, regexp_split_to_array(url, '[_\\-./]') AS t FROM pages WHERE regexp_matches(url, '^https?://[a-z.]+/[a-z]+/[0-9]+$')))""".replace("\\\\", "\\")


@query(f"""
SELECT n, pos, count(DISTINCT tok) AS "values", min(c) AS rarest, CAST(sum(p) AS BIGINT) AS pairs FROM (SELECT n, pos, tok, count(*) AS c, count(DISTINCT coalesce(nxt, '')) AS p FROM ({STRUCTURES}) GROUP BY n, pos, tok) GROUP BY n, pos""")
def structure_places(spark, sf_dir):
    """Facts about each place of a structure, by which detection settles it or splits it."""
    urls = table(spark, sf_dir, "pages").select(F.col("url").alias("path")).filter(F.col("path").rlike("^https?://[a-z.]+/[a-z]+/[0-9]+$")).distinct()
    toks = urls.select("path", F.split("path", r"[_\-./]").alias("toks")).withColumn("g", F.size("toks").cast("long"))
    return detect.place_facts(toks).select(F.col("g").cast("int").alias("n"), "pos", "values", "rarest", "pairs")


# --- stores


@query(f"""
SELECT 'worktree' AS section, CASE WHEN n_nationkey % 5 = 0 THEN 'deleted' ELSE 'modified' END AS label, {PATH} AS path FROM nation WHERE n_nationkey % 5 = 0 OR n_nationkey % 4 = 1
UNION ALL SELECT 'untracked', 'untracked', 'new_' || r_regionkey || '.txt' FROM region""")
def dataset_status(spark, sf_dir):
    """A dataset committed, then files changed, removed and added."""
    root = workspace(spark)
    rows = nation_files(spark, sf_dir, root)
    data = Dataset.init(spark, root)
    data.add(FORMAT)
    data.commit("nations")
    for r in rows:
        path = os.path.join(root, f"r{r.n_regionkey}/n_{r.n_nationkey}.dat")
        if r.n_nationkey % 5 == 0:
            os.unlink(path)
        elif r.n_nationkey % 4 == 1:
            with open(path, "a") as f:
                f.write("!")
    for r in table(spark, sf_dir, "region").collect():
        open(os.path.join(root, f"new_{r.r_regionkey}.txt"), "w").close()
    return data.status_frame()


@query(f"""
SELECT 'main' AS branch, {PATH} AS path, sha1(n_name) AS sha1 FROM nation
UNION ALL SELECT 'half', {PATH}, sha1(n_name || CASE WHEN n_nationkey % 3 = 0 THEN ' changed' ELSE '' END) FROM nation WHERE n_nationkey % 2 = 0""")
def dataset_checkout(spark, sf_dir):
    """Two branches checked out in turn; the files each has on disk."""
    root = workspace(spark)
    rows = nation_files(spark, sf_dir, root)
    data = Dataset.init(spark, root)
    data.add(FORMAT)
    data.commit("all")
    data.checkout("half")
    for r in rows:
        path = os.path.join(root, f"r{r.n_regionkey}/n_{r.n_nationkey}.dat")
        if r.n_nationkey % 2:
            os.unlink(path)
        elif r.n_nationkey % 3 == 0:
            with open(path, "a") as f:
                f.write(" changed")
    data.add(".")
    data.commit("half")
    seen = []
    for branch in ("main", "half"):
        data.checkout(branch)
        found = inventory.with_checksum(inventory.inventory(spark, root).select("path"), root)
        seen += [(branch, r.path, r.sha1) for r in found.collect()]
    return spark.createDataFrame(seen, "branch string, path string, sha1 string")


@query(f"SELECT * FROM (SELECT {PATH} AS path, sha1(n_name || ' again') AS sha1 FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT {PATH}, sha1(n_name) FROM nation WHERE n_nationkey % 2 = 1)")
def manifest_upsert(spark, sf_dir):
    """A format added again: rows of changed files take the new digest, rows of files since removed stay. The manifest at the last commit."""
    root = workspace(spark)
    rows = nation_files(spark, sf_dir, root)
    data = Dataset.init(spark, root)
    data.add(FORMAT)
    data.commit("one")
    for r in rows:
        path = os.path.join(root, f"r{r.n_regionkey}/n_{r.n_nationkey}.dat")
        if r.n_nationkey % 2:
            os.unlink(path)
        else:
            with open(path, "a") as f:
                f.write(" again")
    data.add(FORMAT)
    data.commit("two")
    return data.entries_at(data.revision("main"))


@query(f"SELECT {PATH} AS path, sha1(n_name) AS sha1 FROM nation")
def dataset_clone(spark, sf_dir):
    """Files of a clone, a third of which its store lacked and a server gave."""
    root = workspace(spark)
    rows = nation_files(spark, sf_dir, os.path.join(root, "one"))
    data = Dataset.init(spark, os.path.join(root, "one"))
    data.add(FORMAT)
    data.set_config(remote="http://host")
    data.commit("nations")
    for r in rows[::3]:
        sha1 = hashlib.sha1(r.n_name.encode()).hexdigest()
        os.unlink(os.path.join(root, "one", ".hm", "objects", sha1[:2], sha1[2:]))
    Dataset.clone(spark, os.path.join(root, "one"), os.path.join(root, "two"), fetch=site(spark, sf_dir).get)
    return inventory.with_checksum(inventory.inventory(spark, os.path.join(root, "two")).select("path"), os.path.join(root, "two"))


@query(f"SELECT {PATH} AS path, sha1(n_name) AS sha1 FROM nation WHERE n_regionkey = 1")
def dataset_scoped_add(spark, sf_dir):
    """Files scanned again below one directory replace the manifest; one whose name only begins alike is not below it."""
    root = workspace(spark)
    nation_files(spark, sf_dir, root)
    os.makedirs(os.path.join(root, "r1-other"))
    with open(os.path.join(root, "r1-other", "n_99.dat"), "w") as f:
        f.write("beside")
    data = Dataset.init(spark, root)
    data.add(FORMAT)
    data.add(".", below="r1")
    return data.entries_at(None)


@query("SELECT sha1(n_name) AS sha1, n_nationkey % 2 = 0 AS fetched FROM nation")
def dataset_fetch(spark, sf_dir):
    """Contents that a store lacks fetched from another one: which there are afterwards, and which were not there before."""
    root = workspace(spark)
    nation_files(spark, sf_dir, os.path.join(root, "one"))
    data = Dataset.init(spark, os.path.join(root, "one"))
    data.add(FORMAT)
    data.commit("nations")
    copy = Dataset.clone(spark, os.path.join(root, "one"), os.path.join(root, "two"))
    lost = [hashlib.sha1(r.n_name.encode()).hexdigest() for r in table(spark, sf_dir, "nation").collect() if r.n_nationkey % 2 == 0]
    for sha1 in lost:
        os.unlink(os.path.join(root, "two", ".hm", "objects", sha1[:2], sha1[2:]))
    before = spark.createDataFrame(copy.objects().collect(), "sha1 string")
    copy.fetch_missing(os.path.join(root, "one"))
    return copy.objects().join(before.withColumn("was", F.lit(True)), "sha1", "left").select("sha1", F.col("was").isNull().alias("fetched"))


@query("SELECT * FROM (VALUES (1, 'third', 'main'), (2, 'first', 'main'), (3, 'Initial commit', 'main')) t(place, message, branch)")
def dataset_log(spark, sf_dir):
    """Commits of a branch, newest first; a commit of nothing makes none, and those of another branch don't show."""
    root = workspace(spark)
    nation_files(spark, sf_dir, root)
    data = Dataset.init(spark, root)
    data.add(FORMAT)
    data.commit("first")
    data.commit("nothing")
    data.checkout("side")
    data.set_config(encoding={"aspin": "m([0-9]+)"})
    data.commit("second")
    data.checkout("main")
    data.set_config(remote_name="origin", remote_url="http://host")
    data.commit("third")
    return spark.createDataFrame([(n, c["message"], c["branch"]) for n, c in enumerate(data.log(), 1)], "place int, message string, branch string")


@query(f"""
SELECT 'nations' AS part, {PATH} AS path, CASE WHEN n_nationkey % 2 = 1 THEN 'md5' ELSE 'None' END AS algorithm, CASE WHEN n_nationkey % 2 = 1 THEN md5(n_name) ELSE 'None' END AS checksum, CAST(n_regionkey AS VARCHAR) AS region, CAST(n_nationkey AS VARCHAR) AS nation FROM nation
UNION ALL SELECT 'static', 'README.md', 'md5', md5('read me'), NULL, NULL
UNION ALL SELECT 'static', 'r' || n_regionkey || '/md5sums.txt', 'md5', md5('# not a checksum' || chr(10) || coalesce(string_agg(md5(n_name) || '  n_' || n_nationkey || '.dat' || chr(10), '' ORDER BY n_nationkey) FILTER (n_nationkey % 2 = 1), '')), NULL, NULL FROM nation GROUP BY n_regionkey""")
def build_dataset(spark, sf_dir):
    """A dataset built from a server's index: matched files in a table with their checksums, the others in the configuration with digests."""
    folder = workspace(spark)
    made = build.build(spark, folder, "http://host", [{"fmt": FORMAT, "db": "nations"}], site(spark, sf_dir).get)
    assert made == tables.load_yaml(os.path.join(folder, "config.yml"))
    static = [("static", e["file"], "md5", e["md5"], None, None) for e in made["data"] if "file" in e]
    schema = "part string, path string, algorithm string, checksum string, region string, nation string"
    rows = tables.read_tsv(spark, "file://" + os.path.join(folder, "nations.tsv"))
    return rows.select(F.lit("nations").alias("part"), "path", F.col("checksum_algorithm").alias("algorithm"), "checksum", "region", "nation").union(spark.createDataFrame(static, schema))


@query("SELECT CAST(r_regionkey AS VARCHAR) AS key, r_name AS name, 'two' || chr(10) || 'lines of ' || r_name || chr(10) AS note, repeat(r_name, 60) AS long FROM region")
def yaml_round_trip(spark, sf_dir):
    path = os.path.join(workspace(spark), "meta.yml")
    rows = table(spark, sf_dir, "region").orderBy("r_regionkey").collect()
    tables.dump_yaml({str(r.r_regionkey): {"name": r.r_name, "note": f"two\nlines of {r.r_name}\n", "long": r.r_name * 60} for r in rows}, path)
    return spark.createDataFrame([(k, v["name"], v["note"], v["long"]) for k, v in tables.load_yaml(path).items()], "key string, name string, note string, long string")


RULES = [
    ("one remote takes a URL", "origin http://new"), ("a named remote changes", "a 1, b 3"), ("a new remote is added", "a 1, b 2"), ("several need a name", "error"), ("a text is one remote", "http://x"),
    ("the strongest checksum", "sha256 b"), ("a table name", "t.tsv"), ("a format repeats", "error"), ("one format", "{a}"), ("two formats", "error"), ("a branch", "x/y"), ("no branch", "error"), ("encodings merge", "a 1, b 2"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in RULES) + ") t(rule, outcome)")
def configuration_rules(spark, sf_dir):
    """What the rules of configurations give, one by one."""
    listed = lambda config: ", ".join(" ".join(e.values()) for e in config["remote"])
    two = [{"name": "a", "url": "1"}, {"name": "b", "url": "2"}]
    outcomes = [
        lambda: " ".join(configuration.with_remote({"remote": {"name": "origin"}}, None, "http://new")["remote"].values()),
        lambda: listed(configuration.with_remote({"remote": two}, "b", "3")),
        lambda: listed(configuration.with_remote({"remote": two[:1]}, "b", "2")),
        lambda: listed(configuration.with_remote({"remote": two}, None, "3")),
        lambda: configuration.remote_url({"remote": "http://x"}),
        lambda: " ".join(configuration.entry_checksum({"md5": "a", "sha256": "b", "sha1": "unknown"})),
        lambda: configuration.build_entries([{"fmt": "{a}", "db": "t"}])[0]["db"],
        lambda: configuration.build_entries([{"fmt": "{a}", "db": "t"}, {"fmt": " {a} ", "db": "u"}])[0]["db"],
        lambda: configuration.single_format({"data": [{"fmt": "{a}"}, {"file": "x"}]})["fmt"],
        lambda: configuration.single_format({"data": [{"fmt": "{a}"}, {"fmt": "{b}"}]})["fmt"],
        lambda: branch_name("x/y"),
        lambda: branch_name("x..y"),
        lambda: ", ".join(" ".join(e) for e in configuration.with_format({"data": {"fmt": "{z}", "encoding": {"a": "1"}}}, encoding={"b": "2"})["data"][0]["encoding"].items()),
    ]

    def outcome(f) -> str:
        try:
            return f()
        except ValueError:
            return "error"

    return spark.createDataFrame([(rule, outcome(f)) for (rule, _), f in zip(RULES, outcomes, strict=True)], "rule string, outcome string")


# --- streams and SQL functions


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def stream_upsert(spark, sf_dir):
    """The last event of each user and type, kept up to date by micro-batches of a third of the events each."""
    folder = workspace(spark)
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    for k in range(3):
        events.filter(F.col("event_id") % 3 == k).coalesce(2).write.mode("append").parquet(folder + "/in")
        stream = spark.readStream.schema(events.schema).parquet(folder + "/in")
        upsert.upsert_stream(stream, folder + "/out", ["user_id", "event_type"], "event_id", folder + "/checkpoint").awaitTermination()
    return upsert.current(spark, folder + "/out")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    """Events per hour and type, counted by a stream in one run over what is there."""
    folder = workspace(spark)
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    events.write.parquet(folder + "/in")
    counts = upsert.windowed_counts(spark.readStream.schema(events.schema).parquet(folder + "/in"), "ts", "event_type", late="1000 days")
    name = "paramscan_windows"
    counts.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", folder + "/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("SELECT path, l_linenumber AS line, fields, again FROM (SELECT DISTINCT l_linenumber, 'l' || printf('%03d', l_linenumber) || '/' || l_returnflag || '.dat' AS path, 'flag=' || l_returnflag || ';line=' || printf('%03d', l_linenumber) AS fields, 'l' || printf('%03d', l_linenumber) || '/' || l_returnflag || '.dat' AS again FROM lineitem)")
def sql_functions(spark, sf_dir):
    """``fmt_match`` and ``fmt_render``, and a format's own functions, in SQL."""
    registry.register(spark)
    registry.register_format(spark, "shipped", "l{line:03d}/{flag}.dat")
    table(spark, sf_dir, "lineitem").select("l_linenumber", "l_returnflag").distinct().createOrReplaceTempView("paramscan_lines")
    return spark.sql("""
        SELECT path, shipped_match(path).line AS line, array_join(array_sort(transform(map_entries(m), e -> concat(e.key, '=', e.value))), ';') AS fields, fmt_render(fmt, m) AS again
        FROM (SELECT path, fmt, fmt_match(fmt, path) AS m FROM (SELECT shipped_render(l_linenumber, l_returnflag) AS path, 'l{line:03d}/{flag}.dat' AS fmt FROM paramscan_lines))""").withColumn("line", F.col("line").cast("int"))
