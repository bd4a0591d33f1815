import hashlib
import http.server
import os
import threading

import pytest
from pyspark.sql import functions as F

from paramscan import build, cli
from paramscan import config as configuration
from paramscan.errors import CloneError, SelectionError
from paramscan.functions import checksums, paths, values
from paramscan.operators import manifest, select
from paramscan.sources import remote, tables
from paramscan.store import Dataset
from paramscan.streaming import upsert

MD5 = "a" * 32


def page(*entries):
    return "<table>" + "".join(f'<tr class="object {"collection" if e.endswith("/") else "data-object x"}"><td class="name"><a href="{e}">{e}</a></td></tr>' for e in entries) + "</table>"


SITE = {
    "http://h/": page("README.md", "proj/", "beside/", "beside.md5sums", "a%20b+c.dat"),
    "http://h/proj/": page("data.tar", "md5sum.txt", "deep/"),
    "http://h/proj/deep/": page("x.bin", "checksum_report.txt"),
    "http://h/beside/": page("one.dat", "two.dat"),
    "http://h/proj/md5sum.txt": f"{MD5}  proj/data.tar\n",
    "http://h/proj/deep/checksum_report.txt": f"{MD5} x.bin\nno sum here\nnor here\n",
    "http://h/beside.md5sums": f"{'b' * 32} *one.dat\n",
    "http://h/README.md": "read me",
}


def fetcher(site):
    def get(url):
        body = site.get(url)
        return body.encode() if body is not None else None

    return get  # a nested function travels to workers whole


fetch = fetcher(SITE)


def test_crawl_and_build(spark, tmp_path):
    found = {r.path: (r.algorithm, r.checksum) for r in remote.crawl(spark, "http://h", fetch).collect()}
    assert found["proj/data.tar"] == ("md5", MD5) and found["beside/one.dat"] == ("md5", "b" * 32)
    assert found["README.md"] == found["proj/deep/x.bin"] == found["beside/two.dat"] == (None, None) and "a b+c.dat" in found
    out = build.build(spark, str(tmp_path), "http://h", [{"fmt": "beside/{n}.dat", "db": "t"}, {"fmt": "proj/{name}.tar", "db": "t"}], fetch)
    rows = tables.read_tsv(spark, "file://" + str(tmp_path / "t.tsv")).collect()
    assert {(r.path, r.n, r.name) for r in rows} == {("beside/one.dat", "one", "None"), ("beside/two.dat", "two", "None"), ("proj/data.tar", "None", "data")}
    readme = next(e for e in out["data"] if e.get("file") == "README.md")
    assert readme["name"] == "readme" and len(readme["md5"]) == 32 and tables.load_yaml(str(tmp_path / "config.yml")) == out
    with pytest.raises(FileExistsError):
        build.build(spark, str(tmp_path), "http://h", [], fetch)


def test_unsafe_index(spark):
    with pytest.raises(Exception, match="unsafe index entry"):
        remote.index_entries(spark.createDataFrame([("", page("../up.dat"))], "rel_dir string, html string")).collect()


def test_download(spark, tmp_path):
    rows = [(1, "README.md", None, None), (2, "proj/md5sum.txt", "md5", "0" * 32), (3, "gone.dat", None, None)]
    done = remote.download(spark.createDataFrame(rows, "ord long, path string, algorithm string, checksum string"), "http://h", str(tmp_path), 2, fetch)
    summary = select.outcome_summary(done.persist()).first()
    assert (summary.succeeded, summary.failed, summary.total_bytes) == (1, 2, 7) and "md5 differs" in summary.errors
    assert (tmp_path / "README.md").read_text() == "read me" and sorted(os.listdir(tmp_path)) == ["README.md", "proj"] or sorted(os.listdir(tmp_path)) == ["README.md"]


def site_size(told):
    return lambda url: told.get(url.rsplit("/", 1)[-1])


def test_small_digests_ask_for_the_size_first(spark, tmp_path):
    asked = str(tmp_path)

    def chunks(url):
        open(os.path.join(asked, url.rsplit("/", 1)[-1]), "w").close()
        yield b"abc"
        yield b"d" * (remote.SMALL if url.endswith("liar") else 1)

    paths = spark.createDataFrame([("small",), ("huge",), ("untold",), ("liar",)], "path string")
    got = {r.path: (r.algorithm, r.checksum) for r in remote.small_digests(paths, "http://h", size=site_size({"small": 4, "huge": 5 << 30, "liar": 7}), chunks=chunks).collect()}
    assert got == {"small": ("md5", hashlib.md5(b"abcd").hexdigest()), "huge": ("unknown", "unknown"), "untold": ("unknown", "unknown"), "liar": ("unknown", "unknown")}
    assert sorted(os.listdir(asked)) == ["liar", "small"]  # the others were never fetched


def test_download_in_pieces(spark, tmp_path):
    body = b"x" * 100_000

    def chunks(url):
        for at in range(0, len(body), 1000):
            if url.endswith("broken") and at > 50_000:
                raise OSError("connection lost")
            yield body[at : at + 1000]

    good = hashlib.sha256(body).hexdigest()
    rows = [(1, "d/a", "sha256", good), (2, "d/broken", None, None), (3, "d/wrong", "sha256", "0" * 64), (4, "d/a", "sha256", good)]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "wrong").write_text("old")
    done = remote.download(spark.createDataFrame(rows, "ord long, path string, algorithm string, checksum string"), "http://h", str(tmp_path), 3, chunks=chunks)
    got = {r.ord: (r.ok, r.bytes, r.error) for r in done.collect()}
    assert got == {1: (True, 100_000, None), 4: (True, 100_000, None), 2: (False, 0, "connection lost"), 3: (False, 0, "sha256 differs")}
    assert sorted(os.listdir(tmp_path / "d")) == ["a", "wrong"] and (tmp_path / "d" / "wrong").read_text() == "old"


def test_endless_index(spark):
    body = page("more/").encode()
    endless = lambda url: body
    with pytest.raises(OSError, match="more than 3 levels"):
        remote.crawl(spark, "http://h", endless, max_levels=3)


class Handler(http.server.BaseHTTPRequestHandler):
    def do_HEAD(self):
        self.send_response(404 if "gone" in self.path else 200)
        if "untold" not in self.path:
            self.send_header("Content-Length", "5")
        self.end_headers()

    def do_GET(self):
        self.do_HEAD()
        if "gone" not in self.path:
            self.wfile.write(b"hello")

    def log_message(self, *args):
        pass


def test_http_functions():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}/"
    try:
        assert remote.http_get(base + "a") == b"hello" and remote.http_get(base + "gone") is None
        assert [remote.http_size(base + x) for x in ("a", "untold", "gone")] == [5, None, None]
        assert b"".join(remote.http_chunks(base + "a")) == b"hello"
        with pytest.raises(OSError):
            list(remote.http_chunks(base + "gone"))
    finally:
        server.shutdown()
    assert remote.http_get(base + "a") is None


def test_sql_functions(spark):
    from paramscan.functions import registry

    registry.register(spark)
    rows = [("a{a}_i{i:03d}.h5", "a0.75_i030.h5"), ("{x}.{y}", "it's.b"), ("{x}.{y}", "none"), (None, "a"), ("{x}", None)]
    spark.createDataFrame(rows, "fmt string, path string").createOrReplaceTempView("formatted")
    got = spark.sql("SELECT path, fmt_match(fmt, path) AS m, fmt_render(fmt, fmt_match(fmt, path)) AS again FROM formatted").collect()
    assert [(r.m, r.again) for r in got] == [({"a": "0.75", "i": "030"}, "a0.75_i030.h5"), ({"x": "it's", "y": "b"}, "it's.b"), (None, None), (None, None), (None, None)]
    registry.register_format(spark, "run", "it's/a{a:f}_{i:03d}-{name}.h5")
    found = spark.sql(r"SELECT run_match(p) AS m, run_render(run_match(p).a, run_match(p).i, run_match(p).name) AS again FROM VALUES ('it\'s/a0.750000_030-x.h5'), ('no') AS t(p)")
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(tuple(r.m) if r.m else None, r.again) for r in found.collect()] == [((0.75, 30, "x"), "it's/a0.750000_030-x.h5"), (None, None)]


@pytest.mark.parametrize(
    "known, given, expected",
    [
        (None, ("origin", None), {"name": "origin"}),
        ({"name": "origin"}, (None, "http://x"), {"name": "origin", "url": "http://x"}),
        ([{"name": "a", "url": "1"}, {"name": "b", "url": "2"}], ("b", "3"), [{"name": "a", "url": "1"}, {"name": "b", "url": "3"}]),
        ([{"name": "a", "url": "1"}], (None, "3"), [{"name": "a", "url": "3"}]),
        ([{"name": "a", "url": "1"}], ("b", "2"), [{"name": "a", "url": "1"}, {"name": "b", "url": "2"}]),
        ([{"name": "a"}, {"name": "b"}], (None, "3"), ValueError),
        ([{"name": "a"}, {"name": "b"}], ("c", None), ValueError),
        ("text", (None, "3"), ValueError),
        (None, (" ", None), ValueError),
    ],
)
def test_remote_by_name(known, given, expected):
    config = {"data": [], "remote": known}
    if expected is ValueError:
        with pytest.raises(ValueError):
            configuration.with_remote(config, *given)
    else:
        assert configuration.with_remote(config, *given) == {"data": [], "remote": expected} and config["remote"] == known


@pytest.mark.parametrize(
    "name, folder, expected",
    [("data.tgz", "root/project/", "root/project/data.tgz"), ("project/data.tgz", "root/project/", "root/project/data.tgz"), ("root/project/data.tgz", "root/project/", "root/project/data.tgz"), ("./other/data.tgz", "root/project/", "other/data.tgz")],
)
def test_manifest_path(spark, name, folder, expected):
    df = spark.createDataFrame([(name, folder)], "n string, d string")
    assert df.select(paths.manifest_path(F.col("n"), F.col("d"))).first()[0] == expected


def test_tsv_codec(spark, tmp_path):
    path = str(tmp_path / "data.tsv")
    df = spark.createDataFrame([("first", "NA"), ("second", None), ('q"t\\', "a\tb\nc")], "sha1 string, name string")
    tables.write_tsv(df, path)
    assert sorted(map(tuple, tables.read_tsv(spark, "file://" + path).collect())) == sorted([("first", "NA"), ("second", ""), ('q"t\\', "a\tb\nc")])
    tables.write_tsv(df, path, null="None")
    assert "second\tNone" in open(path).read()
    assert tables.parse_tsv(spark, "").columns == ["sha1"] and os.listdir(tmp_path) == ["data.tsv"]


def test_yaml(tmp_path):
    path = str(tmp_path / "c.yml")
    tables.dump_yaml({"z": 1, "a": "two\nlines\n", "l": "x" * 200}, path)
    text = open(path).read()
    assert text.index("z:") < text.index("a: |") and tables.load_yaml(path)["l"] == "x" * 200
    open(path, "w").write("")
    assert tables.load_yaml(path) == {}
    open(path, "w").write("- 1")
    with pytest.raises(ValueError):
        tables.load_yaml(path)


@pytest.mark.parametrize("texts, kind", [(["0", "30"], "bigint"), (["0", "0.75"], "double"), (["001", "002"], "string"), (["1e3"], "string"), ([" 5"], "string"), (["+1"], "string"), (["1.0"], "double"), (["inf"], "string"), ([], "string")])
def test_numeric_inference(spark, texts, kind):
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    assert values.numeric_types(df, ["v"]) == {"v": kind}


def test_strict_filters(spark):
    df = spark.createDataFrame([("001", 1, 1.5), ("1", 2, None), (None, None, float("nan"))], "s string, i long, d double")
    n = lambda **k: values.any_filter(df, **k).count()
    assert n(s=1) == 0 and n(s="001") == 1 and n(i="1") == 0 and n(i=1) == 1 and n(i=True) == 1 and n(s=[None]) == 1 and n(s=None) == 0 and n(d=float("nan")) == 0


def test_state(spark):
    one = spark.createDataFrame([(0, "old", "1")], "seq long, sha1 string, number string")
    new = spark.createDataFrame([(0, "new", "1"), (1, "more", "2")], "seq long, sha1 string, number string")
    assert [(r.sha1, r.number) for r in manifest.upsert(one, new).orderBy("seq").collect()] == [("new", "1"), ("more", "2")]
    bare = spark.createDataFrame([(0, "a")], "seq long, sha1 string")
    assert [r.sha1 for r in manifest.upsert(bare, spark.createDataFrame([(0, "b")], "seq long, sha1 string")).collect()] == ["b"]
    nulls = spark.createDataFrame([("a", "p", None), ("b", "p", "NA")], "sha1 string, path string, value string")
    assert manifest.normalised(nulls).columns == ["sha1", "value"] and [r.value for r in manifest.normalised(nulls).collect()] == ["", "NA"]
    text = spark.createDataFrame([("x", None), ("y", 1.0), ("z", float("inf"))], "sha1 string, value double")
    assert [r.value for r in manifest.manifest(text, "{value}.dat").collect()] == [None, "1", "inf"]
    with pytest.raises(ValueError):
        manifest.normalised(text.drop("sha1"))
    many = spark.range(500).selectExpr("concat('p', lpad(id, 4, '0')) as path")
    assert [r.seq for r in manifest.numbered(many).orderBy("path").collect()] == list(range(1, 501))
    many = spark.range(40_000).select(F.sha1(F.col("id").cast("string")).alias("path"), "id")
    assert [r.seq for r in manifest.numbered(many).orderBy("path").select("seq").collect()] == list(range(1, 40_001))


def test_selection(spark):
    rows = [(1, "same", None, None), (2, "same", "SHA1", "A" * 40), (3, "other", None, None), (4, "same", "sha1", "a" * 40)]
    schema = "ord long, path string, algorithm string, checksum string"
    got = [tuple(r) for r in select.select_files(spark.createDataFrame(rows, schema)).collect()]
    assert got == [(1, "same", "sha1", "a" * 40), (3, "other", None, None)]
    with pytest.raises(SelectionError):
        select.select_files(spark.createDataFrame(rows + [(5, "same", "sha1", "b" * 40)], schema))
    with pytest.raises(SelectionError):
        select.select_files(spark.createDataFrame([(1, "x", "md5", "zz")], schema))


def test_checksums(spark):
    df = spark.createDataFrame([("md5", MD5), ("sha1", MD5), ("other", MD5), ("md5", "g" * 32), (None, None)], "a string, v string")
    ok = lambda unknown: [r[0] for r in df.select(checksums.is_valid(F.col("a"), F.col("v"), unknown)).collect()]
    assert ok(False) == [True, False, False, False, False] and ok(True) == [True, False, True, False, False]


def test_streaming_upsert(spark, tmp_path):
    schema = "seq long, sha1 string, k string"
    for n, rows in enumerate([[(1, "a", "x"), (2, "b", "y")], [(3, "c", "x")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        upsert.upsert_stream(stream, str(tmp_path / "out"), ["k"], "seq", str(tmp_path / "checkpoint")).awaitTermination()
    assert {(r.k, r.sha1) for r in upsert.current(spark, str(tmp_path / "out")).collect()} == {("x", "c"), ("y", "b")}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a1.dat").write_text("x")
    run = lambda *a: cli.run(cli.parser().parse_args(["-C", str(tmp_path), *a]), spark)
    assert run("init") == 0 and run("add", "a{n}.dat") == 0 and run("commit", "-m", "one") == 0 and run("status") == 0 and run("log") == 0
    assert run("set-config", "--remote", "http://h") == 0 and run("info") == 0 and run("branch") == 0 and run("download", str(tmp_path / "o"), "--dry-run") == 0
    assert "* main" in capsys.readouterr().out


def test_command_line_in_a_nested_directory(spark, tmp_path, monkeypatch):
    for folder in ("nested", "nested-other"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "data_1.txt").write_text(folder)
    run = lambda *a: cli.run(cli.parser().parse_args(["-C", str(tmp_path), *a]), spark)
    assert run("init") == 0 and run("set-config", "--fmt", "{folder}/data_{number}.txt", "--remote", "http://h", "--remote-name", "origin") == 0
    monkeypatch.chdir(tmp_path / "nested")
    assert run("add", ".") == 0
    data = Dataset(spark, str(tmp_path))
    assert [(r.folder, r.number) for r in data.data().collect()] == [("nested", "1")] and data.config()["remote"] == {"name": "origin", "url": "http://h"}
    monkeypatch.chdir("/")
    assert data.below() == ""
    with pytest.raises(RuntimeError):
        data.add_paths(["x"])


def test_bulk_downloads_are_confirmed(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"a{n}.dat").write_text("x")
    run = lambda *a, ask=input: cli.run(cli.parser().parse_args(["-C", str(tmp_path), *a]), spark, lambda *x: None, ask)
    assert run("init") == 0 and run("add", "a{n}.dat") == 0 and run("commit", "-m", "one") == 0
    said = []
    cli.BULK, old = 2, cli.BULK
    try:
        assert run("download", str(tmp_path / "o"), ask=lambda prompt: said.append(prompt) or "n") == 1 and said
    finally:
        cli.BULK = old
    assert cli.confirmed("?", lambda p: " YES ") and not cli.confirmed("?", lambda p: "")
    with pytest.raises(ValueError):
        cli.prompt_choice("?", {"a"}, lambda p: "b")


def test_clone_downloads_what_the_store_lacks(spark, tmp_path):
    home = tmp_path / "one"
    home.mkdir()
    (home / "a1.dat").write_text("first")
    (home / "a2.dat").write_text("second")
    data = Dataset.init(spark, str(home))
    data.add("a{n}.dat")
    data.set_config(remote="http://h/data")
    data.commit("files")
    sha1 = hashlib.sha1(b"second").hexdigest()
    os.unlink(home / ".hm" / "objects" / sha1[:2] / sha1[2:])
    bodies = {"http://h/data/a2.dat": b"second"}
    Dataset.clone(spark, str(home), str(tmp_path / "two"), fetch=bodies.get)
    assert {p.name: p.read_text() for p in (tmp_path / "two").glob("*.dat")} == {"a1.dat": "first", "a2.dat": "second"}
    Dataset.clone(spark, str(home), str(tmp_path / "three"), fetch_data=False)
    assert [p.name for p in (tmp_path / "three").glob("*.dat")] == ["a1.dat"]
    with pytest.raises(CloneError):
        Dataset.clone(spark, str(home), str(tmp_path / "four"), fetch={}.get)
    assert not (tmp_path / "four").exists()
