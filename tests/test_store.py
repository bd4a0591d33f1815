import hashlib
import os

import pytest

from paramscan import config
from paramscan.errors import CheckoutError, DestinationExistsError
from paramscan.operators.frame import ParamFrame
from paramscan.store import Dataset, branch_name


def fill(folder, a=(0, 0.75), i=(0, 30)):
    os.makedirs(folder, exist_ok=True)
    for x in a:
        for y in i:
            (folder / f"a{x}_i{y}.h5").write_text(f"{x} {y}\n")


def test_filter_algebra(spark, tmp_path):
    for a in range(10):
        os.makedirs(tmp_path / f"a_{a}")
        for b in range(1, 11):
            (tmp_path / f"a_{a}" / f"b_{b}.txt").write_text("x")
    pf = ParamFrame.parse(spark, "a_{a:d}/b_{b:d}.txt", str(tmp_path))
    count = lambda f: f.df.count()
    assert count(pf) == 100 and dict(pf.df.dtypes) == {"path": "string", "a": "bigint", "b": "bigint"}
    assert count(pf(a=0)) == 10 and count(pf(a=[0, 1])) == 20 and count(pf(a=0, b=10)) == 19 and count(pf(a=0)(b=10)) == 1
    assert count(pf[(pf.df.a >= 1) & (pf.df.a <= 4)]) == 40 and count(pf()) == 0
    assert count(ParamFrame.parse(spark, "a_{a:d}/b_{b:d}.txt", str(tmp_path), a=3)) == 10
    with pytest.raises(KeyError):
        pf(zzz=1)


def test_encoding_and_odd_names(spark, tmp_path):
    os.makedirs(tmp_path / "encoded")
    for i in (0, 30):
        (tmp_path / "encoded" / f"am0.5_i{i}.h5").write_text("x")
    (tmp_path / "_under_1.dat").write_text("x")
    (tmp_path / ".hidden_1.dat").write_text("x")
    os.makedirs(tmp_path / "dir_2.dat")
    encodings = [{"fmt": "encoded/a{aspin}_i{i}.h5", "encoding": {"aspin": r"m([0-9]+(\.[0-9]+)?|\.[0-9]+)"}}]
    rows = ParamFrame.parse(spark, "encoded/a{aspin}_i{i}.h5", str(tmp_path), encodings, encoding=True).df.collect()
    assert {(r.aspin, r.i) for r in rows} == {(-0.5, 0), (-0.5, 30)} and rows[0].path == "encoded/am0.5_i0.h5"
    names = [r.path for r in ParamFrame.parse(spark, "{a}_{n}.dat", str(tmp_path)).df.collect()]
    assert names == ["_under_1.dat"]


def test_add_commit_status_checkout(spark, tmp_path):
    root = tmp_path / "set"
    fill(root)
    data = Dataset.init(spark, str(root))
    assert data.add("a{a}_i{i}.h5").count() == 4
    assert [tuple(r) for r in data.data().select("a", "i").orderBy("a", "i").collect()] == [("0", "0"), ("0", "30"), ("0.75", "0"), ("0.75", "30")]
    assert data.commit("first") and not data.commit("again")
    (root / "a0_i0.h5").write_text("changed")
    os.unlink(root / "a0_i30.h5")
    (root / "extra.h5").write_text("x")
    found = data.status()
    assert found["worktree"] == {"modified": ["a0_i0.h5"], "deleted": ["a0_i30.h5"]} and found["untracked"] == ["extra.h5"]
    assert found["staged"] == {"state": [], "added": [], "modified": [], "deleted": []}
    with pytest.raises(CheckoutError):
        data.checkout("other")
    data.add("a{a}_i{i}.h5")  # upsert keeps the row of the deleted file
    assert data.data().count() == 4
    data.add(".")  # a new scan drops it
    assert data.data().count() == 3
    assert data.commit("second") and [c["message"] for c in data.log()] == ["second", "first", "Initial commit"]
    data.checkout("other")
    (root / "a9_i9.h5").write_text("new")
    data.add(".")
    data.commit("third")
    data.checkout("main")
    assert not (root / "a9_i9.h5").exists() and data.branches() == {"current": "main", "names": ["main", "other"]}
    (root / "a9_i9.h5").write_text("in the way")
    with pytest.raises(CheckoutError):
        data.checkout("other")
    assert (root / "a9_i9.h5").read_text() == "in the way"
    os.unlink(root / "a9_i9.h5")
    data.checkout("other")
    assert (root / "a9_i9.h5").read_text() == "new"
    copy = Dataset.clone(spark, str(root), str(tmp_path / "copy"))
    assert (tmp_path / "copy" / "a9_i9.h5").read_text() == "new" and copy.status()["worktree"] == {"modified": [], "deleted": []}
    with pytest.raises(DestinationExistsError):
        Dataset.clone(spark, str(root), str(tmp_path / "copy"))
    tree = data.add_worktree("main")
    assert sorted(p for p in os.listdir(tree.root) if p != ".hm") == ["a0.75_i0.h5", "a0.75_i30.h5", "a0_i0.h5"]


def test_failed_checkout_is_undone(spark, tmp_path):
    root = tmp_path / "set"
    fill(root)
    data = Dataset.init(spark, str(root))
    data.add("a{a}_i{i}.h5")
    data.commit("first")
    data.checkout("other")
    first = (root / "a0_i0.h5").read_text()
    (root / "a0_i0.h5").write_text("changed")
    os.unlink(root / "a0_i30.h5")
    (root / "a7_i7.h5").write_text("only here")
    data.add(".")
    data.commit("second")
    before = {p.name: p.read_text() for p in root.glob("*.h5")}
    sha1 = hashlib.sha1(first.encode()).hexdigest()
    stored = root / ".hm" / "objects" / sha1[:2] / sha1[2:]
    stored.write_text("damaged")
    with pytest.raises(CheckoutError, match="undone"):
        data.checkout("main")
    assert {p.name: p.read_text() for p in root.glob("*.h5")} == before and data.branch == "other" and not (root / ".hm" / "backup").exists()
    stored.write_text(first)
    data.checkout("main")
    assert (root / "a0_i0.h5").read_text() == first and not (root / "a7_i7.h5").exists() and (root / "a0_i30.h5").exists()
    (root / "a0_i0.h5").write_text("dirty")
    with pytest.raises(CheckoutError, match="a0_i0.h5"):
        data.ensure_clean()


@pytest.mark.parametrize("name", ["", "-x", "a..b", "a b", "x.lock", "/a", "a/", "a@{b", "a~b"])
def test_bad_branch_names(name):
    with pytest.raises(ValueError):
        branch_name(name)


def test_configuration():
    assert config.remotes("http://x") == [{"url": "http://x"}]
    with pytest.raises(ValueError):
        config.remotes(["http://x", "http://y"])
    assert config.entry_checksum({"md5": "a", "sha256": "b"}) == ("sha256", "b")
    assert config.build_entries([{"fmt": "{a}", "db": "x"}])[0]["db"] == "x.tsv"
    with pytest.raises(ValueError):
        config.build_entries([{"fmt": "{a}", "db": "x"}, {"fmt": "{a}", "db": "y"}])
