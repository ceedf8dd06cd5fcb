"""Archive members and nested settings files."""

import gzip
import io
import os
import tarfile
import time

import pytest

from millrace.sources import members, nested_yaml


def tar(contents):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, data in contents.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_archives_larger_than_a_batch_are_dealt_by_member(spark, tmp_path, monkeypatch):
    """12 MB of pages in one archive, one packed archive inside, and one inside that."""
    body = lambda n: os.urandom(10_000).hex().encode() + str(n).encode()
    outer = {f"o/{i}.html": body(i) for i in range(600)}
    inner = {f"i/{i}.html": body(i) for i in range(40)} | {"deep.tar": tar({"deep/d.html": b"deepest", "x.txt": b"no"})}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tar").write_bytes(tar(outer | {"b.tgz": gzip.compress(tar(inner)), "c.txt": b"no page"}))
    (tmp_path / "in" / "c.tar.gz").write_bytes(gzip.compress(tar({"c/e.html": b"", "c/f.html": b"packed"})))
    (tmp_path / "in" / "none.tar").write_bytes(tar({}))
    assert os.path.getsize(tmp_path / "in" / "a.tar") > 2 * members.BATCH_BYTES
    places = members.headers(spark, str(tmp_path / "in"))
    assert places.count() == 600 + 1 + 1
    df = members.archive_pages(spark, str(tmp_path / "in"))
    got = {r.name: bytes(r.content) for r in df.collect()}
    want = outer | {k: v for k, v in inner.items() if k.endswith(".html")} | {"deep/d.html": b"deepest", "c/e.html": b"", "c/f.html": b"packed"}
    assert got == want and df.count() == len(want)
    from pyspark.sql import functions as F

    tasks = df.where("name LIKE 'o/%'").groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) > 1 and max(r["count"] for r in tasks) < 600


def test_a_file_that_is_no_archive_is_an_error(spark, tmp_path):
    (tmp_path / "bad.tar").write_bytes(b"not a tar file" * 100)
    with pytest.raises(Exception, match="tar|header|ReadError"):
        members.archive_pages(spark, str(tmp_path)).count()


TEXT = """# a comment
versions:
  min: 8.1
  max: '18'
featurematrix:
  Backend & more:
  - name: 64-bit "large" objects
    versions:
      '9.3': 'Yes'
      "10": "No: \\u00e9 # kept"
    description: Large objects are now
      carried on here: not a key in the middle? no
  - name: 'It''s'
    tags: []
    more:
    - a
    - - b
      - c
    - k: v
      l: w
  Other:
    -   name: wide
        url: https://example.org/x#y
legacymap:
  1: one
  2:
  3: ~
"""


def flat(value, keys=()):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from flat(v, (*keys, str(k)))
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from flat(v, (*keys, str(i)))
    else:
        yield list(keys), None if value is None else str(value)


def test_leaves_of_the_subset():
    got = dict((tuple(k), v) for k, v in nested_yaml.leaves(TEXT.replace(" here: not a key in the middle? no", " here")))
    assert got[("versions", "min")] == "8.1" and got[("versions", "max")] == "18"
    b = ("featurematrix", "Backend & more")
    assert got[(*b, "0", "name")] == '64-bit "large" objects'
    assert got[(*b, "0", "versions", "10")] == "No: é # kept"
    assert got[(*b, "0", "description")] == "Large objects are now carried on here"
    assert got[(*b, "1", "name")] == "It's" and (*b, "1", "tags") not in got
    assert [got[(*b, "1", "more", *k)] for k in (("0",), ("1", "0"), ("1", "1"), ("2", "k"), ("2", "l"))] == ["a", "b", "c", "v", "w"]
    assert got[("featurematrix", "Other", "0", "url")] == "https://example.org/x#y"
    assert got[("legacymap", "1")] == "one" and got[("legacymap", "3")] is None


def test_leaves_equal_a_yaml_library():
    yaml = pytest.importorskip("yaml")
    text = TEXT.replace(" here: not a key in the middle? no", " here").replace("  2:\n", "")
    want = [(k, v) for k, v in flat(yaml.load(text, yaml.BaseLoader)) if v != "[]"]
    want = [(k, None if v == "~" else v) for k, v in want]
    assert [(k, v) for k, v in nested_yaml.leaves(text)] == want
    assert list(nested_yaml.leaves("")) == []


@pytest.mark.parametrize("text", ["a: [1, 2]", "a: &x 1", "a: |\n  text", "\ta: 1", "a: 'open", "a: 1\nb"])
def test_other_notations_are_refused(text):
    with pytest.raises(ValueError, match="line"):
        list(nested_yaml.leaves(text))


def test_only_changed_files_are_read_again(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.yaml").write_text(f"featurematrix:\n  {n}:\n  - name: {n}1\n    versions:\n      '9.3': 'Yes'\n")
    held = nested_yaml.Reloaded(spark, str(tmp_path))
    shown = lambda: sorted(tuple(r) for r in nested_yaml.features(held.rows()).collect())
    assert shown() == [("a", "a1", "9.3", "Yes"), ("b", "b1", "9.3", "Yes")] and held.reads == 2
    assert len(shown()) == 2 and held.reads == 2
    time.sleep(0.02)
    (tmp_path / "b.yaml").write_text("featurematrix:\n  b:\n  - name: b2\n    versions:\n      '10': 'No'\n")
    (tmp_path / "c.yml").write_text("featurematrix: {}\n")
    assert shown() == [("a", "a1", "9.3", "Yes"), ("b", "b2", "10", "No")] and held.reads == 4
    os.remove(tmp_path / "a.yaml")
    assert shown() == [("b", "b2", "10", "No")] and held.reads == 4


def test_one_partition_a_file(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"{n}.yaml").write_text(f"a: {n}\n")
    df = nested_yaml.read_yaml(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 3 and sorted(r.value for r in df.collect()) == ["0", "1", "2"]


def test_fixtures_lists_and_concatenated_files(spark, tmp_path):
    from millrace.sources import files

    (tmp_path / "a.json").write_text('[{"model": "m.x", "pk": 1, "fields": {"n": "one", "k": 5, "gone": null}}, {"model": "m.x", "fields": {"n": "no key"}}, {"model": "m.y", "pk": 2, "fields": {}}]')
    rows = files.fixtures(spark, str(tmp_path / "a.json"))
    got = sorted(((r.pk, r.n, r.k) for r in files.fixture_rows(rows, "m.x", "n string, k int").collect()), key=str)
    assert got == [("1", "one", 5), (None, "no key", None)]
    assert files.fixture_rows(rows, "m.z", "n string").count() == 0
    (tmp_path / "l.json").write_text('[{"name": "g", "sortkey": 1, "lists": [{"name": "a"}, {"name": "b", "active": false}]}, {"name": "h", "lists": []}]')
    assert sorted((r.listname, r.active) for r in files.list_info(spark, str(tmp_path / "l.json")).collect()) == [("a", True), ("b", False)]
    for n, t in (("x.css", "x\n"), ("y.css", "ü")):
        (tmp_path / n).write_text(t)
    os.utime(tmp_path / "x.css", (1_700_000_000, 1_700_000_000))
    r = files.concatenated(spark, str(tmp_path), ["y.css", "x.css"]).first()
    assert r.content == "üx\n" and r.version.timestamp() > 1_700_000_000
    with pytest.raises(Exception, match="z.css|exist"):
        files.concatenated(spark, str(tmp_path), ["z.css"]).collect()
