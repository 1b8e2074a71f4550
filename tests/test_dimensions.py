import gzip
import hashlib
import json

from samples import utc

from vulntide.operators import dimensions
from vulntide.sources import readers


def item(cve, v3=None, v2=None, texts=(("en", "Text"),), urls=("http://x",), published="2019-09-13T19:35Z"):
    impact = {}
    if v3 is not None:
        impact["baseMetricV3"] = {"cvssV3": {"baseScore": v3}}
    if v2 is not None:
        impact["baseMetricV2"] = {"cvssV2": {"baseScore": v2}}
    return {
        "cve": {
            "CVE_data_meta": {"ID": cve},
            "description": {"description_data": [{"lang": a, "value": b} for a, b in texts]},
            "references": {"reference_data": [{"url": u, "name": "n"} for u in urls]},
        },
        "impact": impact, "publishedDate": published, "configurations": {"nodes": []},
    }


def write_feed(folder, name, items):
    with gzip.open(folder / f"nvdcve-1.1-{name}.json.gz", "wt") as f:
        json.dump({"CVE_data_type": "CVE", "CVE_Items": items}, f, indent=1)


def test_feed_files(spark, tmp_path):
    write_feed(tmp_path, "2018", [
        item("CVE-A", v3=9.8, v2=5.0), item("CVE-B", v2=5.0), item("CVE-C"),
        item("CVE-D", texts=(("es", "x"),), urls=()), item("CVE-E", texts=(("es", "x"), ("en", "1"), ("en", "2"))),
    ])
    write_feed(tmp_path, "modified", [item("CVE-A", v3=1.5, published="2020-01-01T00:00Z")])
    items = dimensions.explode_cve_items(readers.read_cve_feed(spark, f"{tmp_path}/*.json.gz"))
    latest = {r.cve_id: r for r in dimensions.latest_cve(items).collect()}
    assert {k: (r.cvss.version, r.cvss.score) for k, r in latest.items()} == {
        "CVE-A": ("V3", 1.5), "CVE-B": ("V2", 5.0), "CVE-C": ("Unknown", None),
        "CVE-D": ("Unknown", None), "CVE-E": ("Unknown", None),
    }
    assert (latest["CVE-D"].description, latest["CVE-D"].url) == ("", "")
    assert latest["CVE-E"].description == "1"
    first = {r.cve_id: r.published for r in dimensions.first_cve_date(items).collect()}
    assert first["CVE-A"] == utc(2019, 9, 13, 19, 35)
    assert latest["CVE-A"].published == utc(2020, 1, 1)


def test_manifest_and_hash(spark, tmp_path):
    content = b'{"CVE_Items": []}\n'
    digest = hashlib.sha256(content).hexdigest().upper()
    for name, sha in (("2018", digest), ("2019", "0" * 64)):
        with gzip.open(tmp_path / f"nvdcve-1.1-{name}.json.gz", "wb") as f:
            f.write(content)
        lines = ["lastModifiedDate:2020-01-02T03:00:00-05:00", "size:18", "zipSize:9", "gzSize:7", f"sha256:{sha}"]
        (tmp_path / f"nvdcve-1.1-{name}.meta").write_bytes("".join(x + "\r\n" for x in lines).encode())
    (tmp_path / "nvdcve-1.1-2020.meta").write_bytes(b"size:18\r\nsha256:x\r\n")
    manifest = readers.read_feed_manifest(spark, f"{tmp_path}/*.meta")
    rows = {r.feed: r for r in manifest.collect()}
    assert rows["2018"].last_modified == utc(2020, 1, 2, 8) and rows["2018"].gz_size == 7
    assert rows["2018"].error is None and rows["2020"].error == "lastModifiedDate"
    files = readers.read_feed_files(spark, f"{tmp_path}/*.json.gz")
    checked = dimensions.check_feed_hash(files, manifest)
    assert {r.feed: r.hash_ok for r in checked.collect()} == {"2018": True, "2019": False}
    state = spark.createDataFrame([("2018", utc(2020, 1, 2, 8)), ("2019", utc(2020, 1, 1))],
                                  "feed string, last_updated timestamp")
    stale = dimensions.stale_feeds(manifest.filter("error IS NULL"), state)
    assert [r.feed for r in stale.collect()] == ["2019"]


def test_feeds_in_parts(spark):
    files = [("2018", 0, "a"), ("2018", 1, "b"), ("2019", 0, "c"), ("2020", 0, "d"), ("2020", 1, None)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest().upper()
    listed = [("2018", 0, sha("a")), ("2018", 1, sha("b")), ("2019", 0, sha("x")), ("2019", 1, sha("y")), ("2020", 0, sha("d")), ("2020", 1, None)]
    parts = dimensions.check_feed_parts(
        spark.createDataFrame(files, "feed string, part long, content string"),
        spark.createDataFrame(listed, "feed string, part long, sha256 string"),
    )
    rows = {(r.feed, r.part): r for r in parts.collect()}
    assert {k: r.hash_ok for k, r in rows.items()} == {
        ("2018", 0): True, ("2018", 1): True, ("2019", 0): False, ("2019", 1): False, ("2020", 0): True, ("2020", 1): False,
    }
    assert rows["2019", 1].computed_sha256 is None
    feeds = {r.feed: r for r in dimensions.check_whole_feeds(parts).collect()}
    assert {k: (r.n_parts, r.hash_ok) for k, r in feeds.items()} == {"2018": (2, True), "2019": (2, False), "2020": (2, False)}
    assert feeds["2018"].computed_sha256 == sha(sha("a") + sha("b")) == feeds["2018"].expected_sha256
    assert feeds["2019"].computed_sha256 == sha(sha("c") + "-") and feeds["2019"].expected_sha256 == sha(sha("x") + sha("y"))


def advisory(id, cve, **more):
    return {"advisory": "text", "cve": cve, "id": id, "specs": ["<1"], "v": "<1", **more}


def test_advisory_database(spark, tmp_path):
    database = {
        "$meta": {"advisory": "metadata", "timestamp": 1900000001},
        "ambergate": [advisory("pyup.io-11", None)],
        "brindle": [advisory("pyup.io-12", "CVE-2031-77")],
        "cobble": [advisory("pyup.io-13", "CVE-2031-78"), advisory("pyup.io-14", None)],
        "number": [advisory("pyup.io-1", 5)], "none": [],
    }
    (tmp_path / "db.json").write_text(json.dumps(database, indent=2))
    documents = readers.read_advisory_db(spark, str(tmp_path))
    assert documents.count() == 1
    rows = dimensions.flatten_advisories(documents).collect()
    assert {r.id: r.cve_list for r in rows} == {
        "pyup.io-11": None, "pyup.io-12": "CVE-2031-77", "pyup.io-13": "CVE-2031-78",
        "pyup.io-14": None, "pyup.io-1": None,
    }


def test_malformed_advisories_are_told_apart(spark):
    bad = advisory("x", None)
    del bad["v"]
    database = {"a": [bad], "b": [advisory("y", None, specs=[1])], "c": 5, "$meta": {"advisory": "m", "timestamp": None}}
    documents = spark.createDataFrame([(json.dumps(database),)], "document string")
    shapes = {r.package: r["shape"] for r in dimensions.advisory_entries(documents).collect()}
    assert shapes == {"a": "malformed", "b": "malformed", "c": "malformed", "$meta": "meta"}


def test_duplicate_advisories(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", None), ("a", "y"), ("b", None)], "id string, cve_list string")
    assert sorted(map(tuple, dimensions.dedup_advisories(rows).collect())) == [("a", "y"), ("b", None)]
