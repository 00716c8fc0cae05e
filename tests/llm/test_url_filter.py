import duckdb
from pyspark.sql import functions as F

from groundline.llm import oracle
from groundline.llm.url_filter import host_reputation, judge_urls, matching_rule, registered_domain, split_url, suffix


def test_hosts_paths_and_rules(spark):
    cases = [
        ("http://Example.ORG/es/1?x#y", "example.org", "/es/1", "example.org/es/", "block"),
        ("https://a.example.org/en/17", "a.example.org", "/en/17", "example.org/en/1", "block"),
        ("https://a.example.org/en/2", "a.example.org", "/en/2", "org/", "allow"),
        ("x://myexample.org/es/", "myexample.org", "/es/", "org/", "allow"),
        ("http://shop.com/fr/a", "shop.com", "/fr/a", "com/fr/", "allow"),
        ("http://shop.com/de/a", "shop.com", "/de/a", "com/de/", "block"),
        ("http://shop.com/en/", "shop.com", "/en/", None, None),
        ("http://shop.org?q=/es/", "shop.org", "", None, None),
        ("http://ÄB.net#/x", "Äb.net", "", None, None),
        ("http://a.net/\nb/c", "a.net", "/\nb/c", None, None),
        ("a://b://c/d", "b:", "//c/d", None, None),
        ("no scheme/de/", "", "", None, None),
        ("://", "", "", None, None),
        ("", "", "", None, None),
        (None, "", "", None, None),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "url string")
    host, path = split_url(F.col("url"))
    parts = df.select("url", host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"))
    assert [tuple(r) for r in parts.select("url", "host", "path", rule, verdict).collect()] == cases


def test_shrinkage_by_level(spark):
    rows = [("good.site.com", 1)] * 60 + [("bad.site.com", 0)] * 60 + [("new.site.com", 0)] + [("a.farm.net", 0)] * 40 + [("b.farm.net", 0)] * 2 + [("c.fine.net", 1)] * 40
    rep = {r["host"]: (r["mean"], r["upper"]) for r in host_reputation(spark.createDataFrame(rows, "host string, good int")).collect()}
    assert rep["bad.site.com"][1] < 0.5 < rep["good.site.com"][0]
    assert rep["new.site.com"][1] > 0.5  # one bad page does not block a host of a mixed domain
    assert rep["b.farm.net"][0] < rep["new.site.com"][0]  # two bad pages of a bad domain weigh more


def test_odd_rows_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://bad.x.io/a"), (2, None), (2, None), (None, "http://bad.x.io/b"), (3, "http://bad.x.io/c")] + [(k, "http://bad.x.io/d") for k in range(10, 60)] + [(k, f"http://ok{k % 3}.y.io/") for k in range(60, 99)], "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("good", F.lit(1)).withColumn("doc_id", F.lit(1))
    labels = spark.createDataFrame([(k, 0, None) for k in range(10, 60)] + [(k, 1, 0) for k in range(60, 99)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").withColumn("url", F.lit("clash"))
    got = [tuple(r) for r in judge_urls(pages, labels).collect()]
    assert len(got) == pages.count()
    verdicts = {(r[1], r[4]) for r in got}
    assert ("bad.x.io", "block") in verdicts and ("ok0.y.io", "allow") in verdicts and ("", "allow") in verdicts
    assert {r[4] for r in judge_urls(pages, labels.limit(0)).collect()} == {"allow"}
    assert judge_urls(pages.limit(0), labels).count() == 0


def test_hosts_without_labels_are_judged_by_domain_suffix_and_overall(spark):
    hosts = [f"h{k % 20}.bad{k % 4}.io" for k in range(400)] + [f"h{k % 20}.good{k % 4}.net" for k in range(400)]
    new = {"new.bad1.io": "block", "bad1.io": "block", "x.unseen.io": "block", "new.good1.net": "allow", "x.unseen.net": "allow", "x.y.zz": "allow"}
    pages = spark.createDataFrame([(k, f"http://{h}/a") for k, h in enumerate([*hosts, *new])], "page_id long, url string")
    labels = spark.createDataFrame([(k, int("good" in h), 0) for k, h in enumerate(hosts)], "doc_id long, quality int, toxic int")
    rows = judge_urls(pages, labels).collect()
    assert len(rows) == len(hosts) + len(new)
    assert {r["host"]: r["verdict"] for r in rows if r["host"] in new} == new
    bad = spark.createDataFrame([(k, 0, 0) for k in range(len(hosts))], "doc_id long, quality int, toxic int")
    assert {r["verdict"] for r in judge_urls(pages, bad).filter("host = 'x.y.zz'").collect()} == {"block"}


def test_registered_domains(spark):
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.y.com": ("y.com", "com"), "com": ("com", "com"), "": ("", "")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert {r[0]: (r[1], r[2]) for r in df.select("host", registered_domain(F.col("host")), suffix(F.col("host"))).collect()} == hosts


def test_sql_gives_the_same_verdicts_for_planted_hosts(spark, tmp_path):
    """Bad and good domains with many hosts, and hosts without any label, in Spark and in the query's SQL."""
    labelled = [f"h{k % 30}.spam.net" for k in range(120)] + [f"h{k % 30}.fine.net" for k in range(120)] + [f"h{k % 9}.bad{k % 5}.co.uk" for k in range(90)] + ["", "solo"]
    new = ["new.spam.net", "new.fine.net", "x.unseen.net", "x.bad9.co.uk", "co.uk", "a.b.zz", ""]
    pages = spark.createDataFrame([(k, f"http://{h}/a") for k, h in enumerate([*labelled, *new])], "page_id long, url string")
    labels = spark.createDataFrame([(k, int("fine" in h), 0) for k, h in enumerate(labelled)], "doc_id long, quality int, toxic int")
    duck = duckdb.connect()
    for name, df in (("pages", pages), ("labels", labels)):
        df.write.parquet(str(tmp_path / name))
        duck.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path / name}/*.parquet'")
    key = lambda r: r[0]
    got = sorted(map(tuple, judge_urls(pages, labels).collect()), key=key)
    assert got == sorted(duck.sql(oracle.url_filters()).fetchall(), key=key)
    verdict = {r[1]: r[4] for r in got}
    assert verdict["new.spam.net"] == "block" and verdict["new.fine.net"] == verdict[""] == "allow"


def test_pages_without_a_host_have_no_reputation(spark):
    """Bad labels of pages without a url block none of them, and no other host."""
    pages = spark.createDataFrame([(k, None if k % 2 else "no scheme") for k in range(60)] + [(100, "http://new.example/a"), (101, "http://fine.example/a")], "page_id long, url string")
    labels = spark.createDataFrame([(k, 0, 1) for k in range(50)] + [(101, 1, 0)], "doc_id long, quality int, toxic int")
    rows = judge_urls(pages, labels).collect()
    assert len(rows) == 62 and {r["verdict"] for r in rows} == {"allow"}
    assert {r["verdict"] for r in judge_urls(pages, labels.filter("doc_id < 50")).collect()} == {"allow"}
