"""Archives against the pages that they were written from, and the chain of records against a walk through the file."""

import hashlib
import os
import random

import numpy as np
import pytest

from oligoflow.llm import common, warc

PAGES = "page_id long, url string, html string, size long, digest string, file string"
MAGIC = "\r\n\r\nWARC/1.1\r\n"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 5, "d", "f") for i, u, h in rows], PAGES)


def by_hand(rows, least=1000):
    keeper = {}
    for i, _, html in rows:
        keeper[html or ""] = max(keeper.get(html or "", -1), -1 if i is None else i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        again = len(data) >= least and keeper[html or ""] > (-1 if i is None else i)
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", keeper[html or ""] if again else None))
    return sorted(out, key=repr)


def record(body, kind="response"):
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x-page:77>\r\nContent-Length: {len(body.encode())}\r\n\r\n{body}"


def sample():
    rng = random.Random(2)
    inner = record("HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi")
    rows = [(i, f"http://a.example/{i}\r\nX: y", "".join(rng.choices(["é", "word ", "<p>", "\r\n", "\n"], k=rng.choice([1, 30, 400])))) for i in range(40)]
    rows += [(100, None, None), (101, "u", ""), (102, "u" + MAGIC, MAGIC), (103, "u", f"x{MAGIC}y"), (104, "u", "x\r\n\r\n"), (105, "u", "x\r\n"), (106, "u", "\r\n\r\n" * 3 + "WARC/1.1\r\n\r\n")]
    rows += [(107, "u", f"a page on archives:\r\n\r\n{inner}\r\n\r\n{inner}\r\n\r\nend"), (108, "u", f"\r\n\r\n{inner}\r\n\r\n"), (109, "u", MAGIC + "Content-Length: 99999999\r\n\r\nz"), (110, "u", f"\r\n\r\n{record('x' * 50)}{MAGIC}Content-Length: 3\r\n\r\nabc"), (111, "u", "\r\n\r\nWARC/1.0\r\nContent-Length: 1\r\n\r\n")]
    rows += [(120 + i, "u", "long repeated payload " * 60 + "é") for i in range(6)] + [(130 + i, "u", "short") for i in range(3)]
    rows += [(140, "u", "edge" * 250), (141, "u", "edge" * 250), (142, "u", "edge" * 249 + "abc"), (143, "u", "edge" * 249 + "abc"), (141, "u", "edge" * 250), (None, "u", "edge" * 250), (None, "u", "no id")]
    rows += [(150 + i, "u", ("filler " * 300 + f"\r\n\r\n{inner}") * 4) for i in range(3)] + [(160, "u", f"big {MAGIC}" * 3000)]
    return rows


@pytest.mark.parametrize(("split", "some"), [("128m", slice(None)), ("4999b", slice(None)), ("97b", slice(40, 55)), ("61b", slice(44, 53))])
def test_pages_come_back(spark, split, some):
    rows = sample()[some]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    folder = common.new_path(spark, "test-warc")
    warc.write_archives(pages(spark, rows).repartition(2), folder)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        got = sorted((tuple(r) for r in warc.read_archives(spark, folder).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == by_hand(rows)


def test_files_are_archives(spark):
    """A walk from record to record, by the lengths that they give, ends with each file."""
    rows, count = sample(), 0
    folder = common.new_path(spark, "test-warc")
    warc.write_archives(pages(spark, rows).repartition(4), folder)
    for name in os.listdir(folder):
        if not name.startswith("part-"):
            continue
        with open(f"{folder}/{name}", "rb") as f:
            data, at = f.read(), 0
        while at < len(data):
            assert data[at : at + 10] == b"WARC/1.1\r\n"
            size, block = warc.header(data[at + 7 :])
            at += 7 + size + block
            assert data[at : at + 4] == b"\r\n\r\n"
            at, count = at + 4, count + 1
    assert count == len(rows)


def test_other_archives_and_broken_ones(spark):
    folder = common.new_path(spark, "test-warc")
    whole = (record("HTTP/1.1 200 OK\r\n\r\nabc") + "\r\n\r\n" + record("no http", "metadata").replace("WARC/1.1", "WARC/1.0") + "\r\n\r\n").encode()
    os.makedirs(folder)
    with open(f"{folder}/one.warc", "wb") as f:
        f.write(whole)
    assert sorted(tuple(r)[1:4] for r in warc.read_archives(spark, folder).collect()) == [(3, hashlib.sha1(b"abc").hexdigest(), "response"), (7, hashlib.sha1(b"no http").hexdigest(), "metadata")]
    for bad in (whole[:-2], whole[:-4], whole + b"junk", whole.replace(b"Content-Length: 22", b"Content-Length: 23")):
        with open(f"{folder}/one.warc", "wb") as f:
            f.write(bad)
        with pytest.raises(ValueError, match="don't lead to its end"):
            warc.read_archives(spark, folder).collect()


def test_compressed_archives(spark):
    rows = sample()
    folder = common.new_path(spark, "test-warc")
    warc.records(pages(spark, rows)).write.option("lineSep", warc.END).option("compression", "gzip").text(folder)
    assert sorted((tuple(r) for r in warc.read_archives(spark, folder).collect()), key=repr) == by_hand(rows)


def test_chains_by_walking():
    rng = random.Random(1)
    for _ in range(50):
        at = np.array(sorted(rng.sample(range(100), rng.randint(1, 30))), np.int64)
        follower = np.array([rng.choice([x for x in at.tolist() if x > a] + [120, 121, -1, a + 1]) for a in at.tolist()], np.int64)
        exit_, first, last = warc._chains(at, follower, 101)
        for i, a in enumerate(at.tolist()):
            seen, x = set(), a
            while x in at.tolist():
                seen.add(x)
                x = follower[at.tolist().index(x)]
            assert exit_[i] == (x if x >= 100 else -1)
            assert seen == {r for j, r in enumerate(at.tolist()) if first[j] <= first[i] <= last[j]}


def test_no_pages(spark):
    assert warc.archive_pages(spark.createDataFrame([], PAGES)).collect() == []
