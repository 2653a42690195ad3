"""Co-bucketed files against a plain version over all rows, the files themselves read by another library."""

import datetime as dt
import hashlib
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from marginalia.llm import cobuckets, queries

SF = "/root/testdata/sf0.001"


def order(row):
    return [(v is not None, v.encode() if isinstance(v, str) else v if v is not None else 0) for v in row]


def sha(values):
    return hashlib.sha256(",".join(values).encode()).hexdigest()


def plain(sales, lines):
    """By (table, bucket): rows in order, the digests, n_joined and, if a starting file is the same, its number."""
    crc = lambda x: zlib.crc32(x.encode()) % 300
    have = Counter(r[0] for r in sales if r[0] is not None)
    home = lambda k: 301 if k is None else crc(f"line{k}")
    starts, finals = (defaultdict(list), defaultdict(list)), (defaultdict(list), defaultdict(list))
    for r in sales:
        b = home(r[0])
        starts[0][b - (b % 3 == 1)].append(r)
        finals[0][b].append((b - (b % 3 == 1), r))
    for r in lines:
        s = 0 if r[2] is None else crc(str(r[2]))
        starts[1][s].append(r)
        finals[1][home(r[0]) if r[0] is None or r[0] in have else 300].append((s, r))
    out = {}
    for t, name in enumerate(("sales", "sale_lines")):
        for b, found in finals[t].items():
            rows = sorted((r for _, r in found), key=order)
            counts = Counter(s for s, _ in found)
            same = [s for s in counts if len(starts[t][s]) == len(found) == counts[s]]
            out[name, b] = {
                "rows": rows,
                "ids": sha(["" if r[0] is None else str(r[0]) for r in rows]),
                "lineage": sha([f"{s}:{n}" for s, n in sorted(counts.items())]),
                "joined": sum(have[r[0]] for _, r in finals[1].get(b, [])) if b < 300 else 0,
                "start": same[0] if same else None,
            }
    return out


def compare(spark, sales, lines):
    got = cobuckets.op12_co_buckets(sales, lines).collect()
    rows = [[tuple(r) for r in df.collect()] for df in (sales, lines)]
    want = plain(*rows)
    assert sorted((r["table_name"], r["bucket"]) for r in got) == sorted(want)
    names = {"sales": sales.columns, "sale_lines": lines.columns}
    for r in got:
        w = want[r["table_name"], r["bucket"]]
        assert r["columns"] == ",".join(names[r["table_name"]])
        assert (r["ids_sha256"], r["lineage_sha256"], r["n_rows"], r["n_joined"]) == (w["ids"], w["lineage"], len(w["rows"]), w["joined"])
        assert r["rewritten"] == (w["start"] is None)
        file = pq.ParquetFile(r["path"].removeprefix("file:"))
        assert file.schema_arrow.names == names[r["table_name"]]
        assert [tuple(x.values()) for x in file.read().to_pylist()] == w["rows"]
    folders = {str(Path(r["path"].removeprefix("file:")).parent) for r in got}
    left = sorted(str(p) for d in folders for p in Path(d).iterdir() if not p.name.endswith(".crc"))
    assert left == sorted(r["path"].removeprefix("file:") for r in got)  # only final data files remain
    return got


def test_given_tables(spark):
    got = compare(spark, queries.table(spark, SF, "sales"), queries.table(spark, SF, "sale_lines"))
    assert {r["rewritten"] for r in got if r["table_name"] == "sales"} == {True, False}
    assert {r["bucket"] for r in got} >= {300, 301}


@pytest.mark.parametrize("seed", [1, 2])
def test_hot_keys_orphans_nulls_repeats_and_small_files(spark, monkeypatch, seed):
    monkeypatch.setattr(cobuckets, "INDEX_ROWS", 3)
    monkeypatch.setattr(cobuckets, "REPEATS", 7)
    rng = random.Random(seed)
    when = [None, dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 3, 4, 5, 6, 7)]
    sales = [(rng.choice([None, *range(60)]), rng.choice(["b", "é", "B", "", None]), rng.choice(when), rng.choice([None, 1.5, -2.0])) for _ in range(90)]
    lines = [(rng.choice([7, 7, 7, None, *range(90)]), rng.randrange(3), rng.choice([None, 5, *range(40)]), rng.choice(["x", None, "é"])) for _ in range(300)]
    lines += [(1000 + seed, 1, 77, "only")] * 2 + lines[:20]
    s = spark.createDataFrame(sales, "sale_id long, number string, bucket timestamp_ntz, k double").repartition(3)
    x = spark.createDataFrame(lines, "sale_id long, line_no int, item_id long, `final` string").repartition(3)
    compare(spark, s, x)


def test_a_starting_file_that_is_a_bucket_stays_and_empty_tables_have_no_files(spark):
    s = spark.createDataFrame([(5, "a"), (5, "b")], "sale_id long, status string")
    x = spark.createDataFrame([(5, 1, 3)] * 3, "sale_id long, line_no int, item_id long")
    assert [r["rewritten"] for r in compare(spark, s, x)] == [False, False]
    assert {r["n_joined"] for r in compare(spark, s, x)} == {6}
    assert {r["bucket"] for r in compare(spark, s.limit(0), x)} == {300}
    assert len(compare(spark, s, x.limit(0))) == 1
    assert compare(spark, s.limit(0), x.limit(0)) == []
