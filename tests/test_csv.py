"""CSV over several files in the order of paths and records."""

import csv as plain
import random

import pytest

from marginalia.sources import files


@pytest.mark.parametrize("block", [150, 1 << 20])
def test_ordered_csv_keeps_files_and_records_in_order(spark, tmp_path, block):
    rng = random.Random(block)
    words = ["a", 'say "x"', "two\nlines", "", "é,", "\n\n", "end\r", '""', "plain words here"]
    want = []
    for folder in ("b", "a"):  # files of one name in two folders
        for name in ("one.csv", "two.csv"):
            path = tmp_path / folder / name
            path.parent.mkdir(exist_ok=True)
            rows = [(str(i), rng.choice(words), rng.choice(words)) for i in range(12)]
            order = [0, 1, 2] if name == "one.csv" else [2, 0, 1]
            with path.open("w", newline="", encoding="utf-8-sig" if folder == "a" else "utf-8") as f:
                out = plain.writer(f, lineterminator="\n" if folder == "a" else "\r\n")
                out.writerow([("id", "text", "more")[k] for k in order])
                out.writerows([r[k] for k in order] for r in rows)
            want.append((str(path), name, rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = files.csv(spark, [str(tmp_path / "b"), str(tmp_path / "a")], "id string, text string, more string", ["id"], ordered=True)
        got = [(r["source_file"], r["id"], r["text"] or "", r["more"] or "") for r in df.orderBy("_ord").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [(name, *r) for _, name, rows in sorted(want) for r in rows]


def test_ordered_csv_without_rows_and_with_repeated_columns(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,b\n")
    assert files.csv(spark, str(tmp_path / "x.csv"), "id string", ordered=True).count() == 0
    (tmp_path / "y.csv").write_text("id,id\n1,2\n")
    with pytest.raises(files.SourceError, match="repeated"):
        files.csv(spark, str(tmp_path / "y.csv"), ordered=True)
    with pytest.raises(files.SourceError, match="missing columns: c"):
        files.csv(spark, str(tmp_path / "x.csv"), required=["c"], ordered=True)
