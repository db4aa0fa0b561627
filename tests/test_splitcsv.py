"""CSV in many splits a file against one plain reading of it."""

import random

import pytest

from tidemark.sources.readers import read_csv
from tidemark.sources.splitcsv import cells_of


def quoted(rng, k):
    word = rng.choice(["x", "a,b", 'say ""this""', "line\nbreak", "\n\n", "", "é\r\nö", "long " * rng.randrange(60)])
    return f'"{word}"' if set(word) & set('",\n') or k % 7 == 0 else word


def plain(text):
    """Record by record: a line begins one where the quotes before it are even."""
    records, held, quotes = [], [], 0
    for line in text.split("\n")[: -1 if text.endswith("\n") else None]:
        held.append(line)
        quotes += line.count('"')
        if quotes % 2 == 0:
            records.append(cells_of("\n".join(held)))
            held = []
    return records


@pytest.mark.parametrize("split", [64, 997, 1 << 20])
def test_splits_say_what_the_file_says(spark, tmp_path, split):
    rng = random.Random(split)
    text = 'id,"a\nb",c\r\n' + "".join(f"{i},{quoted(rng, i)},{quoted(rng, i + 3)}\r\n" for i in range(300))
    (tmp_path / "t.csv").write_bytes(text.encode())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        df = read_csv(spark, str(tmp_path / "t.csv"))
        assert split > 10_000 or df.rdd.getNumPartitions() > 10
        got = sorted((tuple(r) for r in df.collect()), key=lambda r: int(r[0]))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == [tuple(r) for r in plain(text)[1:]] and len(got) == 300


def test_cells():
    assert cells_of('1,"a ""b"" c",,"",x') == ["1", 'a "b" c', None, "", "x"]
    assert cells_of('ab"cd,e"f\r') == ["abcd,ef"] and cells_of('""""') == ['"'] and cells_of("") == [None]


def test_a_wrong_number_of_cells_names_the_row(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,"x\ny"\n2,z\n3\n')
    with pytest.raises(Exception, match="row 3 of .*t.csv holds 1 cells, not 2"):
        read_csv(spark, str(tmp_path / "t.csv")).collect()


def test_several_files_and_no_last_line_end(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text(f"\ufeffa,b\n{k},x" if k else "a,b\n0,x")
    assert sorted(map(tuple, read_csv(spark, str(tmp_path)).collect())) == [("0", "x"), ("1", "x"), ("2", "x")]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.csv").write_text("a,b\n")
    assert read_csv(spark, str(tmp_path / "none")).collect() == []
