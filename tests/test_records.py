"""Records of CSV files read in many splits, against Python's own reader of whole files."""

from __future__ import annotations

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from leadbook import schema as S
from leadbook.sources import exports, records


@pytest.fixture
def small_splits(spark):
    """Splits of about 200 bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "20"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def cells_to_read(rng):
    parts = ["a", "b c", '"', ",", "\n", "\n\n", "é", "", " ", "x" * 30]
    return "".join(rng.choices(parts, weights=[4, 4, 1, 1, 1, 1, 1, 1, 1, 1], k=rng.randint(0, 5)))


@pytest.mark.parametrize("seed", [1, 2])
def test_records_of_many_splits_equal_the_reader(spark, tmp_path, small_splits, seed):
    rng, want = random.Random(seed), {}
    for f in range(4):
        rows = [["Name", "Phone", "Email", "Budget"]] + [["n" + str(k), *(cells_to_read(rng) for _ in range(3))] for k in range(120)]
        text = io.StringIO()
        csv.writer(text, lineterminator="\n" if f % 2 else "\r\n", quoting=csv.QUOTE_ALL if f == 3 else csv.QUOTE_MINIMAL).writerows(rows)
        (tmp_path / f"f{f}.csv").write_bytes(text.getvalue().encode())
        want[f"f{f}.csv"] = rows
    held = records.file_records(spark, str(tmp_path), lambda line: F.lit(True))
    assert held.select(records.PATH, records.BLOCK).distinct().count() > 40
    got, _ = exports.read_exports(spark, str(tmp_path))
    null = lambda v: None if v in exports.READER_NULL_TOKENS else v
    out = [(r[S.SOURCE_FILE], r["name"], r["phone"], r["email"], r["budget"]) for r in got.orderBy(S.ROW_ORD).collect()]
    assert out == [(f, *(null(v) for v in row)) for f in sorted(want) for row in want[f][1:]]
    assert [r[S.ROW_ORD] for r in got.orderBy(S.ROW_ORD).collect()] == list(range(480))


def test_a_quote_that_is_never_closed_tears_nothing_else(spark, tmp_path, small_splits):
    lines = ["Name,Phone,Email,Budget", 'A,1,"two\nlines",x'] + [f"n{k},{k},,5\" pipe" for k in range(60)] + ['B,2,"open,y'] + [f"m{k},{k},e,z" for k in range(60)]
    (tmp_path / "f.csv").write_text("\n".join(lines) + "\n")
    got, _ = exports.read_exports(spark, str(tmp_path))
    rows = got.orderBy(S.ROW_ORD).collect()
    assert [r["name"] for r in rows] == ["A", *(f"n{k}" for k in range(60)), "B", *(f"m{k}" for k in range(60))]
    assert rows[0]["email"] == "two\nlines" and rows[5]["budget"] == '5" pipe' and rows[-1]["budget"] == "z"


def test_states_of_single_lines(column):
    outside = {"a,b": False, 'a,"b': True, 'a,"b"': False, 'a,""': False, 'a,"""': True, '"a"",b': True, '"a""",b': False, '5" x,y': False, '"a"x,"': True, "": False}
    assert column(lambda c: c.rlike(records._OPENS), list(outside)) == list(outside.values())
    inside = {"a,b": True, 'a"': False, 'a"",b': True, 'a","b': True, 'a","b"': False, '",': False, '"': False, "": True, '""': True, 'a"x,y': False}
    assert column(lambda c: c.rlike(records._STAYS), list(inside)) == list(inside.values())
    wide = '"' + "q" * 200_000 + '",' + '""""' + "," + "p" * 200_000
    assert [len(x) for x in column(records.cells_of, [wide])[0]] == [200_000, 1, 200_000]


def plan_size(df):
    return len(df._jdf.queryExecution().optimizedPlan().toString())


def test_the_plan_does_not_grow_with_the_layouts(spark, tmp_path):
    one, many = tmp_path / "one", tmp_path / "many"
    for folder, n in ((one, 1), (many, 50)):
        folder.mkdir()
        for k in range(n):
            (folder / f"f{k:02d}.csv").write_text(f"Name,Phone,Own {k}" + ",More" * (k % 7) + f"\nA{k},{k},v{k}\n")
    plans = {}
    for folder, n in ((one, 1), (many, 50)):
        held = records.file_records(spark, str(folder), exports._anything)
        layouts = exports._with_layouts(spark, exports._files(held), {})
        assert layouts.count() == n
        plans[n] = plan_size(exports._projected(held, layouts))
    assert abs(plans[50] - plans[1]) < 0.01 * plans[1]
    rows = exports.read_exports(spark, str(many))[0].orderBy(S.ROW_ORD).collect()
    assert [(r["name"], r["extras"][f"Own {k}"]) for k, r in enumerate(rows)] == [(f"A{k}", f"v{k}") for k in range(50)]


def test_lines_of_a_split_are_dealt_in_cuts(spark, tmp_path, monkeypatch):
    """One split of 400 lines with breaks in cells: no task needs to hold it whole, and the row numbers run on."""
    rows = [f'n{k},{k},"two\nlines {k}",x' for k in range(200)] + ['B,2,"' + "\n".join(f"l{k}" for k in range(100)) + '",z', 'C,3,"a\nb",w']
    (tmp_path / "f.csv").write_text("\n".join(["Name,Phone,Email,Budget", *rows]) + "\n")
    monkeypatch.setattr(records, "_CUT_BITS", 4)
    held = records.file_records(spark, str(tmp_path), lambda line: F.lit(True))
    sizes = [r["count"] for r in held.groupBy(records.PATH, records.BLOCK).count().collect()]
    assert len(sizes) > 20 and max(sizes) <= 16
    got = exports.read_exports(spark, str(tmp_path))[0].orderBy(S.ROW_ORD).collect()
    assert [r[S.ROW_ORD] for r in got] == list(range(202))
    assert [r["name"] for r in got] == [*(f"n{k}" for k in range(200)), "B", "C"]
    assert got[5]["email"] == "two\nlines 5" and got[200]["email"].count("\n") == 99 and got[201]["email"] == "a\nb"
