"""Lines judged by the bytes of many, against a look at each of them."""

import csv
import io
import random
import re

import pyarrow as pa
import pytest

from concord.plans import more
from concord.sources import csvcheck
from concord.sources.csvcheck import Block, after_line, open_csv, records, walk
from concord.sources.source import ODD, ORDER, SEPARATOR
from concord.sources.texts import read


def states(lines, state, delimiter):
    out = []
    for line in lines:
        state, wrong = after_line(line, state, delimiter)
        if wrong:
            return out, wrong
        out.append(state)
    return out, ""


def test_blocks_of_lines_say_what_each_line_says():
    rng, met = random.Random(5), 0
    for _ in range(20_000):
        end, sign, state = rng.choice(["\n", "\r\n", "\r"]), rng.choice([",", ";", SEPARATOR]), rng.choice([0, 1])
        parts = rng.choice([['"', '""', sign, "x", "é", SEPARATOR, ODD, "\r", "\n"], ['""', sign, '"a"', '"', "é"], ['"a"', sign, '"b""c"', '"\r"', f'"{end}"', f'"é{sign}"']])
        lines = "".join(rng.choice([*parts, end]) for _ in range(rng.randrange(1, 14))).split(end)
        values = pa.array(["before", *lines, "after"], pa.string()).slice(1, len(lines))
        want, wrong = states(lines, state, sign)
        got, said = walk(values, state, sign, end)
        assert said == wrong and (wrong or got.tolist() == want)
        block = Block.of(values, state, sign, end)
        if block is None or state:
            continue
        assert not wrong and block.after.tolist() == want
        begins = [k for k in range(len(lines)) if k == 0 or want[k - 1] == 0]
        left = begins.pop() if want[-1] else len(lines)
        stops = [*begins[1:], left]
        fields = records([end.join(lines[a:z]) for a, z in zip(begins, stops, strict=True)], sign) if begins else []
        found = block.records(sign, end, len(fields[0]) if fields else 2)
        if len({len(f) for f in fields}) > 1:
            assert found is None
            continue
        first, texts, other, open_from = found
        assert (first.tolist(), open_from) == (begins, left)
        for text, odd, f in zip(texts.to_pylist(), other.tolist(), fields, strict=True):
            assert odd if any(SEPARATOR in x or ODD in x for x in f) else odd or text.split(SEPARATOR) == f
            met += not odd
    assert met > 2000


def test_quotes_in_their_places_are_not_looked_at_line_by_line(monkeypatch):
    def looked_at(*args):
        raise AssertionError("one line alone")

    monkeypatch.setattr(csvcheck, "after_line", looked_at)
    values = pa.array([x for k in range(5000) for x in (f'"{k}","a ""quote""', ',","b"')])
    assert walk(values, 0, ",", "\n")[0].tolist() == [1, 0] * 5000


@pytest.mark.parametrize("long", [40, 6000])
def test_records_over_splits_take_no_scan_of_their_own_unless_they_are_long(spark, tmp_path, long):
    rng = random.Random(7)
    rows = [[f"{k}", "".join(rng.choice(["x" * long if k % 9 == 0 else "x", '"', ",", "\n", "é"]) for _ in range(20))] for k in range(60)]
    (tmp_path / "t.csv").mkdir()
    for part in range(2):
        out = io.StringIO(newline="")
        csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_ALL).writerows([["id", "v"], *rows[part * 30 : part * 30 + 30]])
        (tmp_path / "t.csv" / f"p{part}").write_text(out.getvalue(), encoding="utf-8", newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        plan = open_csv(spark, str(tmp_path / "t.csv")).rows._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall(r"Relation ?\[[^]]*\] text", plan)) == (1 if long < 100 else 2)
        assert [[r.id, r.v] for r in read(spark, str(tmp_path / "t.csv")).orderBy(ORDER).collect()] == rows
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_files_grow_in_number_with_the_rows(spark, tmp_path, monkeypatch):
    """Files of a bounded number of rows, more than an expression tells apart, in the order of their rows; the result is the same."""
    path, folders = "/root/testdata/sf0.001", []
    want = sorted(map(tuple, more.csv_duplicates(spark, path).collect()))
    monkeypatch.setattr(more, "_FILE_ROWS", 300)
    monkeypatch.setattr(more, "open_source", lambda s, p: folders.append(p) or open_csv(s, p))
    assert sorted(map(tuple, more.csv_duplicates(spark, path).collect())) == want
    assert all(len(open_csv(spark, p).rows.inputFiles()) == 20 for p in folders)
