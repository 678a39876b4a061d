import csv
import io
import json
import random
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from concord.config import CompareConfig, ConfigError, Container, Override, Rule, align_headers, check, common_headers, normalize_headers, parse_keys, rename, scope_rules
from concord.functions import texts
from concord.operators import analysis, revision
from concord.operators.compare import Comparison
from concord.sinks.results import evidence_package, export_html, export_workbook, fitting, write_results
from concord.sinks.workbook import letters, sheet_names, workbook
from concord.sources.csvcheck import after_line, check_csv
from concord.sources.excel import read_excel
from concord.sources.texts import ORDER, open_source, preview, read, text_table


def table(spark, names, rows):
    schema = ", ".join(f"`{n}` string" for n in names.split(",")) + f", {ORDER} long"
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], schema)


def compare(spark, names, left, right, keys="id", right_names=None, **settings):
    return Comparison(table(spark, names, left), table(spark, right_names or names, right), CompareConfig(tuple(keys.split(",")), **settings))


def totals(c):
    s = c.summary.first().asDict()
    assert s["matched_keys"] == s["equal_rows"] + s["changed_rows"]
    assert s["changed_cells"] == sum(r.mismatches for r in c.column_counts.collect())
    for side in ("left", "right"):
        assert s[f"{side}_compared_rows"] == s[f"{side}_rows"] - s[f"{side}_excluded_rows"] - s[f"{side}_duplicate_rows_skipped"] == s["matched_keys"] + s[f"{side}_only"]
    return s


def test_headers():
    names = ["", "column1", "a", "a", "a_1", "  "]
    assert normalize_headers(names) == ["column1_1", "column1", "a", "a_2", "a_1", "column6"]
    assert normalize_headers(normalize_headers(names)) == normalize_headers(names)
    assert align_headers(["Id", "V"], ["ID", "x"]) == ["Id", "x"] and common_headers(["Id", "V", "w"], ["W", "id"]) == ["Id", "w"]
    assert rename(["a", "b"], ["a", "c"]) == (["a", "c"], [(2, "b", "c")])
    for bad in (["a"], ["a", " "], ["a", "A"]):
        with pytest.raises(ConfigError):
            rename(["a", "b"], bad)


def test_keys_and_settings():
    assert parse_keys("002, 003", 1) == (("002",), ("003",)) and parse_keys('[["01","A"]]', 2) == (("01", "A"),)
    for bad, width in (("a,,b", 1), ('[["x"]]', 2), ("nonsense", 2)):
        with pytest.raises(ConfigError):
            parse_keys(bad, width)
    assert scope_rules([Rule("a"), Rule("b")], ["b"]) == (Rule("b"),)
    sides = ["id", "v", "w"], ["id", "v", "w"]
    for bad in (
        CompareConfig(("x",)), CompareConfig(("id",), ("id",)), CompareConfig(("id",), duplicate_policy="any"), CompareConfig(("id",), rules=(Rule("id"),)), CompareConfig(("id",), rules=(Rule("v", tolerance="nan"),)),
        CompareConfig(("id",), rules=(Rule("v", left_date_format="%Y"),)), CompareConfig(("id",), rules=(Rule("v"), Rule("v"))), CompareConfig(("id",), overrides=(Override("id", "a", "b"),)), CompareConfig(("id",), containers=(Container("c", (("a", "b"),)),)),
    ):
        with pytest.raises(ConfigError):
            check(bad, *sides)


def test_composite_key_other_order_and_exact_text(spark):
    left = [("a", "x", "01"), ("a", "y", "2"), ("b", "x", "雪\n\t,"), ("z", "z", "q")]
    right = [("1", "x", "a"), ("2", "y", "a"), ("雪\n\t,", "x", "b"), ("q", "n", "n")]
    c = compare(spark, "id,part,value", left, right, "id,part", "value,part,id")
    s = totals(c)
    assert (s["equal_rows"], s["changed_rows"], s["changed_cells"], s["left_only"], s["right_only"]) == (2, 1, 1, 1, 1)
    r = c.differences.first()
    assert (json.loads(r.key_json), r.column, r.left_value, r.right_value) == (["a", "x"], "value", "01", "1")


def test_duplicates_first_and_last(spark):
    left, right = [("1", x) for x in "abacab"], [("1", x) for x in "abca"]
    left, right = [*[("1", x) for x in "abc"], ("2", "x"), ("3", "y")], [("1", "a"), ("1", "c"), ("2", "x"), ("3", "y")]
    for policy, cells in (("first", 0), ("last", 0)):
        s = totals(compare(spark, "id,v", left, right, duplicate_policy=policy))
        assert (s["changed_cells"], s["left_duplicate_keys"], s["left_duplicate_rows_skipped"], s["right_duplicate_rows_skipped"]) == (cells, 1, 2, 1)
    one_sided = compare(spark, "id,v", [("a", "1"), ("a", "2")], [])
    assert [(r.side, r.occurrences, r.skipped_rows) for r in one_sided.duplicates.collect()] == [("left", 2, 1)] and totals(one_sided)["left_only"] == 1


def test_exclusion_ignored_columns_and_empty_keys(spark):
    c = compare(spark, "id,value,timestamp", [("001", "a", "1"), ("002", "b", "2"), ("003", "c", "3")], [("001", "a", "9"), ("002", "x", "2"), ("004", "d", "4")], ignored_columns=("timestamp",), containers=(Container("x", (("002",), ("003",))),))
    s = totals(c)
    assert (s["equal_rows"], s["right_only"], s["left_excluded_rows"], s["right_excluded_rows"], s["left_compared_rows"]) == (1, 1, 2, 1, 1)
    with pytest.raises(Exception, match="key part is empty"):
        compare(spark, "id,v", [("", "a")], [("b", "a")]).matched_keys.collect()
    assert totals(compare(spark, "id,v", [("", "a"), (None, "b")], [("", "a"), (None, "c")], allow_empty_keys=True))["changed_cells"] == 1


def test_rules_overrides_and_nulls(spark):
    rules = (Rule("amount", tolerance="0.05"), Rule("date", left_date_format="%Y-%m-%d", right_date_format="%d/%m/%Y"), Rule("text", trim=True, ignore_case=True))
    s = totals(compare(spark, "id,amount,date,text", [("1", "10.00", "2026-09-08", " Straße ")], [("1", "10.05", "8/9/2026", "STRASSE")], rules=rules))
    assert (s["changed_cells"], s["rule_equivalent_cells"]) == (0, 3)
    c = compare(spark, "id,v", [("1", None), ("2", ""), ("3", "Y"), ("4", "N")], [("1", ""), ("2", "NULL"), ("3", "N"), ("4", "Y")], overrides=(Override("v", "", "NULL"), Override("v", "Y", "N")))
    assert (totals(c)["changed_cells"], totals(c)["override_equivalent_cells"]) == (2, 2)
    assert {r.left_value for r in c.differences.collect()} == {"[NULL]", "N"}


def test_tolerance_against_decimal(spark):
    rng = random.Random(2)
    values = ["1", "1.0", "1e400", "-0", "abc", "", None, "1_000", "5.", "١", "0.0000000000000000001", "99999999999999999999.5", "1E+3", "1000", "inf", "+2.50", " 1"]
    pairs = [(rng.choice(values), rng.choice(values)) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for t in ("0", "0.5", "1e-30"):
        got = [r.ok for r in df.select(texts.close(F.col("a"), F.col("b"), t).alias("ok")).collect()]
        want = [texts.number(a) is not None and texts.number(b) is not None and abs(texts._EXACT.subtract(texts.number(a), texts.number(b))) <= Decimal(t) for a, b in pairs]
        assert [bool(x) for x in got] == want


def test_patterns(spark):
    rows = [("", "x", "Blank → value"), (" ", "x", "Blank → value"), ("x", "", "Value → blank"), (" a", "a ", "Whitespace only"), ("ß", "SS", "Case only"), (" A", "a", "Case and whitespace"), ("1.0", "1", "Numeric formatting"), ("a", "b", "Other value change"), ("[NULL]", "b", "Other value change")]
    df = spark.createDataFrame(rows, "a string, b string, want string")
    assert df.where(texts.pattern(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_analyses(spark):
    c = compare(spark, "id,part,v,w", [(str(k), "p", "a" * 1200, "s") for k in range(25)], [(str(k), "p", "b", "t" if k < 3 else "s") for k in range(25)], "id,part")
    d = c.differences
    sampled = analysis.samples(d).collect()
    assert sorted(r.place for r in sampled if r.column == "v") == list(range(1, 21)) and sum(r.column == "w" for r in sampled) == 3
    assert all(r.left_value.endswith(" … [truncated]") and r.left_length == 1200 for r in sampled if r.column == "v")
    assert {r.column: r.match_percent for r in analysis.match_rates(c).collect()} == {"v": 0.0, "w": 88.0}
    assert {r.column: r.share for r in analysis.pair_counts(d).collect()} == {"v": 100.0, "w": 100.0}


def test_revision(spark):
    c = compare(spark, "id,v,x", [("1", "a", "1"), ("2", "b", "2"), ("3", "c", "3"), ("4", "d", "4")], [("1", "A", "1"), ("2", "z", "9"), ("3", "c", "3"), ("5", "e", "5")])
    kept = revision.Evidence(c.raw_differences, c.matched_keys, c.left_only, c.right_only)
    after = CompareConfig(("id",), rules=(Rule("v", ignore_case=True),), containers=(Container("x", (("4",),)),))
    n = revision.revise(c, kept, after).counters.first()
    assert (n.original_cells, n.changed_cells, n.accepted_cells, n.left_only, n.right_only, n.equal_rows) == (3, 2, 1, 0, 1, 2)
    assert revision.plan(c.config, after) == ("review", "") and revision.plan(after, c.config)[0] == "full"


def test_text_rendering(spark):
    df = spark.sql("SELECT 1.0D a, 1e20D b, cast('nan' AS double) c, 0.1F d, true e, timestamp'2024-01-02 03:04:05.5' f, date'2024-01-02' g, named_struct('z', 1, 'a', 'q\"') h, array(1, null) i, cast('x' AS binary) j, 1e-5D k, -0.0D l, cast(null AS double) m")
    r = text_table(df).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g) == ("1.0", "1e+20", "nan", "0.10000000149011612", "true", "2024-01-02T03:04:05.500000", "2024-01-02")
    assert (r.h, r.i, r.j, r.k, r.l, r.m) == ('{"a":"q\\"","z":1}', "[1,null]", "base64:eA==", "1e-05", "-0.0", None)


def test_files(spark, tmp_path):
    (tmp_path / "l.csv").write_text('id,v,\n1,"a\n""q""",\n2,,x\n', encoding="utf-8")
    spark.createDataFrame([("1", 'a\n"q"', ""), ("2", None, "x")], "ID string, v string, column3 string").coalesce(1).write.parquet(str(tmp_path / "r.parquet"))
    left, right = read(spark, str(tmp_path / "l.csv")), read(spark, str(tmp_path / "r.parquet"))
    c = Comparison(left, right, CompareConfig(("id",)))
    s = write_results(c, str(tmp_path / "out"))
    assert (s["matched_keys"], s["changed_cells_by_column"]) == (2, {"v": 1, "column3": 0})
    assert json.loads(spark.read.text(str(tmp_path / "out/summary.json")).first().value)["changed_cells"] == 1
    book = export_workbook(c, str(tmp_path / "book"))
    (tmp_path / "b.xlsx").write_bytes(book)
    assert [tuple(r)[:2] for r in read_excel(spark, str(tmp_path / "b.xlsx"), "Summary").collect() if r.total == "matched_keys"] == [("matched_keys", "2")]
    assert "[NULL]" in export_html(c) and preview(left, 1).count() == 1
    assert sheet_names(["a/b", "A:b", "x" * 40, "x" * 50, "History", "", "'q'\x07"]) == ["a b", "A b (2)", "x" * 31, "x" * 27 + " (2)", "History sheet", "sheet", "q"]
    assert [letters(k) for k in (1, 26, 27, 702, 703, 16384)] == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]


def test_a_row_of_another_width_is_an_error(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("id,v\n1\n", encoding="utf-8")
    with pytest.raises(Exception, match="MALFORMED"):
        read(spark, str(tmp_path / "bad.csv")).select("id").collect()


@pytest.mark.parametrize(
    "content, wrong",
    [
        ("a,b\n1,2\n", ""), ('a,b\n"x\n\ny",2\n', ""), ('a,b\n"q""q",\n', ""), ('a,b\n1,x"y\n', ""), ("a,b\r\n1,2\r\n", ""), ('a,b\r\n"x\ny",2\r\n', ""), ('a,b\n"x\r\ny",2\n', ""), ("a,b\r1,2\r", ""), ('a,b\n"1","2"', ""),
        ("a,b\n\n1,2\n", "blank"), ("a,b\n1,2\n\n", "blank"), ('a,b\n"1"x,2\n', "closing"), ('a,b\n1,"2\n', "never closed"), ('a,b\n"1" ,2\n', "closing"), ("a,b\n1\n", "MALFORMED"), ("a,b\n1,2,3\n", "MALFORMED"),
    ],
)
def test_strict_csv(spark, tmp_path, content, wrong):
    (tmp_path / "t.csv").write_bytes(content.encode())
    want = None
    try:
        want = list(csv.reader(io.StringIO(content, newline=""), strict=True))
        assert all(len(r) == len(want[0]) for r in want) == (not wrong)
    except csv.Error:
        assert wrong
    if wrong:
        with pytest.raises(Exception, match=wrong):
            read(spark, str(tmp_path / "t.csv")).select("a").collect()
    else:
        assert [[r.a, r.b] for r in read(spark, str(tmp_path / "t.csv")).orderBy(ORDER).collect()] == want[1:]


def test_csv_state_machine_in_many_splits(spark, tmp_path):
    """Stretches of any size give what one reader of the whole file says."""
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(['"', '""', ",", "\n", "x", "yz"]) for _ in range(rng.randrange(1, 30)))
        lines, state, wrong = text.split("\n")[: None if not text.endswith("\n") else -1], 0, ""
        for line in lines:
            both = [after_line(line, s, ",") for s in (0, 1)]
            state, now = both[state]
            wrong = wrong or now
        try:
            rows = list(csv.reader(io.StringIO(text, newline=""), strict=True))
        except csv.Error:
            assert wrong or state == 1
            continue
        assert bool(wrong) == any(r == [] for r in rows) and state == 0
    (tmp_path / "big.csv").write_text("id,v\n" + "".join(f'{k},"line {k}\n""second"" {"x" * 50}"\n' for k in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        check_csv(spark, str(tmp_path / "big.csv"))
        assert read(spark, str(tmp_path / "big.csv")).count() == 3000
        with (tmp_path / "big.csv").open("a") as f:
            f.write('3000,"open\n')
        with pytest.raises(ValueError, match="never closed"):
            check_csv(spark, str(tmp_path / "big.csv"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_utf16_and_latin1(spark, tmp_path):
    for encoding in ("UTF-16", "ISO-8859-1"):
        path = tmp_path / f"{encoding}.csv"
        path.write_bytes('id;v\r\n1;"é\r\nü"\r\n'.encode(encoding))
        assert [r.v for r in read(spark, str(path), delimiter=";", encoding=encoding).collect()] == ["é\r\nü"]
        path.write_bytes('id;v\r\n1;"é"x\r\n'.encode(encoding))
        with pytest.raises(ValueError, match="closing"):
            read(spark, str(path), delimiter=";", encoding=encoding)


def test_rules_and_kinds_agree_with_plain_python(spark):
    rng = random.Random(6)
    values = ["1", "1.0", " 1 ", "1e0", "ß", "SS", "ss", " Ss", "a", "A", "", " ", "\x1f1", "١", "1_0", "10", None, "2026-01-02", "02/01/2026", "\xa0a", "İ", "i̇", "0.00000000000000000001", "0"]
    rules = [Rule("t", trim=True), Rule("c", ignore_case=True), Rule("tc", trim=True, ignore_case=True), Rule("n", tolerance="0.5", trim=True), Rule("e", tolerance="0"), Rule("d", left_date_format="%Y-%m-%d", right_date_format="%d/%m/%Y"), Rule("x")]
    rows = [(rng.choice([r.column for r in rules] + ["none"]), rng.choice(values), rng.choice(values)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "c string, a string, b string")
    by_column = {r.column: r for r in rules}
    got = df.select("*", texts.accepted_by(rules, F.col("c"), F.col("a"), F.col("b")).alias("ok"), texts.numeric_difference(F.col("a"), F.col("b")).alias("delta")).collect()
    assert all(r.ok == (r.c in by_column and texts.accepts(by_column[r.c], r.a, r.b)) for r in got)
    assert all(r.delta == texts.difference_text(r.a, r.b) for r in got)
    shown = df.where("a is not null and b is not null").select("a", "b", texts.pattern(F.col("a"), F.col("b")).alias("kind")).collect()
    assert all(r.kind == texts.change_kind(r.a, r.b) for r in shown)


def test_stored_evidence_answers_everything(spark, tmp_path):
    c = compare(spark, "id,v,w", [("1", "a", "x"), ("2", "b", "y"), ("2", "c", "y"), ("3", None, "z")], [("1", "A", "x"), ("2", "b", "q"), ("4", "", "")], rules=(Rule("v", ignore_case=True),))
    before = c.summary.first()
    kept = revision.keep(c, str(tmp_path / "kept"))
    assert c.summary.first() == before and kept.raw_differences.count() == 2
    r = revision.revise(c, kept, CompareConfig(("id",), overrides=(Override("w", "y", "q"),), containers=(Container("x", (("3",),)),)))
    assert [(x.column, x.accepted) for x in r.accepted.collect()] == [("w", "override")] and [x.column for x in r.differences.collect()] == ["v"]
    assert [tuple(x) for x in r.excluded.collect()] == [('["3"]', "left_only")] and r.left_only.count() == 0
    first = c.first_duplicates.collect()
    assert [(x.side, x.occurrences, x.place, x["values"]) for x in first] == [("left", 2, 1, ["b", "y"]), ("left", 2, 2, ["c", "y"])]


def test_many_changed_keys_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr("concord.operators.compare.BROADCAST_KEYS", 3)
    rows = [(str(k), str(k)) for k in range(50)]
    c = compare(spark, "id,v", rows + [("7", "again")], [(i, v + "x") for i, v in rows], duplicate_policy="last")
    assert {(r.key_json, r.left_value) for r in c.raw_differences.collect()} == {(f'["{k}"]', "again" if k == 7 else str(k)) for k in range(50)}


def test_null_and_text_places_are_not_confused(spark):
    c = compare(spark, "id,v,w", [("1", None, "a"), ("2", "", None), ("3", None, None)], [("1", "a", None), ("2", None, ""), ("3", None, None)])
    assert c.raw_differences.count() == 4 and totals(c)["equal_rows"] == 1


def test_package_within_its_budget(spark):
    left, right = [(str(k), "v" * 200, str(k % 7)) for k in range(400)], [(str(k), "w" * 200, str((k + 1) % 7)) for k in range(400)]
    c = compare(spark, "id,v,n", left, right)
    notes = spark.createDataFrame([("n", None, "seven"), (None, '["1"]', "key"), ("v", None, "long " * 10_000)], "column string, key_json string, comment string")
    with zipfile.ZipFile(io.BytesIO(evidence_package(c, 8_000, 5, annotations=notes))) as z:
        files = {n: z.read(n).decode() for n in z.namelist()}
    assert sum(map(len, files.values())) <= 32_000 and "seven" in files["comments.csv"] and "long" not in files["comments.csv"]
    assert files["samples.csv"].count("\n") == 11 and "Remarks: 2, left out 1" in files["context.txt"]
    with zipfile.ZipFile(io.BytesIO(evidence_package(c, columns=["n"], annotations=notes))) as z:
        assert "v," not in z.read("columns.csv").decode()
    assert fitting([("a" * 5,), ("b" * 90,), ("c",)], 20) == ([("a" * 5,), ("c",)], 1, 10)
    for bad in ({"tokens": 9}, {"n": 2}, {"columns": ["zz"]}):
        with pytest.raises(ValueError):
            evidence_package(c, **bad)


def test_excel_rules(spark, tmp_path):
    def book(sheet_rows):
        path = tmp_path / f"{abs(hash(sheet_rows))}.xlsx"
        with zipfile.ZipFile(io.BytesIO(workbook({"S": [("x",)]}))) as old, zipfile.ZipFile(path, "w") as new:
            for n in old.namelist():
                new.writestr(n, old.read(n) if "sheet1" not in n else f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{sheet_rows}</sheetData></worksheet>')
            new.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>id</t></si><si><r><t>va</t></r><r><t>lue</t></r><rPh sb="0" eb="1"><t>no</t></rPh></si></sst>')
        return str(path)

    head = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>'
    good = head + '<row r="2"/><row r="3"><c r="A3" t="inlineStr"><is><t>001</t></is></c><c r="B3"><f>1+1</f><v>2</v></c></row><row r="4"><c r="A4" t="b"><v>1</v></c></row>'
    assert [(r.id, r.value) for r in read_excel(spark, book(good)).orderBy(ORDER).collect()] == [("001", "2"), ("TRUE", "")]
    for bad, why in ((head.replace('r="1"', 'r="2"', 1), "first row"), (head + '<row r="2"><c r="A2"><f>1</f></c></row>', "no saved result"), (head + '<row r="2"><c r="C2"><v>1</v></c></row>', "past the header")):
        with pytest.raises(Exception, match=why):
            read_excel(spark, book(bad)).collect()


@pytest.fixture(params=[0, 1 << 62], ids=["keys first", "carried"])
def plan_size(request, monkeypatch):
    monkeypatch.setattr("concord.operators.compare.CARRIED_BYTES", request.param)


def test_both_plans_agree_with_plain_python(spark, plan_size, monkeypatch):
    """Random tables with duplicates, nulls, one-sided and excluded keys, of one chunk of columns and of several."""
    rng = random.Random(8)
    for width, chunk in ((3, 64), (7, 2)):
        monkeypatch.setattr("concord.sources.source.CHUNK", chunk)
        monkeypatch.setattr("concord.operators.compare.CHUNK", chunk)
        names = ",".join(["id", *(f"v{k}" for k in range(width))])
        sides = [[(str(rng.randrange(40)), *(rng.choice(["a", "b", "", None]) for _ in range(width))) for _ in range(60)] for _ in range(2)]
        for policy in ("first", "last"):
            gone = {("3",), ("5",), ("99",)}
            c = compare(spark, names, *sides, duplicate_policy=policy, containers=(Container("x", tuple(gone)),))
            kept = [{}, {}]
            for rows, own in zip(sides, kept, strict=True):
                for r in rows if policy == "last" else reversed(rows):
                    own[r[0]] = r[1:]
            both = {k for k in kept[0] if k in kept[1]} - {k for (k,) in gone}
            want = {(f'["{k}"]', f"v{n}", a, b) for k in both for n, (a, b) in enumerate(zip(kept[0][k], kept[1][k], strict=True)) if a != b}
            assert {tuple(r) for r in c.raw_differences.collect()} == want and c.raw_differences.count() == len(want)
            s = totals(c)
            assert (s["matched_keys"], s["changed_cells"], s["changed_rows"]) == (len(both), len(want), len({w[0] for w in want}))
            assert s["left_excluded_rows"] == sum((r[0],) in gone for r in sides[0]) and s["left_rows"] == 60
            audit = {(json.loads(r.key_json)[0], r.left_rows) for r in c.exclusion_audit.collect()}
            assert audit == {(k, sum(r[0] == k for r in sides[0])) for (k,) in gone}


def test_excluded_keys_from_a_table(spark, plan_size):
    rows = [(str(k), "a") for k in range(50)]
    gone = spark.range(0, 100, 2).selectExpr("to_json(array(string(id))) as key_json", "'even' as container", "'no need' as reason")
    c = Comparison(table(spark, "id,v", rows), table(spark, "id,v", [(i, "b") for i, _ in rows]), CompareConfig(("id",)), gone)
    s = c.summary.first()
    assert (s.left_rows, s.left_excluded_rows, s.matched_keys, s.changed_cells) == (50, 25, 25, 25)


def test_csv_of_several_files_in_their_order(spark, tmp_path, plan_size):
    """Files follow one another by path, whatever their sizes; headers may be in another order, but not of other names."""
    left, right = tmp_path / "a b%20 l.csv", tmp_path / "r.csv"
    left.mkdir()
    (left / "part-0").write_text("id,v\n1,first\n")
    (left / "part-1").write_text("v,id\n" + "second,1\n" + "".join(f"x{k},{k}\n" for k in range(2, 500)))
    right.write_text('id,v\n1,first\n2,"x2"\n3,x\n')
    for policy, cells in (("first", {'["3"]'}), ("last", {'["1"]', '["3"]'})):
        c = Comparison(open_source(spark, str(left)), open_source(spark, str(right)), CompareConfig(("id",), duplicate_policy=policy))
        assert {r.key_json for r in c.raw_differences.collect()} == cells and c.summary.first().left_duplicate_rows_skipped == 1
    (left / "part-2").write_text("id,w\n1,x\n")
    with pytest.raises(ValueError, match="header differs"):
        open_source(spark, str(left))


def test_csv_records_over_many_splits(spark, tmp_path):
    """Quoted records cross splits, some of them several; the result is that of one reader, in its order."""
    rng = random.Random(3)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for n in range(3):
            (tmp_path / f"{n}.csv").mkdir()
            want = []
            for part in range(2):
                rows = [[f"{part}-{k}", "".join(rng.choice(["x", '"', ",", "\n", "é", "\x1f", "\x00", "long " * 30 + "\n"]) for _ in range(rng.randrange(1 + 8 * (n > 0))))] for k in range(60)]
                out = io.StringIO(newline="")
                csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_MINIMAL).writerows([["id", "a\nb"], *rows])
                (tmp_path / f"{n}.csv" / f"p{part}").write_text(out.getvalue(), encoding="utf-8", newline="")
                want += rows
            df = read(spark, str(tmp_path / f"{n}.csv"))
            assert df.rdd.getNumPartitions() > 6 and df.columns == ["id", "a\nb", ORDER]
            assert [[r[0], r[1]] for r in df.orderBy(ORDER).collect()] == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_csv_encodings_and_errors_with_their_place(spark, tmp_path):
    (tmp_path / "w.csv").write_bytes("id,v\r\n1,€uro\r\n".encode("cp1252"))
    assert [tuple(r)[:2] for r in read(spark, str(tmp_path / "w.csv"), encoding="cp1252").collect()] == [("1", "€uro")]
    (tmp_path / "b.csv").write_bytes("﻿id,v\n1,a\n".encode())
    assert read(spark, str(tmp_path / "b.csv")).columns[:2] == ["id", "v"]
    (tmp_path / "e.csv").write_text("id,v\n1,a\n2\n")
    with pytest.raises(Exception, match="MALFORMED record after byte 9 of .*e.csv: expected 2 fields, got 1"):
        read(spark, str(tmp_path / "e.csv")).collect()
    (tmp_path / "n.csv").write_text("")
    with pytest.raises(ValueError, match="no header"):
        read(spark, str(tmp_path / "n.csv"))
    (tmp_path / "h.csv").write_text("id,v\n")
    assert read(spark, str(tmp_path / "h.csv")).count() == 0


def test_parquet_files_in_their_order(spark, tmp_path, plan_size):
    for part, rows in (("a x", [("1", 5, None)]), ("b%", [("1", 6, 1.5), ("2", 7, 2e20)])):
        spark.createDataFrame(rows, "id string, n int, f double").coalesce(1).write.parquet(str(tmp_path / "l.parquet" / f"part={part}"))
    for k in range(20):
        spark.createDataFrame([("1", 100 + k, 0.0), (f"x{k}", k, 0.0)], "id string, n int, f double").coalesce(1).write.mode("append").parquet(str(tmp_path / "m.parquet"))
    left = read(spark, str(tmp_path / "l.parquet"))
    assert [(r.id, r.n, r.f) for r in left.orderBy(ORDER).collect()] == [("1", "5", None), ("1", "6", "1.5"), ("2", "7", "2e+20")]
    c = Comparison(open_source(spark, str(tmp_path / "m.parquet")), open_source(spark, str(tmp_path / "l.parquet")), CompareConfig(("id",), ("f",)))
    first = sorted((tmp_path / "m.parquet").glob("*.parquet"), key=str)[0]
    n = str(next(r.n for r in spark.read.parquet(str(first)).collect() if r.id == "1"))
    assert [(r.left_value, r.right_value) for r in c.raw_differences.collect()] == [(n, "5")]
    assert c.summary.first().left_duplicate_rows_skipped == 19


def test_each_source_is_scanned_twice_at_most(spark, tmp_path, monkeypatch):
    """Large sources: once for the keys, written, once for the columns of changed chunks. Sorting is no part of grouping narrow rows."""
    monkeypatch.setattr("concord.operators.compare.CARRIED_BYTES", 0)
    names = ["id", *(f"c{k}" for k in range(130))]
    for side in ("l", "r"):
        rows = [tuple([str(k), *(["x"] * 70), side if k == 3 else "y", *(["z"] * 59)]) for k in range(20)]
        spark.createDataFrame(rows, names).write.parquet(str(tmp_path / f"{side}.parquet"))
    c = Comparison(*[open_source(spark, str(tmp_path / f"{s}.parquet")) for s in "lr"], CompareConfig(("id",)))
    assert not c.carried
    plan = c.summary._jdf.queryExecution().executedPlan().toString()
    assert [(r.key_json, r.column) for r in c.raw_differences.collect()] == [('["3"]', "c70")]
    reads = [line for line in plan.splitlines() if "FileScan parquet" in line and "c64#" in line]
    assert len(reads) == 2 and not any(f"{c}#" in r for r in reads for c in ("c63", "c128"))
    assert not any(f"{c}#" in plan for c in ("c63", "c128"))
    narrow = Comparison(*[open_source(spark, str(tmp_path / f"{s}.parquet")) for s in "lr"], CompareConfig(("id",), tuple(names[10:])))
    assert "SortAggregate" not in narrow._grouped()._jdf.queryExecution().executedPlan().toString()


def test_dates_on_the_jvm_agree_with_strptime(spark):
    """Random texts and formats: what the shapes decide is what strptime() says, and ordinary dates need no Python."""
    rng = random.Random(9)
    forms = ["%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%Y%m%d", "%Y-%m-%dT%H:%M:%S", "%d.%m.%Y %H:%M", "%H:%M", "%Y", "%d %b %Y", "%Y-%m-%d %%", "%y-%m-%d", "at %Y-%m", "%m%d"]
    assert texts.date_shape("%d %b %Y") is None and texts.date_shape("%y-%m-%d") is None and texts.date_shape("%d%") is None and texts.date_shape("%d-%d") is None

    def moment():
        y, m, d, h, n = rng.choice(["2024", "0000", "1999", "24", "0001", "9999"]), rng.choice(["2", "02", "12", "13", "1", "٣"]), rng.choice(["29", "1", "01", "31", "30", "0", "32"]), rng.choice(["23", "7", "24"]), rng.choice(["59", "5", "60"])
        return rng.choice([f"{y}-{m}-{d}", f"{d}/{m}/{y}", f"{m}/{d}/{y}", f"{y}{m}{d}", f"{y}-{m}-{d}{rng.choice('Tt')}{h}:{n}:{rng.choice(['59', '61', '0'])}", f"{d}.{m}.{y}{rng.choice([' ', '  ', chr(10)])}{h}:{n}", f"{h}:{n}", y, "", "x", f"{y}-{m}-{d}\n", f"{y}-{m}-{d} %", f"at {y}-{m}", f"{m}{d}"])

    for _ in range(12):
        rules = [Rule(f"c{k}", left_date_format=rng.choice(forms), right_date_format=rng.choice(forms), trim=rng.random() < 0.3) for k in range(4)]
        rows = [(rng.choice(rules).column, moment(), moment()) for _ in range(800)]
        df = spark.createDataFrame(rows, "c string, a string, b string")
        by_column = {r.column: r for r in rules}
        got = df.select("*", texts.accepted_by(rules, F.col("c"), F.col("a"), F.col("b")).alias("ok")).collect()
        assert [(r.c, r.a, r.b) for r in got if r.ok != texts.accepts(by_column[r.c], r.a, r.b)] == []
    rule = Rule("d", left_date_format="%Y-%m-%d", right_date_format="%d/%m/%Y")
    known, equal = texts._plain_rule(rule, F.col("a"), F.col("b"))
    plain = spark.createDataFrame([("2024-02-29", "29/02/2024"), ("2024-02-30", "30/2/2024"), ("2024-1-2", "02/01/2024"), ("", "1/1/2024")], "a string, b string")
    assert [tuple(r) for r in plain.select(known, equal).collect()] == [(True, True), (True, False), (True, True), (True, False)]


def test_excluded_keys_of_a_table_in_a_revision(spark, tmp_path):
    c = compare(spark, "id,v", [(str(k), "a") for k in range(9)], [(str(k), "b") for k in range(9)])
    kept = revision.keep(c, str(tmp_path / "kept"))
    few, many = (spark.range(n).selectExpr("to_json(array(string(id))) AS key_json") for n in (2, 5))
    assert revision.plan(c.config, c.config, tables=(few, many)) == ("review", "") and revision.plan(c.config, c.config, tables=(many, few))[0] == "full"
    assert revision.plan(c.config, c.config, tables=(None, few))[0] == "review" and revision.plan(c.config, c.config, tables=(few, None))[0] == "full"
    assert revision.revise(c, kept, c.config, many).counters.first().changed_cells == 4


def test_results_are_in_key_order(spark, tmp_path, plan_size):
    rows = [(f"{k:03d}", "a") for k in range(300)]
    c = compare(spark, "id,v", rows, [(i, "b") for i, _ in reversed(rows)])
    write_results(c, str(tmp_path / "out"))
    keys = []
    for f in sorted((tmp_path / "out/differences.csv").glob("part-*.csv")):
        with open(f, newline="") as h:
            keys += [r[0] for r in list(csv.reader(h))[1:]]
    assert keys == [f'["{i}"]' for i, _ in rows]


def test_folding_of_every_code_point(spark):
    every = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x110000))]
    rows = ["".join(every[k : k + 997]) for k in range(0, len(every), 997)] + every[:3000:7] + ["ßẞŉ", "Straße İ", "Ὀδυσσεύς", ""]
    got = spark.createDataFrame([(x,) for x in rows], "a string").select(texts.folded(F.col("a")).alias("b")).collect()
    assert [r.b for r in got] == [x.casefold() for x in rows]


def test_changed_middle(spark):
    rng = random.Random(2)
    rows = [("".join(rng.choice("ab\U0001f600") for _ in range(rng.randrange(9))), "".join(rng.choice("ab\U0001f600") for _ in range(rng.randrange(9)))) for _ in range(400)]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", texts.changed_middle(F.col("a"), F.col("b")).alias("m"))
    for r in df.collect():
        start = next((k for k in range(min(len(r.a), len(r.b))) if r.a[k] != r.b[k]), min(len(r.a), len(r.b)))
        left = min(len(r.a), len(r.b)) - start
        end = next((k for k in range(left) if r.a[-1 - k] != r.b[-1 - k]), left)
        assert tuple(r.m) == (r.a[:start], r.a[start : len(r.a) - end], r.b[start : len(r.b) - end], r.a[len(r.a) - end :])


def test_a_changed_source_needs_a_full_run(spark, tmp_path):
    (tmp_path / "l.csv").write_text("id,v\n1,a\n")
    (tmp_path / "r.csv").write_text("id,v\n1,b\n")
    c = Comparison(*[open_source(spark, str(tmp_path / f"{s}.csv")) for s in "lr"], CompareConfig(("id",)))
    revision.keep(c, str(tmp_path / "kept"))
    assert not revision.sources_changed(spark, str(tmp_path / "kept"))
    (tmp_path / "r.csv").write_text("id,v\n1,bb\n")
    changed = revision.sources_changed(spark, str(tmp_path / "kept"))
    assert changed and revision.plan(c.config, c.config, changed=changed) == ("full", "a source changed")


def test_preview_ends_within_its_budget(spark):
    df = table(spark, "id,v", [(str(k), "é" * 100) for k in range(50)])
    assert preview(df, 50, most_bytes=1000).count() == 4 and preview(df, 3).count() == 3


def test_cli_with_rules_and_headers(spark, tmp_path, monkeypatch):
    from concord import cli

    monkeypatch.setattr(cli.SparkSession.Builder, "getOrCreate", lambda self: spark)
    (tmp_path / "l.csv").write_text("id,v\n1,A\n")
    (tmp_path / "r.csv").write_text("key,w\n1,a \n")
    base = [str(tmp_path / "l.csv"), str(tmp_path / "r.csv"), "--keys", "id", "--headers", '[["id", "v"], ["id", "v"]]', "--output"]
    assert cli.main([*base, str(tmp_path / "a")]) == 1
    assert cli.main([*base, str(tmp_path / "b"), "--rules", '[{"column": "v", "trim": true, "ignore_case": true}]']) == 0
    assert cli.main([*base, str(tmp_path / "c"), "--rules", '[{"colum": "v"}]']) == 2


def test_supporting_fields_in_the_package(spark):
    left, right = [("1", "a", "x" * 400), ("1", "q", "second"), ("2", "b", None)], [("1", "z", "r"), ("2", "b", "s")]
    c = compare(spark, "id,v,note", left, right, ignored_columns=("note",))
    with zipfile.ZipFile(io.BytesIO(evidence_package(c, 8_000, 1, supporting=["note"]))) as z:
        rows = list(csv.DictReader(io.StringIO(z.read("supporting.csv").decode())))
        assert "Supporting fields: 2, left out 0" in z.read("context.txt").decode()
    assert [(r["side"], r["field"], r["value"], r["length"]) for r in rows] == [("left", "note", "x" * 300, "400"), ("right", "note", "r", "1")]


def test_workbook_escapes():
    from concord.sinks.workbook import MAX_CELL, cell, escaped

    assert escaped("_x0041_ a\x01b _x00_") == "_x005F_x0041_ a_x0001_b _x00_" and "&#13;" in cell("a\rb")
    cell("x" * MAX_CELL)
    with pytest.raises(ValueError):
        cell("\U0001f600" * (MAX_CELL // 2 + 1))


def test_rows_of_a_revision(spark):
    c = compare(spark, "id,v", [("1", "a"), ("1", "b"), ("2", "b"), ("3", "c"), ("9", "x")], [("1", "a"), ("2", "b"), ("4", "d")], containers=(Container("x", (("9",),)),))
    kept = revision.Evidence(c.raw_differences, c.matched_keys, c.left_only, c.right_only)
    after = CompareConfig(("id",), containers=(Container("x", (("9",), ("1",), ("4",))),))
    assert tuple(revision.revise(c, kept, after).rows.first()) == (2, 2, 2, 1)


def test_json_documents_as_files(spark, tmp_path, monkeypatch):
    from concord import cli
    from concord.sources.documents import MAX_BYTES, document_pairs, read_documents, write_documents

    docs = spark.createDataFrame([("a.json", '{"k": [1, 2]}'), ("sub ü/b.json", '"é"'), ("c.json", "[]")], "name string, text string")
    assert write_documents(docs, str(tmp_path / "l")) == 3 and write_documents(docs, str(tmp_path / "l")) == 3  # again: the same files
    assert {tuple(r) for r in read_documents(spark, f"{tmp_path}/l/").collect()} == {tuple(r) for r in docs.collect()}
    (tmp_path / "r" / "sub ü").mkdir(parents=True)
    (tmp_path / "r" / "a.json").write_bytes("\ufeff{\"k\": [1, 3]}".encode())
    (tmp_path / "r" / "note.txt").write_text("not read")
    pairs = {r.name: (r.a, r.b) for r in document_pairs(spark, str(tmp_path / "l"), str(tmp_path / "r")).collect()}
    assert pairs == {"a.json": ('{"k": [1, 2]}', '{"k": [1, 3]}'), "sub ü/b.json": ('"é"', None), "c.json": ("[]", None)}
    assert document_pairs(spark, str(tmp_path / "l" / "a.json"), str(tmp_path / "r" / "a.json")).first().name == ""
    (tmp_path / "none").mkdir()
    assert read_documents(spark, str(tmp_path / "none")).count() == 0
    for content, why in ((b"", "empty"), (b"\"\xff\"", "UTF"), (b" " * (MAX_BYTES + 1), "more than")):
        (tmp_path / "bad.json").write_bytes(content)
        with pytest.raises(Exception, match=why):
            read_documents(spark, str(tmp_path / "bad.json")).collect()

    monkeypatch.setattr(cli.SparkSession.Builder, "getOrCreate", lambda self: spark)
    base = [str(tmp_path / "l" / "a.json"), str(tmp_path / "r" / "a.json"), "--output", str(tmp_path / "out")]
    assert cli.main(base) == 1 and [tuple(r) for r in spark.read.csv(str(tmp_path / "out/differences.csv"), header=True).select("kind", "left_path").collect()] == [("changed", "$.k[1]")]
    assert cli.main([base[0], base[0], *base[2:]]) == 0 and cli.main([*base, "--arrays", '[{"path": "$.k", "mode": "odd"}]']) == 2


def test_record_of_an_empty_key(spark, tmp_path, monkeypatch, capsys):
    from concord import cli

    c = compare(spark, "id,b,v", [("1", "x", "a"), ("2", "y", "a")], [("1", "x", "a"), ("2", "y", "a"), ("3", None, "a"), ("", "", "a")], keys="id,b")
    assert [tuple(r) for r in c.first_empty_keys.collect()] == [("right", 3, '["3",null]')]
    monkeypatch.setattr(cli.SparkSession.Builder, "getOrCreate", lambda self: spark)
    (tmp_path / "l.csv").write_text('id,v\n1,"a\nb"\n,c\n')
    base = [str(tmp_path / "l.csv"), str(tmp_path / "l.csv"), "--keys", "id", "--output", str(tmp_path / "out")]
    assert cli.main(base) == 2 and "left: record 2: empty key component" in capsys.readouterr().err
    assert cli.main([*base, "--allow-empty-keys", "--html"]) == 0 and "Bands" in (tmp_path / "out/report.html").read_text()


def test_page_of_results(spark):
    left = [(str(k), "A" if k % 2 else f"<b>{k}", "x", "same") for k in range(60)]
    right = [(str(k), "a" if k % 2 else f"<b>{k} ", None if k == 3 else "x", "same") for k in range(1, 61)]
    c = compare(spark, "id,many&more,few,none", left, right)
    page = export_html(c, pairs=5, n=2)
    assert "<b>" not in page.replace("<body>", "") and "<script" not in page and "many&amp;more: 59" in page and "few: 1" in page
    assert "none: " not in page and page.count("<details>") == 2 and "<p>25 more</p>" in page  # 30 pairs, five shown
    top = analysis.top_pairs(c.differences, 5).where("column = 'many&more'").orderBy("place").collect()
    assert (top[0].left_value, top[0].right_value, top[0].occurrences, top[0].pairs) == ("A", "a", 30, 30) and len(top) == 5
    assert "N/A" in export_html(compare(spark, "id,v", [("1", "a")], [("2", "a")]))  # no matched key
