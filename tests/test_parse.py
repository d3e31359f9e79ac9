import csv
import datetime
import io
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from limpid.operators import parse


#: Lines of very many fields, quotes or characters.
LONG = [
    "," * 100_000, '"' + "," * 100_000 + '"', '"a",' * 50_000, '"a",' * 50_000 + 'b"', '""' * 50_000, '"' + '""' * 50_000 + '"', "x" * 300_000, ",".join(["a"] * 1023), ",".join(["a"] * 1024), ",".join(["a"] * 30_000),
    '"http://a.b/' + "," * 1500 + '",joe,2024-01-02T03:04:05,7,1', '"http://a.b/' + "," * 2100 + '",joe,2024-01-02T03:04:05,7,1', "a,b,c,d," + "e" * 200_000,
]


def judge(line):
    """Brute force, by a state machine."""
    if line is None:
        return "columns"
    fields, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            j, text = i + 1, ""
            while True:
                if j >= len(line):
                    return "quoting"
                if line[j] == '"':
                    if line[j + 1 : j + 2] == '"':
                        text, j = text + '"', j + 2
                        continue
                    break
                text, j = text + line[j], j + 1
            j += 1
            if j < len(line) and line[j] != ",":
                return "quoting"
        else:
            j = line.find(",", i)
            j = len(line) if j < 0 else j
            text = line[i:j]
            if '"' in text:
                return "quoting"
        fields.append(text)
        if j >= len(line):
            break
        i = j + 1
    if len(fields) != 5:
        return "columns"
    url, name, seen, source, hits = fields
    good = len(url.encode()) <= 2048 and re.fullmatch(r"[A-Za-z0-9_]+://[A-Za-z0-9.\-]+(:[0-9]{1,5})?(/[\s\S]*)?", url)
    good = good and 1 <= len(name.encode()) <= 128 and not re.search(r"[\x00-\x1f\x7f-\x9f]", name)
    try:
        good = good and re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}", seen) and datetime.datetime.strptime(seen, "%Y-%m-%dT%H:%M:%S")
    except ValueError:
        good = False
    good = good and re.fullmatch("[0-9]*", source) and re.fullmatch("[0-9]*[1-9][0-9]*", hits)
    return None if good else "value"


LINES = [
    "http://a.b/c,joe,2024-01-02T03:04:05,7,1", '"http://a.b/c,d","jo""e",2024-01-02T03:04:05,,"3"', "", None, '"', 'a"b,c,d,e,f', '"a"b,c,d,e,f', ',,,,', "a,b,c,d", "a,b,c,d,e,f",
    "http://a.b,joe,2024-02-30T03:04:05,7,1", "http://a.b,joe,2024-02-29T24:00:00,7,1", "http://a.b,joe,2023-02-29T01:00:00,7,1", "http://a.b,joe,2024-01-02 03:04:05,7,1", "http://a.b,joe,2024-01-02T03:04:05,7,0",
    "http://a.b,joe,2024-01-02T03:04:05,-7,1", "http://a.b,joe,2024-01-02T03:04:05,7,+1", "http://a.b,joe,2024-01-02T03:04:05,7,007", "http://a_b,joe,2024-01-02T03:04:05,7,1", "http://a.b:123456,joe,2024-01-02T03:04:05,7,1",
    "http://a.b?x,joe,2024-01-02T03:04:05,7,1", "http://a.b,,2024-01-02T03:04:05,7,1", f"http://a.b,{'é' * 65},2024-01-02T03:04:05,7,1", f"http://a.b,{'é' * 64},2024-01-02T03:04:05,7,1", "http://a.b,a\tb,2024-01-02T03:04:05,7,1", 'http://a.b,"a\x00b",2024-01-02T03:04:05,7,1', "http://a.b/\x00,ab,2024-01-02T03:04:05,7,1", "\n", " ",
    f"http://a.b/{'x' * 2037},joe,2024-01-02T03:04:05,7,1", f"http://a.b/{'x' * 2038},joe,2024-01-02T03:04:05,7,1", '"http://a.b/\n","j\noe",2024-01-02T03:04:05,7,1', ' "a",b,c,d,e', f"http://a.b,joe,2024-01-02T03:04:05,{'9' * 50},1",
    "http://a.b,joe,2024-01-02T03:04:05,7,1\n", "http://a.b,joe,2024-01-02T03:04:05,٣,1", "http://a.b,joe,9999-12-31T23:59:59,7,1", "http://a.b,joe,2024-01-02T03:04:60,7,1", '"a' + "b" * 200_000,
]


def classified(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "raw_id int, raw string")
    found = {r.raw_id: r.reason_code for r in parse.bad_lines(df, "raw_id").collect()}
    return [found.get(i) for i in range(len(lines))]


def test_cases(spark):
    got = classified(spark, LINES)
    for line, g in zip(LINES, got, strict=True):
        assert g == judge(line), (line and line[:80], g, judge(line))


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from('",a\n 1'), max_size=14), min_size=40, max_size=80))
def test_quoting_against_state_machine(spark, lines):
    assert classified(spark, lines) == [judge(x) for x in lines]


def test_round_trip_and_types(spark):
    rows = [("http://a.b/x,y", 'j"o,e', "2024-01-02T03:04:05", "7", "2"), ("ftp://c.d:21", " edge ", "1999-12-31T23:59:59", "", "1")]
    out = io.StringIO()
    csv.writer(out, lineterminator="\x1e").writerows(rows)
    lines = out.getvalue().split("\x1e")[:-1]
    df = spark.createDataFrame([(i, x, "extra") for i, x in enumerate(lines)], "raw_id int, raw string, record string")
    got = parse.good_lines(df, "raw_id").orderBy("raw_id").collect()
    assert [(r.url, r.username) for r in got] == [r[:2] for r in rows]
    assert got[0].first_seen == datetime.datetime(2024, 1, 2, 3, 4, 5) and int(got[0].hits) == 2 and got[1].source_id is None
    assert parse.good_lines(df.limit(0), "raw_id").count() == 0


def test_lines_of_any_number_of_columns(spark):
    df = spark.createDataFrame(list(enumerate(LONG)), "id bigint, raw string")
    want = {i: judge(x) for i, x in enumerate(LONG)}
    assert {r.id: r.reason_code for r in parse.bad_lines(df, "id").collect()} == {i: r for i, r in want.items() if r} and want[0] == "columns" and want[10] is None
    assert [r.url for r in parse.good_lines(df, "id").collect()] == ["http://a.b/" + "," * 1500]
