import re

from pyspark.sql import functions as F

from deltarill.operators import quarantine


def parse(t, sep):
    """Fields of a record read sign by sign, or None where quoting is wrong."""
    out, i, n = [], 0, len(t)
    blanks = " " if sep == "\t" else " \t"
    while True:
        while i < n and t[i] in blanks:
            i += 1
        if i < n and t[i] == '"':
            i, buf = i + 1, ""
            while True:
                if i >= n:
                    return None
                if t[i] == '"':
                    if t[i + 1 : i + 2] == '"':
                        buf, i = buf + '"', i + 2
                        continue
                    break
                buf, i = buf + t[i], i + 1
            i += 1
            while i < n and t[i] in blanks:
                i += 1
            if i < n and t[i] != sep:
                return None
            out.append(buf)
        else:
            j = i
            while j < n and t[j] != sep:
                j += 1
            f = t[i:j].strip(blanks)
            if '"' in f:
                return None
            out.append(f)
            i = j
        if i >= n:
            return out
        i += 1


def is_id(s):
    return re.fullmatch("[0-9]+", s) is not None and int(s) <= 4294967295


def is_number(s):
    return re.fullmatch(r"[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?", s) is not None


def reason(feed, t):
    p = parse(t, "\t" if feed == "input_graph" else ",")
    if p is None:
        return "quoting"
    if len(p) != (2 if feed == "input_graph" else 4):
        return "columns"
    if not is_id(p[0]):
        return "src"
    if feed == "input_graph":
        it = [x for x in re.split("[ \t]+", p[1]) if x]
        if not it or not is_id(it[0]) or int(it[0]) != len(it) - 1:
            return "edge_count"
        for x in it[1:]:
            a, c, b = x.partition(",")
            if not is_id(a) or (c and not is_number(b)):
                return "dst"
        return None
    if not is_id(p[1]):
        return "dst"
    return "value" if p[2] and not is_number(p[2]) else None


EDGES = ["1,2,0.5,ok", '1,2,,"a, b"', '1,2,"0,5",x', '1,2,3.,"said ""keep"""', '1,2,1,so "called"', '1,2,1,"open', '1,"2"7,1,', "1,2,1", "x,2,1,", "1,7O1,,", '1,"",1,ok',
         "4294967296,1,1,", "1,4294967295,1,", "007,00012,+1.5,", "1,2,inf,", "1,2,1e,", ' 1 , 2 ,.5, note ', "1,2,1,a,b", '"1","2","3","4"', "1,2,2e-3,\"first\nsecond\"", "٢٣,1,1,", '"a","', ","]
LISTS = ["1\t2 3 4", "1\t0", '1\t"2 3 4"', '"1"\t1 5,0.5', "1\t2 3", "1\ttwo 3", "1\t1 3,", "1\t1 3,x", "1\t1 3,,0.5", "1\t", "\t1 2", "1 2 3", "1\t1 2\t3", '1\t"1 2"x', "1\t3  20  ,0.25  500582", "0x1F\t0", "1\t1 4294967296", "1\t1.0 3", " 1 \t 1 2 "]
NO_RECORDS = ["# c", "% 12\t1", "", "   ", "\t", None]


def test_reasons_like_brute_force(spark, rows):
    data = [(i, "edge_with_value", t) for i, t in enumerate(EDGES)] + [(100 + i, "input_graph", t) for i, t in enumerate(LISTS)]
    data += [(200 + i, "input_graph", t) for i, t in enumerate(NO_RECORDS)] + [(300, None, "1,2,3"), (None, "edge_with_value", "x,1,1,")]
    df = spark.createDataFrame(data, "line_id long, feed string, line_text string").withColumns({"col": F.lit(1), "reason": F.lit("x"), "val": F.lit("y")})
    want = [(i, r) for i, f, t in data if f and t and t.strip() and t[0] not in "#%" and (r := reason(f, t))]
    assert rows(quarantine.faults(df), "line_id", "reason") == sorted(want, key=repr)


def test_valid_rows_are_loaded(spark, rows):
    data = [(1, "edge_with_value", '7, 8 ,+1.5,"said ""x"""'), (2, "edge_with_value", "7,8,,"), (3, "input_graph", '9\t"2 1,0.5 4"'), (4, "input_graph", "9\t0"), (5, "input_graph", "9\t1"), (6, "edge_with_value", "7,8,,")]
    df = spark.createDataFrame(data, "line_id long, feed string, line_text string")
    assert rows(quarantine.loaded(df, "edge_with_value")) == [(1, 7, 8, 1.5, 'said "x"'), (2, 7, 8, None, None), (6, 7, 8, None, None)]
    assert rows(quarantine.loaded(df, "input_graph")) == [(3, 9, 2, 1, 0.5), (3, 9, 2, 4, None), (4, 9, 0, None, None)]


def test_empty_table_and_long_text(spark):
    schema = "line_id long, feed string, line_text string"
    assert quarantine.faults(spark.createDataFrame([], schema)).count() == 0
    n = 20_000
    long = f"1\t{n} " + " ".join(str(i) for i in range(n))
    note = '1,2,3,"' + 'a""' * 100_000 + '"'
    df = spark.createDataFrame([(1, "input_graph", long), (2, "edge_with_value", note), (3, "edge_with_value", note[:-1])], schema)
    assert [tuple(r) for r in quarantine.faults(df).select("line_id", "reason").collect()] == [(3, "quoting")]


def test_the_rules_rule(spark, rows):
    data = [(1, "edge_with_value", "7,8,1.5,x"), (2, "edge_with_value", "7,8,abc,x"), (3, "edge_with_value", "700,8,1,x"), (4, "edge_with_value", "7,8,1"), (5, "input_graph", "1\t1 5,x")]
    df = spark.createDataFrame(data, "line_id long, feed string, line_text string")
    found = lambda rules: rows(quarantine.faults(df, rules), "line_id", "reason")
    assert found(quarantine.RULES) == [(2, "value"), (4, "columns"), (5, "dst")]
    changed = [r._replace(pattern=r"\A[a-z]*\z") if r.col == "value" else r for r in quarantine.RULES]
    assert found(changed) == [(1, "value"), (3, "value"), (4, "columns"), (5, "dst")]
    assert found([r._replace(most=100) if r.col == "src" else r for r in quarantine.RULES]) == [(2, "value"), (3, "src"), (4, "columns"), (5, "dst")]
    assert found([r._replace(cells=3) if r.feed == "edge_with_value" and r.col == "row" else r for r in quarantine.RULES]) == [(1, "columns"), (2, "columns"), (3, "columns"), (5, "dst")]
    assert found([r._replace(rank=1, reason="note") if r.col == "weight" else r for r in quarantine.RULES if r.col != "row"]) == [(2, "value"), (5, "note")]
    assert found([r._replace(pattern="NEVER") if r.pattern else r for r in quarantine.RULES]) == [(i, "quoting") for i in range(1, 6)]
    assert found([]) == []
