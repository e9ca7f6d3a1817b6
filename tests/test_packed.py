import re

import pytest
from pyspark.sql import functions as F

from deltarill.operators import packed

GRAPH = packed.Layout(decimal_suffix=True, list_quotes=True)


def brute(s, soft, decimal, hard, list_quotes):
    """Reads one field sign by sign."""
    s = s.strip(" \t\r\n")
    if list_quotes and re.fullmatch(r"\"(?:[^\"]|\"\")*\"|'(?:[^']|'')*'", s):
        s = s[1:-1].strip(" \t")
    i, pos, out, n = 0, 1, [], len(s)
    sep = re.compile(rf"[ \t]*[{re.escape(hard)}][ \t]*|[ \t]+" if soft else rf" *[{re.escape(hard)}]")
    while i <= n:
        j = i
        while j < n and s[j] == " ":
            j += 1
        if j < n and s[j] in "\"'":
            q, k, buf = s[j], j + 1, ""
            while k < n:
                if s[k] == q:
                    if s[k + 1 : k + 2] == q:
                        buf, k = buf + q, k + 2
                        continue
                    break
                buf, k = buf + s[k], k + 1
            val, i = buf.strip(), k + 1
        else:
            k, buf = i, ""
            while k < n:
                m = decimal and re.match(r",[-+]?(\d+\.\d*|\.\d+)(?=[ \t,;；|/]|$)", s[k:])
                if m:
                    buf, k = buf + m.group(), k + m.end()
                    continue
                if s[k] in hard or (soft and s[k] in " \t"):
                    break
                buf, k = buf + s[k], k + 1
            val, i = buf.strip(), k
        if val:
            out.append((pos, val))
        m = sep.match(s, i)
        if not m:
            break
        i, pos = m.end(), pos + 1
    return out


LABELS = ["0.41 / \"old, cold\"", "0.457, shares；0.25 / 0.32", "\"so called \"\"friend\"\"\",0.548", "links to | redirect；", "'0.23';'shares'", "0.7;;0.2",
          " \"0.7\", , \"x, y\"  ", "0.3\t0.1 ; 0.654\n0.525, 0.9", "mirror of", "|1.0", "", "  ", "\"seed\"//\"bridge\"", "0.5", "strong tie", "0.5", "0.5"]
LISTS = ["18258661/8281098/20448070", "684705 7124660 4938837,6.3", "\"20932582 14549903 13079116\"", "'10440100,8.08' '91193,4.66'", "3107401;;20711641",
         "13634131,5.6 18228112,1.21,3131289,8.0848|4233401,3.64 | 6197052,8.54", "9768675,9969063,603888", "15662252,7.50   47937,2.7809", "20136790\t1442492", "7", "", " 14205828/5246653"]


def test_splits_like_brute_force(spark, rows):
    df = spark.createDataFrame(list(enumerate(LABELS)), "id long, value string")
    got = rows(packed.split_packed(df, "id", "value", [",", ";", "；", "|", "/", "\t", "\n"]), "row_id", "pos", "val")
    want = sorted(((i, p, v) for i, s in enumerate(LABELS) for p, v in brute(s, False, False, ",;；|/\t\n", False)), key=repr)
    assert got == want
    df = spark.createDataFrame(list(enumerate(LISTS)), "id long, value string")
    got = rows(packed.split_packed(df, "id", "value", [",", ";", "|", "/", "\t", " "], GRAPH), "row_id", "pos", "val")
    want = sorted(((i, p, v) for i, s in enumerate(LISTS) for p, v in brute(s, True, True, ",;；|/", True)), key=repr)
    assert got == want


def test_infers_separators(spark):
    labels = [f"0.{i}{s}{w}" for i in range(30) for s in ",;|" for w in ("shares", "0.5")] + ["links to", "strong tie", "weak tie"] * 20
    df = spark.createDataFrame([(i, v) for i, v in enumerate(labels)], "id long, value string")
    kept = {r.candidate for r in packed.score_candidates(df, "value").collect() if r.score >= packed.MIN_SCORE}
    assert kept == {",", ";", "|"}
    lists = [(i, "11 22 33", 3) for i in range(20)] + [(50 + i, "4,1.5 6", 2) for i in range(20)]
    df = spark.createDataFrame(lists, "id long, value string, n int")
    assert {r.candidate for r in packed.score_candidates(df, "value", None, "n", GRAPH).collect() if r.score >= packed.MIN_SCORE} == {" "}


def test_sources_have_separators_of_their_own(spark, rows):
    data = [("a", 1, "1;2 3"), ("a", 2, "4;5"), ("b", 3, "6 7"), ("b", 4, "8 9"), (None, 5, "x"), ("c", 6, None)]
    df = spark.createDataFrame(data, "pattern string, source long, value string")  # names that the operator uses itself
    got = rows(packed.unpack_by_source(df, "source", "value", "pattern"), "row_id", "pos", "val")
    assert (3, 2, "7") in got and (2, 2, "5") in got and (5, 1, "x") in got


def test_nulls_empty_tables_and_long_texts(spark, rows):
    df = spark.createDataFrame([(1, None), (2, ""), (3, ";;;"), (None, "1;2")], "id long, value string")
    assert rows(packed.split_packed(df, "id", "value", [";"]), "row_id", "val") == sorted([(None, "1"), (None, "2")], key=repr)
    empty = spark.createDataFrame([], "id long, value string")
    assert packed.unpack(empty, "id", "value").count() == 0
    long = ";".join(str(i) for i in range(50_000)) + ";" + '"' + "a" * 300_000 + '""' * 2000 + '"'
    df = spark.createDataFrame([(1, long)], "id long, value string")
    assert packed.split_packed(df, "id", "value", [";"]).agg(F.max("pos")).first()[0] == 50_001


@pytest.mark.parametrize("text", ['"open;1', "a'b;c", '"x"y;z', "'';1"])
def test_lone_quotes_do_not_break(spark, text):
    df = spark.createDataFrame([(1, text)], "id long, value string")
    assert packed.split_packed(df, "id", "value", [";"]).count() >= 1
