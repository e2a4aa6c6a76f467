"""Schema discovery, explanations, layout, the command line and the interactive loop."""

import re

import pytest

from tallyline import cli
from tallyline.charts import bars, boxed, plot
from tallyline.describe import describe, sniff, suggest
from tallyline.lang.explain import explain
from tallyline.lang.formatting import formatted, highlighted
from tallyline.lang.syntax import parse
from tallyline.repl import Session


def test_sniffing():
    s = sniff(["name,n,x", 'a,1,1.5', '"b, c",2,2'])
    assert (s.format, s.header, [(c.name, c.kind) for c in s.columns]) == ("csv", True, [("name", "String"), ("n", "Int"), ("x", "Float")])
    assert sniff(["a\t1", "b\t2"]).format == "tsv"
    assert not sniff(["1,2", "3,4"]).header
    j = sniff(['{"a": 1, "b": {"c": 2}}', '{"a": 2, "d": "x"}'])
    assert j.format == "json" and [c.name for c in j.columns] == ["a", "b", "d"]
    assert sniff(["plain words here"]).format == "text"
    assert sniff([]).columns == []
    assert s.spark().fieldNames() == ["name", "n", "x"]


def test_describe_and_suggest(spark, tmp_path, folder):
    (tmp_path / "t.csv").write_text("dept,pay\nx,1\ny,2\nx,3\n")
    s = describe(spark, str(tmp_path / "t.csv"))
    assert "csv, header, 2 columns" in s.text()
    from tallyline.lang import run

    for what, program in suggest(s):
        assert run(spark, program, str(tmp_path / "t.csv"), header=True).collect(), what
    assert describe(spark, f"{folder}/nation.parquet").columns[0].kind == "Int"


@pytest.mark.parametrize(("program", "said"), [("!seen[$0]++", "distinct by $0"), ("NR==FNR{a[$1]=1;next} !($1 in a)", "rows without a match by $1"), ("NR==FNR{a[$1]=$2;next} ($1 in a){print}", "join by $1"), ("{a[$1]++} END{for(k in a) print k}", "count by $1"), ("{s[$1]+=$2} END{for(k in s) print k}", "sum of $2 by $1"), ("{a[NR]=$1} END{print median(a)}", "median of records"), ("END{print NR}", "count records"), ("$3 > 5 {print $1}", "print $1 where $3 > 5"), ("/x/,/y/", "print records: /x/ to /y/"), ("last 3", "print records: the last 3"), ("every 5", "print records: every 5 records"), ("/a/{n++} END{print n}", "count of /a/")])
def test_explain(program, said):
    assert explain(program) == said
    assert len(explain(program, 10)) <= 10


PROGRAMS = ["{ a[$1]++ } END { for (k in a) @sort print k, a[k] }", 'BEGIN { x = "a\\"b\\n"; y = 2 ** 3; if (x ~ /a\\/b/) print x > "f"; else print y }', "function f(a, b) { while (a < b) { a++; if (a == 3) continue; else break }; return a } { print f($1, $NF) ?? 1 }", "NR == 2, NR == 4 { do { i-- } while (i > 0); delete a[1, 2]; delete a }", 'last 3\nevery 2 { printf "%s\\n", $0 | "sort" }', "{ for (i = 1; i <= NF; i++) s += $i; getline x < \"f\"; next }", "BEGINFILE { print FILENAME } ENDFILE { exit 1 } (1, 2) in a || !b { $2 = -x; print (1)(2), a? , c ? d : e }"]


@pytest.mark.parametrize("program", PROGRAMS)
def test_layout_keeps_the_tree(program):
    assert parse(formatted(program)) == parse(program)
    assert re.sub(r"\x1b\[\d+m", "", highlighted(program)) == program
    assert "\x1b[" in highlighted(program)


def test_command_line(capsys, tmp_path, spark):
    (tmp_path / "w").write_text("a 1\nb 2\na 3\n")
    path = str(tmp_path / "w")
    assert cli.main(["{ s[$1] += $2 } END { for (k in s) @sort print k, s[k] }", path]) == 0
    assert capsys.readouterr().out == "a 4\nb 2\n"
    assert cli.main([path, "-O", "-", "{ print $2, $1 }"]) == 0
    assert capsys.readouterr().out == "1-a\n2-b\n3-a\n"
    assert cli.main([path]) == 0
    assert capsys.readouterr().out == "a 1\nb 2\na 3\n"
    assert cli.main(["-v", "x=7", "BEGIN { print x + 1 }"]) == 0
    assert capsys.readouterr().out == "8\n"
    assert cli.main(["seq(1,3)"]) == 0
    assert capsys.readouterr().out == "1\n2\n3\n"
    assert cli.main(["{ print", path]) == 2
    assert "1:8" in capsys.readouterr().err
    assert cli.main(["--explain", "!s[$0]++"]) == 0 and capsys.readouterr().out == "distinct by $0\n"
    assert cli.main(["--format", "{print}"]) == 0 and capsys.readouterr().out == "{\n    print\n}\n"
    assert cli.main(["-d", path]) == 0 and "text, 2 columns" in capsys.readouterr().out
    (tmp_path / "p").write_text("{ print NR }")
    assert cli.main(["-f", str(tmp_path / "p"), path]) == 0 and capsys.readouterr().out == "1\n2\n3\n"


def test_interactive_loop():
    s = Session()
    assert s.run("BEGIN { x = 3; a[1] = 2 }") == ""
    assert s.run("BEGIN { print x + a[1] }") == "5\n"
    assert s.run('toupper("q")') == "Q\n"
    assert s.run(":vars") == "a = array of 1\nx = 3\n"
    assert s.run("{ print").startswith("error: 1:")
    s.run(":reset")
    assert s.run(":vars") == ""


def test_charts(spark):
    assert bars([("a", 2.0), ("bb", 1.0)], 4, "#") == [" a | #### 2", "bb | ##   1"]
    assert boxed(["x"], "t")[0].startswith("┌─ t ─")
    assert plot(spark.createDataFrame([("a", 1)], "k string, n int"), "k", "n", 3).startswith("a | ███")
    assert bars([]) == []


def test_suggestions_group_by_what_comes_again():
    rows = ["boat,berth,crew"] + [f"boat{i},{'mole' if i % 2 else 'quay'},{i}" for i in range(9)]
    said = [what for what, _ in suggest(sniff(rows))]
    assert "count by berth" in said and not any("boat" in what for what in said)
    assert not any(what.startswith("count by") for what, _ in suggest(sniff([f"x{i} {i}" for i in range(9)])))
