"""Programs: lowered plans against the sequential machine, and both against stated results."""

import random

import pytest

from tallyline.lang import Program, run
from tallyline.lang.machine import Machine
from tallyline.lang.syntax import ProgramError, parse

RNG = random.Random(20)
PORTS = ["Brest", "Cadiz", "Emden", "Gdynia", "Lorient"]
BIRDS = ["avocet", "curlew", "dunlin", "eider", "gannet", "knot", "sanderling"]

#: A harbour's books, mostly drawn: birds seen, depths, tides by port, seas, tolls, crossings, notes.
FILES = {
    "birds": RNG.choices(BIRDS, k=16) + ["dunlin", "gannet"],
    "depths": [str(RNG.randint(2, 140)) for _ in range(13)],
    "tides": [f"{RNG.choice(PORTS)} {RNG.randint(20, 99)}" for _ in range(14)],
    "seas": ["Brest Iroise", "Cadiz Atlantic", "Emden Wadden", "avocet wader", "dunlin wader", "gannet sulid"],
    "tolls": ["Brest 4.75", "Cadiz 11", "Gdynia 0.6"],
    "crossings": ["Cadiz 7", "Lorient 12", "Brest 31"],
    "notes": ["fog over Emden until noon", "gannet and knot on the outer mole", "slack water at Brest", "gale warning: all boats stay in", "avocet nest found"],
    "gaps": ["14", "", "9", "", "", "27"],
    "watches": [w for w in "port star port mid dog".split() for _ in range(RNG.randint(1, 4))],
    "ebb": RNG.sample(PORTS, 4),
    "flood": RNG.sample(PORTS, 3) + ["Vigo"],
}


@pytest.fixture(scope="module")
def paths(tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    for name, lines in FILES.items():
        (folder / name).write_text("".join(f"{x}\n" for x in lines))
    return {name: str(folder / name) for name in FILES}


def sequential(program, names, **options):
    records = [(n, line, None) for n in names for line in FILES[n]]
    return "".join(s for target, s in Machine(parse(program), **options).run(records) if target is None)


#: (program, files, how it must run, whether the order of output is fixed)
PROGRAMS = [
    ("!met[$0]++", "birds", "distinct", True),
    ("!port[$1] ++ { print \"first at\", $2 }", "tides", "distinct", True),
    ("{ n[$1]++ } END { for (b in n) print n[b], b }", "birds", "accumulate", False),
    ("{ h[$1] += $2; n[$1]++ } END { for (p in h) print p, h[p] / n[p] }", "tides", "accumulate", False),
    ("{ h[$1] += $2 } END { for (p in h) @rval print h[p], p }", "tides", "accumulate", True),
    ("{ n[$1]++; all++ } END { for (b in n) printf \"%s %.2f of it\\n\", b, n[b] / all }", "birds", "accumulate", False),
    ("{ for (j = 1; j <= NF; j++) n[$j]++ } END { for (w in n) print w, n[w] }", "notes", "accumulate", False),
    ("{ l[$1] = l[$1] (l[$1] ? \"/\" : \"\") $2 } END { for (p in l) print p, l[p] }", "tides", "accumulate", False),
    ("$2 > top { top = $2; at = $0 } END { print at, top }", "tides", "accumulate", True),
    ("{ if ($2 > 55) spring++; else neap++ } END { print neap, spring, NR }", "tides", "accumulate", True),
    ("/puffin/ { n++ } END { print \"<\" n \">\", 0 + n }", "birds", "accumulate", True),
    ("{ d[NR] = $1 } END { print mean(d), median(d), iqm(d), p(d, 90), length(d) }", "depths", "accumulate", True),
    ("{ b[NR] = $1 } END { asort(b); print join(b, \"+\") }", "birds", "accumulate, then machine", True),
    ("{ n[$1]++ } END { best = 0; for (b in n) if (n[b] > best) { best = n[b]; who = b } print best }", "birds", "accumulate, then machine", True),
    ("NR == FNR { sea[$1] = $2; next } ($1 in sea) { print sea[$1], $0 }", "seas tides", "lookup", True),
    ("NR == FNR { toll[$1] = $2; next } { print $0, ($1 in toll ? toll[$1] : \"free\") }", "tolls crossings", "lookup", True),
    ("NR == FNR { there[$1] = 1; next } !($1 in there)", "flood ebb", "lookup", True),
    ("NR == FNR { sea[$1] = $2; next } { if ($1 in sea) $2 = sea[$1]; print }", "seas crossings", "lookup", True),
    ("{ print $2, $1; print NF \";\" $NF, $-1 }", "tides", "stateless", True),
    ("{ note = $0; if (length(note) > 18) note = substr(note, 1, 14) \"~\"; print note }", "notes", "stateless", True),
    ("{ sub(/n/, \"(&)\"); gsub(/l/, \"L\") } 1", "birds", "stateless", True),
    ("{ $4 = \"m\"; print; print NF }", "tides", "stateless", True),
    ("NR == 3, NR == 6", "birds", "range", True),
    ("/gannet/, /gale/ { print NR, $1 }", "notes", "range", True),
    ("every 4", "depths", "stateless", True),
    ("last 3", "depths", "last", True),
    ("END { print }", "birds", "last", True),
    ("NR > 5 { exit } 1", "birds", "stateless", True),
    ("/dunlin/ { print before } { before = $0 }", "birds", "ordered", True),
    ("watch != $0 { print } { watch = $0 }", "watches", "ordered", True),
    ("{ sum += $1; print sum, NR }", "depths", "ordered", True),
    ("NF { print $0 \";\\n\" }", "gaps", "stateless", True),
    ("BEGIN { OFS = \" | \" } { print $2, $1 }", "tides", "stateless", True),
    ("function feet(m) { return m * 3.25 } { print feet($2) }", "tides", "stateless", True),
    ("{ l[NR] = $0 } END { for (k = NR; k >= 1; k--) print l[k] }", "notes", "by number", True),
    ("ORS = NR % 4 ? \" \" : \"\\n\"", "birds", "machine", True),
    ("{ met[$1] = 1; n = 0; for (b in met) n++; print n, NR }", "birds", "running count", True),
    ("{ far[$1]++; n = 0; for (p in far) n++; if (n > 2) print $2, n }", "tides", "running count", True),
    ("{ l[NR] = $2 } END { for (k = 1; k <= NR; k++) print l[k] }", "tides", "by number", True),
    ("{ l[NR] = NR \":\" $1 } END { for (k = NR; k > 0; k--) print l[k] }", "gaps", "by number", True),
    ("{ met[$1] = 1; n = 0; for (b in met) n++; print n, met[$1] }", "birds", "machine", True),
    ("{ d[NR] = $1 } NR >= 3 { printf \"%.3f\\n\", (d[NR] + d[NR-1] + d[NR-2]) / 3 }", "depths", "ordered", True),
    ("{ d[NR] = $1 } { print d[NR], d[NR-5] }", "depths", "ordered", True),
    ("NR == 6 { print; exit }", "birds", "stateless", True),
    ("{ print $1 } /gannet/ { print \"over\"; exit } { print $1 }", "birds", "stateless", True),
    ("/puffin/ { print; exit } 1", "birds", "stateless", True),
    ("NR == FNR { sea[$1] = $2; next } { for (j = 1; j <= NF; j++) if ($j in sea) $j = sea[$j]; print }", "seas notes", "field lookup", True),
    ("BEGIN { OFS = \"-\" } NR == FNR { n[$1]++; next } { for (j = 1; j <= NF; j++) if ($j in n) $j = n[$j]; print }", "tides notes", "field lookup", True),
    ("NR == FNR { sea[$1] = $2; next } { for (j = 2; j <= NF; j++) if ($j in sea) $j = sea[$j]; print }", "seas notes", "machine", True),
]


@pytest.mark.parametrize(("program", "files", "how", "fixed"), PROGRAMS)
def test_lowered_is_sequential(spark, paths, program, files, how, fixed):
    names = files.split()
    expected = sequential(program, names).removesuffix("\n").split("\n")
    result = run(spark, program, [paths[n] for n in names])
    got = result.collect()
    assert result.how == how
    assert got == expected if fixed else sorted(got) == sorted(expected)


#: Programs without input, and what they print.
STATED = [
    ("BEGIN { print or(0x30, 9), and(0x3C, 29), xor(77, 7) }", "57 28 74"),
    ("BEGIN { print toupper(\"mole\"), repeat(\"-+\", 2), reverse(\"tide\") }", "MOLE -+-+ edit"),
    ("BEGIN { seq(k, 7, 4); print k }", "7\n6\n5\n4"),
    ("BEGIN { print 3 ** 1 ** 4, -3 ** 2, 11 % -4, 6 / 0, 2 / 3 }", "3 -9 3 0 0.666667"),
    ("BEGIN { none = \"\"; print none ?? \"calm\", \"gale\" ?? \"calm\" }", "calm gale"),
    ("BEGIN { wind = \"NW\"; got = clr(wind) clr(sea) ?? \"still\"; print got, \"<\" wind \">\" }", "NW <>"),
    ("BEGIN { none = \"\"; print \"<\" (none? \" sail\") \">\" }", "<>"),
    ("BEGIN { if (match(\"at depth: 42 m\", /([a-z]+): (\\d+)/, g)) print g[2], g[1], RSTART, RLENGTH }", "42 depth 4 9"),
    ("BEGIN { n = split(\"sun/moon/sea/sky\", w, \"/\"); print n, w[4] w[2]; print split(\" ebb  flow \", v), v[1] }", "4 skymoon\n2 ebb"),
    ("BEGIN { d[5] = 31; d[9] = 4; print join(asort(d), \"<\"), typeof(d), typeof(q), typeof(2.5), typeof(\"\") }", "4<31 array uninitialized number string"),
    ("BEGIN { print jpath(\"{\\\"boats\\\":[{\\\"crew\\\":12},{\\\"crew\\\":7}]}\", \".boats[1].crew\") }", "7"),
    ("BEGIN { printf \"%7.3f/%-5s/%04d/%o/%c\\n\", 2.71828, \"log\", 61, 64, 90 }", "  2.718/log  /0061/100/Z"),
    ("function steps(n) { if (n < 2) return 0; return 1 + steps(n % 2 ? 3 * n + 1 : n / 2) } BEGIN { print steps(27) }", "111"),
    ("function deep(m) { return m > 20 } BEGIN { d[1] = 8; d[2] = 44; d[3] = 21; print join(filter(d, \"deep\"), \" \") }", "44 21"),
    ("BEGIN { h[\"ebb\"] = 1; h[\"slack\"] = 2; g[\"slack\"] = 3; diff(h, g); for (k in h) print k, h[k] }", "ebb 1"),
    ("BEGIN { while (t < 5) { t++; if (t % 2 == 0) continue; print t }; do { t -= 2 } while (t > 0); print t }", "1\n3\n5\n-1"),
    ("BEGIN { for (;;) { if ((m += 3) > 10) break }; print m; buoy[4,7] = 1; print ((7,4) in buoy), ((4,7) in buoy) }", "12\n0 1"),
    ("BEGIN { for (j = 2; j <= 12; j += 2) window(w, 4, j); print length(w), mean(w) }", "4 9"),
    ("BEGIN { seq(v, 1, 9); hist(v, 4, h); print h }", "2\n2\n2\n3"),
    ("BEGIN { print mktime(\"1971 1 1 0 0 1\"), strftime(\"%d.%m.%Y\", 86400 * 365), parsedate(\"1970/02/01\", \"%Y/%m/%d\") }", "31536001 01.01.1971 2678400"),
    ("BEGIN { print gensub(/(\\w)-(\\w)/, \"$2=$1\", \"g\", \"p-q r-s\"), gensub(/e/, \"_\", 3, \"everglede\") }", "q=p s=r evergl_de"),
    ("BEGIN { print substr(\"harbour\", 0, 4), index(\"harbour\", \"bou\"), rpad(\"9\", 3, \"*\"), trim(\" pier \") }", "harb 4 9** pier"),
    ("BEGIN { w = \"seaweed sees\"; k = gsub(/e+/, \"3\", w); print k, w; print length(w), 7 \"\" == 7.00, \"pier\" < \"dock\" }", "3 s3aw3d s3s\n10 1 0"),
    ("BEGIN { $0 = \"x y\"; $4 = \"z\"; print NF, $0; NF = 1; print $0; $0 = \"k l m\"; print flip() }", "4 x y  z\nx\nm l k"),
    ("BEGIN { m[8] = \"q\"; m[2] = \"r\"; m[\"w\"] = \"s\"; print vals(m); print keys(m); inv(m); print m[\"r\"] }", "r\nq\ns\n2\n8\nw\n2"),
]


@pytest.mark.parametrize(("program", "expected"), STATED)
def test_machine(program, expected):
    assert "".join(s for _, s in Machine(parse(program)).run(())) == expected + "\n"


def test_commands_are_refused():
    with pytest.raises(PermissionError):
        Machine(parse('BEGIN { system("true") }')).run(())
    assert Machine(parse('BEGIN { "echo x" | getline v; print v }'), commands=True).run(()) == [(None, "x\n")]


def test_getline_and_files(tmp_path):
    (tmp_path / "f").write_text("1\n2\n")
    program = f'BEGIN {{ while ((getline x < "{tmp_path}/f") > 0) s += x; print s; print "y" > "out"; n = slurp("{tmp_path}/f", a); print n, (getline z < "/none") }}'
    assert Machine(parse(program)).run(()) == [(None, "3\n"), ("out", "y\n"), (None, "2 -1\n")]
    lines = [("f", x, None) for x in "abcd"]
    assert Machine(parse("NR == 2 { getline; print } /d/ { nextfile } END { print NR }")).run(lines) == [(None, "c\n"), (None, "4\n")]


@pytest.mark.parametrize("program", ["{ print", "BEGIN { x = }", "{ a[ }", "/x", '{ print "x }', "for", "{ if (x }", "BEGIN { print nosuch(1) }"])
def test_errors(program):
    with pytest.raises(ProgramError):
        Machine(parse(program))


def test_named_columns(spark, tmp_path):
    (tmp_path / "p.csv").write_text('boat,berth,draught\nTern,"quay 2, east",4.1\nKittiwake,mole,2.9\n')
    (tmp_path / "p.jsonl").write_text('{"boat":"Tern","crew":5}\n{"boat":"Kittiwake","crew":2}\n')
    assert run(spark, "$draught > 3 { print $berth, $boat }", str(tmp_path / "p.csv"), header=True).collect() == ["quay 2, east Tern"]
    assert run(spark, "{ print $1, NR }", str(tmp_path / "p.csv"), mode="csv").collect() == ["boat 1", "Tern 2", "Kittiwake 3"]
    assert run(spark, "{ print $2 }", str(tmp_path / "p.jsonl"), mode="json").collect() == ["5", "2"]
    with pytest.raises((ValueError, ProgramError)):
        run(spark, "{ print $nosuch }", str(tmp_path / "p.csv"), header=True).collect()


def test_parquet_is_pruned_and_pushed_down(spark, folder):
    rows = spark.read.parquet(f"{folder}/customer.parquet")
    plan = Program("$c_acctbal > 9000 { print $c_name }").on(spark, rows, "c_custkey").lines._jdf.queryExecution().toString()
    assert "GreaterThan(c_acctbal,9000.0)" in plan
    assert "c_mktsegment" not in plan.split("ReadSchema")[1]
