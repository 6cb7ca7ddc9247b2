import io
import math

import pytest

from tablewright.__main__ import main, refuse_locale
from tablewright.errors import Refusal, UserError, Violation
from tablewright.functions.display import show
from tablewright.plans.language import parse, run

FIVE, PAIRS, SKEWED = "3\n9\n4\n12\n7\n", "3\t1\n9\t5\n4\t2\n12\t8\n7\t3\n", "1\n2\n2\n7\n9\n"
FRUIT = "plum\t4\nfig\t7\nplum\t1\nfig\t2\nquince\t9\n"
#: (arguments, input, lines of output); expected numbers follow from the definitions.
GOLDEN = [
    ("count 1 sum 1 mean 1 min 1 max 1 absmin 1 absmax 1 range 1", FIVE, "5\t35\t7\t3\t12\t3\t12\t9"),
    ("median 1 q1 1 q3 1 iqr 1 perc:60 1 trimmean:0.2 1", FIVE, "7\t4\t9\t5\t7.8\t6.6666666666667"),
    ("pvar 1 svar 1 pstdev 1 sstdev 1", FIVE, "10.8\t13.5\t3.286335345031\t3.6742346141748"),
    ("geomean 1 harmmean 1 ms 1 rms 1", FIVE, "6.1878618388653\t5.4310344827586\t59.8\t7.7330459716725"),
    ("pcov 1:2 scov 1:2 ppearson 1:2 spearson 1:2 dotprod 1:2", PAIRS, "8\t10\t0.9808164772275\t0.9808164772275\t173"),
    ("pskew 1 sskew 1 pkurt 1 skurt 1", SKEWED, "0.48467255499255\t0.72250718652789\t-1.5584661169322\t-2.2338644677289"),
    ("jarque 1 dpo 1", SKEWED, "0.70406834112736\t0.39180978932298"),
    ("mode 1 antimode 1 madraw 1 mad 1", "5\n1\n5\n2\n2\n9\n", "2\t1\t1.5\t2.2239"),
    ("first 1 last 1 unique 1 countunique 1 collapse 1", FRUIT, "plum\tquince\tfig,plum,quince\t3\tplum,fig,plum,fig,quince"),
    ("round 1 floor 1 ceil 1 trunc 1 frac 1", "-3.5\n7.25\n", "-4\t-4\t-3\t-3\t-0.5\n7\t7\t8\t7\t0.25"),
    ("getnum:n 1 getnum:i 1 getnum:h 1 getnum:o 1 getnum:p 1 getnum:d 1", "x17\n", "17\t17\t23\t15\t17\t17"),
    ("bin:6 1 strbin:5 1", "-7\n16\n", "-12\t0\n12\t2"),
    ("strbin:11 1", "plum\nq\n", "5\n3"),
    ("cut 3,1", "r\ts\tt\nu\tv\tw\n", "t\tr\nw\tu"),
    ("dirname 1 basename 1 extname 1 barename 1", "/srv//data.csv.zst\nplain\n", "/srv\tdata.csv.zst\tzst\tdata.csv\n.\tplain\t\tplain"),
    ("base64 1", "plum\n", "cGx1bQ=="),
    ("debase64 1", "cGx1bQ==\nccOp\n", "plum\nqé"),
    ("transpose", "r\ts\tt\nu\tv\tw\n", "r\tu\ns\tv\nt\tw"),
    ("reverse", "r\ts\tt\nu\tv\tw\n", "t\ts\tr\nw\tv\tu"),
    ("-sg1 sum 2", FRUIT, "fig\t9\nplum\t5\nquince\t9"),
    ("-g 1 sum 2", "plum\t4\nplum\t1\nfig\t2\nplum\t8\n", "plum\t5\nfig\t2\nplum\t8"),
    ("rmdup 1", FRUIT, "plum\t4\nfig\t7\nquince\t9"),
    ("check 3 fields", "r\ts\tt\nu\tv\tw\n", "2 lines, 3 fields"),
    ("ct 1,2", "plum\tred\nplum\tred\nplum\tred\n", "\tred\nplum\t3"),
    ("-s crosstab 1,2 max 3", "plum\tred\t4\nfig\tred\t6\nplum\tblue\t5\nplum\tred\t8\n", "\tblue\tred\nfig\tN/A\t6\nplum\t5\t8"),
    ("-zH --narm sum weight", "weight\0" + "5\0NA\0" + "6\0", "sum(weight)\n11"),
    ("--narm dotprod 1:2", "3\tNA\nNA\t7\n5\t11\n", "76"),
    ("wmean 1:2", "8\t2\n20\t6\n", "17"),
    ("-s -g1 wmean 2:3", "plum\t6\t5\nfig\t8\t2\nfig\t20\t6\n", "fig\t17\nplum\t6"),
    ("top:2 2", FRUIT, "quince\t9\nfig\t7"),
    ("bottom:2 2", FRUIT, "plum\t1\nfig\t2"),
    ("--csv -H -s -g kind sum crates", "kind,crates\nplum,3\nfig,5\nplum,4\n", "GroupBy(kind),sum(crates)\nfig,5\nplum,7"),
    ("--header-out --result-name=3:again --result-name=1:total sum 2,1-2", "6\t1\n7\t9\n", "total\tsum(field-1)\tagain\n10\t13\t10"),
    ("-i -s -g1 count 1", "Fig\nplum\nFIG\n", "Fig\t2\nplum\t1"),
    ("-W -C sum 2", "; skipped\n  fig   5\nplum\t7 \n", "12"),
    ("--vnlog -s -g kind sum n", "# kind n\nplum 3\nfig 5 # ripe\n# none\nplum 4\n", "# GroupBy(kind) sum(n)\nfig 5\nplum 7"),
    ("--narm mean 1 min 1 max 1 sum 1 count 1 first 1 unique 1", "nan\nNA\nn/a\n", "nan\t-inf\tinf\t0\t0\tN/A\t"),
    ("geomean 1", "0\n6\n", "0"),
    ("-f -s -g1 max 2", "plum\t4\tred\nplum\t9\tblue\nfig\t2\tgreen\n", "fig\t2\tgreen\t2\nplum\t9\tblue\t9"),
    ("--no-strict transpose", "r\ts\tt\nu\n", "r\tu\ns\tN/A\nt\tN/A"),
    ("bin 1", "340\n-7\n", "300\n-100"),
    ("-R 2 mean 1", "4\n7\n", "5.50"),
    ("count 1", "", ""),
    ("sha1 1 md5 1", "plum\n", "d6a0ca33c03b6a6d20cfd0eb97910ade8cd2bec0\t3e042037287d6871eec3dbd48556b0b4"),
    ("sha224 1", "plum\n", "3339552b8dbc19f33360758fe8afe1cf7d60d9ea06ef8aca74431829"),
    ("sha384 1", "plum\n", "4e41f94bd1ef3e2a9879545ec12204750050f27c95fd36ca4985b50d43552213e4187d0f878f1bbe7656d0b2198bef3c"),
    ("sha512 1", "plum\n", "907787c864d4c0160fb449891c297b92957efadc6d50848008dbe82baa6fb55de2ebb8ece287be333d2b5998f9f7a2c6995865171d7cb59900b1bb2eb57e8129"),
    # NaN replaces no number; one that comes first stays.
    ("absmin 1 absmax 1 min 1 max 1", "4\nnan\n-9\n", "4\t-9\t-9\t4"),
    ("absmin 1 absmax 1 min 1 max 1", "nan\n4\n-9\n", "nan\tnan\tnan\tnan"),
    ("absmin 1 absmax 1", "-6\n6\n", "-6\t-6"),
    # Extended precision with missing values and folded keys.
    ("--exact --narm sum 1 median 1", "5\nNA\n8\n", "13\t6.5"),
    ("--exact --narm mean 1 sum 1 min 1 max 1", "NA\n", "nan\t0\t-inf\tinf"),
    ("--exact -i -s -g1 sum 2", "Fig\t5\nplum\t1\nFIG\t8\n", "Fig\t13\nplum\t1"),
    ("--exact -i -g1 sum 2", "Fig\t5\nFIG\t8\nplum\t1\nfig\t2\n", "Fig\t13\nplum\t1\nfig\t2"),
    ("--exact sum 1", "18014398509481985\n-18014398509481984\n", "1"),
    # Selection leaves out rows whose ranked field is missing, and folds keys.
    ("--narm top:2 2", "plum\tNA\nfig\t3\nquince\tn/a\npear\t5\tNA\n", "pear\t5\tNA\nfig\t3"),
    ("--narm bottom:1 1", "nan\nNA\n", ""),
    ("-i -s -g1 top:1 2", "Fig\t5\nplum\t1\nFIG\t8\n", "FIG\t8\nplum\t1"),
    ("-i -g1 bottom:1 2", "Fig\t5\nFIG\t8\nplum\t1\nfig\t2\n", "Fig\t5\nplum\t1\nfig\t2"),
    # A group of one row leaves no choice: rand next to other operations, and its full row.
    ("-S5 -s -g1 rand 2 sum 2 mode 2", "plum\t4\nfig\t7\n", "fig\t7\t7\t7\nplum\t4\t4\t4"),
    ("-S5 -f -s -g1 rand 2", "plum\t4\tred\nfig\t7\tblue\n", "fig\t7\tblue\t7\nplum\t4\tred\t4"),
    ("-f -s -g1 rand 2 count 2", "plum\t4\tred\nfig\t7\tblue\n", "fig\t7\tblue\t7\t1\nplum\t4\tred\t4\t1"),
    # What the generator draws under these seeds, and digits of an 80-bit difference.
    ("-S0 -g1 rand 2", "a\t1\na\t2\na\t3\na\t4\nb\t1\nb\t2\nb\t3\nb\t4\n", "a\t3\nb\t4"),
    ("--seed=7 rand 1", "a\nb\nc\nd\n", "a"),
    ("--exact --format=%.20g sum 1", "1.0000000000000000001\n-1\n", "1.084202172485504434e-19"),
]


def lines(spark, tmp_path, args, text):
    path = tmp_path / "in"
    path.write_bytes(text.encode())
    return [r.value for r in run(spark, args.split(" "), str(path)).collect()]


def test_golden_commands(spark, tmp_path):
    bad = []
    for args, text, want in GOLDEN:
        try:
            got = "\n".join(lines(spark, tmp_path, args, text))
        except Exception as e:
            got = f"{type(e).__name__}: {str(e)[:300]}"
        if got != want:
            bad.append((args, got, want))
    assert not bad, bad


def test_seeded_choices_with_other_operations(spark, tmp_path):
    text = "".join(f"{'ab'[i // 20]}\t{i}\t{i * i}\n" for i in range(40))
    alone = lines(spark, tmp_path, "-S3 -s -g1 rand 2 rand 3", text)
    mixed = lines(spark, tmp_path, "-S3 -s -g1 rand 2 count 2 rand 3 max 2", text)
    assert mixed == [f"{k}\t{x}\t20\t{y}\t{m}" for (k, x, y), m in zip((r.split("\t") for r in alone), (19, 39))]
    full = lines(spark, tmp_path, "-S3 -f -s -g1 rand 2", text)
    assert full == [f"{k}\t{x}\t{int(x) ** 2}\t{x}" for k, x in (r.split("\t") for r in lines(spark, tmp_path, "-S3 -s -g1 rand 2", text))]


def test_one_block_is_read_once_and_lines_never_move(spark, tmp_path):
    (tmp_path / "in").write_text("r\ts\n" * 50)
    plan = run(spark, ["cut", "1"], str(tmp_path / "in"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1 and "hashpartitioning" not in plan


def test_command_entry(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("LC_ALL", "C.UTF-8")
    (tmp_path / "in").write_text("plum\t4\nfig\t7\n")
    own = ["--input", str(tmp_path / "in")]
    for args, status, said in (
        ([*own, "-s", "-g1", "sum", "2"], 0, "fig\t7\nplum\t4\n"), ([*own, "sum", "1"], 1, ""), ([*own, "health", "type", "1", "integer", "validate"], 1, "Table health report\nValidation failed"),
        ([*own, "-R2", "top:1", "2"], 77, ""), ([*own, "gather", "1"], 1, ""), (["--version"], 0, "tablewright "), (["-h"], 0, "usage: "),
    ):
        out, err = io.StringIO(), io.StringIO()
        assert main(args, out, err, spark) == status, (args, err.getvalue())
        assert out.getvalue().startswith(said) and (status == 0 or said or err.getvalue().startswith("tablewright: "))


@pytest.mark.parametrize("name, args, refused", [("de_DE.UTF-8", "sum 1", True), ("en_US.UTF-8", "sum 1", False), ("en_US.UTF-8", "-s -g1 sum 1", True), ("en_GB.UTF-8", "unique 1", True), ("POSIX", "-s -g1 sum 1", False), ("", "ct 1,2", False)])
def test_languages_are_refused(monkeypatch, name, args, refused):
    for key in ("LC_ALL", "LC_COLLATE", "LC_NUMERIC", "LANG"):
        monkeypatch.delenv(key, raising=False)
    if name:
        monkeypatch.setenv("LANG", name)
    if refused:
        with pytest.raises(Refusal, match="set LC_"):
            refuse_locale(parse(args.split(" ")))
    else:
        refuse_locale(parse(args.split(" ")))


def test_compare_command(spark, tmp_path):
    (tmp_path / "a").write_text("2\n")
    (tmp_path / "b").write_text("5\n")
    got = [r.value for r in run(spark, ["compare", str(tmp_path / "a"), str(tmp_path / "b"), "sum", "1"]).collect()]
    assert got == ["matched\tnot_requested\t2\t5\t3\tavailable\t150\tavailable"]


@pytest.mark.parametrize(
    "args, kind",
    [
        ("perc:2.5 1", Refusal), ("perc:0 1", UserError), ("trimmean:0.6 1", UserError), ("strbin:0 1", UserError), ("rmdup 1,2", Refusal), ("crosstab 1", UserError),
        ("sum 1 round 1", UserError), ("sum:3 1", UserError), ("sum 1:2", UserError), ("pcov 1", UserError), ("sum", UserError), ("--sort-cmd x sum 1", Refusal),
        ("health -s", UserError), ("health --narm", UserError), ("--csv health", UserError), ("-f health", UserError), ("-R 2 top:1 1", Refusal), ("--vnlog top:1 1", Refusal), ("-c ; top:1 1", Refusal), ("--exact bottom:1 1", Refusal),
        ("-f compare a b sum 1", Refusal), ("--vnlog compare a b sum x", Refusal), ("compare a b unique 1", Refusal), ("compare a b round 1", Refusal), ("--csv -t ; sum 1", UserError), ("--csv -C sum 1", UserError), ("--csv -z sum 1", UserError),
        ("--csv-out --output-delimiter ; sum 1", UserError), ("--vnlog -t ; sum x", UserError), ("--vnlog -F x sum x", UserError), ("sum weight", UserError), ("-g kind sum 1", UserError), ("top:1 weight", UserError), ("--exact -f sum 1", Refusal),
        ("--header-out --result-name=1:" + "n" * 512 + " sum 1", Refusal), ("--csv rmdup 1", Refusal), ("--csv-out check", Refusal),
        ("sum 3-1", UserError), ("-g 1 round 1", UserError), ("--csv transpose", Refusal), ("nothing 1", UserError), ("--format %d%d sum 1", UserError), ("", UserError),
    ],
)
def test_refused_before_reading(args, kind):
    with pytest.raises(kind):
        parse(args.split(" ") if args else [])


@pytest.mark.parametrize("args, text, said", [("sum 1", "1\nx\n", "invalid numeric value"), ("sum 2", "1\n", "missing"), ("sum 1", "1 \n", "invalid numeric"), ("--narm dotprod 1:2", "1\tNA\n2\t3\n", "different number"), ("wmean 1:2", "1\t-1\n", "nonnegative"), ("wmean 1:2", "1\t0\n", "no positive"), ("top:1 1", "nan\n", "NaN"), ("transpose", "a\tb\nc\n", "fields"), ("check", "a\tb\nc\n", "previous"), ("--csv sum 1", 'a"b\n', "invalid CSV"), ("debase64 1", "YW Jj\n", "base64")])
def test_data_errors(spark, tmp_path, args, text, said):
    with pytest.raises(Exception, match=said):
        lines(spark, tmp_path, args, text)


@pytest.mark.parametrize("value, format, want", [(1.5, "%.14g", "1.5"), (1e16, "%.14g", "1e+16"), (-0.0, "%g", "-0"), (math.nan, "%05g", "  nan"), (2.5, "%.0f", "2"), (3.0, "%a", "0x1.8p+1"), (1234567.5, "%'.1f", "1,234,567.5"), (7, "x%%%+5.1f%%", "x% +7.0%"), (math.inf, "%G", "INF")])
def test_number_display(value, format, want):
    assert show(value, format) == want


def test_health_reports(spark, tmp_path):
    text = "kind\tn\nplum\t4\nfig\tmany\n; none\npear\t\n"
    got = lines(spark, tmp_path, "-H -C health examples 1 tsv type n number required 2", text)
    cells = [x.split("\t") for x in got]
    assert cells[0][:3] == ["row_kind", "category", "basis"] and all(len(c) == 13 for c in cells)
    summary = {c[1]: (c[5], c[9]) for c in cells if c[0] == "summary"}
    assert len(summary) == 17 and summary["data_records"] == ("3", "") and summary["accepted_records"] == ("4", "") and summary["baseline_width_source"] == ("", "header")
    assert summary["separator"] == ("", "\\t") and summary["comment_filter"] == ("", "comments") and summary["example_limit"] == ("1", "")
    assert ["finding", "presence_mismatch", "declared", "2", "n", "1", "cells", "", "required", "", "", "", "0"] in cells
    assert ["example", "presence_mismatch", "declared", "2", "n", "", "", "4", "required", "empty", "", "no", ""] in cells
    assert ["example", "type_mismatch", "declared", "2", "n", "", "", "3", "number", "text", "many", "no", ""] in cells
    plain = lines(spark, tmp_path, "-H -C health examples 1", text)
    assert plain[:5] == ["Table health report", "Inspection complete: advisory findings", "Data records: 3", "Header records: 1", "Accepted records: 4"]
    assert '  Empty field values [observation, advisory]: 1 cell; field 2, name "n"; examples retained 1, omitted 0' in plain
    with pytest.raises(Violation) as failed:
        lines(spark, tmp_path, "-H -C health nonmissing n validate", text)
    assert failed.value.status == 1 and "Validation failed: supplied rules were not met" in failed.value.lines
    assert "Validation passed: supplied rules were met" in lines(spark, tmp_path, "-H -C health nonmissing kind validate", text)
    for args in ("-H health type 1 text type kind number", "-H health required weight", "--csv -H health"):
        with pytest.raises(UserError):
            lines(spark, tmp_path, args, text)
    with pytest.raises(UserError, match="ambiguous"):
        lines(spark, tmp_path, "-H health required k", "k\tk\n1\t2\n")


@pytest.mark.parametrize("words", ["exampels 3", "width x", "type 1 date", "required", "required k", "validate", "width 2 width 3"])
def test_health_words_are_checked(words):
    with pytest.raises(UserError):
        parse(["health", *words.split()])
