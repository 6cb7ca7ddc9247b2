import functools
import threading

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from tablewright.errors import UserError
from tablewright.operators import compare, exact, health, modes, seeded
from tablewright.operators.exact import show_long
from tablewright.operators.summary import op, summarise
from tablewright.plans.order import islands, ordinals
from tablewright.sources.strict_csv import read_csv, records
from tablewright.sources.text import ordered_lines
from tablewright.streaming.adjacent import adjacent_runs
from pyspark.sql import functions as F


def test_generator_vectors_and_jumps():
    assert seeded.draws(0, 0, 8).tolist() == [1804289383, 846930886, 1681692777, 1714636915, 1957747793, 424238335, 719885386, 1649760492]
    assert seeded.draws(7, 0, 8).tolist() == [1045618677, 1863967299, 1272579899, 461085871, 21961325, 1105564443, 2138782586, 68574097]
    long = seeded.draws(7, 0, 3000)
    assert seeded.draws(7, 2900, 100).tolist() == long[2900:].tolist()


@pytest.mark.parametrize("buckets", [1, 3, 8])
def test_islands_do_not_depend_on_buckets(spark, buckets):
    rng = np.random.default_rng(1)
    keys = rng.choice(["a", "b", None], 300, p=[0.5, 0.4, 0.1]).tolist()
    df = spark.createDataFrame(pd.DataFrame({"rid": range(300), "k": keys}), "rid long, k string").repartition(5)
    got = {r.rid: r._gid for r in islands(df, [F.col("k")], "rid", buckets=buckets).collect()}
    gid, want = 0, {}
    for i, k in enumerate(keys):
        gid = i if i == 0 or k != keys[i - 1] else gid
        want[i] = gid
    assert got == want
    assert [r._line for r in ordinals(df, "rid", buckets=buckets).orderBy("rid").collect()] == list(range(1, 301))


def test_sorted_equals_adjacent_on_sorted_rows(spark):
    df = spark.range(200).select(F.col("id").alias("rid"), F.floor(F.col("id") / 17).alias("k"), (F.col("id") % 5).cast("double").alias("v"))
    ops = [op("sum", "v", alias="s"), op("median", "v", alias="m"), op("collapse", "v", alias="c")]
    assert summarise(df, ops, ["k"], "rid").collect() == summarise(df, ops, ["k"], "rid", sort=False).collect()


def test_comparison_with_itself_is_zero(spark):
    df = spark.range(50).select((F.col("id") % 7).alias("k"), F.col("id").cast("double").alias("v"))
    got = compare.compare(df, df, [op("sum", "v", alias="s")], ["k"]).collect()
    assert len(got) == 7 and all(r.s_difference == 0 and r.presence == "matched" for r in got)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "rid long, k string, v double")
    assert summarise(df, [op("sum", "v"), op("median", "v")], rid="rid").count() == 0
    assert summarise(df, [op("sum", "v")], ["k"], "rid", sort=False).count() == 0


def test_strict_csv(spark, tmp_path):
    text = 'a,b\r\n"x,1","say ""hi""\nthere"\n\n,"",z'
    assert list(records(text)) == [(1, ["a", "b"]), (2, ["x,1", 'say "hi"\nthere']), (4, [""]), (5, ["", "", "z"])]
    for bad, said in (('a"b', "quote in an unquoted"), ('"a"b', "after a closing"), ('"a', "end of input"), ("a\rb", "bare carriage")):
        with pytest.raises(UserError, match=said):
            list(records(bad))
    (tmp_path / "1.csv").write_text("h,i\n1,2\n3,4\n")
    (tmp_path / "2.csv").write_text("5,6\n")
    table = read_csv(spark, str(tmp_path), header=True)
    assert table.names == ("h", "i") and [(r.rid, r.fields) for r in table.rows.orderBy("rid").collect()] == [(2, ["1", "2"]), (3, ["3", "4"]), (4, ["5", "6"])]


def test_csv_records_cross_blocks(spark, tmp_path):
    rng = np.random.default_rng(5)
    cell = lambda: "".join(rng.choice(list('ab,"\n '), int(rng.integers(0, 30))))
    quoted = lambda c: '"' + c.replace('"', '""') + '"'
    want = {}
    for name, n in (("a.csv", 400), ("b.csv", 150), ("c.csv", 3)):
        rows = [[f"{name}{i}", cell(), "plain", "x\n" * 60 if i % 97 == 0 else ""] for i in range(n)]
        (tmp_path / name).write_text("".join(",".join(c if c == "plain" else quoted(c) for c in r) + ("\r\n" if i % 2 else "\n") for i, r in enumerate(rows)))
        want[name] = rows
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = read_csv(spark, str(tmp_path)).rows.orderBy("rid").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.fields for r in got] == [r for name in ("a.csv", "b.csv", "c.csv") for r in want[name]]
    (tmp_path / "d.csv").write_text('a,b\n"open,c\n')
    with pytest.raises(Exception, match="end of input inside quotes in line"):
        read_csv(spark, str(tmp_path / "d.csv")).rows.collect()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='ab",\n\r ', max_size=6), min_size=1, max_size=4), min_size=1, max_size=5))
def test_csv_round_trip(rows):
    text = "".join(",".join('"' + c.replace('"', '""') + '"' for c in r) + "\n" for r in rows)
    assert [f for _, f in records(text)] == rows


def test_line_numbers_over_blocks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {i}\n" for i in range(20000)))
    (tmp_path / "b.txt").write_text("last\r\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        got = ordered_lines(spark, str(tmp_path)).orderBy("rid").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.value for r in got] == [f"line {i}" for i in range(20000)] + ["last\r"]
    assert [r.rid for r in got] == list(range(1, 20002))


def test_health_of_a_ragged_table(spark):
    rows = [(2, ["a", "1"]), (3, ["b", "x"]), (4, ["c"]), (5, ["", "NA"]), (6, ["d", "2.5", "extra" * 40])]
    df = spark.createDataFrame(rows, "rid long, fields array<string>").repartition(3).select("rid", F.array_join("fields", "\t").alias("raw"), "fields")
    report = health.inspect(df, ["k", "k"], types={2: "integer", 9: "text"}, presence={2: "nonmissing"}, examples=2)
    found = {(f.category, f.basis, f.field and f.field.position): (f.count, [(e.record, e.observed, e.truncated) for e in f.examples]) for f in report.findings}
    assert found == {
        ("width_mismatch", "inferred", None): (2, [(4, "1", False), (6, "3", True)]),
        ("duplicate_header", "observation", 1): (1, [(1, "duplicate", False)]),
        ("duplicate_header", "observation", 2): (1, [(1, "duplicate", False)]),
        ("absent_field", "observation", 2): (1, [(4, "absent", False)]),
        ("absent_field", "observation", 3): (4, [(2, "absent", False), (3, "absent", False)]),
        ("absent_field", "observation", 9): (5, [(2, "absent", False), (3, "absent", False)]),
        ("empty_field", "observation", 1): (1, [(5, "empty", False)]),
        ("missing_indicator", "observation", 2): (1, [(5, "missing_indicator", False)]),
        ("mixed_types", "observation", 2): (1, [(2, "integer", False), (3, "text", False)]),
        ("type_mismatch", "declared", 2): (2, [(3, "text", False), (6, "other_number", False)]),
        ("presence_mismatch", "declared", 2): (2, [(4, "absent", False), (5, "missing_indicator", False)]),
    }
    assert report.violated and report.records == 5 and report.widest == 3
    told = health.table(spark, report).where("row_kind = 'example' and category = 'width_mismatch' and sample_truncated = 'yes'").first()
    assert (told.record_index, told.observed, told.sample) == (6, "3", "d\\t2.5\\t" + ("extra" * 40)[:122])
    assert [len(x.split("\t")) for x in health.tsv(report)] == [13] * len(health.tsv(report))
    plan = health.profile(df, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    empty = health.inspect(df.limit(0), examples=0)
    assert (empty.records, empty.baseline, empty.source, empty.findings, empty.fields) == (0, None, "unavailable", [], [])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["", "NA", "n/a", "12", " +7", "1.5", "0x1F", "-inf", "nan(3)", "x", "1 ", "é", "7e", "NaN "]), max_size=12))
def test_health_classes(values):
    import re

    from tablewright.functions.values import NUMBER

    def kind(v):
        if v == "":
            return "empty"
        if v.lower() in ("na", "n/a", "nan"):
            return "missing"
        return "integer" if re.search(health.INTEGER, v) else "other_number" if re.search(NUMBER.replace("(?i:inf(?:inity)?|nan", "(?:inf(?:inity)?|nan"), v, re.I) else "text"

    got = health.classes(pa.array([v.encode() for v in values], pa.binary()))
    assert [health.CLASSES[k] for k in got] == [kind(v) for v in values]


def test_extended_display():
    assert [show_long(np.longdouble(x)) for x in ("0", "-0", "1", "123456789012345678", "0.00001", "1e300", "nan", "-inf", "2.5")] == ["0", "-0", "1", "1.2345678901235e+17", "1e-05", "1e+300", "nan", "-inf", "2.5"]


def test_streamed_runs(spark, tmp_path):
    rows = [(i, "ab"[(i // 3) % 2], float(i)) for i in range(14)]
    for n in range(3):
        part = [r for r in rows if r[0] // 5 == n]
        spark.createDataFrame([("s", *r, r[0] == 13) for r in part], "src string, rid long, k string, v double, final boolean").coalesce(1).write.parquet(str(tmp_path / f"in/p{n}"))
    schema = "src string, rid long, k string, v double, final boolean"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    runs = adjacent_runs(stream, "src", "k", "v", "rid", "final")
    query = runs.writeStream.format("memory").queryName("runs").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = [(r.run, r.key, r.n, r.total) for r in spark.sql("select * from runs order by run").collect()]
    assert got == [(1, "a", 3, 3.0), (2, "b", 3, 12.0), (3, "a", 3, 21.0), (4, "b", 3, 30.0), (5, "a", 2, 25.0)]


def test_paired_under_narm_holds_no_group(spark):
    rows = [(i, "a" if i % 3 else None, None if i % 4 == 1 else float(i), None if i % 4 == 2 else i * 2.0) for i in range(48)]
    df = spark.createDataFrame(rows, "rid long, k string, x double, y double")
    got = summarise(df, [op("dotprod", "x", "y", alias="v"), op("ppearson", "x", "y", alias="p")], ["k"], "rid", narm=True)
    assert "collect_list" not in got._jdf.queryExecution().toString()
    found = got.collect()
    assert {r.k for r in found} == {"a", None}
    for r in found:
        own = [z for z in rows if z[1] == r.k]
        pairs = list(zip([z[2] for z in own if z[2] is not None], [z[3] for z in own if z[3] is not None]))
        assert r.v == sum(a * b for a, b in pairs) and 0.9 < r.p <= 1


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 2), st.one_of(st.sampled_from([0.0, 1.0, 2.5, float("inf"), float("nan"), -float("inf")]), st.floats(-1e9, 1e9))), min_size=1, max_size=60))
def test_order_statistics_match_percentile(spark, rows):
    df = spark.createDataFrame(rows, "k int, v double")
    ops = [op("q1", "v", alias="a"), op("median", "v", alias="b"), op("q3", "v", alias="c"), op("perc", "v", param=37, alias="d")]
    got = {r.k: tuple(r[1:]) for r in summarise(df, ops, ["k"]).collect()}
    want = {r.k: tuple(r.p) for r in df.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.37)))).alias("p")).collect()}
    assert got.keys() == want.keys()
    for k in got:
        assert np.allclose(got[k], want[k], rtol=1e-9, atol=1e-9, equal_nan=True), (k, got[k], want[k])


def test_order_statistics_of_many_sizes(spark):
    # Group k has 1 to 97 values or, from k = 90 on, about 40,000 and more: there brackets have bounds. Some repeat a lot.
    sizes = [*range(1, 98, 4), 39_990, 40_001, 40_013, 60_007, 90_000]
    parts = [spark.range(n).select(F.lit(n).alias("k"), (F.xxhash64("id", F.lit(n)) % (7 if n % 2 else 1_000_003)).cast("double").alias("v")) for n in sizes]
    df = functools.reduce(lambda a, b: a.unionByName(b), parts)
    points = (0.25, 0.5, 0.75, 0.01, 0.99, 1.0)
    ops = [op("q1", "v", alias="a"), op("median", "v", alias="b"), op("q3", "v", alias="c"), op("perc", "v", param=1, alias="d"), op("perc", "v", param=99, alias="e"), op("perc", "v", param=100, alias="f")]
    want = {r.k: r.p for r in df.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, points))).alias("p")).collect()}
    alone = [{r.k: r[1] for r in summarise(df, [o], ["k"]).collect()} for o in ops[1:4]]
    got = summarise(df, ops, ["k"]).collect()
    assert len(got) == len(sizes)
    for r in got:
        assert np.allclose(r[1:], want[r.k], rtol=1e-12), r.k
        assert [a[r.k] for a in alone] == list(r[2:5])


def test_order_statistics_of_a_large_group_hold_a_small_share(spark):
    df = spark.range(300_000).select(F.lit("a").alias("k"), ((F.col("id") * 7919) % 300_007).cast("double").alias("v"))
    got = summarise(df, [op("median", "v", alias="m"), op("iqr", "v", alias="i"), op("perc", "v", param=99, alias="p")], ["k"])
    want = df.agg(F.percentile("v", F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.99))))).first()[0]
    assert np.allclose(got.first()[1:], [want[1], want[2] - want[0], want[3]])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(-900, 900), min_size=4, max_size=30).filter(lambda v: len(set(v)) > 1))
def test_extended_operations_match_definitions(values):
    x = np.array(values, np.longdouble)
    n, s = len(values), sorted(values)
    d = [v - sum(values) / n for v in values]
    m = lambda k: sum(v**k for v in d) / n
    skew, kurt = m(3) / m(2) ** 1.5, m(4) / m(2) ** 2 - 3
    median = np.median(values)
    often = {v: values.count(v) for v in s}
    want = {
        "absmin": min(values, key=abs), "absmax": max(values, key=abs), "perc": np.percentile(values, 30), "mode": min(often, key=lambda v: (-often[v], v)), "antimode": min(often, key=lambda v: (often[v], v)),
        "madraw": np.median([abs(v - median) for v in values]), "pskew": skew, "pkurt": kurt, "sskew": skew * (n * (n - 1)) ** 0.5 / (n - 2), "skurt": ((n + 1) * kurt + 6) * (n - 1) / ((n - 2) * (n - 3)),
        "trimmean": np.mean(s[int(n * 0.2) : n - int(n * 0.2)]),
    }
    for name, value in want.items():
        more = {"perc": [30], "trimmean": [0.2]}.get(name, [])
        assert np.isclose(float(exact.EXACT[name](x, *more)), value, rtol=1e-9, atol=1e-9), name


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_seeded_choices_follow_the_stream(spark, keys):
    rng = np.random.default_rng(8)
    rows = [(i, str(rng.integers(0, 9)), None if rng.random() < 0.2 else f"v{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "rid long, k string, v string").repartition(5)
    got = {tuple(r[:-1]): r[-1] for r in seeded.seeded_rand(df, [op("rand", "v", alias="chosen")], 11, "rid", keys).collect()}
    groups = sorted({r[1] for r in rows}) if keys else [None]
    stream, at, want = seeded.draws(11, 0, 400), 0, {}
    for g in groups:
        n = 0
        for _, k, v in rows:
            if v is not None and (g is None or k == g):
                n += 1
                if n == 1 or stream[at] % n == 0:
                    want[(g,) if keys else ()] = v
                at += 1
    assert got == want


def _spelt(pairs):
    """Of (rid, value) pairs the distinct values without regard to case, as first spelt, in the order of their folded bytes."""
    first = {}
    for _, v in sorted(pairs):
        if v is not None:
            first.setdefault("".join(c.lower() if c.isascii() else c for c in v), v)
    return ",".join(first[f] for f in sorted(first, key=lambda f: f.encode()))


@pytest.mark.parametrize("narm", [False, True])
def test_spellings_without_case(spark, narm):
    rng = np.random.default_rng(3)
    values = ["Fig", "FIG", "fig", "plum", "PLUM", "_x", "[y", "Äpfel", "äpfel", "", "NA", None]
    rows = [(i, ["k", "K", "ä", "Ä", None][rng.integers(0, 5)], "lL"[rng.integers(0, 2)], values[rng.integers(0, len(values))]) for i in rng.permutation(300).tolist()]
    rows += [(300, "only", "l", "n/a"), (301, "only", "L", None)]
    df = spark.createDataFrame(rows, "rid long, k string, l string, v string").repartition(5)
    there = lambda v: None if narm and v and v.lower() in ("na", "n/a", "nan") else v
    folded = lambda k: k and k.replace("K", "k")
    ops = [op("unique", "v", alias="u"), op("count", "v", alias="n"), op("unique", "l", alias="w")]

    def want(members):
        return _spelt([(r[0], there(r[3])) for r in members]), sum(there(r[3]) is not None for r in members), _spelt([(r[0], r[2]) for r in members])

    groups, runs = {}, []
    for r in sorted(rows, key=lambda r: r[0]):
        groups.setdefault(folded(r[1]), []).append(r)
        if runs and folded(runs[-1][0][1]) == folded(r[1]):
            runs[-1].append(r)
        else:
            runs.append([r])
    got = summarise(df, ops, ["k"], "rid", narm=narm, ignore_case=True).collect()
    assert {folded(r.k): (r.k, r.u, r.n, r.w) for r in got} == {k: (m[0][1], *want(m)) for k, m in groups.items()} and len(got) == len(groups)
    got = summarise(df, ops, ["k"], "rid", sort=False, narm=narm, ignore_case=True).collect()
    assert [(r.k, r.u, r.n, r.w) for r in got] == [(m[0][1], *want(m)) for m in runs]
    assert [tuple(r) for r in summarise(df, ops, rid="rid", narm=narm, ignore_case=True).collect()] == [want(rows)]
    drawn = seeded.seeded_rand(df, [op("rand", "v", alias="r"), *ops], 7, "rid", ["k"], narm=narm, ignore_case=True).collect()
    assert {folded(r.k): (r.k, r.u, r.n, r.w) for r in drawn} == {k: (m[0][1], *want(m)) for k, m in groups.items()}
    table = {r.k: r.l for r in modes.crosstab(df, "k", "l", ops[0], "rid", ignore_case=True, narm=narm).collect()}
    assert table == {k: want(m)[0] for k, m in groups.items()}
    table = {r.k: r.l for r in modes.crosstab(df, "k", "l", ops[0], "rid", sort=False, ignore_case=True, narm=narm).collect()}
    assert table == {k: want(next(m for m in runs if folded(m[0][1]) == k))[0] for k in groups}
    with pytest.raises(UserError, match="row order"):
        summarise(df, ops, ignore_case=True)


@pytest.mark.parametrize("how", ["sorted", "adjacent", "whole", "seeded", "crosstab"])
def test_spellings_of_a_large_group(spark, how):
    """A group's rows were sorted once for each of them: 100,000 rows didn't end."""
    n = 100_000
    word = F.concat(F.lit("w"), (F.col("id") % 3).cast("string"))
    df = spark.range(n).select(F.col("id").alias("rid"), F.when(F.col("id") % 2 == 0, "K").otherwise("k").alias("k"), F.when(F.col("id") % 4 == 1, F.upper(word)).otherwise(word).alias("v"))
    ops = [op("unique", "v", alias="u")]
    made = {
        "sorted": lambda: summarise(df, ops, ["k"], "rid", ignore_case=True),
        "adjacent": lambda: summarise(df, ops, ["k"], "rid", sort=False, ignore_case=True),
        "whole": lambda: summarise(df, ops, rid="rid", ignore_case=True),
        "seeded": lambda: seeded.seeded_rand(df, [op("rand", "v", alias="r"), *ops], 7, "rid", ["k"], ignore_case=True).select("u"),
        "crosstab": lambda: modes.crosstab(df.withColumn("j", F.lit("row")), "j", "k", ops[0], "rid", ignore_case=True),
    }
    late = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        assert [r[-1] for r in made[how]().collect()] == ["w0,W1,w2"]
    finally:
        late.cancel()
